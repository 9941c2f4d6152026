"""BPE with word ends by forced-boundary splitting.

Texts are composed (NFC) and lower-cased, words are found by the classes of their code
points, and every byte becomes a symbol that also tells whether it ends its word. Two
neighbouring symbols that no token of the vocabulary holds side by side can never be
merged across, so the place between them is a certain cut. All cuts of a slice of texts
come from one look-up in a table of symbol pairs; word ends are among them, as no token
goes on after a word end. The fragments between cuts are encoded independently, each
distinct one once in a while, and their ids are concatenated.

Strings of added tokens inside a text stand for the token, as the library of the
vocabulary file has it; the text on both sides is then handled apart. Null and empty texts
and those of white space alone have no tokens. Rows are encoded by themselves, so repeated
rows get equal results. ``encode`` adds ``ids`` (little-endian unsigned 32-bit integers),
``decode`` adds ``decoded``: the tokens' own strings with a space between, which is what
decoding is for a vocabulary that names no decoder. Input columns of these names are
replaced.

Code points that Unicode assigned only lately may count as letters, or have a lower case,
in one library and not in another; those are read by Python's tables here.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, types as T

from textloom.llm.bytebpe import LETTER, NUMBER, OTHER, SPACE, classes
from textloom.llm.common import map_texts

#: Fragments whose ids are remembered; at the bound the memory starts anew.
CACHE = 1 << 19
#: Symbols up to which fragments are merged together; longer ones go by a heap each.
SHORT = 48
#: Rank of a pair that makes no token.
NEVER = 1 << 40
#: Added to the last byte of a word.
END = 256
#: The word pattern of the vocabulary files this operator reads.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    plain = set(shown)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Ids of the 512 symbols, merges by pairs of ids, and pairs of symbols inside tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or split != PATTERN or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a BPE vocabulary with word ends in lower case")
        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        symbols = letters + [x + suffix for x in letters]
        missing = [s for s in symbols if s not in vocab]
        if missing:
            raise ValueError(f"the vocabulary has no token for {missing[:5]}")
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.strings = {i: token for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: token for token, i in self.added.items()}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.pairs = pairs
        ordered = sorted(pairs)
        self.keys = np.array([a << 32 | b for a, b in ordered], np.int64)
        self.ranks = np.array([pairs[k][0] for k in ordered], np.int64)
        self.made = np.array([pairs[k][1] for k in ordered], np.int64)
        self.inside = self._inside(vocab, suffix, letters)

    @staticmethod
    def _inside(vocab, suffix: str, letters: list[str]) -> np.ndarray:
        """Whether some token holds two symbols side by side."""
        byte = {x: b for b, x in enumerate(letters)}
        out = np.zeros((2 * END, 2 * END), bool)
        for token in vocab:
            # A token may also spell the suffix out, so both readings count.
            readings = [(token, 0)] + ([(token[: -len(suffix)], END)] if token.endswith(suffix) else [])
            for letters_of, end in readings:
                found = [byte.get(x) for x in letters_of]
                if found and None not in found:
                    found[-1] += end
                    out[found[:-1], found[1:]] = True
        return out


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Flags of code points that begin a word; white space is in no word."""
    n = len(points)
    before = np.concatenate([[SPACE], kind[:-1]])
    starts = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    # A contraction is read only where a word may begin, so not inside a run of other signs.
    at = np.flatnonzero((points == 0x27) & (before != OTHER))
    at = at[at + 1 < n]
    one = points[at + 1]
    two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    starts[at[short | long] + 1] = False
    for whole, size in ((at[short], 2), (at[long], 3)):
        after = whole[whole + size < n] + size
        starts[after] = kind[after] != SPACE
    return starts


class Encoder:
    """Ids of the fragments of a task, remembered as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cache = vocabulary, {}

    def fragments(self, joined: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Symbols of each fragment, the byte where it begins, and the bytes' places."""
        raw = np.frombuffer(joined.encode(), np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = classes()[points]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        sizes = np.diff(np.append(lead, len(raw)))
        space = np.repeat(kind == SPACE, sizes)
        starts = np.zeros(len(raw) + 1, bool)
        starts[lead[word_starts(points, kind)]] = True
        stop = starts[1:].copy()
        stop[:-1] |= space[1:]
        stop[-1:] = True
        at = np.flatnonzero(~space)
        symbols = (raw.astype("<u2") + END * stop.astype("<u2"))[at]
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.v.inside[symbols[:-1], symbols[1:]]
        begin = np.flatnonzero(cut)
        whole, cuts = symbols.tobytes(), [*(2 * begin).tolist(), 2 * len(symbols)]
        return list(map(whole.__getitem__, map(slice, cuts, cuts[1:]))), at[begin], lead

    def ids(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of fragments; those not remembered are merged together."""
        found = list(map(self.cache.get, fragments))
        if None in found:
            new = {p for p, f in zip(fragments, found) if f is None}
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = set(fragments)
            self._learn(sorted(new))
            found = list(map(self.cache.__getitem__, fragments))
        return found

    def _learn(self, fragments: list[bytes]) -> None:
        short = [x for x in fragments if len(x) <= 2 * SHORT]
        for x in fragments:
            if len(x) > 2 * SHORT:
                self.cache[x] = self._merge_long(self.v.first[np.frombuffer(x, "<u2")].tolist())
        if short:
            self.cache.update(zip(short, self._merge_together(short)))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of a pair, or NEVER, and the token that it makes."""
        key = left << 32 | right
        at = np.searchsorted(self.v.keys, key)
        at[at == len(self.v.keys)] = 0
        return np.where(self.v.keys[at] == key, self.v.ranks[at], NEVER), self.v.made[at]

    def _merge_together(self, fragments: list[bytes]) -> list[bytes]:
        """In each round every fragment merges its pair of least rank, the leftmost of equals."""
        sizes = np.array([len(x) // 2 for x in fragments])
        token = self.v.first[np.frombuffer(b"".join(fragments), "<u2")]
        owner = np.repeat(np.arange(len(fragments)), sizes)
        done_ids, done_owner = [], []
        while len(token):
            rank, made = self._rank(token[:-1], token[1:])
            rank = np.append(np.where(owner[1:] == owner[:-1], rank, NEVER), NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(token))))
            done = least == NEVER
            done_ids.append(token[done])
            done_owner.append(owner[done])
            at = np.flatnonzero((rank == least) & ~done)
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            token[at] = made[at]
            keep = ~done
            keep[at + 1] = False
            token, owner = token[keep], owner[keep]
        ids, whose = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(whose, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(whose, minlength=len(fragments))) * 4
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _merge_long(self, ids: list[int]) -> bytes:
        """Always the pair of least rank, the leftmost of equals; n log n in the length."""
        pairs, n = self.v.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[ids[i], ids[i + 1]], i, ids[i], ids[i + 1]) for i in range(n - 1) if (ids[i], ids[i + 1]) in pairs]
        heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (found := pairs.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (found[0], p, found[1], ids[p], ids[q]))
        kept = [x for x in ids if x >= 0]
        return struct.pack(f"<{len(kept)}I", *kept)


def normal(text: str) -> str:
    """Composed, and in lower case letter by letter: a last sigma is like any other."""
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Token ids of every whole text."""
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(json.load(file)))

    def make():
        encoder = Encoder(shared.value)
        added = shared.value.added
        special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        marks = {min(x[:2] for x in added)} if added else set()

        def work(data, offsets):
            raw, at = data.tobytes(), offsets.tolist()
            parts, marked, first = [], {}, [0]
            for a, b in zip(at, at[1:]):
                text = raw[a:b].decode()
                cut = special.split(text) if special and any(m in text for m in marks) else [text]
                for i, part in enumerate(cut):
                    if i % 2:
                        marked[len(parts) - 1] = struct.pack("<I", added[part])
                    else:
                        parts.append(normal(part))
                first.append(len(parts))
            # White space between the parts ends their words.
            joined = "\n".join(parts)
            fragments, begin, lead = encoder.fragments(joined)
            places = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
            bounds = np.searchsorted(begin, np.append(lead, [len(joined.encode())] * 2)[np.minimum(places, len(lead) + 1)])
            made, bounds = encoder.ids(fragments), bounds.tolist()
            if not marked:
                return {"ids": [b"".join(made[bounds[a] : bounds[b]]) for a, b in zip(first, first[1:])]}
            of_part = [b"".join(made[a:b]) + marked.get(p, b"") for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            return {"ids": [b"".join(of_part[a:b]) for a, b in zip(first, first[1:])]}

        return work

    return map_texts(docs, make, T.StructType([T.StructField("ids", T.BinaryType())]), docs.columns if keep is None else keep)


def decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The text that the ``ids`` of every row stand for."""
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(json.load(file)).strings)

    def make():
        strings = shared.value

        def work(data, offsets):
            made = list(map(strings.__getitem__, data.view("<u4").tolist()))
            at = (offsets // 4).tolist()
            return {"decoded": [" ".join(made[a:b]) for a, b in zip(at, at[1:])]}

        return work

    added = T.StructType([T.StructField("decoded", T.StringType())])
    return map_texts(docs, make, added, docs.columns if keep is None else keep, text="ids")
