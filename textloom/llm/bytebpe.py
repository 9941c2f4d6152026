"""Byte-level BPE with vectorised pre-tokenisation.

A slice of texts becomes an array of code points, and each code point one of eight
symbols (letter, number, other, kinds of white space and apostrophe, told apart by the one
or two code points that follow). Eight states describe the piece a symbol would continue;
a symbol is a function from states to states. Functions compose associatively, so the scan
runs over all blocks of the slice at once: each block is composed from every state, the
blocks are chained, and a second pass marks where pieces start. No regular expression is
involved. Pieces are slices of the bytes; merges of a piece are cached.

Nulls and empty texts have no tokens. Each row is encoded by itself, so repeated rows get
equal results. ``encode`` adds ``ids`` (little-endian unsigned 32-bit integers) and
``starts`` (byte offset of every token, same layout); ``decode`` adds ``decoded``. Input
columns of these names are replaced.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import struct
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, types as T

from textloom.llm.common import map_texts

#: Pieces whose tokens are remembered; at the bound the memory starts anew.
CACHE = 1 << 17
#: Bytes that are worked on at once: every piece of them is a Python object.
SLICE = 1 << 18
#: Rank of pairs that make no token.
NEVER = 1 << 40
#: Bytes up to which pieces are merged together; longer ones go by a heap each.
SHORT_PIECE = 48
#: Code points in a block of the scan.
BLOCK = 128

LETTER, NUMBER, OTHER, JOIN, ALONE, SPACE, SHORT, LONG = range(8)
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, JOINED, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
#: White space of the pattern's `\s`. Fixed values of the Unicode property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start-of-piece, at state * 16 + symbol; symbols from 8 begin a text."""
    after, begins = np.zeros((8, 16), np.uint8), np.ones((8, 16), bool)
    after[:, :8] = [IN_LETTER, IN_NUMBER, IN_OTHER, JOINED, NONE, IN_SPACE, ONE_LEFT, TWO_LEFT]
    for state, symbol, to in (
        (IN_LETTER, LETTER, IN_LETTER),
        (IN_NUMBER, NUMBER, IN_NUMBER),
        (IN_SPACE, SPACE, IN_SPACE),
        (JOINED, LETTER, IN_LETTER),
        (JOINED, NUMBER, IN_NUMBER),
        (TWO_LEFT, LETTER, ONE_LEFT),
        (ONE_LEFT, LETTER, NONE),
        *((s, x, IN_OTHER) for s in (IN_OTHER, JOINED) for x in (OTHER, SHORT, LONG)),
    ):
        after[state, symbol], begins[state, symbol] = to, False
    after[:, 8:] = after[NONE, :8]
    return after.ravel(), begins.ravel()


def symbols(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The symbol of every code point; offsets are those of the texts."""
    n = len(points)
    out = classes()[points]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    ends = np.zeros(n, bool)
    ends[last] = True
    white = out == SPACE
    follows = np.ones(n, bool)
    follows[:-1] = white[1:]
    follows[last] = True
    out[white & ~follows] = ALONE
    out[white & ~follows & (points == 0x20)] = JOIN
    at = np.flatnonzero((points == 0x27) & ~ends)
    one = points[at + 1]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    two = np.where(ends[at + 1], 0, points[np.minimum(at + 2, n - 1)])
    pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[at[pairs]] = LONG
    out[first] += 8
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, by a blocked scan of transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    after, begins = transitions()
    width = -(-n // BLOCK)
    padded = np.zeros(width * BLOCK, np.uint8)
    padded[:n] = symbols(points, offsets)
    rows = np.ascontiguousarray(padded.reshape(width, BLOCK).T)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], width, axis=1)
    for row in rows:
        whole = after[(whole << 4) + row]
    chain, state = np.zeros(width, np.uint8), 0
    for b, f in enumerate(whole.T.tolist()):
        chain[b] = state
        state = f[state]
    marks = np.zeros((BLOCK, width), bool)
    for i, row in enumerate(rows):
        at = (chain << 4) + row
        marks[i] = begins[at]
        chain = after[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class Merger:
    """Merges of pieces by rank, remembered as packed 32-bit token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Arrays of whole numbers from the start: a dictionary of so many would stay in a worker's memory.
        pairs, merged = array.array("q"), array.array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        found = np.array(pairs, np.int64)
        order = np.argsort(found)
        self.pairs, self.merged = found[order], np.array(merged, np.int64)[order]

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of pieces; those not remembered are merged together."""
        found = list(map(self.cache.get, pieces))
        if None in found:
            new = {p for p, f in zip(pieces, found) if f is None}
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = set(pieces)
            self.learn(list(new))
            found = list(map(self.cache.__getitem__, pieces))
        return found

    def learn(self, pieces: list[bytes]) -> None:
        short = []
        for piece in pieces:
            if piece in self.ranks:
                self.cache[piece] = struct.pack("<I", self.ranks[piece])
            elif len(piece) <= SHORT_PIECE:
                short.append(piece)
            else:
                ids = [self.ranks[p] for p in self._merge(piece)]
                self.cache[piece] = struct.pack(f"<{len(ids)}I", *ids)
        if short:
            self.cache.update(zip(short, self._merge_together(short)))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair makes, or NEVER."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.merged[at], NEVER)

    def _merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """In each round every piece merges its pair of least rank, the leftmost of equals."""
        out: list[bytes] = [b""] * len(pieces)
        token = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.append(np.where(owner[1:] == owner[:-1], self._rank(token[:-1], token[1:]), NEVER), NEVER)
        while len(token):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(token))))
            done = least == NEVER
            if done.any():
                ids, whose = token[done], owner[done]
                cuts = np.append(np.flatnonzero(np.append(True, whose[1:] != whose[:-1])), len(ids))
                raw = ids.astype("<u4").tobytes()
                for i, a, b in zip(whose[cuts[:-1]].tolist(), cuts.tolist(), cuts[1:].tolist()):
                    out[i] = raw[4 * a : 4 * b]
                token, owner, rank, least = token[~done], owner[~done], rank[~done], least[~done]
                if not len(token):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            token, owner, rank = token[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(token) - 1)
                rank[i] = np.where((j > i) & (owner[i] == owner[j]), self._rank(token[i], token[j]), NEVER)
        return out

    def _merge(self, piece: bytes) -> list[bytes]:
        """Always the pair of least rank, the leftmost of equals; n log n in the length."""
        ranks, n = self.ranks, len(piece)
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i):
            j = end[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if j <= 0 or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, starts: bool = False) -> DataFrame:
    """Token ids of every whole text, and with ``starts`` the tokens' byte offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    added = T.StructType([T.StructField("ids", T.BinaryType())])
    if starts:
        added.add("starts", T.BinaryType())

    def make():
        merge = Merger(shared.value)
        sizes = np.zeros(max(shared.value.values(), default=0) + 1, np.int64)
        for token, rank in shared.value.items():
            sizes[rank] = len(token)

        def work(data, offsets):
            raw = data.tobytes()
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            points = data if len(lead) == len(data) else np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
            places = np.searchsorted(lead, offsets)
            begin = lead[piece_starts(points, places)]
            first = np.searchsorted(begin, offsets).tolist()
            cuts = [*begin.tolist(), len(raw)]
            made = merge(list(map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
            out = {"ids": [b"".join(made[a:b]) for a, b in zip(first, first[1:])]}
            if starts:
                out["starts"] = [_offsets(sizes[np.frombuffer(ids, "<u4")]) for ids in out["ids"]]
            return out

        return work

    return map_texts(docs, make, added, docs.columns if keep is None else keep, limit=SLICE)


def _offsets(sizes: np.ndarray) -> bytes:
    return (np.cumsum(sizes) - sizes).astype("<u4").tobytes()


def decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The bytes that the ``ids`` of every row stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    added = T.StructType([T.StructField("decoded", T.BinaryType())])

    def make():
        tokens = {rank: token for token, rank in shared.value.items()}

        def work(data, offsets):
            made = list(map(tokens.__getitem__, data.view("<u4").tolist()))
            at = (offsets // 4).tolist()
            return {"decoded": [b"".join(made[a:b]) for a, b in zip(at, at[1:])]}

        return work

    return map_texts(docs, make, added, docs.columns if keep is None else keep, text="ids", limit=SLICE)
