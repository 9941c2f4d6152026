"""Alignment of two tokenizers by lockstep vectorised merging.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (sentence pieces, which
add that space themselves) the text. The tokens of both cover the same bytes. All documents
of a slice are merged at the same time: two vectors hold the current A and B token of every
lane, a lane being a document or, of a long one, a stretch of ``LANE`` bytes. One step links
the two tokens of every lane, advances in each the token that ends first (both where they
end together, which is a cut), and drops lanes that are finished. The number of steps is
bounded by the stretch, whatever the lengths of the texts.

Long texts reach the tokenizers in parts. They are parted at a single space between two
ASCII letters, where neither tokenizer can have a token go on (that no piece of B holds a
letter and then a space is checked when the files are read), so parts give the tokens of
the whole. Texts that are null or empty, and those whose joined A or B bytes are not the
space and the text, have no tokens. Repeated rows, ids included, are rows of their own.

``align`` returns documents and, between them, one row for each block of about
``BLOCK_BYTES`` of documents: the id pairs linked in the block and how many documents hold
each. ``link_counts`` sums these over the corpus, and ``score`` brings each block its own
pairs' counts, so what crosses the network is a row per block and pair and not per link.
Columns of the names in ``ADDED`` are replaced.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm.common import slices
from textloom.sources.tables import checkpoint

#: Bytes of text in a block, and in a lane.
BLOCK_BYTES = 8 << 20
LANE = 4096
#: Bytes of text that a tokenizer gets at once, where the text can be parted.
PART = 1 << 16
BREAK = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")

DOC = [("block", T.LongType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()),
       ("groups", T.StringType()), ("at", T.ArrayType(T.IntegerType())), ("times", T.ArrayType(T.IntegerType()))]
OF_BLOCK = [("pairs", T.ArrayType(T.LongType())), ("holders", T.ArrayType(T.LongType()))]
ADDED = [name for name, _ in DOC + OF_BLOCK]


class Tokenizers:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from textloom.llm.wordbpe import byte_letters

        self.a, self.b = Tokenizer.from_buffer(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {x: i for i, x in enumerate(byte_letters())}
        size = 1 + max(self.a.get_vocab().values())
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            known = all(x in byte for x in token)
            self.bytes_a[i] = bytes(byte[x] for x in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)
        ]
        self.size_a, self.blob_a = self._joined(self.bytes_a)
        self.size_b, self.blob_b = self._joined(self.bytes_b)
        self.ranks = self._ranks(a)
        self.may_part = not any(re.search("[A-Za-z]▁", x) for x in pieces)
        # Decimal ids with what may follow them in the list of groups.
        self.text = [f"{i}{s}" for i in range(len(self.bytes_a)) for s in ",|"]
        self.text += [f"{i}{s}" for i in range(len(pieces)) for s in (",", ";", "")]

    @staticmethod
    def _joined(tokens: list[bytes]):
        """Sizes of tokens; their bytes one after another, and where each begins."""
        sizes = np.array([len(x) for x in tokens])
        return sizes, (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes)

    def _ranks(self, a: bytes):
        """The same vocabulary for the faster library, where ids follow the order of merges."""
        import public_tokenizers
        import tiktoken

        spec = json.loads(a)
        vocab, split = spec["model"]["vocab"], spec["pre_tokenizer"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ordered = all(vocab[m.replace(" ", "")] == 256 + i for i, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
        if not ordered or spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            return None
        ranks = {self.bytes_a[i]: i for i in vocab.values()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        # The faster library's patterns overflow on very long runs of white space.
        fast = self.ranks.encode_ordinary if self.ranks is not None else None
        return [fast(x) if fast and len(x) <= 2 * PART else self.a.encode(x, add_special_tokens=False).ids for x in texts]

    def parts(self, text: bytes) -> list[bytes]:
        """The text cut where both tokenizers certainly cut; the space there is left out."""
        if len(text) <= PART or not self.may_part:
            return [text]
        out, at = [], 0
        while len(text) - at > PART and (found := BREAK.search(text, at + PART)):
            out.append(text[at : found.start()])
            at = found.end()
        return [*out, text[at:]]

    def __call__(self, texts: list[bytes]):
        """For the documents' bytes: (A ids, B ids, ends of documents among each)."""
        parts, owner = [], []
        for d, text in enumerate(texts):
            found = self.parts(text) if text else []
            parts += found
            owner += [d] * len(found)
        plain = [p.decode() for p in parts]
        whole = np.frombuffer(b"".join(b" " + p for p in parts), np.uint8)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        made, wrong = [], np.zeros(len(texts), bool)
        for ids, size, (blob, begin) in (
            (self.encode_a([" " + p for p in plain]), self.size_a, self.blob_a),
            (self.b.encode(plain, num_threads=1) if plain else [], self.size_b, self.blob_b),
        ):
            counts = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum()))
            part = np.repeat(np.arange(len(parts)), counts)
            covered = np.bincount(part, size[flat], len(parts)).astype(np.int64)
            bad = covered != sizes
            fits = ~bad[part]
            own = flat[fits]
            ends = np.cumsum(size[own])
            spelt = blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[own] - ends + size[own], size[own])]
            unlike = spelt != (whole if not bad.any() else whole[np.repeat(~bad, sizes)])
            if unlike.any():
                bad[np.unique(np.repeat(np.flatnonzero(~bad), sizes[~bad])[unlike])] = True
            wrong[[d for d, x in zip(owner, bad.tolist()) if x]] = True
            made.append((flat, counts))
        of_doc, out = np.array(owner, np.int64), []
        for flat, counts in made:
            right = ~wrong[of_doc]
            per_doc = np.bincount(of_doc[right], counts[right], len(texts)).astype(np.int64)
            out.append((flat if right.all() else flat[np.repeat(right, counts)], np.append(0, np.cumsum(per_doc))))
        return out


def merge_lanes(end_a: np.ndarray, end_b: np.ndarray, bounds: np.ndarray, lane: int = LANE):
    """Links as (A token, B token), in no order, and flags of the tokens that end at a cut.

    ``end_a`` and ``end_b`` are the byte ends of all tokens, ``bounds`` those of documents,
    at which both have an end; documents without bytes have none of the tokens.
    """
    sizes = np.diff(bounds)
    per_doc = -(-sizes // lane)
    first = np.repeat(bounds[:-1], per_doc)
    begin = first + lane * (np.arange(len(first)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
    stop = np.minimum(begin + lane, np.repeat(bounds[1:], per_doc))
    start_a, start_b = end_a - np.diff(end_a, prepend=0), end_b - np.diff(end_b, prepend=0)
    a, b = np.searchsorted(end_a, begin, "right"), np.searchsorted(end_b, begin, "right")
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    # An overlap that began in the lane before belongs to that one; it is stepped over first.
    early = np.maximum(start_a[a], start_b[b]) < begin
    links_a, links_b = [], []
    while len(a):
        ends_a, ends_b = end_a[a], end_b[b]
        if early is None:
            links_a.append(a)
            links_b.append(b)
            both = ends_a == ends_b
            cut_a[a[both]], cut_b[b[both]] = True, True
            go = np.ones(len(a), bool)
        else:
            go, early = early, None
        nearest = np.minimum(ends_a, ends_b)
        a, b = a + (go & (ends_a == nearest)), b + (go & (ends_b == nearest))
        live = ~go | (nearest < stop)
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    empty = np.zeros(0, np.int64)
    return np.concatenate(links_a or [empty]), np.concatenate(links_b or [empty]), cut_a, cut_b


def align_texts(tokenizers: Tokenizers, texts: list[bytes]) -> list[dict]:
    """Counts, groups and linked id pairs (distinct, with their number of links) of texts."""
    (ids_a, at_a), (ids_b, at_b) = tokenizers(texts)
    end_a, end_b = np.cumsum(tokenizers.size_a[ids_a]), np.cumsum(tokenizers.size_b[ids_b])
    bounds = np.append(0, end_a)[at_a]
    link_a, link_b, cut_a, cut_b = merge_lanes(end_a, end_b, bounds)
    # Groups are listed A tokens first: a token's place counts the other side's before it.
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    before_b, upto_a = np.append(0, np.flatnonzero(cut_b) + 1), np.append(0, np.flatnonzero(cut_a) + 1)
    code = np.zeros(len(ids_a) + len(ids_b), np.int64)
    code[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a + cut_a
    last = np.zeros(len(ids_b), np.int64)
    last[at_b[1:][at_b[1:] > at_b[:-1]] - 1] = 1
    code[np.arange(len(ids_b)) + upto_a[group_b + 1]] = 2 * len(tokenizers.bytes_a) + 3 * ids_b + cut_b + last
    at = (at_a + at_b).tolist()
    listed = list(map(tokenizers.text.__getitem__, code.tolist()))
    # Distinct pairs of each document.
    docs, width = len(texts), len(tokenizers.bytes_b)
    owner = np.searchsorted(at_a, link_a, "right") - 1
    space = len(tokenizers.bytes_a) * width
    keys, times = np.unique(owner * space + ids_a[link_a] * width + ids_b[link_b], return_counts=True)
    of_doc = np.searchsorted(keys, np.arange(docs + 1) * space)
    keys %= space
    pairs = keys // width << 32 | keys % width
    n_links, n_groups = np.bincount(owner, minlength=docs), np.append(0, np.cumsum(cut_a))[at_a]
    return [
        {
            "n_a": int(at_a[d + 1] - at_a[d]),
            "n_b": int(at_b[d + 1] - at_b[d]),
            "n_groups": int(n_groups[d + 1] - n_groups[d]),
            "n_links": int(n_links[d]),
            "groups": "".join(listed[at[d] : at[d + 1]]),
            "pairs": pairs[of_doc[d] : of_doc[d + 1]],
            "times": times[of_doc[d] : of_doc[d + 1]],
        }
        for d in range(docs)
    ]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents (``pairs`` null) and of blocks (``at`` null); see the top."""
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, *(T.StructField(name, kind) for name, kind in DOC + OF_BLOCK)])
    out = to_arrow_schema(schema)
    kinds = {f.name: f.type for f in out}

    def run(batches):
        tokenizers = Tokenizers(*shared.value)
        block, held, rows, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            """The documents held, with places in the block's list of pairs, and the block's row."""
            nonlocal block
            every = [row["pairs"] for part in rows for row in part]
            pairs, at, holders = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
            done = 0
            for kept, part in zip(held, rows):
                made = dict(zip(keep, kept)) | {"block": pa.array([block] * len(part), pa.int64())}
                for name in ("n_a", "n_b", "n_groups", "n_links", "groups"):
                    made[name] = pa.array([row[name] for row in part], kinds[name])
                sizes = [len(row["pairs"]) for row in part]
                cuts = done + np.cumsum([0, *sizes])
                made["at"] = _lists([at[i:j] for i, j in zip(cuts, cuts[1:])], pa.int32())
                made["times"] = _lists([row["times"] for row in part], pa.int32())
                done = int(cuts[-1])
                yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(len(part), f.type) for f in out], schema=out)
            own = {"block": pa.array([block]), "pairs": _lists([pairs], pa.int64()), "holders": _lists([holders], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(1, f.type) for f in out], schema=out)
            block += 1

        for batch in batches:
            names = batch.schema.names
            for i, j, data, offsets in slices(batch.column(names.index("text"))):
                raw, at = data.tobytes(), offsets.tolist()
                rows.append(align_texts(tokenizers, [raw[a:b] for a, b in zip(at, at[1:])]))
                held.append([batch.column(names.index(c)).slice(i, j - i) for c in keep])
                size += len(raw) + 64 * (j - i)
                if size >= block_bytes:
                    yield from flush()
                    held, rows, size = [], [], 0
        if rows:
            yield from flush()

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, docs, best)``: documents that hold an id pair linked (A id above 32 bits, B id
    below), and whether no other pair of its A id has more."""
    rows = aligned.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "holders")))
    counts = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("docs"))
    counts = checkpoint(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def score(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents of a written ``align`` table with ``n_best`` and ``count_sum``.

    The lists ``at``, ``times`` and the columns of blocks are dropped. A task sees the
    documents of a block and the counts of its pairs, both bounded by the block's size.
    """
    listed = aligned.where("pairs is not null").select(
        F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair")
    )
    known = listed.join(counts, "pair").select("of_block", "place", "docs", "best")
    docs = aligned.where("pairs is null").drop("pairs", "holders")
    made = ("n_best", "count_sum")
    keep = [c for c in docs.columns if c not in (*made, "at", "times")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.LongType()) for name in made])
    out = to_arrow_schema(schema)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("docs").to_numpy(), right.column("best").to_numpy()
        sums = {name: [] for name in made}
        for part in left.select(["at", "times"]).to_batches():
            at, times = part.column(0), part.column(1)
            ends = at.offsets.to_numpy().astype(np.int64)
            n = times.flatten().to_numpy().astype(np.int64)
            ends -= ends[0]
            where = at.flatten().to_numpy()
            for name, value in (("n_best", best), ("count_sum", count)):
                run = np.append(0, np.cumsum(value[where] * n))[ends]
                sums[name].append(np.diff(run))
        arrays = [left.column(c).combine_chunks() for c in keep]
        arrays += [pa.array(np.concatenate(sums[name]) if sums[name] else [], pa.int64()) for name in made]
        return pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, out)], schema=out)

    return docs.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(total, schema)
