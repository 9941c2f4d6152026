"""Substring dedup by run-length compressed suffix indexes.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts anywhere else.

1. Every such string holds exactly one minimiser (the least hash of its ``KMERS[0]``-byte
   substrings, the leftmost of equals). Neighbouring strings with one minimiser form a
   segment of at most ``2 * LENGTH - KMERS[0]`` bytes; equal strings are in segments with
   equal minimisers. Segments are rows of numbers, without their text.
2. Segments whose minimiser occurs once are done. Equal segments are one content from here
   on; a content that occurs twice is repeated as a whole.
3. The texts of contents that share a minimiser with other contents are fetched. A block of
   whole minimisers, of about ``BLOCK_BYTES``, gets an index: a Burrows-Wheeler transform,
   kept as runs, with suffix positions and common prefix lengths sampled at the ends of
   the runs. Streaming through the text from sample to sample gives the matching statistic
   of every position, the longest match of its suffix elsewhere in the block; positions
   with ``LENGTH`` or more are repeated.
4. A minimiser with too many contents for a block is cut again by longer minimisers, down
   to single strings, where contents are equal; so no group outgrows a task.
5. The marks go back to the documents by key.

Nulls: a null text is empty; null ids are ids. A row is known by the hash of its id and
text; repeated rows are copies of each other, so they lose all strings of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm.common import U64, mix, powers, prefix_hash, slices
from textloom.sources.tables import checkpoint

LENGTH = 200
#: Sizes of the minimisers, level by level. The last one is a whole string.
KMERS = (32, 128, 184, 200)
BLOCK_BYTES = 1 << 20
#: Contents of one minimiser that still make a block; an index takes below 2**21 bytes.
MOST = 2000
#: Window starts are packed as start << SHIFT | how many.
SHIFT = 9


def segments(data: np.ndarray, offsets: np.ndarray, kmer: int):
    """(text, start, length, minimiser, content hash) of the segments of all texts."""
    n, span = len(data), LENGTH - kmer + 1
    starts = n - LENGTH + 1
    if starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, U64) for _ in range(2))
    total, inverse = prefix_hash(data), powers(n + 1)[1]
    hashes = mix((total[kmer:] - total[:-kmer]) * inverse[: n - kmer + 1])
    # The least whole hash, the first of equals: the same in every slice that holds a window.
    least, at, width = hashes, np.arange(len(hashes), dtype=np.int32 if n < 1 << 31 else np.int64), 1

    def join(least, at, shift, size):
        left = least[:size] <= least[shift : shift + size]
        return np.where(left, least[:size], least[shift : shift + size]), np.where(left, at[:size], at[shift : shift + size])

    while width * 2 <= span:
        least, at = join(least, at, width, len(least) - width)
        width *= 2
    if width < span:
        least, at = join(least, at, span - width, starts)
    at = at[:starts]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    whole = np.arange(starts) + LENGTH <= offsets[1:][text]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    begin = np.flatnonzero(first)
    after = np.flatnonzero(whole & ~np.append(whole[1:] & ~first[1:], False)) + 1
    end = after - 1 + LENGTH
    content = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64))
    return text[begin], begin - offsets[text[begin]], end - begin, hashes[at[begin]], content


class RunLengthIndex:
    """A Burrows-Wheeler transform of several texts as runs, sampled at their ends.

    ``symbols`` and ``lengths`` are the runs; ``heads`` and ``tails`` the suffix positions
    at their first and last rows; ``common`` the length of the common prefix of a head and
    the row before it. Texts end with terminators that differ from each other, so no
    prefix is common beyond the end of a text.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.n = n = len(raw)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        self.stop = stop = self.ends[owner] - 1
        is_end = np.zeros(n, bool)
        is_end[self.ends - 1] = True
        seen = np.zeros(256, bool)
        seen[raw[~is_end]] = True
        code = np.cumsum(seen).astype(np.int64)[raw]
        code[is_end] = 0
        order = _suffix_array(code, owner, stop)
        before = code[order - 1]
        starts = np.zeros(n, bool)
        starts[self.begins] = True
        edge = starts[order]
        cut = np.ones(n, bool)
        cut[1:] = (before[1:] != before[:-1]) | edge[1:] | edge[:-1]
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], n) - 1
        self.symbols = np.where(edge[heads], -1, before[heads])
        self.lengths = tails - heads + 1
        self.heads, self.tails = order[heads], order[tails]
        self.common = np.zeros(len(heads), np.int64)
        self.common[1:] = _common_prefix(raw, self.tails[:-1], self.heads[1:], stop)

    def matching_statistics(self) -> np.ndarray:
        """For every position, the longest match of its suffix at another position.

        The neighbours of a row within a run are the neighbours of the next position,
        so between samples the match gets shorter by one with each step.
        """
        reach = np.zeros((2, self.n), np.int64)
        reach[0, self.heads] = self.heads + self.common
        reach[1, self.tails] = self.tails
        reach[1, self.tails[:-1]] += self.common[1:]
        return np.maximum.accumulate(reach, axis=1).max(axis=0) - np.arange(self.n)


def _suffix_array(code: np.ndarray, owner: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; key and position share a word, so it is one sort."""
    n = len(code)
    width = max(1, int(n).bit_length())
    if 3 * width > 63:
        raise ValueError("the block is too large for an index")
    symbol = max(1, int(code.max()).bit_length())
    depth = max(1, min((63 - width) // symbol, 16))
    key, alive, place = np.zeros(n, np.int64), np.ones(n, bool), np.arange(n)
    padded = np.append(code, np.zeros(depth, np.int64))
    for k in range(depth):
        now = np.where(alive, padded[k : k + n], 0)
        key = (key << symbol) | now
        alive = now > 0
    while True:
        packed = np.sort((key << width) | place)
        order = packed & ((1 << width) - 1)
        value = packed >> width
        rank = np.zeros(n, np.int64)
        rank[1:] = np.cumsum(value[1:] != value[:-1])
        if rank[-1] == n - 1:
            return order
        by_place = np.empty(n, np.int64)
        by_place[order] = rank
        ahead = place + depth
        inside = ahead <= stop
        second = np.where(inside, by_place[np.minimum(ahead, n - 1)], owner)
        key = (by_place << width) | second
        depth *= 2


def _common_prefix(raw: np.ndarray, x: np.ndarray, y: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Common prefix lengths of suffix pairs, eight bytes at a time."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.zeros(len(raw), U64)
    for k in range(8):
        eight |= padded[k : k + len(raw)].astype(U64) << U64(8 * k)
    most = np.minimum(stop[x] - x, stop[y] - y)
    out = np.zeros(len(x), np.int64)
    todo = np.flatnonzero(most > 0)
    while len(todo):
        at = out[todo]
        differ = eight[x[todo] + at] ^ eight[y[todo] + at]
        # Bytes before the lowest one that differs.
        equal = np.full(len(todo), 8)
        for k in range(7, -1, -1):
            equal[(differ & U64(0xFF << (8 * k))) != 0] = k
        out[todo] += equal
        todo = todo[(equal == 8) & (out[todo] < most[todo])]
    return np.minimum(out, most)


def repeated_starts(texts: list[bytes]) -> list[list[int]]:
    """For each text, packed runs of starts of strings that also start elsewhere."""
    index = RunLengthIndex(texts)
    marks = np.append(index.matching_statistics() >= LENGTH, False)
    edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    edges = np.append(0, edges) if marks[0] else edges
    begin, end = edges[::2], edges[1::2]
    owner = np.searchsorted(index.ends, begin, side="right")
    out: list[list[int]] = [[] for _ in texts]
    for t, a, b in zip(owner.tolist(), (begin - index.begins[owner]).tolist(), (end - begin).tolist()):
        out[t].append((a << SHIFT) | b)
    return out


def _segment_rows(texts: DataFrame, kmer: int, with_text: bool) -> DataFrame:
    """Segments of (k, text or data): (key, h, k, at), packed start and length, and text."""
    schema = "key long, h long, k long, at long" + (", seg binary" if with_text else "")

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                text, start, length, key, content = segments(data, offsets, kmer)
                k = batch.column(0).slice(i, j - i).to_numpy()[text]
                columns = [key.view(np.int64), content.view(np.int64), k, (start << SHIFT) | length]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_text:
                    raw = data.tobytes()
                    at = (offsets[text] + start).tolist()
                    arrays.append(pa.array([raw[a : a + n] for a, n in zip(at, length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "h", "k", "at", "seg"][: len(arrays)])

    return texts.mapInArrow(run, schema)


def _cut_out(texts: DataFrame) -> DataFrame:
    """Contents (key, h, whole, seg) from rows (text, list of places)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                for place in wanted.as_py():
                    start, length = place["at"] >> SHIFT, place["at"] & ((1 << SHIFT) - 1)
                    rows.append((place["key"], place["h"], place["whole"], raw[start : start + length]))
                if len(rows) >= 4096:
                    yield _contents(rows)
                    rows = []
            if rows:
                yield _contents(rows)

    return texts.mapInArrow(run, "key long, h long, whole boolean, seg binary")


def _contents(rows):
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["key", "h", "whole", "seg"])


def _index_blocks(contents: DataFrame) -> DataFrame:
    """Marks (h, starts) of contents that no copy marks as a whole, block by block."""

    def run(batches):
        block, size = [], 0

        def marks():
            found = repeated_starts([r[2] for r in block])
            rows = [(r[0], s) for r, s in zip(block, found) if s and not r[1]]
            if rows:
                h, starts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(starts, pa.list_(pa.int64()))], names=["h", "starts"])

        last = None
        for batch in batches:
            for key, h, whole, seg in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size >= BLOCK_BYTES // 2:
                    yield from marks()
                    block, size = [], 0
                block.append((h, whole, seg))
                size += len(seg) + 1
                last = key
        if block:
            yield from marks()

    placed = contents.repartition("key").sortWithinPartitions("key", "h")
    return placed.select("key", "h", "whole", "seg").mapInArrow(run, "h long, starts array<long>")


def _marks(contents: DataFrame, level: int) -> DataFrame:
    """Marks of contents (key, h, whole, seg), each key with two contents or more."""
    sizes = contents.groupBy("key").agg(F.count("*").alias("contents"))
    big = sizes.where(F.col("contents") > MOST).select("key")
    if level + 1 == len(KMERS) or big.isEmpty():
        return _index_blocks(contents)
    small = contents.join(big, "key", "left_anti")
    parents = contents.join(big, "key").select(F.col("h").alias("k"), F.col("seg"), "whole")
    # The same strings, under minimisers of their own.
    parts = _segment_rows(parents.select("k", "seg"), KMERS[level + 1], True)
    parts = checkpoint(parts.join(parents.select("k", "whole"), "k"))
    inner = parts.groupBy("key", "h").agg(F.count("*").alias("n"), F.max("whole").alias("whole"), F.first("seg").alias("seg"))
    inner = checkpoint(inner.select("key", "h", ((F.col("n") > 1) | F.col("whole")).alias("whole"), "seg"))
    shared = inner.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1").select("key")
    found = _whole_marks(inner).union(_marks(inner.join(shared, "key"), level + 1))
    start = F.shiftright("at", SHIFT)
    moved = parts.where(~F.col("whole")).join(found, "h").select(
        F.col("k").alias("h"), F.explode("starts").alias("s"), start.alias("start")
    )
    moved = moved.groupBy("h").agg(F.collect_list(F.col("s") + F.shiftleft("start", SHIFT)).alias("starts"))
    return _index_blocks(small).union(moved)


def _whole_marks(contents: DataFrame) -> DataFrame:
    count = F.octet_length("seg") - LENGTH + 1
    return contents.where("whole").select("h", F.array(count.cast("long")).alias("starts"))


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(k, starts): packed runs of starts of repeated strings of each row (k, text)."""
    every = checkpoint(_segment_rows(docs.select("k", "text"), KMERS[0], False))
    # A table of its own: a join of two plain shuffles can be split where a key is hot.
    again = checkpoint(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met = checkpoint(every.join(again, "key"))
    contents = met.groupBy("key", "h").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("one"))
    contents = checkpoint(contents.select("key", "h", (F.col("n") > 1).alias("whole"), "one.k", "one.at"))
    shared = contents.groupBy("key").agg(F.count("*").alias("m"), F.min("whole").alias("all")).where("m > 1 AND NOT all").select("key")
    wanted = contents.join(shared, "key").groupBy("k").agg(F.collect_list(F.struct("key", "h", "whole", "at")).alias("wanted"))
    texts = docs.select("k", "text").join(wanted, "k").select("text", "wanted")
    marks = checkpoint(_marks(checkpoint(_cut_out(texts).dropDuplicates(["key", "h"])), 0))
    count = (F.col("at").bitwiseAND((1 << SHIFT) - 1) - LENGTH + 1).cast("long")
    whole = contents.where("whole").select("key", "h")
    full = met.join(whole, ["key", "h"]).select("k", (F.shiftleft(F.shiftright("at", SHIFT), SHIFT) + count).alias("s"))
    part = met.join(marks, "h").select("k", F.explode("starts").alias("s"), F.shiftright("at", SHIFT).alias("start"))
    part = part.select("k", (F.col("s") + F.shiftleft("start", SHIFT)).alias("s"))
    # Repeated rows share k and bring the same starts: a set keeps one of each.
    return checkpoint(full.union(part).groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("starts")))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: spans of bytes, and what is left.

    Other columns are not returned. Repeated rows are copies of each other, so all of them lose
    what they share.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.join(repeated_strings(rows), "k", "left").select("doc_id", "text", "starts")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("removed", SPANS), T.StructField("kept", T.BinaryType())]
    )

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                removed, kept = [], []
                starts = batch.column(2).slice(i, j - i)
                for d, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    spans = _spans(starts[d].as_py() or ())
                    removed.append([{"start": x, "end": y} for x, y in spans])
                    cuts = [0, *(z for span in spans for z in span), b - a]
                    raw = data[a:b].tobytes()
                    kept.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
                arrays = [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets), pa.int64())]
                arrays += [pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return marked.mapInArrow(run, schema)


def _spans(starts) -> list[list[int]]:
    """Disjoint spans of bytes covered by the strings with these sorted, packed starts."""
    out: list[list[int]] = []
    for packed in starts:
        a = packed >> SHIFT
        b = a + (packed & ((1 << SHIFT) - 1)) - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
