"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item of fewer
words is one window). A window is a set of word shingles, ordered by how rarely they occur
in the documents. A document that contains the window must contain each of its shingles,
so the join needs the rarest one only: the prefix for full containment is one token. A
meeting gives the place where the window would have to start; places outside the document
fall by the length and positional bounds, and the rest are compared word by word.

The documents are read twice (shingle counts, then the join) and never shuffled. Of the
benchmark, blocks of ``BLOCK_BYTES`` of text are broadcast, one after the other.

Nulls: a null text has no words; a null item_id is the item ``""``. Repeated rows of a
document each get the result; repeated items count once.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm.common import ALNUM, LOWER, map_texts, shingle_hashes, slices, span_hashes, word_spans

#: Words in a shingle. Windows with fewer words are one shingle.
SHINGLE = 3
#: Benchmark text that is broadcast at a time; the index takes about ten times as much.
BLOCK_BYTES = 8 << 20
#: Slots of the table that rules out most of the documents' shingles.
SLOTS = 1 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def plain_words(text: str | None) -> list[bytes]:
    """Words of one text, A-Z lower-cased."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s, e)]


class Windows:
    """The windows of a block of items, and the shingles by which they are found."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = plain_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        keys = sorted(owners)
        self.texts = [b" ".join(k) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.items = [sorted(owners[k]) for k in keys]
        self.shingles = [self._shingles(k) for k in keys]
        self.sizes = sorted({min(SHINGLE, len(k)) for k in keys})

    @staticmethod
    def _shingles(words: tuple[bytes, ...]) -> np.ndarray:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return shingle_hashes(span_hashes(data, starts, ends.astype(np.int64)), min(SHINGLE, len(words)))

    def all_shingles(self) -> np.ndarray:
        return np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)


class Finder:
    """Places in a slice of texts whose shingle is one of a given set."""

    def __init__(self, hashes: np.ndarray, sizes: list[int]):
        self.hashes, self.sizes = hashes, sizes
        self.table = np.zeros(SLOTS, bool)
        self.table[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray):
        """(first word, index into the set) of every match."""
        for size in self.sizes if len(self.hashes) else ():
            h = shingle_hashes(words, size)
            at = np.flatnonzero(self.table[(h & np.uint64(SLOTS - 1)).astype(np.int64)])
            if len(at):
                k = np.searchsorted(self.hashes, h[at])
                k[k == len(self.hashes)] = 0
                same = self.hashes[k] == h[at]
                yield at[same], k[same]


def _shingle_counts(docs: DataFrame, index, sizes: list[int]) -> dict[int, int]:
    """How often the shingles of a block of windows occur in all documents."""

    def count(batches):
        import pyarrow as pa

        find, n = Finder(index.value, sizes), np.zeros(len(index.value), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                data = LOWER[data]
                s, e, _ = word_spans(data, offsets, ALNUM)
                for _, k in find(span_hashes(data, s, e)):
                    n += np.bincount(k, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["k", "n"])

    found = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {r.k: r.n for r in found.collect()}


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents with ``n_words``, ``hits`` (merged spans of hit words) and ``items``.

    ``keep`` names the columns of ``docs`` that stay (all by default). Columns of the
    three names above are replaced.
    """
    keep = docs.columns if keep is None else keep
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    of = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    kept = [c for c in keep if c not in ADDED.names]
    through = list(dict.fromkeys([*kept, "text"]))
    result = None
    for block in range(blocks):
        rows = items.where(of == block).collect()
        windows = Windows([(r.item, r.text) for r in rows], window)
        shingles = windows.all_shingles()
        counts = _shingle_counts(docs, context.broadcast(shingles), windows.sizes) if len(shingles) else {}
        shared = context.broadcast((windows, counts))
        if result is None:
            result = _find(docs, shared, through if blocks > 1 else kept)
        else:
            before = result.withColumnsRenamed({c: f"_before_{c}" for c in ADDED.names})
            found = _find(before, shared, [*through, *(f"_before_{c}" for c in ADDED.names)])
            result = found.select(
                *through,
                "n_words",
                _merge_spans("_before_hits", "hits").alias("hits"),
                F.array_distinct(F.concat("_before_items", "items")).alias("items"),
            )
    return result.select(*kept, *ADDED.names)


@F.udf(ADDED["hits"].dataType)
def _merge_spans(a, b):
    """Spans found by two blocks of the benchmark; runs only where there are two."""
    return merged([tuple(x) for x in (a or []) + (b or [])])


def _find(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """Join one block of windows to all documents."""

    def make():
        windows, counts = shared.value
        every = windows.all_shingles()
        by_token: dict[int, list[tuple[int, int]]] = {}
        for w, shingles in enumerate(windows.shingles):
            ranks = np.searchsorted(every, shingles)
            # Rarest first, ties by hash: the prefix is the first of this order.
            first = min(range(len(ranks)), key=lambda i: (counts.get(int(ranks[i]), 0), int(shingles[i]), i))
            by_token.setdefault(int(shingles[first]), []).append((w, first))
        tokens = np.array(sorted(by_token), np.uint64)
        find = Finder(tokens, windows.sizes)
        meets = [by_token[int(t)] for t in tokens]

        def work(data, offsets):
            data = LOWER[data]
            s, e, first = word_spans(data, offsets, ALNUM)
            # Words joined by one space, so that windows can be compared as bytes.
            kept = ALNUM[data]
            gaps = np.zeros(len(kept), bool)
            gaps[1:] = kept[:-1] & ~kept[1:]
            line = np.where(kept, data, 32).astype(np.uint8)[kept | gaps].tobytes()
            place = np.cumsum(kept | gaps) - 1
            begin, stop = place[s], place[e - 1] + 1
            spans: dict[int, list] = {}
            names: dict[int, set] = {}
            for at, token in find(span_hashes(data, s, e)):
                rows = np.searchsorted(first, at, side="right") - 1
                for q, t, d in zip(at.tolist(), token.tolist(), rows.tolist()):
                    for w, offset in meets[t]:
                        a = q - offset
                        b = a + int(windows.lengths[w])
                        if a < first[d] or b > first[d + 1]:
                            continue
                        if line[begin[a] : stop[b - 1]] == windows.texts[w]:
                            spans.setdefault(d, []).append((a - int(first[d]), b - int(first[d])))
                            names.setdefault(d, set()).update(windows.items[w])
            n = len(offsets) - 1
            return {
                "n_words": np.diff(first),
                "hits": [[{"start": a, "end": b} for a, b in merged(spans.get(d, ()))] for d in range(n)],
                "items": [sorted(names.get(d, ())) for d in range(n)],
            }

        return work

    return map_texts(docs, make, ADDED, keep)


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hit_words(hits):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
