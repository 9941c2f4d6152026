"""N-gram Jaccard join by T-occurrence search.

A document is a set of word shingles. Two documents link when their sets' intersection is
at least ``num/den`` of their union; the result is the connected components of the links.

1. Documents with equal sets are one class from here on.
2. Shingles are ordered from rare to common. How common a shingle is comes from counts of
   words and shingles over all documents, kept in tables of ``WORD_SLOTS`` and ``SLOTS``
   sums, so what is broadcast is fixed in size. Any order gives exact results; a good one
   keeps chance meetings and passages that many documents share out of the prefixes. Of the first ``n - ceil(n * num / den) + s`` shingles, linked sets share s.
   A class whose prefix has fewer than s shingles that any other prefix holds is done.
3. Each class that is left goes with its set to the blocks of two shingles, those that
   most prefixes hold. A block is searched by DivideSkip: for a query, the
   inverted lists of its shingles are split, the short ones are merged on a heap, the long
   ones are probed by binary search, and sets that reach the required overlap T are linked.
   Queries stop when all that is left is linked, so copies do not meet pairwise. A block
   of more than ``BLOCK_ROWS`` sets is cut into several that share its first set.
4. What step 3 leaves: pairs of classes that share a prefix shingle, are not connected yet
   and were in no block together. They meet by shingle and by band of set size, so a
   shingle of many sets is compared within neighbouring sizes only; pairs are filtered by
   length, by ``SKETCH`` parity bits of the sets (sets differ in at least as many shingles
   as their parities differ) and by position, and their overlap is counted.
   With this step the components are exact.

Nulls: a null text or one without words has an empty set and links with nothing. A null
doc_id takes part; the component is named by the least id that is not null. Repeated rows
are equal sets, each with its row in the result.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import LOWER, NON_SPACE, U64, mix, shingle_hashes, slices, span_hashes, word_spans
from textloom.llm.components import components
from textloom.sources.tables import checkpoint

SLOTS = 1 << 14
WORD_SLOTS = 1 << 16
BLOCK_ROWS = 2000
HOMES = 2
#: Prefixes are longer by so many hundredths of the set, and as many more must be shared.
EXTRA = 4
#: Parity bits of a set: bit i tells whether it has an odd number of shingles in slot i.
SKETCH = 512
#: Weight of a probe against a step of the merge, as in the published algorithm.
MU = 0.0085


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int):
    """Word hashes, shingle hashes, and (first, last, fewer) shingles of every text.

    A text with fewer words than ``size`` is one shingle; its words are given instead.
    """
    data = LOWER[data]
    s, e, first = word_spans(data, offsets, NON_SPACE)
    words = span_hashes(data, s, e)
    places = [(a, b - size + 1, False) if b - a >= size else (a, b, True) for a, b in itertools.pairwise(first.tolist())]
    return words, shingle_hashes(words, size), places


def frequencies(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of all words and all shingles of all documents, in fixed tables of sums."""

    def run(batches):
        n = np.zeros(WORD_SLOTS + SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words, every, places = shingles_of(data, offsets, size)
                inside = np.zeros(len(every) + 1, np.int64)
                for a, b, fewer in places:
                    if not fewer:
                        inside[a] += 1
                        inside[b] -= 1
                every = every[np.cumsum(inside)[:-1] > 0]
                n[:WORD_SLOTS] += np.bincount((words & U64(WORD_SLOTS - 1)).astype(np.int64), minlength=WORD_SLOTS)
                n[WORD_SLOTS:] += np.bincount((every & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["slot", "n"])

    out = np.zeros(WORD_SLOTS + SLOTS, np.int64)
    for row in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row.slot] = row.n
    return out[:WORD_SLOTS], out[WORD_SLOTS:]


class Order:
    """How common a shingle is, as a byte.

    Up to 199: how often its words would meet by chance, from the words' frequencies.
    Above: its own slot is well over the mean, as with a passage of many documents.
    """

    def __init__(self, words: np.ndarray, shingles: np.ndarray):
        self.total = math.log2(max(1, int(words.sum())))
        self.words = np.log2(np.maximum(words, 1)).astype(np.float32) - np.float32(self.total)
        ratio = np.log2(np.maximum(shingles / max(1.0, float(shingles.mean())), 1.0))
        self.heavy = np.where(ratio >= 1.5, np.clip(np.round(200 + 4 * ratio), 200, 255), 0).astype(np.int64)

    def sets(self, data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
        """Distinct shingles of every text, rare ones first: the byte, then 56 bits of hash."""
        words, every, places = shingles_of(data, offsets, size)
        chance = self.words[(words & U64(WORD_SLOTS - 1)).astype(np.int64)]
        together = chance[: len(every)].copy()
        for k in range(1, size if len(every) else 0):
            together += chance[k : k + len(every)]
        every = self._tokens(every, together)
        out = []
        for a, b, fewer in places:
            if not fewer:
                out.append(np.unique(every[a:b]))
            elif b > a:
                out.append(self._tokens(shingle_hashes(words[a:b], b - a), chance[a:b].sum(keepdims=True)))
            else:
                out.append(every[:0])
        return out

    def _tokens(self, h: np.ndarray, chance: np.ndarray) -> np.ndarray:
        common = np.clip(np.round(4 * (chance + np.float32(self.total)) + 100), 0, 199).astype(np.int64)
        common = np.maximum(common, self.heavy[(h & U64(SLOTS - 1)).astype(np.int64)])
        return (common.astype(U64) << U64(56)) | (h >> U64(8))


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    if not len(tokens):
        return 0
    mixed = mix(tokens)
    both = np.array([mixed.sum(dtype=U64) ^ U64(len(tokens)), np.bitwise_xor.reduce(mix(tokens * U64(3)))], U64)
    both = mix(both) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U64)
    return int(np.bitwise_xor.reduce(both).astype(np.int64))


def prefix_length(n: int, num: int, den: int) -> int:
    """Linked sets share at least ``1 + n * EXTRA // 100`` of so many first shingles."""
    return n - -(-n * num // den) + 1 + n * EXTRA // 100


def _linked(overlap: int, n: int, m: int, num: int, den: int) -> bool:
    return den * overlap >= num * (n + m - overlap)


class Block:
    """Inverted lists of the sets of a block, and the T-occurrence search over them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
        record = np.repeat(np.arange(len(sets)), self.sizes)
        # A list is the part of `flat` with one token; records ascend by size within it.
        self.width = len(sets)
        self.flat = np.sort(local.astype(np.int64) * self.width + record)
        self.bounds = np.searchsorted(self.flat, np.arange(len(tokens) + 1) * self.width)
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sets = [local[a:b] for a, b in itertools.pairwise(cuts.tolist())]
        self.parent = list(range(len(sets)))
        self.left = [1] * len(sets)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def search(self, q: int):
        """Records of other components that reach the overlap with q."""
        tokens, n = self.sets[q], int(self.sizes[q])
        begin, end = self.bounds[tokens], self.bounds[tokens + 1]
        lengths = end - begin
        smallest = int(np.searchsorted(self.sizes, -(-n * self.num // self.den)))
        largest = int(np.searchsorted(self.sizes, n * self.den // self.num, side="right"))
        # Least overlap with a partner of the smallest size in range.
        least = -(-self.num * (n + int(self.sizes[smallest])) // (self.num + self.den))
        shared = np.flatnonzero(lengths > 1)
        if len(shared) < least:
            return
        shared = shared[np.argsort(-lengths[shared], kind="stable")]
        longest = int(lengths[shared[0]])
        long = min(int(least / (MU * math.log2(longest) + 1)), least - 1)
        probed, merged = tokens[shared[:long]], shared[long:]
        lists = [(self.flat[begin[k] : end[k]] - tokens[k] * self.width).tolist() for k in merged.tolist()]
        mine = self.root(q)
        for record, hits in itertools.groupby(heapq.merge(*lists)):
            if not smallest <= record < largest or record == q:
                continue
            count = sum(1 for _ in hits)
            if count < least - long or self.root(record) == mine:
                continue
            keys = probed * self.width + record
            at = np.searchsorted(self.flat, keys)
            at[at == len(self.flat)] = 0
            count += int((self.flat[at] == keys).sum())
            if _linked(count, n, int(self.sizes[record]), self.num, self.den):
                yield record
                mine = self.root(q)

    def links(self) -> list[tuple[int, int]]:
        """Links that connect all that is linked, as places in the list given."""
        out, todo = [], deque(range(self.width))
        unsearched, big = self.width, 0
        while todo:
            q = todo.popleft()
            mine = self.root(q)
            if self.left[mine] == unsearched:
                break
            if mine == self.root(big) and self.left[mine] > 1:
                todo.append(q)
                # All that is left to do is in the largest component, or it comes later.
                if self.left[mine] == len(todo):
                    break
                continue
            for record in self.search(q):
                a, b = self.root(q), self.root(record)
                if a != b:
                    self.parent[b] = a
                    self.left[a] += self.left[b]
                    out.append((self.order[q], self.order[record]))
            mine = self.root(q)
            self.left[mine] -= 1
            unsearched -= 1
            if self.left[mine] > self.left[self.root(big)]:
                big = mine
        return out


def pack(tokens: np.ndarray) -> bytes:
    """A set in six bytes a shingle; two shingles of two texts fall together once in 2**48."""
    short = np.unique(tokens & U64((1 << 48) - 1))
    return short.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :6] = rows
    return out.view(U64).ravel()


def sketch(data: bytes) -> np.ndarray:
    """Parities of a packed set, as 64-bit words."""
    odd = np.bincount((unpack(data) & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_of(n, num: int, den: int):
    """Band of a set size: sizes that can link are in one band or in neighbouring ones."""
    # A little wider than the threshold asks, so that rounding cannot put sizes two apart.
    return F.floor(F.log(n) / max(1.001 * math.log(den / num), 0.01)).cast("int")


def _describe(docs: DataFrame, size: int, num: int, den: int, order) -> DataFrame:
    """Each document's set size, fingerprint and prefix."""
    schema = "k long, doc_id long, n long, c long, prefix array<long>"

    def run(batches):
        table = order.value
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                sets = table.sets(data, offsets, size)
                cut = [s[: prefix_length(len(s), num, den)] if len(s) else s for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in cut])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cut).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.int64()),
                        prefix,
                    ],
                    names=["k", "doc_id", "n", "c", "prefix"],
                )

    return docs.mapInArrow(run, schema)


def _sets(rows: DataFrame, size: int, order) -> DataFrame:
    """Rows (c, text, homes) with the set in place of the text, and its sketch."""

    def run(batches):
        table = order.value
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                sets = table.sets(data, offsets, size)
                right = [fingerprint(s) == c for s, c in zip(sets, batch.column(0).slice(i, j - i).to_pylist())]
                made = [pack(s) if ok else None for s, ok in zip(sets, right)]
                bits = [sketch(m) if m else None for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(made, pa.binary()),
                        batch.column(2).slice(i, j - i),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["c", "tokens", "homes", "sketch"],
                )

    return rows.mapInArrow(run, "c long, tokens binary, homes array<long>, sketch array<long>").where(F.col("tokens").isNotNull())


def _search_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links found inside the blocks (token, salt) of (c, tokens)."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)))

        for _, group in itertools.groupby(rows(), key=lambda r: (r[0], r[1])):
            group = list(group)
            if len(group) < 2:
                continue
            found = Block([unpack(r[3]) for r in group], num, den).links()
            if found:
                a, b = zip(*((group[i][2], group[j][2]) for i, j in found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = members.repartition("token", "salt").sortWithinPartitions("token", "salt")
    return placed.select("token", "salt", "c", "tokens").mapInArrow(run, "a long, b long")


def _count_overlaps(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, left, right) of sets that reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (unpack(batch.column(k)[i].as_py()) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(_linked(both, len(x), len(y), num, den))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(k, doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``k`` is the hash of the row by which callers can join the result back.
    """
    source = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    order = context.broadcast(Order(*frequencies(docs, size)))
    every = checkpoint(_describe(source, size, num, den, order))
    full = every.where("n > 0")
    sets = full.groupBy("c").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    tokens = sets.select("c", "k", "n", F.posexplode("prefix").alias("pos", "token"))
    # A table of its own: a join of two plain shuffles can be split where a shingle is hot.
    shared = checkpoint(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"))
    meets = checkpoint(tokens.join(shared, "token"))
    least = 1 + F.floor(F.ceil(F.col("n") * num / den) * EXTRA / 100)
    enough = meets.groupBy("c", "n").agg(F.count("*").alias("met")).where(F.col("met") >= least).select("c")
    meets = checkpoint(meets.join(enough, "c"))
    counts = meets.groupBy("token").agg(F.count("*").alias("df"), F.min("c").alias("pivot")).where("df > 1")
    meets = checkpoint(meets.join(counts, "token"))

    first = Window.partitionBy("c").orderBy(F.desc("df"), "token")
    homes = meets.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= HOMES)
    homes = homes.groupBy("c", "k").agg(F.collect_list("token").alias("homes"))
    texts = homes.join(source.select("k", "text"), "k").select("c", "text", "homes")
    # Repeated rows share k; one of them stands for the class.
    stored = checkpoint(_sets(texts, size, order).dropDuplicates(["c"]))

    blocks = F.ceil(F.col("df") / BLOCK_ROWS).cast("int")
    salts = F.when(F.col("c") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("c"), blocks).cast("int"))
    )
    members = stored.select("c", "tokens", F.explode("homes").alias("token")).join(counts_of(meets), "token")
    members = members.select("c", "tokens", "token", F.explode(salts).alias("salt"))
    links = checkpoint(_search_blocks(members, num, den))
    labels = components(links)

    named = meets.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    # Sets that were in one block have met; a pair has to be listed only if it was in none.
    blocks_of = members.groupBy("c").agg(F.sort_array(F.collect_set(F.xxhash64("token", "salt"))).alias("met"))
    named = named.select("token", "c", "n", "pos", "label").join(blocks_of, "c")
    named = checkpoint(named.withColumn("home", F.get("met", F.lit(0))))
    sides = named.groupBy("token").agg(*(f(x).alias(f"{g}_{x}") for x in ("label", "home") for g, f in (("x", F.min), ("y", F.max))))
    mixed = checkpoint(sides.where("x_label <> y_label AND x_home <> y_home").select("token"))
    rest = named.join(mixed, "token").join(stored.select("c", "sketch"), "c").withColumn("band", band_of(F.col("n"), num, den))
    rest = checkpoint(rest)
    parts = ("c", "n", "pos", "label", "met", "sketch")
    a, b = (rest.select("token", "band", *(F.col(x).alias(f"{x}_{s}") for x in parts)) for s in "ab")
    # The larger set of a pair is in the band of the smaller one or in the next.
    a = a.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    words = ((F.get(f"sketch_{s}", F.lit(i)) for s in "ab") for i in range(SKETCH // 64))
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in words), F.lit(0))
    near = (
        (F.col("label_a") != F.col("label_b"))
        & ~F.arrays_overlap("met_a", "met_b")
        & ((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("c_a") < F.col("c_b")))
        & (den * F.col("n_a") >= num * F.col("n_b"))
        & ((den + num) * differ <= (den - num) * (F.col("n_a") + F.col("n_b")))
    )
    pairs = a.join(b, ["token", "band"]).where(near).groupBy("c_a", "c_b", "n_a", "n_b").agg(
        F.count("*").alias("shared"), (F.max("pos_a") + F.max("pos_b") + 2).alias("passed")
    )
    apart = F.col("passed") - 2 * F.col("shared")
    pairs = pairs.where((den + num) * apart <= (den - num) * (F.col("n_a") + F.col("n_b")))
    pairs = pairs.where(F.col("shared") > F.floor(F.col("n_a") * EXTRA / 100))
    pairs = pairs.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    left, right = (stored.select(F.col("c").alias(s), F.col("tokens").alias(t)) for s, t in (("a", "left"), ("b", "right")))
    more = checkpoint(_count_overlaps(pairs.join(left, "a").join(right, "b"), num, den))
    if not more.isEmpty():
        labels = components(links.union(more))
    return _name(every, full, labels)


def counts_of(meets: DataFrame) -> DataFrame:
    return meets.select("token", "df", "pivot").distinct()


def row_key():
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _name(every: DataFrame, full: DataFrame, labels: DataFrame) -> DataFrame:
    """Name components by their least doc_id; the hot ones are summed before the shuffle."""
    least = full.groupBy("c").agg(F.min("doc_id").alias("first")).join(labels.withColumnRenamed("node", "c"), "c", "left")
    least = checkpoint(least.withColumn("label", F.coalesce("label", "c")))
    by_label = least.groupBy("label").agg(F.min("first").alias("least"))
    names = least.join(by_label, "label").select("c", "least")
    joined = every.join(names.withColumn("n_", F.lit(1)), (every.c == names.c) & (every.n > 0), "left")
    return joined.select(
        "k",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )
