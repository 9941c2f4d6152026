"""Document vectors, cosine neighbours and similarity reports.

Neighbours and similar pairs are found exactly, and without scoring every pair when
the vectors have any structure. On unit vectors the cosine falls as the Euclidean
distance grows, so the triangle inequality can rule out whole regions, as in the
pivot-based k-nearest-neighbour join of Lu et al. (VLDB 2012):

* every query vector belongs to the cell of its nearest pivot;
* a target is sent to a cell only when its distance to the pivot does not exceed the
  cell's radius plus the distance within which the cell's queries can have a result;
* near cells share a block and a cell that holds many vectors is cut into several, so a task
  sees a bounded number of queries and targets, however the data is skewed, and a target is
  sent on once per block: where nothing can be ruled out, what is shuffled is a copy of each
  side for every block of the other.

Identical vectors are joined once and expanded afterwards, so a corpus in which many
documents are copies of one costs no more than its distinct documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.arrays import dot, millionths, unit
from textloom.sources.tables import PIECE_BYTES, checkpoint, numbered

BLOCK_ROWS = 8192
#: Blocks of a join of vectors hold up to four times as many rows where these stay below so many bytes.
BLOCK_BYTES = 1 << 24
#: Bytes of vectors that a packed block of ``cosine_pairs`` holds at most.
PACKED_BYTES = 1 << 20
MAX_PIVOTS = 256
MAX_WIDE_COLUMNS = 1000
DIGITS = 6
SLACK = 1e-6  # keeps rounding errors from ruling out a target


# --- vectors ------------------------------------------------------------------


def vectors_wide(vecs: DataFrame, dim: int, prefix: str = "v") -> DataFrame:
    """One column per dimension: ``(doc_id, v1, v2, ...)``."""
    columns = [F.get("vec", F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(dim)]
    return vecs.select("doc_id", *columns)


def term_bucket(term: Column, dim: int) -> Column:
    """Bucket of a term in ``0 .. dim - 1``, from the first half of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def term_sign(term: Column) -> Column:
    """+1 or -1, from a digit of the MD5 the bucket does not use."""
    odd = F.conv(F.substring(F.md5(term), 16, 1), 16, 10).cast("int") % 2
    return F.when(odd == 1, -1).otherwise(1)


def embed_hashed(scored: DataFrame, dim: int = 384, term: str = "word") -> DataFrame:
    """Signed feature hashing of TF-IDF, length one: ``(doc_id, vec)``.

    Adds ``n * idf``, which differs from TF-IDF by a factor the normalisation removes,
    as whole millionths: the result does not depend on the order in which rows arrive.
    """
    value = millionths(F.col("n") * F.col("idf"))
    hashed = scored.select(
        "doc_id",
        term_bucket(F.col(term), dim).alias("bucket"),
        (value * term_sign(F.col(term))).alias("value"),
    )
    sums = hashed.groupBy("doc_id", "bucket").agg((F.sum("value") / 10**DIGITS).alias("value"))
    # At most dim entries per document are gathered here, and filled up in their order.
    entries = F.sort_array(F.collect_list(F.struct("bucket", "value")))
    before = lambda i: F.coalesce(F.get("entries", i - 1)["bucket"], F.lit(-1))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    filled = F.transform("entries", lambda e, i: F.concat(zeros(e["bucket"] - before(i) - 1), F.array(e["value"])))
    dense = F.concat(F.flatten(filled), zeros(dim - 1 - before(F.size("entries"))))
    gathered = sums.groupBy("doc_id").agg(entries.alias("entries"))
    return gathered.select("doc_id", unit(dense).alias("vec"))


# --- blocked joins of vectors ---------------------------------------------------


def _stack(vecs: pd.Series) -> np.ndarray:
    return np.vstack(vecs.to_numpy()) if len(vecs) else np.zeros((0, 0))


def _pivots(vecs: DataFrame, rows: int) -> np.ndarray:
    """A bounded, repeatable choice of vectors; any choice gives the same results."""
    wanted = max(1, min(MAX_PIVOTS, math.isqrt(rows) // 2))
    chosen = vecs.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # at most MAX_PIVOTS
    return np.array([r.vec for r in chosen], dtype=float)


def _distances(vecs: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (vecs**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * vecs @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def _smallest_per_pivot(targets: DataFrame, pivots: np.ndarray, count: int) -> DataFrame:
    """``(cell, reach)``: distance from each pivot to its ``count``-th nearest target."""

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros((0, len(pivots)))
        for batch in batches:
            if len(batch):
                best = np.vstack([best, _distances(_stack(batch["vec"]), pivots)])
                best = np.partition(best, count - 1, axis=0)[:count] if len(best) > count else best
        depth, cells = best.shape
        yield pd.DataFrame({"cell": np.tile(np.arange(cells), depth), "d": best.ravel()})

    near = targets.select("vec").mapInPandas(reduce_batches, "cell int, d double")
    by_cell = Window.partitionBy("cell").orderBy("d")
    ranked = near.withColumn("r", F.row_number().over(by_cell)).where(F.col("r") <= count)
    return ranked.groupBy("cell").agg(
        F.when(F.count("*") == count, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach")
    )


def _blocked(
    queries: DataFrame,
    targets: DataFrame,
    kernel,
    schema: str,
    within: float | None = None,
    nearest: int | None = None,
) -> DataFrame:
    """Join ``(id, vec)`` tables cell by cell; ``kernel(q_ids, q, t_ids, t)`` scores a block.

    A query's results lie ``within`` a distance, or are its ``nearest`` targets. The
    driver holds pivots and a few numbers per cell, never vectors of the tables.
    """
    pivots = _pivots(targets, targets.count())
    if not len(pivots):
        return targets.sparkSession.createDataFrame([], schema)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_stack(batch["vec"]), pivots)
                yield batch.assign(cell=d.argmin(axis=1).astype("int32"), d=d.min(axis=1))

    id_type = queries.schema["id"].dataType.simpleString()
    q = queries.select("id", "vec").mapInPandas(celled, f"id {id_type}, vec array<double>, cell int, d double")
    cells = q.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("rows"))
    cells = {r.cell: r for r in cells.collect()}
    if within is None:
        near = {r.cell: r.reach for r in _smallest_per_pivot(targets, pivots, nearest).collect()}
        # Scores are rounded before they are ranked: a tie can be a little farther away.
        tie = 2.0 * 10.0**-DIGITS
        reach = {c: math.sqrt((cells[c].radius + near.get(c, math.inf)) ** 2 + tie) for c in cells}
    else:
        reach = {c: within for c in cells}
    limits = [
        float(cells[c].radius + reach[c] + SLACK) if c in cells else -1.0 for c in range(len(pivots))
    ]

    def score(q: dict[str, np.ndarray], t: dict[str, np.ndarray]) -> pd.DataFrame:
        return kernel(q["id"], q["vec"], t["id"], t["vec"])

    rows = {c: r.rows for c, r in cells.items()}
    return meet(q.drop("d"), targets.select("id", "vec"), pivots, np.array(limits), rows, score, schema)


def _groups(pivots: np.ndarray, rows: dict[int, int], most: int) -> np.ndarray:
    """The group of each cell, -1 where it has no queries.

    Cells are taken from one pivot to the nearest that is left, and fill a group up to
    ``most`` queries; a cell of more is a group by itself.
    """
    groups, left = np.full(len(pivots), -1), sorted(c for c in rows if rows[c])
    at, group, held = left[0] if left else 0, -1, math.inf
    while left:
        at = left[int(((pivots[left] - pivots[at]) ** 2).sum(axis=1).argmin())]
        left.remove(at)
        if held + rows[at] > most:
            group, held = group + 1, 0
        groups[at], held = group, held + rows[at]
    return groups


def meet(
    q: DataFrame,
    t: DataFrame,
    pivots: np.ndarray,
    limits: np.ndarray,
    rows: dict[int, int],
    score: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """What ``score`` gives for the queries of each cell and the targets within its limit.

    ``q`` is ``(id, vec, ..., cell)``, ``t`` the same without a cell, and ``rows`` counts the
    queries of each cell. ``score`` takes the columns of a block as arrays, targets in the
    order of their ids.

    Cells share a block as long as it has room, so a target is sent on once per block of
    queries and not once per cell, whatever the limits rule out; a task then holds the cells
    of its block to their own limits. A block is as large as memory allows, but there are
    enough of them for all cores.
    """
    cores = t.sparkSession.sparkContext.defaultParallelism
    columns = t.columns
    shape = t.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("dim")).first()
    room = BLOCK_ROWS * max(1, min(4, BLOCK_BYTES // (8 * BLOCK_ROWS * max(1, shape.dim or 1))))

    def most(count: int) -> int:
        return max(1, min(room, math.ceil(count / math.ceil(math.sqrt(3 * cores)))))

    of_queries = most(sum(rows.values()))
    groups = _groups(pivots, rows, of_queries)
    members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]

    def wanted(vecs: pd.Series) -> np.ndarray:
        inside = _distances(_stack(vecs), pivots) <= limits
        return np.array([inside[:, cells].any(axis=1) for cells in members]).T

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(members), np.int64)
        for batch in batches:
            if len(batch):
                total += wanted(batch["vec"]).sum(axis=0)
        yield pd.DataFrame({"grp": np.arange(len(members)), "n": total})

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(groups=[np.flatnonzero(w).astype("int32") for w in wanted(batch["vec"])])

    # Of no type: an empty column of numbers could not become one of text.
    empty = pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})
    if not members:
        return t.sparkSession.createDataFrame([], schema)
    met = t.select("vec").mapInPandas(counted, "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    met = {r.grp: r.n for r in met.collect()}
    of_targets = most(shape.rows)
    q_blocks = [math.ceil(sum(rows[c] for c in cells) / of_queries) for cells in members]
    t_blocks = [max(1, math.ceil(met.get(g, 0) / of_targets)) for g in range(len(members))]

    def place(side: DataFrame, mine: str, own: list[int], theirs: str, other: list[int]) -> DataFrame:
        number = lambda of: F.get(F.array(*[F.lit(n) for n in of]), F.col("grp"))
        block = F.pmod(F.xxhash64("id"), number(own)).cast("int")
        return side.withColumn(mine, block).withColumn(theirs, F.explode(F.sequence(F.lit(0), number(other) - 1)))

    keys = ["grp", "q_block", "t_block"]
    left = q.withColumn("grp", F.get(F.array(*[F.lit(int(g)) for g in groups]), F.col("cell")))
    left = place(left, "q_block", q_blocks, "t_block", t_blocks).groupBy(*keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
    right = t.mapInPandas(sent, f"{fields}, groups array<int>").select(*columns, F.explode("groups").alias("grp"))
    right = place(right, "t_block", t_blocks, "q_block", q_blocks)
    # New names on this side: both may come from one table.
    right = right.select(*[F.col(c).alias(f"t_{c}") for c in columns], *keys).groupBy(*keys)

    def arrays(side: pd.DataFrame, prefix: str = "") -> dict[str, np.ndarray]:
        return {c: _stack(side[prefix + c]) if c == "vec" else side[prefix + c].to_numpy() for c in columns}

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return empty.copy()
        mine, theirs = arrays(a), arrays(b.sort_values("t_id", kind="stable"), "t_")
        cell = a["cell"].to_numpy()
        cells = np.unique(cell)
        inside = _distances(theirs["vec"], pivots[cells]) <= limits[cells]
        whole = inside.all(axis=0)
        shares = [(np.isin(cell, cells[whole]), slice(None))] if whole.any() else []
        shares += [(cell == c, inside[:, i]) for i, c in enumerate(cells) if not whole[i] and inside[:, i].any()]
        found = [score({c: x[qs] for c, x in mine.items()}, {c: x[ts] for c, x in theirs.items()}) for qs, ts in shares]
        return pd.concat(found) if found else empty.copy()

    return left.cogroup(right).applyInPandas(block, schema)


def _row_steps(rows: int, columns: int, numbers: int = 4_000_000) -> Iterator[slice]:
    """Slices of rows that keep a block of scores near so many numbers."""
    step = max(1, numbers // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def frame_of(columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """A frame of arrays as they are: text that pandas keeps in Arrow could not be joined in pieces."""
    return pd.DataFrame({c: pd.Series(x, dtype=x.dtype) for c, x in columns.items()})


def _short(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides in short numbers, and how far off their inner products can be, rounding included."""
    length = max(1.0, float(np.sqrt((q**2).sum(axis=1).max(initial=0.0) * (t**2).sum(axis=1).max(initial=0.0))))
    off = (q.shape[1] + 8) * 1.2e-7 * length + 10.0**-DIGITS
    return q.astype(np.float32), np.ascontiguousarray(t.T, dtype=np.float32), off


def _rounded(q: np.ndarray, t: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of chosen pairs as whole numbers of ``10**-DIGITS``."""
    sims = np.empty(len(row), np.int64)
    for some in _row_steps(len(row), q.shape[1]):
        sims[some] = np.rint(np.einsum("ij,ij->i", q[row[some]], t[col[some]]) * 10**DIGITS)
    return sims


#: Columns of which only the best tells how good a row's best are.
RUN = 64


def best_targets(n: int, sign: int = 1):
    """A kernel: for each query of a block its ``n`` best other targets, ties by target id.

    Short numbers tell which pairs may be among them, and those alone are computed in full.
    """

    def kernel(q_ids, q, t_ids, t):
        found = [frame_of({"q": q_ids[:0], "t": t_ids[:0], "sim": np.zeros(0)})]
        short_q, short_t, off = _short(q, t)
        runs = len(t) // RUN
        # Among so many targets as good as the last of them at least n are not the query itself.
        enough = n + int(pd.Series(t_ids).value_counts().max() if len(t) else 0)
        for part in _row_steps(len(q_ids), len(t_ids)):
            ids = q_ids[part]
            sims = short_q[part] @ short_t
            if runs >= enough:
                tops = sims[:, : runs * RUN].reshape(len(ids), runs, RUN).max(axis=2)
                least = np.partition(tops, runs - enough, axis=1)[:, runs - enough] - 2.0 * off
                row, col = np.nonzero(sims >= least[:, None])
            else:
                row, col = (x.ravel() for x in np.indices(sims.shape))
            other = ids[row] != t_ids[col]
            row, col = row[other], col[other]
            exact = _rounded(q[part], t, row, col)
            # Targets are sorted, so of equal similarities the smallest id comes first.
            order = np.lexsort((col, -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < n
            found.append(frame_of({"q": ids[row[best]], "t": t_ids[col[best]], "sim": sign * exact[best] / 10**DIGITS}))
        return pd.concat(found)

    return kernel


def _nearest_pairs(queries: DataFrame, targets: DataFrame, n: int, sign: int = 1) -> DataFrame:
    """``(q, t, sim)``: for each query its ``n`` best other targets, ties by target id.

    With ``sign=-1`` the queries are negated vectors and ``sim`` is the cosine of the
    original ones, so the best are the least similar.
    """
    id_type = queries.schema["id"].dataType.simpleString()
    schema = f"q {id_type}, t {id_type}, sim double"
    # One target more than asked for: a query may meet itself.
    pairs = _blocked(queries, targets, best_targets(n, sign), schema, nearest=n + 1)
    by_query = Window.partitionBy("q").orderBy((F.col("sim") * sign).desc(), "t")
    ranked = pairs.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= n)
    return ranked.select("q", "t", "sim")


def finite(vec: Column) -> Column:
    """The vector, or an error where a component is NaN or infinite: no distance is defined."""
    odd = F.exists(vec, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(odd, F.raise_error(F.lit("a vector has a component that is not finite"))).otherwise(vec)


def _units(vecs: DataFrame) -> DataFrame:
    return vecs.select("doc_id", unit(finite(F.col("vec"))).alias("vec"))


def copy_groups(vecs: DataFrame) -> DataFrame:
    """``(doc_id, rep)``: the first document with the same direction stands for all."""
    units = _units(vecs)
    first = units.groupBy("vec").agg(F.min("doc_id").alias("rep"))
    return units.join(first, "vec").select("doc_id", "rep")


def _representatives(units: DataFrame) -> DataFrame:
    return units.groupBy("vec").agg(F.min("doc_id").alias("id")).select("id", "vec")


def _padded(reps: DataFrame) -> DataFrame:
    """Adds a dimension that only a zero vector uses.

    It gives a zero vector length one without changing a cosine, so that distance
    orders all vectors as the cosine does.
    """
    spare = F.when(dot(F.col("vec"), F.col("vec")) > 0, 0.0).otherwise(1.0)
    return reps.select("id", F.concat("vec", F.array(spare)).alias("vec"))


# --- similarity -----------------------------------------------------------------


def top_similar(vecs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` nearest documents by cosine, exactly, ties in document order.

    ``(source_document, similar_document, similarity_score, rank)``; a document is not
    its own neighbour, and with fewer than ``n`` others there are fewer rows. Scores
    are rounded to six decimals before ranking.
    """
    return similar_by(vecs, n, _nearest_pairs)


def similar_by(
    vecs: DataFrame, n: int, nearest: Callable[[DataFrame, DataFrame, int], DataFrame], wanted: Column | None = None
) -> DataFrame:
    """``top_similar`` with a way to find nearest pairs of different vectors.

    ``nearest(queries, targets, n)`` joins tables ``(id, vec)`` to ``(q, t, sim)``.
    ``wanted``, a condition on ``doc_id``, limits the documents that ask, not those that
    are found.
    """
    units = _units(vecs).persist()
    # The first n + 1 of a group of copies are all that can be a neighbour of anything.
    in_group = Window.partitionBy("vec").orderBy("doc_id")
    firsts = units.withColumn("r", F.row_number().over(in_group)).where(F.col("r") <= n + 1)
    groups = firsts.groupBy("vec").agg(
        F.min("doc_id").alias("id"), F.sort_array(F.collect_list("doc_id")).alias("members")
    ).persist()

    reps = groups.select("id", "vec")
    points = _padded(reps)
    asking = units if wanted is None else units.where(wanted)
    asked = points if wanted is None else points.join(asking.join(reps, "vec").select("id").distinct(), "id", "left_semi")
    others = nearest(asked, points, n)
    own = groups.select(
        F.col("id").alias("q"), F.col("id").alias("t"), F.round(dot(F.col("vec"), F.col("vec")), DIGITS).alias("sim")
    )
    members = groups.select(F.col("id").alias("t"), "members")
    near = (
        others.unionByName(own)
        .join(members, "t")
        .select("q", "sim", F.explode("members").alias("doc"))
    )
    by_rep = Window.partitionBy("q").orderBy(F.desc("sim"), "doc")
    near = near.withColumn("r", F.row_number().over(by_rep)).where(F.col("r") <= n + 1)
    # At most n + 1 entries per representative are gathered here.
    near = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "doc", "sim"))).alias("near"))

    rep_of = asking.join(reps, "vec").select("doc_id", F.col("id").alias("q"))
    matched = rep_of.join(near, "q")
    listed = F.slice(F.filter("near", lambda x: x["doc"] != F.col("doc_id")), 1, n)
    rows = matched.select("doc_id", F.posexplode_outer(listed).alias("pos", "x")).where("pos is not null")
    return rows.select(
        F.col("doc_id").alias("source_document"),
        F.col("x.doc").alias("similar_document"),
        F.col("x.sim").alias("similarity_score"),
        (F.col("pos") + 1).alias("rank"),
    )


def most_similar(neighbours: DataFrame) -> DataFrame:
    """The nearest document of each source."""
    return neighbours.where(F.col("rank") == 1).select(
        "source_document",
        F.col("similar_document").alias("most_similar"),
        F.col("similarity_score").alias("similarity_to_most_similar"),
    )


def cosine_pairs(vecs: DataFrame, threshold: float, expand_copies: bool = False) -> DataFrame:
    """Pairs with a cosine of at least ``threshold``, both ways: ``(doc1, doc2, cosine)``.

    Complete and exact for the threshold; -1 lists every pair, which grows with the
    square of the corpus. Copies are listed through their first document, see
    ``copy_groups``; ``expand_copies`` writes out the pairs of all documents.

    Blocks of vectors meet as they lie in the checkpoint folder, so what is shuffled is
    the vectors, not a copy for each block of the others.
    """
    units = _units(vecs)
    points = units.select(F.col("doc_id").alias("id"), "vec") if expand_copies else _representatives(units)
    points = checkpoint(_padded(points.where("id is not null and vec is not null")))
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"doc1 {id_type}, doc2 {id_type}, cosine double"
    shape = points.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("dim")).first()
    pivots = _pivots(points, shape.rows)
    if not len(pivots):
        return points.sparkSession.createDataFrame([], schema)
    scale = 10**DIGITS
    least = round(threshold * scale)
    within = math.sqrt(max(0.0, 2.0 - 2.0 * (threshold - 1.0 / scale))) + SLACK
    packed, radius = _cells_packed(points, pivots, shape.rows, shape.dim)

    def score(q_ids, q, t_ids, t, same):
        for part in _row_steps(len(q_ids), len(t_ids)):
            ids = q_ids[part]
            products = q[part] @ t.T
            products *= scale
            row, col = np.nonzero(products >= least - 1.0)
            real = ids[row] != t_ids[col]
            if same:
                real &= row + part.start < col
            row, col = row[real], col[real]
            near = products[row, col]
            sims = np.rint(near).astype(np.int64)
            # What a product that is off by rounding leaves open is computed by itself.
            open_ = np.flatnonzero(np.abs(np.abs(near - sims) - 0.5) < 1e-4)
            sims[open_] = _rounded(q[part], t, row[open_], col[open_])
            real = sims >= least
            first, second, sims = ids[row[real]], t_ids[col[real]], sims[real] / scale
            columns = {"doc1": [first, second], "doc2": [second, first], "cosine": [sims, sims]}
            yield frame_of({c: np.concatenate(x) for c, x in columns.items()})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, t = _unpacked(r.vecs, r.ids), _unpacked(r.t_vecs, r.t_ids)
                if r.block == r.t_block:
                    yield from score(r.ids, q[:, :-1], r.t_ids, t[:, :-1], True)
                    continue
                cells = np.unique(r.cells)
                inside = _distances(t, pivots[cells]) <= radius[cells] + within
                whole = inside.all(axis=0)
                shares = [(np.isin(r.cells, cells[whole]), slice(None))] if whole.any() else []
                shares += [(r.cells == c, inside[:, i]) for i, c in enumerate(cells) if not whole[i] and inside[:, i].any()]
                for qs, ts in shares:
                    yield from score(r.ids[qs], q[qs, :-1], r.t_ids[ts], t[ts, :-1], False)

    # Blocks that some pivot tells apart by more than the distance within which pairs lie do not meet.
    apart = F.exists(F.zip_with("low", "t_high", lambda x, y: x - y > within), lambda x: x)
    apart |= F.exists(F.zip_with("t_low", "high", lambda x, y: x - y > within), lambda x: x)
    pairs = _block_pairs(packed, ~apart)
    return pairs.select("block", "ids", "vecs", "cells", "t_block", "t_ids", "t_vecs").mapInPandas(met, schema)


def _cells_packed(points: DataFrame, pivots: np.ndarray, rows: int, dim: int) -> tuple[DataFrame, np.ndarray]:
    """``(id, vec)`` in blocks of near cells, and the radius of each cell.

    ``(block, ids, vecs, cells, low, high)``: the last two are the least and the greatest
    distance of the block's vectors from each pivot.
    """
    id_type = points.schema["id"].dataType.simpleString()

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_stack(batch["vec"]), pivots)
                yield batch.assign(cell=d.argmin(axis=1).astype("int32"), d=d.min(axis=1))

    # A row's place, not its id, says which block of its cells it is in: an id may come on many rows.
    placed = points.withColumn("at", F.monotonically_increasing_id())
    placed = placed.mapInPandas(celled, f"id {id_type}, vec array<double>, at bigint, cell int, d double")
    cells = placed.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("rows")).collect()
    counts, radius = {r.cell: r.rows for r in cells}, np.zeros(len(pivots))
    for r in cells:
        radius[r.cell] = r.radius + SLACK
    cores = points.sparkSession.sparkContext.defaultParallelism
    room = max(1, min(BLOCK_ROWS, PACKED_BYTES // (8 * max(1, dim))))
    most = max(1, min(room, math.ceil(rows / math.ceil(math.sqrt(3 * cores)))))
    groups = _groups(pivots, counts, most)
    held = np.zeros(groups.max() + 1, int)
    for cell, n in counts.items():
        held[groups[cell]] += n
    blocks = -(-held // most)
    first = np.cumsum(blocks) - blocks

    def of(values: np.ndarray) -> Column:
        return F.get(F.array(*[F.lit(int(values[g]) if g >= 0 else 0) for g in groups]), F.col("cell"))

    block = (of(first) + F.pmod(F.xxhash64("at"), of(blocks))).cast("int")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "at"], kind="stable")
        stacked = _stack(rows["vec"])
        d = _distances(stacked, pivots)
        found = (rows["block"].iloc[0], rows["id"].tolist(), stacked.tobytes(), rows["cell"].tolist(), d.min(axis=0), d.max(axis=0))
        return pd.DataFrame([found], columns=["block", "ids", "vecs", "cells", "low", "high"])

    schema = f"block int, ids array<{id_type}>, vecs binary, cells array<int>, low array<double>, high array<double>"
    placed = placed.select("id", "vec", "at", "cell", block.alias("block"))
    return checkpoint(placed.groupBy("block").applyInPandas(pack, schema)), radius


def _unpacked(vecs: bytes, ids: np.ndarray) -> np.ndarray:
    return np.frombuffer(vecs).reshape(len(ids), -1)


def _block_pairs(packed: DataFrame, condition: Column | None = None) -> DataFrame:
    """Every two rows of a table of blocks, and each with itself, once; the columns of the second begin with ``t_``.

    A cartesian product: partitions are read again for each other one, nothing is sent on
    per pair. A partition holds about ``PIECE_BYTES`` of blocks.
    """
    cores = packed.sparkSession.sparkContext.defaultParallelism
    size = packed.agg(F.count("*").alias("rows"), F.sum(F.length("vecs")).alias("bytes")).first()
    parts = max(math.ceil(math.sqrt(4 * cores)), -(-(size.bytes or 0) // PIECE_BYTES))
    packed = packed.repartition(max(1, min(size.rows, parts)))
    other = packed.select(*[F.col(c).alias(f"t_{c}") for c in packed.columns])
    meet = F.col("block") <= F.col("t_block")
    return packed.hint("shuffle_replicate_nl").join(other, meet if condition is None else meet & condition)


def similarity_long(vecs: DataFrame, threshold: float, expand_copies: bool = False) -> DataFrame:
    """The similarity matrix in long form, diagonal included, down to ``threshold``.

    See ``cosine_pairs`` for the pairs of copies.
    """
    diagonal = vecs.select(
        F.col("doc_id").alias("doc1"), F.col("doc_id").alias("doc2"), F.lit(1.0).alias("cosine")
    )
    return cosine_pairs(vecs, threshold, expand_copies).unionByName(diagonal)


def similarity_wide(vecs: DataFrame, ids: Sequence) -> DataFrame:
    """Similarity of every document to the listed ones, a column ``sim_<id>`` each."""
    if len(ids) > MAX_WIDE_COLUMNS:
        raise ValueError(f"at most {MAX_WIDE_COLUMNS} columns: use similarity_long")
    units = _units(vecs)
    listed = {r.doc_id: r.vec for r in units.where(F.col("doc_id").isin(list(ids))).collect()}
    missing = [i for i in ids if i not in listed]
    if missing:
        raise ValueError(f"no vector for {missing}")
    matrix = np.array([listed[i] for i in ids], dtype=float)

    names = [f"sim_{i}" for i in ids]

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sims = np.round(_stack(batch["vec"]) @ matrix.T, DIGITS)
                yield pd.concat([batch[["doc_id"]], pd.DataFrame(sims, columns=names, index=batch.index)], axis=1)

    id_type = units.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"`{name}` double" for name in names)
    return units.mapInPandas(against, f"doc_id {id_type}, {columns}")


# --- the whole matrix, in tiles -------------------------------------------------

TILE_SIDE = 512


def similarity_tiles(vecs: DataFrame, side: int = TILE_SIDE) -> DataFrame:
    """The whole similarity matrix, diagonal included, in tiles of at most ``side`` squared.

    ``(row_block, col_block, row_ids, col_ids, cosines)``: documents are numbered in the
    order of their ids and cut into blocks of ``side``; ``cosines`` lists a tile row by
    row. A tile below the diagonal is its mirror image, computed once, and blocks are not
    shuffled per tile. Rows without a
    vector are left out; a vector of zeros has a cosine of 0 with all, itself included.
    """
    if side < 1:
        raise ValueError("side must be positive")
    units = numbered(_units(vecs.where("vec is not null")).orderBy("doc_id"), "at")
    placed = units.select("doc_id", "vec", F.expr(f"cast((at - 1) div {side} as int)").alias("block"))
    id_type = placed.schema["doc_id"].dataType.simpleString()
    scale = 10**DIGITS

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        found = (rows["block"].iloc[0], rows["doc_id"].tolist(), _stack(rows["vec"]).astype(float).tobytes())
        return pd.DataFrame([found], columns=["block", "ids", "vecs"])

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                left, right = _unpacked(r.vecs, r.ids), _unpacked(r.t_vecs, r.t_ids)
                sims = np.rint(left @ right.T * scale) / scale + 0.0
                found = [(r.block, r.t_block, r.ids, r.t_ids, sims.ravel())]
                if r.block < r.t_block:
                    found.append((r.t_block, r.block, r.t_ids, r.ids, sims.T.ravel()))
                yield pd.DataFrame(found, columns=["row_block", "col_block", "row_ids", "col_ids", "cosines"])

    ids = f"array<{id_type}>"
    packed = checkpoint(placed.groupBy("block").applyInPandas(pack, f"block int, ids {ids}, vecs binary"))
    return _block_pairs(packed).mapInPandas(
        tiles, f"row_block int, col_block int, row_ids {ids}, col_ids {ids}, cosines array<double>"
    )


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Write tiles in the order of the matrix, so that a row of blocks lies in few files."""
    keys = ("row_block", "col_block")
    tiles.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def tiles_long(tiles: DataFrame) -> DataFrame:
    """Tiles as one row per entry: ``(doc1, doc2, cosine)``."""
    rows = tiles.select(F.posexplode("row_ids").alias("at", "doc1"), "col_ids", "cosines")
    width = F.size("col_ids")
    row = F.slice("cosines", F.col("at") * width + 1, width)
    entries = F.arrays_zip(F.col("col_ids").alias("doc2"), row.alias("cosine"))
    return rows.select("doc1", F.inline(entries).alias("doc2", "cosine"))


def tiles_wide(tiles: DataFrame, ids: Sequence) -> DataFrame:
    """Tiles as a column ``sim_<id>`` for each listed document: a view for reading few columns.

    An id that has no vector gives a column of nulls.
    """
    ids = list(ids)
    listed = F.array(*(F.lit(i) for i in ids)).cast(tiles.schema["col_ids"].dataType)
    entries = tiles_long(tiles.where(F.arrays_overlap("col_ids", listed))).where(F.col("doc2").isin(ids))
    columns = [F.max(F.when(F.col("doc2") == i, F.col("cosine"))).alias(f"sim_{i}") for i in ids]
    return entries.groupBy(F.col("doc1").alias("doc_id")).agg(*columns)


def mean_similarity(vecs: DataFrame) -> Column:
    """Mean cosine over all pairs, as a scalar: linear in the corpus, no pair is formed.

    The sum over pairs follows from the length of the sum of all unit vectors.
    """
    units = _units(vecs)
    by_dim = units.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    total = by_dim.agg(F.sum(F.col("s") * F.col("s"))).scalar()
    own = units.agg(F.struct(F.count("*").alias("n"), F.sum(dot(F.col("vec"), F.col("vec"))).alias("own"))).scalar()
    n = own["n"].cast("double")
    return F.when(n > 1, F.round((total - own["own"]) / (n * (n - 1)), 4))


def similarity_stats(vecs: DataFrame) -> DataFrame:
    """One row: documents, dimensions, mean similarity, most and least similar pair."""
    near = most_similar(top_similar(vecs, 1))
    nearest = near.orderBy(F.desc("similarity_to_most_similar"), "source_document").limit(1)
    nearest = nearest.select(
        F.struct(
            F.col("source_document").alias("doc1"),
            F.col("most_similar").alias("doc2"),
            F.col("similarity_to_most_similar").alias("sim"),
        )
    )
    reps = _padded(_representatives(_units(vecs))).persist()
    negated = reps.select("id", F.transform("vec", lambda x: -x).alias("vec"))
    far = _nearest_pairs(negated, reps, 1, sign=-1).orderBy("sim", "q", "t").limit(1)
    farthest = far.select(F.struct(F.col("q").alias("doc1"), F.col("t").alias("doc2"), "sim"))
    row = vecs.agg(F.count("*").alias("documents"), F.max(F.size("vec")).alias("dimensions"))
    return row.select(
        "documents",
        "dimensions",
        mean_similarity(vecs).alias("mean_similarity"),
        nearest.scalar().alias("most"),
        # Copies of one vector only: their pair is also the least similar one.
        F.coalesce(farthest.scalar(), nearest.scalar()).alias("least"),
    ).select(
        "documents",
        "dimensions",
        "mean_similarity",
        F.col("most.doc1").alias("most_similar_doc1"),
        F.col("most.doc2").alias("most_similar_doc2"),
        F.col("most.sim").alias("most_similarity"),
        F.col("least.doc1").alias("least_similar_doc1"),
        F.col("least.doc2").alias("least_similar_doc2"),
        F.col("least.sim").alias("least_similarity"),
    )
