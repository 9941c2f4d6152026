"""k-means, its quality measures, Ward's hierarchical clustering, cluster reports.

Clusters are numbered from 0. The driver holds centres, one number per cluster or candidate
k, and a sample of at most ``CORESET`` rows on which k-means starts are tried.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from textloom.operators.features import micro_clusters as micro_clusters
from textloom.operators.vectors import BLOCK_ROWS, DIGITS, _row_steps, _stack, finite
from textloom.operators.ward import ward_linkage as ward_linkage
from textloom.sources.tables import checkpoint, numbered

MAX_K = 10


# --- k-means --------------------------------------------------------------------


#: Rows of the weighted sample that all starts run on; a smaller table is taken whole.
CORESET = 8192


class Fit(NamedTuple):
    centres: np.ndarray
    cost: float


def _features(vecs: DataFrame) -> DataFrame:
    return vecs.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def coreset(vecs: DataFrame, rows: int = CORESET, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that cost what the whole table costs, for any centres, nearly.

    A row is drawn half by its share of the squared distances to the mean and half evenly
    (Bachem et al., KDD 2018), by a hash of its id, so the draw does not depend on
    partitions. Of rows in order of priority the first are kept, and weights make sums over
    them unbiased. At most ``rows`` rows return to the driver; a table of no more than that
    returns whole, each row of weight 1.
    """
    points = vecs.where("vec is not null").select("doc_id", finite(F.col("vec").cast("array<double>")).alias("vec"))
    total = points.count()
    if total > rows:
        mean = [r.mean for r in cluster_means(points.withColumn("cluster", F.lit(0))).orderBy("dim").collect()]
        apart = F.aggregate(F.zip_with("vec", F.array(*map(F.lit, mean)), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
        far = points.withColumn("apart", apart)
        spread = far.agg(F.sum("apart")).first()[0]
        share = F.lit(0.5 / total) + (F.col("apart") / (2 * spread) if spread > 0 else F.lit(0.5 / total))
        even = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = far.withColumn("share", share).withColumn("priority", F.col("share") / even)
        drawn = drawn.orderBy(F.desc("priority"), "doc_id").limit(rows + 1).collect()
        least = drawn[rows].priority
        found = [(r.vec, max(1.0, least / r.share)) for r in drawn[:rows]]
    else:
        found = [(r.vec, 1.0) for r in points.orderBy("doc_id").collect()]
    return np.array([v for v, _ in found], float).reshape(len(found), -1), np.array([w for _, w in found])


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2.0 * points @ centres.T, 0.0)


def _one_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int, max_iter: int) -> tuple[float, np.ndarray]:
    """Cost and centres of weighted k-means from a start by k-means++."""
    random = np.random.default_rng(seed)
    centres = points[[random.choice(len(points), p=weights / weights.sum())]]
    nearest = _squared(points, centres)[:, 0]
    while len(centres) < k:
        odds = nearest * weights
        # With fewer different points than centres the rest are copies.
        at = random.choice(len(points), p=odds / odds.sum()) if odds.sum() > 0 else 0
        centres = np.vstack([centres, points[at]])
        nearest = np.minimum(nearest, _squared(points, points[[at]])[:, 0])
    cost = math.inf
    for _ in range(max_iter):
        squared = _squared(points, centres)
        own = squared.argmin(axis=1)
        now = float((squared[np.arange(len(points)), own] * weights).sum())
        if now >= cost * (1 - 1e-9):
            break
        cost = now
        member = np.zeros((len(points), k))
        member[np.arange(len(points)), own] = weights
        mass = member.sum(axis=0)
        moved = mass > 0
        centres = centres.copy()
        centres[moved] = (member.T @ points)[moved] / mass[moved, None]
    return cost, centres


def _best_starts(spark, points: np.ndarray, weights: np.ndarray, ks: Sequence[int], n_init: int, seed: int, max_iter: int) -> dict[int, np.ndarray]:
    """The best centres for each k on a coreset; every start is a task's work."""
    shared = spark.sparkContext.broadcast((points, weights))
    ks = list(ks)

    def run(batches):
        for batch in batches:
            for i in batch["id"].tolist():
                k, start = ks[i // n_init], i % n_init
                cost, centres = _one_start(*shared.value, k, seed + start, max_iter)
                yield pd.DataFrame({"k": [k], "cost": [cost], "start": [start], "centres": [centres.ravel().tolist()]})

    starts = spark.range(0, len(ks) * n_init, 1, min(len(ks) * n_init, 4 * spark.sparkContext.defaultParallelism))
    found = starts.mapInPandas(run, "k int, cost double, start int, centres array<double>")
    best = found.groupBy("k").agg(F.min(F.struct("cost", "start", "centres")).alias("best")).collect()  # one row per k
    shared.destroy()
    return {r.k: np.array(r.best.centres).reshape(r.k, -1) for r in best}


def _moves(vecs: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """For the centres of each k their cost over all rows, and the means of the rows nearest to each.

    All k are answered in one pass. A partition sums its own rows, so a row per centre and
    partition is shuffled.
    """

    def sums(batches):
        totals = {k: [np.zeros(c.shape), np.zeros(k), np.zeros(k)] for k, c in centres.items()}
        for batch in batches:
            if len(batch):
                points = _stack(batch["vec"]).astype(float)
                for k, held in totals.items():
                    squared = _squared(points, centres[k])
                    own = squared.argmin(axis=1)
                    member = (own[:, None] == np.arange(k)[None, :]).astype(float)
                    held[0] += member.T @ points
                    held[1] += member.sum(axis=0)
                    held[2] += np.bincount(own, ((points - centres[k][own]) ** 2).sum(axis=1), k)
        for k, (total, mass, cost) in totals.items():
            yield pd.DataFrame({"k": k, "cluster": np.arange(k), "n": mass, "cost": cost, "total": list(total)})

    parts = vecs.where("vec is not null").select("vec").mapInPandas(sums, "k int, cluster int, n double, cost double, total array<double>")
    # Added as vectors: a column per dimension would be a plan per dimension.
    added = Summarizer.sum(array_to_vector("total"))
    out = {k: [0.0, c.copy()] for k, c in centres.items()}
    for r in parts.groupBy("k", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), added.alias("total")).collect():  # one row per centre
        out[r.k][0] += r.cost
        if r.n > 0:
            out[r.k][1][r.cluster] = r.total.toArray() / r.n
    return {k: (cost, after) for k, (cost, after) in out.items()}


def fits(vecs: DataFrame, ks: Iterable[int], n_init: int, seed: int = 42, max_iter: int = 50) -> dict[int, Fit]:
    """The best of ``n_init`` k-means runs for each k, by within-cluster sum of squares.

    All starts run on a ``coreset``, many at a time; the best start for each k then goes on
    over all rows until its cost falls no more, and that cost is reported. All k that still
    move share a pass, so there are at most ``max_iter + 1`` passes over the rows.
    """
    ks = sorted(set(ks))
    if ks and ks[0] < 2:
        raise ValueError("k must be at least 2; within_ss gives the cost of one cluster")
    if n_init < 1:
        raise ValueError("n_init must be at least 1")
    points, weights = coreset(vecs, CORESET, seed)
    if not len(points) or not ks:
        if ks:
            raise ValueError("no vectors to cluster")
        return {}
    centres = _best_starts(vecs.sparkSession, points, weights, ks, n_init, seed, max_iter)
    moved = _moves(vecs, centres)
    out = {k: Fit(centres[k], cost) for k, (cost, _) in moved.items()}
    for _ in range(max_iter if len(points) == CORESET else 0):
        live = {k: after for k, (_, after) in moved.items()}
        moved = {k: found for k, found in _moves(vecs, live).items() if found[0] < out[k].cost * (1 - 1e-6)}
        out |= {k: Fit(live[k], cost) for k, (cost, _) in moved.items()}
        if not moved:
            break
    return out


def kmeans(vecs: DataFrame, k: int, n_init: int = 25, seed: int = 42, max_iter: int = 50) -> Fit:
    """The best of ``n_init`` k-means runs; ``k >= 2``. See ``fits``."""
    return fits(vecs, [k], n_init, seed, max_iter)[k]


def membership(fit: Fit, vecs: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, cluster)`` and any columns to keep, such as a summary."""
    return vecs.where("vec is not null").select("doc_id", *keep, _nearest_centre(fit.centres)("vec").alias("cluster"))


def _nearest_centre(centres: np.ndarray):
    # A label that no vector starts with has no centre and takes no vector.
    labels = np.flatnonzero(np.isfinite(centres).all(axis=1)).astype("int32")
    known = centres[labels]

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        points = _stack(batch).astype(float)
        squared = (known**2).sum(1)[None, :] - 2.0 * points @ known.T
        return pd.Series(labels[squared.argmin(axis=1)])

    return nearest


def cluster_means(assigned: DataFrame) -> DataFrame:
    """Centre of each cluster of ``(vec, cluster)``: ``(cluster, dim, mean)``."""
    # One row per vector is summed, not one per number of it.
    means = _features(assigned.where("vec is not null")).groupBy("cluster").agg(Summarizer.mean(F.col("features")).alias("mean"))
    return means.select("cluster", F.posexplode(vector_to_array("mean")).alias("dim", "mean"))


def kmeans_from(assigned: DataFrame, iterations: int) -> DataFrame:
    """k-means from a given start: ``(doc_id, vec, cluster)`` to ``(doc_id, cluster)``.

    ``cluster`` numbers the starting groups from 0. Each iteration moves the centres,
    which are all that returns to the driver, and assigns every vector to the nearest;
    an emptied cluster keeps its centre.
    """
    centres: np.ndarray | None = None
    for _ in range(iterations):
        means = cluster_means(assigned).collect()  # k rows per dimension
        if centres is None:
            shape = (1 + max(r.cluster for r in means), 1 + max(r.dim for r in means))
            centres = np.full(shape, np.inf)
        centres = centres.copy()
        for r in means:
            centres[r.cluster, r.dim] = r.mean
        assigned = assigned.withColumn("cluster", _nearest_centre(centres)("vec"))
    return assigned.select("doc_id", "cluster")


# --- how many clusters ------------------------------------------------------------


def within_ss(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances to the cluster centres of ``(doc_id, vec, cluster)``.

    One row ``(k, wss)``; with a constant cluster, the cost of a single one.
    """
    found = Summarizer.metrics("variance", "count").summary(F.col("features"))
    spread = _features(assigned.where("vec is not null")).groupBy("cluster").agg(found.alias("s"))
    total = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, x: a + x)
    return spread.agg(F.count("*").cast("int").alias("k"), F.sum(total * (F.col("s.count") - 1)).alias("wss"))


def elbow(vecs: DataFrame, ks: Iterable[int] = range(1, MAX_K + 1), n_init: int = 25, seed: int = 42) -> DataFrame:
    """Within-cluster sum of squares for each k: ``(k, wss)``."""
    ks = list(ks)
    found = fits(vecs, [k for k in ks if k > 1], n_init, seed)
    costs = {k: fit.cost for k, fit in found.items()}
    if 1 in ks:
        costs[1] = within_ss(vecs.withColumn("cluster", F.lit(0))).first().wss
    return vecs.sparkSession.createDataFrame([(k, float(costs[k])) for k in ks], "k int, wss double")


def silhouette_sq(assigned: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance: linear in the corpus."""
    points = _features(assigned).withColumn("prediction", F.col("cluster").cast("double"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(points)


def silhouette_points(assigned: DataFrame) -> DataFrame:
    """Euclidean silhouette of every point of ``(doc_id, vec, cluster)``.

    ``(doc_id, cluster, silhouette)``; a point alone in its cluster scores 0. Exact:
    every distance is computed, in blocks of bounded size, and added up per point and
    cluster where it is computed, so pairs are never shuffled. The work still grows
    with the square of the corpus; ``silhouette_sq`` is the linear measure.
    """
    points = assigned.select(F.col("doc_id").alias("id"), "vec", "cluster").persist()
    sizes = points.groupBy("cluster").agg(F.count("*").alias("size")).persist()
    cores = points.sparkSession.sparkContext.defaultParallelism
    rows = points.count()
    blocks = max(math.ceil(rows / BLOCK_ROWS), min(math.isqrt(cores), max(1, rows // 256)))
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, other int, total double"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": [], "other": [], "total": []})]
        if len(left) and len(right):
            q, t = _stack(left["vec"]).astype(float), _stack(right["t_vec"]).astype(float)
            labels = right["t_cluster"].to_numpy()
            names = np.unique(labels)
            own = (labels[:, None] == names[None, :]).astype(float)
            for part in _row_steps(len(q), len(t)):
                squared = (q[part] ** 2).sum(1)[:, None] + (t**2).sum(1)[None, :] - 2.0 * q[part] @ t.T
                ids = left["id"].to_numpy()[part]
                squared[ids[:, None] == right["t_id"].to_numpy()[None, :]] = 0.0
                totals = np.sqrt(np.maximum(squared, 0.0)) @ own
                found.append(
                    pd.DataFrame(
                        {
                            "id": np.repeat(ids, len(names)),
                            "other": np.tile(names, len(ids)),
                            "total": totals.ravel(),
                        }
                    )
                )
        return pd.concat(found[1:] or found)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = points.select("id", "vec", block.alias("a")).withColumn("b", every)
    right = points.select(
        F.col("id").alias("t_id"), F.col("vec").alias("t_vec"), F.col("cluster").alias("t_cluster"), block.alias("b")
    ).withColumn("a", every)
    totals = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(score, schema)
    totals = totals.groupBy("id", "other").agg(F.sum("total").alias("total"))

    sized = totals.join(sizes.withColumnRenamed("cluster", "other"), "other")
    sized = sized.join(points.select("id", "cluster"), "id")
    own = F.col("other") == F.col("cluster")
    a = F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1)))
    b = F.min(F.when(~own, F.col("total") / F.col("size")))
    widths = sized.groupBy("id", "cluster").agg(a.alias("a"), b.alias("b"))
    larger = F.greatest("a", "b")
    width = F.when(larger > 0, (F.col("b") - F.col("a")) / larger).otherwise(0.0)
    defined = F.col("a").isNotNull() & F.col("b").isNotNull()
    return widths.select(
        F.col("id").alias("doc_id"),
        "cluster",
        F.when(defined, width).otherwise(0.0).alias("silhouette"),
    )


def silhouette(assigned: DataFrame) -> DataFrame:
    """Mean Euclidean silhouette, one row ``(points, silhouette)``."""
    return silhouette_points(assigned).agg(
        F.count("*").alias("points"), F.round(F.avg("silhouette"), DIGITS).alias("silhouette")
    )


def choose_k(
    vecs: DataFrame, max_k: int = MAX_K, n_init: int = 10, seed: int = 42, measure: str = "squared"
) -> DataFrame:
    """Silhouette for k from 2 to ``min(max_k, n - 1)``: ``(k, silhouette, chosen)``.

    The first k with the highest silhouette is chosen, and 2 when there are too few
    points to try. ``measure`` is ``squared`` (linear in the corpus) or ``euclidean``
    (every distance).
    """
    if measure not in ("squared", "euclidean"):
        raise ValueError(f"unknown measure {measure!r}: use 'squared' or 'euclidean'")
    scores = []
    found = sorted(fits(vecs, range(2, min(max_k, vecs.count() - 1) + 1), n_init, seed).items())
    # Every row is assigned for all k at once; a measure reads its rows more than once.
    labels = [_nearest_centre(fit.centres)("vec").alias(f"of_{k}") for k, fit in found]
    known = vecs.where("vec is not null").select("doc_id", "vec", *labels).persist()
    for k, _ in found:
        assigned = known.select("doc_id", "vec", F.col(f"of_{k}").alias("cluster"))
        if measure == "squared":
            score = silhouette_sq(assigned)
        else:
            score = silhouette(assigned).first().silhouette
        scores.append((k, float(score)))
    known.unpersist()
    best = max(scores, key=lambda s: s[1])[0] if scores else 2
    rows = [(k, score, k == best) for k, score in scores] or [(2, None, True)]
    return vecs.sparkSession.createDataFrame(rows, "k int, silhouette double, chosen boolean")


# --- reports ----------------------------------------------------------------------


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Documents and percentage per cluster, ordered by cluster."""
    total = members.agg(F.count("*")).scalar()
    sizes = members.groupBy("cluster").agg(F.count("*").alias("documents"))
    percent = F.round(F.col("documents") * 100.0 / total, 1)
    return sizes.withColumn("percent", percent).orderBy("cluster")


def cluster_members(members: DataFrame) -> DataFrame:
    """Member list, one row per document, ordered by cluster and document."""
    return members.select("cluster", "doc_id").orderBy("cluster", "doc_id")


def cluster_reps(members: DataFrame) -> DataFrame:
    """The first document of each cluster in corpus order."""
    return members.groupBy("cluster").agg(F.min("doc_id").alias("doc_id"))


def cluster_keywords(bags: DataFrame, members: DataFrame, idf: DataFrame, n: int = 15) -> DataFrame:
    """Characteristic words: ``(cluster, keyword, avg_tfidf, doc_freq, total_occurrences)``.

    The mean TF-IDF is over the cluster's documents that contain the word. As a word's
    idf is one number, it is the mean ``tf`` times the idf: documents are joined to
    their clusters while still one row each, counts are aggregated per cluster and word
    before the idf is looked up. ``n`` words per cluster, ties cut in word order.
    """
    rows = members.join(bags.where(F.size("terms") > 0), "doc_id")
    rows = rows.select("cluster", "total", F.inline_outer("terms"))
    words = rows.groupBy("cluster", "word").agg(
        F.avg(F.col("n") / F.col("total")).alias("mean_tf"),
        F.count("*").alias("doc_freq"),
        F.sum("n").alias("total_occurrences"),
    )
    scored = words.join(idf.select("word", "idf"), "word").select(
        "cluster",
        F.col("word").alias("keyword"),
        F.round(F.col("mean_tf") * F.col("idf"), 9).alias("avg_tfidf"),
        "doc_freq",
        "total_occurrences",
    )
    best = Window.partitionBy("cluster").orderBy(F.desc("avg_tfidf"), "keyword")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).drop("r")


def cluster_cloud(keywords: DataFrame) -> DataFrame:
    """Words and weights of one word cloud per cluster."""
    return keywords.select(
        "cluster", F.col("keyword").alias("word"), F.col("total_occurrences").alias("frequency")
    )


# --- cuts of a Ward tree ------------------------------------------------------------


def cut_k(tree: DataFrame, k: int) -> DataFrame:
    """The tree's leaves in ``k`` clusters, ``2 <= k <= n``: ``(doc_id, cluster)``.

    The ``k - 1`` highest merges are undone. What remains points from each merged
    cluster to the one it joined, and ``follow`` takes every leaf to its root. Clusters
    are numbered in the order of their first documents.
    """
    n = tree.count() + 1
    if not 2 <= k <= n:
        raise ValueError(f"k must be between 2 and {n}")
    leaves = tree.select(F.explode(F.array("left", "right")).alias("doc_id")).distinct()
    links = tree.where(F.col("step") <= n - k).select(F.col("right").alias("doc_id"), F.col("left").alias("root"))
    links = leaves.join(links, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    links = checkpoint(follow(checkpoint(links)))
    roots = numbered(links.where("doc_id = root").select("root").orderBy("root"), "number")
    return _shared(links, roots, _shares(n)).select("doc_id", (F.col("number") - 1).cast("int").alias("cluster"))


# Rows that point to one place meet it in at least this many shares, of a million rows or less.
SHARES, SHARE_ROWS = 64, 1_000_000


def follow(links: DataFrame) -> DataFrame:
    """Pointers ``(doc_id, root)`` without a cycle, followed to their ends.

    Every ``doc_id`` has one row; an end points to itself. Pointers are doubled, which
    takes a number of rounds that is the logarithm of the longest chain, and a row that
    has reached its end takes no part in later rounds.
    """
    ended = links.where("doc_id = root")
    live = links.where("doc_id <> root")
    shares = _shares(links.count())
    while True:
        ahead = live.select("*", F.lit(False).alias("ends")).unionByName(ended.select("*", F.lit(True).alias("ends")))
        ahead = ahead.select(F.col("doc_id").alias("root"), F.col("root").alias("next"), "ends")
        jumped = checkpoint(_shared(live, ahead, shares).select("doc_id", F.col("next").alias("root"), "ends"))
        ended = ended.unionByName(jumped.where("ends").drop("ends"))
        live = jumped.where("not ends").drop("ends")
        if live.isEmpty():
            return ended


def _shares(rows: int) -> int:
    return max(SHARES, math.ceil(rows / SHARE_ROWS))


def _shared(links: DataFrame, ahead: DataFrame, shares: int) -> DataFrame:
    """``links`` joined to the one row of ``ahead`` with their ``root``, however many share it.

    The places asked for are found per share first, which a partial aggregate shrinks to
    at most a row per share and place; the answer goes back to each share as its own key.
    """
    links = links.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int"))
    answers = links.select("root", "share").distinct().join(ahead, "root")
    return links.join(answers, ["root", "share"]).drop("share")


# Where a cut is suggested, as parts of the greatest height.
CUT_FRACTIONS = (0.3, 0.5, 0.7)


def cut_candidates(tree: DataFrame, fractions: Sequence[float] = CUT_FRACTIONS) -> DataFrame:
    """How many clusters a cut at parts of the greatest height gives.

    ``(fraction, height, clusters)``: one cluster more than there are merges above.
    """
    greatest = tree.agg(F.max("height")).scalar()
    cuts = tree.select(
        "height",
        greatest.alias("greatest"),
        F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"),
    )
    above = F.sum((F.col("height") > F.col("fraction") * F.col("greatest")).cast("long"))
    return cuts.groupBy("fraction").agg(
        (F.max("greatest") * F.col("fraction")).alias("height"), (above + 1).alias("clusters")
    )
