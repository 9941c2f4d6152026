"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each document gives a vector of four transformed rates (letters per word, symbols, repeated
lines and repeated words). For each language and source a minimum-covariance-determinant
estimate is searched: the three quarters of the documents with the least distance give a
mean and a covariance, those give new distances, and so on for ``STEPS`` concentration
steps. That is done from two starts, one robust (median and quartiles of each coordinate)
and one plain (mean and covariance of all); of all estimates on the way, the one of least
determinant is kept. A document is rejected when its Mahalanobis distance is beyond
``CUTOFF``, a chi-square quantile.

No group is too small for an estimate: the moments of a group are joined by those of its
language with the weight of ``BORROWED`` documents, and a language's by those of all rows,
so a group of few documents is judged by its language and nothing jumps at any size.

The estimates are sums over all documents, combined before the shuffle, so a source with a
third of all rows costs no more than others. Coordinates are whole numbers (ten
thousandths) and sums are decimals; quantiles come from histograms of fixed bins. Results
do not depend on the order of rows.

Rates are smoothed towards those of the language and source by ``PRIOR`` words, so that
short texts do not stand out by chance. The covariance has a floor on its diagonal
(``FLOOR``), as most documents have no symbol and no repeated line at all.

Nulls: a null text has no words and fails the base rules; a null language or source counts
as an empty one. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.sources.tables import checkpoint

STEPS = 3
SUBSET = 0.75
#: Chi-square quantile of four degrees of freedom at 0.99999.
CUTOFF = 28.5
#: Its median.
MEDIAN = 3.357
PRIOR = 200
#: Documents for which the language stands in an estimate of a group, all rows in a language's.
BORROWED = 200
#: Least standard deviations of the coordinates.
FLOOR = (0.05, 0.3, 0.3, 0.05)
SCALE = 10_000
DIM = 4
#: Width of the histogram bins of coordinates (in ten thousandths) and of log distance.
BIN, LOG_BINS = 100, 200

#: Parts into which a language and source is cut where rows meet its estimates.
SALTS = 32

GROUP = ["_lang", "_source"]


def _meet(rows: DataFrame, of_group: DataFrame) -> DataFrame:
    """Rows joined with a row per group; a hot group's rows go to ``SALTS`` keys."""
    salted = of_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("_id", F.lit(SALTS)).cast("int")).join(salted, [*GROUP, "_salt"]).drop("_salt")


def _zero() -> Column:
    return F.lit(0).cast("long")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``n_words`` and the base statistics of every whole text; no shuffle."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(*keep, text.alias("_text"), words.alias("_words"))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    # A window stands for itself by a 64-bit hash; they are compared within a text only.
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    rows = rows.select(
        *keep,
        "n_words",
        F.aggregate("_words", _zero(), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        hashes.alias("_hashes"),
    )
    five = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 5),
        lambda i: F.xxhash64(*(F.get(F.col("_hashes"), i + k) for k in range(5))),
    )
    rows = rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= 6, five).alias("_windows"),
    )
    rows = rows.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    return rows.withColumn("n_repeat_words", F.when(F.col("_repeats"), _covered(F.col("_windows"))).otherwise(_zero())).drop(
        "_windows", "_repeats"
    )


def _covered(windows: Column) -> Column:
    """Words in windows of five that occur twice: equal ones meet when sorted."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(s, k):
        return F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"]) | (k > 0) & (F.get(s, k)["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])

    # The sorted array is bound by a one-element transform, so that it is made once.
    starts = F.flatten(
        F.transform(
            F.array(placed),
            lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(s, k)), lambda k: F.get(s, k)["i"]),
        )
    )
    state = F.struct(F.lit(0).alias("end"), _zero().alias("n"))
    return F.aggregate(
        F.array_sort(starts),
        state,
        lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _with_borrowed(moments: DataFrame, n: str, sums: list[str], weight: float) -> DataFrame:
    """Sums of groups with those of their language and of all rows added at a weight.

    ``n`` counts what the sums are of. There is one row per group here, not per document.
    """
    names = [n, *sums]
    plain = moments.select(*GROUP, *(F.col(c).cast("double").alias(c) for c in names))
    whole = plain.agg(F.struct(*(F.sum(c).alias(c) for c in names))).scalar()
    langs = plain.groupBy(GROUP[0]).agg(*(F.sum(c).alias(f"l_{c}") for c in names))
    joined = plain.join(langs, GROUP[0]).withColumn("w_", whole)

    def add(mine, other, other_n):
        return mine + weight * other / other_n

    lang = {c: add(F.col(f"l_{c}"), F.col("w_").getField(c), F.col("w_").getField(n)) for c in names}
    return joined.select(*GROUP, *(add(F.col(c), lang[c], lang[n]).alias(c) for c in names))


def _vectors(rows: DataFrame) -> DataFrame:
    """Passing documents with their coordinates z1..z4."""
    counts = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    pooled = rows.groupBy(*GROUP).agg(
        F.sum("n_words").alias("_n"), *(F.sum(c).alias(f"_{c}") for c in counts)
    )
    pooled = _with_borrowed(checkpoint(pooled), "_n", [f"_{c}" for c in counts], BORROWED * PRIOR)
    joined = _meet(rows, pooled)

    def rate(c):
        return (F.col(c) + PRIOR * F.col(f"_{c}") / F.col("_n")) / (F.col("n_words") + PRIOR)

    made = (F.log(rate(counts[0])), F.log1p(100 * rate(counts[1])), F.log1p(100 * rate(counts[2])), rate(counts[3]))
    return joined.select(
        "_id", *GROUP, *(F.round(SCALE * x).cast("long").alias(f"z{i + 1}") for i, x in enumerate(made))
    )


Z = [f"z{i + 1}" for i in range(DIM)]


def _start(vectors: DataFrame) -> DataFrame:
    """Means and spreads of the coordinates of each group from medians and quartiles."""
    bins = vectors.select(
        *GROUP, F.posexplode(F.array(*(F.floor(F.col(z) / BIN) for z in Z))).alias("dim", "bin")
    ).groupBy(*GROUP, "dim", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*GROUP, "dim")
    bins = bins.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))

    def quantile(q):
        return F.min(F.when(F.col("below") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN / SCALE))

    spread = bins.groupBy(*GROUP, "dim").agg(
        quantile(0.5).alias("m"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("s")
    )
    first = []
    for i in range(DIM):
        at = F.col("dim") == i
        first.append(F.max(F.when(at, F.col("m"))).alias(f"m{i + 1}"))
        for j in range(i + 1):
            value = F.greatest("s", F.lit(FLOOR[i])) if i == j else F.lit(0.0)
            first.append(F.max(F.when(at, value)).alias(f"l{i + 1}{j + 1}"))
    return spread.groupBy(*GROUP).agg(*first)


def _moments(vectors: DataFrame) -> DataFrame:
    """Count, sums and sums of products of the coordinates of each group."""
    whole = [F.col(z).cast("decimal(19,0)") for z in Z]
    sums = [F.sum(z).alias(f"s{i + 1}") for i, z in enumerate(whole)]
    sums += [F.sum((whole[i] * whole[j]).cast("decimal(28,0)")).alias(f"q{i + 1}{j + 1}") for i in range(DIM) for j in range(i + 1)]
    return vectors.groupBy(*GROUP).agg(F.count("*").alias("n"), *sums)


def _distances(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """``d2``: squared Mahalanobis distance by forward substitution, and its bin."""
    rows = _meet(vectors, estimates)
    for i in range(1, DIM + 1):
        y = F.col(f"z{i}") / SCALE - F.col(f"m{i}")
        for j in range(1, i):
            y = y - F.col(f"l{i}{j}") * F.col(f"_y{j}")
        rows = rows.withColumn(f"_y{i}", y / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(2, DIM + 1)), F.col("_y1") * F.col("_y1"))
    rows = rows.select("_id", *GROUP, *Z, F.round(total, 9).alias("d2"))
    return rows.withColumn("bin", F.floor(F.log1p("d2") * LOG_BINS))


def _quantile_bin(distances: DataFrame, q: float, name: str) -> DataFrame:
    """The bin by which a share q of each group is reached."""
    bins = distances.groupBy(*GROUP, "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*GROUP)
    bins = bins.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return bins.groupBy(*GROUP).agg(F.min(F.when(F.col("below") >= q * F.col("all"), F.col("bin"))).alias(name))


def _cholesky(moments: DataFrame) -> DataFrame:
    """Mean, lower triangle of the covariance, its diagonal raised to the floor, and ``det``,
    the logarithm of the determinant."""
    names = [f"s{i}" for i in range(1, DIM + 1)] + [f"q{i}{j}" for i in range(1, DIM + 1) for j in range(1, i + 1)]
    moments = _with_borrowed(moments, "n", names, BORROWED)
    n = F.col("n").cast("double")
    rows = moments.select(
        *GROUP, "n", *((F.col(f"s{i}").cast("double") / n / SCALE).alias(f"m{i}") for i in range(1, DIM + 1)),
        *(F.col(f"q{i}{j}").cast("double").alias(f"q{i}{j}") for i in range(1, DIM + 1) for j in range(1, i + 1)),
    )
    for i in range(1, DIM + 1):
        for j in range(1, i + 1):
            cov = F.col(f"q{i}{j}") / n / SCALE / SCALE - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                # The subset is the inner part; its spread is raised by the floor's square.
                cov = F.greatest(cov, F.lit(0.0)) + FLOOR[i - 1] ** 2
            for k in range(1, j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(cov, F.lit(FLOOR[i - 1] ** 2 / 100))) if i == j else cov / F.col(f"l{j}{j}")
            rows = rows.withColumn(f"l{i}{j}", value)
    names = [f"m{i}" for i in range(1, DIM + 1)] + [f"l{i}{j}" for i in range(1, DIM + 1) for j in range(1, i + 1)]
    det = sum((F.log(f"l{i}{i}") for i in range(2, DIM + 1)), F.log("l11"))
    return rows.select(*GROUP, *names, F.round(2 * det, 9).alias("det"))


def _concentrate(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step."""
    distances = _distances(vectors, estimates)
    inner = _meet(distances, _quantile_bin(distances, SUBSET, "last")).where(F.col("bin") <= F.col("last"))
    return _cholesky(checkpoint(_moments(inner)))


def _least_determinant(found: list[DataFrame]) -> DataFrame:
    """Of all estimates of a group that of least determinant, the first found of equals."""
    names = [c for c in found[0].columns if c not in (*GROUP, "det")]
    every = found[0].withColumn("turn", F.lit(0))
    for turn, estimates in enumerate(found[1:], 1):
        every = every.unionByName(estimates.withColumn("turn", F.lit(turn)))
    best = every.groupBy(*GROUP).agg(F.min(F.struct("det", "turn", *names)).alias("best"))
    return best.select(*GROUP, *(F.col(f"best.{c}") for c in names))


def _raises(distances: DataFrame) -> DataFrame:
    """By what distances are divided, as the inner part is less spread than the whole: their
    median against that of the distribution; small groups borrow it as they do moments."""
    bins = checkpoint(distances.groupBy(*GROUP, "bin").agg(F.count("*").alias("n")))

    def of(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        rows = rows.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        # One row per bin of a key, of which there are no more than bins of a histogram.
        by = Window.partitionBy(*keys)
        rows = rows.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
        middle = F.min(F.when(F.col("below") >= 0.5 * F.col("all"), F.col("bin")))
        made = rows.groupBy(*keys).agg(middle.alias("m"), F.max("all").alias(f"n_{name}"))
        return made.select(*keys, f"n_{name}", F.greatest(F.expm1((F.col("m") + 1) / LOG_BINS) / MEDIAN, F.lit(1.0)).alias(name))

    groups, langs = of(bins, GROUP, "own"), of(bins, GROUP[:1], "lang")
    every = of(bins.withColumn("_every", F.lit(0)), ["_every"], "every").select("every").scalar()
    lang = (F.col("n_lang") * F.col("lang") + BORROWED * every) / (F.col("n_lang") + BORROWED)
    own = (F.col("n_own") * F.col("own") + BORROWED * lang) / (F.col("n_own") + BORROWED)
    return groups.join(langs, GROUP[0]).select(*GROUP, own.alias("raise"))


def quality(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents with their statistics, ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is null where the base rules decide alone. Columns of these names are
    replaced; the others stay, whatever they are called.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    # The caller's columns go by place, so that none clashes with a name used here.
    keep = [f"_caller{i}" for i in range(len(names))]
    groups = {g: F.coalesce(F.col(g[1:]).cast("string"), F.lit("")) for g in GROUP}
    docs = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, keep)), "text", *(c.alias(g) for g, c in groups.items()))
    # Rows are numbered once, in a written table, so that verdicts find them again.
    rows = statistics(docs, [*keep, *GROUP]).withColumn("base_failed", base_failed())
    rows = checkpoint(rows.withColumn("_id", F.monotonically_increasing_id()))
    vectors = checkpoint(_vectors(rows.where(~F.col("base_failed"))))
    found = []
    for start in (_start(vectors), _cholesky(checkpoint(_moments(vectors)))):
        estimates = checkpoint(start)
        for _ in range(STEPS):
            estimates = checkpoint(_concentrate(vectors, estimates))
            found.append(estimates)
    distances = checkpoint(_distances(vectors, checkpoint(_least_determinant(found))))
    raised = checkpoint(_raises(distances))
    verdicts = _meet(distances, raised).select("_id", (F.col("d2") / F.col("raise")).alias("_d2"))
    joined = rows.join(verdicts, "_id", "left")
    return joined.select(
        *(F.col(k).alias(c) for k, c in zip(keep, names)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.sqrt("_d2").alias("distance"),
        (~F.col("base_failed") & (F.col("_d2").isNull() | (F.col("_d2") <= CUTOFF))).alias("kept"),
    )
