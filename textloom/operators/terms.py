"""Word and bigram counts, TF-IDF, rankings and corpus statistics.

A corpus is a table ``(doc_id, text)`` with one row per document. Counting is done
inside the row (``term_bags``), so a corpus of any size is counted without a shuffle
and a very long document cannot unbalance one. What is shuffled is already counted:
one row per distinct word of a document, and less where a partial aggregate applies.

Scores are ranked on ``n * idf`` rounded to nine decimals. Within a document that is
the order of ``tf * idf``, and it makes scores that are equal in exact arithmetic tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textloom.functions import text as T
from textloom.functions.arrays import count_runs, let

# Words removed in addition to a language's stop words.
CUSTOM_STOP_WORDS = (
    "delle", "della", "del", "dei", "degli", "una", "loro", "sono",
    "alla", "alle", "allo", "agli", "questo", "questa", "questi",
    "queste", "quello", "quella", "quelli", "quelle", "come", "con",
    "per", "tra", "fra", "sul", "sulla", "sui", "sugli", "sulle",
    "nella", "nelle", "negli", "siano", "essere", "aver", "avere",
    "dell'", "_esgcon", "i.e.", "www.issgovernance.com", "mediolanum",
    "saipem", "bper", "terna", "enel", "pirelli", "hera", "generali", "tim",
    "campari", "italgas", "prysmian", "intesa", "sanpaolo", "unicredit",
    "eni", "nexi", "fineco", "interpump", "finecobank", "unipolsai",
    "amplifon", "bpm", "montepaschi", "unipol", "inwit",
    "moncler", "camparisti", "tenaris", "diasorin", "iveco", "leonardo",
    "mediobanca", "pagg", "which", "bancobpm", "sondrio", "nexigroup",
    "unicreditgroup", "stmicroelectronics", "Paschi", "telecom", "azimut",
    "siena", "erg", "pump", "pry", "gruppotim",
)

# A stop list up to this size is tested inside the row; a longer one is joined.
MAX_INLINE_STOP_WORDS = 20_000
RANK_DIGITS = 9
# Rows of a table that a task may hold as a hash table in a join, on average.
MAX_HASHED_ROWS = 5_000_000


# --- stop words ---------------------------------------------------------------


def stop_words(
    spark: SparkSession,
    language: str | None = "italian",
    custom: Sequence[str] | DataFrame | None = CUSTOM_STOP_WORDS,
) -> DataFrame:
    """Stop words of a language united with a custom list or table.

    ``lexicon`` names where a word comes from; a custom table without that column
    gets null.
    """
    table = spark.createDataFrame([], "word string, lexicon string")
    if language is not None:
        from pyspark.ml.feature import StopWordsRemover

        listed = [(w, language) for w in StopWordsRemover.loadDefaultStopWords(language)]
        table = table.unionByName(spark.createDataFrame(listed, table.schema))
    if isinstance(custom, DataFrame):
        table = table.unionByName(custom, allowMissingColumns=True)
    elif custom:
        listed = [(w, "custom") for w in custom]
        table = table.unionByName(spark.createDataFrame(listed, table.schema))
    return table


def _short_list(stops: DataFrame) -> list[str] | None:
    """The distinct stop words, or None when there are too many to hold in a plan."""
    distinct = stops.select("word").where("word is not null").distinct()
    rows = distinct.limit(MAX_INLINE_STOP_WORDS + 1).collect()
    return None if len(rows) > MAX_INLINE_STOP_WORDS else [r.word for r in rows]


def remove_stop_words(tokens: DataFrame, stops: DataFrame, column: str = "word") -> DataFrame:
    """Rows whose word is not a stop word (exact, case-sensitive match)."""
    listed = stops.select(F.col("word").alias(column)).where(F.col(column).isNotNull()).distinct()
    if _short_list(stops) is not None:
        listed = F.broadcast(listed)
    return tokens.join(listed, column, "left_anti").select(*tokens.columns)


# --- tokens -------------------------------------------------------------------


def rows_of(df: DataFrame, items: Column, position: str, item: str) -> DataFrame:
    """One row ``(doc_id, position, item)`` per array element.

    The outer generator is used on purpose: for the inner one the optimizer adds a
    filter on the array's size below it, and the array would be computed twice.
    """
    exploded = df.select("doc_id", F.posexplode_outer(items).alias(position, item))
    return exploded.where(F.col(position).isNotNull())


def tokens(corpus: DataFrame) -> DataFrame:
    """One row per word: ``(doc_id, pos, word)``, ``pos`` counting from 0."""
    return rows_of(corpus, T.words(F.col("text")), "pos", "word")


def ngrams(corpus: DataFrame, n: int = 2) -> DataFrame:
    """One row per run of ``n`` neighbouring words: ``(doc_id, pos, ngram)``."""
    grams = let(T.words(F.col("text")), lambda toks: T.word_ngrams(toks, n))
    return rows_of(corpus, grams, "pos", "ngram")


# --- counts -------------------------------------------------------------------


def term_bags(corpus: DataFrame, stops: DataFrame | None = None, bigrams: bool = False) -> DataFrame:
    """Counted terms of each document: ``(doc_id, total, terms)``.

    ``terms`` is ``array<struct<word, n>>`` (``bigram`` instead of ``word`` with
    ``bigrams=True``) and ``total`` the sum of its counts. Needs one row per document.
    Without a shuffle where the stop words fit in a plan; a longer table is joined to the
    distinct words of each document, which gives the same bags.
    """
    listed = [] if stops is None else _short_list(stops)
    if listed is None:
        return _without_stop_words(term_bags(corpus, bigrams=bigrams), stops, bigrams)

    def keep(word: Column) -> Column:
        return T.token_ok(word) & ~word.isin(listed) if listed else T.token_ok(word)

    toks = T.words(F.col("text"))
    if bigrams:
        bag = count_runs(let(toks, lambda t: T.kept_bigrams(t, keep)), "bigram")
    else:
        # Counting first, so that the predicates see each distinct word once.
        bag = F.filter(count_runs(toks, "word"), lambda t: keep(t["word"]))
    counted = let(bag, lambda terms: F.struct(total_of(terms).alias("total"), terms.alias("terms")))
    return corpus.select("doc_id", counted.alias("bag")).select("doc_id", "bag.total", "bag.terms")


def _without_stop_words(bags: DataFrame, stops: DataFrame, bigrams: bool) -> DataFrame:
    """Bags without a table of stop words of any length; a document may be left with none.

    A word that most documents share is one key of the join: adaptive execution splits its
    partition, as it does for the idf join.
    """
    term = "bigram" if bigrams else "word"
    listed = stops.select("word").where("word is not null").distinct()
    rows = bags.select("doc_id", F.inline_outer("terms"))
    stopped = F.lit(False)
    for i, part in enumerate([F.split(term, " ")[0], F.split(term, " ")[1]] if bigrams else [F.col(term)]):
        side = listed.select(F.col("word").alias(f"stop{i}"))
        rows = rows.withColumn(f"part{i}", part).join(side, F.col(f"part{i}") == F.col(f"stop{i}"), "left")
        stopped = stopped | F.col(f"stop{i}").isNotNull()
    # Only a document's own distinct terms are gathered; empty documents have a row with no term.
    kept = F.collect_list(F.when(F.col("n").isNotNull() & ~stopped, F.struct(term, "n")))
    gathered = rows.groupBy("doc_id").agg(F.sort_array(kept).alias("terms"))
    return gathered.select("doc_id", total_of(F.col("terms")).alias("total"), "terms")


def total_of(terms: Column) -> Column:
    """Sum of the counts of a bag."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc + t["n"])


def bag_counts(bags: DataFrame) -> DataFrame:
    """Bags as rows ``(doc_id, total, word or bigram, n)``."""
    return bags.select("doc_id", "total", F.inline_outer("terms")).where("n is not null")


def term_counts(
    corpus: DataFrame, stops: DataFrame | None = None, repeated_keys: bool = False
) -> DataFrame:
    """Word counts per document: ``(doc_id, word, n)``.

    Set ``repeated_keys`` when a ``doc_id`` may occur on several rows; their counts are
    then added up, after each row has been counted.
    """
    if stops is None or _short_list(stops) is not None:
        counts = bag_counts(term_bags(corpus, stops)).drop("total")
    else:
        counts = remove_stop_words(bag_counts(term_bags(corpus)).drop("total"), stops)
    return _merged(counts, "word") if repeated_keys else counts


def bigram_counts(
    corpus: DataFrame, stops: DataFrame | None = None, repeated_keys: bool = False
) -> DataFrame:
    """Counts of bigrams of two kept words per document: ``(doc_id, bigram, n)``."""
    if stops is None or _short_list(stops) is not None:
        counts = bag_counts(term_bags(corpus, stops, bigrams=True)).drop("total")
    else:
        first, second = F.split("bigram", " ")[0], F.split("bigram", " ")[1]
        parts = bag_counts(term_bags(corpus, bigrams=True)).drop("total")
        parts = parts.withColumn("word1", first).withColumn("word2", second)
        parts = remove_stop_words(remove_stop_words(parts, stops, "word1"), stops, "word2")
        counts = parts.select("doc_id", F.concat_ws(" ", "word1", "word2").alias("bigram"), "n")
    return _merged(counts, "bigram") if repeated_keys else counts


def _merged(counts: DataFrame, term: str) -> DataFrame:
    return counts.groupBy("doc_id", term).agg(F.sum("n").alias("n"))


# --- TF-IDF -------------------------------------------------------------------


def idf_table(counts: DataFrame, term: str = "word", n_docs: Column | None = None) -> DataFrame:
    """``(term, doc_freq, idf)`` with ``idf = ln(N / doc_freq)``, unsmoothed.

    ``N`` is the number of documents that still have a term. Pass it as ``n_docs`` when
    it is at hand (see ``bag_idf``); otherwise it is counted.
    """
    if n_docs is None:
        n_docs = counts.select("doc_id").distinct().agg(F.count("*")).scalar()
    freq = counts.groupBy(term).agg(F.count("*").alias("doc_freq"))
    return freq.withColumn("idf", F.log(n_docs / F.col("doc_freq")))


def bag_idf(bags: DataFrame, term: str = "word") -> DataFrame:
    """``idf_table`` from bags: the number of documents costs no distinct count."""
    n_docs = bags.agg(F.count(F.when(F.size("terms") > 0, 1))).scalar()
    return idf_table(bag_counts(bags), term, n_docs)


def passing_idf(bags: DataFrame, term: str = "word") -> DataFrame:
    """``bag_idf`` in one pass over the bags, which then need not be kept; the vocabulary is persisted.

    A document with terms counts under a null term, too.
    """
    named = F.concat(F.array(F.lit(None).cast("string")), F.transform("terms", lambda t: t[term]))
    # The outer generator, see ``rows_of``.
    rows = bags.select(F.explode_outer(F.when(F.size("terms") > 0, named)).alias(term), (F.size("terms") > 0).alias("any"))
    freq = rows.where("any").groupBy(term).agg(F.count("*").alias("doc_freq")).persist()
    n_docs = freq.where(F.col(term).isNull()).select("doc_freq").scalar()
    return freq.where(F.col(term).isNotNull()).withColumn("idf", F.log(n_docs / F.col("doc_freq")))


def hashed(table: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, one per key, as the hashed side of a join by shuffle.

    The other side, which is many times as long, is then not sorted. Where a task's share
    would be large, the join is left to sorting, which spills.
    """
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.hint("shuffle_hash") if rows <= tasks * MAX_HASHED_ROWS else table


def tf_idf(counts: DataFrame, term: str = "word") -> DataFrame:
    """TF-IDF of every counted term: ``(doc_id, term, n, tf, idf, tf_idf)``.

    ``tf`` divides by the document's sum over the terms given. Joins leave it to
    adaptive execution to broadcast a small vocabulary by its measured size, and to
    split the partition of a word that most documents share.
    """
    totals = counts.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return _score(counts.join(totals, "doc_id"), idf_table(counts, term), term)


def bag_tf_idf(bags: DataFrame, term: str = "word") -> DataFrame:
    """``tf_idf`` from bags: totals are known, so only the idf join shuffles.

    The bags are read three times, once of them for their size; cache or write them first.
    """
    rows = bags.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    return _score(bag_counts(bags), hashed(bag_idf(bags, term), rows), term)


def _score(counts: DataFrame, idf: DataFrame, term: str) -> DataFrame:
    tf = F.col("n") / F.col("total")
    return counts.join(idf.select(term, "idf"), term).select(
        "doc_id", term, "n", tf.alias("tf"), "idf", (tf * F.col("idf")).alias("tf_idf")
    )


def rank_score() -> Column:
    """What terms of one document are ranked by."""
    return F.round(F.col("n") * F.col("idf"), RANK_DIGITS)


def top_terms(scored: DataFrame, n: int = 10) -> DataFrame:
    """Terms ranked 1 to ``n`` in their document, ties included.

    Ranks are limited before the shuffle, so a document sends on few of its terms.
    """
    by_doc = Window.partitionBy("doc_id").orderBy(rank_score().desc())
    ranked = scored.withColumn("rank", F.rank().over(by_doc)).where(F.col("rank") <= n)
    return ranked.drop("rank")


def tfidf_export(scored: DataFrame, term: str = "word", columns: Sequence[str] | None = None) -> DataFrame:
    """All or chosen columns, ordered by document and falling score.

    Documents are dealt by ranges and sorted there; what ``n``, ``tf`` and ``idf`` give is not
    shuffled but worked out again.
    """
    columns = columns or ["doc_id", term, "n", "tf", "idf", "tf_idf"]
    dealt = scored.drop("tf_idf").repartitionByRange("doc_id")
    # A column of its own: a sort works out its expressions again for every comparison.
    ranked = dealt.withColumns({"tf_idf": F.col("tf") * F.col("idf"), "_rank_score": rank_score()})
    return ranked.sortWithinPartitions("doc_id", F.desc("_rank_score"), term).select(*columns)


# --- frequencies and statistics -----------------------------------------------


def overall_frequency(counts: DataFrame, term: str = "word", name: str = "total_freq") -> DataFrame:
    """Occurrences of each term over all documents."""
    return counts.groupBy(term).agg(F.sum("n").alias(name))


def top_overall(freq: DataFrame, n: int = 20, name: str = "total_freq") -> DataFrame:
    """The ``n`` most frequent terms, and all that tie with the last of them."""
    nth = freq.select(name).orderBy(F.desc(name)).limit(n).agg(F.min(name))
    return freq.where(F.col(name) >= nth.scalar())


def head_overall(
    freq: DataFrame, n: int = 10, term: str = "word", name: str = "total_freq"
) -> DataFrame:
    """Exactly ``n`` most frequent terms, ties cut in term order."""
    return freq.orderBy(F.desc(name), term).limit(n)


def cloud_weights(
    freq: DataFrame, n: int = 100, term: str = "word", name: str = "total_freq"
) -> DataFrame:
    """Terms and weights of a word cloud: ``(word, frequency)``."""
    return head_overall(freq, n, term, name).select(term, F.col(name).alias("frequency"))


def doc_stats(counts: DataFrame, term: str = "word") -> DataFrame:
    """Total and distinct words per document that has any."""
    return counts.groupBy("doc_id").agg(
        F.sum("n").alias("total_words"), F.count(term).alias("unique_words")
    )


def bag_doc_stats(bags: DataFrame) -> DataFrame:
    """``doc_stats`` from bags, without a shuffle."""
    size = F.size("terms").cast("long")
    return bags.where(size > 0).select(
        "doc_id", F.col("total").alias("total_words"), size.alias("unique_words")
    )


def corpus_stats(stats: DataFrame, freq: DataFrame, bigrams: DataFrame) -> DataFrame:
    """One row about the corpus, from ``doc_stats``, ``overall_frequency`` and bigram counts.

    ``bigrams`` counts distinct bigrams per document.
    """
    top = freq.orderBy(F.desc("total_freq"), "word").limit(1)
    top = top.select(F.struct("word", "total_freq"))
    distinct_words = freq.agg(F.count("*")).scalar()
    bigram_rows = bigrams.agg(F.count("*")).scalar()
    row = stats.agg(F.count("*").alias("documents"), F.sum("total_words").alias("occurrences"))
    return row.select(
        "documents",
        distinct_words.alias("distinct_words"),
        "occurrences",
        bigram_rows.alias("bigrams"),
        top.scalar().alias("top"),
    ).select(
        "documents",
        "distinct_words",
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        "bigrams",
        F.col("top.word").alias("most_frequent_word"),
        F.col("top.total_freq").alias("most_frequent_count"),
    )
