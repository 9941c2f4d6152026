"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs: language ID, near duplicates, benchmark decontamination,
secret scans, byte-level BPE. All but the last return the columns of ``documents``.

A row without text has no language and goes in the first stage. Stages keep rows apart by
their contents, so repeated rows, null ids and ties are handled as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textloom.llm import bytebpe, decontaminate, jaccard, langid, secrets
from textloom.sources.tables import checkpoint_folder

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, (80, 100)
#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5


#: Rows that Spark hands to Python at once, and Python to Spark: rows here hold whole texts and their token ids.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bound the session's batches; a lower bound that it has stays.

    A batch is held whole by the executor and by each of its Python workers, a few times
    over. Spark's own bound of 10,000 rows makes it 100 MB and more with texts of 5 kB.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


#: Columns that the operators read; the caller's others are kept aside from their results.
READ = ("doc_id", "text", "lang")


def _aside(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others of the caller in one struct.

    Nothing is carried twice: a text is by far the largest of a row's values.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
    return docs.select(*(c for c in READ if c in docs.columns), *([F.struct(*others).alias("_caller")] if others else []))


def _own(name: str) -> Column:
    """A column of the caller after ``_aside``."""
    return F.col(name) if name in READ else F.col("_caller").getField(name)


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(_own(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; learned from the rows that have one."""
    _small_batches(spark)
    model = langid.train_fold(docs)
    if not model.langs:
        return docs
    found = langid.predict(_aside(docs), model)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return _back(found.where(sure), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id."""
    _small_batches(spark)
    named = jaccard.jaccard_components(docs, SHINGLE, *SIMILARITY)
    # Texts without words link with nothing, so each is a group of its own.
    alone = F.when(F.col("n_shingles") == 0, F.col("k"))
    first = Window.partitionBy("component_id", alone).orderBy(F.col("doc_id").asc_nulls_last(), "k")
    kept = named.withColumn("place", F.row_number().over(first)).where("place = 1").select("k")
    rows = docs.select(jaccard.row_key().alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_caller"))
    rows = rows.join(kept.distinct(), "k", "left_semi")
    # Rows of one id and text are one document; the least of the other columns stays.
    own = F.col("_caller").getField("doc_id")
    first = rows.groupBy("k", own.alias("own")).agg(F.min("_caller").alias("_caller"))
    return first.select(*(F.col("_caller").getField(c).alias(c) for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(_aside(docs), benchmark)
    return _back(found.where(F.size("hits") == 0), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; ``n_chars`` follows the text."""
    _small_batches(spark)
    found = secrets.scan_secrets(_aside(docs), redact=True)
    changed = F.size("secrets") > 0
    new = {"text": F.when(F.col("text").isNotNull(), F.col("redacted"))}
    if "n_chars" in docs.columns:
        length = F.length("redacted").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(_own("n_chars"))
    return found.select(*(new.get(c, _own(c)).alias(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, little-endian; ``round_trip`` tells that they decode to it."""
    import public_tokenizers

    _small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.decode(bytebpe.encode(docs, path), path)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", without_secrets),
    ("byte-level BPE", token_ids),
]

#: Language ID and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4()}"
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
