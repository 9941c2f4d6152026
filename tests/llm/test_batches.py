"""The pipeline bounds what Spark and Python hand each other at once, and what byte-level BPE works on."""

import corpus_pipeline
from textloom.llm import bytebpe

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_every_stage_bounds_batches(spark, tmp_path):
    before = spark.conf.get(BATCH)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, f"one two three {i}", "en", "web", 15) for i in range(20)], schema)
    items = spark.createDataFrame([(1, "none of these words")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(BATCH, 10_000)
            stage(spark, docs, str(tmp_path))
            assert int(spark.conf.get(BATCH)) == corpus_pipeline.BATCH_ROWS
        for given, kept in ((0, corpus_pipeline.BATCH_ROWS), (7, 7)):
            spark.conf.set(BATCH, given)
            corpus_pipeline._small_batches(spark)
            assert int(spark.conf.get(BATCH)) == kept
    finally:
        spark.conf.set(BATCH, before)


def test_byte_bpe_works_on_bounded_slices(monkeypatch):
    given = []
    monkeypatch.setattr(bytebpe, "map_texts", lambda *a, limit=1 << 20, **k: given.append(limit))

    class Docs:
        columns = ["text", "ids"]

        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda x: x)

    monkeypatch.setattr(bytebpe, "load_ranks", lambda path: {bytes([b]): b for b in range(256)})
    bytebpe.encode(Docs, "")
    bytebpe.decode(Docs, "")
    assert given == [bytebpe.SLICE] * 2 and bytebpe.SLICE <= 1 << 18
