"""What a bundle leaves on disk while it is written, and an export that is dealt by document."""

from pyspark.sql import functions as F

from textloom.operators import terms
from textloom.sources import tables


def test_a_table_of_a_bundle_is_written_without_keeping_its_shuffles(spark, tmp_path, monkeypatch):
    kept, write = [], tables.write_table

    def watched(df, *rest):
        kept.append(spark.conf.get(tables._CLEANUP))
        write(df, *rest)

    monkeypatch.setattr(tables, "write_table", watched)
    found = {"a": spark.range(9).groupBy("id").count(), "b": spark.range(3)}
    tables.write_bundle(found, str(tmp_path), "one")
    assert kept == ["true", "true"] and spark.conf.get(tables._CLEANUP, "false") == "false"
    assert {n: t.count() for n, t in tables.read_bundle(spark, str(tmp_path), "one").items()} == {"a": 9, "b": 3}
    assert [f.name for f in (tmp_path / "run_id=one/a").glob("*.zstd.parquet")]


def test_an_export_shuffles_no_score_and_keeps_its_order(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} other{i % 5} word{i % 3}") for i in range(90)], "doc_id long, text string")
    scored = terms.bag_tf_idf(terms.term_bags(docs.repartition(5)).persist())
    export = terms.tfidf_export(scored)
    rows = [tuple(r) for r in export.collect()]
    ranked = scored.withColumn("s", terms.rank_score()).orderBy("doc_id", F.desc("s"), "word").drop("s")
    assert rows == [tuple(r) for r in ranked.collect()]
    plan = export._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "_rank_score" in plan and "_rank_score" not in below and "tf_idf" not in below
