"""A table is read in pieces that do not grow with it."""

from textloom.sources import tables


def test_pieces_follow_the_size_of_the_files(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    path = f"{tmp_path}/docs.parquet"
    rows = spark.range(5000).selectExpr("if(id % 7 = 0, null, id) as doc_id", "sha2(cast(id as string), 256) as text")
    rows.repartition(2).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "docs.parquet").glob("*.parquet"))
    assert tables.read_table(spark, path).rdd.getNumPartitions() == cores  # a small table: one piece per core

    monkeypatch.setattr(tables, "PIECE_BYTES", size // (5 * cores))
    found = tables.read_table(spark, path, "doc_id", "text")
    assert found.rdd.getNumPartitions() >= 5 * cores
    held = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert max(held) <= 2 * 5000 // (5 * cores)
    assert found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()


def test_one_file_and_no_rows(spark, tmp_path):
    spark.range(3).selectExpr("id as doc_id").coalesce(1).write.parquet(f"{tmp_path}/one")
    [part] = (tmp_path / "one").glob("*.parquet")
    assert tables.read_table(spark, str(part)).count() == 3
    spark.range(0).selectExpr("id as doc_id").write.parquet(f"{tmp_path}/none")
    assert tables.read_table(spark, f"{tmp_path}/none").count() == 0
