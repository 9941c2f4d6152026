"""Pairs of copies are listed by the query and by the vector report."""

from tests.test_vectors import clustered, cosines, frame
from textloom.plans import flows
from textloom.queries import table


def embeddings(spark, points, folder):
    rows = [(i, None if p is None else [float(x) for x in p], 0) for i, p in enumerate(points)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def test_the_query_lists_the_pairs_of_copies(spark, tmp_path):
    embeddings(spark, [[1, 0], [1, 0], [1, 1], [1, 0], [0, 0], None], tmp_path)
    found = {(r.doc1, r.doc2): round(r.cosine, 6) for r in table.cosine_pairs(spark, str(tmp_path)).collect()}
    same = {(a, b): 1.0 for a in (0, 1, 3) for b in (0, 1, 3) if a != b}
    near = {p: 0.707107 for a in (0, 1, 3) for p in ((a, 2), (2, a))}
    assert found == same | near


def test_the_vector_report_lists_the_pairs_of_copies(spark):
    points = clustered(5)[:60]
    words = spark.createDataFrame([], "doc_id long, total long, terms array<struct<word:string,n:long>>")
    tables = flows.vector_tables(frame(spark, points), words, k=2, n_init=2, threshold=0.9, max_k=2)
    sims = cosines(points)
    expected = {(i, j) for i in range(60) for j in range(60) if i != j and sims[i, j] >= 0.9}
    assert {(r.doc1, r.doc2) for r in tables["similarity_pairs"].collect()} == expected
