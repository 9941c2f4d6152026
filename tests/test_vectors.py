"""Similarity operators against brute force, with copies, zero vectors and small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import learned, terms, vectors


def frame(spark, points, ids=None):
    ids = list(range(len(points))) if ids is None else ids
    kind = "string" if isinstance(ids[0], str) else "long"
    rows = [(i, [float(x) for x in p]) for i, p in zip(ids, points)]
    return spark.createDataFrame(rows, f"doc_id {kind}, vec array<double>").repartition(4)


def cosines(points):
    points = np.array(points, float)
    length = np.sqrt((points**2).sum(1, keepdims=True))
    units = np.divide(points, length, out=np.zeros_like(points), where=length > 0)
    return np.round(units @ units.T, 6)


def brute_top(points, ids, n):
    sims, rows = cosines(points), []
    for i, source in enumerate(ids):
        others = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if j != i)
        rows += [(source, doc, round(float(-score), 6), r + 1) for r, (score, doc) in enumerate(others[:n])]
    return sorted(rows)


def clustered(seed=0):
    """Tight groups, a third of all rows copies of one vector, and two zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 5
    points = np.vstack([c + rng.normal(size=(12, 8)) * 0.3 for c in centres])
    copies = np.tile(points[5], (38, 1))
    zeros = np.zeros((2, 8))
    points = np.vstack([points, copies, zeros])
    return points[rng.permutation(len(points))]


@pytest.fixture(params=[8192, 7])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", request.param)


@pytest.mark.parametrize("n", [1, 5])
def test_top_similar_is_exact(spark, block_rows, n):
    points = clustered()
    found = vectors.top_similar(frame(spark, points), n).collect()
    rounded = [(a, b, round(c, 6), r) for a, b, c, r in map(tuple, found)]
    assert sorted(rounded) == brute_top(points, list(range(len(points))), n)


def test_top_similar_with_text_keys_and_few_documents(spark):
    points, ids = [[1, 0], [0.9, 0.1], [0, 1]], ["b.txt", "a.txt", "c.txt"]
    found = vectors.top_similar(frame(spark, points, ids), 5)
    assert sorted(map(tuple, found.collect())) == brute_top(points, ids, 5)
    assert found.count() == 6
    nearest = {r.source_document: r.most_similar for r in vectors.most_similar(found).collect()}
    assert nearest == {"a.txt": "b.txt", "b.txt": "a.txt", "c.txt": "a.txt"}
    assert vectors.top_similar(frame(spark, points[:1], ids[:1]), 5).count() == 0


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.7, 0.999])
def test_cosine_pairs_are_complete(spark, block_rows, threshold):
    points = clustered(1)
    sims = cosines(points)
    n = len(points)
    expected = {(i, j): sims[i, j] for i in range(n) for j in range(n) if i != j and sims[i, j] >= threshold}
    found = vectors.cosine_pairs(frame(spark, points), threshold, expand_copies=True).collect()
    assert len(found) == len(expected)
    assert {(r.doc1, r.doc2): r.cosine for r in found} == pytest.approx(expected)


def test_pairs_of_copies_are_listed_once(spark):
    points = [[1, 0], [1, 0], [1, 1], [1, 0]]
    pairs = vectors.cosine_pairs(frame(spark, points), 0.5)
    assert {(r.doc1, r.doc2) for r in pairs.collect()} == {(0, 2), (2, 0)}
    reps = {r.doc_id: r.rep for r in vectors.copy_groups(frame(spark, points)).collect()}
    assert reps == {0: 0, 1: 0, 2: 2, 3: 0}


def test_a_join_sends_few_targets_when_vectors_are_clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 8)) * 5
    points = np.vstack([c + rng.normal(size=(40, 8)) * 0.01 for c in centres])
    df = vectors._padded(vectors._units(frame(spark, points)).withColumnRenamed("doc_id", "id"))
    seen = spark.sparkContext.accumulator(0)

    def kernel(q_ids, q, t_ids, t):
        import pandas as pd

        seen.add(len(q_ids) * len(t_ids))
        return pd.DataFrame({"q": q_ids[:0]})

    vectors._blocked(df, df, kernel, "q long", within=0.1).collect()
    assert 0 < seen.value < 400 * 400 / 2


def test_similarity_stats(spark):
    points = [[1, 0, 0], [1, 0.1, 0], [-1, 0.2, 0], [0, 0, 1], [0, 1, 1]]
    row = vectors.similarity_stats(frame(spark, points)).first()
    sims = cosines(points)
    upper = sims[np.triu_indices(5, 1)]
    assert (row.documents, row.dimensions) == (5, 3)
    assert row.mean_similarity == pytest.approx(upper.mean(), abs=1e-4)
    assert (row.most_similar_doc1, row.most_similar_doc2, row.most_similarity) == (0, 1, upper.max())
    assert (row.least_similar_doc1, row.least_similar_doc2, row.least_similarity) == (0, 2, upper.min())


def test_similarity_matrix(spark):
    points = [[1, 0], [1, 1], [0, 1]]
    long = vectors.similarity_long(frame(spark, points), 0.5)
    assert long.where("doc1 = doc2").count() == 3 and long.count() == 7
    wide = {r.doc_id: r for r in vectors.similarity_wide(frame(spark, points), [2, 0]).collect()}
    assert wide[1].sim_0 == pytest.approx(0.707107) and wide[1].sim_2 == pytest.approx(0.707107)
    with pytest.raises(ValueError):
        vectors.similarity_wide(frame(spark, points), [9])


def test_hashed_vectors_have_length_one_and_ignore_partitioning(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")

    def embedded(parts):
        scored = terms.bag_tf_idf(terms.term_bags(docs.repartition(parts)))
        return {r.doc_id: r.vec for r in vectors.embed_hashed(scored, 32).collect()}

    one = embedded(1)
    assert one == embedded(7)
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in one.values())


def test_word_vectors_are_saved_and_repeatable(spark, tmp_path):
    text = " ".join(["alfa beta gamma", "delta epsilon zeta"] * 40)
    docs = spark.createDataFrame([(1, text), (2, "alfa beta"), (3, "")], "doc_id long, text string")
    from textloom.operators.chunks import word_chunks

    settings = dict(dim=8, iterations=2, window=3, partitions=1)
    trained = learned.train_word_vectors(word_chunks(docs), **settings)
    vecs = {r.doc_id: r.vec for r in learned.doc_vectors_w2v(docs, trained).collect()}
    assert set(vecs) == {1, 2, 3} and len(vecs[1]) == 8 and vecs[3] == [0.0] * 8
    again = learned.train_word_vectors(word_chunks(docs), **settings)
    assert {r.doc_id: r.vec for r in learned.doc_vectors_w2v(docs, again).collect()} == vecs
    learned.save_word_vectors(trained, str(tmp_path / "model"))
    loaded = learned.load_word_vectors(spark, str(tmp_path / "model"))
    assert {r.doc_id: r.vec for r in learned.doc_vectors_w2v(docs, loaded).collect()} == vecs
    hashed = learned.train_word_vectors(word_chunks(docs), buckets=4, **settings)
    assert hashed.buckets == 4 and hashed.model.getVectors().count() <= 4


def test_layout_spreads_most_along_x(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(50, 4)) * np.array([1, 9, 3, 1]) + 5
    rows = {r.doc_id: (r.x, r.y) for r in learned.layout_2d(frame(spark, points)).collect()}
    xy = np.array([rows[i] for i in range(50)])
    centred = points - points.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    for column, axis in ((0, axes[:, -1]), (1, axes[:, -2])):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        assert np.allclose(xy[:, column], centred @ axis, atol=1e-6)
    assert xy[:, 0].var() > xy[:, 1].var()


def test_empty_input(spark):
    empty = spark.createDataFrame([], "doc_id long, vec array<double>")
    assert vectors.top_similar(empty, 3).count() == 0
    assert vectors.cosine_pairs(empty, 0.5).count() == 0


def test_ties_of_near_copies_are_ranked_by_id(spark):
    angles = {8: 0.0, 1: 0.0011, 0: 0.0012, 14: 0.0013, **{20 + i: 0.3 + i / 10 for i in range(16)}}
    points = [[float(np.cos(a)), float(np.sin(a))] for a in angles.values()]
    vecs = spark.createDataFrame(list(zip(angles, points)), "doc_id long, vec array<double>")
    top = {r.source_document: r.similar_document for r in vectors.top_similar(vecs, 1).collect()}
    assert top[8] == 0


def test_stats_of_copies_only(spark):
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "doc_id long, vec array<double>")
    row = vectors.similarity_stats(vecs).first()
    assert (row.most_similarity, row.least_similarity) == (1.0, 1.0)
    assert (row.least_similar_doc1, row.least_similar_doc2) == (1, 2)


def test_vectors_that_are_not_finite_are_refused(spark):
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 2.0])], "doc_id long, vec array<double>")
    with pytest.raises(Exception, match="not finite"):
        vectors.top_similar(vecs, 1).collect()
