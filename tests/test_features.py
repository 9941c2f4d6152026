"""Coresets, many starts, and clustering features against whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cluster, features
from textloom.queries.table import vectors_of
from tests.test_cluster import frame, planted, same_partition


def cost_of(points, centres):
    return ((points[:, None, :] - centres[None]) ** 2).sum(2).min(1).sum()


def test_coreset_costs_what_the_table_costs(spark):
    points, _ = planted(groups=4, each=700, dim=6)
    vecs = frame(spark, points).persist()
    some, weights = cluster.coreset(vecs, 500)
    assert len(some) == len(weights) == 500 and weights.sum() == pytest.approx(len(points), rel=0.1)
    again, _ = cluster.coreset(vecs.repartition(7), 500)
    assert np.allclose(some, again)
    random = np.random.default_rng(2)
    for _ in range(5):
        centres = points[random.choice(len(points), 5, replace=False)]
        squared = ((some[:, None, :] - centres[None]) ** 2).sum(2).min(1)
        assert (squared * weights).sum() == pytest.approx(cost_of(points, centres), rel=0.15)
    whole, ones = cluster.coreset(vecs, 5000)
    assert len(whole) == len(points) and (ones == 1).all()


def test_starts_on_a_coreset_are_finished_on_all_rows(spark, monkeypatch):
    points, labels = planted(groups=5, each=200, dim=6)
    monkeypatch.setattr(cluster, "CORESET", 150)
    vecs = frame(spark, points).persist()
    fit = cluster.kmeans(vecs, 5, n_init=8)
    assert fit.cost == pytest.approx(cost_of(points, fit.centres))
    means = np.array([points[labels == g].mean(0) for g in range(5)])
    assert fit.cost == pytest.approx(cost_of(points, means), rel=1e-3)


def test_more_starts_never_cost_more(spark):
    vecs = vectors_of(spark, "/root/testdata/sf0.01").persist()
    costs = [cluster.kmeans(vecs, 6, n_init=n).cost for n in (1, 5, 25)]
    assert costs == sorted(costs, reverse=True)


def test_kmeans_with_few_points_and_copies(spark):
    points = [[0.0, 0.0]] * 5 + [[1.0, 0.0]]
    fit = cluster.kmeans(frame(spark, points), 3, n_init=2)
    assert fit.cost == pytest.approx(0.0) and len(fit.centres) == 3
    with pytest.raises(ValueError):
        cluster.kmeans(frame(spark, points), 3, n_init=0)


def test_summaries_add_up_and_stay_few():
    random = np.random.default_rng(1)
    points = np.concatenate([random.normal(size=(3000, 5)), np.zeros((500, 5))])
    made = features.Summaries(64)
    for at in range(0, len(points), 700):
        x = points[at : at + 700]
        made.add(list(range(at, at + len(x))), np.ones(len(x)), x, (x**2).sum(1))
        assert len(made.n) <= 64
    assert made.n.sum() == len(points)
    assert np.allclose(made.sums.sum(0), points.sum(0)) and made.squares.sum() == pytest.approx((points**2).sum())
    assert len(set(made.names)) == len(made.names) and min(made.names) == 0


def test_summaries_of_many_partitions(spark):
    points, _ = planted(groups=4, each=150, dim=4)
    vecs = frame(spark, points).repartition(20, "doc_id")
    rows = features.summaries(vecs.unionByName(spark.createDataFrame([(9999, None)], vecs.schema)), 40).collect()
    assert len(rows) <= 40 and sum(r["size"] for r in rows) == len(points)
    assert np.allclose(np.sum([r.sums for r in rows], axis=0), points.sum(0))
    # Groups far apart are never merged into one summary.
    centres = np.array([np.array(r.sums) / r["size"] for r in rows])
    means = points.reshape(4, 150, 4).mean(1)
    assert np.sqrt(((centres[:, None] - means[None]) ** 2).sum(2).min(1)).max() < 8
    assert features.summaries(vecs.limit(0)).count() == 0


def test_cut_over_features_is_near_the_exact_one(spark):
    vecs = vectors_of(spark, "/root/testdata/sf0.01").drop("label").persist()
    points = {r.doc_id: np.array(r.vec) for r in vecs.collect()}

    def within(cut):
        groups = {}
        for r in cut:
            groups.setdefault(r.cluster, []).append(points[r.doc_id])
        return sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups.values())

    exact = within(cluster.cut_k(cluster.ward_linkage(vecs).persist(), 4).collect())
    centres, parts = cluster.micro_clusters(vecs, 200)
    cut = cluster.cut_k(cluster.ward_linkage(centres, sizes="size").persist(), 4).withColumnRenamed("doc_id", "micro")
    assert within(parts.join(cut, "micro").collect()) <= 1.1 * exact
