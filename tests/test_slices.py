"""Summaries in slices are those of all texts at once, and the idf of one pass that of two."""

import numpy as np
import pytest

from textloom.operators import summary, terms


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("alfa", "beta", "gamma", "delta", "omega") for b in ("x", "y", "z")]

    def text(n):
        return " ".join(" ".join(rng.choice(words, 9)) + "." for _ in range(n))

    rows = [(i, text(4 if i % 3 else 90)) for i in range(24)]
    rows += [(90, None), (91, ""), (92, "12 34"), (None, text(3))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()


def test_idf_of_one_pass(spark, docs):
    bags = terms.term_bags(docs).persist()
    rows = {tuple(r) for r in terms.passing_idf(bags).collect()}
    assert rows == {tuple(r) for r in terms.bag_idf(bags).collect()} and len(rows) == 15
    assert terms.passing_idf(bags.where("doc_id > 90")).count() == 0


@pytest.mark.parametrize("make", [summary.summarize, lambda d, i: summary.summarize_long(d, i, 200, 20)])
def test_slices_give_the_same_summaries(spark, docs, monkeypatch, make):
    idf = terms.passing_idf(terms.term_bags(docs)).persist()
    whole = {tuple(r) for r in make(docs, idf).collect()}
    written, write = [], summary.checkpoint
    monkeypatch.setattr(summary, "checkpoint", lambda df: written.append(1) or write(df))
    monkeypatch.setattr(summary, "SLICE_CHARS", 12_000)
    found = make(docs, idf)
    assert len(written) > 2
    assert {tuple(r) for r in found.collect()} == whole and found.count() == len(docs.collect())
