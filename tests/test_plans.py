"""Plans: what is read, and what is shuffled."""

import pytest

from textloom.operators import terms
from textloom.queries import table


@pytest.fixture
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counting_does_not_shuffle(spark, docs):
    for bigrams in (False, True):
        text = plan(terms.bag_counts(terms.term_bags(docs, table.stops(spark), bigrams)))
        assert "Exchange" not in text and "Join" not in text
    assert "Exchange" not in plan(terms.bag_doc_stats(terms.term_bags(docs)))


def test_only_used_columns_are_read(docs):
    text = plan(terms.term_bags(docs))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_ranks_are_limited_before_the_shuffle(docs):
    text = plan(terms.top_terms(terms.bag_tf_idf(terms.term_bags(docs)), 10))
    final, partial = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert "Exchange" in text[final:partial]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_frequencies_are_aggregated_before_the_shuffle(docs):
    text = plan(terms.overall_frequency(terms.bag_counts(terms.term_bags(docs))))
    assert "partial_sum" in text
