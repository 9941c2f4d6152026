"""What counting and scoring terms costs per row: joins, sorts, sums and the word pattern."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.arrays import millionths
from textloom.operators import terms


@pytest.fixture
def bags(spark):
    texts = [(i, " ".join(["alpha"] * (i % 3) + [f"word{chr(97 + i % 7)}", "gamma", "gamma"])) for i in range(40)]
    return terms.term_bags(spark.createDataFrame([*texts, (40, None), (None, "beta gamma"), (3, "beta")], "doc_id long, text string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_hash_the_idf_and_sort_nothing(bags, monkeypatch):
    scored = terms.bag_tf_idf(bags)
    assert "ShuffledHashJoin" in plan(scored) and "SortMergeJoin" not in plan(scored)
    monkeypatch.setattr(terms, "MAX_HASHED_ROWS", 0)  # a share too large for a task is sorted
    by_sorting = terms.bag_tf_idf(bags)
    assert "ShuffledHashJoin" not in plan(by_sorting)
    assert sorted(map(str, scored.collect())) == sorted(map(str, by_sorting.collect()))


def test_an_export_works_out_its_order_once_per_row(bags):
    export = terms.tfidf_export(terms.bag_tf_idf(bags))
    sorts = [line for line in plan(export).splitlines() if re.search(r"\bSort \[", line)]
    assert sorts and not any("round(" in line for line in sorts)
    found = [(r.doc_id is not None, r.doc_id or 0, -round(r.n * r.idf, 9), r.word) for r in export.collect()]
    assert found == sorted(found)



def test_millionths_are_the_decimals(spark):
    values = [(x,) for x in (0.0, 0.5e-6, 1.5e-6, 2.0000005, -2.0000005, 1e9 / 3, 0.1 + 0.2, 1234567.8901235, None)]
    rows = spark.createDataFrame(values, "x double").select(
        millionths(F.col("x")).alias("m"), F.round("x", 6).cast("decimal(28,6)").alias("d")
    )
    for r in rows.collect():
        assert (r.m is None) if r.d is None else r.m == r.d.scaleb(6)


def test_words_are_those_of_the_possessive_pattern(spark):
    possessive = (
        r"(?:[\p{L}\p{M}]++(?:[.'‘’·][\p{L}\p{M}]++)*+"
        r"|\p{Nd}++(?:[.,;'‘’]\p{Nd}++)*+"
        r"|_++)++"
    )
    shapes = "a{0}b {0}{0} 1{0}2 x.{0} {0}'y _{0}_ 3,{0} {0};4 é{0}’z"
    codes = [*range(0x20, 0x3100, 7), *range(0x3100, 0x110000, 1009)]
    texts = [(shapes.format(chr(c)),) for c in codes if not 0xD800 <= c < 0xE000] + [("ab'c1_" * 50_000 + ".",)]
    rows = spark.createDataFrame(texts, "text string")
    old = F.regexp_extract_all(F.lower("text"), F.lit(possessive), F.lit(0))
    assert rows.where(~F.equal_null(old, T.words(F.col("text")))).isEmpty()
    assert "++" not in T.WORD_PATTERN[:-2]  # classes loop without it
