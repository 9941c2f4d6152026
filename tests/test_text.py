"""Text functions and term operators on literal rows the given tables do not contain."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.arrays import let
from textloom.operators import chunks, terms
from textloom.sources.corpus import normalize_lines


def corpus(spark, *texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")


def value(spark, text, expression):
    return corpus(spark, text).select(expression(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("l'acqua pura", ["l'acqua", "pura"]),
        ("l’acqua", ["l’acqua"]),
        ("Costs 3,5 or 1.000; see co2.", ["costs", "3,5", "or", "1.000", "see", "co2"]),
        ("report.2023 and 2023.report", ["report", "2023", "and", "2023", "report"]),
        ("www.example.com, i.e. snake_case __x", ["www.example.com", "i.e", "snake_case", "__x"]),
        ("end.\r\nStart -- (ok)!", ["end", "start", "ok"]),
        ("Sostenibilità È", ["sostenibilità", "è"]),
        ("", []),
        (None, []),
        ("... !!!", []),
    ],
)
def test_words(spark, text, expected):
    assert value(spark, text, T.words) == expected


def test_a_long_odd_token_does_not_overflow_the_stack(spark):
    blob = "a1b2.c3" * 50_000
    assert len(value(spark, blob, T.words)) > 0
    assert value(spark, "a." * 100_000 + "a", T.words) == ["a." * 100_000 + "a"]
    assert len(value(spark, "a.b? " * 20_000, T.sentences)) == 20_000


def test_token_filter(spark):
    kept = terms.term_counts(corpus(spark, "ab abc co2 2023 l'acqua l’acqua"))
    assert sorted(r.word for r in kept.collect()) == ["abc", "l’acqua"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Sostenibilità 2023!", "sostenibilit"),
        ("CO2  emissions: 12 t, 3x", "co2 emissions t 3x"),
        ("snake_case\r\n\tTab", "snake case tab"),
        ("àè", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, text, expected):
    assert value(spark, text, T.clean_text) == expected


def test_line_modes(spark):
    df = corpus(spark, "one\r\ntwo\rthree\n\nfour\r\n")
    assert normalize_lines(df).first().text == "one\ntwo\nthree\n\nfour\n"
    assert normalize_lines(df, "space").first().text == "one two three  four"
    with pytest.raises(ValueError):
        normalize_lines(df, "other")


def test_doc_key(spark):
    assert value(spark, "/a/b/My report.v2.txt", T.doc_key) == "My report.v2.txt"
    assert value(spark, "My report.v2.TXT", lambda c: T.doc_key(c, True)) == "My report.v2"


def test_middle_extract(spark):
    text = "\n\n".join(f"p{i}" for i in range(10))
    assert value(spark, text, T.middle_extract) == "\n\n".join(f"p{i}" for i in range(2, 8))
    assert value(spark, "only one", T.middle_extract) == "only one"
    assert value(spark, "x" * 3000, T.middle_extract) == "x" * 1000
    assert len(value(spark, "a\n\n" + "b" * 4000 + "\n\nc", T.middle_extract)) == 1500
    assert value(spark, "a|b|c|d|e", lambda c: T.middle_extract(c, "|")) == "b|c|d"


def test_midpoint_extract(spark):
    short = "".join(chr(97 + i % 26) for i in range(2000))
    assert value(spark, short, T.midpoint_extract) == short[:500] + "..."
    long = short + "z"
    assert value(spark, long, T.midpoint_extract) == long[1000:2000] + "..."


def test_ngrams_cross_lines_and_need_enough_words(spark):
    found = terms.ngrams(corpus(spark, "a b\nc", "parola", ""), 2).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.ngram) for r in found] == [(0, 0, "a b"), (0, 1, "b c")]
    assert [r.ngram for r in terms.ngrams(corpus(spark, "a b c"), 3).collect()] == ["a b c"]


def test_no_bigram_over_a_dropped_word(spark):
    stops = terms.stop_words(spark, None, ["il"])
    df = corpus(spark, "alfa il beta gamma. beta gamma 12 delta")
    found = {r.bigram: r.n for r in terms.bigram_counts(df, stops).collect()}
    assert found == {"beta gamma": 2, "gamma beta": 1}


def test_word_chunks(spark):
    df = corpus(spark, " ".join(["w"] * 250), "", None, "12 34")
    rows = chunks.word_chunks(df).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx, len(r.chunk.split())) for r in rows] == [(0, 0, 100), (0, 1, 100), (0, 2, 50)]
    stats = chunks.chunk_stats(chunks.word_chunks(df)).first()
    assert (stats.documents, stats.chunks, stats.mean_chunks) == (1, 3, 3.0)


@pytest.mark.parametrize("tokens, windows", [(16_000, 1), (16_001, 2), (31_700, 3), (31_600, 2)])
def test_overlap_windows(spark, tokens, windows):
    text = " ".join(str(i) for i in range(tokens))
    rows = chunks.overlap_chunks(corpus(spark, text)).orderBy("chunk_idx").collect()
    assert len(rows) == windows
    if windows == 1:
        assert rows[0].chunk == text
    else:
        assert rows[1].chunk.split()[0] == "15800"
        assert rows[0].chunk.split()[-1] == "15999"


def test_overlap_options(spark):
    text = " ".join(str(i) for i in range(19))
    whole = [r.chunk for r in chunks.overlap_chunks(corpus(spark, text), 10, 4).collect()]
    assert [w.split()[0] for w in whole] == ["0", "6", "12", "18"]
    dropped = chunks.overlap_chunks(corpus(spark, text), 10, 4, drop_contained_tail=True).collect()
    assert [r.chunk for r in dropped] == whole[:3]
    kept = chunks.overlap_chunks(corpus(spark, "  odd   spacing "), 10, 4).first().chunk
    assert kept == "  odd   spacing "
    with pytest.raises(ValueError):
        chunks.overlap_chunks(corpus(spark, text), 10, 10)


def test_stop_words(spark):
    italian = terms.stop_words(spark).collect()
    assert {r.lexicon for r in italian} == {"italian", "custom"}
    words = {r.word for r in italian if r.lexicon == "custom"}
    assert "moncler" in words and "custom" not in words
    assert sum(r.lexicon == "italian" for r in italian) == 279
    table = spark.createDataFrame([("uno",)], "word string")
    assert [tuple(r) for r in terms.stop_words(spark, None, table).collect()] == [("uno", None)]


def test_long_stop_lists_are_joined(spark, monkeypatch):
    df = corpus(spark, "alfa il beta gamma", "il delta alfa beta")
    df = df.union(corpus(spark, "delta delta", "", "gamma delta gamma alfa zeta alfa zeta alfa zeta", None, ids=[2, 3, 4, 5]))
    stops = terms.stop_words(spark, None, ["il", "delta", "delta", None])

    def found():
        counts = [sorted(map(tuple, f(df, stops).collect())) for f in (terms.term_counts, terms.bigram_counts)]
        bags = [{r.doc_id: r for r in terms.term_bags(df, stops, bigrams=b).collect()} for b in (False, True)]
        return counts, bags

    short = found()
    assert short[1][0][2].terms == [] and len(short[1][0]) == 6
    monkeypatch.setattr(terms, "MAX_INLINE_STOP_WORDS", 1)
    assert found() == short


def test_repeated_keys_are_added_up(spark):
    df = corpus(spark, "alfa alfa beta", "alfa", ids=[7, 7])
    found = {r.word: r.n for r in terms.term_counts(df, repeated_keys=True).collect()}
    assert found == {"alfa": 3, "beta": 1}


def test_tf_idf_both_ways(spark):
    df = corpus(spark, "alfa alfa beta", "alfa gamma", "12 !!", "")
    by_counts = {(r.doc_id, r.word): r for r in terms.tf_idf(terms.term_counts(df)).collect()}
    by_bags = {(r.doc_id, r.word): r for r in terms.bag_tf_idf(terms.term_bags(df)).collect()}
    assert by_counts == by_bags
    assert by_counts[0, "alfa"].tf_idf == 0.0
    assert by_counts[0, "beta"].tf == pytest.approx(1 / 3)
    # Two documents still have a term.
    assert by_counts[0, "beta"].idf == pytest.approx(math.log(2))


def test_more_documents_leave_tf_alone(spark):
    few = corpus(spark, "alfa beta beta")
    more = corpus(spark, "alfa beta beta", "beta delta")
    tf = [
        {r.word: r.tf for r in terms.bag_tf_idf(terms.term_bags(c)).where("doc_id = 0").collect()}
        for c in (few, more)
    ]
    assert tf[0] == tf[1]


def test_ties_share_a_rank(spark):
    twelve = " ".join(f"word{c}" for c in "abcdefghijkl")
    scored = terms.bag_tf_idf(terms.term_bags(corpus(spark, twelve, "other text")))
    assert terms.top_terms(scored, 10).where("doc_id = 0").count() == 12
    freq = terms.overall_frequency(terms.term_counts(corpus(spark, twelve)))
    assert terms.top_overall(freq, 5).count() == 12
    assert [r.word for r in terms.head_overall(freq, 2).collect()] == ["worda", "wordb"]
    assert terms.top_overall(freq, 50).count() == 12


def test_partitioning_does_not_change_results(spark, tiny):
    from textloom.queries import table

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")

    def top(parts):
        bags = terms.term_bags(docs.repartition(parts), table.stops(spark))
        return {tuple(r) for r in terms.top_terms(terms.bag_tf_idf(bags), 10).collect()}

    assert top(1) == top(16)


def test_corpus_stats_of_nothing(spark):
    df = corpus(spark, "")
    bags = terms.term_bags(df)
    row = terms.corpus_stats(
        terms.bag_doc_stats(bags), terms.overall_frequency(terms.bag_counts(bags)), terms.bigram_counts(df)
    ).first()
    assert (row.documents, row.distinct_words, row.occurrences, row.bigrams) == (0, 0, 0, 0)
    assert row.most_frequent_word is None


def test_let_evaluates_once(spark):
    df = spark.range(1).select(let(F.rand(), lambda x: x - x).alias("zero"))
    assert df.first().zero == 0.0
