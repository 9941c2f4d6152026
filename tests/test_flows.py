"""Sources, sinks, summaries and the end-to-end flows."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import learned, summary, terms
from textloom.plans import flows
from textloom.queries import table
from textloom.sources.corpus import read_checked, read_corpus
from textloom.sources.tables import checkpoint, numbered, read_bundle, write_bundle, write_table


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "One report.txt").write_bytes("Riga uno\r\n\r\nriga due è\r\n".encode())
    (tmp_path / "50%+è.txt").write_text("tre", encoding="utf-8")
    (tmp_path / "due.v2.TXT").write_text("testo", encoding="utf-8")
    (tmp_path / "notes.md").write_text("not a text file")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("not read")
    return tmp_path


def test_read_corpus(spark, folder):
    rows = {r.doc_id: r.text for r in read_corpus(spark, str(folder)).collect()}
    assert rows == {"One report.txt": "Riga uno\n\nriga due è\n", "due.v2.TXT": "testo", "50%+è.txt": "tre"}
    spaced = read_corpus(spark, str(folder), strip_ext=True, line_mode="space")
    expected = {"One report": "Riga uno  riga due è", "due.v2": "testo", "50%+è": "tre"}
    assert {r.doc_id: r.text for r in spaced.collect()} == expected
    assert read_corpus(spark, str(folder), ignore_case=False).count() == 2
    (folder / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(folder / "none"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_corpus(spark, str(folder / "missing"))


def test_read_checked_lists_rejects(spark, folder):
    (folder / "bad.txt").write_bytes(b"caf\xe9")
    (folder / "cut.txt").write_bytes("è".encode()[:1])
    (folder / "empty.txt").write_bytes(b"")
    (folder / "long.txt").write_bytes(b"x" * 500)
    corpus, rejects = read_checked(spark, str(folder), max_bytes=400)
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert texts == {r.doc_id: r.text for r in read_corpus(spark, str(folder)).collect() if r.doc_id in texts}
    assert sorted(texts) == ["50%+è.txt", "One report.txt", "due.v2.TXT"]  # nor the empty one
    found = {r.doc_id: (r.reason, r.length) for r in rejects.collect()}
    assert found == {"bad.txt": ("not UTF-8", 4), "cut.txt": ("not UTF-8", 1), "long.txt": ("too long", 500)}
    spaced, _ = read_checked(spark, str(folder), strip_ext=True, line_mode="space")
    assert "Riga uno  riga due è" in {r.text for r in spaced.collect()}


def test_read_checked_aborts_on_none(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_checked(spark, str(tmp_path))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(ValueError, match="can be read"):
        read_checked(spark, str(tmp_path))


def test_write_table_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", word'), (2, "line\nend")], "doc_id int, word string")
    write_table(df.coalesce(1), str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = back.csv(str(tmp_path / "csv"))
    assert rows.columns == ["doc_id", "word"]
    assert sorted(r.word for r in rows.collect()) == ['a "quoted", word', "line\nend"]
    with pytest.raises(ValueError):
        write_table(df.select(F.array("doc_id").alias("a")), str(tmp_path / "bad"), "csv")
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "bad"), "xlsx")
    paths = write_bundle({"Words": df}, str(tmp_path / "out"), "20250101_120000")
    assert spark.read.parquet(paths["Words"]).count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).select("run_id").distinct().count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_bundle({"Words": df}, str(tmp_path / "out"), "20250101_120000")


def test_numbered_and_checkpoint(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(9)
    rows = numbered(df.orderBy("x"), "at").collect()
    assert sorted((r.x, r["at"]) for r in rows) == [(i, i + 1) for i in range(1000)]
    assert numbered(df.where("x < 0").orderBy("x"), "at").count() == 0
    assert checkpoint(df).count() == 1000


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_summary_takes_the_best_sentences_in_order(spark):
    df = corpus(spark, "Common words here. Rare jewel shines! Common words again.", "common words here again", "...")
    idf = terms.idf_table(terms.term_counts(df))
    found = {r.doc_id: r.summary for r in summary.summarize(df, idf, 3, 200).collect()}
    assert found == {0: "Rare jewel shines!", 1: "common words here again", 2: None}
    found = {r.doc_id: r.summary for r in summary.summarize(df, idf, 4, 5).collect()}
    assert found[0] == "Common words here. Rare jewel"
    with pytest.raises(ValueError):
        summary.summarize(df, idf, 5, 4)


def test_fallbacks(spark):
    df = corpus(spark, "One sentence.", "?!", "a\n\nb\n\nc\n\nd\n\ne")
    idf = terms.idf_table(terms.term_counts(df))
    found = summary.summary_or_extract(df, summary.summarize_long(df, idf))
    assert {r.doc_id: r.summary for r in found.collect()} == {0: "One sentence.", 1: "?!...", 2: "a b c d e"}
    found = {r.doc_id: r.summary for r in summary.summary_or_extract(df, None).collect()}
    assert found == {0: "One sentence.", 1: "?!", 2: "b\n\nc\n\nd"}


def test_long_documents_are_summarised_in_windows(spark):
    text = " ".join(f"Sentence number {chr(97 + i % 26) * 5} talks about topic {chr(97 + i % 7) * 4}." for i in range(400))
    df = corpus(spark, text, "Short text.")
    idf = terms.idf_table(terms.term_counts(df))
    found = {r.doc_id: r.summary for r in summary.summarize_long(df, idf, max_tokens=300, overlap=20).collect()}
    assert set(found) == {0, 1} and found[1] == "Short text."
    assert 80 <= len(found[0].split()) <= 200


def test_sentences(spark):
    text = "One, 3.5 percent of www.site.com. Two?! Three\nfour  five\r\n ... Six"
    found = corpus(spark, text).select(T.sentences(F.col("text")).alias("s")).first().s
    assert found == ["One, 3.5 percent of www.site.com.", "Two?!", "Three", "four five", "...", "Six"]


def test_term_report(spark, tiny, tmp_path):
    docs = table.corpus(spark, tiny)
    tables = flows.term_report(docs, table.stops(spark))
    assert list(tables) == [
        "TF_IDF_Full", "Top_Words_Per_Doc", "Top_Bigrams_Per_Doc", "Overall_Word_Frequency",
        "Overall_Bigram_Frequency", "Document_Statistics", "Bigram_Analysis_Full",
        "Word_Frequency_Distribution", "Corpus_Statistics", "Word_Cloud",
    ]
    paths = write_bundle(tables, str(tmp_path), "1")
    full = spark.read.parquet(paths["TF_IDF_Full"])
    assert full.columns == ["doc_id", "word", "n", "tf", "idf", "tf_idf"]
    assert full.count() == terms.term_counts(docs, table.stops(spark)).count()
    freq = [r.total_freq for r in tables["Overall_Word_Frequency"].collect()]
    assert freq == sorted(freq, reverse=True)
    stats = spark.read.parquet(paths["Document_Statistics"])
    assert stats.agg(F.sum("total_words")).first()[0] == sum(freq)


def test_vector_report(spark, tiny, tmp_path):
    docs = table.corpus(spark, tiny)
    options = dict(k=3, n_init=1, max_k=3, dim=8, iterations=1, window=3)
    paths = flows.write_vector_report(docs, str(tmp_path), "1", table.stops(spark), **options)
    tables = read_bundle(spark, str(tmp_path), "1")
    n = docs.count()
    # The saved model gives the vectors of the report.
    trained = learned.load_word_vectors(spark, paths["word_vectors"])
    again = {r.doc_id: r.vec for r in learned.doc_vectors_w2v(docs, trained).collect()}
    for r in tables["document_vectors"].collect():
        assert r.vec == pytest.approx(again[r.doc_id])
    costs = [r.wss for r in tables["elbow"].orderBy("k").collect()]
    assert len(costs) == 3 and costs[0] > costs[2]
    assert tables["similarity_matrix"].agg(F.sum(F.size("cosines"))).first()[0] == n * n
    assert tables["similarity_pairs"].where("cosine < 0.2 or doc1 = doc2").isEmpty()
    assert tables["cluster_clouds"].count() == tables["cluster_keywords"].count()
    assert tables["document_vectors"].count() == tables["cluster_membership"].count() == n
    assert tables["similar_documents"].count() == 5 * n
    assert tables["cluster_sizes"].agg(F.sum("documents")).first()[0] == n
    assert tables["layout"].count() == n
    assert tables["cluster_keywords"].groupBy("cluster").count().agg(F.max("count")).first()[0] == 15
    row = tables["summary_statistics"].first()
    assert (row.documents, row.dimensions, row.clusters) == (n, 8, 3)


@pytest.mark.parametrize("options", [dict(k=None, max_k=4), dict(method="ward", k=3, micro=20)])
def test_summary_clusters(spark, tiny, options):
    docs = table.corpus(spark, tiny)
    tables = flows.summary_clusters(docs, table.stops(spark), dim=16, n_init=1, **options)
    rows = tables["summaries_with_clusters"]
    assert rows.columns == ["doc_id", "summary", "cluster"]
    assert rows.count() == docs.count() == rows.where("summary is not null").count()
    if options["k"]:
        assert rows.select("cluster").distinct().count() == options["k"]
    with pytest.raises(ValueError):
        flows.summary_clusters(docs, method="ward")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_bundles_are_read_only_when_finished(spark, tmp_path, fmt):
    rows = [(1, "a,\"b\"\nc", 0.1), (2, None, None), (3, "é", -2.5)]
    whole = spark.createDataFrame(rows, "doc_id long, text string, x double")
    tables = {"whole": whole, "none": whole.limit(0)}

    def save(path):
        spark.range(3).write.parquet(path)

    paths = write_bundle(tables, str(tmp_path), "1", fmt, models={"model": save})
    found = read_bundle(spark, str(tmp_path), "1")
    assert list(found) == ["whole", "none"] and spark.read.parquet(paths["model"]).count() == 3
    assert sorted(map(tuple, found["whole"].collect())) == rows
    assert found["none"].count() == 0 and found["none"].schema == whole.schema

    def fails(path):
        raise OSError("disk full")

    with pytest.raises(OSError):
        write_bundle(tables, str(tmp_path), "2", fmt, models={"model": fails})
    with pytest.raises(ValueError, match="not a finished run"):
        read_bundle(spark, str(tmp_path), "2")
    whole.write.mode("append").format(fmt).save(paths["whole"])
    with pytest.raises(ValueError, match="manifest says 3"):
        read_bundle(spark, str(tmp_path), "1")
    with pytest.raises(ValueError, match="names"):
        write_bundle({"manifest": whole}, str(tmp_path), "3", fmt)
