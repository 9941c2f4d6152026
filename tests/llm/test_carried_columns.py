"""The pipeline hands a row's text to an operator once."""

import corpus_pipeline


def test_a_text_is_carried_once(spark):
    schema = "doc_id long, text string, lang string, source string, score double, n_chars long"
    docs = spark.createDataFrame([(1, "one two", "en", "web", 0.5, 7), (None, None, None, None, None, None)], schema)
    aside = corpus_pipeline._aside(docs)
    assert aside.schema["_caller"].dataType.names == ["source", "score", "n_chars"]
    back = corpus_pipeline._back(aside.withColumn("score", aside.doc_id), docs)
    assert back.schema == docs.schema and sorted(back.collect(), key=str) == sorted(docs.collect(), key=str)
    plain = docs.select("doc_id", "text")
    assert corpus_pipeline._back(corpus_pipeline._aside(plain), plain).collect() == plain.collect()
