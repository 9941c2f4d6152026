"""Three flows: term report, vector report, clustered summaries.

Each returns its result tables by name, ready for ``write_bundle``. What several tables
share is written to the checkpoint folder once; the tables themselves are lazy.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from textloom.functions import text as T
from textloom.operators import chunks, cluster, learned, summary, terms, vectors
from textloom.sources.tables import checkpoint, write_bundle


def term_report(corpus: DataFrame, stops: DataFrame | None = None) -> dict[str, DataFrame]:
    """Words and bigrams: TF-IDF, top terms, frequencies, statistics and a word cloud."""
    words = checkpoint(terms.term_bags(corpus, stops))
    bigrams = checkpoint(terms.term_bags(corpus, stops, bigrams=True))
    word_scores = terms.bag_tf_idf(words)
    bigram_scores = terms.bag_tf_idf(bigrams, "bigram")
    counts, bigram_counts = terms.bag_counts(words), terms.bag_counts(bigrams)

    def frequency(name: str) -> DataFrame:
        return terms.overall_frequency(counts, name=name).orderBy(F.desc(name), "word")

    bigram_frequency = terms.overall_frequency(bigram_counts, "bigram", "total_frequency")
    totals = terms.overall_frequency(counts)
    statistics = terms.corpus_stats(terms.bag_doc_stats(words), totals, bigram_counts)
    short = ["doc_id", "word", "n", "tf_idf"]
    # Names and columns of the tables.
    return {
        "TF_IDF_Full": terms.tfidf_export(word_scores),
        "Top_Words_Per_Doc": terms.tfidf_export(terms.top_terms(word_scores, 10), columns=short),
        "Top_Bigrams_Per_Doc": terms.tfidf_export(
            terms.top_terms(bigram_scores, 8), "bigram", ["doc_id", "bigram", "n", "tf_idf"]
        ),
        "Overall_Word_Frequency": frequency("total_freq"),
        "Overall_Bigram_Frequency": bigram_frequency.orderBy(F.desc("total_frequency"), "bigram"),
        "Document_Statistics": terms.bag_doc_stats(words).orderBy(F.desc("total_words"), "doc_id"),
        "Bigram_Analysis_Full": terms.tfidf_export(bigram_scores, "bigram"),
        "Word_Frequency_Distribution": frequency("total_count"),
        "Corpus_Statistics": statistics,
        "Word_Cloud": terms.cloud_weights(totals),
    }


def vector_tables(
    vecs: DataFrame,
    words: DataFrame,
    k: int = 4,
    neighbours: int = 5,
    n_init: int = 25,
    threshold: float = 0.2,
    max_k: int = cluster.MAX_K,
) -> dict[str, DataFrame]:
    """What the vector report tells of any vectors ``(doc_id, vec)`` and their word bags.

    Pairs are listed from a cosine of ``threshold``, those of copies included; the matrix is whole, in tiles.
    """
    vecs = checkpoint(vecs.select("doc_id", "vec"))
    similar = checkpoint(vectors.top_similar(vecs, neighbours))
    fit = cluster.kmeans(vecs, k, n_init)
    members = checkpoint(cluster.membership(fit, vecs))
    keywords = checkpoint(cluster.cluster_keywords(words, members, terms.bag_idf(words)))
    statistics = vectors.similarity_stats(vecs).withColumn("clusters", F.lit(k))
    return {
        "document_vectors": vecs,
        "similarity_pairs": vectors.cosine_pairs(vecs, threshold, expand_copies=True),
        "similarity_matrix": vectors.similarity_tiles(vecs),
        "similar_documents": similar,
        "most_similar": vectors.most_similar(similar),
        "elbow": cluster.elbow(vecs, range(1, max_k + 1), n_init),
        "cluster_membership": members,
        "cluster_sizes": cluster.cluster_sizes(members),
        "cluster_representatives": cluster.cluster_reps(members),
        "cluster_keywords": keywords,
        "cluster_clouds": cluster.cluster_cloud(keywords),
        "layout": learned.layout_2d(vecs).join(members, "doc_id"),
        "summary_statistics": statistics,
    }


def vector_report(
    corpus: DataFrame,
    stops: DataFrame | None = None,
    k: int = 4,
    neighbours: int = 5,
    n_init: int = 25,
    threshold: float = 0.2,
    max_k: int = cluster.MAX_K,
    **training,
) -> dict[str, DataFrame]:
    """Learned document vectors: neighbours, clusters, keywords and statistics.

    ``training`` goes to ``train_word_vectors``.
    """
    trained = learned.train_word_vectors(chunks.word_chunks(corpus), **training)
    return _vector_report(corpus, stops, trained, k, neighbours, n_init, threshold, max_k)


def _vector_report(corpus, stops, trained, *options) -> dict[str, DataFrame]:
    words = checkpoint(terms.term_bags(corpus, stops))
    return vector_tables(learned.doc_vectors_w2v(corpus, trained), words, *options)


def write_vector_report(
    corpus: DataFrame,
    root: str,
    run_id: str,
    stops: DataFrame | None = None,
    k: int = 4,
    neighbours: int = 5,
    n_init: int = 25,
    threshold: float = 0.2,
    max_k: int = cluster.MAX_K,
    fmt: str = "parquet",
    **training,
) -> dict[str, str]:
    """``vector_report`` as a bundle, with the trained model as ``word_vectors``: the paths.

    The model is read back by ``learned.load_word_vectors``.
    """
    trained = learned.train_word_vectors(chunks.word_chunks(corpus), **training)
    tables = _vector_report(corpus, stops, trained, k, neighbours, n_init, threshold, max_k)
    save = functools.partial(learned.save_word_vectors, trained)
    return write_bundle(tables, root, run_id, fmt, models={"word_vectors": save})


def embed_texts(texts: DataFrame, stops: DataFrame | None = None, dim: int = 384) -> DataFrame:
    """Hashed TF-IDF vectors of short texts; a text without counted words gets zeros."""
    bags = terms.term_bags(texts, stops).persist()
    vecs = vectors.embed_hashed(terms.bag_tf_idf(bags), dim)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return texts.select("doc_id").join(vecs, "doc_id", "left").select(
        "doc_id", F.coalesce("vec", zeros).alias("vec")
    )


def summary_clusters(
    corpus: DataFrame,
    stops: DataFrame | None = None,
    method: str = "kmeans",
    k: int | None = None,
    dim: int = 384,
    max_k: int = cluster.MAX_K,
    n_init: int = 10,
    micro: int | None = None,
    max_tokens: int = T.WINDOW_TOKENS,
    overlap: int = T.WINDOW_OVERLAP,
) -> dict[str, DataFrame]:
    """Summaries, their vectors, and clusters of these by ``kmeans`` or ``ward``.

    k-means chooses ``k`` by silhouette when it is not given; Ward needs it, and shows
    the candidates in ``cut_candidates``. ``micro`` makes Ward start from at most
    that many clustering features, for a corpus too large for every pair of documents.
    """
    if method not in ("kmeans", "ward"):
        raise ValueError(f"unknown method {method!r}: use 'kmeans' or 'ward'")
    if method == "ward" and k is None:
        raise ValueError("Ward clustering needs k: see cluster.cut_candidates")
    words = checkpoint(terms.term_bags(corpus, stops))
    idf = checkpoint(terms.bag_idf(words))
    short = summary.summarize_long(corpus, idf, max_tokens, overlap)
    summaries = checkpoint(summary.summary_or_extract(corpus, short))
    texts = summaries.withColumnRenamed("summary", "text")
    vecs = checkpoint(embed_texts(texts, stops, dim))
    tables = {"summaries": summaries, "vectors": vecs}
    if method == "kmeans":
        if k is None:
            tables["k_choice"] = cluster.choose_k(vecs, max_k, n_init)
            k = tables["k_choice"].where("chosen").first().k
        members = checkpoint(cluster.membership(cluster.kmeans(vecs, k, n_init), vecs))
    elif micro is None:
        tables["merge_tree"] = checkpoint(cluster.ward_linkage(vecs))
        members = checkpoint(cluster.cut_k(tables["merge_tree"], k))
    else:
        centres, parts = cluster.micro_clusters(vecs, micro)
        tables["merge_tree"] = checkpoint(cluster.ward_linkage(centres, sizes="size"))
        cut = cluster.cut_k(tables["merge_tree"], k).withColumnRenamed("doc_id", "micro")
        members = checkpoint(parts.join(cut, "micro").select("doc_id", "cluster"))
    if method == "ward":
        tables["cut_candidates"] = cluster.cut_candidates(tables["merge_tree"])
    tables["cluster_membership"] = members
    tables["cluster_sizes"] = cluster.cluster_sizes(members)
    tables["summaries_with_clusters"] = summaries.join(members, "doc_id")
    return tables
