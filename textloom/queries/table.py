"""Queries by name."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as T
from textloom.functions.arrays import dot
from textloom.operators import chunks, cluster, features, hashing, indexing, learned, summary, terms, vectors
from textloom.plans import flows
from textloom.queries.settings import PAIR_THRESHOLD, SCORE_DIGITS, STOP_WORDS, WIDE_IDS
from textloom.sources.corpus import normalize_lines, read_checked as read_corpus_checked
from textloom.sources.tables import checkpoint, checkpoint_folder, numbered, read_bundle, read_table, write_bundle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def all_queries():
    return dict(QUERIES)


# --- inputs -------------------------------------------------------------------


def corpus(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def stops(spark):
    return terms.stop_words(spark, None, STOP_WORDS)


# Bags and idf are read more than once by what is built on them.
def word_bags(spark, sf_dir):
    return terms.term_bags(corpus(spark, sf_dir), stops(spark)).persist()


def bigram_bags(spark, sf_dir):
    return terms.term_bags(corpus(spark, sf_dir), stops(spark), bigrams=True).persist()


def word_counts(spark, sf_dir):
    return terms.bag_counts(word_bags(spark, sf_dir))


def bigram_counts_of(spark, sf_dir):
    return terms.bag_counts(bigram_bags(spark, sf_dir))


def rounded(df, digits=SCORE_DIGITS):
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# --- text ---------------------------------------------------------------------


@query
def tokens(spark, sf_dir):
    return terms.tokens(corpus(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query
def remove_stop_words(spark, sf_dir):
    kept = terms.remove_stop_words(terms.tokens(corpus(spark, sf_dir)), stops(spark))
    return kept.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


@query
def token_filter(spark, sf_dir):
    ok = terms.tokens(corpus(spark, sf_dir)).where(T.token_ok(F.col("word")))
    return ok.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


@query
def ngrams(spark, sf_dir):
    return terms.ngrams(corpus(spark, sf_dir), 2).withColumn("pos", F.col("pos").cast("long"))


@query
def normalize_lines_space(spark, sf_dir):
    return normalize_lines(corpus(spark, sf_dir), "space")


@query
def normalize_lines_newline(spark, sf_dir):
    pages = read_table(spark, f"{sf_dir}/pages.parquet", "page_id", "html")
    return normalize_lines(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query
def doc_key(spark, sf_dir):
    pages = read_table(spark, f"{sf_dir}/pages.parquet", "page_id", "url")
    return pages.select(
        "page_id",
        T.doc_key(F.col("url")).alias("name"),
        T.doc_key(F.col("url"), strip_ext=True).alias("stem"),
    )


@query
def clean_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query
def middle_extract(spark, sf_dir):
    extract = T.middle_extract(F.col("text"), sep="\n")
    return corpus(spark, sf_dir).select("doc_id", extract.alias("extract"))


@query
def midpoint_extract(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.midpoint_extract(F.col("text")).alias("extract"))


# --- terms --------------------------------------------------------------------


@query
def term_counts(spark, sf_dir):
    return terms.term_counts(corpus(spark, sf_dir), stops(spark))


@query
def tf_idf(spark, sf_dir):
    return rounded(terms.bag_tf_idf(word_bags(spark, sf_dir)))


@query
def top_terms(spark, sf_dir):
    scored = terms.bag_tf_idf(word_bags(spark, sf_dir))
    return rounded(terms.top_terms(scored, 10))


@query
def top_terms_15(spark, sf_dir):
    scored = terms.bag_tf_idf(word_bags(spark, sf_dir))
    return rounded(terms.top_terms(scored, 15))


@query
def tfidf_export(spark, sf_dir):
    scored = terms.bag_tf_idf(word_bags(spark, sf_dir))
    return rounded(terms.tfidf_export(scored, columns=["doc_id", "word", "n", "tf_idf"]))


@query
def bigram_counts(spark, sf_dir):
    return terms.bigram_counts(corpus(spark, sf_dir), stops(spark))


@query
def bigram_tf_idf(spark, sf_dir):
    return rounded(terms.bag_tf_idf(bigram_bags(spark, sf_dir), "bigram"))


@query
def top_bigrams(spark, sf_dir):
    scored = terms.bag_tf_idf(bigram_bags(spark, sf_dir), "bigram")
    return rounded(terms.top_terms(scored, 8))


@query
def top_bigrams_10(spark, sf_dir):
    scored = terms.bag_tf_idf(bigram_bags(spark, sf_dir), "bigram")
    return rounded(terms.top_terms(scored, 10))


@query
def overall_frequency(spark, sf_dir):
    return terms.overall_frequency(word_counts(spark, sf_dir))


@query
def top_overall(spark, sf_dir):
    return terms.top_overall(terms.overall_frequency(word_counts(spark, sf_dir)), 20)


@query
def head_overall(spark, sf_dir):
    freq = terms.overall_frequency(word_counts(spark, sf_dir), name="total_count")
    return terms.head_overall(freq, 50, name="total_count")


@query
def overall_bigram_frequency(spark, sf_dir):
    freq = terms.overall_frequency(bigram_counts_of(spark, sf_dir), "bigram", "total_frequency")
    return terms.head_overall(freq, 10, "bigram", "total_frequency")


@query
def cloud_weights(spark, sf_dir):
    return terms.cloud_weights(terms.overall_frequency(word_counts(spark, sf_dir)), 100)


@query
def doc_stats(spark, sf_dir):
    return terms.bag_doc_stats(word_bags(spark, sf_dir))


@query
def corpus_stats(spark, sf_dir):
    bags = word_bags(spark, sf_dir)
    return terms.corpus_stats(
        terms.bag_doc_stats(bags),
        terms.overall_frequency(terms.bag_counts(bags)),
        bigram_counts_of(spark, sf_dir),
    )


# --- chunks -------------------------------------------------------------------


@query
def word_chunks(spark, sf_dir):
    df = chunks.word_chunks(corpus(spark, sf_dir))
    return df.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query
def overlap_chunks(spark, sf_dir):
    df = chunks.overlap_chunks(corpus(spark, sf_dir), max_tokens=500, overlap=50)
    return df.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query
def chunk_stats(spark, sf_dir):
    return rounded(chunks.chunk_stats(chunks.word_chunks(corpus(spark, sf_dir))), 6)


# --- vectors ------------------------------------------------------------------


def vectors_of(spark, sf_dir):
    vecs = read_table(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", "label")
    return vecs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def labelled(spark, sf_dir):
    return vectors_of(spark, sf_dir).withColumnRenamed("label", "cluster")


@query
def vectors_wide(spark, sf_dir):
    wide = vectors.vectors_wide(vectors_of(spark, sf_dir), 64)
    return wide.select("doc_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in wide.columns[1:]])


@query
def embed_hashed(spark, sf_dir):
    vecs = vectors.embed_hashed(terms.bag_tf_idf(word_bags(spark, sf_dir)), dim=64)
    values = vecs.select("doc_id", F.posexplode("vec").alias("dim", "value"))
    values = values.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))
    return values.where("value <> 0")


@query
def cosine_pairs(spark, sf_dir):
    return vectors.cosine_pairs(vectors_of(spark, sf_dir), PAIR_THRESHOLD, expand_copies=True)


@query
def top_similar(spark, sf_dir):
    near = vectors.top_similar(vectors_of(spark, sf_dir), 5)
    return near.withColumn("rank", F.col("rank").cast("long"))


@query
def most_similar(spark, sf_dir):
    return vectors.most_similar(vectors.top_similar(vectors_of(spark, sf_dir), 1))


@query
def similarity_stats(spark, sf_dir):
    stats = vectors.similarity_stats(vectors_of(spark, sf_dir))
    return stats.withColumn("dimensions", F.col("dimensions").cast("long"))


@query
def copy_groups(spark, sf_dir):
    return vectors.copy_groups(vectors_of(spark, sf_dir))


@query
def similarity_long(spark, sf_dir):
    return vectors.similarity_long(vectors_of(spark, sf_dir), PAIR_THRESHOLD)


@query
def similarity_tiles(spark, sf_dir):
    return vectors.tiles_long(vectors.similarity_tiles(vectors_of(spark, sf_dir)))


@query
def similarity_wide(spark, sf_dir):
    return vectors.similarity_wide(vectors_of(spark, sf_dir), WIDE_IDS)


# --- clusters -----------------------------------------------------------------


def quality_clusters(spark, sf_dir):
    labels = read_table(spark, f"{sf_dir}/labels.parquet", "doc_id", "quality")
    return labels.withColumnRenamed("quality", "cluster")


@query
def kmeans_from(spark, sf_dir):
    return cluster.kmeans_from(labelled(spark, sf_dir), 2)


@query
def elbow_from(spark, sf_dir):
    """Cost of 1 to 10 clusters after two rounds from fixed starts."""
    vecs = vectors_of(spark, sf_dir).drop("label").persist()
    starts = (vecs.withColumn("cluster", F.pmod("doc_id", F.lit(k)).cast("int")) for k in range(1, cluster.MAX_K + 1))
    costs = [cluster.within_ss(vecs.join(cluster.kmeans_from(start, 2), "doc_id")) for start in starts]
    return rounded(functools.reduce(DataFrame.unionAll, costs), 6)


@query
def elbow_one(spark, sf_dir):
    return rounded(cluster.within_ss(vectors_of(spark, sf_dir).withColumn("cluster", F.lit(0))), 6)


@query
def within_ss(spark, sf_dir):
    return rounded(cluster.within_ss(labelled(spark, sf_dir)), 6)


@query
def silhouette(spark, sf_dir):
    return cluster.silhouette(labelled(spark, sf_dir))


@query
def silhouette_sq(spark, sf_dir):
    score = cluster.silhouette_sq(labelled(spark, sf_dir).persist())
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


@query
def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(quality_clusters(spark, sf_dir))


@query
def cluster_members(spark, sf_dir):
    return cluster.cluster_members(quality_clusters(spark, sf_dir))


@query
def cluster_reps(spark, sf_dir):
    return cluster.cluster_reps(quality_clusters(spark, sf_dir))


def keywords_of(spark, sf_dir, n):
    bags = word_bags(spark, sf_dir)
    return cluster.cluster_keywords(bags, quality_clusters(spark, sf_dir), terms.bag_idf(bags), n)


@query
def cluster_keywords(spark, sf_dir):
    return keywords_of(spark, sf_dir, 15)


@query
def cluster_cloud(spark, sf_dir):
    return cluster.cluster_cloud(keywords_of(spark, sf_dir, 15))


# --- summaries ----------------------------------------------------------------


def corpus_idf(spark, sf_dir):
    return terms.passing_idf(terms.term_bags(corpus(spark, sf_dir), stops(spark))).persist()


@query
def summarize(spark, sf_dir):
    return summary.summarize(corpus(spark, sf_dir), corpus_idf(spark, sf_dir))


def long_summaries(spark, sf_dir):
    return summary.summarize_long(
        corpus(spark, sf_dir), corpus_idf(spark, sf_dir), max_tokens=500, overlap=50
    )


@query
def summarize_long(spark, sf_dir):
    return long_summaries(spark, sf_dir)


@query
def summary_or_extract(spark, sf_dir):
    return summary.summary_or_extract(corpus(spark, sf_dir), long_summaries(spark, sf_dir))


@query
def extract_all(spark, sf_dir):
    return summary.summary_or_extract(corpus(spark, sf_dir), None)


# --- neighbours by hashing: every row whose id is divisible by 20 asks --------------


def asking():
    return F.col("doc_id") % 20 == 0


@query
def similar_hashed(spark, sf_dir):
    return hashing.similar_hashed(vectors_of(spark, sf_dir), 5, asking())


@query
def hashed_recall(spark, sf_dir):
    """Searches, neighbours, whether nine tenths are found, and scores that are not exact."""
    vecs = vectors_of(spark, sf_dir)
    found = checkpoint(hashing.similar_hashed(vecs, 5, asking()))
    exact = vectors.top_similar(vecs, 5).where(F.col("source_document") % 20 == 0)
    measured = hashing.recall(found, exact)
    units = vectors._units(vecs)
    source = units.select(F.col("doc_id").alias("source_document"), F.col("vec").alias("a"))
    other = units.select(F.col("doc_id").alias("similar_document"), F.col("vec").alias("b"))
    scored = found.join(source, "source_document").join(other, "similar_document")
    off = F.abs(dot(F.col("a"), F.col("b")) - F.col("similarity_score")) > 1e-6
    wrong = scored.agg(F.coalesce(F.sum(off.cast("long")), F.lit(0))).scalar()
    return measured.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"), wrong.alias("wrong_scores"))


@query
def pairs_hashed(spark, sf_dir):
    return hashing.pairs_hashed(vectors_of(spark, sf_dir), PAIR_THRESHOLD)


@query
def doc_vectors_indexed(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    vecs = indexing.doc_vectors(docs, indexing.word_vectors(docs))
    return vecs.select("doc_id", F.posexplode("vec").alias("dim", "value"))


# --- learned vectors, k-means and Ward: no SQL states them ----------------------


@query
def doc_vectors_w2v(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    trained = learned.train_word_vectors(chunks.word_chunks(docs))
    vecs = learned.doc_vectors_w2v(docs, trained)
    return vecs.select("doc_id", F.posexplode("vec").alias("dim", "value"))


@query
def layout_2d(spark, sf_dir):
    return rounded(learned.layout_2d(vectors_of(spark, sf_dir)), 6)


@query
def kmeans(spark, sf_dir):
    vecs = vectors_of(spark, sf_dir).persist()
    return cluster.membership(cluster.kmeans(vecs, 4), vecs)


@query
def elbow(spark, sf_dir):
    return cluster.elbow(vectors_of(spark, sf_dir).persist())


@query
def choose_k(spark, sf_dir):
    return cluster.choose_k(vectors_of(spark, sf_dir).persist())


@query
def ward_linkage(spark, sf_dir):
    return cluster.ward_linkage(vectors_of(spark, sf_dir))


@query
def ward_totals(spark, sf_dir):
    """What any full tree must give: half the squared heights add up to the total sum of squares."""
    tree = cluster.ward_linkage(vectors_of(spark, sf_dir)).persist()
    names = tree.select(F.explode(F.array("left", "right")).alias("name")).agg(F.countDistinct("name").alias("names"))
    totals = tree.agg(
        F.count("*").alias("merges"),
        F.max("size").alias("last_size"),
        F.round(F.sum(F.pow("height", F.lit(2)) / 2), 6).alias("half_squared_heights"),
    )
    return totals.withColumn("names", names.scalar())


@query
def feature_totals(spark, sf_dir):
    """Sums over all summaries, by dimension: no row may be lost or counted twice."""
    found = features.summaries(vectors_of(spark, sf_dir), 256).persist()
    totals = found.agg(F.sum("size").alias("n"), F.round(F.sum("squares"), 4).alias("squares"))
    by_dim = found.select(F.posexplode("sums").alias("dim", "x")).groupBy("dim").agg(F.round(F.sum("x"), 6).alias("total"))
    one = totals.select(F.struct("n", "squares")).scalar()
    return by_dim.select("dim", "total", one["n"].alias("n"), one["squares"].alias("squares"))


@query
def ward_micro(spark, sf_dir):
    """The tree over at most 512 clustering features, cut into four, for all documents."""
    centres, parts = cluster.micro_clusters(vectors_of(spark, sf_dir), 512)
    cut = cluster.cut_k(checkpoint(cluster.ward_linkage(centres, sizes="size")), 4)
    return parts.join(cut.withColumnRenamed("doc_id", "micro"), "micro").select("doc_id", "cluster")


@query
def ward_cut(spark, sf_dir):
    return cluster.cut_k(cluster.ward_linkage(vectors_of(spark, sf_dir)).persist(), 4)


@query
def cut_candidates(spark, sf_dir):
    return cluster.cut_candidates(cluster.ward_linkage(vectors_of(spark, sf_dir)).persist())


def chain_of_lengths(spark, sf_dir):
    """Documents in a row, joined to their neighbours from the least difference in length up.

    A tree of the deepest kind: its pointers form one chain through all documents.
    """
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "n_chars")
    docs = numbered(docs.orderBy("doc_id"), "at")
    after = docs.select((F.col("at") - 1).alias("at"), F.col("doc_id").alias("right"), F.col("n_chars").alias("other"))
    apart = F.abs(F.col("n_chars") - F.col("other")).cast("double")
    merges = docs.join(after, "at").select(F.col("doc_id").alias("left"), "right", apart.alias("height"))
    return numbered(merges.orderBy("height", "left"), "step")


@query
def cut_chain(spark, sf_dir):
    return cluster.cut_k(checkpoint(chain_of_lengths(spark, sf_dir)), 40)


@query
def cut_chain_candidates(spark, sf_dir):
    return cluster.cut_candidates(checkpoint(chain_of_lengths(spark, sf_dir)))


# --- sources --------------------------------------------------------------------


@query
def read_checked(spark, sf_dir):
    """Documents as a file each, one in fifty spoilt, read back: digests, or why not."""
    folder = f"{checkpoint_folder(spark)}/texts-{uuid.uuid4()}"
    spoilt = F.pmod("doc_id", F.lit(50)) == 7
    text = F.coalesce("text", F.lit("")).cast("binary")
    text = F.concat(text, F.when(spoilt, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    corpus(spark, sf_dir).select("doc_id", text.cast("string").alias("value")).write.partitionBy("doc_id").text(folder)
    found, rejects = read_corpus_checked(spark, folder, id_column="doc_id")
    none = F.lit(None).cast("string")
    kept = found.select("doc_id", F.md5("text").alias("digest"), none.alias("reason"))
    rows = kept.unionByName(rejects.select("doc_id", none.alias("digest"), "reason"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


# --- flows ----------------------------------------------------------------------


@query
def term_report_documents(spark, sf_dir):
    tables = flows.term_report(corpus(spark, sf_dir), stops(spark))
    return tables["Document_Statistics"]


@query
def term_report_bundle(spark, sf_dir):
    """All tables of the report, written as a bundle and read back: rows and sum of counts."""
    root, run_id = f"{checkpoint_folder(spark)}/bundles", str(uuid.uuid4())
    write_bundle(flows.term_report(corpus(spark, sf_dir), stops(spark)), root, run_id)
    numbers = {"n", "total_freq", "total_frequency", "total_words", "total_count", "occurrences", "frequency"}
    rows = []
    for name, found in read_bundle(spark, root, run_id).items():
        number = next(c for c in found.columns if c in numbers)
        rows.append(found.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.sum(number).alias("total")))
    return functools.reduce(DataFrame.unionByName, rows)


@query
def vector_report_bundle(spark, sf_dir):
    """The vector report on the given vectors, written as a bundle and read back: rows, documents told of."""
    root, run_id = f"{checkpoint_folder(spark)}/bundles", str(uuid.uuid4())
    vecs = vectors_of(spark, sf_dir)
    write_bundle(flows.vector_tables(vecs, checkpoint(word_bags(spark, sf_dir)), threshold=PAIR_THRESHOLD), root, run_id)
    told = {"cluster_sizes": F.sum("documents"), "summary_statistics": F.max("documents")}
    rows = []
    for name, found in read_bundle(spark, root, run_id).items():
        if not name.startswith("cluster_keywords") and name != "cluster_clouds":
            documents = told.get(name, F.lit(None)).cast("long").alias("documents")
            rows.append(found.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), documents))
    return functools.reduce(DataFrame.unionByName, rows)


@query
def summary_clusters(spark, sf_dir):
    tables = flows.summary_clusters(corpus(spark, sf_dir), stops(spark))
    return tables["summaries_with_clusters"]
