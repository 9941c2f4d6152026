"""SQL that states the same results as the queries, for an engine with lists and lambdas."""

from __future__ import annotations

from textloom.queries.settings import PAIR_THRESHOLD, STOP_WORDS, WIDE_IDS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# Stated here on their own, so that a fault in the library's patterns shows.
WORD = quoted(
    "("
    r"[\p{L}\p{M}]+([.'\x{2018}\x{2019}\x{B7}][\p{L}\p{M}]+)*"
    r"|\p{Nd}+([.,;'\x{2018}\x{2019}]\p{Nd}+)*"
    "|_"
    ")+"
)
NON_SPACE = quoted(r"[^\x09-\x0D\x20]+")
SENTENCE = quoted(r"[^\n.!?]+([.!?]+[^\x09-\x0D\x20.!?][^\n.!?]*)*[.!?]*")

WORDS = f"regexp_extract_all(lower(coalesce(text, '')), {WORD})"
SPACED = f"regexp_extract_all(coalesce(text, ''), {NON_SPACE})"

STOPS = "stops AS (SELECT unnest([" + ", ".join(quoted(w) for w in STOP_WORDS) + "]) AS word)"
TOKENS = f"""tokens AS (
  SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id, {WORDS} AS t FROM documents))"""


def ok(word: str) -> str:
    return f"NOT regexp_matches({word}, '[0-9'']') AND length({word}) > 2"


def kept(word: str) -> str:
    return f"{ok(word)} AND {word} NOT IN (SELECT word FROM stops)"


WORD_COUNTS = f"""counts AS (
  SELECT doc_id, word, count(*) AS n FROM tokens WHERE {kept('word')} GROUP BY ALL)"""
BIGRAMS = """pairs AS (
  SELECT doc_id, pos, word AS word1, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS word2
  FROM tokens)"""
BIGRAM_COUNTS = f"""bcounts AS (
  SELECT doc_id, word1 || ' ' || word2 AS bigram, count(*) AS n FROM pairs
  WHERE word2 IS NOT NULL AND {kept('word1')} AND {kept('word2')} GROUP BY ALL)"""


def scored(counts: str, term: str, name: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, {term}, n, n / sum(n) OVER (PARTITION BY doc_id) AS tf,
         ln((SELECT count(DISTINCT doc_id) FROM {counts})
            / count(*) OVER (PARTITION BY {term})) AS idf
  FROM {counts})"""


WORD_BASE = (STOPS, TOKENS, WORD_COUNTS)
BIGRAM_BASE = (STOPS, TOKENS, BIGRAMS, BIGRAM_COUNTS)
WORD_SCORES = (*WORD_BASE, scored("counts", "word", "scored"))
BIGRAM_SCORES = (*BIGRAM_BASE, scored("bcounts", "bigram", "scored"))


def tfidf_columns(term: str) -> str:
    return (
        f"doc_id, {term}, n::BIGINT AS n, round(tf, 9) AS tf, round(idf, 9) AS idf, "
        "round(tf * idf, 9) AS tf_idf"
    )


def top(base: tuple[str, ...], term: str, n: int) -> str:
    return with_(
        *base,
        select=f"""SELECT {tfidf_columns(term)} FROM scored
QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY round(n * idf, 9) DESC) <= {n}""",
    )


FREQ = "freq AS (SELECT word, sum(n)::BIGINT AS total_freq FROM counts GROUP BY word)"

SQL: dict[str, str] = {
    "tokens": with_(TOKENS, select="SELECT doc_id, pos::BIGINT AS pos, word FROM tokens"),
    "remove_stop_words": with_(
        STOPS,
        TOKENS,
        select="SELECT doc_id, pos::BIGINT AS pos, word FROM tokens "
        "WHERE word NOT IN (SELECT word FROM stops)",
    ),
    "token_filter": with_(
        TOKENS, select=f"SELECT doc_id, pos::BIGINT AS pos, word FROM tokens WHERE {ok('word')}"
    ),
    "ngrams": with_(
        TOKENS,
        BIGRAMS,
        select="SELECT doc_id, pos::BIGINT AS pos, word1 || ' ' || word2 AS ngram "
        "FROM pairs WHERE word2 IS NOT NULL",
    ),
    "normalize_lines_space": r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
         '\n\z', ''), '\n', ' ', 'g') AS text FROM documents""",
    "normalize_lines_newline": r"""
SELECT page_id AS doc_id, regexp_replace(html, '\r\n?', chr(10), 'g') AS text FROM pages""",
    "doc_key": r"""
SELECT page_id, regexp_replace(url, '^.*/', '') AS name,
       regexp_replace(regexp_replace(url, '^.*/', ''), '\.[A-Za-z0-9]+$', '') AS stem FROM pages""",
    "clean_text": r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(
         coalesce(text, ''), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]', ' ', 'g'),
         '\b[0-9]+\b', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM documents""",
    "middle_extract": r"""
WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
b AS (SELECT *, greatest(1, floor(len(p) * 0.2::DOUBLE))::BIGINT AS s,
             floor(len(p) * 0.8::DOUBLE)::BIGINT AS e FROM p)
SELECT doc_id, CASE WHEN e > s THEN substring(array_to_string(p[s + 1:e], chr(10)), 1, 1500)
                    ELSE substring(text, 1, 1000) END AS extract FROM b""",
    "midpoint_extract": r"""
SELECT doc_id, CASE WHEN length(text) > 2000 THEN substring(text, length(text) // 2 + 1, 1000)
                    ELSE substring(text, 1, 500) END || '...' AS extract FROM documents""",
    "term_counts": with_(*WORD_BASE, select="SELECT doc_id, word, n::BIGINT AS n FROM counts"),
    "tf_idf": with_(*WORD_SCORES, select=f"SELECT {tfidf_columns('word')} FROM scored"),
    "top_terms": top(WORD_SCORES, "word", 10),
    "top_terms_15": top(WORD_SCORES, "word", 15),
    "tfidf_export": with_(
        *WORD_SCORES,
        select="""SELECT doc_id, word, n::BIGINT AS n, round(tf * idf, 9) AS tf_idf FROM scored
ORDER BY doc_id, round(n * idf, 9) DESC, word""",
    ),
    "bigram_counts": with_(*BIGRAM_BASE, select="SELECT doc_id, bigram, n::BIGINT AS n FROM bcounts"),
    "bigram_tf_idf": with_(*BIGRAM_SCORES, select=f"SELECT {tfidf_columns('bigram')} FROM scored"),
    "top_bigrams": top(BIGRAM_SCORES, "bigram", 8),
    "top_bigrams_10": top(BIGRAM_SCORES, "bigram", 10),
    "overall_frequency": with_(*WORD_BASE, FREQ, select="SELECT * FROM freq"),
    "top_overall": with_(
        *WORD_BASE,
        FREQ,
        select="SELECT * FROM freq QUALIFY rank() OVER (ORDER BY total_freq DESC) <= 20",
    ),
    "head_overall": with_(
        *WORD_BASE,
        FREQ,
        select="SELECT word, total_freq AS total_count FROM freq ORDER BY total_freq DESC, word LIMIT 50",
    ),
    "overall_bigram_frequency": with_(
        *BIGRAM_BASE,
        select="""SELECT bigram, sum(n)::BIGINT AS total_frequency FROM bcounts
GROUP BY bigram ORDER BY total_frequency DESC, bigram LIMIT 10""",
    ),
    "cloud_weights": with_(
        *WORD_BASE,
        FREQ,
        select="SELECT word, total_freq AS frequency FROM freq ORDER BY total_freq DESC, word LIMIT 100",
    ),
    "doc_stats": with_(
        *WORD_BASE,
        select="""SELECT doc_id, sum(n)::BIGINT AS total_words, count(*)::BIGINT AS unique_words
FROM counts GROUP BY doc_id""",
    ),
    "corpus_stats": with_(
        *WORD_BASE,
        BIGRAMS,
        BIGRAM_COUNTS,
        FREQ,
        select="""SELECT (SELECT count(DISTINCT doc_id) FROM counts)::BIGINT AS documents,
  (SELECT count(*) FROM freq)::BIGINT AS distinct_words,
  (SELECT sum(n) FROM counts)::BIGINT AS occurrences,
  (SELECT count(*) FROM bcounts)::BIGINT AS bigrams,
  (SELECT word FROM freq ORDER BY total_freq DESC, word LIMIT 1) AS most_frequent_word,
  (SELECT max(total_freq) FROM freq)::BIGINT AS most_frequent_count""",
    ),
}

CLEAN = SQL["clean_text"]
CHUNKS = f"""clean AS ({CLEAN}),
words AS (SELECT doc_id, regexp_extract_all(clean, '[a-z0-9]+') AS w FROM clean),
chunks AS (
  SELECT doc_id, i AS chunk_idx, array_to_string(w[i * 100 + 1:i * 100 + 100], ' ') AS chunk
  FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 99) // 100)) AS i FROM words))"""


def overlap_cte(max_tokens: int, overlap: int) -> str:
    step = max_tokens - overlap
    return f"""spaced AS (SELECT doc_id, text, {SPACED} AS w FROM documents),
chunks AS (
  SELECT doc_id, i // {step} AS chunk_idx,
         CASE WHEN len(w) <= {max_tokens} THEN text
              ELSE array_to_string(w[i + 1:i + {max_tokens}], ' ') END AS chunk,
         len(w) > {max_tokens} AS split
  FROM (SELECT doc_id, text, w,
          unnest(CASE WHEN len(w) <= {max_tokens} THEN [0] ELSE range(0, len(w), {step}) END) AS i
        FROM spaced))"""


VECS = """vecs AS (
  SELECT vec_id AS doc_id, label AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings)"""
PAIRS = """pairs AS (
  SELECT a.doc_id AS doc1, b.doc_id AS doc2, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
  FROM vecs a JOIN vecs b ON a.doc_id <> b.doc_id)"""
DISTANCES = """apart AS (
  SELECT a.doc_id, a.cluster, b.cluster AS other, list_distance(a.v, b.v) AS d
  FROM vecs a JOIN vecs b ON a.doc_id <> b.doc_id)"""


def silhouette_of(distance: str) -> str:
    return with_(
        VECS,
        DISTANCES,
        f"""means AS (SELECT doc_id, cluster, other, avg({distance}) AS m FROM apart GROUP BY ALL),
ab AS (SELECT doc_id, max(m) FILTER (other = cluster) AS a, min(m) FILTER (other <> cluster) AS b
  FROM means GROUP BY doc_id),
s AS (SELECT coalesce((b - a) / greatest(a, b), 0) AS s FROM ab)""",
        select="SELECT count(*)::BIGINT AS points, round(avg(s), 6) AS silhouette FROM s",
    )


def within_of(cluster: str) -> str:
    return with_(
        VECS,
        f"""x AS (SELECT {cluster} AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
g AS (SELECT cluster, i, var_pop(x) * count(*) AS ss FROM x GROUP BY ALL)""",
        select="SELECT count(DISTINCT cluster)::INTEGER AS k, round(sum(ss), 6) AS wss FROM g",
    )


COORDINATES = "x AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs)"


def kmeans_ctes(start: str, rounds: int, name: str) -> list[str]:
    """Lloyd's rounds from a label per vector; the last ones are ``{name}a{rounds}``."""
    p = name
    ctes = [f"{p}a0 AS (SELECT doc_id, {start} AS cluster FROM vecs)"]
    for r in range(1, rounds + 1):
        ctes.append(f"""{p}c{r} AS (SELECT cluster, i, avg(x) AS m FROM x JOIN {p}a{r - 1} USING (doc_id) GROUP BY ALL),
{p}d{r} AS (SELECT doc_id, cluster, sum((x - m) * (x - m)) AS d FROM x JOIN {p}c{r} USING (i) GROUP BY ALL),
{p}a{r} AS (SELECT doc_id, arg_min(cluster, (d, cluster)) AS cluster FROM {p}d{r} GROUP BY doc_id)""")
    return ctes


def kmeans_rounds(rounds: int) -> str:
    ctes = kmeans_ctes("cluster", rounds, "")
    return with_(VECS, COORDINATES, *ctes, select=f"SELECT doc_id, cluster FROM a{rounds}")


def elbow_rounds(ks: range, rounds: int) -> str:
    ctes = [c for k in ks for c in kmeans_ctes(f"doc_id % {k}", rounds, f"k{k}_")]
    labels = " UNION ALL ".join(f"SELECT {k} AS k, doc_id, cluster FROM k{k}_a{rounds}" for k in ks)
    return with_(
        VECS,
        COORDINATES,
        *ctes,
        f"labels AS ({labels})",
        "g AS (SELECT k, cluster, i, var_pop(x) * count(*) AS ss FROM x JOIN labels USING (doc_id) GROUP BY ALL)",
        select="SELECT k::INTEGER AS k, round(sum(ss), 6) AS wss FROM g GROUP BY k",
    )


MEMBERS = "members AS (SELECT doc_id, quality AS cluster FROM labels)"
KEYWORDS = """keywords AS (
  SELECT cluster, word AS keyword, round(avg(tf) * any_value(idf), 9) AS avg_tfidf,
         count(*)::BIGINT AS doc_freq, sum(n)::BIGINT AS total_occurrences
  FROM scored JOIN members USING (doc_id) GROUP BY cluster, word
  QUALIFY row_number() OVER (PARTITION BY cluster
    ORDER BY round(avg(tf) * any_value(idf), 9) DESC, word) <= 15)"""

SQL |= {
    "word_chunks": with_(CHUNKS, select="SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, chunk FROM chunks"),
    "overlap_chunks": with_(
        overlap_cte(500, 50), select="SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, chunk FROM chunks"
    ),
    "chunk_stats": with_(
        CHUNKS,
        select="""SELECT count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS chunks,
       round(count(*) / count(DISTINCT doc_id), 6) AS mean_chunks FROM chunks""",
    ),
    "vectors_wide": "SELECT vec_id AS doc_id, "
    + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS v{i}" for i in range(1, 65))
    + " FROM embeddings",
    "embed_hashed": with_(
        *WORD_SCORES,
        """hashed AS (
  SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS dim,
         round(n * idf, 6)::DECIMAL(28, 6)
           * CASE WHEN ('0x' || substr(md5(word), 16, 1))::BIGINT % 2 = 1 THEN -1 ELSE 1 END AS value
  FROM scored),
sums AS (SELECT doc_id, dim, sum(value)::DOUBLE AS value FROM hashed GROUP BY ALL)""",
        select="""SELECT * FROM (
  SELECT doc_id, dim, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value
  FROM sums) WHERE value <> 0""",
    ),
    "cosine_pairs": with_(VECS, PAIRS, select=f"SELECT * FROM pairs WHERE cosine >= {PAIR_THRESHOLD}"),
    "similarity_long": with_(
        VECS,
        PAIRS,
        select=f"""SELECT * FROM pairs WHERE cosine >= {PAIR_THRESHOLD}
UNION ALL SELECT doc_id, doc_id, 1.0::DOUBLE FROM vecs""",
    ),
    "similarity_tiles": with_(
        VECS,
        select="""SELECT a.doc_id AS doc1, b.doc_id AS doc2,
  CASE WHEN abs(list_cosine_similarity(a.v, b.v)) < 0.0000005 THEN 0.0::DOUBLE
       ELSE round(list_cosine_similarity(a.v, b.v), 6) END AS cosine FROM vecs a, vecs b""",
    ),
    "similarity_wide": with_(
        VECS,
        select="SELECT a.doc_id, "
        + ", ".join(
            f"round(list_cosine_similarity(a.v, (SELECT v FROM vecs WHERE doc_id = {i})), 6) AS sim_{i}"
            for i in WIDE_IDS
        )
        + " FROM vecs a",
    ),
    "top_similar": with_(
        VECS,
        PAIRS,
        select="""SELECT doc1 AS source_document, doc2 AS similar_document, cosine AS similarity_score,
  row_number() OVER (PARTITION BY doc1 ORDER BY cosine DESC, doc2)::BIGINT AS rank
FROM pairs QUALIFY row_number() OVER (PARTITION BY doc1 ORDER BY cosine DESC, doc2) <= 5""",
    ),
    "copy_groups": """SELECT vec_id AS doc_id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings""",
    "most_similar": with_(
        VECS,
        PAIRS,
        select="""SELECT doc1 AS source_document, doc2 AS most_similar,
  cosine AS similarity_to_most_similar
FROM pairs QUALIFY row_number() OVER (PARTITION BY doc1 ORDER BY cosine DESC, doc2) = 1""",
    ),
    "similarity_stats": with_(
        VECS,
        PAIRS,
        "most AS (SELECT * FROM pairs ORDER BY cosine DESC, doc1, doc2 LIMIT 1)",
        "least AS (SELECT * FROM pairs ORDER BY cosine, doc1, doc2 LIMIT 1)",
        select="""SELECT (SELECT count(*) FROM vecs)::BIGINT AS documents,
  (SELECT max(len(v)) FROM vecs)::BIGINT AS dimensions,
  (SELECT round(avg(list_cosine_similarity(a.v, b.v)), 4)
   FROM vecs a JOIN vecs b ON a.doc_id < b.doc_id) AS mean_similarity,
  m.doc1 AS most_similar_doc1, m.doc2 AS most_similar_doc2, m.cosine AS most_similarity,
  l.doc1 AS least_similar_doc1, l.doc2 AS least_similar_doc2, l.cosine AS least_similarity
FROM most m, least l""",
    ),
    "kmeans_from": kmeans_rounds(2),
    "elbow_from": elbow_rounds(range(1, 11), 2),
    "feature_totals": with_(
        "x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)",
        select="""SELECT dim::INTEGER AS dim, round(sum(v), 6) AS total, (SELECT count(*) FROM embeddings)::BIGINT AS n,
  round((SELECT sum(v * v) FROM x), 4) AS squares FROM x GROUP BY dim""",
    ),
    "hashed_recall": with_(
        "n AS (SELECT count(*) AS rows, count(*) FILTER (vec_id % 20 = 0) AS queries FROM embeddings)",
        select="""SELECT queries::BIGINT AS queries, (queries * least(5, rows - 1))::BIGINT AS neighbours,
  TRUE AS enough, 0::BIGINT AS wrong_scores FROM n""",
    ),
    "ward_totals": with_(
        VECS,
        COORDINATES,
        "g AS (SELECT i, var_pop(x) * count(*) AS ss FROM x GROUP BY i)",
        select="""SELECT (SELECT count(*) - 1 FROM vecs)::BIGINT AS merges, (SELECT count(*) FROM vecs)::BIGINT AS last_size,
  (SELECT count(*) FROM vecs)::BIGINT AS names, round(sum(ss), 6) AS half_squared_heights FROM g""",
    ),
    "elbow_one": within_of("0"),
    "within_ss": within_of("cluster"),
    "silhouette": silhouette_of("d"),
    "silhouette_sq": "SELECT silhouette FROM (" + silhouette_of("d * d") + ")",
    "cluster_sizes": with_(
        MEMBERS,
        select="""SELECT cluster, count(*)::BIGINT AS documents,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM members), 1) AS percent
FROM members GROUP BY cluster ORDER BY cluster""",
    ),
    "cluster_members": with_(MEMBERS, select="SELECT cluster, doc_id FROM members ORDER BY ALL"),
    "cluster_reps": with_(
        MEMBERS, select="SELECT cluster, min(doc_id) AS doc_id FROM members GROUP BY cluster"
    ),
    "cluster_keywords": with_(*WORD_SCORES, MEMBERS, KEYWORDS, select="SELECT * FROM keywords"),
    "cluster_cloud": with_(
        *WORD_SCORES,
        MEMBERS,
        KEYWORDS,
        select="SELECT cluster, keyword AS word, total_occurrences AS frequency FROM keywords",
    ),
}


IDF = (*WORD_SCORES, "idf AS (SELECT DISTINCT word, idf FROM scored)")


def summary_ctes(source: str, name: str, keys: str, least: int, most: int) -> str:
    """Summaries of ``source(keys, text)`` as ``name(keys, summary)``."""
    s = name
    return f"""{s}_s AS (
  SELECT {keys}, idx, sentence, len(regexp_extract_all(sentence, {NON_SPACE})) AS nw
  FROM (SELECT {keys}, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx
    FROM (SELECT {keys}, list_filter(list_transform(
            regexp_extract_all(coalesce(text, ''), {SENTENCE}),
            lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0b]+', ' ', 'g'))),
            lambda x: x <> '') AS ss FROM {source}))),
{s}_w AS (
  SELECT {keys}, idx, unnest(regexp_extract_all(lower(sentence), {WORD})) AS word FROM {s}_s),
{s}_v AS (
  SELECT {keys}, idx, round(count(*) OVER (PARTITION BY {keys}, word) * idf, 6)::DECIMAL(20, 6) AS value
  FROM {s}_w JOIN idf USING (word)),
{s}_c AS (
  SELECT {keys}, idx, round(sum(value)::DOUBLE / count(*), 6) AS score FROM {s}_v GROUP BY ALL),
{s}_t AS (
  SELECT {keys}, idx, sentence,
    coalesce(sum(nw) OVER (PARTITION BY {keys} ORDER BY coalesce(score, 0) DESC, idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {s}_s LEFT JOIN {s}_c USING ({keys}, idx)),
{s}_j AS (
  SELECT {keys}, string_agg(sentence, ' ' ORDER BY idx) AS joined FROM {s}_t
  WHERE before < {least} GROUP BY {keys}),
{s} AS (
  SELECT {keys}, array_to_string(regexp_extract_all(joined, {NON_SPACE})[1:{most}], ' ') AS summary
  FROM {s}_j)"""


LONG_SUMMARIES = (
    *IDF,
    overlap_cte(500, 50),
    "short AS (SELECT doc_id, text FROM documents WHERE len(" + SPACED + ") <= 500)",
    "long AS (SELECT doc_id, chunk_idx, chunk AS text FROM chunks WHERE split)",
    summary_ctes("short", "direct", "doc_id", 80, 200),
    summary_ctes("long", "parts", "doc_id, chunk_idx", 50, 150),
    """combined AS (SELECT doc_id, string_agg(summary, ' ' ORDER BY chunk_idx) AS text
  FROM parts GROUP BY doc_id),
lengthy AS (SELECT * FROM combined WHERE length(text) > 2000)""",
    summary_ctes("lengthy", "again", "doc_id", 80, 200),
    """summaries AS (SELECT * FROM direct UNION ALL SELECT * FROM again
  UNION ALL SELECT doc_id, text FROM combined WHERE length(text) <= 2000)""",
)

SQL |= {
    "summarize": with_(
        *IDF, summary_ctes("documents", "summaries", "doc_id", 80, 200), select="SELECT * FROM summaries"
    ),
    "summarize_long": with_(*LONG_SUMMARIES, select="SELECT * FROM summaries"),
    "summary_or_extract": with_(
        *LONG_SUMMARIES,
        f"extracts AS ({SQL['midpoint_extract']})",
        select="""SELECT e.doc_id, coalesce(s.summary, e.extract) AS summary
FROM extracts e LEFT JOIN summaries s ON s.doc_id = e.doc_id""",
    ),
    "extract_all": r"""
WITH p AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS p FROM documents),
b AS (SELECT *, greatest(1, floor(len(p) * 0.2::DOUBLE))::BIGINT AS s,
             floor(len(p) * 0.8::DOUBLE)::BIGINT AS e FROM p)
SELECT doc_id, CASE WHEN e > s
         THEN substring(array_to_string(p[s + 1:e], chr(10) || chr(10)), 1, 1500)
         ELSE substring(text, 1, 1000) END AS summary FROM b""",
}

SQL["term_report_documents"] = SQL["doc_stats"]

# Jumps of the length from one document to the next: a chain cut at the greatest ones.
JUMPS = """jumps AS (
  SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS prev,
    abs(n_chars - lag(n_chars) OVER (ORDER BY doc_id))::DOUBLE AS height FROM documents)"""
SQL["cut_chain"] = with_(
    JUMPS,
    """cuts AS (
  SELECT doc_id FROM jumps WHERE prev IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY height DESC, prev DESC) <= 39)""",
    select="""SELECT j.doc_id, (count(c.doc_id) OVER (ORDER BY j.doc_id))::INTEGER AS cluster
FROM jumps j LEFT JOIN cuts c ON j.doc_id = c.doc_id""",
)
SQL["cut_chain_candidates"] = with_(
    JUMPS,
    "f AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS fraction)",
    "most AS (SELECT max(height) AS m FROM jumps)",
    select="""SELECT fraction, m * fraction AS height,
  (SELECT 1 + count(*) FROM jumps j WHERE j.height > fraction * m)::BIGINT AS clusters FROM f, most""",
)
SQL["read_checked"] = r"""
SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL
    ELSE md5(regexp_replace(coalesce(text, '') || chr(10), '\r\n?', chr(10), 'g')) END AS digest,
  CASE WHEN doc_id % 50 = 7 THEN 'not UTF-8' END AS reason FROM documents"""

SQL["term_report_bundle"] = with_(
    *WORD_BASE,
    FREQ,
    scored("counts", "word", "scored"),
    BIGRAMS,
    BIGRAM_COUNTS,
    scored("bcounts", "bigram", "bscored"),
    """ranked AS (
  SELECT n, rank() OVER (PARTITION BY doc_id ORDER BY round(n * idf, 9) DESC) AS r FROM scored)""",
    """branked AS (
  SELECT n, rank() OVER (PARTITION BY doc_id ORDER BY round(n * idf, 9) DESC) AS r FROM bscored)""",
    """listed AS (
  SELECT 'TF_IDF_Full' AS name, n FROM scored
  UNION ALL SELECT 'Top_Words_Per_Doc', n FROM ranked WHERE r <= 10
  UNION ALL SELECT 'Top_Bigrams_Per_Doc', n FROM branked WHERE r <= 8
  UNION ALL SELECT 'Overall_Word_Frequency', total_freq FROM freq
  UNION ALL SELECT 'Overall_Bigram_Frequency', sum(n) FROM bcounts GROUP BY bigram
  UNION ALL SELECT 'Document_Statistics', sum(n) FROM counts GROUP BY doc_id
  UNION ALL SELECT 'Bigram_Analysis_Full', n FROM bscored
  UNION ALL SELECT 'Word_Frequency_Distribution', total_freq FROM freq
  UNION ALL SELECT 'Corpus_Statistics', sum(n) FROM counts
  UNION ALL (SELECT 'Word_Cloud', total_freq FROM freq ORDER BY total_freq DESC, word LIMIT 100))""",
    select="SELECT name, count(*) AS n_rows, sum(n)::BIGINT AS total FROM listed GROUP BY name",
)

# Four clusters, five neighbours, ten costs; the matrix in tiles of 512 documents a side.
SQL["vector_report_bundle"] = with_(
    VECS,
    PAIRS,
    "size AS (SELECT count(*) AS n FROM vecs)",
    f"""listed AS (
  SELECT unnest(['document_vectors', 'most_similar', 'cluster_membership', 'layout']) AS name, n AS n_rows, NULL AS documents FROM size
  UNION ALL SELECT 'similar_documents', n * least(5, n - 1), NULL FROM size
  UNION ALL SELECT 'similarity_pairs', (SELECT count(*) FROM pairs WHERE cosine >= {PAIR_THRESHOLD}), NULL
  UNION ALL SELECT 'similarity_matrix', ceil(n / 512.0) * ceil(n / 512.0), NULL FROM size
  UNION ALL SELECT 'elbow', 10, NULL
  UNION ALL SELECT 'cluster_sizes', 4, n FROM size
  UNION ALL SELECT 'cluster_representatives', 4, NULL
  UNION ALL SELECT 'summary_statistics', 1, n FROM size)""",
    select="SELECT name, n_rows::BIGINT AS n_rows, documents::BIGINT AS documents FROM listed",
)

# Index vectors of four signed entries, windows of ten words, words of five occurrences or more.
SQL["doc_vectors_indexed"] = with_(
    f"clean AS ({CLEAN})",
    f"""toks AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(clean, '[a-z0-9]+') AS w FROM clean))""",
    """entries AS (
  SELECT word, part & 268435455 AS low, CASE WHEN (part >> 28) & 1 = 1 THEN -1 ELSE 1 END AS sign
  FROM (SELECT word, ('0x' || substr(md5(word), 8 * i + 1, 8))::BIGINT AS part
        FROM (SELECT DISTINCT word FROM toks), range(4) AS r(i)))""",
    """around AS (
  SELECT a.word, b.word AS other, count(*) AS n
  FROM (SELECT doc_id, word, pos + o AS pos FROM toks, range(-10, 11) AS r(o) WHERE o <> 0) a
  JOIN toks b ON a.doc_id = b.doc_id AND a.pos = b.pos
  GROUP BY ALL)""",
    "common AS (SELECT word FROM toks GROUP BY word HAVING count(*) >= 5)",
    """sums AS (
  SELECT a.word, low % 100 AS dim, sum(n * sign)::DOUBLE AS value
  FROM around a JOIN common USING (word) JOIN entries e ON e.word = a.other GROUP BY ALL)""",
    """units AS (
  SELECT word, dim, round(value / sqrt(sum(value * value) OVER (PARTITION BY word)) * 1000000)::BIGINT AS value
  FROM sums QUALIFY sum(value * value) OVER (PARTITION BY word) > 0)""",
    "used AS (SELECT doc_id, count(*) AS n FROM toks JOIN common USING (word) GROUP BY doc_id)",
    """added AS (
  SELECT doc_id, dim, sum(t.n * value) AS value
  FROM (SELECT doc_id, word, count(*) AS n FROM toks GROUP BY ALL) t JOIN units USING (word) GROUP BY ALL)""",
    select="""SELECT doc_id, dim::INTEGER AS dim, coalesce(value / (n * 1000000), 0.0)::DOUBLE AS value
FROM (SELECT doc_id, unnest(range(100)) AS dim FROM documents)
LEFT JOIN used USING (doc_id) LEFT JOIN added USING (doc_id, dim)""",
)


def all_sql() -> dict[str, str]:
    return dict(SQL)
