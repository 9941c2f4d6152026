"""Word BPE, tokenizer alignment and whitening against plain computations."""

import bisect
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import align, whiten, wordbpe
from textloom.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tables(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def ids_of(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# --- BPE with word ends ---------------------------------------------------------


def test_word_bpe_query_equals_the_library(spark, tiny):
    library = Tokenizer.from_file(WORDS)
    found = {r.doc_id: r for r in QUERIES["op11_word_bpe"](spark, tiny).collect()}
    docs = tables(spark, tiny, "documents", "doc_id", "text")
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = found[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), ids_of(ids))
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_bpe_edges(spark):
    library = Tokenizer.from_file(WORDS)
    pick = random.Random(5)
    letters = "abcs'tremvldS \n\t0123é漢!?-Σ İß́"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(80))) for _ in range(300)]
    texts += [
        "", " \n ", "a" * 700, "ab" * 4000, "!" * 900, "word " * 30_000, "x<|endoftext|>y", "<|startoftext|>", "<|endoftext|><|endoftext|>",
        "<|ENDOFTEXT|> <| endoftext", "it's 's ''s !'s we'll've", "ΣΑΣ ÀÉ ½ ①", " 　\x85x", "same", "same", "\x00\x01",
    ]
    rows = [(i, x, "c") for i, x in enumerate(texts)] + [(None, None, None), (0, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    back = wordbpe.decode(wordbpe.encode(docs, WORDS), WORDS)
    assert sorted(back.columns) == ["decoded", "doc_id", "ids", "text"]
    got = back.collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, r.text
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert wordbpe.encode(docs.limit(0), WORDS).count() == 0


def test_cuts_are_where_no_token_spans():
    import json

    with open(WORDS, encoding="utf-8") as file:
        encoder = wordbpe.Encoder(wordbpe.Vocabulary(json.load(file)))
    fragments, begin, _ = encoder.fragments("the zqxjk thing\nq7漢")
    # Every word end is a cut, and there are cuts inside words that hold rare pairs.
    assert len(fragments) > 6 and sum(len(x) // 2 for x in fragments) == len("thezqxjkthingq7漢".encode())
    encoder.cache.clear()
    short, wordbpe.SHORT = wordbpe.SHORT, 2
    try:
        by_heap = encoder.ids(fragments)
    finally:
        wordbpe.SHORT = short
    encoder.cache.clear()
    assert encoder.ids(fragments) == by_heap


# --- alignment ------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    with open(A, "rb") as a, open(B, "rb") as b:
        return align.Tokenizers(a.read(), b.read())


def plain_alignment(t, text):
    """Spans of both tokenizers, all overlapping pairs and the common ends."""
    whole = (" " + text).encode() if text else b""
    a = t.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = t.b.encode(text) if text else []
    if b"".join(t.bytes_a[i] for i in a) != whole or b"".join(t.bytes_b[i] for i in b) != whole:
        return [], [], [], [], ""
    ends_a = np.cumsum([len(t.bytes_a[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(t.bytes_b[i]) for i in b]).tolist()
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    links, j = [], 0
    for i, token in enumerate(a):
        while j and starts_b[j] > starts_a[i]:
            j -= 1
        k = j
        while k < len(b) and starts_b[k] < ends_a[i]:
            if ends_b[k] > starts_a[i]:
                links.append((token, b[k]))
                j = k
            k += 1
    cuts, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for cut in cuts:
        k, m = bisect.bisect_left(starts_a, cut, i), bisect.bisect_left(starts_b, cut, j)
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    return a, b, cuts, links, ";".join(groups)


AWKWARD = ["", "a", " ", "  x", "▁x", "<|endoftext|></s><s>", "<0x41>", "漢字 é \x00 b", "a\nb\r\n", "x" * 300, "🎉🎉", "one two three " * 20, "\n" * 50]


@pytest.mark.parametrize("lane", [7, 64, 4096])
def test_lockstep_merge_equals_all_overlaps(spark, tiny, tokenizers, monkeypatch, lane):
    monkeypatch.setattr(align, "PART", 200)
    monkeypatch.setattr(align.merge_lanes, "__defaults__", (lane,))
    texts = [(x or "")[:2500] for _, x in tables(spark, tiny, "documents", "doc_id", "text")[:60]] + AWKWARD
    for text, got in zip(texts, align.align_texts(tokenizers, [x.encode() for x in texts])):
        a, b, cuts, links, groups = plain_alignment(tokenizers, text)
        assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"], got["groups"]) == (len(a), len(b), len(cuts), len(links), groups)
        listed = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p, n in zip(got["pairs"], got["times"]) for _ in range(n)]
        assert sorted(listed) == sorted(links)


def test_align_query_equals_plain_counts(spark, tiny, tokenizers):
    docs = tables(spark, tiny, "documents", "doc_id", "text")
    made = {d: plain_alignment(tokenizers, text or "") for d, text in docs}
    holders: dict = {}
    for *_, links, _ in made.values():
        for pair in set(links):
            holders[pair] = holders.get(pair, 0) + 1
    most: dict = {}
    for (a, _), n in holders.items():
        most[a] = max(most.get(a, 0), n)
    rows = QUERIES["op12_align"](spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        a, b, cuts, links, groups = made[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(cuts), len(links))
        assert r.count_sum == sum(holders[x] for x in links)
        assert r.n_best == sum(holders[x] == most[x[0]] for x in links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if a else "")


def test_align_edges(spark, tokenizers):
    rows = [(i, x, "c") for i, x in enumerate(AWKWARD)] + [(None, None, None), (1, "a", "c"), (1, "a", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("note", F.lit(1))
    for size in (1, 1 << 20):
        aligned = align.checkpoint(align.align(docs, A, B, block_bytes=size))
        found = align.score(aligned, align.link_counts(aligned))
        assert {"doc_id", "text", "note", "groups", "count_sum"} <= set(found.columns) and "at" not in found.columns
        got = found.collect()
        assert len(got) == len(rows)
        holders = {}
        for _, x, _ in rows:
            for pair in set(plain_alignment(tokenizers, x or "")[3]):
                holders[pair] = holders.get(pair, 0) + 1
        for r in got:
            a, b, cuts, links, groups = plain_alignment(tokenizers, r.text or "")
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (len(a), len(b), len(cuts), len(links), groups)
            assert r.count_sum == sum(holders[x] for x in links)
    empty = align.checkpoint(align.align(docs.limit(0), A, B))
    assert align.score(empty, align.link_counts(empty)).count() == 0


def test_long_text_in_one_piece(tokenizers):
    """White space alone cannot be parted: the slower library reads it."""
    text = b"\n" * 200_000 + b"end"
    (got,) = align.align_texts(tokenizers, [text])
    a = tokenizers.a.encode(" " + text.decode(), add_special_tokens=False).ids
    assert got["n_a"] == len(a) and got["n_links"] >= max(got["n_a"], got["n_b"])


# --- whitening ------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], np.int64)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    return n, ((n * x - s).astype(object) ** 2).sum(axis=1), e[::-1], (x - s / n) @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), np.trace(v)


def test_whiten_query_equals_plain_eigenvectors(spark, tiny):
    data = tables(spark, tiny, "embeddings", "vec_id", "embedding")
    n, deviations, e, white, trace = plain_whitening([v for _, v in data])
    found = {(r.vec_id, r.component): r for r in QUERIES["op13_whiten"](spark, tiny).collect()}
    assert len(found) == 4 * len(data)
    for k in range(4):
        mine = np.array([found[i, k + 1].whitened for i, _ in data])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine, sign * white[:, k], rtol=0, atol=1e-8)
        assert found[data[0][0], k + 1].explained == pytest.approx(e[k] / trace, rel=1e-12)
    assert all(found[i, 1].deviation == d and found[i, 1].n == n for (i, _), d in zip(data, deviations))
    assert len({r.identity_error for r in found.values()}) == 1 and found[data[0][0], 1].identity_error < 1e-10


def test_whiten_edges(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, n string, c0 int"
    base = [(i, [1000.0 + i % 7, -float(i), 0.25 * i * i, 3.0], "n", 0) for i in range(30)]
    odd = [(90, None, None, None), (91, [1.0, None, 0.0, 0.0], "n", 1), (92, [nan, 0.0, 0.0, 0.0], "n", 1), (93, [0.0, inf, 0.0, 0.0], "n", 1)]
    rows = base + base[:5] + [(None, base[3][1], None, None)] + odd + [(94, [], "n", 0)]
    got = whiten.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 * 36 and {r.c0 for r in got} == {0, None}
    n, deviations, e, white, trace = plain_whitening([v for _, v, *_ in base])
    by = {(r.vec_id, r.component): r for r in got}
    assert {r.n for r in got} == {n} and all(by[i, 1].deviation == d for i, d in enumerate(deviations))
    for k in range(3):
        mine = np.array([by[i, k + 1].whitened for i in range(30)])
        assert np.allclose(np.abs(mine), np.abs(white[:30, k]), atol=1e-6)
    # The last entry never changes, so the fourth component has no variance.
    assert by[0, 4].whitened is None and by[0, 4].explained == 0.0 and by[0, 1].identity_error < 1e-9
    one = whiten.whiten(spark.createDataFrame([(1, [2.0, 3.0], "n", 0)] * 3, schema)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)] * 3
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None, None, None)], schema)).count() == 0
    with pytest.raises(ValueError, match="same number"):
        whiten.whiten(spark.createDataFrame([(1, [1.0], "n", 0), (2, [1.0, 2.0], "n", 0)], schema))


def test_feast_on_known_spectra():
    pick = np.random.default_rng(3)
    q, _ = np.linalg.qr(pick.standard_normal((40, 40)))
    for spectrum in (
        np.linspace(1, 100, 40), 1.0 + 1e-5 * np.arange(40), np.array([5.0] * 6 + [1.0] * 34), np.geomspace(1e-12, 1e6, 40),
        np.array([0.0] * 35 + [1, 1, 2, 2, 9.0]),
    ):
        matrix = (q * spectrum) @ q.T
        matrix = (matrix + matrix.T) / 2
        order = np.sort(spectrum)[::-1]
        for shift in (0.5, 3.3, 77.0):
            assert whiten.above(matrix, shift) == (spectrum > shift).sum()
        for wanted in (1, 4, 13):
            if order[wanted - 1] <= 1e-9 * order[0]:
                continue
            values, vectors = whiten.leading(matrix, wanted)
            assert np.allclose(values, order[:wanted], rtol=0, atol=1e-12 * order[0])
            assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-12 * order[0]
            assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-6


def test_products_are_exact():
    small, large = np.array([[1, -2], [3, 4]] * 50), np.array([[1 << 38, -3], [5, (1 << 38) + 1]])
    for z in (small, large):
        whole = z.astype(object)
        assert (whiten.products(z) == whole.T @ whole).all()
