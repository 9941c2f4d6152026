"""Repeated rows, groups of any size, long payloads and clashing names."""

import base64
import collections
import math
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import jaccard, langid, quality, reshard, secrets, suffixes
from tests.llm.test_operators import DOC, sentence

# --- substring dedup ------------------------------------------------------------


def test_many_equal_rows_bring_each_start_once(spark):
    long = sentence(1, 90)
    rows = [(1, long)] * 120 + [(2, sentence(2, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text")
    (listed,) = suffixes.repeated_strings(keyed).collect()
    assert len(listed.starts) == len(set(listed.starts)) <= len(long)
    for r in suffixes.remove_repeats(docs).collect():
        assert len(r.kept) == (0 if r.doc_id == 1 else r.n_bytes)


def test_a_window_has_one_minimiser_in_every_slice(monkeypatch):
    """With a hash that often ties, the slice around a text changes nothing."""
    monkeypatch.setattr(suffixes, "mix", lambda h: h & np.uint64(3))
    text = np.frombuffer(sentence(5, 300).encode(), np.uint8)
    found = []
    for around in (0, 7, 100_000):
        other = np.frombuffer(b"q" * around, np.uint8)
        data = np.concatenate([other, text, other])
        offsets = np.array([0, around, around + len(text), len(data)])
        doc, start, size, *_ = suffixes.segments(data, offsets, suffixes.KMERS[0])
        found.append(list(zip(start[doc == 1].tolist(), size[doc == 1].tolist())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 3


# --- similar documents ------------------------------------------------------------


def test_equal_rows_are_searched_once(spark, monkeypatch):
    words = sentence(3, 80).split()
    a, b = " ".join(words), " ".join([*words[:-1], "changed"])
    docs = spark.createDataFrame([(1, a)] * 60 + [(2, b)] * 60 + [(3, sentence(4, 80))], "doc_id long, text string").repartition(4)
    seen, search = [], jaccard._search_blocks
    monkeypatch.setattr(jaccard, "_search_blocks", lambda members, *x: (seen.append(members.select("c").distinct().count() / max(1, members.select("c", "token", "salt").count())), search(members, *x))[1])
    rows = jaccard.jaccard_components(docs).collect()
    assert len(rows) == 121 and {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1), (3, 3)}
    # A class is in a few blocks, and not there once for every row.
    assert seen[0] >= 1 / (2 * jaccard.HOMES)


# --- quality ----------------------------------------------------------------------


@pytest.mark.parametrize("clean", [3, 48, 49])
def test_junk_is_rejected_at_every_group_size(spark, clean):
    rows = [(i, sentence(i, 40 + i % 50), "en", "s", None) for i in range(clean)]
    rows += [(500 + i, sentence(500 + i, 40 + i % 50), "en", "t", None) for i in range(150)]
    junk = " ".join(f"#{w}|$" for w in sentence(900, 60).split())
    rows += [(900, junk, "en", "s", None), (901, junk, "en", "alone", None), (902, sentence(902, 60), "en", "lone", None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("_note", F.lit("mine")).withColumn("distance", F.lit("x"))
    found = quality.quality(docs)
    assert {"_note", "source", "distance"} <= set(found.columns) and dict(found.dtypes)["distance"] == "double"
    got = {r.doc_id: r for r in found.collect()}
    assert not got[900].kept and not got[901].kept
    assert all(got[i].kept for i in (*range(clean), *range(500, 650), 902)) and got[0]._note == "mine"


def test_the_estimate_of_least_determinant_is_kept(spark):
    estimates = [spark.createDataFrame([("en", "s", float(t), d)], "_lang string, _source string, m1 double, det double") for t, d in enumerate((3.0, 1.0, 2.0, 1.0))]
    assert [tuple(r) for r in quality._least_determinant(estimates).collect()] == [("en", "s", 1.0)]


# --- resharding -------------------------------------------------------------------


def test_equal_rows_do_not_make_a_shard_large(spark, tmp_path):
    distinct = spark.range(2000).select("id", F.lpad(F.col("id").cast("string"), 100, "a").alias("text"))
    equal = spark.range(2000).select(F.lit(-1).cast("long").alias("id"), F.lit("b" * 100).alias("text"))
    docs = distinct.union(equal).withColumnRenamed("id", "doc_id")
    for table in (docs, docs.repartition(7)):
        moved = reshard.reshard(table, F.pmod("doc_id", F.lit(4)), 8)
        files = reshard.rewrite(moved, str(tmp_path / f"{table is docs}"), all_shards=True)
        rows = files.groupBy("shard").agg(F.sum("size").alias("size"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("*").alias("n")).collect()
        sizes = [r["size"] for r in rows]
        assert len(rows) == 8 and sum(r.n for r in rows) == 4000 and max(sizes) - min(sizes) <= 0.05 * max(sizes)
        assert all((r.low, r.high) == (0, r.n - 1) for r in rows)


def test_flow_is_as_cheap_as_any(spark):
    """Every way to send a few blocks of supply, tried one after the other."""
    pick = random.Random(4)
    for _ in range(30):
        supply = {i: pick.randrange(4) for i in range(3)}
        total = sum(supply.values())
        room = {0: pick.randrange(total + 1), 1: 0}
        room[1] = total - room[0]
        cost = {(i, j): pick.randrange(1, 9) for i in supply for j in room}
        flow = reshard.min_cost_flow(supply, room, lambda i, j: cost[i, j])
        ways = [
            sum(x * cost[i, 0] + (supply[i] - x) * cost[i, 1] for i, x in enumerate(way))
            for way in np.ndindex(*(supply[i] + 1 for i in supply))
            if sum(way) == room[0]
        ]
        assert sum(cost[k] * v for k, v in flow.items()) == min(ways)


# --- language ID ------------------------------------------------------------------


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or word and kind == "M":
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def plain_langid(labelled, texts):
    """Words first, then the longest known n-grams, counted one by one."""
    langs = sorted({lang for _, lang in labelled})
    words, grams = {x: collections.Counter() for x in langs}, {(x, n): collections.Counter() for x in langs for n in range(1, 5)}
    for text, lang in labelled:
        for w in plain_words(text):
            words[lang][w] += 1
            for n in range(1, 5):
                padded = f" {w} "
                for i in range(len(padded) - n + 1):
                    grams[lang, n][padded[i : i + n]] += 1

    def log(counts, item):
        known = len(set().union(*counts))
        return [math.log(c[item] + 0.5) - math.log(c.total() + known / 2 + 1) for c in counts]

    by_word = [words[x] for x in langs]
    of_word = {}

    def score(w):
        if any(w in c for c in by_word):
            return log(by_word, w)
        for n in range(4, 0, -1):
            of_n, padded = [grams[x, n] for x in langs], f" {w} "
            known = [g for i in range(len(padded) - n + 1) if any((g := padded[i : i + n]) in c for c in of_n)]
            if known:
                return np.mean([log(of_n, g) for g in known], axis=0)
        return np.zeros(len(langs))

    out = []
    for text in texts:
        found = plain_words(text)
        total = sum((np.array(of_word.setdefault(w, score(w))) for w in found), np.zeros(len(langs)))
        best = int(np.argmax(total))
        out.append((langs[best], 1 / np.exp(total - total[best]).sum()) if found else ("und", 0.0))
    return out


def test_predictions_equal_a_plain_backoff(spark):
    table = {"en": "the house of and with stream", "de": "das haus und der mit größe", "hi": "नमस्ते दुनिया क्या"}
    pick = random.Random(1)
    labelled = [(" ".join(pick.choices(table[x].split(), k=12)), x) for x in ["en", "de", "hi"] * 15] * 2
    texts = ["das und", "thestream ½", "½ ① ²", "12 ½", None, "", "नमस्", "x" * 50_000, "hausen with", "haus the", "haus the", "l'été", "漢字"]
    model = langid.train(spark.createDataFrame(labelled, "text string, lang string"))
    docs = spark.createDataFrame([(i, x, "c", "d") for i, x in enumerate(texts)], "doc_id long, text string, score string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, (lang, score) in enumerate(plain_langid(labelled, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9), texts[i]


def test_every_counted_word_is_known(spark):
    words = [f"w{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(25_000)]
    model = langid.train(spark.createDataFrame([(" ".join(words), "en"), ("andere", "de")], "text string, lang string"))
    assert len(model.words[0]) == 25_001


def test_the_sample_follows_its_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 20_000)
    same = [("the same text again and again", "en")] * 4000 + [(sentence(i, 8), "de") for i in range(50)]
    drawn = langid.sample(spark.createDataFrame(same, "text string, lang string")).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    sizes = {r.lang: r.n for r in drawn}
    assert 14_000 < sizes["en"] < 26_000 and sizes["de"] == sum(len(x) for x, lang in same if lang == "de")


# --- secrets ----------------------------------------------------------------------


def test_base_spans_equal_plain_patterns(spark, tiny):
    names = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").withColumn("base", F.lit(0))
    for r in secrets.scan_secrets(docs).collect():
        text = r.text or ""
        want = [(m.start(), 0, m.end()) for m in names.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = ("assign", "access", "hex")
        assert [(s.start, kinds.index(s.kind), s.end) for s in r.base] == sorted(want)


def test_payload_of_many_stretches_takes_time_in_proportion():
    pick = random.Random(1)

    def seconds(size):
        out = bytearray()
        while len(out) < size:
            out += "some réadable words ".encode() + bytes(pick.randrange(128, 256) for _ in range(6))
        out += b" password = hunter2hunter2 \xff"
        text = f"go {base64.b64encode(bytes(out)).decode()} end"
        began = time.process_time()
        found = secrets.find_secrets(text)[1]
        assert [kind for kind, _, _ in found] == ["assign"] and len(text) - 60 < found[0][1] < found[0][2] <= len(text) - 4
        return time.process_time() - began

    assert seconds(1 << 20) < 12 * seconds(1 << 17) + 1


# --- pipeline ---------------------------------------------------------------------


def test_pipeline_keeps_the_callers_columns(spark, tmp_path):
    import corpus_pipeline

    clash = ["score", "lang_pred", "k", "n_words", "hits", "items", "base", "secrets", "redacted", "_caller", "place"]
    rows = [(i, f"{sentence(i, 60)} password=hunter2hunter2", "en" if i % 2 else "de", "s", None) for i in range(12)]
    rows += [(3, rows[3][1], "en", "z", 7), (3, rows[3][1], "en", "a", 7)]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(f"own {c}") for c in clash})
    spark.createDataFrame([(1, sentence(900, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*DOC.names, *clash], name
        got = docs.collect()
        assert all(r[c] == f"own {c}" for r in got for c in clash), name
    assert len(got) == 12 and all(r.text.endswith("[assign]") and r.n_chars == len(r.text) for r in got)
    # Of rows with one id and text the least of the other columns stays: null sorts first.
    assert [r.source for r in got if r.doc_id == 3] == ["a"]
