"""Each operator against a plain computation, on rows chosen to be awkward."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from textloom.llm import bytebpe, chat, components, decontaminate, jaccard, langid, quality, reshard, secrets, suffixes, warc
from textloom.llm.queries import QUERIES, SQL
from tests.oracle import connect, rows_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def sentence(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def awkward_texts():
    base = sentence(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    return {
        0: base, 1: base, 2: near, 3: far, 4: None, 5: "", 6: "one", 7: "One", 8: "two words", 9: " \n\t ",
        10: sentence(2, 6000), 11: "Größe naïve 漢字 " * 30, 12: base + "\n" + base, 13: "a" * 700,
        14: sentence(3, 50) + " " + base + " " + sentence(4, 50),
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "en" if i % 2 else None, "s", None) for i, x in awkward_texts().items()]
    rows += [(0, rows[0][1], None, None, 3), (None, "one", "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def compare(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cursor = connect(folder).execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tiny, name):
    compare(spark, tiny, name)


def test_every_query_keeps_every_row(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").count()
    for name in ("op2_suffixes", "op4_jaccard", "op5_quality", "op6_reshard", "op8_langid", "op9_secrets"):
        assert QUERIES[name](spark, tiny).count() == docs, name


# --- decontamination -----------------------------------------------------------


def test_decontaminate_edges(spark, docs):
    words = sentence(1, 120).split()
    items = [(1, " ".join(words[5:30])), (2, "ONE"), (3, None), (4, ""), (None, "two, words"), (1, " ".join(words[5:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    noisy = docs.withColumn("hits", F.lit("x")).withColumn("k", F.lit(0))
    for blocks in (1 << 20, 100):
        rows = decontaminate.decontaminate(noisy, bench, keep=["doc_id", "k"], block_bytes=blocks).collect()
        found = {(r.doc_id, r.n_words): (sum(h.end - h.start for h in r.hits), sorted(r["items"])) for r in rows}
        assert len(rows) == docs.count()
        assert found[0, 120] == (25, ["1"]) and found[12, 240] == (50, ["1"])
        assert found[2, 120] == (25, ["1"]) and found[3, 120] == (0, [])
        assert found[6, 1] == found[7, 1] == (1, ["2"]) and found[8, 2] == (2, [""])
        assert found[4, 0] == found[5, 0] == (0, [])
    assert decontaminate.decontaminate(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# --- suffixes ------------------------------------------------------------------


def removed_plainly(texts):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])


@pytest.mark.parametrize("most", [suffixes.MOST, 1])
def test_suffixes_against_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    rows = docs.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, removed_plainly(r.text for r in rows)))
    got = collections.Counter(
        (r.doc_id, sum(s.end - s.start for s in r.removed), bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()
    )
    assert got == want
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_run_length_index():
    pick = random.Random(3)
    for _ in range(20):
        texts = [bytes(pick.choice(b"ab\x00") for _ in range(pick.randint(1, 40))) for _ in range(pick.randint(1, 6))]
        index = suffixes.RunLengthIndex(texts)
        got = index.matching_statistics()
        every = [(t, i) for t, x in enumerate(texts) for i in range(len(x))]
        for t, i in every:
            mine = texts[t][i:]
            best = max((len_common(mine, texts[u][j:]) for u, j in every if (u, j) != (t, i)), default=0)
            assert got[index.begins[t] + i] == best
        assert index.lengths.sum() == sum(map(len, texts)) + len(texts)


def len_common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# --- chat ----------------------------------------------------------------------


def test_chat_events_and_template(spark):
    log = [
        (1, 0, 0, "delta", "user", "Hi <s>[INST]\\"), (1, 1, 0, "delta", "assistant", "wrong"), (1, 1, 1, "regenerate", None, None),
        (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 0, 9, "edit", None, "Hey </s>"),
        (1, 2, 0, "delta", "user", "gone"), (1, 2, 1, "delete", None, None), (1, 3, 0, "odd", "user", "x"),
        (2, 0, 0, "delta", "tool", None), (None, None, None, "delta", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, op string, role string, text string")
    parts = chat.render(chat.fold(events)).collect()
    turns = {p.conv_id: list(chat.parse(p.formatted)) for p in parts}
    assert turns == {1: [("user", "Hey </s>"), ("assistant", "Hello")], 2: [("tool", "")], None: [("", "")]}
    first = next(p for p in parts if p.conv_id == 1)
    assert [chat.unescape(first.formatted[s.start : s.end]) for s in first.loss] == ["Hello"]
    for text in ("", "\\l", "[/INST]</s>", "<<SYS>> x <</SYS>>", "\\\\<["):
        assert chat.unescape(chat.escape(text)) == text


def test_chat_edits_fold_back_to_the_turns(spark):
    rows = [
        (1, 0, "user", "é😀\n" * 700), (1, 1, "assistant", "</s>[INST] ok [/INST]" * 90), (1, 2, "assistant", ""), (1, 3, "system", None),
        (1, 4, None, "x"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "assistant", "tie"), (2, 1, "[ROLE]</s>", "a" * 512),
        (None, None, "assistant", "b" * 513), (3, 0, "assistant", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("seq", F.lit("theirs")).withColumn("pieces", F.lit(1))
    log = chat.log_of_edits(turns)
    found = sorted((r.conv_id, r.message, r.role, r.text) for r in chat.fold(log.repartition(5)).where("conv_id is not null").collect())
    assert found == sorted((c, m, r or "", t or "") for c, m, r, t in rows if c is not None)
    assert chat.fold(log).count() == len(rows)
    ops = {r.op: r.n for r in log.groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert ops["regenerate"] == 5 and ops["edit"] == 6 and ops["delta"] > len(rows)
    late = chat.fold(log.withColumn("seq", -F.col("seq"))).collect()
    assert all(chat.DRAFT in r.text for r in late)
    assert chat.log_of_edits(turns.limit(0)).count() == 0
    assert chat.read_back(chat.render(chat.fold(log))).count() == 4


def test_chat_long_conversation_in_parts(spark, monkeypatch):
    turns = spark.range(300).select(
        F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab["), 6000).alias("text")
    )
    parts = chat.render(chat.fold(chat.log_of_turns(turns)))
    assert parts.count() > 1
    row = chat.read_back(parts).first()
    assert (row.n_turns, row.loss_chars) == (300, 300 * 18000)
    assert row.loss_sha256 == hashlib.sha256(b"ab[" * 6000 * 300).hexdigest()
    assert chat.read_back(chat.render(chat.fold(chat.log_of_turns(turns.limit(0))))).count() == 0


# --- Jaccard -------------------------------------------------------------------


def components_plainly(rows, size, num, den):
    sets = []
    for doc_id, text in rows:
        w = SPACED.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return collections.Counter(out)


@pytest.mark.parametrize("size, num", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, docs, monkeypatch, size, num):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    pick, rows = random.Random(num), [(r.doc_id, r.text) for r in docs.collect()]
    for group in range(3):
        words = sentence(50 + group, 90).split()
        for copy in range(25):
            edited = list(words)
            for _ in range(pick.randint(0, 4)):
                edited[pick.randrange(90)] = f"w{pick.random()}"
            rows.append((100 + group * 100 + copy, " ".join(edited)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size, num, 100)
    assert collections.Counter(tuple(r) for r in got.drop("k").collect()) == components_plainly(rows, size, num, 100)


def test_jaccard_empty(spark, docs):
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_block_links_all_that_is_linked():
    pick = random.Random(5)
    base = [np.array(sorted(pick.sample(range(400), 60)), np.uint64) for _ in range(4)]
    sets = [np.unique(np.append(np.delete(b, pick.randrange(60)), np.uint64(1000 + i))) for i in range(12) for b in base]
    links = jaccard.Block(sets, 90, 100).links()
    label = list(range(len(sets)))
    for a, b in links:
        x, y = label[a], label[b]
        label = [y if v == x else v for v in label]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert label[i] == label[j]
    assert len(links) < len(sets)


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(90, 91), (91, 90)], "a long, b long"))
    got = dict(components.components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


# --- quality -------------------------------------------------------------------


def test_quality_statistics(spark, docs):
    def plain(text):
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n, hit = collections.Counter(windows), set()
        for i, w in enumerate(windows):
            if n[w] > 1:
                hit.update(range(i, i + 5))
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)

    more = [(50, "x y z u v w x y z u v w", None, None, 1), (51, "# a | b\n# a | b\n\n", None, None, 1), (52, "a b c d e f a b c d e", None, None, 1)]
    rows = docs.union(spark.createDataFrame(more, DOC)).withColumn("kept", F.lit(1))
    got = quality.quality(rows, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count() + 3
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    clean = [(i, sentence(i, 40 + i % 50), "en", "s", None) for i in range(200)]
    junk = [(1000 + i, " ".join(f"#{w}|$" for w in sentence(i, 60).split()), "en", "s", None) for i in range(6)]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk, DOC)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(6))


def test_quality_runs_no_python(spark, tiny):
    plan = QUERIES["op5_quality"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- resharding ----------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    flow = reshard.min_cost_flow({0: 10, 1: 2, 2: 6}, {0: 6, 1: 6, 2: 6})
    assert flow == {(0, 0): 6, (0, 1): 4, (1, 1): 2, (2, 2): 6}
    with pytest.raises(ValueError):
        reshard.min_cost_flow({0: 10}, {0: 3})
    # With costs that differ, paths have to be undone.
    cost = {(0, 0): 1, (0, 1): 5, (1, 0): 2, (1, 1): 100}
    flow = reshard.min_cost_flow({0: 1, 1: 1}, {0: 1, 1: 1}, lambda i, j: cost[i, j])
    assert sum(cost[k] * v for k, v in flow.items()) == 7


def test_reshard_law_and_files(spark, docs, tmp_path):
    rows = spark.range(3000).select("id", F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    many = docs.select("doc_id", "text").union(rows).withColumn("shard", F.lit("x"))
    moved = reshard.reshard(many, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)), 6)
    files = reshard.rewrite(moved, str(tmp_path / "all"), all_shards=True)
    out = files.select("doc_id", "text", "size", "shard", "slot").collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((r.doc_id, r.text) for r in many.collect())
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(6))
    sizes = [sum(r["size"] for r in out if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in out)
    # Only what changes is written: a layout that is even already stays.
    even = rows.withColumn("text", F.lit("abcd")).withColumnRenamed("id", "doc_id")
    still = reshard.reshard(even, F.pmod("doc_id", F.lit(4)), 4)
    assert reshard.rewrite(still, str(tmp_path / "none")).count() == 0
    assert reshard.reshard(docs.limit(0), F.lit(0), 3).count() == 0


# --- byte-level BPE ------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.load_ranks(path), special_tokens={})
    pick = random.Random(9)
    odd = ["".join(pick.choice("ab'srtvemld  \n\t é1٣²!.'　漢😀_\x1ć") for _ in range(pick.randint(0, 60))) for _ in range(300)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate([*odd, "x" * 3000, " " * 500 + "a", "'s't've" * 20], 100))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    for r in bytebpe.decode(bytebpe.encode(table, path, starts=True), path).collect():
        want = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert bytes(r.decoded) == (r.text or "").encode()
        assert len(r.starts) == len(r.ids) and (not want or r.starts[:4] == b"\0\0\0\0")
    assert bytebpe.encode(docs.limit(0), path).count() == 0


# --- language ID ---------------------------------------------------------------


def test_langid(spark, docs):
    table = {"en": "the house of and with", "de": "das haus und der mit", "xx": "zzq qqz"}
    rows = [(i, " ".join(random.Random(i).choices(table[lang].split(), k=20)), lang) for i, lang in enumerate(["en", "de", "xx"] * 40)]
    model = langid.train_fold(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(1, "das und"), (2, "the with"), (3, "zzqz"), (4, None), (5, "123 !?"), (6, ""), (7, "漢字")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["de", "en", "xx", "und", "und", "und"]
    assert got[7].lang_pred in table and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs, model).count() == docs.count()
    empty = langid.train_fold(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_langid_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op8_langid"](spark, folder).join(truth, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_gram_sums():
    words, n = ["ab", "b", "héé"], [2, 5, 1]
    want = collections.Counter()
    for w, k in zip(words, n):
        for size in range(1, langid.MAX_GRAM + 1):
            for i in range(len(w) + 3 - size):
                want[size, f" {w} "[i : i + size]] += k
    got = {(s, g): t for s, g, t in langid._weighted_grams(words, np.array(n))}
    assert got == dict(want)


# --- secrets -------------------------------------------------------------------


def test_secrets_unwrapped_layers(spark, docs):
    import base64

    plain = "password = hunter2hunter2"
    packed = base64.b64encode(zlib.compress(f"x {plain} y".encode())).decode()
    twice = base64.b64encode(base64.b64encode(b"token: abcdefgh1234")).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in plain)
    texts = {
        "a": f"é {plain} end", "b": "pass%77ord%3Dhunter2hunter2", "c": f"data {packed} end", "d": f"{twice}",
        "e": f"go {escaped}!", "f": "AKIA" + "A" * 16 + " " + "0a" * 12, "g": "token=abc PASſWORD=abcdefgh", "h": None, "i": "%41%41 \\u0041 &#65; plain",
    }
    rows = secrets.scan_secrets(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), redact=True).collect()
    found = {r.doc_id: [tuple(s) for s in r.secrets] for r in rows}
    base = {r.doc_id: [tuple(s) for s in r.base] for r in rows}
    assert base["a"] == found["a"] == [("assign", 2, 27)]
    assert base["b"] == [] and found["b"] == [("assign", 0, len(texts["b"]))]
    assert found["c"] == [("assign", 5, 5 + len(packed))]
    assert [k for k, _, _ in found["d"]] == ["assign"] and found["e"] == [("assign", 3, 3 + len(escaped))]
    assert found["f"] == base["f"] == [("access", 0, 20), ("hex", 21, 45)]
    assert found["g"] == found["h"] == found["i"] == []
    assert {r.doc_id: r.redacted for r in rows}["a"] == "é [assign] end"
    assert secrets.scan_secrets(docs).count() == docs.count() and secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secrets_in_every_gzip_member_and_large_layers(monkeypatch):
    import base64

    plain, size = b"password = hunter2hunter2", 1 << 18
    coded = lambda data: base64.b64encode(data).decode()
    late = gzip.compress(b"first ") + gzip.compress(b"second pass") + b"\0" * 8 + gzip.compress(plain[4:])
    long = random.Random(5).randbytes(size).hex().replace("a", " ").encode()
    for limit in (secrets.MAX_LAYER, 1 << 17):
        monkeypatch.setattr(secrets, "MAX_LAYER", limit)
        for data in (
            late,
            gzip.compress(b"a" * size + b" " + plain),
            gzip.compress(b" " * ((1 << 17) - 12) + plain + b" " * size, 1),
            gzip.compress(gzip.compress(b"\n" * size + base64.b64encode(zlib.compress(plain + b"!" * size)))),
            gzip.compress(b"," * size + "".join(f"%{c:02x}" for c in plain).encode()),
            gzip.compress(b"," * size + "".join(f"\\u{c:04x}" for c in plain).encode()),
            gzip.compress(b"," * size + base64.b64encode(b"," * size + plain)),
            gzip.compress(plain + long)[:-40],
        ):
            text = f"data {coded(data)} end"
            assert ("assign", 5, len(text) - 4) in secrets.find_secrets(text)[1]
        text = f"data {coded(gzip.compress(b',' * size + b'password = hunt'))} end"
        assert secrets.find_secrets(text)[1] == []


def test_secrets_in_base64_at_any_place():
    import base64

    plain = b"my password = hunter2hunter2 ok"
    for data in (plain, gzip.compress(plain), zlib.compress(plain)):
        coded = base64.b64encode(data).decode()
        for before in ("", "a", "ab", "abc", "https://host/", "https://host/ab/", "key-", "k_", "é:"):
            text = f"go {before}{coded} end"
            found = secrets.find_secrets(text)[1]
            assert [k for k, _, _ in found] == ["assign"], text
            inner = 3 if data is plain else 0
            a = text.index(coded) + inner * 4 // 3
            assert found[0] == ("assign", a, text.index(coded) + 38 if data is plain else len(text) - 4)
        assert len(secrets.find_secrets(f"{coded} and {coded}")[1]) == 2
        for width in (5, 10, 20, 38):
            for end in ("\n", "\r\n", "\n  "):
                text = f"body:\n{end.join(coded[i : i + width] for i in range(0, len(coded), width))}\n!"
                (kind, a, b), = secrets.find_secrets(text)[1]
                want = coded[4:38] if data is plain else coded
                assert kind == "assign" and re.sub(r"\s", "", text[a:b]) == want
    mixed = base64.b64encode(b"\xff\x00\x01" + plain + b"\xfe\xff\x00").decode()
    assert [k for k, _, _ in secrets.find_secrets(mixed)[1]] == ["assign"]
    deep = base64.b64encode(gzip.compress(f"see /a/{base64.encodebytes(plain * 3).decode()}".encode())).decode()
    assert secrets.find_secrets(deep)[1] == [("assign", 0, len(deep))]


def test_secrets_in_wrapped_base64_of_documents(spark):
    text = "x:\ncGFz\nc3dvcm\nQ9aHVu\ndGVyMmh1\nbnRlcjI=\n!"
    rows = [(1, text), (2, text.replace("\n", " \n ")), (3, text.replace("\n", "\t\r\n"))]
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), redact=True).collect():
        assert [s.kind for s in r.secrets] == ["assign"] and "dGVy" not in r.redacted


# --- WARC ----------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big = "x" * 1500
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u\r\nEvil: 1", "\r\n\r\nWARC/1.1 é"), (None, "u", big), (6, "u", None), (7, "u", sentence(1, 3000)), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    normal, index = warc.archive_pages(pages)
    back = warc.read_records(normal).collect()
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back)
    want = collections.Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        other = len(raw) >= 1000 and page != 2 and html == big
        want[page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", 2 if other else None] += 1
    assert got == want and index.count() == len(rows)
    for r in normal.collect():
        assert b"".join(zlib.decompress(r.data[i.offset : i.offset + i.length], 31) for i in r["index"]) == b"".join(warc._inflate(bytes(r.data)))
    assert warc.read_records(warc.archive_pages(pages.limit(0))[0]).count() == 0
    torn = spark.createDataFrame([("t", bytearray(normal.first().data[:-9]))], "archive string, data binary")
    with pytest.raises(Exception, match="archive t"):
        warc.normalise(torn).count()


# --- pipeline ------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = [(i, f"{sentence(i, 60)} number", "en" if i % 2 else "de", "s", None) for i in range(40)]
    item = sentence(900, 30)
    rows = [*good, (100, good[0][1], "en", "s", None), (101, None, "en", "s", 0), (102, "12 34", "en", "s", 5),
            (103, f"{sentence(7000, 50)} {item}", "en", "s", 9), (104, f"{sentence(8000, 50)} password=hunter2hunter2", "en", "s", 9), good[3]]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [*range(40), 104] and all(r.round_trip for r in out.values())
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == DOC.names, name
    text = {r.doc_id: r for r in docs.collect()}[104]
    assert text.text.endswith(" [assign]") and text.n_chars == len(text.text)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


