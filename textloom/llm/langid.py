"""Language identification by words first, then shorter and shorter character n-grams.

Counts of words per language are taken over the training rows; counts of character
n-grams follow from the counts of words. A known word scores by its log frequency in each
language. An unknown word scores by the longest n-grams of it that are known: it starts at
``MAX_GRAM`` characters and backs off until some n-gram of that length is known.

The model is what is broadcast, and it holds every word and n-gram that was counted. Its
size is bounded by what it is fitted on: of each language a sample of labelled rows, drawn
by a hash of the text and the row's place, of about ``SAMPLE_BYTES`` bytes (all rows where a language has no
more); texts of more than ``SAMPLE_TEXT`` bytes are not drawn. Prediction reads every row
and whole texts.

Letters are the characters of the Unicode categories L; a mark (M) goes on with the word that
it follows. A text that is null or has no letter, or a model without languages, gives ``und``
with score 0. Equal scores go to the language that sorts first. Rows are predicted by
themselves.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm.common import map_texts
from textloom.sources.tables import checkpoint

#: Bytes of the labelled texts of a language that the model is fitted on, and of one text.
SAMPLE_BYTES, SAMPLE_TEXT = 4 << 20, 1 << 18
MAX_GRAM = 4
#: Words counted in a task before they are handed on.
BUFFER = 1 << 18
#: Words whose scores are remembered in a task.
CACHE = 1 << 17
UNDETERMINED = "und"


@functools.cache
def word_pattern() -> re.Pattern:
    """A letter, then letters and marks. Of the standard classes only ``[^\\W\\d_]`` comes near,
    which also takes numerals such as a half; those that are no letters are taken out."""
    odd, marks = [], []
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "M":
            marks.append(chr(c))
        elif kind != "L" and re.match(r"[^\W\d_]", chr(c)):
            odd.append(chr(c))
    letter = f"(?:(?![{_spans(odd)}])[^\\W\\d_])"
    return re.compile(f"{letter}(?:{letter}|[{_spans(marks)}])*")


def _spans(chars: list[str]) -> str:
    """Characters as ranges of a class."""
    out = []
    for _, run in itertools.groupby(enumerate(map(ord, chars)), lambda x: x[1] - x[0]):
        places = [c for _, c in run]
        out.append(f"\\U{places[0]:08x}-\\U{places[-1]:08x}")
    return "".join(out)


PLAIN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    text = text.lower()
    # Where no mark and no numeral can be, the plain class finds the same words.
    return (PLAIN if text.isascii() or not ODD.search(text) else word_pattern()).findall(text)


#: Outside of what most texts hold: beyond Latin, Greek and Cyrillic letters, and signs below.
ODD = re.compile("[\xaa-\xbf\u0300-\u036f\u0483-\uffff\U00010000-\U0010ffff]")


def _flush(counts: Counter, names: list[str]):
    columns = list(zip(*counts)) if counts else [[] for _ in names[:-1]]
    arrays = [pa.array(list(c), pa.int32() if name == "size" else pa.string()) for c, name in zip(columns, names)]
    yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), pa.int64())], names=names)
    counts.clear()


def _count_words(batches):
    counts: Counter = Counter()
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            for word, n in Counter(words(text.as_py() or "")).items():
                counts[lang, word] += n
            if len(counts) >= BUFFER:
                yield from _flush(counts, ["lang", "word", "n"])
    yield from _flush(counts, ["lang", "word", "n"])


def _weighted_grams(words: list[str], n: np.ndarray):
    """Sums of n over the n-grams of words: (size, gram, sum), by sorting packed codes."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letters, codes = np.unique(points, return_inverse=True)
    if len(letters) >= 1 << 15 and len(words) > 1:
        half = len(words) // 2
        yield from _weighted_grams(words[:half], n[:half])
        yield from _weighted_grams(words[half:], n[half:])
        return
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    packed = np.zeros(len(codes), np.int64)
    for size in range(1, MAX_GRAM + 1):
        m = len(codes) - size + 1
        if m <= 0:
            return
        packed = (packed[:m] << 15) | codes[size - 1 :]
        inside = owner[:m] == owner[size - 1 :]
        grams, at = np.unique(packed[inside], return_inverse=True)
        sums = np.bincount(at, n[owner[:m][inside]], len(grams)).astype(np.int64)
        chars = [letters[(grams >> (15 * k)) & 0x7FFF] for k in range(size - 1, -1, -1)]
        flat = np.stack(chars, axis=1).astype("<u4").tobytes().decode("utf-32-le")
        for i, total in enumerate(sums.tolist()):
            yield size, flat[i * size : (i + 1) * size], total


def _count_grams(batches):
    counts: Counter = Counter()
    for batch in batches:
        langs, words, n = (c.to_pylist() for c in batch.columns)
        weights = np.array(n, np.int64)
        for lang in dict.fromkeys(langs):
            mine = [i for i, x in enumerate(langs) if x == lang]
            for size, gram, total in _weighted_grams([words[i] for i in mine], weights[mine]):
                counts[lang, size, gram] += total
            if len(counts) >= BUFFER:
                yield from _flush(counts, ["lang", "size", "gram", "n"])
    yield from _flush(counts, ["lang", "size", "gram", "n"])


class Model:
    """Log frequencies of words and n-grams in every language."""

    def __init__(self, langs, word_counts, gram_counts, word_totals, gram_totals):
        self.langs = sorted(langs)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.words = self._logs(((w, at[x], n) for w, x, n in word_counts), [word_totals.get(x, 0) for x in self.langs])
        self.tables = {}
        for size in range(1, MAX_GRAM + 1):
            rows = ((g, at[x], n) for k, g, x, n in gram_counts if k == size)
            self.tables[size] = self._logs(rows, [gram_totals.get((x, size), 0) for x in self.langs])

    @staticmethod
    def _logs(rows, totals) -> tuple[dict[str, int], np.ndarray]:
        """Place of every item, and its log frequencies there."""
        places: dict[str, int] = {}
        found = [(places.setdefault(item, len(places)), lang, n) for item, lang, n in rows]
        counts = np.zeros((len(places), len(totals)))
        for place, lang, n in found:
            counts[place, lang] = n
        below = np.array([math.log(t + len(places) / 2 + 1) for t in totals])
        return places, np.log(counts + 0.5) - below

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies per word; unknown words back off to n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        places, table = self.words
        at = np.array([places.get(word, -1) for word in words], np.int64)
        out[at >= 0] = table[at[at >= 0]]
        todo = np.flatnonzero(at < 0).tolist()
        for size in range(MAX_GRAM, 0, -1):
            places, table = self.tables[size]
            get, rows, counts, left, scored = places.get, [], [], [], []
            for i in todo:
                padded = f" {words[i]} "
                found = [k for j in range(len(padded) - size + 1) if (k := get(padded[j : j + size])) is not None]
                if found:
                    rows += found
                    counts.append(len(found))
                    scored.append(i)
                else:
                    left.append(i)
            if scored:
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                out[scored] = np.add.reduceat(table[rows], starts, axis=0) / np.array(counts)[:, None]
            todo = left
        return out


def sample(labelled: DataFrame) -> DataFrame:
    """(text, lang) of the rows that the model is fitted on; see the top."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = rows.where(F.octet_length("text") <= SAMPLE_TEXT)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # one per language
    if not sizes:
        return rows
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, SAMPLE_BYTES / max(1, n)))))
    # The place of a row takes part, so that of many copies a share is drawn, not all or none.
    even = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("even", even).where(F.col("even") < F.element_at(share, F.col("lang"))).drop("even")


def _listed(rows: DataFrame) -> list[tuple]:
    """Rows in order, brought over as columns."""
    return sorted(zip(*(c.to_pylist() for c in rows.toArrow().columns)))


def train(labelled: DataFrame) -> Model:
    """A model of rows (text, lang); rows without a language are left out."""
    schema = "lang string, word string, n long"
    langs = [r.lang for r in labelled.where("lang IS NOT NULL").select("lang").distinct().collect()]
    counts = checkpoint(sample(labelled).mapInArrow(_count_words, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    pieces = counts.mapInArrow(_count_grams, "lang string, size int, gram string, n long")
    pieces = checkpoint(pieces.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_totals = {(r.lang, r["size"]): r.n for r in pieces.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    # As many rows as the sample's bytes allow, a bound that does not grow with the corpus.
    found = (_listed(x.select(*names)) for x, names in ((counts, ("word", "lang", "n")), (pieces, ("size", "gram", "lang", "n"))))
    return Model(langs if totals else [], *found, totals, gram_totals)


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Documents with ``lang_pred`` and ``score``, the model's posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        places: dict[str, int] = {}
        table = np.zeros((0, len(model.langs)))

        def learn(lists):
            """Scores of the words of a slice that are not remembered yet."""
            nonlocal table
            new = list(dict.fromkeys(w for found in lists for w in found if w not in places))
            if len(places) + len(new) > CACHE:
                places.clear()
                table = table[:0]
                new = list(dict.fromkeys(w for found in lists for w in found))
            if new:
                places.update((w, len(table) + i) for i, w in enumerate(new))
                table = np.concatenate([table, model.scores(new)])

        def work(data, offsets):
            raw, at = data.tobytes(), offsets.tolist()
            lists = [words(raw[a:b].decode()) for a, b in zip(at, at[1:])]
            preds, scores = [], []
            if model.langs:
                learn(lists)
            for found in lists:
                if not found or not model.langs:
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = table[[places[w] for w in found]].sum(axis=0)
                best = int(np.argmax(total))
                preds.append(model.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            return {"lang_pred": preds, "score": scores}

        return work

    return map_texts(docs, make, ADDED, docs.columns if keep is None else keep)


def held_out(doc_id) -> "F.Column":
    """Rows that are never trained on: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_fold(docs: DataFrame) -> Model:
    """Learn from the rows that are not held out; a row without an id is not learned from."""
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
