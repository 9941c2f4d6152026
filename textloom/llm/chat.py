"""Chat formatting from an event log.

A conversation is a log of events (conv_id, message, seq, op, role, text). Events are
partitioned by conversation and message, sorted by sequence, and folded: ``delta`` appends
to the message, ``edit`` replaces it, ``regenerate`` starts it anew, ``delete`` drops it;
other ops change nothing. The role is the last one that is not null. Folding holds one
message at a time, so a conversation of any length spreads over tasks. Rendering then
streams through the messages of each conversation in order and cuts long conversations
into parts of about ``PART_CHARS`` characters.

Template: every turn stands in ``<s>...</s>``, user texts in ``[INST] ... [/INST]``,
system texts in ``<<SYS>> ... <</SYS>>``, texts of other roles after ``[ROLE]role[/ROLE]``.
Inside texts, backslash, ``<`` and ``[`` are written ``\\\\``, ``\\l`` and ``\\b``, so no text can
hold a control string and every text can be read back. The loss mask is a list of spans of
the formatted text: the assistant's texts.

Nulls: a null text is empty, a null role is the empty role, a null conv_id or message is a
value of its own and sorts first. Turns that repeat a (conv_id, turn) are turns of their
own, in the order of role and text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PART_CHARS = 1 << 20
PIECE_CHARS = 512
DRAFT = "[draft, to be replaced]"
MESSAGE = "conv_id bigint, message bigint, role string, text string"
PART = "conv_id bigint, part int, formatted string, loss array<struct<start: bigint, end: bigint>>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

_OUT = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {"\\": "\\", "l": "<", "b": "["}
WRAP = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("", "")}
TURN = re.compile(
    r"<s>(?:\[INST\] (?P<user>[^<\[]*) \[/INST\]|<<SYS>> (?P<system>[^<\[]*) <</SYS>>"
    r"|\[ROLE\](?P<role>[^<\[]*)\[/ROLE\](?P<other>[^<\[]*)|(?P<assistant>[^<\[]*))</s>"
)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def log_of_turns(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as a log with one delta per turn."""
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    key = turns.select("conv_id", F.col("turn").alias("message"), "role", "text", F.row_number().over(order).alias("copy"))
    return key.select("conv_id", "message", "copy", F.lit(0).cast("long").alias("seq"), F.lit("delta").alias("op"), "role", "text")


def log_of_edits(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as the log that streaming them would leave.

    Every turn begins as a draft. An assistant's is regenerated and streamed anew in deltas
    of ``PIECE_CHARS`` characters; that of any other role is edited to its first piece, and
    deltas bring the rest. Events come latest first, so only sorting by ``seq`` gives the text.
    Cutting is linear in the text; an empty or null text is one empty piece.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    again = F.coalesce(F.col("role") == "assistant", F.lit(False))
    none = F.lit(None).cast("string")

    def event(seq, op, role, text):
        return F.struct(seq.cast("long").alias("seq"), op.alias("op"), role.alias("role"), text.alias("text"))

    first = event(F.lit(0), F.lit("delta"), F.col("role"), F.lit(DRAFT))
    second = event(F.lit(1), F.when(again, "regenerate").otherwise("edit"), none, F.when(~again, F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))))
    rest = F.slice("pieces", F.when(again, 1).otherwise(2), F.greatest(F.size("pieces"), F.lit(1)))
    deltas = F.transform(rest, lambda piece, i: event(i + 2, F.lit("delta"), none, piece))
    # A regenerated message of no piece still is a message.
    empty = F.when(again & (F.size("pieces") == 0), F.array(event(F.lit(2), F.lit("delta"), none, F.lit("")))).otherwise(deltas)
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    key = turns.select("conv_id", F.col("turn").alias("message"), "role", found.alias("pieces"), F.row_number().over(order).alias("copy"))
    return key.select("conv_id", "message", "copy", F.inline(F.reverse(F.concat(F.array(first, second), empty))))


def _schema(ddl: dict) -> pa.Schema:
    return pa.schema(list(ddl.items()))


def _rows(batches, size=1024):
    """Rows as tuples, a bounded number of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def _emit(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, copy, role, text); a log without ``copy`` has none."""
    events = events if "copy" in events.columns else events.withColumn("copy", F.lit(0))
    key = ["conv_id", "message", "copy"]
    log = events.select(*key, "seq", "op", "role", "text").repartition(*key).sortWithinPartitions(*key, "seq", "op", "text")
    kind = _schema({"conv_id": pa.int64(), "message": pa.int64(), "copy": pa.int32(), "role": pa.string(), "text": pa.string()})

    def run(batches):
        at, role, parts, alive, out, held = None, None, [], False, [], 0

        def done():
            return (*at, role or "", "".join(parts))

        for *now, _, op, new_role, text in _rows(batches):
            if now != at:
                if alive:
                    out.append(done())
                    held += len(out[-1][-1])
                    if held >= PART_CHARS or len(out) >= 4096:
                        yield _emit(out, kind)
                        out, held = [], 0
                at, role, parts, alive = now, None, [], False
            role = role if new_role is None else new_role
            if op == "delta":
                parts.append(text or "")
                alive = True
            elif op == "edit":
                parts, alive = [text or ""], True
            elif op == "regenerate":
                parts, alive = [], True
            elif op == "delete":
                parts, alive = [], False
        if alive:
            out.append(done())
        if out:
            yield _emit(out, kind)

    types = "conv_id bigint, message bigint, copy int, role string, text string"
    return log.withColumn("copy", F.col("copy").cast("int")).mapInArrow(run, types)


def render(messages: DataFrame) -> DataFrame:
    """Formatted conversations in parts, with the loss mask of each part."""
    sort = ["conv_id", "message", "copy"]
    rows = messages.select(*sort, "role", "text").repartition("conv_id").sortWithinPartitions(*sort)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = _schema({"conv_id": pa.int64(), "part": pa.int32(), "formatted": pa.string(), "loss": pa.list_(span)})

    def run(batches):
        at, part, texts, size, loss, out, held = None, 0, [], 0, [], [], 0
        open_ = False
        for conv, _, _, role, text in _rows(batches):
            if open_ and (conv != at or size >= PART_CHARS):
                out.append((at, part, "".join(texts), loss))
                held += size
                part, texts, size, loss = (part + 1 if conv == at else 0), [], 0, []
                if held >= PART_CHARS or len(out) >= 4096:
                    yield _emit(out, kind)
                    out, held = [], 0
            at, open_ = conv, True
            head, tail = WRAP.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "")
            body = escape(text)
            if role == "assistant":
                start = size + len("<s>") + len(head)
                loss.append({"start": start, "end": start + len(body)})
            texts.append(f"<s>{head}{body}{tail}</s>")
            size += len(texts[-1])
        if open_:
            out.append((at, part, "".join(texts), loss))
        if out:
            yield _emit(out, kind)

    return rows.mapInArrow(run, PART)


def parse(formatted: str):
    """Turns (role, text) of a formatted part."""
    at = 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        kind = m.lastgroup
        yield (unescape(m["role"]) if kind == "other" else kind), unescape(m[kind])
    if at != len(formatted):
        raise ValueError("not a formatted conversation")


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what the formatted parts hold, a row per conversation.

    A digest is taken over the parts in order, so it streams; nothing of a conversation is
    held but the state of two hashes.
    """
    kind = _schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})

    def run(batches):
        at, open_, out = None, False, []
        n = chars = size = 0
        turns = loss = None

        def done():
            return at, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for conv, _, formatted, spans in _rows(batches, 16):
            if not open_ or conv != at:
                if open_:
                    out.append(done())
                    if len(out) >= 4096:
                        yield _emit(out, kind)
                        out = []
                at, open_, n, chars, size = conv, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in parse(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = unescape(formatted[span["start"] : span["end"]])
                chars += len(text)
                loss.update(text.encode())
            size += len(formatted)
        if open_:
            out.append(done())
        if out:
            yield _emit(out, kind)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGEST)
