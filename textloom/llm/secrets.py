"""Secret scans with a recursive decoding worklist.

A text is a layer. Each layer is scanned, then unwrapped: percent escapes, Unicode and
character-reference escapes, runs of base64 at all four alignments (line ends do not break
a run, unreadable bytes are left out), and gzip or zlib data anywhere inside those. Each
result is a new layer on the worklist, with the place in the original text that every one
of its characters stands for. A layer that was seen before at the same place is not taken
again, which ends cycles; the work stops when no new layer appears.

Spans count code points of the original text. A null or empty text has none. Rows are
scanned by themselves, so repeated rows get equal results.

Everything inside compressed data stands for the one span of that data, so such a layer is
kept as bytes and only the kinds in it matter. One of more than ``MAX_LAYER`` bytes is a
temporary file without a name, mapped into memory page by page: it is worked on whole, and
memory does not follow its size.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import re
import tempfile
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, types as T

from textloom.llm.common import map_texts, word_spans

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
MIN_BASE64 = 16


def _either(word: str) -> str:
    """ASCII letters in either case; re.IGNORECASE would also take other letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_DIGIT = "[A-Za-z0-9+/_-]"
#: Runs of base64 digits, joined where only line ends (and blanks around them) break them.
BASE64 = re.compile(rf"(?<!{_DIGIT})(?:{_DIGIT}{{{MIN_BASE64},}}+|{_DIGIT}++(?=[ \t]*[\r\n]))(?:[ \t]*+[\r\n][ \t\r\n]*+{_DIGIT}++)*+={{0,2}}")
#: Readable text; no secret and no base64 of one is shorter, and all are ASCII.
STRETCH = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]{12,}")
ASCII_STRETCH = re.compile(r"[\t\n\r\x20-\x7e]{12}")
ASCII_STRETCH_B = re.compile(ASCII_STRETCH.pattern.encode())
INDENTED = re.compile(rb"[ \t][\r\n]|[\r\n][ \t]")

#: The same patterns on UTF-8; long runs are taken without memory for going back.
ASSIGN_B, ACCESS_B, HEX_B, BASE64_B = (re.compile(x.pattern.encode()) for x in (ASSIGN, ACCESS, HEX, BASE64))
PERCENT_B = re.compile(PERCENT.pattern.encode() + b"+")
ESCAPE_B = re.compile(ESCAPE.pattern.encode().replace(b"{4})+", b"{4})++"))
ZLIB = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes((a, b))) for a in range(8, 0x80, 16) for b in range(256) if not b & 32 and (a * 256 + b) % 31 == 0), re.DOTALL)

HEX_BYTES = np.zeros(256, bool)
HEX_BYTES[list(b"0123456789abcdef")] = True
#: Line ends too, as they do not end a run.
BASE64_BYTES = np.zeros(256, bool)
BASE64_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n")] = True


def scan(text: str, may_hex: bool = True) -> list[tuple[str, int, int]]:
    """Secrets of one layer."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if may_hex:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text and the span of the original that each character stands for."""

    def __init__(self, text: str, begin=None, end=None):
        self.text, self.begin, self.end = text, begin, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (int(self.begin[a]), int(self.end[b - 1]))

    def key(self) -> tuple:
        return self.text, *self.span(0, len(self.text))

    def scan(self) -> set[tuple[str, int, int]]:
        return {(kind, *self.span(a, b)) for kind, a, b in scan(self.text)}

    def unwrap(self):
        return unwrap(self)


class Packed:
    """Bytes that stand for one span of the original as a whole."""

    def __init__(self, data: bytes | mmap.mmap, begin: int, end: int):
        self.data, self.begin, self.end = data, begin, end

    def key(self) -> tuple:
        digest = hashlib.sha256()
        for a in range(0, len(self.data), 1 << 20):
            digest.update(self.data[a : a + (1 << 20)])
        return digest.digest(), self.begin, self.end

    def scan(self) -> set[tuple[str, int, int]]:
        data, kinds = self.data, set()
        if any(m.end(2) - m.start(2) >= 6 for m in ASSIGN_B.finditer(data)):
            kinds.add("assign")
        if any(m.end() - m.start() >= 20 for m in ACCESS_B.finditer(data)):
            kinds.add("access")
        if HEX_B.search(data):
            kinds.add("hex")
        return {(kind, self.begin, self.end) for kind in kinds}

    def unwrap(self):
        """The layers directly inside."""
        data = self.data
        if PERCENT_B.search(data):
            yield self._rewritten(PERCENT_B, 3, lambda x: bytes.fromhex(x.decode().replace("%", "")))
        if ESCAPE_B.search(data):
            yield self._rewritten(ESCAPE_B, 6, lambda x: ESCAPE.sub(_unescape, x.decode()).encode("utf-8", "replace"))
        for m in BASE64_B.finditer(data):
            if m.end() - m.start() >= MIN_BASE64:
                for skip in range(4):
                    yield self._made(_decoded(_letters(data, *m.span()), skip))
        for _, _, inner, _ in _streams(data):
            yield self._made(inner)

    def _made(self, data) -> Packed:
        return Packed(data, self.begin, self.end)

    def _rewritten(self, pattern, unit: int, new) -> Packed:
        data, out, at = self.data, Spool(), 0
        for m in pattern.finditer(data):
            out.copy(data, at, m.start())
            for a in range(m.start(), m.end(), unit << 18):
                out.write(new(data[a : min(a + (unit << 18), m.end())]))
            at = m.end()
        out.copy(data, at, len(data))
        return self._made(out.contents())


TO_PLAIN = bytes.maketrans(b"-_", b"+/")


def _letters(data: bytes | mmap.mmap, a: int, b: int):
    """Base64 digits of data[a:b] in blocks."""
    for i in range(a, b, 1 << 20):
        yield data[i : min(i + (1 << 20), b)].translate(TO_PLAIN, b"= \t\r\n")


def _decoded(blocks, skip: int) -> bytes | mmap.mmap:
    """Bytes of base64 digits after the first few."""
    out, rest = Spool(), b""
    for block in blocks:
        rest += block[skip:]
        skip = max(0, skip - len(block))
        n = len(rest) & ~3
        out.write(base64.b64decode(rest[:n]))
        rest = rest[n:]
    if len(rest) > 1:
        out.write(base64.b64decode(rest + b"=" * (4 - len(rest))))
    return out.contents()


def _rewritten(layer: Layer, found: list[tuple[int, int, str]]) -> Layer:
    """The layer with spans replaced; a replacement's characters share the span's place."""
    texts, begins, ends, at = [], [], [], 0
    n = len(layer.text)
    own_begin = np.arange(n) if layer.begin is None else layer.begin
    own_end = np.arange(1, n + 1) if layer.end is None else layer.end
    for a, b, new in [*found, (n, n, "")]:
        texts += [layer.text[at:a], new]
        begins += [own_begin[at:a], np.full(len(new), own_begin[a] if a < n else 0)]
        ends += [own_end[at:a], np.full(len(new), own_end[b - 1] if b else 0)]
        at = b
    return Layer("".join(texts), np.concatenate(begins), np.concatenate(ends))


def _unescape(m: re.Match) -> str:
    for group, base in ((1, 16), (2, 16), (3, 10), (4, 16)):
        if m[group]:
            code = int(m[group], base)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
    units = bytes.fromhex(m[0].replace("\\u", ""))
    return units.decode("utf-16-be", "replace")


class Spool:
    """Bytes written one after another; more than MAX_LAYER of them go to a temporary file."""

    def __init__(self):
        self.file, self.size = tempfile.SpooledTemporaryFile(MAX_LAYER), 0

    def write(self, data: bytes) -> None:
        self.size += self.file.write(data)

    def copy(self, data: bytes | mmap.mmap, a: int, b: int) -> None:
        for i in range(a, b, 1 << 20):
            self.write(data[i : min(i + (1 << 20), b)])

    def contents(self) -> bytes | mmap.mmap:
        with self.file as file:
            if self.size > MAX_LAYER:
                file.flush()
                return mmap.mmap(file.fileno(), self.size, access=mmap.ACCESS_READ)
            file.seek(0)
            return file.read()


def _members(data: bytes | mmap.mmap, at: int):
    """Contents of the zlib stream, or of all gzip members in a row, that begins at a place;
    the place after the last whole one; and whether the data ended or broke inside one."""
    out, whole = Spool(), at
    while True:
        unpack, step = zlib.decompressobj(47), 1 << 10
        try:
            while not unpack.eof and at < len(data):
                part = data[at : at + step]
                at, step = at + len(part), 1 << 16
                while True:
                    out.write(unpack.decompress(part, 1 << 20))
                    part = unpack.unconsumed_tail
                    if unpack.eof or not part:
                        break
            while not unpack.eof and (more := unpack.decompress(b"", 1 << 20)):
                out.write(more)
        except zlib.error:
            return out.contents(), whole, True
        if not unpack.eof:
            return out.contents(), whole, True
        at = whole = at - len(unpack.unused_data)
        while data[at : at + 1] == b"\0":
            at += 1
        if data[at : at + 3] != b"\x1f\x8b\x08":
            return out.contents(), whole, False


def _streams(data: bytes | mmap.mmap):
    """Start, end and contents of all compressed data, and whether it is whole."""
    at = 0
    while m := ZLIB.search(data, at):
        begin = m.start()
        inner, at, broken = _members(data, begin)
        if not broken:
            yield begin, at, inner, True
        else:
            # What came before the break counts, unless the place only looked like a header.
            if at > begin or ASCII_STRETCH_B.search(inner) or inner[:3] == b"\x1f\x8b\x08":
                yield begin, len(data), inner, False
            at = max(at, begin + 1)


def _base64_layers(layer: Layer):
    """Layers in base64. A payload may begin at any digit of a run, after a letter or ``/``
    as well; the four alignments of the run hold the bytes of each."""
    for m in BASE64.finditer(layer.text):
        if m.end() - m.start() < MIN_BASE64:
            continue
        run = m[0].rstrip("=").encode()
        letters = run.translate(TO_PLAIN, b" \t\r\n")
        if len(letters) < MIN_BASE64:
            continue
        places = m.start() + (
            np.arange(len(run)) if len(letters) == len(run) else np.flatnonzero(~np.isin(np.frombuffer(run, np.uint8), list(b" \t\r\n")))
        )
        for skip in range(4):
            yield from _layers_of_run(layer, _decoded([letters], skip), places[skip:], m.end())


def _layers_of_run(layer: Layer, data: bytes | mmap.mmap, places: np.ndarray, stop: int):
    """Layers in decoded data whose digits are at some places; padding ends at ``stop``."""
    gaps, at = [], 0
    for a, b, inner, whole in _streams(data):
        end = stop if b == len(data) else int(places[-(-b * 4 // 3) - 1]) + 1
        yield Packed(inner, *layer.span(int(places[a * 4 // 3]), end))
        if whole:
            gaps.append((at, a))
            at = b
    for a, b in [*gaps, (at, len(data))]:
        text, ends = data[a:b].decode("utf-8", "surrogateescape"), None
        for m in STRETCH.finditer(text):
            if ASCII_STRETCH.search(m[0]):
                if ends is None:
                    # Where each character ends among the bytes; one that is no UTF-8 is a byte.
                    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
                    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
                    ends = a + np.cumsum(size)
                last = ends[m.start() : m.end()]
                begin, end = places[(last - size[m.start() : m.end()]) * 4 // 3], places[-(-last * 4 // 3) - 1] + 1
                if layer.begin is not None:
                    begin, end = layer.begin[begin], layer.end[end - 1]
                yield Layer(m[0], begin, end)


def unwrap(layer: Layer):
    """The layers directly inside a layer of text."""
    text = layer.text
    if "%" in text and (found := [(*m.span(), bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")) for m in PERCENT.finditer(text)]):
        yield _rewritten(layer, found)
    if ("\\" in text or "&#" in text) and (found := [(*m.span(), _unescape(m)) for m in ESCAPE.finditer(text)]):
        yield _rewritten(layer, found)
    yield from _base64_layers(layer)


def find_secrets(text: str, may_hex: bool = True, may_nest: bool = True):
    """(base spans, all spans) of one text, both sorted by start, kind and end."""
    order = lambda found: sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    base = scan(text, may_hex)
    if not may_nest:
        return order(base), order(base)
    whole = Layer(text)
    every, seen, todo = set(base), {whole.key()}, deque([whole])
    while todo:
        for inner in todo.popleft().unwrap():
            if (key := inner.key()) not in seen:
                seen.add(key)
                todo.append(inner)
                every.update(inner.scan())
    return order(base), order(every)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("secrets", T.ArrayType(SPAN))])


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Documents with ``base`` and ``secrets``: spans without and with unwrapping.

    With ``redact`` the text is returned with every secret replaced by its kind in
    brackets. ``keep`` names the columns that stay; columns of the new names are replaced.
    """
    added = T.StructType(list(ADDED.fields) + ([T.StructField("redacted", T.StringType())] if redact else []))

    def make():
        def work(data, offsets):
            raw = data.tobytes()
            n = len(offsets) - 1

            def with_run(letters, least):
                s, e, _ = word_spans(data, offsets, letters)
                flags = np.zeros(n, bool)
                flags[np.searchsorted(offsets, s[e - s >= least], side="right") - 1] = True
                return flags

            hexes, nests = with_run(HEX_BYTES, 24), with_run(BASE64_BYTES, MIN_BASE64)
            at = offsets.tolist()
            out = {f.name: [] for f in added.fields}
            for d in range(n):
                part = raw[at[d] : at[d + 1]]
                nested = bool(nests[d]) or INDENTED.search(part) is not None or b"%" in part or b"\\" in part or b"&#" in part
                text = part.decode()
                base, every = find_secrets(text, bool(hexes[d]), nested)
                out["base"].append([dict(zip(SPAN.names, x)) for x in base])
                out["secrets"].append([dict(zip(SPAN.names, x)) for x in every])
                if redact:
                    out["redacted"].append(redacted(text, every))
            return out

        return work

    return map_texts(docs, make, added, docs.columns if keep is None else keep)


def redacted(text: str, spans) -> str:
    """The text with secrets replaced; overlapping spans are one, named by the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b, i = max(b, spans[i][2]), i + 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])
