"""Secret scans: a worklist unwraps nested encodings and rescans every layer.

Layers of a text: the text; every layer with its percent escapes decoded; with its Unicode escapes
(``\\uXXXX``, ``\\xXX``, ``\\UXXXXXXXX``) decoded; and the readable parts of each base64 run, decoded from all four phases (a run may start
with characters that are none of it, as in a path), and of what gzip, zlib, bzip2 or xz streams in it hold: all members,
streams inside streams. Lines of base64 (16 or more characters each, the last any) are also read as one run. New layers join the worklist until
none is left; a layer already seen for the same place of the text is not taken again, so cycles end.
Every character of a layer knows which span of the original text it came from; what was compressed comes from its whole stream.
No secret has fewer than 14 characters, so shorter readable parts are left out.

Cases: null or empty text gives no spans. Repeated rows each give a row. Escapes and bytes that do not decode stay as they are, and the rest of
their run is decoded. A stream of any length is read in windows (8 MB that overlap by 1 MB: only a secret or inner layer longer than the
overlap can be missed in a stream longer than a window). Beyond ``max_unpacked`` bytes (1 GB) in all, the streams of a document are
not read on (guard against decompression bombs): they are counted in ``n_oversized``, and ``redact_secrets`` replaces them whole. A cut or damaged stream
is read as far as it goes. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.common import frame, map_batches, only, pieces, table

KINDS = ("assign", "access", "hex")
MAX_UNPACKED, WINDOW, OVERLAP, CHUNK = 1 << 30, 8 << 20, 1 << 20, 1 << 20
SHORTEST = 14  # "token=" and eight characters

# Fixed patterns of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a greedy run of 32 or more is a maximal run
_KEYWORDS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_BREAK, _DIGITS = r"[ \t]*\r?\n[ \t]*", "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(f"{_DIGITS}{{16,}}+(?:{_BREAK}{_DIGITS}{{16,}}+)*+(?:{_BREAK}{_DIGITS}++)?={{0,2}}")
_LINE = re.compile(f"{_DIGITS}+")
_BEYOND_ASCII = (
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_UTF8 = re.compile(rb"(?:[\x00-\x7f]++|" + _BEYOND_ASCII + rb")++")
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]++|" + _BEYOND_ASCII + rb")++")
# How compressed streams begin.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the secrets in plain sight, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and the span of the original that each character came from: arrays, one span for all (``flat``), or neither for the original itself."""

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None, flat: tuple[int, int] | None = None):
        self.text, self.low, self.high, self.flat = text, low, high, flat

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.flat is not None:
            return self.flat
        if self.low is None:
            return start, end
        return int(self.low[start:end].min()), int(self.high[start:end].max())

    def at(self, first: np.ndarray, last: np.ndarray, text: str) -> Layer:
        """A layer whose characters come from those of this one between ``first`` and ``last``, both included."""
        if self.flat is not None:
            return Layer(text, flat=self.flat)
        if self.low is None:
            return Layer(text, first, last + 1)
        return Layer(text, self.low[first], self.high[last])

    def key(self) -> tuple:
        return (hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *(self.span(0, len(self.text)) if self.text else (0, 0)))


def _cuts(text: str) -> np.ndarray:
    """The first byte of each character, and the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], Iterable[tuple[str, np.ndarray]]]) -> Iterator[Layer]:
    """The layer with what decodes in every run of ``pattern``, if anything does; ``decode`` gives texts with the places in the run where each
    character starts, and where the last one ends."""
    parts, first, last, at = [], [], [], 0

    def same(start: int, stop: int) -> None:
        parts.append(layer.text[start:stop])
        first.append(np.arange(start, stop))
        last.append(first[-1])

    for m in pattern.finditer(layer.text):
        for text, places in decode(m.group()):
            same(at, m.start() + int(places[0]))
            parts.append(text)
            first.append(places[:-1] + m.start())
            last.append(places[1:] + (m.start() - 1))
            at = m.start() + int(places[-1])
    if at:
        same(at, len(layer.text))
        yield layer.at(np.concatenate(first), np.concatenate(last), "".join(parts))


def _percent(run: str) -> Iterator[tuple[str, np.ndarray]]:
    for m in _UTF8.finditer(bytes.fromhex(run.replace("%", ""))):
        text = m.group().decode()
        yield text, 3 * (_cuts(text) + m.start())


def _escapes(run: str) -> Iterator[tuple[str, np.ndarray]]:
    units = [(m.start(), m.end(), int(m[1] or m[2] or m[3], 16)) for m in re.finditer(r"\\(?:u(....)|U(.{8})|x(..))", run)]
    k, text, places = 0, [], []
    while k < len(units):
        start, end, code = units[k]
        k += 1
        if 0xD800 <= code < 0xDC00 and k < len(units) and 0xDC00 <= units[k][2] < 0xE000:
            code, end, k = 0x10000 + ((code - 0xD800) << 10) + units[k][2] - 0xDC00, units[k][1], k + 1
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            text.append(chr(code))
            places.append(start)
        if text and (k == len(units) or places[-1] != start):  # a code that is none ends a part
            yield "".join(text), np.array([*places, end if places[-1] == start else start])
            text, places = [], []


class _Unpacked:
    """The plain bytes, in pieces, of a compressed stream given in pieces: all members that follow each other.

    ``left`` counts the bytes behind the last whole member once all is read; a stream that breaks off in a member ends there.
    """

    def __init__(self, chunks: Iterable[bytes], budget: list[int]):
        self.chunks, self.budget, self.left = chunks, budget, None

    @staticmethod
    def _opened(data: bytes):
        if data[:3] == b"\x1f\x8b\x08":
            return zlib.decompressobj(31)
        if data[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        if data[:6] == b"\xfd7zXZ\x00":
            return lzma.LZMADecompressor()
        return zlib.decompressobj() if data[:1] == b"\x78" else None

    def __iter__(self) -> Iterator[bytes]:
        box, data = None, b""
        for chunk in self.chunks:
            data += chunk
            while data:
                if box is None:
                    self.left = len(data)
                    if len(data) < 6:
                        break  # more may follow
                    box = self._opened(data)
                    if box is None:
                        return
                more = True
                while more:
                    try:
                        out = box.decompress(data, CHUNK)
                    except (zlib.error, OSError, lzma.LZMAError, EOFError):
                        return
                    self.budget[0] -= len(out)
                    if self.budget[0] < 0:
                        raise OverflowError
                    if out:
                        yield out
                    data = getattr(box, "unconsumed_tail", b"")
                    more = not box.eof and (bool(data) or (len(out) == CHUNK if hasattr(box, "unconsumed_tail") else not box.needs_input))
                if box.eof:
                    data, box = box.unused_data, None
                    self.left = len(data)


class _Scan:
    """The worklist of one text."""

    def __init__(self, text: str, most: int, window: int, overlap: int):
        self.budget, self.window, self.overlap = [most], window, overlap
        self.base = base_spans(text)
        self.spans, self.unread, self.layers, self.seen = set(self.base), set(), 0, set()
        # Iterators of layers: an inner layer is worked through before its outer one goes on, so few are held at a time.
        work = [iter([Layer(text)])]
        while work:
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
            elif (key := layer.key()) not in self.seen:
                self.seen.add(key)
                self.layers += 1
                if self.layers > 1:
                    for start, kind, end in base_spans(layer.text):
                        low, high = layer.span(start, end)
                        self.spans.add((low, kind, high))
                work.append(self.inner(layer))

    def inner(self, layer: Layer) -> Iterator[Layer]:
        if "%" in layer.text:
            yield from _replaced(layer, _PERCENT, _percent)
        if "\\" in layer.text:
            yield from _replaced(layer, _ESCAPES, _escapes)
        for m in _BASE64.finditer(layer.text):
            lines = [x.span() for x in _LINE.finditer(m.group())]
            runs = [(a + m.start(), b + m.start()) for a, b in lines]
            if len(runs) > 1:
                digits = np.concatenate([np.arange(a, b) for a, b in runs])
                yield from self.base64(layer, "".join(layer.text[a:b] for a, b in runs), digits, m.end())
            for a, b in runs:
                if b - a >= 16:
                    yield from self.base64(layer, layer.text[a:b], np.arange(a, b), m.end() if b == runs[-1][1] else b)

    def base64(self, layer: Layer, run: str, digits: np.ndarray, end: int) -> Iterator[Layer]:
        """Layers of a run whose characters stand at ``digits``, in each phase; ``end`` is behind its padding."""
        run = run.replace("-", "+").replace("_", "/")
        for phase in range(4):
            size = len(run) - phase
            size -= size % 4 == 1
            data = base64.b64decode(run[phase : phase + size] + "=" * (-size % 4))

            def part(start: int, text: str, phase: int = phase) -> Layer:
                cuts = _cuts(text) + start  # byte b comes from digits b * 4 // 3 up to ceil((b + 1) * 4 / 3)
                return layer.at(digits[phase + cuts[:-1] * 4 // 3], digits[phase - (-cuts[1:] * 4 // 3) - 1], text)

            yield from self.blob(data, part, lambda start, phase=phase: layer.span(int(digits[phase + start * 4 // 3]), end))

    def blob(self, data: bytes, part: Callable[[int, str], Layer], place: Callable[[int], tuple[int, int]]) -> Iterator[Layer]:
        """Readable parts of ``data`` and of the compressed streams in it; ``place`` is the span from a byte to the end."""
        for m in _READABLE.finditer(data):
            if m.end() - m.start() >= SHORTEST:
                text = m.group().decode()
                if len(text) >= SHORTEST:
                    yield part(m.start(), text)
        at = 0
        while m := _PACKED.search(data, at):
            at = m.start() + 1
            stream, flat = _Unpacked([data[m.start() :]], self.budget), place(m.start())
            try:
                yield from self.contents(stream, flat)
            except OverflowError:
                self.unread.add(flat)
            if stream.left is not None:
                at = max(at, len(data) - stream.left)

    def contents(self, stream: Iterable[bytes], flat: tuple[int, int]) -> Iterator[Layer]:
        """Layers of an unpacked stream, by windows if it is long."""

        def layers(data: bytes) -> Iterator[Layer]:
            key = (hashlib.sha256(data).digest(), "bytes", *flat)
            if key not in self.seen:
                self.seen.add(key)
                yield from self.blob(data, lambda _, text: Layer(text, flat=flat), lambda _: flat)

        pieces_of, held, first = iter(stream), b"", True
        try:
            for piece in pieces_of:
                held += piece
                if len(held) <= self.window:
                    continue
                if first and _PACKED.match(held):
                    inner, held = _Unpacked(chain([held], pieces_of), self.budget), b""
                    yield from self.contents(inner, flat)
                    return
                first = False
                yield from layers(held)
                held = held[-self.overlap :]
        except OverflowError:
            yield from layers(held)
            raise
        yield from layers(held)


def all_spans(
    text: str, most: int = MAX_UNPACKED, window: int = WINDOW, overlap: int = OVERLAP
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans, number of layers read, compressed runs that were not read to their end."""
    scan = _Scan(text, most, window, overlap)
    return scan.base, sorted(scan.spans), scan.layers, len(scan.unread)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()),
     ("spans", pa.string()), ("n_layers", pa.int64()), ("n_oversized", pa.int64())]
)


def scan_secrets(docs: DataFrame, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """Per document: ``doc_id``, counts of base spans by kind, ``base`` and ``spans`` (``kind:start:end``, comma-joined),
    ``n_layers`` read and ``n_oversized``. One pass, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    base, spans, layers, over = all_spans(text or "", max_unpacked)
                    kinds = [k for _, k, _ in base]
                    rows.append((doc, *(kinds.count(k) for k in range(3)), listed(base), listed(spans), layers, over))
                yield frame(_ARROW, *zip(*rows))

    return map_batches(
        only(docs, "doc_id", "text"), scan, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_layers long, n_oversized long"
    )


def redact(text: str, spans: list[tuple[int, int, int]], unread: Iterable[tuple[int, int]] = ()) -> str:
    """``text`` with the union of the spans replaced by one mark, the kind of its first span; ``unread`` spans count as a kind of their own."""
    out, at = [], 0
    marks = sorted([*((start, kind, end) for start, kind, end in spans), *((start, len(KINDS), end) for start, end in unread)])
    runs: list[list[int]] = []
    for start, kind, end in marks:
        if runs and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
        else:
            runs.append([start, kind, end])
    for start, kind, end in runs:
        out += [text[at:start], f"[{(*KINDS, 'unread')[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, max_unpacked: int = MAX_UNPACKED) -> DataFrame:
    """The documents with every span of every layer replaced in ``text`` by ``[kind]``, and streams beyond ``max_unpacked`` by ``[unread]``;
    all columns and rows stay, null text stays null."""

    def cleared(text: str) -> str:
        scan = _Scan(text, max_unpacked, WINDOW, OVERLAP)
        return redact(text, list(scan.spans), scan.unread)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for piece in pieces(batch, "text"):
                texts = [t and cleared(t) for t in piece.column(at).to_pylist()]
                yield piece.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return map_batches(docs, replace, docs.schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_layers", "n_oversized"
    )
