"""Secret scan with a recursive decoding worklist.

Every text is scanned for three kinds of secrets. Then its layers are unwrapped until nothing new
appears: percent escapes and Unicode escapes give a new layer of the whole text, each base64 run a
layer for each of the four places where a group of four characters can begin, and gzip or zlib data at
any place of it a layer of its own. Runs that only line ends part are read as one; bytes that are not
UTF-8 become replacement characters. Each layer is scanned like the text itself, and spans found there
are mapped back to the characters they came from (up to the end of the run for compressed data). A
layer that was seen before at the same place is not entered again, so cycles end.

One pass over whole texts, no shuffle. Compressed data is unpacked to its end, all members of it, in
pieces of ``LAYER`` bytes that overlap by ``OVERLAP``; one piece is held at a time. A secret
or an encoded run that is longer than the overlap may be seen in parts.

Cases: a null text is an empty text; it has no spans. Repeated rows are scanned alike; other columns,
whatever their names, are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYER = 4 << 20  # bytes of unpacked data that are scanned at once
OVERLAP = 1 << 20  # of these, bytes of the piece before
SLICE = 1 << 16  # bytes given to the unpacker at once, and taken
RUN = 16  # characters of the shortest base64 run that is tried

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE64 = re.compile(
    r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]++(?=[=\r\n"'`<]|\Z))*={0,2}"""
)
WRAPPED = re.compile(rb"\n[\x20\t]*[A-Za-z0-9+/_-]++[=\r\n\"'`<]|\n[\x20\t]*[A-Za-z0-9+/_-]++\Z")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")

WORDS = (b"passw", b"secret", b"token", b"api")
IN_HEX = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
IN_BASE64 = bytes(49 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 48 for c in range(256))
SAFE = bytes.maketrans(b"-_", b"+/")
BETWEEN = b" \t\r\n"

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str, raw: bytes) -> list[Span]:
    """Spans of one layer; ``raw`` is the text in UTF-8."""
    found: list[Span] = []
    lower = raw.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in raw.translate(IN_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text whose character i stands for characters [lo[i], hi[i]) of the document."""

    __slots__ = ("text", "lo", "hi")

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.text, self.lo, self.hi = text, lo, hi

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        return int(self.lo[start]), int(self.hi[end - 1])

    def bounds(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.lo is None:
            at = np.arange(start, end)
            return at, at + 1
        return self.lo[start:end], self.hi[start:end]


def _rewritten(layer: Layer, pattern: re.Pattern, decoded) -> Layer | None:
    """The layer with every match of ``pattern`` decoded; None if nothing changed.

    ``decoded`` gives the text of a match and the place in the match where each character begins.
    """
    texts, los, his, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decoded(m.group())
        if got is None:
            continue
        text, starts = got
        lo, hi = layer.bounds(at, m.start())
        ends = [*starts[1:], m.end() - m.start()]
        places = [layer.place(m.start() + a, m.start() + max(b, a + 1)) for a, b in zip(starts, ends, strict=True)]
        texts += [layer.text[at : m.start()], text]
        los += [lo, np.array([a for a, _ in places], dtype=np.int64)]
        his += [hi, np.array([b for _, b in places], dtype=np.int64)]
        at = m.end()
    if not at:
        return None
    lo, hi = layer.bounds(at, len(layer.text))
    return Layer("".join([*texts, layer.text[at:]]), np.concatenate([*los, lo]), np.concatenate([*his, hi]))


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    text, starts, at = [], [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                char = raw[at : at + n].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            char, n = "\ufffd", 1
        text.append(char)
        starts.append(3 * at)
        at += n
    return "".join(text), starts


def _escapes(run: str):
    units, starts = [], []
    for m in ONE_ESCAPE.finditer(run):
        code = int(m.group(1), 16)
        if units and 0xD800 <= units[-1] < 0xDC00 <= code < 0xE000:
            units[-1] = 0x10000 + ((units[-1] - 0xD800) << 10) + code - 0xDC00
            continue
        units.append(code)
        starts.append(m.start())
    return "".join(chr(u) if u < 0x110000 and not 0xD800 <= u < 0xE000 else "\ufffd" for u in units), starts


def _members(source: Callable[[], Iterable[bytes]], used: list[int]) -> Iterator[bytes]:
    """The content of gzip or zlib data, all members of it, in pieces; what is broken ends it.

    ``used`` gets the number of bytes up to the end of the last whole member.
    """
    got, read = zlib.decompressobj(47), 0
    try:
        for piece in source():
            for at in range(0, len(piece), SLICE):
                data = piece[at : at + SLICE]
                read += len(data)
                while data:
                    if got.eof:
                        got = zlib.decompressobj(47)
                        data = data.lstrip(b"\0")  # padding between members
                        continue
                    if out := got.decompress(data, SLICE):
                        yield out
                    data = got.unused_data if got.eof else got.unconsumed_tail
                    if got.eof:
                        used[0] = read - len(data)
        if out := got.flush():
            yield out
    except zlib.error:
        return


def _pieces(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Overlapping pieces of bounded size that cover the stream."""
    held, new = bytearray(), 0
    for data in stream:
        held += data
        new += len(data)
        if len(held) >= LAYER:
            yield bytes(held)
            del held[:-OVERLAP]
            new = 0
    if new:
        yield bytes(held)


def _contents(data: bytes, used: list[int]) -> Iterator[bytes]:
    """Pieces of what was packed once, twice ...; data that unpacks to itself ends."""
    level = partial(_members, partial(iter, [data]), used)
    heads = set()
    while True:
        head = bytearray()
        for x in level():
            head += x
            if len(head) >= SLICE:
                break
        if not head or bytes(head) in heads:
            return
        heads.add(bytes(head))
        yield from _pieces(level())
        if not PACKED.match(head):
            return
        level = partial(_members, level, [0])


def _decoded(data: bytes) -> tuple[str, np.ndarray]:
    """Text with a replacement character for each byte that is not UTF-8, and bytes of each character."""
    code = np.frombuffer(data.decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wrong = code >> 11 == 0xD800 >> 11
    sizes = np.where(wrong, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    return np.where(wrong, np.uint32(0xFFFD), code).astype("<u4").tobytes().decode("utf-32-le"), sizes


def _runs(layer: Layer) -> Iterator[Layer]:
    """The layers inside base64 runs, which may be glued to what stands before: four alignments are
    tried, and packed data at every place."""
    for m in BASE64.finditer(layer.text):
        if m.end() - m.start() < RUN:
            continue
        run = m.group().encode()
        body = run.translate(SAFE, BETWEEN + b"=")
        if len(body) < RUN:
            continue
        at = np.flatnonzero(np.frombuffer(run.translate(IN_BASE64), dtype=np.uint8) == 49)
        lo, hi = (x[at] for x in layer.bounds(m.start(), m.end()))
        last = layer.place(m.start(), m.end())[1]
        for k in range(4):
            n = len(body) - k
            n -= n % 4 == 1
            data = base64.b64decode(body[k : k + n] + b"=" * (-n % 4))
            done = 0
            for p in PACKED.finditer(data):
                if p.start() < done:
                    continue
                used, first = [0], int(lo[k + p.start() * 4 // 3])
                for piece in _contents(data[p.start() :], used):
                    text = piece.decode(errors="replace")
                    yield Layer(text, np.broadcast_to(np.int64(first), len(text)), np.broadcast_to(np.int64(last), len(text)))
                done = p.start() + used[0]
            text, sizes = _decoded(data)
            ends = np.cumsum(sizes)
            yield Layer(text, lo[k + (ends - sizes) * 4 // 3], hi[k + np.minimum(-(-ends * 4 // 3), n) - 1])


def _inner(layer: Layer, raw: bytes) -> Iterator[Layer]:
    """The layers directly inside a layer, one at a time."""
    if b"%" in raw and (got := _rewritten(layer, PERCENT, _percent)):
        yield got
    if b"\\" in raw and (got := _rewritten(layer, ESCAPE, _escapes)):
        yield got
    if b"1" * RUN in raw.translate(IN_BASE64) or WRAPPED.search(raw):
        yield from _runs(layer)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and all spans with those of its layers, each in order."""
    text = text or ""
    raw = text.encode()
    base = sorted(scan(text, raw))
    found, seen, todo = set(base), {(_digest(raw), 0, len(text))}, [_inner(Layer(text), raw)]
    while todo:
        one = next(todo[-1], None)
        if one is None:
            todo.pop()
            continue
        if not one.text:
            continue
        raw = one.text.encode()
        name = (_digest(raw), *one.place(0, len(one.text)))
        if name in seen:
            continue
        seen.add(name)
        found.update(_span(one.place(s, e), k) for s, k, e in scan(one.text, raw))
        todo.append(_inner(one, raw))
    return base, sorted(found)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _span(place: tuple[int, int], kind: int) -> Span:
    return place[0], kind, place[1]


def secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all others than the results), ``base`` and ``spans``.

    Both are arrays of (kind, start, end): code points of the text, end exclusive, by start and kind.
    """
    names = [c for c in df.columns if c not in ("base", "spans")] if keep is None else keep
    rows = df.select(F.struct(*names).alias("row"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("base", kind), T.StructField("spans", kind)])

    def run(batches):
        for batch in batches:
            found = [find(x) for x in batch.column(1).to_pylist()]
            lists = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, span) for x in lists)], names=schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "base", "spans")
