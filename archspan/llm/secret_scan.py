"""Secrets in texts and in the layers encoded inside them.

The text itself is scanned for assignments of credentials, access keys and
hexadecimal keys. Then a worklist of layers is processed until it is empty: URL
escapes (%41), Unicode escapes (\\u0041, \\x41), base64 and compressed data are
unwrapped, each new layer is scanned and joins the worklist. A layer that its
text has produced before at the same place is not entered again, so cycles end.
Base64 may be wrapped over lines. Bytes that are no UTF-8 are replaced, never a
reason to leave a layer out; bytes with NUL are read as UTF-16 as well.
Every character of a layer carries the span of the original text that made it,
and a finding is reported at the span of its characters.

A narrow pass without a shuffle. Compressed data are unpacked to the end, over all
members, and scanned in windows of about ``WINDOW`` characters that end where neither a
finding nor a base64 run can cross; only a run that long makes a longer window.
Null and empty texts have no findings; repeated rows get equal ones.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, without

KINDS = ("assign", "access", "hex")
WINDOW = 1 << 20


def _either_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are whole, so those of 16 and more are what a filter on length would leave.
HEX = re.compile(r"[0-9a-f]{16,}")

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs of several lines; quoting marks may begin a line.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*\r?\n[ \t>]*)+[A-Za-z0-9+/_-]++={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Characters that findings, escapes and (wrapped) base64 runs are made of.
_CARRIED = re.compile(r"""[A-Za-z0-9+/_.=:"'%\\{}>\s-]*""")

FINDING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("layers", T.StringType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string())]))


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the text itself, in code points."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text; ``start[i]`` to ``end[i]`` is what made character i."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, path: str):
        self.text, self.start, self.end, self.path = text, start, end, path


def _lines(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of the lines with a match."""
    done = -1
    for m in pattern.finditer(text):
        if m.start() < done:
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        hi = text.find("\n", m.end())
        done = len(text) if hi < 0 else hi
        yield lo, done


def _replaced(layer: Layer, lo: int, hi: int, pattern: re.Pattern, decode, path: str) -> Layer | None:
    """The part [lo, hi) of a layer with the matches of ``pattern`` decoded."""
    pieces, starts, ends = [], [], []
    at, changed = lo, False
    for m in pattern.finditer(layer.text, lo, hi):
        got = decode(m[0])
        changed = True
        a, b = m.span()
        pieces.append(layer.text[at:a])
        starts.append(layer.start[at:a])
        ends.append(layer.end[at:a])
        for char, x, y in got:
            pieces.append(char)
            starts.append(layer.start[a + x : a + x + 1])
            ends.append(layer.end[a + y - 1 : a + y])
        at = b
    if not changed:
        return None
    pieces.append(layer.text[at:hi])
    starts.append(layer.start[at:hi])
    ends.append(layer.end[at:hi])
    return Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends), f"{layer.path}/{path}" if layer.path else path)


def _url(run: str) -> list[tuple[str, int, int]]:
    """Bytes that are no UTF-8 become U+FFFD, one each."""
    raw = bytes.fromhex(run.replace("%", ""))
    out, at = [], 0
    for char in raw.decode(errors="surrogateescape"):
        escaped = 0xDC80 <= ord(char) <= 0xDCFF
        n = 3 if escaped else 3 * len(char.encode())
        out.append(("\ufffd" if escaped else char, at, at + n))
        at += n
    return out


def _unicode(run: str) -> list[tuple[str, int, int]]:
    units = [(int(m[1], 16), m.start(), m.end()) for m in _ONE_ESCAPE.finditer(run)]
    out: list[tuple[str, int, int]] = []
    k = 0
    while k < len(units):
        code, a, b = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, b = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2]
            k += 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            code = 0xFFFD
        out.append((chr(code), a, b))
        k += 1
    return out


_MAKERS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}


def _packing(raw: bytes) -> str | None:
    """Name of a compression by the first bytes."""
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return "zlib"
    if raw[:3] == b"BZh":
        return "bzip2"
    return "xz" if raw[:6] == b"\xfd7zXZ\x00" else None


def _inflated(raw: bytes, name: str | None) -> Iterator[bytes]:
    """Contents of compressed data, piece by piece, over all members; damaged data give what comes before the damage."""
    at = 0
    while name:
        made = _MAKERS[name]()
        try:
            while at < len(raw) and not made.eof:
                part = raw[at : at + 16384]
                at += len(part)
                if name in ("gzip", "zlib"):
                    while part and not made.eof:
                        yield made.decompress(part, WINDOW)
                        part = made.unconsumed_tail
                else:
                    yield made.decompress(part, WINDOW)
                    while not made.eof and not made.needs_input:
                        yield made.decompress(b"", WINDOW)
            if name in ("gzip", "zlib") and not made.eof:
                yield made.flush()
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        at -= len(made.unused_data)
        while raw[at : at + 1] == b"\x00":  # padding between members
            at += 1
        name = _packing(raw[at : at + 8])


def _windows(pieces: Iterator[bytes], encoding: str) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    held: list[str] = []
    size = 0

    for piece in pieces:
        text = decoder.decode(piece)
        tail = _CARRIED.match(text[::-1]).end()
        if size + len(text) >= WINDOW and tail < len(text):
            cut = len(text) - tail
            yield "".join([*held, text[:cut]])
            held, size = [text[cut:]], tail
        else:
            held.append(text)
            size += len(text)
    last = "".join([*held, decoder.decode(b"", True)])
    if last:
        yield last


def _contents(raw: bytes) -> Iterator[tuple[str, str]]:
    """(text, layers unwrapped) of the windows of data, packed or not."""
    path, seen = "base64", set()
    while (name := _packing(raw)) is not None and (mark := hashlib.sha256(raw).digest()) not in seen:
        seen.add(mark)
        pieces = filter(None, _inflated(raw, name))
        first = next(pieces, b"")
        while 0 < len(first) < 8 and (more := next(pieces, b"")):
            first += more
        if not first:
            break
        path += f"/{name}"
        if _packing(first) is None:
            break
        raw = b"".join([first, *pieces])
    else:
        first = b""

    def whole() -> Iterator[bytes]:
        if not first:
            yield raw
            return
        pieces = filter(None, _inflated(raw, _packing(raw)))
        yield from pieces

    for text in _windows(whole(), "utf-8"):
        yield text, path
    if any(b"\x00" in piece for piece in whole()):
        for encoding in ("utf-16-le", "utf-16-be"):
            for text in _windows(whole(), encoding):
                yield text, f"{path}/utf-16"


def _base64(run: str) -> bytes | None:
    """Bytes of a base64 run without its line breaks."""
    body = run.rstrip("=")
    if body.isalpha() and body[1:].islower():
        return None  # a word
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of base64 over several lines: all lines that may belong together, and those of one width with a shorter one behind them."""
    for m in WRAPPED.finditer(text):
        lines = [x.span() for x in _RUN.finditer(text, *m.span())]
        width = [b - a for a, b in lines]
        spans = {(0, len(lines))}
        at = 0
        while at < len(lines):
            end = at + 1
            while end < len(lines) and width[end] == width[at]:
                end += 1
            if end < len(lines) and width[end] < width[at]:
                spans.add((at, end + 1))
            if end - at > 1:
                spans.add((at, end))
            at = end
        for lo, hi in sorted(spans):
            end = m.end() if hi == len(lines) else lines[hi - 1][1]
            yield lines[lo][0], end, "".join(text[a:b] for a, b in lines[lo:hi])


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        for lo, hi in _lines(text, URL_ESCAPE):
            if (made := _replaced(layer, lo, hi, URL_ESCAPE, _url, "url")) is not None:
                yield made
    if "\\" in text:
        for lo, hi in _lines(text, UNICODE_ESCAPE):
            if (made := _replaced(layer, lo, hi, UNICODE_ESCAPE, _unicode, "unicode")) is not None:
                yield made
    single = ((*m.span(), m[0]) for m in BASE64.finditer(text))
    for lo, hi, run in (*single, *_wrapped(text)):
        if (raw := _base64(run)) is not None:
            a, b = layer.start[lo], layer.end[hi - 1]
            for inner, path in _contents(raw):
                yield Layer(inner, np.broadcast_to(a, len(inner)), np.broadcast_to(b, len(inner)), f"{layer.path}/{path}" if layer.path else path)


def _may_hold_layers(text: str) -> bool:
    return bool("%" in text and URL_ESCAPE.search(text) or "\\" in text and UNICODE_ESCAPE.search(text) or BASE64.search(text))


def findings(text: str | None) -> list[dict]:
    """All findings, by start, then kind in the order of ``KINDS``, then end; layers is empty for the text itself."""
    if not text:
        return []
    found = {(kind, a, b): "" for kind, a, b in base_findings(text)}
    if _may_hold_layers(text):
        place = np.arange(len(text) + 1)
        mark = lambda made: (hashlib.sha256(made.text.encode(errors="surrogatepass")).digest(), int(made.start.min()), int(made.end.max()))
        whole = Layer(text, place[:-1], place[1:], "")
        seen = {mark(whole)}
        work = [_unwrapped(whole)]
        while work:  # depth first: one window of each layer is held
            made = next(work[-1], None)
            if made is None:
                work.pop()
            elif made.text and (own := mark(made)) not in seen:
                seen.add(own)
                for kind, a, b in base_findings(made.text):
                    span = (kind, int(made.start[a:b].min()), int(made.end[a:b].max()))
                    found.setdefault(span, made.path)
                work.append(_unwrapped(made))
    order = sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [{"kind": k, "start": a, "end": b, "layers": path} for (k, a, b), path in order]


def scan(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """``df`` with ``findings``; a column of that name in any letter case is replaced."""
    ship(df.sparkSession)
    df = without(df, "findings")
    kept = [c for c in df.columns if keep_text or c != "text"]
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add("findings", FINDING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            made = pa.array((findings(t.as_py()) for t in text), _ARROW)
            yield pa.RecordBatch.from_arrays([*own, made], names=[*kept, "findings"])

    return df.mapInArrow(run, schema)
