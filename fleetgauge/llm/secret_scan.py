"""Secrets in texts, also inside nested encodings, by a worklist of decoded layers.

The base rules run over the text as it is. Then every layer of the worklist is searched for encoded
parts: URL escapes, Unicode escapes and character references, base64 and compressed bytes (gzip,
zlib, zstd; inside base64 or written with escapes of either kind, also several one after another). A base64 run goes over line
breaks and is decoded from each of its first four characters, as what stands before a blob may be of its alphabet too; invalid
UTF-8 is replaced, not refused. Each decoded part is a new layer, scanned by the same rules and
put on the worklist again, until nothing new turns up. A layer that has been seen for the same place of
the text is not decoded again, so cycles end. Every layer knows for each of its characters which characters
of the text it comes from, so a finding gives the span of the text that encodes it.

Compressed bytes give layers of bytes. All of such a layer stands for the same part of the text, so it needs no places, and the
rules, which know ASCII only, run over the bytes as they are. Streams are looked for at every offset of it, as are escapes
and base64, so layers may nest in any order and to any depth: the worklist is a list, not a recursion, and a layer seen for the same
place (by its digest) is not entered again, so a stream that unpacks to itself ends too. What a broken stream gives before it breaks counts.

A layer is held whole, so memory follows the largest one. A stream that gives more than ``WINDOW`` bytes, which takes a text
of over 250 KB or streams in streams, is handed on in windows, cut behind a byte that no rule and no encoding contains; what
is lost then is the rest of an inner compressed stream that lies across such a cut. Base rules whose match is too short are dropped after matching.

Defined cases: null text is empty; spans count code points, end exclusive; the spans of ``spans`` are
distinct and sorted by start, then kind as in ``KINDS``, then end; a repeated row gets a row each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from html import unescape
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from fleetgauge.llm.common import by_text

KINDS = ("assign", "access", "hex")
# fixed values: the base patterns and the least lengths of what they match
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
BREAK = re.compile(r"\r?\n[ \t]*")
STANDARD = str.maketrans("-_", "+/")
#: First bytes of gzip, zlib and zstd.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")
#: Escapes for bytes, among them the short ones that accompany escapes in a string.
BYTE = re.compile(r"""\\[abfnrtv0'"\\/](?!x)|\\\\|""" + ESCAPE.pattern)
SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0"))
#: What any finding or encoded part must contain; texts without it are done.
HINT = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|"""
        r"""\\[uUx][0-9A-Fa-f{]|&#|[A-Za-z0-9+/_-]{16}""")
HINTED = re.compile(HINT)

#: Compressed bytes read at a time, and unpacked bytes that one layer holds.
STEP = 1 << 16
WINDOW = 256 << 20
ZSTD = b"\x28\xb5\x2f\xfd"
RULES = (("assign", re.compile(ASSIGN.pattern.encode(), re.IGNORECASE)), ("access", re.compile(ACCESS.pattern.encode())),
         ("hex", re.compile(HEX.pattern.encode())))
URL_BYTES, ESCAPE_BYTES, BYTE_BYTES, BASE64_BYTES, BREAK_BYTES, HINTED_BYTES = (
    re.compile(r.encode()) for r in (URL.pattern, ESCAPE.pattern, BYTE.pattern, BASE64.pattern, BREAK.pattern, HINT))
#: Bytes that no rule and no encoding contains.
APART = re.compile(rb"[^A-Za-z0-9+/_=.\-\"':%\\&#;{}\r\n\t ]")

Span = tuple[str, int, int]
#: A layer of bytes and the part of the text that it stands for.
Bytes = tuple[bytes, tuple[int, int]]


class Layer:
    """A decoded text and, per character, the first and last-plus-one character of the text it stands for.

    ``start`` and ``end`` are None for the text itself and whole numbers where every character stands
    for the same part.
    """

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start=None, end=None):
        self.text, self.start, self.end = text, start, end

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        if isinstance(self.start, int):
            return self.start, self.end
        return self.start[a], self.end[b - 1]


def rule_spans(text: str) -> Iterator[Span]:
    """Matches of the base rules, long enough, per kind leftmost and non-overlapping."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            yield "assign", m.start(), m.end()
    for kind, rule in (("access", ACCESS), ("hex", HEX)):
        for m in rule.finditer(text):
            if m.end() - m.start() >= LEAST[kind]:
                yield kind, m.start(), m.end()


def _rewritten(layer: Layer, rule: re.Pattern, decode) -> Layer | None:
    """The layer with each match of ``rule`` replaced by what ``decode`` gives: (characters, their places)."""
    out, start, end, at, changed = [], array("q"), array("q"), 0, False

    def copy(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        for i in range(a, b):
            s, e = layer.place(i, i + 1)
            start.append(s)
            end.append(e)

    for m in rule.finditer(layer.text):
        parts = decode(m[0])
        if parts is None:
            continue
        copy(at, m.start())
        for text, a, b in parts:
            s, e = layer.place(m.start() + a, m.start() + b)
            for _ in text:
                start.append(s)
                end.append(e)
            out.append(text)
        at, changed = m.end(), True
    if not changed:
        return None
    copy(at, len(layer.text))
    return Layer("".join(out), start, end)


def _url(match: str):
    raw = bytes.fromhex(match.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    parts, at = [], 0
    for c in text:
        n = 3 * (len(c.encode()) if len(text) != len(raw) or c < "\x80" else 1)
        parts.append((c, at, at + n))
        at += n
    return parts


def _escape(match: str):
    if match[0] == "&":
        text = unescape(match)
    else:
        code = int(match[2:].strip("{}"), 16)
        text = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return [(text, 0, len(match))]


def _inflated(raw: bytes, start: int) -> tuple[list[bytes], int]:
    """What the stream at ``start`` holds, in windows, and its end (0 if it does not end whole)."""
    engine = zstandard.ZstdDecompressor().decompressobj() if raw.startswith(ZSTD, start) else zlib.decompressobj(47)
    windows, out, at, broken = [], bytearray(), start, False
    while at < len(raw) and not engine.eof and not broken:
        step = raw[at:at + STEP]
        at += len(step)
        try:
            out += engine.decompress(step)
        except (zlib.error, zstandard.ZstdError):
            broken = True
            out += _before_error(raw, start, at - len(step), step)
        if len(out) > WINDOW:
            cut = next((m.end() for m in APART.finditer(out, WINDOW - (WINDOW >> 4))), WINDOW)
            windows.append(bytes(out[:cut]))
            del out[:cut]
    windows.append(bytes(out))
    return [w for w in windows if w], at - len(engine.unused_data) if engine.eof else 0


def _before_error(raw: bytes, start: int, good: int, step: bytes) -> bytes:
    """What the step in which a stream breaks gives before it does, byte by byte; the steps before it are read again."""
    engine = zstandard.ZstdDecompressor().decompressobj() if raw.startswith(ZSTD, start) else zlib.decompressobj(47)
    for at in range(start, good, STEP):
        engine.decompress(raw[at:min(at + STEP, good)])
    out = bytearray()
    try:
        for i in range(len(step)):
            out += engine.decompress(step[i:i + 1])
    except (zlib.error, zstandard.ZstdError):
        pass
    return bytes(out)


def _unpacked(raw: bytes) -> Iterator[tuple[list[bytes], int, int]]:
    """Windows, first byte and end of every compressed stream in ``raw``.

    The end of a broken stream is that of ``raw``; after it the search goes on behind its first byte.
    """
    at = 0
    while (m := PACKED.search(raw, at)) is not None:
        windows, end = _inflated(raw, m.start())
        if windows:
            yield windows, m.start(), end or len(raw)
        at = end or m.start() + 1


def _url_bytes(m: re.Match) -> bytes:
    return bytes.fromhex(m[0].decode().replace("%", ""))


def _escape_bytes(m: re.Match) -> bytes:
    return _escape(m[0].decode())[0][0].encode()


def _byte(found: str) -> bytes:
    """The byte an escape stands for, or the UTF-8 bytes of a character beyond them."""
    if found[0] == "\\" and found[1] not in "uUx":
        return bytes([SHORT.get(found[1], ord(found[1]))])
    digits = found[2:].strip("{};")
    code = int(digits.lstrip("xX"), 16 if found[0] == "\\" or digits[:1] in "xX" else 10)
    return bytes([code]) if code < 256 else _escape(found)[0][0].encode()


def _inner(raw: bytes) -> Iterator[bytes]:
    """The layers one step of decoding away from a layer of bytes."""
    if URL_BYTES.search(raw):
        yield URL_BYTES.sub(_url_bytes, raw)
    if ESCAPE_BYTES.search(raw):
        yield ESCAPE_BYTES.sub(_escape_bytes, raw)
        yield BYTE_BYTES.sub(lambda m: _byte(m[0].decode()), raw)
    for m in BASE64_BYTES.finditer(raw):
        whole = BREAK_BYTES.sub(b"", m[0]).replace(b"-", b"+").replace(b"_", b"/")
        for shift in range(4):
            body = whole[shift:]
            body = body[:-1] if len(body) % 4 == 1 else body
            got = base64.b64decode(body + b"=" * (-len(body) % 4))
            if HINTED_BYTES.search(got) or PACKED.search(got):
                yield got
    for windows, *_ in _unpacked(raw):
        yield from windows


def _byte_kinds(raw: bytes) -> Iterator[str]:
    for kind, rule in RULES:
        if any(len(m[2] if kind == "assign" else m[0]) >= LEAST[kind] for m in rule.finditer(raw)):
            yield kind


def _escaped(layer: Layer, rule: re.Pattern) -> tuple[bytes, array, array]:
    """The layer as bytes with its escapes resolved, and for each byte the characters of the layer it is written by."""
    out, first, last = bytearray(), array("q"), array("q")

    def add(raw: bytes, a: int, b: int) -> None:
        out.extend(raw)
        first.extend([a] * len(raw))
        last.extend([b] * len(raw))

    def copy(a: int, b: int) -> None:
        for i in range(a, b):
            add(layer.text[i].encode("utf-8", "surrogatepass"), i, i + 1)

    at = 0
    for m in rule.finditer(layer.text):
        copy(at, m.start())
        at = m.end()
        if m[0][0] == "%":
            for i in range(m.start(), m.end(), 3):
                add(bytes.fromhex(layer.text[i + 1:i + 3]), i, i + 3)
        else:
            add(_byte(m[0]), m.start(), m.end())
    copy(at, len(layer.text))
    return bytes(out), first, last


def _hinted(text: str) -> bool:
    """Whether a text may hold findings or encoded parts."""
    if len(text) < 4096:
        return HINTED.search(text) is not None
    return pc.match_substring_regex(pa.array([text]), HINT)[0].as_py()


def _decoded(layer: Layer, m: re.Match) -> Iterator[Layer | Bytes]:
    """What a run of base64 says, from each of its first four characters on."""
    parts, spots, at = [], [], m.start()
    for gap in [*BREAK.finditer(m[0]), None]:
        end = m.end() if gap is None else m.start() + gap.start()
        parts.append(layer.text[at:end])
        spots.append(range(at, end))
        at = end if gap is None else m.start() + gap.end()
    spots = spots[0] if len(spots) == 1 else array("q", chain.from_iterable(spots))
    whole = "".join(parts).translate(STANDARD)
    for shift in range(4):
        body = whole[shift:]
        if len(body) % 4 == 1:
            body = body[:-1]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        # byte i of the decoded bytes is written by characters 4i/3 to 4(i+1)/3
        place = lambda a, b: layer.place(
            spots[shift + a * 4 // 3], spots[shift + min(len(body), -(-b * 4 // 3)) - 1] + 1)
        text = raw.decode("utf-8", "replace")
        if _hinted(text):
            start, end, at = array("q"), array("q"), 0
            for c in raw.decode("utf-8", "surrogateescape"):
                n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
                s, e = place(at, at + n)
                start.append(s)
                end.append(e)
                at += n
            yield Layer(re.sub("[\udc80-\udcff]", "\ufffd", raw.decode("utf-8", "surrogateescape")), start, end)
        for windows, a, b in _unpacked(raw):
            for unpacked in windows:
                yield unpacked, place(a, b)


def _parts(layer: Layer) -> Iterator[Layer | Bytes]:
    """The layers one step of decoding away from a layer of text."""
    for rule, decode, byte in ((URL, _url, URL), (ESCAPE, _escape, BYTE)):
        if (new := _rewritten(layer, rule, decode)) is not None:
            yield new
            raw, first, last = _escaped(layer, byte)
            for windows, a, b in _unpacked(raw):
                at = layer.place(first[a], first[a] + 1)[0], layer.place(last[b - 1] - 1, last[b - 1])[1]
                for unpacked in windows:
                    yield unpacked, at
    for m in BASE64.finditer(layer.text):
        yield from _decoded(layer, m)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, each sorted by start, kind and end."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = set(rule_spans(text))
    found, seen, work = set(base), set(), [Layer(text)]
    while work:
        layer = work.pop()
        if isinstance(layer, Layer):
            at = layer.place(0, len(layer.text)) if layer.text else (0, 0)
            content = layer.text.encode("utf-8", "surrogatepass")
        else:
            content, at = layer
        name = (isinstance(layer, Layer), hashlib.sha256(content).digest(), at)
        if name in seen:
            continue
        seen.add(name)
        if not isinstance(layer, Layer):
            found.update((kind, *at) for kind in _byte_kinds(content))
            work.extend((inner, at) for inner in _inner(content))
            continue
        if layer.start is not None:
            found.update((kind, *layer.place(a, b)) for kind, a, b in rule_spans(layer.text))
        work.extend(_parts(layer))
    key = lambda s: (s[1], order[s[0]], s[2])
    return sorted(base, key=key), sorted(found, key=key)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found``: the spans as text, ``kind:start:end`` joined by commas."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = piece.column("text")
        hint = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()
        base, found = [], []
        for at, there in enumerate(hint):
            a, b = find(texts[at].as_py()) if there else ([], [])
            base.append(joined(a))
            found.append(joined(b))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(base, pa.string()), pa.array(found, pa.string())],
                                          ["doc_id", "base", "found"])

    return by_text(docs, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, base string, found string")
