"""Secret scans: patterns over whole texts and over every layer that can be decoded out of them.

A document is a worklist of items. The first is the text itself; its matches are the base spans. Each item is searched
for encoded stretches, and what they decode to goes back into the worklist with a map from its characters to those of
the document, until nothing new can be decoded. Layers: URL escapes, Unicode escapes and character references, base64
(both alphabets, any alignment, folded lines) and, inside of it, zlib and gzip.

Three facts keep the work near the size of the text without a limit on depth. A match holds only characters of
:data:`LIVE`, so escapes are decoded within the stretch of such characters around them instead of the whole text. A
match has 16 characters or more, so shorter decoded stretches hold none. And URL, Unicode and base64 layers get
shorter with each step, so only decompression can come back to a text met before: an item that equals one of those it
was decoded from is a cycle and is left.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm.common import map_arrow

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex")
#: Least length of a match of any kind.
LEAST = 16
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters that a match, or an escape of such a character, can consist of.
LIVE = r"""A-Za-z0-9+/_.=\-"':\x20%\\&#;{}"""
LIVE_RUN = re.compile(f"[{LIVE}]+")
#: A nested escape of an escape sign is taken off at once: ``%252541`` is one letter.
URL = re.compile(r"(?:%(?:25)*(?!25)[0-9A-Fa-f]{2}|%(?:25)+)+")
URL_BYTE = re.compile(r"%(?:25)*((?!25)[0-9A-Fa-f]{2})|%(?:25)+")
UNICODE = re.compile(r"\\+u([0-9A-Fa-f]{4})|\\+u\{([0-9A-Fa-f]{1,6})\}|\\+U([0-9A-Fa-f]{8})|\\+x([0-9A-Fa-f]{2})|&#0*([0-9]{1,7});|&#[xX]0*([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}(?:\r?\n[A-Za-z0-9+/_-]+)*")
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
STANDARD = str.maketrans("-_", "+/")
#: Bytes that decompression hands on at a time.
PIECE = 1 << 20

Span = tuple[int, int, int]


class Item(NamedTuple):
    """A layer: its text, the first and the end character of the document of each of its characters, its ancestors."""

    text: str
    first: np.ndarray | range
    end: np.ndarray | range
    above: frozenset[bytes]


def matches(text: str) -> Iterator[Span]:
    """``start, rank of the kind, end`` of all matches in ``text``; leftmost and without overlap within a kind."""
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        yield from ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST)
    yield from ((m.start(), 1, m.end()) for m in ACCESS.finditer(text))
    yield from ((m.start(), 2, m.end()) for m in HEX.finditer(text))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _take(places: np.ndarray | range, index: np.ndarray) -> np.ndarray:
    return index + places.start if isinstance(places, range) else places[index]


def _child(item: Item, text: str, first: np.ndarray, end: np.ndarray) -> Iterator[Item]:
    own = _digest(text)
    if own not in item.above:
        yield Item(text, first, end, item.above | {own})


def _unescape_url(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of URL escapes with their places; bytes that are no UTF-8 stand for themselves."""
    parts = [(int(b.group(1) or "25", 16), b.start(), b.end()) for b in URL_BYTE.finditer(m.string, m.start(), m.end())]
    raw, out, at = bytes(p[0] for p in parts), [], 0
    for char in raw.decode("utf-8", "surrogateescape"):
        size = len(char.encode("utf-8", "surrogateescape"))
        out.append((char if char.isprintable() or char in "\t\n\r" else "\ufffd", parts[at][1], parts[at + size - 1][2]))
        at += size
    return out


def _unescape_unicode(m: re.Match) -> list[tuple[str, int, int]]:
    hexadecimal = m.group(1) or m.group(2) or m.group(3) or m.group(4) or m.group(6)
    code = int(hexadecimal, 16) if hexadecimal else int(m.group(5))
    return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", m.start(), m.end())]


def _unescaped(item: Item, pattern: re.Pattern, decode) -> Iterator[Item]:
    """Every stretch of live characters with a match of ``pattern``, decoded."""
    text, at = item.text, 0
    while found := pattern.search(text, at):
        start = found.start()
        while start > at and LIVE_RUN.match(text, start - 1, start):
            start -= 1
        at = end = LIVE_RUN.match(text, found.start()).end()
        chars: list[str] = []
        first: list[int] = []
        last: list[int] = []
        place = start
        for m in pattern.finditer(text, start, end):
            chars.append(text[place : m.start()])
            first.extend(item.first[place : m.start()])
            last.extend(item.end[place : m.start()])
            for char, a, b in decode(m):
                chars.append(char)
                first.append(item.first[a])
                last.append(item.end[b - 1])
            place = m.end()
        chars.append(text[place:end])
        first.extend(item.first[place:end])
        last.extend(item.end[place:end])
        if len(first) >= LEAST:
            yield from _child(item, "".join(chars), np.array(first, np.int64), np.array(last, np.int64))


def _inflated(packed: bytes) -> Iterator[str]:
    """Printable stretches of decompressed bytes, a piece at a time; nothing if the bytes are not compressed."""
    stream, carry = zlib.decompressobj(wbits=47), b""
    try:
        while not stream.eof:
            piece = stream.decompress(packed, PIECE)
            packed = stream.unconsumed_tail
            if not piece and not packed:
                break
            carry += piece
            found = list(PRINTABLE.finditer(carry))
            for m in found:
                if m.end() < len(carry):
                    yield m.group().decode()
            if found and found[-1].end() == len(carry):
                carry = carry[found[-1].start() :]
                cut = carry.rfind(b"\n")  # no match holds one
                if cut > PIECE // 2:
                    yield carry[:cut].decode()
                    carry = carry[cut:]
            else:
                carry = carry[-LEAST:]
    except zlib.error:
        pass
    yield from (m.group().decode() for m in PRINTABLE.finditer(carry))


def _unwrapped(item: Item) -> Iterator[Item]:
    """What base64 stretches hold: printable text, mapped by groups of four, and compressed text, mapped as a whole."""
    for m in BASE64.finditer(item.text):
        signs = np.frombuffer(m.group().encode(), np.uint8)
        places = m.start() + np.flatnonzero((signs != 10) & (signs != 13))
        sent = m.group().replace("\r", "").replace("\n", "").translate(STANDARD)
        for shift in range(4):
            body = sent[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            for p in PRINTABLE.finditer(raw):
                index = np.arange(p.start(), p.end())
                index = shift + index // 3 * 4 + index % 3
                yield from _child(item, p.group().decode(), _take(item.first, places[index]), _take(item.end, places[index + 1]))
            for p in PACKED.finditer(raw):
                first, end = item.first[places[shift + p.start() // 3 * 4]], item.end[places[-1]]
                for text in _inflated(raw[p.start() :]):
                    yield from _child(item, text, np.full(len(text), first), np.full(len(text), end))


def layers(text: str) -> Iterator[Item]:
    """The text and all that can be decoded out of it, each with its map to the characters of the text."""
    whole = range(len(text) + 1)
    todo = [iter([Item(text, whole[:-1], whole[1:], frozenset([_digest(text)]))])]
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
            continue
        yield item
        if "%" in item.text:
            todo.append(_unescaped(item, URL, _unescape_url))
        if "\\" in item.text or "&#" in item.text:
            todo.append(_unescaped(item, UNICODE, _unescape_unicode))
        todo.append(_unwrapped(item))


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text as sorted ``(start, rank of the kind, end)``; null has none."""
    found: set[Span] = set()
    base: list[Span] = []
    for k, item in enumerate(layers(text or "")):
        if not k:
            base = sorted(matches(item.text))
            found.update(base)
        else:
            found.update((int(item.first[start]), kind, int(item.end[end - 1])) for start, kind, end in matches(item.text))
    return base, sorted(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every whole text: lists of ``kind, start, end``, in code points, the end exclusive.

    No exchange: each text is scanned where it is read, one at a time. Spans of decoded layers cover the encoded
    characters of the text. Null, empty and clean texts have empty lists. Repeated rows and doc_ids, null ones too,
    are kept as they are; other columns are ignored. Memory grows with the longest text and the longest stretch
    without a line end of what it holds compressed; a packed text of any size is read a piece at a time.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [scan(text.as_py()) for text in batch.column(1)]
            lists = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in p[side]] for p in pairs], kind) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "base", "spans"])

    schema = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and the digest of the base spans, and all spans as one string, one row per document; see :func:`find_secrets`."""

    def text_of(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return find_secrets(docs).select("doc_id", *map(number, KINDS), F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("spans").alias("spans"), added)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
