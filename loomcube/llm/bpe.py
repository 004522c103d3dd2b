"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks.

Pre-tokens are linked lists of tokens. Every adjacent pair that some rank joins puts its left position into the
bucket of that rank, and a bitmap of two levels marks the buckets in use; find-first-set gives the lowest rank.
Positions whose pair has changed since are stale and skipped. A merge costs a constant number of steps, so very
long pre-tokens stay near linear where a scan for the lowest rank would be quadratic.

The lists of all pre-tokens that a block of texts brings up for the first time share one queue: ranks are taken in
the same order within each of them, and the positions of a bucket are merged at once, in numpy. :func:`merge` is
the same with one list and one position at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomcube.llm.common import map_arrow

#: Different pre-tokens and their ids kept per Python worker; beyond, both are forgotten. It bounds memory, not results.
CACHE_ENTRIES, CACHE_IDS = 500_000, 8_000_000
#: Characters of text whose new pre-tokens are merged together, and matches of the pattern taken from a text at a time.
BLOCK_CHARS, MATCHES = 8_000_000, 100_000
#: Ids that are spelt out at a time.
SPELT = 1 << 18
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Positions in buckets by rank; ``lowest`` is find-first-set over a bitmap of 256-bit words under one top word."""

    __slots__ = ("buckets", "top", "words")

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, position) -> None:
        """One position, or an array of them."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.words[word] = self.words.get(word, 0) | 1 << (rank & 255)
        self.top |= 1 << word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        bounds = np.concatenate([[0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(ranks)]]).tolist()
        for rank, a, b in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):  # noqa: B905
            self.push(rank, positions[a:b])

    def lowest(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        return word << 8 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list:
        """Removes the bucket and gives what was pushed into it."""
        word = rank >> 8
        bits = self.words[word] & ~(1 << (rank & 255))
        self.words[word] = bits
        if not bits:
            self.top &= ~(1 << word)
        return self.buckets.pop(rank)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the lowest rank first, leftmost first within a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the token that starts here
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the pair whose left token starts here
    queue = RankQueue()
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2], -1)
        if rank >= 0:
            pair[i] = rank
            queue.push(rank, i)
    while (rank := queue.lowest()) >= 0:
        positions = sorted(queue.take(rank))
        for at, i in enumerate(positions):
            if pair[i] != rank:
                continue
            middle = ends[i]
            end = ends[i] = ends[middle]
            pair[middle] = -1
            below = rank
            if end < n:
                before[end] = i
                pair[i] = new = get(piece[i : ends[end]], -1)
                if new >= 0:
                    queue.push(new, i)
                    below = min(below, new)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = new = get(piece[left:end], -1)
                if new >= 0:
                    queue.push(new, left)
                    below = min(below, new)
            if below < rank:  # a lower rank has come up: it goes first
                for j in positions[at + 1 :]:
                    queue.push(rank, j)
                break
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Merges:
    """The rank file, as a mapping of bytes and as a table of the pairs of tokens that make up another token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.many = max(ranks.values()) + 1
        get, keys, made = ranks.get, [], []
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = get(token[:at]), get(token[at:])
                if left is not None and right is not None:
                    keys.append(left * self.many + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(made, np.int64)[order], -1)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where there is none; a token of -1 joins with nothing."""
        key = left * self.many + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after the other, and the first one of each (with a last bound)."""
        whole = list(map(self.ranks.get, pieces))
        parts = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        ids, bounds = self._linked(parts)
        if len(parts) == len(pieces):
            return ids, bounds
        size = np.ones(len(pieces), np.int64)
        known = np.array([w is not None for w in whole])
        size[~known] = np.diff(bounds)
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(ends[-1], np.int64)
        mask = np.ones(len(out), bool)
        mask[ends[:-1][known]] = False
        out[mask], out[~mask] = ids, [w for w in whole if w is not None]
        return out, ends

    def _linked(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes + 1)  # a token of -1 ends each list
        starts = stops - sizes - 1
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        n = len(raw)
        token = self.single[raw]
        token[stops - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1)
        pair[:-1] = self.of(token[:-1], token[1:])
        queue = RankQueue()
        at = np.flatnonzero(pair >= 0)
        queue.push_all(pair[at], at)
        odd: dict[int, list[int]] = {}
        while (rank := queue.lowest()) >= 0:
            taken = queue.take(rank)
            at = taken[0] if len(taken) == 1 else np.concatenate(taken)
            at = np.sort(at[pair[at] == rank])
            if not len(at):
                continue
            middle = after[at]
            chained = at[1:] == middle[:-1]
            if chained.any():  # every second one of a chain, as its token is the right one of the one before
                begin = np.concatenate([[True], ~chained])
                nth = np.arange(len(at)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
                at, middle = at[nth % 2 == 0], middle[nth % 2 == 0]
            end = after[middle]
            ahead = self.of(np.full(len(at), rank), token[end])  # before the next one of a chain is merged
            token[at], token[middle] = rank, -1
            pair[middle] = -1
            after[at], before[end] = end, at
            left = before[at]
            other = left >= 0
            other[1:] &= end[:-1] != at[1:]  # else the one on the left is itself among the merged
            changed = np.concatenate([at, left[other]])
            new = self.of(token[changed], token[after[changed]])
            pair[changed] = new
            low = (new >= 0) & (new < rank)
            early = (ahead >= 0) & (ahead < rank)
            if low.any() or early.any():  # a lower rank has come up in the middle of a bucket: merged by themselves
                for i in np.unique(np.searchsorted(stops, np.concatenate([changed[low], at[early]]), "right")).tolist():
                    odd[i] = merge(pieces[i], self.ranks)
                    pair[starts[i] : stops[i]] = -1
            good = pair[changed] >= 0
            queue.push_all(pair[changed][good], changed[good])
        live = token >= 0
        for i, ids in odd.items():
            live[starts[i] : stops[i]] = False
            token[starts[i] : starts[i] + len(ids)] = ids
            live[starts[i] : starts[i] + len(ids)] = True
        count = np.concatenate([[0], np.cumsum(live)])
        return token[live], np.append(count[starts], count[-1])


class Numbers(dict):
    """Numbers of pre-tokens in the order in which they come up; ``fresh`` holds those without ids so far."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches of a table, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Spelling:
    """A string of bytes for each id, in one table."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> Iterator[bytes]:
        """The strings of ``ids``, one after the other, some at a time."""
        for at in range(0, len(ids), SPELT):
            part = ids[at : at + SPELT]
            yield self.table[stretches(self.start[part], self.size[part])].tobytes()

    def each(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[Iterator[bytes]]:
        """The strings of every stretch ``bounds[i]:bounds[i + 1]`` of ``ids``, in pieces."""
        row, n = 0, len(bounds) - 1
        while row < n:
            end = max(int(np.searchsorted(bounds, bounds[row] + SPELT, "right")) - 1, row + 1)
            if end == row + 1:
                yield self.of(ids[bounds[row] : bounds[end]])
            else:  # several short ones at a time
                part = ids[bounds[row] : bounds[end]]
                size = self.size[part]
                ends = np.concatenate([[0], np.cumsum(size)])[bounds[row : end + 1] - bounds[row]].tolist()
                raw = self.table[stretches(self.start[part], size)].tobytes()
                for a, b in zip(ends, ends[1:]):  # noqa: B905
                    yield iter([raw[a:b]])
            row = end


class Codec:
    """Encodes whole texts under a rank file and the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        self.pattern = regex.compile(pattern)
        by_id = dict(map(reversed, self.merges.ranks.items()))
        self.bytes_of = Spelling([by_id.get(i, b"") for i in range(self.merges.many)])
        self.decimal_of = Spelling([b" %d" % i for i in range(self.merges.many)])
        self.forget()

    def forget(self) -> None:
        self.numbers, self.ids, self.bounds = Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern; those of a long text in several lists."""
        if len(text) <= MATCHES:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, MATCHES)]:
            yield part

    def learn(self) -> None:
        """Ids of the pre-tokens that have none so far."""
        fresh = self.numbers.fresh
        ids, bounds = self.merges.all([p.encode() for p in fresh])
        self.bounds = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        fresh.clear()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the first one of each (with a last bound)."""
        if len(self.numbers) > CACHE_ENTRIES or len(self.ids) > CACHE_IDS:
            self.forget()
        number, coded, ends = self.numbers.__getitem__, [np.zeros(0, np.int32)], [0]
        for text in texts:
            size = 0
            for part in self.pieces(text):
                coded.append(np.fromiter(map(number, part), np.int32, len(part)))
                size += len(part)
            ends.append(ends[-1] + size)
        self.learn()
        coded = np.concatenate(coded)
        size = np.diff(self.bounds)
        out = [np.zeros(0, np.int32)]
        for at in range(0, len(coded), SPELT):
            part = coded[at : at + SPELT]
            out.append(self.ids[stretches(self.bounds[part], size[part])])
        total = np.concatenate([[0], np.cumsum(size[coded])])
        return np.concatenate(out), total[ends]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of.of(np.asarray(ids, np.int64)))

    def blocks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, end row, ids, bounds)`` of blocks of about :data:`BLOCK_CHARS` characters; nulls are empty."""
        texts, size, first = [], 0, 0
        for row, value in enumerate(column, 1):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS or row == len(column):
                yield first, row, *self.encode_all(texts)
                texts, size, first = [], 0, row


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def sha256(parts: Iterator[bytes], skip: int = 0) -> str:
    """Digest of the parts, one after the other, without the first ``skip`` bytes."""
    digest = hashlib.sha256(next(parts, b"")[skip:])
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every whole text; a null or empty text has no ids.

    Repeated rows and doc_ids, null ones too, are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for first, end, ids, bounds in own.blocks(batch.column(1)):
                decoded = list(map(sha256, own.bytes_of.each(ids, bounds)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(bounds), pa.int64()), lists, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the bytes decoded from them, one row per document.

    No exchange: each text is encoded where it is read, a few texts at a time. Null and empty texts have 0 tokens
    and the digest of nothing. Repeated rows and doc_ids, null ones too, are kept as they are; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for first, end, ids, bounds in own.blocks(batch.column(1)):
                coded = [sha256(parts, 1) for parts in own.decimal_of.each(ids, bounds)]  # no blank before the first
                decoded = list(map(sha256, own.bytes_of.each(ids, bounds)))
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(bounds), pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def default_tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern; a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizer())
