"""Sizes of a holdout of the pairs that share a group, without a table of these pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcube.operators.shared import MEMBER_GROUPS, SIDE, met_members
from loomcube.storage import discard, materialise
from loomcube.workers import ship_package

#: Pairs that a task takes, and texts that are digested at once. A task gives a row a node and part of its own, so larger ones give fewer.
TASK_PAIRS, LANES = 4_000_000, 16_384
#: Between members at most, so that two fit one number, and up to which a table gives their places.
WIDEST, TABLE = 3_000_000_000, 1 << 22
LEAST_DDL = "node long, other long, h long, n long, hits long"

_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), 4, axis=0).reshape(4, 4, 4).reshape(64)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _short_digests(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of texts of one block: ``texts`` has 64 bytes a row, zero after its ``sizes`` bytes."""
    rows = np.arange(len(texts))
    texts[rows, sizes] = 0x80
    texts[:, 56:60] = (sizes * 8).astype("<u4").view(np.uint8).reshape(-1, 4)
    m = np.ascontiguousarray(texts.view("<u4").T)
    a, b, c, d = (np.full(len(texts), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += _SINES[i]
        f += m[_WORDS[i]]
        a, d, c = d, c, b
        b = b + ((f << _TURNS[i]) | (f >> np.uint32(32 - _TURNS[i])))
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return ((a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()) >> np.uint64(4)).astype(np.int64)


def digests(texts: pa.Array) -> np.ndarray:
    """For each text its MD5's first 15 hexadecimal digits as a number."""
    out = np.empty(len(texts), np.int64)
    for start in range(0, len(texts), LANES):
        some = pc.cast(texts.slice(start, LANES), pa.binary())
        sizes = pc.binary_length(some).to_numpy()
        block = np.zeros((len(some), 64), np.uint8)
        at = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some)]
        data = np.frombuffer(some.buffers()[2] or b"\0", np.uint8)
        for j in range(min(int(sizes.max()), 55)):
            block[:, j] = np.where(j < sizes, data[np.minimum(at + j, len(data) - 1)], 0)
        short = sizes <= 55
        part = _short_digests(block, np.minimum(sizes, 55))
        for i in np.flatnonzero(~short):
            part[i] = int(hashlib.md5(some[int(i)].as_py()).hexdigest()[:15], 16)
        out[start : start + len(some)] = part
    return out


def _different(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, sorted."""
    if not len(first):
        return first, second
    low, ranked = min(int(first.min()), int(second.min())), None
    span = max(int(first.max()), int(second.max())) - low + 1
    if span > WIDEST:  # numbers far apart: their ranks instead
        ranked = np.unique(np.concatenate([np.unique(first), np.unique(second)]))
        first, second, low, span = np.searchsorted(ranked, first), np.searchsorted(ranked, second), 0, len(ranked)
    packed = (first - low) * span + (second - low)
    packed.sort()
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    first, second = np.divmod(packed, span)
    return (first + low, second + low) if ranked is None else (ranked[first], ranked[second])


def _pairs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different members of ``a, bs``, sorted, and their places in the different pairs. Repeated pairs go as they gather."""
    firsts, seconds, held, most = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 2 * TASK_PAIRS
    for batch in batches:
        lists = batch.column("bs")
        firsts.append(np.repeat(batch.column("a").to_numpy(), lists.value_lengths().to_numpy()))
        seconds.append(lists.flatten().to_numpy())
        held += len(firsts[-1])
        if held > most:
            first, second = _different(np.concatenate(firsts), np.concatenate(seconds))
            firsts, seconds, held, most = [first], [second], len(first), max(most, 2 * len(first))
    first, second = _different(np.concatenate(firsts), np.concatenate(seconds))
    if not len(first) or (span := int(second.max()) - int(first.min()) + 1) > TABLE:
        members = np.unique(np.concatenate([np.unique(first), np.unique(second)]))
        return members, np.searchsorted(members, first), np.searchsorted(members, second)
    low, seen = int(first.min()), np.zeros(span, bool)
    seen[first - low] = seen[second - low] = True
    at = np.cumsum(seen) - 1
    return np.flatnonzero(seen) + low, at[first - low], at[second - low]


def _least(prefix: str, permille: int, seed: int):
    """For a task's different pairs: how many there are, how many the hash draws, and every member's pairs of the least hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, first, second = _pairs(batches)
        names = pc.binary_join_element_wise(prefix, pc.cast(pa.array(members), pa.string()), "")
        order = pc.array_sort_indices(names).to_numpy()
        place = np.empty(len(members), np.int64)
        place[order] = np.arange(len(members))
        swap = place[first] > place[second]
        low, high = np.where(swap, second, first), np.where(swap, first, second)
        h = np.empty(len(first), np.int64)
        for start in range(0, len(first), LANES):
            ends = (names.take(pa.array(x[start : start + LANES])) for x in (low, high))
            h[start : start + LANES] = digests(pc.binary_join_element_wise(*ends, str(seed), "|"))
        m = np.full(len(members), np.iinfo(np.int64).max)
        np.minimum.at(m, first, h)
        np.minimum.at(m, second, h)
        by_first, by_second = h == m[first], h == m[second]
        node = members[np.concatenate([first[by_first], second[by_second]])]
        other = members[np.concatenate([second[by_first], first[by_second]])]
        kept = np.concatenate([h[by_first], h[by_second]])
        none = pa.nulls(len(node), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(kept), none, none], ["node", "other", "h", "n", "hits"])
        absent = pa.nulls(1, pa.int64())
        hits = int(((h >> 8) % 1000 < permille).sum())
        yield pa.RecordBatch.from_arrays([absent, absent, absent, pa.array([len(h)]), pa.array([hits])], ["node", "other", "h", "n", "hits"])

    return of


def shared_holdout_sizes(rows: DataFrame, group: str, member: str, prefix: str, share: float = 0.3, seed: int = 1, side: int = SIDE, member_groups: int = MEMBER_GROUPS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """``part, n``: the sizes of :func:`loomcube.operators.kg.holdout` of the pairs that share groups, whose nodes are ``prefix`` and a number.

    Every pair is made and digested, once, where its first member arrives; only a node's least hashes and sums leave a
    task. A pair is kept in training if its hash is the least of one of its ends.
    """
    spark = rows.sparkSession
    ship_package(spark)
    met, keys, pairs, written = met_members(rows.select(F.col(group).cast("long").alias(group), F.col(member).cast("long").alias(member)), group, member, side, member_groups)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // task_pairs))
    least = materialise(met.repartition(n, *keys).select("a", "bs").mapInArrow(_least(prefix, int(share * 1000), seed), LEAST_DDL), "least")
    ends = least.filter("node IS NOT NULL").select("node", "other", "h")
    own = ends.groupBy("node").agg(F.min("h").alias("m"))
    kept = ends.join(own, "node").filter("h = m").select(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), "h").distinct()
    drawn = kept.agg(F.count_if(F.pmod(F.shiftrightunsigned("h", 8), F.lit(1000)) < int(share * 1000)).alias("kept"))
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    sizes = total.crossJoin(drawn).select("n", (F.col("hits") - F.col("kept")).alias("test"))
    out = materialise(sizes.select(F.explode(F.array(F.struct(F.lit("test").alias("part"), F.col("test").alias("n")), F.struct(F.lit("train").alias("part"), (F.col("n") - F.col("test")).alias("n")))).alias("s")).select("s.*").filter("n > 0"), "sizes")
    discard(least, *written)
    return out
