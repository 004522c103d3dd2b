"""Exact substring deduplication with suffix arrays per shard and a merge across shards.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or same
document and earlier start). Five steps, each of linear output:

1. Equal texts are reduced to one; later copies are removed whole.
2. Every window of ``LENGTH`` bytes is named by the least hash of its ``GRAM``-byte strings. Equal windows have
   equal names, and neighbouring windows mostly share theirs, so runs of windows are a few per cent of the bytes.
   Names that occur once in the corpus cannot repeat anything.
3. The runs of other names, with the bytes they cover, go to shards by name. A shard leaves out what agrees with
   nothing else around the named string, and sorts all suffixes of the other bytes by Larsson-Sadakane refinement and gets their common prefixes by Kasai's scan; neighbours that share
   ``LENGTH`` bytes form a group, whose earliest member stays.
4. A name with very many runs is spread over several shards. The windows that stay in each of these are merged
   across the shards by binary search in their sorted bytes.
5. Removed spans go back to their texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm import textvec as tv
from loomcube.llm.common import checked_broadcast, deal, discard, map_arrow, materialise, shared_dir, text_blocks, whole_groups

U = np.uint64
LENGTH, GRAM = 100, 24
#: Runs of one name that a single shard takes; bytes of segments whose suffixes are sorted at a time.
SHARD_RUNS, SHARD_BYTES = 5_000, 2 << 20
#: Positions of a segment that one lane of the prefix scan takes.
LANE = 1024
#: Bytes of text whose names are compared before they leave a task.
LOCAL_BYTES = 8 << 20
_RUN = "key long, name long, tid binary, first int, last int, plain boolean, seen long"
_FOUND = "merge boolean, tid binary, start int, stop int, key long, ord long, window binary"


def sliding(values: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """``best`` over all runs of ``span`` values, by doubling."""
    width = 1
    while 2 * width <= span:
        values = best(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def gram_hashes(sums: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM``-byte strings at all places, from the prefix sums of the bytes."""
    _, inverse = tv._powers(len(sums))
    grams = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(sums) - GRAM]
    grams ^= grams >> U(32)
    return grams * U(0xBF58476D1CE4E5B9)


def window_names(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows of one name: text, first and last start within it, name, and whether the named string
    occurs in the run more than once, so that windows of this very run may be equal."""
    none = np.zeros(0, np.int64)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return none, none, none, none.astype(U), none.astype(bool)
    grams = gram_hashes(tv.prefix(buf))
    span = LENGTH - GRAM + 1
    least = sliding(grams, span, np.minimum)
    starts = offsets[:-1]
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    valid = np.zeros(n + 1, np.int32)
    has = count > 0
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, starts[has] + count[has], -1)
    valid = np.cumsum(valid)[:n] > 0
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begin = np.zeros(n, bool)
    begin[starts[has]] = True
    first |= begin & valid
    at = np.flatnonzero(first)
    text = np.searchsorted(offsets, at, "right") - 1
    nxt = np.append(at[1:], n)
    last = np.minimum(nxt, starts[text] + count[text]) - 1
    own = np.zeros(len(at), bool)
    if len(at):
        pad = np.zeros(span - 1, U)
        chosen = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), span, np.maximum) == grams)
        twice = np.flatnonzero(grams[chosen[:-1]] == grams[chosen[1:]])
        one, two = chosen[twice], chosen[twice + 1]
        run = np.maximum(np.searchsorted(at, two - span + 1, "right") - 1, 0)
        end = np.searchsorted(at, one, "right") - 1
        while len(run := run[going := run <= end]):  # runs with a window that holds both
            one, end = one[going], end[going]
            own[run[least[at[run]] == grams[one]]] = True
            run = run + 1
    return text, at - starts[text], last - starts[text], least[at], own


def named_runs(texts: DataFrame) -> DataFrame:
    """The runs of all texts, dealt by name. A name that a task meets more than once is known to repeat: one of its
    runs stands for it (``seen``: how many, one more if the run may repeat itself), the others (``plain``) may go anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch.column(1)):
                text, a, b, name, own = window_names(buf, offsets)
                held.append((batch.column(0).slice(first, end - first).take(pa.array(text)), a, b, name, own))
                size += len(buf)
                if size >= LOCAL_BYTES:
                    yield from pack(held)
                    held, size = [], 0
        yield from pack(held)

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        tids = pa.concat_arrays([h[0] for h in held])
        a, b, name, own = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4))
        if not len(name):
            return
        _, first, inverse, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        seen = np.zeros(len(name), np.int64)
        seen[first] = times
        plain = seen == 0
        seen[first] += own[first]
        key = name.copy()
        key[plain] = tv.mix(name[plain] + np.arange(len(name), dtype=U)[plain] * U(0x9E3779B97F4A7C15))
        columns = [pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), tids, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(plain), pa.array(seen)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "name", "tid", "first", "last", "plain", "seen"])

    return map_arrow(texts.select("tid", "text"), run, _RUN)


def repeated_runs(runs: DataFrame) -> DataFrame:
    """``name, tid, first, last, total`` of the runs whose name is not alone; ``total`` is null for plain ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "key"):
            plain = table.column("plain").to_numpy()
            seen = np.where(plain, 0, table.column("seen").to_numpy())
            total = np.repeat(np.add.reduceat(seen, bounds[:-1]), np.diff(bounds))
            keep = plain | (total > 1)
            out = table.select(["name", "tid", "first", "last"]).append_column("total", pa.array(total, mask=plain))
            yield from out.filter(pa.array(keep)).to_batches()

    return map_arrow(deal(runs, "key"), run, "name long, tid binary, first int, last int, total long")


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement: only groups that are still tied are sorted again."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for j in range(8):
        key = key << U(8) | padded[j : n + j]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are not settled
    step = 8
    while len(tied):
        suffix = order[tied]
        ahead = suffix + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + step + 1, n + step - ahead)  # a shorter suffix is less
        key = rank[suffix] * (n + step + 2) + second
        again = np.argsort(key)
        key, suffix = key[again], suffix[again]
        order[tied] = suffix
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(tied)))
        rank[suffix] = np.repeat(tied[start], size)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return order, rank


def common_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Common prefix, up to ``LENGTH``, of each suffix of a segment ``[start, stop)`` with the one before it in the order,
    up to the segment's end. Kasai's scan: the length drops by one at most from a position to the next, so the
    comparison goes on from there. Segments are cut into lanes, which are scanned one position of all at a time."""
    n = len(symbols)
    before = np.where(rank > 0, order[rank - 1], n)
    padded = np.append(symbols, np.uint8(0))
    out = np.zeros(n, np.int64)
    lanes = -(-(stops - starts) // LANE)
    owner = np.repeat(np.arange(len(starts)), lanes)
    at = starts[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop, last = stops[owner], np.minimum(at + LANE, stops[owner])
    length = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        length[other == n] = 0
        growing = np.flatnonzero((other < n) & (at + length < stop) & (length < LENGTH))
        while len(growing):
            i, j = at[growing] + length[growing], np.minimum(other[growing] + length[growing], n)
            growing = growing[(padded[i] == padded[j]) & (j < n)]
            length[growing] += 1
            growing = growing[(at[growing] + length[growing] < stop[growing]) & (length[growing] < LENGTH)]
        out[at] = length
        length = np.maximum(length - 1, 0)
        at = at + 1
        on = at < last
        at, stop, last, length = at[on], stop[on], last[on], length[on]
    return out


def periodic_windows(segment: bytes) -> np.ndarray | None:
    """Places of a long segment's windows that equal the one a period before; ``None`` if there are none.

    All windows of a segment hold one string, the named one. Where the segment is longer than two windows that
    string comes again, and if the text around is periodic, it comes again after a period.
    """
    if len(segment) < 2 * LENGTH + GRAM:
        return None
    buf = np.frombuffer(segment, np.uint8)
    grams = gram_hashes(tv.prefix(buf))
    at = np.flatnonzero(grams == grams.min())
    if len(at) < 2:
        return None
    steps, times = np.unique(np.diff(at), return_counts=True)
    period = int(steps[np.argmax(times)])
    same = np.concatenate([[0], np.cumsum(buf[period:] == buf[:-period])])
    places = period + np.flatnonzero(same[LENGTH:] - same[:-LENGTH] == LENGTH)
    return places if len(places) else None


def unrolled(segments: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The segments without windows that repeat a period, in order: the parts that are left, the segment and first place
    of each, and the places in the joined segments of the windows that are left out. What these equal is left."""
    parts, owner, begin, later, place = [], [], [], [], 0
    for k, segment in enumerate(segments):
        gone = periodic_windows(segment)
        if gone is None:
            parts.append(segment)
            owner.append(k)
            begin.append(0)
        else:
            later.append(place + gone)
            left = np.ones(len(segment) - LENGTH + 1, bool)
            left[gone] = False
            edge = np.flatnonzero(np.diff(np.concatenate([[0], left, [0]]).astype(np.int8)))
            for first, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                parts.append(segment[first : end - 1 + LENGTH])
                owner.append(k)
                begin.append(first)
        place += len(segment) + 1
    return parts, np.array(owner), np.array(begin), np.concatenate(later) if later else np.zeros(0, np.int64)


def repeated_windows(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For segments in their global order: places in the joined text whose window also starts earlier, and the
    first place of every segment. A zero separates segments; bytes are raised by one, which UTF-8 allows."""
    lengths = np.array([len(s) for s in segments])
    places = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    parts, owner, begin, periodic = unrolled(segments)
    size = np.array([len(s) for s in parts])
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    symbols = symbols + np.uint8(1)
    symbols[starts + size] = 0
    order, rank = suffix_array(symbols)
    prefix = common_prefixes(symbols, order, rank, starts, starts + size)
    tied = prefix[order] >= LENGTH
    group = np.cumsum(~tied) - 1
    bounds = np.flatnonzero(~tied)
    earliest = np.minimum.reduceat(order, bounds)
    later = order[order > earliest[group]]
    part = np.searchsorted(starts, later, "right") - 1
    later = places[owner[part]] + begin[part] + later - starts[part]
    return np.sort(np.concatenate([later, periodic])), places


def likely(pieces: list[bytes]) -> np.ndarray:
    """Which segments may share a window with another one, or hold one twice; the others need no sorting.

    All windows of a segment hold its named string, the one of the least hash. Equal windows hold it at the same
    offset, so around it the segments agree on ``LENGTH - GRAM`` further bytes, and on half of them to its left or to
    its right. A segment none of whose halves occurs again is out.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    stops = np.cumsum(size)
    starts = stops - size
    sums = tv.prefix(np.frombuffer(b"".join(pieces), np.uint8))
    grams = np.full(len(sums) - 1, ~U(0))
    grams[: len(sums) - GRAM] = gram_hashes(sums)
    for j in range(1, GRAM):  # strings that cross the end of a segment
        grams[stops - j] = ~U(0)
    least = np.minimum.reduceat(grams, starts)
    at = np.flatnonzero(grams == np.repeat(least, size))
    owner = np.searchsorted(stops, at, "right")
    half = (LENGTH - GRAM + 1) // 2
    out = np.zeros(len(pieces), bool)
    for low, high in ((half, GRAM), (0, GRAM + half)):
        whole = (at - low >= starts[owner]) & (at + high <= stops[owner])
        here = at[whole]
        _, which, times = np.unique(tv.range_hash(sums, here - low, here + high), return_inverse=True, return_counts=True)
        out[owner[whole][times[which] > 1]] = True
    return out


def shard_spans(segments: DataFrame) -> DataFrame:
    """Spans of repeated windows within each shard, and the windows that stay where a name has several shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table, bounds in whole_groups(batches, "gid"):
            total = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("bytes")).to_numpy())])
            reach = total[bounds]
            at = 0
            while at < len(bounds) - 1:
                end = min(max(int(np.searchsorted(reach, reach[at] + SHARD_BYTES - size)), at + 1), len(bounds) - 1)
                held.append(table.slice(bounds[at], bounds[end] - bounds[at]))
                size += int(reach[end] - reach[at])
                at = end
                if size >= SHARD_BYTES:
                    yield from shard(pa.concat_tables(held))
                    held, size = [], 0
        if held:
            yield from shard(pa.concat_tables(held))

    def shard(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("ord", "ascending"), ("tid", "ascending"), ("first", "ascending")]).combine_chunks()
        # of equal segments the first goes on; every window of the others starts earlier in it
        alike = table.column("bytes").combine_chunks().dictionary_encode().indices.to_numpy()
        _, lead = np.unique(alike, return_index=True)
        same = np.ones(len(alike), bool)
        same[lead] = False
        if same.any():
            part = table.filter(pa.array(same))
            begin = part.column("first").to_numpy()
            yield found(False, part.column("tid").combine_chunks(), begin, begin + pc.binary_length(part.column("bytes")).to_numpy())
        table = table.take(pa.array(np.sort(lead))).combine_chunks()
        pieces = table.column("bytes").to_pylist()
        wanted = likely(pieces) | table.column("spread").to_numpy()
        if not wanted.any():
            return
        table = table.filter(pa.array(wanted)).combine_chunks()
        pieces = [p for p, w in zip(pieces, wanted.tolist(), strict=True) if w]
        tids, first = table.column("tid").combine_chunks(), table.column("first").to_numpy()
        spread = table.column("spread").to_numpy()
        later, starts = repeated_windows(pieces)
        owner = np.searchsorted(starts, later, "right") - 1
        new = np.ones(len(later), bool)
        new[1:] = (later[1:] != later[:-1] + 1) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin, len(later))[1:] - 1
        who = owner[begin]
        a = first[who] + later[begin] - starts[who]
        b = first[who] + later[end] - starts[who] + LENGTH
        yield found(False, tids.take(pa.array(who)), a, b)
        rows = np.flatnonzero(spread)
        if len(rows):
            taken = np.zeros(int(starts[-1]) + len(pieces[-1]) + 1, bool)
            taken[later] = True
            ords = table.column("ord").to_numpy()
            for lo in range(0, len(rows), 4096):
                ids, at, key, windows = [], [], [], []
                for r in rows[lo : lo + 4096].tolist():
                    buf = np.frombuffer(pieces[r], np.uint8)
                    p = np.arange(len(buf) - LENGTH + 1)
                    p = p[~taken[starts[r] + p]]
                    key.append(tv.range_hash(tv.prefix(buf), p, p + LENGTH))
                    windows.append(np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[p])
                    ids.append(np.full(len(p), r))
                    at.append(first[r] + p)
                ids, at, key = (np.concatenate(x) for x in (ids, at, key))
                windows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(at), [None, pa.py_buffer(np.concatenate(windows).tobytes())]).cast(pa.binary())
                yield found(True, tids.take(pa.array(ids)), at, at + LENGTH, pa.array(key.view(np.int64)), pa.array(ords[ids]), windows)

    return map_arrow(deal(segments, "gid"), run, _FOUND)


def found(merge: bool, tids: pa.Array, start: np.ndarray, stop: np.ndarray, *rest: pa.Array) -> pa.RecordBatch:
    n = len(tids)
    more = rest or [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([merge] * n, pa.bool_()), tids, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), *more], ["merge", "tid", "start", "stop", "key", "ord", "window"])


def merged_spans(kept: DataFrame) -> DataFrame:
    """Spans of the windows that stayed in their shard but start later than an equal one of another shard.

    Windows of all shards are dealt by a hash and lie sorted by their bytes; a binary search finds the first of
    each. One shard sends a window once, so a window has no more rows than its name has shards. Bytes are raised
    by one, which UTF-8 allows, since the search takes final zeros for padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "key"):
            table = table.sort_by([(c, "ascending") for c in ("window", "ord", "tid", "start")]).combine_chunks()
            raw = np.frombuffer(b"".join(table.column("window").to_pylist()), np.uint8) + np.uint8(1)
            windows = raw.view(f"S{LENGTH}")
            late = np.searchsorted(windows, windows, "left") < np.arange(len(windows))
            yield from table.select(["tid", "start", "stop"]).filter(pa.array(late)).to_batches()

    return map_arrow(deal(kept, "key"), run, "tid binary, start int, stop int")


def removed_spans(texts: DataFrame) -> DataFrame:
    """``tid, start, stop`` of repeated windows, joined to spans, from ``tid, ord, text``."""
    runs = materialise(repeated_runs(named_runs(texts)), "suffix-runs")
    # one row a name of over SHARD_RUNS runs; sent whole, so that no name gathers its runs to learn that it has many
    many = materialise(runs.filter(F.col("total") > SHARD_RUNS).groupBy("name").agg(F.max("total").alias("total")), "suffix-many")
    shards = F.ceil(F.coalesce(F.col("m.total"), F.lit(1)) / SHARD_RUNS).cast("int")
    placed = runs.alias("r").join(checked_broadcast(many).alias("m"), "name", "left").select("name", "r.tid", "first", "last", shards.alias("shards"))
    lists = placed.groupBy("tid").agg(F.collect_list(F.struct("name", "first", "last", "shards")).alias("runs"))
    holding = texts.join(lists, "tid").select("tid", "ord", F.encode("text", "UTF-8").alias("raw"), F.explode("runs").alias("r"))
    segments = holding.select(
        F.xxhash64("r.name", F.expr("pmod(xxhash64(tid), r.shards)")).alias("gid"), (F.col("r.shards") > 1).alias("spread"), "tid", "ord",
        F.col("r.first").alias("first"), F.expr(f"substring(raw, r.first + 1, r.last - r.first + {LENGTH})").alias("bytes"),
    )
    spans = materialise(shard_spans(segments), "suffix-spans")
    discard(runs, many)
    return spans.filter("NOT merge").select("tid", "start", "stop").unionByName(merged_spans(spans.filter("merge").drop("merge")))


def bucketed_texts(rows: DataFrame) -> DataFrame:
    """One row per different text of at least ``LENGTH`` bytes, stored by ``tid`` so that joins need not move it.

    The catalogue knows the table only while it is written and planned; its files are those of the shared folder.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    texts = rows.filter(F.octet_length("text") >= LENGTH).groupBy("tid").agg(F.min("ord").alias("ord"), F.first("text").alias("text"))
    writer = texts.write.format("parquet").bucketBy(n, "tid").sortBy("tid").option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the catalogue forgets it
    spark.sql(f"DROP TABLE {name}")
    return table


def kept_parts(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """``tid, n_removed, n_spans, kept`` of the texts that lose bytes; ``kept`` is the rest or its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                values = spans.values
                pairs = np.column_stack([values.field(0).to_numpy(), values.field(1).to_numpy()])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:, 0] > reach[:-1]
                start, stop = pairs[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(pairs)) - 1]
                edges = [0, *np.column_stack([start, stop]).ravel().tolist(), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(int((stop - start).sum()))
                count.append(len(start))
                kept.append(rest.decode(errors="ignore") if with_text else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())], ["tid", "n_removed", "n_spans", "kept"])

    lists = spans.groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return map_arrow(texts.join(lists, "tid").select("tid", "text", "spans"), run, "tid binary, n_removed long, n_spans long, kept string")


def _order() -> Column:
    """The doc_id, with null as the smallest."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256)
    return docs.select(
        "doc_id", _order().alias("ord"), text.alias("text"),
        digest.alias("digest"), F.unhex(F.substring(digest, 1, 32)).alias("tid"),
    )


def substring_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document row.

    Documents are ordered by doc_id, a null one first; rows of one doc_id by the SHA-256 of their texts; of fully
    equal rows one counts as the first and the others as copies. Null texts are empty; texts under ``LENGTH`` bytes
    lose nothing. Other columns are ignored.
    """
    rows = _rows(docs)
    texts = bucketed_texts(rows)
    changed = kept_parts(texts, removed_spans(texts), with_text=False)
    ids = rows.groupBy("tid", "doc_id", "ord", "digest", F.octet_length("text").cast("long").alias("n_bytes")).agg(F.count("*").alias("times"))
    ids = materialise(ids, "suffix-ids")
    first = ids.groupBy("tid").agg(F.min("ord").alias("least"), F.sum("times").alias("n")).filter("n > 1").drop("n")
    own = ids.join(first, "tid", "left").withColumn("nth", F.explode(F.expr("sequence(1L, times)")))
    own = own.withColumn("copy", F.expr(f"n_bytes >= {LENGTH} AND (coalesce(ord > least, false) OR nth > 1)"))
    out = own.join(changed, "tid", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.expr("CASE WHEN copy THEN n_bytes ELSE coalesce(n_removed, 0L) END").alias("n_removed"),
        F.expr("CASE WHEN copy THEN 1L ELSE coalesce(n_spans, 0L) END").alias("n_spans"),
        F.expr(f"CASE WHEN copy THEN '{empty}' ELSE coalesce(kept, digest) END").alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut out; those of which nothing is left go.

    Documents are ordered as in :func:`substring_digests`. Of texts of at least ``LENGTH`` bytes that are equal the
    first row stays, also where doc_ids are equal or null; of rows with equal doc_id and text but other columns any
    one does. Shorter, empty and null texts stay as they are, repeated rows too. Bytes of a character that is cut in
    part are dropped with it. ``n_chars`` follows the text where it exists; all other columns are kept.
    """
    own = docs.columns
    rows = _rows(docs)
    texts = bucketed_texts(rows)
    changed = kept_parts(texts, removed_spans(texts), with_text=True).select("tid", "kept")
    firsts = texts.select("tid", "ord").join(changed, "tid", "left")
    long = F.octet_length(F.coalesce("text", F.lit(""))) >= LENGTH
    tid = F.unhex(F.substring(F.sha2(F.col("text"), 256), 1, 32))
    packed = docs.filter(long).select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("d"), tid.alias("tid"), _order().alias("ord"))
    joined = packed.dropDuplicates(["tid", "ord"]).join(firsts, ["tid", "ord"]).withColumn("rest", F.coalesce("kept", "d.text"))
    joined = joined.filter("kept IS NULL OR trim(kept) <> ''")
    columns = {c: F.col(f"d.`{c}`") for c in own} | {"text": F.col("rest")}
    if "n_chars" in own:
        columns["n_chars"] = F.when(F.col("kept").isNull(), F.col("d.n_chars")).otherwise(F.length("rest").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(columns[c].alias(c) for c in own)).unionByName(docs.filter(~long))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
