"""Benchmark decontamination by the q-gram lemma: count shared q-grams in diagonal bands, then align in the band.

Texts and benchmark items are folded (lower case, runs of other characters become one blank). An item is probed
by windows of 60 and of 96 bytes that start at every fourth byte (a last one ends with the item), so every verbatim
quotation of 63 folded bytes or more holds a whole window and is found, wherever in the item it starts. Shorter ones
are found only where they hold a window; an item of up to 60 bytes is one window. Items under a q-gram's length are
looked up as whole words instead, without edits. A window of length m that occurs with at most k edits shares at least m + 1 - q - k q of
its q-grams with the text on diagonals that span at most k; bands of twice that width, each overlapping the next
by half, therefore hold all of them. Regions that reach the bound are verified by alignment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm import textvec as tv
from loomcube.llm.common import discard, map_arrow, materialise, text_blocks

#: Length of a q-gram, and the edits that a window may have.
Q, EDIT_PERCENT = 12, 6
#: Lengths of the windows and their step, in bytes of folded text. The long ones allow more edits close together.
WINDOWS, STEP = (60, 96), 4
#: A verbatim quotation of this many folded bytes of an item holds a whole window, wherever in the item it starts.
LEAST_QUOTATION = min(WINDOWS) + STEP - 1
#: Bytes of benchmark text that are sent to the workers at a time; more are taken in further scans.
BLOCK_OF_ITEMS = 8 << 20
#: Shared q-grams, each with one place in an item, that are held at a time; texts and items are halved beyond.
HITS = 1 << 20
SCHEMA = "doc_id long, item_id long, n_windows long, edits long, end_byte long"
U = np.uint64


def fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and their offsets. No text begins or ends with a blank."""
    letter = tv.LETTER[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    keep[begins] = letter[begins]
    out = np.where(letter, tv.lower(buf), np.uint8(32))[keep]
    places = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    bounds = places[offsets]
    lasts = bounds[1:][np.diff(bounds) > 0] - 1
    blank = lasts[out[lasts] == 32]
    return np.delete(out, blank), bounds - np.searchsorted(blank, bounds)


def qgrams(buf: np.ndarray) -> np.ndarray:
    """64-bit values of the q-grams at every position; those of different q-grams may rarely agree."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    two = buf[:-1].astype(np.uint32) | buf[1:].astype(np.uint32) << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    eight = four[:-4].astype(U) | four[4:].astype(U) << U(32)
    out = eight[:n] * U(0x9E3779B97F4A7C15)
    out ^= out >> U(32)
    out += four[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F)
    out *= U(0xBF58476D1CE4E5B9)
    return out ^ out >> U(29)


def edit_budget(length: int) -> int:
    """Edits allowed in a window: the stated share, and so few that the lemma still asks for one shared q-gram."""
    return max(0, min(length * EDIT_PERCENT // 100, (length - Q) // Q))


class WindowsOfSize:
    """Windows of one size: by item their length, edits and the q-grams that they must share, and where each starts.

    An item that a smaller size holds whole has no windows of that size, since it is a window of the largest.
    """

    def __init__(self, begin: np.ndarray, lengths: np.ndarray, size: int) -> None:
        self.begin, self.length = begin, np.minimum(lengths, size)
        self.budget = np.array([edit_budget(n) for n in range(size + 1)], np.int64)[self.length]
        self.needed = self.length + 1 - Q - self.budget * Q
        spare = lengths - self.length
        number = spare // STEP + 1 + (spare % STEP > 0)  # the last window ends with the item
        if size < max(WINDOWS):
            number[spare == 0] = 0
        self.item = np.repeat(np.arange(len(lengths)), number)
        nth = np.arange(len(self.item)) - np.repeat(np.cumsum(number) - number, number)
        self.start = begin[self.item] + np.minimum(nth * STEP, spare[self.item])
        #: Number of the first of them among the windows of all sizes
        self.first = 0

    def candidates(self, group: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(group, window)`` of every window that holds enough of the places of a group; a group is of one item."""
        order = np.lexsort((place, group))
        group, item, place = group[order], item[order], place[order]
        last = np.arange(len(group)) + self.needed[item] - 1
        inside = last < len(group)
        last[~inside] = 0
        reach = self.length[item] - Q
        inside &= (group[last] == group) & (place[last] - place <= reach)
        least = np.maximum(place[last[inside]] - reach[inside], self.begin[item[inside]])
        low, high = np.searchsorted(self.start, least), np.searchsorted(self.start, place[inside], "right")
        spans = np.unique(np.stack([group[inside], low, high], 1)[high > low], axis=0)
        times = spans[:, 2] - spans[:, 1]
        window = np.repeat(spans[:, 1] - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.unique(np.stack([np.repeat(spans[:, 0], times), window], 1), axis=0)
        return both[:, 0], both[:, 1] + self.first


class Probes:
    """Windows of the items of a benchmark block and an index of the q-grams of the items.

    The index holds every q-gram of an item once, whatever the number of windows it lies in.
    """

    TABLE_BITS = 22

    def __init__(self, items: list[tuple[int, str]]) -> None:
        raws = [(text or "").encode() for _, text in items]
        ends = np.cumsum([0] + [len(raw) for raw in raws])
        buf, bounds = fold(np.frombuffer(b"".join(raws), np.uint8), ends) if ends[-1] else (np.zeros(0, np.uint8), ends)
        lengths = np.diff(bounds)
        used = np.flatnonzero(lengths >= Q)
        short = np.flatnonzero((lengths > 0) & (lengths < Q))
        self.bytes, self.begin, self.end = buf, bounds[:-1][used], bounds[1:][used]
        owners = np.array([item for item, _ in items], np.int64)[used]
        self.sizes = [WindowsOfSize(self.begin, lengths[used], size) for size in WINDOWS]
        first = 0
        for sized in self.sizes:
            sized.first = first
            first += len(sized.start)
        item = np.concatenate([sized.item for sized in self.sizes])
        self.owner, self.start = owners[item], np.concatenate([sized.start for sized in self.sizes])
        self.length, self.budget = (np.concatenate([getattr(sized, k)[sized.item] for sized in self.sizes]) for k in ("length", "budget"))
        self.short = self._strings(buf, bounds[:-1][short], lengths[short], len(self.owner))
        none = np.zeros(len(short), np.int64)
        self.owner, self.start = np.concatenate([self.owner, np.array([i for i, _ in items], np.int64)[short]]), np.concatenate([self.start, bounds[:-1][short]])
        self.length, self.budget = np.concatenate([self.length, lengths[short]]), np.concatenate([self.budget, none])
        self.padded = np.concatenate([buf, np.zeros(max(WINDOWS), np.uint8)])
        grams = qgrams(buf)
        whole = np.zeros(len(buf) + 1, np.int8)
        np.add.at(whole, self.begin, 1)
        np.add.at(whole, self.end + 1 - Q, -1)
        places = np.flatnonzero(np.cumsum(whole)[: len(grams)])
        order = np.argsort(grams[places], kind="stable")
        self.place = places[order]
        values = grams[self.place]
        heads = np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]]))
        self.values = values[heads]
        #: for each entry of the index the number of its q-gram and its place, in one rising number
        self.entry = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(values)))) * self.stride + self.place
        self.table = np.zeros(1 << self.TABLE_BITS, bool)
        self.table[self.values >> U(64 - self.TABLE_BITS)] = True

    @property
    def stride(self) -> int:
        return len(self.bytes) + 1

    @staticmethod
    def _strings(buf: np.ndarray, start: np.ndarray, length: np.ndarray, first: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By length: the sorted items of that length and their window numbers."""
        out = []
        for size in np.unique(length).tolist():
            which = np.flatnonzero(length == size)
            strings = np.ascontiguousarray(buf[start[which][:, None] + np.arange(size)]).view(f"S{size}").ravel()
            order = np.argsort(strings, kind="stable")
            out.append((size, strings[order], first + which[order]))
        return out

    def grams(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text position of every shared q-gram, and its number."""
        grams = qgrams(buf)
        at = np.flatnonzero(self.table[grams >> U(64 - self.TABLE_BITS)])
        found = np.searchsorted(self.values, grams[at])
        found[found == len(self.values)] = 0
        same = self.values[found] == grams[at] if len(self.values) else np.zeros(len(at), bool)
        return at[same], found[same]

    def entries(self, number: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For each q-gram the first entry with a place in ``[low, high)``, and how many there are."""
        first = np.searchsorted(self.entry, number * self.stride + low)
        return first, np.searchsorted(self.entry, number * self.stride + high) - first

    def words(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, window, end)`` of every short item that stands as whole words in a folded text."""
        out = [(np.zeros(0, np.int64),) * 3]
        if self.short:
            blank = np.append(buf == 32, True)
            blank[offsets[1:]] = True  # what follows the last byte of a text
            begins = np.zeros(len(buf) + 1, bool)
            begins[offsets[:-1]] = True
            begins[1:] |= np.append(buf == 32, True)[:-1]
            starts = np.flatnonzero(begins[:-1])
            text = np.searchsorted(offsets, starts, "right") - 1
        for size, strings, window in self.short:
            whole = starts + size <= offsets[text + 1]
            whole[whole] &= blank[starts[whole] + size]
            here, owner = starts[whole], text[whole]
            if not len(here):
                continue
            found = np.ascontiguousarray(buf[here[:, None] + np.arange(size)]).view(f"S{size}").ravel()
            first, last = np.searchsorted(strings, found, "left"), np.searchsorted(strings, found, "right")
            times = last - first
            which = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            out.append((np.repeat(owner, times), window[which], np.repeat(here + size, times)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def pieces(self, window: np.ndarray) -> np.ndarray:
        """A matrix with the bytes of a window in each row, with zeros after its end."""
        out = np.lib.stride_tricks.sliding_window_view(self.padded, max(WINDOWS))[self.start[window]]
        return np.where(np.arange(max(WINDOWS)) < self.length[window][:, None], out, np.uint8(0))

    @property
    def text(self) -> np.ndarray:
        """The bytes of all windows."""
        return self.pieces(np.arange(len(self.owner)))


def align(window: np.ndarray, length: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each window and any part of its region, and where that part ends.

    ``window`` and ``region`` are matrices with a row per candidate. Regions are only as wide as the band.
    """
    n, width = region.shape
    columns = np.arange(width + 1, dtype=np.int16)
    row = np.zeros((n, width + 1), np.int16)
    best, end = np.full(n, 1 << 14, np.int64), np.zeros(n, np.int64)
    for i in range(window.shape[1]):
        step = row[:, :-1] + (region != window[:, i : i + 1])
        new = row + np.int16(1)
        np.minimum(new[:, 1:], step, out=new[:, 1:])
        row = np.minimum.accumulate(new - columns, axis=1) + columns
        done = length == i + 1
        if done.any():
            best[done] = row[done].min(1)
            end[done] = row[done].argmin(1)
    return best, end


def search(probes: Probes, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Verified ``(text, window, edits, end in the folded text)`` of a block of folded texts; a window of a long text may be repeated."""
    text, window, end = probes.words(buf, offsets)
    out = [(text, window, np.zeros(len(text), np.int64), end)]
    if len(probes.values):
        at, number = probes.grams(buf)
        text = np.searchsorted(offsets, at, "right") - 1
        whole = at + Q <= offsets[text + 1]
        out += _in_parts(probes, buf, offsets, at[whole], number[whole], text[whole], 0, len(probes.begin))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_parts(probes: Probes, buf: np.ndarray, offsets: np.ndarray, at: np.ndarray, number: np.ndarray, text: np.ndarray, one: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Results for the items ``one`` to ``end``, from bounded numbers of hits: of some texts, of overlapping stretches
    of a text, or of some items. What a window needs lies within a stretch, since these overlap by more than its length."""
    if not len(at):
        return
    low = probes.begin[one]
    high = probes.begin[end] if end < len(probes.begin) else len(probes.bytes)
    first, times = probes.entries(number, low, high)
    if times.sum() > HITS:
        reach = 2 * (max(WINDOWS) + int(probes.budget.max()))
        middle = text[min(int(np.searchsorted(np.cumsum(times), times.sum() // 2)), len(text) - 1)]
        middle += middle == text[0]
        place = (at[0] + at[-1]) // 2
        if text[0] != text[-1]:
            sides = [(text < middle, one, end), (text >= middle, one, end)]
        elif at[-1] - at[0] > 4 * reach:
            sides = [(at < place + reach, one, end), (at >= place - reach, one, end)]
        elif end - one > 1:
            sides = [(times >= 0, one, (one + end) // 2), (times >= 0, (one + end) // 2, end)]
        else:
            sides = []
        for side, a, b in sides:
            yield from _in_parts(probes, buf, offsets, at[side], number[side], text[side], a, b)
        if sides:
            return
    entry = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
    at, text, place = np.repeat(at, times), np.repeat(text, times), probes.place[entry]
    if not len(at):
        return
    item = np.searchsorted(probes.begin, place, "right") - 1
    parts = [_in_bands(probes, sized, at, place, text, item) for sized in probes.sizes]
    text, window, low = (np.concatenate(x) for x in zip(*parts, strict=True))
    span = max(WINDOWS) + 4 * int(probes.budget.max()) + 4
    for a in range(0, len(window), 512):
        w, t, l = window[a : a + 512], text[a : a + 512], low[a : a + 512]
        spots = l[:, None] + np.arange(span)
        inside = (spots >= offsets[t][:, None]) & (spots < offsets[t + 1][:, None])
        region = np.where(inside, buf[np.clip(spots, 0, len(buf) - 1)], 0)
        edits, end = align(probes.pieces(w), probes.length[w], region)
        good = edits <= probes.budget[w]
        yield t[good], w[good], edits[good], (l + end)[good]


def _in_bands(probes: Probes, sized: WindowsOfSize, at: np.ndarray, place: np.ndarray, text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, window, where its region begins)`` of the windows of a size with enough shared q-grams in a band."""
    # items that lack hits altogether go before any band is counted
    pairs, inverse, total = np.unique(text * len(probes.begin) + item, return_inverse=True, return_counts=True)
    likely = (total >= sized.needed[pairs % len(probes.begin)])[inverse]
    at, place, item, dense = at[likely], place[likely], item[likely], inverse[likely]
    # bands of the diagonals of an item are those of all of its windows
    shift = len(probes.bytes) + max(WINDOWS)
    band = (at - place + shift) // (sized.budget[item] + 1)
    key = dense * (1 << 33) + band  # pairs by their dense numbers: their own would leave no bits for the band
    keys, group, counts = np.unique(np.concatenate([key, key - 1]), return_inverse=True, return_counts=True)
    item, place = np.concatenate([item, item]), np.concatenate([place, place])
    enough = counts[group] >= sized.needed[item]
    group, window = sized.candidates(group[enough], item[enough], place[enough])
    band = keys[group] & ((1 << 33) - 1)
    low = band * (probes.budget[window] + 1) - shift + probes.start[window] - probes.budget[window]
    return pairs[keys[group] >> 33] // len(probes.begin), window, low


_built: dict[str, Probes] = {}


def probes_of(name: str, items: list[tuple[int, str]]) -> Probes:
    """The probes of a block of items, built once per Python worker; only those of the last block are held."""
    if name not in _built:
        _built.clear()
        _built[name] = Probes(items)
    return _built[name]


def find_passages(docs: DataFrame, benchmark: DataFrame, least: int = 0) -> DataFrame:
    """One row per document row and benchmark item that shares a passage with it.

    Every quotation of :data:`LEAST_QUOTATION` folded bytes of an item is found, and every window with at most 6 %
    edits. ``n_windows`` windows of the item occur within their edit budget, the best with ``edits`` edits;
    ``end_byte`` is the earliest end of one in the folded text. Items under twelve folded bytes are found where they
    stand as whole words, without edits; ``least`` leaves out items of fewer folded bytes. No exchange: the benchmark
    is sent to the workers in blocks of stated size, one scan each; if there are several, the results of a block are
    written before the next is read. Null and empty texts match nothing; nor do items without a letter or digit, or
    whose item_id is null, as no row could name them; repeated rows give repeated results; equal items each give a
    row. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    out = None
    for items, last in item_blocks(benchmark, least):
        found = _scan(rows, items)
        if not last or out is not None:
            found = materialise(found, "decontam-found")
        out = found if out is None else out.unionByName(found)
    return out


def item_blocks(benchmark: DataFrame, least: int = 0, named: bool = True) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The benchmark in blocks of about :data:`BLOCK_OF_ITEMS` bytes, and whether it is the last; the driver holds one at a time.

    Items whose text is null are left out, and if they are to be ``named`` those without an item_id.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text IS NOT NULL")
    items = items.filter("item_id IS NOT NULL") if named else items.fillna(0, ["item_id"])
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_OF_ITEMS))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [x for x in sorted((r["item_id"], r["text"]) for r in block.collect()) if not least or _folded_size(x[1]) >= least], b == blocks - 1


def _folded_size(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return len(fold(raw, np.array([0, len(raw)]))[0]) if len(raw) else 0


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 0) -> DataFrame:
    """The documents that share no passage with the benchmark, with their own columns; nothing is exchanged.

    Passages are those of :func:`find_passages`, and of items without an item_id too. Null and empty texts stay,
    repeated rows too. If the benchmark has several blocks, what a block leaves is written before the next.
    """
    was, names = None, docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # own names may hold a dot
    for items, last in item_blocks(benchmark, least, named=False):
        docs = map_arrow(docs, _clean_rows(items, names.index("text")), docs.schema)
        if not last:
            docs = materialise(docs, "decontam-clean")
            if was is not None:
                discard(was)
            was = docs
    return docs.toDF(*names)


def _name(items: list[tuple[int, str]]) -> str:
    digest = hashlib.sha256()
    for item, text in items:
        raw = text.encode()
        digest.update(b"%d %d " % (item, len(raw)) + raw)
    return digest.hexdigest()


def _clean_rows(items: list[tuple[int, str]], at: int):
    name = _name(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = probes_of(name, items)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, _, raw, raw_offsets in text_blocks(batch.column(at)):
                clean[first + search(probes, *fold(raw, raw_offsets))[0]] = False
            yield batch.filter(pa.array(clean))

    return run


def _scan(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    name = _name(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = probes_of(name, items)
        for batch in batches:
            ids = batch.column(0)
            for first, _, raw, raw_offsets in text_blocks(batch.column(1)):
                buf, offsets = fold(raw, raw_offsets)
                text, window, edits, end = search(probes, buf, offsets)
                if not len(text):
                    continue
                item = probes.owner[window]
                found: dict[tuple[int, int], list] = {}
                for t, i, w, e, at in zip(text.tolist(), item.tolist(), window.tolist(), edits.tolist(), (end - offsets[text]).tolist(), strict=True):
                    was = found.setdefault((t, i), [set(), e, at])
                    was[0].add(w)
                    was[1], was[2] = min(was[1], e), min(was[2], at)
                keys = sorted(found)
                places = pa.array([first + t for t, _ in keys], pa.int64())
                columns = [ids.take(places), pa.array([i for _, i in keys], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*((len(found[k][0]), found[k][1], found[k][2]) for k in keys), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_windows", "edits", "end_byte"])

    return map_arrow(rows, run, SCHEMA)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_passages(docs, items)
