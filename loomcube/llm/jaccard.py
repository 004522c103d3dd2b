"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Bands of MinHash values give candidates; their values are then compared in
steps, and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls
below a tolerance (uniform prior). The rest is verified exactly on the shingles.

Equal texts are joined once. A bucket or component of any size is worked on in tiles of bounded size; pairs are
never written out, only links as counts and spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm import textvec as tv
from loomcube.llm.common import components, deal, discard, map_arrow, materialise, text_blocks, whole_groups

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 4 values: a pair at the threshold shares none with probability 3e-6.
BANDS, ROWS = 24, 4
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Texts of one side of a tile.
BUCKET_TILE, VERIFY_TILE = 4096, 2048
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(U) * U(2) + U(1)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among ``n`` with which the posterior probability still reaches the tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_LEAST = {n: least_matches(n) for n in range(STEP, BANDS * ROWS + 1, STEP)}


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and the first one of each; a text of one to four words has a single one."""
    starts, ends, bounds = tv.words(buf, offsets)
    hashes = tv.range_hash(tv.prefix(buf), starts, ends)
    out, first = tv.windows(hashes, bounds, SHINGLE)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if not len(short):
        return out, first
    extra = np.zeros(len(short), U)
    for j in range(SHINGLE - 1):
        has = count[short] > j
        extra[has] = tv.mix(extra[has] * U(3) + hashes[bounds[short][has] + j])
    own = np.diff(first)
    own[short] = 1
    at = np.concatenate([[0], np.cumsum(own)])
    merged = np.zeros(at[-1], U)
    mask = np.ones(at[-1], bool)
    mask[at[short]] = False
    merged[mask], merged[at[short]] = out, extra
    return merged, at


def signatures(docs: DataFrame) -> DataFrame:
    """``tid, doc_id, sig, bands``: MinHash values and band keys of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch.column(2)):
                values, bounds = shingles(buf, offsets)
                rows = np.flatnonzero(np.diff(bounds))
                if not len(rows):
                    continue
                sig = np.empty((len(rows), BANDS * ROWS), np.uint32)
                work = np.empty_like(values)
                for k, factor in enumerate(_FACTORS):
                    np.multiply(values, factor, out=work)
                    sig[:, k] = np.minimum.reduceat(work, bounds[rows]) >> U(32)
                parts = sig.reshape(len(rows), BANDS, ROWS).astype(U)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(rows), BANDS)).copy()
                for r in range(ROWS):
                    keys = tv.mix(keys * U(0x9E3779B97F4A7C15) + parts[:, :, r])
                bands = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, pa.array(keys.view(np.int64).ravel()))
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1] * 4), len(rows), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                take = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), binary, bands], ["tid", "doc_id", "sig", "bands"])

    return map_arrow(docs.select("tid", "doc_id", "text"), run, "tid binary, doc_id long, sig binary, bands array<long>")


def similar(sig: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of rows of ``sig`` outlast the stepwise comparison."""
    alive = np.arange(len(one))
    matches = np.zeros(len(one), np.int64)
    for at in range(0, sig.shape[1], STEP):
        a, b = one[alive], other[alive]
        matches[alive] += (sig[a, at : at + STEP] == sig[b, at : at + STEP]).sum(1)
        alive = alive[matches[alive] >= _LEAST[at + STEP]]
        if not len(alive):
            break
    out = np.zeros(len(one), bool)
    out[alive] = True
    return out


def forest(sig: np.ndarray) -> np.ndarray:
    """For each row a row of its component of similar rows; rows already reached are not compared again."""
    n = len(sig)
    root = np.arange(n)
    left = np.arange(n)
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            v = queue.pop()
            hit = similar(sig, np.full(len(left), v), left)
            found, left = left[hit], left[~hit]
            root[found] = seed
            queue += found.tolist()
    return root


def candidate_edges(texts: DataFrame) -> DataFrame:
    """A spanning forest ``u, v`` of the texts that share a band and outlast the comparison."""
    keys = texts.select("tid", F.explode("bands").alias("key"))
    full = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "jaccard-buckets")
    tiles = F.ceil(F.col("n") / BUCKET_TILE).cast("int")
    members = keys.join(full, "key").select("tid", "key", tiles.alias("tiles"))
    members = members.withColumn("own", F.expr("cast(pmod(xxhash64(tid), tiles) AS int)"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    members = members.select("tid", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("gid"))
    members = members.join(texts.select("tid", "sig"), "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "gid"):
            table = table.combine_chunks()
            tids = table.column("tid").combine_chunks()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(table.num_rows, -1)
            size = np.diff(bounds)
            one, two = [], []
            pairs = bounds[:-1][size == 2]
            if len(pairs):
                good = similar(sig, pairs, pairs + 1)
                one.append(pairs[good])
                two.append(pairs[good] + 1)
            for g in np.flatnonzero(size > 2).tolist():
                root = forest(sig[bounds[g] : bounds[g + 1]])
                at = np.flatnonzero(root != np.arange(len(root)))
                one.append(at + bounds[g])
                two.append(root[at] + bounds[g])
            if one:
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(np.concatenate(x))) for x in (one, two)], ["u", "v"])

    return map_arrow(deal(members, "gid"), run, "u binary, v binary").distinct()


def intersections(values: np.ndarray, bounds: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and of their intersections: of all with all, or of the first ``split`` with the others."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    size = np.bincount(owner, minlength=n)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    out = np.zeros((split, n - split) if split < n else (n, n), np.float32)
    for a in range(0, int(shared.sum()), 4096):
        here = slice(*np.searchsorted(column, [a, a + 4096]))
        block = np.zeros((n, min(4096, int(shared.sum()) - a)), np.float32)
        block[owner[here], column[here] - a] = 1
        out += block[:split] @ block[split:].T if split < n else block @ block.T
    return size, out


def verified_links(members: DataFrame, tag: str) -> DataFrame:
    """``tid, root, links`` a row per text and tile, from ``tid, comp, n, text``; exact Jaccard of all pairs of a component."""
    tiles = F.ceil(F.col("n") / VERIFY_TILE).cast("int")
    rows = members.withColumn("tiles", tiles).withColumn("own", F.expr("cast(pmod(xxhash64(tid), tiles) AS int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(F.xxhash64("comp", low, high).alias("gid"), (F.col("own") == high).alias("late"), (low != high).alias("cross"), "tid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "gid"):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(a, b - a).combine_chunks()
                tids = part.column("tid").combine_chunks()
                cross = part.column("cross")[0].as_py()
                split = int(np.count_nonzero(~part.column("late").to_numpy())) if cross else part.num_rows
                if cross and split in (0, part.num_rows):
                    continue
                sets, at = [], [0]
                for _, _, buf, offsets in text_blocks(part.column("text")):
                    values, first = shingles(buf, offsets)
                    sets.append(values)
                    at += (first[1:] + at[-1]).tolist()
                size, both = intersections(np.concatenate(sets), np.array(at), split)
                left, right = (size[:split], size[split:]) if cross else (size, size)
                linked = both * 10 >= (left[:, None] + right[None, :] - both) * (THRESHOLD * 10)
                linked &= both > 0
                if not cross:
                    np.fill_diagonal(linked, False)
                    links = linked.sum(1)
                else:
                    links = np.concatenate([linked.sum(1), linked.sum(0)])
                root = spread(linked, cross)
                yield pa.RecordBatch.from_arrays([tids, tids.take(pa.array(root)), pa.array(links.astype(np.int64))], ["tid", "root", "links"])

    return materialise(map_arrow(deal(rows, "gid", "late", "tid"), run, "tid binary, root binary, links long"), tag)


def spread(linked: np.ndarray, cross: bool) -> np.ndarray:
    """For each text the first one of its component; ``linked`` is a square matrix, or one of two sides if ``cross``."""
    a, b = linked.shape
    n = a + b if cross else a
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        queue = [seed]
        while queue:
            v = queue.pop()
            near = (np.flatnonzero(linked[v]) + a if v < a else np.flatnonzero(linked[:, v - a])) if cross else np.flatnonzero(linked[v])
            near = near[root[near] < 0]
            root[near] = seed
            queue += near.tolist()
    return root


def classified(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, copy_of, cls, class_id, n_links`` of every document row; ``cls`` names the class by a text.

    The texts to verify are fetched by text and doc_id of one row each, whatever their number: copies of a text are
    dealt to as many tasks as they have doc_ids, repeated rows are reduced before they move. Tables with one row a
    class or text are written before they are joined with the rows of a class, so that large classes can be split.
    """
    rows = _rows(docs)
    signed = signatures(rows).groupBy("tid").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    texts = materialise(signed, "jaccard-texts")
    linked = materialise(components(candidate_edges(texts), "jaccard-candidates"), "jaccard-linked")
    sizes = materialise(linked.groupBy("root").agg(F.count("*").alias("n")), "jaccard-sizes")
    wanted = linked.join(sizes, "root").select(F.col("node").alias("tid"), F.col("root").alias("comp"), "n")
    wanted = materialise(wanted.join(texts.select("tid", _order("rep")), "tid"), "jaccard-wanted")
    own = rows.select("tid", "ord", "text").dropDuplicates(["tid", "ord"]).join(wanted.hint("merge"), ["tid", "ord"])
    links = verified_links(own.select("tid", "comp", "n", "text"), "jaccard-links")
    counts = links.groupBy("tid").agg(F.sum("links").alias("n_links"))
    classes = components(links.filter("tid <> root").select(F.col("tid").alias("u"), F.col("root").alias("v")), "jaccard-classes")
    named = materialise(classes.join(texts.select(F.col("tid").alias("node"), "rep"), "node"), "jaccard-named")
    least = materialise(named.groupBy("root").agg(F.min("rep").alias("class_id")), "jaccard-least")
    known = named.join(least, "root").select(F.col("node").alias("tid"), F.col("root").alias("cls"), "class_id").join(counts, "tid", "left")
    ids = rows.select("doc_id", "tid")
    copies = ids.groupBy("tid").agg(F.min("doc_id").alias("copy_of"))
    facts = materialise(copies.join(known, "tid", "left"), "jaccard-facts")
    discard(texts, linked, sizes, wanted, links, named, least)
    return ids.join(facts, "tid").select(
        "doc_id", "tid", "copy_of", F.coalesce("cls", "tid").alias("cls"), F.coalesce("class_id", "copy_of").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def _order(doc_id: str) -> Column:
    """The doc_id, with null as the largest."""
    return F.coalesce(F.col(doc_id), F.lit((1 << 63) - 1)).cast("long").alias("ord")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _order("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_id("text").alias("tid"))


def text_id(column: str) -> Column:
    """Half of the SHA-256 of a text: equal for equal texts only."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(column), F.lit("")), 256), 1, 32))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` of every document row.

    ``n_links`` counts the other texts whose shingle sets have a Jaccard similarity of at least 0.8; ``class_id``
    is the least doc_id among the documents that such links and equal texts connect; ``copy_of`` is the least
    doc_id of the equal texts. Null texts count as empty; a text without words is linked to none but equal ones.
    Repeated rows are copies. A null doc_id is never the least of a class unless it has no other. Other columns
    are ignored.
    """
    return classified(docs).select("doc_id", "class_id", "copy_of", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each class: that of the least doc_id, a null one only if there is no other.

    Texts without words, null ones too, are a class with their equals only. Of repeated rows one stays; of rows
    with equal doc_id and text but other columns any one does. All columns are kept, whatever their names.
    """
    own = docs.columns
    order = F.struct(_order("doc_id"), "tid")
    best = materialise(classified(docs).groupBy("cls").agg(F.min(order).alias("best")).select("best.tid", "best.ord"), "jaccard-kept")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"), text_id("text").alias("tid"), _order("doc_id"))
    return packed.dropDuplicates(["tid", "ord"]).join(best.hint("merge"), ["tid", "ord"]).select("doc.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM t),
g AS (SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common * 10 >= 8 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS seen FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT id, min(seen) AS class_id FROM r GROUP BY id),
d AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, k.class_id, t.id AS copy_of, coalesce(d.n_links, 0) AS n_links FROM documents JOIN t ON t.text = coalesce(documents.text, '')
 JOIN k ON k.id = t.id LEFT JOIN d ON d.id = t.id"""
