"""The largest inner products between two sets of vectors, without comparing all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcube.operators.rank import positions
from loomcube.storage import discard, materialise
from loomcube.workers import ship_package

#: Vectors of a tile at most: one side in a task's memory against the other.
HEADS, TAILS = 2048, 4096
#: Decimals that decide; below them the order of a sum would.
DIGITS = 9


def _numbered(vectors: DataFrame) -> DataFrame:
    """``id, node, x, norm``: numbers from 0 by falling norm."""
    x = F.transform("x", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    own = vectors.filter("x IS NOT NULL").select("node", x.alias("x"), F.lit(0).alias("all")).withColumn("norm", norm)
    return materialise(positions(own, "all", [F.desc("norm"), F.col("node")]).select((F.col("position") - 1).alias("id"), "node", "x", "norm"), "vectors")


def _tile(k: int):
    def best(tile: pa.Table) -> pa.Table:
        kinds, ids = tile.column("kind").to_numpy(), tile.column("id").to_numpy()
        sides = []
        for kind in (0, 1):
            rows = np.flatnonzero(kinds == kind)
            x = tile.column("x").take(pa.array(rows)).combine_chunks()
            flat = np.asarray(x.flatten(), dtype=np.float64)
            order = np.argsort(ids[rows])
            sides.append((ids[rows][order], flat.reshape(len(rows), -1)[order] if len(rows) else flat.reshape(0, 1)))
        (heads, h), (tails, t) = sides
        if not len(heads) or not len(tails):
            return OUT.empty_table()
        scores = np.round(h @ t.T, DIGITS) + 0.0
        known = np.flatnonzero(kinds == 2)
        if len(known):
            scores[np.searchsorted(heads, ids[known]), np.searchsorted(tails, tile.column("tail").to_numpy()[known])] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # equal scores: the larger norm, then the name
        row = np.repeat(np.arange(len(heads)), order.shape[1])
        found = scores[row, order.ravel()]
        real = found > -np.inf
        columns = heads[row][real], tails[order.ravel()][real], found[real]
        pairs = pa.table([pa.array(c) for c in columns], schema=OUT)
        counted = pa.table([pa.array([-1]), pa.array([-1]), pa.array([float(scores.size)])], schema=OUT)
        return pa.concat_tables([pairs, counted])

    return best


OUT = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("score", pa.float64())])


def top_products(heads: DataFrame, tails: DataFrame, k: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``head, tail, score, position`` of the k largest products of each head, and ``wave, pairs`` that were compared.

    ``heads`` and ``tails`` are ``node, x``, all of one length; pairs in ``known (head, tail)`` do not count. A product
    is at most the product of the norms, so tails are taken by falling norm, in waves of 1, 2, 4, … blocks of
    :data:`TAILS`. A head is done once its k-th best beats what the next wave can give. The heads that go on meet the
    blocks of a wave in tiles, each side of a tile being bounded, and a tile hands on k pairs a head. Equal scores are
    ordered by the norm of the tail, then its name. Only counts and a norm a wave reach the driver.
    """
    ship_package(heads.sparkSession)
    head, tail = _numbered(heads), _numbered(tails)
    spark, n_tails = head.sparkSession, tail.count()
    blocks = -(-n_tails // TAILS)
    first = [2**w - 1 for w in range(blocks.bit_length()) if 2**w - 1 < blocks]
    bounds = {r["id"] // TAILS: r["norm"] for r in tail.filter(F.col("id").isin([b * TAILS for b in first])).select("id", "norm").collect()}
    if known is not None:
        pairs = known.select(F.col("head").alias("hn"), F.col("tail").alias("tn")).distinct()
        pairs = pairs.join(head.select(F.col("id").alias("h"), F.col("node").alias("hn")), "hn").join(tail.select(F.col("id").alias("t"), F.col("node").alias("tn")), "tn")
        pairs = materialise(pairs.select("h", "t"), "known-pairs")
    best = spark.createDataFrame([], "h long, t long, score double")
    compared = spark.createDataFrame([], "wave int, pairs long")
    active = head
    old: list[DataFrame] = []
    for wave, start in enumerate(first):
        end = min(blocks, 2 * start + 1)
        n = active.count()
        if not n:
            break
        chunks = -(-n // HEADS)
        chunk, block = F.pmod(F.xxhash64(F.col("id")), F.lit(chunks)), F.floor(F.col("id") / TAILS)
        key = lambda c, b: (c * blocks + b).alias("key")
        none = F.lit(None).cast("long").alias("tail")
        sides = [
            active.withColumn("b", F.explode(F.sequence(F.lit(start), F.lit(end - 1)))).select(key(chunk, F.col("b")), F.lit(0).alias("kind"), "id", none, "x"),
            tail.filter((block >= start) & (block < end)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(key(F.col("c"), block), F.lit(1).alias("kind"), "id", none, "x"),
        ]
        if known is not None:
            place = pairs.join(active.select(F.col("id").alias("h")), "h").select(F.col("h").alias("id"), F.col("t").alias("tail")).withColumn("b", F.floor(F.col("tail") / TAILS))
            place = place.filter((F.col("b") >= start) & (F.col("b") < end))
            sides.append(place.select(key(chunk, F.col("b")), F.lit(2).alias("kind"), "id", "tail", F.lit(None).cast("array<double>").alias("x")))
        tiles = sides[0]
        for side in sides[1:]:
            tiles = tiles.unionByName(side)
        found = materialise(tiles.groupBy("key").applyInArrow(_tile(k), "h long, t long, score double"), "products")
        compared = compared.unionByName(found.filter("h < 0").select(F.lit(wave).alias("wave"), F.col("score").cast("long").alias("pairs")))
        order = Window.partitionBy("h").orderBy(F.desc("score"), "t")
        ranked = best.unionByName(found.filter("h >= 0")).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
        best = materialise(ranked.drop("position"), "best-products")
        old += [found, best]
        if end < blocks:
            least = best.groupBy(F.col("h").alias("id")).agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
            going = head.join(active.select("id"), "id", "left_semi").join(least.select("id", "least"), "id", "left")
            reach = F.col("norm") * bounds[end] >= F.col("least") - 10.0**-DIGITS * 10
            going = going.filter(F.col("least").isNull() | reach)
            active = materialise(going.drop("least", "n"), "open-heads")
            old.append(active)
    compared = materialise(compared.groupBy("wave").agg(F.sum("pairs").alias("pairs")), "compared-pairs")
    order = Window.partitionBy("h").orderBy(F.desc("score"), "t")
    named = best.withColumn("position", F.row_number().over(order).cast("long"))
    named = named.join(head.select(F.col("id").alias("h"), F.col("node").alias("head")), "h").join(tail.select(F.col("id").alias("t"), F.col("node").alias("tail")), "t")
    out = materialise(named.select("head", "tail", "score", "position"), "top-products")
    discard(head, tail, *old, *([pairs] if known is not None else []))
    return out, compared
