"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k sample of their ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. The raw model is the bucket
distribution of all documents, the target model that of documents labelled good. A document's log weight is the
sum of the log ratios of its n-grams; adding Gumbel noise and taking the k largest keys draws k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm import textvec as tv
from loomcube.llm.common import discard, global_row_number, map_arrow, materialise, text_blocks

#: Buckets of both models: bounds what the driver gathers and sends out, whatever the size of the corpus.
BUCKETS = 10_000
#: Target documents that the target model is fitted on, chosen by hash of doc_id. The raw model covers all rows.
TARGET_ROWS = 20_000
#: Log ratios are summed as integers of this unit, so that a sum does not depend on its order.
UNIT = 1 << 24
SEED = 17


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def ngram_buckets(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For single words and for pairs: the bucket of each, and the first one of each text."""
    starts, ends, bounds = tv.words(buf, offsets)
    hashes = tv.range_hash(tv.prefix(buf), starts, ends)
    pairs, pair_bounds = tv.windows(hashes, bounds, 2)
    return [((h % np.uint64(buckets)).astype(np.int64), b) for h, b in ((hashes, bounds), (pairs, pair_bounds))]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: n-grams of all documents and of those with ``is_target``; one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, buf, offsets in text_blocks(batch.column(0)):
                for ids, bounds in ngram_buckets(buf, offsets, buckets):
                    totals[0] += np.bincount(ids, minlength=buckets)
                    inside = np.repeat(target[first:end], np.diff(bounds))
                    totals[1] += np.bincount(ids[inside], minlength=buckets)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], ["bucket", "raw", "target"])

    counts = map_arrow(docs.select("text", "is_target"), run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability of each bucket in ``UNIT``; add-one smoothing."""
    table = np.zeros((2, buckets))
    for row in counts.collect():
        table[:, row["bucket"]] = row["raw"], row["target"]
    share = (table + 1) / (table.sum(1, keepdims=True) + buckets)
    return np.round((np.log(share[1]) - np.log(share[0])) * UNIT).astype(np.int64)


def log_weights(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_ngrams, log_weight, gumbel_key`` of every document; the last two are null without a word.

    The noise follows from doc_id and text, so rows of one doc_id or of none differ unless their texts are equal.
    """
    buckets = len(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy().astype(np.uint64) ^ tv.mix(batch.column(2).to_numpy().astype(np.uint64))
            counts, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for first, end, buf, offsets in text_blocks(batch.column(1)):
                for grams, bounds in ngram_buckets(buf, offsets, buckets):
                    counts[first:end] += np.diff(bounds)
                    sums[first:end] += tv.per_text(ratios[grams], bounds)
            weight = sums / UNIT
            uniform = ((tv.mix(ids + tv.mix(np.array([seed], np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
            key = np.round(weight - np.log(-np.log(uniform)), 9)
            none = counts == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(weight, mask=none), pa.array(key, mask=none)],
                ["doc_id", "n_ngrams", "log_weight", "gumbel_key"],
            )

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, "doc_id long, n_ngrams long, log_weight double, gumbel_key double")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight, rank and whether it is among the ``k`` sampled ones.

    ``k`` defaults to the number of documents times the share of good rows among the labels learnt from. A doc_id
    with several labels is good only if all are. Texts without a word (null, empty) have no weight and rank last;
    equal keys are ranked by doc_id; without labels every document is kept. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = known.agg(F.avg(F.col("quality").cast("double")).alias("s")).first()["s"]
    target = known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    target = target.select("doc_id", F.lit(True).alias("is_target"))
    marked = docs.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    # written first, since a range exchange reads its input twice
    keys = materialise(log_weights(docs, log_ratios(bucket_counts(marked, buckets), buckets)), "importance-keys")
    order = [F.desc_nulls_last("gumbel_key"), F.col("doc_id")]
    ranked, n = global_row_number(keys, order, "rank", "importance")
    discard(keys)
    k = k if k is not None else round(n * (1.0 if share is None else share))
    return ranked.withColumn("kept", F.col("rank") < k)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels)
