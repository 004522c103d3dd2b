"""Reproducible sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered globally in a reproducible order. A keyed Feistel network permutes the smallest even power of
two that holds all numbers; values outside the row count are permuted again (cycle walking), which leaves a
permutation of ``[0, n)``. Position ``p`` goes to shard ``p % shards`` at slot ``p // shards``, so both can be
computed from the number alone, shard counts differ by at most one row and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcube.llm.common import crc_table, global_row_number, map_arrow
from loomcube.llm.textvec import mix

SHARDS, SEED, ROUNDS = 24, 20240607, 6
U = np.uint64


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced Feistel domain with at least ``n`` values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def feistel(values: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The images of ``values`` in ``[0, n)`` under the permutation that ``n`` and ``seed`` name."""
    bits = half_bits(n)
    low = U((1 << bits) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U) + mix(np.array([seed & (2**64 - 1)], U)))
    out = np.asarray(values).astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(bits), out[todo] & low
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & low)
        out[todo] = (left << U(bits)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def feistel_inverse(values: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The row numbers whose positions are ``values``: which row a given shard and slot holds."""
    bits = half_bits(n)
    low = U((1 << bits) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U) + mix(np.array([seed & (2**64 - 1)], U)))
    out = np.asarray(values).astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(bits), out[todo] & low
        for key in keys[::-1]:
            left, right = right ^ (mix(left ^ key) & low), left
        out[todo] = (left << U(bits)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def assign(numbered: DataFrame, n: int, shards: int, number: str = "row_number", seed: int = SEED) -> DataFrame:
    """``numbered`` (row numbers ``0..n-1`` in ``number``) with ``shard`` and ``slot``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(number)).to_numpy()
            at = feistel(rows, n, seed)
            shard, slot = pa.array((at % shards).astype(np.int32)), pa.array(at // shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, shard, slot], [*batch.schema.names, "shard", "slot"])

    schema = T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return map_arrow(numbered, place, schema)


def _numbered(docs: DataFrame, *more: Column) -> tuple[DataFrame, int]:
    """``doc_id, size, text_crc32`` and ``more`` of every row, numbered in the order that :func:`shard_documents` states."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *more,
    )
    order = [F.col(c) for c in ("doc_id", "size", "text_crc32", "text_hash")]
    numbered, n = global_row_number(rows, order, "row_number", "shard-rows")
    return numbered.drop("text_hash"), n


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document, without the text.

    Law ``rows``: shard sizes differ by at most one row. The order of numbering is doc_id (null first), then size,
    CRC-32 and a 64-bit hash of the text, so the result does not depend on files or partitions; rows equal in all
    of these are interchangeable. A null text counts as no bytes (size 8, CRC-32 of nothing: 0). Equal texts are
    not kept together: counts at most one apart leave no room for groups, which may be larger than a shard. An
    empty table gives no rows. Other columns are ignored.
    """
    numbered, n = _numbered(docs)
    return assign(numbered, n, shards, seed=seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> tuple[str, str]:
    """Write every row as Parquet, one folder a shard; returns the names of the columns of shard and slot.

    The rows are numbered as a whole, so null and repeated doc_ids and repeated rows each keep their own place. Rows
    are dealt by ranges of (shard, slot): a shard is written by several tasks, and each file holds a range of slots
    in order. All columns of the documents are kept; where they have a ``shard`` or ``slot`` of their own, the
    columns of the places get underscores after their names.
    """
    shard, slot = _free("shard", docs.columns), _free("slot", docs.columns)
    numbered, n = _numbered(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    placed = assign(numbered, n, shards, seed=seed).select("doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    files = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(files, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _mix_sql(x: str) -> str:
    """:func:`~loomcube.llm.textvec.mix` of an unsigned 64-bit expression."""
    out = x
    for step in ("xor(v, v >> 30)", 0xBF58476D1CE4E5B9, "xor(v, v >> 27)", 0x94D049BB133111EB, "xor(v, v >> 31)"):
        if isinstance(step, int):
            step = f"CAST(v::UHUGEINT * {step}::UHUGEINT % {1 << 64}::UHUGEINT AS UBIGINT)"
        out = f"list_transform([{out}], lambda v: {step})[1]"
    return out


def _oracle() -> str:
    """The network as joins with a table of its round function, and cycle walking as a recursion."""
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U) + mix(np.array([SEED], U))).tolist()
    rounds = ", ".join(f"({i}, {k}::UBIGINT)" for i, k in enumerate(keys))
    steps = ",\n".join(f"p{i + 1} AS (SELECT spot, r AS l, xor(l, o) AS r FROM p{i} JOIN f ON f.i = {i} AND f.v = p{i}.r)" for i in range(ROUNDS))
    return f"""
WITH RECURSIVE tb AS (SELECT [{", ".join(map(str, crc_table()))}]::UBIGINT[] AS tb),
b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
d AS (SELECT doc_id, CAST(len(h) AS BIGINT) + 8 AS size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(h, lambda x: ('0x' || x)::UBIGINT)),
  lambda a, x: xor(a >> 8, tb[CAST(xor(a & 255, x) + 1 AS BIGINT)])), 4294967295) AS BIGINT) AS text_crc32 FROM b, tb),
m AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM d),
c AS (SELECT count(*) AS n, CAST(greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2) AS INTEGER) AS bits FROM d),
f AS (SELECT i, v, {_mix_sql("xor(v, k)")} & ((1::UBIGINT << bits) - 1) AS o FROM (VALUES {rounds}) AS t(i, k), (SELECT bits, unnest(range(0, CAST(1 << bits AS BIGINT)))::UBIGINT AS v FROM c)),
p0 AS (SELECT spot, spot >> bits AS l, spot & ((1::UBIGINT << bits) - 1) AS r FROM (SELECT bits, unnest(range(0, CAST(1 << (2 * bits) AS BIGINT)))::UBIGINT AS spot FROM c)),
{steps},
perm AS (SELECT CAST(spot AS BIGINT) AS spot, CAST((l << bits) | r AS BIGINT) AS place FROM p{ROUNDS}, c),
w AS (SELECT spot, place FROM perm, c WHERE spot < n UNION ALL SELECT w.spot, perm.place FROM w JOIN perm ON perm.spot = w.place, c WHERE w.place >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {SHARDS} AS INTEGER) AS shard, place // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
 FROM m JOIN w ON w.spot = row_number, c WHERE place < n"""


#: Rows that are equal in all that orders them are interchangeable; the text hash that tells rows of one doc_id apart is left out.
ORACLE_SQL = _oracle()
