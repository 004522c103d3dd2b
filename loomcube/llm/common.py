"""Shared plumbing of the training-data operators: global row numbers, Arrow block iteration, components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomcube.storage import discard, materialise, on_one_machine, remove, shared_dir

__all__ = ["discard", "materialise", "on_one_machine", "remove", "shared_dir"]
#: Bytes of text handled at a time inside one Arrow batch; bounds the numpy temporaries of a task.
BLOCK_BYTES = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that executors need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_loomcube_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if on_one_machine(spark):
        known = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = f"{package.parent}:{known}" if known else str(package.parent)
        sc._loomcube_shipped = True
        return
    target = Path(tempfile.mkdtemp(prefix="loomcube-")) / "loomcube.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    sc.addPyFile(str(target))
    sc._loomcube_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def global_row_number(df: DataFrame, order: list[Column], name: str, tag: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based row number in the order of ``order``, and the number of rows.

    One range exchange; each partition numbers its own rows and adds the rows of the partitions before it. Only
    one count per partition reaches the driver. The numbered table is written before it is counted, so a lost
    executor cannot change the numbering. Rows equal in every order key are interchangeable; a source position
    breaks the tie so that many repeated rows still spread over partitions.
    """
    tie = "__tie"
    ranged = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, F.col(tie)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(tie)
    stored = materialise(ranged.withColumn("__mid", F.monotonically_increasing_id()), tag)
    stored = stored.withColumn("__part", F.shiftright("__mid", 33))
    counts = sorted((r["p"], r["n"]) for r in stored.groupBy(F.col("__part").alias("p")).agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for p, c in counts:
        starts.append((p, total))
        total += c
    base = df.sparkSession.createDataFrame(starts, "__part long, __start long")  # a row for each partition
    index = F.col("__start") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(base), "__part").withColumn(name, index).drop("__mid", "__part", "__start"), total


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row, end row, bytes, offsets)`` of whole texts of about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: Rows of narrow keys that are sent to every executor at most; more are joined by exchange.
BROADCAST_ROWS = 500_000


def checked_broadcast(keys: DataFrame) -> DataFrame:
    """A table of narrow keys, marked for broadcast if a count shows that it is within :data:`BROADCAST_ROWS`."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by the long ``key``: tables of whole groups, with the bounds of these groups."""
    tail: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if tail is not None:
            if tail.column(key)[-1].as_py() == batch.column(batch.schema.get_field_index(key))[-1].as_py():
                tail = pa.concat_tables([tail, table])
                continue
            table = pa.concat_tables([tail, table])
        bounds = _bounds(table, key)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        tail = table.slice(bounds[-2])
    if tail is not None:
        yield tail, _bounds(tail, key)


def _bounds(table: pa.Table, key: str) -> np.ndarray:
    keys = table.column(key).to_numpy()
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def deal(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with equal ``key`` in one partition and next to each other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """``node, root`` of every node of the undirected ``edges`` (u, v); the root is the least node of a component.

    Alternating large-star and small-star rounds: edges shrink to stars in a number of rounds that grows with the
    logarithm of the path lengths. Every round is written to the shared folder; only a count and a checksum reach
    the driver. Minima are pre-aggregated and written, so that they join as a plain table with one row a node:
    nothing is aggregated on top of the exchange of a hub's edges, and adaptive execution may split that hub.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state["n"], state["s"]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), tag)
        discard(edges, least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        hooked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialise(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), tag)
        discard(large, least)


def crc_table() -> list[int]:
    """The 256 values of the CRC-32 polynomial, for SQL."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII expression; the table is ``tb`` of a row ``tb`` of :data:`CRC_SQL`."""
    parts = f"regexp_extract_all(hex(encode({text})), '..')"
    step = "lambda a, x: xor(a >> 8, tb[CAST(xor(a & 255, x) + 1 AS BIGINT)])"
    return f"CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform({parts}, lambda x: ('0x' || x)::UBIGINT)), {step}), 4294967295) AS BIGINT)"


CRC_SQL = f"tb AS (SELECT [{', '.join(map(str, crc_table()))}]::UBIGINT[] AS tb)"
