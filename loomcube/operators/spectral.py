"""Truncated spectra of a graph's matrix by block power iteration over its stored edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomcube.storage import discard, materialise

#: Columns that are iterated beside those asked for, which speeds up the last of these.
EXTRA = 4
#: Directions whose share of the Gram matrix is below this hold nothing but rounding.
TINY = 1e-13


def _mixed(table: DataFrame, columns: list[str], weights: np.ndarray, names: list[str]) -> DataFrame:
    """``node`` and columns ``names``: sums of ``columns`` times a column of ``weights`` each.

    The weights go to the tasks as data. As literals they would make every round code of its own to compile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(row) for row in weights.T @ x)], ["node", *names])

    return table.select("node", *columns).mapInArrow(run, StructType([table.schema["node"], *(StructField(n, DoubleType()) for n in names)]))


def _half_inverse(gram: np.ndarray) -> np.ndarray:
    """W with Y·W orthonormal for Y'Y = ``gram``; columns without substance are 0."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    scale = np.where(values > TINY * max(values[-1], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return (vectors * scale)[:, ::-1]


def _gram(table: DataFrame, columns: list[str]) -> np.ndarray:
    """The products of all pairs of columns, summed in the tasks; a number a pair reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    parts = table.select(*columns).mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "v"))
    sums = {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    n = len(columns)
    return np.array([sums.get(i, 0.0) for i in range(n * n)]).reshape(n, n)


def spectrum(edges: DataFrame, d: int, matrix: str = "adjacency", rounds: int = 100, tol: float = 1e-9, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """``node, x`` and the ``d`` eigenvalues of largest size of the symmetric matrix of ``edges (head, tail, weight)``.

    ``adjacency`` holds the weights, ``laplacian`` the degrees less the weights; equal and opposite edges add up and
    loops count once. The sizes of the values are the singular values. ``x`` has a component an eigenvector, of which
    the largest entry (of the least such node) is positive; of values of one size the positive one comes first. For small ``edges`` it has fewer than ``d``.

    A round is a join of the entries with a table of d + :data:`EXTRA` columns by node and one sum by node; the
    columns are made orthonormal by the inverse root of their small Gram matrix, which is all that reaches the driver.
    Rounds end when no value moves by more than ``tol`` of the largest one, or after ``rounds``, of which there is one at
    least. Either way the vectors are those that the last round's columns span best, so values of both signs do not mix.
    """
    own = edges.filter("head IS NOT NULL AND tail IS NOT NULL AND weight IS NOT NULL").select(F.col("head").alias("i"), F.col("tail").alias("j"), F.col("weight").cast("double").alias("w"))
    both = own.unionByName(own.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    entries = materialise(both, "entries")
    degrees = materialise(entries.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("deg")), "degrees")
    p = min(d + EXTRA, degrees.count())
    if not p:
        return degrees.select("node", F.array().cast("array<double>").alias("x")), []
    v, y = [f"v{k}" for k in range(p)], [f"y{k}" for k in range(p)]
    start = [(F.pmod(F.xxhash64("node", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0).alias(c) for k, c in enumerate(v)]
    table = materialise(degrees.select("node", *start), "iterate")
    x, old = _mixed(table, v, _half_inverse(_gram(table, v)), v), None
    for left in reversed(range(rounds)):
        moved = entries.join(x.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(*(F.sum(F.col("w") * F.col(a)).alias(b) for a, b in zip(v, y)))
        joined = x.join(moved, "node")
        if matrix == "laplacian":
            joined = joined.join(degrees, "node").withColumns({b: F.col("deg") * F.col(a) - F.col(b) for a, b in zip(v, y)}).drop("deg")
        before, table = table, materialise(joined, "iterate")
        discard(before)
        both = _gram(table, [*v, *y])
        ritz, gram = both[:p, p:], both[p:, p:]
        values, inner = np.linalg.eigh((ritz + ritz.T) / 2)
        size = np.round(np.abs(values) / max(np.max(np.abs(values)), 1e-300), 7)
        order = np.lexsort((-values, -size))  # of two values of one size the positive one is first
        values, inner = values[order], inner[:, order]
        if not left or (old is not None and np.max(np.abs(np.abs(values[:d]) - np.abs(old[:d]))) <= tol * max(abs(values[0]), 1e-300)):
            break
        x, old = _mixed(table, y, _half_inverse(gram), v), values
    kept = min(d, p)
    named = materialise(_mixed(table, v, inner[:, :kept], v[:kept]), "eigenvectors")
    signs = [F.min_by(F.signum(c), F.struct((-F.round(F.abs(F.col(c)), 9)).alias("size"), "node")).alias(c) for c in v[:kept]]
    sign = named.agg(*signs).first()
    out = materialise(named.select("node", F.array(*(F.col(c) * F.lit(float(sign[c] or 1.0)) for c in v[:kept])).alias("x")), "spectrum")
    discard(named, table, entries, degrees)
    return out, [float(a) for a in values[:kept]]
