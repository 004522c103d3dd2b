"""Sinks, and stages that are computed once and reused."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from loomcube.storage import children, listing, remove


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``, built and written first if it is missing or ``refresh`` is set."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Stage:
    """A table: what it reads (paths and other stages), its parameters, and how it is built from the other stages' tables."""

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    paths: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    parameters: Mapping[str, object] = field(default_factory=dict)


class Stages:
    """Tables that depend on files and on each other; what depends on a change is built again, nothing else.

    A table lies in a folder named by the fingerprint of what it was built from: the files' names, lengths and times,
    the parameters, and the fingerprints of the stages before. A folder counts once its writer has finished, so a
    build that failed is repeated. Older folders of a stage go when the new one is there.
    """

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]):
        self.spark, self.root = spark, root
        self.stages = {s.name: s for s in stages}
        if unknown := sorted({a for s in stages for a in s.after} - set(self.stages)):
            raise ValueError(f"unknown stages: {', '.join(unknown)}")

    def order(self, wanted: list[str]) -> list[str]:
        """The wanted stages and all before them, each after what it needs."""
        done: list[str] = []
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in open_:
                raise ValueError(f"stages need each other: {' > '.join([*open_[open_.index(name):], name])}")
            if name not in done:
                open_.append(name)
                for before in self.stages[name].after:
                    visit(before)
                open_.pop()
                done.append(name)

        for name in wanted:
            visit(name)
        return done

    def fingerprint(self, stage: Stage, before: Mapping[str, str]) -> str:
        files = {p: listing(self.spark, p) for p in sorted(stage.paths)}
        if gone := [p for p, found in files.items() if not found]:
            raise FileNotFoundError(f"stage {stage.name} needs {', '.join(gone)}")
        facts = {"files": files, "parameters": dict(stage.parameters), "after": {a: before[a] for a in stage.after}}
        return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def run(self, *wanted: str) -> tuple[dict[str, DataFrame], list[str]]:
        """The tables of the wanted stages (of all by default) and those before, and the names of those built now."""
        prints: dict[str, str] = {}
        tables: dict[str, DataFrame] = {}
        built: list[str] = []
        for name in self.order(list(wanted) or list(self.stages)):
            stage = self.stages[name]
            prints[name] = self.fingerprint(stage, prints)
            path = f"{self.root}/{name}/{prints[name]}"
            if "_SUCCESS" not in children(self.spark, path):
                stage.build({a: tables[a] for a in stage.after}).write.mode("overwrite").parquet(path)
                built.append(name)
                for old in children(self.spark, f"{self.root}/{name}"):
                    if old != prints[name]:
                        remove(self.spark, f"{self.root}/{name}/{old}")
            tables[name] = self.spark.read.parquet(path)
        return tables, built


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that do not exist, by the file system each of them names."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if not make(p).getFileSystem(hadoop).exists(make(p))]


def write_table(df: DataFrame, path: str, kind: str = "parquet", one_file: bool = False) -> None:
    """Parquet, JSON lines, or CSV and TSV with a header; arrays in text formats are joined by semicolons."""
    from pyspark.sql import functions as F

    if kind in {"csv", "tsv"}:
        df = df.select(*(F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if kind == "parquet":
        out.parquet(path)
    elif kind == "json":
        out.json(path)
    else:
        out.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
