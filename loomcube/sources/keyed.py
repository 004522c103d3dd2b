"""Tables with keys that are updated in place of being rewritten, and a text cube that follows such updates.

A keyed table is a folder: rows lie in ``data/<generation>/bucket=<b>`` by the hash of their keys, and a manifest names
the generation that holds each bucket. An update writes the buckets of its keys anew, as a generation of its own, and
then the next manifest, under another name first. Readers of an older manifest keep its files; a failed update leaves
no trace in what is read. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomcube.operators.cube import newest
from loomcube.storage import children, discard, materialise, move, remove

BUCKETS = 64
#: Old rows and new rows of some buckets to the rows that these buckets hold from now on.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """A keyed table at ``path``; see the module. ``buckets`` stays as it was when the table was made."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = BUCKETS

    @classmethod
    def create(cls, path: str, rows: DataFrame, keys: tuple[str, ...], buckets: int = BUCKETS) -> KeyedTable:
        """A new table of ``rows``, whose keys should be unique."""
        table = cls(rows.sparkSession, path, keys, rows.schema, buckets)
        table._commit(rows, {}, set(range(buckets)))
        return table

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("v")) for n in children(self.spark, f"{self.path}/manifests"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Generation of each bucket that has rows."""
        version = self.versions()[-1] if version is None else version
        return {r["bucket"]: r["generation"] for r in self.spark.read.parquet(f"{self.path}/manifests/v{version}").collect()}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the last one by default; of some buckets only if these are named."""
        wanted = {b: g for b, g in self.manifest(version).items() if buckets is None or b in buckets}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{g}/bucket={b}" for b, g in sorted(wanted.items())))

    def touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def update(self, rows: DataFrame, merge: Merge) -> set[int]:
        """Merges ``rows`` into the buckets of their keys and returns these; the files of all others stay."""
        buckets = self.touched(rows)
        if buckets:
            self._commit(merge(self.read(buckets=buckets), rows), self.manifest(), buckets)
        return buckets

    def replace(self, rows: DataFrame) -> DataFrame:
        """Puts ``rows``, whose keys are unique, in place of those with their keys, and returns these as a stored table.

        Old and new rows of the buckets meet in the exchange that deals them to files; those that go out are written
        beside those that stay.
        """
        buckets, version = self.touched(rows), self.versions()[-1] + 1
        if not buckets:
            return materialise(self.spark.createDataFrame([], self.schema), "rows-out")
        columns, keys = [F.col(f"`{f.name}`") for f in self.schema], [F.col(f"`{k}`") for k in self.keys]
        both = self.read(buckets=buckets).select(*columns, F.lit(0).alias("__new")).unionByName(rows.select(*columns, F.lit(1).alias("__new")))
        dealt = both.withColumn("bucket", self.bucket()).repartition("bucket")
        met = F.max("__new").over(Window.partitionBy("bucket", *keys))
        placed = dealt.withColumn("__out", F.when(F.col("__new") < met, 1).otherwise(0)).drop("__new")
        draft, out = f"{self.path}/drafts/data{version}", f"{self.path}/replaced/v{version}-{uuid.uuid4().hex}"
        placed.sortWithinPartitions("__out", "bucket", *keys).write.mode("overwrite").partitionBy("__out", "bucket").parquet(draft)
        data = f"{self.path}/data/{version}"
        remove(self.spark, data)  # of a writer that did not come as far as the manifest
        move(self.spark, f"{draft}/__out=0", data)
        move(self.spark, f"{draft}/_SUCCESS", f"{data}/_SUCCESS")
        gone = self.spark.createDataFrame([], self.schema)
        if "__out=1" in children(self.spark, draft):
            move(self.spark, f"{draft}/__out=1", out)
            gone = self.spark.read.schema(self.schema).parquet(out).select(*columns)
        gone._loomcube_path = out
        remove(self.spark, draft)
        self._publish(version, self.manifest(), buckets)
        return gone

    def _commit(self, rows: DataFrame, before: dict[int, int], buckets: set[int]) -> None:
        version = (self.versions() or [0])[-1] + 1
        data = f"{self.path}/data/{version}"
        dealt = rows.select(*(F.col(f"`{f.name}`") for f in self.schema)).withColumn("bucket", self.bucket())
        dealt.repartition("bucket").sortWithinPartitions("bucket", *(f"`{k}`" for k in self.keys)).write.mode("overwrite").partitionBy("bucket").parquet(data)
        self._publish(version, before, buckets)

    def _publish(self, version: int, before: dict[int, int], buckets: set[int]) -> None:
        data = f"{self.path}/data/{version}"
        written = {int(n.removeprefix("bucket=")) for n in children(self.spark, data) if n.startswith("bucket=")}
        after = {b: g for b, g in before.items() if b not in buckets} | dict.fromkeys(written, version)
        draft = f"{self.path}/drafts/v{version}"
        self.spark.createDataFrame(sorted(after.items()), "bucket int, generation int").coalesce(1).write.mode("overwrite").parquet(draft)
        move(self.spark, draft, f"{self.path}/manifests/v{version}")


def latest_rows(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """The latest row of each key; rows whose keys are unique, as a count of the keys alone shows, stay where they are."""
    own = [F.col(f"`{k}`") for k in keys]
    if not rows.groupBy(*own).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return rows
    return newest(rows.withColumn("__key", F.struct(*own)), "__key", f"`{version}`").drop("__key")


def upsert(table: KeyedTable, rows: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Puts each row of ``rows`` in place of that with its key if ``version`` is as late or later.

    Of new rows with one key the latest counts. Returns the rows that went out and those that came in, as stored
    tables; late arrivals of older versions are in neither.
    """
    keys = [f"`{k}`" for k in table.keys]
    latest = latest_rows(rows.select(*(F.col(f"`{f.name}`") for f in table.schema)), table.keys, version)
    buckets = table.touched(latest)
    old = table.read(buckets=buckets)
    before = old.select(F.struct(*(F.col(f"`{k}`") for k in table.keys)).alias("__key"), F.col(f"`{version}`").alias("__before"))
    named = latest.withColumn("__key", F.struct(*keys)).join(before, "__key", "left")
    come = materialise(named.filter(F.col("__before").isNull() | (F.col(f"`{version}`") >= F.col("__before"))).drop("__key", "__before"), "rows-in")
    gone = table.replace(come)
    return gone, come


class IncrementalCube:
    """Documents by id, and frequencies by category and entity that follow their updates.

    ``observe`` turns documents into ``category, doc_id, entity, cnt``, document by document. An update takes what the
    replaced versions gave out of the sums and adds what the new ones give, so its cost is that of the changed
    documents and of the buckets they and their cells are in.
    """

    def __init__(self, path: str, docs: DataFrame, observe: Callable[[DataFrame], DataFrame], version: str = "version", buckets: int = BUCKETS):
        self.observe, self.version = observe, version
        self.docs = KeyedTable.create(f"{path}/documents", latest_rows(docs, ("doc_id",), version), ("doc_id",), buckets)
        cells = self._sums([(self.docs.read(), 1)])
        self.cells = KeyedTable.create(f"{path}/cells", cells, ("category", "entity"), buckets)

    def _sums(self, parts: list[tuple[DataFrame, int]]) -> DataFrame:
        """``category, entity, tf, df`` of signed documents; the cells of no entity count a category's documents."""
        out = None
        for docs, sign in parts:
            seen = self.observe(docs)
            rows = seen.select("category", "entity", (F.col("cnt") * sign).cast("long").alias("tf"), F.lit(sign).cast("long").alias("df"))
            all_docs = seen.select("category", "doc_id").distinct().select("category", F.lit(None).cast("string").alias("entity"), F.lit(0).cast("long").alias("tf"), F.lit(sign).cast("long").alias("df"))
            both = rows.unionByName(all_docs)
            out = both if out is None else out.unionByName(both)
        return self._added(out)

    @staticmethod
    def _added(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("category", "entity").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        return sums.filter("tf <> 0 OR df <> 0")

    def update(self, docs: DataFrame) -> None:
        """Brings new versions of documents and new documents in; see :func:`upsert`."""
        gone, come = upsert(self.docs, docs, self.version)
        change = materialise(self._sums([(gone, -1), (come, 1)]), "cell-changes")
        self.cells.update(change, lambda own, new: self._added(own.unionByName(new)))
        discard(gone, come, change)

    def frequencies(self) -> DataFrame:
        """``category, entity, tf, df``."""
        return self.cells.read().filter("entity IS NOT NULL")

    def documents_per_category(self) -> DataFrame:
        """``category, n_docs`` of the documents with any entity."""
        return self.cells.read().filter("entity IS NULL").select("category", F.col("df").alias("n_docs"))
