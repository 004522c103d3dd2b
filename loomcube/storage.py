"""Shared storage for tables that are written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and workers see the same local folders."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; Hadoop removes it when the driver's JVM ends.

    Without the setting a private folder serves where all workers are on this machine (tests); elsewhere it is an
    error, since executors would write where no other reads.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = sc._loomcube_private = getattr(sc, "_loomcube_private", None) or f"file://{tempfile.mkdtemp(prefix='loomcube-')}"
    folder = f"{where.rstrip('/')}/loomcube-{sc.applicationId}"
    if getattr(sc, "_loomcube_folder", None) != folder:
        files, path = _hadoop(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._loomcube_folder = folder
    return folder


def _hadoop(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, whatever store it is in."""
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder within one store; the folder above ``target`` is made."""
    files, path = _hadoop(spark, source)
    where = _hadoop(spark, target)[1]
    files.mkdirs(where.getParent())
    if not files.rename(path, where):
        raise OSError(f"{source} could not be moved to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names within a folder of any store; none if it is missing."""
    files, where = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name below ``path``, length and time of every file of a folder, or of a file itself; none if it is missing."""
    files, where = _hadoop(spark, path)
    if not files.exists(where):
        return []
    out, found = [], files.listFiles(where, True)
    top = files.makeQualified(where).toString()
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString().removeprefix(top), int(status.getLen()), int(status.getModificationTime())))
    return sorted(out)


def materialise(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders of the values of ``by``, and read it back, so later plans neither repeat nor re-derive it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomcube_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables whose last reader has been written."""
    for table in tables:
        remove(table.sparkSession, table._loomcube_path)
