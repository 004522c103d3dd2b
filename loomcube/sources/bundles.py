"""Members of tar bundles, read one at a time where a list of the wanted ones is dealt by bundle."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcube.workers import ship_package

#: Bytes of members that are handed on at a time.
BATCH_BYTES = 8 << 20
OUT = pa.schema([("bundle", pa.string()), ("member", pa.string()), ("content", pa.binary())])


def _members(path: str, wanted: set[str] | None) -> Iterator[tuple[str, bytes]]:
    """Name and content of the wanted files of a bundle; it ends with the last of them."""
    store, place = pyarrow.fs.FileSystem.from_uri(path)
    packed = path.endswith((".gz", ".tgz", ".bz2", ".xz"))
    source = store.open_input_stream(place, compression=None) if packed else store.open_input_file(place)
    left = None if wanted is None else set(wanted)
    with source, tarfile.open(fileobj=source, mode="r|*" if packed else "r:") as bundle:  # a plain one is skipped through
        for info in bundle:
            if info.isfile() and (left is None or info.name in left):
                yield info.name, bundle.extractfile(info).read()
                if left is not None:
                    left.discard(info.name)
                    if not left:
                        return
            bundle.members = []  # the list of what has gone by would grow with the bundle


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[str, set[str] | None]]:
            bundle, names, every = None, set(), False
            for batch in batches:
                for b, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if b != bundle:
                        if bundle is not None:
                            yield bundle, None if every else names
                        bundle, names, every = b, set(), False
                    every |= m is None
                    names.add(m)
            if bundle is not None:
                yield bundle, None if every else names

        rows: list[tuple[str, str, bytes]] = []
        size = 0
        for bundle, names in groups():
            for member, content in _members(f"{folder.rstrip('/')}/{bundle}", names):
                rows.append((bundle, member, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

    return run


def read_members(wanted: DataFrame, folder: str) -> DataFrame:
    """``bundle, member, content`` of the ``wanted (bundle, member)`` files of tar bundles below ``folder``.

    A null member asks for all of a bundle. Wanted rows are dealt by bundle, the unit that is read in order; the
    memory of a task is the names wanted of a bundle and the members handed on at a time. Bundles without
    compression are skipped through by their headers, others stream by. ``folder`` is a path or an address of a store
    that Arrow opens in the workers. A bundle that is missing is an error, a member that is missing gives no row.
    """
    ship_package(wanted.sparkSession)
    rows = wanted.select(F.col("bundle").cast("string"), F.col("member").cast("string")).filter("bundle IS NOT NULL").distinct()
    n = max(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(n, "bundle").sortWithinPartitions("bundle", "member")
    return dealt.mapInArrow(_read(folder), "bundle string, member string, content binary")


def wanted_articles(files: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """``pmcid, member, text`` of the wanted articles of ``files (bundle, member, pmcid)``, read from their bundles."""
    chosen = files.join(wanted.select("pmcid").distinct(), "pmcid", "left_semi").select("bundle", "member", "pmcid")
    texts = read_members(chosen, folder).select("bundle", "member", F.col("content").cast("string").alias("text"))
    return chosen.distinct().join(texts, ["bundle", "member"]).select("pmcid", "member", "text")
