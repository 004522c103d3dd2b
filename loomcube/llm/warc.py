"""Deterministic sharded WARC writer and reader.

Records are range-sorted, each range is written by one task that rolls to a new file by compressed size, headers
and digests are made anew, and files get their names by renaming temporary ones. A manifest table names the files
of the tasks that were committed; a reader takes no other file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm.common import map_arrow, materialise, shared_dir

#: Compressed bytes after which a new file is begun; pages of a payload from which on repeats become revisits.
ROLL_BYTES, DEDUP_FROM = 256 << 20, 0
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, url: str, digest: str, copy: int) -> str:
    name = hashlib.sha1(f"{page_id}\n{copy}\n{digest}\n{url}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, copy: int, refers: tuple | None) -> bytes:
    """One record. ``refers`` is the page and URL of the response that a revisit points to."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"X-Page-Id: {'-' if page_id is None else page_id}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0], refers[1], digest, 0)}", f"X-Refers-To-Page-Id: {'-' if refers[0] is None else refers[0]}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class Roller:
    """Writes gzip members to files of about ``limit`` bytes; a file gets its name when it is complete."""

    def __init__(self, root: str, shard: str, limit: int) -> None:
        self.files, self.path = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.sequence = shard, limit, 0
        self.out = None

    def add(self, record: bytes) -> dict | None:
        """Writes a record; the manifest row of the file that this filled, if any."""
        if self.out is None:
            self.name = f"{self.shard}-{self.sequence:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(self.temporary)
            self.records = self.bytes = 0
            self.digest = hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.records += 1
        self.bytes += len(member)
        return self.close() if self.bytes >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.files.move(self.temporary, f"{self.path}/{self.name}")
        self.out = None
        self.sequence += 1
        return {"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.digest.hexdigest()}


def sorted_records(pages: DataFrame, dedup_from: int = DEDUP_FROM) -> DataFrame:
    """Range-sorted rows for the writers: each page, and before it a row that says which response it revisits.

    Which page of a payload is the response is found on digests alone. The answer travels with the pages through
    one range exchange instead of a join, so the payloads are moved once.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), text.alias("html"), F.sha1(text).alias("digest"))
    keys = rows.select("page_id", "url", "digest", F.octet_length("html").alias("size")).filter(F.col("size") >= dedup_from)
    best = keys.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = materialise(best.drop("n"), "warc-best")  # a plain table, so that the pages of a common payload can be split
    notes = keys.join(best, ["digest", "size"]).filter("NOT (page_id <=> best.page_id AND url <=> best.url)")
    notes = notes.select("page_id", "url", "digest", F.lit(None).cast("string").alias("html"), F.lit(0).alias("kind"), F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"))
    notes = notes.distinct()
    own = rows.withColumns({"kind": F.lit(1), "best_id": F.lit(None).cast("long"), "best_url": F.lit(None).cast("string")})
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(notes).repartitionByRange(n, "page_id", "url").sortWithinPartitions("page_id", "url", "digest", "kind")


def write_archives(pages: DataFrame, root: str, roll: int = ROLL_BYTES, dedup_from: int = DEDUP_FROM) -> DataFrame:
    """Write all pages as WARC files under ``root`` and return the manifest.

    Among records with equal payloads of at least ``dedup_from`` bytes the one with the largest page_id (then URL,
    then the first of repeated rows) is a response and the others revisit it.
    """
    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        roller = Roller(root, f"shard-{TaskContext.get().partitionId():05d}", roll)
        note, last, copy = None, None, 0
        for batch in batches:
            done = []
            names = batch.schema.names
            for values in zip(*(batch.column(i) for i in range(len(names))), strict=True):
                row = {k: v.as_py() for k, v in zip(names, values, strict=True)}
                key = row["page_id"], row["url"], row["digest"]
                if row["kind"] == 0:
                    note = key, (row["best_id"], row["best_url"])
                    continue
                copy = copy + 1 if key == last else 0
                last = key
                payload = row["html"].encode()
                refers = note[1] if note and note[0] == key else None
                if refers is None and copy and len(payload) >= dedup_from:
                    refers = row["page_id"], row["url"]
                digest = base32(hashlib.sha1(payload).digest())
                done.append(roller.add(build_record(row["page_id"], row["url"], payload, digest, copy, refers)))
            if done := [d for d in done if d]:
                yield pa.RecordBatch.from_pylist(done)
        if end := roller.close():
            yield pa.RecordBatch.from_pylist([end])

    manifest = map_arrow(sorted_records(pages, dedup_from), run, MANIFEST)
    manifest.write.parquet(f"{root}/_manifest")  # names files of committed tasks only
    for left in files.get_file_info(fs.FileSelector(path)):
        if left.type == fs.FileType.File and left.base_name.startswith(".shard-"):  # of attempts that failed
            files.delete_file(left.path)
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{root}/_manifest")


def members(stream, chunk: int = 1 << 20, sha256: str | None = None) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time; at its end the digest of the file has to be the given one."""
    unpack, parts, rest, digest = zlib.decompressobj(31), [], b"", hashlib.sha256()
    while True:
        if not rest:
            rest = stream.read(chunk)
            digest.update(rest)
        if not rest:
            break
        data, rest = rest, b""
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")
    if sha256 is not None and digest.hexdigest() != sha256:
        raise ValueError("the archive is not the one that the manifest names")


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Block-Digest"] == "sha1:" + base32(hashlib.sha1(block).digest())
    if response:
        whole &= size == len(payload) and digest == base32(hashlib.sha1(payload).digest())
    number = {k: None if fields.get(k, "-") == "-" else int(fields[k]) for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    return {
        "page_id": number["X-Page-Id"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number["X-Refers-To-Page-Id"], "url": fields["WARC-Target-URI"], "intact": whole,
    }


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """The records of the files that the manifest names; ``intact`` is whether all digests agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(root)
        names = [f.name for f in schema]
        for batch in batches:
            for name, sha256 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows = []
                    for record in members(stream, sha256=sha256):
                        rows.append(parse_record(record))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, types).select(names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types).select(names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    types = to_arrow_schema(schema)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("file", "sha256").repartition(n), run, schema)


def archive_pages(pages: DataFrame, root: str | None = None, roll: int = ROLL_BYTES, dedup_from: int = DEDUP_FROM) -> DataFrame:
    """Write all pages and read the archives back: one row per page.

    A null html is an empty payload, a null url an empty one; a null page_id comes back as null. Repeated rows are
    kept, the second and later ones as revisits of the first. Other columns are ignored.
    """
    root = root or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, root, roll, dedup_from), root)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


#: The base32 alphabet and the bits of hexadecimal digits.
_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, h, array_to_string(list_transform(range(1, 41), lambda i: ([{_BITS}])[1 + strpos('0123456789abcdef', substr(sha1(h), CAST(i AS INTEGER), 1)) - 1]), '') AS bits FROM p),
d AS (SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(k * 5 + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(power(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact FROM m"""
