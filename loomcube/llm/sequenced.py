"""Numbered changes applied in order, by a stateful stream over an LSM-like buffer of the changes that came too early.

Clients are dealt to buckets by hash, and a bucket is the key of the state. Its changes that cannot be applied yet lie
in runs: each batch appends one run, sorted by client and number, to a list state of its own, as blocks of rows. The
runs are read by a heap merge, a block of each at a time, along with the register of clients (next number, values) and
the new rows. Per run, a cursor counts the rows at its start that have been applied. When :data:`RUNS` runs are in use,
what is left in them is merged into one. Each row of a run carries the least day from it to the end of its client, so
the heads of the runs tell a client's earliest held day without reading on.

Of the rows of one batch with one client and number only the first can be held or applied. These are picked by a
grouping before the stream, and only they are dealt by client; the others, which are rejected whatever the state, are
dealt by their own hash. A client's kept numbers are one ordered list and go to one task of a batch; its held rows
stream past and are never in memory together.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomcube.llm.common import discard, materialise, remove, shared_dir, ship_package
from loomcube.operators.rank import positions
from loomcube.storage import move

#: Batches of the query, and days after which a client stops waiting for a missing number.
BATCHES, PATIENCE = 10, 8
#: Epoch day at which the first batch begins, and days that the batches cover.
FIRST_DAY, DAYS = 19723, 160
#: Runs of a bucket before they are merged into one.
RUNS = 4
#: Rows of a block of a run.
BLOCK = 2048
#: Changes of all batches that a bucket is made for.
BUCKET_ROWS = 20_000
#: Day that no row has.
NEVER = 1 << 40

INPUT = "bucket int, first boolean, client_id long, n long, day long, change_id long, op string, city string, balance double"
OUTPUT = "client_id long, n long, change_id long, op string, status string, batch int, missed long, city string, balance double"
RUN = pa.schema([("client", pa.int64()), ("n", pa.int64()), ("day", pa.int64()), ("change_id", pa.int64()), ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64()), ("least", pa.int64())])
REGISTER = pa.schema([("client", pa.int64()), ("next", pa.int64()), ("city", pa.string()), ("balance", pa.float64())])
Result = Row(*(c.split()[0] for c in OUTPUT.split(", ")))


class Held(NamedTuple):
    """A change in a run; ``least`` is the least day from it to the end of its client in the run."""

    client: int | None
    n: int
    day: int
    change_id: int
    op: str | None
    city: str | None
    balance: float | None
    least: int = NEVER


class Client(NamedTuple):
    client: int | None
    next: int = 1
    city: str | None = None
    balance: float | None = None

    def applied(self, row: Held) -> Client:
        """After ``row``: I sets the values, U those that are not null, D clears them; other operations keep them."""
        city, balance = self.city, self.balance
        if row.op == "I":
            city, balance = row.city, row.balance
        elif row.op == "U":
            city, balance = (city if row.city is None else row.city), (balance if row.balance is None else row.balance)
        elif row.op == "D":
            city = balance = None
        return Client(self.client, row.n + 1, city, balance)


def rank_of(client: int | None) -> tuple[bool, int]:
    """Clients in order, null first."""
    return (client is not None, client or 0)


class Writer:
    """Appends rows to a list state, a block at a time."""

    def __init__(self, state, schema: pa.Schema):
        self.state, self.schema, self.rows, self.total = state, schema, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) == BLOCK:
            self.close()

    def close(self) -> None:
        if self.rows:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as out:
                out.write_batch(batch)
            self.state.appendValue((len(self.rows), sink.getvalue().to_pybytes()))
            self.total += len(self.rows)
            self.rows = []


def blocks(state, skip: int = 0) -> Iterator[tuple]:
    """Rows of a list state without the first ``skip``; skipped blocks are not unpacked."""
    for size, data in state.get() if state.exists() else ():
        if skip >= size:
            skip -= size
            continue
        columns = pa.ipc.open_stream(bytes(data)).read_next_batch().columns
        rows = zip(*(c.to_pylist() for c in columns))
        for _ in range(skip):
            next(rows)
        skip = 0
        yield from rows


class Cursor:
    """The rows of one run from its cursor on; counts those at its start that are done."""

    def __init__(self, slot: int, state, done: int):
        self.slot, self.done, self.clean = slot, done, True
        self.rows = map(Held._make, blocks(state, done))
        self.head = next(self.rows, None)

    def step(self, gone: bool) -> None:
        """Goes on to the next row; ``gone`` says that the present one is held no longer."""
        self.clean &= gone
        self.done += self.clean
        self.head = next(self.rows, None)


class Merge:
    """What a client holds in all runs, by number."""

    def __init__(self, cursors: list[Cursor]):
        self.heap = [(rank_of(c.head.client), c.head.n, i, c) for i, c in enumerate(cursors) if c.head]
        heapq.heapify(self.heap)

    def client(self) -> tuple[bool, int] | None:
        return self.heap[0][0] if self.heap else None

    def peek(self, client: tuple[bool, int], after: int) -> Held | None:
        """The client's held row of the least number; rows below ``after`` were applied by an earlier batch."""
        while self.heap and self.heap[0][0] == client:
            row = self.heap[0][3].head
            if row.n >= after:
                return row
            self.pop(True)
        return None

    def pop(self, gone: bool) -> None:
        _, _, i, cursor = self.heap[0]
        cursor.step(gone)
        if cursor.head:
            heapq.heapreplace(self.heap, (rank_of(cursor.head.client), cursor.head.n, i, cursor))
        else:
            heapq.heappop(self.heap)

    def earliest(self, client: tuple[bool, int], after: int) -> int:
        """The client's earliest held day: the least one at the heads of the runs."""
        return min(c.head.least for k, n, _, c in self.heap if k == client and n >= after)


class Applier(StatefulProcessor):
    """One batch of :func:`apply_changes`: ``horizon`` is the largest day of earlier batches, ``None`` ends all waiting."""

    def __init__(self, batch: int, horizon: int | None, patience: int = PATIENCE):
        self.batch, self.horizon, self.patience = batch, horizon, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        block = "rows int, data binary"
        self.runs = [handle.getListState(f"run_{i}", block) for i in range(RUNS + 2)]
        self.registers = [handle.getListState(f"clients_{i}", block) for i in range(2)]
        self.meta = handle.getValueState("meta", "slots array<int>, cursors array<long>, register int")

    def close(self) -> None:
        pass

    def expired(self, day: int) -> bool:
        return self.horizon is None or day + self.patience <= self.horizon

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: list[tuple] = []
        for _, first, client, n, day, change_id, op, city, balance in rows:
            if first:
                fresh.append((rank_of(client), n, day, change_id, op, city, balance, client))
            elif first is not None:  # a null marks the row that wakes a bucket
                yield Result(client, n, change_id, op, "rejected", self.batch, 0, None, None)
        fresh.sort(key=lambda r: r[:4])
        slots, done, register = self.meta.get() or ([], [], 0)
        cursors = [Cursor(slot, self.runs[slot], at) for slot, at in zip(slots, done)]
        free = [i for i in range(RUNS + 2) if i not in set(slots)]
        kept = Writer(self.runs[free[0]], RUN) if len(slots) >= RUNS else None
        new, clients = Writer(self.runs[free[1 if kept else 0]], RUN), Writer(self.registers[1 - register], REGISTER)
        yield from self.merge(fresh, Merge(cursors), map(Client._make, blocks(self.registers[register])), kept, new, clients)
        for writer in filter(None, (kept, new, clients)):
            writer.close()
        self.registers[register].clear()
        live = []
        for cursor in cursors:
            if kept or cursor.clean:
                self.runs[cursor.slot].clear()
            else:
                live.append((cursor.slot, cursor.done))
        live += [(slot, 0) for slot, writer in zip(free, (kept, new) if kept else (new,)) if writer.total]
        self.meta.update(([s for s, _ in live], [d for _, d in live], 1 - register))

    def merge(self, fresh: list[tuple], held: Merge, known: Iterator[Client], kept: Writer | None, new: Writer, clients: Writer) -> Iterator[Row]:
        """Goes through the clients of runs, register and new rows in one order."""
        at, entry = 0, next(known, None)
        while True:
            todo = [r for r in (held.client(), fresh[at][0] if at < len(fresh) else None, rank_of(entry.client) if entry else None) if r is not None]
            if not todo:
                return
            client = min(todo)
            if entry and rank_of(entry.client) == client:
                state, entry = entry, next(known, None)
            else:
                state = Client(client[1] if client[0] else None)
            end = at
            while end < len(fresh) and fresh[end][0] == client:
                end += 1
            state = yield from self.one_client(client, state, fresh[at:end], held, kept, new)
            clients.add(tuple(state))
            at = end

    def one_client(self, client: tuple[bool, int], state: Client, fresh: list[tuple], held: Merge, kept: Writer | None, new: Writer) -> Iterator[Row]:
        def applied(row: Held, missed: int) -> Row:
            return Result(state.client, row.n, row.change_id, row.op, "applied", self.batch, missed, state.city, state.balance)

        while row := held.peek(client, state.next):  # the start of the batch: waiting ends
            if row.n > state.next and not self.expired(held.earliest(client, state.next)):
                break
            missed, state = row.n - state.next, state.applied(row)
            held.pop(True)
            yield applied(row, missed)
        late: list[Held] = []
        taken = 0
        for _, n, day, change_id, op, city, balance, _ in fresh:
            while (row := held.peek(client, state.next)) and row.n <= n:
                taken = row.n
                if row.n == state.next:
                    state = state.applied(row)
                    held.pop(True)
                    yield applied(row, 0)
                else:
                    self.keep(client, state.next, held, kept)
            change = Held(state.client, n, day, change_id, op, city, balance)
            if n < state.next or n == taken:
                yield Result(state.client, n, change_id, op, "rejected", self.batch, 0, None, None)
            elif n == state.next:
                state, taken = state.applied(change), n
                yield applied(change, 0)
            else:
                late.append(change)
                taken = n
        while row := held.peek(client, state.next):
            if row.n == state.next:
                state = state.applied(row)
                held.pop(True)
                yield applied(row, 0)
            else:
                self.keep(client, state.next, held, kept)
        least = NEVER
        for i in range(len(late) - 1, -1, -1):
            least = min(least, late[i].day)
            late[i] = late[i]._replace(least=least)
        for change in late:
            new.add(tuple(change))
        return state

    @staticmethod
    def keep(client: tuple[bool, int], after: int, held: Merge, kept: Writer | None) -> None:
        """The next held row stays: in its run, or in the run that replaces all."""
        row = held.peek(client, after)
        if kept:
            kept.add(tuple(row._replace(least=held.earliest(client, after))))
        held.pop(False)


def _crc(change_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(change_id).cast("string"), F.lit("")).cast("binary"))


def prepared(changes: DataFrame) -> DataFrame:
    """``client_id, n, day, change_id, op, city, balance, batch`` of the distinct changes that count.

    n is the dense rank of seq among the client's changes, null first. A change without time, or of whose hash 11 is a
    divisor (so one without change_id), drops out after that; the day of the others is put off by up to 15 days. A
    null client is a client; days before the first batch belong to it.
    """
    own = changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
    numbers = positions(own.select("client_id", "seq").distinct(), "client_id", [F.col("seq").asc_nulls_first()], "n")
    h = _crc("change_id")
    day = (F.unix_date(F.to_date("valid_at")) + 5 * (h % 4)).cast("long")
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    counted = own.filter(F.col("valid_at").isNotNull() & (h % 11 != 0)).distinct().withColumns({"day": day, "batch": batch})
    numbers = numbers.select(F.col("client_id").alias("c"), F.col("seq").alias("s"), "n")
    same = F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s"))
    return counted.join(numbers, same).select("client_id", "n", "day", "change_id", "op", "source", "segment", "city", "balance", "batch")


def write_batches(changes: DataFrame, path: str, batches: int, buckets: int) -> dict[int, int]:
    """Writes the changes of each batch, and a row that wakes every bucket, to ``path``; returns the largest day by batch.

    ``changes`` has ``client_id, n, day, change_id, op, city, balance, batch``; further columns decide between rows
    that are equal in client, number, batch, day and change_id. Only the first row of a client and number in a batch
    is marked as first; it is found by a grouping that combines before the exchange.
    """
    keys = ["client_id", "n", "batch"]
    order = ["day", "change_id", *sorted(c for c in changes.columns if c not in {*keys, "day", "change_id"})]
    changes = materialise(changes.withColumn("place", F.struct(*(F.col(f"`{c}`") for c in order))), "changes")
    least = changes.groupBy(F.col("client_id").alias("c"), F.col("n").alias("k"), F.col("batch").alias("b")).agg(F.min("place").alias("least"))
    least = materialise(least, "first-changes")
    same = F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("k")) & (F.col("batch") == F.col("b"))
    first = F.col("place").eqNullSafe(F.col("least"))
    rows = changes.join(least, same).withColumn("first", first)
    rows = rows.withColumn("bucket", F.pmod(F.when(F.col("first"), F.xxhash64("client_id")).otherwise(F.xxhash64("change_id", "n")), F.lit(buckets)).cast("int"))
    columns = [c.split()[0] for c in INPUT.split(", ")]
    spark = changes.sparkSession
    wake = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(1), F.lit(batches + 1))).alias("batch"))
    rows.select(*columns, "batch").unionByName(wake, allowMissingColumns=True).write.partitionBy("batch").parquet(path)
    days = {r["batch"]: r["day"] for r in changes.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    discard(changes, least)
    return days


def apply_changes(changes: DataFrame, batches: int = BATCHES, patience: int = PATIENCE, buckets: int | None = None) -> DataFrame:
    """Feeds numbered changes (see :func:`write_batches`) through the stateful stream, a start for each batch.

    Returns ``client_id, n, change_id, op, status, batch, missed, city, balance`` of every row; the last start, with
    batch ``batches + 1``, applies what is still held. All starts share one checkpoint in a new folder below
    ``spark.checkpoint.dir``; tasks lost with an executor are repeated from the state of the batch before.
    Exactly repeated rows are one row for the caller to make distinct; if kept, all but one are rejected, or, if
    marked first together, the state rejects the others. No changes give no rows.
    """
    spark = changes.sparkSession
    folder = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    ship_package(spark)
    changes = materialise(changes, "numbered-changes")
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-changes.count() // BUCKET_ROWS))
    days = write_batches(changes, f"{folder}/batches", batches, buckets)
    discard(changes)
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start is one batch, and the next has other instances
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for batch in range(1, batches + 2):
            seen = [d for b, d in days.items() if b < batch]
            horizon = None if batch > batches else max(seen, default=-NEVER)
            move(spark, f"{folder}/batches/batch={batch}", f"{folder}/in/batch={batch}")
            stream = spark.readStream.schema(f"{INPUT}, batch int").parquet(f"{folder}/in").drop("batch")
            out = stream.groupBy("bucket").transformWithState(Applier(batch, horizon, patience), OUTPUT, "append", "none")
            started = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
            started.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for done in ("batches", "in", "checkpoint"):
        remove(spark, f"{folder}/{done}")
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")


def outcome(applied: DataFrame) -> DataFrame:
    """Status, values and ``current`` of every change from the rows of :func:`apply_changes`."""
    last = applied.filter("status = 'applied'").groupBy("client_id").agg(F.max("n").alias("last"))
    last = last.select(F.col("client_id").alias("c"), "last")
    same = F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("last"))
    current = (F.col("status") == "applied") & F.col("last").isNotNull() & ~F.col("op").eqNullSafe(F.lit("D"))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents")
    return applied.join(last, same, "left").select("change_id", "client_id", "status", "batch", "missed", "city", cents, current.alias("current"), "n")


def op12_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of clients in the order of their numbers: which are applied, when, and what they leave."""
    return outcome(apply_changes(prepared(spark.read.parquet(f"{sf_dir}/client_changes.parquet"))))
