"""The change applier against a version that goes through the rows one by one, as the contract reads."""

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from loomcube.llm import sequenced

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, n long, day string, bucket string, `a.b` string"
EPOCH = datetime(1970, 1, 1)


def plain(rows, patience=8):
    rows = list(dict.fromkeys(r[:9] for r in rows))
    seqs = defaultdict(set)
    for r in rows:
        seqs[r[1]].add(r[2])
    rank = {c: {s: i for i, s in enumerate(sorted(ss, key=lambda s: (s is not None, s or 0)), 1)} for c, ss in seqs.items()}
    batches = defaultdict(list)
    for change, client, seq, op, at, source, segment, city, balance in rows:
        h = zlib.crc32(str(change).encode()) if change is not None else 0
        if at is None or h % 11 == 0:
            continue
        day = (at - EPOCH).days + 5 * (h % 4)
        batch = min(10, max(1, 1 + math.floor((day - 19723) * 10 / 160)))
        batches[batch].append((client, rank[client][seq], day, change, op, city, balance))
    state = defaultdict(lambda: [1, None, None])
    held = defaultdict(dict)
    out, last = {}, {}

    def apply(client, n, batch, missed):
        day, change, op, city, balance = held[client].pop(n)
        s = state[client]
        s[0] = n + 1
        if op == "I":
            s[1:] = city, balance
        elif op == "U":
            s[1:] = s[1] if city is None else city, s[2] if balance is None else balance
        elif op == "D":
            s[1:] = None, None
        cents = None if s[2] is None else math.floor(100 * s[2] + 0.5)
        out[client, n, day, change, op, city, balance] = ["applied", batch, missed, s[1], cents, False]
        last[client] = (client, n, day, change, op, city, balance)

    def drain(client, batch):
        while state[client][0] in held[client]:
            apply(client, state[client][0], batch, 0)

    largest = None
    for batch in range(1, 12):
        for client in list(held):
            while held[client] and (batch == 11 or largest is not None and min(v[0] for v in held[client].values()) + patience <= largest):
                n = min(held[client])
                missed, state[client][0] = n - state[client][0], n
                apply(client, n, batch, missed)
                drain(client, batch)
        for row in sorted(batches[batch], key=lambda r: (r[2], r[3], r[4] or "", r[5] or "", r[6] or 0)):
            client, n, *rest = row
            if n in held[client] or n < state[client][0]:
                out[row] = ["rejected", batch, 0, None, None, False]
            else:
                held[client][n] = rest
                drain(client, batch)
        days = [r[2] for r in batches[batch]]
        largest = max([*days, *([largest] if largest is not None else [])], default=None)
    for row in last.values():
        out[row][5] = row[4] != "D"
    return sorted(((r[3], r[0], *v, r[1]) for r, v in out.items()), key=repr)


def changes(n, seed, clients, hot=0.3):
    r = random.Random(seed)
    out, at = [], defaultdict(int)
    for i in range(n):
        client = 7 if r.random() < hot else r.choice([*range(clients), None])
        at[client] += r.choice([0, 1, 1, 1, 2])
        when = None if r.random() < 0.01 else datetime(2024, 1, 1) + timedelta(hours=r.randrange(int(120 * 24 * i / n), int(120 * 24 * i / n) + 100))
        op = r.choice(["I", "U", "U", "U", "D", None])
        out.append((i, client, at[client] if r.random() < 0.95 else r.randrange(n), op, when, "s", None, r.choice([None, "Bel", "Ilar"]), r.choice([None, 2.005, 1.115, -3.335, 8.0]), 1, "x", "y", "z"))
        if r.random() < 0.1:
            out.append(out[-1] if r.random() < 0.5 else (i + n, *out[-1][1:]))
    r.shuffle(out)
    return out


def got(df):
    names = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current", "n"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "block", "buckets"), [(1, 16, 3), (2, 2048, 1)])
def test_changes_equal_the_plain_version(frame, seed, block, buckets, monkeypatch):
    monkeypatch.setattr(sequenced, "BLOCK", block)
    rows = changes(1500, seed, 40)
    numbered = sequenced.prepared(frame(rows, SCHEMA).repartition(3))
    assert got(sequenced.outcome(sequenced.apply_changes(numbered, buckets=buckets))) == plain(rows)


class Store(list):
    """A list state without a stream."""

    def get(self):
        return iter(list(self))

    def exists(self):
        return bool(self)

    appendValue = list.append


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def without_stream(batches, patience, monkeypatch):
    """Rows of all batches of one bucket; the runs in use after each batch."""
    monkeypatch.setattr(sequenced, "BLOCK", 8)
    runs, registers, meta, out, used = [Store() for _ in range(sequenced.RUNS + 2)], [Store(), Store()], Value(), [], []
    days = []
    for k, batch in enumerate([*batches, []], 1):
        one = sequenced.Applier(k, None if k > len(batches) else max(days, default=-sequenced.NEVER), patience)
        one.runs, one.registers, one.meta = runs, registers, meta
        rows = [(0, None, *[None] * 7), *((0, True, *r) for r in batch)]
        out += [tuple(r) for r in one.handleInputRows((0,), iter(rows), None)]
        used.append([(s, sum(n for n, _ in runs[s])) for s in meta.value[0]])
        assert all(not runs[i] for i in range(len(runs)) if i not in meta.value[0])
        days += [r[2] for r in batch]
    return out, used


def test_runs_cursors_and_merges(monkeypatch):
    """Long waits fill all runs, so that they are merged; the rows are those of the plain rules."""
    for seed in range(12):
        r = random.Random(seed)
        batches, left = [], {(c, n): None for c in (None, 1, 2) for n in range(1, 120)}
        for k in range(14):
            part = r.sample(sorted(left, key=repr), min(len(left), 20))
            part = [p for p in part if p[1] > 2 or k > 9]
            batches.append([(c, n, 10 * k + r.randrange(10), 1000 * k + i, "U", None, float(n)) for i, (c, n) in enumerate(part)])
            for p in part:
                if r.random() < 0.8:
                    left.pop(p)
        patience = r.choice([5, 40, 100])
        out, used = without_stream(batches, patience, monkeypatch)
        assert max(map(len, used)) <= sequenced.RUNS + 1 and not used[-1]
        assert patience < 50 or max(map(len, used)) == sequenced.RUNS
        held, nexts, want, largest = defaultdict(dict), defaultdict(lambda: 1), [], None
        for k, batch in enumerate([*batches, []], 1):
            for c in list(held):
                while held[c] and (k > len(batches) or largest is not None and min(d for d, _ in held[c].values()) + patience <= largest):
                    n = min(held[c])
                    want.append((c, n, held[c].pop(n)[1], "applied", k, n - nexts[c]))
                    nexts[c] = n + 1
                    while nexts[c] in held[c]:
                        want.append((c, nexts[c], held[c].pop(nexts[c])[1], "applied", k, 0))
                        nexts[c] += 1
            for c, n, day, change, *_ in sorted(batch, key=lambda x: x[2:4]):
                if n < nexts[c] or n in held[c]:
                    want.append((c, n, change, "rejected", k, 0))
                    continue
                held[c][n] = (day, change)
                while nexts[c] in held[c]:
                    want.append((c, nexts[c], held[c].pop(nexts[c])[1], "applied", k, 0))
                    nexts[c] += 1
            largest = max([r[2] for r in batch] + ([largest] if largest is not None else []), default=None)
        assert sorted(((*x[:3], *x[4:7]) for x in out), key=repr) == sorted(want, key=repr)


def test_nothing_to_apply(frame):
    assert got(sequenced.outcome(sequenced.apply_changes(sequenced.prepared(frame([], SCHEMA)), buckets=2))) == []


def test_a_part_without_batches_still_ends_waiting(frame):
    """One early batch and a late one: the waiting ends at the start of the first empty batch that knows of the late days."""
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [(i, 1, s, "U", day(d), "s", None, "Bel", 1.0, 1, "x", "y", "z") for i, (s, d) in enumerate([(1, 0), (3, 1), (5, 40), (2, 119)], 20)]
    numbered = sequenced.prepared(frame(rows, SCHEMA))
    assert got(sequenced.outcome(sequenced.apply_changes(numbered))) == plain(rows)
