import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from loomcube.llm import suffix_dedup


def test_suffix_arrays_and_prefixes():
    r = random.Random(1)
    for _ in range(40):
        x = np.array([r.choice([0, 1, 2]) for _ in range(r.randrange(1, 200))], np.uint8)
        order, rank = suffix_dedup.suffix_array(x)
        b = bytes(x)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        prefix = suffix_dedup.common_prefixes(x, order, rank, np.array([0]), np.array([len(x)]))
        for k in range(1, len(order)):
            i, j, n = order[k], order[k - 1], 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert prefix[order[k]] == n


def plain(docs):
    """``doc_id, n_bytes, n_removed, n_spans, digest`` and the kept bytes of each row."""
    order = sorted(docs, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for d, text in order:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def periodic(n=160):
    r = random.Random(7)
    docs = []
    for d in range(n):
        if d % 4 == 0:
            x = "".join(r.choice("ab") for _ in range(r.randrange(1, 40))) * r.randrange(1, 30)
        elif d % 4 == 1:
            x = "".join(r.choice("abcdé\n") for _ in range(r.randrange(400)))
        elif d % 4 == 2:
            x = "".join(r.choice("xyz") for _ in range(80))
            x = x + x[: r.randrange(80)] + x + r.choice("pq") * r.randrange(200)
        else:
            x = r.choice(docs)[1] or ""
            k = r.randrange(len(x) + 1)
            x = x[k:] + r.choice(["", "Q" * 120, "zz"]) + x[:k]
        docs.append((r.choice([d, d, d, 7, None]), r.choice([x] * 9 + [None])))
    return docs


@pytest.mark.parametrize(("runs", "block"), [(20_000, 2 << 20), (3, 3000)])
def test_like_a_plain_version(frame, monkeypatch, runs, block):
    monkeypatch.setattr(suffix_dedup, "SHARD_RUNS", runs)  # few runs: names are spread over shards and merged
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", block)
    docs = periodic()
    got = suffix_dedup.substring_digests(frame(docs, "doc_id long, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == plain(docs)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    got = suffix_dedup.substring_digests(edge_docs).collect()
    assert Counter(map(tuple, got)) == plain([(d, t) for d, t, *_ in edge_rows])
    assert suffix_dedup.substring_digests(no_docs).count() == 0


def test_repeats_are_cut(frame):
    passage = "".join(f"{i:03d}-" for i in range(60))
    docs = frame([(1, "first " + passage), (2, "second " + passage + " tail"), (3, passage), (4, None), (5, "é" * 49)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(docs).collect()}
    assert got[1] == "first " + passage and got[2] == "second tail"
    assert 3 not in got and got[4] is None and got[5] == "é" * 49


def test_equal_rows_stay_once(spark, frame):
    """Of equal long texts the first row stays, whatever the doc_ids; short rows are left alone."""
    long = "".join(f"{i:03d}-" for i in range(60))
    rows = [(1, long), (1, long), (None, "x" + long[::-1]), (None, "x" + long[::-1]), (7, "x" + long[::-1]), (2, "short"), (2, "short"), (None, None), (None, None)]
    docs = frame([(d, t, "own", 0) for d, t in rows], "doc_id long, text string, tid string, n_chars int")
    got = suffix_dedup.drop_repeats(docs.repartition(3))
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter((d, t, "own", 0) for d, t in [rows[0], rows[2], *rows[5:]])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix")]


def repeated(segments):
    seen, out, place = set(), [], 0
    for s in segments:
        for i in range(len(s) - 99):
            if s[i : i + 100] in seen:
                out.append(place + i)
            seen.add(s[i : i + 100])
        place += len(s) + 1
    return out


def test_periodic_segments_equal_the_plain_version(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LANE", 37)
    r = random.Random(1)
    for _ in range(150):
        segments = []
        for _ in range(r.randrange(1, 5)):
            kind = r.randrange(4)
            if kind == 0:
                s = bytes(r.choice(b"ab") for _ in range(r.randrange(100, 400)))
            elif kind == 1:
                s = (bytes(r.choice(b"abc") for _ in range(r.randrange(1, 80))) * 1500)[: r.randrange(100, 1500)]
            elif kind == 2:
                s = b"a" * r.randrange(100, 900) + bytes(r.choice(b"ab") for _ in range(r.randrange(50))) + b"ab" * r.randrange(60, 900)
            else:
                s = segments[0] if segments else b"x" * 150
            segments.append(s)
        assert suffix_dedup.repeated_windows(segments)[0].tolist() == repeated(segments)


@pytest.mark.parametrize("period", [b"=", b"abc"])
def test_long_periodic_texts_take_linear_time(period):
    text = period * (10_000_000 // len(period))
    began = time.perf_counter()
    assert suffix_dedup.likely([text]).tolist() == [True]
    later, _ = suffix_dedup.repeated_windows([text])
    assert len(later) == len(text) - 99 - len(period)
    assert time.perf_counter() - began < 30, "about 6 seconds on a free core; by single steps it was minutes"
