"""Prefix tries against a version that walks every conversation on the driver."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomcube.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, position long, words string, `a.b` string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}:{text}"), len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = convs.get(first, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(t[0] for t in ts[:d])].append((c, ts[d - 1][1] if d else 0, len(ts) == d))
    out = []
    for path, ms in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * members[p][0][1] for p in below)
        parent = min(c for c, *_ in members[path[:-1]]) if path else None
        done = ",".join(str(c) for c in sorted(c for c, _, end in ms if end))
        out.append((min(c for c, *_ in ms), len(path), parent, len(ms), len(children), len(leaves), saved, sha(done)))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for c in [*range(-45, 70), 10**12, 10**12 + 1]:
        for t in range(r.randrange(1, 6)):
            out.append((c, t, r.choice(["user", "assistant"]), r.choice(["yes", "no", "one two", ""])))
    out += [(3, None, "user", "null first"), (3, None, None, None), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (5, 1, "user", "yes"), (5, 1, "user", "yes")]
    out += [(None, 0, "user", "nobody"), (200, 0, "user", "word " * 50_000), (201, 0, "us", "er: x"), (202, 0, "use", "r: x"), (220, 0, None, "é\x00☃ 　 z")]
    r.shuffle(out)
    return [(*x, "x", "y", 7, "z", "w") for x in out]


def test_trie_equals_the_plain_version(frame, rows):
    want = plain(rows)
    assert got(prefix_trie.conversation_trie(frame(rows, SCHEMA).repartition(5))) == want
    assert len({(n[0], n[1]) for n in want}) == len(want)


def test_many_ids_end_at_one_node(frame, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(c, 0, "user", "the same", *"xy", 1, *"zw") for c in range(-90, 400)]
    assert got(prefix_trie.conversation_trie(frame(rows, SCHEMA).repartition(4))) == plain(rows)


def test_no_conversations(frame):
    assert got(prefix_trie.conversation_trie(frame([], SCHEMA))) == []
    assert got(prefix_trie.conversation_trie(frame([(None, 1, "user", "x", *"xy", 1, *"zw")], SCHEMA))) == []
