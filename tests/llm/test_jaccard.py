import random
import re
from collections import Counter

import numpy as np

from loomcube.llm import common, jaccard


def plain(docs):
    """Expected ``doc_id, class_id, copy_of, n_links`` of every row, by comparing all pairs."""
    low = lambda a, b: a if b is None else b if a is None else min(a, b)
    rep = {}
    for d, t in docs:
        rep[t or ""] = low(rep.get(t or ""), d)
    sets = {}
    for t in rep:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        sets[t] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    texts, links, parent = list(rep), Counter(), {t: t for t in rep}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for t in texts:
        least[find(t)] = low(least.get(find(t)), rep[t])
    return Counter((d, least[find(t or "")], rep[t or ""], links[t or ""]) for d, t in docs)


def groups(n=14):
    r = random.Random(4)
    docs = []
    for g in range(n):
        base = [f"g{g}w{r.randrange(50)}" for _ in range(r.choice([3, 5, 40, 90]))]
        for _ in range(r.choice([1, 2, 6, 20])):
            ws = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                ws[r.randrange(len(ws))] = f"x{r.randrange(1000)}"
            docs.append(r.choice([" ", "  "]).join(ws))
    r.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


def test_like_all_pairs(frame):
    docs = groups()
    assert Counter(map(tuple, jaccard.jaccard_join(frame(docs, "doc_id long, text string").repartition(3)).collect())) == plain(docs)


def test_tiles(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_TILE", 4)
    monkeypatch.setattr(jaccard, "VERIFY_TILE", 3)
    docs = groups(8)
    assert Counter(map(tuple, jaccard.jaccard_join(frame(docs, "doc_id long, text string")).collect())) == plain(docs)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    assert Counter(map(tuple, jaccard.jaccard_join(edge_docs).collect())) == plain([(d, t) for d, t, *_ in edge_rows])
    assert jaccard.jaccard_join(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_one_of_each_class_stays(edge_docs, edge_rows):
    kept = jaccard.keep_one(edge_docs)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == edge_docs.columns and len(rows) == len(set(rows))
    assert len(rows) == len({t or '' for _, t in rows})
    assert (6, edge_rows[6][1]) not in rows and (7, edge_rows[7][1]) not in rows and (5, edge_rows[5][1]) in rows


def test_pruning_bounds():
    assert jaccard.least_matches(16) < jaccard.least_matches(96) < 77
    r = np.random.default_rng(0)
    sig = r.integers(0, 1 << 32, (4, 96), dtype=np.uint32)
    sig[1, :80] = sig[0, :80]
    assert jaccard.similar(sig, np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


def test_components(frame):
    edges = frame([(b"a", b"b"), (b"b", b"c"), (b"d", b"e"), *((bytes([200, i]), bytes([200, i + 1])) for i in range(60))], "u binary, v binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in common.components(edges, "test").collect()}
    assert got[b"c"] == b"a" and got[b"e"] == b"d" and len(got) == 66 and all(got[bytes([200, i])] == bytes([200, 0]) for i in range(61))
