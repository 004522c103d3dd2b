"""Holdouts, products, spectra and embeddings of graphs against plain numpy versions."""

import hashlib
import math
import random
import struct
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomcube.operators import embed, forest, links, products, spectral
from loomcube.plans import model_queries


def kruskal(edges, seed):
    def weight(e):
        return int(hashlib.md5(f"{e[0]}|{e[1]}|{seed}".encode()).hexdigest()[:15], 16), *e

    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    kept = set()
    for a, b in sorted({(min(e), max(e)) for e in edges}, key=weight):
        ra, rb = root(a), root(b)
        if ra != rb:
            above[max(ra, rb)] = min(ra, rb)
            kept.add((a, b))
    return kept, {x: root(x) for x in above}


@pytest.fixture(scope="module")
def some_edges():
    r = random.Random(7)
    out = [("hub", f"n{i:03d}") for i in range(150)]
    out += [(f"n{r.randrange(200):03d}", f"n{r.randrange(200):03d}") for _ in range(250)]
    out += [(f"m{i}", f"m{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    return out + out[:20]


def test_spanning_forest_is_that_of_kruskal(frame, some_edges):
    rows = [*some_edges, (None, "a"), ("a", None)]
    got, labels = forest.spanning_forest(frame(rows, "head string, tail string").repartition(3), seed=3)
    kept, roots = kruskal(some_edges, 3)
    assert {(r["lo"], r["hi"]) for r in got.collect()} == kept
    assert {r["node"]: r["root"] for r in labels.collect()} == roots
    nothing, none = forest.spanning_forest(frame([], "head string, tail string"))
    assert nothing.count() == none.count() == 0


def test_holdout_keeps_the_components(frame, some_edges):
    held = forest.connected_holdout(frame([(*e, 1.0) for e in some_edges], "head string, tail string, `w.t` double"), 0.2, seed=3)
    rows = [tuple(r) for r in held.collect()]
    assert sorted(r[:2] for r in rows) == sorted(some_edges)
    parts = {}
    for a, b, _, part in rows:
        assert parts.setdefault((min(a, b), max(a, b)), part) == part
    train = [e for e, p in parts.items() if p == "train"]
    assert kruskal(train, 3) == kruskal(some_edges, 3)
    different = sum(a != b for a, b in parts)
    assert 0.15 * different < len(parts) - len(train) < 0.25 * different
    tree = forest.connected_holdout(frame([("a", "b"), ("b", "c")], "head string, tail string"))
    assert {r["part"] for r in tree.collect()} == {"train"}


def test_components_are_those_of_the_forest_in_few_rounds_of_numbers(frame, some_edges, monkeypatch):
    rows = [*some_edges, (None, "a"), ("a", None), *((f"p{i:05d}", f"p{i + 1:05d}") for i in range(300))]
    edges = frame(rows, "head string, tail string").repartition(3)
    live, keep = [], forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, tag: live.append((tag, dict(df.dtypes))) or keep(df, tag))
    _, roots = kruskal([e for e in rows if None not in e], 3)
    assert {r["node"]: r["root"] for r in forest.components(edges).collect()} == roots
    rounds = [types for tag, types in live if tag == "forest-picks"]
    assert 0 < len(rounds) <= 9, "components at least halve"
    assert all(set(types.values()) == {"bigint"} for types in rounds), "rounds exchange numbers"
    assert forest.components(frame([], "head string, tail string")).count() == 0


def test_equal_numbers_of_nodes_take_the_next_seed(frame, some_edges, monkeypatch):
    own, asked = forest.node_number, []
    monkeypatch.setattr(forest, "node_number", lambda node, seed: asked.append(seed) or (own(node, seed) if seed else forest.F.pmod(own(node, seed), forest.F.lit(8))))
    got, labels = forest.spanning_forest(frame(some_edges, "head string, tail string"), seed=3)
    kept, roots = kruskal(some_edges, 3)
    assert {(r["lo"], r["hi"]) for r in got.collect()} == kept and {r["node"]: r["root"] for r in labels.collect()} == roots
    assert {0, 1} <= set(asked)


def plain_products(heads, tails, k, known):
    out = []
    norm = {t: math.sqrt(sum(v * v for v in x)) for t, x in tails}
    for h, a in heads:
        own = [(-round(float(np.dot(a, x)), 9), -norm[t], t) for t, x in tails if (h, t) not in known]
        out += [(h, t, -s + 0.0, i) for i, (s, _, t) in enumerate(sorted(own)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("skew", [0, 3])
def test_products_equal_all_pairs(frame, monkeypatch, skew):
    monkeypatch.setattr(products, "HEADS", 16)
    monkeypatch.setattr(products, "TAILS", 16)
    g = np.random.default_rng(skew)
    heads = [(f"h{i}", g.normal(size=6).tolist()) for i in range(40)]
    tails = [(f"t{i:03d}", (g.normal(size=6) * math.exp(-skew * i / 60)).tolist()) for i in range(300)]
    tails += [("u1", tails[0][1]), ("u2", tails[0][1]), ("zero", [0.0] * 6)]
    known = {(h, f"t{i:03d}") for h, _ in heads[:20] for i in range(0, 300, 3)}
    schema = "node string, x array<double>"
    got, compared = products.top_products(frame(heads, schema), frame(tails, schema), 5, frame(sorted(known), "head string, tail string"))
    want = plain_products(heads, tails, 5, known)
    rows = sorted((r["head"], r["tail"], r["score"], r["position"]) for r in got.collect())
    assert [(h, t, p) for h, t, _, p in rows] == [(h, t, p) for h, t, _, p in want]
    assert [s for *_, s, _ in rows] == pytest.approx([s for *_, s, _ in want], abs=2e-9)
    pairs = sum(r["pairs"] for r in compared.collect())
    assert pairs <= 40 * 303 and (not skew or pairs < 0.5 * 40 * 303), "falling norms end the scan"


def test_products_of_few_or_no_vectors(frame):
    schema = "node long, x array<float>"
    one = frame([(1, [1.0, 2.0]), (2, None)], schema)
    got, _ = products.top_products(one, frame([(7, [1.0, 1.0]), (8, [-1.0, 0.0])], schema), 5)
    assert [tuple(r) for r in got.orderBy("position").collect()] == [(1, 7, 3.0, 1), (1, 8, -1.0, 2)]
    assert products.top_products(one, frame([], schema), 5)[0].count() == 0
    assert products.top_products(frame([], schema), one, 5)[0].count() == 0


def plain_distmult(edges, dim, epochs, negatives, rate, seed, block):
    """The same training with one vector a dictionary entry and one edge a time within a batch."""
    nodes = sorted({e for h, _, t in edges for e in (h, t)}, key=lambda v: (hashlib.md5(f"{seed}|{v}".encode()).hexdigest(), v))
    number, rels = {v: i for i, v in enumerate(nodes)}, {r: i for i, r in enumerate(sorted({r for _, r, _ in edges}))}
    x = dict(enumerate(embed.start_vectors(np.arange(len(nodes)), dim, seed)))
    rel = dict(enumerate(embed.start_vectors(np.arange(len(rels)), dim, seed + 1)))
    gx, gr = dict.fromkeys(x, 0.0), dict.fromkeys(rel, 0.0)
    blocks = -(-len(nodes) // block)
    losses = []

    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    for epoch in range(epochs):
        total = 0.0
        for r in range(blocks):
            new_rel = []
            for pair in sorted({min(i, (r - i) % blocks) for i in range(blocks)}):
                other = (r - pair) % blocks
                mine, gm, seen = {k: v.copy() for k, v in rel.items()}, dict(gr), dict.fromkeys(rel, 0)
                rows = [(number[h], rels[q], number[t]) for h, q, t in edges if {number[h] // block, number[t] // block} in ({pair, other},)]
                salted = sorted((spark_hash(*e, epoch), *e) for e in rows)
                for at in range(0, len(salted), embed.BATCH):
                    dx, dr = defaultdict(lambda: np.zeros(dim)), defaultdict(lambda: np.zeros(dim))
                    for salt, h, q, t in salted[at : at + embed.BATCH]:
                        seen[q] += 1
                        cases = [(h, t, True)]
                        for side, own in ((0, t), (1, h)):
                            low, size = own // block * block, min(block, len(nodes) - own // block * block)
                            for k in range(1, negatives + 1):
                                z = int(embed.mixed(np.array([(salt + k * (2 + side)) % 2**64], np.uint64))[0])
                                cases.append((h, low + z % size, False) if side == 0 else (low + z % size, t, False))
                        for a, b, true in cases:
                            s = float(np.sum(x[a] * mine[q] * x[b]))
                            total += math.log1p(math.exp(-s if true else s))
                            c = sigmoid(s) - true
                            dx[a] += c * mine[q] * x[b]
                            dx[b] += c * mine[q] * x[a]
                            dr[q] += c * x[a] * x[b]
                    for own, g, d in ((x, gx, dx), (mine, gm, dr)):
                        for k, v in d.items():
                            g[k] += float(np.mean(v**2))
                            own[k] = own[k] - rate * v / math.sqrt(g[k] + 1e-12)
                new_rel.append((mine, gm, seen))
            for q in rel:
                w = [s[q] + 1e-9 for _, _, s in new_rel]
                rel[q] = sum(m[q] * v for (m, _, _), v in zip(new_rel, w)) / sum(w)
                gr[q] = sum(g[q] * v for (_, g, _), v in zip(new_rel, w)) / sum(w)
        losses.append(total)
    return {v: x[i] for v, i in number.items()}, {q: rel[i] for q, i in rels.items()}, losses


def spark_hash(*values):
    """xxhash64 of three longs and an int, as Spark chains it."""
    h = 42
    for v in values[:-1]:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    h = xxhash.xxh64(struct.pack("<i", values[-1]), seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.fixture(scope="module")
def typed_edges():
    """Nodes of two kinds in groups that like each other, under two relations."""
    r = random.Random(4)
    out = {(f"a{i}", rel, f"b{j}") for rel, shift in (("likes", 0), ("owns", 1)) for i in range(24) for j in range(24) if (i + shift) % 3 == j % 3 and r.random() < 0.7}
    return sorted(out)


def test_training_equals_the_plain_version(frame, typed_edges, monkeypatch):
    monkeypatch.setattr(embed, "BATCH", 64)
    rows = [*typed_edges, ("a1", None, "b1"), (None, "likes", "b1")]
    how = {"dim": 6, "epochs": 2, "negatives": 2, "rate": 0.1, "seed": 5, "block": 20}
    nodes, relations, loss = embed.distmult(frame(rows, "head string, relation string, tail string").repartition(3), **how)
    x, rel, losses = plain_distmult(typed_edges, *how.values())
    got = {r["node"]: r["x"] for r in nodes.collect()}
    assert got.keys() == x.keys()
    assert all(got[v] == pytest.approx(x[v].tolist(), abs=1e-9) for v in x)
    assert all(r["x"] == pytest.approx(rel[r["relation"]].tolist(), abs=1e-9) for r in relations.collect())
    assert [r["loss"] for r in loss.orderBy("epoch").collect()] == pytest.approx(losses)
    tails = frame([(v,) for v in x if v.startswith("b")], "node string")
    ranks = {tuple(r)[:3]: r["rank"] for r in embed.tail_ranks(frame(typed_edges[:60], "head string, relation string, tail string"), nodes, relations, tails).collect()}
    for h, q, t in typed_edges[:60]:
        scores = {v: round(float(np.sum(x[h] * rel[q] * x[v])), 9) for v in x if v.startswith("b")}
        assert ranks[h, q, t] == 1 + sum(s > scores[t] for s in scores.values())


def test_rounds_and_products_read_blocks_without_an_exchange(frame, typed_edges, monkeypatch):
    seen, keep = [], embed.materialise

    def noted(df, tag, *by):
        if tag == "trained":
            seen.append((df.rdd.getNumPartitions(), "Exchange" in df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, tag, *by)

    monkeypatch.setattr(embed, "materialise", noted)
    edges = frame(typed_edges, "head string, relation string, tail string").repartition(3)
    of = embed.train(edges, dim=6, epochs=1, block=10)
    assert of.blocks == 5 and seen == [(3, False)] * 5, "a task a pair of blocks, nothing is exchanged"
    x = {r["node"]: r["x"] for r in embed.distmult(edges, dim=6, epochs=1, block=10)[0].collect()}
    pairs = [(h, t, True, "train") for h, _, t in typed_edges[:90]] + [(t, h, False, "test") for h, _, t in typed_edges[50:99]] + [("a0", "a0", False, "test")] * 2
    got = embed.products(frame([*pairs, ("a0", "none", False, "test"), (None, "a0", True, "train")], "head string, tail string, is_true boolean, part string").repartition(3), of, 6)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() == 15
    want = sorted((part, true, [a * b for a, b in zip(x[h], x[t])]) for h, t, true, part in pairs)
    assert sorted((r["part"], r["is_true"], r["x"]) for r in got.collect()) == want
    one = embed.products(frame(pairs, "head string, tail string, is_true boolean, part string"), embed.train(edges, dim=6, epochs=1), 6)
    assert one.rdd.getNumPartitions() == embed.TASKS and one.count() == len(pairs)


def test_trade_has_a_row_an_item_and_kind(spark, frame, tmp_path):
    lines = [(1, 7), (1, 7), (2, 7), (1, 8), (1, 9), (None, 7), (1, None), (3, 10)]
    items = [(7, "toys"), (7, "toys"), (8, None), (8, "other"), (9, "home"), (9, "toys"), (None, "home")]
    frame(lines, "vendor_id long, item_id long").write.parquet(f"{tmp_path}/sale_lines.parquet")
    frame(items, "item_id long, kind string").write.parquet(f"{tmp_path}/items.parquet")
    got = model_queries._trade(spark, str(tmp_path))
    want = [("V1", "home", "I9"), ("V1", "other", "I8"), ("V1", "toys", "I7"), ("V1", "toys", "I9"), ("V2", "toys", "I7"), ("V3", "other", "I10")]
    assert sorted(tuple(r) for r in got.select("head", "relation", "tail").collect()) == want


def test_a_batch_touches_the_rows_of_its_nodes_only():
    n, d = 400_000, 16
    g = np.random.default_rng(2)
    model = embed.Model(np.arange(n), g.normal(size=(n, d)), np.zeros(n), np.arange(3), g.normal(size=(3, d)), np.zeros(3), n // 2, 0.1, 4)
    before, (head, tail, salt) = model.x.copy(), g.integers(0, n, (3, 512))
    tracemalloc.start()
    model.step(head, salt % 3, tail, salt)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * d * 8 / 2, "a step of 512 edges makes no array of the size of the blocks"
    moved = set(np.flatnonzero((model.x != before).any(1)))
    assert {*head, *tail} <= moved and len(moved) <= 512 * 10


def test_rounds_do_not_grow_with_the_nodes():
    assert embed.block_size(12_600, 16) == embed.block_size(400_000, 16) == 50_000
    for n in (800_000, 4_536_000, 6_000_000):
        assert -(-n // embed.block_size(n, 16)) <= embed.BLOCKS
    assert embed.block_size(10**9, 16) * 16 * 8 <= embed.BLOCK_BYTES


def test_ranks_over_many_tiles_score_a_head_and_relation_once(frame, monkeypatch):
    monkeypatch.setattr(embed, "QUERIES", 32)
    monkeypatch.setattr(embed, "TAILS", 16)
    g = np.random.default_rng(9)
    x, rel = {f"n{i}": g.normal(size=4) for i in range(60)}, {"p": g.normal(size=4), "q": g.normal(size=4)}
    queries = [(f"n{i}", r, f"n{j}") for i in range(4) for r in rel for j in range(20, 60, 2)]
    nodes = frame([(v, a.tolist()) for v, a in x.items()], "node string, x array<double>")
    relations = frame([(v, a.tolist()) for v, a in rel.items()], "relation string, x array<double>")
    schema = "head string, relation string, tail string"
    got = embed.tail_ranks(frame([*queries, ("none", "p", "n1")], schema), nodes, relations, frame([(v,) for v in x], "node string"))
    want = {(h, r, t): 1 + sum(round(float(np.sum(x[h] * rel[r] * v)), 9) > round(float(np.sum(x[h] * rel[r] * x[t])), 9) for v in x.values()) for h, r, t in queries}
    assert {tuple(row)[:3]: row["rank"] for row in got.collect()} == want
    scored, repeated = [], np.repeat(g.normal(size=(3, 4)), 40, 0)
    monkeypatch.setattr(embed.np, "round", lambda a, n, keep=np.round: scored.append(a.shape) or keep(a, n))
    tile = {"kind": [0] * 120 + [1] * 50, "id": range(170), "x": [*repeated.tolist(), *g.normal(size=(50, 4)).tolist()], "score": [0.0] * 170}
    embed._greater(pa.table(tile))
    assert scored == [(3, 50)]


def test_training_finds_groups(frame, typed_edges, monkeypatch):
    monkeypatch.setattr(embed, "BATCH", 16)
    r = random.Random(1)
    test = set(r.sample(typed_edges, 60))
    schema = "head string, relation string, tail string"
    nodes, relations, loss = embed.distmult(frame([e for e in typed_edges if e not in test], schema), dim=8, epochs=10, rate=0.3)
    tails = frame([(f"b{j}",) for j in range(24)], "node string")
    ranks = [x["rank"] for x in embed.tail_ranks(frame(sorted(test), schema), nodes, relations, tails).collect()]
    assert sum(ranks) / len(ranks) < 8, "by chance it would be 12.5"
    falling = [x["loss"] for x in loss.orderBy("epoch").collect()]
    assert falling[-1] < 0.7 * falling[0]


def matrix_of(rows, kind):
    nodes = sorted({e for a, b, _ in rows for e in (a, b)})
    at, m = {v: i for i, v in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for a, b, w in rows:
        m[at[a], at[b]] += w
        if a != b:
            m[at[b], at[a]] += w
    return nodes, (np.diag(m.sum(1)) - m if kind == "laplacian" else m)


@pytest.mark.parametrize("kind", ["adjacency", "laplacian"])
def test_spectrum_equals_numpy(frame, kind):
    r = random.Random(3)
    rows = [(f"n{a}", f"n{b}", float(r.choice([1, 2, 5]))) for a in range(40) for b in range(40) if r.random() < (0.6 if a % 4 == b % 4 else 0.04)]
    rows += [("n1", "n1", 3.0), rows[0]]
    nodes, m = matrix_of(rows, kind)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:3]
    got, found = spectral.spectrum(frame([*rows, (None, "n1", 1.0)], "head string, tail string, weight double"), 3, kind)
    assert found == pytest.approx(values[order].tolist(), rel=1e-6)
    x = {r["node"]: r["x"] for r in got.collect()}
    assert sorted(x) == nodes
    own = np.array([x[v] for v in nodes])
    for k, j in enumerate(order):
        v = vectors[:, j]
        v = v * np.sign(v[min(range(len(v)), key=lambda i: (-round(abs(v[i]), 9), nodes[i]))])
        assert own[:, k] == pytest.approx(v, abs=2e-4)


def test_few_rounds_do_not_mix_values_of_both_signs(frame):
    r = random.Random(5)
    rows = [(f"a{a}", f"b{b}", 1.0) for a in range(20) for b in range(20) if r.random() < (0.8 if a % 2 == b % 2 else 0.1)]
    got, values = spectral.spectrum(frame(rows, "head string, tail string, weight double"), 2, rounds=3, tol=0.0)
    nodes, m = matrix_of(rows, "adjacency")
    x = {r["node"]: r["x"] for r in got.collect()}
    own = np.array([x[v] for v in nodes])
    assert values[0] * values[1] < 0
    assert own.T @ m @ own == pytest.approx(np.diag(values), abs=1e-6), "vectors belong to the values"


def test_rounds_of_a_spectrum_share_their_code(frame):
    table = frame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "node string, y0 double, y1 double")
    plans = [spectral._mixed(table, ["y0", "y1"], np.array([[k, 0.0], [1.0, k]]), ["v0", "v1"]) for k in (0.25, 0.75)]
    assert [tuple(r) for r in plans[0].collect()] == [("a", 2.25, 0.5), ("b", 4.75, 1.0)]
    assert not any("0.75" in p._jdf.queryExecution().toString() for p in plans), "weights are no literals"


def test_spectrum_of_small_graphs(frame):
    schema = "head string, tail string, weight double"
    got, values = spectral.spectrum(frame([("a", "b", 2.0)], schema), 5)
    assert sorted(values) == pytest.approx([-2, 2]) and {len(r["x"]) for r in got.collect()} == {2}
    assert spectral.spectrum(frame([], schema), 5)[1] == []


def test_grid_has_a_row_a_configuration(frame, typed_edges, monkeypatch):
    monkeypatch.setattr(embed, "BATCH", 16)
    edges = frame(sorted({(h, t) for h, _, t in typed_edges if int(h[1:]) % 3 == int(t[1:]) % 3}), "head string, tail string")
    rows = {(r["embedding"], r["model"]): r for r in links.grid(edges, ("adjacency", "distmult"), folds=1, d=6).collect()}
    assert set(rows) == {(e, m) for e in ("adjacency", "distmult") for m in links.MODELS}
    assert rows["adjacency", "perceptron"]["auroc"] > 0.7, "negatives within a group cannot be told from edges"
    train, pairs = links.labelled_pairs(edges)
    for r in links.edge_features(pairs, links.EMBEDDINGS["adjacency"](train, 6, 1)).collect():
        same = int(r["head"][1:]) % 3 == int(r["tail"][1:]) % 3
        assert r["similarity"] > 0.99 if same else abs(r["similarity"]) < 0.1, "three groups are three pairs of leading eigenvectors"
    every = {(r["head"], r["tail"]): (r["is_true"], r["part"]) for r in pairs.collect()}
    known = {tuple(r) for r in edges.collect()}
    assert {p for p, (true, _) in every.items() if true} == known
    assert all(h.startswith("a") and t.startswith("b") for h, t in every)
    assert {tuple(r) for r in train.collect()} == {p for p, (true, part) in every.items() if true and part == "train"}
