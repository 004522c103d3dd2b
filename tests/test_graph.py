"""Hierarchies, expansion, mappings and the knowledge graph."""

import hashlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcube.operators import expand, hierarchy, kg, mapping, pair_holdout, shared

EDGES = "parent string, child string"
MAP = "src string, dst string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_closure_with_diamond_and_cycle(frame):
    edges = frame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], EDGES)
    got = rows(hierarchy.ancestors(edges), "ancestor", "node", "depth")
    assert got == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("b", "d", 1), ("b", "e", 2), ("c", "d", 1), ("c", "e", 2), ("d", "e", 1)]
    assert rows(hierarchy.ancestors(frame([("a", "b"), ("b", "a")], EDGES)), "ancestor", "node") == [("a", "b"), ("b", "a")]


def test_prune_prefers_the_larger_subtree(frame):
    edges = frame([("r", "p"), ("r", "q"), ("p", "x"), ("q", "x"), ("p", "p1"), ("p", "p2"), ("p", "p3"), ("q", "q1")], EDGES)
    tree = hierarchy.prune(edges)
    assert ("p", "x") in rows(tree, "parent", "child") and ("q", "x") not in rows(tree, "parent", "child")
    assert all(r["n_in"] <= 1 for r in hierarchy.degrees(tree).collect())
    assert ("Root", "r") in rows(tree, "parent", "child")


def test_paths_and_subgraph(frame):
    tree = frame([("r", "a"), ("a", "b"), ("b", "c"), ("r", "z")], EDGES)
    assert dict(rows(hierarchy.paths_to_root(tree), "node", "path"))["c"] == ["c", "b", "a", "r"]
    sub = hierarchy.ancestor_subgraph(tree, frame([("b",), ("c",)], "node string"))
    assert rows(sub, "parent", "child") == [("a", "b"), ("b", "b_leaf"), ("b", "c"), ("r", "a")]


def test_dendrogram(frame):
    linkage, order = hierarchy.dendrogram(frame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y")], EDGES))
    assert order == ["x", "y", "b"] and [row[3] for row in linkage] == [2, 3]


def test_annotations_below_unannotated_terms(frame):
    edges = frame([("t", "u"), ("u", "v")], EDGES)
    notes = frame([("p", "t"), ("q", "v")], "entity string, term string")
    seeds = frame([("t",)], "term string")
    assert rows(hierarchy.descendant_annotations(seeds, edges, notes), "entity") == [("p",), ("q",)]
    assert rows(hierarchy.descendant_annotations(seeds, edges, notes, True), "entity") == [("p",)]


def test_hops(frame):
    edges = frame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 0.2)], "src string, dst string, score double")
    core = frame([("a",)], "entity string")
    found, walked = expand.interaction_partners(edges, core, 3, 0.5)
    assert rows(found, "entity", "hop") == [("a", 0), ("b", 1), ("c", 2)]
    assert ("b", "c") in rows(walked, "head", "tail")
    _, first = expand.interaction_partners(edges, core, 3, 0.5, all_hops=False)
    assert rows(first, "head", "tail") == [("a", "b")]


def test_pathway_filter_is_or(frame):
    members = frame([("w", f"e{i}") for i in range(10)], "pathway string, entity string")
    core = frame([(f"e{i}",) for i in range(4)], "entity string")
    assert expand.pathway_partners(members, core, 4, 0.5)[0].count() == 6
    assert expand.pathway_partners(members, core, 4, 0.5, "and")[0].count() == 0


def test_all_pathways_add_entities(frame):
    members = frame([("w1", "p1"), ("w1", "p2"), ("w2", "p1"), ("w2", "p3")], "pathway string, entity string")
    added, triples = expand.pathway_partners(members, frame([("p1",)], "entity string"), 1, 0.5)
    assert rows(added, "entity") == [("p2",), ("p3",)] and triples.count() == 4


def test_regulators_go_both_ways(frame):
    pairs = frame([("t", "x"), ("y", "t"), ("u", "v")], "regulator string, target string")
    added, _ = expand.regulator_partners(pairs, frame([("t",)], "entity string"))
    assert rows(added, "entity") == [("x",), ("y",)]


def test_mappings(frame):
    a, b = frame([("1", "x"), ("1", "y"), ("2", "y")], MAP), frame([("x", "A"), ("y", "A")], MAP)
    assert rows(mapping.chain(a, b), "src", "dst") == [("1", "A"), ("2", "A")]
    assert rows(mapping.unambiguous(a), "src", "dst") == [("2", "y")]
    assert rows(mapping.multi_valued(a), "src", "n") == [("1", 2)]
    assert rows(mapping.not_one_to_one(a), "side", "id") == [("dst", "y"), ("src", "1")]
    assert rows(mapping.unmapped(frame([("9",)], "src string"), a), "src") == [("9",)]


def test_node_type_comes_from_the_first_source(frame):
    schema = "head string, relation string, tail string, weight double"
    scores, ppi = frame([("C", "s", "p", 1.0)], schema), frame([("p", "binds_to", "q", 1.0)], schema)
    hierarchy_edges = frame([("p", "h", "w", 1.0)], schema)
    nodes = kg.node_list({"score": scores, "ppi": ppi, "hierarchy": hierarchy_edges}, frame([("C",)], "category string"))
    assert dict(rows(nodes, "node", "node_type")) == {"C": "CVD", "p": "Protein", "q": "Protein", "w": "Reactome_Pathway"}
    assert kg.connected_nodes(nodes, ppi).count() == 2


def test_predictions(frame):
    predictions = frame([(0.95, "a", "b"), (0.97, "c", "d"), (0.1, "e", "f")], "predictions double, sources string, destinations string")
    truth = frame([("b", "r", "a", 1.0)], "head string, relation string, tail string, weight double")
    assert rows(kg.label_predictions(predictions, truth), "sources", "is_true") == [("a", True), ("c", False), ("e", False)]
    known = frame([("a", "r", "b", 1.0)], "head string, relation string, tail string, weight double")
    assert rows(kg.append_predictions(known, predictions), "head", "relation") == [("a", "r"), ("c", "predicted")]
    assert not any(r["is_true"] for r in kg.label_negatives(predictions).collect())


def test_auroc(frame):
    df = frame([(0.9, True), (0.8, False), (0.7, True), (0.7, False), (0.1, False)], "predictions double, is_true boolean")
    assert kg.auroc(df).first()["auroc"] == pytest.approx((3 + 1.5) / 6)
    assert kg.auroc(df.filter("is_true")).first()["auroc"] is None


def test_holdout_leaves_every_node_an_edge(frame):
    edges = frame([(f"n{i}", f"n{(i * 7 + k) % 40}") for i in range(40) for k in (1, 2, 3) if i != (i * 7 + k) % 40], "head string, tail string")
    parts = kg.holdout(edges)
    train = {x for r in parts.filter("part = 'train'").collect() for x in (r["head"], r["tail"])}
    assert parts.filter("part = 'test'").count() > 0 and {f"n{i}" for i in range(40)} <= train
    nodes = frame([(f"n{i}",) for i in range(40)], "node string")
    negatives = set(rows(kg.negative_edges(edges, nodes, 3), "head", "tail"))
    own = {frozenset(r) for r in rows(edges, "head", "tail")}
    assert negatives and not any(frozenset(p) in own for p in negatives)


def test_negatives_of_every_node(frame):
    nodes = frame([(i,) for i in range(500)], "node long").repartition(4)
    pairs = rows(kg.negative_edges(frame([], "head long, tail long"), nodes, 2), "head", "tail")
    heads = [h for h, _ in pairs]
    assert len(pairs) == 1000 and all(heads.count(i) == 2 for i in range(500))


def test_link_pairs(spark, frame, tmp_path):
    from loomcube.plans import assoc_queries

    frame([(i, [1.0, float(i % 5), 2.0], i // 7 % 2) for i in range(90)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = assoc_queries._link_pairs(spark, str(tmp_path)).collect()
    known = [p for p in pairs if p["is_true"]]
    ends = {x for p in known for x in (p["head"], p["tail"])}
    assert ends == {x for p in known if p["part"] == "train" for x in (p["head"], p["tail"])}
    others = {frozenset((p["head"], p["tail"])) for p in pairs if not p["is_true"]}
    assert len(others) > 60 and not others & {frozenset((p["head"], p["tail"])) for p in known}


def test_shared_groups_cut_large_groups_and_busy_members(frame):
    rows = [(g, m) for g in range(9) for m in range(g % 4 * 5)] + [(3, 2), (3, 2), (None, 1), (4, None)] + [(g, 70) for g in range(9)]
    sets = {g: {m for k, m in rows if k == g and m is not None} for g in range(9)}
    right = Counter(pair for ms in sets.values() for pair in combinations(sorted(ms), 2))
    for side, busy in ((1024, 1024), (4, 1024), (4, 3)):
        got = shared.shared_groups(frame(rows, "g long, m long"), "g", "m", side, busy).collect()
        assert {(r["a"], r["b"]): r["n"] for r in got} == right and len(got) == len(right)


def test_holdout_does_not_exchange_edges_by_their_ends(frame):
    edges = frame([(f"a{i}", f"b{j}") for i in range(30) for j in range(3)] + [("b1", "a1"), (None, "a1"), ("b0", "b0")], "head string, tail string")
    parts = kg.holdout(edges, 0.5)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(lo" not in plan and "Exchange hashpartitioning(hi" not in plan
    own = kg.undirected(edges).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", "lo", "hi", F.lit("1"))), 1, 15), 16, 10).cast("long")).collect()
    least = {}
    for r in own:
        for node in (r["lo"], r["hi"]):
            least[node] = min(r["h"], least.get(node, r["h"]))
    test = Counter((r["head"], r["tail"]) for r in own if (r["h"] >> 8) % 1000 < 500 and r["h"] not in (least[r["lo"]], least[r["hi"]]))
    assert test and Counter((r["head"], r["tail"]) for r in parts.filter("part = 'test'").collect()) == test and parts.count() == len(own)


def test_node_types_combine_without_sorting(frame):
    nodes = kg.node_list({"ppi": frame([("a", "b")], "head string, tail string"), "tree": frame([("b", "c")], "head string, tail string")}, frame([("C",)], "category string"))
    assert {tuple(r) for r in nodes.collect()} == {("a", "Protein"), ("b", "MeSH_Tree_Disease"), ("c", "MeSH_Tree_Disease"), ("C", "CVD")}
    assert "SortAggregate" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_ends_of_shared_groups_come_without_their_pairs(frame):
    kinds = {m: "xyz"[m % 3] for m in range(1, 12)}
    rows = [(1, 1), (1, 1), (2, 1), (2, 4), (3, 2), (3, 3), (3, 3), (4, 5), (None, 6), (None, 8), (5, None), (5, 7), (6, 9), (6, 11), (6, None)]
    sets = {g: {m for k, m in rows if k == g and m is not None} for g in range(1, 7)}
    pairs = [p for ms in sets.values() for p in combinations(sorted(ms), 2)]
    given = frame(rows, "g long, m long")
    assert sorted(r["m"] for r in shared.linked_members(given, "g", "m").collect()) == sorted({m for p in pairs for m in p})
    got = shared.linked_kinds(given, "g", "m", frame(list(kinds.items()), "m long, kind string")).collect()
    assert sorted(map(tuple, got)) == sorted({tuple(sorted((kinds[a], kinds[b]))) for a, b in pairs})


def test_types_of_ends_do_not_ask_for_pairs_of_suppliers(spark, monkeypatch):
    from loomcube.plans import assoc_queries

    monkeypatch.setattr(assoc_queries.t, "shared_groups", None)
    for query in ("kg_edge_type_ends", "kg_nodes_dedup", "kg_connected_nodes"):
        assert assoc_queries.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize(("widest", "table", "side", "busy", "task"), [(1 << 31, 1 << 22, 1024, 1024, 1 << 20), (5, 3, 4, 1024, 40), (1 << 31, 3, 4, 3, 40)])
def test_sizes_of_a_holdout_of_shared_groups(frame, monkeypatch, widest, table, side, busy, task):
    monkeypatch.setattr(pair_holdout, "WIDEST", widest)
    monkeypatch.setattr(pair_holdout, "TABLE", table)
    monkeypatch.setattr(pair_holdout, "LANES", 7)
    rows = [(g, m * m * 37) for g in range(9) for m in range(g % 4 * 5)] + [(3, 4), (3, 4), (None, 1), (4, None)] + [(g, 70) for g in range(9)]
    given = frame(rows, "g long, m long")
    pairs = shared.shared_groups(given, "g", "m").select(F.concat(F.lit("S"), "a").alias("head"), F.concat(F.lit("S"), "b").alias("tail"))
    want = dict(rows_of(kg.holdout(pairs).groupBy("part").count()))
    monkeypatch.setattr(shared, "shared_groups", None)
    got = pair_holdout.shared_holdout_sizes(given, "g", "m", "S", 0.3, 1, side, busy, task)
    assert dict(rows_of(got)) == want and len(want) == 2
    assert rows_of(pair_holdout.shared_holdout_sizes(given.filter("g = 0"), "g", "m", "S")) == []


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_digests_of_texts_of_any_length():
    texts = ["", "S1|S2|1", "é|ü|1", *("x" * n for n in (54, 55, 56, 63, 64, 200))] * 3
    assert pair_holdout.digests(pa.array(texts)).tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts]


def test_edge_holdout_makes_no_table_of_pairs(spark, monkeypatch):
    from loomcube.plans import assoc_queries

    monkeypatch.setattr(assoc_queries.t, "shared_groups", None)
    assert dict(rows_of(assoc_queries.QUERIES["edge_holdout"](spark, "/root/testdata/sf0.001")))["train"] > 0


def test_repeated_pairs_go_as_they_gather(monkeypatch):
    monkeypatch.setattr(pair_holdout, "TASK_PAIRS", 2)
    given = [(5, [7, 9]), (5, [9, 70]), (7, [9]), (5, [7, 9]), (7, [9, 70]), (-3, [5])] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array([a]), pa.array([bs])], ["a", "bs"]) for a, bs in given]
    for widest, table in ((1 << 31, 1 << 22), (3, 3)):
        monkeypatch.setattr(pair_holdout, "WIDEST", widest)
        monkeypatch.setattr(pair_holdout, "TABLE", table)
        members, first, second = pair_holdout._pairs(iter(batches))
        assert list(zip(members[first].tolist(), members[second].tolist(), strict=True)) == sorted({(a, b) for a, bs in given for b in bs})
    assert [x.tolist() for x in pair_holdout._pairs(iter([]))] == [[], [], []]
