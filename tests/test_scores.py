"""Hand-computed cases of the cube, its scores and rankings."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomcube.operators import assoc, cube, rank, score

OBS = "category string, doc_id long, entity string, cnt long"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_single_observation_has_no_popularity(frame):
    r = score.score(frame([("c", 1, "e", 1)], OBS)).first()
    x = 2.2 / (1 + 1.2 * (0.25 + 0.75)) * 1.0
    assert r["pop"] is None and r["score"] is None
    assert r["dist"] == pytest.approx((math.exp(x) - 1) / (1 + math.exp(x)))


def test_absent_cell_counts_in_the_denominator(frame):
    obs = [("a", 1, "e", 3), ("a", 1, "f", 1), ("b", 2, "f", 2)]
    got = {(r["category"], r["entity"]): r for r in score.score(frame(obs, OBS)).collect()}
    assert len(got) == 4
    gone = got["b", "e"]
    assert (gone["tf"], gone["df"], gone["score"]) == (0, 0, 0.0)
    there = got["a", "e"]
    assert there["dist"] == pytest.approx((math.exp(there["ratio"]) - 1) / (1 + math.exp(there["ratio"]) + 1))
    assert there["pop"] == pytest.approx(math.log(4) / math.log(4))


def test_core_scores_use_core_totals(frame):
    obs = frame([("a", 1, "e", 3), ("a", 2, "e", 1), ("a", 1, "f", 5)], OBS)
    core = {r["entity"]: r for r in score.score_core(obs, frame([("e",)], "entity string")).collect()}
    assert set(core) == {"e"} and core["e"]["pop"] == pytest.approx(math.log(5) / math.log(4))


def test_score_is_zero_exactly_where_tf_is(frame):
    obs = frame([("a", i % 5, f"e{i % 7}", i % 3 + 1) for i in range(30)] + [("b", 9, "e1", 4), ("b", 9, "e2", 1)], OBS)
    for r in score.score(obs).collect():
        assert (r["score"] == 0) == (r["tf"] == 0)


def test_shared_synonym_counts_for_both_entities(frame):
    counts = frame([(1, "s", 3)], "doc_id long, synonym string, cnt long")
    pairs = frame([("e1", "s"), ("e2", "s"), ("e2", "s")], "entity string, synonym string")
    assert rows(cube.entity_counts(counts, pairs), "entity", "cnt") == [("e1", 3), ("e2", 3)]
    assert cube.entity_counts(counts, pairs, frame([("s",)], "synonym string")).count() == 0


def test_total_counts_a_document_once(frame):
    counts = frame([(1, "s", 3), (2, "s", 9)], "doc_id long, synonym string, cnt long")
    cats = frame([("a", 1), ("b", 1)], "category string, doc_id long")
    assert rows(cube.synonym_totals(counts, cats), "category", "cnt") == [("TOTAL", 3), ("a", 3), ("b", 3)]


def test_prefix_needs_a_boundary_if_strict(frame):
    nodes = frame([("C1.2",), ("C1.25",), ("C1",)], "code string")
    roots = frame([("x", "C1.2")], "category string, root string")
    assert rows(cube.prefix_assign(nodes, roots), "code") == [("C1.2",)]
    assert rows(cube.prefix_assign(nodes, roots, strict=False), "code") == [("C1.2",), ("C1.25",)]


def test_latest_version_wins(frame):
    docs = frame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "doc_id long, version int, text string")
    assert rows(cube.latest_versions(docs, "doc_id", docs["version"].desc()), "doc_id", "text") == [(1, "new"), (2, "only")]


def test_rank_breaks_ties_by_name(frame):
    df = frame([("a", "y", 1.0), ("a", "x", 1.0), ("a", "z", 2.0)], "category string, entity string, score double")
    assert rows(rank.ranked(df, "category", "score", "entity"), "position", "entity") == [(1, "z"), (2, "x"), (3, "y")]


def test_z_score_is_null_with_six_values(frame):
    few = frame([("c", f"e{i}", float(i + 1)) for i in range(6)], "category string, entity string, score double")
    assert all(r["z"] is None for r in assoc.z_scores(few).collect())
    more = frame([("c", f"e{i}", float(i + 1)) for i in range(8)] + [("c", "none", 0.0)], "category string, entity string, score double")
    z = {r["entity"]: r["z"] for r in assoc.z_scores(more).collect()}
    deviation = math.sqrt(sum((i - 4.5) ** 2 for i in range(1, 9)) / 2)
    assert z["none"] is None and z["e7"] == pytest.approx((8 - 4.5) / deviation)


def test_exact_sets(frame):
    z = frame([("x", "A", 4.0), ("y", "A", 4.0), ("x", "B", 5.0), ("y", "B", None), ("y", "C", 1.0)], "category string, entity string, z double")
    sets = assoc.significant_sets(z, 3.0)
    assert rows(assoc.only_in_one(sets), "category", "entity") == [("x", "B")]
    assert rows(assoc.set_sizes(sets), "categories", "n_entities") == [("x", 1), ("x|y", 1)]
    assert rows(assoc.in_all(z, 2), "entity") == [("A",)]


def test_equal_rows_merge_their_ids(frame):
    df = frame([("b", 1.0, None), ("a", 1.0, None), ("c", 2.0, None)], "entity string, x double, y double")
    assert rows(assoc.merge_redundant(df, "entity", ["x", "y"]), "entity") == [("a;b",), ("c",)]


def test_enrichment_is_the_hypergeometric_tail(frame):
    members = frame([("p", f"e{i}") for i in range(4)] + [("q", f"e{i}") for i in range(4, 10)], "pathway string, entity string")
    sets = frame([("s", "e0;e1"), ("s", "e2"), ("s", "elsewhere")], "set_name string, entity string")
    got = {r["pathway"]: r["p_value"] for r in assoc.enrichment(members, sets).collect()}
    assert got == {"p": pytest.approx(math.comb(4, 3) / math.comb(10, 3))}


def test_empty_tables(frame):
    assert score.score(frame([], OBS)).count() == 0
    assert assoc.z_scores(frame([], "category string, entity string, score double")).count() == 0


def test_pca_of_whole_vectors(spark, frame, tmp_path):
    import numpy as np

    from loomcube.plans import assoc_queries

    r = np.random.default_rng(3)
    x = r.normal(size=(40, 12)) + np.outer(r.normal(size=40), np.arange(12)) + np.outer(r.normal(size=40), np.arange(12)[::-1] / 3)
    frame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = np.array([(o["pc1"], o["pc2"]) for o in assoc_queries.QUERIES["pca_scores"](spark, str(tmp_path)).orderBy("vec_id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    loadings = np.linalg.svd(z)[2][:2]
    loadings *= np.sign([v[np.argmax(np.abs(v))] for v in loadings])[:, None]
    assert np.allclose(got, z @ loadings.T)


def test_positions_split_a_group_over_partitions(frame):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.choice([None, *range(300)]), i) for i in range(3000)]
    df = frame(rows, "g string, v int, `i.d` int").repartition(5)
    got = rank.positions(df, "g", [F.desc_nulls_last("v"), F.col("`i.d`")], "at").collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for g, v, i in rows:
        want[g].append((v is None, -(v or 0), i))
    want = {(g, x[2]): k for g, xs in want.items() for k, x in enumerate(sorted(xs), 1)}
    assert {(x["g"], x["i.d"]): x["at"] for x in got} == want
    plan = rank.positions(df, "g", [F.col("v"), F.col("`i.d`")])
    tasks = [x["n"] for x in spark_partitions(plan)]
    assert max(tasks) < 0.6 * len(rows)
    same = frame([("g", 1)] * 1000, "g string, v int").repartition(4)
    assert sorted(x["position"] for x in rank.positions(same, "g", [F.col("v")]).collect()) == list(range(1, 1001))
    assert rank.positions(same.limit(0), "g", [F.col("v")]).count() == 0


def spark_partitions(ranked):
    """Rows of each file that the ranking has written, which is what a task sorts."""
    files = ranked.inputFiles()
    return ranked.sparkSession.read.parquet(*files).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
