"""Lifecycles from parameters over hand-made tables, and the metrics and sources that they use."""

import pytest
from pyspark.sql import functions as F

from loomcube import config
from loomcube.operators import assoc, hierarchy, kg
from loomcube.plans import lifecycle
from loomcube.sources import readers


def entity_tables(frame):
    return {
        "tree": frame([("R1", "a"), ("R1.1", "b"), ("R2", "c")], "code string, name string"),
        "ontology": frame([("T1", "T2")], "parent string, child string"),
        "annotations": frame([("p1", "T2"), ("p2", "T1"), ("p3", "T9"), ("p9", "T2")], "entity string, term string"),
        "reference": frame([("p1",), ("p2",), ("p3",), ("p4",)], "entity string"),
        "interactions": frame([("p1", "q1", 0.995), ("p1", "q2", 0.5), ("q1", "q3", 0.999)], "src string, dst string, score double"),
        "members": frame([("w", "p1"), ("w", "p2"), ("w", "m1")], "pathway string, entity string"),
        "regulation": frame([("p2", "r1"), ("r2", "zz")], "regulator string, target string"),
    }


def test_expanded_entities_follow_the_flags(frame):
    tables = entity_tables(frame)

    def run(**how):
        out = lifecycle.expand_entities(config.Preprocessing(("x",), (("R1",),), ("T1",), ("p4",), **how), tables)
        return {r["entity"]: r["core"] for r in out["entities"].collect()}, out

    core = dict.fromkeys(("p1", "p2", "p4"), True)
    got, out = run()
    assert got == core and out["triples"].count() == 0
    assert {(r["category"], r["code"]) for r in out["categories"].collect()} == {("x", "R1"), ("x", "R1.1")}
    assert run(include_ppi=True)[0] == core | {"q1": False}
    assert run(include_ppi=True, ppi_hops=2)[0] == core | {"q1": False, "q3": False}
    assert run(include_pathways=True)[0] == core | {"m1": False}
    got, out = run(include_regulators=True)
    assert got == core | {"r1": False} and [tuple(r) for r in out["triples"].collect()] == [("p2", "targets", "r1", 1.0)]
    with pytest.raises(ValueError, match="unknown tree number R7; unknown term T7"):
        lifecycle.expand_entities(config.Preprocessing(("x",), (("R7",),), ("T7",)), tables)


def text_tables(frame):
    docs = [
        (1, 2000, ["t1"], "heart", "valve", "deep valve", "", "valve", ""),
        (2, 1990, ["t1"], "heart", "", "", "", "", ""),
        (3, 2001, [], "On Heart again", "heart attack", "", "", "", ""),
    ]
    return {
        "docs": frame(docs, "doc_id long, year int, terms array<string>, title string, abstract string, full_text string, introduction string, results string, discussion string"),
        "category_terms": frame([("c", "t1")], "category string, term string"),
        "synonyms": frame([("e1", "heart"), ("e2", "valve")], "entity string, synonym string"),
        "core": frame([("e2",)], "entity string"),
        "lexicon": frame([("heart",)], "word string"),
        "category_synonyms": frame([("c", "heart")], "category string, synonym string"),
    }


def test_scores_follow_the_flags(frame):
    tables = text_tables(frame)

    def run(given=tables, **how):
        out = lifecycle.mine_texts(config.TextMining(**{"first_year": 1995, "vary_case": False, **how}), given)
        return {(r["doc_id"], r["synonym"]): r["cnt"] for r in out["counts"].collect()}, out

    assert run()[0] == {(1, "heart"): 1, (1, "valve"): 1}
    assert run(first_year=1980)[0] == {(1, "heart"): 1, (1, "valve"): 1, (2, "heart"): 1}
    assert run(include_full_text=True, sections="full_text")[0][1, "valve"] == 2
    assert run(include_full_text=True)[0][1, "valve"] == 2
    assert run(include_label_imputation=True)[0] == {(1, "heart"): 1, (1, "valve"): 1, (3, "heart"): 1}
    assert run(include_label_imputation=True, vary_case=True)[0][3, "Heart"] == 1
    _, out = run(check_synonyms=True)
    assert [r["synonym"] for r in out["removed"].collect()] == ["heart"]
    assert {r["entity"] for r in out["scores"].collect()} == {"e2"}
    again = frame([(1, "valve", 7)], "doc_id long, synonym string, cnt long")
    _, out = run(tables | {"counts": again}, rerun_scoring=True)
    assert [(r["entity"], r["tf"]) for r in out["core_scores"].collect()] == [("e2", 7)]


def test_merged_entities_are_analysed_once(frame):
    scores = frame([(c, f"e{i}", float(v)) for c in "ab" for i, v in enumerate([1, 1, 1, 1, 4, 5, 6, 7, 20, 20])], "category string, entity string, score double")
    synonyms = [("e0", "s"), ("e1", "s"), ("e2", "t"), ("e8", "u"), ("e9", "u")]
    tables = {
        "scores": scores, "core_scores": scores.filter("entity < 'e5'"), "synonyms": frame(synonyms, "entity string, synonyms string"),
        "core": frame([("e9",), ("e1",)], "entity string"), "members": frame([("w", "e0"), ("w", "e8"), ("v", "e1"), ("v", "e9")], "pathway string, entity string"),
    }
    both = lifecycle.analyse(config.Analysis(z_threshold=0.5, analyze_all_entities=True, thresholds=(0.5,)), tables, 2)
    out = both["all"]
    summary = {r["entity"]: r for r in out["summary"].collect()}
    assert set(summary) == {"e0;e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8;e9"}, "equal scores without equal synonyms are no reason to merge"
    assert summary["e8;e9"]["synonyms"] == "u" and summary["e8;e9"]["categories"] == "a|b" and summary["e0;e1"]["synonyms"] == "s"
    sets = {(r["set_name"], r["entity"]) for r in out["sets"].collect()}
    assert {x for x in sets if x[0].startswith("core")} == {("core|a", "e8;e9"), ("core|b", "e8;e9")}
    assert {(r["pathway"], r["category"]): r["n_scored"] for r in out["means"].collect()} == {(p, c): 2 for p in "wv" for c in "ab"}
    assert {(r["entity"], r["member"]) for r in out["members"].collect() if ";" in r["entity"]} == {("e0;e1", "e0"), ("e0;e1", "e1"), ("e8;e9", "e8"), ("e8;e9", "e9")}
    assert {r["entity"] for r in both["core"]["z"].collect()} == {"e0;e1", "e2", "e3", "e4"}
    assert set(lifecycle.analyse(config.Analysis(z_threshold=0.5), tables, 2)) == {"core"}
    single = lifecycle.analyse(config.Analysis(z_threshold=0.5, merge_entities=False), tables, 2)["core"]
    assert {r["entity"]: r["synonyms"] for r in single["summary"].collect()} == {"e0": "s", "e1": "s", "e2": "t", "e3": None, "e4": None}
    with pytest.raises(ValueError):
        lifecycle.analyse(config.Analysis(analyze_core_entities=False), tables, 2)


def test_what_makes_entities_equal(frame):
    nan, rows = float("nan"), []
    for e, a, b in [("p1", 1.0, None), ("p2", 1.0, nan), ("p4", 1.0, 2.0), ("p5", 0.0, 0.0), ("p6", -0.0, 0.0), ("p7", 1.0, None), ("p8", 1.0, None)]:
        rows += [("a", e, a), ("b", e, b)]
    rows.append(("a", "p3", 1.0))
    lists = [("p1", ["x", "y"]), ("p2", ["y", "x", "y"]), ("p3", ["x", "y"]), ("p4", ["x", "y"]), ("p5", ["z"]), ("p6", ["z"])]
    scores, members = assoc.merge_entities(frame(rows, "category string, entity string, score double"), frame(lists, "entity string, synonyms array<string>"))
    assert {r["entity"] for r in members.collect()} == {"p1;p2;p3", "p4", "p5;p6", "p7", "p8"}
    assert {(r["category"], r["entity"]) for r in scores.collect()} == {(c, e) for c in "ab" for e in ("p1;p2;p3", "p4", "p5;p6", "p7", "p8")}


def test_graph_follows_the_flags(frame):
    tables = {
        "scores": frame([("c", "e", 2.0)], "category string, entity string, score double"), "members": frame([("w", "e")], "pathway string, entity string"),
        "pathway_edges": frame([("R-HSA-1", "R-HSA-2")], "parent string, child string"), "interactions": frame([("e", "f", 0.9)], "src string, dst string, score double"),
        "regulation": frame([("e", "g")], "regulator string, target string"), "tree_edges": frame([("R1", "R1.1")], "parent string, child string"),
        "tree": frame([("R1", "n")], "code string, name string"), "roots": frame([("c", "R1")], "category string, root string"),
    }

    def relations(**how):
        return {r["relation"] for r in lifecycle.build_graph(config.KnowledgeGraph(**how), tables)["edges"].collect()}

    every = {"category_score", "MeSH_hierarchy", "MeSH_is", "MeSH_CVD", "participates_in_pathway", "pathway_hierarchy", "binds_to", "targets"}
    assert relations() == every
    assert relations(include_tree=False) == {r for r in every if not r.startswith("MeSH")}
    assert relations(include_ppi=False, include_regulators=False, include_pathways=False) == {"category_score", "MeSH_hierarchy", "MeSH_is", "MeSH_CVD"}
    nodes = {r["node"]: r["node_type"] for r in lifecycle.build_graph(config.KnowledgeGraph(), tables)["nodes"].collect()}
    assert nodes["c"] == "CVD" and nodes["e"] == "Protein" and nodes["w"] == "Reactome_Pathway"


def test_metrics_of_predictions(frame):
    rows = frame([(0.9, True), (0.8, False), (0.8, True), (0.3, False), (0.1, True)], "predictions double, is_true boolean")
    assert kg.auroc(rows).first()["auroc"] == round((2 + 1.5 + 0) / 6, 9)
    assert kg.auprc(rows).first()["auprc"] == round((1 + 2 / 3 + 3 / 5) / 3, 9)
    m = kg.threshold_metrics(rows, (0.8,)).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["accuracy"], m["precision"], m["f1"]) == (2, 1, 1, 1, 0.6, 0.666666667, 0.666666667)
    one = rows.filter("NOT is_true")
    assert kg.auroc(one).first()["auroc"] is None and kg.auprc(one).first()["auprc"] is None


def test_cycles_are_named(frame):
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.paths_to_root(frame([("a", "b"), ("b", "c"), ("c", "b")], "parent string, child string"))
    loops = frame([("a", "b"), ("x", "y"), ("y", "x"), ("y", "z")], "parent string, child string")
    assert {(r["parent"], r["child"]) for r in hierarchy.prune(loops, None).collect()} == {("a", "b"), ("x", "y"), ("y", "x"), ("y", "z")}


def test_closure_of_a_long_chain(frame):
    n = 37
    edges = frame([(i, i + 1) for i in range(n)] + [(0, 20)], "parent long, child long")
    got = {(r["ancestor"], r["node"]): r["depth"] for r in hierarchy.ancestors(edges).collect()}
    want = {(i, j): j - i for i in range(n + 1) for j in range(i + 1, n + 1)}
    want |= {(0, j): min(j, j - 19) for j in range(20, n + 1)}
    assert got == want


def test_components_of_rows_with_nulls(frame):
    rows = frame([(1, 1.0, 2.0), (2, 2.0, None), (3, 3.0, 6.5), (4, None, 8.0)], "k long, a double, b double")
    assert assoc.components(rows, "k", ["a", "b"]).count() == 4


def test_further_readers(spark, frame, tmp_path):
    def put(name, content):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
        return f"file://{tmp_path / name}"

    assert {tuple(r) for r in readers.read_entity_counts(spark, put("counts", "d1 a|2 b|1 a|3\nd2\n")).collect()} == {("d1", "a", 5), ("d1", "b", 1)}
    folder = put("reg/x.txt", "t\tg1\t1\t2\t3\tHigh\nerror\nt\tg2\t1\t2\t3\tHigh\n").removesuffix("/x.txt")
    put("reg/y.txt", "u\tg3\t1\t2\t3\tHigh\nu\tg4\t1\t2\t3\tLow\n")
    assert {tuple(r) for r in readers.read_regulators(spark, folder).collect()} == {("t", "g1"), ("t", "g2"), ("u", "g3")}
    assert {tuple(r) for r in readers.read_regulators(spark, folder, stop_at_errors=True).collect()} == {("t", "g1"), ("u", "g3")}
    put("maps/a_to_b/x", "1\t2\n")
    loaded = readers.load_resources(spark, f"file://{tmp_path}/maps", ["r"], {"r": ["a_to_b"], "q": ["none"]})
    assert list(loaded) == ["a_to_b"] and [tuple(r) for r in loaded["a_to_b"].collect()] == [("1", "2")]
    with pytest.raises(ValueError, match="unknown resources: z"):
        readers.load_resources(spark, "x", ["z"], {})
    tagged = readers.read_tagged_records(spark, put("tags", "D1\tX\ta; b\nD1\tX\tc\nD2\tY\td\n"), ["X", "Y"])
    assert {tuple(r) for r in readers.cross_references(tagged, "X").collect()} == {("D1", "a"), ("D1", "b"), ("D1", "c")}


def test_storage_needs_a_shared_folder(spark, monkeypatch):
    from loomcube import storage

    assert storage.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    table = storage.materialise(spark.range(3).select(F.col("id")), "test")
    assert table.count() == 3
    storage.discard(table)

    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    monkeypatch.setattr(storage, "on_one_machine", lambda _: False)
    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(Unset)
