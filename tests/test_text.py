"""Text functions, screening and imputation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomcube.functions import text as x
from loomcube.operators import impute


def one(frame, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return frame([values], schema).select(column.alias("r")).first()["r"]


def c(i=0):
    return F.col(f"c{i}")


def test_substrings_do_not_overlap(frame):
    assert one(frame, x.count_substring(c(0), c(1)), "aaaa", "aa") == 2
    assert one(frame, x.count_substring(c(0), c(1)), "abc", "") == 0


def test_hyphens(frame):
    given = "alpha-beta end- x -y z-"
    assert one(frame, x.normalise_hyphens(c()), given) == "alpha beta end- x  y z"
    assert one(frame, x.normalise_synonym(c()), given) == "alpha beta end- x  y z-"


def test_hyphens_like_a_plain_version(frame):
    r = random.Random(4)
    texts = ["".join(r.choice("a- ") for _ in range(r.randrange(12))) for _ in range(300)]
    got = frame([(t,) for t in texts], "c0 string").select("c0", x.normalise_hyphens(c()).alias("r")).collect()
    assert all(g["r"] == re.sub("-(?! )", " ", g["c0"]).strip(" ") for g in got)


def test_case_variants(frame):
    assert sorted(one(frame, x.case_variants(c()), "Fake PrO name")) == ["Fake PrO Name", "Fake PrO name", "fake PrO Name", "fake PrO name"]
    assert sorted(one(frame, x.case_variants(c()), "beta-gamma/delta")) == sorted(f"{a}-{b}/{d}" for a in ("beta", "Beta") for b in ("gamma", "Gamma") for d in ("delta", "Delta"))
    assert one(frame, x.case_variants(c()), "A1 B") == ["A1 B"]


def test_names_of_many_words(frame):
    name = "a-b " + " ".join(["word", "other"] * 6)
    rows = x.vary_case(frame([(1, name), (2, "A1"), (3, "")], "k int, name string"), "name").collect()
    got = {k: sorted(r["variant"] for r in rows if r["k"] == k) for k in (1, 2, 3)}
    assert len(got[1]) == 4096 * 4 == len(set(got[1])) and got[2] == ["A1"] and got[3] == [""]
    assert got[1] == sorted(one(frame, x.case_variants(c()), name))


def test_species(frame):
    assert one(frame, x.without_species(c()), "ABC1 human") == "ABC1"
    assert one(frame, x.without_species(c()), "a b human") is None


def test_comma_permutations(frame):
    assert one(frame, x.comma_permutations(c()), "Failure, Heart") == ["Failure Heart", "Heart Failure"]
    assert len(one(frame, x.comma_permutations(c()), "a, b, c")) == 6
    rows = x.permute_commas(frame([("a, b, c, d, e, f",), ("x",), ("y, y",)], "term string"), "term").collect()
    assert len(rows) == 722 and sorted(r["permutation"] for r in rows if r["term"] == "a, b, c, d, e, f") == one(frame, x.comma_permutations(c()), "a, b, c, d, e, f")


def test_short_synonyms(frame):
    got = [one(frame, x.is_short(c()), s) for s in ("AB", "A1B", "ABC", "A B")]
    assert got == [True, False, True, False]


def test_screening(frame):
    synonyms = frame([("cat",), ("cats",), ("catsx",), ("CAT",), ("ab",), ("heart failure",)], "synonym string")
    got = {r["synonym"]: r["reason"] for r in x.screen_synonyms(synonyms, frame([("cat",)], "word string")).collect()}
    assert got == {"cat": "english", "catsx": "english", "CAT": "short", "ab": "short"}


def test_counting_finds_every_occurrence(frame, monkeypatch):
    r = random.Random(2)
    words = ["alpha", "beta-gamma", "de", "x1", "tion", "ation", "étude"]
    docs = [(i, " ".join(r.choice([*words, "nation", "filler", "gamma"]) for _ in range(30))) for i in range(40)]
    docs += [(90, None), (91, "")]
    got = {(g["doc_id"], g["synonym"]): g["cnt"] for g in x.count_synonyms(frame(docs, "doc_id long, text string"), frame([(w,) for w in words], "synonym string")).collect()}
    want = {}
    for d, t in docs:
        t = re.sub("-(?! )", " ", t or "").strip(" ")
        for w in words:
            s = re.sub("-(?! )", " ", w + " ").strip(" ")
            if n := t.count(s):
                want[d, s] = n
    assert got == want
    monkeypatch.setattr(x, "LISTED_SYNONYMS", 0)
    assert {(g["doc_id"], g["synonym"]): g["cnt"] for g in x.count_synonyms(frame(docs, "doc_id long, text string"), frame([(w,) for w in words], "synonym string")).collect()} == want


@pytest.mark.parametrize("listed", [200, 0])
def test_counting_by_fields(frame, monkeypatch, listed):
    monkeypatch.setattr(x, "LISTED_SYNONYMS", listed)
    docs = frame([(1, "ab cell", "cell", "cell cell", "x", "cell", None), (2, None, "-- no", "", "", "", "")], "doc_id long, title string, abstract string, full_text string, introduction string, results string, discussion string")
    words = frame([("cell",), ("ab c",), ("no",), ("absent",), ("--",), ("a",)], "synonym string")
    got = {m: {(r["doc_id"], r["synonym"]): r["cnt"] for r in x.count_synonyms(docs, words, text_columns=f).collect()} for m, f in x.FIELDS.items()}
    rest = {(1, "ab c"): 1, (2, "no"): 1, (1, "a"): 1, (2, "-"): 1}
    assert got == {"abstract": {(1, "cell"): 2, **rest}, "full_text": {(1, "cell"): 4, **rest}, "full_text_no_methods": {(1, "cell"): 3, **rest}}


def test_a_large_lexicon_is_not_broadcast(spark, frame):
    docs = frame([(1, "word7 and word 99"), (2, "none")], "doc_id long, text string")
    many = spark.range(1_000_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("synonym"))
    counts = x.count_synonyms(docs, many)
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    labels = impute.impute(docs.select("doc_id", F.col("text").alias("title"), F.lit("").alias("abstract")), many.withColumn("category", F.lit("c")))
    assert "Broadcast" not in labels._jdf.queryExecution().executedPlan().toString()


def test_sections(frame):
    lines = ["Title", "Introduction", "one", "two", "METHODS", "three", "Results", "", "Abbreviations", "AB"]
    s = frame([(lines,)], "lines array<string>").select(x.sections(F.col("lines")).alias("s")).first()["s"]
    assert (s["introduction"], s["methods"], s["discussion"]) == ("one two", "three", "")
    body = one(frame, x.body_lines(c()), "front\nBody\nkept\nReferences\ngone")
    assert body == ["kept"]


def test_year(frame):
    assert one(frame, x.publication_year(c(0), c(1)), "2001", "x") == 2001
    assert one(frame, x.publication_year(c(0), c(1)), None, "1998 Spring") == 1998
    assert one(frame, x.publication_year(c(0), c(1)), "soon", "Spring") == -1


def _impute(frame, title, abstract, synonyms, **how):
    docs = frame([(1, title, abstract)], "doc_id long, title string, abstract string")
    return impute.impute(docs, frame([("c", s) for s in synonyms], "category string, synonym string"), **how).count()


@pytest.mark.parametrize("listed", [200, 0])
def test_imputation_needs_an_incomparable_pair(frame, monkeypatch, listed):
    monkeypatch.setattr(x, "LISTED_SYNONYMS", listed)
    text = "about heart failure and heart block"
    assert _impute(frame, "none", text, ["heart", "heart failure"]) == 0
    assert _impute(frame, "none", text, ["heart", "heart failure", "heart block"]) == 1
    assert _impute(frame, "On Heart: a view", "", ["heart"]) == 1
    assert _impute(frame, "On Hearts", "", ["heart"]) == 0
    assert _impute(frame, "On Heart", "", ["heart"], use_title=False) == 0
    assert _impute(frame, None, None, ["heart"]) == 0


@pytest.mark.parametrize("listed", [200, 0])
def test_triggering_synonyms(frame, monkeypatch, listed):
    monkeypatch.setattr(x, "LISTED_SYNONYMS", listed)
    docs = frame([(1, "On heart block", "heart failure"), (2, None, "valve, heart block and heart")], "doc_id long, title string, abstract string")
    synonyms = frame([("c", s) for s in ("heart", "heart block", "valve")], "category string, synonym string")
    labels = impute.impute(docs, synonyms)
    assert sorted(map(tuple, labels.collect())) == [(1, "c", True, 2, "heart"), (2, "c", False, 3, "heart")]
    assert sorted(map(tuple, impute.document_synonyms(labels).collect())) == [(1, ["heart"]), (2, ["heart"])]


def test_evaluation(frame):
    real = frame([(1, "a")], "doc_id long, category string")
    imputed = frame([(1, "a"), (1, "b")], "doc_id long, category string")
    r = impute.evaluate(real, imputed).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 1, 0, 0.5, 1.0)
    assert impute.evaluate(real, imputed, ref_compat=True).first()["tp"] == 2


def test_write_back_and_undo(frame):
    docs = frame([(1, ["x"]), (2, None)], "doc_id long, terms array<string>")
    labels = frame([(1, "a"), (2, "b")], "doc_id long, category string")
    after = impute.write_back(docs, labels)
    assert {r["doc_id"]: sorted(r["terms"]) for r in after.collect()} == {1: ["a", "x"], 2: ["b"]}
    assert {r["doc_id"]: r["terms"] for r in impute.undo(after, labels).collect()} == {1: ["x"], 2: []}


def test_candidates_hold_a_long_piece(frame):
    docs = frame([(1, "überaus wichtig-es 12ab x𝒳yz"), (2, "ab"), (3, None)], "doc_id long, f0 string")
    words = frame([("wichtig",), ("𝒳yz",), ("raus w",), ("12a",), ("fehlt",), ("ab",)], "synonym string")
    found = x.candidate_synonyms(docs, words, ["f0"])
    assert {(r["doc_id"], r["synonym"]) for r in found.collect()} == {(1, "wichtig"), (1, "𝒳yz"), (1, "raus w"), (1, "12a"), (1, "ab"), (2, "ab")}
    near = frame([(i, " ".join(f"{w[:5]}x {w[1:]}" for w in ("wichtig", "anderes"))) for i in range(9)], "doc_id long, f0 string")
    assert x.candidate_synonyms(near, frame([("wichti",), ("andere",)], "synonym string"), ["f0"]).count() == 0, "runs of three would make candidates of all"


@pytest.mark.parametrize("long", [256, 3])
def test_words_of_a_large_lexicon_are_counted_by_row_without_their_texts(frame, monkeypatch, long):
    monkeypatch.setattr(x, "LISTED_SYNONYMS", 2)
    monkeypatch.setattr(x, "LONG_WORD", long)
    docs = frame([(1, "banana-bananas, anan"), (1, "banana"), (1, "banana"), (None, "an 𝒳an1an")], "doc_id long, text string")
    counts = x.count_synonyms(docs, frame([("an",), ("anan",), ("banana",), ("bananas",), ("nanas",), ("none",)], "synonym string"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan, "sums alone are exchanged"
    want = [(None, "an", 3), *[(1, "an", 2), (1, "anan", 1), (1, "banana", 1)] * 2, (1, "an", 6), (1, "anan", 3), (1, "banana", 2), (1, "bananas", 1), (1, "nanas", 1)]
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(map(str, want))
