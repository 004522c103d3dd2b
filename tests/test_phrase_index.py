"""The positional index against a scan of token lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomcube.operators import phrase_index as p
from loomcube.storage import children

SCHEMA = "doc_id long, title string, abstract string"


def plain(docs, phrases, fields, tokens, stop):
    out = {}
    for phrase in set(phrases):
        own = [(i, w) for i, w in enumerate(tokens(phrase)) if w not in stop] if phrase is not None else []
        for d, *texts in docs:
            n = 0
            for f, text in zip(("title", "abstract"), texts):
                if f in fields and own and d is not None:
                    words = [w if w not in stop else None for w in tokens(text or "")]
                    n += sum(all(0 <= s + i < len(words) and words[s + i] == w for i, w in own) for s in range(-own[0][0], len(words)))
            if n:
                out[phrase, d] = n
    return out


@pytest.fixture(scope="module")
def docs():
    r = random.Random(6)
    words = ["heart", "Heart", "failure", "the", "of", "and", "alpha-1", "e.g", "3.5", "x", "don't", "été"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randrange(5))), ", ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(80)]
    return [*out, (100, None, ""), (101, "heart " * 3000, None), (None, "heart failure", "x")]


PHRASES = ["heart failure", "heart", "the", "of the", "failure of heart", "the heart", "heart heart heart", "3.5 x", "don't été", "absent heart", "", None, "alpha-1 x", "Heart"]


@pytest.mark.parametrize("case", [True, False])
def test_phrases_equal_the_plain_version(frame, docs, tmp_path, case):
    analyzer = p.Analyzer(case_sensitive=case)
    path = f"file://{tmp_path}/index"
    p.build(frame(docs, SCHEMA).repartition(3), path, ("title", "abstract"), analyzer, buckets=8, spread=2)
    pattern = re.compile(r"\w+(?:(?:(?<=[^\W\d_])['’.](?=[^\W\d_])|(?<=\d)[.,](?=\d))\w+)*")

    def tokens(text):
        return [w if case else w.lower() for w in pattern.findall(text)]

    for fields in (("title",), ("title", "abstract")):
        got = p.find_phrases(frame([(x,) for x in [*PHRASES, "heart"]], "phrase string"), path, fields, analyzer)
        assert {(r["phrase"], r["doc_id"]): r["n"] for r in got.collect()} == plain(docs, PHRASES, fields, tokens, p.STOP_WORDS)
    assert p.find_phrases(frame([], "phrase string"), path, ("title",), analyzer).count() == 0


def test_a_lookup_reads_the_folders_of_its_tokens(frame, spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    p.build(frame(docs, SCHEMA), path, ("title",), buckets=16, spread=2)
    read = p._read(spark, path, "postings", [r["b"] for r in frame([("heart",)], "t string").select(F.pmod(F.xxhash64("t"), F.lit(16)).cast("int").alias("b")).collect()])
    folders = {r["f"].split("bucket=")[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(folders) == 1 and len(children(spark, f"{path}/postings")) > 3
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters, "folders are chosen before files are read"


def test_counts_of_retrieved_documents(frame, tmp_path):
    docs = frame([(1, "alpha-beta", "an alpha beta, alphabet"), (2, "alphabet", "x"), (3, None, "alpha beta")], SCHEMA)
    path = f"file://{tmp_path}/index"
    p.build(docs, path, ("title", "abstract"))
    got = p.count_retrieved(docs, frame([("alpha-beta",), ("alpha",), ("-",)], "synonym string"), path, ("title", "abstract"))
    assert {tuple(r) for r in got.collect()} == {(1, "alpha beta", 2), (3, "alpha beta", 1), (1, "alpha", 3), (3, "alpha", 1)}


def test_the_build_exchanges_a_row_a_field_and_bucket(frame, docs, tmp_path, monkeypatch):
    seen, kind = [], type(frame(docs, SCHEMA))
    plain_repartition = kind.repartition

    def recorded(self, *how):
        seen.append((self.count(), "Exchange" in self._jdf.queryExecution().executedPlan().toString()))
        return plain_repartition(self, *how)

    monkeypatch.setattr(kind, "repartition", recorded)
    p.build(frame(docs, SCHEMA), f"file://{tmp_path}/index", ("title", "abstract"), buckets=4, spread=2)
    assert seen[0][0] <= 2 * 4 * len(docs) and not seen[0][1], "positions come together before anything is exchanged"


def test_positions_of_equal_ids_come_together(frame, spark, tmp_path):
    path = f"file://{tmp_path}/index"
    p.build(frame([(1, "heart x heart", None), (1, "y heart", None)], SCHEMA), path, ("title",), buckets=4, spread=2)
    assert [r["positions"] for r in spark.read.parquet(f"{path}/postings").filter("token = 'heart'").collect()] == [[0, 1, 2]]
