"""Keyed tables and the cube that follows their updates."""

import random

import pytest
from pyspark.sql import functions as F

from loomcube.sources import keyed
from loomcube.storage import children

SCHEMA = "doc_id long, version long, lang string, text string, `a.b` string"


def observe(docs):
    words = docs.select("doc_id", F.col("lang").alias("category"), F.explode(F.split("text", " ")).alias("entity"))
    return words.filter("entity <> ''").groupBy("category", "doc_id", "entity").agg(F.count("*").alias("cnt"))


def fresh(rows):
    last = {}
    for r in rows:
        if r[0] not in last or r[1] >= last[r[0]][1]:
            last[r[0]] = r
    tf, df, docs = {}, {}, {}
    for d, _, lang, text, _ in last.values():
        words = [w for w in (text or "").split(" ") if w]
        for w in words:
            tf[lang, w] = tf.get((lang, w), 0) + 1
        for w in set(words):
            df[lang, w] = df.get((lang, w), 0) + 1
        if words:
            docs[lang] = docs.get(lang, 0) + 1
    return {k: (tf[k], df[k]) for k in tf}, docs, last


def document(r, i, version):
    return (i, version, r.choice(["de", "en", None]), r.choice([None, ""]) if r.random() < 0.1 else " ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))), "x")


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/cube"


def test_cube_after_updates_equals_the_fresh_one(frame, place):
    r = random.Random(8)
    rows = [document(r, i, 5) for i in range(60)]
    cube = keyed.IncrementalCube(place, frame(rows, SCHEMA), observe, buckets=8)
    updates = [
        [document(r, i, 6) for i in range(0, 60, 7)] + [document(r, 100, 1)],
        [document(r, 3, 4), document(r, 7, 6), document(r, 7, 9), document(r, 101, 2)],
        [document(r, 7, 8), document(r, 100, 1)],
        [],
    ]
    for new in updates:
        cube.update(frame(new, SCHEMA))
        rows += sorted(new, key=lambda x: x[1])
        cells, docs, last = fresh(rows)
        assert {(x["category"], x["entity"]): (x["tf"], x["df"]) for x in cube.frequencies().collect()} == cells
        assert {x["category"]: x["n_docs"] for x in cube.documents_per_category().collect()} == docs
        assert sorted(map(tuple, cube.docs.read().collect()), key=repr) == sorted(last.values(), key=repr)


def test_untouched_buckets_keep_their_files(frame, spark, place):
    rows = [(i, 1, "de", f"w{i}", "x") for i in range(200)]
    table = keyed.KeyedTable.create(place, frame(rows, SCHEMA), ("doc_id",), 16)
    before = table.manifest()
    gone, come = keyed.upsert(table, frame([(5, 2, "en", "new", "y"), (6, 0, "en", "stale", "y")], SCHEMA), "version")
    after = table.manifest()
    assert [tuple(r)[:4] for r in gone.collect()] == [(5, 1, "de", "w5")] and [tuple(r)[:4] for r in come.collect()] == [(5, 2, "en", "new")]
    moved = {b for b in after if after[b] != before[b]}
    assert len(moved) == 1 and set(after) == set(before)
    assert children(spark, f"{place}/data/2") == ["_SUCCESS", f"bucket={moved.pop()}"]
    assert table.read().count() == 200 and table.read(version=1).filter("doc_id = 5").first()["text"] == "w5"
    assert table.versions() == [1, 2] and children(spark, f"{place}/drafts") == []


def test_a_failed_update_is_not_seen(frame, place):
    table = keyed.KeyedTable.create(place, frame([(1, 1, "de", "a", "x")], SCHEMA), ("doc_id",), 4)
    broken = frame([(1, 2, "de", "b", "x")], SCHEMA)
    with pytest.raises(Exception, match="USER_RAISED|broken"):
        table.update(broken, lambda own, new: new.withColumn("text", F.raise_error(F.lit("broken")).cast("string")))
    assert table.versions() == [1] and table.read().first()["text"] == "a"
    table.update(broken, lambda own, new: new)
    assert table.read().first()["text"] == "b"


def test_empty_tables(frame, place):
    table = keyed.KeyedTable.create(place, frame([], SCHEMA), ("doc_id",), 4)
    assert table.read().count() == 0 and table.update(frame([], SCHEMA), lambda own, new: new) == set()
    keyed.upsert(table, frame([(None, 1, "de", "a", "x"), (None, 2, "de", "b", "x")], SCHEMA), "version")
    assert [r["text"] for r in table.read().collect()] == ["b"]


def test_an_update_exchanges_old_rows_once(frame, spark, place, monkeypatch):
    table = keyed.KeyedTable.create(place, frame([(i, 1, "de", f"w{i}", "x") for i in range(200)], SCHEMA), ("doc_id",), 4)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "10000"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    plans, writer = [], type(frame([], SCHEMA).write)
    stored = writer.parquet

    def recorded(self, *how, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return stored(self, *how, **named)

    monkeypatch.setattr(writer, "parquet", recorded)
    try:
        gone, come = keyed.upsert(table, frame([(5, 2, "en", "new", "y"), (500, 1, "en", "other", "y")], SCHEMA), "version")
    finally:
        for k in conf:
            spark.conf.unset(k)
    texts = [line for plan in plans for line in plan.splitlines() if "Scan parquet" in line and "data/1" in line and "text" in line.split("ReadSchema")[-1]]
    assert len(texts) == 1, "texts of old rows are read for one exchange"
    assert [r["text"] for r in gone.collect()] == ["w5"] and come.count() == 2 and table.read().count() == 201
