"""Tar bundles, XML records across splits, and stages that follow their inputs."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from loomcube.sources import bundles, readers, stages


@pytest.fixture(scope="module")
def packed(tmp_path_factory):
    """Three bundles and the same members in a folder."""
    top, names = tmp_path_factory.mktemp("bundles"), {}
    for b, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz"), ("c.tgz", "w:gz")):
        with tarfile.open(top / b, mode) as out:
            for i in range(1500 if b != "c.tgz" else 3):
                data = f"{b} text {i} ".encode() * (i % 50)
                info = tarfile.TarInfo(f"d{i % 7}/m{i}.txt")
                info.size = len(data)
                out.addfile(info, io.BytesIO(data))
                names[b, info.name] = data
            folder = tarfile.TarInfo("empty")
            folder.type = tarfile.DIRTYPE
            out.addfile(folder)
    return top, names


def test_wanted_members_of_bundles(frame, packed, monkeypatch):
    top, names = packed
    monkeypatch.setattr(bundles, "BATCH_BYTES", 2000)
    wanted = [k for i, k in enumerate(sorted(names)) if i % 9 == 0] + [("a.tar", "d0/absent.txt"), (None, "x")]
    for folder in (str(top), f"file://{top}/"):
        got = bundles.read_members(frame(wanted + wanted[:5], "bundle string, member string"), folder).collect()
        assert {(r["bundle"], r["member"]): bytes(r["content"]) for r in got} == {k: names[k] for k in wanted if k in names}
        assert len(got) == len(wanted) - 2
    every = bundles.read_members(frame([("c.tgz", None), ("c.tgz", "d0/m0.txt")], "bundle string, member string"), str(top))
    assert every.count() == 3
    files = frame([(b, m, f"PMC{i}") for i, (b, m) in enumerate(sorted(names))], "bundle string, member string, pmcid string")
    some = bundles.wanted_articles(files, frame([("PMC3",), ("PMC2000",), ("none",)], "pmcid string"), str(top))
    assert {r["pmcid"]: r["text"].encode() for r in some.collect()} == {f"PMC{i}": names[k] for i, k in enumerate(sorted(names)) if i in (3, 2000)}
    assert bundles.read_members(frame([], "bundle string, member string"), str(top)).count() == 0


def test_records_across_splits_come_once(spark, tmp_path):
    articles = [f'<article n="{i}">\n<article-id pub-id-type="pmid">{i}</article-id><body><p>{"é" * (i % 300)} end {i}</p></body></article>' for i in range(3000)]
    (tmp_path / "many.xml").write_text("<?xml version='1.0'?>\n<articles>\n" + "\n".join(articles) + "\n</articles>\n", encoding="utf-8")
    (tmp_path / "none.xml").write_text("<articles></articles>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        got = readers.read_full_text_xml(spark, str(tmp_path))
        parts = readers.read_xml_records(spark, str(tmp_path), "article").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        rows = sorted((int(r["pmid"]), r["body"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [(i, f"{'é' * (i % 300)} end {i}".strip()) for i in range(3000)]
    assert len(parts) > 10 and max(r["count"] for r in parts) < 1000


def test_what_depends_on_a_change_is_built_again(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(f"{name}\n")

    def graph(least=0):
        def text(name):
            return lambda _: spark.read.text(f"file://{tmp_path}/{name}.txt")

        return stages.Stages(spark, f"file://{tmp_path}/tables", [
            *(stages.Stage(n, text(n), (f"file://{tmp_path}/{n}.txt",)) for n in "abc"),
            stages.Stage("ab", lambda t: t["a"].unionByName(t["b"]), after=("a", "b")),
            stages.Stage("size", lambda t: t["ab"].filter(F.length("value") > least), after=("ab",), parameters={"least": least}),
            stages.Stage("only c", lambda t: t["c"], after=("c",)),
        ])

    tables, built = graph().run()
    assert built == ["a", "b", "c", "ab", "size", "only c"] and sorted(r["value"] for r in tables["size"].collect()) == ["a", "b"]
    assert graph().run()[1] == []
    assert graph(least=1).run("size")[1] == ["size"]
    (tmp_path / "b.txt").write_text("b\nbb\n")
    tables, built = graph(least=1).run()
    assert built == ["b", "ab", "size"] and [r["value"] for r in tables["size"].collect()] == ["bb"]
    assert len(list((tmp_path / "tables" / "ab").iterdir())) == 1
    (tmp_path / "c.txt").unlink()
    assert graph(least=1).run("size")[1] == []
    with pytest.raises(FileNotFoundError, match="c.txt"):
        graph().run()
    with pytest.raises(ValueError, match="x > y > x"):
        stages.Stages(spark, "t", [stages.Stage("x", len, after=("y",)), stages.Stage("y", len, after=("x",))]).run()
    with pytest.raises(ValueError, match="unknown"):
        stages.Stages(spark, "t", [stages.Stage("x", len, after=("z",))])


def test_a_failed_stage_is_built_again(spark, tmp_path):
    broken = [True]

    def build(_):
        rows = spark.range(5)
        return rows.select(F.raise_error(F.lit("broken")).alias("id")) if broken[0] else rows

    graph = stages.Stages(spark, f"file://{tmp_path}/tables", [stages.Stage("s", build)])
    with pytest.raises(Exception, match="broken"):
        graph.run()
    broken[0] = False
    tables, built = graph.run()
    assert built == ["s"] and tables["s"].count() == 5
