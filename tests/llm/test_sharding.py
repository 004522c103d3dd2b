import zlib
from collections import Counter

import numpy as np

from loomcube.llm import sharding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        image = sharding.feistel(np.arange(n), n)
        assert sorted(image.tolist()) == list(range(n))
        assert (sharding.feistel_inverse(image, n) == np.arange(n)).all()
    assert (sharding.feistel(np.arange(1000), 1000, seed=1) != sharding.feistel(np.arange(1000), 1000, seed=2)).mean() > 0.9


def test_shards(edge_docs, edge_rows):
    rows = sharding.shard_documents(edge_docs, 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in edge_rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_do_not_depend_on_partitions(edge_docs):
    once = sharding.shard_documents(edge_docs, 5).drop("row_number").collect()
    again = sharding.shard_documents(edge_docs.repartition(7), 5).drop("row_number").collect()
    assert Counter(once) == Counter(again)


def test_empty(no_docs):
    assert sharding.shard_documents(no_docs).count() == 0


def test_written_shards(spark, edge_docs, edge_rows, tmp_path):
    """Null and repeated doc_ids, repeated rows and own columns of the same names."""
    path = f"file://{tmp_path}/shards"
    assert sharding.write_shards(edge_docs, path, 3) == ("shard_", "slot")
    rows = spark.read.parquet(path).collect()
    assert Counter((r["doc_id"], r["text"], r["shard"], r["size"]) for r in rows) == Counter((d, t, s, z) for d, t, _, _, _, _, s, _, _, z, *_ in edge_rows)
    sizes = Counter(r["shard_"] for r in rows)
    assert len(sizes) == 3 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard_"] == k) == list(range(n)) for k, n in sizes.items())
    places = sharding.shard_documents(edge_docs, 3).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in places) == Counter((r["doc_id"], r["shard_"], r["slot"]) for r in rows)
    several = sharding.write_shards(edge_docs.select("doc_id", "text"), f"{path}2", 1)
    assert several == ("shard", "slot") and len(list(tmp_path.glob("shards2/shard=0/*.parquet"))) > 1
