import math
import random
from collections import Counter

from loomcube.llm import importance
from loomcube.llm import textvec as tv


def corpus(frame):
    r = random.Random(3)
    good = [(i, " ".join(r.choice(["the", "of", "and", "land", "sea", "sky"]) for _ in range(60))) for i in range(150)]
    bad = [(1000 + i, " ".join(r.choice(["the", "$$", "%%", "buy", "now"]) for _ in range(60))) for i in range(50)]
    docs = frame([*good, *bad], "doc_id long, text string")
    labels = frame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad], "doc_id long, quality int")
    return docs, labels


def test_good_documents_are_drawn(frame):
    docs, labels = corpus(frame)
    rows = importance.resample(docs, labels).collect()
    assert len(rows) == 200 and sorted(r["rank"] for r in rows) == list(range(200))
    kept = [r["doc_id"] < 1000 for r in rows if r["kept"]]
    assert sum(kept) >= 0.97 * len(kept)


def test_weights_like_a_plain_version(frame):
    docs, labels = corpus(frame)
    from pyspark.sql import functions as F

    marked = docs.withColumn("is_target", F.col("doc_id") < 1000)
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in importance.bucket_counts(marked.select("text", "is_target"), 997).collect()}

    def grams(text):
        ws = text.split()
        single = [tv.bytes_hash(w.encode()) for w in ws]
        import numpy as np

        pairs, _ = tv.windows(np.array(single, np.uint64), np.array([0, len(single)]), 2)
        return [h % 997 for h in single] + [int(p) % 997 for p in pairs]

    raw, target = Counter(), Counter()
    for d, text in docs.collect():
        raw.update(grams(text))
        if d < 1000:
            target.update(grams(text))
    assert counts == {b: (n, target[b]) for b, n in raw.items()}
    ratios = importance.log_ratios(importance.bucket_counts(marked.select("text", "is_target"), 997), 997)
    total, own = sum(raw.values()) + 997, sum(target.values()) + 997
    weights = {r["doc_id"]: r["log_weight"] for r in importance.log_weights(docs, ratios).collect()}
    for d, text in docs.limit(20).collect():
        want = sum(math.log((target[b] + 1) / own) - math.log((raw[b] + 1) / total) for b in grams(text))
        assert abs(weights[d] - want) < 1e-4


def test_edge_cases(frame, edge_docs, edge_rows, no_docs):
    labels = frame([(5, 1), (5, 0), (12, 1), (None, 1), (13, None)], "doc_id long, quality int")
    rows = importance.resample(edge_docs, labels, k=4).collect()
    assert len(rows) == len(edge_rows) and sum(r["kept"] for r in rows) == 4
    assert all(r["log_weight"] is None and not r["kept"] for r in rows if r["n_ngrams"] == 0)
    none = frame([], "doc_id long, quality int")
    assert all(r["kept"] for r in importance.resample(edge_docs, none).collect())
    assert importance.resample(no_docs, labels).count() == 0


def test_draw_like_a_plain_version(frame, edge_docs, edge_rows):
    """Noise from doc_id and text, keys in falling order, the first k kept."""
    from pyspark.sql import functions as F
    import numpy as np

    labels = frame([(5, 1), (12, 1), (7, 0)], "doc_id long, quality int")
    rows = importance.resample(edge_docs, labels, k=6).collect()
    hashes = {r["text"]: r["h"] for r in edge_docs.select("text", F.xxhash64("text").alias("h")).collect()}
    noise, mask = {}, 2**64 - 1
    seed = int(tv.mix(np.array([importance.SEED], np.uint64))[0])
    for d, t, *_ in edge_rows:
        own = (-1 if d is None else d) & mask ^ int(tv.mix(np.array([hashes[t] & mask], np.uint64))[0])
        u = ((int(tv.mix(np.array([(own + seed) & mask], np.uint64))[0]) >> 11) + 0.5) / 2**53
        noise.setdefault(d, []).append(-math.log(-math.log(u)))
    for r in rows:
        if r["gumbel_key"] is not None:
            assert min(abs(r["gumbel_key"] - r["log_weight"] - n) for n in noise[r["doc_id"]]) < 1e-8
    ranked = sorted(rows, key=lambda r: r["rank"])
    keys = [(r["gumbel_key"] is None, -(r["gumbel_key"] or 0), r["doc_id"] is not None, r["doc_id"] or 0) for r in ranked]
    assert keys == sorted(keys) and [r["kept"] for r in ranked] == [i < 6 for i in range(len(ranked))]
