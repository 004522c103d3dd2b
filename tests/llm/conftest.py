import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid string, shard string, rank string, kept string, size string, text_hash string, `a.b` string"


def words(r, n, pool=400):
    return " ".join(f"w{r.randrange(pool)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and doc_ids."""
    r = random.Random(11)
    long = words(r, 30_000, 5000)
    base = words(r, 60)
    near = base.replace(base.split(" ")[30], "changed", 1)
    texts = [None, "", " \n\t ", "one", "Ünïcödé ☃ 日本語 \x00 zero", base, base, near, long, long[:100_000], "a" * 5000, "ab " * 400, words(r, 200), words(r, 25)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, base), (None, base), (None, None), (3, "one"), (100, "other text of doc one hundred"), (100, words(r, 40))]
    return [(d, t, "en", None, None if t is None else len(t), "x", "y", "z", None, "s", "h", "dot") for d, t in rows]


@pytest.fixture(scope="session")
def edge_docs(frame, edge_rows):
    return frame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(frame):
    return frame([], SCHEMA)
