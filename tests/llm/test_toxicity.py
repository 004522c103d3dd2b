import math
import random
import re
import string
import zlib

import numpy as np

from loomcube.llm import textvec as tv
from loomcube.llm import toxicity


def test_isotonic_is_the_least_squares_increasing_fit():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and np.allclose(np.interp([2.5], x, y), [0.5])


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    score = toxicity.Trees().fit(x[:1500], y[:1500]).score(x[1500:])
    assert ((score > 0) == (y[1500:] > 0)).mean() > 0.95


def corpus():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        ws = [f"w{r.randrange(300)}" for _ in range(r.randrange(15, 80))]
        toxic = i % 5 == 0
        if toxic:
            for w in r.choices(["idiot", "moron", "grumbold", "grumboldly"], k=3):
                ws.insert(r.randrange(len(ws)), w)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(frame):
    rows, labels = corpus()
    docs, known = frame(rows, "doc_id long, text string"), frame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.fit(docs, known)).collect()
    truth = dict(labels)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(held) > 100 and np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_edge_cases(frame, edge_docs, edge_rows, no_docs):
    labels = frame([(1, 1), (1, 0), (None, 1), (5, None), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, labels)
    assert toxicity.score_documents(edge_docs, model).count() == len(edge_rows)
    model = toxicity.fit(no_docs, frame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(no_docs, model).count() == 0
    assert toxicity.score_documents(edge_docs, model).count() == len(edge_rows)


LETTERS = "[0-9A-Za-z\u0080-\U0010ffff]+"
LEET = str.maketrans("013457@$!", "oieastasi")


def lower(text):
    return "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text)


def plain_features(text, words, stems):
    """The features of one text, word by word; ``words`` and ``stems`` give weights."""
    ws = re.findall(LETTERS, text)
    low = [lower(w) for w in ws]
    n = max(len(ws), 1)
    fixed, second = [w in toxicity.INSULTS for w in low], [w in toxicity.SECOND_PERSON for w in low]
    word = [words.get(w, 0.0) for w in low]
    stem = [max([stems.get(w.encode()[:k], 0.0) for k in toxicity.STEMS if len(w.encode()) > k], default=0.0) for w in low]
    strong = [f or a > 2.5 or b > 2.5 for f, a, b in zip(fixed, word, stem)]
    near = [s and any(second[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, s in enumerate(strong)]
    raw = text.encode()
    size, letters = max(len(raw), 1), max(sum(c.isascii() and c.isalpha() for c in text), 1)
    tokens = re.findall(r"[^\x20\x09-\x0d]+", text)
    veiled = [t for t in tokens if re.search(r"[A-Za-z][*@$!.\-_#0-9][A-Za-z]", t)]

    def shown(t):
        spelt = lower(t).translate(LEET)
        return re.sub(r"[^A-Za-z\u0080-\U0010ffff]", "", spelt)

    shown_hits = sum(shown(t) in toxicity.INSULTS or shown(t) in words for t in veiled)
    punct = sum(c in string.punctuation for c in text)
    return [
        sum(fixed) / n, sum(w in words for w in low) / n, sum(word) / n, max(word, default=0.0),
        sum(s > 0 for s in stem) / n, sum(stem) / n, max(stem, default=0.0), sum(near) / n, sum(second) / n,
        sum("A" <= c <= "Z" for c in text) / letters, sum(len(w) > 1 and bool(re.fullmatch("[A-Z]+", w)) for w in ws) / n,
        text.count("!") / n, text.count("?") / n, (punct - text.count("!") - text.count("?")) / size,
        sum(c in string.digits for c in text) / size, len(veiled) / n, shown_hits / n, math.log1p(len(ws)),
        math.log1p(sum(s and (f or w in words or t > 0) for s, f, w, t in zip(strong, fixed, low, stem))),
    ]


def test_features_like_a_plain_version():
    r = random.Random(8)
    words = {"grumbold": 3.0, "über": 1.9, "zonk": 2.6}
    stems = {b"grum": 2.7, b"grumb": 1.8, b"zonker": 3.1, "düst".encode(): 1.6}
    lexicon = {}
    for name, weights in (("word", {w.encode(): o for w, o in words.items()}), ("stem", stems)):
        rows = sorted((tv.bytes_hash(w), o) for w, o in weights.items())
        lexicon[name] = np.array([h for h, _ in rows], np.uint64), np.array([o for _, o in rows])
    parts = ["you", "IDIOT", "id.iot", "m0r0n", "i-d-i-o-t", "Grumboldly", "grumbold", "zonkerei", "ÜBER", "düster", "what?!", "(42)", "$#", "st*pid", "http://a.b.c/d-e", "Ihr", "x", "\n", "日本", "z0nk", "gr.umbold!", "BIG"]
    texts = ["", " ", "idiot"] + [" ".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    raws = [t.encode() for t in texts]
    got = toxicity.features(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0] + [len(x) for x in raws]), lexicon)
    want = np.array([plain_features(t, words, stems) for t in texts])
    for j, name in enumerate(toxicity.FEATURES):
        assert np.allclose(got[:, j], want[:, j]), name


def test_repeated_ids_leave_the_sample_bounded(frame):
    docs = frame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = frame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.sample_labelled(docs, labels).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [x for x in [(1, "text 0"), (2, "b"), (3, "")] if zlib.crc32(str(x[0]).encode()) % 5]
