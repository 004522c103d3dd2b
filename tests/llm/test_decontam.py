import random

import numpy as np

from loomcube.llm import decontam


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))


def edit(r, text, n):
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        out[i : i + 1] = [] if kind == 0 else [r.choice("xyz")] if kind == 1 else [out[i], r.choice("xyz")]
    return "".join(out)


def distance(window, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def folded(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return decontam.fold(raw, np.array([0, len(raw)]))[0].tobytes() if len(raw) else b""


def test_folding():
    assert folded("  Ünder-Wasser,  42! ") == "ünder wasser 42".encode()
    buf = "A b.".encode() + b"" + "!C".encode()
    out, offsets = decontam.fold(np.frombuffer(buf, np.uint8), np.array([0, 4, 4, 6]))
    assert out.tobytes() == b"a bc" and offsets.tolist() == [0, 3, 3, 4]


def test_like_all_alignments(frame):
    r = random.Random(6)
    items = [(i, sentence(r, n)) for i, n in enumerate([3, 10, 18, 30, 60])] + [(7, ""), (8, None), (None, "x" * 200), (9, "tiny"), (10, "Tiny one"), (11, "tiny"), (12, "?!")]
    docs = []
    for d in range(60):
        body = sentence(r, 40)
        if d % 3:
            _, item = items[r.randrange(5)]
            body = body[:50] + " " + edit(r, item, r.choice([0, 1, 3, 6, 12])).upper() + "! " + body[50:]
        docs.append((d, body))
    docs += [(80, "A Tiny, one"), (81, "tinyone untiny"), (82, "tiny"), (90, None), (91, ""), (92, items[3][1]), (92, items[3][1])]
    got = sorted((x["doc_id"], x["item_id"], x["n_windows"], x["edits"]) for x in decontam.find_passages(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect())
    probes = decontam.Probes([(i, t) for i, t in items if i is not None and t is not None])
    pieces, want = probes.text, []
    for d, t in docs:
        text, by = folded(t), {}
        for w, item in enumerate(probes.owner.tolist()):
            item_window = pieces[w, : probes.length[w]].tobytes()
            if len(item_window) < decontam.Q:
                if b" " + item_window + b" " in b" " + text + b" ":
                    by.setdefault(item, []).append(0)
                continue
            e = distance(item_window, text)
            if e <= probes.budget[w]:
                by.setdefault(item, []).append(e)
        want += [(d, item, len(es), min(es)) for item, es in by.items()]
    assert len(want) > 20 and got == sorted(want)


def test_few_hits_at_a_time(monkeypatch):
    """Texts, stretches of a text and items in halves give the same results."""
    r = random.Random(16)
    items = [(i, sentence(r, 30)) for i in range(6)] + [(6, "ab " * 60), (7, "ba " * 60), (8, "a" * 150)]
    texts = [sentence(r, 300) + " " + edit(r, t, 2) + " " + sentence(r, 300) for _, t in items] + ["a" * 400 + " " + "ab " * 150, sentence(r, 50)]
    raws = [folded(t) for t in texts]
    buf, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0] + [len(x) for x in raws])
    probes = decontam.Probes(items)

    def best():
        out = {}
        for t, w, e, _ in zip(*(x.tolist() for x in decontam.search(probes, buf, offsets)), strict=True):
            out[t, w] = min(e, out.get((t, w), 99))
        return out

    want = best()
    assert {t for t, _ in want} == set(range(10))
    for hits in (20_000, 2_000):
        monkeypatch.setattr(decontam, "HITS", hits)
        assert best() == want


def test_short_items_can_be_left_out(frame):
    docs, items = frame([(1, "say yes"), (2, "nothing")], "doc_id long, text string"), frame([(1, "Yes!")], "item_id long, text string")
    assert [x["doc_id"] for x in decontam.drop_contaminated(docs, items).collect()] == [2]
    assert decontam.drop_contaminated(docs, items, least=4).count() == 2


def test_blocks_of_items(frame, monkeypatch):
    r = random.Random(9)
    items = [(i, sentence(r, 20)) for i in range(12)]
    docs = frame([(i, "start " + t) for i, t in items] + [(99, sentence(r, 30))], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_OF_ITEMS", 400)
    got = decontam.find_passages(docs, frame(items, "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(i, i) for i in range(12)]
    assert [x["doc_id"] for x in decontam.drop_contaminated(docs, frame(items, "item_id long, text string")).collect()] == [99]


def test_edge_cases(frame, edge_docs, edge_rows, no_docs):
    items = frame([(1, edge_rows[5][1])], "item_id long, text string")
    assert {x["doc_id"] for x in decontam.find_passages(edge_docs, items).collect()} >= {5, 6, 7}
    none = frame([], "item_id long, text string")
    assert decontam.find_passages(edge_docs, none).count() == 0 and decontam.find_passages(no_docs, items).count() == 0
    assert decontam.drop_contaminated(edge_docs, none).count() == len(edge_rows)
    assert decontam.drop_contaminated(edge_docs, items).columns == edge_docs.columns


def test_many_texts_by_many_windows():
    r = random.Random(12)
    items = [(i, "".join(r.choice("abcdefghijklmnop") for _ in range(20))) for i in range(60_000)]
    probes = decontam.Probes(items)
    texts = [b"nothing to find here"] * 20_000
    texts[3], texts[19_990] = items[41][1].encode(), items[59_321][1].encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    text, window, edits, _ = decontam.search(probes, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert len(texts) * len(items) > 1 << 30
    assert set(zip(text.tolist(), probes.owner[window].tolist(), edits.tolist(), strict=True)) == {(3, 41, 0), (19_990, 59_321, 0)}


def test_partial_quotations_at_all_offsets():
    r = random.Random(13)
    items = [(1, sentence(r, 45)), (2, sentence(r, 12)[:63]), (3, sentence(r, 30))]
    probes = decontam.Probes(items)
    least = 63
    for item, text in items:
        quoted = folded(text)
        texts, want = [], set()
        for start in range(len(quoted) - least + 1):
            want.add(len(texts))
            texts.append(sentence(r, 9).encode() + b" " + quoted[start : start + least] + b" " + sentence(r, 9).encode())
        offsets = np.cumsum([0] + [len(t) for t in texts])
        found, window, edits, _ = decontam.search(probes, np.frombuffer(b"".join(texts), np.uint8), offsets)
        assert set(found.tolist()) == want and set(probes.owner[window].tolist()) == {item}
        for k, b in enumerate(texts[:: max(1, len(texts) // 6)]):
            best = min(distance(probes.text[w, : probes.length[w]].tobytes(), b) for w in np.flatnonzero(probes.owner == item))
            assert best == edits[found == k * max(1, len(texts) // 6)].min()


def test_long_quotations_through_the_query(frame):
    r = random.Random(14)
    item = folded(sentence(r, 60)).decode()
    docs = [(s, f"{sentence(r, 20)} {item[s : s + 65]} {sentence(r, 20)}") for s in range(0, len(item) - 65, 7)]
    found = decontam.find_passages(frame(docs, "doc_id long, text string"), frame([(5, item)], "item_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in found) == [d for d, _ in docs]


def test_edits_close_together():
    r = random.Random(15)
    item = folded(sentence(r, 40))[:96]
    text = item[:40] + b"z" + item[41:45] + b"z" + item[46:50] + b"z" + item[51:55] + b"z" + item[56:]
    found, window, edits, _ = decontam.search(decontam.Probes([(1, item.decode())]), np.frombuffer(text, np.uint8), np.array([0, 96]))
    assert len(found) and edits.min() == 4
