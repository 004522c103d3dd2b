import random
import re
from collections import Counter

from loomcube.llm import quality_rules


def plain(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    times, covered = Counter(wins), set()
    for i, w in enumerate(wins):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def check(rows, texts):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((d, *plain(t)) for d, t in texts)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_edge_cases(edge_docs, edge_rows, no_docs):
    check(quality_rules.judge(edge_docs, "doc_id").collect(), [(d, t) for d, t, *_ in edge_rows])
    assert quality_rules.judge(no_docs, "doc_id").count() == 0


def test_repeats_like_a_plain_version(frame):
    r = random.Random(8)
    texts = [(i, "".join(r.choice(["a", "b", "c", "d#", "é"]) + r.choice([" ", " ", " ", "\n", "\t", "\x0b", "\xa0", "\n\n"]) for _ in range(r.randrange(80)))) for i in range(150)]
    texts += [(200 + i, " ".join(f"u{k % p}" for k in range(40))) for i, p in enumerate(range(1, 30))]
    check(quality_rules.judge(frame(texts, "doc_id long, text string"), "doc_id").collect(), texts)


def test_verdicts(frame):
    prose = "the house of the river and one boat that was seen by many people in spring while rain fell on it"
    docs = frame([(1, prose), (2, prose.replace(" ", "### ")), (3, prose.upper()), (4, "x " * 19)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, "doc_id").collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert [tuple(r) for r in quality_rules.quality_filter(docs).collect()] == [(1, prose)]


def test_filter_keeps_columns(edge_docs):
    assert quality_rules.quality_filter(edge_docs).columns == edge_docs.columns


def test_no_python(edge_docs):
    plan = quality_rules.judge(edge_docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange (?!.*REPARTITION)", plan.replace("REPARTITION_BY_NUM", "REPARTITION"))
