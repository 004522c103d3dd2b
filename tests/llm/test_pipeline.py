import hashlib
import random
from collections import Counter

import corpus_pipeline

from loomcube.llm import bpe, quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def without_repeats(docs):
    """``doc_id, text`` of the texts that are left when every 100 bytes that also start earlier are cut, byte by byte."""
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())):
        raw = (text or "").encode()
        gone = set()
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone.update(range(i, i + 100))
            seen.add(window)
        rest = bytes(b for i, b in enumerate(raw) if i not in gone).decode(errors="ignore")
        if len(raw) < 100 or rest.strip(" "):
            out.append((d, text if not gone else rest))
    return out


def tokens(text):
    import tiktoken

    path, pattern = bpe.default_tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).merges.ranks, special_tokens={})
    return tuple(library.encode_ordinary(text or "")), hashlib.sha256((text or "").encode()).hexdigest()


def test_stages(spark, frame, tmp_path):
    r = random.Random(12)
    stop = ["the", "of", "and", "in", "to", "a"]

    def prose(n):
        return " ".join(r.choice(stop) if r.random() < 0.4 else "".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(n))

    item = prose(40)
    texts = [prose(120) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", "short", None, "# " * 200, prose(60) + " " + item + " " + prose(60)]
    passage = prose(40)
    texts += [prose(60) + " " + passage + " " + prose(60) for _ in range(3)]
    docs = frame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        kept[name] = {x["doc_id"] for x in current.collect()}
        if name != "byte_bpe":
            assert current.columns == docs.columns
    assert kept["quality_rules"] == set(range(12)) | {12, 13, 17, 18, 19, 20}
    assert kept["jaccard_join"] == set(range(12)) | {17, 18, 19, 20}
    assert kept["suffix_dedup"] == kept["jaccard_join"] and kept["decontamination"] == kept["jaccard_join"] - {17} == kept["byte_bpe"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in final.collect()} == kept["byte_bpe"] and final.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    # the texts of the survivors, cut and encoded by plain versions
    survivors = [(i, texts[i]) for i in sorted(kept["jaccard_join"])]
    want = {(d, *tokens(t)) for d, t in without_repeats(survivors) if d != 17}
    assert any(t != texts[d] for d, t in without_repeats(survivors))
    assert {(x["doc_id"], tuple(x["ids"]), x["decoded_sha256"]) for x in final.collect()} == want
    assert all(x["n_tokens"] == len(x["ids"]) for x in final.collect())


def run_on(spark, frame, docs, items, path):
    docs.write.parquet(f"{path}/documents.parquet")
    frame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, path)


def test_empty_tables(spark, frame, no_docs, tmp_path):
    out = run_on(spark, frame, no_docs, [], str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() == 0


def test_odd_rows(spark, frame, edge_docs, edge_rows, tmp_path):
    """Nulls, repeated rows and ids, very long texts, columns of clashing names: each stage as its plain version says."""
    kept = quality_rules.quality_filter(edge_docs)
    good = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == edge_docs.columns and all(t for _, t in good)
    one = corpus_pipeline.near_duplicates(spark, kept, "")
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert one.columns == edge_docs.columns and len(set(left)) == len(left) and set(left) <= set(good)
    cut = corpus_pipeline.repeated_passages(spark, one, "")
    assert cut.columns == edge_docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter(without_repeats(left))
    out = run_on(spark, frame, edge_docs, [(1, None), (None, "x"), (2, "")], str(tmp_path))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == Counter((d, tokens(t)[0]) for d, t in without_repeats(left))


def test_repeated_rows_and_stage_folders(spark, frame, tmp_path):
    from loomcube.storage import shared_dir

    text = " ".join(f"the word{i} of text and" for i in range(30))
    rows = [(1, text, "en", "s", len(text))] * 3 + [(2, text + " more", "en", "s", 0), (None, text, "en", "s", None)]
    before = set(_folders(shared_dir(spark)))
    out = run_on(spark, frame, frame(rows, COLUMNS), [(1, "nothing like it in any text of this test")], str(tmp_path))
    assert [(r["doc_id"], r["n_tokens"]) for r in out.collect()] == [(1, len(tokens(text)[0]))]
    assert len([f for f in set(_folders(shared_dir(spark))) - before if f.startswith("pipeline-")]) == 1


def _folders(path):
    import os

    return os.listdir(path.removeprefix("file://"))
