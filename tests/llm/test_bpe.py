import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from loomcube.llm import bpe

PATH, PATTERN = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    own = bpe.Codec(PATH, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.merges.ranks, special_tokens={})


def test_like_the_library(pair):
    own, library = pair
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "b", "the", "é", "1", "日本", "\t", "!", "ing", "aaaa", " \n", "\xa0", "'s", "\x1c", "\x85", "<|endoftext|>", "🎉", "​"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(50)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_long_pre_tokens(pair):
    own, library = pair
    r = random.Random(2)
    for text in ("".join(r.choice("abcdefghij") for _ in range(20_000)), "!?" * 5000, "ab" * 4000):
        assert own.encode(text) == library.encode_ordinary(text)


def test_full_caches_change_nothing(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    fresh = bpe.Codec(PATH, PATTERN)
    text = "some words of a text with many words of some kind, " * 20
    assert fresh.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("name, value", [("MATCHES", 7), ("BLOCK_CHARS", 40), ("SPELT", 5), ("CACHE_IDS", 20)])
def test_blocks_change_nothing(pair, monkeypatch, name, value):
    _, library = pair
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "the ", " of", "\n", "ing", "é", "!!", "  "]) for _ in range(r.randrange(60))) for _ in range(60)]
    monkeypatch.setattr(bpe, name, value)
    own = bpe.Codec(PATH, PATTERN)
    got = []
    for first, end, ids, bounds in own.blocks(pa.array([*texts, None, ""])):
        assert len(bounds) == end - first + 1
        coded = [bpe.sha256(x, 1) for x in own.decimal_of.each(ids, bounds)]
        decoded = [bpe.sha256(x) for x in own.bytes_of.each(ids, bounds)]
        got += [(ids[a:b].tolist(), c, d) for a, b, c, d in zip(bounds, bounds[1:], coded, decoded)]
    want = [(library.encode_ordinary(t), t) for t in [*texts, "", ""]]
    assert got == [(ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for ids, t in want]


@pytest.mark.parametrize("seed", range(6))
def test_many_pieces_at_once_under_any_ranks(seed):
    """Ranks in random order: lower ones come up in the middle of a bucket."""
    r = random.Random(seed)
    longer = sorted({bytes(r.choice(b"abc") for _ in range(r.randrange(2, 7))) for _ in range(150)})
    singles = [bytes([b]) for b in range(256)]
    r.shuffle(longer)
    ranks = {t: i for i, t in enumerate(longer + singles if seed % 2 else singles + longer)}
    pieces = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 60))) for _ in range(400)] + [b"ab" * 500, b"a" * 777]
    ids, bounds = bpe.Merges(ranks).all(pieces)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain_merge(p, ranks) for p in pieces]
    assert [bpe.merge(p, ranks) for p in pieces] == [plain_merge(p, ranks) for p in pieces]


def plain_merge(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        near = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not near:
            return [ranks[p] for p in parts]
        _, i = min(near)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_queue_finds_the_lowest_rank():
    q, r = bpe.RankQueue(), random.Random(3)
    want = []
    for _ in range(500):
        rank, at = r.randrange(60_000), r.randrange(1000)
        q.push(rank, at)
        want.append((rank, at))
    got = []
    while (rank := q.lowest()) >= 0:
        got += [(rank, at) for at in sorted(q.take(rank))]
    assert got == sorted(want)


def test_documents(pair, edge_docs, edge_rows, no_docs):
    _, library = pair

    def want(t):
        ids = library.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = bpe.token_digests(edge_docs, PATH, PATTERN).collect()
    assert Counter(map(tuple, got)) == Counter((d, *want(t)) for d, t, *_ in edge_rows)
    assert bpe.token_digests(no_docs, PATH, PATTERN).count() == 0
    ids = bpe.encode_documents(edge_docs, PATH, PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids) == Counter((d, tuple(library.encode_ordinary(t or ""))) for d, t, *_ in edge_rows)
