"""Secret scans against a plain version of the base patterns and against stretches encoded in known places."""

import base64
import gzip
import hashlib
import json
import random
import re
import urllib.parse
import zlib

import pytest

from loomcube.llm import secrets

SECRET = "token=abcdEFGH12345678"
PLAIN = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def url(s):
    return "".join(f"%{b:02X}" for b in s.encode())


def b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


WRAPPED = {
    "url": url(SECRET),
    "url twice": urllib.parse.quote(url(SECRET), safe=""),
    "url of the sign": SECRET.replace("=", "%3d"),
    "unicode": json.dumps("é" + SECRET).replace("é", "")[1:-1].replace("=", "\\u003d"),
    "references": "".join(f"&#x{ord(c):x};" if i % 2 else f"&#{ord(c)};" for i, c in enumerate(SECRET)),
    "base64": b64(SECRET),
    "base64 for urls": base64.urlsafe_b64encode(("??>>" + SECRET + "~~").encode()).decode(),
    "base64 thrice": b64(b64(b64(SECRET))),
    "base64 of url": b64(url(SECRET)),
    "url of base64": url(b64(SECRET)),
    "gzip": b64(gzip.compress(SECRET.encode())),
    "zlib": b64(zlib.compress(b"words " * 50 + SECRET.encode())),
    "gzip of base64 of zlib": b64(gzip.compress(b64(zlib.compress(SECRET.encode())).encode())),
    "not aligned": "ab/" + b64(SECRET),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_secrets_are_found_in_their_place(name):
    before, after = "Grüße, ", ", the end"
    text = before + WRAPPED[name] + after
    base, found = secrets.scan(text)
    assert base == plain(text)
    added = set(found) - set(base)
    assert added and {kind for _, kind, _ in added} == {0}
    for start, _, end in added:
        assert len(before) <= start < end <= len(text) - len(after)
        assert end - start >= len(SECRET)


def test_positions_of_a_part_of_a_layer():
    inner = "x" * 9 + " " + SECRET + " yy"
    text = "é " + b64(inner)
    (start, _, end), = secrets.scan(text)[1]
    assert (start, end) == (2 + 10 // 3 * 4 + 10 % 3, 2 + 31 // 3 * 4 + 31 % 3 + 2)
    text = "a" + url("key? ") + SECRET + url("!")
    assert secrets.scan(text)[1] == [(16, 0, 16 + len(SECRET))]


def test_folded_base64_and_hex_and_access_keys():
    inner = "filler " * 20 + "AKIA" + "B7" * 8 + " " + "0123456789abcdef" * 2
    found = secrets.scan("mail\n" + base64.encodebytes(inner.encode()).decode())[1]
    assert [kind for _, kind, _ in found] == [1, 2]


def test_base_patterns_equal_the_plain_version_on_noise():
    r = random.Random(3)
    parts = ["token", "TOKEN", "Api_Key", "apikey", "secret", "pass", "word", "passwd", " ", ":", "=", '"', "'", "AKIA", "ABC123", "deadbeef", "0123", "zzz", "-", "ſecret", "toKen", "%41", "\\u0041", "\n", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        base, found = secrets.scan(text)
        assert base == plain(text)
        assert set(base) <= set(found) and found == sorted(set(found))


def test_a_cycle_ends():
    item = secrets.Item("0" * 20, range(20), range(1, 21), frozenset())
    again = next(secrets._child(item, "abc", range(3), range(3)))
    assert not list(secrets._child(again, "abc", range(3), range(3)))


def test_long_chains_and_packed_texts_stay_cheap():
    assert secrets.scan("%" + "25" * 200_000 + "41")[1]
    packed = b64(zlib.compress(b"words and more\n" * 2_000_000 + SECRET.encode()))
    (start, kind, end), = secrets.scan(packed)[1]
    assert (start, kind, end) == (0, 0, len(packed.rstrip("=")))


def test_query_on_edge_rows(edge_docs, edge_rows, no_docs):
    got = secrets.secret_digests(edge_docs).collect()
    want = []
    for d, text, *_ in edge_rows:
        base = plain(text)
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        want.append((d, *(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed, 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert secrets.find_secrets(no_docs).count() == 0


def test_query_keeps_base_counts_beside_added_spans(frame):
    docs = frame([(1, f"{SECRET} and {b64(SECRET)}"), (1, None), (None, url(SECRET))], "doc_id long, text string")
    got = {(r["doc_id"], r["n_assign"], r["n_added"]) for r in secrets.secret_digests(docs).collect()}
    assert got == {(1, 1, 1), (1, 0, 0), (None, 0, 1)}
