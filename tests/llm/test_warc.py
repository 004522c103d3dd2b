import base64
import hashlib
from collections import Counter

from loomcube.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, kind string, file string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages():
    rows = [(i, f"http://h{i % 3}.com/{i}", t) for i, t in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "<p>é☃</p>\r\n\r\nx", "<p>a</p>"])]
    rows += [(6, "http://h0.com/6", "<p>a</p>"), (10, None, "only"), (11, "http://x/ a\nb", "z" * 300_000), (None, "http://n", "null id"), (12, "http://u1", "same"), (12, "http://u2", "same")]
    return [(*r, "d", "k", "f") for r in rows]


def test_round_trip(frame, tmp_path):
    root = f"file://{tmp_path}/archive"
    manifest = warc.write_archives(frame(pages(), SCHEMA).repartition(3), root, roll=400)
    listed = manifest.collect()
    assert {m["file"] for m in listed} == {p.name for p in tmp_path.glob("archive/*.warc.gz")} and len(listed) > 4
    for m in listed:
        data = (tmp_path / "archive" / m["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m["bytes"], m["sha256"])
    got = warc.read_archives(manifest, root).collect()
    assert all(r["intact"] for r in got) and not list(tmp_path.glob("archive/.shard*gz.????*"))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), b32(h)) for i, _, h, *_ in pages())
    best = {}
    for i, _, h, *_ in pages():
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    digests = {b32(h): (None if i < 0 else i) for h, i in best.items()}
    responses = Counter(r["payload_digest"] for r in got if r["record_type"] == "response")
    assert set(responses.values()) == {1} and set(responses) == set(digests)
    for r in got:
        assert (r["page_id"] if r["record_type"] == "response" else r["refers_to"]) == digests[r["payload_digest"]]
        assert (r["refers_to"] is None) == (r["record_type"] == "response")


def test_bytes_do_not_depend_on_partitions(frame, tmp_path):
    digests = []
    for n in (1, 4):
        root = f"file://{tmp_path}/a{n}"
        rows = warc.read_archives(warc.write_archives(frame(pages(), SCHEMA).repartition(n), root), root)
        digests.append(Counter(map(tuple, rows.collect())))
    assert digests[0] == digests[1]


def test_small_payloads_stay_responses(frame, tmp_path):
    got = warc.archive_pages(frame(pages(), SCHEMA), f"file://{tmp_path}/s", dedup_from=5).collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 5)


def test_empty(frame):
    assert warc.archive_pages(frame([], SCHEMA)).count() == 0


def test_torn_archives_are_noticed():
    import io
    import zlib

    import pytest

    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(warc.build_record(1, "http://a", b"x" * 1000, b32("x" * 1000), 0, None)) + packer.flush()
    assert len(list(warc.members(io.BytesIO(data + data)))) == 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(io.BytesIO(data + data[:-20])))
    assert len(list(warc.members(io.BytesIO(data), sha256=hashlib.sha256(data).hexdigest()))) == 1
    with pytest.raises(ValueError, match="the manifest names"):
        list(warc.members(io.BytesIO(data), sha256=hashlib.sha256(data + data).hexdigest()))


def test_files_of_failed_attempts_go(frame, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / ".shard-00000-00000.warc.gz.dead").write_bytes(b"half a record")
    warc.write_archives(frame(pages(), SCHEMA), f"file://{tmp_path}/w")
    assert not list(tmp_path.glob("w/.shard*dead"))
