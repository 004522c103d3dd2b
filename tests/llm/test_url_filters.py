import datetime as dt
import random
import re

from loomcube.llm import url_filters

ENTRY = "list_name string, kind string, pattern string, action string, entry_date date"
CAPTURE = "page_id long, url string, fetch_date date, host string, verdict string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def plain(url, when, entries):
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", url or "")
    host = re.sub(r"\.$", "", m[1].lower().rstrip(" ")) if m else ""
    best = None
    keys = {(e[0], e[1], e[2].lower()) for e in entries if e[2] and e[3] and e[4]}
    for name, kind, pattern in keys:
        if not host or not (host == pattern or host.endswith("." + pattern)) or when is None:
            continue
        past = [e for e in entries if (e[0], e[1], (e[2] or "").lower()) == (name, kind, pattern) and e[4] and e[4] <= when]
        if past:
            last = max(e[4] for e in past)
            if all(e[3] == "add" for e in past if e[4] == last):
                rank = (len(pattern), kind == "allow")
                best = max(best, (rank, name), key=lambda b: (b[0], [-ord(c) for c in b[1]])) if best else (rank, name)
    return (host, "unlisted", None) if best is None else (host, "allowed" if best[0][1] else "blocked", best[1])


def test_like_a_plain_version(frame):
    r = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "bb.org"]
    entries = [(r.choice("lm"), r.choice(["block", "allow"]), r.choice([*hosts, "A.com", None]), r.choice(["add", "remove"]), r.choice([day(r.randrange(30)), None])) for _ in range(60)]
    captures = [(i, r.choice([f"https://u:p@{h}:80/p?q=1", f"http://{h.upper()}./", f"http://{h}"]), day(r.randrange(-3, 40)), "h", "v") for i, h in enumerate(r.choices(hosts, k=200))]
    captures += [(900, None, day(3), None, None), (901, "http://a.com", None, None, None), (902, "nothing", day(3), None, None), (903, "http://[2001:DB8::1]:80/", day(3), None, None), (None, "http://a.com/", day(9), None, None), (0, *captures[0][1:])]
    got = sorted(((c["page_id"], c["host"], c["fetch_date"], c["verdict"], c["list_name"]) for c in url_filters.filter_urls(frame(captures, CAPTURE), frame(entries, ENTRY)).collect()), key=repr)
    want = sorted(((p, (b := plain(u, w, entries))[0], w, b[1], b[2]) for p, u, w, *_ in captures), key=repr)
    assert got == want


def test_empty(frame):
    none = frame([], ENTRY)
    captures = frame([(1, "http://a.com", day(1), None, None)], CAPTURE)
    assert url_filters.filter_urls(captures, none).first()["verdict"] == "unlisted"
    assert url_filters.filter_urls(frame([], CAPTURE), frame([("l", "block", "a.com", "add", day(1))], ENTRY)).count() == 0


def test_no_python(spark, frame):
    pages = frame([(1, "http://a.com", "")], "page_id long, url string, html string")
    plan = url_filters.filter_urls(url_filters.dated_captures(pages), url_filters.dated_entries(pages))._jdf.queryExecution().optimizedPlan().toString()
    subjects = frame([("a.com", day(1))], "host string, fetch_date date")
    parts = [url_filters.validity_intervals(url_filters.dated_entries(pages)), url_filters.host_verdicts(subjects, url_filters.validity_intervals(url_filters.dated_entries(pages)))]
    plans = [plan] + [p._jdf.queryExecution().optimizedPlan().toString() for p in parts]
    assert not re.search("Python|Pandas|Arrow", "".join(plans))
