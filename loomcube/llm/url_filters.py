"""URL filters as a temporal list join: dated list entries become validity intervals, joined as of the fetch date.

Everything is DataFrame or SQL operations. Captures are reduced to distinct pairs of host and fetch date before
anything is joined, so a host with a third of all captures adds a row a day at most; only one verdict per pair
goes back to the captures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcube.llm.common import checked_broadcast, materialise

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"

#: Fixed dated entries of the query: list, kind, host or parent domain, action, date.
FIXED_ENTRIES = [
    ("adult", "block", "adult-x.example.com", "add", "2024-01-01"),
    ("spam", "block", "cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", "block", "cheap-pills.example.com", "remove", "2024-06-01"),
    ("spam", "block", "cheap-pills.example.com", "add", "2024-09-01"),
    ("trusted", "allow", "example.org", "add", "2025-01-01"),
    ("trusted", "allow", "example.org", "remove", "2025-03-01"),
]


def with_host(captures: DataFrame) -> DataFrame:
    """Adds ``host``: lower case, without user, port or final dot, an IPv6 address in brackets; empty for a URL without one."""
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), _HOST, 1)))
    return captures.withColumn("host", F.regexp_replace(host, r"\.$", ""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list_name, kind, pattern, valid_from, valid_to`` of dated ``add`` and ``remove`` entries.

    An entry holds from its date until the next entry of the same list and pattern (null: still). Several entries
    of one date count once, a removal outweighing an addition; this also bounds a pattern's rows by its dates.
    Repeated additions continue an interval. Entries with a null in pattern, action or date are void.
    """
    days = (
        entries.filter("pattern IS NOT NULL AND action IN ('add', 'remove') AND entry_date IS NOT NULL")
        .groupBy("list_name", "kind", F.lower("pattern").alias("pattern"), "entry_date")
        .agg(F.min(F.col("action") == "add").alias("active"))
    )
    own = Window.partitionBy("list_name", "kind", "pattern").orderBy("entry_date")
    changes = days.withColumn("was", F.lag("active").over(own)).filter("active IS DISTINCT FROM coalesce(was, false)")
    spans = changes.withColumn("valid_to", F.lead("entry_date").over(own)).filter("active")
    return spans.select("list_name", "kind", "pattern", F.col("entry_date").alias("valid_from"), "valid_to")


def host_verdicts(subjects: DataFrame, intervals: DataFrame) -> DataFrame:
    """The deciding active entry of each ``host, fetch_date``; pairs without one are absent.

    An entry applies to its host and all hosts below it. The longest pattern decides; among equal ones an allowing
    list outweighs a blocking one, then the first list by name.
    """
    labels = F.split("host", r"\.")
    tails = subjects.filter("host <> ''").select(
        "host", "fetch_date",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )).alias("pattern"),
    )
    # most tails name no entry; those that many hosts share, like a top-level domain, need not be gathered for that
    tails = tails.join(checked_broadcast(intervals.select("pattern").distinct()), "pattern", "left_semi")
    active = tails.join(intervals, "pattern").filter("valid_from <= fetch_date AND (valid_to IS NULL OR fetch_date < valid_to)")
    best = active.groupBy("host", "fetch_date", F.length("pattern").alias("size"), (F.col("kind") == "allow").alias("allow")).agg(
        F.min(F.struct("list_name", "pattern", "valid_from")).alias("entry")
    )
    rank = F.struct("size", "allow", "entry")
    return best.groupBy("host", "fetch_date").agg(F.max(rank).alias("best")).select("host", "fetch_date", "best.allow", "best.entry.*")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, host, fetch_date, verdict, list_name, pattern, valid_from`` of every capture.

    ``verdict`` is ``blocked``, ``allowed`` or ``unlisted``; a null URL or date is unlisted. Repeated captures give
    repeated rows; empty lists leave all captures unlisted. Other columns are ignored.
    """
    own = with_host(captures.select("page_id", "url", "fetch_date")).drop("url")
    subjects = own.select("host", "fetch_date").distinct()
    # both are written: intervals are read twice, and verdicts as a plain table let a hot pair be split when joined
    verdicts = materialise(host_verdicts(subjects, materialise(validity_intervals(entries), "url-intervals")), "url-verdicts")
    joined = own.join(verdicts, ["host", "fetch_date"], "left")
    verdict = F.when(F.col("pattern").isNull(), "unlisted").when(F.col("allow"), "allowed").otherwise("blocked")
    return joined.select("page_id", "host", "fetch_date", verdict.alias("verdict"), "list_name", "pattern", "valid_from")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch date. The table has none: day ``page_id mod 730`` from 2024-01-01 stands in."""
    day = F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 730) AS int))")
    return pages.select("page_id", "url", day.alias("fetch_date"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries for the query: the fixed ones, and dated ones for a hashed part of the hosts of ``pages``.

    The number taken from a host's MD5 says which lists name it, on which dates and whether as itself or by its
    parent domain, so the lists grow with the hosts.
    """
    spark = pages.sparkSession
    hosts = with_host(pages.select("url")).filter("host <> ''").select("host").distinct()
    hosts = hosts.withColumn("m", F.expr("cast(conv(substr(md5(host), 1, 6), 16, 10) AS int)"))
    start, parent = "date'2024-01-01'", "regexp_replace(host, '^[^.]+[.]', '')"
    hashed = hosts.selectExpr(
        f"""stack(6,
            m % 3 = 0, 'ads', 'block', host, 'add', date_add({start}, m % 400),
            m % 3 = 0, 'ads', 'block', host, 'remove', date_add({start}, m % 400 + 90 + m % 100),
            m % 6 = 0, 'ads', 'block', host, 'add', date_add({start}, m % 400 + 300),
            m % 5 = 1, 'spam', 'block', {parent}, 'add', date_add({start}, m % 500),
            m % 10 = 1, 'spam', 'block', {parent}, 'remove', date_add({start}, m % 500 + 60),
            m % 7 = 2, 'trusted', 'allow', host, 'add', date_add({start}, m % 300)
        ) AS (used, list_name, kind, pattern, action, entry_date)"""
    ).filter("used").drop("used")
    fixed = ", ".join(f"('{a}', '{b}', '{c}', '{d}', date'{e}')" for a, b, c, d, e in FIXED_ENTRIES)
    return hashed.unionByName(spark.sql(f"SELECT * FROM VALUES {fixed} AS t(list_name, kind, pattern, action, entry_date)"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = filter_urls(dated_captures(pages), dated_entries(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetch_date", "valid_from")})


def _duck_sql() -> str:
    fixed = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in FIXED_ENTRIES)
    at = "DATE '2024-01-01' + CAST({} AS INTEGER)"
    rows = [
        ("m % 3 = 0", "ads", "block", "host", "add", "m % 400"), ("m % 3 = 0", "ads", "block", "host", "remove", "m % 400 + 90 + m % 100"),
        ("m % 6 = 0", "ads", "block", "host", "add", "m % 400 + 300"), ("m % 5 = 1", "spam", "block", "up", "add", "m % 500"),
        ("m % 10 = 1", "spam", "block", "up", "remove", "m % 500 + 60"), ("m % 7 = 2", "trusted", "allow", "host", "add", "m % 300"),
    ]
    hashed = " UNION ALL ".join(f"SELECT '{a}' AS list_name, '{k}' AS kind, {p} AS pattern, '{x}' AS action, {at.format(d)} AS entry_date FROM h WHERE {w}" for w, a, k, p, x, d in rows)
    return f"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '{_HOST}', 1)), '\\.$', '') AS host,
  DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS fetch_date FROM pages),
h AS (SELECT host, regexp_replace(host, '^[^.]+[.]', '') AS up, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS m
  FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
e AS ({hashed} UNION ALL SELECT * FROM (VALUES {fixed}) AS t(list_name, kind, pattern, action, entry_date)),
d AS (SELECT list_name, kind, pattern, entry_date, bool_and(action = 'add') AS active FROM e GROUP BY ALL),
v AS (SELECT *, lead(entry_date) OVER (PARTITION BY list_name, kind, pattern ORDER BY entry_date) AS valid_to
  FROM (SELECT *, lag(active) OVER (PARTITION BY list_name, kind, pattern ORDER BY entry_date) AS was FROM d)
  WHERE active IS DISTINCT FROM coalesce(was, false)),
r AS (SELECT p.page_id, p.host, p.fetch_date, v.list_name, v.kind, v.pattern, v.entry_date AS valid_from,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.pattern) DESC, v.kind, v.list_name, v.pattern) AS k
  FROM p JOIN v ON v.active AND v.entry_date <= p.fetch_date AND (v.valid_to IS NULL OR p.fetch_date < v.valid_to)
   AND (p.host = v.pattern OR p.host LIKE '%.' || v.pattern))
SELECT p.page_id, p.host, CAST(p.fetch_date AS VARCHAR) AS fetch_date, CASE WHEN r.page_id IS NULL THEN 'unlisted' WHEN r.kind = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict,
  r.list_name, r.pattern, CAST(r.valid_from AS VARCHAR) AS valid_from FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.k = 1"""


ORACLE_SQL = _duck_sql()
