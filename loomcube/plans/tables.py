"""The star tables seen as a text cube, hierarchy, entity sets and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.operators import cube
from loomcube.operators.shared import linked_members, shared_groups

#: The lexicon of the text queries (entity, synonym); one synonym is shared, one nested, one hyphenated.
LEXICON = [
    ("e_article", "the"), ("e_article", "die"), ("e_article", "les"), ("e_and", "and"), ("e_and", "und"), ("e_and", "et"),
    ("e_of", "of"), ("e_of", "de"), ("e_suffix", "tion"), ("e_suffix", "ation"), ("e_suffix", "the"), ("e_code", "e-mail"), ("e_code", "end-of"),
]
#: Synonyms of the categories of label imputation.
CATEGORY_SYNONYMS = [
    ("en", "the"), ("en", "and"), ("en", "that"), ("en", "with"), ("de", "und"), ("de", "der"), ("de", "nicht"),
    ("fr", "les"), ("fr", "des"), ("fr", "une"), ("fr", "qui"), ("es", "que"), ("es", "para"), ("es", "los"), ("es", "con"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table from literals, without a Python worker."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def values_sql(rows: list[tuple], names: str) -> str:
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {values}) AS t({names}))"


def category_documents(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.select(F.col("c_mktsegment").alias("category"), F.col("o_orderkey").alias("doc_id"))


def document_entities(spark: SparkSession, d: str) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return joined.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("entity")).agg(F.count("*").alias("cnt"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    return cube.observations(category_documents(spark, d), document_entities(spark, d))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """``code, name``: region, nation and customer as dotted codes."""
    r, n, c = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    region = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    nation = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(".N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    customer = F.concat(nation, F.lit(".C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    regions = r.select(region.alias("code"), F.col("r_name").alias("name"))
    nations = n.select(nation.alias("code"), F.col("n_name").alias("name"))
    customers = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(customer.alias("code"), F.col("c_name").alias("name"))
    return regions.unionByName(nations).unionByName(customers)


TREE_SQL = """tree AS (SELECT 'R' || r_regionkey AS code, r_name AS name FROM region
 UNION ALL SELECT 'R' || n_regionkey || '.N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), n_name FROM nation
 UNION ALL SELECT 'R' || n_regionkey || '.N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), c_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
edges AS (SELECT DISTINCT regexp_replace(code, '[.][^.]*$', '') AS parent, code AS child FROM tree WHERE contains(code, '.'))"""

OBS_SQL = """obs AS (SELECT c_mktsegment AS category, l_orderkey AS doc_id, p_brand AS entity, count(*) AS cnt FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def score_sql(obs: str = "obs") -> str:
    """Common table expressions from ``obs`` to ``s`` with all measures."""
    return f"""cells AS (SELECT category, entity, CAST(sum(cnt) AS BIGINT) AS tf, count(doc_id) AS df FROM {obs} GROUP BY ALL),
grid AS (SELECT c.category, e.entity, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df FROM (SELECT DISTINCT category FROM {obs}) c
 CROSS JOIN (SELECT DISTINCT entity FROM {obs}) e LEFT JOIN cells ON cells.category = c.category AND cells.entity = e.entity),
m AS (SELECT *, sum(tf) OVER w AS total, count(*) FILTER (tf > 0) OVER w AS ne, max(df) OVER w AS mx FROM grid WINDOW w AS (PARTITION BY category)),
x AS (SELECT category, entity, tf, df, ln(tf + 1) / nullif(ln(nullif(total, 0)), 0) AS pop,
 tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * ne)) AS ntf, CASE WHEN df = 0 THEN 0e0 ELSE ln(df + 1) / ln(mx + 1) END AS ndf FROM m),
r AS (SELECT *, ntf * ndf AS ratio FROM x),
s AS (SELECT *, pop * dist AS score FROM (SELECT *, (exp(ratio) - 1) / (1 + sum(exp(ratio)) OVER (PARTITION BY entity)) AS dist FROM r))"""


def pathway_members(spark: SparkSession, d: str) -> DataFrame:
    """``pathway, entity``: parts by type and size."""
    name = F.concat("p_type", F.lit("#"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(name.alias("pathway"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"))


MEMBERS_SQL = "members AS (SELECT p_type || '#' || p_size AS pathway, 'P' || p_partkey AS entity FROM part)"


def core_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size <= 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"))


CORE_SQL = "core AS (SELECT 'P' || p_partkey AS entity FROM part WHERE p_size <= 10)"


def supplier_graph(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, score``: suppliers by the parts they share over the most that any two share."""
    both = shared_groups(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")
    most = both.agg(F.max("n").alias("most")).first()["most"]
    a, b = (F.concat(F.lit("S"), F.col(c).cast("string")) for c in ("a", "b"))
    return both.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), (F.col("n") / F.lit(most).cast("long")).alias("score"))


def linked_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """``l_suppkey, node`` of the suppliers in the graph, without its edges."""
    members = linked_members(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    return members.select("l_suppkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node"))


SUPPLIER_GRAPH_SQL = """own AS (SELECT DISTINCT l_partkey AS part, 'S' || l_suppkey AS s FROM lineitem),
shared AS (SELECT a.s AS src, b.s AS dst, count(*) AS n FROM own a JOIN own b ON a.part = b.part AND a.s < b.s GROUP BY ALL),
graph AS (SELECT src, dst, n / (SELECT max(n) FROM shared) AS score FROM shared)"""


def core_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").filter("s_acctbal > 9800").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"))


def text_cat_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("category"), "doc_id")
