"""Queries of the cube and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcube.operators import cube, rank, score
from loomcube.plans import tables as t

WITH = f"WITH {t.OBS_SQL}"
SCORED = f"{WITH}, {t.score_sql()}"


def _scores(spark, d):
    return score.score(t.observations(spark, d))


def _measure(name):
    return lambda spark, d: score.rounded(_scores(spark, d).select("category", "entity", name))


def _core_obs(spark, d):
    lines, part = t.table(spark, d, "lineitem"), t.table(spark, d, "part")
    doc = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("entity")).agg(F.count("*").alias("cnt"))
    core = part.filter("p_size <= 10").select(F.col("p_type").alias("entity")).distinct().filter("entity <> 'PROMO'")
    return score.rounded(score.score_core(cube.observations(t.category_documents(spark, d), doc), core).select("category", "entity", "tf", "df", "pop", "dist", "score"))


def _year(spark, d):
    docs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))
    kept = cube.relevant_documents(docs, t.category_documents(spark, d), 1996, 1998).select("doc_id")
    own = t.category_documents(spark, d).join(kept, "doc_id", "left_semi")
    return score.rounded(score.score(cube.observations(own, t.document_entities(spark, d))).select("category", "entity", "tf", "df", "score"))


def _pivot(spark, d):
    cats = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return score.rounded(score.wide(_scores(spark, d), "score", cats))


def _found(spark, d):
    part = t.table(spark, d, "part")
    lines = t.table(spark, d, "lineitem").filter("l_quantity >= 50")
    return cube.found_proportion(part.select(F.col("p_partkey").alias("entity")), lines.select(F.col("l_partkey").alias("entity")))


def _rank(spark, d):
    return score.rounded(rank.ranked(score.rounded(rank.with_total(_scores(spark, d), "score")), "category", "score", "entity"))


def _top(spark, d):
    return score.rounded(rank.top_per_group(score.rounded(_scores(spark, d).select("category", "entity", "score")), "category", "score", "entity", 3))


def _top_rows(spark, d):
    cats = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return score.rounded(rank.top_rows(score.rounded(score.wide(_scores(spark, d), "score", cats)), "entity", cats, 5).select("entity", "value"), 6)


QUERIES = {
    "cube_score": lambda s, d: score.rounded(_scores(s, d).select("category", "entity", "tf", "df", "pop", "ntf", "ndf", "dist", "score")),
    "cube_obs": t.observations,
    "cube_tf_df": lambda s, d: cube.tf_df(t.observations(s, d)),
    "cube_dense_grid": lambda s, d: cube.dense_grid(cube.tf_df(t.observations(s, d))),
    "cube_popularity": _measure("pop"),
    "cube_ntf": _measure("ntf"),
    "cube_ndf": _measure("ndf"),
    "cube_ratio": _measure("ratio"),
    "cube_distinctiveness": _measure("dist"),
    "cube_score_core": _core_obs,
    "cube_score_year_range": _year,
    "score_pivot": _pivot,
    "docs_per_category": lambda s, d: cube.documents_per_category(t.category_documents(s, d)),
    "entities_per_category": lambda s, d: cube.entities_per_category(t.observations(s, d)),
    "found_proportion": _found,
    "rank_entities": _rank,
    "top_entities": _top,
    "top_rows_by_mean": _top_rows,
}


def _one(name):
    return f"{SCORED} SELECT category, entity, round({name}, 9) AS {name} FROM s"


_CORE_OBS = """obs AS (SELECT c_mktsegment AS category, l_orderkey AS doc_id, p_type AS entity, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE p_type IN (SELECT p_type FROM part WHERE p_size <= 10) AND p_type <> 'PROMO' GROUP BY ALL)"""
_YEAR_OBS = t.OBS_SQL.replace("GROUP BY ALL", "WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL")
_CATS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_WIDE = ", ".join(f"max(CASE WHEN category = '{c}' THEN round(score, 9) END) AS {c}" for c in _CATS)

SQL = {
    "cube_score": f"{SCORED} SELECT category, entity, tf, df, round(pop, 9) AS pop, round(ntf, 9) AS ntf, round(ndf, 9) AS ndf, round(dist, 9) AS dist, round(score, 9) AS score FROM s",
    "cube_obs": f"{WITH} SELECT * FROM obs",
    "cube_tf_df": f"{SCORED} SELECT category, entity, tf, df FROM cells",
    "cube_dense_grid": f"{SCORED} SELECT category, entity, tf, df FROM grid",
    "cube_popularity": _one("pop"),
    "cube_ntf": _one("ntf"),
    "cube_ndf": _one("ndf"),
    "cube_ratio": _one("ratio"),
    "cube_distinctiveness": _one("dist"),
    "cube_score_core": f"WITH {_CORE_OBS}, {t.score_sql()} SELECT category, entity, tf, df, round(pop, 9) AS pop, round(dist, 9) AS dist, round(score, 9) AS score FROM s",
    "cube_score_year_range": f"WITH {_YEAR_OBS}, {t.score_sql()} SELECT category, entity, tf, df, round(score, 9) AS score FROM s",
    "score_pivot": f"{SCORED} SELECT entity, {_WIDE} FROM s GROUP BY entity",
    "docs_per_category": "WITH c AS (SELECT c_mktsegment AS category, o_orderkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey) SELECT category, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY category UNION ALL SELECT 'TOTAL', count(DISTINCT doc_id) FROM c",
    "entities_per_category": f"{WITH} SELECT category, count(DISTINCT entity) AS n_entities FROM obs GROUP BY category UNION ALL SELECT 'TOTAL', count(DISTINCT entity) FROM obs",
    "found_proportion": "SELECT count(*) AS n_searched, count(f.k) AS n_found, round(count(f.k) / count(*), 9) AS share FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 50) f ON f.k = p_partkey",
    "rank_entities": f"{SCORED}, z AS (SELECT category, entity, round(score, 9) AS score FROM s UNION ALL SELECT 'TOTAL', entity, round(sum(score), 9) FROM s GROUP BY entity) SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, entity) AS position FROM z",
    "top_entities": f"{SCORED}, z AS (SELECT category, entity, round(score, 9) AS score, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, entity) AS position FROM s) SELECT * FROM z WHERE position <= 3",
    "top_rows_by_mean": f"{SCORED} SELECT entity, round(avg(round(score, 9)), 6) AS value FROM s GROUP BY entity ORDER BY avg(round(score, 9)) DESC, entity LIMIT 5",
}
