"""Queries of a cube that follows updates of its documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomcube.functions.text import run_starts, runs
from loomcube.operators.phrase_index import SIMPLE
from loomcube.plans import tables as t
from loomcube.sources.keyed import IncrementalCube
from loomcube.storage import shared_dir


def _observe(docs):
    """Words of a document as its entities, its language as its category; words are counted in the row of their text."""
    words = docs.select("doc_id", F.col("lang").alias("category"), F.sort_array(F.regexp_extract_all("text", F.lit(SIMPLE), 0)).alias("words"))
    count = lambda a, n: F.struct(F.get("words", a).alias("entity"), n.cast("long").alias("cnt"))
    each = words.withColumn("starts", run_starts("words")).select("category", "doc_id", F.explode(runs("words", "starts", count)).alias("w"))
    return each.select("category", "doc_id", "w.entity", "w.cnt")


def _cube(spark, d):
    """Documents but those of one source, and three updates: other languages; new documents and old versions; longer texts."""
    docs = t.table(spark, d, "documents").select("doc_id", "lang", "text", "source", "n_chars")
    base = lambda rows, v: rows.select("doc_id", F.lit(v).cast("long").alias("version"), "lang", "text")
    cube = IncrementalCube(f"{shared_dir(spark)}/cube-{uuid.uuid4().hex}", base(docs.filter("source <> 'src3'"), 1), _observe, buckets=16)
    cube.update(base(docs.filter("source IN ('src1', 'src2')").withColumn("lang", F.lit("other")), 2))
    cube.update(base(docs.filter("source = 'src3'"), 1).unionByName(base(docs.filter("source = 'src2'"), 0)))
    cube.update(base(docs.filter("lang = 'de' AND n_chars > 1000").withColumn("text", F.concat("text", F.lit(" ergänzt"))), 4))
    return cube


QUERIES = {
    "cube_after_updates": lambda s, d: _cube(s, d).frequencies(),
    "cube_documents_after_updates": lambda s, d: _cube(s, d).documents_per_category(),
}

_LAST = f"""WITH v AS (SELECT doc_id, 1 AS version, lang, text FROM documents WHERE source IS NOT NULL
 UNION ALL SELECT doc_id, 2, 'other', text FROM documents WHERE source IN ('src1', 'src2')
 UNION ALL SELECT doc_id, 4, lang, text || ' ergänzt' FROM documents WHERE lang = 'de' AND n_chars > 1000),
l AS (SELECT doc_id, arg_max(lang, version) AS category, arg_max(text, version) AS text FROM v GROUP BY doc_id),
w AS (SELECT doc_id, category, unnest(regexp_extract_all(text, '{SIMPLE}')) AS entity FROM l)"""
SQL = {
    "cube_after_updates": f"{_LAST} SELECT category, entity, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY ALL",
    "cube_documents_after_updates": f"{_LAST} SELECT category, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY ALL",
}
