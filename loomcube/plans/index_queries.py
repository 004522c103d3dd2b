"""Queries of the positional index: phrases of the benchmark in the fields of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomcube.functions import text as x
from loomcube.operators import phrase_index as p
from loomcube.plans import tables as t
from loomcube.plans.text_queries import _LINES, _NORM, _articles
from loomcube.storage import shared_dir

ANALYZER = p.Analyzer(pattern=p.SIMPLE)


def _index(spark, d):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    p.build(_articles(spark, d), path, ("title", "abstract", "full_text", "introduction", "results", "discussion"), ANALYZER, buckets=16, spread=2)
    return path


def _triples(spark, d):
    """Every three words in a row of the benchmark."""
    words = F.regexp_extract_all("text", F.lit(p.SIMPLE), 0)
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " ")))
    return t.table(spark, d, "benchmark").filter(F.size(words) > 2).select(each.alias("phrase")).distinct()


def _hits(mode):
    return lambda spark, d: p.find_phrases(_triples(spark, d), _index(spark, d), x.FIELDS[mode], ANALYZER)


def _retrieved(spark, d):
    synonyms = t.literal(spark, t.LEXICON, "entity, synonym")
    return p.count_retrieved(_articles(spark, d), synonyms, _index(spark, d), x.FIELDS["full_text"], ANALYZER)


QUERIES = {
    "phrase_hits_abstract": _hits("abstract"),
    "phrase_hits_full_text": _hits("full_text"),
    "phrase_hits_no_methods": _hits("full_text_no_methods"),
    "phrase_retrieved_counts": _retrieved,
}

_PLACE = {"title": f"{_LINES}[1]", "abstract": f"{_LINES}[2]", "introduction": f"{_LINES}[3]", "results": f"{_LINES}[4]", "discussion": f"{_LINES}[5]", "full_text": "text"}
_STOP = ", ".join(f"'{w}'" for w in p.STOP_WORDS)


def _tokens_sql(name, source):
    """Tokens and positions of ``id, f, s`` of a table, without stop words."""
    return f"{name} AS (SELECT id, f, w, i FROM (SELECT id, f, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT id, f, regexp_extract_all(s, '{p.SIMPLE}') AS ws FROM {source})) WHERE w NOT IN ({_STOP}))"


def _found_sql(mode, phrases):
    fields = " UNION ALL ".join(f"SELECT doc_id AS id, '{f}' AS f, coalesce({_PLACE[f]}, '') AS s FROM documents" for f in x.FIELDS[mode])
    return f"""WITH fs AS ({fields}), {_tokens_sql("tk", "fs")}, {phrases}, {_tokens_sql("pk", "(SELECT phrase AS id, '' AS f, phrase AS s FROM ph)")},
pn AS (SELECT id, count(*) AS k FROM pk GROUP BY id),
pl AS (SELECT pk.id AS phrase, tk.id AS doc_id, tk.f, tk.i - pk.i AS start, count(*) AS c FROM tk JOIN pk ON tk.w = pk.w GROUP BY ALL),
hit AS (SELECT phrase, doc_id, count(*) AS n FROM pl JOIN pn ON pn.id = pl.phrase AND pn.k = pl.c GROUP BY ALL)"""


_TRIPLES = f"bw AS (SELECT regexp_extract_all(text, '{p.SIMPLE}') AS ws FROM benchmark), ph AS (SELECT DISTINCT array_to_string(ws[i:i + 2], ' ') AS phrase FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM bw))"
_FULL = " + ".join(f"CAST((length({s}) - length(replace({s}, synonym, ''))) / length(synonym) AS BIGINT)" for s in (_NORM.format(f"coalesce({_PLACE[f]}, '')") for f in x.FIELDS["full_text"]))

SQL = {
    **{f"phrase_hits_{n}": f"{_found_sql(m, _TRIPLES)} SELECT * FROM hit" for n, m in (("abstract", "abstract"), ("full_text", "full_text"), ("no_methods", "full_text_no_methods"))},
    "phrase_retrieved_counts": f"""{_found_sql("full_text", f"ph AS (SELECT DISTINCT synonym AS phrase FROM {t.values_sql(t.LEXICON, 'entity, synonym')})")},
us AS (SELECT DISTINCT doc_id, {_NORM.format("phrase || ' '")} AS synonym FROM hit),
ct AS (SELECT doc_id, synonym, {_FULL} AS cnt FROM us JOIN documents USING (doc_id)) SELECT * FROM ct WHERE cnt > 0""",
}
