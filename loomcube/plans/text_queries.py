"""Queries over texts: synonym counts, variants, screening, sections, label imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcube.functions import text as x
from loomcube.operators import cube, impute, rank, score
from loomcube.plans import tables as t

_LEX = f"lex AS {t.values_sql(t.LEXICON, 'entity, synonym')}"
_NORM = "trim(replace(replace(replace({}, '- ', chr(1)), '-', ' '), chr(1), '- '))"
_COUNTS = f"""{_LEX}, dd AS (SELECT doc_id, lang, {_NORM.format("coalesce(text, '')")} AS t FROM documents),
ss AS (SELECT DISTINCT {_NORM.format("synonym || ' '")} AS synonym FROM lex),
ls AS (SELECT DISTINCT entity, {_NORM.format("synonym || ' '")} AS synonym FROM lex),
cc AS (SELECT doc_id, synonym, CAST((length(t) - length(replace(t, synonym, ''))) / length(synonym) AS BIGINT) AS cnt FROM dd, ss WHERE contains(t, synonym)),
ec AS (SELECT doc_id, entity, CAST(sum(cnt) AS BIGINT) AS cnt FROM cc JOIN ls USING (synonym) GROUP BY ALL)"""
_LINES = "string_split(coalesce(text, ''), chr(10))"


def _mode_sql(*fields):
    """Counts of each field by itself; a number takes a line of the text, else the whole."""
    parts = [_NORM.format(f"coalesce({_LINES}[{f}], '')" if isinstance(f, int) else "coalesce(text, '')") for f in fields]
    times = " + ".join(f"CAST((length({p}) - length(replace({p}, synonym, ''))) / length(synonym) AS BIGINT)" for p in parts)
    return f"""WITH {_LEX}, ss AS (SELECT DISTINCT {_NORM.format("synonym || ' '")} AS synonym FROM lex),
cc AS (SELECT doc_id, synonym, {times} AS cnt FROM documents, ss) SELECT * FROM cc WHERE cnt > 0"""


_TOTALS = "tt AS (SELECT lang AS category, synonym, CAST(sum(cnt) AS BIGINT) AS cnt FROM cc JOIN documents USING (doc_id) GROUP BY ALL UNION ALL SELECT 'TOTAL', synonym, CAST(sum(cnt) AS BIGINT) FROM cc GROUP BY ALL)"


def _lexicon(spark):
    return t.literal(spark, t.LEXICON, "entity, synonym").select("entity", x.normalise_synonym(F.col("synonym")).alias("synonym"))


def _counts(spark, d):
    return x.count_synonyms(t.table(spark, d, "documents"), t.literal(spark, t.LEXICON, "entity, synonym"))


def _articles(spark, d):
    """Documents as articles: the first line is the title, the second the abstract, the next three the sections."""
    line = F.split("text", "\n")
    parts = {name: F.get(line, F.lit(i)) for i, name in enumerate(("title", "abstract", "introduction", "results", "discussion"))}
    return t.table(spark, d, "documents").select("doc_id", F.col("text").alias("full_text"), *(c.alias(n) for n, c in parts.items()))


def _mode_counts(mode):
    return lambda spark, d: x.count_synonyms(_articles(spark, d), t.literal(spark, t.LEXICON, "entity, synonym"), text_columns=x.FIELDS[mode])


def _wide_lexicon(spark, d):
    """Beginnings of the benchmark's words: more synonyms than one projection takes."""
    words = t.table(spark, d, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).filter("length(w) > 5")
    return x.count_synonyms(t.table(spark, d, "documents"), words.select(F.left("w", F.lit(6)).alias("synonym")))


def _entities(spark, d):
    return cube.entity_counts(_counts(spark, d), _lexicon(spark))


def _removed(spark, d):
    removed = t.literal(spark, [("the",), ("tion",)], "synonym")
    return cube.entity_counts(_counts(spark, d), _lexicon(spark), removed)


def _hyphens(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", x.normalise_hyphens(F.col("text")).alias("n"))
    return docs.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("n_chars"))


def _entity_lists(spark, d):
    own = _counts(spark, d).join(t.text_cat_docs(spark, d), "doc_id").join(_lexicon(spark).distinct(), "synonym")
    return rank.entity_synonym_list(own.groupBy("category", "entity", "synonym").agg(F.sum("cnt").alias("cnt")))


def _variants(spark, d):
    names = t.table(spark, d, "part").select("p_name").distinct()
    return x.vary_case(names.select(F.col("p_name").alias("name")), "name")


def _species(spark, d):
    names = t.table(spark, d, "part").select(F.regexp_replace("p_name", "widget|ring", "mouse").alias("name")).distinct()
    return names.select("name", x.without_species(F.col("name")).alias("short")).filter("short IS NOT NULL")


def _words(spark, d):
    return t.table(spark, d, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("synonym")).filter("synonym <> ''").distinct()


def _short(spark, d):
    return _words(spark, d).filter(x.is_short(F.col("synonym")))


def _screen(spark, d):
    lexicon = t.literal(spark, [("the",), ("and",), ("with",), ("that",), ("for",), ("und",)], "word")
    return x.screen_synonyms(_words(spark, d), lexicon)


def _permutations(spark, d):
    names = t.table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(", "), "p_type").alias("term")).distinct()
    return x.permute_commas(names, "term")


def _doc_terms(spark, d):
    docs = t.table(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.array("lang", "source")).alias("term"))


def _sources(spark, d):
    """Categories by source: cat_a holds src0 and src1, and so on."""
    return t.literal(spark, [(f"cat_{'abcde'[i // 4]}", f"src{i}") for i in range(20)], "category, term")


def _imputable(spark, d):
    docs, labels = t.table(spark, d, "documents"), t.table(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    title = F.substring_index("text", "\n", 1)
    split = docs.select("doc_id", "lang", title.alias("title"), F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("abstract"))
    terms = F.when(F.col("known"), F.array("lang")).otherwise(F.array().cast("array<string>"))
    return split.join(labels, "doc_id", "left").withColumn("terms", terms).drop("known")


def _impute(spark, d, mode="unlabelled", **how):
    synonyms = t.literal(spark, t.CATEGORY_SYNONYMS, "category, synonym")
    return impute.impute(impute.select_mode(_imputable(spark, d), mode), synonyms, **how)


def _evaluate(spark, d, compat=False):
    real = impute.select_mode(_imputable(spark, d), "labelled").select("doc_id", F.col("lang").alias("category"))
    return impute.evaluate(real, _impute(spark, d, "labelled"), compat)


def _write_back(spark, d):
    out = impute.write_back(_imputable(spark, d), _impute(spark, d))
    return out.select("doc_id", F.array_join(F.array_sort("terms"), "|").alias("terms"))


def _sections(spark, d):
    turns = t.table(spark, d, "conversations")
    header = F.element_at(F.create_map(*map(F.lit, ("user", "Introduction", "assistant", "Methods", "system", "Results"))), F.col("role"))
    lines = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", header.alias("h"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("b")))).alias("turns"))
    flat = lines.select("conv_id", F.flatten(F.transform("turns", lambda r: F.array(r["h"], r["b"]))).alias("lines"))
    return flat.select("conv_id", x.sections(F.col("lines")).alias("s")).select("conv_id", *(F.md5(f"s.{h}").alias(h) for h in x.SECTION_HEADERS))


def _section_counts(spark, d):
    own = _sections(spark, d)
    empty = F.md5(F.lit(""))
    return own.agg(*(F.count_if(F.col(h) != empty).alias(f"n_{h}") for h in x.SECTION_HEADERS))


def _pages(spark, d):
    def first(pattern):
        return F.regexp_extract("html", pattern, 1)

    return t.table(spark, d, "pages").select("page_id", first('<html lang="([^"]*)"').alias("lang"), first("<title>([^<]*)</title>").alias("title"), F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).cast("long").alias("n_paragraphs"))


def _latest(spark, d):
    orders = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return cube.newest(orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def _year_of(spark, d):
    orders = t.table(spark, d, "orders")
    year = F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate").cast("string"))
    free = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.year("o_orderdate").cast("string"), F.lit(" Spring")))
    return orders.select("o_orderkey", x.publication_year(year, free).cast("long").alias("year"))


def _concordance(spark, d):
    return cube.concordance(t.table(spark, d, "documents"), t.text_cat_docs(spark, d).filter("category = 'en'"), "tion of").select("doc_id", F.md5("text").alias("digest"))


QUERIES = {
    "text_synonym_counts": _counts,
    "text_counts_abstract": _mode_counts("abstract"),
    "text_counts_full_text": _mode_counts("full_text"),
    "text_counts_no_methods": _mode_counts("full_text_no_methods"),
    "text_counts_large_lexicon": _wide_lexicon,
    "text_hyphen_normalise": _hyphens,
    "text_entity_counts": _entities,
    "removed_synonym_antijoin": _removed,
    "text_cube_score": lambda s, d: score.rounded(score.score(cube.observations(t.text_cat_docs(s, d), _entities(s, d))).select("category", "entity", "tf", "df", "pop", "dist", "score")),
    "synonym_totals": lambda s, d: cube.synonym_totals(_counts(s, d), t.text_cat_docs(s, d)),
    "rank_synonyms": lambda s, d: rank.ranked(cube.synonym_totals(_counts(s, d), t.text_cat_docs(s, d)), "category", "cnt", "synonym"),
    "rank_entity_synonyms": _entity_lists,
    "docs_with_hits": lambda s, d: cube.documents_with_hits(t.text_cat_docs(s, d), _counts(s, d)),
    "case_variants": _variants,
    "species_suffix": _species,
    "screen_short": _short,
    "screen_lexicon": _screen,
    "comma_permutations": _permutations,
    "term_docs": lambda s, d: cube.term_documents(_doc_terms(s, d)),
    "category_docs": lambda s, d: cube.category_documents(_doc_terms(s, d), _sources(s, d)),
    "relevant_docs_semijoin": lambda s, d: cube.relevant_documents(t.table(s, d, "labels"), t.text_cat_docs(s, d).filter("category IN ('de', 'fr')")),
    "impute_labels": _impute,
    "impute_doc_synonyms": lambda s, d: impute.document_synonyms(_impute(s, d)).select("doc_id", F.array_join("synonyms", "|").alias("synonyms")),
    "impute_ground_truth": lambda s, d: impute.ground_truth(t.table(s, d, "documents"), _doc_terms(s, d), _sources(s, d).filter("category IN ('cat_a', 'cat_b')")),
    "impute_keyword_variant": lambda s, d: _impute(s, d, "all", domain_words=("tion", "ung"), use_title=False),
    "impute_eval": _evaluate,
    "impute_eval_compat": lambda s, d: _evaluate(s, d, True),
    "impute_writeback": _write_back,
    "doc_sections": _sections,
    "section_counts": _section_counts,
    "page_fields": _pages,
    "doc_latest_version": _latest,
    "publication_year": _year_of,
    "concordance": _concordance,
}

_CATS = f"cats AS {t.values_sql(t.CATEGORY_SYNONYMS, 'category, synonym')}"
_SPLIT = """sp AS (SELECT d.doc_id, d.lang, ' ' || translate(lower(split_part(text, chr(10), 1)), ',:', '  ') || ' ' AS title,
 lower(substr(text, length(split_part(text, chr(10), 1)) + 2)) AS abstract, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)"""
_PAIRS = "list_filter(m, lambda a: len(list_filter(m, lambda b: NOT contains(a, b) AND NOT contains(b, a))) > 0)"


def _impute_sql(where, title="by_title"):
    return f"""{_CATS}, {_SPLIT}, mm AS (SELECT doc_id, lang, category, bool_or(contains(title, ' ' || synonym || ' ')) AS by_title, list(DISTINCT synonym) AS m,
 min(synonym) FILTER (contains(title, ' ' || synonym || ' ')) AS first_title FROM sp, cats WHERE ({where}) AND (contains(title, synonym) OR contains(abstract, synonym)) GROUP BY ALL),
im AS (SELECT doc_id, lang, category, {title} AS by_title, CAST(len(m) AS BIGINT) AS n_matches, CASE WHEN {title} THEN first_title ELSE list_min({_PAIRS}) END AS synonym
 FROM mm WHERE {title} OR len({_PAIRS}) > 0)"""


def _eval_sql(times):
    return f"""WITH {_impute_sql('known')}, re AS (SELECT doc_id, lang AS category FROM sp WHERE known), fj AS (SELECT re.doc_id AS a, im.doc_id AS b FROM re FULL JOIN im ON re.doc_id = im.doc_id AND re.category = im.category),
n AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) * {times} AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn FROM fj)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM n"""


_SECTION_LINES = """tl AS (SELECT conv_id, flatten(list([CASE role WHEN 'user' THEN 'Introduction' WHEN 'assistant' THEN 'Methods' ELSE 'Results' END, replace(text, chr(10), ' ')] ORDER BY turn)) AS ls FROM conversations GROUP BY conv_id),
lo AS (SELECT conv_id, ls, list_reverse(list_transform(ls, lambda v: lower(trim(v)))) AS rv FROM tl),
pl AS (SELECT conv_id, ls, len(ls) - list_position(rv, 'introduction') + 1 AS p1, len(ls) - list_position(rv, 'methods') + 1 AS p2,
 len(ls) - list_position(rv, 'results') + 1 AS p3, len(ls) - list_position(rv, 'discussion') + 1 AS p4 FROM lo),
pp AS (SELECT conv_id, ls, [CASE WHEN p1 <= len(ls) THEN p1 END, CASE WHEN p2 <= len(ls) THEN p2 END, CASE WHEN p3 <= len(ls) THEN p3 END, CASE WHEN p4 <= len(ls) THEN p4 END] AS p FROM pl)"""


def _section(i):
    after = f"coalesce(list_min(list_filter(p, lambda q: q > p[{i}])), len(ls) + 1)"
    return f"CASE WHEN p[{i}] IS NULL THEN '' ELSE coalesce(array_to_string(list_slice(ls, p[{i}] + 1, {after} - 1), ' '), '') END"


_SECTIONS = f"{_SECTION_LINES}, sc AS (SELECT conv_id, " + ", ".join(f"{_section(i + 1)} AS {h}" for i, h in enumerate(x.SECTION_HEADERS)) + " FROM pp)"
_SOURCES = t.values_sql([(f"cat_{'abcde'[i // 4]}", f"src{i}") for i in range(20)], "category, term")
_WORDS = "ww AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS synonym FROM documents), w AS (SELECT synonym FROM ww WHERE synonym <> '')"
_IS_SHORT = "(NOT contains(synonym, ' ') AND (length(synonym) <= 2 OR (length(synonym) <= 3 AND regexp_full_match(synonym, '\\p{L}+'))))"

SQL = {
    "text_synonym_counts": f"WITH {_COUNTS} SELECT * FROM cc",
    "text_counts_abstract": _mode_sql(1, 2),
    "text_counts_full_text": _mode_sql(1, 2, "text"),
    "text_counts_no_methods": _mode_sql(1, 2, 3, 4, 5),
    "text_counts_large_lexicon": f"""WITH dd AS (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS t FROM documents),
ss AS (SELECT DISTINCT left(w, 6) AS synonym FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS w FROM benchmark) WHERE length(w) > 5)
SELECT doc_id, synonym, CAST((length(t) - length(replace(t, synonym, ''))) / length(synonym) AS BIGINT) AS cnt FROM dd, ss WHERE contains(t, synonym)""",
    "text_hyphen_normalise": f"WITH n AS (SELECT doc_id, {_NORM.format('text')} AS n FROM documents) SELECT doc_id, md5(n) AS digest, length(n) AS n_chars FROM n",
    "text_entity_counts": f"WITH {_COUNTS} SELECT * FROM ec",
    "removed_synonym_antijoin": f"WITH {_COUNTS} SELECT doc_id, entity, CAST(sum(cnt) AS BIGINT) AS cnt FROM cc JOIN ls USING (synonym) WHERE synonym NOT IN ('the', 'tion') GROUP BY ALL",
    "text_cube_score": f"WITH {_COUNTS}, obs AS (SELECT lang AS category, doc_id, entity, cnt FROM ec JOIN documents USING (doc_id)), {t.score_sql()} SELECT category, entity, tf, df, round(pop, 9) AS pop, round(dist, 9) AS dist, round(score, 9) AS score FROM s",
    "synonym_totals": f"WITH {_COUNTS}, {_TOTALS} SELECT * FROM tt",
    "rank_synonyms": f"WITH {_COUNTS}, {_TOTALS} SELECT *, row_number() OVER (PARTITION BY category ORDER BY cnt DESC, synonym) AS position FROM tt",
    "rank_entity_synonyms": f"WITH {_COUNTS}, g AS (SELECT lang AS category, entity, synonym, CAST(sum(cnt) AS BIGINT) AS cnt FROM cc JOIN documents USING (doc_id) JOIN ls USING (synonym) GROUP BY ALL) SELECT category, entity, string_agg(synonym || '|' || cnt, ';' ORDER BY cnt DESC, synonym) AS synonyms FROM g GROUP BY ALL",
    "docs_with_hits": f"WITH {_COUNTS} SELECT lang AS category, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM cc)",
    "case_variants": "WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT name, u || ' ' || v AS variant FROM (SELECT name, unnest([a, upper(a[1]) || a[2:]]) AS u, b FROM n), LATERAL (SELECT unnest([b, upper(b[1]) || b[2:]]) AS v)",
    "species_suffix": "WITH n AS (SELECT DISTINCT regexp_replace(p_name, 'widget|ring', 'mouse', 'g') AS name FROM part) SELECT name, split_part(name, ' ', 1) AS short FROM n WHERE name LIKE '% mouse' AND len(string_split(name, ' ')) = 2",
    "screen_short": f"WITH {_WORDS} SELECT synonym FROM w WHERE {_IS_SHORT}",
    "screen_lexicon": f"WITH {_WORDS}, r AS (SELECT synonym, CASE WHEN substr(synonym, 2) = lower(substr(synonym, 2)) AND (lower(synonym) IN ('the', 'and', 'with', 'that', 'for', 'und') OR lower(left(synonym, greatest(length(synonym) - 2, 0))) IN ('the', 'and', 'with', 'that', 'for', 'und')) THEN 'english' WHEN {_IS_SHORT} THEN 'short' END AS reason FROM w) SELECT * FROM r WHERE reason IS NOT NULL",
    "comma_permutations": "WITH n AS (SELECT DISTINCT replace(p_name, ' ', ', ') || ', ' || p_type AS term, string_split(p_name || ' ' || p_type, ' ') AS p FROM part) SELECT DISTINCT term, p[i] || ' ' || p[j] || ' ' || p[k] AS permutation FROM n, (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) AS o(i, j, k)",
    "term_docs": "WITH n AS (SELECT DISTINCT lang AS term, doc_id FROM documents UNION SELECT DISTINCT source, doc_id FROM documents) SELECT term, count(*) AS n_docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM n GROUP BY term",
    "category_docs": f"SELECT DISTINCT category, doc_id FROM documents JOIN {_SOURCES} c ON c.term = source",
    "relevant_docs_semijoin": "SELECT * FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr'))",
    "impute_labels": f"WITH {_impute_sql('NOT known')} SELECT doc_id, category, by_title, n_matches, synonym FROM im",
    "impute_doc_synonyms": f"WITH {_impute_sql('NOT known')} SELECT doc_id, string_agg(DISTINCT synonym, '|' ORDER BY synonym) AS synonyms FROM im GROUP BY doc_id",
    "impute_ground_truth": f"WITH p AS (SELECT DISTINCT doc_id, category FROM documents JOIN {_SOURCES} c ON c.term = source WHERE category IN ('cat_a', 'cat_b')) SELECT d.doc_id, p.category FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN p USING (doc_id)",
    "impute_keyword_variant": "WITH " + _impute_sql("contains(title || abstract, 'tion') OR contains(title || abstract, 'ung')", "false") + " SELECT doc_id, category, by_title, n_matches, synonym FROM im",
    "impute_eval": _eval_sql(1),
    "impute_eval_compat": _eval_sql(2),
    "impute_writeback": f"WITH {_impute_sql('NOT known')}, u AS (SELECT doc_id, category FROM im UNION SELECT doc_id, lang FROM sp WHERE known), g AS (SELECT doc_id, string_agg(category, '|' ORDER BY category) AS terms FROM u GROUP BY doc_id) SELECT d.doc_id, coalesce(g.terms, '') AS terms FROM documents d LEFT JOIN g USING (doc_id)",
    "doc_sections": f"WITH {_SECTIONS} SELECT conv_id, " + ", ".join(f"md5({h}) AS {h}" for h in x.SECTION_HEADERS) + " FROM sc",
    "section_counts": f"WITH {_SECTIONS} SELECT " + ", ".join(f"count(*) FILTER ({h} <> '') AS n_{h}" for h in x.SECTION_HEADERS) + " FROM sc",
    "page_fields": """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages""",
    "doc_latest_version": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "publication_year": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 THEN -1 ELSE year(o_orderdate) END AS BIGINT) AS year FROM orders",
    "concordance": "SELECT doc_id, md5(text) AS digest FROM documents WHERE contains(text, 'tion of') AND lang = 'en' ORDER BY doc_id LIMIT 11",
}
