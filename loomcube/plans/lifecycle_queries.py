"""Queries of the lifecycles, and of operators that only these use."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcube import config
from loomcube.functions import text as x
from loomcube.operators import assoc, cube, expand, impute, kg, mapping, rank, score
from loomcube.plans import assoc_queries as a
from loomcube.plans import graph_queries as g
from loomcube.plans import lifecycle
from loomcube.plans import tables as t
from loomcube.plans import text_queries as tq

BRANDS = ("B:Brand#1", "B:Brand#7", "B:Brand#13")


def _entities(spark, d):
    """Parts annotated with their brand below their type; widened by pathways and regulators."""
    part = t.table(spark, d, "part")
    entity, brand = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"), F.concat(F.lit("B:"), "p_brand")
    inputs = {
        "tree": t.tree(spark, d), "ontology": part.select(F.concat(F.lit("T:"), "p_type").alias("parent"), brand.alias("child")).distinct(),
        "annotations": part.select(entity, brand.alias("term")), "reference": part.filter("p_size <= 40").select(entity),
        "members": t.pathway_members(spark, d), "regulation": g._regulation(spark, d),
    }
    p = config.Preprocessing(("cat_a", "cat_b"), (("R0",), ("R2", "R3.N03")), BRANDS, include_pathways=True, pathway_count=2, pathway_share=0.25, include_regulators=True)
    return lifecycle.expand_entities(p, inputs)


def _texts(spark, d, **how):
    docs = tq._articles(spark, d).join(t.table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    docs = docs.select("*", (F.lit(2000) + F.pmod("n_chars", F.lit(10))).alias("year"), F.array("source").alias("terms"))
    inputs = {
        "docs": docs, "category_terms": tq._sources(spark, d), "synonyms": t.literal(spark, t.LEXICON, "entity, synonym"),
        "core": t.literal(spark, [("e_code",)], "entity"), "lexicon": t.literal(spark, [("the",), ("ations",)], "word"),
        "category_synonyms": t.literal(spark, t.CATEGORY_SYNONYMS, "category, synonym"),
    }
    p = config.TextMining(first_year=2002, last_year=2008, include_full_text=True, check_synonyms=True, **how)
    return lifecycle.mine_texts(p, inputs)


def _analysis(spark, d):
    scores = a._scores(spark, d)
    synonyms = scores.select("entity", F.concat(F.lit("syn_"), "entity").alias("synonyms")).distinct()
    inputs = {"scores": scores, "core_scores": scores, "synonyms": synonyms, "core": scores.select("entity").distinct(), "members": t.pathway_members(spark, d)}
    p = config.Analysis(z_threshold=0.5, analyze_all_entities=True, analyze_core_entities=False, merge_entities=False, thresholds=a.LEVELS)
    return lifecycle.analyse(p, inputs, 5)["all"]


def _merged_analysis(spark, d):
    """Parts by their lines in a segment, in classes of four, so that parts of a type often have equal scores."""
    lines, orders, customer = (t.table(spark, d, n) for n in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"])
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    scores = joined.groupBy(F.col("c_mktsegment").alias("category"), part.alias("entity")).agg(F.floor(F.count("*") / 4).cast("double").alias("score"))
    synonyms = t.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"), F.array("p_type", "p_brand").alias("synonyms"))
    inputs = {"scores": scores, "core_scores": scores, "synonyms": synonyms, "core": t.core_parts(spark, d), "members": t.pathway_members(spark, d)}
    return lifecycle.analyse(config.Analysis(z_threshold=1.0, analyze_all_entities=True, analyze_core_entities=False), inputs, 5)["all"]


def _merged_summary(spark, d):
    return _merged_analysis(spark, d)["summary"].withColumn("synonyms", F.array_join(F.sort_array("synonyms"), "|"))


def _set_kinds(spark, d):
    return assoc.entity_sets(assoc.z_scores(a._part_scores(spark, d)), 2.0, t.core_parts(spark, d), 5)


def _graph(spark, d):
    inputs = {
        "scores": a._scores(spark, d), "tree_edges": g._edges(spark, d), "tree": t.tree(spark, d), "roots": g._roots(spark, d),
        "interactions": t.supplier_graph(spark, d), "regulation": g._regulation(spark, d),
    }
    return lifecycle.build_graph(config.KnowledgeGraph(include_pathways=False), inputs)


def _graph_summary(spark, d):
    return _graph(spark, d)["edges"].groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def _heatmap(spark, d):
    z = assoc.z_scores(a._part_scores(spark, d)).select("category", "entity", "z")
    return score.rounded(assoc.heatmap(assoc.pathway_means(t.pathway_members(spark, d), z), a.CATS), 6)


def _genes(spark, d):
    """Suppliers regulate parts by name; a name has the ids of all rows that bear it."""
    lines, part = t.table(spark, d, "lineitem"), t.table(spark, d, "part")
    tf = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("TF"), F.col("l_suppkey").cast("string")).alias("tf_gene"), F.col("p_name").alias("target_gene"))
    ids = part.select(F.col("p_name").alias("gene"), F.col("p_partkey").alias("gene_id")).unionByName(t.table(spark, d, "supplier").select(F.concat(F.lit("TF"), F.col("s_suppkey").cast("string")).alias("gene"), (-1 - F.col("s_suppkey")).alias("gene_id")))
    entities = ids.select("gene_id", F.concat(F.lit("E"), F.col("gene_id").cast("string")).alias("entity"))
    return expand.regulation_by_entity(tf, ids, entities)


def _hierarchy(spark, d):
    n = t.table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("R-HSA-"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.when(F.col("n_nationkey") < 20, "R-HSA-1").otherwise("R-MMU-1"), F.col("n_nationkey").cast("string")).alias("child"))
    return kg.hierarchy_triples(edges)


def _regulator_triples(spark, d):
    return expand.regulator_partners(g._regulation(spark, d), g._mixed_core(spark, d))[1]


def _merged_counts(spark, d):
    lines = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("synonym"), F.col("l_linenumber").cast("long").alias("cnt"))
    return cube.merge_counts(lines.filter("synonym = 'R'"), lines.filter("synonym <> 'R'"), lines)


def _ordinals(spark, d):
    listed = t.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cat_num")).agg(F.collect_list("c_custkey").alias("docs"))
    return cube.ordinal_pairs(listed)


def _lines(spark, d):
    ranked = rank.top_per_group(score.rounded(a._scores(spark, d).select("category", "entity", "score")), "category", "score", "entity", 3)
    synonyms = ranked.select("category", "entity", F.concat(F.lit("s_"), "entity").alias("synonyms"))
    return rank.report_lines(ranked, synonyms).select("category", "position", "line")


def _labels(spark, d):
    sizes = t.pathway_members(spark, d).groupBy("pathway").agg(F.count("*").alias("n"))
    return sizes.select("pathway", x.shorten(F.col("pathway"), 5, F.col("n")).alias("label"))


def _bodies(spark, d):
    docs = t.table(spark, d, "documents")
    full = F.concat(F.lit("front\nBody\n"), "lang", F.lit("\n"), "source", F.lit("\nReferences\n"), "lang")
    return docs.select("doc_id", F.array_join(x.body_lines(full), "|").alias("body"))


def _extended(spark, d):
    return impute.extend_cube(t.text_cat_docs(spark, d).join(t.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), tq._impute(spark, d))


def _undone(spark, d):
    labels = tq._impute(spark, d)
    after = impute.undo(impute.write_back(tq._imputable(spark, d), labels), labels)
    return after.select("doc_id", F.array_join("terms", "|").alias("terms"))


def _unknown(spark, d):
    given = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
    return config.unknown_values(given, t.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k")


def _max_rows(spark, d):
    wide = score.rounded(score.wide(a._scores(spark, d), "score", a.CATS))
    return rank.top_rows(wide, "entity", a.CATS, 5, by="max").select("entity", "value")


QUERIES = {
    "lifecycle_entities": lambda s, d: _entities(s, d)["entities"],
    "lifecycle_categories": lambda s, d: _entities(s, d)["categories"].select("category", "code"),
    "lifecycle_scores": lambda s, d: score.rounded(_texts(s, d)["scores"].select("category", "entity", "tf", "df", "score")),
    "lifecycle_core_scores": lambda s, d: score.rounded(_texts(s, d, include_label_imputation=False)["core_scores"].select("category", "entity", "tf", "score")),
    "lifecycle_summary": lambda s, d: _analysis(s, d)["summary"],
    "lifecycle_graph": _graph_summary,
    "lifecycle_nodes": lambda s, d: _graph(s, d)["nodes"].groupBy("node_type").agg(F.count("*").alias("n")),
    "lifecycle_merged_summary": _merged_summary,
    "lifecycle_merged_sets": lambda s, d: _merged_analysis(s, d)["sets"],
    "pathway_set_kinds": lambda s, d: _set_kinds(s, d).groupBy("set_name").agg(F.count("*").alias("n")),
    "pathway_sets_enrichment": lambda s, d: score.rounded(assoc.enrichment(t.pathway_members(s, d), _set_kinds(s, d)), 6),
    "pathway_heatmap": _heatmap,
    "regulation_by_entity": _genes,
    "regulator_triples": _regulator_triples,
    "kg_hierarchy_triples": _hierarchy,
    "kg_tree_flat": lambda s, d: kg.tree_triples(g._edges(s, d), t.tree(s, d), g._roots(s, d), False),
    "pred_auprc": lambda s, d: kg.auprc(a._labelled(s, d)),
    "pred_thresholds": lambda s, d: kg.threshold_metrics(a._labelled(s, d), (0.0, 0.1, 0.2)),
    "pred_negatives": lambda s, d: kg.label_negatives(a._pairs(s, d).filter("NOT same").drop("same", "low_label")),
    "pred_of_core": lambda s, d: kg.of_core(a._pairs(s, d).drop("same", "low_label"), t.table(s, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("entity"))),
    "map_invert": lambda s, d: mapping.invert(g._supplier_nation(s, d)),
    "map_unmapped": lambda s, d: mapping.unmapped(t.table(s, d, "customer").select(F.col("c_custkey").alias("src")), g._large_buys(s, d)).select("src"),
    "merged_counts": _merged_counts,
    "ordinal_pairs": _ordinals,
    "report_lines": _lines,
    "short_labels": _labels,
    "body_lines": _bodies,
    "impute_extend_cube": _extended,
    "impute_undo": _undone,
    "unknown_values": _unknown,
    "top_rows_by_maximum": _max_rows,
}

#: What is left of the lexicon in all spellings once everyday and short words are taken out.
_SPELT = [("e_suffix", s) for s in ("tion", "Tion", "ation", "Ation")] + [("e_code", s) for s in ("e mail", "E mail", "e Mail", "E Mail", "end of", "End of", "end Of", "End Of")]
_FIELD = [tq._NORM.format(f"coalesce(string_split(coalesce(text, ''), chr(10))[{i}], '')") for i in range(1, 6)]
_TIMES = " + ".join(f"CAST((length({f}) - length(replace({f}, synonym, ''))) / length(synonym) AS BIGINT)" for f in _FIELD)


def _lifecycle_scores(where="true"):
    return f"""WITH lx AS {t.values_sql(_SPELT, 'entity, synonym')},
ec AS (SELECT doc_id, source, entity, CAST(sum({_TIMES}) AS BIGINT) AS cnt FROM documents, lx WHERE n_chars % 10 BETWEEN 2 AND 8 AND {where} GROUP BY ALL HAVING sum({_TIMES}) > 0),
obs AS (SELECT category, doc_id, entity, cnt FROM ec JOIN {tq._SOURCES} c ON c.term = source), {t.score_sql()}"""


_KINDS = """SELECT 'core|' || category AS set_name, entity FROM z WHERE z >= 2 AND entity IN (SELECT 'P' || p_partkey FROM part WHERE p_size <= 10)
 UNION SELECT 'I', entity FROM z GROUP BY entity HAVING count(z) = 5 UNION SELECT 'II|' || min(category), entity FROM z WHERE z >= 2 GROUP BY entity HAVING count(*) = 1
 UNION SELECT 'all', entity FROM z UNION SELECT 'nonzero|' || category, entity FROM z WHERE score <> 0"""
_NO_PATHWAYS = a._GRAPH.replace("UNION ALL SELECT * FROM kg_path ", "UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'targets', 'P' || l_partkey, 1e0 FROM lineitem ")

_MERGED = f"""WITH ps AS (SELECT c_mktsegment AS category, 'P' || l_partkey AS entity, CAST(count(*) // 4 AS DOUBLE) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
ve AS (SELECT entity, list((category, score) ORDER BY category) AS vals FROM ps GROUP BY entity),
sy AS (SELECT 'P' || p_partkey AS entity, least(p_type, p_brand) || '|' || greatest(p_type, p_brand) AS synonyms FROM part),
na AS (SELECT string_agg(entity, ';' ORDER BY entity) AS name, list(entity) AS ids, min(entity) AS one, any_value(synonyms) AS synonyms FROM ve JOIN sy USING (entity) GROUP BY vals, synonyms),
mem AS (SELECT name AS entity, unnest(ids) AS member, synonyms FROM na),
s AS (SELECT category, name AS entity, score FROM ps JOIN na ON ps.entity = na.one),
{a._Z[a._Z.index("mo AS ("):].replace("z >= 0.5", "z >= 1")}"""

SQL = {
    "lifecycle_entities": g.SQL["expanded_union"].replace("'Brand#13'))", "'Brand#13') AND p_size <= 40)"),
    "lifecycle_categories": f"WITH {t.TREE_SQL}, r AS {t.values_sql([('cat_a', 'R0'), ('cat_b', 'R2'), ('cat_b', 'R3.N03')], 'category, root')} SELECT DISTINCT category, code FROM tree JOIN r ON code = root OR starts_with(code, root || '.')",
    "lifecycle_scores": f"{_lifecycle_scores()} SELECT category, entity, tf, df, round(score, 9) AS score FROM s",
    "lifecycle_core_scores": _lifecycle_scores("entity = 'e_code'") + " SELECT category, entity, tf, round(score, 9) AS score FROM s",
    "lifecycle_summary": f"{a._Z} SELECT e.entity, category_i, coalesce(st.n, 0) AS n, st.categories, CASE WHEN st.n = 1 THEN st.categories END AS category_ii, 'syn_' || e.entity AS synonyms FROM (SELECT entity, count(z) = 5 AS category_i FROM z GROUP BY entity) e LEFT JOIN st ON st.entity = e.entity",
    "lifecycle_graph": f"{_NO_PATHWAYS} SELECT relation, count(*) AS n, round(sum(weight), 6) AS weight FROM kg GROUP BY relation",
    "lifecycle_nodes": f"""{a._GRAPH.replace("UNION ALL SELECT tail, 2, 'Reactome_Pathway' FROM kg_path", "UNION ALL SELECT unnest(['S' || l_suppkey, 'P' || l_partkey]), 4, 'Protein' FROM lineitem").replace("UNION ALL SELECT category, -1, 'CVD' FROM roots", "")} SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type""",
    "lifecycle_merged_summary": f"{_MERGED} SELECT e.entity, category_i, coalesce(st.n, 0) AS n, st.categories, CASE WHEN st.n = 1 THEN st.categories END AS category_ii, y.synonyms FROM (SELECT entity, count(z) = 5 AS category_i FROM z GROUP BY entity) e LEFT JOIN st ON st.entity = e.entity LEFT JOIN (SELECT DISTINCT entity, synonyms FROM mem) y ON y.entity = e.entity",
    "lifecycle_merged_sets": f"{_MERGED} SELECT 'core|' || category AS set_name, entity FROM z WHERE z >= 1 AND entity IN (SELECT entity FROM mem WHERE member IN (SELECT 'P' || p_partkey FROM part WHERE p_size <= 10)) UNION SELECT 'I', entity FROM z GROUP BY entity HAVING count(z) = 5 UNION SELECT 'II|' || categories, entity FROM st WHERE n = 1 UNION SELECT 'all', entity FROM z UNION SELECT 'nonzero|' || category, entity FROM z WHERE score <> 0",
    "pathway_set_kinds": f"{a._PZ}, sets AS ({_KINDS}) SELECT set_name, count(*) AS n FROM sets GROUP BY set_name",
    "pathway_sets_enrichment": a._ENRICH.replace("sets AS (SELECT category AS set_name, entity FROM z WHERE z >= 2)", f"sets AS ({_KINDS})") + " SELECT * FROM en",
    "pathway_heatmap": f"{a._PZ}, {t.MEMBERS_SQL}, hm AS (SELECT pathway, category, round(avg(z), 6) AS mean_z FROM members JOIN z USING (entity) GROUP BY ALL) SELECT pathway, " + ", ".join(f"max(CASE WHEN category = '{c}' THEN mean_z END) AS {c}" for c in a.CATS) + " FROM hm GROUP BY pathway",
    "regulation_by_entity": "WITH gi AS (SELECT p_name AS gene, min(p_partkey) AS k FROM part GROUP BY 1) SELECT DISTINCT 'E' || (-1 - l_suppkey) AS regulator, 'E' || gi.k AS target FROM lineitem JOIN part ON l_partkey = p_partkey JOIN gi ON gi.gene = p_name",
    "regulator_triples": f"WITH {g._REG}, {g._MIXED} SELECT regulator AS head, 'targets' AS relation, target AS tail, 1e0 AS weight FROM reg WHERE regulator IN (FROM core) OR target IN (FROM core)",
    "kg_hierarchy_triples": "SELECT 'R-HSA-' || n_regionkey AS head, 'pathway_hierarchy' AS relation, 'R-HSA-1' || n_nationkey AS tail, 1e0 AS weight FROM nation WHERE n_nationkey < 20",
    "kg_tree_flat": f"WITH {t.TREE_SQL}, {g._ROOTS} SELECT code AS head, 'MeSH_is' AS relation, name AS tail, 1e0 AS weight FROM tree UNION ALL SELECT category, 'MeSH_CVD', root, 1e0 FROM roots",
    "pred_auprc": f"WITH {a._PAIRS}, gr AS (SELECT predictions AS s, count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg FROM pr GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM gr WINDOW w AS (ORDER BY s DESC)) SELECT CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS auprc FROM c",
    "pred_thresholds": f"WITH {a._PAIRS}, c AS (SELECT threshold, count(*) FILTER (predictions >= threshold AND same) AS tp, count(*) FILTER (predictions >= threshold AND NOT same) AS fp, count(*) FILTER (predictions < threshold AND same) AS fn, count(*) FILTER (predictions < threshold AND NOT same) AS tn FROM pr, (SELECT unnest([0e0, 0.1e0, 0.2e0]) AS threshold) GROUP BY threshold) SELECT threshold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9) AS mcc FROM c",
    "pred_negatives": f"WITH {a._PAIRS} SELECT sources, destinations, predictions, false AS is_true FROM pr WHERE NOT same",
    "pred_of_core": f"WITH {a._PAIRS} SELECT sources, destinations, predictions FROM pr WHERE destinations IN (SELECT vec_id FROM embeddings WHERE label = 3)",
    "map_invert": "SELECT CAST(s_nationkey AS BIGINT) AS src, s_suppkey AS dst FROM supplier",
    "map_unmapped": "SELECT c_custkey AS src FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "merged_counts": "SELECT l_orderkey AS doc_id, l_returnflag AS synonym, CAST(2 * sum(l_linenumber) AS BIGINT) AS cnt FROM lineitem GROUP BY ALL",
    "ordinal_pairs": "SELECT c_custkey AS doc_id, c_nationkey AS cat_num FROM customer",
    "report_lines": f"{a._Z}, k AS (SELECT category, entity, round(score, 9) AS score, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, entity) AS position FROM z) SELECT category, position, position || '. ' || entity || ' ' || printf('%.6f', score) || ' [s_' || entity || ']' AS line FROM k WHERE position <= 3",
    "short_labels": f"WITH {t.MEMBERS_SQL} SELECT pathway, CASE WHEN length(pathway) > 5 THEN left(pathway, 5) || '...' ELSE pathway END || ' (' || count(*) || ')' AS label FROM members GROUP BY pathway",
    "body_lines": "SELECT doc_id, lang || '|' || source AS body FROM documents",
    "impute_extend_cube": f"WITH {tq._impute_sql('NOT known')} SELECT lang AS category, doc_id FROM sp WHERE known UNION SELECT category, doc_id FROM im",
    "impute_undo": f"WITH {tq._impute_sql('NOT known')} SELECT doc_id, CASE WHEN known THEN lang ELSE '' END AS terms FROM sp",
    "unknown_values": "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ORDER BY k",
    "top_rows_by_maximum": f"{a._Z} SELECT entity, max(round(score, 9)) AS value FROM z GROUP BY entity ORDER BY value DESC, entity LIMIT 5",
}
