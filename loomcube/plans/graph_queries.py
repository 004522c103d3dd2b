"""Queries of hierarchies, mappings and entity expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcube.operators import cube, expand, hierarchy, mapping
from loomcube.plans import tables as t

_T = f"WITH RECURSIVE {t.TREE_SQL}"
_CLOSURE = "cl AS (SELECT parent AS ancestor, child AS node, 1 AS depth FROM edges UNION ALL SELECT e.parent, cl.node, cl.depth + 1 FROM cl JOIN edges e ON e.child = cl.ancestor)"


def _edges(spark, d):
    return hierarchy.code_edges(t.tree(spark, d))


def _dag(spark, d):
    """The tree with a second parent for the customers of one segment: the nation with the next key."""
    n = t.table(spark, d, "nation")
    c = t.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumn("second", (F.col("c_nationkey") + 1) % 25)
    code = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(".N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    codes = n.select(F.col("n_nationkey").alias("k"), code.alias("code"))
    joined = c.join(codes.select(F.col("k").alias("second"), F.col("code").alias("parent")), "second").join(codes.select(F.col("k").alias("c_nationkey"), F.col("code").alias("own")), "c_nationkey")
    more = joined.select("parent", F.concat("own", F.lit(".C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("child"))
    return _edges(spark, d).unionByName(more)


_DAG = f"""{t.TREE_SQL}, nc AS (SELECT n_nationkey AS k, 'R' || n_regionkey || '.N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation),
dag AS (SELECT parent, child FROM edges UNION ALL SELECT b.code, a.code || '.C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') FROM customer JOIN nc a ON a.k = c_nationkey
 JOIN nc b ON b.k = (c_nationkey + 1) % 25 WHERE c_mktsegment = 'BUILDING')"""


def _roots(spark, d):
    return t.literal(spark, [("cat_a", "R0"), ("cat_a", "R1.N01"), ("cat_b", "R2"), ("cat_c", "R3.N03"), ("cat_c", "R1")], "category, root")


_ROOTS = f"roots AS {t.values_sql([('cat_a', 'R0'), ('cat_a', 'R1.N01'), ('cat_b', 'R2'), ('cat_c', 'R3.N03'), ('cat_c', 'R1')], 'category, root')}"


def _assign(strict):
    return lambda spark, d: cube.prefix_assign(t.tree(spark, d), _roots(spark, d), strict).select("category", "code")


def _annotated(spark, d):
    """Orders annotate their customer's code."""
    c, n, o = t.table(spark, d, "customer"), t.table(spark, d, "nation"), t.table(spark, d, "orders")
    code = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(".N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    notes = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("o_orderkey").alias("entity"), code.alias("term"))
    seeds = t.literal(spark, [("R1",), ("R2.N02",)], "term")
    return hierarchy.descendant_annotations(seeds, _edges(spark, d), notes)


def _khop(spark, d):
    found, _ = expand.interaction_partners(t.supplier_graph(spark, d), t.core_suppliers(spark, d), 2, 0.75)
    return found


def _khop_edges(spark, d):
    _, edges = expand.interaction_partners(t.supplier_graph(spark, d), t.core_suppliers(spark, d), 1, 0.75)
    return edges.select("head", "relation", "tail", F.round("weight", 9).alias("weight"))


def _pathways(spark, d):
    hits = expand.pathway_hits(t.pathway_members(spark, d), t.core_parts(spark, d))
    return hits.select("pathway", "size", "hits", F.round("share", 9).alias("share"))


def _mixed_core(spark, d):
    """Parts of three brands make the core for pathways."""
    return t.table(spark, d, "part").filter("p_brand IN ('Brand#1', 'Brand#7', 'Brand#13')").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"))


def _pathway_expand(mode):
    return lambda spark, d: expand.pathway_partners(t.pathway_members(spark, d), _mixed_core(spark, d), 2, 0.25, mode)[0]


def _regulation(spark, d):
    lines = t.table(spark, d, "lineitem")
    return lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("regulator"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"))


def _regulator_core(spark, d):
    part = t.table(spark, d, "part").filter("p_brand = 'Brand#1'").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity"))
    return t.core_suppliers(spark, d).unionByName(part)


def _union(spark, d):
    core = _mixed_core(spark, d)
    pathways, _ = expand.pathway_partners(t.pathway_members(spark, d), core, 2, 0.25)
    regulators, _ = expand.regulator_partners(_regulation(spark, d), core)
    return expand.expanded(core, pathways, regulators)


def _part_supplier(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def _supplier_nation(spark, d):
    return t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


def _customer_nation(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))


def _large_buys(spark, d):
    return t.table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"))


def _edge_list(spark, d):
    return mapping.edge_list(_supplier_nation(spark, d), "is_in", "Supplier:", "Nation:")


def _lists(spark, d):
    return mapping.as_lists(_large_buys(spark, d)).select("src", F.array_join("dsts", "|").alias("dsts"))


def _paths(spark, d):
    return hierarchy.paths_to_root(_edges(spark, d)).select("node", F.array_join("path", "/").alias("path"))


def _subgraph(spark, d):
    nodes = t.literal(spark, [("R0.N00",), ("R0.N05.C0000005",), ("R1",)], "node")
    chosen = t.tree(spark, d).filter("code LIKE '%7'").select(F.col("code").alias("node")).unionByName(nodes).distinct()
    return hierarchy.ancestor_subgraph(_edges(spark, d), chosen)


def _names_with(spark, d):
    names = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return mapping.name_contains(_customer_nation(spark, d), names, "_1")


QUERIES = {
    "tree_parent": _edges,
    "prefix_assign": _assign(True),
    "prefix_assign_loose": _assign(False),
    "ontology_closure": lambda s, d: hierarchy.ancestors(_dag(s, d)),
    "ontology_annotations": _annotated,
    "path_to_root": _paths,
    "roots_leaves": lambda s, d: hierarchy.roots(_dag(s, d)).select(F.lit("root").alias("kind"), "node").unionByName(hierarchy.leaves(_dag(s, d)).select(F.lit("leaf").alias("kind"), "node")),
    "node_degrees": lambda s, d: hierarchy.degrees(_dag(s, d)),
    "subtree_size": lambda s, d: hierarchy.subtree_sizes(_dag(s, d)),
    "family_label": lambda s, d: hierarchy.family_labels(_dag(s, d)),
    "prune_tree": lambda s, d: hierarchy.prune(_dag(s, d)),
    "ancestor_subgraph": _subgraph,
    "khop_neighbours": _khop,
    "khop_edges": _khop_edges,
    "pathway_hits": _pathways,
    "pathway_expand": _pathway_expand("or"),
    "pathway_expand_and": _pathway_expand("and"),
    "regulator_expand": lambda s, d: expand.regulator_partners(_regulation(s, d), _regulator_core(s, d))[0],
    "expanded_union": _union,
    "map_chain": lambda s, d: mapping.chain(_part_supplier(s, d), _supplier_nation(s, d)),
    "map_unambiguous": lambda s, d: mapping.unambiguous(_large_buys(s, d)),
    "map_one_target": lambda s, d: mapping.one_target(_large_buys(s, d)),
    "map_merge": lambda s, d: mapping.merge(_supplier_nation(s, d), _customer_nation(s, d)),
    "map_multi_valued": lambda s, d: mapping.multi_valued(_large_buys(s, d)),
    "map_as_lists": _lists,
    "map_name_contains": _names_with,
    "map_tally": lambda s, d: mapping.tally(_customer_nation(s, d), _large_buys(s, d)),
    "dq_one_to_one": lambda s, d: mapping.not_one_to_one(_supplier_nation(s, d)),
    "edge_list": _edge_list,
}

_MIXED = "core AS (SELECT 'P' || p_partkey AS entity FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#13'))"
_HITS = "hits AS (SELECT pathway, count(*) AS size, count(core.entity) AS hits FROM members LEFT JOIN core USING (entity) GROUP BY pathway)"
_REG = "reg AS (SELECT DISTINCT 'S' || l_suppkey AS regulator, 'P' || l_partkey AS target FROM lineitem)"
_REG_ADDED = "used AS (SELECT * FROM reg WHERE regulator IN (FROM core) OR target IN (FROM core)), radd AS (SELECT entity FROM (SELECT regulator AS entity FROM used UNION SELECT target FROM used) WHERE entity NOT IN (FROM core))"
_CORE_S = "core AS (SELECT 'S' || s_suppkey AS entity FROM supplier WHERE s_acctbal > 9800)"
_BOTH = "both_ways AS (SELECT src, dst, score FROM graph WHERE score >= 0.75 UNION SELECT dst, src, score FROM graph WHERE score >= 0.75)"
_DAG_CL = _CLOSURE.replace("FROM edges", "FROM dag").replace("JOIN edges", "JOIN dag")
_TOPS = "tops AS (SELECT DISTINCT parent AS node FROM dag WHERE parent NOT IN (SELECT child FROM dag))"
_DCL = "dcl AS (SELECT ancestor, node, min(depth) AS depth FROM cl GROUP BY ALL)"
_SIZE = "sz AS (SELECT n.node, count(dcl.node) AS size FROM (SELECT parent AS node FROM dag UNION SELECT child FROM dag) n LEFT JOIN dcl ON dcl.ancestor = n.node GROUP BY n.node)"
_FAM = "fam AS (SELECT node, family FROM (SELECT dcl.node, dcl.ancestor AS family, row_number() OVER (PARTITION BY dcl.node ORDER BY sz.size DESC, dcl.ancestor) AS k FROM dcl JOIN tops ON tops.node = dcl.ancestor JOIN sz ON sz.node = dcl.ancestor) WHERE k = 1 UNION ALL SELECT node, node FROM tops)"
_D = f"WITH RECURSIVE {_DAG}, {_DAG_CL}, {_DCL}, {_TOPS}, {_SIZE}, {_FAM}"
_PATHS = "up AS (SELECT code AS node, code AS cur, code AS path FROM tree UNION ALL SELECT up.node, e.parent, up.path || '/' || e.parent FROM up JOIN edges e ON e.child = up.cur)"


def _expand_sql(test):
    return f"WITH {t.MEMBERS_SQL}, {_MIXED}, {_HITS} SELECT DISTINCT entity FROM members WHERE pathway IN (SELECT pathway FROM hits WHERE {test} AND hits > 0) AND entity NOT IN (FROM core)"


SQL = {
    "tree_parent": f"{_T} SELECT parent, child FROM edges",
    "prefix_assign": f"{_T}, {_ROOTS} SELECT DISTINCT category, code FROM tree JOIN roots ON code = root OR starts_with(code, root || '.')",
    "prefix_assign_loose": f"{_T}, {_ROOTS} SELECT DISTINCT category, code FROM tree JOIN roots ON starts_with(code, root)",
    "ontology_closure": f"{_D} SELECT ancestor, node, CAST(depth AS BIGINT) AS depth FROM dcl",
    "ontology_annotations": f"{_T} SELECT DISTINCT o_orderkey AS entity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR (n_regionkey = 2 AND n_nationkey = 2)",
    "path_to_root": f"{_T}, {_PATHS} SELECT node, path FROM up WHERE NOT contains(cur, '.')",
    "roots_leaves": f"WITH {_DAG} SELECT 'root' AS kind, parent AS node FROM (SELECT DISTINCT parent FROM dag WHERE parent NOT IN (SELECT child FROM dag)) UNION ALL SELECT 'leaf', child FROM (SELECT DISTINCT child FROM dag WHERE child NOT IN (SELECT parent FROM dag))",
    "node_degrees": f"WITH {_DAG}, n AS (SELECT parent AS node, 0 AS i, 1 AS o FROM dag UNION ALL SELECT child, 1, 0 FROM dag) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM n GROUP BY node",
    "subtree_size": f"{_D} SELECT node, size FROM sz",
    "family_label": f"{_D} SELECT node, family FROM fam",
    "prune_tree": f"{_D}, c AS (SELECT d.parent, d.child, row_number() OVER (PARTITION BY d.child ORDER BY (a.family <> b.family), s.size DESC, d.parent) AS k FROM (SELECT DISTINCT parent, child FROM dag) d JOIN sz s ON s.node = d.parent JOIN fam a ON a.node = d.parent JOIN fam b ON b.node = d.child) SELECT parent, child FROM c WHERE k = 1 UNION ALL SELECT 'Root', node FROM tops",
    "ancestor_subgraph": f"{_T}, ch AS (SELECT code AS node FROM tree WHERE code LIKE '%7' OR code IN ('R0.N00', 'R0.N05.C0000005', 'R1')), w AS (SELECT node AS at FROM ch UNION SELECT e.parent FROM w JOIN edges e ON e.child = w.at), g AS (SELECT parent, child FROM edges WHERE child IN (FROM w)) SELECT parent, child FROM g UNION ALL SELECT node, node || '_leaf' FROM ch WHERE node IN (SELECT parent FROM g)",
    "khop_neighbours": f"WITH {t.SUPPLIER_GRAPH_SQL}, {_CORE_S}, {_BOTH}, h1 AS (SELECT DISTINCT dst AS e FROM both_ways WHERE src IN (FROM core) AND dst NOT IN (FROM core)), h2 AS (SELECT DISTINCT dst AS e FROM both_ways WHERE src IN (FROM h1) AND dst NOT IN (FROM core) AND dst NOT IN (FROM h1)) SELECT entity, CAST(0 AS BIGINT) AS hop FROM core UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2",
    "khop_edges": f"WITH {t.SUPPLIER_GRAPH_SQL}, {_CORE_S}, {_BOTH} SELECT src AS head, 'binds_to' AS relation, dst AS tail, round(score, 9) AS weight FROM both_ways WHERE src IN (FROM core)",
    "pathway_hits": f"WITH {t.MEMBERS_SQL}, {t.CORE_SQL}, {_HITS} SELECT pathway, size, hits, round(hits / size, 9) AS share FROM hits",
    "pathway_expand": _expand_sql("(hits >= 2 OR hits / size >= 0.25)"),
    "pathway_expand_and": _expand_sql("(hits >= 2 AND hits / size >= 0.25)"),
    "regulator_expand": f"WITH {_REG}, core AS (SELECT 'S' || s_suppkey AS entity FROM supplier WHERE s_acctbal > 9800 UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_brand = 'Brand#1'), {_REG_ADDED} SELECT entity FROM radd",
    "expanded_union": f"WITH {t.MEMBERS_SQL}, {_MIXED}, {_HITS}, {_REG}, {_REG_ADDED}, padd AS ({_expand_sql('(hits >= 2 OR hits / size >= 0.25)').split('hits AS ')[1].split('GROUP BY pathway) ')[1]}) SELECT entity, true AS core FROM core UNION ALL SELECT entity, false FROM (SELECT entity FROM padd UNION SELECT entity FROM radd)",
    "map_chain": "SELECT DISTINCT l_partkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "map_unambiguous": "SELECT o_custkey AS src, min(o_orderstatus) AS dst FROM orders WHERE o_totalprice > 450000 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1",
    "map_one_target": "SELECT o_custkey AS src, min(o_orderstatus) AS dst FROM orders WHERE o_totalprice > 450000 GROUP BY 1",
    "map_merge": "SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM supplier UNION SELECT c_custkey, CAST(c_nationkey AS BIGINT) FROM customer",
    "map_multi_valued": "SELECT o_custkey AS src, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    "map_as_lists": "SELECT o_custkey AS src, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS dsts FROM orders WHERE o_totalprice > 450000 GROUP BY 1",
    "map_name_contains": "SELECT DISTINCT c_custkey AS src FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(n_name, '_1')",
    "map_tally": "SELECT CAST(c_nationkey AS BIGINT) AS dst, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) GROUP BY 1",
    "dq_one_to_one": "WITH m AS (SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM supplier) SELECT 'src' AS side, CAST(src AS VARCHAR) AS id, count(DISTINCT dst) AS n FROM m GROUP BY src HAVING count(DISTINCT dst) > 1 UNION ALL SELECT 'dst', CAST(dst AS VARCHAR), count(DISTINCT src) FROM m GROUP BY dst HAVING count(DISTINCT src) > 1",
    "edge_list": "SELECT DISTINCT 'Supplier:' || s_suppkey AS head, 'is_in' AS relation, 'Nation:' || s_nationkey AS tail, 1.0::DOUBLE AS weight FROM supplier",
}
