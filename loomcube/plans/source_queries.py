"""Queries of the readers: files of each format are written from the tables to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.plans import tables as t
from loomcube.sources import readers
from loomcube.storage import shared_dir


#: Records of an XML file that is written here: Spark reads such a file as one piece.
XML_RECORDS = 50_000


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, lines: DataFrame, separator: str = "\n") -> str:
    path = _path(spark)
    lines.write.option("lineSep", separator).text(path)
    return path


def _whole(spark: SparkSession, lines: DataFrame) -> str:
    """One file, for formats that are one value."""
    return _lines(spark, lines.coalesce(1))


def _tabs(spark: SparkSession, table: DataFrame, *columns: Column | str, header: str | None = None, separator: str = "\t") -> str:
    if header is not None:
        path = _path(spark)
        table.select(*(F.col(c) if isinstance(c, str) else c for c in columns)).toDF(*header.split()).write.csv(path, sep=separator, header=True)
        return path
    return _lines(spark, table.select(F.concat_ws(separator, *columns).alias("value")))


def _text(column: str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _articles_json(spark, d):
    docs = t.table(spark, d, "documents")
    made = docs.select(
        _text("doc_id").alias("PMID"), F.col("lang").alias("ArticleTitle"), F.col("text").alias("Abstract"), F.array("source").alias("MeshHeadingList"),
        F.struct(F.when(F.col("lang") == "en", F.lit("2001")).alias("Year"), F.lit("1998 Spring").alias("MedlineDate")).alias("PubDate"),
    )
    path = _path(spark)
    made.write.json(path)
    got = readers.with_year(readers.read_articles_json(spark, path))
    return got.select("PMID", "ArticleTitle", F.md5("Abstract").alias("digest"), F.get("MeshHeadingList", F.lit(0)).alias("heading"), F.col("year").cast("long").alias("year"))


def _articles_xml(spark, d):
    docs = t.table(spark, d, "documents")
    made = docs.select(F.struct(
        _text("doc_id").alias("PMID"),
        F.struct(F.col("source").alias("ArticleTitle"), F.struct(F.array("lang", "source").alias("AbstractText")).alias("Abstract")).alias("Article"),
    ).alias("MedlineCitation"))
    path = _path(spark)
    made.write.option("maxRecordsPerFile", XML_RECORDS).format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").save(path)
    return readers.read_articles_xml(spark, path).select("PMID", "ArticleTitle", "Abstract")


def _full_text(spark, d):
    pages = t.table(spark, d, "pages")
    xml = F.format_string('<article><article-id pub-id-type="pmid">%d</article-id><article-id pub-id-type="pmc">PMC%d</article-id><body><p>%s</p></body></article>', "page_id", F.col("page_id") + 1, "url")
    files = pages.select(F.concat(F.lit("PMC"), (F.col("page_id") + 1).cast("string")).alias("pmcid"), "url")
    wanted = files.filter("url LIKE '%5.example%' OR url LIKE '%/1%'")
    return readers.wanted_full_texts(spark, _lines(spark, pages.select(xml.alias("value"))), files, wanted)


def _obo(spark, d):
    n = t.table(spark, d, "nation").join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    low = n.select(F.format_string("[Term]\nid: N:%d\nname: %s\nnamespace: %s\nis_a: R:%d ! %s", "n_nationkey", "n_name", "r_name", "r_regionkey", "r_name").alias("value"))
    top = t.table(spark, d, "region").select(F.format_string("[Term]\nid: R:%d\nname: %s\nnamespace: %s", "r_regionkey", "r_name", "r_name").alias("value"))
    return readers.read_obo(spark, _lines(spark, low.unionByName(top), "\n\n"))


def _gaf(spark, d):
    lines = t.table(spark, d, "lineitem")
    other = [F.lit("x")] * 11
    relation = F.when(F.col("l_returnflag") == "R", "NOT|located_in").otherwise("involved_in")
    path = _tabs(spark, lines, F.lit("db"), _text("l_suppkey", "S"), F.lit("sym"), relation, _text("l_partkey", "P"), *other, F.lit("x"))
    return readers.read_gaf(spark, path, negated=False)


def _descriptors(spark, d):
    made = t.tree(spark, d).groupBy("name").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    made = made.select(F.concat(F.lit("D"), F.md5("name")).alias("DescriptorUI"), F.struct(F.col("name").alias("String")).alias("DescriptorName"), F.struct(F.col("codes").alias("TreeNumber")).alias("TreeNumberList"))
    path = _path(spark)
    made.write.option("maxRecordsPerFile", XML_RECORDS).format("xml").option("rowTag", "DescriptorRecord").option("rootTag", "DescriptorRecordSet").save(path)
    return readers.read_descriptors_xml(spark, path, "^R[01]").select("name", "code")


def _tree(spark, d):
    return readers.read_tree(spark, _tabs(spark, t.tree(spark, d), "name", "code", separator=";"))


def _pathway_rows(spark, d):
    species = F.when(F.col("p_size") <= 25, "Homo sapiens").otherwise("Mus musculus")
    return readers.read_pathways(spark, _tabs(spark, t.table(spark, d, "part"), _text("p_partkey", "P"), "p_type", F.lit("url"), F.lit("name"), F.lit("IEA"), species))


def _hierarchy(spark, d):
    n = t.table(spark, d, "nation")
    return readers.read_pathway_hierarchy(spark, _tabs(spark, n, F.format_string("R-%s-%d", F.when(F.col("n_regionkey") < 3, "HSA").otherwise("MMU"), "n_regionkey"), _text("n_nationkey", "R-HSA-1")))


def _regulators(spark, d):
    sure = F.when(F.col("l_quantity") > 25, "High").otherwise("Low")
    return readers.read_regulators(spark, _tabs(spark, t.table(spark, d, "lineitem"), _text("l_suppkey", "TF"), _text("l_partkey", "G"), F.lit(1), F.lit(2), F.lit(3), sure))


def _fasta(spark, d):
    entry = F.format_string(">sp|P%d|%s\nMKV\nLAA", "p_partkey", "p_name").alias("value")
    return readers.read_fasta_ids(spark, _lines(spark, t.table(spark, d, "part").select(entry)))


def _interactions(spark, d):
    taxon = F.when(F.col("l_linestatus") == "O", "9606.").otherwise("10090.")
    rows = t.table(spark, d, "lineitem").select(F.concat(taxon, _text("l_suppkey")).alias("a"), F.concat(F.lit("9606."), _text("l_partkey", "p")).alias("b"), (F.col("l_discount") * 100).cast("int").cast("double").alias("s"))
    path = _tabs(spark, rows, "a", F.lit("n"), "b", F.lit("m"), "s", header="query_ensp query_name partner_ensp partner_name combined_score")
    return readers.read_interactions(spark, path, threshold=5.0)


def _id_map(spark, d):
    rows = t.table(spark, d, "customer")
    path = _tabs(spark, rows, "c_mktsegment", _text("c_custkey", "C"), F.lit("nation"), _text("c_nationkey", "N"), (F.col("c_acctbal") > 0).cast("string"), F.lit("9606"), header="from_db from_id to_db to_id reviewed taxon")
    return readers.id_map(readers.read_id_map(spark, path), "BUILDING", "nation")


def _synonyms(spark, d):
    rows = t.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    one = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "names")))).alias("value"))
    return readers.read_entity_synonyms(spark, _whole(spark, one))


def _synonym_lines(spark, d):
    return readers.read_synonym_lines(spark, _tabs(spark, t.table(spark, d, "supplier"), _text("s_suppkey", "S_"), "s_name", _text("s_nationkey", "n_"), separator="|"))


def _entity_counts(spark, d):
    pairs = t.document_entities(spark, d)
    line = F.concat_ws(" ", _text("doc_id"), F.array_join(F.collect_list(F.concat_ws("|", F.col("entity"), F.col("cnt").cast("string"))), " ")).alias("value")
    return readers.read_entity_counts(spark, _lines(spark, pairs.groupBy("doc_id").agg(line).select("value")))


def _roots(spark, d):
    rows = t.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(_text("n_nationkey", "N"))), " ").alias("value"))
    one = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_regionkey", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return readers.read_category_roots(spark, _whole(spark, one), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


def _document_categories(spark, d):
    one = t.table(spark, d, "customer").agg(F.to_json(F.collect_list(F.array(_text("c_custkey"), _text("c_nationkey")))).alias("value"))
    return readers.read_document_categories(spark, _whole(spark, one)).select("doc_id", F.col("cat_num").cast("long").alias("cat_num"))


def _graph(spark, d):
    n = t.table(spark, d, "nation")
    edges = _tabs(spark, n, _text("n_nationkey", "N"), F.lit("is_in"), _text("n_regionkey", "R"), (F.col("n_nationkey") / 4).cast("string"), header="head relation tail weight")
    nodes = _tabs(spark, n, _text("n_nationkey", "N"), F.lit("Nation"), header="node node_type")
    e, v = readers.read_graph(spark, edges, nodes)
    return e.join(v, e["head"] == v["node"]).select("head", "relation", "tail", "weight", "node_type")


def _score_table(spark, d):
    rows = t.table(spark, d, "part")
    return readers.read_score_table(spark, _tabs(spark, rows, _text("p_partkey", "P"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), header="entity price size", separator=","), ["price", "size"])


def _predictions(spark, d):
    rows = t.table(spark, d, "supplier")
    path = _tabs(spark, rows, _text("s_suppkey"), F.col("s_acctbal").cast("string"), "s_name", _text("s_nationkey", "N"), header="i predictions sources destinations", separator=",")
    return readers.read_predictions(spark, path)


def _clusters(spark, d):
    rows = t.table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.collect_set(_text("p_size", "U")), "; ").alias("entities"))
    return readers.clusters_by_entity(readers.read_uniref(spark, _tabs(spark, rows, "p_type", "entities")))


def _records(spark, d):
    part = t.table(spark, d, "part")
    made = part.select(_text("p_partkey", "D").alias("r"), F.explode(F.array(F.struct(F.lit("NAME").alias("k"), F.col("p_name").alias("v")), F.struct(F.lit("XREF").alias("k"), F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type")).alias("v")), F.struct(F.lit("SKIP").alias("k"), F.lit("x").alias("v")))).alias("x"))
    return readers.read_tagged_records(spark, _tabs(spark, made, "r", "x.k", "x.v"), ["NAME", "XREF"])


def _drugs(spark, d):
    part = t.table(spark, d, "part")
    target = F.struct(_text("p_size", "T").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") <= 25, "Humans").otherwise("Mice").alias("organism"))
    made = part.select(F.array(_text("p_partkey", "DB"), F.lit("old")).alias("drugbank-id"), F.col("p_name").alias("name"), F.struct(F.array("p_brand").alias("synonym")).alias("synonyms"), F.struct(F.array(target).alias("target")).alias("targets"))
    path = _path(spark)
    made.write.option("maxRecordsPerFile", XML_RECORDS).format("xml").option("rowTag", "drug").option("rootTag", "drugbank").save(path)
    return readers.read_drugs_xml(spark, path).select("id", "name", F.get("synonyms", F.lit(0)).alias("synonym"), F.array_join("targets", "|").alias("targets"))


def _entity_names(spark, d):
    def value(c):
        return F.struct(F.col(c).alias("value"))

    part = t.table(spark, d, "part").select(_text("p_partkey", "P").alias("k"), "p_name", "p_brand", "p_type")
    described = F.struct(F.struct(value("p_name").alias("fullName"), F.array(value("p_brand")).alias("shortNames")).alias("recommendedName"))
    made = part.select(F.col("k").alias("primaryAccession"), described.alias("proteinDescription"), F.array(F.struct(value("p_type").alias("geneName"))).alias("genes"))
    path = _path(spark)
    made.write.json(path)
    return readers.read_entity_names_json(spark, path)


def _ranked(spark, d):
    def row(category, k):
        return F.struct(F.lit(category).alias("category"), F.col("p_size").cast("long").alias("position"), _text("p_partkey", "P").alias("entity"), (F.col("p_retailprice") / k).alias("score"), F.when(F.lit(category == "TOTAL"), F.array("p_name", "p_type")).alias("synonyms"))

    made = t.table(spark, d, "part").select(F.explode(F.array(row("TOTAL", 1), row("A", 2), row("B", 4))).alias("r")).select("r.*")
    path = _path(spark)
    made.write.json(path)
    got = readers.read_ranked_entities(spark, path)
    return got.select("category", "position", "entity", F.round("score", 6).alias("score"), F.array_join("synonyms", "|").alias("synonyms"))


def _sets(spark, d):
    members = t.pathway_members(spark, d).withColumn("entity", F.concat("entity", F.lit("-2")))
    return readers.pathway_sets(members.unionByName(t.pathway_members(spark, d))).select("pathway", "size", F.md5(F.array_join("entities", "|")).alias("digest"))


QUERIES = {
    "src_articles_json": _articles_json,
    "src_articles_xml": _articles_xml,
    "src_wanted_full_texts": _full_text,
    "src_obo_terms": lambda s, d: readers.obo_terms(_obo(s, d)),
    "src_obo_edges": lambda s, d: readers.obo_edges(_obo(s, d)),
    "src_gaf": _gaf,
    "src_descriptors": _descriptors,
    "src_tree": _tree,
    "src_pathways": _pathway_rows,
    "src_pathway_hierarchy": _hierarchy,
    "src_regulators": _regulators,
    "src_fasta_ids": _fasta,
    "src_interactions": _interactions,
    "src_id_map": _id_map,
    "src_entity_synonyms": _synonyms,
    "src_synonym_lines": _synonym_lines,
    "src_entity_counts": _entity_counts,
    "src_category_roots": _roots,
    "src_document_categories": _document_categories,
    "src_graph": _graph,
    "src_score_table": _score_table,
    "src_predictions": _predictions,
    "src_clusters": _clusters,
    "src_tagged_records": lambda s, d: _records(s, d).select("record", F.get("NAME", F.lit(0)).alias("name"), F.get("XREF", F.lit(0)).alias("xref")),
    "src_cross_references": lambda s, d: readers.cross_references(_records(s, d), "XREF"),
    "src_drugs": _drugs,
    "src_entity_names": _entity_names,
    "src_ranked_entities": _ranked,
    "src_pathway_sets": _sets,
    "src_set_sizes": lambda s, d: readers.size_statistics(readers.pathway_sets(t.pathway_members(s, d))).select("mean", "median", F.round("deviation", 6).alias("deviation")),
}

SQL = {
    "src_articles_json": "SELECT CAST(doc_id AS VARCHAR) AS PMID, lang AS ArticleTitle, md5(text) AS digest, source AS heading, CAST(CASE WHEN lang = 'en' THEN 2001 ELSE 1998 END AS BIGINT) AS year FROM documents",
    "src_articles_xml": "SELECT CAST(doc_id AS VARCHAR) AS PMID, source AS ArticleTitle, lang || chr(10) || source AS Abstract FROM documents",
    "src_wanted_full_texts": "SELECT CAST(page_id AS VARCHAR) AS pmid, CAST(page_id + 1 AS VARCHAR) AS pmcid, url AS body FROM pages WHERE url LIKE '%5.example%' OR url LIKE '%/1%'",
    "src_obo_terms": "SELECT 'N:' || n_nationkey AS id, n_name AS name, r_name AS namespace FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R:' || r_regionkey, r_name, r_name FROM region",
    "src_obo_edges": "SELECT 'R:' || n_regionkey AS parent, 'N:' || n_nationkey AS child FROM nation",
    "src_gaf": "SELECT DISTINCT 'S' || l_suppkey AS entity, 'involved_in' AS relation, 'P' || l_partkey AS term FROM lineitem WHERE l_returnflag <> 'R'",
    "src_descriptors": f"WITH {t.TREE_SQL} SELECT name, code FROM tree WHERE code LIKE 'R0%' OR code LIKE 'R1%'",
    "src_tree": f"WITH {t.TREE_SQL} SELECT name AS term, code FROM tree",
    "src_pathways": "SELECT DISTINCT 'P' || p_partkey AS entity, p_type AS pathway FROM part WHERE p_size <= 25",
    "src_pathway_hierarchy": "SELECT 'R-HSA-' || n_regionkey AS parent, 'R-HSA-1' || n_nationkey AS child FROM nation WHERE n_regionkey < 3",
    "src_regulators": "SELECT DISTINCT 'TF' || l_suppkey AS tf_gene, 'G' || l_partkey AS target_gene FROM lineitem WHERE l_quantity > 25",
    "src_fasta_ids": "SELECT 'P' || p_partkey AS entity FROM part",
    "src_interactions": "SELECT DISTINCT '9606.' || l_suppkey AS src, '9606.p' || l_partkey AS dst, CAST(trunc(l_discount * 100) AS DOUBLE) AS score FROM lineitem WHERE l_linestatus = 'O' AND trunc(l_discount * 100) >= 5",
    "src_id_map": "SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    "src_entity_synonyms": "SELECT DISTINCT p_brand AS entity, unnest([p_brand, replace(p_name, '_', ' ')]) AS synonym FROM part",
    "src_synonym_lines": "SELECT 'S_' || s_suppkey AS entity, unnest(['S ' || s_suppkey, replace(s_name, '_', ' '), 'n ' || s_nationkey]) AS synonym FROM supplier",
    "src_entity_counts": "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, p_brand AS entity, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "src_category_roots": "SELECT (['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'])[n_regionkey + 1] AS category, 'N' || n_nationkey AS root FROM nation",
    "src_document_categories": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(c_nationkey AS BIGINT) AS cat_num FROM customer",
    "src_graph": "SELECT 'N' || n_nationkey AS head, 'is_in' AS relation, 'R' || n_regionkey AS tail, n_nationkey / 4 AS weight, 'Nation' AS node_type FROM nation",
    "src_score_table": "SELECT 'P' || p_partkey AS entity, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part",
    "src_predictions": "SELECT s_acctbal AS predictions, s_name AS sources, 'N' || s_nationkey AS destinations FROM supplier",
    "src_clusters": "SELECT 'U' || p_size AS entity, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS clusters FROM part GROUP BY p_size",
    "src_tagged_records": "SELECT 'D' || p_partkey AS record, p_name AS name, p_brand || '; ' || p_type AS xref FROM part",
    "src_cross_references": "SELECT 'D' || p_partkey AS id, unnest([p_brand, p_type]) AS xref FROM part",
    "src_drugs": "SELECT 'DB' || p_partkey AS id, p_name AS name, p_brand AS synonym, CASE WHEN p_size <= 25 THEN 'T' || p_size ELSE '' END AS targets FROM part",
    "src_entity_names": "SELECT DISTINCT 'P' || p_partkey AS entity, unnest([p_name, p_brand, p_type]) AS name FROM part",
    "src_ranked_entities": "SELECT c.category, CAST(p_size AS BIGINT) AS position, 'P' || p_partkey AS entity, round(p_retailprice / c.k, 6) AS score, p_name || '|' || p_type AS synonyms FROM part, (VALUES ('A', 2), ('B', 4)) AS c(category, k)",
    "src_pathway_sets": f"WITH {t.MEMBERS_SQL} SELECT pathway, count(DISTINCT entity) AS size, md5(string_agg(DISTINCT entity, '|' ORDER BY entity)) AS digest FROM members GROUP BY pathway",
    "src_set_sizes": f"WITH {t.MEMBERS_SQL}, n AS (SELECT count(DISTINCT entity) AS size FROM members GROUP BY pathway) SELECT avg(size) AS mean, median(size) AS median, round(stddev_pop(size), 6) AS deviation FROM n",
}
