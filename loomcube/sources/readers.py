"""Readers of articles, ontologies, annotations, interactions and lexicons into typed DataFrames.

All take paths that Spark can open; compressed text is read as it is. Schemas are stated, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcube.functions.text import publication_year

AUTHOR = "struct<LastName:string,ForeName:string,Initials:string,Suffix:string,CollectiveName:string>"
#: The document schema at every stage boundary.
ARTICLE = (
    f"PMID string, ArticleTitle string, Abstract string, MeshHeadingList array<string>, full_text string, AuthorList array<{AUTHOR}>, "
    "Journal string, PubDate struct<Year:string,Month:string,Day:string,Season:string,MedlineDate:string>, Country string"
)


def _present(*parts: Column) -> Column:
    return F.coalesce(*parts, F.lit(""))


def read_articles_xml(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Articles and book documents of XML files, in the schema :data:`ARTICLE`, with ``file`` they came from.

    An abstract is its parts joined by line breaks; one empty part makes it empty. ``pattern`` filters file names.
    """
    date = "struct<Year:string,Month:string,Day:string,Season:string,MedlineDate:string>"
    authors = f"struct<Author:array<{AUTHOR}>>"
    article = (
        f"struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:{authors},"
        f"Journal:struct<Title:string,JournalIssue:struct<PubDate:{date}>>>"
    )
    headings = "struct<MeshHeading:array<struct<DescriptorName:string,QualifierName:array<string>>>>"
    journal = f"MedlineCitation struct<PMID:string,Article:{article},MeshHeadingList:{headings},MedlineJournalInfo:struct<Country:string>>"
    book = f"BookDocument struct<PMID:string,ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:{authors},Book:struct<BookTitle:string,PubDate:{date}>>"

    def load(tag: str, schema: str) -> DataFrame:
        reader = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").schema(schema)
        reader = reader.option("pathGlobFilter", pattern) if pattern else reader
        return reader.load(path).withColumn("file", F.col("_metadata.file_name"))

    def abstract(parts: str) -> Column:
        whole = F.when(F.exists(parts, lambda p: p.isNull() | (p == "")), F.lit("")).otherwise(F.array_join(parts, "\n"))
        return F.coalesce(whole, F.lit(""))

    a, m = "MedlineCitation.Article", "MedlineCitation"
    terms = F.flatten(F.transform(f"{m}.MeshHeadingList.MeshHeading", lambda h: F.concat(F.array(h["DescriptorName"]), F.coalesce(h["QualifierName"], F.array().cast("array<string>")))))
    none = F.array().cast("array<string>")
    articles = load("PubmedArticle", journal).select(
        _present(F.col(f"{m}.PMID")).alias("PMID"), _present(F.col(f"{a}.ArticleTitle")).alias("ArticleTitle"), abstract(f"{a}.Abstract.AbstractText").alias("Abstract"),
        F.coalesce(terms, none).alias("MeshHeadingList"), F.lit("").alias("full_text"), F.col(f"{a}.AuthorList.Author").alias("AuthorList"),
        _present(F.col(f"{a}.Journal.Title")).alias("Journal"), F.col(f"{a}.Journal.JournalIssue.PubDate").alias("PubDate"), _present(F.col(f"{m}.MedlineJournalInfo.Country")).alias("Country"), "file",
    )
    b = "BookDocument"
    books = load("PubmedBookArticle", book).select(
        _present(F.col(f"{b}.PMID")).alias("PMID"), _present(F.col(f"{b}.ArticleTitle"), F.col(f"{b}.Book.BookTitle")).alias("ArticleTitle"), abstract(f"{b}.Abstract.AbstractText").alias("Abstract"),
        none.alias("MeshHeadingList"), F.lit("").alias("full_text"), F.col(f"{b}.AuthorList.Author").alias("AuthorList"),
        F.lit("").alias("Journal"), F.col(f"{b}.Book.PubDate").alias("PubDate"), F.lit("").alias("Country"), "file",
    )
    return articles.unionByName(books)


def with_year(articles: DataFrame) -> DataFrame:
    return articles.withColumn("year", publication_year(F.col("PubDate.Year"), F.col("PubDate.MedlineDate")))


def documents_per_file(articles: DataFrame) -> DataFrame:
    return articles.groupBy("file").agg(F.count_distinct("PMID").alias("n_documents"))


def read_articles_json(spark: SparkSession, path: str) -> DataFrame:
    """One article a line."""
    return spark.read.schema(ARTICLE).json(path)


def read_xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``record``: each element ``tag`` of XML files as text, without its end tag.

    Files are cut at the end tags while they are read, so that a large one is many splits and no task holds more
    than a record at a time; a record across a boundary of splits comes once. Elements of a kind must not be nested.
    """
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    return raw.select(F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1).alias("record")).filter("record <> ''")


def read_full_text_xml(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, pmcid, body`` of full-text articles; the body is all text of its paragraphs and titles."""
    each = read_xml_records(spark, path, "article").select(F.col("record").alias("x"))

    def ident(kind: str) -> Column:
        return F.regexp_extract("x", rf'<article-id[^>]*pub-id-type="{kind}"[^>]*>\s*([^<\s]+)', 1)

    body = F.regexp_extract("x", r"(?s)<body[^>]*>(.*)</body>", 1)
    return each.select(ident("pmid").alias("pmid"), F.regexp_replace(ident("pmc"), "^PMC", "").alias("pmcid"), F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"\s+", " ")).alias("body"))


def verify_digests(spark: SparkSession, path: str, pattern: str = "*.gz") -> DataFrame:
    """``file, ok``: MD5 of each file against the digest in its side file ``<name>.md5``; null without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    own = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.md5("content").alias("digest"))
    side = spark.read.text(path, wholetext=True, pathGlobFilter="*.md5").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md5$", "").alias("file"), F.regexp_extract("value", "([0-9a-fA-F]{32})", 1).alias("said"))
    return own.join(side, "file", "left").select("file", (F.col("digest") == F.lower("said")).alias("ok"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """``id, key, value`` of the ``key: value`` lines of each ontology record; an obsolete record keeps its lines."""
    records = spark.read.text(path, lineSep="\n\n")
    lines = F.filter(F.split("value", "\n"), lambda x: F.contains(x, F.lit(": ")))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.expr("1").alias("one"), x.alias("line")))
    rows = records.select(F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("id"), F.explode(pairs).alias("p")).filter("id <> ''")
    value = F.expr("substring(p.line, length(p.key) + 3)")
    return rows.select("id", F.col("p.key").alias("key"), F.trim(value).alias("value")).filter("key <> 'id'")


def obo_terms(obo: DataFrame) -> DataFrame:
    """``id, name, namespace``."""
    return obo.filter("key IN ('name', 'namespace')").groupBy("id").pivot("key", ["name", "namespace"]).agg(F.first("value"))


def obo_edges(obo: DataFrame) -> DataFrame:
    """``parent, child`` of ``is_a`` and ``part_of`` lines."""
    target = F.regexp_extract("value", r"^(?:part_of )?([A-Za-z]+:\d+)", 1)
    lines = obo.filter("key = 'is_a' OR (key = 'relationship' AND value LIKE 'part_of %')")
    return lines.select(target.alias("parent"), F.col("id").alias("child")).filter("parent <> ''").distinct()


def valid_ids(spark: SparkSession, path: str, prefix: str = "GO") -> DataFrame:
    """Ids of whole ``id:`` lines; alternative ids are none."""
    return spark.read.text(path).select(F.regexp_extract("value", rf"^id: ({prefix}:\d+)", 1).alias("id")).filter("id <> ''").distinct()


def read_gaf(spark: SparkSession, path: str, negated: bool = True) -> DataFrame:
    """``entity, relation, term`` of annotation files; comment lines start with ``!``. ``negated`` keeps ``NOT`` relations."""
    rows = spark.read.csv(path, sep="\t", comment="!", schema=", ".join(f"c{i} string" for i in range(17)))
    out = rows.select(F.col("c1").alias("entity"), F.col("c3").alias("relation"), F.col("c4").alias("term")).distinct()
    return out if negated else out.filter(~F.contains("relation", F.lit("NOT")))


def ontology_bundle(spark: SparkSession, obo_path: str, gaf_path: str) -> dict[str, DataFrame]:
    """Terms, hierarchy, annotations, and annotations by term name of each namespace."""
    obo = read_obo(spark, obo_path)
    terms, notes = obo_terms(obo), read_gaf(spark, gaf_path)
    named = notes.join(terms, notes["term"] == terms["id"]).select("entity", "name", "namespace").distinct()
    out = {"terms": terms, "edges": obo_edges(obo), "annotations": notes}
    return out | {f"names_{n}": named.filter(F.col("namespace") == n).select("entity", "name") for n in ("biological_process", "cellular_component", "molecular_function")}


def read_descriptors_xml(spark: SparkSession, path: str, trees: str = "^(C|F03)") -> DataFrame:
    """``id, name, code`` of descriptors, a row per tree number that matches ``trees``."""
    schema = "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>"
    rows = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    return rows.select(F.col("DescriptorUI").alias("id"), F.col("DescriptorName.String").alias("name"), F.explode("TreeNumberList.TreeNumber").alias("code")).filter(F.col("code").rlike(trees))


def tree_problems(tree: DataFrame) -> DataFrame:
    """Codes with several ids and ids with several names; none are expected."""
    codes = tree.groupBy("code").agg(F.count_distinct("id").alias("n")).filter("n > 1").select(F.lit("code").alias("kind"), F.col("code").alias("key"), "n")
    return codes.unionByName(tree.groupBy("id").agg(F.count_distinct("name").alias("n")).filter("n > 1").select(F.lit("id").alias("kind"), F.col("id").alias("key"), "n"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """``term, code`` of ``term;tree_number`` lines."""
    return spark.read.csv(path, sep=";", schema="term string, code string")


def read_pathways(spark: SparkSession, path: str, species: str = "homo sapiens", columns: tuple[int, int, int] = (0, 1, 5)) -> DataFrame:
    """Distinct ``entity, pathway`` of a species, from the stated columns (entity, pathway, species)."""
    e, p, s = columns
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"c{i} string" for i in range(max(columns) + 1)))
    return rows.filter(F.lower(F.trim(f"c{s}")) == species.lower()).select(F.col(f"c{e}").alias("entity"), F.col(f"c{p}").alias("pathway")).distinct()


def read_pathway_hierarchy(spark: SparkSession, path: str, part: str = "HSA") -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="parent string, child string")
    return rows.filter(F.contains("parent", F.lit(part)) & F.contains("child", F.lit(part))).distinct()


def read_pathway_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id string, name string, species string").select("id", "name")


def pathway_sets(members: DataFrame, merge_isoforms: bool = True) -> DataFrame:
    """``pathway, entities, size``; isoforms ``P1-2`` count as ``P1``."""
    entity = F.substring_index("entity", "-", 1) if merge_isoforms else F.col("entity")
    own = members.groupBy("pathway").agg(F.sort_array(F.collect_set(entity)).alias("entities"))
    return own.withColumn("size", F.size("entities").cast("long"))


def size_statistics(sets: DataFrame) -> DataFrame:
    return sets.agg(F.avg("size").alias("mean"), F.median("size").alias("median"), F.stddev_pop("size").alias("deviation"))


def read_regulators(spark: SparkSession, path: str, confidence: str = "High", stop_at_errors: bool = False) -> DataFrame:
    """Distinct ``tf_gene, target_gene`` of high confidence from a folder of tables with a header.

    With ``stop_at_errors`` a file counts up to its first line of fewer than six fields only.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    if stop_at_errors:
        place = F.struct("block", "i")
        ends = lines.filter("size(c) < 6").groupBy("file").agg(F.min(place).alias("end"))
        lines = lines.join(F.broadcast(ends), "file", "left").filter(F.col("end").isNull() | (place < F.col("end")))
    rows = lines.filter(F.get("c", F.lit(5)) == confidence)
    return rows.select(F.get("c", F.lit(0)).alias("tf_gene"), F.get("c", F.lit(1)).alias("target_gene")).distinct()


def read_fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """``entity``: accessions of the header lines ``>db|ACCESSION|…``."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit(">")))
    return lines.select(F.get(F.split("value", r"\|"), F.lit(1)).alias("entity")).filter("entity IS NOT NULL").distinct()


def read_interactions(spark: SparkSession, path: str, taxon: str = "9606", threshold: float = 0.0) -> DataFrame:
    """``src, dst, score``: interaction rows at or above a score whose two ids are of a taxon, which precedes a point."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_ensp string, query_name string, partner_ensp string, partner_name string, combined_score double")
    own = rows.filter(F.startswith("query_ensp", F.lit(f"{taxon}.")) & F.startswith("partner_ensp", F.lit(f"{taxon}.")) & (F.col("combined_score") >= threshold))
    return own.select(F.col("query_ensp").alias("src"), F.col("partner_ensp").alias("dst"), F.col("combined_score").alias("score")).distinct()


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """The static table that stands for identifier services: ``from_db, from_id, to_db, to_id, reviewed, taxon``."""
    return spark.read.csv(path, sep="\t", header=True, schema="from_db string, from_id string, to_db string, to_id string, reviewed boolean, taxon string")


def id_map(table: DataFrame, source: str, target: str, reviewed: bool | None = True, taxa: list[str] | None = None) -> DataFrame:
    """``src, dst`` between two databases."""
    own = table.filter((F.col("from_db") == source) & (F.col("to_db") == target))
    own = own if reviewed is None else own.filter(F.col("reviewed") == reviewed)
    own = own.filter(F.col("taxon").isin(taxa)) if taxa else own
    return own.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


def read_entity_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``entity, synonym`` from a JSON object of lists, or from lines ``id|synonym|…``; ids are synonyms, ``_`` a blank."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("entity", "synonyms"))
    return with_own_id(parsed)


def read_synonym_lines(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\|")
    return with_own_id(spark.read.text(path).select(F.get(parts, F.lit(0)).alias("entity"), F.slice(parts, 2, 1 << 20).alias("synonyms")))


def with_own_id(table: DataFrame) -> DataFrame:
    every = F.concat(F.array("entity"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return table.select("entity", F.explode(every).alias("synonym")).select("entity", F.replace("synonym", F.lit("_"), F.lit(" ")).alias("synonym")).filter("synonym <> ''").distinct()


def read_entity_counts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, entity, cnt`` of lines ``PMID ent|n ent|n``; an entity that a line repeats has the sum."""
    rows = spark.read.text(path).select(F.substring_index("value", " ", 1).alias("doc_id"), F.expr("substring(value, length(substring_index(value, ' ', 1)) + 2)").alias("rest"))
    pairs = rows.select("doc_id", F.explode(F.split(F.trim("rest"), " +")).alias("pair")).filter("pair <> ''")
    parts = pairs.select("doc_id", F.substring_index("pair", "|", 1).alias("entity"), F.substring_index("pair", "|", -1).try_cast("long").alias("cnt"))
    return parts.groupBy("doc_id", "entity").agg(F.sum("cnt").alias("cnt"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file without the white space around them."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("id")).filter("id <> ''").distinct()


def read_category_roots(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``category, root``: the roots on line i belong to the i-th name."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("i", "line"))
    return lines.select(F.get(F.array(*map(F.lit, names)), F.col("i")).alias("category"), F.explode(F.split(F.trim("line"), r"\s+")).alias("root")).filter("root <> '' AND category IS NOT NULL")


def read_document_categories(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, cat_num`` of a JSON list of pairs."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    return pairs.select(F.get("p", F.lit(0)).alias("doc_id"), F.get("p", F.lit(1)).cast("int").alias("cat_num")).distinct()


def read_graph(spark: SparkSession, edges: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """Edge and node lists with headers ``head relation tail weight`` and ``node node_type``."""
    e = spark.read.csv(edges, sep="\t", header=True, schema="head string, relation string, tail string, weight double")
    return e, spark.read.csv(nodes, sep="\t", header=True, schema="node string, node_type string")


def read_score_table(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(["entity string", *(f"`{c}` double" for c in categories)]))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="i long, predictions double, sources string, destinations string")
    return rows.drop("i")


def read_uniref(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, entity`` of rows ``cluster <tab> entity; entity``."""
    rows = spark.read.csv(path, sep="\t", schema="cluster string, entities string")
    return rows.select("cluster", F.explode(F.split("entities", r";\s*")).alias("entity")).filter("entity <> ''").distinct()


def clusters_by_entity(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("cluster")), "; ").alias("clusters"))


def read_tagged_records(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """A row per record of lines ``record <tab> tag <tab> value``; several values of a tag are a list."""
    rows = spark.read.csv(path, sep="\t", schema="record string, tag string, value string").filter(F.col("tag").isin(tags))
    return rows.groupBy("record").pivot("tag", tags).agg(F.sort_array(F.collect_set("value")))


def read_drugs_xml(spark: SparkSession, path: str) -> DataFrame:
    """Ids, names, descriptions, groups and targets of drug records; targets of humans only."""
    schema = T.StructType.fromDDL(
        "`drugbank-id` array<string>, name string, description string, `cas-number` string, unii string, indication string, "
        "synonyms struct<synonym:array<string>>, categories struct<category:array<struct<category:string>>>, "
        "`atc-codes` struct<`atc-code`:array<struct<`_code`:string>>>, pathways struct<pathway:array<struct<name:string>>>, "
        "`external-identifiers` struct<`external-identifier`:array<struct<resource:string,identifier:string>>>, "
        "targets struct<target:array<struct<id:string,name:string,organism:string>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "drug").schema(schema).load(path)
    human = F.filter("targets.target", lambda t: t["organism"] == "Humans")
    return rows.select(
        F.get("drugbank-id", F.lit(0)).alias("id"), "name", "description", F.col("cas-number").alias("cas"), "unii", "indication", F.col("synonyms.synonym").alias("synonyms"),
        F.col("categories.category.category").alias("categories"), F.col("`atc-codes`.`atc-code`.`_code`").alias("atc_codes"), F.col("pathways.pathway.name").alias("pathways"),
        F.col("`external-identifiers`.`external-identifier`").alias("external_ids"), F.transform(human, lambda t: t["id"]).alias("targets"),
    ).filter("id IS NOT NULL")


def read_entity_names_json(spark: SparkSession, path: str) -> DataFrame:
    """``entity, name``: recommended, alternative and submitted names, short names, EC numbers and genes of entity records."""
    value = "struct<value:string>"
    name = f"struct<fullName:{value},shortNames:array<{value}>,ecNumbers:array<{value}>>"
    schema = (
        f"primaryAccession string, proteinDescription struct<recommendedName:{name},alternativeNames:array<{name}>,submissionNames:array<{name}>>, "
        f"genes array<struct<geneName:{value},synonyms:array<{value}>>>"
    )
    rows = spark.read.schema(schema).json(path)
    d = "proteinDescription"
    none = F.array().cast(f"array<{name}>")
    groups = F.concat(F.array(f"{d}.recommendedName"), F.coalesce(f"{d}.alternativeNames", none), F.coalesce(f"{d}.submissionNames", none))
    empty = F.array().cast(f"array<{value}>")
    names = F.flatten(F.transform(groups, lambda g: F.concat(F.array(g["fullName"]), F.coalesce(g["shortNames"], empty), F.coalesce(g["ecNumbers"], empty))))
    genes = F.flatten(F.transform("genes", lambda g: F.concat(F.array(g["geneName"]), F.coalesce(g["synonyms"], empty))))
    every = F.concat(names, F.coalesce(genes, empty))
    return rows.select(F.col("primaryAccession").alias("entity"), F.explode(every).alias("n")).select("entity", F.col("n.value").alias("name")).filter("name IS NOT NULL").distinct()


def wanted_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows ``file, pmcid`` of a file list that are wanted."""
    return files.join(wanted.select("pmcid").distinct(), "pmcid", "left_semi")


def wanted_full_texts(spark: SparkSession, folder: str, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pmid, pmcid, body`` of the wanted articles of an extracted bulk download under ``folder``."""
    texts = read_full_text_xml(spark, folder)
    return texts.join(wanted_files(files, wanted).select(F.regexp_replace("pmcid", "^PMC", "").alias("pmcid")).distinct(), "pmcid", "left_semi").select("pmid", "pmcid", "body")


def cross_references(records: DataFrame, tag: str, id_pattern: str = r"[^;,\s]+") -> DataFrame:
    """``id, xref``: the identifiers that the lists under a tag of :func:`read_tagged_records` hold."""
    values = F.explode(F.col(f"`{tag}`")).alias("v")
    return records.select(F.col("record").alias("id"), values).select("id", F.explode(F.regexp_extract_all("v", F.lit(f"({id_pattern})"), F.lit(1))).alias("xref")).distinct()


def load_resources(spark: SparkSession, folder: str, resources: list[str], needed: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The mapping tables that the chosen resources need, by name; each is a table ``src, dst`` under ``folder``."""
    if unknown := sorted(set(resources) - set(needed)):
        raise ValueError(f"unknown resources: {', '.join(unknown)}")
    names = sorted({m for r in resources for m in needed[r]})
    return {m: spark.read.csv(f"{folder}/{m}", sep="\t", schema="src string, dst string") for m in names}


def read_ranked_entities(spark: SparkSession, path: str) -> DataFrame:
    """``category, position, entity, score, synonyms`` of a JSON lines ranking, with the synonyms of ``TOTAL`` for each entity."""
    rows = spark.read.schema("category string, position long, entity string, score double, synonyms array<string>").json(path)
    total = rows.filter("category = 'TOTAL'").groupBy("entity").agg(F.first("synonyms").alias("synonyms"))
    return rows.filter("category <> 'TOTAL'").drop("synonyms").join(total, "entity", "left").select("category", "position", "entity", "score", "synonyms")
