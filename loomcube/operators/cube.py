"""The text cube: documents in categories, entity counts in documents, and sums over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_assign(nodes: DataFrame, roots: DataFrame, strict: bool = True) -> DataFrame:
    """``nodes(code, …) × roots(category, root)``: a node belongs to a category if its code lies below one of its roots.

    The strict form asks for a boundary at the dot and is a hash join on exploded ancestor codes, so neither side
    has to be small. The loose form is a plain text prefix: codes are exploded into all prefixes of the lengths
    that roots have, which is a hash join again.
    """
    if strict:
        parts = F.split("code", r"\.")
        keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    else:
        keys = F.transform(F.sequence(F.lit(1), F.length("code")), lambda i: F.substring(F.col("code"), F.lit(1), i))
    exploded = nodes.withColumn("root", F.explode(keys))
    return exploded.join(roots.select("category", "root").distinct(), "root").drop("root").distinct()


def term_documents(doc_terms: DataFrame) -> DataFrame:
    """Documents and their number by term, as the file of the inverted index lists them; repeated pairs count once.

    A row holds the whole list of a term; :func:`category_documents` and the other joins work on the pairs instead.
    """
    pairs = doc_terms.select("term", "doc_id").distinct()
    return pairs.groupBy("term").agg(F.count("*").alias("n_docs"), F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("docs"))


def category_documents(doc_terms: DataFrame, category_terms: DataFrame) -> DataFrame:
    """Distinct ``category, doc_id`` of documents that hold a term of the category."""
    return doc_terms.join(category_terms, "term").select("category", "doc_id").distinct()


def ordinal_pairs(categories: DataFrame) -> DataFrame:
    """``doc_id, cat_num`` from rows ``cat_num, docs`` (an array)."""
    return categories.select(F.explode("docs").alias("doc_id"), "cat_num").distinct()


def documents_per_category(cat_docs: DataFrame) -> DataFrame:
    """Documents by category, and under ``TOTAL`` the distinct documents of all."""
    per = cat_docs.groupBy("category").agg(F.count_distinct("doc_id").alias("n_docs"))
    return per.unionByName(cat_docs.agg(F.count_distinct("doc_id").alias("n_docs")).select(F.lit("TOTAL").alias("category"), "n_docs"))


def relevant_documents(docs: DataFrame, cat_docs: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents of any category, published between two years; -1 stands for an unknown year."""
    if first is not None:
        docs = docs.filter(F.col("year").between(first, last))
    return docs.join(cat_docs.select("doc_id").distinct(), "doc_id", "left_semi")


def entity_counts(counts: DataFrame, entity_synonyms: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``doc_id, entity, cnt`` from ``doc_id, synonym, cnt``; a shared synonym counts for each of its entities."""
    pairs = entity_synonyms.select("entity", "synonym").distinct()
    if removed is not None:
        pairs = pairs.join(removed.select("synonym").distinct(), "synonym", "left_anti")
    return counts.join(pairs, "synonym").groupBy("doc_id", "entity").agg(F.sum("cnt").alias("cnt"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum of partial ``doc_id, synonym, cnt`` tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "synonym").agg(F.sum("cnt").alias("cnt"))


def observations(cat_docs: DataFrame, doc_entities: DataFrame) -> DataFrame:
    """The cube ``category, doc_id, entity, cnt``."""
    return cat_docs.join(doc_entities, "doc_id").select("category", "doc_id", "entity", "cnt")


def tf_df(obs: DataFrame) -> DataFrame:
    """Term and document frequency by category and entity."""
    return obs.groupBy("category", "entity").agg(F.sum("cnt").alias("tf"), F.count("doc_id").alias("df"))


def dense_grid(cells: DataFrame, entities: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """All pairs of category and entity with tf and df, 0 where the cube has none.

    The product is the result itself, so it is as large as it has to be; the categories are an array on one row
    that is unnested per entity, which keeps it a narrow step instead of a join without keys.
    """
    entities = (entities if entities is not None else cells).select("entity").distinct()
    names = (categories if categories is not None else cells).select("category").distinct()
    listed = names.agg(F.collect_set("category").alias("categories"))
    grid = entities.join(F.broadcast(listed)).select(F.explode("categories").alias("category"), "entity")
    zero = F.lit(0).cast("long")
    return grid.join(cells, ["category", "entity"], "left").select("category", "entity", F.coalesce("tf", zero).alias("tf"), F.coalesce("df", zero).alias("df"))


def entities_per_category(obs: DataFrame) -> DataFrame:
    """Entities by category and, as ``TOTAL``, over all."""
    per = obs.groupBy("category").agg(F.count_distinct("entity").alias("n_entities"))
    return per.unionByName(obs.agg(F.count_distinct("entity").alias("n_entities")).select(F.lit("TOTAL").alias("category"), "n_entities"))


def found_proportion(searched: DataFrame, found: DataFrame) -> DataFrame:
    """How many of the searched entities were found."""
    hit = searched.select("entity").distinct().join(found.select("entity").distinct().withColumn("hit", F.lit(1)), "entity", "left")
    return hit.agg(F.count("*").alias("n_searched"), F.count("hit").alias("n_found")).withColumn("share", F.round(F.try_divide("n_found", "n_searched"), 9))


def synonym_totals(counts: DataFrame, cat_docs: DataFrame) -> DataFrame:
    """Synonym hits by category and under ``TOTAL``, where a document counts once however many categories it has."""
    relevant = counts.join(cat_docs.select("doc_id").distinct(), "doc_id", "left_semi")
    per = counts.join(cat_docs, "doc_id").groupBy("category", "synonym").agg(F.sum("cnt").alias("cnt"))
    total = relevant.groupBy("synonym").agg(F.sum("cnt").alias("cnt")).select(F.lit("TOTAL").alias("category"), "synonym", "cnt")
    return per.unionByName(total)


def documents_with_hits(cat_docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Category rows of the documents with at least one hit."""
    return cat_docs.join(counts.select("doc_id").distinct(), "doc_id", "left_semi")


def latest_versions(docs: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in ``order``, which may mix directions. :func:`newest` needs no sort."""
    from pyspark.sql import Window

    ranked = docs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n")


def newest(docs: DataFrame, key: str, *version: str) -> DataFrame:
    """One row per key: the one with the largest ``version`` columns; aggregated before the exchange."""
    own = docs.columns
    best = docs.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in own)), F.struct(*version)).alias("d"))
    return best.select(*(F.col(f"d.`{c}`").alias(c) for c in own))


def concordance(docs: DataFrame, cat_docs: DataFrame, name: str, n: int = 11) -> DataFrame:
    """The first relevant documents that hold a name, for reading."""
    hits = docs.filter(F.contains(F.col("text"), F.lit(name))).join(cat_docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.orderBy("doc_id").limit(n)
