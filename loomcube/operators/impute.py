"""Labels for documents without a category, from synonyms of the categories in title and abstract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcube.functions.text import any_of, candidate_synonyms, few, title_text

def select_mode(docs: DataFrame, mode: str) -> DataFrame:
    """Documents by whether they have ``terms``: ``unlabelled``, ``labelled`` or ``all``."""
    size = F.coalesce(F.size("terms"), F.lit(0))
    return {"unlabelled": docs.filter(size <= 0), "labelled": docs.filter(size > 0), "all": docs}[mode]


def incomparable(matches: Column) -> Column:
    """The matched synonyms that have another one which neither holds them nor lies in them (apostrophes aside)."""

    def clean(m: Column) -> Column:
        return F.replace(m, F.lit("'"), F.lit(""))

    return F.filter(matches, lambda a: F.exists(matches, lambda b: ~F.contains(clean(a), clean(b)) & ~F.contains(clean(b), clean(a))))


def impute(docs: DataFrame, synonyms: DataFrame, domain_words: tuple[str, ...] = (), use_title: bool = True) -> DataFrame:
    """``doc_id, category, by_title, n_matches, synonym`` of the labels that follow from ``docs(doc_id, title, abstract)``.

    A category is given if one of its synonyms stands as words in the title, or if two of its matched synonyms are
    incomparable; the order of synonyms plays no part. ``synonym`` is the least that stands in the title, else the
    least of an incomparable pair. ``domain_words`` asks for one of them in the text, and without ``use_title`` only
    pairs count (the keyword variant). A small lexicon is matched in one projection; a larger one by
    :func:`candidate_synonyms`, with the same result.
    """
    words = synonyms.select("category", F.lower("synonym").alias("synonym")).filter("synonym <> ''").distinct()
    text = docs.select("doc_id", title_text(F.col("title")).alias("title"), F.lower(F.coalesce("abstract", F.lit(""))).alias("abstract"))
    if domain_words:
        text = text.filter(any_of([F.contains(F.concat("title", "abstract"), F.lit(w)) for w in domain_words]))

    def in_title(s: Column) -> Column:
        return F.contains(F.col("title"), F.concat(F.lit(" "), s, F.lit(" ")))

    def anywhere(s: Column) -> Column:
        return F.contains(F.col("title"), s) | F.contains(F.col("abstract"), s)

    if few(words):
        lists = words.groupBy("category").agg(F.collect_list("synonym").alias("synonyms"))
        lists = lists.agg(F.collect_list(F.struct("category", "synonyms")).alias("lists"))
        each = text.join(F.broadcast(lists)).select("doc_id", "title", "abstract", F.explode("lists").alias("l"))
        matched = each.select("doc_id", F.col("l.category").alias("category"), F.filter("l.synonyms", in_title).alias("titles"), F.filter("l.synonyms", anywhere).alias("matches"))
    else:
        near = candidate_synonyms(text, words.select("synonym").distinct(), ["title", "abstract"])
        hits = near.join(text.hint("merge"), "doc_id").filter(anywhere(F.col("synonym"))).select("doc_id", "synonym", in_title(F.col("synonym")).alias("in_title"))
        own = hits.join(words.hint("merge"), "synonym").groupBy("doc_id", "category")
        matched = own.agg(F.collect_set(F.when(F.col("in_title"), F.col("synonym"))).alias("titles"), F.collect_set("synonym").alias("matches"))
    by_title = (F.size("titles") > 0) if use_title else F.lit(False)
    pairs = incomparable(F.col("matches"))
    return matched.filter(by_title | (F.size(pairs) > 0)).select(
        "doc_id", "category", by_title.alias("by_title"), F.size("matches").cast("long").alias("n_matches"),
        F.when(by_title, F.array_min("titles")).otherwise(F.array_min(pairs)).alias("synonym"),
    )


def document_synonyms(labels: DataFrame) -> DataFrame:
    """``doc_id, synonyms``: a sorted list of the synonyms by which a document got its labels."""
    return labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("synonym")).alias("synonyms"))


def merge_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, categories`` as a sorted list."""
    return labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def ground_truth(docs: DataFrame, doc_terms: DataFrame, category_terms: DataFrame) -> DataFrame:
    """``doc_id, category`` by the documents' own terms; documents with none keep a row with a null category."""
    pairs = doc_terms.join(category_terms, "term").select("doc_id", "category").distinct()
    return docs.select("doc_id").distinct().join(pairs, "doc_id", "left")


def evaluate(real: DataFrame, imputed: DataFrame, ref_compat: bool = False) -> DataFrame:
    """Confusion counts, precision and recall over distinct pairs; ``ref_compat`` counts true positives twice."""
    a = real.select("doc_id", "category").filter("category IS NOT NULL").distinct().withColumn("is_real", F.lit(1))
    b = imputed.select("doc_id", "category").distinct().withColumn("is_imputed", F.lit(1))
    both = a.join(b, ["doc_id", "category"], "full")
    times = 2 if ref_compat else 1
    counts = both.agg(
        (F.count_if(F.col("is_real").isNotNull() & F.col("is_imputed").isNotNull()) * times).alias("tp"),
        F.count_if(F.col("is_real").isNull()).alias("fp"), F.count_if(F.col("is_imputed").isNull()).alias("fn"),
    )
    return counts.select(
        "tp", "fp", "fn", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"),
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 9).alias("recall"),
    )


def write_back(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose ``terms`` also hold their imputed categories."""
    own = merge_labels(labels)
    none = F.array().cast("array<string>")
    return docs.join(own, "doc_id", "left").withColumn("terms", F.array_union(F.coalesce("terms", none), F.coalesce("categories", none))).drop("categories")


def undo(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents without the categories that an imputation had added."""
    own = merge_labels(labels)
    none = F.array().cast("array<string>")
    return docs.join(own, "doc_id", "left").withColumn("terms", F.array_except(F.coalesce("terms", none), F.coalesce("categories", none))).drop("categories")


def extend_cube(cat_docs: DataFrame, labels: DataFrame) -> DataFrame:
    return cat_docs.select("category", "doc_id").unionByName(labels.select("category", "doc_id")).distinct()
