"""Algebra of long two-column mappings ``src, dst``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chain(*maps: DataFrame) -> DataFrame:
    """The composition of mappings; pairs are distinct after every step, which keeps fan-out in check."""
    return reduce(
        lambda a, b: a.withColumnRenamed("dst", "via").join(b.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct(), maps
    )


def invert(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def merge(*maps: DataFrame) -> DataFrame:
    """Set union of the targets of each key."""
    return reduce(DataFrame.unionByName, maps).distinct()


def unambiguous(mapping: DataFrame) -> DataFrame:
    """Pairs whose key has one target."""
    return mapping.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("top")).filter("dst = top").drop("top")


def one_target(mapping: DataFrame) -> DataFrame:
    """The least target of each key, where one has to be picked."""
    return mapping.groupBy("src").agg(F.min("dst").alias("dst"))


def multi_valued(mapping: DataFrame) -> DataFrame:
    """Keys with several targets and how many."""
    return mapping.groupBy("src").agg(F.count_distinct("dst").alias("n")).filter("n > 1")


def unmapped(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    return keys.select("src").distinct().join(mapping, "src", "left_anti")


def not_one_to_one(mapping: DataFrame) -> DataFrame:
    """Ids that break a one-to-one relation, with the side they are on."""
    left = multi_valued(mapping).select(F.lit("src").alias("side"), F.col("src").cast("string").alias("id"), "n")
    return left.unionByName(multi_valued(invert(mapping)).select(F.lit("dst").alias("side"), F.col("src").cast("string").alias("id"), "n"))


def edge_list(mapping: DataFrame, relation: str, head_prefix: str = "", tail_prefix: str = "", weight: Column | None = None) -> DataFrame:
    """Distinct ``head, relation, tail, weight`` with prefixed ids."""
    return mapping.select(
        F.concat(F.lit(head_prefix), F.col("src").cast("string")).alias("head"), F.lit(relation).alias("relation"),
        F.concat(F.lit(tail_prefix), F.col("dst").cast("string")).alias("tail"), (F.lit(1.0) if weight is None else weight).alias("weight"),
    ).distinct()


def as_lists(mapping: DataFrame) -> DataFrame:
    """``src, dsts``: sorted distinct targets of each key."""
    return mapping.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dsts"))


def name_contains(mapping: DataFrame, names: DataFrame, part: str) -> DataFrame:
    """Sources mapped to any term whose name holds ``part``."""
    terms = names.filter(F.contains(F.col("name"), F.lit(part))).select(F.col("id").alias("dst"))
    return mapping.join(terms, "dst", "left_semi").select("src").distinct()


def tally(mapping: DataFrame, members: DataFrame) -> DataFrame:
    """Targets of the given sources with their number, most frequent first."""
    own = mapping.join(members.select("src").distinct(), "src", "left_semi").distinct()
    return own.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst")
