"""Rankings of synonyms and entities, and top-n reports; every order ends in a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcube.storage import materialise


def positions(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the position from 1 within ``group`` by ``order``; a null group is a group. No task holds a whole group.

    Rows are dealt by ranges of group and order, sorted and written with their place in their partition. A group of a
    partition begins at the least such place, and as many rows of it lie before as earlier partitions count; these
    counts are one row a group and partition that meet. A source position breaks ties, so rows that are equal in
    every order key spread over partitions too.
    """
    place, tie, part, first, before = "__place", "__tie", "__part", "__first", "__before"
    keys = [F.col(f"`{group}`"), *order, F.col(tie)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(tie)
    stored = materialise(dealt.withColumn(place, F.monotonically_increasing_id()), "positions").withColumn(part, F.shiftright(place, 33))
    met = stored.groupBy(F.col(f"`{group}`").alias("__group"), F.col(part).alias("__of")).agg(F.min(place).alias(first), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn(before, F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    joined = stored.join(met, (F.col(part) == F.col("__of")) & F.col(f"`{group}`").eqNullSafe(F.col("__group")))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(place) - F.col(first) + F.col(before) + 1).alias(name))


def ranked(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """Adds the position within ``group`` by falling ``value``; see :func:`positions`."""
    return positions(df, group, [F.desc(value), F.col(tie)])


def with_total(scores: DataFrame, value: str) -> DataFrame:
    """``category, entity, value`` with the sum over categories as the category ``TOTAL``."""
    total = scores.groupBy("entity").agg(F.sum(value).alias(value)).select(F.lit("TOTAL").alias("category"), "entity", value)
    return scores.select("category", "entity", value).unionByName(total)


def entity_synonym_list(entity_counts: DataFrame) -> DataFrame:
    """For each category and entity its synonyms by falling count, joined as ``synonym|count;…``."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "synonym", "cnt")))
    joined = F.array_join(F.transform(items, lambda x: F.concat(x["synonym"], F.lit("|"), x["cnt"].cast("string"))), ";")
    return entity_counts.groupBy("category", "entity").agg(joined.alias("synonyms"))


def report_lines(ranked_entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Lines of the text report: position, entity, value and synonyms."""
    value = [c for c in ranked_entities.columns if c not in {"category", "entity", "position"}][0]
    joined = ranked_entities.join(synonyms, ["category", "entity"], "left")
    line = F.format_string("%d. %s %.6f [%s]", "position", "entity", value, F.coalesce("synonyms", F.lit("")))
    return joined.select("category", "position", line.alias("line"))


def top_rows(table: DataFrame, key: str, columns: list[str], n: int = 5, by: str = "mean") -> DataFrame:
    """The first rows by mean or maximum over ``columns``, nulls skipped."""
    values = F.array_compact(F.array(*columns))
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(values), F.lit(0))
    key_value = mean if by == "mean" else F.array_max(values)
    return table.dropDuplicates([key]).withColumn("value", key_value).orderBy(F.desc_nulls_last("value"), key).limit(n)


def top_per_group(df: DataFrame, group: str, value: str, tie: str, n: int, ascending: bool = False) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.asc(value) if ascending else F.desc(value), F.col(tie))
    return df.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= n)
