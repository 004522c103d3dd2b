"""Pairs of members by the groups they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcube.storage import discard, materialise

#: Members of a group that meet in one row at most, groups of a member that go to one task, and rows and pairs that a task takes.
SIDE, MEMBER_GROUPS, TASK_ROWS, TASK_PAIRS = 1024, 100_000, 200_000, 1_000_000


def met_members(rows: DataFrame, group: str, member: str, side: int = SIDE, member_groups: int = MEMBER_GROUPS) -> tuple[DataFrame, list[str], int, list[DataFrame]]:
    """``a, bs``: members of ``rows`` and greater ones of one group; columns that hold all rows of a pair together, pairs at most, and tables to discard.

    The sorted ids of a group give, for each member, one row with those after it. Nulls take no part. Rows are gathered after the exchange,
    in as many tasks as their number asks for, since sets that combine before it are sorted in memory. Groups of more than ``side`` members
    are cut into stretches that meet two at a time on tasks of their own; what a member of over ``member_groups``
    groups meets is dealt to 32 tasks by hash.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    sets = rows.filter(F.col(group).isNotNull()).repartition(n, group).groupBy(group).agg(F.sort_array(F.collect_set(member)).alias("ids")).withColumn("size", F.size("ids"))
    sets = materialise(sets.filter("size > 1").select("ids", "size"), "groups")
    facts = sets.agg(F.sum(F.col("size").cast("long") * (F.col("size") - 1) / 2).alias("pairs"), F.max("size").alias("most")).first()
    places = F.sequence(F.lit(1), F.col("size") - 1)
    own = sets.filter(F.col("size") <= side).select(F.explode(F.transform(places, lambda i: F.struct(F.get("ids", i - 1).alias("a"), F.slice("ids", i + 1, F.col("size") - i).alias("bs")))).alias("r"))
    if (facts["most"] or 0) > side:
        last = F.floor((F.col("size") - 1) / side).cast("int")
        cut = sets.filter(F.col("size") > side).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence(F.col("i"), last)))
        left, right = (F.slice("ids", F.col(c) * side + 1, F.lit(side)).alias(c) for c in ("i", "j"))
        met = cut.select(left, right, (F.col("i") == F.col("j")).alias("same")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        after = lambda x, k: F.struct(x.alias("a"), F.when(F.col("same"), F.slice("j", k + 2, F.lit(side))).otherwise(F.col("j")).alias("bs"))
        own = own.unionByName(met.select(F.explode(F.transform("i", after)).alias("r")))
    own, keys = own.select("r.a", "r.bs").filter(F.size("bs") > 0), ["a"]
    busy = sets.select(F.explode("ids").alias("a")).groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") > member_groups).select("a")
    busy = materialise(busy.withColumn("busy", F.lit(True)), "busy")
    if not busy.isEmpty():
        parts = F.when(F.col("busy"), F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(0)))
        spread = own.join(busy, "a", "left").select("a", "bs", "busy", F.explode(parts).alias("part"))
        some = F.when(F.col("busy"), F.filter("bs", lambda b: F.pmod(F.xxhash64(b), F.lit(32)) == F.col("part"))).otherwise(F.col("bs"))
        own, keys = spread.select("a", "part", some.alias("bs")).filter(F.size("bs") > 0), ["a", "part"]
    return own, keys, int(facts["pairs"] or 0), [sets, busy]


def shared_groups(rows: DataFrame, group: str, member: str, side: int = SIDE, member_groups: int = MEMBER_GROUPS) -> DataFrame:
    """``a, b, n``, written: the pairs ``a < b`` of members of ``rows`` that share groups, and how many. Nulls take no part.

    Rows of :func:`met_members` are exchanged by their first member and counted where they arrive, so the pairs
    themselves are not.
    """
    own, keys, pairs, written = met_members(rows, group, member, side, member_groups)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    each = own.repartition(n, *keys).select(*keys, F.explode("bs").alias("b"))
    out = materialise(each.groupBy(*keys, "b").agg(F.count("*").cast("int").alias("n")).select("a", "b", "n"), "shared")
    discard(*written)
    return out


def linked_members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``member``: those of ``rows`` that share a group with another, each once. Pairs are not formed, so work grows as the rows."""
    own = rows.select(group, member).filter(F.col(group).isNotNull() & F.col(member).isNotNull())
    several = own.groupBy(group).agg(F.min(member).alias("lo"), F.max(member).alias("hi")).filter("lo < hi").select(group)
    return own.join(several, group, "left_semi").select(member).distinct()


def linked_kinds(rows: DataFrame, group: str, member: str, kinds: DataFrame) -> DataFrame:
    """``kind_a, kind_b``: the kinds of any two members of one group, the lesser first; ``kinds`` has ``member, kind``.

    A group is known by its kinds and by which of these it has two members of, so its pairs are not formed.
    """
    each = rows.select(group, member).filter(F.col(group).isNotNull()).join(kinds, member).groupBy(group, "kind").agg(F.min(member).alias("lo"), F.max(member).alias("hi"))
    sets = each.groupBy(group).agg(F.sort_array(F.collect_set(F.struct("kind", (F.col("lo") < F.col("hi")).alias("several")))).alias("of")).select("of").distinct()
    pairs = sets.withColumn("a", F.explode("of")).withColumn("b", F.explode("of"))
    pairs = pairs.filter((F.col("a.kind") < F.col("b.kind")) | ((F.col("a.kind") == F.col("b.kind")) & F.col("a.several")))
    return pairs.select(F.col("a.kind").alias("kind_a"), F.col("b.kind").alias("kind_b")).distinct()
