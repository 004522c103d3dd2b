"""Widening an entity set: ontology, interaction partners, pathways, regulators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcube.operators.hierarchy import reach


def interaction_partners(edges: DataFrame, core: DataFrame, hops: int = 1, threshold: float = 0.0, all_hops: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities within ``hops`` of the core over ``src, dst, score`` of at least the threshold, and the edges walked.

    Edges are undirected. ``all_hops=False`` returns the edges of the first hop only.
    """
    strong = edges.filter(F.col("score") >= threshold)
    both = strong.select("src", "dst", "score").unionByName(strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")).distinct()
    found = reach(both, core.select(F.col("entity").alias("node")), hops)
    last = hops - 1 if all_hops else 0
    walked = both.join(found.filter(F.col("hop") <= last).select(F.col("node").alias("src")), "src", "left_semi")
    triples = walked.select(F.col("src").alias("head"), F.lit("binds_to").alias("relation"), F.col("dst").alias("tail"), F.col("score").alias("weight"))
    return found.select(F.col("node").alias("entity"), "hop"), triples.distinct()


def pathway_hits(members: DataFrame, core: DataFrame) -> DataFrame:
    """``pathway, size, hits, share`` of distinct ``pathway, entity``."""
    own = members.select("pathway", "entity").distinct().join(core.select("entity").distinct().withColumn("hit", F.lit(1)), "entity", "left")
    return own.groupBy("pathway").agg(F.count("*").alias("size"), F.count("hit").alias("hits")).withColumn("share", F.col("hits") / F.col("size"))


def pathway_partners(members: DataFrame, core: DataFrame, count: int = 4, share: float = 0.5, mode: str = "or") -> tuple[DataFrame, DataFrame]:
    """Entities added by pathways that hold enough of the core, and ``participates_in_pathway`` triples of these."""
    few, part = F.col("hits") >= count, F.col("share") >= share
    test = few & part if mode == "and" else few | part
    chosen = pathway_hits(members, core).filter(test & (F.col("hits") > 0)).select("pathway")
    own = members.select("pathway", "entity").distinct().join(chosen, "pathway", "left_semi")
    added = own.select("entity").distinct().join(core.select("entity"), "entity", "left_anti")
    triples = own.select(F.col("entity").alias("head"), F.lit("participates_in_pathway").alias("relation"), F.col("pathway").alias("tail"), F.lit(1.0).alias("weight"))
    return added, triples


def regulator_partners(regulation: DataFrame, core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partners over ``regulator, target`` in both directions: targets of core regulators, regulators of core targets."""
    pairs = regulation.select("regulator", "target").distinct()
    own = core.select("entity").distinct()
    ahead = pairs.join(own.withColumnRenamed("entity", "regulator"), "regulator", "left_semi")
    back = pairs.join(own.withColumnRenamed("entity", "target"), "target", "left_semi")
    used = ahead.unionByName(back).distinct()
    every = used.select(F.col("regulator").alias("entity")).union(used.select("target")).distinct()
    triples = used.select(F.col("regulator").alias("head"), F.lit("targets").alias("relation"), F.col("target").alias("tail"), F.lit(1.0).alias("weight"))
    return every.join(own, "entity", "left_anti"), triples


def regulation_by_entity(tf_targets: DataFrame, gene_ids: DataFrame, gene_entities: DataFrame) -> DataFrame:
    """``regulator, target`` entities from gene names: each name by its least gene id, then by that gene's entities."""
    ids = gene_ids.groupBy("gene").agg(F.min("gene_id").alias("gene_id"))
    named = ids.join(gene_entities, "gene_id").select("gene", "entity")
    first = tf_targets.join(named.select(F.col("gene").alias("tf_gene"), F.col("entity").alias("regulator")), "tf_gene")
    return first.join(named.select(F.col("gene").alias("target_gene"), F.col("entity").alias("target")), "target_gene").select("regulator", "target").distinct()


def expanded(core: DataFrame, *added: DataFrame) -> DataFrame:
    """The union of all sets with, for each entity, whether it is of the core."""
    rows = core.select("entity", F.lit(True).alias("core"))
    for a in added:
        rows = rows.unionByName(a.select("entity", F.lit(False).alias("core")))
    return rows.groupBy("entity").agg(F.max("core").alias("core"))


def of_reference(entities: DataFrame, reference: DataFrame) -> DataFrame:
    """Entities of the reference list."""
    return entities.join(reference.select("entity").distinct(), "entity", "left_semi")
