"""Spanning forests, components and holdouts that keep a graph connected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcube.operators.kg import undirected
from loomcube.storage import discard, materialise


def edge_hash(lo: str, hi: str, seed: int) -> Column:
    """60 bits that only the ends of an edge and the seed decide; SQL of other engines can follow it."""
    digest = F.md5(F.concat_ws("|", F.col(lo).cast("string"), F.col(hi).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def node_number(node: str | Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def _numbered(edges: DataFrame) -> tuple[DataFrame, int]:
    """``node, n``, written: the ends of ``edges (lo, hi)`` with numbers of 64 bits, and the seed of these.

    Numbers are hashes, so edges need no join to have them. If two nodes have one number the next seed is tried.
    """
    seed = 0
    while True:
        nodes = edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("n", node_number("node", seed))
        nodes = materialise(nodes, "forest-nodes")
        if nodes.groupBy("n").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            return nodes, seed
        discard(nodes)
        seed += 1


def _follow(parents: DataFrame) -> DataFrame:
    """``c, p`` with p the root above c: paths are halved until none is longer than a step."""
    while True:
        above = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        longer = materialise(parents.join(above, "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "forest-jump")
        moved = not longer.filter("moved").isEmpty()
        discard(parents)
        parents = longer
        if not moved:
            return parents


def _contracted(live: DataFrame, own: list[str], best: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """What each round picks, and its ``c, p``: components and the one that they become part of.

    ``live`` has the edges of different components ``cu, cv`` and their columns ``own``. ``best`` gives a row a
    component ``c`` of both directions ``c, to, own``: its least edge, in an order in which only two that pick each
    other close a cycle. Components at least halve, and only edges between components are read again.
    """
    taken: list[DataFrame] = []
    parents: list[DataFrame] = []
    while not live.isEmpty():
        ways = F.explode(F.array(*(F.struct(F.col(a).alias("c"), F.col(b).alias("to"), *own) for a, b in (("cu", "cv"), ("cv", "cu")))))
        picks = materialise(best(live.select(ways.alias("w")).select("w.*")), "forest-picks")
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        above = _follow(materialise(picks.join(back, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("p")), "forest-parents"))
        ends = live
        for side in ("cu", "cv"):
            ends = ends.join(above.select(F.col("c").alias(side), F.col("p").alias(f"p{side}")), side).drop(side).withColumnRenamed(f"p{side}", side)
        left = materialise(ends.filter("cu <> cv"), "forest-live")
        discard(live)
        live = left
        taken.append(picks)
        parents.append(above)
    discard(live)
    return taken, parents


def _labels(nodes: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """``node, root``, written, of ``nodes (node, n)`` after the rounds ``parents``; the root is the least node. Later rounds are small and join first."""
    top = None
    for above in reversed(parents):
        if top is not None:
            above = above.join(top.select(F.col("c").alias("p"), F.col("p").alias("last")), "p", "left").select("c", F.coalesce("last", "p").alias("p"))
        top = above
    placed = nodes.withColumn("c", F.col("n")) if top is None else nodes.join(top.select(F.col("c").alias("n"), "p"), "n", "left").select("node", F.coalesce("p", "n").alias("c"))
    placed = materialise(placed.select("node", "c"), "forest-labels")
    least = placed.groupBy("c").agg(F.min("node").alias("root"))
    out = materialise(placed.join(least, "c").select("node", "root"), "components")
    discard(placed)
    return out


def _least_forest(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, int, DataFrame, list[DataFrame]]:
    """The different ``lo, hi, h`` of ``edges``, ``node, n``, the seed of numbers, ``a, b`` of the forest in these, and the rounds' ``c, p``."""
    own = undirected(edges.filter("head IS NOT NULL AND tail IS NOT NULL")).select("lo", "hi").distinct()
    own = materialise(own.withColumn("h", edge_hash("lo", "hi", seed)), "forest-edges")
    nodes, salt = _numbered(own)
    keyed = own.filter("lo <> hi").select("h", node_number("lo", salt).alias("a"), node_number("hi", salt).alias("b"))
    least = lambda ways: ways.groupBy("c").agg(F.min(F.struct("h", "a", "b", "to")).alias("e")).select("c", "e.*")
    taken, parents = _contracted(materialise(keyed.withColumns({"cu": F.col("a"), "cv": F.col("b")}), "forest-live"), ["h", "a", "b"], least)
    forest = keyed.select("a", "b").limit(0)
    for picks in taken:
        forest = forest.unionByName(picks.select("a", "b"))
    forest = materialise(forest.distinct(), "forest")
    discard(*taken)
    return own, nodes, salt, forest, parents


def spanning_forest(edges: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``lo, hi`` of the edges of the forest of least hashes, and ``node, root`` of all nodes of ``edges (head, tail)``.

    Borůvka's rounds: every component takes its least edge to another one, and components joined by such edges
    become one. No two edges have equal weights (numbers of the ends break ties of the hash), so the taken edges close
    no cycle but the pair that picks itself. Rounds are few, work on numbers of 64 bits instead of the nodes, and each is
    written; the least edges combine before the exchange, so a hub is one row a task. Direction, repetition and loops do
    not matter; the root is the least node of its component.
    """
    own, nodes, salt, forest, parents = _least_forest(edges, seed)
    ends = own.select("lo", "hi", node_number("lo", salt).alias("a"), node_number("hi", salt).alias("b"))
    named = materialise(ends.join(forest, ["a", "b"], "left_semi").select("lo", "hi"), "forest-named")
    labels = _labels(nodes, parents)
    discard(own, nodes, forest, *parents)
    return named, labels


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``edges (head, tail)``, as :func:`spanning_forest` has them, without a forest.

    Every component joins that with the least number among its neighbours: of a cycle of such steps every second
    number would be no larger than the one before, so there are none of more than two. A round is a minimum of numbers.
    """
    own = materialise(undirected(edges.filter("head IS NOT NULL AND tail IS NOT NULL")).select("lo", "hi"), "forest-edges")
    nodes, salt = _numbered(own)
    live = materialise(own.filter("lo <> hi").select(node_number("lo", salt).alias("cu"), node_number("hi", salt).alias("cv")), "forest-live")
    discard(own)
    taken, parents = _contracted(live, [], lambda ways: ways.groupBy("c").agg(F.min("to").alias("to")))
    labels = _labels(nodes, parents)
    discard(nodes, *taken, *parents)
    return labels


def connected_holdout(edges: DataFrame, share: float = 0.3, seed: int = 1) -> DataFrame:
    """Adds ``part``, written: ``test`` for hashed edges outside of a spanning forest, else ``train``.

    Training keeps the forest, so it has the components of the whole graph. Test edges make up ``share`` of all
    different edges, drawn by hash from those outside of the forest, or all of these if there are not as many. Equal
    and opposite edges have the same part; loops and edges without an end are training edges. ``edges`` are read twice.
    """
    own, nodes, salt, forest, parents = _least_forest(edges, seed)
    n = own.filter("lo <> hi").count()
    rate = share * n / max(1, n - forest.count())
    ends = [F.least("head", "tail"), F.greatest("head", "tail")]
    keyed = edges.withColumns({"of.a": node_number(ends[0], salt), "of.b": node_number(ends[1], salt)})
    kept = forest.select(F.col("a").alias("of.a"), F.col("b").alias("of.b"), F.lit(True).alias("of.kept"))
    named = undirected(keyed.join(kept, ["of.a", "of.b"], "left"))
    test = F.col("`of.kept`").isNull() & (F.col("lo") < F.col("hi")) & (edge_hash("lo", "hi", seed + 1) / float(1 << 60) < rate)
    out = materialise(named.select(*(F.col(f"`{c}`") for c in edges.columns), F.when(test, "test").otherwise("train").alias("part")), "holdout")
    discard(own, nodes, forest, *parents)
    return out
