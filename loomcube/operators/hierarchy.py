"""Hierarchies and graphs from edge tables ``parent, child``: closures, paths, families, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcube.storage import discard, materialise


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that a loop's plan stays short."""
    return materialise(df, "loop")


def parent_code(code: Column) -> Column:
    """A dotted code without its last part; null for a root."""
    n = F.size(F.split(code, r"\."))
    return F.when(n > 1, F.array_join(F.slice(F.split(code, r"\."), F.lit(1), n - 1), "."))


def code_edges(nodes: DataFrame) -> DataFrame:
    """``parent, child`` of the dotted codes that have a parent."""
    return nodes.select(parent_code(F.col("code")).alias("parent"), F.col("code").alias("child")).filter("parent IS NOT NULL").distinct()


def ancestors(edges: DataFrame, strict: bool = True) -> DataFrame:
    """``ancestor, node, depth``: all pairs of the transitive closure with their least distance.

    Path lengths double in every round, so a hierarchy of depth d takes about log2(d) rounds; only pairs that are new
    or shorter than in the round before are joined again, which also ends on cycles. The closure itself is the result and as large as it has to be.
    """
    known = stored(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).cast("long").alias("depth")).filter("ancestor <> node").distinct())
    latest = known
    while True:
        # a path that is new in this round ends or begins with one that was new in the last
        halves = [("known", "latest"), ("latest", "known")]
        sides = {"known": known, "latest": latest}
        longer = [
            sides[x].alias("a").join(sides[y].alias("b"), F.expr("a.node = b.ancestor AND a.ancestor <> b.node")).select(F.col("a.ancestor"), F.col("b.node"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
            for x, y in halves[: 1 if known is latest else 2]
        ]
        every = longer[0] if len(longer) == 1 else longer[0].unionByName(longer[1])
        best = every.groupBy("ancestor", "node").agg(F.min("depth").alias("depth"))
        was = known.withColumnRenamed("depth", "was")
        better = stored(best.join(was, ["ancestor", "node"], "left").filter("was IS NULL OR depth < was").drop("was"))
        if better.isEmpty():
            break
        before, known = known, stored(known.unionByName(better).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        discard(before, *([] if before is latest else [latest]))
        latest = better
    if strict:
        return known
    every = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    return known.unionByName(every.select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("long").alias("depth")))


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """``node, hop``: nodes reached from ``seeds(node)`` along ``src, dst`` with the least number of hops.

    Each round joins only the nodes found last and drops those known; ``hops`` limits the rounds.
    """
    found = stored(seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long")))
    frontier, hop = found, 0
    while hops is None or hop < hops:
        hop += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(found, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def descendant_annotations(terms: DataFrame, edges: DataFrame, annotations: DataFrame, through_annotated_only: bool = False) -> DataFrame:
    """Distinct ``entity`` annotated (``entity, term``) with any of ``terms(term)`` or a term below.

    With ``through_annotated_only`` the descent ends at terms that have no annotation themselves.
    """
    down = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    if through_annotated_only:
        down = down.join(annotations.select(F.col("term").alias("src")).distinct(), "src", "left_semi")
    below = reach(down, terms.select(F.col("term").alias("node")))
    return annotations.join(below.select(F.col("node").alias("term")), "term", "left_semi").select("entity").distinct()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, n_in, n_out``."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.col("parent").alias("node"), zero.alias("i"), one.alias("o")).unionByName(edges.select(F.col("child").alias("node"), one.alias("i"), zero.alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def subtree_sizes(edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``node, size``: distinct nodes below each node."""
    closure = closure if closure is not None else ancestors(edges)
    every = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    below = closure.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
    return every.join(below, "node", "left").select("node", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def family_labels(edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``node, family``: the root with the largest family above each node; a root is its own family."""
    closure = closure if closure is not None else ancestors(edges)
    tops = roots(edges)
    own = closure.join(tops.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    size = own.groupBy("ancestor").agg(F.count("*").alias("size"))
    best = own.join(size, "ancestor").groupBy("node").agg(F.min(F.struct((-F.col("size")).alias("neg"), "ancestor")).alias("b"))
    return best.select("node", F.col("b.ancestor").alias("family")).unionByName(tops.select("node", F.col("node").alias("family")))


def prune(edges: DataFrame, add_root: str | None = "Root") -> DataFrame:
    """One parent per node: of its own family before others, then the largest subtree, then the least name.

    ``add_root`` joins all roots under one artificial node. Nodes that no root reaches (on or below a cycle) have no
    family and keep a parent all the same.
    """
    closure = ancestors(edges)
    sizes, family = subtree_sizes(edges, closure), family_labels(edges, closure)
    named = (
        edges.distinct()
        .join(sizes.withColumnsRenamed({"node": "parent"}), "parent")
        .join(family.select(F.col("node").alias("parent"), F.col("family").alias("pf")), "parent", "left")
        .join(family.select(F.col("node").alias("child"), F.col("family").alias("cf")), "child", "left")
    )
    order = F.struct((~F.col("pf").eqNullSafe(F.col("cf"))).alias("other"), (-F.col("size")).alias("neg"), "parent")
    tree = named.groupBy("child").agg(F.min(order).alias("b")).select(F.col("b.parent").alias("parent"), "child")
    if add_root is None:
        return tree
    return tree.unionByName(roots(edges).select(F.lit(add_root).alias("parent"), F.col("node").alias("child")))


def paths_to_root(tree: DataFrame) -> DataFrame:
    """``node, path`` from each node of a tree up to its root; joined by doubling partial paths.

    A node with several parents has a path for each way up. Paths that have no root are on a cycle: after as many
    doublings as nodes could need, a cycle is named in an error.
    """
    up = tree.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.array("child").alias("path")).distinct()
    tops = roots(tree).select("node", F.lit(None).cast("string").alias("top"), F.array("node").alias("path"))
    paths = stored(up.unionByName(tops))
    rounds = tree.select("child").distinct().count().bit_length() + 1
    while not paths.filter("top IS NOT NULL").isEmpty():
        on_cycle = paths.filter("top IS NOT NULL AND array_contains(path, top)").select("path").first()
        if on_cycle is not None or rounds < 0:
            raise ValueError(f"the tree has a cycle: {' < '.join(map(str, on_cycle['path'] if on_cycle else []))}")
        rounds -= 1
        ahead = paths.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("rest"))
        longer = stored(paths.join(ahead, "top", "left").select("node", F.col("next").alias("top"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path")))
        discard(paths)
        paths = longer
    return paths.select("node", "path")


def ancestor_subgraph(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``parent, child`` on the paths from ``nodes`` to the root; an inner node of the list gets a ``_leaf`` child."""
    chosen = paths_to_root(tree).join(nodes.select("node").distinct(), "node", "left_semi")
    steps = F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.struct(F.get("path", i - 1).alias("parent"), F.get("path", i - 2).alias("child")))
    edges = chosen.filter(F.size("path") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct()
    inner = nodes.select("node").distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_semi")
    return edges.unionByName(inner.select(F.col("node").alias("parent"), F.concat("node", F.lit("_leaf")).alias("child")))


def dendrogram(tree: DataFrame, most: int | None = None) -> tuple[list[list[float]], list[str]]:
    """Linkage rows (two clusters, height, leaves) and leaf order of a tree for plotting.

    The matrix of a drawing is a driver-side value, so the tree is gathered there; ``most`` refuses larger trees.
    """
    if most is not None and tree.limit(most + 1).count() > most:
        raise ValueError(f"a tree of over {most} edges is not drawn")
    rows = sorted(tree.select("parent", "child").toLocalIterator(), key=lambda r: (r["parent"], r["child"]))
    below: dict[str, list[str]] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r["child"])
    children = {c for cs in below.values() for c in cs}
    order: list[str] = []
    stack = sorted(set(below) - children, reverse=True)
    while stack:
        node = stack.pop()
        if node in below:
            stack += sorted(below[node], reverse=True)
        else:
            order.append(node)
    number = {leaf: i for i, leaf in enumerate(order)}
    linkage: list[list[float]] = []
    done: dict[str, tuple[int, float, int]] = {leaf: (i, 0.0, 1) for leaf, i in number.items()}

    def join(parts: list[tuple[int, float, int]]) -> tuple[int, float, int]:
        total = parts[0]
        height = max(h for _, h, _ in parts) + 1
        for part in parts[1:]:
            linkage.append([total[0], part[0], height, total[2] + part[2]])
            total = (len(order) + len(linkage) - 1, height, total[2] + part[2])
        return total[0], height if len(parts) > 1 else parts[0][1], total[2]

    stack = sorted(set(below) - children)
    walk, post = list(stack), []
    while walk:
        node = walk.pop()
        if node in below:
            post.append(node)
            walk += below[node]
    for node in reversed(post):
        done[node] = join([done[c] for c in sorted(below[node])])
    if len(stack) > 1:
        join([done[s] for s in stack])
    return linkage, order


def reorder(table: DataFrame, key: str, order: list[str], sizes: DataFrame) -> DataFrame:
    """Rows in leaf order with a size label."""
    places = F.create_map(*(x for i, name in enumerate(order) for x in (F.lit(name), F.lit(i))))
    labelled = table.withColumn("place", F.element_at(places, F.col(key))).join(sizes.select(F.col("node").alias(key), "size"), key, "left")
    return labelled.withColumn("label", F.format_string("%s (%d)", F.col(key), F.col("size"))).filter("place IS NOT NULL").orderBy("place")
