"""The knowledge graph: typed triples and nodes, and prediction of its edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcube.storage import materialise

#: Node types, and the sources of node lists in the order in which they decide a node's type.
NODE_TYPES = {"tree": "MeSH_Tree_Disease", "score": "Protein", "pathway": "Reactome_Pathway", "ppi": "Protein", "regulator": "Protein", "hierarchy": "Reactome_Pathway"}
CATEGORY_TYPE = "CVD"


def triple(head: Column, relation: str, tail: Column, weight: Column | None = None) -> list[Column]:
    return [head.cast("string").alias("head"), F.lit(relation).alias("relation"), tail.cast("string").alias("tail"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight")]


def tree_triples(tree: DataFrame, names: DataFrame, category_roots: DataFrame, with_hierarchy: bool = True) -> DataFrame:
    """Hierarchy of codes, names of codes, and roots of categories, each of weight 1."""
    is_a = names.select(*triple(F.col("code"), "MeSH_is", F.col("name")))
    top = category_roots.select(*triple(F.col("category"), "MeSH_CVD", F.col("root")))
    out = is_a.unionByName(top)
    return tree.select(*triple(F.col("parent"), "MeSH_hierarchy", F.col("child"))).unionByName(out) if with_hierarchy else out


def score_triples(scores: DataFrame, value: str = "score", scale: str = "raw") -> DataFrame:
    """``category -category_score-> entity`` of non-zero scores; weights raw, as z-scores over all, or these plus 1."""
    relation = "category_score"
    rows = scores.select("category", "entity", F.col(value).alias("w"))
    if scale != "raw":
        moments = rows.filter("w <> 0").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("dev"))
        shift = {"z_score": 0.0, "scaled_z_score": 1.0}[scale]
        rows = rows.filter("w <> 0").join(F.broadcast(moments)).select("category", "entity", (F.try_divide(F.col("w") - F.col("mean"), F.col("dev")) + shift).alias("w"))
    return rows.filter("w <> 0").select(*triple(F.col("category"), relation, F.col("entity"), F.col("w")))


def unpivot_scores(wide: DataFrame, categories: list[str]) -> DataFrame:
    """Long ``entity, category, score`` from a wide score table."""
    return wide.unpivot(["entity"], categories, "category", "score")


def pathway_triples(members: DataFrame) -> DataFrame:
    return members.select(*triple(F.col("entity"), "participates_in_pathway", F.col("pathway"))).distinct()


def hierarchy_triples(edges: DataFrame, part: str = "R-HSA") -> DataFrame:
    """Hierarchy edges whose two ends both hold ``part``; they are tested row by row."""
    both = edges.filter(F.contains(F.col("parent"), F.lit(part)) & F.contains(F.col("child"), F.lit(part)))
    return both.select(*triple(F.col("parent"), "pathway_hierarchy", F.col("child")))


def assemble(sources: dict[str, DataFrame]) -> DataFrame:
    """All triples of the sources given; rows are kept as they are."""
    return reduce(DataFrame.unionByName, [df.select("head", "relation", "tail", "weight") for df in sources.values()])


def node_list(sources: dict[str, DataFrame], categories: DataFrame) -> DataFrame:
    """``node, node_type``: each node once, typed by the first source that has it; categories have their own type."""
    order = {name: i for i, name in enumerate(NODE_TYPES)}
    parts = []
    for name, df in sources.items():
        ends = df.select((F.col("tail") if name == "pathway" else F.explode(F.array("head", "tail"))).alias("node"))  # one pass over a source
        parts.append(ends.select("node", F.lit(order[name]).alias("priority")))
    parts.append(categories.select(F.col("category").cast("string").alias("node"), F.lit(-1).alias("priority")))
    first = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.min("priority").alias("priority"))  # numbers combine in hash tables, structs would be sorted
    kinds = F.create_map(*(F.lit(v) for name, i in order.items() for v in (i, NODE_TYPES[name])), F.lit(-1), F.lit(CATEGORY_TYPE))
    return first.select("node", F.element_at(kinds, F.col("priority")).alias("node_type"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("head", "tail")).alias("node"))
    return nodes.join(ends.distinct(), "node", "left_semi")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def edge_type_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct sorted pairs of node types of each relation; once heads have their types, a tail is one row a type."""
    a = edges.join(nodes.select(F.col("node").alias("head"), F.col("node_type").alias("ht")), "head").select("relation", "ht", "tail").distinct()
    b = a.join(nodes.select(F.col("node").alias("tail"), F.col("node_type").alias("tt")), "tail")
    return b.select("relation", F.least("ht", "tt").alias("type_a"), F.greatest("ht", "tt").alias("type_b")).distinct()


def undirected(edges: DataFrame, a: str = "head", b: str = "tail") -> DataFrame:
    return edges.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def label_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``sources, destinations, predictions, is_true``; edges match in either direction."""
    known = undirected(truth).select("lo", "hi").distinct().withColumn("hit", F.lit(True))
    own = undirected(predictions, "sources", "destinations")
    return own.join(known, ["lo", "hi"], "left").select("sources", "destinations", "predictions", F.coalesce("hit", F.lit(False)).alias("is_true"))


def label_negatives(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("is_true", F.lit(False))


def append_predictions(edges: DataFrame, predictions: DataFrame, relation: str = "predicted", least: float = 0.9) -> DataFrame:
    """Edges and, under a relation of their own, predictions above ``least`` that no edge has yet."""
    new = predictions.filter(F.col("predictions") > least).select(*triple(F.col("sources"), relation, F.col("destinations"), F.col("predictions")))
    return edges.unionByName(new.join(edges.select("head", "tail").distinct(), ["head", "tail"], "left_anti").select("head", "relation", "tail", "weight"))


def of_core(predictions: DataFrame, core: DataFrame) -> DataFrame:
    return predictions.join(core.select(F.col("entity").alias("destinations")), "destinations", "left_semi")


def _ranked_scores(labelled: DataFrame, score: str) -> DataFrame:
    """``s, pos, neg, tp, fp`` of the distinct scores: rows of each class at a score, and at it or above.

    Scores are grouped first; running counts take one sorted pass over these groups, partition by partition.
    """
    groups = labelled.groupBy(F.col(score).alias("s")).agg(F.count_if("is_true").alias("pos"), F.count_if(~F.col("is_true")).alias("neg"))
    part = materialise(groups.repartitionByRange(F.desc("s")).sortWithinPartitions(F.desc("s")).withColumn("p", F.spark_partition_id()), "scores")
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = part.groupBy("p").agg(F.sum("pos").alias("pos_p"), F.sum("neg").alias("neg_p"))
    base = base.select("p", *(F.coalesce(F.sum(f"{c}_p").over(ahead), F.lit(0)).alias(f"{c}_base") for c in ("pos", "neg")))
    own = Window.partitionBy("p").orderBy(F.desc("s"))
    counted = part.join(F.broadcast(base), "p")
    return counted.select("s", "pos", "neg", (F.col("pos_base") + F.sum("pos").over(own)).alias("tp"), (F.col("neg_base") + F.sum("neg").over(own)).alias("fp"))


def auroc(labelled: DataFrame, score: str = "predictions") -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half; null if only one class occurs."""
    ranked = _ranked_scores(labelled, score)
    total = ranked.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("above"))
    return total.select("n_pos", "n_neg", F.round(1 - F.try_divide("above", F.col("n_pos") * F.col("n_neg")), 9).alias("auroc"))


def auprc(labelled: DataFrame, score: str = "predictions") -> DataFrame:
    """Area under the precision-recall curve as average precision over distinct scores; null if nothing is true."""
    ranked = _ranked_scores(labelled, score)
    gain = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return ranked.agg(F.sum("pos").alias("n_pos"), F.sum(gain).alias("gain")).select("n_pos", F.round(F.try_divide("gain", "n_pos"), 9).alias("auprc"))


def threshold_metrics(labelled: DataFrame, thresholds: tuple[float, ...] = (0.5,), score: str = "predictions") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, specificity, F1 and Matthews correlation of each threshold.

    A score at a threshold or above counts as positive; a measure whose divisor is 0 is null.
    """
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    said, true = F.col(score) >= F.col("threshold"), F.col("is_true")
    counts = labelled.withColumn("threshold", levels).groupBy("threshold").agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    measures = {
        "accuracy": (tp + tn, tp + fp + fn + tn), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "specificity": (tn, tn + fp),
        "f1": (2 * tp, 2 * tp + fp + fn), "mcc": (tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    return counts.select("threshold", "tp", "fp", "fn", "tn", *(F.round(F.try_divide(a, b), 9).alias(k) for k, (a, b) in measures.items()))


def holdout(edges: DataFrame, share: float = 0.3, seed: int = 1) -> DataFrame:
    """Adds ``part``: ``test`` for a hashed share of the edges whose ends both keep another edge, else ``train``.

    Each node keeps its edge of the least hash in training, which leaves no node without one. The least hashes are
    written and looked up by hash, so that the edges are not exchanged by their ends, and not at all if there are few.
    """
    digest = F.md5(F.concat_ws("|", F.col("lo").cast("string"), F.col("hi").cast("string"), F.lit(str(seed))))
    own = undirected(edges).withColumn("h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    own = own.filter("lo IS NOT NULL")
    kept = own.select(F.explode(F.array("lo", "hi")).alias("node"), "h").groupBy("node").agg(F.min("h").alias("m"))
    kept = materialise(kept.groupBy("m").agg(F.collect_set("node").alias("of")), "kept")
    marked = own.join(kept, F.col("h") == F.col("m"), "left")
    least = F.array_contains("of", F.col("lo")) | F.array_contains("of", F.col("hi"))
    test = (F.pmod(F.shiftrightunsigned("h", 8), F.lit(1000)) < int(share * 1000)) & ~F.coalesce(least, F.lit(False))
    return marked.withColumn("part", F.when(test, "test").otherwise("train")).select(*edges.columns, "part")


def negative_edges(edges: DataFrame, nodes: DataFrame, per_node: int = 1, seed: int = 1) -> DataFrame:
    """``head, tail`` pairs that are no edges: nodes numbered by hash are paired with the next ones in that order.

    The numbers have no gaps and the last nodes are paired with the first, so every node has ``per_node`` pairs
    before edges are taken out. Only a count per partition reaches the driver.
    """
    ranged = nodes.select("node", F.xxhash64("node", F.lit(seed)).alias("h")).repartitionByRange("h").sortWithinPartitions("h")
    numbered = materialise(ranged.withColumn("id", F.monotonically_increasing_id()), "nodes")
    part = F.shiftright("id", 33)
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for p, n in counts:
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += n
    if not total:
        return nodes.select(F.col("node").alias("head"), F.col("node").alias("tail"))
    numbered = numbered.withColumn("id", F.element_at(F.create_map(*starts), part) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    steps = F.explode(F.sequence(F.lit(1), F.lit(per_node)))
    shifted = numbered.select(F.col("node").alias("head"), "id", steps.alias("k")).withColumn("next", F.pmod(F.col("id") + F.col("k"), F.lit(total)))
    pairs = shifted.join(numbered.select(F.col("node").alias("tail"), F.col("id").alias("next")), "next").select("head", "tail")
    pairs = undirected(pairs.filter("head <> tail")).dropDuplicates(["lo", "hi"])
    return pairs.join(undirected(edges).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti").select("head", "tail")


def fit_products(data: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """A multilayer perceptron on ``x``, ``size`` numbers, fitted on the training rows of ``data (is_true, part, x)``; ``predictions`` instead of ``x``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = [c for c in data.columns if c != "x"]
    rows = data.select(*own, array_to_vector("x").alias("features"), F.col("is_true").cast("double").alias("label"))
    model = MultilayerPerceptronClassifier(layers=[size, 16, 2], maxIter=60, seed=seed).fit(rows.filter("part = 'train'"))
    return model.transform(rows).select(*own, vector_to_array("probability")[1].alias("predictions"))


def fit_edge_model(pairs: DataFrame, features: DataFrame, seed: int = 1):
    """A multilayer perceptron on products of node features; ``pairs`` is ``head, tail, is_true``. Returns scored pairs."""
    product = F.zip_with("a", "b", lambda x, y: (x * y).cast("double"))
    left = features.select(F.col("node").alias("head"), F.col("x").alias("a"))
    right = features.select(F.col("node").alias("tail"), F.col("x").alias("b"))
    data = pairs.join(left, "head").join(right, "tail").select("head", "tail", "part", "is_true", product.alias("x"))
    return fit_products(data, len(data.first()["x"]), seed)
