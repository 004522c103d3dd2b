"""Link prediction: labelled pairs of a connected holdout, edge features from node vectors, models, and a grid of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcube.operators import embed, kg
from loomcube.operators.embed import distmult
from loomcube.operators.forest import connected_holdout
from loomcube.operators.rank import positions
from loomcube.operators.spectral import spectrum
from loomcube.storage import discard, materialise


def shuffled_negatives(edges: DataFrame, seed: int = 1) -> DataFrame:
    """``head, tail`` pairs that are no edges: every edge's head with the tail of the next edge in the order of a hash.

    So heads and tails keep their kinds and come as often as in the edges, but for pairs that are edges after all.
    The last edge takes the tail of the first.
    """
    pairs = edges.select("head", "tail").distinct()
    order = [F.xxhash64("head", "tail", F.lit(seed)), F.col("head"), F.col("tail")]
    placed = materialise(positions(pairs.withColumn("all", F.lit(0)), "all", order, "at").drop("all"), "pairs")
    n = placed.count()
    following = placed.select((F.pmod(F.col("at") - 2, F.lit(max(1, n))) + 1).alias("at"), F.col("tail").alias("other"))
    shifted = kg.undirected(placed.join(following, "at").select("head", F.col("other").alias("tail")).filter("head <> tail")).dropDuplicates(["lo", "hi"])
    return shifted.join(kg.undirected(pairs).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti").select("head", "tail")


def labelled_pairs(edges: DataFrame, share: float = 0.3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The training edges of a connected holdout, and ``head, tail, is_true, part`` of all edges and as many negatives.

    Negatives are dealt to the parts in the proportion of the edges.
    """
    edges = materialise(edges, "edges")
    held = connected_holdout(edges, share, seed)
    negative = F.when(F.pmod(F.xxhash64("head", "tail", F.lit(seed + 1)), F.lit(1000)) < int(share * 1000), "test").otherwise("train")
    wrong = shuffled_negatives(edges, seed).select("head", "tail", F.lit(False).alias("is_true"), negative.alias("part"))
    right = held.filter("head <> tail").select("head", "tail", F.lit(True).alias("is_true"), "part").distinct()
    return held.filter("part = 'train'").drop("part"), materialise(right.unionByName(wrong), "labelled-pairs")


def cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def edge_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds ``similarity``, the cosine of the head's ``x`` and the tail's ``y`` (its ``x`` if there is none).

    Pairs with an end without vector are left out.
    """
    left = vectors.select(F.col("node").alias("head"), F.col("x").alias("a"))
    right = vectors.select(F.col("node").alias("tail"), F.col("y" if "y" in vectors.columns else "x").alias("b"))
    return pairs.join(left, "head").join(right, "tail").select(*pairs.columns, cosine("a", "b").alias("similarity"))


def scored(features: DataFrame, model: str, seed: int = 1) -> DataFrame:
    """Adds ``predictions`` of a ``perceptron`` (one logistic unit) or an ``mlp`` fitted on the training pairs."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = features.withColumns({"features": array_to_vector(F.array("similarity")), "label": F.col("is_true").cast("double")})
    learner = LogisticRegression(maxIter=50) if model == "perceptron" else MultilayerPerceptronClassifier(layers=[1, 8, 2], maxIter=60, seed=seed)
    fitted = learner.fit(data.filter("part = 'train'"))
    return fitted.transform(data).select(*features.columns, vector_to_array("probability")[1].alias("predictions"))


def _spectral(matrix: str) -> Callable[[DataFrame, int, int], DataFrame]:
    """Eigenvectors times the roots of the sizes of their values; a negative value turns its part of ``y`` around.

    So the product of a head's ``x`` and a tail's ``y`` is the entry of the matrix of the rank that is left, which the
    products of one and the same vectors are not: two groups of a bipartite graph have values of both signs.
    """

    def vectors(edges: DataFrame, d: int, seed: int) -> DataFrame:
        x, values = spectrum(edges.select("head", "tail", F.lit(1.0).alias("weight")).distinct(), d, matrix, rounds=8, tol=1e-4, seed=seed)
        scale = F.lit([abs(v) ** 0.5 for v in values]).cast("array<double>")
        turned = F.lit([abs(v) ** 0.5 * (-1.0 if v < 0 else 1.0) for v in values]).cast("array<double>")
        product = lambda a, b: F.zip_with(a, b, lambda u, v: u * v)
        return x.select("node", product("x", scale).alias("x"), product("x", turned).alias("y"))

    return vectors


def _typed(edges: DataFrame) -> DataFrame:
    relation = F.col("relation") if "relation" in edges.columns else F.lit("edge")
    return edges.select("head", relation.alias("relation"), "tail")


def _distmult(edges: DataFrame, d: int, seed: int) -> DataFrame:
    return distmult(_typed(edges), d, seed=seed)[0]


#: Ways to node vectors: the leading eigenvectors of the adjacency or the Laplacian matrix, and trained ones.
EMBEDDINGS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {"adjacency": _spectral("adjacency"), "laplacian": _spectral("laplacian"), "distmult": _distmult}
MODELS = ("perceptron", "mlp")


def grid(edges: DataFrame, embeddings=tuple(EMBEDDINGS), models=MODELS, folds: int = 2, d: int = 16, share: float = 0.3, seed: int = 1) -> DataFrame:
    """``embedding, model, folds, n_test, auroc, auprc``: a row a configuration, means over the folds.

    A fold is a connected holdout of its own seed. Vectors come from its training edges only, models see the cosine
    of the ends' vectors.
    """
    spark, rows = edges.sparkSession, []
    for fold in range(folds):
        train, pairs = labelled_pairs(edges, share, seed + 10 * fold)
        for name in embeddings:
            features = materialise(edge_features(pairs, EMBEDDINGS[name](train, d, seed + fold)), "edge-features")
            for model in models:
                test = materialise(scored(features, model, seed).filter("part = 'test'"), "predictions")
                roc, prc = kg.auroc(test).first(), kg.auprc(test).first()
                rows.append((name, model, roc["n_pos"] + roc["n_neg"], roc["auroc"], prc["auprc"]))
                discard(test)
            discard(features)
    table = spark.createDataFrame(rows, "embedding string, model string, n long, auroc double, auprc double")
    mean = {c: F.round(F.avg(c), 6).alias(c) for c in ("auroc", "auprc")}
    return table.groupBy("embedding", "model").agg(F.count("*").alias("folds"), F.sum("n").alias("n_test"), *mean.values())


def independent_evaluation(edges: DataFrame, d: int = 16, share: float = 0.3, seed: int = 1) -> DataFrame:
    """``part, is_true, n, mean_prediction`` of a model on products of trained vectors, for training, test and negatives."""
    train, pairs = labelled_pairs(edges, share, seed)
    predicted = kg.fit_products(embed.products(pairs, embed.train(_typed(train), d, seed=seed), d), d, seed)
    return predicted.groupBy("part", "is_true").agg(F.count("*").alias("n"), F.round(F.avg("predictions"), 6).alias("mean_prediction"))
