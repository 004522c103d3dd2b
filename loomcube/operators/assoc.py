"""Association analysis: merged ids, z-scores, significance sets, exact combinations, pathways, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: degrees of freedom taken off in the z-score of a category.
DDOF = 6


def merge_redundant(table: DataFrame, key: str, value_columns: list[str]) -> DataFrame:
    """Ids with equal values in all ``value_columns`` (nulls are equal) become one, joined by semicolons in order."""
    return table.groupBy(*value_columns).agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ";").alias(key))


def merge_entities(scores: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores and members of the entities that remain when those with equal synonyms and equal scores become one.

    ``scores`` is ``category, entity, score`` with one row a pair, ``synonyms`` is ``entity, synonyms``, a text or an
    array whose order and repetitions do not matter. A missing category, a null and a NaN are equal. Entities without
    synonyms stay alone, since nothing shows that they are the same. Returns ``category, entity, score`` with merged
    names, ids joined by semicolons in order, and ``entity, member, synonyms`` with a row for each id that has a score.
    """
    known = F.col("score").isNotNull() & ~F.isnan("score")
    cell = F.when(known, F.concat_ws("=", "category", (F.col("score") + F.lit(0.0)).cast("string")))  # -0.0 is 0.0
    vectors = scores.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list(cell)), "|").alias("vector"))
    listed = dict(synonyms.dtypes)["synonyms"].startswith("array")
    key = F.to_json(F.sort_array(F.array_distinct("synonyms"))) if listed else F.col("synonyms")
    own = vectors.join(synonyms.select("entity", key.alias("key")), "entity", "left")
    alone = F.when(F.col("key").isNull(), F.col("entity"))
    merged = own.groupBy("vector", "key", alone.alias("alone")).agg(F.sort_array(F.collect_set("entity")).alias("ids"))
    members = merged.select(F.array_join("ids", ";").alias("name"), F.explode("ids").alias("member"))
    first = merged.select(F.array_join("ids", ";").alias("name"), F.get("ids", F.lit(0)).alias("entity"))
    kept = scores.select("category", "entity", "score").join(first, "entity").select("category", F.col("name").alias("entity"), "score")
    members = members.join(synonyms.select(F.col("entity").alias("member"), "synonyms"), "member", "left")
    return kept, members.select(F.col("name").alias("entity"), "member", "synonyms")


def z_scores(scores: DataFrame, value: str = "score", ddof: int = DDOF) -> DataFrame:
    """Adds ``z`` per category over its non-zero values; null where there are too few or no deviation.

    Moments of a category are aggregated and joined back, so no category is gathered in one task.
    """
    x = F.nullif(F.col(value), F.lit(0.0))
    moments = scores.groupBy("category").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("dev"))
    spread = F.col("dev") * F.sqrt(F.try_divide(F.col("n"), F.col("n") - ddof))
    z = F.when((F.col("n") > ddof) & (F.col("dev") > 0), (x - F.col("mean")) / spread)
    return scores.join(moments, "category").withColumn("z", z).drop("n", "mean", "dev")


def flags(z: DataFrame, threshold: float) -> DataFrame:
    """``category, entity, significant``."""
    return z.select("category", "entity", F.coalesce(F.col("z") >= threshold, F.lit(False)).alias("significant"))


def in_all(z: DataFrame, n_categories: int) -> DataFrame:
    """Entities with a z-score in every category (category I)."""
    return z.groupBy("entity").agg(F.count("z").alias("n")).filter(F.col("n") == n_categories).select("entity")


def significant_sets(z: DataFrame, threshold: float) -> DataFrame:
    """``entity, n, categories``: the exact set of categories in which an entity is significant."""
    own = z.filter(F.col("z") >= threshold).groupBy("entity").agg(F.sort_array(F.collect_set("category")).alias("set"))
    return own.select("entity", F.size("set").cast("long").alias("n"), F.array_join("set", "|").alias("categories"))


def only_in_one(sets: DataFrame) -> DataFrame:
    """Entities significant in one category alone (category II)."""
    return sets.filter("n = 1").select(F.col("categories").alias("category"), "entity")


def set_sizes(sets: DataFrame) -> DataFrame:
    """Entities by exact combination of categories (category III and the data of an UpSet plot)."""
    return sets.groupBy("categories").agg(F.min("n").alias("n_categories"), F.count("*").alias("n_entities"))


def membership(sets: DataFrame, categories: list[str]) -> DataFrame:
    """A boolean column per category."""
    listed = F.split("categories", r"\|")
    return sets.select("entity", *(F.array_contains(listed, c).alias(c) for c in categories))


def summary_table(z: DataFrame, threshold: float, synonyms: DataFrame, n_categories: int) -> DataFrame:
    """Per entity: whether it is in category I, its exact set, its only category if one, and its synonyms."""
    sets = significant_sets(z, threshold)
    every = z.groupBy("entity").agg((F.count("z") == n_categories).alias("category_i"))
    return (
        every.join(sets, "entity", "left")
        .join(synonyms.select("entity", "synonyms"), "entity", "left")
        .select("entity", "category_i", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "categories", F.when(F.col("n") == 1, F.col("categories")).alias("category_ii"), "synonyms")
    )


def cutoff_table(scores: DataFrame, thresholds: tuple[float, ...], value: str = "z") -> DataFrame:
    """For each threshold and category the entities above it there and nowhere else."""
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    above = scores.select("category", "entity", F.col(value).alias("v"), levels).filter("v >= threshold")
    alone = above.groupBy("threshold", "entity").agg(F.min("category").alias("category"), F.count_distinct("category").alias("n")).filter("n = 1")
    counted = alone.groupBy("threshold", "category").agg(F.count("*").alias("n_exclusive"))
    grid = scores.select("category").distinct().select("category", levels)
    return grid.join(counted, ["threshold", "category"], "left").select("threshold", "category", F.coalesce("n_exclusive", F.lit(0).cast("long")).alias("n_exclusive"))


def positive_everywhere(scores: DataFrame, value: str = "score") -> DataFrame:
    return scores.groupBy("entity").agg(F.min(value).alias("low")).filter("low > 0").select("entity")


def above_in_several(scores: DataFrame, threshold: float, value: str = "score") -> DataFrame:
    """Entities above a cut-off in more than one category."""
    return scores.groupBy("entity").agg(F.count_if(F.col(value) > threshold).alias("n")).filter("n > 1")


def best_per_category(scores: DataFrame, value: str = "score") -> DataFrame:
    """The entity of the largest value of each category; the least name of equal ones."""
    best = scores.groupBy("category").agg(F.min(F.struct((-F.col(value)).alias("neg"), "entity")).alias("b"))
    return best.select("category", F.col("b.entity").alias("entity"), (-F.col("b.neg")).alias(value))


def cell_counts(scores: DataFrame, value: str = "score") -> DataFrame:
    return scores.agg(F.count_if(F.col(value) == 0).alias("n_zero"), F.count_if(F.col(value) != 0).alias("n_nonzero"))


def pathway_coverage(members: DataFrame, entities: DataFrame) -> DataFrame:
    """``pathway, n_found, n_total, coverage``; 0 for pathways without a hit."""
    own = members.select("pathway", "entity").distinct().join(entities.select("entity").distinct().withColumn("hit", F.lit(1)), "entity", "left")
    return own.groupBy("pathway").agg(F.count("hit").alias("n_found"), F.count("*").alias("n_total")).withColumn("coverage", F.col("n_found") / F.col("n_total"))


def pathway_means(members: DataFrame, z: DataFrame) -> DataFrame:
    """Mean z-score and number of scored entities by pathway and category, nulls skipped."""
    own = members.select("pathway", "entity").distinct().join(z, "entity")
    return own.groupBy("pathway", "category").agg(F.avg("z").alias("mean_z"), F.count("z").alias("n_scored"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series above 20, where its error is below 1e-13, and by the product below."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.get(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(21))), F.least(n, F.lit(20)).cast("int"))
    return F.when(n <= 20, small).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def enrichment(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_name, pathway, hits, p_value``: over-representation of each set's entities in each pathway.

    The upper tail of the hypergeometric distribution. ``sets`` is ``set_name, entity``; entities outside of all
    pathways are left out; ids joined by semicolons are split. Only counts meet in the last step: the terms of a
    tail are summed in place, one row per set and pathway with a hit. The first term comes from factorials, each
    further one from the one before by its ratio.
    """
    own = members.select("pathway", "entity").distinct()
    split = sets.select("set_name", F.explode(F.split("entity", ";")).alias("entity")).distinct()
    universe = own.select("entity").distinct()
    drawn = split.join(universe, "entity", "left_semi")
    total = universe.agg(F.count("*").alias("n"))
    size = own.groupBy("pathway").agg(F.count("*").alias("k"))
    draws = drawn.groupBy("set_name").agg(F.count("*").alias("m"))
    hits = drawn.join(own, "entity").groupBy("set_name", "pathway").agg(F.count("*").alias("hits"))
    rows = hits.join(size, "pathway").join(draws, "set_name").join(F.broadcast(total))  # one row
    n, k, m = F.col("n"), F.col("k"), F.col("m")

    low = F.greatest(F.col("hits"), m - (n - k))
    rows = rows.withColumn("low", low)
    low = F.col("low")
    rows = rows.withColumn("term", F.exp(log_choose(k, low) + log_choose(n - k, m - low) - log_choose(n, m)))

    def step(acc: Column, i: Column) -> Column:  # from the term of i to that of i + 1
        ratio = (k - i) * (m - i) / ((i + 1) * (n - k - m + i + 1))
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ratio).alias("term"))

    start = F.struct(F.lit(0.0).alias("sum"), F.col("term").alias("term"))
    tail = F.aggregate(F.sequence(low, F.least(k, m)), start, step, lambda acc: acc["sum"])
    return rows.select("set_name", "pathway", "hits", F.least(tail, F.lit(1.0)).alias("p_value"))


def significant_pathways(p_values: DataFrame, most: float = 0.05, n: int = 15) -> DataFrame:
    """The first pathways of each set below a p-value."""
    order = Window.partitionBy("set_name").orderBy("p_value", "pathway")
    return p_values.filter(F.col("p_value") < most).withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= n)


def unique_pathways(p_values: DataFrame, most: float = 0.05, n: int = 3) -> DataFrame:
    """Per set the first pathways that are significant in it alone, by p-value and then name."""
    good = p_values.filter(F.col("p_value") < most)
    alone = good.groupBy("pathway").agg(F.min("set_name").alias("set_name"), F.count("*").alias("n"), F.min("p_value").alias("p_value")).filter("n = 1").drop("n")
    order = Window.partitionBy("set_name").orderBy("p_value", "pathway")
    return alone.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= n)


def pathway_listing(members: DataFrame, names: DataFrame) -> DataFrame:
    """``pathway, name, entities`` with entities joined by semicolons."""
    own = members.groupBy("pathway").agg(F.array_join(F.sort_array(F.collect_set("entity")), ";").alias("entities"))
    return own.join(names.select(F.col("id").alias("pathway"), "name"), "pathway", "left")


def heatmap(means: DataFrame, categories: list[str], value: str = "mean_z") -> DataFrame:
    """``pathway`` and a column of ``value`` for each category, null where a pathway has none."""
    return means.groupBy("pathway").pivot("category", categories).agg(F.first(value))


def entity_sets(z: DataFrame, threshold: float, core: DataFrame, n_categories: int, value: str = "score") -> DataFrame:
    """``set_name, entity`` of the five kinds of sets that pathways are sought for, in one table.

    ``core|c``: significant entities of the core in category c; ``I``: those with a z-score in every category;
    ``II|c``: those significant in c alone; ``all``: every scored entity; ``nonzero|c``: those with a value in c.
    """
    def named(kind: str, rows: DataFrame, category: bool = True) -> DataFrame:
        name = F.concat(F.lit(f"{kind}|"), F.col("category")) if category else F.lit(kind)
        return rows.select(name.alias("set_name"), "entity")

    high = z.filter(F.col("z") >= threshold)
    parts = [
        named("core", high.join(core.select("entity").distinct(), "entity", "left_semi")),
        named("I", in_all(z, n_categories), False),
        named("II", only_in_one(significant_sets(z, threshold))),
        named("all", z, False),
        named("nonzero", z.filter(F.col(value) != 0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def components(table: DataFrame, key: str, columns: list[str], n: int = 2) -> DataFrame:
    """Principal components of standardised columns, as ``key, pc1, pc2, …``; a null takes its column's mean.

    The largest loading of a component (the first such column) is positive.
    """
    means = table.agg(*(F.avg(c).alias(c) for c in columns)).first().asDict()
    table = table.fillna({c: v for c, v in means.items() if v is not None}).fillna(0.0, columns)
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=columns, outputCol="raw").transform(table)
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="x").fit(vectors).transform(vectors)
    model = PCA(k=n, inputCol="x", outputCol="pc").fit(scaled)
    loadings = model.pc.toArray()  # a column of the table each row, n columns
    signs = [-1.0 if max(column.round(9), key=abs) < 0 else 1.0 for column in loadings.T]
    out = model.transform(scaled).withColumn("v", vector_to_array("pc"))
    return out.select(key, *((F.col("v")[i] * F.lit(s)).alias(f"pc{i + 1}") for i, s in enumerate(signs)))
