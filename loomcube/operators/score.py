"""Popularity, distinctiveness and their product for every category and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcube.operators.cube import dense_grid, tf_df

#: Saturation and length weights of the term frequency.
K1, B = 1.2, 0.75


def measures(grid: DataFrame) -> DataFrame:
    """``grid(category, entity, tf, df)`` with pop, ntf, ndf, ratio, dist and score.

    Totals of a category are aggregated before they are joined back, so a category is never gathered in one task;
    the join is left to adaptive execution, which sends a small side whole and splits a hot category otherwise. The sum over categories is taken per entity. A category whose total is
    1 or 0 has no popularity (null).
    """
    totals = grid.groupBy("category").agg(
        F.sum("tf").alias("total"), F.count_if(F.col("tf") > 0).alias("n_entities"), F.max("df").alias("max_df")
    )
    d = F.col
    pop = F.try_divide(F.ln(d("tf") + 1), F.nullif(F.ln(F.nullif(d("total"), F.lit(0))), F.lit(0.0)))
    ntf = F.try_divide(d("tf") * (K1 + 1), d("tf") + K1 * (1 - B + B * d("n_entities")))
    ndf = F.when(d("df") == 0, F.lit(0.0)).otherwise(F.try_divide(F.ln(d("df") + 1), F.ln(d("max_df") + 1)))
    base = grid.join(totals, "category").select("category", "entity", "tf", "df", pop.alias("pop"), ntf.alias("ntf"), ndf.alias("ndf"))
    ratio = base.withColumn("ratio", d("ntf") * d("ndf"))
    everywhere = F.sum(F.exp("ratio")).over(Window.partitionBy("entity"))
    dist = (F.exp("ratio") - 1) / (1 + everywhere)
    return ratio.withColumn("dist", dist).withColumn("score", d("pop") * d("dist"))


def score(obs: DataFrame, entities: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """All measures from the cube; ``entities`` may name more than those found."""
    return measures(dense_grid(tf_df(obs), entities, categories))


def score_core(obs: DataFrame, core: DataFrame) -> DataFrame:
    """The measures of core entities alone; they differ from those of all, as the totals do."""
    return score(obs.join(core.select("entity").distinct(), "entity", "left_semi"))


def wide(scores: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """A row per entity and a column per category."""
    return scores.groupBy("entity").pivot("category", categories).agg(F.first(value))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, for export and comparison."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
