"""Error rates, rollups, confusion counts and their probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import log_cost, relative_improvement
from utterframe.session import broadcast_if_small

MAX_LABELS = 20_000


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def corpus_rate(df: DataFrame, keys: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """Micro character error rate: all errors over all reference characters."""
    errors = F.sum(F.levenshtein(reference, hypothesis)).cast("bigint")
    chars = F.sum(F.length(reference)).cast("bigint")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), errors.alias("n_errors"), chars.alias("n_chars"))
    return out.withColumn("cer", F.round(ratio(F.col("n_errors"), F.col("n_chars")), 4))


def row_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of one row; 1 for a hypothesis against an empty reference, 0 for two empty ones."""
    empty = F.when(F.length(hypothesis) > 0, 1.0).otherwise(0.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def rollup_rate(df: DataFrame, key: str, columns: dict[str, Column], all_label: str = "all") -> DataFrame:
    """Aggregates per value of a key and over all rows, in one pass."""
    out = df.groupingSets([[F.col(key)], []], F.col(key)).agg(*[c.alias(n) for n, c in columns.items()], F.grouping(key).alias("whole__"))
    return out.withColumn(key, F.when(F.col("whole__") == 1, all_label).otherwise(F.coalesce(key, F.lit("none")))).drop("whole__")


def improvement_summary(df: DataFrame, key: str, raw: str, new: str) -> DataFrame:
    """Count, means and the relative improvement of the means, per value and over all."""
    out = rollup_rate(df, key, {"n": F.count("*"), "mean_raw": F.avg(raw), "mean_new": F.avg(new)})
    return out.withColumn("improvement_pct", F.round(relative_improvement(F.col("mean_raw"), F.col("mean_new")), 4)).withColumn("mean_raw", F.round("mean_raw", 6)).withColumn("mean_new", F.round("mean_new", 6))


def conditional_probabilities(counts: DataFrame, source: str, target: str, count: str, alpha: float = 0.0, labels: DataFrame | None = None) -> DataFrame:
    """Row-conditional probabilities with Dirichlet smoothing; uniform only for an empty row without any.

    `labels` (one column named like `target`) makes the matrix dense; it holds an alphabet.
    """
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    labels = labels if labels is not None else counts.select(F.col(target)).distinct()
    # The matrix is dense by definition; its side is the alphabet, whose size is checked.
    labels = broadcast_if_small(labels, MAX_LABELS)
    size = labels.agg(F.count("*").alias("v__"))
    grid = counts.select(source).distinct().join(labels)
    full = grid.join(counts, [source, target], "left").withColumn(count, F.coalesce(count, F.lit(0))).join(F.broadcast(size))
    total = F.sum(count).over(Window.partitionBy(source))
    whole = total + alpha * F.col("v__")
    p = F.when(whole > 0, (F.col(count) + alpha) / whole).otherwise(1 / F.col("v__"))
    return full.withColumn("p", p).withColumn("support", total).drop("v__")


def log_costs(probabilities: DataFrame, source: str, target: str, epsilon: float, least_support: int, fallback: float) -> DataFrame:
    """Substitution costs: nothing on the diagonal, a fallback for a source seen too rarely."""
    cost = F.when(F.col(source) == F.col(target), 0.0).when(F.col("support") < least_support, fallback).otherwise(log_cost(F.col("p"), epsilon))
    return probabilities.withColumn("cost", cost)


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Least and most frequent value, mean and population deviation of the counts, coverage."""
    return df.groupBy(*keys).agg(
        F.min_by(value, F.struct(count, value)).alias("rarest"), F.max_by(value, F.struct(F.col(count), F.col(value))).alias("commonest"),
        F.round(F.avg(count), 6).alias("mean_count"), F.round(F.stddev_pop(count), 6).alias("sd_count"), F.count(F.when(F.col(count) > 0, 1)).alias("n_active"), F.round(F.count(F.when(F.col(count) > 0, 1)) / F.count("*"), 6).alias("coverage"),
    )
