"""Rankings, batches, top-k and best-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn__", F.row_number().over(w)).where(F.col("rn__") <= k).drop("rn__")


def best_of_each(df: DataFrame, keys: Sequence[str], orders: dict[str, Sequence[Column]], pick: Sequence[str]) -> DataFrame:
    """For several orderings at once, the row that each puts first."""
    chosen = F.struct(*pick)
    return df.groupBy(*keys).agg(*[F.min_by(chosen, F.struct(*order)).alias(name) for name, order in orders.items()])


def length_batches(df: DataFrame, keys: Sequence[str], length: str, tie: Sequence[str], most: int) -> DataFrame:
    """Batches of at most `most` rows of similar length."""
    w = Window.partitionBy(*keys).orderBy(length, *tie)
    return df.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / most))


def tiered_best(df: DataFrame, keys: Sequence[str], pick: str, ok: Column, score: Column, fallback: Column, default: str) -> DataFrame:
    """The best score among rows that qualify, else the least fallback value, else a constant."""
    return df.groupBy(*keys).agg(F.coalesce(F.max_by(pick, F.when(ok, F.struct(score, F.col(pick)))), F.min_by(pick, F.struct(fallback, F.col(pick))), F.lit(default)).alias(pick))
