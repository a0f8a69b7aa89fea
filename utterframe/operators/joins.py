"""Joins that equality alone does not express, and lookups with defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with a table that has one row per key; missing values take their default."""
    out = df.join(dim, list(keys), "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among those done; null keys match null keys."""
    cond = [todo[k].eqNullSafe(done[k]) for k in keys]
    return todo.join(done.select(*keys).distinct(), _all(cond), "left_anti")


def _all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], bucket: int, tolerance: int = 0) -> DataFrame:
    """Pairs of `left` and `right` rows of one key whose intervals overlap, or of which the left lies
    within the right by a tolerance.

    Each side is listed in every bucket that it touches, so that pairs meet by equality; a pair that
    shares several buckets is kept in the first.
    """
    (ls, le), (rs, re) = a, b
    cut = lambda df, lo, hi: df.withColumn("bucket__", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    x = cut(left, F.col(ls), F.col(le))
    y = cut(right, F.col(rs) - tolerance, F.col(re) + tolerance)
    pairs = x.join(y, [*keys, "bucket__"])
    inside = (F.col(ls) >= F.col(rs) - tolerance) & (F.col(le) <= F.col(re) + tolerance)
    overlap = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
    first = F.floor(F.greatest(F.col(ls), F.col(rs) - tolerance) / bucket)
    return pairs.where((inside | overlap) & (F.col("bucket__") == first)).drop("bucket__")


def nearest_before(points: DataFrame, values: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """The last known value at or before each point, and the first at or after it (for interpolation)."""
    both = points.select(*keys, at, F.lit(None).cast("double").alias(value), F.lit(1).alias("point__"))
    both = both.unionAll(values.select(*keys, at, F.col(value).cast("double"), F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(at, "point__")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(at, F.desc("point__")).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    out = both.withColumn("before__", F.last(known, ignorenulls=True).over(past)).withColumn("after__", F.first(known, ignorenulls=True).over(ahead))
    return out.where("point__ = 1").drop("point__", value)


def interpolated(points: DataFrame, values: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Linear interpolation of values at points; 0 outside the known range."""
    out = nearest_before(points, values, keys, at, value)
    b, a = F.col("before__"), F.col("after__")
    share = (F.col(at) - b.t) / (a.t - b.t)
    v = F.when(b.isNull() | a.isNull(), 0.0).when(a.t == b.t, b.v).otherwise(b.v + (a.v - b.v) * share)
    return out.withColumn(value, v).drop("before__", "after__")


def ordinal_slices(parents: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """Each parent's range of ordinals (from 1) in the flat list of its key's children."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(size).over(w), F.lit(0)) + 1
    return parents.withColumn("first_no", first).withColumn("last_no", F.col("first_no") + F.col(size) - 1)


def first_hit(df: DataFrame, key: str, tables: Sequence[tuple[DataFrame, str]], compute: Column) -> DataFrame:
    """The value of the first table that knows a key; computed, once per distinct key, where none does."""
    keys = df.select(key).distinct()
    known = keys
    for i, (t, value) in enumerate(tables):
        known = known.join(t.select(key, F.col(value).alias(f"hit{i}__")), key, "left")
    hit = F.coalesce(*[F.col(f"hit{i}__") for i in range(len(tables))], compute)
    return df.join(known.select(key, hit.alias("value")), key, "left")


def symmetric(df: DataFrame, i: str, j: str, p: str) -> DataFrame:
    """Mean of p(i, j) and p(j, i)."""
    other = df.select(F.col(i).alias(j), F.col(j).alias(i), F.col(p).alias("q__"))
    return df.join(other, [i, j], "full").select(i, j, ((F.coalesce(p, F.lit(0.0)) + F.coalesce("q__", F.lit(0.0))) / 2).alias(p))
