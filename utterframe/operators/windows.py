"""Windows over ordered rows: runs, islands, padding, boundaries, tumbling and overlapping frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import decibels


def run_starts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before: each run of equal values once."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("before__", before).where(~F.col("before__").eqNullSafe(F.col(value))).drop("before__")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], fresh: Column, name: str = "island") -> DataFrame:
    """Numbers stretches of rows; `fresh` marks the first row of one (null counts as first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("fresh__", F.coalesce(fresh, F.lit(True)).cast("int"))
    return out.withColumn(name, F.sum("fresh__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh__")


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, start: str, end: str) -> DataFrame:
    """Contiguous rows of one label as one interval."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = islands(df.withColumn("last__", F.lag(label).over(w)), keys, order, ~F.col("last__").eqNullSafe(F.col(label)))
    return numbered.groupBy(*keys, "island").agg(F.first(label).alias(label), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def padded_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], pad: int, low: Column, high: Column) -> DataFrame:
    """Intervals padded on both sides by at most half the gap to a neighbour, within low and high."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(end).over(w), F.lead(start).over(w)
    out = df.withColumn("l__", before).withColumn("r__", after)
    left = F.least(F.lit(pad), F.greatest(F.floor((F.col(start) - F.col("l__")) / 2), F.lit(0)))
    right = F.least(F.lit(pad), F.greatest(F.floor((F.col("r__") - F.col(end)) / 2), F.lit(0)))
    return out.withColumn("padded_start", F.greatest(F.col(start) - F.when(F.col("l__").isNull(), pad).otherwise(left), low)).withColumn("padded_end", F.least(F.col(end) + F.when(F.col("r__").isNull(), pad).otherwise(right), high)).drop("l__", "r__")


def midpoint_boundaries(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Neighbours meet halfway; starts never fall back behind an earlier end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("mid__", F.floor((F.col(end) + F.lead(start).over(w)) / 2))
    out = out.withColumn("new_end", F.coalesce("mid__", F.col(end))).withColumn("new_start", F.coalesce(F.lag("mid__").over(w), F.col(start)))
    return out.withColumn("new_start", F.max("new_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("new_end", F.greatest("new_end", "new_start")).drop("mid__")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The last known value up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def running_sum(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of all rows up to each, in blocks that follow the order; a window over one row per block
    adds the earlier ones."""
    over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    earlier = df.groupBy(*keys, block).agg(F.sum(value).alias("sum__")).select(*keys, block, F.coalesce(F.sum("sum__").over(over), F.lit(0)).alias("before__"))
    inside = F.sum(value).over(Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, inside).join(earlier, [*keys, block]).withColumn(name, F.col("before__") + F.coalesce(name, F.lit(0))).drop("before__")


def carried_over_blocks(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """As `carried`, in blocks that follow the order; an earlier block's last value is taken along."""
    last = df.groupBy(*keys, block).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("last__"))
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, block, F.last("last__", ignorenulls=True).over(w).alias("before__"))
    return carried(df, [*keys, block], order, value, name).join(last, [*keys, block]).withColumn(name, F.coalesce(name, "before__")).drop("before__")


def turns(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], label: str, name: str) -> DataFrame:
    """Numbers runs of one label (not null) from 1 on, in blocks that follow the order; a run may
    go on over any number of blocks."""
    w = Window.partitionBy(*keys, block).orderBy(*order)
    inner = df.withColumn("last__", F.lag(label).over(w)).withColumn("new__", (F.col("last__") != F.col(label)).cast("int"))
    place = F.struct(*order)
    blocks = inner.groupBy(*keys, block).agg(F.min_by(label, place).alias("first__"), F.max_by(label, place).alias("end__"), F.coalesce(F.sum("new__"), F.lit(0)).alias("n__"))
    over = Window.partitionBy(*keys).orderBy(block)
    blocks = blocks.withColumn("border__", (~F.lag("end__").over(over).eqNullSafe(F.col("first__"))).cast("int"))
    base = F.sum("border__").over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("n__").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*keys, block, base.alias("base__"))
    inside = F.coalesce(F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return inner.withColumn("inside__", inside).join(blocks, [*keys, block]).withColumn(name, F.col("base__") + F.col("inside__")).drop("last__", "new__", "inside__", "base__")


def dilated(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, radius: int, name: str) -> DataFrame:
    """Largest value within `radius` rows on either side."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)))


def overlapping_windows(df: DataFrame, position: str, size: int, margin: int) -> DataFrame:
    """Rows of overlapping windows, each without its margins, so that every row is taken once.

    Windows start every size - 2 * margin rows; the first keeps its left margin.
    """
    step = size - 2 * margin
    return df.withColumn("window_no", F.greatest(F.floor((F.col(position) - margin) / step), F.lit(0))).withColumn("window_start", F.col("window_no") * step).withColumn("offset", F.col(position) - F.col("window_start"))


def tumbling_level(df: DataFrame, keys: Sequence[str], position: str, value: str, size: int) -> DataFrame:
    """Level in dB of consecutive windows of `size` rows; an incomplete last one is left out."""
    out = df.groupBy(*keys, F.floor(F.col(position) / size).alias("window_no")).agg(F.count("*").alias("n"), F.avg(F.col(value) * F.col(value)).alias("power"))
    return out.where(F.col("n") == size).select(*keys, "window_no", F.round(decibels(F.col("power")), 6).alias("level_db"))


def apportioned(df: DataFrame, start: str, end: str, index: str, n: str) -> DataFrame:
    """Equal shares of an interval, in whole thousandths; the last one ends where it ends.

    The small addition makes halves round up whatever the noise in their last digits.
    """
    step = (F.col(end) - F.col(start)) / F.col(n)
    return df.withColumn("part_start", F.round(F.col(start) + F.col(index) * step + 1e-9, 3)).withColumn("part_end", F.when(F.col(index) == F.col(n) - 1, F.round(F.col(end), 3)).otherwise(F.round(F.col(start) + (F.col(index) + 1) * step + 1e-9, 3)))


def generated_id(prefix: str, ordinal: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(ordinal.cast("string"), width, "0"))


def gap_filled(df: DataFrame, keys: Sequence[str], start: str, end: str, label: str, total: Column, tolerance: int = 0) -> DataFrame:
    """A contiguous tier: overlaps clipped, swallowed intervals dropped, gaps filled with empty labels."""
    w = Window.partitionBy(*keys).orderBy(start, end, label)
    out = df.withColumn("reach__", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("from__", F.greatest(F.col(start), F.coalesce("reach__", F.lit(0)))).where(F.col(end) > F.col("from__"))
    own = F.struct(F.col("from__").cast("bigint").alias("xmin"), F.col(end).cast("bigint").alias("xmax"), F.coalesce(label, F.lit("")).alias("text"))
    gap = F.struct(F.coalesce("reach__", F.lit(0)).cast("bigint").alias("xmin"), F.col("from__").cast("bigint").alias("xmax"), F.lit("").alias("text"))
    has_gap = F.col("from__") - F.coalesce("reach__", F.lit(0)) > tolerance
    body = out.select(*keys, F.inline(F.when(has_gap, F.array(gap, own)).otherwise(F.array(own))))
    last = out.groupBy(*keys).agg(F.max(end).cast("bigint").alias("xmin"), F.max(total).cast("bigint").alias("xmax")).where(F.col("xmax") - F.col("xmin") > tolerance)
    return body.unionAll(last.select(*keys, "xmin", "xmax", F.lit("")))


def fused(df: DataFrame, keys: Sequence[str], start: str, end: str, text: str, pad: int) -> DataFrame:
    """Padded intervals that overlap become one, with their texts joined in order."""
    w = Window.partitionBy(*keys).orderBy(start, end, text)
    out = df.withColumn("a__", F.greatest(F.col(start) - pad, F.lit(0))).withColumn("b__", F.col(end) + pad)
    out = out.withColumn("reach__", F.max("b__").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = islands(out, keys, [start, end, text], F.col("a__") >= F.col("reach__"))
    parts = F.array_sort(F.collect_list(F.struct(start, end, text)))
    return out.groupBy(*keys, "island").agg(F.min("a__").cast("bigint").alias("xmin"), F.max("b__").cast("bigint").alias("xmax"), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("text"), F.count("*").alias("n")).drop("island")


def quietest_window(df: DataFrame, keys: Sequence[str], position: str, value: str, size: int) -> DataFrame:
    """Start of the window of `size` rows with the least mean square; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(0, size - 1)
    out = df.withColumn("n__", F.count("*").over(w)).withColumn("power", F.avg(F.col(value) * F.col(value)).over(w)).where(F.col("n__") == size)
    return out.groupBy(*keys).agg(F.min_by(position, F.struct(F.round("power", 9), F.col(position))).alias("window_start"), F.round(F.min("power"), 6).alias("least_power"))
