"""Union of time intervals per entity: continuous periods and the gaps between them.

The aggregate's state is a list of disjoint intervals in order of time. A task sorts its rows into
such lists once; from there on lists of the same entity and time block are merged linearly, two at a
time, first across salted partial groups, then per block (a reduction tree). Blocks are stitched by
a window over one summary row per block (its first start and last end) that is joined back to the
lists, so no task holds the lists of a whole entity. An interval belongs to the block of its start;
its end may reach into later blocks and is carried on as a running maximum, so a long interval is
never copied.

State bound: bounds are whole milliseconds, so a block of B ms holds at most B / 2 disjoint
intervals, whatever the number of rows (300,000 for the default of ten minutes).

Defined results: rows with a null, NaN or infinite bound, or that do not end after they start
(after rounding), are left out; equal rows, nested and touching intervals merge; a null key is an
entity of its own; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.session import written

BLOCK_MS = 600_000
SALTS = 4
BUFFER = 200_000


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds; null for what is no finite number of a sane size."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(1e14))
    return F.when(ok, F.round(seconds * 1000).cast("long"))


def merge_sorted_groups(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of each group: (group code, start, end), in order of code and start.

    The running maximum of the ends within a group is taken over ranks, offset by group, which
    cannot overflow whatever the size of the bounds.
    """
    if not len(code):
        return code, start, end
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    values, rank = np.unique(end, return_inverse=True)
    fresh = np.r_[True, code[1:] != code[:-1]]
    group = np.cumsum(fresh) - 1
    n = len(values) + 1
    reach = values[np.maximum.accumulate(group * n + rank) - group * n]
    opens = fresh.copy()
    opens[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(code)] - 1
    return code[first], start[first], reach[last]


def merge_lists(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of disjoint intervals in order of time as one: every interval goes straight to its
    place in the common order, and what touches the reach of those before is joined to them."""
    n = len(a[0]) + len(b[0])
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    for (s, e), (other, _), side in ((a, b, "left"), (b, a, "right")):
        place = np.arange(len(s)) + np.searchsorted(other, s, side)
        start[place], end[place] = s, e
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:], n] - 1]


def merge_all(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists merged two by two."""
    while len(lists) > 1:
        lists = [merge_lists(*lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    return lists[0]


def _leaves(keys: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """One row per distinct key with the list of its intervals."""
    code = keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy()
    c, s, e = merge_sorted_groups(code, start, end)
    heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    out = keys.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
    cuts = np.r_[heads, len(c)]
    out["starts"] = [s[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    out["ends"] = [e[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _partial(keys: list[str]):
    """Merge rows of one task, a bounded buffer at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= BUFFER:
                yield flush(held)
                held = []
        if sum(map(len, held)):
            yield flush(held)

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        return _leaves(pdf[keys], pdf["s__"].to_numpy(), pdf["e__"].to_numpy())

    return run


def _level(keys: list[str]):
    """Merge lists whose keys stand next to each other in a sorted partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            lists = list(zip(pdf["starts"], pdf["ends"]))
            merged = [merge_all(lists[i:j]) for i, j in zip(heads, np.r_[heads[1:], len(code)])]
            out = pdf.iloc[heads].assign(starts=[m[0] for m in merged], ends=[m[1] for m in merged])
            held, out = out.iloc[-1:], out.iloc[:-1]
            if len(out):
                yield out
        if held is not None:
            yield held

    return run


def interval_blocks(df: DataFrame, keys: Sequence[str], start_ms: Column, end_ms: Column, block_ms: int = BLOCK_MS, salts: int = SALTS) -> DataFrame:
    """(keys, block__, starts, ends): the merged list of every entity and time block."""
    keys = list(keys)
    rows = df.select(*keys, start_ms.alias("s__"), end_ms.alias("e__")).where("s__ is not null and e__ > s__")
    rows = rows.withColumn("block__", F.floor(F.col("s__") / block_ms))
    fields = [f for f in rows.schema.fields if f.name in keys] + [T.StructField("block__", T.LongType())]
    lists = [T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("starts", "ends")]
    schema, by = T.StructType(fields + lists), [*keys, "block__"]
    part = rows.mapInPandas(_partial(by), schema).withColumn("salt__", F.spark_partition_id() % salts)
    salted = [*by, "salt__"]
    part = part.repartition(*salted).sortWithinPartitions(*salted).drop("salt__").mapInPandas(_level(by), schema)
    return part.repartition(*by).sortWithinPartitions(*by).mapInPandas(_level(by), schema)


def _with_heads(blocks: DataFrame, keys: Sequence[str], summary: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """Adds columns of a window over one short row (`summary`) for each block."""
    by = [*keys, "block__"]
    heads = blocks.select(*by, *[c.alias(n) for n, c in summary.items()])
    heads = heads.select(*[F.col(c).alias(f"{c}_h") for c in by], *[c.alias(n) for n, c in over.items()])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_h")) for c in by]
    return blocks.join(heads.hint("merge"), same).drop(*[f"{c}_h" for c in by])


def _stitched(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the reach of earlier blocks, the entity's last end and the gaps that end in each block."""
    entity = Window.partitionBy(*keys)
    before = entity.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _with_heads(written(blocks), keys, {"top__": F.element_at("ends", -1)}, {"reach__": F.max("top__").over(before), "last__": F.max("top__").over(entity)})
    gap = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.when(i == 0, F.col("reach__")).otherwise(F.greatest(F.col("reach__"), F.get("ends", i - 1))).alias("gap_start_ms"),
            s.alias("gap_end_ms"),
        ),
    )
    return blocks.withColumn("gaps__", F.filter(gap, lambda g: g.gap_start_ms.isNotNull() & (g.gap_end_ms > g.gap_start_ms)))


def interval_gaps(df: DataFrame, keys: Sequence[str], start_ms: Column, end_ms: Column, min_ms: int = 1, below_ms: int | None = None, **tree: int) -> DataFrame:
    """(keys, gap_start_ms, gap_end_ms): what no interval covers, between two that are covered."""
    blocks = _stitched(interval_blocks(df, keys, start_ms, end_ms, **tree), keys)
    out = blocks.select(*keys, F.inline("gaps__"))
    length = F.col("gap_end_ms") - F.col("gap_start_ms")
    return out.where((length >= min_ms) & (length < below_ms if below_ms else F.lit(True)))


def interval_periods(df: DataFrame, keys: Sequence[str], start_ms: Column, end_ms: Column, **tree: int) -> DataFrame:
    """(keys, period_start_ms, period_end_ms): the continuous periods.

    A period starts at an entity's first start and after each gap; it ends where the next gap
    starts, which may be in a later block, or at the entity's last end.
    """
    blocks = _stitched(interval_blocks(df, keys, start_ms, end_ms, **tree), keys)
    later = Window.partitionBy(*keys).orderBy("block__").rowsBetween(1, Window.unboundedFollowing)
    blocks = _with_heads(blocks, keys, {"gap__": F.get("gaps__", F.lit(0)).gap_start_ms}, {"next__": F.first("gap__", ignorenulls=True).over(later)})
    firsts = F.when(F.col("reach__").isNull(), F.slice("starts", 1, 1)).otherwise(F.slice("starts", 1, 0))
    opens = F.concat(firsts, F.transform("gaps__", lambda g: g.gap_end_ms))
    blocks = blocks.withColumn("opens__", opens).withColumn("skip__", F.size("opens__") - F.size("gaps__"))
    end = lambda i: F.coalesce(F.get("gaps__", i + 1 - F.col("skip__")).gap_start_ms, F.col("next__"), F.col("last__"))
    period = F.transform("opens__", lambda s, i: F.struct(s.alias("period_start_ms"), end(i).alias("period_end_ms")))
    return blocks.select(*keys, F.inline(period))
