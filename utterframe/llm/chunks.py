"""Cutting oversized items into pieces at natural boundaries.

Content-defined chunking: a rolling hash over the last few boundaries (their distances and
lengths, not their positions) ranks the natural boundaries. A boundary whose hash is the greatest
within the least stride on both sides is a landmark, and every landmark is a cut. Stretches between
landmarks that are longer than the largest stride are cut evenly, each time at the natural boundary
nearest to an even share that the largest stride reaches; only where there is none, a forced cut is
made at the largest stride. Landmarks depend on content within the least stride alone and a stretch
on itself alone, so an edit moves the cuts of the stretches that it touches and no others.

A piece starts `overlap` before the end of the one before, so the stride between cuts is at most
limit - overlap, and no piece is longer than the limit.

Defined results: an item with a null bound, or that does not end after it starts, gives no piece;
one within the limit gives one piece; boundaries that are null, empty or outside are ignored;
several at one place count once; an overlap of the limit or more is taken as none; of several rows
with one id the latest holds, ties by all columns; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.session import table

#: Boundaries that the rolling hash covers.
WINDOW = 2
#: The least stride between landmarks as a share of the largest.
LEAST = 0.5
DEFAULT_PROFILE = "default"
SCHEMA = "piece_no int, piece_start_ms bigint, piece_end_ms bigint, cut_kind string"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def boundary_hashes(position: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A rolling hash over `window` distances and lengths at each boundary."""
    with np.errstate(over="ignore"):
        step = np.diff(position, prepend=position[:1]).astype(np.uint64) * _PRIMES[0] + length.astype(np.uint64) * _PRIMES[1]
        step ^= step >> np.uint64(29)
        h = np.zeros(len(step), np.uint64)
        for i in range(window):
            h += np.r_[np.zeros(min(i, len(step)), np.uint64), step[: len(step) - i]] * _PRIMES[2] ** np.uint64(i + 1)
        h *= _PRIMES[0]
        return h ^ h >> np.uint64(32)


def _range_max(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of values[lo:hi] for each pair; 0 where there is none."""
    levels, w = [values], 1
    while 2 * w <= len(values):
        levels.append(np.maximum(levels[-1][:-w], levels[-1][w:]))
        w *= 2
    size = hi - lo
    out = np.zeros(len(lo), values.dtype)
    level = np.minimum(np.frexp(np.maximum(size, 1))[1] - 1, len(levels) - 1)
    for k, top in enumerate(levels):
        at = np.flatnonzero((level == k) & (size > 0))
        if len(at):
            out[at] = np.maximum(top[lo[at]], top[hi[at] - (1 << k)])
    return out


def landmarks(start: int, end: int, position: np.ndarray, length: np.ndarray, least: float) -> np.ndarray:
    """The boundaries whose hash is the greatest within `least` on both sides (the first of equal
    ones), and that are no nearer than that to the item's ends."""
    h = boundary_hashes(position, length)
    place = np.arange(len(position))
    before = _range_max(h, np.searchsorted(position, position - least, "right"), place)
    after = _range_max(h, place + 1, np.searchsorted(position, position + least, "left"))
    return position[(before < h) & (after <= h) & (position - start >= least) & (end - position >= least)]


def cut(start: int, end: int, position: np.ndarray, length: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[bool]]:
    """Cuts strictly within an item, and whether each is forced. All in one integer unit."""
    stride = limit - overlap if 0 <= overlap < limit else limit
    if end - start <= limit:
        return [], []
    inner = (position > start) & (position < end)
    position, length = position[inner], length[inner]
    position, first = np.unique(position, return_index=True)
    length = length[first]
    cuts, forced, at = [], [], start
    for mark in [*landmarks(start, end, position, length, LEAST * stride).tolist(), end]:
        while mark - at > stride:
            aim = at + (mark - at) / -(-(mark - at) // stride)
            reach = position[np.searchsorted(position, at, "right") : np.searchsorted(position, at + stride, "right")]
            forced.append(not len(reach))
            at = int(reach[np.abs(reach - aim).argmin()]) if len(reach) else at + stride
            cuts.append(at)
        if mark < end:
            at = mark
            cuts.append(at)
            forced.append(False)
    return cuts, forced


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, start, end, limit, overlap, position, length in pdf.itertuples(index=False):
            order = np.argsort(position, kind="stable")
            # Halves of a millisecond, as the middle of a pause may lie between two.
            cuts, forced = cut(2 * start, 2 * end, np.asarray(position)[order], np.asarray(length)[order], 2 * limit, 2 * overlap)
            back = overlap if 0 <= overlap < limit else 0
            for i, (a, b, kind) in enumerate(zip([start, *(c // 2 - back for c in cuts)], [*(c // 2 for c in cuts), end], [*forced, None])):
                out.append((key, i, a, b, "end" if kind is None else "forced" if kind else "pause"))
        yield pd.DataFrame(out, columns=["item_id", "piece_no", "piece_start_ms", "piece_end_ms", "cut_kind"])


def split_items(items: DataFrame) -> DataFrame:
    """(item_id, piece_no, piece_start_ms, piece_end_ms, cut_kind) of items with the columns item_id,
    start_ms, end_ms, limit_ms, overlap_ms and boundaries: array<struct<start_ms, end_ms>>.

    cut_kind tells how the piece ends: `pause`, `forced`, or `end` for the last piece.
    """
    ok = items.where("start_ms is not null and end_ms > start_ms and limit_ms > 0")
    inner = F.filter(
        F.coalesce("boundaries", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")),
        lambda p: p.isNotNull() & F.coalesce((p.end_ms > p.start_ms) & (p.start_ms >= F.col("start_ms")) & (p.end_ms <= F.col("end_ms")), F.lit(False)),
    )
    ok = ok.withColumn("inner", inner)
    ok = ok.select("item_id", "start_ms", "end_ms", "limit_ms", F.coalesce("overlap_ms", F.lit(0)).cast("bigint").alias("overlap_ms"), F.transform("inner", lambda p: p.start_ms + p.end_ms).alias("position"), F.transform("inner", lambda p: p.end_ms - p.start_ms).alias("length"))
    kind = dict(items.dtypes)["item_id"]
    return ok.mapInPandas(_pieces, f"item_id {kind}, {SCHEMA}")


def _ms(seconds: Column) -> Column:
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < F.lit(1e14)), F.round(seconds * 1000).cast("long"))


def audio_items(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """The latest version of each chunk with the limits of its profile, for split_items."""
    body = F.struct("ingested_at", "start_sec", "end_sec", "profile", "pauses")
    latest = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(body).alias("c")).select("chunk_id", "c.*")
    limits = config.select(F.col("profile").alias("name"), (F.round(F.col("chunk_seconds") * 1000)).cast("long").alias("limit_ms"), (F.round(F.col("margin_seconds") * 1000)).cast("long").alias("overlap_ms"))
    # The configuration has one row per profile name; it does not grow with the chunks.
    out = latest.withColumn("name", F.coalesce("profile", F.lit(DEFAULT_PROFILE))).join(limits, "name")
    pauses = F.transform("pauses", lambda p: F.struct(_ms(p.start_sec).alias("start_ms"), _ms(p.end_sec).alias("end_ms")))
    return out.select(F.col("chunk_id").alias("item_id"), _ms(F.col("start_sec")).alias("start_ms"), _ms(F.col("end_sec")).alias("end_ms"), "limit_ms", "overlap_ms", pauses.alias("boundaries"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk."""
    return split_items(audio_items(table(spark, sf_dir, "audio_chunks"), table(spark, sf_dir, "aligner_config"))).withColumnRenamed("item_id", "chunk_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks longer than their profile allows: cut in pauses alone, or by force too."""
    pieces = p1_pieces(spark, sf_dir)
    kinds = pieces.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max(F.col("cut_kind") == "forced").alias("forced"))
    return kinds.where("n > 1").select("chunk_id", F.when(F.col("forced"), "forced").otherwise("pause").alias("cut_kind"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

SQL = {
    "p1_found": """
with latest as (
  select distinct on (chunk_id) chunk_id, coalesce(profile, 'default') as profile, pauses,
    cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e
  from audio_chunks order by chunk_id, ingested_at desc nulls last
), long_ones as (
  select l.*, cast(round(chunk_seconds * 1000) as bigint) as lim, cast(round((chunk_seconds - margin_seconds) * 1000) as bigint) as stride
  from latest l join aligner_config c using (profile) where e > s and e - s > cast(round(chunk_seconds * 1000) as bigint)
), pauses as (
  select chunk_id, s, e, cast(round(p.start_sec * 1000) as bigint) as a, cast(round(p.end_sec * 1000) as bigint) as b
  from (select chunk_id, s, e, unnest(pauses) as p from long_ones)
), points as (
  select chunk_id, 2 * s as x from long_ones union select chunk_id, 2 * e from long_ones
  union select chunk_id, a + b from pauses where b > a and a >= s and b <= e
), steps as (
  select chunk_id, x - lag(x) over (partition by chunk_id order by x) as step from points
)
select chunk_id, case when max(step) > 2 * any_value(stride) then 'forced' else 'pause' end as cut_kind
from steps join long_ones using (chunk_id) group by chunk_id
""",
}
