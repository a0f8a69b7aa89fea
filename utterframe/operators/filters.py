"""Row filters: reject reasons, acceptance of groups, search, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reject_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reject_reason") -> DataFrame:
    """The first rule that a row breaks, null for a row to keep."""
    reason = F.lit(None).cast("string")
    for label, broken in reversed(rules):
        reason = F.when(broken, label).otherwise(reason)
    return df.withColumn(name, reason)


def accepted_groups(df: DataFrame, keys: Sequence[str], value: Column, above: float) -> DataFrame:
    """Groups in which every value is known and above a threshold."""
    ok = F.coalesce(value > above, F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ok.cast("int")).alias("ok")).where("ok = 1").drop("ok")


def any_contains(columns: Sequence[Column], needle: str) -> Column:
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def is_anomaly(confidence: Column, least: float, char_confidence: Column | None = None, least_char: float = 0.0, aligned: Column | None = None) -> Column:
    """Low confidence, a low least character confidence (if a threshold is set), or not aligned."""
    out = confidence < least
    if char_confidence is not None and least_char > 0:
        out = out | F.coalesce(char_confidence < least_char, F.lit(False))
    return F.coalesce(out, F.lit(True)) if aligned is None else F.coalesce(out | ~aligned, F.lit(True))


def noise_reason(highest_db: Column, rms_ratio: Column, mean_db: Column) -> Column:
    """Why a segment is noise; null for speech."""
    return F.when(highest_db < -42, "quiet").when(rms_ratio < 1.8, "flat").when(mean_db < -55, "low")


def near(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) < tolerance
