"""Queries over the recordings' interval tables, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.operators.interval_union import interval_gaps, interval_periods, to_ms
from utterframe.session import table

LEAST_GAP_MS = 20
SESSION_END_MS = 600_000


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(F.lit(origin).alias("origin"), "source_id", "start_sec", "end_sec")
        for name, origin in (("word_intervals", "word_interval"), ("aligned_spans", "aligned_span"))
    ]
    return reduce(DataFrame.unionAll, parts)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of at least 20 ms and less than ten minutes in each table and recording."""
    return interval_gaps(_both(spark, sf_dir), ["origin", "source_id"], to_ms(F.col("start_sec")), to_ms(F.col("end_sec")), LEAST_GAP_MS, SESSION_END_MS)


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of each table and recording."""
    return interval_periods(_both(spark, sf_dir), ["origin", "source_id"], to_ms(F.col("start_sec")), to_ms(F.col("end_sec")))


_MS = """
with i as (
  select 'word_interval' as origin, source_id, start_sec, end_sec from word_intervals
  union all select 'aligned_span', source_id, start_sec, end_sec from aligned_spans
), m as (
  select origin, source_id, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e
  from i where start_sec is not null and end_sec is not null and not isnan(start_sec) and not isnan(end_sec)
), r as (
  select *, max(e) over (partition by origin, source_id order by s, e rows between unbounded preceding and 1 preceding) as reach
  from m where e > s
)
"""

QUERIES = {"p6_found": p6_found, "p6_periods": p6_periods}

SQL = {
    "p6_found": _MS + "select origin, source_id, reach as gap_start_ms, s as gap_end_ms from r where s - reach >= 20 and s - reach < 600000",
    "p6_periods": _MS
    + """, g as (
  select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by origin, source_id order by s, e rows unbounded preceding) as k from r
)
select origin, source_id, min(s) as period_start_ms, max(e) as period_end_ms from g group by origin, source_id, k""",
}
