"""Resumable work: results are appended, and what is there already is not done again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from utterframe.operators.joins import not_done


def append_missing(todo: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Does the rows of `todo` whose key the table at `path` lacks, appends them, and returns it all."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        done = None
    rest = todo if done is None else not_done(todo, done, keys)
    work(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], at: str, delay: str):
    """Each key once, appended to a table as the stream goes; late repeats within `delay` are known."""
    once = rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def session_stream(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key whose events are less than a gap apart, once no event can extend them."""
    w = rows.withWatermark(at, delay).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
