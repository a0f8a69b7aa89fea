"""Streams, sinks and what is read back from them (STR, SNK, SRC)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.plans.common import CHUNKS_SQL, WORDS_SQL, chunks, words
from utterframe.session import ensure_checkpoint_dir, table
from utterframe.sources.readers import parse_textgrid
from utterframe.sources.writers import manifest, textgrid
from utterframe.streaming.resume import append_missing, session_stream
from utterframe.streaming.speech import speech_segments


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def str01_session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream; those that late events could still extend are not out yet."""
    batch = table(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out, where = _folder(spark, "sessions"), _folder(spark, "sessions-state")
    rows = session_stream(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def str02_speech_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of users' events as frames, active from the value 50 on."""
    e = table(spark, d, "events").where("value is not null")
    return speech_segments(e, "user_id", "event_id", "value", 50.0, start_frames=2, stop_frames=2, least_frames=1)


def str03_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Work on chunks in two runs, the second of which finds the first one's results."""
    todo = chunks(spark, d).select("chunk_id", (F.col("ce") - F.col("cs")).alias("ms"))
    path = _folder(spark, "resumed")
    work = lambda x: x.select("chunk_id", (F.col("ms") * 16).alias("n_samples"))
    append_missing(todo.where("chunk_id < 'chk-00-0000300'"), path, ["chunk_id"], work)
    return append_missing(todo, path, ["chunk_id"], work)


def snk01_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Words of each chunk as one JSON document."""
    w = words(spark, d).where("chunk_id is not null and word is not null")
    return manifest(w, "chunk_id", ["s", "interval_id"], ["word", "s", "e", "emitted_word"])


def _grids(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).where("chunk_id is not null and word is not null").select("chunk_id", F.lit("words").alias("tier"), "s", "e", "word")
    return textgrid(w.distinct(), "chunk_id", "tier", "s", "e", "word")


def snk03_textgrid(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d)


def src12_textgrid_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What the TextGrid text of each chunk gives when it is read again."""
    return _grids(spark, d).select("chunk_id", F.inline(parse_textgrid(F.col("text")))).select("chunk_id", "tier", "idx", F.col("xmin").cast("bigint").alias("s"), F.col("xmax").cast("bigint").alias("e"), F.col("text").alias("word"))


QUERIES = {f.__name__: f for f in (str01_session_stream, str02_speech_segments, str03_resumed, snk01_manifest, snk03_textgrid, src12_textgrid_round_trip)}

SQL = {
    "str03_resumed": f"with {CHUNKS_SQL} select chunk_id, (ce - cs) * 16 as n_samples from chunks",
    "src12_textgrid_round_trip": f"""with {WORDS_SQL}, w as (select distinct chunk_id, s, e, word from words where chunk_id is not null and word is not null)
select chunk_id, 'words' as tier, cast(row_number() over (partition by chunk_id order by s, e, word) as integer) as idx, s, e, word from w""",
}
