"""Tables as the queries use them: repeated rows once, unusable rows left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.functions.text import ascii_form
from utterframe.operators.interval_union import to_ms
from utterframe.session import table


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned words with whole milliseconds; each interval_id once."""
    df = table(spark, sf_dir, "word_intervals").select(
        "interval_id", "source_id", "chunk_id", "word", to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e"), "confidence", "flagged", "emitted_word", "min_char_confidence"
    )
    return df.where("e > s").distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each chunk, with usable bounds."""
    df = table(spark, sf_dir, "audio_chunks").groupBy("chunk_id").agg(F.max(F.struct("ingested_at", "source_id", "chunk_index", "start_sec", "end_sec", "profile")).alias("c"))
    return df.select("chunk_id", "c.source_id", "c.chunk_index", to_ms(F.col("c.start_sec")).alias("cs"), to_ms(F.col("c.end_sec")).alias("ce"), F.coalesce("c.profile", F.lit("default")).alias("profile")).where("ce > cs")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment records whose three transliterations are known, in plain letters."""
    df = table(spark, sf_dir, "enrichment_records").distinct()
    df = df.select("record_id", F.lower(F.trim("split")).alias("split"), ascii_form(F.col("base_transliteration")).alias("ref"), ascii_form(F.col("emitted_text")).alias("hyp"), ascii_form(F.col("reconciled_text")).alias("rec"), "raw_cer", "reconciled_cer", "delta_cer")
    return df.where("ref is not null and hyp is not null and rec is not null").distinct()


WORDS_SQL = """words as (
  select distinct interval_id, source_id, chunk_id, word, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e, confidence, flagged, emitted_word, min_char_confidence
  from word_intervals where start_sec is not null and end_sec is not null and not isnan(start_sec) and not isnan(end_sec) and round(end_sec * 1000) > round(start_sec * 1000)
)"""

CHUNKS_SQL = """chunks as (
  select chunk_id, source_id, chunk_index, cast(round(start_sec * 1000) as bigint) as cs, cast(round(end_sec * 1000) as bigint) as ce, coalesce(profile, 'default') as profile
  from (select distinct on (chunk_id) * from audio_chunks order by chunk_id, ingested_at desc nulls last)
  where round(end_sec * 1000) > round(start_sec * 1000)
)"""


def ascii_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), '''’ʼʔ‘ʻ`', ''''''''''''''''), '[^a-z'' ]', '', 'g'), '\\s+', ' ', 'g'))"


RECORDS_SQL = f"""records as (
  select * from (select distinct record_id, lower(trim(split)) as split, {ascii_sql('base_transliteration')} as ref, {ascii_sql('emitted_text')} as hyp, {ascii_sql('reconciled_text')} as rec, raw_cer, reconciled_cer, delta_cer from enrichment_records)
  where ref is not null and hyp is not null and rec is not null
)"""
