"""Counts by recording, categories of differences, padded batches, transcript words, signals, quiet cuts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import padded
from utterframe.operators.signals import augmented, band_pass, denoise, quiet_parts, time_warp
from utterframe.plans.common import RECORDS_SQL, WORDS_SQL, records, words
from utterframe.session import table

# Categories of differences between two texts of a record.
CATEGORIES = ("word_boundary_shift", "vowel_syncope_dropped", "vowel_restored", "aspiration_removed", "aspiration_added", "glottal_stop_removed", "glottal_stop_added", "orthographic_spelling_variation")


def agg26_recording_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per recording: glottal stops and breaths heard, flagged words, and chunks that hold one."""
    w = words(spark, d)
    signs = lambda pattern: F.coalesce(F.sum(F.length("emitted_word") - F.length(F.regexp_replace("emitted_word", pattern, ""))), F.lit(0))
    return w.groupBy("source_id").agg(signs("['ʔ]").alias("n_glottals"), signs("h").alias("n_breaths"), F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"), F.countDistinct(F.when(F.col("flagged"), F.col("chunk_id"))).alias("n_anomalous_chunks"))


def agg27_difference_categories(spark: SparkSession, d: str) -> DataFrame:
    """What kinds of change lie between reference and reconciled text: records of each, and percent."""
    r = records(spark, d).select("record_id", "ref", "rec").distinct()
    old, new = F.split("ref", " "), F.split("rec", " ")
    pairs = F.filter(F.arrays_zip(old.alias("a"), new.alias("b")), lambda p: p.a.isNotNull() & p.b.isNotNull())
    vowels = F.split(F.lit("aeiouv"), "")
    lost = lambda x, y: (F.length(y) < F.length(x)) & F.arrays_overlap(F.array_except(F.split(x, ""), F.split(y, "")), vowels)
    gone = lambda sign: lambda x, y: x.contains(sign) & ~y.contains(sign)
    tests = [lost, lambda x, y: lost(y, x)] + [t for sign in ("h", "'") for t in (gone(sign), (lambda lacks: lambda x, y: lacks(y, x))(gone(sign)))]
    anywhere = lambda test: F.exists("pairs", lambda p: test(p.a, p.b))
    found = [F.size(old) != F.size(new), *map(anywhere, tests)]
    none = ~found[0]
    for f in found[1:]:
        none = none & ~f
    named = F.array(*[F.when(f, c) for c, f in zip(CATEGORIES, [*found, none & (F.col("ref") != F.col("rec"))])])
    r = r.withColumn("pairs", pairs).select("record_id", F.array_compact(named).alias("c"))
    total = r.agg(F.count("*").alias("total"))
    counts = r.select(F.explode("c").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("category", "n", F.round(F.col("n") * 100 / F.col("total") + 1e-9, 4).alias("pct"))


def arr03_padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Letters of each chunk's words as numbers, padded to the chunk's longest word."""
    w = words(spark, d).where("chunk_id is not null and emitted_word <> ''").select("chunk_id", "interval_id", F.transform(F.split("emitted_word", ""), lambda c: F.ascii(c)).alias("ids"))
    w = w.withColumn("longest", F.max(F.size("ids")).over(Window.partitionBy("chunk_id")))
    return w.select("chunk_id", "interval_id", F.array_join(F.transform(padded(F.col("ids"), F.col("longest")), lambda x: x.cast("string")), " ").alias("ids"))


def txt25_transcript_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each line as a forced aligner takes them; words of which nothing is left are dropped."""
    lines = table(spark, d, "codeswitched_lines").select("line_id", "raw_text").distinct()
    w = lines.select("line_id", F.posexplode(F.filter(F.split(F.regexp_replace("raw_text", r"[\s\p{Z}]+", " "), " "), lambda x: x != "")).alias("place", "word"))
    return w.withColumn("clean", F.regexp_replace(F.lower("word"), "[^a-z']", "")).where("clean <> ''")


def _signals(spark: SparkSession, d: str, fn: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Vectors as short signals through `fn`: their new length and level."""

    def run(batches):
        for pdf in batches:
            out = [fn(int(k), np.asarray(x, float)) for k, x in zip(pdf["vec_id"], pdf["embedding"])]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n_samples": [len(y) for y in out], "power": [round(float(np.mean(y * y)), 6) if len(y) else 0.0 for y in out]})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, n_samples bigint, power double")


def sig03_time_warp(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d, lambda k, x: time_warp(x, 0.8, 16))


def sig04_band_pass(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d, lambda k, x: band_pass(x, 16_000))


def sig05_denoised(spark: SparkSession, d: str) -> DataFrame:
    """Spectral subtraction with a signal's quietest quarter as the noise."""

    def quarter(x: np.ndarray) -> np.ndarray:
        n = max(1, len(x) // 4)
        power = np.convolve(x * x, np.ones(n), "valid")
        return x[int(power.argmin()) :][:n]

    return _signals(spark, d, lambda k, x: denoise(x, quarter(x), n=16))


def sig08_augmented(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d, lambda k, x: augmented(x, zlib.crc32(str(k).encode()), 0.5, n=16))


def int06_quiet_parts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as level profiles, cut into parts of at most 20 steps at their quiet places."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, x in zip(pdf["vec_id"], pdf["embedding"]):
                level = 20 * np.log10(np.maximum(np.abs(np.asarray(x, float)), 1e-6))
                rows += [(k, i, a, b) for i, (a, b) in enumerate(quiet_parts(level, 20, 2, least=(4, 3, 2, 1), window=3))]
            yield pd.DataFrame(rows, columns=["vec_id", "part", "first", "end"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, part int, first int, end int")


QUERIES = {f.__name__: f for f in (agg26_recording_counts, agg27_difference_categories, arr03_padded_batches, txt25_transcript_words, sig03_time_warp, sig04_band_pass, sig05_denoised, sig08_augmented, int06_quiet_parts)}

_GONE = "contains({x}, '{s}') and not contains({y}, '{s}')"
_LOST = "length({y}) < length({x}) and len(list_filter(string_split({x}, ''), lambda c: contains('aeiouv', c) and not contains({y}, c))) > 0"
_PAIR = [_LOST.format(x="a", y="b"), _LOST.format(x="b", y="a")] + [_GONE.format(x=x, y=y, s=s) for s in ("h", "''") for x, y in ("ab", "ba")]

SQL = {
    "agg26_recording_counts": f"""with {WORDS_SQL} select source_id, cast(coalesce(sum(length(emitted_word) - length(regexp_replace(emitted_word, '[''ʔ]', '', 'g'))), 0) as bigint) as n_glottals,
  cast(coalesce(sum(length(emitted_word) - length(replace(emitted_word, 'h', ''))), 0) as bigint) as n_breaths, count(*) filter (flagged) as n_flagged, count(distinct chunk_id) filter (flagged) as n_anomalous_chunks from words group by source_id""",
    "agg27_difference_categories": f"""with {RECORDS_SQL}, r as (select distinct record_id, ref, rec, string_split(ref, ' ') as o, string_split(rec, ' ') as n from records),
p as (select record_id, ref, rec, len(o) <> len(n) as moved, o[i] as a, n[i] as b from (select *, unnest(range(1, least(len(o), len(n)) + 1)) as i from r)),
t as (select record_id, ref, rec, [bool_or(moved), {', '.join(f'bool_or({x})' for x in _PAIR)}] as f from p group by all),
c as (select unnest(list_filter([{', '.join(f"case when f[{i + 1}] then '{c}' end" for i, c in enumerate(CATEGORIES[:-1]))}, case when not list_bool_or(f) and ref <> rec then '{CATEGORIES[-1]}' end], lambda x: x is not null)) as category from t)
select category, count(*) as n, round(count(*) * 100 / (select count(*) from r) + 1e-9, 4) as pct from c group by category""",
    "arr03_padded_batches": f"""with {WORDS_SQL}, w as (select chunk_id, interval_id, emitted_word, length(emitted_word) as n, max(length(emitted_word)) over (partition by chunk_id) as longest from words where chunk_id is not null and emitted_word <> '')
select chunk_id, interval_id, array_to_string(list_concat(list_transform(string_split(emitted_word, ''), lambda c: cast(unicode(c) as varchar)), list_transform(range(0, longest - n), lambda i: '-100')), ' ') as ids from w""",
    "txt25_transcript_words": r"""with l as (select line_id, list_filter(string_split(regexp_replace(raw_text, '[\s\x{0b}\p{Z}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from (select distinct line_id, raw_text from codeswitched_lines)),
x as (select line_id, cast(i as integer) as place, w[i + 1] as word from (select *, unnest(range(0, len(w))) as i from l))
select line_id, place, word, regexp_replace(lower(word), '[^a-z'']', '', 'g') as clean from x where regexp_replace(lower(word), '[^a-z'']', '', 'g') <> ''""",
}
