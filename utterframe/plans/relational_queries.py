"""Projections, filters, joins and set operations (PRJ, FLT, JON, SET, ARR, HSH, JSN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import cache_key, encoded, first_present, padded
from utterframe.operators.filters import accepted_groups, any_contains, is_anomaly, near, noise_reason, with_reject_reason
from utterframe.operators.joins import first_hit, interpolated, interval_join, lookup, not_done, ordinal_slices, symmetric
from utterframe.operators.sets import first_of, hash_split, interleaved, mapped_split, with_rewritten_copies
from utterframe.plans.metric_queries import BIGRAMS_SQL, syllable_bigrams
from utterframe.plans.common import CHUNKS_SQL, RECORDS_SQL, WORDS_SQL, chunks, records, words
from utterframe.session import table


def prj01_resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's audio path as the first of its candidates that the listing knows, else unchanged."""
    listing = table(spark, d, "enrichment_records").select(F.col("audio_path").alias("path")).distinct()
    s = table(spark, d, "syllabary_samples").where("audio_path is not null").select("sample_id", "audio_path").distinct()
    base = F.regexp_extract("audio_path", r"([^/]+)$", 1)
    enr = F.regexp_replace(base, r"^smp-(\d+)-", "enr-$1-")
    tries = F.array(F.col("audio_path"), F.concat(F.lit("split_audio/"), base), F.concat(F.lit("split_audio/"), enr), base)
    hits = s.select("sample_id", "audio_path", F.posexplode(tries).alias("pos", "path")).join(listing, "path")
    best = hits.groupBy("sample_id", "audio_path").agg(F.min_by("path", "pos").alias("hit"))
    return s.join(best, ["sample_id", "audio_path"], "left").select("sample_id", "audio_path", F.coalesce("hit", "audio_path").alias("resolved"))


def prj02_target_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("target_rel_path")
    out = F.when(p.startswith("audio/"), F.concat(F.lit("data/"), p)).otherwise(F.concat(F.lit("data/other/"), p))
    return table(spark, d, "packaged_audio").select("dataset_name", "target_rel_path", out.alias("target")).distinct()


def prj03_first_present(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "syllabary_samples")
    return s.select("sample_id", first_present(F.col("gt_target"), F.col("input_template"), F.col("syllabary_raw")).alias("text")).distinct()


def prj04_clip_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "packaged_audio").select("dataset_name", "source_path", F.regexp_extract("source_path", r"clip_(\d+)\.wav$", 1).alias("n")).where("n <> ''")
    return s.select("dataset_name", "source_path", F.col("n").cast("bigint").alias("clip_no")).distinct()


def prj05_release_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.nullif(F.regexp_extract("dataset_name", r"-(\d+)$", 1), F.lit("")).cast("int"), F.lit(-1))
    return table(spark, d, "packaging_manifest").select("dataset_name", n.alias("release_no")).distinct()


def flt01_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.col("gt_target"), F.lit(""))
    rules = [("no_text", F.trim(text) == ""), ("no_split", F.col("split").isNull()), ("foreign_letter", F.lower(text).rlike("[fb]")), ("too_long", F.length(text) > 90)]
    out = with_reject_reason(table(spark, d, "syllabary_samples").distinct(), rules)
    return out.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def flt02_without_letters(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("ref <> '' and not ref rlike '[dg]'").select("record_id", "ref").distinct()


def flt03_accepted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of which every word has a known confidence above a threshold."""
    w = words(spark, d).where("chunk_id is not null")
    value = F.when(~F.isnan("confidence"), F.col("confidence"))
    return accepted_groups(w, ["chunk_id"], value, 0.3).withColumnRenamed("n", "n_words")


def flt05_length_limit(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("(ce - cs) * 16 < 320000").select("chunk_id", ((F.col("ce") - F.col("cs")) * 16).alias("n_samples"))


def flt06_complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "syllabary_samples").na.drop(subset=["gt_target", "split"]).groupBy("split").agg(F.countDistinct("sample_id").alias("n"))


def flt07_existing_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "syllabary_samples").where("audio_path is not null").select("sample_id", F.regexp_extract("audio_path", r"(\d+-\d+)\.wav$", 1).alias("key")).where("key <> ''").join(table(spark, d, "enrichment_records").select(F.regexp_extract("audio_path", r"(\d+-\d+)\.wav$", 1).alias("key")), "key", "left_semi").distinct()


def flt08_band_or_condition(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct()
    return df.where("(raw_cer between 0.1 and 0.2) or (split = 'test' and reconciled_cer = 0)").groupBy("split").agg(F.count("*").alias("n"))


def flt09_membership(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where(F.col("profile").isin("training", "dialogue", "default")).groupBy("profile").agg(F.count("*").alias("n"))


def flt10_near_equal(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct()
    return df.where(near(F.col("raw_cer") - F.col("reconciled_cer"), F.col("delta_cer"), 1e-3)).select("record_id").distinct()


def flt11_noise_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Levels from the least character confidence, per chunk; the first rule that fits."""
    db = 20 * F.log10(F.greatest(F.col("min_char_confidence"), F.lit(1e-9)))
    w = words(spark, d).where("chunk_id is not null and min_char_confidence > 0 and not isnan(min_char_confidence)").withColumn("db", F.round(db, 6))
    g = w.groupBy("chunk_id").agg(F.max("db").alias("high"), F.round(F.avg("db"), 4).alias("mean"), (F.max("min_char_confidence") / F.min("min_char_confidence")).alias("ratio"))
    return g.select("chunk_id", noise_reason(F.col("high") - 30, F.col("ratio"), F.col("mean") - 40).alias("reason"))


def flt12_anomalies(spark: SparkSession, d: str) -> DataFrame:
    bad = is_anomaly(F.col("confidence"), 0.5, F.col("min_char_confidence"), 0.2, F.col("emitted_word").isNotNull())
    w = words(spark, d).where("(confidence is null or not isnan(confidence)) and (min_char_confidence is null or not isnan(min_char_confidence))")
    return w.groupBy("source_id").agg(F.count(F.when(bad, 1)).alias("n_anomalies"), F.count("*").alias("n"))


def flt13_any_field_search(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct()
    return df.where(any_contains([F.col("base_transliteration"), F.col("emitted_text"), F.col("record_id")], "tlu")).select("record_id").distinct()


def flt16_min_duration(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where("e - s >= 100 and word is not null and word <> ''").groupBy("source_id").agg(F.count("*").alias("n"))


def jon01_chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Words per chunk and profile; words of unknown chunks keep a default."""
    w = words(spark, d).groupBy("chunk_id").agg(F.count("*").alias("n_words"))
    return lookup(w, chunks(spark, d).select("chunk_id", "profile"), ["chunk_id"], {"profile": "unknown"})


def jon02_profile_limits(spark: SparkSession, d: str) -> DataFrame:
    cfg = table(spark, d, "aligner_config").select("profile", "chunk_seconds")
    return lookup(chunks(spark, d).select("chunk_id", "profile"), F.broadcast(cfg), ["profile"], {"chunk_seconds": 30.0})


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    tiers = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("snr")) for k in ("pink", "white") for s in (25, 15, 5)]))
    return records(spark, d).select("record_id", tiers.alias("t")).select("record_id", "t.kind", "t.snr").distinct()


def jon03_left_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of records that are not done yet; done are those of test records at 25 and 15 dB."""
    todo = _tiers(spark, d)
    done = todo.join(records(spark, d).where("split = 'test'").select("record_id").distinct(), "record_id", "left_semi").where("snr >= 15")
    return not_done(todo, done, ["record_id", "kind", "snr"]).groupBy("kind", "snr").agg(F.count("*").alias("n"))


def jon04_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d).groupBy("kind", "snr").agg(F.countDistinct("record_id").alias("n"))


def jon05_config_grid(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that each profile's limit would split: every profile with every recording's chunks."""
    cfg = table(spark, d, "aligner_config").select(F.col("profile").alias("candidate"), F.round(F.col("chunk_seconds") * 1000).cast("bigint").alias("limit_ms"))
    lengths = chunks(spark, d).groupBy("source_id", (F.col("ce") - F.col("cs")).alias("ms")).agg(F.count("*").alias("k"))
    # Six configurations, a table that does not grow.
    return lengths.join(F.broadcast(cfg)).groupBy("source_id", "candidate").agg(F.coalesce(F.sum(F.when(F.col("ms") > F.col("limit_ms"), F.col("k"))), F.lit(0)).alias("n_split"), F.sum("k").alias("n"))


def jon06_words_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Words that overlap a chunk of their recording, or lie in it by 50 ms, counted per chunk."""
    w = words(spark, d).select("interval_id", "source_id", "s", "e")
    pairs = interval_join(w, chunks(spark, d).select("chunk_id", "source_id", "cs", "ce"), ["source_id"], ("s", "e"), ("cs", "ce"), 30_000, 50)
    return pairs.groupBy("chunk_id").agg(F.count("*").alias("n_words"), F.countDistinct("interval_id").alias("n_distinct"))


def jon07_word_slices(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's range of places in its recording's list of chunk words."""
    n = words(spark, d).where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n_words"))
    c = chunks(spark, d).join(n, "chunk_id").withColumn("key", F.concat_ws("/", F.lpad(F.col("chunk_index").cast("string"), 9, "0"), "chunk_id"))
    return ordinal_slices(c, ["source_id"], "key", "n_words").select("chunk_id", "first_no", "last_no")


def jon08_variable_stride(spark: SparkSession, d: str) -> DataFrame:
    """Words of a template matched to tokens of the target by running counts of their parts."""
    df = records(spark, d).select("record_id", F.posexplode(F.split("ref", " ")).alias("i", "w")).distinct().withColumn("k", F.size(F.split("w", "'")))
    return ordinal_slices(df, ["record_id"], "i", "k").select("record_id", "i", "first_no", "last_no")


def jon10_baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """First and second aligner side by side on spans of one recording that start within 10 ms of each other."""
    a = words(spark, d).select("source_id", "s", "e")
    b = table(spark, d, "aligned_spans").select("source_id", F.round(F.col("start_sec") * 1000).cast("bigint").alias("t"), F.round(F.col("end_sec") * 1000).cast("bigint").alias("u")).where("u > t").distinct()
    x = a.withColumn("b", F.floor(F.col("s") / 10))
    y = b.withColumn("b", F.explode(F.sequence(F.floor((F.col("t") - 10) / 10), F.floor((F.col("t") + 10) / 10))))
    pairs = x.join(y, ["source_id", "b"]).where("abs(s - t) <= 10")
    return pairs.groupBy("source_id").agg(F.count("*").alias("n_pairs"), F.sum(F.abs(F.col("s") - F.col("t"))).alias("start_diff_ms"), F.sum(F.abs(F.col("e") - F.col("u"))).alias("end_diff_ms"))


def jon11_three_level_lookup(spark: SparkSession, d: str) -> DataFrame:
    """English of words: the glossary by syllabary, then by phonetics, then the word itself."""
    g = table(spark, d, "glossary")
    one = g.groupBy(F.col("syllabary").alias("word")).agg(F.min("english").alias("english"))
    two = g.groupBy(F.col("phonetic").alias("word")).agg(F.min("english").alias("english"))
    w = words(spark, d).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return first_hit(w, "word", [(one, "english"), (two, "english")], F.concat(F.lit("?"), F.col("word"))).withColumnRenamed("value", "english")


def jon13_interpolated_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each chunk's words on a grid of one second, between word starts; 0 outside."""
    w = words(spark, d).where("chunk_id is not null and confidence is not null and not isnan(confidence)")
    known = w.groupBy("chunk_id", F.col("s").alias("t")).agg(F.max("confidence").alias("v"))
    grid = chunks(spark, d).select("chunk_id", F.explode(F.sequence(F.col("cs"), F.col("ce"), F.lit(1000))).alias("t"))
    out = interpolated(grid, known, ["chunk_id"], "t", "v")
    return out.select("chunk_id", "t", F.round(F.col("v") + 1e-9, 6).alias("v"))


def jon14_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    """Checksums that stand for several paths of a release, in whatever letter case."""
    a = table(spark, d, "packaged_audio").select("dataset_name", F.lower("sha256").alias("key"), "target_rel_path")
    return a.where("key is not null").groupBy("dataset_name", "key").agg(F.countDistinct("target_rel_path").alias("n")).where("n > 1")


def jon16_symmetric_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = syllable_bigrams(spark, d)
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src"))).select("src", "tgt", "p")
    return symmetric(p, "src", "tgt", "p").select("src", "tgt", F.round("p", 9).alias("p"))


def jon17_metrics_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Intervals per recording in the two tables, null where one has none."""
    a = words(spark, d).groupBy("source_id").agg(F.count("*").alias("n_words"))
    b = table(spark, d, "aligned_spans").distinct().where("score is not null and not isnan(score)").groupBy("source_id").agg(F.count("*").alias("n_spans"))
    return a.join(b, "source_id", "full")


def set01_concatenated(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "syllabary_samples").select(F.col("sample_id").alias("id"), "split")
    return s.unionByName(table(spark, d, "enrichment_records").select(F.col("record_id").alias("id"), "split")).groupBy("split").agg(F.count("*").alias("n"))


def set03_hash_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "syllabary_samples").select("sample_id").distinct()
    return hash_split(s, F.col("sample_id"), "42").groupBy("split").agg(F.count("*").alias("n"))


def set04_mapped_split(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in listed lots go to evaluation, all others to training."""
    splits = table(spark, d, "syllabary_samples").select("source").distinct().where("source is not null").select("source", F.when(F.col("source") == "radio", "test").when(F.col("source") == "archive", "valid").alias("split")).where("split is not null")
    s = table(spark, d, "syllabary_samples").select("sample_id", "source").distinct()
    return mapped_split(s, splits, ["source"]).groupBy("source", "split").agg(F.count("*").alias("n"))


def set05_first_version(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "syllabary_samples").select("added_at", "sample_id", "split", "source")
    return first_of(s, ["sample_id"], ["added_at"]).select("sample_id", "split", "source")


def set06_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Words that both aligners have, and those of one only."""
    a = words(spark, d).select("word").where("word is not null").distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "aligned_spans").select("word").where("word is not null").distinct().withColumn("b", F.lit(1))
    return a.join(b, "word", "full").select("word", F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both").alias("side"))


def set07_rewritten_copies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "syllabary_samples").select("sample_id", "source").distinct()
    return with_rewritten_copies(s, F.col("source") == "field", {"source": F.lit("field-noisy")}).groupBy("source").agg(F.count("*").alias("n"))


def set02_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Samples and records half and half; order by `place`."""
    a = table(spark, d, "syllabary_samples").select(F.col("sample_id").alias("id")).distinct()
    b = table(spark, d, "enrichment_records").select(F.col("record_id").alias("id")).distinct()
    return interleaved(a, b, "id")


def set11_equal_strings(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("split", (F.col("hyp") == F.col("rec")).alias("same")).agg(F.count("*").alias("n"))


def arr01_encoded_text(spark: SparkSession, d: str) -> DataFrame:
    """Letters as numbers, padded on the right to the longest text of the split."""
    vocabulary = {c: i for i, c in enumerate(" 'adeghiklmnoqstuvwy")}
    df = records(spark, d).select("record_id", "ref").distinct()
    ids = encoded(F.col("ref"), vocabulary, 20)
    return df.select("record_id", F.array_join(padded(ids, F.lit(90)), " ").alias("ids"))


def arr02_sorted_characters(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", F.array_join(F.array_distinct(F.array_sort(F.split("ref", ""))), "").alias("letters")).distinct()


def jsn01_token_json(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each line through JSON and back."""
    schema = "array<struct<raw_token:string,token_type:string>>"
    df = table(spark, d, "codeswitched_lines").where("size(tokens) > 0").distinct()
    df = df.withColumn("back", F.from_json(F.to_json("tokens"), schema))
    return df.groupBy("line_id").agg(F.max(F.size("back")).alias("n_tokens"), F.max(F.size(F.filter("back", lambda t: t.token_type.isNull()))).alias("n_untyped"))


def jsn02_event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the events' schemaless properties."""
    df = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return df.groupBy("event_type", "key").agg(F.count("*").alias("n"))


def hsh01_text_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def hsh02_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    stem = F.regexp_extract("target_rel_path", r"([^/]+)\.wav$", 1)
    df = table(spark, d, "packaged_audio").select("dataset_name", "target_rel_path", "size_bytes").distinct()
    return df.select("dataset_name", "target_rel_path", cache_key(stem, F.col("dataset_name"), F.col("target_rel_path"), F.col("size_bytes").cast("string")).alias("cache_key"))


def dat01_timestamps(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("created_at")
    return table(spark, d, "packaging_manifest").select("dataset_name", F.date_format(t, "yyyyMMdd").alias("day"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso")).distinct()


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("prj", "flt", "jon", "set", "arr", "jsn", "hsh", "dat") and callable(f) and n[3:5].isdigit()}

_W, _R, _C = f"with {WORDS_SQL}", f"with {RECORDS_SQL}", f"with {CHUNKS_SQL}"
_TIERS = _R + """, todo as (select distinct record_id, kind, snr from records, (select unnest(['pink', 'white']) as kind), (select unnest([25, 15, 5]) as snr))"""

SQL = {
    "prj01_resolved_paths": """with l as (select distinct audio_path as path from enrichment_records), s as (select distinct sample_id, audio_path from syllabary_samples where audio_path is not null), b as (
  select *, regexp_extract(audio_path, '([^/]+)$', 1) as base from s
), t as (select sample_id, audio_path, unnest([0, 1, 2, 3]) as pos, unnest([audio_path, 'split_audio/' || base, 'split_audio/' || regexp_replace(base, '^smp-(\\d+)-', 'enr-\\1-'), base]) as path from b
), h as (select sample_id, audio_path, arg_min(path, pos) as hit from t join l using (path) group by all)
select sample_id, audio_path, coalesce(hit, audio_path) as resolved from s left join h using (sample_id, audio_path)""",
    "prj02_target_paths": "select distinct dataset_name, target_rel_path, case when target_rel_path like 'audio/%' then 'data/' || target_rel_path else 'data/other/' || target_rel_path end as target from packaged_audio",
    "prj03_first_present": "select distinct sample_id, coalesce(nullif(gt_target, ''), nullif(input_template, ''), nullif(syllabary_raw, '')) as text from syllabary_samples",
    "prj04_clip_numbers": "select distinct dataset_name, source_path, cast(regexp_extract(source_path, 'clip_(\\d+)\\.wav$', 1) as bigint) as clip_no from packaged_audio where regexp_extract(source_path, 'clip_(\\d+)\\.wav$', 1) <> ''",
    "prj05_release_numbers": "select distinct dataset_name, coalesce(cast(nullif(regexp_extract(dataset_name, '-(\\d+)$', 1), '') as integer), -1) as release_no from packaging_manifest",
    "flt01_reject_reasons": """select case when trim(coalesce(gt_target, '')) = '' then 'no_text' when split is null then 'no_split' when regexp_matches(lower(gt_target), '[fb]') then 'foreign_letter' when length(gt_target) > 90 then 'too_long' else 'kept' end as reason, count(*) as n
from (select distinct * from syllabary_samples) group by all""",
    "flt02_without_letters": _R + " select distinct record_id, ref from records where ref <> '' and not regexp_matches(ref, '[dg]')",
    "flt03_accepted_chunks": _W + " select chunk_id, count(*) as n_words from words where chunk_id is not null group by chunk_id having min(case when not isnan(confidence) and confidence > 0.3 then 1 else 0 end) = 1",
    "flt05_length_limit": _C + " select chunk_id, (ce - cs) * 16 as n_samples from chunks where (ce - cs) * 16 < 320000",
    "flt06_complete_rows": "select split, count(distinct sample_id) as n from syllabary_samples where gt_target is not null and split is not null group by split",
    "flt07_existing_files": "select distinct regexp_extract(audio_path, '(\\d+-\\d+)\\.wav$', 1) as key, sample_id from syllabary_samples where regexp_extract(audio_path, '(\\d+-\\d+)\\.wav$', 1) <> '' and regexp_extract(audio_path, '(\\d+-\\d+)\\.wav$', 1) in (select regexp_extract(audio_path, '(\\d+-\\d+)\\.wav$', 1) from enrichment_records where audio_path is not null)",
    "flt08_band_or_condition": "select split, count(*) as n from (select distinct * from enrichment_records) where raw_cer between 0.1 and 0.2 or (split = 'test' and reconciled_cer = 0) group by split",
    "flt09_membership": _C + " select profile, count(*) as n from chunks where profile in ('training', 'dialogue', 'default') group by profile",
    "flt10_near_equal": "select distinct record_id from (select distinct * from enrichment_records) where abs((raw_cer - reconciled_cer) - delta_cer) < 1e-3",
    "flt11_noise_reasons": _W + """, w as (select chunk_id, min_char_confidence as m, round(20 * log10(greatest(min_char_confidence, 1e-9)), 6) as db from words where chunk_id is not null and min_char_confidence > 0 and not isnan(min_char_confidence)),
g as (select chunk_id, max(db) - 30 as high, round(avg(db), 4) - 40 as mean, max(m) / min(m) as ratio from w group by chunk_id)
select chunk_id, case when high < -42 then 'quiet' when ratio < 1.8 then 'flat' when mean < -55 then 'low' end as reason from g""",
    "flt12_anomalies": _W + """ select source_id, count(*) filter (coalesce(confidence < 0.5 or coalesce(min_char_confidence < 0.2, false) or emitted_word is null, true)) as n_anomalies, count(*) as n
from words where (confidence is null or not isnan(confidence)) and (min_char_confidence is null or not isnan(min_char_confidence)) group by source_id""",
    "flt13_any_field_search": "select distinct record_id from enrichment_records where contains(lower(coalesce(base_transliteration, '')), 'tlu') or contains(lower(coalesce(emitted_text, '')), 'tlu') or contains(lower(record_id), 'tlu')",
    "flt16_min_duration": _W + " select source_id, count(*) as n from words where e - s >= 100 and word is not null and word <> '' group by source_id",
    "jon01_chunk_metadata": f"with {WORDS_SQL}, {CHUNKS_SQL} select chunk_id, n_words, coalesce(profile, 'unknown') as profile from (select chunk_id, count(*) as n_words from words group by chunk_id) left join chunks using (chunk_id)",
    "jon02_profile_limits": _C + " select profile, chunk_id, coalesce(chunk_seconds, 30.0) as chunk_seconds from chunks left join aligner_config using (profile)",
    "jon03_left_to_do": _TIERS + " select kind, snr, count(*) as n from todo where not (snr >= 15 and record_id in (select record_id from records where split = 'test')) group by all",
    "jon04_tiers": _TIERS + " select kind, snr, count(distinct record_id) as n from todo group by all",
    "jon05_config_grid": _C + " select source_id, c.profile as candidate, count(*) filter (ce - cs > round(chunk_seconds * 1000)) as n_split, count(*) as n from chunks cross join aligner_config c group by source_id, c.profile",
    "jon06_words_in_chunks": f"with {WORDS_SQL}, {CHUNKS_SQL} select c.chunk_id, count(*) as n_words, count(distinct interval_id) as n_distinct from words w join chunks c on w.source_id = c.source_id and ((s >= cs - 50 and e <= ce + 50) or (s < ce and e > cs)) group by c.chunk_id",
    "jon07_word_slices": f"""with {WORDS_SQL}, {CHUNKS_SQL}, n as (select chunk_id, count(*) as n_words from words where chunk_id is not null group by chunk_id)
select chunk_id, cast(coalesce(sum(n_words) over w, 0) + 1 as bigint) as first_no, cast(coalesce(sum(n_words) over w, 0) + n_words as bigint) as last_no from chunks join n using (chunk_id) window w as (partition by source_id order by chunk_index, chunk_id rows between unbounded preceding and 1 preceding)""",
    "jon08_variable_stride": _R + """, w as (select distinct record_id, unnest(range(0, len(string_split(ref, ' ')))) as i, unnest(string_split(ref, ' ')) as w from records), k as (select *, len(string_split(w, '''')) as k from w)
select record_id, i, cast(coalesce(sum(k) over w, 0) + 1 as bigint) as first_no, cast(coalesce(sum(k) over w, 0) + k as bigint) as last_no from k window w as (partition by record_id order by i rows between unbounded preceding and 1 preceding)""",
    "jon10_baseline_comparison": _W + """, a as (select source_id, s, e from words), b as (select distinct source_id, cast(round(start_sec * 1000) as bigint) as t, cast(round(end_sec * 1000) as bigint) as u from aligned_spans where round(end_sec * 1000) > round(start_sec * 1000))
select source_id, count(*) as n_pairs, cast(sum(abs(s - t)) as bigint) as start_diff_ms, cast(sum(abs(e - u)) as bigint) as end_diff_ms from a join b using (source_id) where abs(s - t) <= 10 group by source_id""",
    "jon11_three_level_lookup": _W + """, w as (select word, count(*) as n from words where word is not null group by word)
select word, n, coalesce((select min(english) from glossary g where g.syllabary = w.word), (select min(english) from glossary g where g.phonetic = w.word), '?' || word) as english from w""",
    "jon13_interpolated_confidence": f"""with {WORDS_SQL}, {CHUNKS_SQL}, k as (select chunk_id, s as t, max(confidence) as v from words where chunk_id is not null and confidence is not null and not isnan(confidence) group by all),
g as (select chunk_id, unnest(range(cs, ce + 1, 1000)) as t from chunks),
b as (select g.chunk_id, g.t, k.t as t0, k.v as v0 from g asof left join k on g.chunk_id = k.chunk_id and g.t >= k.t), a as (select b.*, k.t as t1, k.v as v1 from b asof left join k on b.chunk_id = k.chunk_id and b.t <= k.t)
select chunk_id, t, round(case when t0 is null or t1 is null then 0.0 when t1 = t0 then v0 else v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) end + 1e-9, 6) as v from a""",
    "jon14_case_insensitive": "select dataset_name, lower(sha256) as key, count(distinct target_rel_path) as n from packaged_audio where sha256 is not null group by 1, 2 having count(distinct target_rel_path) > 1",
    "jon17_metrics_side_by_side": _W + ", a as (select source_id, count(*) as n_words from words group by source_id), b as (select source_id, count(*) as n_spans from (select distinct * from aligned_spans) where score is not null and not isnan(score) group by source_id) select source_id, n_words, n_spans from a full join b using (source_id)",
    "set01_concatenated": "select split, count(*) as n from (select split from syllabary_samples union all select split from enrichment_records) group by split",
    "set03_hash_split": "with u as (select cast(('0x' || substring(md5(sample_id || '42'), 1, 8)) as bigint) / 4294967296.0 as u from (select distinct sample_id from syllabary_samples)) select case when u < 0.8 then 'train' when u < 0.9 then 'valid' else 'test' end as split, count(*) as n from u group by 1",
    "set04_mapped_split": "select source, case source when 'radio' then 'test' when 'archive' then 'valid' else 'train' end as split, count(*) as n from (select distinct sample_id, source from syllabary_samples) group by all",
    "set05_first_version": "select sample_id, split, source from (select distinct on (sample_id) sample_id, split, source from syllabary_samples order by sample_id, added_at nulls first, split nulls first, source nulls first)",
    "set06_key_sets": _W + ", a as (select distinct word from words where word is not null), b as (select distinct word from aligned_spans where word is not null) select coalesce(a.word, b.word) as word, case when a.word is null then 'second' when b.word is null then 'first' else 'both' end as side from a full join b on a.word = b.word",
    "set07_rewritten_copies": "with s as (select distinct sample_id, source from syllabary_samples) select source, count(*) as n from (select source from s union all select 'field-noisy' from s where source = 'field') group by source",
    "set11_equal_strings": _R + " select split, hyp = rec as same, count(*) as n from records group by all",
    "arr02_sorted_characters": _R + " select distinct record_id, array_to_string(list_sort(list_distinct(string_split(ref, ''))), '') as letters from records",
    "jsn01_token_json": "select line_id, max(len(tokens)) as n_tokens, max(len(list_filter(tokens, lambda t: t.token_type is null))) as n_untyped from codeswitched_lines where len(tokens) > 0 group by line_id",
    "jsn02_event_properties": "select event_type, key, count(*) as n from (select event_type, unnest(json_keys(props)) as key from events) group by all",
    "hsh01_text_digest": "select doc_id, sha256(text) as sha256 from documents",
    "hsh02_cache_keys": "select distinct dataset_name, target_rel_path, regexp_extract(target_rel_path, '([^/]+)\\.wav$', 1) || '_' || substring(sha256(concat_ws('|', dataset_name, target_rel_path, cast(size_bytes as varchar))), 1, 16) as cache_key from packaged_audio",
    "dat01_timestamps": "select distinct dataset_name, strftime(created_at, '%Y%m%d') as day, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as iso from packaging_manifest",
}
SQL["jon16_symmetric_matrix"] = BIGRAMS_SQL + """, p as (select src, tgt, n / sum(n) over (partition by src) as p from bigrams)
select coalesce(a.src, b.tgt) as src, coalesce(a.tgt, b.src) as tgt, round((coalesce(a.p, 0) + coalesce(b.p, 0)) / 2, 9) as p from p a full join p b on a.src = b.tgt and a.tgt = b.src"""
