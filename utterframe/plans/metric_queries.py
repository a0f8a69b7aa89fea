"""Error rates, rollups, rankings and statistics (AGG, SRT, MTH)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import log_add, negative_log, noise_gain, relative_improvement
from utterframe.operators.aggregates import conditional_probabilities, corpus_rate, distribution_summary, improvement_summary, log_costs, rollup_rate, row_rate
from utterframe.operators.interval_union import interval_periods
from utterframe.operators.ranking import best_of_each, first_per, length_batches, tiered_best
from utterframe.plans.common import CHUNKS_SQL, RECORDS_SQL, WORDS_SQL, chunks, records, words
from utterframe.session import table


def agg01_corpus_cer(spark: SparkSession, d: str) -> DataFrame:
    return corpus_rate(records(spark, d), ["split"], "ref", "hyp")


def agg02_macro_cer(spark: SparkSession, d: str) -> DataFrame:
    df = records(spark, d).withColumn("cer", row_rate(F.col("ref"), F.col("hyp")))
    return df.groupBy("split").agg(F.round(F.avg("cer"), 6).alias("mean_cer"), F.count("*").alias("n"))


def agg03_median_cer(spark: SparkSession, d: str) -> DataFrame:
    df = records(spark, d).withColumn("cer", row_rate(F.col("ref"), F.col("hyp")))
    micro = F.sum(F.levenshtein("ref", "hyp")) / F.sum(F.length("ref"))
    return df.groupBy("split").agg(F.round(micro, 6).alias("cer"), F.round(F.median("cer"), 6).alias("median_cer"))


def agg05_enrichment_summary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct().where("raw_cer is not null and reconciled_cer is not null and not isnan(raw_cer) and not isnan(reconciled_cer)")
    return improvement_summary(df.withColumn("split", F.lower(F.trim("split"))), "split", "raw_cer", "reconciled_cer")


def agg06_split_rollup(spark: SparkSession, d: str) -> DataFrame:
    raw, new = F.levenshtein("ref", "hyp"), F.levenshtein("ref", "rec")
    return rollup_rate(records(spark, d), "split", {"n": F.count("*"), "n_better": F.count(F.when(new < raw, 1)), "n_worse": F.count(F.when(new > raw, 1)), "n_equal": F.count(F.when(new == raw, 1)), "n_exact": F.count(F.when(new == 0, 1))})


def agg07_outcome_categories(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each arm by split, and over all splits."""
    arms = F.explode(F.array(F.struct(F.lit("raw").alias("arm"), F.col("hyp").alias("x")), F.struct(F.lit("reconciled").alias("arm"), F.col("rec").alias("x"))))
    df = records(spark, d).select(F.coalesce("split", F.lit("none")).alias("split"), "ref", arms.alias("a")).select("split", "a.arm", F.when(F.col("a.x") == F.col("ref"), "exact").when(F.length("a.x") < F.length("ref"), "shorter").when(F.length("a.x") > F.length("ref"), "longer").otherwise("changed").alias("category"))
    out = df.groupingSets([["arm", "split", "category"], ["arm", "category"]], "arm", "split", "category").agg(F.count("*").alias("n"))
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


def agg13_alignment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Share of words with an emission, mean confidence of those, and characters in all."""
    m = F.col("emitted_word").isNotNull()
    return words(spark, d).groupBy("source_id").agg(
        F.count("*").alias("n_words"), F.count(F.when(m, 1)).alias("n_matched"), F.round(F.count(F.when(m, 1)) / F.count("*"), 6).alias("matched_share"),
        F.round(F.avg(F.when(m, F.round(F.col("confidence") * 10000).cast("bigint"))) / 10000, 6).alias("mean_confidence"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n_chars"),
    )


def agg14_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Segment statistics per recording, and the share of its span that is covered."""
    w = words(spark, d)
    stats = w.groupBy("source_id").agg(F.count("*").alias("n"), F.min(F.col("e") - F.col("s")).alias("shortest_ms"), F.max(F.col("e") - F.col("s")).alias("longest_ms"), F.round(F.median(F.col("e") - F.col("s")), 1).alias("median_ms"), (F.max("e") - F.min("s")).alias("span_ms"))
    periods = interval_periods(w, ["source_id"], F.col("s"), F.col("e"))
    union = periods.groupBy("source_id").agg(F.sum(F.col("period_end_ms") - F.col("period_start_ms")).alias("covered_ms"))
    return stats.join(union, "source_id").withColumn("covered_pct", F.round(F.col("covered_ms") * 100 / F.col("span_ms"), 4))


def agg15_word_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per word: uses, whether every one is unflagged, mean length, first place."""
    return words(spark, d).where("word is not null").groupBy("word").agg(
        F.count("*").alias("n"), F.min(F.coalesce(~F.col("flagged"), F.lit(False)).cast("int")).alias("all_valid"), F.round(F.sum(F.col("e") - F.col("s")) / F.count("*"), 3).alias("mean_ms"), F.min_by("source_id", F.struct("source_id", "s")).alias("first_source"), F.min(F.struct("source_id", "s")).s.alias("first_ms")
    )


def agg16_syllable_coverage(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct().select(F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("split"), F.explode(F.split(F.regexp_replace("syllabary_text", r"[^\x{13A0}-\x{13F5}]", ""), "")).alias("syllable")).where("syllable <> ''")
    return distribution_summary(df.groupBy("split", "syllable").agg(F.count("*").alias("n")), ["split"], "syllable", "n")


def agg17_confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Least, median and greatest confidence, and the worst word, of each chunk."""
    w = words(spark, d).where("chunk_id is not null and confidence is not null and not isnan(confidence)")
    return w.groupBy("chunk_id").agg(F.min("confidence").alias("least"), F.round(F.median("confidence"), 6).alias("median"), F.max("confidence").alias("greatest"), F.count("*").alias("n"), F.min_by("interval_id", F.struct("confidence", "interval_id")).alias("worst_interval"))


def agg18_duration_stats(spark: SparkSession, d: str) -> DataFrame:
    ms = F.round(F.col("duration_sec") * 1000).cast("bigint")
    df = table(spark, d, "packaged_audio").distinct().where("duration_sec > 0 and not isnan(duration_sec)").withColumn("ms", ms)
    return df.groupBy("dataset_name").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"), F.round(F.sum("ms") / F.count("*"), 3).alias("mean_ms"))


def agg19_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "syllabary_samples").select(F.explode(F.split("syllabary_raw", "")).alias("letter")).where("letter <> ''")
    return df.groupBy("letter").agg(F.count("*").alias("n"))


def agg20_group_lists(spark: SparkSession, d: str) -> DataFrame:
    """Words of each chunk in order of time, as one text."""
    w = words(spark, d).where("chunk_id is not null and word is not null")
    return w.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "interval_id", "word"))), lambda x: x.word), " ").alias("text"), F.count("*").alias("n_words"))


def agg21_packaging_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes and time of each release, and its files per split; each path once."""
    s = F.lower(F.trim("split"))
    df = table(spark, d, "packaged_audio").groupBy("dataset_name", "target_rel_path").agg(F.max("size_bytes").alias("size"), F.max(F.when((F.col("duration_sec") > 0) & ~F.isnan("duration_sec"), F.round(F.col("duration_sec") * 1000).cast("bigint"))).alias("ms"), F.min(s).alias("split"))
    return df.groupBy("dataset_name").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.sum("ms").alias("total_ms"), F.count(F.when(F.col("split").isin("train", "training"), 1)).alias("n_train"), F.count(F.when(F.col("split").isin("test", "testing"), 1)).alias("n_test"))


def agg24_geometric_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Geometric mean of the word confidences of each chunk."""
    w = words(spark, d).where("chunk_id is not null and confidence > 0 and not isnan(confidence)")
    return w.groupBy("chunk_id").agg(F.round(F.exp(F.avg(F.ln("confidence"))), 6).alias("confidence"), F.count("*").alias("n"))


def agg25_composite_score(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct().where("not isnan(raw_cer) and not isnan(reconciled_cer)")
    return df.select("record_id", F.round(0.5 * F.col("raw_cer") + 0.5 * F.col("reconciled_cer"), 6).alias("score")).where("score is not null")


def syllable_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a syllable and the one after it."""
    df = table(spark, d, "enrichment_records").select("record_id", F.regexp_replace("syllabary_text", r"[^\x{13A0}-\x{13F5}]", "").alias("t")).where("length(t) > 1").distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.struct(F.substring("t", i, F.lit(1)).alias("src"), F.substring("t", i + 1, F.lit(1)).alias("tgt")))
    return df.select(F.inline(pairs)).groupBy("src", "tgt").agg(F.count("*").alias("n"))


def agg10_conditional_probabilities(spark: SparkSession, d: str) -> DataFrame:
    out = conditional_probabilities(syllable_bigrams(spark, d), "src", "tgt", "n", alpha=0.5)
    return out.select("src", "tgt", "n", F.round("p", 9).alias("p"))


def mth02_log_costs(spark: SparkSession, d: str) -> DataFrame:
    probs = conditional_probabilities(syllable_bigrams(spark, d), "src", "tgt", "n", alpha=0.5)
    return log_costs(probs, "src", "tgt", 1e-4, 20, 1.0).select("src", "tgt", F.round("cost", 9).alias("cost"))


def mth03_negative_logs(spark: SparkSession, d: str) -> DataFrame:
    df = words(spark, d).where("confidence is null or not isnan(confidence)")
    return df.groupBy("source_id").agg(F.round(F.avg(negative_log(F.col("confidence"), 5.0)), 6).alias("mean_cost"), F.count("*").alias("n"))


def mth04_log_add(spark: SparkSession, d: str) -> DataFrame:
    df = words(spark, d).where("confidence > 0 and min_char_confidence > 0 and not isnan(confidence) and not isnan(min_char_confidence)")
    return df.select("interval_id", F.round(log_add(F.ln("confidence"), F.ln("min_char_confidence")), 6).alias("log_sum")).distinct()


def mth06_relative_improvement(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").distinct().where("not isnan(raw_cer) and not isnan(reconciled_cer) and raw_cer is not null and reconciled_cer is not null")
    return df.select("record_id", F.round(relative_improvement(F.col("raw_cer"), F.col("reconciled_cer")), 4).alias("improvement_pct"))


def mth09_noise_gain(spark: SparkSession, d: str) -> DataFrame:
    tiers = F.explode(F.array(*[F.lit(float(x)) for x in (25, 15, 5, 0, -5)]))
    df = words(spark, d).where("confidence > 0 and min_char_confidence > 0 and not isnan(confidence) and not isnan(min_char_confidence)")
    return df.groupBy("source_id").agg(F.avg("confidence").alias("p"), F.avg("min_char_confidence").alias("q")).select("source_id", tiers.alias("snr_db"), "p", "q").select("source_id", "snr_db", F.round(noise_gain(F.col("p"), F.col("q"), F.col("snr_db")), 6).alias("gain"))


def srt02_ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Splits ranked by their error rates, the best first."""
    df = records(spark, d).where("split is not null").groupBy("split").agg(F.round(F.sum(F.levenshtein("ref", "rec")) / F.sum(F.length("ref")), 6).alias("new_cer"), F.round(F.sum(F.levenshtein("ref", "hyp")) / F.sum(F.length("ref")), 6).alias("cer"))
    # One row per split: a window over a handful of rows.
    return df.withColumn("place", F.row_number().over(Window.orderBy("new_cer", "cer", "split")).cast("bigint"))


def srt03_best_of_three(spark: SparkSession, d: str) -> DataFrame:
    df = records(spark, d).where("split is not null").withColumn("a", F.levenshtein("ref", "hyp")).withColumn("b", F.levenshtein("ref", "rec"))
    best = best_of_each(df, ["split"], {"clean": [F.col("a"), F.col("record_id")], "noisy": [F.col("b"), F.col("record_id")], "both": [F.col("a") + F.col("b"), F.col("record_id")]}, ["record_id"])
    return best.select("split", F.col("clean.record_id").alias("best_clean"), F.col("noisy.record_id").alias("best_noisy"), F.col("both.record_id").alias("best_both"))


def srt04_length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Files of each release in batches of at most eight of similar length."""
    df = table(spark, d, "packaged_audio").groupBy("dataset_name", "target_rel_path").agg(F.max(F.when(F.col("duration_sec") > 0, F.round(F.col("duration_sec") * 1000).cast("bigint"))).alias("ms")).where("ms is not null")
    return length_batches(df, ["dataset_name"], "ms", ["target_rel_path"], 8)


def srt06_top_successors(spark: SparkSession, d: str) -> DataFrame:
    """The three likeliest syllables after each."""
    return first_per(syllable_bigrams(spark, d), ["src"], [F.desc("n"), F.col("tgt")], 3)


def srt07_argmax_successor(spark: SparkSession, d: str) -> DataFrame:
    return syllable_bigrams(spark, d).groupBy("src").agg(F.min_by("tgt", F.struct(-F.col("n"), F.col("tgt"))).alias("tgt"), F.max("n").alias("n"))


def srt10_examples(spark: SparkSession, d: str) -> DataFrame:
    """Three examples of each outcome: test before validation before training, then by id."""
    cat = F.when(F.col("rec") == F.col("ref"), "exact").when(F.length("rec") < F.length("ref"), "shorter").when(F.length("rec") > F.length("ref"), "longer").otherwise("changed")
    prio = F.when(F.col("split").isin("test"), 0).when(F.col("split").isin("valid", "validation", "dev", "eval"), 1).otherwise(2)
    df = records(spark, d).withColumn("category", cat).withColumn("prio", prio).groupBy("category", "record_id").agg(F.min("prio").alias("prio"))
    return first_per(df, ["category"], [F.col("prio"), F.col("record_id")], 3)


def srt12_best_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per recording the profile with most chunks among those of at most 60 s; else the one with the shortest."""
    df = chunks(spark, d).groupBy("source_id", "profile").agg(F.max(F.col("ce") - F.col("cs")).alias("longest"), F.count("*").alias("n"))
    return tiered_best(df, ["source_id"], "profile", F.col("longest") <= 60_000, F.col("n"), F.col("longest"), "default")


def srt14_longest_files(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "packaged_audio").where("duration_sec > 0 and not isnan(duration_sec)").groupBy("dataset_name", "target_rel_path").agg(F.max(F.round(F.col("duration_sec") * 1000).cast("bigint")).alias("ms"))
    return df.orderBy(F.desc("ms"), "dataset_name", "target_rel_path").limit(50)


QUERIES = {f.__name__: f for f in (
    agg01_corpus_cer, agg02_macro_cer, agg03_median_cer, agg05_enrichment_summary, agg06_split_rollup, agg07_outcome_categories, agg10_conditional_probabilities, agg13_alignment_metrics, agg14_coverage, agg15_word_audit,
    agg16_syllable_coverage, agg17_confidence_stats, agg18_duration_stats, agg19_vocabulary, agg20_group_lists, agg21_packaging_totals, agg24_geometric_confidence, agg25_composite_score, mth02_log_costs, mth03_negative_logs, mth04_log_add,
    mth06_relative_improvement, mth09_noise_gain, srt02_ranked_sources, srt03_best_of_three, srt04_length_batches, srt06_top_successors, srt07_argmax_successor, srt10_examples, srt12_best_profile, srt14_longest_files,
)}

_W, _R, _C = f"with {WORDS_SQL}", f"with {RECORDS_SQL}", f"with {CHUNKS_SQL}"
_CER = "case when length(ref) = 0 then case when length(hyp) > 0 then 1.0 else 0.0 end else levenshtein(ref, hyp) / length(ref) end"
BIGRAMS_SQL = """with texts as (
  select distinct record_id, regexp_replace(syllabary_text, '[^Ꭰ-Ᏽ]', '', 'g') as t from enrichment_records
), bigrams as (
  select src, tgt, count(*) as n from (
    select substring(t, i, 1) as src, substring(t, i + 1, 1) as tgt from (select t, unnest(range(1, length(t))) as i from texts where length(t) > 1)) group by all
)"""
_COND = BIGRAMS_SQL + """, dense as (
  select s.src, t.tgt, coalesce(n, 0) as n, (select count(distinct tgt) from bigrams) as v
  from (select distinct src from bigrams) s cross join (select distinct tgt from bigrams) t left join bigrams b on b.src = s.src and b.tgt = t.tgt
), probs as (
  select src, tgt, n, (n + 0.5) / (sum(n) over (partition by src) + 0.5 * v) as p, sum(n) over (partition by src) as support from dense
)"""
_OUTCOME = "case when {x} = ref then 'exact' when length({x}) < length(ref) then 'shorter' when length({x}) > length(ref) then 'longer' else 'changed' end"

SQL = {
    "agg01_corpus_cer": _R + " select split, count(*) as n, cast(sum(levenshtein(ref, hyp)) as bigint) as n_errors, cast(sum(length(ref)) as bigint) as n_chars, round(case when sum(length(ref)) > 0 then sum(levenshtein(ref, hyp)) / sum(length(ref)) else 0 end, 4) as cer from records group by split",
    "agg02_macro_cer": _R + f" select split, round(avg({_CER}), 6) as mean_cer, count(*) as n from records group by split",
    "agg03_median_cer": _R + f" select split, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) as cer, round(median({_CER}), 6) as median_cer from records group by split",
    "agg05_enrichment_summary": """with r as (select distinct * from enrichment_records), s as (
  select lower(trim(split)) as split, raw_cer, reconciled_cer from r where raw_cer is not null and reconciled_cer is not null and not isnan(raw_cer) and not isnan(reconciled_cer)
), a as (select case when grouping(split) = 1 then 'all' else coalesce(split, 'none') end as split, count(*) as n, avg(raw_cer) as a, avg(reconciled_cer) as b from s group by grouping sets ((split), ()))
select split, n, round(a, 6) as mean_raw, round(b, 6) as mean_new, round(case when a > 0 then (a - b) / a * 100 else 0 end, 4) as improvement_pct from a""",
    "agg06_split_rollup": _R + """ select case when grouping(split) = 1 then 'all' else coalesce(split, 'none') end as split, count(*) as n,
  count(*) filter (levenshtein(ref, rec) < levenshtein(ref, hyp)) as n_better, count(*) filter (levenshtein(ref, rec) > levenshtein(ref, hyp)) as n_worse,
  count(*) filter (levenshtein(ref, rec) = levenshtein(ref, hyp)) as n_equal, count(*) filter (ref = rec) as n_exact from records group by grouping sets ((split), ())""",
    "agg07_outcome_categories": _R + f""", e as (
  select coalesce(split, 'none') as split, 'raw' as arm, {_OUTCOME.format(x='hyp')} as category from records union all
  select coalesce(split, 'none'), 'reconciled', {_OUTCOME.format(x='rec')} from records)
select arm, split, category, count(*) as n from e group by all union all select arm, 'all', category, count(*) from e group by all""",
    "agg10_conditional_probabilities": _COND + " select src, tgt, n, round(p, 9) as p from probs",
    "agg13_alignment_metrics": _W + """ select source_id, count(*) as n_words, count(emitted_word) as n_matched, round(count(emitted_word) / count(*), 6) as matched_share,
  round(avg(case when emitted_word is not null then cast(round(confidence * 10000) as bigint) end) / 10000, 6) as mean_confidence, cast(coalesce(sum(length(word)), 0) as bigint) as n_chars from words group by source_id""",
    "agg14_coverage": _W + """, r as (
  select *, max(e) over (partition by source_id order by s, e rows between unbounded preceding and 1 preceding) as reach from words
), c as (select source_id, cast(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) as bigint) as covered_ms from r group by source_id)
select source_id, count(*) as n, min(e - s) as shortest_ms, max(e - s) as longest_ms, round(median(e - s), 1) as median_ms, max(e) - min(s) as span_ms, any_value(covered_ms) as covered_ms, round(any_value(covered_ms) * 100 / (max(e) - min(s)), 4) as covered_pct
from words join c using (source_id) group by source_id""",
    "agg15_word_audit": _W + """ select word, count(*) as n, min(case when flagged = false then 1 else 0 end) as all_valid, round(sum(e - s) / count(*), 3) as mean_ms,
  min(source_id) as first_source, arg_min(s, (source_id, s)) as first_ms from words where word is not null group by word""",
    "agg16_syllable_coverage": """with r as (select distinct * from enrichment_records), x as (
  select coalesce(lower(trim(split)), 'none') as split, unnest(string_split(regexp_replace(syllabary_text, '[^Ꭰ-Ᏽ]', '', 'g'), '')) as syllable from r
), c as (select split, syllable, count(*) as n from x where syllable <> '' group by all)
select split, arg_min(syllable, (n, syllable)) as rarest, arg_max(syllable, (n, syllable)) as commonest, round(avg(n), 6) as mean_count, round(stddev_pop(n), 6) as sd_count, count(*) as n_active, cast(1 as double) as coverage from c group by split""",
    "agg17_confidence_stats": _W + " select chunk_id, min(confidence) as least, round(median(confidence), 6) as median, max(confidence) as greatest, count(*) as n, arg_min(interval_id, (confidence, interval_id)) as worst_interval from words where chunk_id is not null and confidence is not null and not isnan(confidence) group by chunk_id",
    "agg18_duration_stats": """with d as (select distinct * from packaged_audio), m as (select dataset_name, cast(round(duration_sec * 1000) as bigint) as ms from d where duration_sec > 0 and not isnan(duration_sec))
select dataset_name, count(*) as n, cast(sum(ms) as bigint) as total_ms, min(ms) as least_ms, max(ms) as most_ms, round(sum(ms) / count(*), 3) as mean_ms from m group by dataset_name""",
    "agg19_vocabulary": "select letter, count(*) as n from (select unnest(string_split(syllabary_raw, '')) as letter from syllabary_samples) where letter <> '' group by letter",
    "agg20_group_lists": _W + " select chunk_id, string_agg(word, ' ' order by s, interval_id, word) as text, count(*) as n_words from words where chunk_id is not null and word is not null group by chunk_id",
    "agg21_packaging_totals": """with f as (
  select dataset_name, target_rel_path, max(size_bytes) as size, max(case when duration_sec > 0 and not isnan(duration_sec) then cast(round(duration_sec * 1000) as bigint) end) as ms, min(lower(trim(split))) as split from packaged_audio group by all)
select dataset_name, count(*) as n_files, cast(sum(size) as bigint) as n_bytes, cast(sum(ms) as bigint) as total_ms, count(*) filter (split in ('train', 'training')) as n_train, count(*) filter (split in ('test', 'testing')) as n_test from f group by dataset_name""",
    "agg24_geometric_confidence": _W + " select chunk_id, round(exp(avg(ln(confidence))), 6) as confidence, count(*) as n from words where chunk_id is not null and confidence > 0 and not isnan(confidence) group by chunk_id",
    "agg25_composite_score": "select record_id, round(0.5 * raw_cer + 0.5 * reconciled_cer, 6) as score from (select distinct * from enrichment_records) where not isnan(raw_cer) and not isnan(reconciled_cer) and raw_cer is not null and reconciled_cer is not null",
    "mth02_log_costs": _COND + " select src, tgt, round(case when src = tgt then 0 when support < 20 then 1.0 else greatest(0, least(1, ln(p + 1e-4) / ln(1e-4))) end, 9) as cost from probs",
    "mth03_negative_logs": _W + " select source_id, round(avg(case when confidence is null then 5.0 else greatest(0, -ln(greatest(confidence, 1e-12))) end), 6) as mean_cost, count(*) as n from words where confidence is null or not isnan(confidence) group by source_id",
    "mth04_log_add": _W + " select distinct interval_id, round(ln(confidence + min_char_confidence), 6) as log_sum from words where confidence > 0 and min_char_confidence > 0 and not isnan(confidence) and not isnan(min_char_confidence)",
    "mth06_relative_improvement": "select record_id, round(case when raw_cer > 0 then (raw_cer - reconciled_cer) / raw_cer * 100 else 0 end, 4) as improvement_pct from (select distinct * from enrichment_records) where not isnan(raw_cer) and not isnan(reconciled_cer) and raw_cer is not null and reconciled_cer is not null",
    "mth09_noise_gain": _W + """, a as (select source_id, avg(confidence) as p, avg(min_char_confidence) as q from words where confidence > 0 and min_char_confidence > 0 and not isnan(confidence) and not isnan(min_char_confidence) group by source_id)
select source_id, cast(snr_db as double) as snr_db, round(sqrt(p / (q * pow(10, snr_db / 10))), 6) as gain from a, (select unnest([25.0, 15.0, 5.0, 0.0, -5.0]) as snr_db)""",
    "srt02_ranked_sources": _R + """, a as (select split, round(sum(levenshtein(ref, rec)) / sum(length(ref)), 6) as new_cer, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) as cer from records where split is not null group by split)
select *, row_number() over (order by new_cer, cer, split) as place from a""",
    "srt03_best_of_three": _R + """, a as (select split, record_id, levenshtein(ref, hyp) as a, levenshtein(ref, rec) as b from records where split is not null)
select split, arg_min(record_id, (a, record_id)) as best_clean, arg_min(record_id, (b, record_id)) as best_noisy, arg_min(record_id, (a + b, record_id)) as best_both from a group by split""",
    "srt04_length_batches": """with f as (select dataset_name, target_rel_path, max(case when duration_sec > 0 then cast(round(duration_sec * 1000) as bigint) end) as ms from packaged_audio group by all)
select *, (row_number() over (partition by dataset_name order by ms, target_rel_path) - 1) // 8 as batch_no from f where ms is not null""",
    "srt06_top_successors": BIGRAMS_SQL + " select * from bigrams qualify row_number() over (partition by src order by n desc, tgt) <= 3",
    "srt07_argmax_successor": BIGRAMS_SQL + " select src, arg_min(tgt, (-n, tgt)) as tgt, max(n) as n from bigrams group by src",
    "srt10_examples": _R + f""", a as (select {_OUTCOME.format(x='rec')} as category, record_id, min(case when split = 'test' then 0 when split in ('valid', 'validation', 'dev', 'eval') then 1 else 2 end) as prio from records group by all)
select * from a qualify row_number() over (partition by category order by prio, record_id) <= 3""",
    "srt12_best_profile": _C + """, a as (select source_id, profile, max(ce - cs) as longest, count(*) as n from chunks group by all)
select source_id, coalesce(arg_max(profile, (n, profile)) filter (longest <= 60000), arg_min(profile, (longest, profile)), 'default') as profile from a group by source_id""",
    "srt14_longest_files": "select dataset_name, target_rel_path, max(cast(round(duration_sec * 1000) as bigint)) as ms from packaged_audio where duration_sec > 0 and not isnan(duration_sec) group by all order by ms desc, dataset_name, target_rel_path limit 50",
}
