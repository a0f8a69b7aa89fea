"""Tones, syllabary, enrichment, masks, splits, signals and estimation steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.functions import text as X
from utterframe.functions.maths import log_softmax, negative_log, soft_gate
from utterframe.functions.tones import HIATUS, canonical_toned, mora_letters, mora_tokens, reconciled, rewrite, syllabary_writing, text_udf, tone_contour
from utterframe.operators.aggregates import MAX_LABELS
from utterframe.operators.alignment import align_grams, align_syllables
from utterframe.operators.confusion import Matrix
from utterframe.operators.joins import interpolated
from utterframe.operators.windows import dilated, running_sum, turns
from utterframe.plans.common import CHUNKS_SQL, RECORDS_SQL, WORDS_SQL, chunks, records, words
from utterframe.plans.metric_queries import BIGRAMS_SQL, syllable_bigrams
from utterframe.plans.sequence_queries import agg08_confusions, word_pairs
from utterframe.session import broadcast_if_small, spread, table
from utterframe.sources.writers import wide_matrix


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enrichment_records").select("record_id", "target_phonetics").where("target_phonetics is not null").distinct()


def txt04_orthography_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Syllabary to phonetics and back; whether the letters are the same again."""
    s = table(spark, d, "enrichment_records").select("record_id", "syllabary_text").where("syllabary_text rlike '^[Ꭰ-Ᏼ ]+$'").distinct()
    s = s.withColumn("phonetic", X.base_transliteration(F.col("syllabary_text")))
    return s.select("record_id", "phonetic", syllabary_writing(F.col("phonetic")).alias("back"))


def txt06_syllabary(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", "ref").distinct().select("record_id", syllabary_writing(F.col("ref")).alias("syllabary"))


def txt09_hiatus(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).select("record_id", rewrite(F.col("target_phonetics"), HIATUS).alias("text")).distinct()


def _toned(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).select("record_id", canonical_toned(F.col("target_phonetics")).alias("toned")).distinct()


def txt12_numbered_tones(spark: SparkSession, d: str) -> DataFrame:
    """Targets in the canonical spelling with numbered tones."""
    return _toned(spark, d)


def txt13_mora_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Letters and moraic tones of each target, apart."""
    return _toned(spark, d).select("record_id", mora_letters(F.col("toned")).alias("letters"), mora_tokens(F.col("toned")).alias("tones"))


def arr02_tone_contours(spark: SparkSession, d: str) -> DataFrame:
    contour = F.transform(tone_contour(mora_tokens(F.col("toned"))), lambda p: F.concat_ws(":", p.time.cast("string"), p.pitch.cast("string")))
    return _toned(spark, d).select("record_id", F.array_join(contour, " ").alias("contour")).distinct()


def txt15_masks(spark: SparkSession, d: str) -> DataFrame:
    """Letters that speech may drop and places where it may put a breath, as strings of 0 and 1."""
    bits = lambda f: lambda x: "".join("01"[m] for m in f(x))
    r = records(spark, d).select("record_id", "ref").distinct()
    return r.select("record_id", text_udf(bits(X.syncope_mask), F.col("ref")).alias("syncope"), text_udf(bits(X.intrusion_mask), F.col("ref")).alias("intrusion"))


def txt20_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Transliterations enriched by what was heard, syllable by syllable (SUP-06)."""
    sounds = {chr(X.FIRST + i): s for i, s in enumerate(X.SYLLABLES)}
    df = table(spark, d, "enrichment_records").select("record_id", "syllabary_text", "emitted_text").where("syllabary_text is not null and emitted_text is not null").distinct()

    def run(batches):
        for pdf in batches:
            out = []
            for key, syllabary, emitted in pdf.itertuples(index=False):
                units = [(c, sounds.get(c, c), c in sounds) for c in syllabary]
                heard = emitted.replace("ʔ", "'")
                out.append((key, reconciled([(c, heard[a:b]) for c, (a, b) in zip(syllabary, align_syllables(units, heard))])))
            yield pd.DataFrame(out, columns=["record_id", "text"])

    return spread(df, "record_id").mapInPandas(run, "record_id string, text string")


def txt21_model_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(F.lower("dataset_name"), "[^a-z0-9._-]+", "_")
    return table(spark, d, "packaging_manifest").select("dataset_name", F.regexp_replace(name, "-", "__").alias("name")).distinct()


def txt23_mismatch_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Changed letters by the kinds of sound that they swap."""
    c = agg08_confusions(spark, d).where("src <> tgt")
    kind = lambda x: F.when(x.isin("<ins>", "<del>"), "nothing").when(x.isin(*X.VOWELS), "vowel").when(x == "h", "breath").when(x == "'", "glottal").when(x == " ", "space").otherwise("consonant")
    return c.groupBy(kind(F.col("src")).alias("was"), kind(F.col("tgt")).alias("is")).agg(F.sum("n").alias("n"))


def txt24_letter_difference(spark: SparkSession, d: str) -> DataFrame:
    """Letters of one text that the other lacks."""
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(F.split(a, ""), F.split(b, ""))), "")
    return records(spark, d).select("record_id", diff("ref", "hyp").alias("lost"), diff("hyp", "ref").alias("new")).distinct()


def agg04_annotated_or_all(spark: SparkSession, d: str) -> DataFrame:
    """Mean rate over the records with a target, or over all where a split has none."""
    df = table(spark, d, "enrichment_records").distinct().where("raw_cer is not null and not isnan(raw_cer)")
    toned = F.col("target_phonetics").isNotNull()
    return df.groupBy("split").agg(F.round(F.coalesce(F.avg(F.when(toned, F.col("raw_cer"))), F.avg("raw_cer")) + 1e-9, 6).alias("cer"), F.count(F.when(toned, 1)).alias("n_annotated"))


def agg09_dense_counts(spark: SparkSession, d: str) -> DataFrame:
    c = syllable_bigrams(spark, d)
    # The labels are an alphabet.
    grid = c.select("src").distinct().join(broadcast_if_small(c.select("tgt").distinct(), MAX_LABELS))
    return grid.join(c, ["src", "tgt"], "left").select("src", "tgt", F.coalesce("n", F.lit(0)).alias("n"))


def agg11_deletions_insertions(spark: SparkSession, d: str) -> DataFrame:
    c = agg08_confusions(spark, d)
    return c.where("src = '<ins>' or tgt = '<del>'").select(F.when(F.col("src") == "<ins>", "insertion").otherwise("deletion").alias("kind"), F.when(F.col("src") == "<ins>", F.col("tgt")).otherwise(F.col("src")).alias("letter"), "n")


def agg22_maximisation_step(spark: SparkSession, d: str) -> DataFrame:
    """Observed counts with a prior of half the last probability, normalised by source; its change."""
    obs = syllable_bigrams(spark, d)
    prior = obs.where("n >= 3").withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("src"))).select("src", "tgt", "q")
    both = obs.join(prior, ["src", "tgt"], "full").withColumn("w", F.coalesce("n", F.lit(0)) + 0.5 * F.coalesce("q", F.lit(0.0)))
    p = both.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src")))
    return p.groupBy("src").agg(F.round(F.max(F.abs(F.col("p") - F.coalesce("q", F.lit(0.0)))) + 1e-9, 6).alias("change"), F.count("*").alias("n_targets"))


def win14_uniform_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of a chunk at equal distances over its length."""
    w = words(spark, d).where("chunk_id is not null").join(chunks(spark, d).select("chunk_id", "cs", "ce"), "chunk_id")
    w = w.withColumn("n", F.count("*").over(Window.partitionBy("chunk_id"))).withColumn("i", F.row_number().over(Window.partitionBy("chunk_id").orderBy("s", "e", "interval_id")) - 1)
    at = lambda k: F.col("cs") + F.floor((F.col("ce") - F.col("cs")) * k / F.col("n"))
    return w.select("interval_id", at(F.col("i")).alias("start_ms"), at(F.col("i") + 1).alias("end_ms"))


def snk11_wide_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Profiles by recording as a wide table of counts; `other` holds those that are not configured."""
    # One row per profile of the configuration.
    known = sorted({"default", *[r.profile for r in table(spark, d, "aligner_config").select("profile").where("profile is not null").collect()]} - {"other"})
    profile = F.when(F.col("profile").isin(known), F.col("profile")).otherwise("other")
    c = chunks(spark, d).groupBy("source_id", profile.alias("profile")).agg(F.count("*").alias("n"))
    return wide_matrix(c, "source_id", "profile", "n", [*known, "other"])


def set08_three_splits(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "syllabary_samples").select("sample_id", F.lower(F.trim("split")).alias("split")).distinct()
    parts = [s.where(F.col("split").isin(*names)).withColumn("part", F.lit(part)) for part, names in (("train", ("train", "training")), ("valid", ("valid", "validation", "dev", "eval")), ("test", ("test",)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count("*").alias("n"))


def set10_distinct_words(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).where("emitted_word is not null").select(F.lower("emitted_word").alias("word")).dropDuplicates()


def srt11_viewer_order(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the order of a viewer: most flagged words first, then least confidence, then id."""
    w = words(spark, d).where("chunk_id is not null").groupBy("chunk_id").agg(F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"), F.min(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("least"))
    return w.orderBy(F.desc("n_flagged"), F.asc_nulls_last("least"), "chunk_id").limit(100)


def jon15_running_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Words of a recording's lines up to each line."""
    lines = table(spark, d, "codeswitched_lines").select("line_id", "source_id", "seq", F.size(F.split("raw_text", " ")).alias("n")).distinct().where("seq is not null")
    return running_sum(lines.withColumn("block", F.floor(F.col("seq") / 200)), ["source_id"], "block", ["seq", "line_id"], "n", "upto").select("line_id", "upto")


def aln13_gram_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Letters of words against letters heard, one or two at a time, under corpus costs."""
    p = agg08_confusions(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    # One row per pair of letters of an alphabet.
    rows = [("" if r.src == "<ins>" else r.src, "" if r.tgt == "<del>" else r.tgt, r.p) for r in p.select("src", "tgt", "p").collect()]
    sent = spark.sparkContext.broadcast(Matrix(rows))
    df = word_pairs(spark, d).groupBy("source", "target").agg(F.count("*").alias("n"))

    def run(batches):
        m = sent.value
        for pdf in batches:
            out = []
            for a, b, n in pdf.itertuples(index=False):
                cost, path = align_grams(list(a), list(b), m.substitute, m.delete, m.insert)
                out.append((a, b, n, round(cost, 4), " ".join(f"{a[i : i + di]}>{b[j : j + dj]}" for i, j, di, dj, _ in path)))
            yield pd.DataFrame(out, columns=["source", "target", "n", "cost", "path"])

    return spread(df, "source").mapInPandas(run, "source string, target string, n bigint, cost double, path string")


def em02_log_costs(spark: SparkSession, d: str) -> DataFrame:
    c = syllable_bigrams(spark, d)
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    return p.select("src", "tgt", F.round(negative_log(F.col("p"), 10.0) + 1e-9, 6).alias("cost"))


def int06_long_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of more than 20 s on a grid of equal parts that are not longer."""
    c = chunks(spark, d).withColumn("n", F.ceil((F.col("ce") - F.col("cs")) / 20_000)).where("n > 1")
    c = c.select("chunk_id", "cs", "ce", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    at = lambda k: F.col("cs") + F.floor((F.col("ce") - F.col("cs")) * k / F.col("n"))
    return c.select("chunk_id", "k", at(F.col("k")).alias("start_ms"), at(F.col("k") + 1).alias("end_ms"))


def int07_speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines of one speaker within a recording."""
    lines = table(spark, d, "codeswitched_lines").select("line_id", "source_id", "seq", F.coalesce("speaker", F.lit("?")).alias("speaker")).where("seq is not null").distinct().withColumn("block", F.floor(F.col("seq") / 500))
    lines = turns(lines, ["source_id"], "block", ["seq", "line_id"], "speaker", "turn")
    return lines.groupBy("source_id", "turn").agg(F.min("speaker").alias("speaker"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def sig07_soft_mask(spark: SparkSession, d: str) -> DataFrame:
    """Frames gated by a probability of speech that is known at every fifth frame only: interpolated,
    widened by two frames, then blended with the blank."""
    e = table(spark, d, "embeddings").select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 200)).alias("utt"), "vec_id", "embedding")
    known = e.where("vec_id % 5 = 0").select("utt", "vec_id", F.round(F.abs(F.get("embedding", F.lit(0))) % 1, 4).cast("double").alias("v"))
    gate = dilated(interpolated(e.select("utt", "vec_id"), known, ["utt"], "vec_id", "v"), ["utt"], ["vec_id"], "v", 2, "gate")
    out = e.join(gate.select("utt", "vec_id", "gate"), ["utt", "vec_id"]).select("vec_id", soft_gate(log_softmax(F.col("embedding")), F.col("gate"), 0).alias("g"))
    return out.select("vec_id", F.round(F.get("g", F.lit(0)), 4).alias("blank"), F.round(F.array_max("g"), 4).alias("best"))


@F.pandas_udf(T.StringType())
def _stripped(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts], dtype=object)


def sup09_evaluation_set(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation samples with a template from the syllabary and a target without tones."""
    s = table(spark, d, "syllabary_samples").where(F.lower(F.trim("split")).isin("test", "valid", "validation", "dev", "eval")).where("trim(coalesce(syllabary_raw, '')) <> '' and trim(coalesce(gt_target, '')) <> ''").select("sample_id", "syllabary_raw", "gt_target").distinct()
    return s.select("sample_id", X.normalize_text(X.syllabary_to_phonetics(F.col("syllabary_raw"))).alias("template"), X.normalize_text(_stripped("gt_target")).alias("target"))


QUERIES = {f.__name__: f for f in (
    txt04_orthography_round_trip, txt06_syllabary, txt09_hiatus, txt12_numbered_tones, txt13_mora_tokens, arr02_tone_contours, txt15_masks, txt20_reconciled, txt21_model_names, txt23_mismatch_kinds, txt24_letter_difference,
    agg04_annotated_or_all, agg09_dense_counts, agg11_deletions_insertions, agg22_maximisation_step, win14_uniform_words, snk11_wide_matrix, set08_three_splits, set10_distinct_words, srt11_viewer_order, jon15_running_prefix,
    aln13_gram_alignment, em02_log_costs, int06_long_chunks, int07_speaker_turns, sig07_soft_mask, sup09_evaluation_set,
)}

_W, _C, _R = f"with {WORDS_SQL}", f"with {CHUNKS_SQL}", f"with {RECORDS_SQL}"
_V, _M = "[aeiouvAEIOUV]", r"[\x{300}-\x{36f}:ː0-9]"
_HIATUS = "target_phonetics"
for _pattern in [f"({_V}{_M}+)({_V})"] * 2 + [f"({_V})({_V}{_M})"] * 2 + [f"([{v}{v.upper()}])([{''.join(u + u.upper() for u in X.VOWELS if u != v)}])" for v in X.VOWELS]:
    _HIATUS = f"regexp_replace({_HIATUS}, '{_pattern}', '\\1''\\2', 'g')"

SQL = {
    "txt09_hiatus": f"select distinct record_id, {_HIATUS} as text from enrichment_records where target_phonetics is not null",
    "txt21_model_names": "select distinct dataset_name, regexp_replace(regexp_replace(lower(dataset_name), '[^a-z0-9._-]+', '_', 'g'), '-', '__', 'g') as name from packaging_manifest",
    "txt24_letter_difference": _R + " select distinct record_id, array_to_string(list_sort(list_filter(list_distinct(string_split(ref, '')), lambda c: not list_contains(string_split(hyp, ''), c))), '') as lost, array_to_string(list_sort(list_filter(list_distinct(string_split(hyp, '')), lambda c: not list_contains(string_split(ref, ''), c))), '') as new from records",
    "agg04_annotated_or_all": "select split, round(coalesce(avg(case when target_phonetics is not null then raw_cer end), avg(raw_cer)) + 1e-9, 6) as cer, count(target_phonetics) as n_annotated from (select distinct * from enrichment_records) where raw_cer is not null and not isnan(raw_cer) group by split",
    "agg09_dense_counts": BIGRAMS_SQL + " select s.src, t.tgt, coalesce(n, 0) as n from (select distinct src from bigrams) s cross join (select distinct tgt from bigrams) t left join bigrams b on b.src = s.src and b.tgt = t.tgt",
    "agg22_maximisation_step": BIGRAMS_SQL + """, q as (select src, tgt, n / sum(n) over (partition by src) as q from bigrams where n >= 3), w as (select b.src, b.tgt, n + 0.5 * coalesce(q, 0) as w, coalesce(q, 0) as q from bigrams b left join q using (src, tgt)),
p as (select src, w / sum(w) over (partition by src) as p, q from w) select src, round(max(abs(p - q)) + 1e-9, 6) as change, count(*) as n_targets from p group by src""",
    "win14_uniform_words": f"with {WORDS_SQL}, {CHUNKS_SQL}, w as (select interval_id, cs, ce, count(*) over (partition by chunk_id) as n, row_number() over (partition by chunk_id order by s, e, interval_id) - 1 as i from words join chunks using (chunk_id)) select interval_id, cs + (ce - cs) * i // n as start_ms, cs + (ce - cs) * (i + 1) // n as end_ms from w",
    "snk11_wide_matrix": _C + " select source_id, " + ", ".join(f'count(*) filter (profile = \'{p}\') as "{p}"' for p in ("default", "dialogue", "longform", "scripture", "training", "tune-a")) + ", count(*) filter (profile not in (select profile from aligner_config where profile is not null) and profile <> 'default') as other from chunks group by source_id",
    "set08_three_splits": "select case when split in ('train', 'training') then 'train' when split = 'test' then 'test' else 'valid' end as part, count(*) as n from (select distinct sample_id, lower(trim(split)) as split from syllabary_samples) where split in ('train', 'training', 'test', 'valid', 'validation', 'dev', 'eval') group by 1",
    "set10_distinct_words": _W + " select distinct lower(emitted_word) as word from words where emitted_word is not null",
    "srt11_viewer_order": _W + " select chunk_id, count(*) filter (flagged) as n_flagged, min(case when not isnan(confidence) then confidence end) as least from words where chunk_id is not null group by chunk_id order by n_flagged desc, least nulls last, chunk_id limit 100",
    "jon15_running_prefix": "select line_id, cast(sum(n) over (partition by source_id order by seq, line_id rows unbounded preceding) as bigint) as upto from (select distinct line_id, source_id, seq, len(string_split(raw_text, ' ')) as n from codeswitched_lines where seq is not null)",
    "em02_log_costs": BIGRAMS_SQL + " select src, tgt, round(greatest(0, -ln(n / sum(n) over (partition by src))) + 1e-9, 6) as cost from bigrams",
    "int06_long_chunks": _C + ", n as (select *, cast(ceil((ce - cs) / 20000) as bigint) as n from chunks), k as (select chunk_id, cs, ce, n, unnest(range(0, n)) as k from n where n > 1) select chunk_id, k, cs + (ce - cs) * k // n as start_ms, cs + (ce - cs) * (k + 1) // n as end_ms from k",
    "int07_speaker_turns": """with l as (select distinct line_id, source_id, seq, coalesce(speaker, '?') as speaker from codeswitched_lines where seq is not null), g as (select *, lag(speaker) over (partition by source_id order by seq, line_id) as last from l),
t as (select *, sum(case when last is distinct from speaker then 1 else 0 end) over (partition by source_id order by seq, line_id rows unbounded preceding) as turn from g)
select source_id, cast(turn as bigint) as turn, min(speaker) as speaker, min(seq) as first_seq, max(seq) as last_seq, count(*) as n from t group by all""",
}
