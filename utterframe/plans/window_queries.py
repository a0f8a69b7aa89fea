"""Windows, intervals and frames (WIN, INT, SRC-08, SRT-08/09, MTH-05/08, ALN-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import argmax, log_softmax, soft_gate, top_k
from utterframe.functions.text import body_of, speaker_of
from utterframe.operators.interval_union import interval_periods
from utterframe.operators.windows import apportioned, carried, carried_over_blocks, dilated, fused, gap_filled, generated_id, islands, label_runs, midpoint_boundaries, overlapping_windows, padded_intervals, quietest_window, run_starts, running_sum, tumbling_level, turns
from utterframe.plans.common import CHUNKS_SQL, WORDS_SQL, chunks, words
from utterframe.session import table


def _chunk_words(spark: SparkSession, d: str) -> DataFrame:
    """Words within chunks: a chunk is short, so windows over one stay small whatever the recording."""
    return words(spark, d).where("chunk_id is not null").select("chunk_id", "interval_id", "word", "s", "e", "confidence", "flagged", "emitted_word", "min_char_confidence")


def win01_run_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The flags of each chunk's words with equal neighbours once."""
    return run_starts(_chunk_words(spark, d).where("flagged is not null"), ["chunk_id"], ["s", "interval_id"], "flagged").select("chunk_id", "interval_id", "flagged")


def win02_label_runs(spark: SparkSession, d: str) -> DataFrame:
    return label_runs(_chunk_words(spark, d).where("flagged is not null"), ["chunk_id"], ["s", "interval_id"], "flagged", "s", "e")


def win03_quiet_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three words below a confidence."""
    w = _chunk_words(spark, d).where("confidence is not null and not isnan(confidence)").withColumn("low", F.col("confidence") < 0.6)
    return label_runs(w, ["chunk_id"], ["s", "interval_id"], "low", "s", "e").where("low and n >= 3").select("chunk_id", "s", "e", "n")


def win04_neighbour_padding(spark: SparkSession, d: str) -> DataFrame:
    w = _chunk_words(spark, d).join(chunks(spark, d).select("chunk_id", "cs", "ce"), "chunk_id")
    return padded_intervals(w, ["chunk_id"], "s", "e", ["s", "e", "interval_id"], 120, F.col("cs"), F.col("ce")).select("interval_id", "padded_start", "padded_end")


def win05_midpoints(spark: SparkSession, d: str) -> DataFrame:
    return midpoint_boundaries(_chunk_words(spark, d), ["chunk_id"], "s", "e", ["s", "e", "interval_id"]).select("interval_id", "new_start", "new_end")


def win06_speaker_carry(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of lines: the one named, else the last one named before in the recording."""
    lines = table(spark, d, "codeswitched_lines").select("line_id", "source_id", "seq", "raw_text").distinct().where("seq is not null")
    lines = lines.withColumn("named", speaker_of(F.col("raw_text"))).withColumn("block", F.floor(F.col("seq") / 500))
    return carried_over_blocks(lines, ["source_id"], "block", ["seq", "line_id"], "named", "speaker").select("line_id", "speaker", F.trim(body_of(F.col("raw_text"))).alias("body"))


def win07_end_carry(spark: SparkSession, d: str) -> DataFrame:
    """End of the last word with an emission, for every word; 0 before the first."""
    w = _chunk_words(spark, d).withColumn("known", F.when(F.col("emitted_word").isNotNull(), F.col("e")))
    return carried(w, ["chunk_id"], ["s", "e", "interval_id"], "known", "last_end").select("interval_id", F.coalesce("last_end", F.lit(0)).alias("last_end"))


def win08_dilation(spark: SparkSession, d: str) -> DataFrame:
    w = _chunk_words(spark, d).where("confidence is not null and not isnan(confidence)")
    return dilated(w, ["chunk_id"], ["s", "e", "interval_id"], "confidence", 2, "best").select("interval_id", "best")


def win09_overlapping_windows(spark: SparkSession, d: str) -> DataFrame:
    """Words by place in windows of 30 with margins of 1, each in one window."""
    w = _chunk_words(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy("s", "e", "interval_id")) - 1)
    return overlapping_windows(w, "place", 30, 1).groupBy("chunk_id", "window_no").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def win10_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Words per window of 5,120 ms of each recording."""
    return words(spark, d).groupBy("source_id", F.floor(F.col("s") / 5120).alias("window_no")).agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("ms"))


def win11_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of every 16 values of each vector, as frames of a signal."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double") / 4)
    return tumbling_level(v, ["vec_id"], "i", "x", 16)


def win12_quietest_window(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))
    return quietest_window(v, ["vec_id"], "i", "x", 8)


def win13_phoneme_shares(spark: SparkSession, d: str) -> DataFrame:
    """Letters of emitted words with equal shares of the word's time."""
    w = words(spark, d).where("emitted_word is not null and emitted_word <> ''").withColumn("n", F.length("emitted_word"))
    w = w.select("interval_id", (F.col("s") / 1000).alias("a"), (F.col("e") / 1000).alias("b"), "n", F.posexplode(F.split("emitted_word", "")).alias("i", "letter")).where("letter <> ''")
    return apportioned(w, "a", "b", "i", "n").select("interval_id", "i", F.round(F.col("part_start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("part_end") * 1000).cast("bigint").alias("end_ms"))


def win15_generated_ids(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("chunk_index", "chunk_id")
    return chunks(spark, d).select("chunk_id", generated_id("chunk_", F.row_number().over(w), 4).alias("generated"))


def int01_union_length(spark: SparkSession, d: str) -> DataFrame:
    p = interval_periods(words(spark, d), ["source_id"], F.col("s"), F.col("e"))
    return p.groupBy("source_id").agg(F.sum(F.col("period_end_ms") - F.col("period_start_ms")).alias("union_ms"), F.count("*").alias("n_periods"))


def int02_neighbour_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Time that consecutive words of a chunk share."""
    after = F.lead("s").over(Window.partitionBy("chunk_id").orderBy("s", "e", "interval_id"))
    return _chunk_words(spark, d).withColumn("shared", F.greatest(F.col("e") - after, F.lit(0))).groupBy("chunk_id").agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("shared_ms"))


def int03_gap_filled(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's words as a tier without holes, relative to the chunk."""
    w = _chunk_words(spark, d).join(chunks(spark, d).select("chunk_id", "cs", "ce"), "chunk_id").where("e > cs and s < ce")
    w = w.select("chunk_id", F.greatest(F.col("s") - F.col("cs"), F.lit(0)).alias("a"), F.least(F.col("e") - F.col("cs"), F.col("ce") - F.col("cs")).alias("b"), F.coalesce("word", F.lit("")).alias("word"), (F.col("ce") - F.col("cs")).alias("total"))
    return gap_filled(w, ["chunk_id"], "a", "b", "word", F.col("total"))


def int04_fused(spark: SparkSession, d: str) -> DataFrame:
    return fused(_chunk_words(spark, d).where("word is not null"), ["chunk_id"], "s", "e", "word", 40)


def int08_clips(spark: SparkSession, d: str) -> DataFrame:
    """Sample ranges of unflagged words at 16 kHz."""
    return words(spark, d).where("flagged = false").select("interval_id", (F.col("s") * 16).alias("first_sample"), (F.col("e") * 16).alias("last_sample")).distinct()


def int09_clip_padding(spark: SparkSession, d: str) -> DataFrame:
    """Words padded by 50 ms within their chunk, of at least one millisecond."""
    w = _chunk_words(spark, d).join(chunks(spark, d).select("chunk_id", "cs", "ce"), "chunk_id")
    a, b = F.greatest(F.col("s") - 50, F.col("cs")), F.least(F.col("e") + 50, F.col("ce"))
    return w.select("interval_id", a.alias("a"), F.greatest(b, a + 1).alias("b")).distinct()


def str01_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users: events less than half an hour apart."""
    ev = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    last = F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    out = islands(ev.withColumn("last", last), ["user_id"], ["t", "event_id"], F.col("t") - F.col("last") > 1_800_000_000, "session")
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("micros"))


def srt08_top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.inline(top_k(F.col("embedding"), 3))).select("vec_id", "id", F.round(F.col("value").cast("double"), 5).alias("value"))


def srt09_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("best"))


def mth05_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("vec_id", F.posexplode(log_softmax(F.col("embedding"))).alias("i", "x"))
    return df.select("vec_id", "i", F.round("x", 5).alias("x"))


def mth08_soft_gate(spark: SparkSession, d: str) -> DataFrame:
    """Log-probabilities of each vector gated by the label as a probability of speech."""
    gate = (F.col("label") % 10 + 0.5) / 10
    df = table(spark, d, "embeddings").select("vec_id", soft_gate(log_softmax(F.col("embedding")), gate, 0).alias("g"))
    return df.select("vec_id", F.posexplode("g").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


def _best_frames(spark: SparkSession, d: str) -> DataFrame:
    """Best id of each frame of a label's sequence, in blocks that follow the order of the frames."""
    return table(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 1000).alias("block"), "vec_id", argmax(F.col("embedding")).alias("best"), F.array_max("embedding").alias("top"))


def aln19_greedy_decode(spark: SparkSession, d: str) -> DataFrame:
    """Best ids of the frames of each label, each run once, id 0 as pad."""
    runs = turns(_best_frames(spark, d), ["label"], "block", ["vec_id"], "best", "run")
    return runs.where("best <> 0").groupBy("label", "run").agg(F.min("best").alias("id"), F.min("vec_id").alias("first"), F.count("*").alias("n"))


def aln21_peaks(spark: SparkSession, d: str) -> DataFrame:
    """For each run of equal best ids, the first frame with the highest value."""
    runs = turns(_best_frames(spark, d), ["label"], "block", ["vec_id"], "best", "run")
    return runs.groupBy("label", "run").agg(F.max_by("vec_id", F.struct(F.col("top"), -F.col("vec_id"))).alias("vec_id"), F.min("best").alias("best"))


def aln22_word_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Frames between delimiters (id 1) as words: their mean best value and extent."""
    f = _best_frames(spark, d).withColumn("top", F.round(F.col("top").cast("double"), 4)).withColumn("mark", (F.col("best") == 1).cast("int"))
    f = running_sum(f, ["label"], "block", ["vec_id"], "mark", "word_no").where("best <> 1")
    return f.groupBy("label", "word_no").agg(F.round(F.avg("top") + 1e-9, 4).alias("confidence"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("win", "int", "str", "srt", "mth", "aln") and callable(f) and n[3:5].isdigit()}

_W = f"with {WORDS_SQL}, cw as (select chunk_id, interval_id, word, s, e, confidence, flagged, emitted_word, min_char_confidence from words where chunk_id is not null)"
_WC = f"with {WORDS_SQL}, {CHUNKS_SQL}, cw as (select w.* exclude (source_id), cs, ce from words w join chunks c using (chunk_id))"
_RUNS = """, l as (select *, lag({x}) over (partition by chunk_id order by s, interval_id) as last from cw where {cond}), g as (
  select *, sum(case when last is distinct from {x} then 1 else 0 end) over (partition by chunk_id order by s, interval_id rows unbounded preceding) as k from l)"""
_FRAMES = "with v as (select vec_id, label, unnest(range(0, len(embedding))) as i, cast(unnest(embedding) as double) as x from embeddings)"
_BEST = "with f as (select label, vec_id, list_position(embedding, list_max(embedding)) - 1 as best, list_max(embedding) as top from embeddings)"
_BEST_RUNS = _BEST + ", l as (select *, lag(best) over (partition by label order by vec_id) as last from f), g as (select *, cast(sum(case when last is distinct from best then 1 else 0 end) over (partition by label order by vec_id rows unbounded preceding) as bigint) as run from l)"

SQL = {
    "win01_run_collapse": _W + ", l as (select *, lag(flagged) over (partition by chunk_id order by s, interval_id) as last from cw where flagged is not null) select chunk_id, interval_id, flagged from l where last is distinct from flagged",
    "win02_label_runs": _W + _RUNS.format(x="flagged", cond="flagged is not null") + " select chunk_id, any_value(flagged) as flagged, min(s) as s, max(e) as e, count(*) as n from g group by chunk_id, k",
    "win03_quiet_runs": _W + _RUNS.format(x="(confidence < 0.6)", cond="confidence is not null and not isnan(confidence)") + " select chunk_id, min(s) as s, max(e) as e, count(*) as n from g group by chunk_id, k having count(*) >= 3 and any_value(confidence < 0.6)",
    "win04_neighbour_padding": _WC + """, n as (select *, lag(e) over w as l, lead(s) over w as r from cw window w as (partition by chunk_id order by s, e, interval_id))
select interval_id, greatest(s - case when l is null then 120 else least(120, greatest(cast(floor((s - l) / 2) as bigint), 0)) end, cs) as padded_start, least(e + case when r is null then 120 else least(120, greatest(cast(floor((r - e) / 2) as bigint), 0)) end, ce) as padded_end from n""",
    "win05_midpoints": _W + """, m as (select *, cast(floor((e + lead(s) over w) / 2) as bigint) as mid from cw window w as (partition by chunk_id order by s, e, interval_id)),
n as (select *, coalesce(lag(mid) over (partition by chunk_id order by s, e, interval_id), s) as a, coalesce(mid, e) as b from m),
o as (select interval_id, max(a) over (partition by chunk_id order by s, e, interval_id rows unbounded preceding) as new_start, b from n) select interval_id, new_start, greatest(b, new_start) as new_end from o""",
    "win06_speaker_carry": r"""with l as (select distinct line_id, source_id, seq, raw_text, case when contains(raw_text, ':') and length(trim(split_part(raw_text, ':', 1))) between 1 and 40 and length(trim(regexp_extract(raw_text, '(?s)^[^:]*:(.*)$', 1))) > 0
    then trim(split_part(raw_text, ':', 1)) end as named from codeswitched_lines where seq is not null)
select line_id, last_value(named ignore nulls) over (partition by source_id order by seq, line_id rows unbounded preceding) as speaker, trim(case when named is null then raw_text else regexp_extract(raw_text, '(?s)^[^:]*:(.*)$', 1) end) as body from l""",
    "win07_end_carry": _W + " select interval_id, coalesce(last_value(case when emitted_word is not null then e end ignore nulls) over (partition by chunk_id order by s, e, interval_id rows unbounded preceding), 0) as last_end from cw",
    "win08_dilation": _W + " select interval_id, max(confidence) over (partition by chunk_id order by s, e, interval_id rows between 2 preceding and 2 following) as best from cw where confidence is not null and not isnan(confidence)",
    "win09_overlapping_windows": _W + ", p as (select chunk_id, row_number() over (partition by chunk_id order by s, e, interval_id) - 1 as place from cw), q as (select chunk_id, place, greatest(cast(floor((place - 1) / 28) as bigint), 0) as window_no from p) select chunk_id, window_no, count(*) as n, min(place - window_no * 28) as first, max(place - window_no * 28) as last from q group by all",
    "win10_tumbling": _W + " select source_id, s // 5120 as window_no, count(*) as n, cast(sum(e - s) as bigint) as ms from words group by all",
    "win11_levels": _FRAMES + ", g as (select vec_id, i // 16 as window_no, count(*) as n, avg((x / 4) * (x / 4)) as p from v group by all) select vec_id, window_no, round(greatest(-120, least(0, 20 * log10(greatest(sqrt(p), 1e-9)))), 6) as level_db from g where n = 16",
    "win12_quietest_window": _FRAMES + ", r as (select vec_id, i, round(x, 4) as x from v), g as (select vec_id, i, count(*) over w as n, avg(x * x) over w as p from r window w as (partition by vec_id order by i rows between current row and 7 following)) select vec_id, arg_min(i, (round(p, 9), i)) as window_start, round(min(p), 6) as least_power from g where n = 8 group by vec_id",
    "win13_phoneme_shares": _W + """, l as (select interval_id, s / 1000 as a, e / 1000 as b, length(emitted_word) as n, unnest(range(0, length(emitted_word))) as i from words where emitted_word is not null and emitted_word <> '')
select interval_id, i, cast(round(round(a + i * ((b - a) / n) + 1e-9, 3) * 1000) as bigint) as start_ms, cast(round(case when i = n - 1 then round(b, 3) else round(a + (i + 1) * ((b - a) / n) + 1e-9, 3) end * 1000) as bigint) as end_ms from l""",
    "win15_generated_ids": f"with {CHUNKS_SQL} select chunk_id, 'chunk_' || lpad(cast(row_number() over (partition by source_id order by chunk_index, chunk_id) as varchar), 4, '0') as generated from chunks",
    "int01_union_length": _W + """, r as (select *, max(e) over (partition by source_id order by s, e rows between unbounded preceding and 1 preceding) as reach from words)
select source_id, cast(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) as bigint) as union_ms, count(*) filter (reach is null or s > reach) as n_periods from r group by source_id""",
    "int02_neighbour_overlap": _W + ", n as (select chunk_id, greatest(e - lead(s) over (partition by chunk_id order by s, e, interval_id), 0) as shared from cw) select chunk_id, cast(coalesce(sum(shared), 0) as bigint) as shared_ms from n group by chunk_id",
    "int03_gap_filled": _WC + """, t as (select chunk_id, greatest(s - cs, 0) as a, least(e - cs, ce - cs) as b, coalesce(word, '') as word, ce - cs as total from cw where e > cs and s < ce),
r as (select *, max(b) over (partition by chunk_id order by a, b, word rows between unbounded preceding and 1 preceding) as reach from t), k as (select *, greatest(a, coalesce(reach, 0)) as f from r where b > greatest(a, coalesce(reach, 0)))
select chunk_id, f as xmin, b as xmax, word as text from k union all select chunk_id, coalesce(reach, 0), f, '' from k where f > coalesce(reach, 0) union all select chunk_id, max(b), max(total), '' from k group by chunk_id having max(total) > max(b)""",
    "int04_fused": _W + """, t as (select chunk_id, s, e, word, greatest(s - 40, 0) as a, e + 40 as b from cw where word is not null),
r as (select *, max(b) over (partition by chunk_id order by s, e, word rows between unbounded preceding and 1 preceding) as reach from t),
g as (select *, sum(case when reach is null or a >= reach then 1 else 0 end) over (partition by chunk_id order by s, e, word rows unbounded preceding) as k from r)
select chunk_id, min(a) as xmin, max(b) as xmax, string_agg(word, ' ' order by s, e, word) as text, count(*) as n from g group by chunk_id, k""",
    "int08_clips": _W + " select distinct interval_id, s * 16 as first_sample, e * 16 as last_sample from words where flagged = false",
    "int09_clip_padding": _WC + " select distinct interval_id, greatest(s - 50, cs) as a, greatest(least(e + 50, ce), greatest(s - 50, cs) + 1) as b from cw",
    "str01_sessions": """with e as (select user_id, event_id, epoch_us(ts) as t from events), l as (select *, t - lag(t) over (partition by user_id order by t, event_id) as gap from e),
s as (select *, sum(case when gap is null or gap > 1800000000 then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding) as session from l)
select user_id, cast(session as bigint) as session, count(*) as n, max(t) - min(t) as micros from s group by all""",
    "srt08_top_k": _FRAMES + " select vec_id, i as id, round(x, 5) as value from v qualify row_number() over (partition by vec_id order by x desc, i) <= 3",
    "srt09_argmax": "select vec_id, list_position(embedding, list_max(embedding)) - 1 as best from embeddings",
    "mth05_log_softmax": _FRAMES + " select vec_id, i, round(x - max(x) over w - ln(sum(exp(x - m)) over w), 5) as x from (select *, max(x) over (partition by vec_id) as m from v) window w as (partition by vec_id)",
    "mth08_soft_gate": _FRAMES + """, s as (select vec_id, label, i, x - m - ln(sum(exp(x - m)) over (partition by vec_id)) as lp from (select *, max(x) over (partition by vec_id) as m from v))
select vec_id, i, round(ln(greatest((label % 10 + 0.5) / 10 * exp(lp) + case when i = 0 then 1 - (label % 10 + 0.5) / 10 else 0 end, 1e-12)), 5) as x from s""",
    "aln19_greedy_decode": _BEST_RUNS + " select label, run, min(best) as id, min(vec_id) as first, count(*) as n from g where best <> 0 group by all",
    "aln21_peaks": _BEST_RUNS + " select label, run, vec_id, best from g qualify row_number() over (partition by label, run order by top desc, vec_id) = 1",
    "aln22_word_confidences": _BEST + ", g as (select *, sum(case when best = 1 then 1 else 0 end) over (partition by label order by vec_id rows unbounded preceding) as word_no from f) select label, cast(word_no as bigint) as word_no, round(avg(round(cast(top as double), 4)) + 1e-9, 4) as confidence, min(vec_id) as first, max(vec_id) as last from g where best <> 1 group by all",
}
