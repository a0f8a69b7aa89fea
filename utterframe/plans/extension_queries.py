"""Extension points and what composes other operators (UDF, SUP, SIG, GRF-03/04, ALN-14/17/24)."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterframe.functions import text as X
from utterframe.functions.maths import log_cost
from utterframe.functions.registry import add_noise, pcm_samples, register_functions, tiling
from utterframe.functions.tones import reconciled
from utterframe.operators.aggregates import conditional_probabilities
from utterframe.operators.alignment import align_syllables, edit_counts
from utterframe.operators.confusion import graph_components
from utterframe.operators.joins import symmetric
from utterframe.plans.common import CHUNKS_SQL, RECORDS_SQL, WORDS_SQL, chunks, records, words
from utterframe.plans.metric_queries import BIGRAMS_SQL, syllable_bigrams
from utterframe.plans.sequence_queries import grf02_components
from utterframe.session import spread, table


def udf01_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Edit operations of each split, from the table function in SQL."""
    register_functions(spark)
    r = records(spark, d).select("record_id", "split", "ref", "hyp").distinct()
    return spark.sql("select split, op, count(*) as n from {r}, lateral edit_ops(ref, hyp) group by split, op", r=r)


def udf02_errors_in_sql(spark: SparkSession, d: str) -> DataFrame:
    return udf01_sql_functions(spark, d).where("op <> 'match'").groupBy("split").agg(F.sum("n").alias("n_errors"))


def mth01_log_cost_of_words(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).where("confidence is not null and not isnan(confidence)")
    return w.select("interval_id", F.round(log_cost(F.col("confidence"), 1e-4) + 1e-9, 6).alias("cost")).distinct()


def mth10_half_even(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of words rounded to whole ones, halves to the even side."""
    w = words(spark, d).select("interval_id", F.bround(F.col("s") / 1000, 0).cast("bigint").alias("sec"))
    return w.distinct()


def mth07_sound_seed(spark: SparkSession, d: str) -> DataFrame:
    """A first matrix from the distance of sounds: exp(-d), normalised by source."""
    kind = {x: k for k, names in X.PHONEMES.items() for x in names}
    rows = [(a, b, 0.0 if a == b else 0.5 if kind[a] == kind[b] else 2.0 if "vowel" in (kind[a], kind[b]) else 1.0) for a in kind for b in kind]
    m = spark.createDataFrame(rows, "src string, tgt string, d double").withColumn("w", F.exp(-F.col("d")))
    return m.select("src", "tgt", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("src")), 6).alias("p"))


def flt04_decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    """Rates written with a decimal comma, read again; those above a tenth."""
    t = table(spark, d, "enrichment_records").select("record_id", F.replace(F.format_string("%.4f", "raw_cer"), F.lit("."), F.lit(",")).alias("x"), "raw_cer").where("raw_cer is not null and not isnan(raw_cer)")
    return t.where(F.replace("x", F.lit(","), F.lit(".")).cast("double") > 0.1).select("record_id", "x").distinct()


def srt01_ordered_steps(spark: SparkSession, d: str) -> DataFrame:
    """Releases by number, and the whole as the last one."""
    n = F.regexp_extract("dataset_name", r"-(\d+)$", 1).cast("int")
    r = table(spark, d, "packaging_manifest").select("dataset_name", n.alias("step")).distinct()
    return r.unionAll(spark.createDataFrame([("final", 2147483647)], "dataset_name string, step int")).withColumn("place", F.row_number().over(Window.orderBy("step", "dataset_name")).cast("bigint"))


def srt05_restored_order(spark: SparkSession, d: str) -> DataFrame:
    """Words of a chunk: their places by time, and by length."""
    w = words(spark, d).where("chunk_id is not null")
    place = lambda *o: F.row_number().over(Window.partitionBy("chunk_id").orderBy(*o)).cast("bigint")
    return w.select("interval_id", place("s", "e", "interval_id").alias("by_time"), place(F.col("e") - F.col("s"), "interval_id").alias("by_length"))


def srt15_vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    letters = syllable_bigrams(spark, d).select("src").distinct()
    # An alphabet.
    return letters.select(F.col("src").alias("token"), (F.row_number().over(Window.orderBy("src")) - 1).cast("bigint").alias("id"))


def jon09_words_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Words of the reference and of the hypothesis with the same place."""
    r = records(spark, d).select("record_id", "ref", "hyp").distinct()
    a = r.select("record_id", F.posexplode(F.split("ref", " ")).alias("place", "word"))
    b = r.select("record_id", F.posexplode(F.split("hyp", " ")).alias("place", "heard"))
    return a.join(b, ["record_id", "place"]).groupBy((F.col("word") == F.col("heard")).alias("same")).agg(F.count("*").alias("n"))


def jon12_pair_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of a syllable pair: its own where it is frequent, else the sum of its parts', else 10."""
    b = syllable_bigrams(spark, d)
    total = F.sum("n").over(Window.partitionBy("src"))
    own = b.withColumn("own", F.when(F.col("n") >= 5, -F.ln(F.col("n") / total)))
    part = b.groupBy(F.col("src").alias("part")).agg(F.sum("n").alias("k"))
    all_ = part.agg(F.sum("k").alias("all"))
    part = part.join(F.broadcast(all_)).select("part", (-F.ln(F.col("k") / F.col("all"))).alias("c"))
    out = own.join(part.select(F.col("part").alias("src"), F.col("c").alias("c1")), "src", "left").join(part.select(F.col("part").alias("tgt"), F.col("c").alias("c2")), "tgt", "left")
    return out.select("src", "tgt", F.round(F.coalesce("own", F.col("c1") + F.col("c2"), F.lit(10.0)) + 1e-9, 6).alias("cost"))


def aln14_syllable_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Emitted words covered by syllables of one or two letters, for distinct words only (ALN-15)."""
    pieces = {s: (chr(X.FIRST + i), 1.0) for i, s in reversed(list(enumerate(X.SYLLABLES)))}
    w = words(spark, d).where("emitted_word is not null").groupBy(F.lower("emitted_word").alias("word")).agg(F.count("*").alias("n"))

    def run(batches):
        for pdf in batches:
            found = [tiling(t, pieces, longest=3) for t in pdf["word"]]
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "syllables": [a for a, _ in found], "cost": [b for _, b in found]})

    return w.mapInPandas(run, "word string, n bigint, syllables string, cost double")


def aln17_reconciled_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of chunks with their syllables enriched by what was emitted."""
    sounds = {chr(X.FIRST + i): s for i, s in enumerate(X.SYLLABLES)}
    w = words(spark, d).where("word rlike '^[Ꭰ-Ᏼ]+$' and emitted_word is not null").groupBy("word", "emitted_word").agg(F.count("*").alias("n"))

    def run(batches):
        for pdf in batches:
            out = []
            for word, heard, n in pdf.itertuples(index=False):
                spans = align_syllables([(c, sounds.get(c, c), c in sounds) for c in word], heard)
                out.append((word, heard, n, reconciled([(c, heard[a:b]) for c, (a, b) in zip(word, spans)])))
            yield pd.DataFrame(out, columns=["word", "emitted_word", "n", "reconciled"])

    return spread(w, "word").mapInPandas(run, "word string, emitted_word string, n bigint, reconciled string")


def aln24_label_masks(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a text for forced alignment: each letter with its id and masks, words apart by 0."""
    r = records(spark, d).select("record_id", "ref").distinct()

    def run(batches):
        for pdf in batches:
            out = []
            for key, t in pdf.itertuples(index=False):
                ids = [0 if c == " " else ord(c) - 96 if c != "'" else 27 for c in t]
                out += [(key, i, k, bool(a), bool(b)) for i, (k, a, b) in enumerate(zip(ids, X.syncope_mask(t), X.intrusion_mask(t)))]
            yield pd.DataFrame(out, columns=["record_id", "place", "id", "skippable", "site"])

    return r.mapInPandas(run, "record_id string, place int, id int, skippable boolean, site boolean")


def grf03_block_order(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in the order of their components, with each component's range of places."""
    c = grf02_components(spark, d)
    # An alphabet.
    c = c.withColumn("place", F.row_number().over(Window.orderBy("component", "symbol")) - 1)
    w = Window.partitionBy("component")
    return c.select("symbol", "component", "place", F.min("place").over(w).alias("first"), F.max("place").over(w).alias("last"))


def grf04_components_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Number of components and largest diameter of each split's confusion graph (EM-04)."""
    counts = edit_counts(records(spark, d).where("split is not null"), ["split"], "ref", "hyp").where("src <> '' and tgt <> '' and src <> ' ' and tgt <> ' '").groupBy("split", "src", "tgt").agg(F.sum("n").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("split", "src")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        """One split's graph, of an alphabet."""
        q = {(a, b): v for a, b, v in pdf[["src", "tgt", "p"]].itertuples(index=False)}
        symbols = sorted({*pdf["src"], *pdf["tgt"]})
        edges = [(a, b) for a in symbols for b in symbols if a < b and (q.get((a, b), 0) + q.get((b, a), 0)) / 2 > 0.002]
        found = graph_components(edges, symbols)
        return pd.DataFrame({"split": [pdf["split"].iloc[0]], "n_symbols": [len(symbols)], "n_components": [len({c for _, c, _, _ in found})], "diameter": [max(x[3] for x in found)]})

    return p.groupBy("split").applyInPandas(group, "split string, n_symbols int, n_components int, diameter int")


def sig02_noisy_levels(spark: SparkSession, d: str) -> DataFrame:
    """Signal-to-noise ratio that vectors really have after noise was added at 10 dB, by colour."""
    def run(batches):
        for pdf in batches:
            out = []
            for key, x in zip(pdf["vec_id"], pdf["embedding"]):
                x = np.asarray(x, float)
                for colour in ("white", "pink"):
                    noise = add_noise(10.0, int(key), colour)(x) - x
                    out.append((key, colour, round(float(10 * np.log10(np.mean(x**2) / np.mean(noise**2))), 3)))
            yield pd.DataFrame(out, columns=["vec_id", "colour", "snr_db"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, colour string, snr_db double")


def str04_pcm_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as base64 payloads of 32-bit floats, decoded again."""
    def run(batches):
        for pdf in batches:
            back = [pcm_samples(base64.b64encode(np.asarray(x, "<f4").tobytes()).decode()) for x in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "n_samples": [len(b) for b in back], "first": [round(float(b[0]), 5) for b in back]})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, n_samples bigint, first double")


def int05_clamped_tier(spark: SparkSession, d: str) -> DataFrame:
    """Words clamped to their chunk, without those that vanish."""
    w = words(spark, d).where("chunk_id is not null").join(chunks(spark, d).select("chunk_id", "cs", "ce"), "chunk_id")
    a, b = F.greatest("s", "cs"), F.least("e", "ce")
    return w.where(b > a).select("interval_id", a.alias("xmin"), b.alias("xmax")).distinct()


def arr05_flattened_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Pauses of chunks, one list per recording flattened to a count and a sum."""
    c = table(spark, d, "audio_chunks").groupBy("chunk_id").agg(F.max(F.struct("ingested_at", "source_id", "pauses")).alias("c"))
    p = c.select("c.source_id", F.explode("c.pauses").alias("p")).where("p.end_sec > p.start_sec")
    return p.groupBy("source_id").agg(F.count("*").alias("n_pauses"), F.sum(F.round((F.col("p.end_sec") - F.col("p.start_sec")) * 1000 + 1e-6).cast("bigint")).alias("ms"))


def grf01_symmetric_cover(spark: SparkSession, d: str) -> DataFrame:
    """Mean symmetric probability of each syllable with the others (GRF-01 over the corpus)."""
    p = conditional_probabilities(syllable_bigrams(spark, d), "src", "tgt", "n").select("src", "tgt", "p")
    return symmetric(p, "src", "tgt", "p").groupBy("src").agg(F.round(F.avg("p") + 1e-12, 9).alias("mean"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    udf01_sql_functions, udf02_errors_in_sql, mth01_log_cost_of_words, mth10_half_even, mth07_sound_seed, flt04_decimal_comma, srt01_ordered_steps, srt05_restored_order, srt15_vocabulary_ids, jon09_words_by_place, jon12_pair_costs,
    aln14_syllable_tiling, aln17_reconciled_words, aln24_label_masks, grf03_block_order, grf04_components_by_split, sig02_noisy_levels, str04_pcm_payloads, int05_clamped_tier, arr05_flattened_pauses, grf01_symmetric_cover,
)}

_W, _R = f"with {WORDS_SQL}", f"with {RECORDS_SQL}"
SQL = {
    "udf02_errors_in_sql": _R + " select split, cast(sum(levenshtein(ref, hyp)) as bigint) as n_errors from (select distinct record_id, split, ref, hyp from records) group by split having sum(levenshtein(ref, hyp)) > 0",
    "mth01_log_cost_of_words": _W + " select distinct interval_id, round(greatest(0, least(1, ln(confidence + 1e-4) / ln(1e-4))) + 1e-9, 6) as cost from words where confidence is not null and not isnan(confidence)",
    "mth10_half_even": _W + " select distinct interval_id, cast(round_even(s / 1000, 0) as bigint) as sec from words",
    "flt04_decimal_comma": "select distinct record_id, replace(printf('%.4f', raw_cer), '.', ',') as x from enrichment_records where raw_cer is not null and not isnan(raw_cer) and cast(printf('%.4f', raw_cer) as double) > 0.1",
    "srt01_ordered_steps": "with r as (select distinct dataset_name, cast(regexp_extract(dataset_name, '-(\\d+)$', 1) as integer) as step from packaging_manifest union all select 'final', 2147483647) select *, row_number() over (order by step, dataset_name) as place from r",
    "srt05_restored_order": _W + " select interval_id, row_number() over (partition by chunk_id order by s, e, interval_id) as by_time, row_number() over (partition by chunk_id order by e - s, interval_id) as by_length from words where chunk_id is not null",
    "srt15_vocabulary_ids": BIGRAMS_SQL + " select src as token, row_number() over (order by src) - 1 as id from (select distinct src from bigrams)",
    "jon09_words_by_place": _R + """, r as (select distinct record_id, ref, hyp from records), a as (select record_id, unnest(range(0, len(string_split(ref, ' ')))) as place, unnest(string_split(ref, ' ')) as word from r), b as (select record_id, unnest(range(0, len(string_split(hyp, ' ')))) as place, unnest(string_split(hyp, ' ')) as heard from r)
select word = heard as same, count(*) as n from a join b using (record_id, place) group by 1""",
    "jon12_pair_costs": BIGRAMS_SQL + """, o as (select src, tgt, case when n >= 5 then -ln(n / sum(n) over (partition by src)) end as own from bigrams), p as (select src as part, -ln(sum(n) / (select sum(n) from bigrams)) as c from bigrams group by src)
select o.src, o.tgt, round(coalesce(own, a.c + b.c, 10.0) + 1e-9, 6) as cost from o left join p a on a.part = o.src left join p b on b.part = o.tgt""",
    "str04_pcm_payloads": "select vec_id, len(embedding) as n_samples, round(cast(embedding[1] as double), 5) as first from embeddings",
    "int05_clamped_tier": f"with {WORDS_SQL}, {CHUNKS_SQL} select distinct interval_id, greatest(s, cs) as xmin, least(e, ce) as xmax from words join chunks using (chunk_id) where least(e, ce) > greatest(s, cs)",
    "arr05_flattened_pauses": """with c as (select distinct on (chunk_id) source_id, pauses from audio_chunks order by chunk_id, ingested_at desc nulls last), p as (select source_id, unnest(pauses) as p from c)
select source_id, count(*) as n_pauses, cast(sum(cast(round((p.end_sec - p.start_sec) * 1000 + 1e-6) as bigint)) as bigint) as ms from p where p.end_sec > p.start_sec group by source_id""",
}
