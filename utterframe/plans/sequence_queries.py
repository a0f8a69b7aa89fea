"""Text functions and sequence alignment (TXT, FLT-14/15, ALN, GRF, EM, UDF)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.functions import text as X
from utterframe.operators.aggregates import conditional_probabilities, log_costs
from utterframe.operators.alignment import EditCosts, align_syllables, align_words, beam_search, edit_counts, edit_distances, force_align, frames_by_key, locate_chunks, merge_streams, with_edit_distance
from utterframe.operators.confusion import alphabet_components, estimate, label_propagation
from utterframe.operators.joins import symmetric
from utterframe.operators.sets import balanced_subset
from utterframe.plans.common import RECORDS_SQL, records, words
from utterframe.session import spread, table


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "syllabary_samples").select("sample_id", "syllabary_raw", "input_template", "gt_target").distinct()


def txt01_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))


def txt03_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean_transcription(F.col("text")).alias("text"))


def txt05_phonetics(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("sample_id", X.syllabary_to_phonetics(F.col("syllabary_raw")).alias("phonetics")).distinct()


def txt07_base_transliteration(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "enrichment_records").select("record_id", "syllabary_text").where("syllabary_text rlike '^[Ꭰ-Ᏼ ]+$'")
    return s.select("record_id", X.base_transliteration(F.col("syllabary_text")).alias("base")).distinct()


def txt08_glottals(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).where("input_template is not null").select("sample_id", X.standardize_glottals(F.col("input_template")).alias("text")).distinct()


def txt10_single_vowels(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", X.collapse_double_vowels(F.col("ref")).alias("text")).distinct()


def txt11_respelled(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "enrichment_records").select("record_id", "target_phonetics").distinct()
    return df.select("record_id", X.dg_to_tth(F.col("target_phonetics")).alias("text")).distinct()


def txt14_phonemes(spark: SparkSession, d: str) -> DataFrame:
    p = records(spark, d).select("record_id", F.inline(X.phonemes(F.col("ref")))).distinct()
    return p.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"), F.sum(F.col("end") - F.col("start")).alias("n_letters"))


def txt17_token_classes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "codeswitched_lines").distinct().select(F.explode("tokens").alias("t")).where("t.raw_token is not null")
    return t.groupBy(X.token_class(F.col("t.raw_token")).alias("right"), F.lower("t.token_type").alias("given")).agg(F.count("*").alias("n"))


def txt18_speakers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "codeswitched_lines").select("line_id", X.speaker_of(F.col("raw_text")).alias("speaker"), X.body_of(F.col("raw_text")).alias("body")).distinct()


def txt19_clitics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "codeswitched_lines").select(F.explode("tokens").alias("t")).select("t.raw_token").distinct()
    return t.select("raw_token", X.clitic_parts(F.col("raw_token")).alias("p")).where("p.stem <> ''").select("raw_token", "p.stem", "p.clitic")


def txt26_padded_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio_chunks").select("chunk_id", F.lpad(F.col("chunk_index").cast("string"), 6, "0").alias("number")).distinct()


def flt14_phonotactics(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", X.valid_phonotactics(F.col("ref")).alias("valid")).distinct()


def flt15_spelling(spark: SparkSession, d: str) -> DataFrame:
    v = records(spark, d).select("record_id", "ref").distinct().select("record_id", F.inline(X.spelling_violations(F.col("ref"))))
    return v.groupBy("letter").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))


def aln01_edit_operations(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each split by kind, from aligned letters."""
    ops = edit_counts(records(spark, d), ["split"], "ref", "hyp")
    count = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n"))), F.lit(0))
    return ops.groupBy("split").agg((count("substitute") + count("delete") + count("insert")).alias("n_errors"), (count("match") + count("substitute") + count("delete")).alias("n_ref"), (count("match") + count("substitute") + count("insert")).alias("n_hyp"))


def agg08_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Aligned letters of references and hypotheses; `<del>` and `<ins>` where one has none."""
    ops = edit_counts(records(spark, d), [], "ref", "hyp")
    return ops.select(F.when(F.col("src") == "", "<ins>").otherwise(F.col("src")).alias("src"), F.when(F.col("tgt") == "", "<del>").otherwise(F.col("tgt")).alias("tgt"), "n")


def agg12_confusion_percent(spark: SparkSession, d: str) -> DataFrame:
    c = agg08_confusions(spark, d)
    total = F.sum("n").over(Window.partitionBy("src"))
    return c.select("src", "tgt", "n", F.round(F.col("n") * 100 / F.greatest(total, F.lit(1)), 4).alias("pct"))


def aln03_distances(spark: SparkSession, d: str) -> DataFrame:
    """The plain edit distance from the batch kernel."""
    out = with_edit_distance(records(spark, d).select("record_id", "ref", "hyp").distinct(), "ref", "hyp", EditCosts())
    return out.select("record_id", F.col("distance").cast("bigint").alias("distance")).distinct()


def aln04_word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Word errors: words as single symbols of an alphabet of their own, then letter by letter."""
    df = records(spark, d).select("record_id", "ref", "hyp").distinct()

    def run(batches):
        for pdf in batches:
            code: dict[str, str] = {}
            as_letters = lambda t: "".join(code.setdefault(w, chr(0x4E00 + len(code)) if len(code) < 20000 else chr(0x20000 + len(code))) for w in t.split())
            a, b = [as_letters(t) for t in pdf["ref"]], [as_letters(t) for t in pdf["hyp"]]
            yield pd.DataFrame({"record_id": pdf["record_id"], "n_words": [len(x) for x in a], "n_errors": edit_distances(a, b).astype(int)})

    return df.mapInPandas(run, "record_id string, n_words bigint, n_errors bigint")


RELATED = {(a, b): w for group, w in (("aeiouv", 0.5), ("dt", 0.3), ("gk", 0.3)) for a in group for b in group if a != b}


def aln06_weighted_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance with cheap changes between related sounds, over the reference's length."""
    out = with_edit_distance(records(spark, d).select("record_id", "ref", "hyp").distinct(), "ref", "hyp", EditCosts(substitution=RELATED))
    return out.select("record_id", F.round(F.col("distance") / F.greatest(F.length("ref"), F.lit(1)), 6).alias("cost"))


def aln07_confusion_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance with costs from the corpus's own confusions."""
    counts = agg08_confusions(spark, d).where("src <> '<ins>' and tgt <> '<del>'")
    costs = log_costs(conditional_probabilities(counts, "src", "tgt", "n", 0.5), "src", "tgt", 1e-4, 5, 1.0)
    # One row per pair of letters of an alphabet.
    known = {(r.src, r.tgt): r.cost for r in costs.select("src", "tgt", "cost").collect() if r.src != r.tgt}
    out = with_edit_distance(records(spark, d).select("record_id", "ref", "hyp").distinct(), "ref", "hyp", EditCosts(substitution=known))
    return out.select("record_id", F.round("distance", 6).alias("distance"))


def aln10_word_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Words of the reference against words of the hypothesis, fused where that fits better."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, ref, hyp in pdf.itertuples(index=False):
                a, b = ref.split(), hyp.split()
                rows += [(key, k, " ".join(a[i : i + di]), " ".join(b[j : j + dj]), round(cost, 6)) for k, (i, j, di, dj, cost) in enumerate(align_words(a, b))]
            yield pd.DataFrame(rows, columns=["record_id", "place", "words", "tokens", "cost"])

    return spread(records(spark, d).select("record_id", "ref", "hyp").distinct(), "record_id").mapInPandas(run, "record_id string, place int, words string, tokens string, cost double")


def aln11_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """The records of a block of ten, in order, found again in their joined hypotheses."""
    df = records(spark, d).select("record_id", "ref", "hyp").distinct().withColumn("block", F.floor(F.regexp_extract("record_id", r"(\d+)$", 1).cast("bigint") / 10))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("record_id")
        found = locate_chunks(pdf["ref"].tolist(), " ".join(pdf["hyp"]).split())
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "record_id": pdf["record_id"].to_numpy(), "first": [a for a, _, _ in found], "last": [b for _, b, _ in found], "cost": [round(c, 4) for _, _, c in found]})

    return spread(df, "block").groupBy("block").applyInPandas(group, "block bigint, record_id string, first int, last int, cost double")


def aln16_syllable_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Stretch of the emitted text for each syllable."""
    sounds = {chr(X.FIRST + i): s for i, s in enumerate(X.SYLLABLES)}
    df = table(spark, d, "enrichment_records").select("record_id", "syllabary_text", "emitted_text").where("syllabary_text is not null and emitted_text is not null").distinct()

    def run(batches):
        for pdf in batches:
            rows = []
            for key, syllabary, emitted in pdf.itertuples(index=False):
                units = [(c, sounds.get(c, c), c in sounds) for c in syllabary]
                rows += [(key, k, u[0], emitted[a:b]) for k, (u, (a, b)) in enumerate(zip(units, align_syllables(units, emitted)))]
            yield pd.DataFrame(rows, columns=["record_id", "place", "syllable", "emitted"])

    return spread(df, "record_id").mapInPandas(run, "record_id string, place int, syllable string, emitted string")


_TONES = {"̀": "1", "́": "3"}


@F.pandas_udf(T.StringType())
def _merged(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        segments, tones = [], []
        for c in unicodedata.normalize("NFD", t):
            if c in _TONES and tones and tones[-1][0] == "V":
                tones[-1] = ("V", _TONES[c])
            elif not unicodedata.combining(c):
                kind = "V" if c in "aeiouv" else "|" if c == " " else "C"
                segments.append((kind, c))
                tones.append((kind, "2" if kind == "V" else c))
        out.append(merge_streams(segments, tones))
    return pd.Series(out, dtype=object)


def aln18_dual_streams(spark: SparkSession, d: str) -> DataFrame:
    """Letters and tones of the targets, taken apart and merged again into numbered tones."""
    s = table(spark, d, "enrichment_records").select("record_id", "target_phonetics").where("target_phonetics is not null").distinct()
    return spread(s, "record_id").select("record_id", _merged("target_phonetics").alias("toned"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in stretches of 50 as utterances, by label."""
    e = table(spark, d, "embeddings")
    return e.select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 50)).alias("utt"), "vec_id", "embedding")


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def aln20_beam_search(spark: SparkSession, d: str) -> DataFrame:
    def run(key, x):
        found = beam_search(_log_softmax(4 * x))
        return pd.DataFrame([(key, k + 1, " ".join(map(str, p)), round(s, 4)) for k, (p, s) in enumerate(found)], columns=["utt", "place", "ids", "score"])

    return frames_by_key(spread(_frames(spark, d), "utt"), "utt", "vec_id", "embedding", run, "utt string, place int, ids string, score double")


def aln23_forced_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a fixed label sequence in each utterance."""
    def run(key, x):
        labels = [1 + k % 5 for k in range(max(1, len(x) // 3))]
        score, at = force_align(_log_softmax(4 * x), labels, skippable=[k % 3 == 1 for k in range(len(labels))], intrusive=[6, 7], sites=[k % 4 == 2 for k in range(len(labels))])
        return pd.DataFrame([(key, k, c, t, round(score, 4)) for k, (c, t) in enumerate(zip(labels, at))], columns=["utt", "place", "id", "frame", "score"])

    return frames_by_key(_frames(spark, d), "utt", "vec_id", "embedding", run, "utt string, place int, id int, frame int, score double")


def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(source, target): the aligned words of every record; fused ones are joined as the alignment
    compares them, and words left over meet the empty text."""
    joined = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return aln10_word_alignment(spark, d).select(joined(F.col("words")).alias("source"), joined(F.col("tokens")).alias("target"))


def em01_confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Substitution probabilities of the hypotheses' words, estimated over four rounds."""
    rows, _ = estimate(word_pairs(spark, d), "source", "target")
    return spark.createDataFrame([(s, t, round(p, 6)) for s, t, p in rows], "source string, target string, p double")


def grf02_components(spark: SparkSession, d: str) -> DataFrame:
    """Letters whose mutual confusion, apart from the diagonal, exceeds 0.2 percent."""
    counts = agg08_confusions(spark, d).where("src <> '<ins>' and tgt <> '<del>' and src <> ' ' and tgt <> ' '")
    p = conditional_probabilities(counts, "src", "tgt", "n").select("src", "tgt", "p")
    return alphabet_components(symmetric(p, "src", "tgt", "p"), "src", "tgt", "p", 0.002)


def grf05_checksum_groups(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a release that are one file, through a checksum or a path that they share."""
    a = table(spark, d, "packaged_audio").where("sha256 is not null").select(F.concat_ws("|", F.lit("p"), "dataset_name", "target_rel_path").alias("a"), F.concat_ws("|", F.lit("s"), "dataset_name", F.lower("sha256")).alias("b")).distinct()
    return label_propagation(a, "a", "b").groupBy("label").agg(F.count("*").alias("n")).where("n > 2")


def set09_balanced_words(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred words whose syllables are spread evenly, at most two of one first syllable."""
    w = words(spark, d).select("word").where("word rlike '^[Ꭰ-Ᏼ]+$'").distinct()
    return balanced_subset(w.select("word", F.substring("word", 1, 1).alias("lemma"), F.split("word", "").alias("parts")), "word", "lemma", "parts", 200)


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("txt", "flt", "aln", "agg", "em0", "grf", "set") and callable(f) and re.match(r"(txt|flt|aln|agg|grf|set)\d\d_|em01_", n)}

_R = f"with {RECORDS_SQL}"
_MAP = "map {" + ", ".join(f"'{chr(X.FIRST + i)}': '{s}'" for i, s in enumerate(X.SYLLABLES)) + "}"
_TRANSLIT = f"array_to_string(list_transform(string_split(@, ''), lambda c: coalesce({_MAP}[c], c)), '')"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_PHONEMES = "(" + X.PHONEME_PATTERN.replace("'", "''") + ")"
_CATS = "case " + " ".join("when s in (" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + f") then '{k}'" for k, v in X.PHONEMES.items()) + " else 'other' end"

SQL = {
    "txt01_normalized": f"""select doc_id, trim(regexp_replace(regexp_replace(translate(lower(nfc_normalize(text)), '’‘ʼʻ`´‛', repeat('''', 7)), '[,?.!;:"“%”\\\\()\\[\\]{{}}«»…-]', '', 'g'), '{_SPACE}+', ' ', 'g')) as text from documents""",
    "txt03_cleaned": f"""select doc_id, lower(trim(regexp_replace(regexp_replace(text, '[\\[\\]"().\\x{{0f7b}}_|》?!/,<…>*-]', ' ', 'g'), '{_SPACE}+', ' ', 'g'))) as text from documents""",
    "txt05_phonetics": f"""with t as (select distinct sample_id, {_TRANSLIT.replace('@', 'upper(syllabary_raw)')} as p from syllabary_samples)
select distinct sample_id, regexp_replace(regexp_replace(regexp_replace(p, '([^ht\\s\\x{{0b}}\\x{{85}}\\p{{Z}}])s', '\\1hs', 'g'), '([aeiouvAEIOUV])([aeiouvAEIOUV])', '\\1''\\2', 'g'), '([aeiouvAEIOUV])([aeiouvAEIOUV])', '\\1''\\2', 'g') as phonetics from t""",
    "txt07_base_transliteration": f"select distinct record_id, {_TRANSLIT.replace('@', 'syllabary_text')} as base from enrichment_records where regexp_full_match(syllabary_text, '[Ꭰ-Ᏼ ]+')",
    "txt08_glottals": r"""with t as (select distinct sample_id, regexp_replace(input_template, '[’‘ʼʻ`ʔ‚?'']+', '''', 'g') as x from syllabary_samples where input_template is not null)
select distinct sample_id, regexp_replace(regexp_replace(x, '([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])''', '\1', 'g'), '(^|[ \t\n\x{0b}\f\r])''([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])', '\1\2', 'g') as text from t""",
    "aln04_word_errors": _R + """, w as (select distinct record_id, list_filter(string_split(ref, ' '), lambda x: x <> '') as a, list_filter(string_split(hyp, ' '), lambda x: x <> '') as b from records),
u as (select record_id, a, b, list_distinct(list_concat(a, b)) as u from w)
select record_id, len(a) as n_words, levenshtein(array_to_string(list_transform(a, lambda x: chr(cast(32 + list_position(u, x) as integer))), ''), array_to_string(list_transform(b, lambda x: chr(cast(32 + list_position(u, x) as integer))), '')) as n_errors from u""",
    "txt10_single_vowels": _R + " select distinct record_id, " + "regexp_replace(" * 6 + "ref" + "".join(f", '{v}{v}+', '{v}', 'g')" for v in X.VOWELS) + " as text from records",
    "txt14_phonemes": _R + f""", p as (select record_id, unnest(regexp_extract_all(ref, '{_PHONEMES}')) as s, unnest(range(0, len(regexp_extract_all(ref, '{_PHONEMES}')))) as i from (select distinct record_id, ref from records))
select {_CATS} as category, count(*) as n, count(distinct s) as n_symbols, cast(sum(length(s)) as bigint) as n_letters from p group by 1""",
    "txt17_token_classes": """with t as (select unnest(tokens) as t from (select distinct * from codeswitched_lines)), r as (select t.raw_token as x, lower(t.token_type) as given from t where t.raw_token is not null)
select case when regexp_matches(x, '[Ꭰ-ᏽꭰ-ꮿ]') and regexp_matches(x, '[A-Za-z]') then 'compound_clitic' when regexp_matches(x, '[Ꭰ-ᏽꭰ-ꮿ]') then 'cherokee_syllabary' when regexp_matches(x, '[A-Za-z]') then 'english' else 'punctuation' end as "right", given, count(*) as n from r group by all""",
    "txt18_speakers": r"""with l as (select distinct line_id, raw_text, contains(raw_text, ':') and length(trim(split_part(raw_text, ':', 1))) between 1 and 40 and length(trim(regexp_extract(raw_text, '(?s)^[^:]*:(.*)$', 1))) > 0 as named from codeswitched_lines)
select line_id, case when named then trim(split_part(raw_text, ':', 1)) end as speaker, case when named then trim(regexp_extract(raw_text, '(?s)^[^:]*:(.*)$', 1)) else raw_text end as body from l""",
    "txt19_clitics": "select distinct t.raw_token as raw_token, regexp_extract(t.raw_token, '^([A-Za-z'']+)[Ꭰ-ᏽꭰ-ꮿ]+$', 1) as stem, regexp_extract(t.raw_token, '^[A-Za-z'']+([Ꭰ-ᏽꭰ-ꮿ]+)$', 1) as clitic from (select unnest(tokens) as t from codeswitched_lines) where regexp_extract(t.raw_token, '^([A-Za-z'']+)[Ꭰ-ᏽꭰ-ꮿ]+$', 1) <> ''",
    "txt26_padded_numbers": "select distinct chunk_id, lpad(cast(chunk_index as varchar), 6, '0') as number from audio_chunks",
    "flt15_spelling": _R + """, l as (select record_id, ref, unnest(range(1, length(ref) + 1)) as i from (select distinct record_id, ref from records)), c as (select record_id, substring(ref, i, 1) as letter, case when i > 1 then substring(ref, i - 1, 1) else ' ' end as before from l)
select letter, count(*) as n, count(distinct record_id) as n_records from c where letter in ('d', 'g', 'c') or letter = 's' and before not in ('h', 't', ' ') group by letter""",
    "aln01_edit_operations": _R + " select split, cast(sum(levenshtein(ref, hyp)) as bigint) as n_errors, cast(sum(length(ref)) as bigint) as n_ref, cast(sum(length(hyp)) as bigint) as n_hyp from records group by split",
    "aln03_distances": _R + " select distinct record_id, levenshtein(ref, hyp) as distance from records",
    "grf05_checksum_groups": """with f as (select dataset_name, target_rel_path, min(lower(sha256)) as sha, count(distinct lower(sha256)) as k from packaged_audio where sha256 is not null group by all)
select min(concat_ws('|', 'p', dataset_name, target_rel_path)) as label, count(*) + 1 as n from f group by dataset_name, sha having count(*) > 1""",
}
