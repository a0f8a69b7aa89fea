"""Records of evaluation splits that are, exactly or nearly, in the training split too.

Texts are compared as classes of equal texts: minwise hashes of character shingles are banded into
buckets, only a training and an evaluation class in the same bucket become a candidate, candidates
are verified by the edit distance and by their exact Jaccard similarity (against the least one that
the allowed edit distance leaves possible, so that nothing is lost), and the confirmed classes are
expanded to samples at the end. Copies of a text, however many, are one class until then; no bucket
is cut short.

The first text that both samples have is compared: syllabary_raw, else gt_target. That makes three
pairings which share no pair: both with syllabary_raw; an evaluation sample without it and any
training sample; a training sample without it and an evaluation sample with it. In each the side
that is smaller by nature is signed first. A bitmap of its keys, of at most MAX_BITS bits however
many there are, is sent to all tasks, and a key of the other side is shuffled only if its bit is set.

All joins are merge joins: tables that look small in a shuffle are many times larger as a hash table
in the driver. Buckets and texts that many rows share are split by adaptive execution.

Shingles are single characters of the syllabary in pairs, of the phonetic text in threes: with an
edit distance of 0.15 nearly equal sentences share few whole words, so word shingles would miss
them. That distance may leave a Jaccard similarity of 0.54 of pairs (a pair then meets with a chance
of 0.988 or more: 50 bands of 4) and of 0.38 of threes (0.989: 80 bands of 3).

Defined results: null splits, samples without any text and texts of fewer than `min_words` words
pair with nothing; equal rows count once; a sample with several versions is compared in each; a
pair is listed once, the smaller id first; no sample pairs with itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.llm.characters import phonetic_form, syllabary_form
from utterframe.session import table, written

MAX_EDIT = 0.15
MIN_WORDS = 4
#: Per text field: characters a shingle, bands, hashes a band.
SHINGLES = {"s": (2, 50, 4), "g": (3, 80, 3)}
CHUNK = 100_000
#: Largest length that is told apart in a text's number.
LONGEST = 0xFFFF
#: Bits of a bitmap of keys: so many a key, within these bounds (the larger one is 16 MB).
BITS_A_KEY, MIN_BITS, MAX_BITS, SEGMENT = 16, 1 << 17, 1 << 27, 1 << 14
#: Pairs of a training and an evaluation sample by the text they are compared in: field, the side
#: that is signed first, and what holds for the rows of that side and of the other.
PAIRINGS = (("s", "e", "s is not null", "s is not null"), ("g", "e", "s is null and g is not null", "g is not null"), ("g", "t", "s is null and g is not null", "s is not null and g is not null"))


def split_side(split: Column) -> Column:
    """'t' training, 'e' evaluation; null for anything else."""
    s = F.lower(F.trim(split))
    return F.when(s.isin("train", "training", "tr"), "t").when(s.isin("valid", "validation", "val", "dev", "eval", "evaluation", "test", "testing"), "e")


def _plain(text: str) -> str:
    kept = "".join(c if c.isalnum() or c in "ʔ" or "̀" <= c <= "ͯ" else " " if c.isspace() else "" for c in text.lower())
    return " ".join(kept.split())


@F.pandas_udf(T.StructType([T.StructField("s", T.StringType()), T.StructField("g", T.StringType())]))
def _forms(pairs: pd.DataFrame) -> pd.DataFrame:
    s = [_plain(syllabary_form(v)) or None if v is not None else None for v in pairs["syllabary_raw"]]
    g = [_plain(phonetic_form(v)) or None if v is not None else None for v in pairs["gt_target"]]
    return pd.DataFrame({"s": s, "g": g}, dtype=object)


#: Not to be moved below the step that makes rows distinct, where it would run for every copy.
_compared = _forms.asNondeterministic()


def prepared(samples: DataFrame) -> DataFrame:
    """(sample_id, split, source, side, s, g) with the texts as they are compared, written once."""
    rows = samples.select("sample_id", "split", "source", split_side(F.col("split")).alias("side"), "syllabary_raw", "gt_target")
    rows = rows.where("side is not null and sample_id is not null and coalesce(syllabary_raw, gt_target) is not null").distinct()
    rows = rows.withColumn("t", _compared(F.struct("syllabary_raw", "gt_target")))
    return written(rows.select("sample_id", "split", "source", "side", "t.s", "t.g").where("coalesce(s, g) is not null"))


class Minwise:
    """Bucket keys of texts under banded minwise hashes of their character shingles."""

    def __init__(self, shingle: int, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shingle, self.bands, self.rows = shingle, bands, rows
        self.a = rng.integers(1, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All shingles of the texts, one after the other, and how many each text has; a text shorter
        than a shingle is one. Repeated ones stay, as they change no minimum."""
        q = self.shingle
        size = np.array([max(len(t), q) for t in texts])
        flat = np.frombuffer("".join(t.ljust(q) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        value = flat[: len(flat) - q + 1].copy()
        for i in range(1, q):
            value = value << np.uint64(21) | flat[i : len(flat) - q + 1 + i]
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        return value[left[: len(value)] >= q], size - q + 1

    def keys(self, texts: list[str]) -> np.ndarray:
        """(text, band): one 64-bit key; texts with equal minima of a band have equal keys."""
        value, count = self.shingles(texts)
        distinct, inverse = np.unique(value, return_inverse=True)
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        with np.errstate(over="ignore"):
            x = distinct * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x = (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
            hashed = x[:, None] * self.a + self.b
            # The longest texts come first, so those that reach a place stand together.
            low = np.full((len(texts), len(self.a)), 0xFFFFFFFF, np.uint32)
            reach = np.searchsorted(-count, -np.arange(count[0]), "left")
            for place, n in enumerate(reach.tolist()):
                np.minimum(low[:n], hashed[inverse[first[:n] + place]], out=low[:n])
            out = np.empty_like(low)
            out[order] = low
            band = (out.reshape(-1, self.bands, self.rows).astype(np.uint64) + np.uint64(1)) * self.mix
            key = np.bitwise_xor.reduce(band ^ (band >> np.uint64(31)), axis=2)
            key = key * np.uint64(0xD6E8FEB86659FD93) + np.arange(self.bands, dtype=np.uint64)
        return (key ^ key >> np.uint64(32)).astype(np.int64)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each key; the bits' number is a power of two."""
    return (keys.astype(np.uint64) >> np.uint64(7)) & np.uint64(bits - 1)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about CHUNK characters, which bound the memory of their hashes."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _signed(field: str, allowed, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    minwise = Minwise(*SHINGLES[field])
    bitmap = np.frombuffer(allowed.value, np.uint8) if allowed is not None else None
    for pdf in batches:
        texts, tids = pdf["text"].tolist(), pdf["tid"].to_numpy()
        for lo, hi in _chunks(texts):
            keys = minwise.keys(texts[lo:hi])
            tid, keys = np.repeat(tids[lo:hi], keys.shape[1]), keys.ravel()
            if bitmap is not None:
                place = _places(keys, 8 * len(bitmap))
                fine = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                tid, keys = tid[fine], keys[fine]
            yield pd.DataFrame({"tid": tid, "key": keys})


def _bits(field: str, bits: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The set segments of a bitmap of one task's keys."""
    minwise, flags = Minwise(*SHINGLES[field]), np.zeros(bits // 8, np.uint8)
    for pdf in batches:
        texts = pdf["text"].tolist()
        for lo, hi in _chunks(texts):
            place = np.unique(_places(minwise.keys(texts[lo:hi]).ravel(), bits))
            np.bitwise_or.at(flags, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    parts = flags.reshape(-1, SEGMENT)
    for i in np.flatnonzero(parts.any(axis=1)):
        yield pd.DataFrame({"segment": [i], "flags": [parts[i].tobytes()]})


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments that stand next to each other in a sorted partition, merged."""
    at, held = None, None
    for pdf in batches:
        for segment, flags in zip(pdf["segment"], pdf["flags"]):
            part = np.frombuffer(flags, np.uint8)
            if segment == at:
                held = held | part
                continue
            if at is not None:
                yield pd.DataFrame({"segment": [at], "flags": [held.tobytes()]})
            at, held = segment, part
    if at is not None:
        yield pd.DataFrame({"segment": [at], "flags": [held.tobytes()]})


def key_bitmap(texts: DataFrame, field: str) -> bytes:
    """A bitmap of the keys of the column `text`, for tests of other keys against it.

    Its size follows the number of texts up to MAX_BITS; beyond, more keys of the other side pass,
    which costs time and changes no row. It is merged by segments before the driver puts it together.
    """
    bits = MIN_BITS
    while bits < min(MAX_BITS, texts.count() * SHINGLES[field][1] * BITS_A_KEY):
        bits *= 2
    schema = "segment int, flags binary"
    parts = texts.select("text").mapInPandas(lambda b: _bits(field, bits, b), schema)
    parts = parts.repartition("segment").sortWithinPartitions("segment").mapInPandas(_merged, schema)
    out = bytearray(bits // 8)
    for row in parts.toLocalIterator():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = row.flags
    return bytes(out)


def classes(rows: DataFrame, field: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(text, tid): the distinct texts of a field, with a number each.

    The length rides in the low bits of the number, so that a bucket's pairs can be told apart by it
    before their texts are fetched. Texts that share a number only cost a comparison more.
    """
    length = F.least(F.length("text"), F.lit(LONGEST)).cast("long")
    texts = rows.where(F.size(F.split(field, " ")) >= min_words).select(F.col(field).alias("text")).distinct()
    return texts.withColumn("tid", F.shiftleft(F.xxhash64("text"), 16).bitwiseOR(length))


def candidates(a: DataFrame, b: DataFrame, field: str, max_edit: float = MAX_EDIT) -> DataFrame:
    """Distinct (a_tid, b_tid) of different texts of two sides that share a bucket and whose lengths
    an allowed edit distance can bridge. `a` is the side that is signed first."""
    sent = a.sparkSession.sparkContext.broadcast(key_bitmap(a, field))

    def side(texts: DataFrame, name: str, allowed) -> DataFrame:
        return texts.select("text", "tid").mapInPandas(lambda rows: _signed(field, allowed, rows), "tid bigint, key bigint").withColumnRenamed("tid", name)

    p, q = F.col("a_tid").bitwiseAND(F.lit(LONGEST)), F.col("b_tid").bitwiseAND(F.lit(LONGEST))
    fits = (F.abs(p - q) <= F.floor(F.greatest(p, q) * max_edit + 1e-9)) | (F.greatest(p, q) == LONGEST)
    pairs = side(a, "a_tid", None).hint("merge").join(side(b, "b_tid", sent).hint("merge"), "key")
    return pairs.where(fits & (F.col("a_tid") != F.col("b_tid"))).select("a_tid", "b_tid").distinct()


def _shingle_set(text: str, q: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(q))))


def near_classes(a: DataFrame, b: DataFrame, field: str, max_edit: float = MAX_EDIT) -> DataFrame:
    """(a_text, b_text, distance, jaccard) of texts of two sides that are nearly, or exactly, the same."""
    text = lambda found, x: found.select(F.col("tid").alias(f"{x}_tid"), F.col("text").alias(f"{x}_text")).hint("merge")
    pairs = candidates(a, b, field, max_edit).join(text(a, "a"), "a_tid").join(text(b, "b"), "b_tid").select("a_text", "b_text")
    q = SHINGLES[field][0]
    pairs = pairs.withColumn("k", F.floor(F.greatest(F.length("a_text"), F.length("b_text")) * max_edit + 1e-9).cast("int"))
    pairs = pairs.where(F.abs(F.length("a_text") - F.length("b_text")) <= F.col("k"))
    # The banded distance (-1: beyond k) is far cheaper than the shingle sets. These stand under a
    # condition, as the optimizer would compute them for every candidate otherwise.
    sa, sb = _shingle_set("a_text", q), _shingle_set("b_text", q)
    counts = F.struct(F.size(F.array_intersect(sa, sb)).alias("shared"), F.size(sa).alias("na"), F.size(sb).alias("nb"))
    pairs = pairs.withColumn("distance", F.expr("levenshtein(a_text, b_text, k)"))
    pairs = pairs.withColumn("c", F.when(F.col("distance") >= 0, counts)).where("c is not null")
    pairs = pairs.where(F.col("c.shared") >= F.greatest("c.na", "c.nb") - q * F.col("k"))
    near = pairs.select("a_text", "b_text", "distance", (F.col("c.shared") / (F.col("c.na") + F.col("c.nb") - F.col("c.shared"))).alias("jaccard"))
    same = a.select("text").hint("merge").join(b.select("text").hint("merge"), "text")
    return near.unionAll(same.select(F.col("text").alias("a_text"), F.col("text").alias("b_text"), F.lit(0).alias("distance"), F.lit(1.0).alias("jaccard")))


def _sides(rows: DataFrame, first: str, where_a: str, where_b: str) -> tuple[DataFrame, DataFrame]:
    return rows.where(where_a).where(F.col("side") == first), rows.where(where_b).where(F.col("side") != first)


def class_pairs(rows: DataFrame, max_edit: float = MAX_EDIT, min_words: int = MIN_WORDS) -> DataFrame:
    """(pairing, e_text, t_text, distance, jaccard): linked classes of an evaluation and a training
    text. With the samples that hold each text this is the whole result, without copies by copies."""
    out = None
    for i, (field, first, where_a, where_b) in enumerate(PAIRINGS):
        a, b = (classes(x, field, min_words) for x in _sides(rows, first, where_a, where_b))
        near = near_classes(a, b, field, max_edit)
        e, t = ("a_text", "b_text") if first == "e" else ("b_text", "a_text")
        near = near.select(F.lit(i).alias("pairing"), F.col(e).alias("e_text"), F.col(t).alias("t_text"), "distance", "jaccard")
        out = near if out is None else out.unionAll(near)
    return out


def _members(rows: DataFrame, side: str) -> DataFrame:
    """(pairing, text, rest of the row) of one side's samples in each pairing that they take part in."""
    take = [F.when(F.expr(where_a if first == side else where_b), F.struct(F.lit(i).alias("pairing"), F.col(field).alias(f"{side}_text"))) for i, (field, first, where_a, where_b) in enumerate(PAIRINGS)]
    return rows.where(F.col("side") == side).select("*", F.inline(F.filter(F.array(*take), lambda x: x.isNotNull()))).drop("side", "s", "g")


def overlapping(rows: DataFrame, max_edit: float = MAX_EDIT, min_words: int = MIN_WORDS) -> DataFrame:
    """(e_id, t_id, distance, jaccard): linked samples; rows of one pair in several versions stay."""
    member = lambda x: _members(rows.select("sample_id", "side", "s", "g"), x).withColumnRenamed("sample_id", f"{x}_id").distinct().hint("merge")
    pairs = class_pairs(rows, max_edit, min_words).join(member("e"), ["pairing", "e_text"]).join(member("t"), ["pairing", "t_text"])
    return pairs.where("e_id <> t_id").select("e_id", "t_id", "distance", "jaccard")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of samples, one in training and one in evaluation, with (nearly) the same text."""
    pairs = overlapping(prepared(table(spark, sf_dir, "syllabary_samples")))
    return pairs.select(F.least("e_id", "t_id").alias("sample_lo"), F.greatest("e_id", "t_id").alias("sample_hi")).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked texts with the number of samples that hold each: the links without copies by copies."""
    rows = prepared(table(spark, sf_dir, "syllabary_samples"))
    held = lambda x: _members(rows.select("sample_id", "side", "s", "g"), x).groupBy("pairing", f"{x}_text").agg(F.countDistinct("sample_id").alias(f"n_{x}")).hint("merge")
    out = class_pairs(rows).join(held("e"), ["pairing", "e_text"]).join(held("t"), ["pairing", "t_text"])
    return out.select("e_text", "t_text", "distance", "jaccard", F.col("n_e").alias("n_evaluation"), F.col("n_t").alias("n_training"), F.element_at(F.array(*[F.lit(p[0]) for p in PAIRINGS]), F.col("pairing") + 1).alias("field"))


def overlap_counts(rows: DataFrame, max_edit: float = MAX_EDIT, min_words: int = MIN_WORDS) -> DataFrame:
    """(e_id, n, same): partners of each evaluation sample, and those with an equal text.

    A sample with one version has one text in each pairing, so its partners are the sum of the
    members of linked classes and no pair is listed. Only pairs with a sample of several versions
    could be counted twice; those are listed and made distinct.
    """
    rows = rows.select("sample_id", "side", "s", "g").distinct()
    several = rows.groupBy("sample_id").agg((F.count("*") > 1).alias("several"))
    rows = written(rows.join(several.hint("merge"), "sample_id"))
    near = written(class_pairs(rows, max_edit, min_words))
    e, t = _members(rows, "e").withColumnRenamed("sample_id", "e_id"), _members(rows, "t").withColumnRenamed("sample_id", "t_id")
    same = F.col("distance") == 0
    held = t.where("not several").groupBy("pairing", "t_text").agg(F.count("*").alias("n_t"))
    by_class = near.join(held.hint("merge"), ["pairing", "t_text"]).groupBy("pairing", "e_text").agg(F.sum("n_t").alias("n"), F.sum(F.when(same, F.col("n_t")).otherwise(0)).alias("same"))
    single = e.where("not several").join(by_class.hint("merge"), ["pairing", "e_text"]).select("e_id", "n", "same")
    left, right = e.withColumnRenamed("several", "e_several"), t.withColumnRenamed("several", "t_several")
    listed = lambda a, b: near.join(a.hint("merge"), ["pairing", "e_text"]).join(b.hint("merge"), ["pairing", "t_text"]).where("e_id <> t_id").select("e_id", "t_id", "distance")
    doubtful = listed(left.where("e_several"), right).unionAll(listed(left.where("not e_several"), right.where("t_several")))
    doubtful = doubtful.groupBy("e_id", "t_id").agg(F.min("distance").alias("distance")).groupBy("e_id").agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("same"))
    return single.unionAll(doubtful).groupBy("e_id").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: samples, those found in training, pairs, exact pairs."""
    rows = prepared(table(spark, sf_dir, "syllabary_samples"))
    pairs = overlap_counts(rows)
    named = F.when(F.lower(F.trim("split")).isin("test", "testing"), "test").otherwise("validation")
    samples = rows.where("side = 'e'").select(F.col("sample_id").alias("e_id"), named.alias("split"), "source").distinct()
    return samples.join(pairs.hint("merge"), "e_id", "left").groupBy("split", "source").agg(
        F.countDistinct("e_id").alias("n_samples"),
        F.countDistinct(F.when(F.col("n").isNotNull(), F.col("e_id"))).alias("n_overlapping"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("n_equal_pairs"),
    )


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_classes": p5_classes}
SQL: dict[str, str] = {}
