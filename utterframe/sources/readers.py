"""Readers for the formats in which transcripts, manifests and annotations come."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators, and names of columns and keys in the order in which they are tried.
SEPARATORS = (",", "\t", ";", "|")
TEXT_KEYS = ("phonetic", "raw_phonetic", "reference_sentence", "cherokee", "syllabary", "raw_text", "text")
ID_KEYS = ("chunk_id", "line_id", "verse_id", "id")
AUDIO = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, by the first separator that gives at least two columns.

    Only the first line is looked at on the driver; a byte order mark is dropped.
    """
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0].lstrip("﻿") if first else ""
    sep = next((s for s in SEPARATORS if s in head), ",")
    df = spark.read.csv(path, sep=sep, header=True)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def pick_column(df: DataFrame, names: Sequence[str], given: str | None = None) -> str:
    """The column that is given, or the first of the names, in any letter case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    for name in [given] if given else names:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise ValueError(f"none of {list(names)} among {df.columns}")


def _from_map(entry: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.element_at(entry, k), F.lit("")) for k in keys])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(seq, chunk_id, text, meta) of a JSON object or list: texts by id, objects by id, a list of
    objects or of bare texts, or any of these under `entries`. Ids that are missing are made from the
    place."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    raw = raw.select(F.coalesce(F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.entries")), F.col("v")).alias("v"))
    flat = T.MapType(T.StringType(), T.StringType())
    listed = F.transform(F.from_json("v", T.ArrayType(T.StringType())), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    keyed = F.transform(F.map_entries(F.from_json("v", flat)), lambda e: F.struct(e.key.alias("key"), e.value.alias("value")))
    rows = raw.select(F.posexplode(F.when(F.col("v").startswith("["), listed).otherwise(keyed)).alias("seq", "e"))
    rows = rows.select("seq", "e.key", "e.value", F.when(F.col("e.value").startswith("{"), F.from_json("e.value", flat)).alias("meta"))
    text = F.when(F.col("meta").isNotNull(), _from_map(F.col("meta"), TEXT_KEYS)).otherwise(F.col("value"))
    made = F.lpad((F.col("seq") + 1).cast("string"), 6, "0")
    return rows.select("seq", F.coalesce("key", _from_map(F.col("meta"), ID_KEYS), made).alias("chunk_id"), text.alias("text"), "meta")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, verse_id, cherokee, phonetic, english, text) of a transcript table, with or without a header.

    Without one, columns are told by their number: one is a text, numbered by its line; of more, the
    first is the id and the others are the text in the syllabary, in letters and in English.
    """
    names = ("cherokee", "phonetic", "english", "text")
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0].lstrip("\ufeff").lower() if head else ""
    sep = "\t" if "\t" in first else ","
    if any(n in [c.strip().strip('"') for c in first.split(sep)] for n in (*ID_KEYS, *names)):
        df = read_table(spark, path)
        have = {c.lower(): c for c in df.columns}
        column = lambda *keys: next((F.col(have[k]) for k in keys if k in have), F.lit(None).cast("string"))
        return df.select(F.input_file_name().alias("file"), column(*ID_KEYS).alias("verse_id"), *[column(n).alias(n) for n in names])
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("seq", "line"))
    cells = F.from_csv("line", "a string, b string, c string, d string", {"sep": sep})
    rows = lines.where(F.trim("line") != "").select("file", "seq", cells.alias("x"))
    alone = F.col("x.b").isNull()
    verse = F.when(alone, F.lpad((F.col("seq") + 1).cast("string"), 6, "0")).otherwise(F.col("x.a"))
    return rows.select("file", verse.alias("verse_id"), F.col("x.b").alias("cherokee"), F.col("x.c").alias("phonetic"), F.col("x.d").alias("english"), F.when(alone, F.col("x.a")).alias("text"))


def read_matrix(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """(src, tgt, value) of a matrix as JSON: values by source and target, or by both in one key."""
    raw = spark.read.text(path, wholetext=True)
    nested = F.map_entries(F.from_json("value", "map<string, map<string, double>>"))
    rows = F.flatten(F.transform(nested, lambda e: F.transform(F.map_entries(e.value), lambda x: F.struct(e.key.alias("src"), x.key.alias("tgt"), x.value.alias("value")))))
    flat = F.transform(F.map_entries(F.from_json("value", "map<string, double>")), lambda e: F.struct(F.substring_index(e.key, separator, 1).alias("src"), F.substring_index(e.key, separator, -1).alias("tgt"), e.value.alias("value")))
    return raw.select(F.inline(F.when(F.col("value").rlike(r"^\s*\{\s*\"[^\"]*\"\s*:\s*\{"), rows).otherwise(flat)))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, row, values) of the numeric arrays in compressed numpy archives, such as cached
    frame scores: a row for each line of a matrix, one for a vector."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for name in archive.files:
                        if archive[name].dtype.kind in "fiub":
                            lines = np.atleast_2d(archive[name].astype(float)).reshape(-1, archive[name].shape[-1] if archive[name].ndim else 1)
                            yield pd.DataFrame({"file": file, "name": name, "row": range(len(lines)), "values": list(lines)})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)
    return df.select("path", "content").mapInPandas(run, "file string, name string, row int, values array<double>")


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """(name, revision) of lines that end in a hash after white space; empty lines and comments are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and v not like '#%'")
    return lines.select(F.regexp_extract("v", r"^(.*?)\s+(\S+)$", 1).alias("name"), F.regexp_extract("v", r"^(.*?)\s+(\S+)$", 2).alias("revision")).where("name <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line_id, text) of the non-empty lines of a transcript; files by name, lines in order."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("seq", "text"))
    kept = raw.where(F.trim("text") != "")
    return kept.select("file", "seq", F.format_string("line_%06d", F.col("seq") + 1).alias("line_id"), F.trim("text").alias("text"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are left out."""
    full = T.StructType.fromDDL(schema).add("broken__", T.StringType())
    df = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="broken__").withColumn("ok__", F.col("broken__").isNull())
    return df.where("ok__").drop("broken__", "ok__")


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, text, folder) of `*.trans.txt` files: an id and a text on each line."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(path)
    parts = F.split("value", " ", 2)
    return raw.select(F.get(parts, F.lit(0)).alias("utt_id"), F.get(parts, F.lit(1)).alias("text"), F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]+$", 1).alias("folder")).where("text is not null")


def list_audio(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length) of audio files below the paths, each once; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length")
    return df.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*AUDIO)).dropDuplicates(["path"])


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, sha256) of files below the paths."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


_LONG = r"intervals \[\d+\]:?\s*xmin = ([0-9.eE+-]+)\s*xmax = ([0-9.eE+-]+)\s*text = \"((?:[^\"]|\"\")*)\""


def parse_textgrid(text: Column) -> Column:
    """array<struct<tier, idx, xmin, xmax, text>> of a TextGrid's interval tiers, long or short form."""
    tiers = F.when(
        text.contains("item [1]"),
        F.transform(F.regexp_extract_all(text, F.lit(r"name = (\"(?:[^\"]|\"\")*\"[\s\S]*?)(?=item \[\d+\]|$)"), 1), lambda t: F.struct(F.regexp_extract(t, r"^\"((?:[^\"]|\"\")*)\"", 1).alias("tier"), F.regexp_extract_all(t, F.lit(f"({_LONG})"), 1).alias("parts"))),
    ).otherwise(
        F.transform(F.regexp_extract_all(text, F.lit(r"\"IntervalTier\"\s+(\"(?:[^\"]|\"\")*\"[\s\S]*?)(?=\"IntervalTier\"|\"TextTier\"|$)"), 1), lambda t: F.struct(F.regexp_extract(t, r"^\"((?:[^\"]|\"\")*)\"", 1).alias("tier"), F.regexp_extract_all(F.regexp_replace(t, r"^\"(?:[^\"]|\"\")*\"\s+\S+\s+\S+\s+\S+", ""), F.lit(r"([0-9.eE+-]+\s+[0-9.eE+-]+\s+\"(?:[^\"]|\"\")*\")"), 1).alias("parts")))
    )
    pattern = r"([0-9.eE+-]+)\s+(?:xmax = )?([0-9.eE+-]+)\s+(?:text = )?\"((?:[^\"]|\"\")*)\"$"
    cell = lambda t, p, i: F.struct(t.tier.alias("tier"), (i + 1).alias("idx"), F.regexp_extract(p, pattern, 1).cast("double").alias("xmin"), F.regexp_extract(p, pattern, 2).cast("double").alias("xmax"), F.replace(F.regexp_extract(p, pattern, 3), F.lit('""'), F.lit('"')).alias("text"))
    return F.flatten(F.transform(tiers, lambda t: F.transform(t.parts, lambda p, i: cell(t, p, i))))


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("file"), F.inline(parse_textgrid(F.col("value"))))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(tier, start_sec, end_sec, duration_sec, text) of a tab-separated annotation export: the last
    column is the text; rows without duration or text are left out."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 5)
    number = lambda i: F.replace(F.get("c", F.lit(i)), F.lit(","), F.lit(".")).try_cast("double")
    out = raw.select(F.get("c", F.lit(0)).alias("tier"), number(1).alias("start_sec"), number(2).alias("end_sec"), number(3).alias("duration_sec"), F.trim(F.element_at("c", -1)).alias("text"))
    return out.where("duration_sec > 0 and text <> ''")
