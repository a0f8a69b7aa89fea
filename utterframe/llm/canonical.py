"""Values that look the same, brought to one form.

Look-alike-mapped values are grouped under Spark's accent-sensitive Unicode collation; each class
of values that are equal there (canonically equivalent, or apart only in characters that show
nothing) takes its shortest, then smallest member as canonical, which is joined back to the values.

Mapping and grouping see each distinct value once, after a map-side combine, so a value that a third
of all rows hold costs one row; a class has as many rows as its text has distinct spellings, and its
window spills to disk. The last join is on the values that differ from their form.

Defined results: a null value has no form and is no case; an empty one is its own form; equal rows
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.llm.characters import phonetic_form, syllabary_form
from utterframe.session import table

COLLATION = "UNICODE"
FORMS = {"phonetic": phonetic_form, "syllabary": syllabary_form}


@F.pandas_udf(T.StringType())
def mapped_form(pairs: pd.DataFrame) -> pd.Series:
    return pd.Series([FORMS[k](v) for k, v in zip(pairs["kind"], pairs["value"])], dtype=object)


def forms(values: DataFrame) -> DataFrame:
    """(kind, value, form) of the distinct rows of (kind, value)."""
    distinct = values.where("value is not null").select("kind", "value").distinct()
    mapped = distinct.withColumn("mapped", mapped_form(F.struct("kind", "value")))
    # Most values are in form: what is sent to a class's partition is then the one text.
    mapped = mapped.select("kind", F.nullif("value", F.col("mapped")).alias("value"), F.collate("mapped", COLLATION).alias("class"))
    text = F.collate("class", "UTF8_BINARY")
    member = F.min(F.struct(F.length(text), text)).over(Window.partitionBy("kind", "class"))
    out = mapped.withColumn("member", member)
    return out.select("kind", F.coalesce("value", text).alias("value"), F.col("member.col2").alias("form"))


def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, rec_key, field_name, kind, value) of the fields that hold such text."""
    samples, records = table(spark, sf_dir, "syllabary_samples"), table(spark, sf_dir, "enrichment_records")
    fields = F.inline(
        F.array(
            F.struct(F.lit("syllabary_raw").alias("field_name"), F.lit("syllabary").alias("kind"), F.col("syllabary_raw").alias("value")),
            F.struct(F.lit("gt_target").alias("field_name"), F.lit("phonetic").alias("kind"), F.col("gt_target").alias("value")),
        )
    )
    a = samples.select(F.lit("sample").alias("origin"), F.col("sample_id").alias("rec_key"), fields)
    b = records.select(F.lit("enrichment").alias("origin"), F.col("record_id").alias("rec_key"), F.lit("target_phonetics").alias("field_name"), F.lit("phonetic").alias("kind"), F.col("target_phonetics").alias("value"))
    return a.unionAll(b)


def differing(values: DataFrame) -> DataFrame:
    return forms(values).where("form <> value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold other characters than the ones they show."""
    rows = text_fields(spark, sf_dir)
    wrong = differing(rows)
    return rows.join(wrong, ["kind", "value"], "left_semi").select("origin", "rec_key", "field_name").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its one form."""
    rows = text_fields(spark, sf_dir).where("value is not null")
    out = rows.join(differing(rows), ["kind", "value"], "left")
    return out.select("origin", "rec_key", "field_name", "value", F.coalesce("form", "value").alias("form")).distinct()


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
SQL: dict[str, str] = {}
