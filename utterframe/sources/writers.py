"""Writers: manifests, TextGrid text, split files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(words: DataFrame, parent: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One JSON document per parent with its rows in order; null fields are left out."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("row"))))
    return words.groupBy(parent).agg(F.to_json(F.transform(rows, lambda r: r.row)).alias("json"), F.count("*").alias("n"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def textgrid(intervals: DataFrame, file: str, tier: str, xmin: str, xmax: str, text: str) -> DataFrame:
    """(file, text) in TextGrid's long form; tiers by name, intervals in order of time."""
    n = lambda c: F.col(c).cast("double").cast("string")
    part = F.concat(F.lit("            xmin = "), n(xmin), F.lit("\n            xmax = "), n(xmax), F.lit("\n            text = "), _quoted(F.coalesce(F.col(text), F.lit(""))), F.lit("\n"))
    cells = intervals.withColumn("part", part)
    tiers = cells.groupBy(file, tier).agg(F.array_sort(F.collect_list(F.struct(xmin, xmax, "part"))).alias("p"), F.min(xmin).alias("lo"), F.max(xmax).alias("hi"))
    body = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n"), x.part)), "")
    tiers = tiers.withColumn("block", F.concat(F.lit('        class = "IntervalTier"\n        name = '), _quoted(F.col(tier)), F.lit("\n        xmin = "), n("lo"), F.lit("\n        xmax = "), n("hi"), F.lit("\n        intervals: size = "), F.size("p").cast("string"), F.lit("\n"), body))
    files = tiers.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(tier, "block"))).alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    items = F.array_join(F.transform("t", lambda x, i: F.concat(F.lit("    item ["), (i + 1).cast("string"), F.lit("]:\n"), x.block)), "")
    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = '), n("lo"), F.lit("\nxmax = "), n("hi"), F.lit("\ntiers? <exists>\nsize = "), F.size("t").cast("string"), F.lit("\nitem []:\n"))
    return files.select(file, F.concat(head, items).alias("text"))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of CSV files per split."""
    df.write.mode("overwrite").partitionBy(split).option("header", True).csv(path)


def append_records(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def wide_matrix(counts: DataFrame, source: str, target: str, value: str, targets: Sequence[str]) -> DataFrame:
    """A row per source and a column per target of an alphabet."""
    return counts.groupBy(source).pivot(target, list(targets)).agg(F.first(value)).na.fill(0)


def with_packaging(files: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Files that a split refers to, each once, with the split."""
    return files.join(references.dropDuplicates([key]), key)


def write_matrix(cells: DataFrame, path: str, source: str, target: str, value: str) -> None:
    """Values by source and target as JSON, one document to a line for each source."""
    rows = F.map_from_entries(F.array_sort(F.collect_list(F.struct(target, value))))
    cells.groupBy(source).agg(rows.alias("r")).select(F.to_json(F.create_map(F.col(source), F.col("r"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_vocabularies(spark: SparkSession, path: str, **vocabularies: dict[str, int]) -> None:
    """Each vocabulary (an alphabet) as one JSON object of ids by token, in its folder below `path`."""
    for name, ids in vocabularies.items():
        text = json.dumps(dict(sorted(ids.items(), key=lambda x: x[1])), ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
