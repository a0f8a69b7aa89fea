"""Mixing sources to target shares of a budget.

Efraimidis-Spirakis sampling: each file draws a key -ln(u) / weight from a hash of its identity, so
the order within a source is a weighted random one and the same in every run. A source is used in
complete epochs first; what is left of its share is filled by the files with the smallest keys, as
far as their running sum stays nearer to the share than stopping would. No file is used more than
max_repeats times.

The running sum needs no task that sees a whole source: keys fall into ranges by their logarithm,
RANGES to each factor of two, sums per range are accumulated over one row per range, and files are
summed within their range only. An exponential key lies in a given range with a chance of at most
0.26 / RANGES whatever its weight, so no range holds more than about 0.2 % of a source.

A source is too small for its share if the plan uses each of its files as often as it may and still
falls short.

Defined results: a file is the rows of one target_rel_path, or of one sha256 (in any letter case);
null, zero, negative and infinite durations add nothing; a target with a null share or budget wants
nothing, one with null max_repeats allows nothing; a source without files reaches a share of 0;
files of no named source are left out; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterframe.session import table

#: Ranges of keys to each factor of two.
RANGES = 128
SEED = 42


def source_of(path: Column) -> Column:
    """The directory directly below `raw`, in one spelling."""
    plain = F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    plain = F.coalesce(plain, F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(plain, r"(?i)(?:^|/)raw(?:/+\.)*/+([^/]+)/", 1)
    return F.nullif(source_name(name), F.lit(""))


def source_name(name: Column) -> Column:
    """Letter case and the characters between words do not matter."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def files_of(packaged: DataFrame) -> DataFrame:
    """(dataset_name, source, file, duration_ms): each file once.

    Rows of one path are one file, then paths of one checksum are; a path takes the checksum that
    any of its rows has.
    """
    seconds = F.col("duration_sec")
    ms = F.when((seconds > 0) & ~F.isnan(seconds) & (seconds < F.lit(1e12)), F.round(seconds * 1000).cast("long"))
    rows = packaged.select("dataset_name", source_of(F.col("source_path")).alias("source"), "target_rel_path", F.lower(F.trim("sha256")).alias("sha"), ms.alias("ms"))
    rows = rows.withColumn("path", F.coalesce("target_rel_path", F.concat(F.lit("sha:"), "sha")))
    paths = rows.groupBy("dataset_name", "source", "path").agg(F.min("sha").alias("sha"), F.max("ms").alias("ms"))
    paths = paths.withColumn("file", F.coalesce(F.concat(F.lit("sha:"), "sha"), F.concat(F.lit("path:"), "path")))
    return paths.groupBy("dataset_name", "source", "file").agg(F.max("ms").alias("duration_ms"))


def targets_of(targets: DataFrame) -> DataFrame:
    want = F.round(F.col("target_share") * F.col("budget_sec") * 1000, 3)
    return targets.select("dataset_name", "source_name", source_name(F.col("source_name")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "budget_sec", F.coalesce(want, F.lit(0.0)).alias("want_ms")).distinct()


def plan_uses(files: DataFrame, targets: DataFrame, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """(dataset_name, source_name, file, duration_ms, uses) of every file of a target's source.

    `weight` is a column of `files`; the heavier a file, the earlier it comes in its source.
    """
    files = files.where("duration_ms > 0")
    u = (F.pmod(F.xxhash64("dataset_name", "file", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    w = F.greatest(F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0)), F.lit(1e-9))
    keyed = files.withColumn("key", -F.log(u) / w)
    keyed = keyed.withColumn("range", F.floor(F.log2("key") * RANGES))
    source = ["dataset_name", "source"]
    sums = keyed.groupBy(*source, "range").agg(F.sum("duration_ms").alias("in_range"))
    ranges = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy(*source).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("size_ms", F.sum("in_range").over(Window.partitionBy(*source)))
    wanted = ranges.join(targets, source).withColumn("reach", F.least("want_ms", F.col("size_ms") * F.col("max_repeats")))
    wanted = wanted.withColumn("epochs", F.floor(F.col("reach") / F.col("size_ms"))).withColumn("rest", F.col("reach") - F.col("epochs") * F.col("size_ms"))
    wanted = wanted.select(*source, "range", "source_name", F.coalesce("before", F.lit(0)).alias("before"), "epochs", "rest", "max_repeats")
    rows = keyed.join(wanted, [*source, "range"])
    inner = Window.partitionBy(*source, "source_name", "range").orderBy("key", "file").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sum", F.col("before") + F.coalesce(F.sum("duration_ms").over(inner), F.lit(0)))
    extra = ((F.col("sum") + F.col("duration_ms") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))).cast("long")
    return rows.select("dataset_name", "source_name", "file", "duration_ms", (F.col("epochs") + extra).alias("uses"))


def shares(files: DataFrame, targets: DataFrame, uses: DataFrame) -> DataFrame:
    """Per target: the source's size, what it fills, the share reached, and whether it can fill it."""
    sizes = files.where("source is not null").groupBy("dataset_name", "source").agg(F.sum("duration_ms").alias("size_ms"), F.count("*").alias("n_files"))
    used = uses.groupBy("dataset_name", "source_name").agg(F.sum(F.col("uses") * F.col("duration_ms")).alias("filled_ms"), F.max("uses").alias("most_uses"), F.min("uses").alias("least_uses"))
    out = targets.join(sizes, ["dataset_name", "source"], "left").join(used, ["dataset_name", "source_name"], "left")
    size, filled = F.coalesce("size_ms", F.lit(0)), F.coalesce("filled_ms", F.lit(0))
    worn_out = F.coalesce("least_uses", "max_repeats") >= F.col("max_repeats")
    return out.select(
        "dataset_name", "source_name", "target_share", "max_repeats", "budget_sec", size.alias("size_ms"), F.coalesce("n_files", F.lit(0)).alias("n_files"), filled.alias("filled_ms"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (filled / 1000 / F.nullif(F.col("budget_sec"), F.lit(0.0))).alias("share_reached"), (worn_out & (filled < F.col("want_ms"))).alias("too_small"),
    )


def split_name(split: Column) -> Column:
    s = F.lower(F.trim(split))
    return F.when(s.isin("train", "training"), "train").when(s.isin("valid", "validation", "val", "dev", "eval"), "validation").when(s.isin("test", "testing"), "test").otherwise(s)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return files_of(table(spark, sf_dir, "packaged_audio")), targets_of(table(spark, sf_dir, "mix_targets"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached."""
    files, targets = _tables(spark, sf_dir)
    return shares(files, targets, plan_uses(files, targets))


def p2_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each file is used."""
    files, targets = _tables(spark, sf_dir)
    return plan_uses(files, targets)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose source cannot fill its share."""
    return p2_shares(spark, sf_dir).where("too_small").select("dataset_name", "source_name").distinct()


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per release and split: files counted now beside the manifest's count."""
    counted = table(spark, sf_dir, "packaged_audio").select("dataset_name", split_name(F.col("split")).alias("split"), "target_rel_path").distinct().groupBy("dataset_name", "split").agg(F.count("*").alias("n_files"))
    listed = table(spark, sf_dir, "packaging_manifest").select("dataset_name", F.explode("split_counts").alias("name", "n")).groupBy("dataset_name", split_name(F.col("name")).alias("split")).agg(F.sum("n").alias("n_listed"))
    return counted.join(listed, ["dataset_name", "split"], "full").select("dataset_name", "split", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_listed", F.lit(0)).alias("n_listed"))


QUERIES = {"p2_found": p2_found, "p2_shares": p2_shares, "p2_uses": p2_uses, "p2_splits": p2_splits}

_FILES = r"""
with f as (
  select dataset_name,
    trim(regexp_replace(lower(regexp_extract(replace(url_decode(replace(source_path, '+', '%2B')), '\', '/'), '(?i)(?:^|/)raw(?:/+\.)*/+([^/]+)/', 1)), '[^\p{L}\p{N}]+', ' ', 'g')) as source,
    target_rel_path, min(lower(sha256)) as sha, max(case when duration_sec > 0 then cast(round(duration_sec * 1000) as bigint) end) as ms
  from packaged_audio group by all
), u as (
  select dataset_name, source, coalesce('sha:' || sha, 'path:' || target_rel_path) as file, max(ms) as ms from f group by all
), sizes as (
  select dataset_name, source, sum(ms) as size_ms from u group by all
)
"""
SQL = {
    "p2_found": _FILES
    + r"""
select distinct dataset_name, source_name from mix_targets t
left join sizes s using (dataset_name)
where s.source = trim(regexp_replace(lower(source_name), '[^\p{L}\p{N}]+', ' ', 'g')) and coalesce(size_ms, 0) * max_repeats < round(target_share * budget_sec * 1000, 3)
union
select dataset_name, source_name from mix_targets t
where target_share * budget_sec > 0 and not exists (select 1 from sizes s where s.dataset_name = t.dataset_name and s.source = trim(regexp_replace(lower(t.source_name), '[^\p{L}\p{N}]+', ' ', 'g')))
""",
    "p2_splits": """
with c as (
  select dataset_name, split, count(*) as n_files from (
    select distinct dataset_name, target_rel_path, case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('valid', 'validation', 'val', 'dev', 'eval') then 'validation'
      when lower(trim(split)) in ('test', 'testing') then 'test' else lower(trim(split)) end as split from packaged_audio) group by all
), m as (
  select dataset_name, case when lower(trim(k)) in ('train', 'training') then 'train' when lower(trim(k)) in ('valid', 'validation', 'val', 'dev', 'eval') then 'validation'
      when lower(trim(k)) in ('test', 'testing') then 'test' else lower(trim(k)) end as split, cast(sum(split_counts[k]) as bigint) as n_listed
  from (select dataset_name, split_counts, unnest(map_keys(split_counts)) as k from packaging_manifest) group by all
)
select dataset_name, split, coalesce(n_files, 0) as n_files, coalesce(n_listed, 0) as n_listed from c full join m using (dataset_name, split)
""",
}
