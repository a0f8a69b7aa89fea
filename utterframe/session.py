"""Session helpers: table access and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; only in local mode, where none is named (tests), a new one.

    A folder that exists on one machine only would lose data with that machine, so on a cluster
    without a named folder this fails.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
        if not named and not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="utterframe-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: columns that a reader leaves out are not read, and a
    lost executor costs nothing."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if `df` has at most `max_rows` rows, found without counting further."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only if the size is proven; else Spark joins by shuffle."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over more partitions than cores, for kernels that cost far more than their rows
    weigh; adaptive execution would put such rows into few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def smallest_hashes(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the smallest hash of their keys: the same ones however the rows are split.

    A threshold from the row count leaves about 4 n rows, so that what is sorted and sent does not
    grow with the number of tasks, as a plain top-k would.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 52))
    share = 4 * n / max(1, df.count())
    few = df if share >= 1 else df.where(place < int(share * (1 << 52)))
    return few.orderBy(place, *keys).limit(n)
