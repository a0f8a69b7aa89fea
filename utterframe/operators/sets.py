"""Unions, splits, deduplication, interleaving and balanced selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_fraction(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key alone (from md5, so that any engine gives the same)."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_split(df: DataFrame, key: Column, seed: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """A split that needs no sort and keeps a key's rows together, whatever else is in the table."""
    u = hashed_fraction(key, seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def mapped_split(df: DataFrame, splits: DataFrame, keys: Sequence[str], default: str = "train") -> DataFrame:
    return df.join(splits, list(keys), "left").withColumn("split", F.coalesce("split", F.lit(default)))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in an order; combined before the shuffle."""
    body = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.min(body).alias("r__")).select([F.col(f"r__.{c}") for c in df.columns])


def with_rewritten_copies(df: DataFrame, matching: Column, changes: dict[str, Column]) -> DataFrame:
    """All rows, and once more those that match, with some columns rewritten."""
    copies = df.where(matching)
    for name, value in changes.items():
        copies = copies.withColumn(name, value)
    return df.unionAll(copies.select(*df.columns))


def interleaved(a: DataFrame, b: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Both tables, half and half: the shorter is repeated until the longer is exhausted.

    Copies are numbered, and a hash of key and copy is the place in the mixture.
    """
    n = a.agg(F.count("*").alias("na")).join(b.agg(F.count("*").alias("nb")))
    out = []
    for i, (df, mine, other) in enumerate(((a, "na", "nb"), (b, "nb", "na"))):
        times = F.greatest(F.ceil(F.col(other) / F.greatest(F.col(mine), F.lit(1))), F.lit(1)).cast("int")
        out.append(df.join(F.broadcast(n)).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("na", "nb").withColumn("domain", F.lit(i)))
    return out[0].unionByName(out[1]).withColumn("place", F.xxhash64(key, "copy", "domain", F.lit(seed)))


def balanced_subset(df: DataFrame, item: str, lemma: str, parts: str, want: int, per_lemma: int = 2) -> DataFrame:
    """Items whose parts are spread evenly: again and again an item that holds the rarest part so far.

    The choice is sequential by nature, so it runs over a bounded pool. At most `per_lemma` items of
    a lemma are ever used, so beyond the first `per_lemma` + 1 items of each part and lemma none can
    be chosen: the pool gives what all items would, and is bounded by parts times lemmas.
    """
    first = F.row_number().over(Window.partitionBy("part__", lemma).orderBy(item))
    held = df.select(item, lemma, F.explode(F.array_distinct(parts)).alias("part__")).withColumn("n__", first).where(F.col("n__") <= per_lemma + 1)
    pool = df.join(held.select(item).distinct(), item, "left_semi").select(F.lit(0).alias("g"), item, lemma, parts)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r[1], r[2], list(r[3])) for r in pdf.sort_values(item).itertuples(index=False)]
        holders: dict[str, list[int]] = {}
        for i, (_, _, p) in enumerate(rows):
            for x in set(p):
                holders.setdefault(x, []).append(i)
        count, used, lemmas, out = dict.fromkeys(holders, 0), set(), {}, []
        while len(out) < want:
            for part in sorted(count, key=lambda x: (count[x], x)):
                i = next((i for i in holders[part] if i not in used and lemmas.get(rows[i][1], 0) < per_lemma), None)
                if i is not None:
                    break
            else:
                break
            used.add(i)
            lemmas[rows[i][1]] = lemmas.get(rows[i][1], 0) + 1
            for x in rows[i][2]:
                count[x] += 1
            out.append((len(out), rows[i][0]))
        return pd.DataFrame(out, columns=["place", item])

    return pool.groupBy("g").applyInPandas(choose, f"place int, {item} {dict(df.dtypes)[item]}")

