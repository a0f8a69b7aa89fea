"""Documents into containers of fixed capacity, by bulk-synchronous best-fit.

Documents are measured in tokens and range-sorted by size. In every round each unplaced size class
looks for its successor among the open gaps (the smallest gap that it fits), classes that want the
same gap are served by rank, larger first, gaps shrink by what went in, and the round repeats; when
nothing fits any more, as many containers are opened as the rest must need at least.

Documents of one size are alike to best-fit, and so are gaps of one size. So the sweeps run over
size classes and gap classes, of which there are no more than the capacity whatever the number of
documents, and documents meet their containers by their rank within their class: the distributed
part is the range sort, the ranks and the assignment. What is sent to the driver and back is bounded
by the capacity and the number of partitions.

A document longer than a container fills containers of its own with whole pieces; what is left of it
is packed like a document. Nothing else is split.

Defined results: null ids and null or empty texts, of no tokens, go nowhere; equal rows count once; equal sizes
are served in the order of the sort; capacities that are null or not positive are ignored; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.session import cut_lineage, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _lengths(sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
    encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for pdf in batches:
        pdf = pdf[pdf["text"].notna()]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_tokens": [len(encode(t)) for t in pdf["text"]]})


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) under a public tokenizer, given as a file of ranks."""
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(lambda b: _lengths(sent, b), "doc_id bigint, n_tokens bigint")


class Gaps:
    """Open containers by the room left in them, as ranges of container numbers."""

    def __init__(self, capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, gap: int, lo: int, hi: int) -> None:
        self.count[gap] += hi - lo
        self.ranges[gap].append((lo, hi))

    def take(self, gap: int, n: int) -> list[tuple[int, int]]:
        self.count[gap] -= n
        out, held = [], self.ranges[gap]
        while n:
            lo, hi = held.pop()
            if hi - lo > n:
                held.append((lo + n, hi))
                hi = lo + n
            out.append((lo, hi))
            n -= hi - lo
        return out


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(rows of size, first rank, first container, number; number of containers).

    The documents of a size with `number` ranks from `first rank` go to as many consecutive
    containers, one each.
    """
    left = np.zeros(capacity + 1, np.int64)
    np.add.at(left, sizes, counts)
    left[0] = 0
    rank, gaps, opened, out = np.zeros(capacity + 1, np.int64), Gaps(capacity), 0, []
    while left.any():
        waiting = np.flatnonzero(left)[::-1]
        open_gaps = np.flatnonzero(gaps.count)
        place = np.searchsorted(open_gaps, waiting)
        fits = place < len(open_gaps)
        if not fits.any():
            need = -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
            gaps.add(capacity, opened, opened + need)
            opened += need
            continue
        size, want = waiting[fits], open_gaps[place[fits]]
        # Sizes fall, so those that want one gap stand together, the larger first.
        n = left[size]
        before = np.cumsum(n) - n
        first = np.r_[True, want[1:] != want[:-1]]
        before -= np.maximum.accumulate(np.where(first, before, 0))
        placed = np.clip(gaps.count[want] - before, 0, n)
        moved = []
        for s, gap, k in zip(size[placed > 0].tolist(), want[placed > 0].tolist(), placed[placed > 0].tolist()):
            for lo, hi in gaps.take(gap, k):
                out.append((s, rank[s], lo, hi - lo))
                rank[s] += hi - lo
                moved.append((gap - s, lo, hi))
            left[s] -= k
        for gap, lo, hi in moved:
            if gap:
                gaps.add(gap, lo, hi)
    return np.array(out, np.int64).reshape(-1, 4), opened


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers rows of one capacity and size within a sorted partition."""
    last, seen = None, 0
    for pdf in batches:
        if not len(pdf):
            continue
        key = list(zip(pdf["capacity"], pdf["size"]))
        fresh = np.r_[key[0] != last, (pdf["capacity"].to_numpy()[1:] != pdf["capacity"].to_numpy()[:-1]) | (pdf["size"].to_numpy()[1:] != pdf["size"].to_numpy()[:-1])]
        at = np.arange(len(pdf))
        start = np.maximum.accumulate(np.where(fresh, at, -1))
        local = np.where(start >= 0, at - start, seen + at)
        last, seen = key[-1], int(local[-1]) + 1
        yield pdf.assign(local=local)


def _assigned(sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    offsets, plans = sent.value
    for pdf in batches:
        if not len(pdf):
            continue
        container = np.empty(len(pdf), np.int64)
        for (part, capacity), rows in pdf.groupby(["part", "capacity"]).indices.items():
            size, local = pdf["size"].to_numpy()[rows], pdf["local"].to_numpy()[rows]
            known, starts = offsets[part, capacity]
            rank = local + starts[np.searchsorted(known, size)]
            keys, first, bins = plans[capacity]
            at = np.searchsorted(keys, (size << 40) + rank, "right") - 1
            container[rows] = bins[at] + rank - first[at]
        out = pdf[["capacity", "doc_id", "piece_no", "token_start", "size"]].rename(columns={"size": "n_tokens"})
        yield out.assign(container_id=[f"shared-{c}" for c in container])


def pack(lengths: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, container_id, doc_id, piece_no, token_start, n_tokens) of documents with the columns
    doc_id and n_tokens; container_id is unique within its capacity."""
    spark = lengths.sparkSession
    schema = "capacity bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, container_id string"
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    if not capacities:
        return spark.createDataFrame([], schema)
    # Written once: the texts are not tokenized again for the sort's sample and the passes below.
    docs = cut_lineage(lengths.where("n_tokens > 0").distinct())
    each = docs.select("doc_id", "n_tokens", F.explode(F.array(*[F.lit(c).cast("bigint") for c in capacities])).alias("capacity"))
    each = each.withColumn("whole", F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)))
    full = each.where("whole > 0").select("capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece_no"))
    full = full.select("capacity", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"), F.concat_ws("-", F.lit("own"), "doc_id", "piece_no").alias("container_id"))
    rest = each.select("capacity", "doc_id", F.col("whole").alias("piece_no"), (F.col("whole") * F.col("capacity")).alias("token_start"), (F.col("n_tokens") - F.col("whole") * F.col("capacity")).alias("size")).where("size > 0")
    ranged = rest.repartitionByRange("capacity", "size", "doc_id").sortWithinPartitions("capacity", "size", "doc_id")
    fields = "capacity bigint, doc_id bigint, piece_no bigint, token_start bigint, size bigint"
    ranked = cut_lineage(ranged.mapInPandas(_ranked, f"{fields}, local bigint").withColumn("part", F.spark_partition_id()))
    # As the rows are sorted, a class spans neighbouring partitions: no more rows here than classes and partitions.
    counts = sorted(map(tuple, ranked.groupBy("capacity", "size", "part").count().collect()))
    offsets, plans, total = {}, {}, {}
    for capacity, size, part, n in counts:
        known = offsets.setdefault((part, capacity), ([], []))
        known[0].append(size)
        known[1].append(total.get((capacity, size), 0))
        total[capacity, size] = total.get((capacity, size), 0) + n
    offsets = {k: (np.array(a), np.array(b)) for k, (a, b) in offsets.items()}
    for c in capacities:
        mine = [(s, n) for (capacity, s), n in total.items() if capacity == c]
        rows, _ = best_fit(np.array([s for s, _ in mine], np.int64), np.array([n for _, n in mine], np.int64), c)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        plans[c] = ((rows[:, 0] << 40) + rows[:, 1], rows[:, 1], rows[:, 2])
    sent = spark.sparkContext.broadcast((offsets, plans))
    shared = ranked.mapInPandas(lambda b: _assigned(sent, b), schema)
    return full.select("capacity", "doc_id", "piece_no", "token_start", "n_tokens", "container_id").unionAll(shared)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    budget = table(spark, sf_dir, "pack_budget").where("capacity_tokens > 0").select("purpose", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    # A table of purposes; it does not grow with the documents.
    capacities = [r.capacity for r in budget.select("capacity").distinct().collect()]
    return budget, pack(token_lengths(table(spark, sf_dir, "documents")), capacities)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one, with its container for each purpose."""
    budget, packed = _packed(spark, sf_dir)
    return packed.join(F.broadcast(budget), "capacity").select("purpose", "container_id", "doc_id", "piece_no", "token_start", "n_tokens")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per purpose: containers, tokens, the share of room used, and the least possible number."""
    budget, packed = _packed(spark, sf_dir)
    used = packed.groupBy("capacity").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"))
    return used.join(F.broadcast(budget), "capacity").select("purpose", "capacity", "n_documents", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"), F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"))


QUERIES = {"p7_containers": p7_containers, "p7_report": p7_report}
SQL: dict[str, str] = {}
