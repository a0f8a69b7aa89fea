"""Confusion graphs and their components; estimation of a confusion matrix by repeated alignment."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterframe.functions.maths import negative_log
from utterframe.operators.alignment import align_grams
from utterframe.session import cut_lineage, small_enough, spread, written

#: Largest alphabet whose graph is handled on the driver.
MAX_SYMBOLS = 5000


def graph_components(edges: list[tuple[str, str]], symbols: list[str]) -> list[tuple[str, int, int, int]]:
    """(symbol, component, size, diameter); components by falling size, then by first symbol."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def reach(start: str) -> dict[str, int]:
        far, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
        return far

    seen, groups = set(), []
    for s in sorted(symbols):
        if s not in seen:
            members = sorted(reach(s))
            seen.update(members)
            groups.append((members, max(max(reach(m).values()) for m in members)))
    groups.sort(key=lambda g: (-len(g[0]), g[0][0]))
    return [(s, k, len(members), diameter) for k, (members, diameter) in enumerate(groups) for s in members]


def alphabet_components(pairs: DataFrame, i: str, j: str, p: str, above: float) -> DataFrame:
    """(symbol, component, size, diameter) of the graph of symbols whose symmetric value exceeds a
    threshold; components by falling size, then by first symbol.

    The graph of an alphabet is handled on the driver. One of more than MAX_SYMBOLS symbols goes
    through `label_propagation`; its diameters, which need all distances, are null.
    """
    spark = pairs.sparkSession
    schema = "symbol string, component int, size int, diameter int"
    pairs = written(pairs.select(i, j, p))
    symbols = pairs.select(F.explode(F.array(i, j)).alias("symbol")).where("symbol is not null").distinct()
    edges = pairs.where((F.col(p) > above) & (F.col(i) != F.col(j))).select(F.col(i).alias("a"), F.col(j).alias("b"))
    if small_enough(symbols, MAX_SYMBOLS):
        out = graph_components([tuple(r) for r in edges.distinct().collect()], [r.symbol for r in symbols.collect()])
        return spark.createDataFrame(out, schema)
    labels = symbols.join(label_propagation(edges, "a", "b").withColumnRenamed("node", "symbol"), "symbol", "left").withColumn("label", F.coalesce("label", "symbol"))
    sizes = labels.groupBy("label").agg(F.count("*").cast("int").alias("size"))
    # The number of a component is its place among all: counts per size first, then within a size.
    of_size = sizes.groupBy("size").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("size").orderBy("label")) - 1
    numbered = sizes.withColumn("place", place).join(of_size.select("size", before.alias("before")), "size")
    out = labels.join(numbered.select("label", "size", (F.col("before") + F.col("place")).cast("int").alias("component")), "label")
    return out.select("symbol", "component", "size", F.lit(None).cast("int").alias("diameter"))


def label_propagation(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): each node with the least node of its component, for graphs of any size.

    Each round takes the least label among the neighbours and then the label of the label, which
    halves the distance to go; rounds end when nothing changes. Labels only ever fall, so they do.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(edges.select(F.col(b), F.col(a))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")))
    changed = True
    while changed:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("other"))
        next_ = labels.join(near, "node").select("node", F.least("label", "other").alias("label"))
        jump = next_.join(next_.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        next_ = cut_lineage(jump.select("node", F.least(F.col("label"), F.coalesce("root", "label")).alias("label")))
        changed = bool(next_.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count())
        labels = next_
    return labels


class Matrix:
    """Substitution, insertion and deletion probabilities as costs."""

    def __init__(self, rows: list[tuple[str, str, float]] = (), default: tuple[float, float, float] = (10.0, 5.0, 5.0)):
        self.p = {(s, t): p for s, t, p in rows}
        self.cost = {k: max(0.0, -math.log(max(p, 1e-12))) for k, p in self.p.items()}
        self.default = default

    def substitute(self, s: str, t: str) -> float:
        found = self.cost.get((s, t))
        return found if found is not None else 0.0 if s == t else self.default[0]

    def delete(self, s: str) -> float:
        return self.cost.get((s, ""), self.default[2])

    def insert(self, t: str) -> float:
        return self.cost.get(("", t), self.default[1])


def estimate(pairs: DataFrame, source: str, target: str, rounds: int = 4, prior: float = 0.5, least: float = 0.05) -> tuple[list[tuple[str, str, float]], list[float]]:
    """(source, target, probability) rows and the largest change of each round.

    Every round aligns all pairs under the current costs (on the executors), counts what was aligned,
    and normalises by source with a prior towards the last matrix; targets below `least` are dropped
    unless they are the best. Only the matrix, the size of an alphabet's squares, is on the driver.
    """
    spark = pairs.sparkSession
    data = cut_lineage(pairs.select(source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()))
    data = spread(data.groupBy(source, target).agg(F.count("*").alias("k")), source)
    table: list[tuple[str, str, float]] = []
    deltas = []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Matrix(table))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            m = sent.value
            for pdf in batches:
                counts: dict[tuple[str, str], float] = defaultdict(float)
                for a, b, k in pdf.itertuples(index=False):
                    _, path = align_grams(list(a), list(b), m.substitute, m.delete, m.insert)
                    for i, j, di, dj, _ in path:
                        counts[" ".join(a[i : i + di]), b[j : j + dj]] += k
                yield pd.DataFrame([(s, t, n) for (s, t), n in counts.items()], columns=["s", "t", "n"])

        seen = data.mapInPandas(run, "s string, t string, n double").groupBy("s", "t").agg(F.sum("n").alias("n"))
        old = {(s, t): p for s, t, p in table}
        counts: dict[str, dict[str, float]] = defaultdict(dict)
        for r in seen.collect():
            counts[r.s][r.t] = r.n
        fresh = {}
        for s, row in counts.items():
            full = {t: n + prior * old.get((s, t), 0.0) for t, n in row.items()}
            total = sum(full.values())
            share = {t: n / total for t, n in full.items()}
            best = min(share, key=lambda t: (-share[t], t))
            kept = {t: p for t, p in share.items() if p >= least or t == best}
            whole = sum(kept.values())
            for t, p in kept.items():
                fresh[s, t] = min(0.99, max(0.01, p / whole)) if t == "" else p / whole
        deltas.append(max((abs(fresh.get(k, 0.0) - old.get(k, 0.0)) for k in {*fresh, *old}), default=0.0))
        table = sorted((s, t, p) for (s, t), p in fresh.items())
    return table, deltas


def cost_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cost", negative_log(F.col("p"), 10.0))
