"""Evaluation passages inside corpus documents.

The n-grams of the normalised evaluation items form a hash set that is broadcast in blocks of items
with at most MAX_GRAMS n-grams, each of which scans the corpus once; a Python worker builds a block's
set once. Each batch of documents is turned into word numbers of the evaluation
vocabulary, runs of at least n known words are cut into windows and looked up, and every hit is
verified word by word, as the key of the set is the window itself. Documents are scanned whole and
without a shuffle. To remove spans, documents pass through the blocks one after the other, each of
which notes its spans, and are cut once at the end.

Defined results: documents and items with null text or id are left out; items of fewer than n words are
never found; equal rows count once; ties between items that share a passage give one row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.llm.characters import WORD, search_form
from utterframe.session import table

N = 10
#: Most n-grams of evaluation items that are broadcast; more are scanned in blocks of items.
MAX_GRAMS = 500_000
#: Raw spellings remembered by one task.
MAX_SPELLINGS = 300_000


def words_of(text: str) -> list[str]:
    return [w for raw in WORD.findall(text.replace("_", " ")) if (w := search_form(raw))]


class Grams:
    """The evaluation items' n-grams over a vocabulary of numbers."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n, self.vocabulary, self.items = n, {}, {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]
            for i in range(len(ids) - n + 1):
                self.items.setdefault(tuple(ids[i : i + n]), set()).add(item)
        rng = np.random.default_rng(7)
        self.weights = rng.integers(1, 2**62, n, dtype=np.int64) | 1
        grams = np.array(list(self.items), dtype=np.int64).reshape(-1, n)
        self.hashes = np.unique(self.hash(grams))

    def hash(self, windows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (windows * self.weights).sum(axis=1, dtype=np.int64) if len(windows) else np.empty(0, np.int64)


class Scanner:
    """Finds the windows of documents that are n-grams of evaluation items."""

    def __init__(self, grams: Grams):
        self.grams, self.spellings = grams, {}

    def number(self, raw: str) -> int:
        """-1: a word that no item has; -2: characters that show nothing, no word."""
        if len(self.spellings) > MAX_SPELLINGS:
            self.spellings.clear()
        w = search_form(raw)
        k = self.spellings[raw] = self.grams.vocabulary.get(w, -1) if w else -2
        return k

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, each text closed by a -1, and where each text ends."""
        flat: list[str | None] = []
        ends = []
        for text in texts:
            flat += WORD.findall(text.replace("_", " "))
            ends.append(len(flat))
            flat.append(None)
        known = self.spellings
        ids = np.fromiter((-1 if w is None else known[w] if w in known else self.number(w) for w in flat), np.int64, len(flat))
        return ids, np.array(ends)

    def hits(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, first word, item) of each verified window; words are counted as written."""
        g, out = self.grams, []
        ids, ends = self.numbers(texts)
        place = np.flatnonzero(ids != -2)
        ids = ids[place]
        known = ids >= 0
        run = np.convolve(known, np.ones(g.n, int), "valid") == g.n if len(ids) >= g.n else np.empty(0, bool)
        at = np.flatnonzero(run)
        if not len(at):
            return out
        windows = ids[at[:, None] + np.arange(g.n)]
        keep = np.isin(g.hash(windows), g.hashes)
        if not keep.any():
            return out
        for i, window in zip(at[keep], windows[keep]):
            for item in g.items.get(tuple(window.tolist()), ()):
                k = int(np.searchsorted(ends, place[i]))
                out.append((k, int(place[i]) - (int(ends[k - 1]) + 1 if k else 0), item))
        return out


#: A worker's set by the number of its block; the last one only.
BUILT: dict[int, Grams] = {}


class Sent:
    """A broadcast block of items; in a worker, a scanner over the set that is built from it once."""

    def __init__(self, spark: SparkSession, block: list[tuple[int, str]], n: int):
        self.block, self.n = spark.sparkContext.broadcast(block), n
        self.number = self.block._jbroadcast.id()

    def __call__(self) -> Scanner:
        if self.number not in BUILT:
            BUILT.clear()
            BUILT[self.number] = Grams(self.block.value, self.n)
        return Scanner(BUILT[self.number])


def _find(scanner: Sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scan = scanner()
    for pdf in batches:
        for lo in range(0, len(pdf), 2000):
            part = pdf.iloc[lo : lo + 2000]
            ids = part["doc_id"].to_numpy()
            pairs = {(ids[k], item) for k, _, item in scan.hits(part["text"].tolist())}
            if pairs:
                yield pd.DataFrame(sorted(pairs), columns=["doc_id", "item_id"])


def _mark(scanner: Sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the first words of a block's hits to each document's list."""
    scan = scanner()
    for pdf in batches:
        firsts: dict[int, set[int]] = {}
        for k, first, _ in scan.hits(pdf["text"].tolist()):
            firsts.setdefault(k, set()).add(first)
        yield pdf.assign(firsts=[sorted({*old, *firsts.get(k, ())}) for k, old in enumerate(pdf["firsts"])])


def cut_spans(text: str, firsts: list[int], n: int, mark: str) -> tuple[str, int]:
    """A text without the n words from each of `firsts` on, and how many words that takes."""
    spans = [m.span() for m in WORD.finditer(text.replace("_", " "))]
    real = [i for i, (a, b) in enumerate(spans) if search_form(text[a:b])]
    rank = {i: j for j, i in enumerate(real)}
    out, at, done, removed = [], 0, -1, 0
    for s in firsts:
        last = real[rank[s] + n - 1]
        if s > done:
            out += [text[at : spans[s][0]], mark]
        removed += last - max(s, done + 1) + 1
        at, done = max(spans[last][1], at), max(last, done)
    return "".join(out) + text[at:], removed


def _cut(n: int, mark: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [cut_spans(t, list(f), n, mark) if len(f) else (t, 0) for t, f in zip(pdf["text"], pdf["firsts"])]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "text": [t for t, _ in done], "n_words_removed": [k for _, k in done]})


def _item_blocks(items: DataFrame, n: int, max_grams: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most max_grams words (or one item), one at a time: the driver holds
    a single block."""
    block, words = [], 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        size = len(words_of(row.text))
        if size < n:
            continue
        if words + size > max_grams and block:
            yield block
            block, words = [], 0
        block.append((row.item_id, row.text))
        words += size
    yield block


def _scanners(documents: DataFrame, items: DataFrame, n: int, max_grams: int) -> Iterator[Sent]:
    return (Sent(documents.sparkSession, block, n) for block in _item_blocks(items, n, max_grams))


def leaked_items(documents: DataFrame, items: DataFrame, n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, item_id) of the documents that hold n consecutive words of an item."""
    docs, out = documents.select("doc_id", "text").where("doc_id is not null and text is not null"), None
    for scanner in _scanners(documents, items, n, max_grams):
        part = docs.mapInPandas(lambda batches, scanner=scanner: _find(scanner, batches), "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def without_leaks(documents: DataFrame, items: DataFrame, mark: str = "", n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, text, n_words_removed): the documents with every leaked span cut out. Spans of several
    items may overlap, within a block and between blocks."""
    docs = documents.select("doc_id", "text", F.array().cast("array<int>").alias("firsts")).where("doc_id is not null and text is not null")
    for scanner in _scanners(documents, items, n, max_grams):
        docs = docs.mapInPandas(lambda batches, scanner=scanner: _mark(scanner, batches), docs.schema)
    return docs.mapInPandas(lambda batches: _cut(n, mark, batches), "doc_id bigint, text string, n_words_removed bigint")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of an evaluation item."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation set: items, items leaked and documents that hold them."""
    items = table(spark, sf_dir, "eval_items")
    found = leaked_items(table(spark, sf_dir, "documents"), items)
    sets = items.select("item_id", "item_set").distinct()
    return sets.join(found, "item_id", "left").groupBy("item_set").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_items_leaked"),
        F.countDistinct("doc_id").alias("n_documents"),
    )


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the leaked spans."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_clean": p8_clean}
SQL: dict[str, str] = {}
