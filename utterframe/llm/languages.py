"""Languages of documents and their paragraphs, and types of code-switched tokens.

The model averages hashed subword embeddings of a text's words and ends in a linear softmax; it is
trained by stochastic gradient descent in numpy on the paragraphs of at most MAX_TRAIN labelled
documents (the ones with the smallest hash), twice: the second time without the paragraphs that the
first model takes for another language than their label, as labels are partly wrong. A temperature
and the confidence below which a text gets no language (`und`) are set on held-out paragraphs.

Scoring covers every paragraph of every document. A word's influence on the mean is bounded, so
that a quoted word or short aside does not decide.

Defined results: null ids and null or empty texts have no paragraph; a paragraph without a letter is `und` with
confidence 0; a label that names none of the languages makes every paragraph a case; equal rows
count once; without any labelled document there is no model and no row for documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.llm.characters import BASIC, WORD
from utterframe.session import smallest_hashes, table

#: Labelled documents that the model is trained on, at most.
MAX_TRAIN = 2000
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 15, 10, 5, 64, 1.5, 5
#: The embeddings' gradient is spread over a text's words and their subwords; this makes up for it.
SPREAD = 60.0
#: The share of words whose influence is not cut.
BOUND = 0.5
MAX_WORDS = 300_000
UNKNOWN = "und"
# Usual spellings of the languages that a label can name.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "chr": ("chr", "cherokee", "tsalagi"),
    "es": ("es", "spa", "esp", "spanish", "castilian"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
}
_BREAK = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")


def label_language(label: Column) -> Column:
    """The language that a label names, by code or English name, with or without a region."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_ (.].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(head.isin(*names), code).otherwise(out)
    return out


def paragraphs(text: str) -> list[str]:
    """Stretches of text between blank lines; a line of white space only is blank."""
    return [p for p in _BREAK.split(text) if p and not p.isspace()]


def word_key(raw: str) -> str:
    """A word as the model sees it; empty for what has no letter."""
    w = raw.translate(BASIC).lower()
    return w if any(c.isalpha() for c in w) else ""


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


class Model:
    """Averaged hashed subword embeddings with a linear softmax."""

    def __init__(self, labels: list[str]):
        rng = np.random.default_rng(SEED)
        self.labels = labels
        self.embedding = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
        self.weight = rng.normal(0, 0.5, (DIM, len(labels))).astype(np.float32)
        self.temperature, self.least, self.bound = 1.0, 0.0, np.inf

    def vectors(self, words: list[str]) -> np.ndarray:
        ids = [subwords(w) for w in words]
        size = np.array([len(i) for i in ids])
        flat = np.concatenate(ids) if ids else np.empty(0, int)
        return np.add.reduceat(self.embedding[flat], np.cumsum(size) - size, axis=0) / size[:, None]

    def logits(self, words: list[str]) -> np.ndarray:
        """What each word adds to its text's mean, around zero and bounded by `bound`."""
        x = self.vectors(words) @ self.weight
        return np.clip(x - x.mean(axis=1, keepdims=True), -self.bound, self.bound)

    def judge(self, means: np.ndarray) -> np.ndarray:
        return softmax(means / self.temperature)

    def train(self, texts: list[list[int]], words: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Texts as word numbers; every class weighs the same in sum."""
        rng = np.random.default_rng(SEED)
        ids = [np.array(subwords(w)) for w in words]
        share = np.bincount(labels, minlength=len(self.labels))
        weight = len(labels) / np.maximum(share, 1) / max(1, np.count_nonzero(share))
        weight = np.minimum(weight, 10)
        steps = max(1, epochs * -(-len(texts) // BATCH))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                rate = RATE * (1 - step / steps)
                step += 1
                part = order[lo : lo + BATCH]
                owner = np.repeat(np.arange(len(part)), [len(texts[i]) for i in part])
                pairs, count = np.unique(owner * len(words) + np.concatenate([texts[i] for i in part]), return_counts=True)
                owner, word = pairs // len(words), pairs % len(words)
                distinct, back = np.unique(word, return_inverse=True)
                size = np.array([len(ids[w]) for w in distinct])
                flat = np.concatenate([ids[w] for w in distinct])
                vec = np.add.reduceat(self.embedding[flat], np.cumsum(size) - size, axis=0) / size[:, None]
                mix = np.zeros((len(part), len(distinct)), np.float32)
                mix[owner, back] = count / np.bincount(owner, count, len(part))[owner]
                hidden = mix @ vec
                error = softmax(hidden @ self.weight)
                error[np.arange(len(part)), labels[part]] -= 1
                error *= weight[labels[part], None] / len(part)
                back_hidden = error @ self.weight.T
                self.weight -= rate * hidden.T @ error
                per_word = (mix.T @ back_hidden) / size[:, None]
                np.add.at(self.embedding, flat, (-rate * SPREAD * np.repeat(per_word, size, axis=0)).astype(np.float32))

    def calibrate(self, texts: list[list[int]], words: list[str], labels: np.ndarray) -> None:
        """The temperature with the least log loss, and the confidence below which held-out texts
        are right in fewer than half of the cases."""
        plain = self.logits(words)
        self.bound = float(np.quantile(np.abs(plain).max(axis=1), BOUND))
        logits = self.logits(words)
        means = np.array([logits[i].mean(axis=0) for i in texts])
        best = (np.inf, 1.0)
        for t in (0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0):
            got = softmax(means / t)
            best = min(best, (-np.log(np.maximum(got[np.arange(len(labels)), labels], 1e-9)).mean(), t))
        self.temperature = best[1]
        got = self.judge(means)
        top, right = got.max(axis=1), got.argmax(axis=1) == labels
        bins = np.floor(top * 20).astype(int)
        self.least = next((b / 20 for b in range(21) if (bins == b).sum() >= 5 and right[bins == b].mean() >= 0.5), 0.0)
        self.least = min(self.least, 0.5)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model of (text, language) rows."""
    numbers: dict[str, int] = {}
    texts, labels = [], []
    names = sorted({lang for _, lang in rows})
    for text, lang in rows:
        for p in paragraphs(text):
            ids = [numbers.setdefault(w, len(numbers)) for raw in WORD.findall(p) if (w := word_key(raw))]
            if ids:
                texts.append(ids)
                labels.append(names.index(lang))
    if not texts:
        return None
    words, labels = list(numbers), np.array(labels)
    held = np.arange(len(texts)) % 5 == 4
    pick = lambda mask: [t for t, m in zip(texts, mask) if m]
    train = ~held if (~held).sum() >= 20 else np.ones(len(texts), bool)
    first = Model(names)
    first.train(pick(train), words, labels[train], epochs=1)
    p = first.logits(words)
    agree = np.array([p[t].mean(axis=0).argmax() for t in texts]) == labels
    if len(set(labels[train & agree])) == len(set(labels[train])):
        train = train & agree
    model = Model(names)
    model.train(pick(train), words, labels[train])
    # Wrong labels stay in here: the confidence then says how far a label would agree.
    check = held if held.any() else train
    model.calibrate(pick(check), words, labels[check])
    return model


class Scorer:
    """Distributions of texts under a model, with the words of one task remembered."""

    def __init__(self, model: Model):
        self.model, self.numbers = model, {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean distribution, number of words with letters) of each text."""
        if len(self.numbers) > MAX_WORDS:
            self.numbers.clear()
        flat = [WORD.findall(t) for t in texts]
        size = np.array([len(f) for f in flat])
        known = self.numbers
        fresh = list({w for f in flat for w in f if w not in known})
        self._learn(fresh)
        ids = np.fromiter((known[w] for f in flat for w in f), np.int64, size.sum())
        owner = np.repeat(np.arange(len(texts)), size)
        real = ids >= 0
        words = np.bincount(owner[real], minlength=len(texts))
        total = np.stack([np.bincount(owner[real], self.table[ids[real], k], len(texts)) for k in range(self.table.shape[1])], axis=1)
        return self.model.judge(total / np.maximum(words, 1)[:, None]), words

    def _learn(self, fresh: list[str]) -> None:
        keys = {raw: word_key(raw) for raw in fresh}
        real = [raw for raw in fresh if keys[raw]]
        at = len(self.numbers)
        while at + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if real:
            dist = self.model.logits([keys[r] for r in real])
            for i, raw in enumerate(real):
                self.numbers[raw] = at + i
            self.table[at : at + len(real)] = dist
        for raw in fresh:
            if not keys[raw]:
                self.numbers[raw] = -1


def _scored(sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = sent.value
    scorer = Scorer(model)
    names = np.array([*model.labels, UNKNOWN], dtype=object)
    for pdf in batches:
        pdf = pdf[pdf["text"].notna()]
        for lo in range(0, len(pdf), 1000):
            part = pdf.iloc[lo : lo + 1000]
            split = [paragraphs(t) for t in part["text"]]
            size = [len(s) for s in split]
            if not sum(size):
                continue
            dist, words = scorer.scores([p for s in split for p in s])
            best, top = dist.argmax(axis=1), dist.max(axis=1)
            best[(words == 0) | (top < model.least)] = len(model.labels)
            row = np.repeat(np.arange(len(part)), size)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy()[row], "label": part["label"].to_numpy()[row], "unit_no": np.concatenate([np.arange(n) for n in size]),
                "lang": names[best], "confidence": np.where(words == 0, 0.0, top), "n_words": words,
            })


def training_rows(documents: DataFrame, max_train: int = MAX_TRAIN) -> list[tuple[str, str]]:
    """At most `max_train` labelled documents, the same ones in every run."""
    rows = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("label is not null and text is not null and doc_id is not null")
    return [(r.text, r.label) for r in sorted(smallest_hashes(rows, max_train, "doc_id").collect(), key=lambda r: r.doc_id)]


def paragraph_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, unit_no, lang, confidence, n_words) of every paragraph; label is the language
    that the document's own label names."""
    schema = "doc_id bigint, label string, unit_no int, lang string, confidence double, n_words bigint"
    spark = documents.sparkSession
    model = model or fit(training_rows(documents))
    if model is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)
    rows = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("doc_id is not null and text is not null")
    return rows.mapInPandas(lambda b: _scored(sent, b), schema)


_CHEROKEE = r"[\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}]"
_LATIN = r"[\p{IsLatin}]"


def token_type(token: Column) -> Column:
    """Right type of a code-switched token, by its letters."""
    cherokee, latin = token.rlike(_CHEROKEE), token.rlike(_LATIN)
    return F.when(cherokee & latin, "compound_clitic").when(cherokee, "cherokee_syllabary").when(latin, "english").otherwise("punctuation")


def line_tokens(lines: DataFrame) -> DataFrame:
    """(line_id, unit_no, token, given, right) of every token; where a line has no tokens, of every
    piece of raw_text between spaces."""
    has = F.size(F.coalesce("tokens", F.array().cast(lines.schema["tokens"].dataType))) > 0
    pieces = F.filter(F.split(F.coalesce("raw_text", F.lit("")), " "), lambda t: t != "")
    listed = F.transform("tokens", lambda t: F.struct(t.raw_token.alias("token"), t.token_type.alias("given")))
    cut = F.transform(pieces, lambda t: F.struct(t.alias("token"), F.lit(None).cast("string").alias("given")))
    out = lines.select("line_id", F.posexplode(F.when(has, listed).otherwise(cut)).alias("unit_no", "t"))
    return out.select("line_id", "unit_no", "t.token", "t.given", token_type(F.col("t.token")).alias("right")).where("token is not null").distinct()


def wrong_tokens(lines: DataFrame) -> DataFrame:
    return line_tokens(lines).where("given is null or lower(given) <> right")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in another language than their document's label names; tokens of the wrong type."""
    found = paragraph_languages(table(spark, sf_dir, "documents")).where(f"lang <> '{UNKNOWN}' and (label is null or lang <> label)")
    docs = found.select(F.lit("document").alias("origin"), F.col("doc_id").alias("rec_id"), "unit_no", "lang").distinct()
    tokens = wrong_tokens(table(spark, sf_dir, "codeswitched_lines"))
    return docs.unionAll(tokens.select(F.lit("line").alias("origin"), F.col("line_id").alias("rec_id"), "unit_no", F.col("right").alias("lang")).distinct())


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's main language, its confidence, and how many languages its paragraphs have."""
    parts = paragraph_languages(table(spark, sf_dir, "documents")).groupBy("doc_id", "label", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    out = parts.groupBy("doc_id", "label").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by("c", F.struct("n", "lang")).alias("c"), F.sum("n").alias("n"), F.count(F.when(F.col("lang") != UNKNOWN, 1)).alias("n_languages"))
    return out.select("doc_id", "label", "lang", (F.col("c") / F.greatest("n", F.lit(1))).alias("confidence"), "n_languages")


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_languages(table(spark, sf_dir, "documents"))


def p3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose type is missing or wrong, with the right one."""
    return wrong_tokens(table(spark, sf_dir, "codeswitched_lines"))


QUERIES = {"p3_found": p3_found, "p3_documents": p3_documents, "p3_paragraphs": p3_paragraphs, "p3_tokens": p3_tokens}

SQL = {
    "p3_tokens": r"""
with t as (
  select line_id, unnest(range(0, len(tokens))) as i, unnest(tokens) as t from codeswitched_lines where len(tokens) > 0
), p as (
  select line_id, list_filter(string_split(coalesce(raw_text, ''), ' '), lambda x: x <> '') as w from codeswitched_lines where coalesce(len(tokens), 0) = 0
), u as (
  select line_id, cast(i as integer) as unit_no, t.raw_token as token, t.token_type as given from t
  union all select line_id, cast(unnest(range(0, len(w))) as integer), unnest(w), null from p
), r as (
  select distinct *, case when regexp_matches(token, '[Ꭰ-᏿ꭰ-ꮿ]') and regexp_matches(token, '\p{Latin}') then 'compound_clitic' when regexp_matches(token, '[Ꭰ-᏿ꭰ-ꮿ]') then 'cherokee_syllabary'
    when regexp_matches(token, '\p{Latin}') then 'english' else 'punctuation' end as "right"
  from u where token is not null
)
select * from r where given is null or lower(given) <> "right"
""",
}
