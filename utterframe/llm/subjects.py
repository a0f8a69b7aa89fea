"""Subject areas of documents.

The document-term matrix of labelled documents is factored into non-negative components by seeded
alternating multiplicative updates under the Kullback-Leibler divergence. One component is anchored
for each subject and language (a document starts with the subjects that annotators gave it) and one
for each language takes the words that every subject uses; the labels only seed the factors, so a
wrong one is outvoted by the terms. The subjects' components give each term its share per subject,
and the same update with the documents' mixtures held fixed gives the share of a term *in its
context* (with the word before or after it), which tells a term from the same word in another sense.

Fitting takes at most MAX_FIT labelled documents (those with the smallest hash); every sentence of
every document is scored. A document's mixture is its half of the alternating update; it decides how
much of each word is each subject's, and so which sentences deal with a subject. Two sentences make
a subject. Cherokee words of the glossary, in either script and with or without an ending,
count as their English term.

Defined results: null ids and null or empty texts have no subject; labels that are null, repeated, of unknown
documents or of unknown subjects seed nothing; without any label there is no subject; equal rows
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.llm.characters import WORD_INNER, search_form
from utterframe.llm.languages import label_language
from utterframe.session import smallest_hashes, table

MAX_FIT = 8000
LEAST_DOCS, ROUNDS, FREE_AFTER, SEED_REST = 5, 30, 28, 0.1
#: A term may be a subject's if this share of it is; a word is if that share is under its document's
#: mixture, which is updated so often and mixed with the corpus's own by DAMPING.
TERM_SHARE, WORD_SHARE, MIX_ROUNDS, DAMPING = 0.5, 0.4, 1, 1.0
PRIOR, LEAST_CONTEXT = 2.0, 5
MIN_SENTENCES = 2
#: Entries of the document-term matrix that are held at once with all components.
BLOCK = 20_000
#: The language that documents without a usable label start with; the terms move them.
COMMON = "en"
# Endings that a Cherokee word may carry here.
ENDINGS = ("Ꮧ", "Ꭲ", "Ꮒ", "di", "ni", "i")
MAX_SPELLINGS = 300_000
UNKNOWN, STOP, NOTHING = -1, -2, -3
_CHEROKEE = re.compile("[Ꭰ-ᏽꭰ-ꮿ]")
_TOKEN = re.compile(rf"[\w{WORD_INNER}]+|[.!?…]+[\"'”’)\]]*(?=\s|$)|[\r\n]+")


def fold(raw: str) -> str:
    """A word without marks, case and look-alikes."""
    w = search_form(raw)
    if w.isascii():
        return w
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def script(text: str) -> str:
    """The script of most letters, as far as it matters here."""
    return "cherokee" if 2 * len(_CHEROKEE.findall(text)) > sum(map(str.isalpha, text)) else "other"


class Lexicon:
    """Words, glossary terms and phrases as numbers."""

    def __init__(self, glossary: Iterable[tuple[str | None, str | None, str | None]] = ()):
        self.ids: dict[str, int] = {}
        self.stems: dict[str, str] = {}
        self.phrases: dict[tuple[str, str], str] = {}
        for syllabary, phonetic, english in glossary:
            if not english:
                continue
            words = [fold(w) for w in english.split()]
            for stem in (syllabary, phonetic):
                if stem:
                    self.stems.setdefault(fold(stem), " ".join(words))
            if len(words) == 2:
                self.phrases[words[0], words[1]] = " ".join(words)
        self.spellings: dict[str, int] = {}
        self.endings = tuple(fold(e) for e in ENDINGS)
        self.growing = True
        self.pairs: dict[int, int] = {}

    def term(self, raw: str) -> str:
        w = fold(raw)
        if w in self.stems:
            return self.stems[w]
        for e in self.endings:
            if w.endswith(e) and w[: -len(e)] in self.stems:
                return self.stems[w[: -len(e)]]
        return w

    def number(self, raw: str) -> int:
        first = raw[0]
        if first in "\r\n.!?…":
            k = STOP
        else:
            w = self.term(raw.replace("_", ""))
            k = NOTHING if not w else self.ids.setdefault(w, len(self.ids)) if self.growing else self.ids.get(w, UNKNOWN)
        if len(self.spellings) > MAX_SPELLINGS:
            self.spellings.clear()
        self.spellings[raw] = k
        return k

    def freeze(self, kept: list[str]) -> None:
        """From now on only `kept` words have numbers, which are their places."""
        kept = list(dict.fromkeys([*kept, *(w for pair in self.phrases for w in pair), *self.phrases.values()]))
        self.ids = {w: i for i, w in enumerate(kept)}
        self.spellings, self.growing = {}, False

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, document, sentence) of all words; sentences are numbered through all texts."""
        known, flat, size = self.spellings, [], []
        for t in texts:
            tokens = _TOKEN.findall(t)
            flat += tokens
            size.append(len(tokens))
        ids = np.fromiter((known[w] if w in known else self.number(w) for w in flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), size)
        sentence = np.cumsum((ids == STOP) | np.r_[False, doc[1:] != doc[:-1]]) if len(ids) else ids
        real = ids >= UNKNOWN
        ids, doc, sentence = ids[real], doc[real], sentence[real]
        return self._joined(ids, doc, sentence)

    def _joined(self, ids: np.ndarray, doc: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two words that are a phrase of the glossary become one."""
        table = {}
        for (a, b), phrase in self.phrases.items():
            if a in self.ids and b in self.ids:
                table[self.ids[a] << 32 | self.ids[b]] = self.ids[phrase] if not self.growing else self.ids.setdefault(phrase, len(self.ids))
        if not table or len(ids) < 2:
            return ids, doc, sentence
        keys = np.array(sorted(table))
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0) & (sentence[1:] == sentence[:-1]), ids[:-1] << 32 | ids[1:], -1)
        at = np.flatnonzero(np.isin(pair, keys))
        ids = ids.copy()
        ids[at] = [table[k] for k in pair[at].tolist()]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        return ids[keep], doc[keep], sentence[keep]


class Sparse:
    """Counts of a document-term matrix, in blocks of documents, so that the components of few
    entries are held at once."""

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]):
        key, count = np.unique(row.astype(np.int64) * shape[1] + col, return_counts=True)
        rows, cols = key // shape[1], key % shape[1]
        self.shape, self.blocks = shape, []
        self.docs_of_col = np.bincount(cols, minlength=shape[1])
        self.total_of_col = np.bincount(cols, count, shape[1])
        lo = 0
        while lo < len(rows):
            hi = int(np.searchsorted(rows, rows[min(lo + BLOCK, len(rows)) - 1], "right"))
            r, c = rows[lo:hi], cols[lo:hi]
            r_heads, c_order = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), np.argsort(c, kind="stable")
            sorted_c = c[c_order]
            c_heads = np.flatnonzero(np.r_[True, sorted_c[1:] != sorted_c[:-1]])
            self.blocks.append((r, c, count[lo:hi].astype(np.float32), r_heads, r[r_heads], c_order, c_heads, sorted_c[c_heads]))
            lo = hi

    def shared(self, w: np.ndarray, ht: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Counts V * WH / (WH), shared among the components: their sums by document and by term.

        `ht` is the transpose of H; without it the counts are shared by W alone.
        """
        by_row, by_col = np.zeros(w.shape, np.float32), np.zeros((self.shape[1], w.shape[1]), np.float32)
        for r, c, count, r_heads, r_of, c_order, c_heads, c_of in self.blocks:
            x = w[r] if ht is None else w[r] * ht[c]
            x *= (count / np.maximum(x.sum(axis=1), 1e-12))[:, None]
            by_row[r_of] = np.add.reduceat(x, r_heads, axis=0)
            by_col[c_of] += np.add.reduceat(x[c_order], c_heads, axis=0)
        return by_row, by_col


def factor(v: Sparse, seeds: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS, free_after: int = FREE_AFTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W, transpose of H, counts of terms by component) by multiplicative updates from the seeds.

    `mask` anchors: a document keeps to the components that it gives weight. The last rounds are
    free, too few to drift, so that terms can overrule a label.
    """
    w = (seeds / seeds.sum(axis=1, keepdims=True)).astype(np.float32)
    rest = (1e-3 * v.total_of_col / max(1.0, v.total_of_col.sum())).astype(np.float32)[:, None]
    # The anchored components start from their seeded documents alone.
    counts = v.shared(w, None)[1] + rest
    for i in range(rounds):
        ht = counts / np.maximum(counts.sum(axis=0), 1e-12)
        by_row, counts = v.shared(w, ht)
        w = by_row * (mask if i < free_after else 1.0) + 1e-6
        w = (w / w.sum(axis=1, keepdims=True)).astype(np.float32)
    ht = counts / np.maximum(counts.sum(axis=0), 1e-12)
    return w, ht, v.shared(w, ht)[1]


def with_rest(share: np.ndarray) -> np.ndarray:
    """Shares with one column more for what is no subject's."""
    return np.maximum(np.column_stack([share, 1 - share.sum(axis=1)]), 1e-9).astype(np.float32)


class SubjectModel:
    """Shares of terms, and of terms in context, per subject."""

    def __init__(self, subjects: list[str], lexicon: Lexicon):
        self.subjects, self.lexicon = subjects, lexicon
        self.components = np.zeros((0, len(subjects)), np.float32)
        self.term_subject = np.zeros(0, np.int64)
        self.context_keys = np.zeros(0, np.int64)
        self.context_shares = np.zeros((0, len(subjects)))
        self.prior = np.full(len(subjects) + 1, 1 / (len(subjects) + 1))

    def fit(self, texts: list[str], given: list[list[str]], languages: list[str]) -> SubjectModel:
        """Texts with their subjects and the languages of their labels."""
        lex, n = self.lexicon, len(self.subjects)
        # A language written in two scripts has two vocabularies.
        seeds, mask = self.seeds(given, [f"{lang} {script(t)}" for lang, t in zip(languages, texts)])
        ids, doc, _ = lex.numbers(texts)
        pair = np.unique(doc * (len(lex.ids) + 1) + ids)
        docs = np.bincount(pair % (len(lex.ids) + 1), minlength=len(lex.ids) + 1)
        words = list(lex.ids)
        lex.freeze([w for w, d in zip(words, docs) if d >= LEAST_DOCS])
        ids, doc, sentence = lex.numbers(texts)
        known = ids >= 0
        size = len(lex.ids)
        v = Sparse(doc[known], ids[known], (len(texts), size))
        w, ht, counts = factor(v, seeds, mask)
        total = counts.sum(axis=1)
        share = self._by_subject(counts) / (total + PRIOR)[:, None]
        self.term_subject = np.where(share.max(axis=1) >= TERM_SHARE, share.argmax(axis=1), -1)
        self.components, self.word_share = ht, with_rest(share)
        self._contexts(ids, doc, sentence, w, len(texts))
        fitted = self._senses(ids, sentence)[1]
        self.prior = np.maximum(fitted.mean(axis=0), 1e-6) if len(fitted) else self.prior
        return self

    def seeds(self, given: list[list[str]], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each document's mixture starts, and what it is kept to.

        Components: subject 0 in every language, subject 1 in every language, ..., then one for
        each language. A document may use any language's component of its subjects, as it may mix
        languages; it starts with that of its label.
        """
        n, names = len(self.subjects), sorted(set(languages))
        m = len(names)
        start = np.full((len(given), n * m + m), SEED_REST / m)
        mask = np.full((len(given), n * m + m), SEED_REST)
        mask[:, n * m :] = 1.0
        for i, (subjects, language) in enumerate(zip(given, languages)):
            at = names.index(language)
            start[i, n * m + at] = 1.0
            for s in subjects:
                k = self.subjects.index(s)
                mask[i, k * m : k * m + m] = 1.0
                start[i, k * m + at] = 1.0
        self.n_languages = m
        return start, mask

    def _by_subject(self, x: np.ndarray) -> np.ndarray:
        """Sums of (row, component) over each subject's components."""
        n, m = len(self.subjects), self.n_languages
        return x[:, : n * m].reshape(len(x), n, m).sum(axis=2)

    def _candidates(self, ids: np.ndarray) -> np.ndarray:
        return (ids >= 0) & (self.term_subject[np.maximum(ids, 0)] >= 0)

    def _context_keys(self, ids: np.ndarray, sentence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (word before, term) and (term, word after); -1 at a sentence's ends, for unknown words."""
        padded = np.r_[UNKNOWN, ids, UNKNOWN]
        s = np.r_[-1, sentence, -1]
        before = np.where(s[at] == s[at + 1], padded[at], UNKNOWN)
        after = np.where(s[at + 2] == s[at + 1], padded[at + 2], UNKNOWN)
        # Next to a term of the same subject a term is in its own sense.
        before[self._same_subject(before, ids[at])] = UNKNOWN
        after[self._same_subject(after, ids[at])] = UNKNOWN
        size = len(self.lexicon.ids)
        left = np.where(before >= 0, (before * size + ids[at]) * 2, -1)
        right = np.where(after >= 0, (after * size + ids[at]) * 2 + 1, -1)
        return left, right

    def _same_subject(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a >= 0) & (self.term_subject[np.maximum(a, 0)] == self.term_subject[b])

    def _contexts(self, ids: np.ndarray, doc: np.ndarray, sentence: np.ndarray, w: np.ndarray, n_docs: int) -> None:
        at = np.flatnonzero(self._candidates(ids))
        if not len(at):
            return
        left, right = self._context_keys(ids, sentence, at)
        keys, owner = np.r_[left, right], np.r_[doc[at], doc[at]]
        keys, owner = keys[keys >= 0], owner[keys >= 0]
        distinct, col = np.unique(keys, return_inverse=True)
        v = Sparse(owner, col, (n_docs, len(distinct)))
        # A context starts from its documents' mixtures, and the mixtures stay fixed.
        hc = np.full((len(distinct), w.shape[1]), 1 / len(distinct), np.float32)
        for _ in range(10):
            counts = v.shared(w, hc)[1]
            hc = counts / np.maximum(w.sum(axis=0), 1e-12)
        total = counts.sum(axis=1)
        enough = v.docs_of_col >= LEAST_CONTEXT
        self.context_keys = distinct[enough]
        self.context_shares = (self._by_subject(counts) / np.maximum(total, 1e-12)[:, None])[enough]

    def _senses(self, ids: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that may deal with a subject, and the share of each subject, and of none, in each:
        its term's, or that of a context which leaves its subject less."""
        at = np.flatnonzero(self._candidates(ids)) if len(ids) else np.zeros(0, int)
        share = self.word_share[ids[at]] if len(at) else np.zeros((0, len(self.subjects) + 1), np.float32)
        subject, place = self.term_subject[ids[at]] if len(at) else at, np.arange(len(at))
        for key in self._context_keys(ids, sentence, at) if len(at) and len(self.context_keys) else ():
            found = np.minimum(np.searchsorted(self.context_keys, key), len(self.context_keys) - 1)
            less = (self.context_keys[found] == key) & (self.context_shares[found, subject] < share[place, subject])
            share[less] = with_rest(self.context_shares[found[less]])
        return at, share

    def _posteriors(self, doc: np.ndarray, share: np.ndarray, n_docs: int, prior: np.ndarray, rounds: int = MIX_ROUNDS) -> np.ndarray:
        """Each word's shares under its document's mixture, which is updated from them in turn."""
        x = share
        for _ in range(rounds):
            w = np.stack([np.bincount(doc, x[:, k], n_docs) for k in range(share.shape[1])], axis=1)
            w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
            x = share * (w / prior + DAMPING)[doc]
            x /= np.maximum(x.sum(axis=1, keepdims=True), 1e-12)
        return x

    def sentences(self, texts: list[str]) -> pd.DataFrame:
        """(doc, subject, n): sentences of each text that deal with each subject.

        A sentence does if the document's mixture gives the subject the greater part of one of its
        words, so a word that may be a subject's counts less where nothing else in the document is.
        """
        ids, doc, sentence = self.lexicon.numbers(texts)
        at, share = self._senses(ids, sentence)
        x = self._posteriors(doc[at], share, len(texts), self.prior)[:, : len(self.subjects)]
        word, subject = np.nonzero(x >= WORD_SHARE)
        hits = pd.DataFrame({"doc": doc[at][word], "sentence": sentence[at][word], "subject": subject}).drop_duplicates()
        return hits.groupby(["doc", "subject"], as_index=False).size().rename(columns={"size": "n"})

    def mixtures(self, texts: list[str], rounds: int = 8) -> np.ndarray:
        """(text, component): the documents' half of the alternating update."""
        ids, doc, _ = self.lexicon.numbers(texts)
        known = ids >= 0
        w = np.full((len(texts), self.components.shape[1]), 1 / self.components.shape[1], np.float32)
        v = Sparse(doc[known], ids[known], (len(texts), len(self.lexicon.ids)))
        for _ in range(rounds):
            w = v.shared(w, self.components)[0] + 1e-6
            w /= w.sum(axis=1, keepdims=True)
        return w


def fit_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, glossary: DataFrame, max_fit: int = MAX_FIT) -> SubjectModel | None:
    subjects = sorted(r.subject for r in areas.select("subject").distinct().collect() if r.subject)
    words = [tuple(r) for r in glossary.select("syllabary", "phonetic", "english").distinct().collect()]
    given = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin([s.lower() for s in subjects])).distinct()
    # No more than max_fit ids, each with at most one row per subject area.
    chosen = smallest_hashes(given.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")), max_fit, "doc_id")
    texts = documents.where("text is not null").select("doc_id", "text", F.coalesce(label_language(F.col("lang")), F.lit(COMMON)).alias("label"))
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    named = {s.lower(): s for s in subjects}
    given = [sorted(named[s] for s in r.subjects) for r in rows]
    return SubjectModel(subjects, Lexicon(sorted(words, key=str))).fit([r.text for r in rows], given, [r.label for r in rows])


def _sentences(sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = sent.value
    names = np.array(model.subjects, dtype=object)
    for pdf in batches:
        pdf = pdf[pdf["text"].notna()]
        for lo in range(0, len(pdf), 2000):
            part = pdf.iloc[lo : lo + 2000]
            found = model.sentences(part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[found["doc"]], "subject": names[found["subject"]], "n_sentences": found["n"]})


def _mixtures(sent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = sent.value
    for pdf in batches:
        pdf = pdf[pdf["text"].notna()]
        for lo in range(0, len(pdf), 2000):
            part = pdf.iloc[lo : lo + 2000]
            w = model._by_subject(model.mixtures(part["text"].tolist()))
            yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(), w.shape[1]), "subject": model.subjects * len(part), "share": w.ravel()})


def document_subjects(documents: DataFrame, model: SubjectModel | None) -> DataFrame:
    """(doc_id, subject, n_sentences): sentences of each document that deal with each subject."""
    schema = "doc_id bigint, subject string, n_sentences bigint"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(lambda b: _sentences(sent, b), schema)


def document_mixtures(documents: DataFrame, model: SubjectModel | None) -> DataFrame:
    """(doc_id, subject, share) for every subject; the rest of a document is no subject's."""
    schema = "doc_id bigint, subject string, share double"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(lambda b: _mixtures(sent, b), schema)


def _model(spark: SparkSession, sf_dir: str) -> SubjectModel | None:
    return fit_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas", "glossary")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the subjects that at least two of their sentences deal with."""
    found = document_subjects(table(spark, sf_dir, "documents"), _model(spark, sf_dir))
    return found.where(F.col("n_sentences") >= MIN_SENTENCES).select("doc_id", "subject").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject: documents that deal with it, its share of the documents, and its share of the
    corpus by the documents' mixtures."""
    documents, model = table(spark, sf_dir, "documents"), _model(spark, sf_dir)
    found = document_subjects(documents, model).where(F.col("n_sentences") >= MIN_SENTENCES).groupBy("subject").agg(F.count("*").alias("n_documents"))
    mixed = document_mixtures(documents, model).groupBy("subject").agg(F.avg("share").alias("mean_share"), F.count("*").alias("n_all"))
    return mixed.join(found, "subject", "left").select("subject", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), (F.coalesce("n_documents", F.lit(0)) / F.col("n_all")).alias("document_share"), "mean_share")


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
