"""Extension points: distance measures by name, and functions for use in SQL."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterframe.functions.text import _spans
from utterframe.functions.tones import mora_streams, numbered_tones, to_syllabary
from utterframe.operators.alignment import EditCosts, edit_distances, edit_path

#: Distance measures by name: costs of an alphabet, or any function of two lists of texts.
MEASURES: dict[str, EditCosts | Callable[[list[str], list[str]], np.ndarray]] = {
    "plain": EditCosts(),
    "related": EditCosts(substitution={(a, b): w for group, w in (("aeiouv", 0.5), ("dt", 0.3), ("gk", 0.3)) for a in group for b in group if a != b}),
}


def measure(name: str, refs: list[str], hyps: list[str]) -> np.ndarray:
    m = MEASURES[name]
    return edit_distances(refs, hyps, m) if isinstance(m, EditCosts) else np.asarray(m(refs, hyps))


def register_measure(name: str, m: EditCosts | Callable[[list[str], list[str]], np.ndarray]) -> None:
    MEASURES[name] = m


def compose(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Transforms of a signal, one after another."""

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x

    return run


def add_noise(snr_db: float, seed: int, colour: str = "white") -> Callable[[np.ndarray], np.ndarray]:
    """Noise at a signal-to-noise ratio, the same for a seed; pink noise falls with frequency."""

    def run(x: np.ndarray) -> np.ndarray:
        noise = np.random.default_rng(seed).normal(size=len(x))
        if colour == "pink" and len(x) > 1:
            spectrum = np.fft.rfft(noise) / np.sqrt(np.maximum(np.arange(len(x) // 2 + 1), 1))
            noise = np.fft.irfft(spectrum, len(x))
        power = np.mean(noise**2)
        return x + noise * np.sqrt(np.mean(x**2) / (power * 10 ** (snr_db / 10))) if power > 0 else x

    return run


def pcm_samples(payload: str) -> np.ndarray:
    """Samples of a base64 payload: 32-bit floats if its length allows, else 16-bit integers."""
    raw = base64.b64decode(payload)
    return np.frombuffer(raw, "<f4").astype(float) if len(raw) % 4 == 0 else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768.0


def resolve_vocabulary(tokens: dict[str, int], pad: str | None = None, delimiter: str | None = None) -> tuple[dict[int, str], int, int | None]:
    """(token by id, pad id, delimiter id): what is given, else the usual names, else 0 and none."""
    pads = [p for p in (pad, "[PAD]", "<pad>") if p is not None and p in tokens]
    ends = [e for e in (delimiter, "|", " ") if e is not None and e in tokens]
    return {i: t for t, i in tokens.items()}, tokens[pads[0]] if pads else 0, tokens[ends[0]] if ends else None


def tiling(text: str, pieces: dict[str, tuple[str, float]], missing: float = 5.0, longest: int = 2) -> tuple[str, float]:
    """The cheapest way to cover a text with pieces of up to `longest` letters: (what the pieces stand
    for, cost). A letter without a piece stands for itself at a price."""
    best: list[tuple[float, str]] = [(0.0, "")]
    for i in range(1, len(text) + 1):
        ways = [(best[i - 1][0] + missing, best[i - 1][1] + text[i - 1])]
        ways += [(best[i - k][0] + pieces[text[i - k : i]][1], best[i - k][1] + pieces[text[i - k : i]][0]) for k in range(1, min(longest, i) + 1) if text[i - k : i] in pieces]
        best.append(min(ways, key=lambda w: w[0]))
    return best[-1][1], best[-1][0]


def register_functions(spark: SparkSession) -> None:
    """SQL names: edit_cost(ref, hyp), to_syllabary, numbered_tones, mora_tokens, and the table
    functions edit_ops(ref, hyp) and phoneme_spans(text)."""

    @F.pandas_udf(T.DoubleType())
    def edit_cost(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        known = refs.notna() & hyps.notna()
        out = pd.Series(np.nan, index=refs.index)
        out[known] = measure("related", refs[known].tolist(), hyps[known].tolist())
        return out

    text = T.StringType()
    each = lambda fn: F.pandas_udf(lambda s: pd.Series([None if t is None else fn(t) for t in s], dtype=object), text, F.PandasUDFType.SCALAR)
    for name, fn in (("to_syllabary", to_syllabary), ("numbered_tones", numbered_tones), ("mora_tokens", lambda t: mora_streams(numbered_tones(t))[1])):
        spark.udf.register(name, each(fn))
    spark.udf.register("edit_cost", edit_cost)

    class EditOps:
        def eval(self, ref: str, hyp: str) -> Iterator[tuple]:
            if ref is not None and hyp is not None:
                for place, step in enumerate(edit_path(ref, hyp)):
                    yield place, *step

    class PhonemeSpans:
        def eval(self, t: str) -> Iterator[tuple]:
            yield from _spans(t or "")

    spark.udtf.register("edit_ops", F.udtf(EditOps, returnType="place int, op string, ref string, hyp string"))
    spark.udtf.register("phoneme_spans", F.udtf(PhonemeSpans, returnType="symbol string, category string, start int, end int"))
