"""Numeric, array, JSON and hash functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_cost(p: Column, epsilon: float = 1e-6) -> Column:
    """ln(p + e) / ln(e), kept within 0 and 1: a sure event costs nothing, an impossible one 1."""
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must lie between 0 and 1")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(p + epsilon) / F.ln(F.lit(epsilon))))


def negative_log(p: Column, default: float, floor: float = 1e-12) -> Column:
    return F.when(p.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), -F.ln(F.greatest(p, F.lit(floor)))))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    high, low = F.greatest(a, b), F.least(a, b)
    return high + F.log1p(F.exp(low - high))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_softmax(values: Column) -> Column:
    total = bound(F.array_max(values).cast("double"), lambda top: top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))))
    return bound(total, lambda t: F.transform(values, lambda x: x.cast("double") - t))


def argmax(values: Column) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """array<struct<id, value>> of the k largest, the first of equals first."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("n"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p.id, (-p.n).alias("value")))


def soft_gate(log_probs: Column, gate: Column, blank: int) -> Column:
    """Blend of a frame's distribution with one that is all blank, by the probability of speech."""
    return F.transform(log_probs, lambda x, i: F.ln(F.greatest(gate * F.exp(x.cast("double")) + F.when(i == blank, 1 - gate).otherwise(0.0), F.lit(1e-12))))


def relative_improvement(raw: Column, new: Column) -> Column:
    """Percent; 0 where nothing can improve."""
    return F.when(raw > 0, (raw - new) / raw * 100).otherwise(0.0)


def decibels(mean_square: Column, floor: float = 1e-9) -> Column:
    """Level of a mean square in dB of full scale, within -120 and 0."""
    return F.greatest(F.lit(-120.0), F.least(F.lit(0.0), 20 * F.log10(F.greatest(F.sqrt(mean_square), F.lit(floor)))))


def noise_gain(signal_power: Column, noise_power: Column, snr_db: Column) -> Column:
    """Factor that brings noise to a signal-to-noise ratio."""
    return F.sqrt(signal_power / F.nullif(noise_power * F.pow(F.lit(10.0), snr_db / 10), F.lit(0.0)))


def padded(values: Column, length: Column, fill: int = -100) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def encoded(text: Column, vocabulary: dict[str, int], unknown: int) -> Column:
    ids = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(ids, c), F.lit(unknown)))


def cache_key(stem: Column, *parts: Column) -> Column:
    """A stem and 16 hexadecimal digits of what the content depends on."""
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
