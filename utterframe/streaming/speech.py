"""Speech segments from a stream of frame levels: a state machine per source.

A source starts speaking after `start_frames` active frames (cumulative while it is silent) and
stops after `stop_frames` inactive ones in a row; segments shorter than `least_frames` are dropped.
The state between batches is five numbers per source, so a stream may be as long as it likes.

Finished recordings run on sorted frames of many sources at once. All that the machine sees of them is
pieces: active frames with fewer than `stop_frames` inactive ones between two of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENTS = "source string, first_frame bigint, last_frame bigint"
ENTERED = "source__ string, block__ bigint, entry__ bigint, at__ bigint, last__ bigint"
STATE = "speaking boolean, active int, quiet int, first bigint, last bigint"

#: Stands for a frame of an earlier block.
_EARLIER = -(1 << 61)
#: Codes of frames; others, from 0 on, are of the states that blocks are entered in, which stand before their frames.
_ACTIVE, _INACTIVE = -1, -2


@dataclass
class SpeechState:
    speaking: bool = False
    active: int = 0
    quiet: int = 0
    first: int = -1
    last: int = -1


def advance(state: SpeechState, frames: Iterable[tuple[int, float]], level: float, start_frames: int = 3, stop_frames: int = 10, least_frames: int = 5) -> Iterator[tuple[int, int]]:
    """Feeds (frame, value) in order and yields finished segments."""
    for at, value in frames:
        if value >= level:
            state.quiet = 0
            state.last = at
            if not state.speaking:
                if not state.active:
                    state.first = at
                state.active += 1
                state.speaking = state.active >= start_frames
        elif state.speaking:
            state.quiet += 1
            if state.quiet >= stop_frames:
                if state.last - state.first + 1 >= least_frames:
                    yield state.first, state.last
                state.speaking, state.active, state.quiet = False, 0, 0


class _Pieces:
    """The pieces of groups of frames that stand next to each other; group g starts at `begin[g]`.

    `lead` and `trail` are a group's inactive frames before and after its active ones, `upto` the
    active frames before each piece, `reach` the piece in which a source speaks that is silent, with
    no active frame counted, before this one.
    """

    def __init__(self, active: np.ndarray, at: np.ndarray, begin: np.ndarray, start: int, stop: int):
        self.start, self.stop = start, stop
        on = np.flatnonzero(active)
        group = np.searchsorted(begin, on, "right") - 1
        new = np.ones(len(on), dtype=bool)
        new[1:] = (np.diff(on) > stop) | (np.diff(group) > 0)
        heads = np.flatnonzero(new)
        self.upto = np.r_[heads, len(on)]
        tails = self.upto[1:] - 1
        self.first, self.last, self.group = at[on[heads]], at[on[tails]], group[heads]
        self.low, self.high = (np.searchsorted(self.group, np.arange(len(begin)), side) for side in ("left", "right"))
        self.full = np.flatnonzero(self.high > self.low)
        end = np.r_[begin[1:], len(active)]
        self.lead, self.trail = end - begin, end - begin
        self.lead[self.full] = on[heads[self.low[self.full]]] - begin[self.full]
        self.trail[self.full] = end[self.full] - 1 - on[tails[self.high[self.full] - 1]]
        self.reach = np.searchsorted(self.upto[1:], self.upto[:-1] + start)

    def run(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups, first and last frames of the segments that end, and the groups' states after their
        frames. States are rows of five numbers, as in `SpeechState`."""
        cut = (entry[:, 0] > 0) & (entry[:, 2] + self.lead >= self.stop)
        kept = (entry[:, 0] > 0) & ~cut
        before = np.where(cut, 0, entry[:, 1])
        leave = entry.copy()
        leave[cut, :3] = 0
        leave[kept, 2] += self.lead[kept]
        reach, first, ends = self.reach.copy(), self.first.copy(), self.high[self.group]
        low, had = self.low[self.full], before[self.full]
        reach[low] = np.where(kept[self.full], low, np.searchsorted(self.upto[1:], self.upto[low] + self.start - had))
        first[low] = np.where(had > 0, entry[self.full, 3], first[low])

        visited, k, after = [], 0, np.minimum(reach + 1, ends).tolist()
        while k < len(after):
            visited.append(k)
            k = after[k]
        at = np.array(visited, dtype=np.int64)
        to, end, group = reach[at], ends[at], self.group[at]
        spoken = to < end
        closed = spoken & ((to + 1 < end) | (self.trail[group] >= self.stop))

        final = to + 1 >= end
        a, z, g = at[final], end[final], group[final]
        still, silent = (spoken & ~closed)[final], ~spoken[final]
        counted = self.upto[z] - self.upto[a] + np.where(a == self.low[g], before[g], 0)
        leave[g] = np.stack([still, np.where(silent, counted, still * self.start), still * self.trail[g], first[a], self.last[z - 1]], axis=1)
        return np.r_[np.flatnonzero(cut), group[closed]], np.r_[entry[cut, 3], first[at[closed]]], np.r_[entry[cut, 4], self.last[to[closed]]], leave


def _grouped(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Batches, where their groups start, and whether the first one carries on from the batch before."""
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        other = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns], axis=0)
        yield batch, np.r_[0, np.flatnonzero(other) + 1], key == [c[0] for c in columns]
        key = [c[-1] for c in columns]


def speech_segments(frames: DataFrame, source: str, at: str, value: str, level: float, block: int = 100_000, **rule: int) -> DataFrame:
    """The segments of finished recordings; what is still spoken at the end counts.

    Frames are sorted within a partition and read as a stream, many recordings in a batch. One of more
    than `block` frames is cut into blocks of `block` places. Each block is run from every state that it
    may be entered in; one row per block then tells which one it was, and the block is run from there.
    Of the frames of one place the inactive ones come first.
    """
    start, stop, least = max(1, rule.get("start_frames", 3)), max(1, rule.get("stop_frames", 10)), rule.get("least_frames", 5)
    entries = [SpeechState(False, k, 0) for k in range(start)] + [SpeechState(True, start, k) for k in range(stop)]
    number = {(e.speaking, e.active if not e.speaking else 0, e.quiet): i for i, e in enumerate(entries)}
    place = lambda s: number[bool(s.speaking), 0 if s.speaking else int(s.active), int(s.quiet)]
    numbers = lambda states: np.array([[int(x) for x in astuple(s)] for s in states], dtype=np.int64)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown, held = numbers(replace(e, first=_EARLIER, last=_EARLIER) for e in entries), None

        def ended(keys: list[pa.Array], states: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1) * unknown.size, pa.int32()), pa.array(states.ravel()))
            return pa.RecordBatch.from_arrays([*keys, lists], names=["source__", "block__", "ends__"])

        for batch, begin, goes_on in _grouped(batches, "source__", "block__"):
            pieces = _Pieces(batch.column("active__").to_numpy(zero_copy_only=False), batch.column("at__").to_numpy(), begin, start, stop)
            enter = np.repeat(unknown[:, None], len(begin), axis=1)
            if goes_on:
                enter[:, 0] = held[1][0]
            elif held:
                yield ended(*held)
            ends = np.stack([pieces.run(e)[-1] for e in enter], axis=1)
            keys = [batch.column(c).take(pa.array(begin)) for c in ("source__", "block__")]
            yield ended([k[:-1] for k in keys], ends[:-1])
            held = [k[-1:] for k in keys], ends[-1:]
        if held:
            yield ended(*held)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = SpeechState(), []
        pdf = pdf.sort_values("block__")
        for k, ends in zip(pdf["block__"], pdf["ends__"]):
            out.append((k, 2 * place(state) + int(k == pdf["block__"].iloc[-1]), state.first, state.last))
            speaking, active, quiet, first, last = (int(x) for x in ends[5 * place(state) :][:5])
            state = SpeechState(bool(speaking), active, quiet, state.first if first == _EARLIER else first, state.last if last == _EARLIER else last)
        done = pd.DataFrame(out, columns=["block__", "entry__", "at__", "last__"])
        done.insert(0, "source__", pdf["source__"].iloc[0])
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, known = None, numbers([SpeechState()]), numbers(entries)

        def ended(sources: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
            long = np.flatnonzero(last - first + 1 >= least)
            return pa.RecordBatch.from_arrays([sources.take(pa.array(long)), pa.array(first[long]), pa.array(last[long])], names=["source", "first_frame", "last_frame"])

        for batch, begin, goes_on in _grouped(batches, "source__"):
            sources, places, code = batch.column("source__"), batch.column("at__").to_numpy(), batch.column("code__").to_numpy()
            given = code >= 0
            goes_on = goes_on and not given[0]
            if given.any():
                begin = np.union1d(begin, np.flatnonzero(given))
            has = given[begin]
            pieces = _Pieces((code == _ACTIVE)[~given], places[~given], begin - (np.cumsum(given) - given)[begin], start, stop)
            enter, final = np.repeat(fresh, len(begin), axis=0), np.ones(len(begin), dtype=bool)
            if has.any():
                enter[has], final[has] = known[code[given] // 2], code[given] % 2 > 0
                enter[has, 3], enter[has, 4] = places[given], batch.column("last__").drop_null().to_numpy()
            if goes_on:
                enter[0], final[0] = held[1][0], held[2]
            elif held and held[2] and held[1][0, 0]:
                yield ended(held[0], held[1][:, 3], held[1][:, 4])
            group, first, last, leave = pieces.run(enter)
            rest = np.flatnonzero(final[:-1] & (leave[:-1, 0] > 0))
            yield ended(sources.take(pa.array(begin[np.r_[group, rest]])), np.r_[first, leave[rest, 3]], np.r_[last, leave[rest, 4]])
            held = sources[begin[-1] : begin[-1] + 1], leave[-1:], final[-1]
        if held and held[2] and held[1][0, 0]:
            yield ended(held[0], held[1][:, 3], held[1][:, 4])

    rows = frames.select(F.col(source).cast("string").alias("source__"), F.col(at).cast("bigint").alias("at__"), F.col(value).cast("double").alias("value__"))
    rows = rows.where("source__ is not null and at__ is not null and value__ is not null")
    # At most one row for `block` frames, so it may be broadcast.
    long = rows.groupBy("source__").count().where(F.col("count") > block).select("source__", F.lit(True).alias("long__"))
    rows = rows.join(F.broadcast(long), "source__", "left").withColumn("block__", F.when(F.col("long__"), F.floor(F.col("at__") / block)).otherwise(F.lit(0)))
    rows = rows.withColumn("active__", (F.col("value__") >= level) & ~F.isnan("value__"))
    by, columns = ["source__", "block__"], ["source__", "block__", "at__", "active__"]
    cut = rows.where("long__").select(*columns).repartition(*by).sortWithinPartitions(*columns)
    entered = cut.mapInArrow(exits, "source__ string, block__ bigint, ends__ array<bigint>").groupBy("source__").applyInPandas(chain, ENTERED)
    none = F.lit(None).cast("bigint")
    rows = rows.select(*columns, none.alias("entry__"), none.alias("last__")).unionByName(entered.withColumn("active__", F.lit(False)))
    rows = rows.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("entry__"), "at__", "active__")
    code = F.coalesce("entry__", F.when(F.col("active__"), _ACTIVE).otherwise(_INACTIVE))
    return rows.select("source__", "at__", code.alias("code__"), "last__").mapInArrow(run, SEGMENTS)


def speech_stream(frames: DataFrame, source: str, at: str, value: str, level: float, **rule: int) -> DataFrame:
    """The same on a stream: segments come out when they end. Frames of a source arrive in order
    across batches; within one they are sorted."""

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = SpeechState(*state.get) if state.exists else SpeechState()
        pdf = pd.concat(list(batches)).sort_values("at__", kind="stable")
        out = list(advance(held, zip(pdf["at__"], pdf["value__"]), level, **rule))
        state.update(tuple(x if isinstance(x, bool) else int(x) for x in astuple(held)))
        yield pd.DataFrame([(key[0], a, b) for a, b in out], columns=["source", "first_frame", "last_frame"])

    rows = frames.select(F.col(source).cast("string").alias("source__"), F.col(at).cast("bigint").alias("at__"), F.col(value).cast("double").alias("value__"))
    return rows.groupBy("source__").applyInPandasWithState(run, SEGMENTS, STATE, "append", GroupStateTimeout.NoTimeout)
