"""Sequence alignment and decoding kernels in numpy, and the operators that run them on tables.

Edit distances of any cost table are computed for a whole batch of pairs at once. The alignments
with steps of several symbols share one lattice search, which takes the first of equally good steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, SUBSTITUTE, DELETE, INSERT = 0, 1, 2, 3
OPS = np.array(["match", "substitute", "delete", "insert"], dtype=object)


# -- edit distance over batches ------------------------------------------------------------------
class EditCosts:
    """Costs over an alphabet: substitution by (reference, hypothesis), deletion, insertion."""

    def __init__(self, letters: Iterable[str] = (), substitution: dict[tuple[str, str], float] | None = None, deletion: dict[str, float] | None = None, insertion: dict[str, float] | None = None, default: tuple[float, float, float] = (1.0, 1.0, 1.0)):
        letters = sorted({*letters, *(x for pair in substitution or {} for x in pair), *(deletion or {}), *(insertion or {})})
        self.codes = {c: i + 1 for i, c in enumerate(letters)}
        size, (sub, rem, add) = len(letters) + 1, default
        self.sub, self.rem, self.add = np.full((size, size), sub), np.full(size, rem), np.full(size, add)
        for (a, b), v in (substitution or {}).items():
            self.sub[self.codes[a], self.codes[b]] = v
        for c, v in (deletion or {}).items():
            self.rem[self.codes[c]] = v
        for c, v in (insertion or {}).items():
            self.add[self.codes[c]] = v

    def of(self, points: np.ndarray) -> np.ndarray:
        """Alphabet numbers of code points; 0 for letters without costs of their own."""
        if not self.codes:
            return np.zeros_like(points)
        known = np.array([ord(c) for c in self.codes])
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], points), len(known) - 1)
        return np.where(known[order][at] == points, np.array(list(self.codes.values()))[order][at], 0)


def _matrix(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, size.max(initial=0))), np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out, size


def edit_table(refs: Sequence[str], hyps: Sequence[str], costs: EditCosts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, reference points, sizes, hypothesis points, sizes); table[i, j] over all pairs."""
    a, n = _matrix(refs)
    b, m = _matrix(hyps)
    ca, cb = costs.of(a), costs.of(b)
    table = np.zeros((a.shape[1] + 1, b.shape[1] + 1, len(refs)))
    table[1:, 0] = np.cumsum(costs.rem[ca], axis=1).T
    table[0, 1:] = np.cumsum(costs.add[cb], axis=1).T
    for i in range(1, a.shape[1] + 1):
        same = a[:, i - 1, None] == b
        step = np.where(same, 0.0, costs.sub[ca[:, i - 1, None], cb]).T
        rem, add = costs.rem[ca[:, i - 1]], costs.add[cb].T
        for j in range(1, b.shape[1] + 1):
            table[i, j] = np.minimum(np.minimum(table[i - 1, j - 1] + step[j - 1], table[i - 1, j] + rem), table[i, j - 1] + add[j - 1])
    return table, a, n, b, m


def edit_distances(refs: Sequence[str], hyps: Sequence[str], costs: EditCosts | None = None) -> np.ndarray:
    if not len(refs):
        return np.zeros(0)
    table, _, n, _, m = edit_table(refs, hyps, costs or EditCosts())
    return table[n, m, np.arange(len(refs))]


def edit_operations(refs: Sequence[str], hyps: Sequence[str], costs: EditCosts | None = None) -> pd.DataFrame:
    """(pair, place, op, ref, hyp) of the best path; of equal ones match, substitution, deletion and
    insertion in this order, from the end backwards."""
    costs = costs or EditCosts()
    table, a, i, b, j = edit_table(refs, hyps, costs)
    ca, cb = costs.of(a), costs.of(b)
    i, j, out, step = i.copy(), j.copy(), [], 0
    while (live := np.flatnonzero((i > 0) | (j > 0))).size:
        x, y = i[live], j[live]
        here, px, py = table[x, y, live], np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        ra, rb = a[live, px], b[live, py]
        both = (x > 0) & (y > 0)
        same = both & (ra == rb) & np.isclose(table[px, py, live], here)
        sub = both & ~same & (ra != rb) & np.isclose(table[px, py, live] + costs.sub[ca[live, px], cb[live, py]], here)
        rem = ~same & ~sub & (x > 0) & np.isclose(table[px, y, live] + costs.rem[ca[live, px]], here)
        op = np.where(same, MATCH, np.where(sub, SUBSTITUTE, np.where(rem, DELETE, INSERT)))
        out.append(pd.DataFrame({"pair": live, "back": step, "op": op, "ref": np.where(op == INSERT, 0, ra), "hyp": np.where(op == DELETE, 0, rb)}))
        i[live] -= op != INSERT
        j[live] -= op != DELETE
        step += 1
    if not out:
        return pd.DataFrame({"pair": [], "place": [], "op": [], "ref": [], "hyp": []})
    found = pd.concat(out).sort_values(["pair", "back"], ascending=[True, False], kind="stable")
    letter = lambda s: [chr(v) if v else "" for v in s]
    return pd.DataFrame({"pair": found["pair"].to_numpy(), "place": found.groupby("pair").cumcount().to_numpy(), "op": OPS[found["op"].to_numpy()], "ref": letter(found["ref"]), "hyp": letter(found["hyp"])})


def _by_length(pdf: pd.DataFrame, ref: str, hyp: str, cells: int = 3_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose tables stay small, pairs of similar length together."""
    size = np.maximum(pdf[ref].str.len().to_numpy(), pdf[hyp].str.len().to_numpy()) + 1
    pdf, size = pdf.iloc[np.argsort(size, kind="stable")], np.sort(size)
    lo = 0
    while lo < len(pdf):
        hi = lo + 1
        while hi < len(pdf) and (hi - lo + 1) * int(size[hi]) ** 2 <= cells:
            hi += 1
        yield pdf.iloc[lo:hi]
        lo = hi


def with_edit_distance(df: DataFrame, ref: str, hyp: str, costs: EditCosts, name: str = "distance") -> DataFrame:
    """Adds the weighted edit distance of two text columns; rows with a null text are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _by_length(pdf, ref, hyp):
                yield part.assign(**{name: edit_distances(part[ref].tolist(), part[hyp].tolist(), costs)})

    df = df.where(df[ref].isNotNull() & df[hyp].isNotNull())
    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double")


def edit_counts(df: DataFrame, keys: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """(keys, op, ref, hyp, n): counts of aligned letters, combined within each batch."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _by_length(pdf, ref, hyp):
                ops = edit_operations(part[ref].tolist(), part[hyp].tolist())
                rows = part[list(keys)].iloc[ops["pair"].to_numpy().astype(int)].reset_index(drop=True)
                rows = pd.concat([rows, ops[["op", "ref", "hyp"]].reset_index(drop=True)], axis=1)
                rows.columns = [*keys, "op", "src", "tgt"]
                yield rows.groupby(list(rows.columns), dropna=False, as_index=False).size().rename(columns={"size": "n"})

    df = df.where(df[ref].isNotNull() & df[hyp].isNotNull()).select(*keys, ref, hyp)
    parts = df.mapInPandas(run, ", ".join(f"{k} {fields[k]}" for k in keys) + (", " if keys else "") + "op string, src string, tgt string, n bigint")
    return parts.groupBy(*keys, "op", "src", "tgt").agg(F.sum("n").alias("n"))


# -- alignments with steps of several symbols ----------------------------------------------------
def lattice(n: int, m: int, steps: Callable[[int, int], Iterable[tuple[int, int, float]]]) -> tuple[float, list[tuple[int, int, int, int, float]]]:
    """(cost, path of (i, j, di, dj, cost)) of the cheapest way from (0, 0) to (n, m).

    `steps(i, j)` gives what may follow a node; a later step must be strictly cheaper to win.
    """
    best = np.full((n + 1, m + 1), math.inf)
    came: dict[tuple[int, int], tuple[int, int, float]] = {}
    best[0, 0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = best[i, j]
            if here == math.inf:
                continue
            for di, dj, cost in steps(i, j):
                if i + di <= n and j + dj <= m and here + cost < best[i + di, j + dj]:
                    best[i + di, j + dj] = here + cost
                    came[i + di, j + dj] = (di, dj, cost)
    path, i, j = [], n, m
    while (i, j) != (0, 0) and (i, j) in came:
        di, dj, cost = came[i, j]
        i, j = i - di, j - dj
        path.append((i, j, di, dj, cost))
    return float(best[n, m]), path[::-1]


def prefix_distances(reference: str, hypotheses: Sequence[str]) -> np.ndarray:
    """(hypothesis, j, i): edit distance of its first j letters and the reference's first i.

    One pass over the hypotheses' letters; a column's chain of deletions is a running minimum.
    """
    points, size = _matrix(hypotheses)
    ref = np.frombuffer(reference.encode("utf-32-le"), np.uint32).astype(np.int64)
    steps = np.arange(len(ref) + 1)
    column = np.tile(steps.astype(float), (len(hypotheses), 1))
    out = np.empty((len(hypotheses), points.shape[1] + 1, len(ref) + 1))
    out[:, 0] = column
    for j in range(points.shape[1]):
        fresh = column + 1
        fresh[:, 1:] = np.minimum(fresh[:, 1:], column[:, :-1] + (points[:, j, None] != ref))
        column = np.minimum.accumulate(fresh - steps, axis=1) + steps
        out[:, j + 1] = column
    return out


def edit_path(ref: str, hyp: str) -> list[tuple[str, str, str]]:
    """(op, ref, hyp) of one pair at unit costs, with the preferences of `edit_operations`."""
    table = prefix_distances(ref, [hyp])[0]
    i, j, out = len(ref), len(hyp), []
    while i or j:
        here = table[j, i]
        if i and j and ref[i - 1] == hyp[j - 1] and table[j - 1, i - 1] == here:
            i, j = i - 1, j - 1
            out.append(("match", ref[i], hyp[j]))
        elif i and j and ref[i - 1] != hyp[j - 1] and table[j - 1, i - 1] + 1 == here:
            i, j = i - 1, j - 1
            out.append(("substitute", ref[i], hyp[j]))
        elif i and table[j, i - 1] + 1 == here:
            i -= 1
            out.append(("delete", ref[i], ""))
        else:
            j -= 1
            out.append(("insert", "", hyp[j]))
    return out[::-1]


def fused_rates(words: Sequence[str], tokens: Sequence[str], most: tuple[int, int] = (4, 3)) -> dict[tuple[int, int, int, int], float]:
    """Error rate of every stretch of words (from i, a of them) and of tokens (from j, b of them)."""
    out: dict[tuple[int, int, int, int], float] = {}
    parts = [tokens[j : j + most[1]] for j in range(len(tokens))]
    ends = [np.cumsum([len(t) for t in p]) for p in parts]
    texts = ["".join(p) for p in parts]
    for i in range(len(words) if tokens else 0):
        stretch = words[i : i + most[0]]
        upto = np.cumsum([len(w) for w in stretch])
        table = prefix_distances("".join(stretch), texts)
        for j, e in enumerate(ends):
            rate = table[j][np.ix_(e, upto)] / np.maximum(upto, 1)
            for b, row in enumerate(rate.tolist(), 1):
                for a, cost in enumerate(row, 1):
                    out[i, j, a, b] = cost
    return out


def align_words(words: Sequence[str], tokens: Sequence[str], gap: float = 0.8, fuse: float = 0.15, most: tuple[int, int] = (4, 3)) -> list[tuple[int, int, int, int, float]]:
    """Words to tokens, several of either fused where that is cheaper; gaps for those left over."""
    cost = fused_rates(words, tokens, most)

    def steps(i: int, j: int) -> Iterator[tuple[int, int, float]]:
        yield 1, 0, gap
        yield 0, 1, gap
        for a in range(1, min(most[0], len(words) - i) + 1):
            for b in range(1, min(most[1], len(tokens) - j) + 1):
                yield a, b, cost[i, j, a, b] + fuse * (a + b - 2)

    return lattice(len(words), len(tokens), steps)[1]


def locate_chunks(texts: Sequence[str], tokens: Sequence[str], first_skip: int = 30, skip: int = 5) -> list[tuple[int, int, float]]:
    """(start, end, cost) of each text's best stretch of tokens, in order and without overlap.

    A stretch costs the lesser error rate of its tokens with and without spaces; the first of equals
    in order of start and length. The cost that is reported is that with spaces.
    """
    at, out = 0, []
    for k, text in enumerate(texts):
        longest = max(3 * len(text.split()), 10)
        starts = range(at, min(at + (skip if k else first_skip), len(tokens) - 1) + 1)
        if not text.strip() or not len(starts):
            out.append((at, at, 1.0))
            continue
        parts = [tokens[s : s + longest] for s in starts]
        ends = [np.cumsum([len(t) for t in p]) for p in parts]
        plain = prefix_distances(text, ["".join(p) for p in parts])[:, :, -1]
        spaced = prefix_distances(text, [" ".join(p) for p in parts])[:, :, -1]
        best = (math.inf, at, at, 1.0)
        for i, s in enumerate(starts):
            a, b = plain[i, ends[i]], spaced[i, ends[i] + np.arange(len(ends[i]))]
            low = np.minimum(a, b)
            e = int(low.argmin())
            if low[e] < best[0]:
                best = (low[e], s, s + e + 1, b[e] / len(text))
        out.append(best[1:])
        at = best[2]
    return out


def align_grams(source: Sequence[str], target: Sequence[str], substitute: Callable[[str, str], float], delete: Callable[[str], float], insert: Callable[[str], float]) -> tuple[float, list[tuple[int, int, int, int, float]]]:
    """One or two source symbols against none, one or two target symbols.

    Of equally cheap ways into a node, the plain substitution, then the deletion, the insertion and
    the steps of two symbols.
    """
    n, m = len(source), len(target)
    best = np.full((n + 1, m + 1), math.inf)
    best[0, 0] = 0.0
    came: dict[tuple[int, int], tuple[int, int, float]] = {}
    two_s = [f"{a} {b}" for a, b in zip(source, source[1:])]
    two_t = [a + b for a, b in zip(target, target[1:])]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i and j:
                ways.append((1, 1, substitute(source[i - 1], target[j - 1])))
            if i:
                ways.append((1, 0, delete(source[i - 1])))
            if j:
                ways.append((0, 1, insert(target[j - 1])))
            if i and j > 1:
                ways.append((1, 2, substitute(source[i - 1], two_t[j - 2])))
            if i > 1 and j:
                ways.append((2, 1, substitute(two_s[i - 2], target[j - 1])))
            if i > 1 and j > 1:
                ways.append((2, 2, substitute(two_s[i - 2], two_t[j - 2])))
            for di, dj, cost in ways:
                if best[i - di, j - dj] + cost < best[i, j]:
                    best[i, j] = best[i - di, j - dj] + cost
                    came[i, j] = (di, dj, cost)
    path, i, j = [], n, m
    while i or j:
        di, dj, cost = came[i, j]
        i, j = i - di, j - dj
        path.append((i, j, di, dj, cost))
    return float(best[n, m]), path[::-1]


def _sound_costs() -> np.ndarray:
    """Cost of one sound for another: less for two vowels, for d and t, for g and k."""
    cost = np.ones((128, 128))
    for group, c in (("aeiouv", 0.5), ("dt", 0.3), ("gk", 0.3)):
        at = [ord(x) for x in group]
        cost[np.ix_(at, at)] = c
    np.fill_diagonal(cost, 0.0)
    return cost


_SOUND_COSTS = _sound_costs()


def _stretch_costs(sound: str, emitted: np.ndarray, longest: int) -> np.ndarray:
    """(length, start): cost of a sound for each stretch of the emitted letters, from every start at
    once. Letters outside ASCII equal nothing."""
    m, n = len(emitted), len(sound)
    expected = np.minimum([ord(c) for c in sound], 127) if n else np.zeros(0, int)
    fits = np.minimum(emitted, 127)
    steps = 0.8 * np.arange(n + 1)
    column = np.tile(np.arange(n + 1.0), (m + 1, 1))
    out = np.full((longest + 1, m + 1), np.inf)
    for k in range(1, min(longest, m) + 1):
        starts = m - k + 1
        letters = fits[k - 1 : k - 1 + starts]
        fresh = column[:starts] + 0.8
        fresh[:, 0] = k
        fresh[:, 1:] = np.minimum(fresh[:, 1:], column[:starts, :-1] + _SOUND_COSTS[expected[None, :], letters[:, None]])
        column = np.minimum.accumulate(fresh - steps, axis=1) + steps
        out[k, :starts] = column[:, -1]
    return out


def align_syllables(units: Sequence[tuple[str, str, bool]], emitted: str) -> list[tuple[int, int]]:
    """Stretch of the emitted text for each unit (character, expected sound, is a syllable).

    Unit by unit over all places at once; of equal ways the one that gives a unit more text.
    """
    n, m = len(units), len(emitted)
    letters = np.frombuffer(emitted.encode("utf-32-le"), np.uint32).astype(np.int64)
    known: dict[str, np.ndarray] = {}
    best = np.full(m + 1, math.inf)
    best[0] = 0.0
    took = np.zeros((n, m + 1), np.int64)
    for i, (letter, sound, syllable) in enumerate(units):
        fresh, taken = np.full(m + 1, math.inf), np.zeros(m + 1, np.int64)
        for k in range(max(len(sound) + 3, 4) if syllable else 2, -1, -1):
            if k > m:
                continue
            if k == 0:
                cost = 1.5 if syllable else 0.5
            elif syllable:
                if sound not in known:
                    known[sound] = _stretch_costs(sound, letters, max(len(sound) + 3, 4))
                cost = known[sound][k, : m - k + 1]
            else:
                cost = np.array([0.0 if emitted[j : j + k] == letter or emitted[j : j + k].isspace() and letter.isspace() else 2.0 for j in range(m - k + 1)])
            reached = best[: m - k + 1] + cost
            better = reached < fresh[k:]
            fresh[k:][better] = reached[better]
            taken[k:][better] = k
        best, took[i] = fresh, taken
    if best[m] == math.inf:
        return [(round(i * m / n), round((i + 1) * m / n)) for i in range(n)]
    out, j = [], m
    for i in range(n - 1, -1, -1):
        out.append((j - int(took[i, j]), j))
        j -= int(took[i, j])
    return out[::-1]


def merge_streams(segments: Sequence[tuple[str, str]], tones: Sequence[tuple[str, str]], unmarked: str = "2") -> str:
    """Vowels with the tones that align with them; segments and tones as (kind, value), with kind C,
    V or | for a word's end. Equal kinds meet for nothing, a word's end only at a high price."""
    kinds = {"C": 0, "V": 1, "|": 2}
    a, b = np.array([kinds[k] for k, _ in segments], int), np.array([kinds[k] for k, _ in tones], int)
    pair = np.where(a[:, None] == b, 0.0, np.where((a[:, None] == 2) | (b == 2), 5.0, 3.0))
    steps = np.arange(len(b) + 1)
    table = np.empty((len(a) + 1, len(b) + 1))
    table[0] = steps
    for i in range(len(a)):
        row = table[i] + 1
        row[1:] = np.minimum(row[1:], table[i, :-1] + pair[i])
        table[i + 1] = np.minimum.accumulate(row - steps) + steps
    given: dict[int, str] = {}
    i, j = len(a), len(b)
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + pair[i - 1, j - 1]:
            i, j = i - 1, j - 1
            if segments[i][0] == tones[j][0] == "V":
                given[i] = tones[j][1]
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return "".join(v + (given.get(i, unmarked) if kind == "V" else "") for i, (kind, v) in enumerate(segments))


# -- frames ---------------------------------------------------------------------------------------
def greedy_ids(log_probs: np.ndarray, pad: int = 0) -> list[int]:
    best = log_probs.argmax(axis=1)
    keep = np.r_[True, best[1:] != best[:-1]] & (best != pad) if len(best) else np.zeros(0, bool)
    return best[keep].tolist()


def beam_search(log_probs: np.ndarray, pad: int = 0, width: int = 10, top: int = 3, least: float = 1e-4) -> list[tuple[tuple[int, ...], float]]:
    """Likeliest label sequences with their log probability, summed over all alignments.

    A beam holds the log probability of ending in a pad and in the last label.
    """
    beams: dict[tuple[int, ...], np.ndarray] = {(): np.array([0.0, -np.inf])}
    floor = math.log(least)
    for frame in log_probs:
        grown: dict[tuple[int, ...], np.ndarray] = {}
        labels = [c for c in np.flatnonzero(frame >= floor).tolist() if c != pad]

        def add(key: tuple[int, ...], slot: int, value: float, grown=grown) -> None:
            cell = grown.setdefault(key, np.array([-np.inf, -np.inf]))
            cell[slot] = np.logaddexp(cell[slot], value)

        for prefix, (blank, label) in beams.items():
            both = np.logaddexp(blank, label)
            add(prefix, 0, both + frame[pad])
            for c in labels:
                if prefix and prefix[-1] == c:
                    add(prefix, 1, label + frame[c])
                    add((*prefix, c), 1, blank + frame[c])
                else:
                    add((*prefix, c), 1, both + frame[c])
        ranked = sorted(grown.items(), key=lambda kv: (-np.logaddexp(*kv[1]), kv[0]))
        beams = dict(ranked[:width])
    ranked = sorted(beams.items(), key=lambda kv: (-np.logaddexp(*kv[1]), kv[0]))
    return [(prefix, float(np.logaddexp(*cell))) for prefix, cell in ranked[:top]]


def force_align(log_probs: np.ndarray, labels: Sequence[int], blank: int = 0, skippable: Sequence[bool] | None = None, intrusive: Sequence[int] = (), sites: Sequence[bool] | None = None, stride: int = 4, penalty: float = 0.0) -> tuple[float, list[int]]:
    """(score, frame of each label, -1 for one that was skipped) of the best path through all frames.

    A label may stay (as itself or as a blank), follow the one before, skip a `skippable` label
    before it if it is the likelier of the two at that frame, or follow after one intrusive token at
    a `sites` label, at most `stride` blanks before it, if that token is likelier there than the
    label. Frames before the first label are blank.
    """
    frames, n = len(log_probs), len(labels)
    skip = np.zeros(n, bool) if skippable is None else np.asarray(skippable, bool)
    site = np.zeros(n, bool) if sites is None else np.asarray(sites, bool)
    score = np.full((frames + 1, n + 1), -np.inf)
    back = np.zeros((frames + 1, n + 1, 2), np.int64)
    lead = np.r_[0.0, np.cumsum(log_probs[:, blank])]
    score[:, 0] = lead
    back[1:, 0] = (1, 0)
    for t in range(1, frames + 1):
        frame = log_probs[t - 1]
        for c in range(1, min(n, t) + 1):
            own = frame[labels[c - 1]]
            options = [(score[t - 1, c] + max(frame[blank], own), 1, 0), (score[t - 1, c - 1] + own, 1, 1)]
            if c >= 2 and skip[c - 2] and own > frame[labels[c - 2]]:
                options.append((score[t - 1, c - 2] + own - penalty, 1, 2))
            if c >= 2 and site[c - 1]:
                for d in range(min(stride, t - 2) + 1):
                    at = t - 2 - d
                    if at < 0:
                        break
                    token = max((log_probs[at, k] for k in intrusive), default=-np.inf)
                    if token > log_probs[at, labels[c - 1]]:
                        options.append((score[at, c - 1] + token + lead[t - 1] - lead[at + 1] + own - penalty, t - at, 1))
            value, dt, dc = max(options, key=lambda o: o[0])
            score[t, c], back[t, c] = value, (dt, dc)
    at, t, c = [-1] * n, frames, n
    if score[t, c] == -np.inf:
        return -math.inf, at
    while t > 0 and c > 0:
        dt, dc = back[t, c]
        if dc:
            at[c - 1] = t - 1
        t, c = t - dt, c - dc
    return float(score[frames, n]), at


def frames_by_key(df: DataFrame, key: str, order: str, values: str, run: Callable[[object, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a decoder on the frames of each utterance, in order. An utterance is short by nature."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return run(pdf[key].iloc[0], np.stack(pdf[values].to_list()).astype(float))

    return df.select(key, order, values).groupBy(key).applyInPandas(group, schema)
