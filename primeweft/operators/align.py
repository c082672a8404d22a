"""Differences of a projected window from its template, for masking.

Shared k-mers that are unique in both sequences and in one order anchor the alignment.
The stretches between anchors are aligned with affine gap costs, many of them at once:
stretches of like lengths are rows of one table, filled row by row in a band of
diagonals, and walked back together.  A band is doubled for the stretches whose cost a
path outside of it could still undercut, so that costs are those of the full table.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..ship import ship

K = 15
#: Diagonals on either side that a band begins with, and cells of one table.
BAND, CELLS = 16, 1 << 22
_FAR = 1 << 28
#: Steps of an alignment: a base of both, of the template alone, of the window alone.
BOTH, GONE, EXTRA = 0, 1, 2


@dataclass(frozen=True)
class Costs:
    """A gap of n bases costs ``open + n * extend``."""

    mismatch: int = 4
    open: int = 4
    extend: int = 2


def anchors(a: str, b: str, k: int = K) -> list[tuple[int, int]]:
    """Places (in a, in b) of k-mers unique in both, a longest chain that rises in both."""
    count_a, count_b = (Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in (a, b))
    at_b = {b[i : i + k]: i for i in range(len(b) - k + 1)}
    both = [(i, at_b[x]) for i in range(len(a) - k + 1) if count_a[x := a[i : i + k]] == 1 and count_b.get(x) == 1]
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(both)
    for n, (_, j) in enumerate(both):
        at = bisect.bisect_left(tails, j)
        before[n] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            last.append(n)
        else:
            tails[at], last[at] = j, n
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(both[n])
        n = before[n]
    return chain[::-1]


# ---------------------------------------------------------------- many stretches at once
def _padded(texts: list[bytes], width: int, filling: int) -> np.ndarray:
    out = np.full((len(texts), width), filling, np.uint8)
    for row, x in zip(out, texts, strict=True):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    return out


def _table(a: list[bytes], b: list[bytes], band: int, costs: Costs) -> tuple[np.ndarray, list[np.ndarray]]:
    """(cost, steps) of each pair by paths whose diagonal stays within ``band`` of those of both ends."""
    m, n = (np.array([len(x) for x in s]) for s in (a, b))
    top, low = int((n - m).max()), int((n - m).min())
    below, above = max(0, -low) + band, max(0, top) + band  # column c of row i is place i - below + c of b
    width, rows, count = below + above + 1, int(m.max()), len(a)
    first, second = _padded(a, rows, 0), _padded(b, rows + above + 1, 1)
    columns = np.arange(width)
    climb = costs.extend * columns
    best = np.full((count, width), _FAR, np.int64)
    best[:, below] = 0
    after = columns > below
    best[:, after] = costs.open + costs.extend * (columns[after] - below)
    best[:, columns - below > n[:, None].max()] = _FAR
    gone = np.full((count, width), _FAR, np.int64)
    kind = np.zeros((rows + 1, count, width), np.uint8)  # 2 bits of the step, 4: a gap of a goes on, 8: one of b does
    kind[0][:, after] = EXTRA
    kind[0][:, columns > below + 1] |= 8
    ends = np.zeros(count, np.int64)
    flat = m == 0
    ends[flat] = best[flat, below + n[flat]]
    for i in range(1, rows + 1):
        place = i - below + columns  # of b, from 1
        inside = (place >= 1) & (place <= second.shape[1])
        wrong = np.full((count, width), _FAR, np.int64)
        wrong[:, inside] = np.where(first[:, i - 1 : i] == second[:, place[inside] - 1], 0, costs.mismatch)
        straight = best + wrong
        shifted = np.full((count, width), _FAR, np.int64)
        opened, longer = best[:, 1:] + costs.open + costs.extend, gone[:, 1:] + costs.extend
        shifted[:, :-1] = np.minimum(opened, longer)
        more = np.zeros((count, width), bool)
        more[:, :-1] = longer < opened
        gone = shifted
        base = np.minimum(straight, gone)
        base[:, place < 0] = _FAR
        least = np.minimum.accumulate(base - climb, axis=1)
        extra = np.full((count, width), _FAR, np.int64)
        extra[:, 1:] = least[:, :-1] + climb[1:] + costs.open
        follows = np.zeros((count, width), bool)
        follows[:, 2:] = extra[:, 2:] == extra[:, 1:-1] + costs.extend
        best = np.minimum(np.minimum(base, extra), _FAR)
        step = np.where(straight <= np.minimum(gone, extra), BOTH, np.where(gone <= extra, GONE, EXTRA)).astype(np.uint8)
        kind[i] = step | more.astype(np.uint8) << 2 | follows.astype(np.uint8) << 3
        done = m == i
        ends[done] = best[done, (below + n - m)[done]]
    # back from the ends, all at once
    walked = np.full((count, int((m + n).max()) + 1), 255, np.uint8)
    i, j, at, held, every = m.copy(), n.copy(), np.zeros(count, np.int64), np.full(count, 255), np.arange(count)
    while True:
        live = np.flatnonzero((i > 0) | (j > 0))
        if not len(live):
            break
        x = kind[i[live], live, j[live] - i[live] + below]
        step = np.where(held[live] == 255, x & 3, held[live])
        step = np.where(i[live] == 0, EXTRA, np.where(j[live] == 0, GONE, step))
        walked[live, at[live]] = step
        at[live] += 1
        on = ((step == GONE) & (x & 4 > 0)) | ((step == EXTRA) & (x & 8 > 0))
        held[live] = np.where(on, step, 255)
        i[live] -= step != EXTRA
        j[live] -= step != GONE
    return ends, [walked[r, : at[r]][::-1] for r in every]


def aligned(pairs: list[tuple[bytes, bytes]], costs: Costs = Costs()) -> tuple[np.ndarray, list[np.ndarray]]:  # noqa: B008
    """(cost, steps) of an alignment of least cost of each pair."""
    cost, steps = np.zeros(len(pairs), np.int64), [np.zeros(0, np.uint8)] * len(pairs)
    size = [(len(a), len(b)) for a, b in pairs]
    todo = [(i, BAND) for i in range(len(pairs)) if any(size[i])]
    while todo:
        todo.sort(key=lambda x: (x[1], abs(size[x[0]][0] - size[x[0]][1]), size[x[0]]))
        again, lo = [], 0
        while lo < len(todo):
            band, hi, rows, spread = todo[lo][1], lo, 0, 0
            while hi < len(todo) and todo[hi][1] == band:
                m, n = size[todo[hi][0]]
                rows, spread = max(rows, m), max(spread, abs(n - m))
                if hi > lo and (hi - lo + 1) * (rows + 1) * (2 * spread + 2 * band + 1) > CELLS:
                    break
                hi += 1
            some = [i for i, _ in todo[lo:hi]]
            found, walks = _table([pairs[i][0] for i in some], [pairs[i][1] for i in some], band, costs)
            for i, c, w in zip(some, found.tolist(), walks, strict=True):
                m, n = size[i]
                # a path that leaves the band has over ``band`` bases more on both sides than it needs
                outside = 2 * costs.open + costs.extend * (abs(n - m) + 2 * (band + 1))
                if c <= outside or band > max(m, n):
                    cost[i], steps[i] = c, w
                else:
                    again.append((i, 2 * band))
            lo = hi
        todo = again
    return cost, steps


# ---------------------------------------------------------------- difference strings
def written(t: str, w: str, steps: np.ndarray) -> list[str]:
    """Tokens ``:n``, ``*xy``, ``-x`` and ``+y`` of an alignment."""
    out, i, j = [], 0, 0
    same = np.zeros(len(steps), bool)
    both = steps == BOTH
    at_t, at_w = np.cumsum(steps != EXTRA) - 1, np.cumsum(steps != GONE) - 1
    if both.any():
        a, b = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (t, w))
        same[both] = a[at_t[both]] == b[at_w[both]]
    kind = np.where(both, np.where(same, 0, 3), steps)
    cuts = np.flatnonzero(np.diff(kind)) + 1 if len(kind) else []
    for lo, hi in zip([0, *cuts], [*cuts, len(kind)], strict=True) if len(kind) else []:
        n = int(hi - lo)
        if kind[lo] == 0:
            out.append(f":{n}")
        elif kind[lo] == 3:
            out += [f"*{x.lower()}{y.lower()}" for x, y in zip(t[i : i + n], w[j : j + n], strict=True)]
        elif kind[lo] == GONE:
            out.append("-" + t[i : i + n].lower())
        else:
            out.append("+" + w[j : j + n].lower())
        i += n * (kind[lo] != EXTRA)
        j += n * (kind[lo] != GONE)
    return out


def all_differences(pairs: list[tuple[str, str]], k: int = K, costs: Costs = Costs()) -> list[tuple[int, str] | None]:  # noqa: B008
    """(first template position, difference string) of each pair (template, window), None without an anchor."""
    upper = [(t.upper(), w.upper()) for t, w in pairs]
    chains = [anchors(t, w, k) for t, w in upper]
    gaps, of = [], []
    for p, (chain, (t, w)) in enumerate(zip(chains, upper, strict=True)):
        for (i, j), (ni, nj) in zip(chain, chain[1:], strict=False):
            if ni - i != nj - j or ni - i > 1:  # neighbours on a diagonal share the base between
                of.append(p)
                gaps.append((t[i:ni], w[j:nj]))
    _, steps = aligned([(a.encode("ascii", "replace"), b.encode("ascii", "replace")) for a, b in gaps], costs)
    made = iter(zip(gaps, steps, strict=True))
    out: list[tuple[int, str] | None] = []
    for chain, (t, w) in zip(chains, upper, strict=True):
        if not chain:
            out.append(None)
            continue
        whole = []
        for (i, j), (ni, nj) in zip(chain, chain[1:], strict=False):
            whole.append(next(made)[1] if ni - i != nj - j or ni - i > 1 else np.zeros(1, np.uint8))
        whole.append(np.zeros(k, np.uint8))
        i, j = chain[0]
        out.append((i, "".join(written(t[i:], w[j:], np.concatenate(whole)))))
    return out


def differences(template: str, window: str, k: int = K) -> tuple[int, str] | None:
    """(first template position, difference string) or None without an anchor."""
    return all_differences([(template, window)], k)[0]


def _each(template: pd.Series, window: pd.Series) -> pd.DataFrame:
    have = [i for i, (t, w) in enumerate(zip(template, window, strict=True)) if t and w]
    found: list = [(None, None)] * len(template)
    for i, d in zip(have, all_differences([(template[i], window[i]) for i in have]), strict=True):
        found[i] = d or (None, None)
    return pd.DataFrame(found, columns=["r_start", "cs"])


def align_windows(template: DataFrame, windows: DataFrame) -> DataFrame:
    """(template, haplotype, r_start, cs) of windows (haplotype, sequence) that share an anchor with the template.

    With a column ``template`` windows are aligned with their own one, else all with the one of a design.
    """
    ship(template.sparkSession)
    texts = template.select("template", F.col("sequence").alias("t"))
    own = windows.withColumnRenamed("sequence", "w")
    both = own.join(texts, "template") if "template" in windows.columns else own.select("haplotype", "w").join(texts, how="cross")
    found = both.withColumn("d", pandas_udf(_each, "r_start long, cs string")("t", "w")).select("template", "haplotype", "d.r_start", "d.cs")
    return found.where("cs is not null")


def alignment_cost(a: Column, b: Column, costs: Costs = Costs()) -> Column:  # noqa: B008
    """The least cost of an alignment of two strings of ASCII characters; null if one is."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype="Int64")
        have = [i for i, (s, t) in enumerate(zip(x, y, strict=True)) if s is not None and t is not None]
        cost, _ = aligned([(x[i].encode("ascii", "replace"), y[i].encode("ascii", "replace")) for i in have], costs)
        out.iloc[have] = cost
        return out

    each.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return pandas_udf(each, "long")(a, b)
