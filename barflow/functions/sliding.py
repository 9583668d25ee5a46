"""Trailing windows of any length at a cost of a few lags a row and power of ``STEP``.

Spark sums a sliding frame afresh for every row, so its cost grows with the
frame. Here a value over ``2 * k`` rows is made of two values over ``k`` rows,
the one of this row and the one ``k`` rows before:

    sum      S[2k] = S[k] + S'[k]
    min/max  M[2k] = least(M[k], M'[k])            (greatest)
    squares  Q[2k] = Q[k] + Q'[k] + (S[k] - S'[k])**2 / (2k)

``Q`` is the sum of squared deviations from the window's own mean, so a flat
window has exactly 0 and nothing is subtracted that could lose digits. A window
of ``n`` rows is the sum of its binary parts; a minimum covers it with two
overlapping ones. One ``Window`` step fetches the values ``k, 2 * k, ...`` rows
before, and three doublings are made of them, for all columns and lengths at
once: a row costs far more in a step than its lags do.

A NULL within the window, or too few rows, give NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, lag

#: Rows of one step in rows of the step before: three doublings.
STEP = 8

#: Basic quantities that a window function is made of.
_PARTS = {"sum": ("sum",), "avg": ("sum",), "min": ("min",), "max": ("max",),
          "stddev_pop": ("sum", "squares"), "stddev_samp": ("sum", "squares")}


@dataclass(frozen=True)
class Trailing:
    """Column ``name``: ``agg`` of ``col`` over this row and the ``n - 1`` rows before it."""

    name: str
    agg: str
    col: str
    n: int

    def __post_init__(self):
        if self.agg not in _PARTS:
            raise ValueError(f"unknown aggregate {self.agg!r}")
        if self.n < 1:
            raise ValueError("a window has at least one row")


def _binary(n: int) -> list[tuple[int, int]]:
    """``(length, rows before)`` of the powers of two that make up ``n``."""
    out, done = [], 0
    while done < n:
        k = 1 << ((n - done).bit_length() - 1)
        out.append((k, done))
        done += k
    return out


def _name(part: str, col: str, k: int) -> str:
    return f"_w_{part}_{col}_{k}"


def _value(part: str, col: str, k: int) -> Column:
    """The quantity over the last ``k`` rows; ``k = 1`` is the column itself."""
    if k > 1:
        return F.col(_name(part, col, k))
    x = F.col(col).cast("double") if part in ("sum", "squares") else F.col(col)
    return F.when(x.isNotNull(), F.lit(0.0)) if part == "squares" else x


def _lagged(part: str, col: str, k: int, i: int) -> str:
    return f"_l_{part}_{col}_{k}_{i}"


def _over(part: str, col: str, k: int, m: int, i: int = 0) -> Column:
    """The quantity over ``m * k`` rows that end ``i * k`` rows before, by doublings of lagged values over ``k`` rows."""
    if m == 1:
        return F.col(_lagged(part, col, k, i)) if i else _value(part, col, k)
    if part in ("min", "max"):
        parts = [_over(part, col, k, 1, i + j) for j in range(m)]
        return F.when(reduce(and_, [x.isNotNull() for x in parts]), (F.least if part == "min" else F.greatest)(*parts))
    half = m // 2
    a, b = _over(part, col, k, half, i), _over(part, col, k, half, i + half)
    if part == "squares":
        apart = _over("sum", col, k, half, i) - _over("sum", col, k, half, i + half)
        return a + b + apart * apart / float(m * k)
    return a + b


def _whole(t: Trailing, key: str) -> Column:
    back = lambda part, k, rows: lag(_value(part, t.col, k), rows, key) if rows else _value(part, t.col, k)
    if t.agg in ("min", "max"):
        k = 1 << (t.n.bit_length() - 1)
        if k == t.n:
            return _value(t.agg, t.col, k)
        a, b = _value(t.agg, t.col, k), back(t.agg, k, t.n - k)
        return F.when(a.isNotNull() & b.isNotNull(), (F.least if t.agg == "min" else F.greatest)(a, b))
    total = square = None
    for k, rows in _binary(t.n):
        s = back("sum", k, rows)
        if t.agg.startswith("stddev"):
            q = back("squares", k, rows)
            if total is not None:
                apart = s / k - total / rows
                q = square + q + apart * apart * (rows * k / (rows + k))
            square = q
        total = s if total is None else total + s
    if t.agg == "sum":
        return total
    if t.agg == "avg":
        return total / t.n
    if t.agg == "stddev_pop":
        return F.sqrt(square / t.n)
    return F.sqrt(square / (t.n - 1)) if t.n > 1 else F.lit(None).cast("double")


def with_trailing(df: DataFrame, windows: list[Trailing], key: str = KEY) -> DataFrame:
    """Add the columns of ``windows`` to laid-out rows."""
    if not windows:
        return df
    longest: dict[tuple[str, str], int] = {}
    for t in windows:
        for part in _PARTS[t.agg]:
            longest[part, t.col] = max(longest.get((part, t.col), 1), 1 << (t.n.bit_length() - 1))
    made, k = [], 1
    while True:
        step = [(part, col, min(STEP, most // k)) for (part, col), most in longest.items() if 2 * k <= most]
        if not step:
            break
        lags = {_lagged(part, col, k, i): lag(_value(part, col, k), i * k, key) for part, col, times in step for i in range(1, times)}
        own = {_name(part, col, m * k): _over(part, col, k, m) for part, col, times in step for m in (2, 4, 8) if m <= times}
        df = df.select("*", *[x.alias(n) for n, x in lags.items()]).select("*", *[x.alias(n) for n, x in own.items()]).drop(*lags)
        made += own
        k *= STEP
    return df.select("*", *[_whole(t, key).alias(t.name) for t in windows]).drop(*made)
