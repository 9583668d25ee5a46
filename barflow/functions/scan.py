"""Recursive smoothers as a blocked affine scan, with window functions only.

A smoother ``y[r] = q * y[r-1] + a * x[r]`` with seed ``y[start] = s`` is an
affine recurrence. Inside a scan sub-block of ``L`` rows (``sb = rn div L``,
``k = rn - sb * L``) the value with a zero carry-in is

    loc[k] = q**k * sum_{j <= k} w[j] * q**(-j),   w = s at start, a*x after

which is a plain running ``sum`` over ``(key, blk, sb)``. The carry into a
sub-block is the exact value at the end of the one before it,
``E[s] = loc_end[s] + q**L * E[s-1]``. The end values form a small table (one
row per ``L`` rows); each ``E`` is folded there over as many predecessors as
double precision can represent at all, across block borders, and comes back as
one array per block joined on the big side's own ``(key, blk)``. That table is
blocked once more: groups of ``GROUP_ENDS`` ends, with the ends that the first
ones fold over copied from the group before, so no task holds a series' ends.
So a value that has decayed far (a halted symbol) keeps its digits, and results
do not depend on the block size. Halo rows take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.frames import KEY
from barflow.operators.layout import DEFAULT_LAYOUT, SUB_ROWS, Layout, written

# Keep q**-k below e**650 (double overflows near e**709).
_OVERFLOW = 650.0
# Weights below e**-746 are zero in double precision.
_VANISHED = 746.0

#: Sub-block ends that one folding task computes at least (and at least four times those it folds over).
GROUP_ENDS = 2048


@dataclass(frozen=True)
class Smoother:
    """``y[start] = seed``; ``y[r] = q*y[r-1] + a*x[r]`` for ``r > start``.

    ``x`` and ``seed`` are column names (``seed`` defaults to ``x``);
    rows before ``start + warmup`` are NULL and rows before ``start`` are
    ``before`` (NULL by default).
    """

    name: str
    x: str
    q: float
    a: float
    start: int = 0
    seed: str | None = None
    warmup: int = 0
    before: float | None = None


def ema(name: str, x: str, span: int, start: int = 0) -> Smoother:
    """pandas ``ewm(span=n, adjust=False, min_periods=n)`` started at ``start``."""
    alpha = 2.0 / (span + 1)
    return Smoother(name, x, 1 - alpha, alpha, start, None, span - 1)


def wilder_mean(name: str, x: str, n: int, start: int = 0) -> Smoother:
    """``ewm(alpha=1/n, adjust=False, min_periods=n)``."""
    return Smoother(name, x, 1 - 1.0 / n, 1.0 / n, start, None, n - 1)


def sub_rows_for(q: float, default: int = SUB_ROWS) -> int:
    """Largest halving of the default sub-block whose weights do not overflow."""
    if not 0.0 < q < 1.0:
        raise ValueError("smoother needs 0 < q < 1")
    rows = default
    while rows * -math.log(q) > _OVERFLOW and rows % 2 == 0:
        rows //= 2
    return rows


def fold_rows(q: float, rows: int) -> int:
    """Sub-blocks back after which a carry has vanished in double precision."""
    return int(math.ceil(_VANISHED / (rows * -math.log(q)))) + 1


def apply_smoothers(df: DataFrame, smoothers: list[Smoother], key: str = KEY,
                    layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Add one column per smoother (all evaluated in the same window pass).

    Values on halo rows are NULL."""
    if not smoothers:
        return df
    rn = F.col("rn")
    by_rows: dict[int, list[Smoother]] = {}
    for s in smoothers:
        by_rows.setdefault(sub_rows_for(s.q, layout.sub_rows), []).append(s)
    for rows, group in by_rows.items():
        sb = F.floor(rn / rows).cast("long")
        own = rows != layout.sub_rows
        if own:
            df = df.withColumn("_sb", sb)
        at = "_sb" if own else "sb"
        k = rn - F.col(at) * rows
        inner = Window.partitionBy(key, "blk", at).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
        terms, locs = [], []
        for s in group:
            w = (F.when(rn == s.start, F.col(s.seed or s.x))
                  .when(rn > s.start, F.lit(s.a) * F.col(s.x))
                  .otherwise(F.lit(0.0)))
            terms.append((w * F.pow(F.lit(s.q), -k.cast("double"))).alias(f"_t_{s.name}"))
            locs.append((F.pow(F.lit(s.q), k.cast("double")) * F.sum(f"_t_{s.name}").over(inner)).alias(f"_l_{s.name}"))
        d = df.select("*", *terms).select("*", *locs).drop(*[f"_t_{s.name}" for s in group])

        # End values of the sub-blocks, folded, as the carry into the next sub-block.
        ends = d.where(~F.col("halo") & (k == rows - 1)).select(
            key, F.col(at).alias("_s"), *[F.coalesce(f"_l_{s.name}", F.lit(0.0)).alias(f"_l_{s.name}") for s in group])

        overlap = max(fold_rows(s.q, rows) for s in group) - 1
        span = max(GROUP_ENDS, 4 * overlap)
        own_group = F.floor(F.col("_s") / span).cast("long")
        last = F.col("_s") % span >= span - overlap
        ends = ends.withColumn("_own", own_group) \
                   .withColumn("_g", F.explode(F.when(last, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))

        def folded(s: Smoother) -> Column:
            past = Window.partitionBy(key, "_g").orderBy("_s").rowsBetween(-(fold_rows(s.q, rows) - 1), 0)
            step = s.q ** rows
            return F.aggregate(F.collect_list(f"_l_{s.name}").over(past), F.lit(0.0), lambda e, x: e * step + x)

        per_block = layout.block_rows // rows
        carry = ends.select(key, "_own", "_g", (F.col("_s") + 1).alias("_s"),
                            *[folded(s).alias(f"_e_{s.name}") for s in group]).where("_own = _g")
        carry = carry.withColumn("blk", F.floor(F.col("_s") / per_block).cast("long")) \
                     .groupBy(key, "blk").agg(F.map_from_entries(F.collect_list(F.struct(
                         "_s", F.struct(*[f"_e_{s.name}" for s in group])))).alias("_carry"))
        carry = written(carry, layout, "scan")
        d = d.join(carry, [key, "blk"], "left")
        outs = []
        for s in group:
            e = F.coalesce(F.try_element_at(F.col("_carry"), F.col(at))[f"_e_{s.name}"], F.lit(0.0))
            y = F.col(f"_l_{s.name}") + e * F.pow(F.lit(s.q), (k + 1).cast("double"))
            before = F.lit(s.before).cast("double") if s.before is not None else F.lit(None).cast("double")
            outs.append(F.when(F.col("halo"), F.lit(None).cast("double"))
                         .when(rn >= s.start + s.warmup, y)
                         .when(rn < s.start, before)
                         .otherwise(F.lit(None).cast("double")).alias(s.name))
        df = d.select("*", *outs).drop("_carry", "_sb", *[f"_l_{s.name}" for s in group])
    return df
