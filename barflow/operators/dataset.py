"""Modelling dataset: min-max scaling, lag sequences, splits, walk-forward folds.

Rows are the complete feature rows of each symbol, renumbered (``rn``) after
the null drop, as the reference builds samples by position. A sample ``i``
takes rows ``[i - lookback, i)`` as input and the target of row
``i + horizon - 1``. To stay inside the block layout (history only, no look
into the next block) the sample is assembled at its *label* row ``j``: the
input window is rows ``[j - horizon + 1 - lookback, j - horizon]`` -- a
trailing frame -- and the sample's date is ``lag(date, horizon - 1)``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.frames import KEY, div, series_window
from barflow.operators.layout import (DEFAULT_LAYOUT, Layout, attach_per_key, block_layout,
                                      number_rows, written)

# --- fixed values (dataset parameters of the reference) -----------------------
# Lookback 60 rows, horizon 5 rows; split 70 % train, 15 % validation, rest test.
# Walk-forward validation: 5 splits with a gap of 5 rows.
LOOKBACK = 60
HORIZON = 5
TRAIN_SPLIT = 0.70
VAL_SPLIT = 0.15
N_SPLITS = 5
GAP = 5


def renumber(df: DataFrame, layout: Layout = DEFAULT_LAYOUT, key: str = KEY,
             order: str = "date") -> DataFrame:
    """Fresh ``rn`` and block layout for a table whose rows were filtered."""
    d = df.drop(*[c for c in ("rn", "blk", "home", "sb", "halo") if c in df.columns])
    d = number_rows(written(d, layout, "rows"), key, order)
    return block_layout(written(d, layout, "numbered"), layout)


def _row_split(n: Column, idx: Column, train: float, val: float) -> Column:
    train_end = F.floor(n * train)
    val_end = F.floor(n * (train + val))
    return (F.when(idx < train_end, "train").when(idx < val_end, "val").otherwise("test"))


def fit_minmax(df: DataFrame, cols: list[str], fit_on: str = "train", train: float = TRAIN_SPLIT,
               key: str = KEY) -> DataFrame:
    """Per-symbol min and max of ``cols`` on laid-out rows: one partial aggregate.

    ``fit_on="train"`` (default) fits on the first ``train`` share of each
    symbol's rows; ``"all"`` fits on every row (the reference's behaviour,
    which lets test rows shape the scale)."""
    if fit_on == "train":
        own = df.where(~F.col("halo") & (F.col("rn") < F.floor(F.col("n_rows") * train)))
    elif fit_on == "all":
        own = df.where(~F.col("halo"))
    else:
        raise ValueError("fit_on must be 'train' or 'all'")
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    return own.groupBy(key).agg(*aggs)


def apply_minmax(df: DataFrame, stats: DataFrame, cols: list[str], key: str = KEY,
                 suffix: str = "_s") -> DataFrame:
    """``(x - min) / (max - min)``; 0 for a constant column (like MinMaxScaler)."""
    d = attach_per_key(df, stats, key) if "blk" in df.columns else df.join(stats, key, "left")
    out = []
    for c in cols:
        lo, hi = F.col(f"{c}__min"), F.col(f"{c}__max")
        out.append(F.when(hi == lo, F.lit(0.0)).otherwise(div(F.col(c) - lo, hi - lo)).alias(c + suffix))
    drop = [f"{c}__{s}" for c in cols for s in ("min", "max")]
    return d.select("*", *out).drop(*drop)


def inverse_minmax(df: DataFrame, stats: DataFrame, scaled: str, target: str, out: str,
                   key: str = KEY) -> DataFrame:
    """Map a scaled prediction back with the target column's statistics."""
    s = stats.select(key, F.col(f"{target}__min").alias("_lo"), F.col(f"{target}__max").alias("_hi"))
    d = attach_per_key(df, s, key) if "blk" in df.columns else df.join(s, key, "left")
    return d.withColumn(out, F.col(scaled) * (F.col("_hi") - F.col("_lo")) + F.col("_lo")).drop("_lo", "_hi")


def sequences(df: DataFrame, cols: list[str], target: str, lookback: int = LOOKBACK,
              horizon: int = HORIZON, drop_last: bool = False, key: str = KEY,
              order: str = "date", layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Lag samples on laid-out rows (``rn`` counts the rows being sampled).

    Output per sample: ``symbol``, ``date`` (row ``i``), ``idx`` (= ``i -
    lookback``, the sample number), ``n_samples`` (samples of the symbol), ``window`` (``lookback`` x ``len(cols)``
    nested array, oldest first), ``label`` (``target`` at ``i + horizon - 1``).
    ``drop_last=True`` reproduces the reference's range ``i < n - horizon``
    (one sample fewer than possible); the default keeps every valid sample.
    """
    if lookback + horizon > layout.halo_rows:
        raise ValueError("lookback + horizon must fit in the layout halo")
    w = series_window(key)
    frame = w.rowsBetween(-(lookback + horizon - 1), -horizon)
    # One array per row, then arrays of arrays: the window is built last and
    # nothing wide goes through a join (``n_rows`` comes with the layout).
    d = df.select(key, order, "rn", "n_rows", "halo", "blk", "home", "sb", F.col(target).alias("_target"),
                  F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    i = F.col("rn") - (horizon - 1)
    d = d.select("*", F.collect_list("_x").over(frame).alias("window"),
                 F.lag(order, horizon - 1).over(w).alias("_sdate"), i.alias("_i"))
    # Rows from number ``lookback`` on have a full window, so samples are counted without building any.
    d = d.where(F.col("_i") >= lookback)
    n_samples = F.col("n_rows") - lookback - horizon + (0 if drop_last else 1)
    d = d.where((F.col("_i") - lookback < n_samples) & ~F.col("halo"))
    return d.select(key, F.col("_sdate").alias(order), (F.col("_i") - lookback).alias("idx"),
                    n_samples.cast("long").alias("n_samples"), "window", F.col("_target").alias("label"))


def latest_windows(df: DataFrame, cols: list[str], lookback: int = LOOKBACK, key: str = KEY, order: str = "date",
                   layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """The window that ends at each row, whether or not its label is known yet: columns
    as those of :func:`sequences`, dated by the window's last row, with a NULL label."""
    if lookback > layout.halo_rows:
        raise ValueError("lookback must fit in the layout halo")
    frame = series_window(key).rowsBetween(-(lookback - 1), 0)
    d = df.select(key, order, "rn", "n_rows", "halo", "blk", "home", "sb", F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    d = d.select("*", F.collect_list("_x").over(frame).alias("window")).where((F.col("rn") >= lookback - 1) & ~F.col("halo"))
    return d.select(key, order, (F.col("rn") - (lookback - 1)).alias("idx"), (F.col("n_rows") - (lookback - 1)).cast("long").alias("n_samples"),
                    "window", F.lit(None).cast("double").alias("label"))


def flatten_window(samples: DataFrame, col: str = "window", vector: bool = True) -> DataFrame:
    """3-D sample -> flat feature list (row-major: lag-major, feature-minor);
    ``vector=True`` adds the ML ``features`` vector (JVM conversion)."""
    d = samples.withColumn("flat", F.flatten(col))
    return d.withColumn("features", array_to_vector("flat")) if vector else d


def split_samples(samples: DataFrame, train: float = TRAIN_SPLIT, val: float = VAL_SPLIT,
                  key: str = KEY) -> DataFrame:
    """Chronological split of each symbol's samples by truncated index
    (uses the ``n_samples`` column of :func:`sequences`; no join)."""
    return samples.withColumn("split", _row_split(F.col("n_samples"), F.col("idx"), train, val))


def walk_forward(samples: DataFrame, n_splits: int = N_SPLITS, gap: int = GAP,
                 key: str = KEY, order: str = "date") -> DataFrame:
    """Expanding-window folds: fold ``k`` tests the ``k``-th of ``n_splits``
    equal tail slices (size ``n // (n_splits + 1)``) and trains on all rows
    ending ``gap`` rows before the test slice. Output: one row per
    ``(sample, fold)`` membership with ``role`` train/test, on the samples'
    keys alone (``key, order, idx, n_samples``); windows are not copied, see
    :func:`fold_samples`."""
    n = F.col("n_samples")
    size = F.floor(n / (n_splits + 1))
    d = samples.select(key, order, "idx", "n_samples") \
               .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return d.withColumn("role", _fold_role(n, F.col("idx"), F.col("fold"), size, n_splits, gap)) \
            .where(F.col("role").isNotNull())


def _fold_role(n: Column, idx: Column, fold: Column, size: Column, n_splits: int, gap: int) -> Column:
    test_start = n - (F.lit(n_splits) - fold) * size
    return (F.when((idx >= test_start) & (idx < test_start + size), "test")
             .when(idx < test_start - gap, "train"))


def fold_samples(samples: DataFrame, fold: int, n_splits: int = N_SPLITS, gap: int = GAP) -> DataFrame:
    """The samples of one fold with their ``role``: a filter, no copy and no join."""
    n = F.col("n_samples")
    role = _fold_role(n, F.col("idx"), F.lit(fold), F.floor(n / (n_splits + 1)), n_splits, gap)
    return samples.withColumn("role", role).where(F.col("role").isNotNull())
