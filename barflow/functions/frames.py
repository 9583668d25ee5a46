"""Window specifications and small column helpers for series work.

Every series operator runs on the block layout of
:func:`barflow.operators.layout.block_layout`: rows carry ``rn`` (0-based
position within the key), ``blk`` (the block the row is computed in), ``sb``
(scan sub-block) and ``halo``. All trailing windows share one partitioning
``(key, blk)`` and one ordering ``(sb, rn)``, so a whole feature pipeline
plans as a single exchange and a single sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "symbol"


def series_window(key: str = KEY) -> Window:
    """Ordered window over one block of one series."""
    return Window.partitionBy(key, "blk").orderBy("sb", "rn")


def trailing(n: int, key: str = KEY) -> Window:
    """The current row and the ``n - 1`` rows before it."""
    return series_window(key).rowsBetween(-(n - 1), 0)


def running(key: str = KEY) -> Window:
    """From the block start to the current row."""
    return series_window(key).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, agg, col: Column | str, key: str = KEY) -> Column:
    """``agg`` over the last ``n`` rows, NULL unless all ``n`` are non-null.

    Spark frames emit partial windows at the start of a series; pandas
    ``rolling(n)`` does not, hence the count guard.
    """
    c = F.col(col) if isinstance(col, str) else col
    w = trailing(n, key)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lag(col: Column | str, n: int = 1, key: str = KEY) -> Column:
    return F.lag(col, n).over(series_window(key))


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL comparison counts as 0 (pandas NaN semantics)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def div(a: Column, b: Column) -> Column:
    """Division that yields NULL for x/0 (ANSI mode would raise)."""
    return F.try_divide(a, b)


def with_pct_rank(df: DataFrame, ranks: dict[str, tuple[str, int, int]], key: str = KEY) -> DataFrame:
    """Add percentile ranks of current values inside their trailing rows: ``ranks`` maps an
    output name to ``(column, rows, min_periods)``.

    Average rank of ties divided by the number of non-null values in the
    window; NULL when the current value is NULL or fewer than
    ``min_periods`` values are present. The window's values are sorted once, as a
    primitive array in a column of its own; the place of the value from either end
    gives the numbers of smaller and of larger ones."""
    df = df.select("*", *[F.sort_array(F.collect_list(c).over(trailing(n, key))).alias(f"_o_{name}") for name, (c, n, _) in ranks.items()])

    def rank(name: str, col: str, least: int) -> Column:
        v, ordered = F.col(col), F.col(f"_o_{name}")
        less, more, cnt = F.array_position(ordered, v) - 1, F.array_position(F.reverse(ordered), v) - 1, F.size(ordered)
        return F.when(v.isNotNull() & (cnt >= least), (less + (cnt - less - more + 1) / 2.0) / cnt)

    return df.select("*", *[rank(name, c, least).alias(name) for name, (c, _, least) in ranks.items()]) \
             .drop(*[f"_o_{name}" for name in ranks])
