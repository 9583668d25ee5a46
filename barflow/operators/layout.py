"""Series layout: global row numbers, row blocks with a halo, block carries.

A window partitioned by ``symbol`` alone sends a whole series to one task,
and one symbol may hold a third of all rows. Instead:

1. :func:`number_rows` gives every row its 0-based position ``rn`` within the
   key. Rows are counted per ``(key, bucket)`` (a calendar bucket such as the
   year), the counts are prefix-summed on that small table, and ``rn`` is the
   bucket offset plus a ``row_number`` inside ``(key, bucket)``. No task sees
   more than one bucket of one key.
2. :func:`block_layout` cuts each series into blocks of ``block_rows`` rows
   (``home = rn div block_rows``). The last ``halo_rows`` rows of a block are
   copied into the next block as read-only history (``halo = true``), so any
   trailing window of at most ``halo_rows`` rows is exact for the block's own
   rows; operators with longer windows raise (:meth:`Layout.need`). Windows are partitioned by ``(key, blk)``.
3. :func:`with_running` adds exact running aggregates with unbounded memory
   (running sums, last non-null value, latest event position): the value
   inside the partition plus a carry from a small per-block summary table
   for everything before the partition's first row.
4. :func:`finish` drops halo copies and layout columns.

Defaults: ``SUB_ROWS = 512`` rows per scan sub-block (see
:mod:`barflow.functions.scan`), ``HALO_ROWS = 3 * SUB_ROWS`` and ``BLOCK_ROWS = 32 * SUB_ROWS``
(halo copies add at most 9.4 % rows, and only for series longer than a block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.frames import KEY, series_window
from barflow.sources.store import cut_lineage

SUB_ROWS = 512
HALO_ROWS = 3 * SUB_ROWS
BLOCK_ROWS = 32 * SUB_ROWS

LAYOUT_COLS = ("blk", "home", "sb", "halo", "n_rows")


@dataclass(frozen=True)
class Layout:
    block_rows: int = BLOCK_ROWS
    halo_rows: int = HALO_ROWS
    sub_rows: int = SUB_ROWS
    #: Write what several passes read to the shared checkpoint folder, so that plans
    #: stay linear: the rows before and after numbering, and the small tables of block
    #: ends and carries. The wide rows in between are not written: a pass over block ends
    #: computes the few columns that it needs, which costs less than writing all of them.
    materialize: bool = True

    def __post_init__(self):
        if self.halo_rows > self.block_rows:
            raise ValueError("halo_rows must not exceed block_rows")
        if self.block_rows % self.sub_rows:
            raise ValueError("block_rows must be a multiple of sub_rows")

    def covers(self, rows: int) -> "Layout":
        """This layout, or one with larger halo (and blocks) if ``rows`` of history do not fit."""
        if rows <= self.halo_rows:
            return self
        halo = -(-rows // self.sub_rows) * self.sub_rows
        block = max(self.block_rows, -(-4 * halo // self.sub_rows) * self.sub_rows)
        return Layout(block, halo, self.sub_rows, self.materialize)

    def need(self, rows: int, what: str) -> None:
        """Raise if a trailing window of ``rows`` rows does not fit the halo: results at
        block edges would differ from those of one whole series."""
        if rows > self.halo_rows:
            raise ValueError(f"{what} needs {rows} rows of history, the layout's halo has {self.halo_rows}; "
                             "lay the series out with Layout.covers")


DEFAULT_LAYOUT = Layout()


def written(df: DataFrame, layout: Layout, name: str) -> DataFrame:
    """``df`` written once and read back, if the layout says so."""
    return cut_lineage(df, name) if layout.materialize else df


def default_bucket(df: DataFrame, order_col: str) -> Column:
    """Calendar bucket that bounds the rows of one numbering task: the year for
    daily bars (DATE), the day for anything finer (timestamps, intraday bars)."""
    fine = isinstance(df.schema[order_col].dataType, (T.TimestampType, T.TimestampNTZType))
    return F.to_date(F.col(order_col)) if fine else F.year(F.col(order_col))


def keyed(df: DataFrame, key: str = KEY, order: str = "date") -> DataFrame:
    """Rows that belong to a series: key and order present."""
    return df.where(F.col(key).isNotNull() & F.col(order).isNotNull())


def unkeyed(df: DataFrame, key: str = KEY, order: str = "date") -> DataFrame:
    """Rows without key or order; they have no place in any series and are
    counted by :func:`barflow.operators.quality.quality_report`."""
    return df.where(F.col(key).isNull() | F.col(order).isNull())


def number_rows(df: DataFrame, key: str = KEY, order: str = "date",
                bucket: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rn``: 0-based position of each row within ``key`` by ``order``, and
    ``n_rows``: rows of the key.

    ``(key, order, *ties)`` must be unique for numbers that do not depend on chance; rows
    without key or order are left out (see :func:`unkeyed`). Work is split by ``(key, bucket)``; the only per-key
    step runs on the bucket-count table (one row per bucket).
    """
    bkt = bucket if bucket is not None else default_bucket(df, order)
    d = keyed(df, key, order).withColumn("_bkt", bkt)
    counts = d.groupBy(key, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bkt", F.sum("_n").over(whole).alias("n_rows"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    d = d.join(offsets, [key, "_bkt"], "inner")
    local = F.row_number().over(Window.partitionBy(key, "_bkt").orderBy(order, *ties))
    return d.withColumn("rn", (F.col("_base") + local - 1).cast("long")).drop("_bkt", "_base")


def block_layout(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Assign ``home``/``blk``/``sb``/``halo``; copy halo rows into the next block."""
    b, h = layout.block_rows, layout.halo_rows
    home = F.floor(F.col("rn") / b).cast("long")
    pos = F.col("rn") - home * b
    targets = F.when(pos >= b - h, F.array(home, home + 1)).otherwise(F.array(home))
    return (df.withColumn("home", home)
              .withColumn("blk", F.explode(targets))
              .withColumn("halo", F.col("blk") != F.col("home"))
              .withColumn("sb", F.floor(F.col("rn") / layout.sub_rows).cast("long")))


def layout_series(df: DataFrame, key: str = KEY, order: str = "date",
                  layout: Layout = DEFAULT_LAYOUT, bucket: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``number_rows`` then ``block_layout`` (skips numbering if ``rn`` and ``n_rows`` exist)."""
    if "rn" not in df.columns or "n_rows" not in df.columns:
        df = written(number_rows(written(df.drop("rn"), layout, "series"), key, order, bucket, ties), layout, "numbered")
    return block_layout(df, layout)


def finish(df: DataFrame, keep_rn: bool = False) -> DataFrame:
    """Drop halo copies and layout columns."""
    out = df.where(~F.col("halo")).drop(*LAYOUT_COLS)
    return out if keep_rn else out.drop("rn")


# --- running aggregates with unbounded memory ---------------------------------

_KINDS = ("sum", "max", "last")


def with_running(df: DataFrame, specs: dict[str, tuple[str, Column]],
                 layout: Layout = DEFAULT_LAYOUT, key: str = KEY,
                 halo_exact: bool = False) -> DataFrame:
    """Add exact running aggregates from the series start to each row.

    ``specs`` maps an output name to ``(kind, expr)`` with kind ``sum``
    (running sum, NULLs skipped), ``max`` (running maximum) or ``last``
    (last non-null value, i.e. a forward fill).

    Everything before the rows a partition aggregates itself comes from a
    per-block summary table (one row per block), prefix-aggregated and
    joined back on ``(key, blk)`` -- the big side's existing partitioning,
    so only the small side moves.

    ``halo_exact=False`` (default, for inputs derived from windows, which
    are not exact on the first halo rows): the partition aggregates only its
    own rows and the carry covers all earlier blocks; values on halo rows are
    not meaningful and are dropped by :func:`finish`.
    ``halo_exact=True`` (for raw inputs): halo rows take part too, and the
    carry covers exactly the rows before the partition's first row, so halo
    rows get exact values as well (used by the forward fill of the cleaner,
    whose output feeds later windows).
    """
    for kind, _ in specs.values():
        if kind not in _KINDS:
            raise ValueError(f"unknown running kind {kind!r}")
    b, h = layout.block_rows, layout.halo_rows
    d = df.select("*", *[e.alias(f"_x_{n}") for n, (_, e) in specs.items()])
    own = d.where(~F.col("halo"))
    in_head = (F.col("rn") - F.col("home") * b) < (b - h)

    def block_agg(kind: str, x: Column, cond: Column | None):
        v = x if cond is None else F.when(cond, x)
        if kind == "sum":
            return F.sum(v)
        if kind == "max":
            return F.max(v)
        return F.max_by(v, F.when(v.isNotNull(), F.col("rn")))

    aggs = []
    for n, (kind, _) in specs.items():
        x = F.col(f"_x_{n}")
        aggs.append(block_agg(kind, x, None).alias(f"_all_{n}"))
        if halo_exact:
            aggs.append(block_agg(kind, x, in_head).alias(f"_head_{n}"))
    blocks = own.groupBy(key, "home").agg(*aggs)

    # Carry for partition blk = home + 1.
    prior = Window.partitionBy(key).orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("home").rowsBetween(Window.unboundedPreceding, 0)
    carry_cols = []
    for n, (kind, _) in specs.items():
        allc = F.col(f"_all_{n}")
        if halo_exact:
            head = F.col(f"_head_{n}")
            if kind == "sum":
                prev = F.sum(allc).over(prior)
                carry = F.when(prev.isNotNull() | head.isNotNull(),
                               F.coalesce(prev, F.lit(0)) + F.coalesce(head, F.lit(0)))
            elif kind == "max":
                carry = F.greatest(F.max(allc).over(prior), head)
            else:
                carry = F.coalesce(head, F.last(allc, ignorenulls=True).over(prior))
        else:
            if kind == "sum":
                carry = F.sum(allc).over(upto)
            elif kind == "max":
                carry = F.max(allc).over(upto)
            else:
                carry = F.last(allc, ignorenulls=True).over(upto)
        carry_cols.append(carry.alias(f"_c_{n}"))
    carries = written(blocks.select(key, (F.col("home") + 1).alias("blk"), *carry_cols), layout, "running")

    d = d.join(carries, [key, "blk"], "left")
    w = series_window(key).rowsBetween(Window.unboundedPreceding, 0)
    outs = []
    for n, (kind, _) in specs.items():
        x, c = F.col(f"_x_{n}"), F.col(f"_c_{n}")
        if not halo_exact:
            x = F.when(~F.col("halo"), x)
        if kind == "sum":
            inside = F.sum(x).over(w)
            val = F.when(inside.isNotNull() | c.isNotNull(),
                         F.coalesce(inside, F.lit(0)) + F.coalesce(c, F.lit(0)))
        elif kind == "max":
            val = F.greatest(F.max(x).over(w), c)
        else:
            val = F.coalesce(F.last(x, ignorenulls=True).over(w), c)
        outs.append(val.alias(n))
    drop = [f"_x_{n}" for n in specs] + [f"_c_{n}" for n in specs]
    return d.select("*", *outs).drop(*drop)


def attach_per_key(df: DataFrame, stats: DataFrame, key: str = KEY) -> DataFrame:
    """Join a per-key table (one row per key) to laid-out rows on ``(key, blk)``.

    A join on ``key`` alone would re-shuffle the big side by key and put a
    hot key in one task. Instead the small table is expanded to the
    ``(key, blk)`` pairs present (an aggregate that reuses the big side's
    partitioning) and joined on the big side's own partitioning.
    """
    stats = cut_lineage(stats, "per-key")  # one row per key; its size is known from here on
    blocks = df.select(key, "blk").distinct()
    return df.join(blocks.join(stats, key), [key, "blk"], "left")
