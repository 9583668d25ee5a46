"""Feature store: generator registry, feature generation, catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import clean as cl
from barflow.operators.layout import DEFAULT_LAYOUT, Layout, finish
from barflow.operators.regime import DEFAULT_REGIME, REGIME_COLUMNS, regime_features, regime_history
from barflow.sources.store import cut_lineage
from barflow.operators.technical import (DEFAULT_TECHNICAL, TECHNICAL_COLUMNS, TechnicalConfig,
                                         technical_features, technical_history)


@dataclass(frozen=True)
class FeatureGroup:
    """A feature generator: ``fn`` maps laid-out bars to bars plus ``provides``.

    ``requires`` lists input columns; :meth:`check` reports the missing ones
    from the schema alone (no job)."""

    name: str
    requires: tuple[str, ...]
    provides: tuple[tuple[str, str], ...]
    fn: Callable[[DataFrame], DataFrame]
    category: str = "technical"

    def check(self, df: DataFrame) -> list[str]:
        have = set(df.columns)
        return [c for c in self.requires if c not in have]

    def __call__(self, df: DataFrame) -> DataFrame:
        missing = self.check(df)
        if missing:
            raise ValueError(f"{self.name}: missing required columns {missing}")
        return self.fn(df)


def default_groups(layout: Layout = DEFAULT_LAYOUT,
                   technical: TechnicalConfig = DEFAULT_TECHNICAL) -> list[FeatureGroup]:
    tech_cols = tuple(p for g in technical.groups for p in TECHNICAL_COLUMNS[g])
    return [
        FeatureGroup("TechnicalFeatures", ("open", "high", "low", "close", "volume"), tech_cols,
                     lambda d: technical_features(d, technical, layout), "technical"),
        FeatureGroup("RegimeFeatures", ("close", "high", "low", "volume"), tuple(REGIME_COLUMNS),
                     lambda d: regime_features(d, DEFAULT_REGIME, layout), "regime"),
    ]


def generate_features(bars: DataFrame, groups: list[FeatureGroup] | None = None,
                      layout: Layout = DEFAULT_LAYOUT, drop_incomplete: bool = True,
                      raw: bool = False, keep_rn: bool = False,
                      materialize: bool = True) -> DataFrame:
    """Clean, apply each generator in order, then drop incomplete rows.

    ``raw=True`` cleans a dirty series first with dedupe (needs ``arrival``).
    ``materialize=True`` writes the cleaned series once (an action) before
    the feature generators run.
    """
    if groups is None:
        layout = layout.covers(max(technical_history(), regime_history()))
    gs = groups if groups is not None else default_groups(layout)
    d = cl.clean_bars(bars, layout, arrival="arrival" if raw else None)
    if materialize:
        # The cleaned, laid-out series is the silver table: writing it once
        # under the shared checkpoint folder cuts the lineage (executor loss
        # recomputes from here) and keeps the feature joins from re-running
        # the cleaner in each of their branches.
        d = cut_lineage(d, "silver")
    for g in gs:
        d = g(d)
    out = finish(d, keep_rn=keep_rn)
    return out.na.drop("any") if drop_incomplete else out


def catalog(spark: SparkSession, groups: list[FeatureGroup] | None = None) -> DataFrame:
    """One row per feature: generator, category, our name, the reference name,
    and the generator's required input columns."""
    gs = groups if groups is not None else default_groups()
    rows = [(g.name, g.category, ours, ref, list(g.requires))
            for g in gs for ours, ref in g.provides]
    return spark.createDataFrame(
        rows, "generator string, category string, feature string, reference_name string, "
              "requires array<string>")


# --- fixed values (row guards of the reference) -------------------------------
# A symbol needs lookback + horizon + 100 rows, before and after the feature
# null drop, and at least 150 samples.
GUARD_EXTRA_ROWS = 100
MIN_SAMPLES = 150


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("rn",)) -> list[str]:
    """Numeric columns in schema order (no job)."""
    from pyspark.sql import types as T
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def guard_min_rows(df: DataFrame, min_rows: int, stage: str = "rows", key: str = "symbol") -> DataFrame:
    """Per symbol: row count and whether it meets ``min_rows``; the rest get a
    reason instead of an exception (one partial aggregate)."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    ok = F.col("rows") >= min_rows
    reason = F.when(~ok, F.format_string(f"{stage}: need %d, got %d", F.lit(min_rows), F.col("rows")))
    return c.select(key, "rows", ok.alias("eligible"), reason.alias("reason"))


def keep_eligible(df: DataFrame, status: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows of eligible symbols (semi join with the one-row-per-symbol status,
    written once so that its size is known to the planner)."""
    return df.join(cut_lineage(status.where("eligible").select(key), "eligible"), key, "left_semi")


def completeness(rows: DataFrame, columns: list[str] | None = None, key: str = "symbol") -> DataFrame:
    """Rows per symbol before and after the drop of rows with a NULL in ``columns`` (all if not
    given), counted in one pass over the rows."""
    whole = F.lit(True)
    for c in columns or rows.columns:
        whole = whole & F.col(f"`{c}`").isNotNull()
    d = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(whole).alias("rows_after"))
    return d.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
