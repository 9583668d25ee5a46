"""Company dimension with the reference's defaults, and the latest quote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values (defaults of the reference's company record) ----------------
# name -> the symbol; sector and industry -> 'Unknown'; description and
# website -> ''; employees -> 0; market cap -> 0.
COMPANY_COLUMNS = ["symbol", "name", "sector", "industry", "description", "employees",
                   "website", "market_cap"]


def company_dimension(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Stand-in company table from the driver's supplier and nation tables:
    symbol = supplier name, sector = nation name, market cap = account balance."""
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
                    .select(F.col("s_name").alias("symbol"), F.col("s_name").alias("name"),
                            F.col("n_name").alias("sector"), F.lit(None).cast("string").alias("industry"),
                            F.lit(None).cast("string").alias("description"),
                            F.lit(None).cast("bigint").alias("employees"),
                            F.lit(None).cast("string").alias("website"),
                            F.col("s_acctbal").alias("market_cap")))


def with_company(symbols: DataFrame, company: DataFrame) -> DataFrame:
    """Attach company attributes to a symbol list; absent values take the
    defaults (a symbol missing from the dimension gets every default)."""
    d = symbols.select("symbol").join(company, "symbol", "left")
    return d.select(
        "symbol", F.coalesce("name", "symbol").alias("name"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("industry", F.lit("Unknown")).alias("industry"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("employees", F.lit(0).cast("bigint")).alias("employees"),
        F.coalesce("website", F.lit("")).alias("website"),
        F.coalesce("market_cap", F.lit(0.0)).alias("market_cap"))


def latest_quote(bars: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Latest bar per symbol as a quote: price, previous close, open, day
    high/low, volume. Only the last two bars of each symbol are kept, via a
    ``row_number() <= 2`` filter that runs map-side before the exchange."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    top = bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2)
    cur = F.when(F.col("_k") == 1, F.struct(order, "close", "open", "high", "low", "volume"))
    g = top.groupBy(key).agg(F.first(cur, ignorenulls=True).alias("q"),
                             F.first(F.when(F.col("_k") == 2, F.col("close")), ignorenulls=True)
                             .alias("previous_close"))
    return g.select(key, F.col(f"q.{order}").alias(f"quote_{order}"), F.col("q.close").alias("current_price"),
                    "previous_close", F.col("q.open").alias("open"), F.col("q.high").alias("day_high"),
                    F.col("q.low").alias("day_low"), F.col("q.volume").alias("volume"))
