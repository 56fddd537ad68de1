"""Price adjustment, price limits and limit streaks.

Limits follow integer cents: a price is rounded half up to cents, multiplied by a
whole percentage and rounded half up again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import by_symbol, lag, so_far

SPECIAL = r"(?i)ST|退"


def classify_board(symbol: Column) -> Column:
    """Board of a symbol, by its suffix and prefix."""
    starts = lambda a, b: symbol.startswith(a) | symbol.startswith(b)
    return F.when(symbol.endswith(".BJ"), "北交所").when(starts("300", "301"), "创业板").when(starts("688", "689"), "科创板").when(symbol.endswith(".SH"), "沪主板").when(symbol.endswith(".SZ"), "深主板").otherwise("其他")


def limit_pct(symbol: Column, name: Column) -> Column:
    """The daily price limit as a share."""
    growth = symbol.startswith("300") | symbol.startswith("301") | symbol.startswith("688") | symbol.startswith("689")
    return F.when(growth, 0.20).when(symbol.endswith(".BJ"), 0.30).when(F.coalesce(name.rlike(SPECIAL), F.lit(False)), 0.05).otherwise(0.10)


def limit_price(reference: Column, percent: Column) -> Column:
    """``reference`` times ``percent`` (a whole number, 110 for +10 %), in cents, half up twice."""
    cents = F.floor(reference * 100 + 0.5).cast("bigint")
    return F.floor((cents * percent.cast("bigint") + 50) / F.lit(100)).cast("double") / 100


def adjust_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Forward-adjusted prices with the raw ones kept, and ``ex_rights``.

    As-of by lookup: a symbol has a handful of factor events, which come to its bars as
    one array in order, so that bars stay where they are. The factor of a (symbol, date)
    that repeats is the last in order of value.
    """
    events = factors.groupBy("symbol", F.col("trade_date").alias("date")).agg(F.max("ex_factor").alias("f")).filter("f IS NOT NULL")
    times = lambda found: F.aggregate(found, F.lit(1.0), lambda a, e: a * e["f"])
    own = events.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "f"))).alias("_events")).withColumn("total", times(F.col("_events")))
    out = bars.join(own, "symbol", "left").withColumns(
        {
            "_cum": F.coalesce(times(F.filter("_events", lambda e: e["date"] <= F.col("date"))), F.lit(1.0)),
            "ex_rights": F.coalesce(F.exists("_events", lambda e: e["date"] == F.col("date")), F.lit(False)),
        }
    )
    ratio = F.col("_cum") / F.coalesce("total", F.lit(1.0))
    raw = {f"raw_{c}": F.col(c) for c in ("close", "high", "low")}
    return out.withColumns(raw | {"adj_ratio": ratio}).withColumns(
        {c: F.col(c) * F.col("adj_ratio") for c in ("open", "high", "low", "close")}
    ).drop("_cum", "_events", "total")


def with_limits(df: DataFrame, use_dimension: bool = True, newest: DataFrame | None = None) -> DataFrame:
    """Reference close, limit prices and limit signals; needs the raw columns, ``adj_ratio`` and ``name``.

    ``newest`` is one row with the last date, on which the dimension's limits hold; by
    default ``df`` is asked for it, which evaluates ``df`` twice.
    """
    moved = F.abs(F.col("adj_ratio") - lag("adj_ratio")) > 1e-6
    out = df.withColumn("prev_ref_close", F.when(moved, lag("close")).otherwise(lag("raw_close")))
    share = F.round(limit_pct(F.col("symbol"), F.col("name")) * 100).cast("int")
    out = out.withColumns(
        {"limit_up": limit_price(F.col("prev_ref_close"), share + 100), "limit_down": limit_price(F.col("prev_ref_close"), F.lit(100) - share)}
    )
    if use_dimension and {"dim_limit_up", "dim_limit_down"} <= set(df.columns):
        newest = df.agg(F.max("date")) if newest is None else newest
        out = out.join(F.broadcast(newest.toDF("_newest")))  # one row
        for side in ("up", "down"):
            given = F.col(f"dim_limit_{side}")
            out = out.withColumn(
                f"limit_{side}",
                F.when((F.col("date") == F.col("_newest")) & given.isNotNull() & (given < 10000), given).otherwise(F.col(f"limit_{side}"))
            )
        out = out.drop("_newest")
    up, down = F.col("limit_up"), F.col("limit_down")
    at_up, at_down = F.col("raw_close") >= up - 0.005, F.col("raw_close") <= down + 0.005
    out = out.withColumns({"signal_limit_up": at_up, "signal_limit_down": at_down})
    touched_down, touched_up = F.col("low") <= down + 0.005, F.col("raw_high") >= up - 0.005
    out = out.withColumns(
        {
            "signal_limit_down_recovery": touched_down & ~F.coalesce(at_down, F.lit(False)) & (F.col("close") > F.col("open")),
            "signal_broken_limit_up": touched_up & ~F.coalesce(at_up, F.lit(False)),
        }
    )
    return with_streaks(out, {"signal_limit_up": "consecutive_limit_ups", "signal_limit_down": "consecutive_limit_downs"})


def with_streaks(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """For each flag (key) a column (value) with the number of bars in a row it has been true; 0 where it is false or null."""
    numbered = df.withColumn("_n", F.row_number().over(by_symbol()))
    last_miss = lambda flag: F.coalesce(F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("_n"))).over(so_far()), F.lit(0))
    return numbered.withColumns({name: (F.col("_n") - last_miss(flag)).cast("int") for flag, name in flags.items()}).drop("_n")


def turnover_rate(volume: Column, float_shares: Column, lot: int = 10000) -> Column:
    """Percent of the float that changed hands."""
    return F.when(float_shares > 0, volume * lot / float_shares)
