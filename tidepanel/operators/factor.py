"""Factor research: rebalancing, rank IC, quantile groups, long-short."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import next_rebalance_price

#: Rebalancing periods of a year.
PERIODS = {"daily": 252, "weekly": 52, "monthly": 12}
# The factors of the catalog.
FACTORS = (
    "momentum_5d", "momentum_10d", "momentum_20d", "momentum_30d", "momentum_60d", "rsi_6", "rsi_14", "rsi_24",
    "annual_vol_20d", "atr_14", "vol_ratio_5d", "turnover_rate", "macd_hist", "kdj_k", "change_pct", "amplitude",
)


def rebalance_calendar(dates: DataFrame, freq: str) -> DataFrame:
    """The rebalance dates: every date, the Mondays present, or each month's first date."""
    days = dates.select("date").distinct()
    if freq == "weekly":
        return days.filter(F.weekday("date") == 0)
    if freq == "monthly":
        return days.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.min("date").alias("date")).select("date")
    return days


def period_return(bars: DataFrame, freq: str) -> DataFrame:
    """``symbol, date, next_date, ret``: the return to the next rebalance date; null on the last."""
    priced = next_rebalance_price(rebalance_calendar(bars, freq), bars)
    return priced.withColumn("ret", F.try_divide(F.col("next_close"), F.col("close")) - 1)


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank with ties averaged, nulls behind."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(F.col(column).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / F.lit(2.0)


def qcut_in_date(column: str, n: int) -> Column:
    """Quantile bin 0..n-1 of the date's distribution."""
    cuts = F.percentile(F.col(column), [k / n for k in range(1, n)]).over(Window.partitionBy("date"))
    return F.size(F.filter(cuts, lambda x: F.col(column) > x))


def rank_ic(rows: DataFrame, factor: str = "factor", ret: str = "ret", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Per key the correlation of the factor's and the return's average ranks, to four digits; null without variance."""
    keys = list(keys)
    fine = rows.filter(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    ranked = fine.select(*keys, average_rank(factor, keys).alias("a"), average_rank(ret, keys).alias("b"))
    cov = F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")
    var = lambda c: F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c)
    spread = F.sqrt(F.greatest(var("a") * var("b"), F.lit(0.0)))
    return ranked.groupBy(*keys).agg(F.round(F.try_divide(cov, spread), 4).alias("ic"), F.count(F.lit(1)).alias("n"))


def ic_summary(ics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation, their ratio, and the share of positive ICs."""
    ic = F.col("ic")
    out = ics.filter(ic.isNotNull()).groupBy(*keys).agg(
        F.avg(ic).alias("ic_mean"),
        F.stddev_pop(ic).alias("ic_std"),
        (F.count_if(ic > 0) / F.count(ic)).alias("win_rate"),
        F.count(ic).alias("periods")
    )
    return out.withColumn("ir", F.try_divide(F.col("ic_mean"), F.col("ic_std")))


def bucket_in_date(factor: str, n: int, keys: list[str]) -> Column:
    """Group 1..n: floor(order * n / count) + 1 in order of factor and symbol, nulls behind."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col(factor).asc_nulls_last(), F.col("symbol").asc_nulls_last())
    return (F.floor((F.row_number().over(order) - 1) * n / F.count(F.lit(1)).over(w)) + 1).cast("int")


def compound(returns: Column, order) -> Column:
    """Running product of 1 + r, for r > -1."""
    return F.exp(F.sum(F.log1p(returns)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def group_nav(rows: DataFrame, n: int = 5, factor: str = "factor", keys: tuple[str, ...] = ()) -> DataFrame:
    """``date, group, ret, nav`` of the ``n`` factor groups, the NAV to four digits."""
    keys = list(keys)
    fine = rows.filter(F.col(factor).isNotNull() & F.col("ret").isNotNull()).withColumn("group", bucket_in_date(factor, n, [*keys, "date"]))
    means = fine.groupBy(*keys, "date", "group").agg(F.avg("ret").alias("ret"))
    return means.withColumn("nav", F.round(compound(F.col("ret"), Window.partitionBy(*keys, "group").orderBy("date")), 4))


def curve_figures(curve: DataFrame, keys: list[str], value: str, freq: str) -> DataFrame:
    """Total and annual return, worst drawdown, Sharpe (population deviation, 0 without any) and win rate of a value series.

    Total and drawdown count from 1; the steps of Sharpe and win rate are those between values.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    peak = F.greatest(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    steps = curve.select(
        *keys,
        "date",
        F.col(value).alias("v"),
        (F.col(value) / peak - 1).alias("dd"),
        (F.try_divide(F.col(value), F.lag(value).over(w)) - 1).alias("r")
    )
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / F.lit(365.25), F.lit(1 / 365.25))
    total = F.max_by("v", "date") - 1
    return steps.groupBy(*keys).agg(
        total.alias("total_return"),
        (F.pow(F.greatest(1 + total, F.lit(1e-9)), 1 / years) - 1).alias("annual_return"),
        F.min("dd").alias("max_drawdown"),
        F.coalesce(F.try_divide(F.avg("r"), F.stddev_pop("r")) * math.sqrt(PERIODS[freq]), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.try_divide(F.count_if(F.col("r") > 0).cast("double"), F.count("r").cast("double")), F.lit(0.0)).alias("win_rate"),
    )


def group_stats(nav: DataFrame, freq: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return curve_figures(nav, [*keys, "group"], "nav", freq)


def long_short(nav: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Half of top minus bottom per period, from the rounded NAVs, with its own NAV and drawdown."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "group").orderBy("date")
    steps = nav.withColumn("r", F.try_divide(F.col("nav"), F.coalesce(F.lag("nav").over(w), F.lit(1.0))) - 1)
    pick = lambda g: F.max(F.when(F.col("group") == g, F.col("r")))
    out = steps.groupBy(*keys, "date").agg(((pick(n) - pick(1)) / 2).alias("ret")).filter("ret IS NOT NULL")
    by = Window.partitionBy(*keys).orderBy("date")
    out = out.withColumn("nav", compound(F.col("ret"), by))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)) - 1)


def factor_rows(df: DataFrame, factors: tuple[str, ...], freq: str, bars: DataFrame | None = None) -> DataFrame:
    """``factor_name, symbol, date, factor, ret``: factors become rows and a grouping key.

    ``bars`` (``symbol, date, close``) are what returns are made of; without them it is ``df``,
    whose factors are then worked out several times.
    """
    returns = period_return((df if bars is None else bars).select("symbol", "date", "close"), freq).select("symbol", "date", "ret")
    return df.select("symbol", "date", *factors).unpivot(["symbol", "date"], list(factors), "factor_name", "factor").join(returns, ["symbol", "date"])


def factor_catalog(df: DataFrame, factors: tuple[str, ...] = FACTORS, freq: str = "daily", bars: DataFrame | None = None) -> DataFrame:
    """IC summary of all factors in one job."""
    return ic_summary(rank_ic(factor_rows(df, factors, freq, bars), keys=("factor_name", "date")), ("factor_name",))


def factor_groups(df: DataFrame, factors: tuple[str, ...] = FACTORS, freq: str = "daily", n: int = 5, scale: float = 1.0, bars: DataFrame | None = None) -> DataFrame:
    """Figures of the ``n`` groups of all factors in one job; returns are multiplied by ``scale``."""
    rows = factor_rows(df, factors, freq, bars).withColumn("ret", F.col("ret") * scale)
    return group_stats(group_nav(rows, n, keys=("factor_name",)), freq, ("factor_name",))
