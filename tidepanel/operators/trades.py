"""Backtests as relational trade labelling.

Every candidate entry is labelled by itself: its later bars come to it as an array by a
window over its symbol, the first exit is picked by (bar, priority) in one fold, a
blocked exit moves to the first bar that sells. No bar is dealt out for it again.
Trials and folds are grouping keys, so a parameter sweep is one job: bars are joined
to entries once, and of an entry's bars only those stay on which some line, target,
signal or hold of the whole grid is reached for the first time; each trial then finds
its exit among these few.
"""

import itertools
import math
from collections.abc import Iterator
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .factor import compound
from .filters import in_window, one_price_limit_flag, tradable_flag
from .joins import delay_signal, entry_exit_range_join, forward_return, numbered
from .windows import by_symbol, lag, valid_shift

MOST_COMBINATIONS = 2000
# The objectives of a sweep, and those of which less is better.
OBJECTIVES = (
    "total_return",
    "annual_return",
    "sharpe",
    "sortino",
    "calmar",
    "win_rate",
    "profit_factor",
    "max_drawdown",
    "mc_maxdd_p50",
    "mc_maxdd_p95",
    "avg_pnl",
    "median_pnl",
    "n_trades",
    "avg_holding_days"
)
MINIMISED = ("avg_holding_days",)


def prepared(panel: DataFrame) -> DataFrame:
    """The panel with bar numbers, previous bar's state and the flags that block buying and selling."""
    out = panel.withColumns(
        {"_tradable": tradable_flag(), "_stuck_up": one_price_limit_flag("signal_limit_up"), "_stuck_down": one_price_limit_flag("signal_limit_down")}
    )
    return numbered(out).withColumn("last_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def _moved(panel: DataFrame, fill: str, delay: int) -> DataFrame:
    """All bars with ``entry_delayed``, whether an entry fills on them, and its price."""
    moved = delay_signal(panel, "entry", delay) if delay else panel.withColumns({"entry_delayed": F.col("entry"), "entry_source_date": F.col("date")})
    w = Window.partitionBy("symbol").orderBy("date")
    if fill == "next_open":
        moved = moved.withColumns(
            {"entry_delayed": F.coalesce(F.lag("entry_delayed").over(w), F.lit(False)), "entry_source_date": F.lag("entry_source_date").over(w)}
        )
    if (shift := delay + (fill == "next_open")) and "variants" in panel.columns:
        moved = moved.withColumn("variants", F.lag("variants", shift).over(w))
    return moved.withColumn("entry_price", F.col("open") if fill == "next_open" else F.col("close"))


def candidate_entries(panel: DataFrame, start, end, fill: str = "close", delay: int = 0) -> DataFrame:
    """Entry bars in the formal window, after the delay; filled at the close, or at the next bar's open."""
    return _moved(panel, fill, delay).filter(F.col("entry_delayed") & in_window(start, end))


def guard_reason(score_min: float | None = None, score_max: float | None = None) -> Column:
    """Why an entry is refused, or null."""
    out = F.when(~F.col("_tradable"), "suspended").when(
        ~F.coalesce(F.col("entry_price") > 0, F.lit(False)),
        "bad_price"
    ).when(F.col("_stuck_up"), "limit_up")
    score = F.coalesce("score", F.lit(0.0))
    low = score < score_min if score_min is not None else F.lit(False)
    return out.when(low | (score > score_max if score_max is not None else F.lit(False)), "score")


def entry_guards(entries: DataFrame, score_min=None, score_max=None) -> tuple[DataFrame, DataFrame]:
    """The entries that pass, and the count of each reason for refusal."""
    judged = entries.withColumn("reason", guard_reason(score_min, score_max))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _exit_columns(panel: DataFrame, fill: str) -> DataFrame:
    """``panel`` with what an exit on a bar needs: ``_exit``, the order price ``at``, ``sellable`` and ``later``, the next bar that sells."""
    opened = fill == "next_open"
    flag = F.coalesce(lag("exit"), F.lit(False)) if opened else F.coalesce("exit", F.lit(False))
    bars = panel.withColumns(
        {"_exit": flag, "at": F.col("open" if opened else "close"), "sellable": F.col("_tradable") & ~F.col("_stuck_down")}
    )
    bars = bars.withColumn("_sells", F.when(F.col("sellable"), F.struct("n", "date", F.col("at").alias("price"))))
    # The next value that isn't null is kept along; a frame up to the end would be gone through again for every bar.
    return bars.withColumn("later", valid_shift("_sells", -1)).drop("_sells")


def exit_bars(panel: DataFrame, fill: str = "close") -> DataFrame:
    """The bars an exit can fall on: prices, the order price ``at``, whether they sell, and ``later``, the next bar that does.

    Orders (signal, longest hold, end of data, deferred exits) fill at the close; with
    ``fill="next_open"`` at the open, and a signal on the bar after its own.
    """
    return _exit_columns(panel, fill).select("symbol", "n", "date", "open", "high", "low", "close", F.col("_exit").alias("exit"), "last_n", "at", "sellable", "later")


def _with_next(panel: DataFrame, hold: int, fill: str) -> DataFrame:
    """``panel`` with ``_next``: of every bar the next ``hold`` ones, as :func:`exit_bars` has them, in order."""
    bar = F.struct("n", "date", "open", "high", "low", F.col("_exit").alias("exit"), "last_n", "at", "sellable", "later")
    return _exit_columns(panel, fill).withColumn("_next", F.collect_list(bar).over(by_symbol().rowsBetween(1, hold))).drop("_exit", "at", "sellable", "later")


def highest_line(price: Column, peak: Column, stop: Column, trail: Column, start: Column, drop: Column) -> Column:
    """The highest of the stop, the trailing stop, and the trailing take-profit once the peak has gained ``start``: (line, rank, reason).

    A rule that is null has no line; equal lines go to the stop, then the trailing stop.
    """
    line = lambda value, rank, reason: F.when(value > 0, F.struct(value.alias("line"), F.lit(rank).alias("rank"), F.lit(reason).alias("reason")))
    active = (peak > price) & (peak / price - 1 >= start)
    return F.array_max(
        F.array(
            line(price * (1 - stop), 3, "stop_loss"),
            line(peak * (1 - trail), 2, "trailing_stop"),
            line(F.when(active, peak * (1 - drop)), 1, "trailing_take_profit")
        )
    )


def judged(bar, price: Column, line: Column, take: Column, hold: Column, held: Column) -> tuple[Column, Column]:
    """Why a position leaves on a bar (null: it stays) and at which price.

    In this order: the highest line, at the open if that gaps below it; the target,
    at the open if that gaps above it; the signal, the longest hold, the end of data.
    ``bar`` gives a bar's columns by name.
    """
    goal = price * (1 + take)
    down, up = bar("low") <= line["line"], bar("high") >= goal
    reason = F.when(down, line["reason"]).when(up, F.lit("take_profit")).when(bar("exit"), F.lit("signal")).when(held >= hold, F.lit("max_hold")).when(bar("n") == bar("last_n"), F.lit("end"))
    return reason, F.when(down, F.least(bar("open"), line["line"])).when(up, F.greatest(bar("open"), goal)).otherwise(bar("at"))


def _positive(x: float | None) -> Column:
    return F.lit(None if x is None else abs(float(x))).cast("double")


#: Columns of a labelled exit.
_EXIT = ("symbol", "entry_n", "entry_date", "entry_price", "reason", "price", "exit_date", "exit_n", "sellable", "later")


def _held_bars(entries: DataFrame, panel: DataFrame, hold: int, fill: str, *more: str) -> DataFrame:
    """Every entry with its next ``hold`` bars and the highest price before each of them, the entry's own from its price and high on."""
    left = entries.select("symbol", F.col("n").alias("entry_n"), F.col("date").alias("entry_date"), "entry_price", F.col("high").alias("entry_high"), *more)
    rows = entry_exit_range_join(left, exit_bars(panel, fill), hold)
    before = Window.partitionBy("symbol", "entry_n").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("peak", F.greatest("entry_price", "entry_high", F.max("high").over(before)))


def label_exits(
    entries: DataFrame,
    panel: DataFrame,
    hold: int,
    stop: float | None = 0.06,
    take: float | None = None,
    trail: float | None = None,
    profit_start: float | None = None,
    profit_trail: float | None = None,
    exit_fill: str = "close"
) -> DataFrame:
    """Each entry's exit: bar, reason and price; signs of the rules don't count.

    The bar on which an order fills may not sell; ``later`` is the next one that does.
    """
    own = _with_next(panel, hold, exit_fill).select("symbol", F.col("n"), "_next")
    return _first_exits(entries.join(own, ["symbol", "n"]), hold, stop, take, trail, profit_start, profit_trail)


def _first_exits(
    entries: DataFrame,
    hold: int,
    stop: float | None = 0.06,
    take: float | None = None,
    trail: float | None = None,
    profit_start: float | None = None,
    profit_trail: float | None = None,
) -> DataFrame:
    """The exits of entries that have their ``_next`` bars: one fold along them, which carries the highest price before a bar."""
    start, drop = (profit_start, profit_trail) if profit_start is not None and profit_trail is not None else (None, None)
    p = F.col("entry_price")

    def left(bar: Column, peak: Column) -> Column:
        """The bar's reason and price, or null where the position stays."""
        line = highest_line(p, peak, *map(_positive, (stop, trail, start, drop)))
        reason, price = judged(lambda c: bar[c], p, line, _positive(take), F.lit(hold), bar["n"] - F.col("n"))
        return F.when(reason.isNotNull(), F.struct(reason.alias("reason"), price.alias("price"), bar.alias("bar")))

    first, peak = F.get("_next", F.lit(0)), F.greatest("entry_price", "high")
    none = F.when(F.lit(False), left(first, peak))
    step = lambda a, bar: F.when(a["x"].isNotNull(), a).otherwise(F.struct(F.greatest(a["peak"], bar["high"]).alias("peak"), left(bar, a["peak"]).alias("x")))
    found = F.aggregate("_next", F.struct(peak.alias("peak"), none.alias("x")), step, lambda a: a["x"])
    # Where there are next bars, the last of them ends the hold or the data; a filter on the result would work out the fold twice.
    rows = entries.filter(F.size("_next") > 0).select("symbol", F.col("n").alias("entry_n"), F.col("date").alias("entry_date"), "entry_price", found.alias("x"))
    return rows.select(
        "symbol", "entry_n", "entry_date", "entry_price", "x.reason", "x.price", F.col("x.bar.date").alias("exit_date"), F.col("x.bar.n").alias("exit_n"), "x.bar.sellable", "x.bar.later"
    )


def defer_blocked(exits: DataFrame) -> DataFrame:
    """Exits on bars that can't sell move to the first later bar that can, however late, at its order price; the reason stays and the days are counted.

    Where no later bar can sell, the exit keeps its bar and price, with no blocked days.
    Columns beside those of an exit stay.
    """
    late = ~F.col("sellable") & F.col("later").isNotNull()
    moved = lambda field, own: F.when(late, F.col(f"later.{field}")).otherwise(F.col(own))
    return exits.select(
        *[c for c in exits.columns if c not in _EXIT],
        "symbol",
        "entry_n",
        "entry_date",
        "entry_price",
        "reason",
        moved("price", "price").alias("exit_price"),
        moved("date", "exit_date").alias("exit_date"),
        moved("n", "exit_n").alias("exit_n"),
        F.when(late, F.col("later.n") - F.col("exit_n")).otherwise(0).cast("int").alias("blocked_days")
    )


def trade_costs(trades: DataFrame, commission: float = 0.0003, slippage: float = 0.0005, stamp: float = 0.0005) -> DataFrame:
    """``pnl_pct`` on the cost basis; the sale bears the stamp tax too."""
    cost, got = F.col("entry_price") * (1 + commission + slippage), F.col("exit_price") * (1 - commission - slippage - stamp)
    return trades.withColumns({"pnl_pct": F.try_divide(got, cost) - 1, "duration": (F.col("exit_n") - F.col("entry_n")).cast("int")})


def label_trades(
    panel: DataFrame, start, end, hold: int, stop: float | None, fill: str = "close", delay: int = 0, exit_fill: str | None = None, **rules
) -> DataFrame:
    """Entries, guards, exits, deferral and costs in one plan; ``panel`` as :func:`prepared` gives it.

    Entries fill as ``fill`` says, exits as ``exit_fill``, or as the entries do.
    """
    bars = _with_next(_moved(panel, fill, delay), hold, exit_fill or fill)
    entries, _ = entry_guards(bars.filter(F.col("entry_delayed") & in_window(start, end)))
    return trade_costs(defer_blocked(_first_exits(entries, hold, stop, **rules)))


def minute_fill_price(orders: DataFrame, minutes: DataFrame) -> DataFrame:
    """Fill of a line (``line``, ``side`` buy or sell) in minute bars: the open if it gaps past the line, the line if it is crossed, else the last close; without minutes the daily price."""
    m = minutes.withColumn("date", F.to_date("datetime")).groupBy("symbol", "date").agg(
        F.min_by("open", "datetime").alias("m_open"),
        F.max_by("close", "datetime").alias("m_close"),
        F.max("high").alias("m_high"),
        F.min("low").alias("m_low"),
        F.try_divide(F.sum("amount"), F.sum("volume").cast("double")).alias("m_vwap")
    )
    buy, line = F.col("side") == "buy", F.col("line")
    gap = F.when(buy, F.col("m_open") >= line).otherwise(F.col("m_open") <= line)
    crossed = F.when(buy, F.col("m_high") >= line).otherwise(F.col("m_low") <= line)
    price = F.when(
        F.col("m_open").isNull(),
        F.col("daily_price")
    ).when(line.isNull(), F.coalesce("m_vwap", "m_close")).when(gap, F.col("m_open")).when(crossed, line).otherwise(F.col("m_close"))
    return orders.join(m, ["symbol", "date"], "left").withColumn("fill_price", price)


def daily_top_n_slots(entries: DataFrame, n: int) -> DataFrame:
    """The ``n`` best-scored entries of each day."""
    w = Window.partitionBy("date").orderBy(F.col("score").desc(), "symbol")
    return entries.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= n)


def weighted_slots(entries: DataFrame, n: int, sizing: str = "equal") -> DataFrame:
    """The day's ``n`` best-scored entries with their ``weight`` among them: equal, or by score (``score_weight``), negative scores counting as 0."""
    if sizing not in ("equal", "score_weight"):
        raise ValueError(f"unknown sizing: {sizing}")
    day = Window.partitionBy("date")
    equal, worth = 1 / F.count(F.lit(1)).over(day), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    weight = equal if sizing == "equal" else F.coalesce(F.try_divide(worth, F.sum(worth).over(day)), equal)
    return daily_top_n_slots(entries, n).withColumn("weight", weight)


def numbered_dates(dates: DataFrame) -> DataFrame:
    """``date, day``: the trading dates, from 1; a row a date."""
    return dates.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")).cast("int"))


def slot_portfolio(trades: DataFrame, dates: DataFrame, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """NAV on every trading date, from the mean of the trades realised on it (weighted by a column if asked for); 0 where none is.

    ``dates`` has the trading dates, and may have ``keys`` columns too: then each key has
    its own. A key's days are joined to their numbers; each stands for the days up to the
    key's next one, so that no date is paired with a key that it isn't a row of.
    """
    keys = list(keys)
    own = [k for k in keys if k in dates.columns]
    order = Window.partitionBy(*own).orderBy("date")
    days = dates.select(*own, "date").distinct().withColumn("day", F.row_number().over(order).cast("int"))
    days = days.withColumn("days", F.count(F.lit(1)).over(Window.partitionBy(*own)).cast("int"))
    mean = F.avg("pnl_pct") if weight is None else F.coalesce(F.try_divide(F.sum(F.col("pnl_pct") * F.col(weight)), F.sum(weight)), F.lit(0.0))
    sold = trades.groupBy(*keys, F.col("exit_date").alias("date")).agg(mean.alias("ret"), F.count(F.lit(1)).alias("n")).join(days, [*own, "date"]).drop("date")
    along = Window.partitionBy(*keys).orderBy("day")
    first = F.when(F.lag("day").over(along).isNull(), F.lit(1)).otherwise(F.col("day"))
    held = sold.withColumn("_span", F.sequence(first, F.coalesce(F.lead("day").over(along) - 1, F.col("days"))))
    each = held.select(*keys, "ret", "n", F.col("day").alias("_sold"), F.explode("_span").alias("day"))
    here = F.col("_sold") == F.col("day")
    each = each.select(*keys, "day", F.when(here, F.col("ret")).otherwise(0.0).alias("ret"), F.when(here, F.col("n")).otherwise(0).alias("n"))
    nav = each.join(days.drop("days"), [*own, "day"])
    return nav.select(*keys, "date", "ret", "n", compound(F.greatest("ret", F.lit(-0.9999)), Window.partitionBy(*keys).orderBy("date")).alias("equity"))


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Figures of the trades; a trade without gain counts as a loss. ``profit_factor`` is the mean gain over the mean loss, null without a loss."""
    r = F.col("pnl_pct")
    gain, loss = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.abs(F.avg(F.when(r <= 0, r))), F.lit(0.0))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.count_if(r > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.when(loss > 0, gain / loss).alias("profit_factor"),
        gain.alias("avg_win"),
        loss.alias("avg_loss"),
        F.avg(r).alias("avg_pnl"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        F.median(r).alias("median_pnl"),
        F.avg("duration").alias("avg_holding_days"),
    )


def curve_stats(curve: DataFrame, keys: tuple[str, ...] = (), value: str = "equity") -> DataFrame:
    """Total, annual, drawdown, Sharpe, Sortino (against 0, over all steps; null without a loss), Calmar."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    peak = F.greatest(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    steps = curve.select(
        *keys,
        "date",
        F.col(value).alias("v"),
        (F.col(value) / peak - 1).alias("dd"),
        (F.try_divide(F.col(value), F.coalesce(F.lag(value).over(w), F.lit(1.0))) - 1).alias("r")
    )
    r, year = F.col("r"), math.sqrt(252)
    out = steps.groupBy(*keys).agg(
        (F.max_by("v", "date") - 1).alias("total_return"),
        F.greatest(F.datediff(F.max("date"), F.min("date")) / F.lit(365.25), F.lit(1 / 365.25)).alias("_years"),
        F.min("dd").alias("max_drawdown"),
        (F.try_divide(F.avg(r), F.stddev_pop(r)) * year).alias("sharpe"),
        (F.try_divide(F.avg(r), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))) * year).alias("sortino"),
    )
    out = out.withColumn("annual_return", F.pow(F.greatest(1 + F.col("total_return"), F.lit(1e-9)), 1 / F.col("_years")) - 1)
    return out.withColumn("calmar", F.try_divide(F.col("annual_return"), F.abs("max_drawdown"))).drop("_years")


def per_symbol_stats(trades: DataFrame) -> DataFrame:
    r = F.greatest(F.col("pnl_pct"), F.lit(-0.9999))
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"),
        (F.count_if(r > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.max("pnl_pct").alias("best"),
        F.min("pnl_pct").alias("worst")
    )


def return_histogram(trades: DataFrame, bins: int = 20, reach: float = 0.2) -> DataFrame:
    """Counts in equal bins of the returns clipped to ±``reach``, the last bin closed."""
    r = F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col("pnl_pct")))
    place = F.least(F.floor(F.round((r + reach) / (2 * reach / bins), 9)), F.lit(bins - 1)).cast("int")
    return trades.filter("pnl_pct IS NOT NULL").groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Most simulations of a bootstrap, and the draws (trades times simulations) that they keep to, down to ``LEAST_SIMULATIONS``.
SIMULATIONS, LEAST_SIMULATIONS, DRAWS = 1000, 200, 2_000_000
#: Modulus of the draws' hash.
_PRIME = 2**31 - 1


def draws(n: int, simulation: int, seed: int = 42) -> np.ndarray:
    """Which of ``n`` trades stands at each place of a simulation, by a seeded hash of whole numbers that SQL can spell as well."""
    x = (np.arange(1, n + 1, dtype=np.int64) * 7919 + simulation * 104729 + seed) % _PRIME
    x = x * 48271 % _PRIME
    x = (x ^ (x >> 15)) * 69621 % _PRIME
    return (x ^ (x >> 12)) * 16807 % _PRIME % n


def worst_drawdowns(pnls: np.ndarray, simulations: int = SIMULATIONS, seed: int = 42) -> tuple[float | None, float | None]:
    """Median and 95th percentile of the worst drawdown of trades drawn with replacement; none for fewer than three."""
    logs = np.log1p(np.maximum(pnls[np.isfinite(pnls)], -0.9999))  # sums of logarithms don't overflow
    n = len(logs)
    if n < 3:
        return None, None
    worst = []
    for k in range(1, min(simulations, max(LEAST_SIMULATIONS, DRAWS // n)) + 1):
        equity = np.cumsum(logs[draws(n, k, seed)])
        worst.append(float(np.expm1((equity - np.maximum.accumulate(equity)).min())))
    return float(np.percentile(worst, 50)), float(np.percentile(worst, 5))


def bootstrap_drawdown(trades: DataFrame, keys: tuple[str, ...] = (), simulations: int = SIMULATIONS, seed: int = 42) -> DataFrame:
    """``keys, mc_maxdd_p50, mc_maxdd_p95``: drawdowns that the luck of the order makes, per key.

    A key's trades stream through one task in order of (symbol, entry): its returns, 8
    bytes a trade, stand in an array, and one simulation at a time draws from it.
    """
    keys = list(keys)
    if not keys:
        return bootstrap_drawdown(trades.withColumn("_all", F.lit(0)), ("_all",), simulations, seed).drop("_all")
    rows = trades.select(*keys, F.col("pnl_pct").cast("double").alias("_r"), "symbol", "entry_date", "exit_date")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "symbol", "entry_date", "exit_date", "_r").select(*keys, "_r")
    columns = len(keys)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close(like: pa.RecordBatch) -> pa.RecordBatch:
            p50, p95 = worst_drawdowns(np.concatenate(parts), simulations, seed)
            arrays = [pa.array([v], f.type) for v, f in zip(key, like.schema)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([p50], pa.float64()), pa.array([p95], pa.float64())], names=[*keys, "mc_maxdd_p50", "mc_maxdd_p95"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch
            values = batch.column(columns).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ends = np.zeros(batch.num_rows, dtype=bool)
            for k in range(columns):
                codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                ends[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(ends).tolist(), batch.num_rows]
            for i, j in zip(starts, starts[1:]):
                own = tuple(batch.column(k)[i].as_py() for k in range(columns))
                if key is not None and own != key:
                    yield close(batch)
                    parts = []
                key = own
                parts.append(values[i:j])
        if key is not None:
            yield close(last)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(of, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", mc_maxdd_p50 double, mc_maxdd_p95 double")


def forward_eval(panel: DataFrame, n: int, scale: float = 1.0) -> DataFrame:
    """Per day the mean ``n``-bar forward return of the entries, their number, and the equity and drawdown of these means compounded."""
    rows = _forward(panel, n, scale)
    days = rows.groupBy("date").agg(F.avg("fwd").alias("ret"), F.count(F.lit(1)).alias("n"))
    along = Window.orderBy("date")  # a row a date
    days = days.withColumn("equity", compound(F.col("ret"), along))
    return days.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)) - 1)


def _forward(panel: DataFrame, n: int, scale: float) -> DataFrame:
    return panel.withColumn("fwd", forward_return(n) * scale).filter(F.col("entry") & F.col("fwd").isNotNull() & ~F.isnan("fwd"))


def forward_stats(panel: DataFrame, n: int, benchmark: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row on how well the entries choose: returns of the picks, of the compounded daily means, and their excess over a benchmark (date, close) of the same dates."""
    r, curve = F.col("fwd"), forward_eval(panel, n, scale)
    gain, loss = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.abs(F.avg(F.when(r <= 0, r))), F.lit(0.0))
    picks = _forward(panel, n, scale).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.avg(r).alias("avg_return"),
        F.median(r).alias("median_return"),
        (F.count_if(r > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.when(loss > 0, gain / loss).alias("profit_factor"),
        F.max(r).alias("best"),
        F.min(r).alias("worst")
    )
    days = curve.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("n").alias("avg_daily_candidates"),
        (F.max_by("equity", "date") - 1).alias("total_return"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * math.sqrt(252), F.lit(0.0)).alias("sharpe"),
        F.min("date").alias("_from"),
        F.max("date").alias("_to")
    )
    inside = benchmark.join(F.broadcast(days.select("_from", "_to")), F.col("date").between(F.col("_from"), F.col("_to")))  # one row
    held = inside.agg(F.coalesce(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1, F.lit(0.0)).alias("benchmark_return"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(picks).join(one(days), "_one").join(one(held), "_one").drop("_one", "_from", "_to")
    return out.withColumn("excess", F.col("total_return") - F.col("benchmark_return"))


def signal_panel(df: DataFrame, entries: list[str], exits: list[str], rsi: tuple[float, float] | None = None) -> DataFrame:
    """Entry and exit from any of the named signals, and from RSI thresholds."""
    any_of = lambda names: reduce(lambda a, b: a | b, [F.coalesce(F.col(x), F.lit(False)) for x in names], F.lit(False))
    entry, exit_ = any_of(entries), any_of(exits)
    if rsi:
        entry, exit_ = entry | F.coalesce(F.col("rsi_14") < rsi[0], F.lit(False)), exit_ | F.coalesce(F.col("rsi_14") > rsi[1], F.lit(False))
    return df.withColumns({"entry": entry, "exit": exit_})


def signal_backtest(
    df: DataFrame, entries: list[str], exits: list[str], start, end, hold: int, rsi: tuple[float, float] | None = None, matching: str = "next_open", **rules
) -> DataFrame:
    """Trades of a backtest on named signals: with ``next_open`` both sides act on the bar after their signal, at its open, else at the close."""
    flagged = signal_panel(df, entries, exits, rsi)
    for name in ("signal_limit_up", "signal_limit_down"):
        if name not in flagged.columns:
            flagged = flagged.withColumn(name, F.lit(False))
    if "score" not in flagged.columns:
        flagged = flagged.withColumn("score", F.lit(0.0))
    return label_trades(prepared(flagged), start, end, hold, rules.pop("stop", None), matching, **rules)


def grid_values(spec) -> list:
    """Values of one parameter: a list, ``{values}``, or ``{min, max, step}`` with the end kept; repeated ones once."""
    if isinstance(spec, dict) and "values" in spec:
        spec = spec["values"]
    if isinstance(spec, dict):
        low, high, step = spec["min"], spec["max"], spec["step"]
        if step <= 0 or high < low:
            raise ValueError(f"not a range: {spec}")
        n = int(math.floor((high - low) / step + 1e-9))
        spec = [round(low + k * step, 10) for k in range(n + 1)]
        spec += [high] if spec[-1] < high - 1e-9 else []
    return list(dict.fromkeys(spec))


def param_grid(grid: dict, allowed: dict[str, tuple[float, float]] | None = None) -> list[dict]:
    """All combinations, at most ``MOST_COMBINATIONS``; unknown or out-of-range values are refused."""
    values = {k: grid_values(v) for k, v in grid.items()}
    for k, vs in values.items():
        if allowed is not None and (k not in allowed or any(not allowed[k][0] <= v <= allowed[k][1] for v in vs)):
            raise ValueError(f"unknown or out of range: {k}")
    if math.prod(map(len, values.values())) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations")
    return [dict(zip(values, c)) for c in itertools.product(*values.values())]


def grid_frame(spark: SparkSession, grid: dict) -> DataFrame:
    """The combinations as rows with a ``trial_id``."""
    combos = param_grid(grid)
    names = list(grid)
    return spark.createDataFrame(
        [(k, *[float(c[n]) for n in names]) for k, c in enumerate(combos)],
        "trial_id int, " + ", ".join(f"{n} double" for n in names)
    )


#: Rules of a trial, each a positive share or null; ``hold`` is a number of bars.
RULES = ("stop", "take", "trail", "profit_start", "profit_trail")


def trial_frame(spark: SparkSession, trials: list[dict]) -> tuple[DataFrame, dict]:
    """The trials as rows with a ``trial_id``, each rule with its place among the grid's distinct values; and these values.

    A trial is a dict of ``hold``, any of ``RULES`` and ``variant``, which set of entries it takes (0).
    """
    clean = [{**{r: None if t.get(r) is None else abs(float(t[r])) for r in RULES}, "hold": int(t["hold"]), "variant": int(t.get("variant", 0))} for t in trials]
    for t in clean:
        if t["profit_start"] is None or t["profit_trail"] is None:
            t["profit_start"] = t["profit_trail"] = None
    own = lambda name: sorted({t[name] for t in clean if t[name] is not None})
    values = {r: own(r) for r in ("stop", "take", "trail", "hold", "profit_start")}
    values["profit_trail"] = [sorted({t["profit_trail"] for t in clean if t["profit_start"] == a}) for a in values["profit_start"]]
    rows = []
    for k, t in enumerate(clean):
        place = {r: values[r].index(t[r]) + 1 if t[r] is not None else None for r in ("stop", "take", "trail", "hold", "profit_start")}
        place["profit_trail"] = values["profit_trail"][place["profit_start"] - 1].index(t["profit_trail"]) + 1 if place["profit_start"] else None
        rows.append((k, t["variant"], t["hold"], *(t[r] for r in RULES), *(place[r] for r in (*RULES, "hold"))))
    schema = "trial_id int, variant int, hold int, " + ", ".join(f"{r} double" for r in RULES) + ", " + ", ".join(f"_{r} int" for r in (*RULES, "hold"))
    return spark.createDataFrame(rows, schema), values


def _events(rows: DataFrame, values: dict) -> DataFrame:
    """Per entry the bars on which something of the grid is reached for the first time, in order.

    A bar reaches the first so many of a rule's sorted values; a bar that reaches more
    than all before it is an event. So an entry has at most as many events as the grid
    has distinct values, however many trials combine them.
    """
    p, peak = F.col("entry_price"), F.col("peak")
    reached = lambda conditions: reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions], F.lit(0))
    active = lambda a: (peak > p) & (peak / p - 1 >= a)
    levels = {
        "stop": reached(F.col("low") <= p * (1 - F.lit(v)) for v in values["stop"]),
        "trail": reached(F.col("low") <= peak * (1 - F.lit(v)) for v in values["trail"]),
        "take": reached(F.col("high") >= p * (1 + F.lit(v)) for v in values["take"]),
        "hold": reached(F.col("n") - F.col("entry_n") >= F.lit(v) for v in values["hold"]),
        "signal": F.col("exit").cast("int"),
        "end": (F.col("n") == F.col("last_n")).cast("int"),
    }
    for j, (a, drops) in enumerate(zip(values["profit_start"], values["profit_trail"])):
        levels[f"profit{j}"] = reached(active(F.lit(a)) & (F.col("low") <= peak * (1 - F.lit(v))) for v in drops)
    out = rows.withColumns({f"_{k}": v for k, v in levels.items()})
    before = Window.partitionBy("symbol", "entry_n").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    new = reduce(lambda a, b: a | b, [F.col(f"_{k}") > F.coalesce(F.max(f"_{k}").over(before), F.lit(0)) for k in levels])
    profits = [F.col(f"_profit{j}") for j in range(len(values["profit_start"]))]
    bar = F.struct(
        "n", "date", "open", "high", "low", "at", "peak", "exit", "last_n", "sellable", "later",
        *(F.col(f"_{k}").alias(f"_{k}") for k in ("stop", "trail", "take", "hold")), (F.array(*profits) if profits else F.array().cast("array<int>")).alias("_profit")
    )
    more = [c for c in ("variants",) if c in rows.columns]
    events = out.withColumn("_new", new).filter("_new").groupBy("symbol", "entry_n", "entry_date", "entry_price", *more)
    return events.agg(F.array_sort(F.collect_list(bar)).alias("events"))


def sweep(
    panel: DataFrame, trials: list[dict], start, end, fill: str = "close", delay: int = 0, exit_fill: str | None = None, variants: list[Column] | None = None, commission: float = 0.0003, slippage: float = 0.0005, stamp: float = 0.0005
) -> DataFrame:
    """Labelled trades of all trials in one job: each trial's are those of :func:`label_trades` with its values.

    ``variants`` are entry conditions, one for each set of strategy parameters; without
    them the column ``entry`` is variant 0. Bars are joined to the entries of all variants
    once, for the longest hold, and cut down to events; the trials, at most
    ``MOST_COMBINATIONS`` rows, multiply the entries they take, not their bars.
    """
    if not 0 < len(trials) <= MOST_COMBINATIONS:
        raise ValueError(f"between 1 and {MOST_COMBINATIONS} trials")
    if variants is not None:
        sets = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in enumerate(variants)]), lambda x: x.isNotNull())
        panel = panel.withColumn("variants", sets).withColumn("entry", F.size("variants") > 0)
    frame, values = trial_frame(panel.sparkSession, trials)
    entries, _ = entry_guards(candidate_entries(panel, start, end, fill, delay))
    more = ["variants"] if variants is not None else []
    events = _events(_held_bars(entries, panel, max(values["hold"]), exit_fill or fill, *more), values)
    takes = F.array_contains("variants", F.col("variant")) if more else F.col("variant") == 0
    own = events.join(F.broadcast(frame), takes)  # at most MOST_COMBINATIONS rows
    past = lambda e, name: F.coalesce(e[f"_{name}"] >= F.col(f"_{name}"), F.lit(False))
    profit = lambda e: F.coalesce(F.get(e["_profit"], F.col("_profit_start") - 1) >= F.col("_profit_trail"), F.lit(False))
    leaves = lambda e: past(e, "stop") | past(e, "trail") | profit(e) | past(e, "take") | e["exit"] | past(e, "hold") | (e["n"] == e["last_n"])
    picked = own.withColumn("e", F.get(F.filter("events", leaves), F.lit(0))).filter("e IS NOT NULL").drop("events")
    p = F.col("entry_price")
    picked = picked.withColumn("line", highest_line(p, F.col("e.peak"), *(F.col(r) for r in ("stop", "trail", "profit_start", "profit_trail"))))
    reason, price = judged(lambda c: F.col(f"e.{c}"), p, F.col("line"), F.col("take"), F.col("hold"), F.col("e.n") - F.col("entry_n"))
    exits = picked.select(
        "trial_id", "symbol", "entry_n", "entry_date", "entry_price", reason.alias("reason"), price.alias("price"), F.col("e.date").alias("exit_date"), F.col("e.n").alias("exit_n"), "e.sellable", "e.later"
    )
    return trade_costs(defer_blocked(exits), commission, slippage, stamp)


#: Objectives that the curve of realised trades gives, and those that resampling gives; the others come from the trades.
OF_CURVE = ("total_return", "annual_return", "sharpe", "sortino", "calmar", "max_drawdown")
OF_DRAWS = ("mc_maxdd_p50", "mc_maxdd_p95")


def trial_stats(trades: DataFrame, objective: str, keys: tuple[str, ...], dates: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """The trades' figures per key, with those of the curve or of the resampling where the objective, or one of ``always``, is among them."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    out, wanted = trade_stats(trades, keys), {objective, *always}
    if wanted & set(OF_CURVE):
        out = out.join(curve_stats(slot_portfolio(trades, dates, keys), keys), list(keys))
    return out.join(bootstrap_drawdown(trades, keys), list(keys)) if wanted & set(OF_DRAWS) else out


def goodness(objective: str, direction: str | None = None) -> Column:
    """The objective so that more is better, to six digits, so that sums in another order don't part equal trials; null and infinite ones are worst."""
    low = (direction or ("min" if objective in MINIMISED else "max")) == "min"
    value = F.round(F.col(objective).cast("double"), 6)
    return F.when(F.abs(value) < float("inf"), -value if low else value)


def rank_trials(trades: DataFrame, dates: DataFrame, objective: str = "avg_pnl", keys: tuple[str, ...] = ("trial_id",), direction: str | None = None) -> DataFrame:
    """Trials from the best to the worst by an objective, most by it or least where less is better, nulls last."""
    stats = trial_stats(trades, objective, keys, dates)
    others = [k for k in keys if k != "trial_id"]
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(*others).orderBy(goodness(objective, direction).desc_nulls_last(), "trial_id")))


def walkforward_folds(start: date, end: date, train_days: int, test_days: int, step_days: int) -> list[tuple[int, date, date, date, date]]:
    """Rolling folds; a test starts the day after its train ends, and no fold reaches beyond the end."""
    if min(train_days, test_days, step_days) <= 0:
        raise ValueError("days must be positive")
    out, at = [], start
    while True:
        train_end = at + timedelta(days=train_days)
        test_end = train_end + timedelta(days=1 + test_days)
        if test_end > end:
            return out
        out.append((len(out), at, train_end, train_end + timedelta(days=1), test_end))
        at += timedelta(days=step_days)


def fold_frame(spark: SparkSession, folds: list) -> DataFrame:
    return spark.createDataFrame(folds, "fold int, train_start date, train_end date, test_start date, test_end date")


def windows_of(folds: DataFrame) -> DataFrame:
    """``fold, tested, first, last``: both windows of each fold as rows."""
    part = lambda name, tested: F.struct(F.lit(tested).alias("tested"), F.col(f"{name}_start").alias("first"), F.col(f"{name}_end").alias("last"))
    return folds.select("fold", F.explode(F.array(part("train", False), part("test", True))).alias("w")).select("fold", "w.*")


def windowed_trades(trades: DataFrame, bars: DataFrame, windows: DataFrame) -> DataFrame:
    """The trades whose entries lie in each window, as if its data ended with it.

    A trade that would leave later leaves on the symbol's last bar in the window, at the
    close, with reason "end"; one entered on that bar is none. ``bars`` has ``symbol,
    date, n, close``; ``windows`` (``fold, tested, first, last``) are some dozens of rows.
    """
    w = F.broadcast(windows)
    ahead = F.coalesce(F.lead("date").over(Window.partitionBy("symbol").orderBy("date")), F.lit("9999-12-31").cast("date"))
    last_bars = bars.select("symbol", "date", "n", "close", ahead.alias("_next")).join(w, (F.col("last") >= F.col("date")) & (F.col("last") < F.col("_next")))
    last_bars = last_bars.select("symbol", "fold", "tested", F.col("date").alias("_last_date"), F.col("n").alias("_last_n"), F.col("close").alias("_last_close"))
    own = trades.join(w, F.col("entry_date").between(F.col("first"), F.col("last"))).join(last_bars, ["symbol", "fold", "tested"]).filter("entry_n < _last_n")
    over = F.col("exit_n") > F.col("_last_n")
    cut_off = lambda late, own_: F.when(over, F.col(late)).otherwise(F.col(own_))
    out = own.withColumns(
        {
            "reason": F.when(over, "end").otherwise(F.col("reason")),
            "exit_price": cut_off("_last_close", "exit_price"),
            "exit_date": cut_off("_last_date", "exit_date"),
            "exit_n": cut_off("_last_n", "exit_n"),
            "blocked_days": F.when(over, 0).otherwise(F.col("blocked_days")).cast("int"),
        }
    )
    return trade_costs(out.drop("first", "last", "_last_date", "_last_n", "_last_close"))


def walkforward(trades: DataFrame, folds: DataFrame, bars: DataFrame, objective: str = "sortino", direction: str | None = None, scale: float = 1.0) -> DataFrame:
    """Per fold the trial that is best on its train window, its figures on the test window, and how much it lost there.

    ``trades`` are a sweep's over the whole time. ``degradation`` is the objective on
    train less that on test, the other way round where less is better. Folds of which
    either window has no trade of the chosen trial are left out. ``scale`` multiplies the returns.
    """
    windows = windows_of(folds)
    tagged = windowed_trades(trades, bars, windows).withColumn("pnl_pct", F.col("pnl_pct") * scale)
    days = bars.select("date").distinct().join(F.broadcast(windows), F.col("date").between(F.col("first"), F.col("last"))).select("fold", "tested", "date")
    stats = trial_stats(tagged, objective, ("fold", "tested", "trial_id"), days, ("total_return",))
    good = goodness(objective, direction)
    place = F.row_number().over(Window.partitionBy("fold").orderBy("tested", good.desc_nulls_last(), "trial_id"))
    # The best train trial and its test figures in one pass over the few rows of a fold.
    ranked = stats.withColumns({"_place": place, "_good": good})
    best = F.first(F.struct("trial_id", objective, "_good")).over(Window.partitionBy("fold").orderBy("_place"))
    out = ranked.withColumn("_best", best).filter("tested AND trial_id = _best.trial_id")
    return out.withColumns({"train_value": F.col(f"_best.{objective}"), "degradation": F.col("_best._good") - F.col("_good")}).drop("_place", "_good", "_best", "tested")


def out_of_sample(result: DataFrame, n_folds: int, objective: str = "sortino", direction: str | None = None) -> DataFrame:
    """One row on a walk-forward: folds that count and that were left out, compounded return, means of the objective, degradation and consistency.

    Means are taken over the folds that have a value; ``consistency`` is the share of folds with a gain.
    """
    sign = -1 if (direction or ("min" if objective in MINIMISED else "max")) == "min" else 1
    inside, outside = F.avg("train_value"), F.avg(objective)
    return result.agg(
        F.count(F.lit(1)).alias("n_folds"),
        (F.lit(n_folds) - F.count(F.lit(1))).alias("skipped"),
        (F.coalesce(F.product(1 + F.coalesce("total_return", F.lit(0.0))), F.lit(1.0)) - 1).alias("compounded_oos_return"),
        inside.alias("avg_is_objective"),
        outside.alias("avg_oos_objective"),
        ((inside - outside) * sign).alias("degradation"),
        F.coalesce(F.count_if(F.col("total_return") > 0) / F.count(F.lit(1)), F.lit(0.0)).alias("consistency")
    )
