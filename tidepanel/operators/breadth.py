"""Market breadth, tiers, ranks and the dashboards made of them.

All work on one day's wide frame (one row a symbol) unless they say otherwise.
Shares and rounded figures use half-even rounding, as the dashboards show them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import join_symbol_or_code, labels_of
from .limits import classify_board
from .windows import by_date

# Lower bounds (shares) and labels of the return bands.
BANDS = ((None, "<-5%"), (-0.05, "-5~-3%"), (-0.03, "-3~-1%"), (-0.01, "-1~0%"), (0, "0~1%"), (0.01, "1~3%"), (0.03, "3~5%"), (0.05, ">5%"))


def count_if(c: Column) -> Column:
    return F.count_if(c)


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.bround(F.try_divide(a.cast("double"), b.cast("double")), digits)


def symbols_lagging(bars: DataFrame, cutoff: str) -> DataFrame:
    """Symbols whose last bar is before the cutoff."""
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date")).filter(F.col("last_date") < F.lit(cutoff).cast("date"))


def latest_two_quotes(bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """Last and previous close of each symbol, with the change."""
    rows = bars if as_of is None else bars.filter(F.col("date") <= F.lit(as_of).cast("date"))
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))
    pick = lambda k, c: F.max(F.when(F.col("_rn") == k, F.col(c)))
    out = rows.withColumn("_rn", rn).filter("_rn <= 2").groupBy("symbol").agg(
        pick(1, "date").alias("date"),
        pick(1, "close").alias("close"),
        pick(2, "close").alias("prev_close")
    )
    change = F.col("close") - F.col("prev_close")
    return out.withColumns({"change": change, "change_pct": F.try_divide(change, F.col("prev_close"))})


def upper_median_by_rank(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``keys, median``: the value at index floor(n / 2) of each group, by ranks, whatever a group's size."""
    w = Window.partitionBy(*keys)
    rows = df.filter(F.col(column).isNotNull()).select(
        *keys,
        F.col(column),
        F.row_number().over(w.orderBy(column)).alias("_rn"),
        F.count(F.lit(1)).over(w).alias("_n")
    )
    return rows.filter(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(column).alias("median"))


def market_breadth(df: DataFrame) -> DataFrame:
    """Per date: totals, ups and downs, shares, mean and upper-median change, strong moves, amounts."""
    p, n = F.col("change_pct"), F.count(F.lit(1))
    out = df.groupBy("date").agg(
        n.alias("total"),
        count_if(p > 0).alias("up"),
        count_if(p < 0).alias("down"),
        count_if(p == 0).alias("flat"),
        ratio(count_if(p > 0), n).alias("up_share"),
        F.avg(p).alias("avg_pct"),
        count_if(p >= 0.03).alias("strong_up"),
        count_if(p <= -0.03).alias("strong_down"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
    )
    return out.join(upper_median_by_rank(df, "change_pct", ["date"]).withColumnRenamed("median", "median_pct"), "date", "left")


def board_breakdown(df: DataFrame) -> DataFrame:
    p, n = F.col("change_pct"), F.count(F.lit(1))
    return df.groupBy(classify_board(F.col("symbol")).alias("board")).agg(
        n.alias("n"),
        count_if(p > 0).alias("up"),
        count_if(p < 0).alias("down"),
        F.sum("amount").alias("amount"),
        ratio(count_if(p > 0), n).alias("up_share")
    )


def limit_stats(df: DataFrame) -> DataFrame:
    """Per date: limit-ups, broken ones, limit-downs, longest streak, seal rate."""
    up, broken = count_if(F.col("signal_limit_up")), count_if(F.col("signal_broken_limit_up"))
    return df.groupBy("date").agg(
        up.alias("limit_up"),
        broken.alias("broken"),
        count_if(F.col("signal_limit_down")).alias("limit_down"),
        F.max("consecutive_limit_ups").alias("max_streak"),
        ratio(up, up + broken).alias("seal_rate")
    )


def limit_tiers(df: DataFrame, k: int = 5) -> DataFrame:
    """Per streak length: how many symbols, and the ``k`` with the largest amounts."""
    hits = df.filter("consecutive_limit_ups >= 1")
    w = Window.partitionBy("consecutive_limit_ups").orderBy(F.col("amount").desc(), "symbol")
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    named = top.groupBy("consecutive_limit_ups").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("symbols")
    )
    return hits.groupBy("consecutive_limit_ups").agg(F.count(F.lit(1)).alias("n")).join(named, "consecutive_limit_ups")


def trend_counts(df: DataFrame) -> DataFrame:
    """Per date: the shares of all rows that are at or above moving averages, and new highs and lows."""
    above = lambda m: ratio(count_if(F.col("close") >= F.col(m)), F.count(F.lit(1))).alias(f"above_{m}")
    return df.groupBy("date").agg(
        *[above(f"ma{k}") for k in (5, 20, 60)],
        count_if(F.col("signal_n_day_high")).alias("new_highs"),
        count_if(F.col("signal_n_day_low")).alias("new_lows")
    )


def activity_stats(df: DataFrame) -> DataFrame:
    """Per date: mean turnover (0 if none is known) and volume ratio (1 if none), and of all rows the share with a ratio of 1.5 or more."""
    t, v = F.col("turnover_rate"), F.col("vol_ratio_5d")
    return df.groupBy("date").agg(
        F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_turnover"),
        count_if(t >= 5).alias("high_turnover"),
        F.coalesce(F.avg(v), F.lit(1.0)).alias("avg_vol_ratio"),
        ratio(count_if(v >= 1.5), F.count(F.lit(1))).alias("active_share")
    )


def band_of(change: Column) -> Column:
    out = F.when(change.isNotNull(), F.lit(0))
    for k, (low, _) in enumerate(BANDS):
        out = out if low is None else F.when(change >= low, k).otherwise(out)
    return out


def pct_bands(df: DataFrame) -> DataFrame:
    """Counts and shares of the eight half-open return bands, empty ones included."""
    table = df.sparkSession.createDataFrame([(k, name) for k, (_, name) in enumerate(BANDS)], "band int, label string")
    counts = df.withColumn("band", band_of(F.col("change_pct"))).filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())
    return table.join(counts, "band", "left").select(
        "band",
        "label",
        F.coalesce("n", F.lit(0)).alias("n"),
        ratio(F.coalesce("n", F.lit(0)), total).alias("share")
    )


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scored(value: Column, low: float, high: float) -> Column:
    """0 to 100 between two bounds, as a whole number, half to even; figures count to nine digits."""
    return clamp(F.bround(F.round((value - low) / (high - low) * 100, 9), 0))


def mixed(*parts: tuple[Column, float]) -> Column:
    """The weighted sum of scores as a whole number, half to even."""
    return F.bround(F.round(reduce(lambda a, b: a + b, [c * w for c, w in parts]), 9), 0)


def emotion_radar(day: DataFrame) -> DataFrame:
    """``day`` with six scores from 0 to 100 of each date's figures, their mean and its label."""
    f = lambda name, none=0.0: F.coalesce(F.col(name).cast("double"), F.lit(none))
    of_all = lambda c: F.when(f("total") > 0, c / f("total") * 100).otherwise(0.0)
    # Bounds and weights of the scores.
    profit = mixed(
        (scored(f("up_pct"), 20, 80), 0.45),
        (scored(f("avg_pct"), -0.02, 0.02), 0.25),
        (scored(f("median_pct"), -0.02, 0.02), 0.20),
        (scored(of_all(f("strong_up") - f("strong_down")), -8, 8), 0.10)
    )
    hot = mixed(
        (scored(f("limit_up"), 5, 90), 0.25),
        (scored(f("seal_rate"), 30, 85), 0.35),
        (scored(f("max_boards"), 1, 8), 0.25),
        (scored(f("tier2"), 0, 30), 0.15)
    )
    mainline = mixed((scored(f("mainline_avg"), -0.005, 0.03), 0.65), (scored(f("mainline_cover_pct"), 1, 12), 0.35))
    scores = {
        "radar_index": scored(f("avg_index_pct"), -2.5, 2.5),
        "radar_profit": profit,
        "radar_money": mixed((scored(f("vol_ratio", 1.0), 0.6, 1.8), 0.70), (scored(f("high_vol_pct"), 2, 12), 0.30)),
        "radar_speculation": hot,
        "radar_resilience": 100 - mixed((scored(f("down_pct"), 20, 80), 0.55), (scored(of_all(f("strong_down")), 1, 12), 0.45)),
        "radar_mainline": F.when(F.col("mainline_avg").isNull(), 50.0).otherwise(mainline),
    }
    out = day.withColumns(scores)
    out = out.withColumn("emotion", F.bround(F.round(reduce(lambda a, b: a + b, [F.col(k) for k in scores]) / len(scores), 9), 0))
    e = F.col("emotion")
    return out.withColumn("mood", F.when(e >= 70, "strong").when(e >= 55, "warm").when(e >= 45, "swinging").when(e >= 30, "cool").otherwise("frozen"))


def industry_level(text: Column, level: int) -> Column:
    """Level ``level`` (from 1) of ``a-b-c``, else the last one."""
    parts = F.split(text, "-")
    return F.coalesce(F.try_element_at(parts, F.lit(level)), F.element_at(parts, -1))


def dimension_rank(day: DataFrame, dimension: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Per label: symbols, mean change, ups and downs, amount, leader; ranks from both ends, the first ``k`` of each."""
    rows = join_symbol_or_code(day, dimension, "symbol", [column]).withColumn("label", F.explode(labels_of(F.col(column))))
    p = F.col("change_pct")
    out = rows.filter(p.isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("avg_pct"),
        count_if(p > 0).alias("up"),
        count_if(p < 0).alias("down"),
        F.sum("amount").alias("amount"),
        F.max_by("symbol", F.struct(p, F.col("symbol"))).alias("leader")
    )
    top, low = F.row_number().over(Window.orderBy(F.col("avg_pct").desc(), "label")), F.row_number().over(Window.orderBy("avg_pct", "label"))
    return out.withColumns({"rank_top": top, "rank_low": low}).filter((F.col("rank_top") <= k) | (F.col("rank_low") <= k))


def top_rows(df: DataFrame, key: str, desc: bool = True, k: int = 8) -> DataFrame:
    """The ``k`` rows with the largest (least) key, nulls left out."""
    c = F.col(key)
    return df.filter(c.isNotNull()).orderBy(c.desc() if desc else c.asc(), "symbol").limit(k)


def top_k_per_group(df: DataFrame, group: list[str], key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(key).desc(), "symbol")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tail_state(bars: DataFrame) -> DataFrame:
    """Per symbol what an incremental update needs: sums over the last closes, extremes, closes some bars ago, volume sums."""
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))
    last = bars.withColumn("_rn", rn).filter("_rn <= 60")
    within = lambda n, c: F.when(F.col("_rn") <= n, F.col(c))
    aggs = [F.sum(within(n, "close")).alias(f"sum_close_{n}") for n in (4, 9, 19, 29, 59)]
    aggs += [
        F.sum(F.pow(within(19, "close"), 2)).alias("sum_sq_19"),
        F.max(within(59, "close")).alias("max_close_59"),
        F.min(within(59, "close")).alias("min_close_59")
    ]
    aggs += [F.max(F.when(F.col("_rn") == n, F.col("close"))).alias(f"close_{n}_ago") for n in (1, 5, 10, 20, 30, 60)]
    aggs += [F.sum(within(n, "volume")).alias(f"sum_volume_{n}") for n in (4, 5, 9)]
    aggs += [F.max(within(8, "high")).alias("max_high_8"), F.min(within(8, "low")).alias("min_low_8")]
    return last.groupBy("symbol").agg(*aggs)


def minute_vwap(minutes: DataFrame) -> DataFrame:
    """Amount over volume of each symbol and day, else the last close."""
    out = minutes.groupBy("symbol", F.to_date("datetime").alias("date")).agg(
        F.sum("amount").alias("a"),
        F.sum("volume").alias("v"),
        F.max_by("close", "datetime").alias("last_close")
    )
    return out.select("symbol", "date", F.coalesce(F.try_divide(F.col("a"), F.col("v").cast("double")), F.col("last_close")).alias("vwap"))


def minute_completeness(minutes: DataFrame, expected: int = 240, share: float = 0.9) -> DataFrame:
    out = minutes.groupBy("symbol", F.to_date("datetime").alias("date")).agg(F.count(F.lit(1)).alias("bars"))
    return out.withColumns({"share": F.col("bars") / F.lit(float(expected)), "complete": F.col("bars") >= expected * share})


def latest_periods(statements: DataFrame, n: int) -> DataFrame:
    """The last ``n`` statement periods of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("period_end").desc())
    return statements.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and symbols of each table."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.countDistinct("symbol").alias("symbols")
        ).select(F.lit(name).alias("name"), "rows", "symbols") for name,
        df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def selection_summary(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (strategy, symbol) hits: symbols per strategy, and strategies per symbol."""
    per_strategy = hits.groupBy("strategy").agg(F.countDistinct("symbol").alias("n_symbols"))
    return per_strategy, hits.groupBy("symbol").agg(
        F.countDistinct("strategy").alias("n_strategies"),
        F.sort_array(F.collect_set("strategy")).alias("strategies")
    )


def analysis_template(
    df: DataFrame,
    group: list[str],
    measures: list[tuple[str, str, str]],
    order: tuple[str, bool] | None = None,
    limit: int | None = None
) -> DataFrame:
    """Group columns, measures ``(name, function, column)``, sort and limit, all from configuration."""
    kinds = {"count": lambda c: F.count(F.lit(1)), "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    out = df.groupBy(*group).agg(*[kinds[f](c).alias(name) for name, f, c in measures])
    if order:
        out = out.orderBy(F.col(order[0]).desc() if order[1] else F.col(order[0]), *group)
    return out.limit(limit) if limit else out


def group_numeric_means(df: DataFrame, key: str) -> DataFrame:
    """The mean of every numeric column per key."""
    numeric = [c for c, t in df.dtypes if c != key and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in numeric])


def quote_metrics(df: DataFrame, key: str) -> DataFrame:
    p = F.col("change_pct")
    return df.groupBy(key).agg(F.avg(p).alias("avg_pct"), count_if(p > 0).alias("up"), count_if(p < 0).alias("down"), count_if(p == 0).alias("flat"))


def bars_from_ticks(
    ticks: DataFrame,
    symbol: str = "symbol",
    ts: str = "ts",
    value: str = "value",
    order: str = "event_id",
    width: str = "1 day"
) -> DataFrame:
    """OHLCV bars of event rows."""
    seq = F.struct(ts, order)
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.window(F.col(ts).cast("timestamp"), width)["start"].alias("start")).agg(
        F.min_by(value, seq).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, seq).alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum(value).alias("amount")
    )


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("symbol").alias("symbols"),
        F.countDistinct("date").alias("dates")
    )


def status_order(df: DataFrame, boards: str = "boards", status: str = "status") -> DataFrame:
    """Most boards first, then main, broken, failed."""
    return df.orderBy(F.col(boards).desc(), F.when(F.col(status) == "main", 0).when(F.col(status) == "broken", 1).otherwise(2), "symbol")


def limit_ladder(df: DataFrame, direction: str = "up", depth: DataFrame | None = None) -> DataFrame:
    """Symbols on the ladder of a day: at the limit, fallen from it, or failed after a limit the bar before.

    ``direction`` is ``up`` or ``down``; ``df`` has ``prev_streak``, that direction's
    streak at the bar before. ``depth`` (:func:`~tidepanel.operators.joins.depth_seals`)
    adds what the order book says of the seal.
    """
    up = direction == "up"
    hit = F.coalesce(f"signal_limit_{direction}", F.lit(False))
    left = F.coalesce("signal_broken_limit_up" if up else "signal_limit_down_recovery", F.lit(False))
    streak = F.col(f"consecutive_limit_{direction}s")
    status = F.when(hit, "main").when(left, "broken").when(F.col("prev_streak") >= 1, "failed")
    boards = F.when(hit, streak).otherwise(F.coalesce("prev_streak", F.lit(0)) + 1)
    out = df.withColumns({"status": status, "boards": boards.cast("int")}).filter("status IS NOT NULL")
    if depth is None:
        return out
    seals = depth.select("symbol", F.col(f"sealed_{direction}").alias("_sealed"), F.col("bid1_vol" if up else "ask1_vol").alias("seal_volume"))
    seal = F.when(F.col("status") != "main", None).when(F.col("_sealed").isNull(), "pending").when(F.col("_sealed"), "real").otherwise("fake")
    return out.join(seals, "symbol", "left").withColumn("seal_status", seal).drop("_sealed")


def ladder_tiers(ladder: DataFrame) -> DataFrame:
    """Per date and number of boards: how many stand, fell, failed, and how the standing ones are sealed."""
    status, seal = F.col("status"), F.col("seal_status")
    parts = {k: count_if(status == k) for k in ("main", "broken", "failed")} | {k: count_if(seal == k) for k in ("real", "fake", "pending")}
    return ladder.groupBy("date", "boards").agg(*[v.alias(k) for k, v in parts.items()])


def market_snapshot(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol",
        "date",
        "close",
        "change_pct",
        "amount",
        (F.col("close") * F.col("total_shares")).alias("market_cap"),
        (F.col("close") * F.col("float_shares")).alias("float_cap")
    )


def market_overview(df: DataFrame) -> DataFrame:
    """Every date's breadth, amounts, limits, bands, trend, activity, radar and mood in one row.

    ``df`` has a row a symbol and date, its ``type`` (``index`` rows count for the index
    score alone) and ``concepts`` (array) and ``industry`` of the symbol. Everything but
    the labels is summed over the rows as they are; for the labels, of which count and
    mean alone are asked, (date, change) pairs are multiplied and summed.
    """
    p, n, c = F.col("change_pct"), F.count(F.lit(1)), F.col
    live = (F.coalesce("volume", F.lit(0)) > 0) | (F.coalesce(p, F.lit(0.0)) != 0)
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("label"))
    labels = F.concat(
        F.when(c("industry").isNotNull(), F.array(key("industry", c("industry")))).otherwise(F.array()),
        F.transform(F.coalesce("concepts", F.array().cast("array<string>")), lambda x: key("concept", x)),
    )
    is_index = F.coalesce(c("type") == "index", F.lit(False))
    keys = F.when(is_index, F.array(key("index", F.lit("")))).when(live, labels)
    up, broken = count_if(F.coalesce("signal_limit_up", F.lit(False)) | (c("consecutive_limit_ups") > 0)), count_if(c("signal_broken_limit_up"))
    percent = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b.cast("double")), F.lit(0.0))
    above = {f"above_ma{k}": count_if(c("close") >= c(f"ma{k}")) for k in (5, 20, 60)}
    market = df.filter(~is_index & live).groupBy("date").agg(
        n.alias("total"),
        count_if(p > 0).alias("up"),
        count_if(p < 0).alias("down"),
        F.avg(p).alias("avg_pct"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY change_pct DESC)").alias("median_pct"),
        count_if(p >= 0.03).alias("strong_up"),
        count_if(p <= -0.03).alias("strong_down"),
        F.sum("amount").alias("total_amount"),
        (F.sum("amount") / n).alias("avg_amount"),
        up.alias("limit_up"),
        broken.alias("broken"),
        count_if(c("signal_limit_down")).alias("limit_down"),
        F.max(F.coalesce("consecutive_limit_ups", F.lit(0))).alias("max_boards"),
        count_if(c("consecutive_limit_ups") >= 2).alias("tier2"),
        percent(up, up + broken).alias("seal_rate"),
        *[v.alias(k) for k, v in above.items()],
        *[percent(v, n).alias(f"{k}_pct") for k, v in above.items()],
        count_if(F.coalesce("signal_n_day_high", F.lit(False))).alias("new_high"),
        count_if(F.coalesce("signal_n_day_low", F.lit(False))).alias("new_low"),
        F.avg("turnover_rate").alias("avg_turnover"),
        count_if(c("turnover_rate") >= 5).alias("high_turnover"),
        F.coalesce(F.avg("vol_ratio_5d"), F.lit(1.0)).alias("vol_ratio"),
        percent(count_if(c("vol_ratio_5d") >= 1.5), n).alias("high_vol_pct"),
        *[count_if(band_of(p) == k).alias(f"band{k}") for k in range(len(BANDS))],
    )
    labelled = df.select("date", "change_pct", F.explode(keys).alias("_key")).groupBy("date", "_key.kind", "_key.label").agg(n.alias("n"), F.avg(p).alias("avg"))
    order = F.row_number().over(Window.partitionBy("date", "kind").orderBy(F.round("avg", 9).desc_nulls_last(), "label"))
    leading = c("kind").isin("concept", "industry") & c("avg").isNotNull() & (c("_order") <= 3)
    found = labelled.withColumn("_order", order).groupBy("date").agg(
        F.max(F.when(leading, c("avg"))).alias("mainline_avg"),
        F.max(F.when(leading, c("n"))).alias("mainline_n"),
        F.max(F.when(c("kind") == "index", c("avg"))).alias("_index")
    )
    market = market.join(found, "date", "left").withColumn("avg_index_pct", F.coalesce(c("_index") * 100, F.lit(0.0))).drop("_index")
    market = market.withColumns(
        {
            "flat": c("total") - c("up") - c("down"),
            "up_pct": percent(c("up"), c("total")),
            "down_pct": percent(c("down"), c("total")),
            "mainline_cover_pct": percent(c("mainline_n"), c("total"))
        }
    )
    return emotion_radar(market.drop("mainline_n"))


def overview_lists(day: DataFrame, labels: DataFrame) -> DataFrame:
    """The ranked blocks of one day as ``block, rank, name, n, value``: boards, tiers, top rows, leading and lagging labels.

    ``labels``: ``kind, symbol, label``, each once.
    """
    shape = ["block", "rank", "name", "n", "value"]
    order = lambda *by: F.row_number().over(Window.partitionBy("block").orderBy(*by))
    boards = day.groupBy(
        F.lit("boards").alias("block"),
        classify_board(F.col("symbol")).alias("name")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value")).withColumn("rank", order(F.col("value").desc_nulls_last(), "name"))
    tiers = day.filter("consecutive_limit_ups > 0").groupBy(
        F.lit("tiers").alias("block"),
        F.col("consecutive_limit_ups").cast("string").alias("name")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value")).withColumn("rank", order(F.col("name").cast("int").desc()))
    kinds = {
        "top_gainers": ("change_pct", True),
        "top_losers": ("change_pct", False),
        "turnover_leaders": ("amount", True),
        "active_leaders": ("turnover_rate", True)
    }
    listed = [
        top_rows(day, key, desc).select(
            F.lit(k).alias("block"),
            F.col("symbol").alias("name"),
            F.lit(1).cast("bigint").alias("n"),
            F.col(key).alias("value"),
            F.lit(1 if desc else -1).alias("_way")
        ) for k,
        (key, desc) in kinds.items()
    ]
    tops = reduce(lambda a, b: a.unionByName(b), listed).withColumn("rank", order((F.col("value") * F.col("_way")).desc(), "name"))
    means = day.filter("change_pct IS NOT NULL").join(labels, "symbol").groupBy("kind", F.col("label").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("change_pct").alias("value")
    )
    ends = means.withColumn("_way", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn(
        "block",
        F.concat("kind", F.when(F.col("_way") > 0, "_leading").otherwise("_lagging"))
    )
    ends = ends.withColumn("rank", order(F.round(F.col("value") * F.col("_way"), 9).desc(), "name")).filter("rank <= 5")
    return reduce(lambda a, b: a.unionByName(b), [x.select(*shape) for x in (boards, tiers, tops, ends)])


def recap_blocks(overview: DataFrame) -> DataFrame:
    """The numbers of the daily recap."""
    return overview.select(
        "date",
        "total",
        "up",
        "down",
        "up_pct",
        "avg_pct",
        "total_amount",
        "limit_up",
        "broken",
        "limit_down",
        "max_boards",
        "seal_rate",
        "emotion",
        "mood"
    )
