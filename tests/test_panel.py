"""Single operators on hand-made frames, and implementations against each other."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalar as C
from tidepanel.functions import udf
from tidepanel.operators import breadth, factor, filters, indicators, joins, levels, limits, recursive, trades, windows
from tidepanel.plans import strategies
from tidepanel.sources import io
from tidepanel.streaming import stream

D0 = date(2024, 1, 1)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"


def wave(symbol, n, skip=()):
    out = []
    for i in range(n):
        if i not in skip:
            c = 10 + 0.03 * i + 0.8 * math.sin(i / 4)
            out.append((symbol, D0 + timedelta(days=i), c - 0.1, c + 0.3 + 0.02 * (i % 3), c - 0.25, c, 1000.0 + 130 * (i % 7), c * 1000))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([*wave("600001.SH", 100), *wave("300002.SZ", 110, {43}), ("000003.SZ", D0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0)], BARS)


def pandas_of(df, symbol):
    return df.filter(F.col("symbol") == symbol).orderBy("date").toPandas().reset_index(drop=True)


def test_windows_wait_until_full_and_count_bars(bars):
    out = pandas_of(indicators.with_indicators(bars, {"ma60", "high_60d", "momentum_60d", "close"}), "300002.SZ")
    close = out["close"]
    assert out["ma60"][:59].isna().all() and np.allclose(out["ma60"][59:], close.rolling(60).mean()[59:])
    assert np.allclose(out["momentum_60d"][60:], (close / close.shift(60) - 1)[60:])


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_recursive_columns_equal_pandas(bars, monkeypatch, chunk):
    monkeypatch.setattr(recursive, "CHUNK", chunk)
    whole = recursive.with_recursive(bars)
    for symbol in ("600001.SH", "300002.SZ", "000003.SZ"):
        out = pandas_of(whole, symbol)
        close, high, low = out["close"], out["high"], out["low"]
        mean = lambda x, a: recursive.ewm(x, a)
        dif = mean(close, 2 / 13) - mean(close, 2 / 27)
        raw = 100 * (close - low.rolling(9).min()) / (high.rolling(9).max() - low.rolling(9).min()).replace(0, np.nan)
        k = mean(raw, 1 / 3)
        step = close.diff().fillna(0)
        gain, loss = mean(step.clip(lower=0), 1 / 14), mean(-step.clip(upper=0), 1 / 14)
        for name, want in {
            "ema10": mean(close, 2 / 11),
            "macd_dea": mean(dif, 0.2),
            "kdj_d": mean(k, 1 / 3),
            "rsi_14": 100 - 100 / (1 + gain / loss.where(loss != 0, 1e-12))
        }.items():
            np.testing.assert_allclose(out[name].astype(float), want.astype(float), rtol=1e-9, err_msg=f"{symbol} {name}")


def test_zero_range_keeps_the_state(spark):
    rows = [
        ("A", D0 + timedelta(days=i), 5.0, 5.0 + (i < 12), 5.0 - (i < 12), 5.0, 1.0, 5.0) for i in range(30)
    ] + [("A", D0 + timedelta(days=30), 5.0, 6.0, 5.0, 6.0, 1.0, 5.0)]
    out = pandas_of(recursive.with_recursive(spark.createDataFrame(rows, BARS), ["kdj_k"]), "A")
    assert out["kdj_k"][:8].isna().all() and out["kdj_k"][8:20].notna().all() and out["kdj_k"][20:30].isna().all() and out["kdj_k"][30] > 50


def test_needed_subset_equals_the_whole(bars):
    part, whole = indicators.with_indicators(bars, {"signal_ma_golden_5_20", "boll_upper"}), indicators.with_indicators(bars)
    assert set(part.columns) == {*bars.columns, "signal_ma_golden_5_20", "boll_upper"}
    assert sorted(map(str, part.select("symbol", "date", "boll_upper", "signal_ma_golden_5_20").collect())) == sorted(
        map(str, whole.select("symbol", "date", "boll_upper", "signal_ma_golden_5_20").collect())
    )


def test_one_bar_at_a_time_equals_batch(bars):
    out = pandas_of(recursive.with_recursive(bars), "600001.SH")
    state = recursive.fresh_states(1)
    for r in out.itertuples():
        row, state = recursive.lockstep(*(np.array([x], dtype=float) for x in (r.close, r.high, r.low)), np.array([0]), state)
        for k, v in row.items():
            want = getattr(r, k)
            assert (np.isnan(v[0]) and pd.isna(want)) or v[0] == want


def test_price_limits_are_integer_cents(spark):
    rows = [(18.90, 95), (10.0, 110), (9.995, 110), (0.05, 90)]
    got = [r[0] for r in spark.createDataFrame(rows, "p double, k int").select(limits.limit_price(F.col("p"), F.col("k"))).collect()]
    assert got == [17.96, 11.0, 10.99, 0.05]
    names = [("300001.SZ", "ST x"), ("600001.SH", "*ST y"), ("600002.SH", "z"), ("830001.BJ", "ST"), ("688001.SH", None)]
    assert [
        r[0] for r in spark.createDataFrame(names, "s string, n string").select(limits.limit_pct(F.col("s"), F.col("n"))).collect()
    ] == [0.2, 0.05, 0.1, 0.3, 0.2]


def test_streaks_reset_on_false_and_null(spark):
    flags = [None, True, True, False, True, None, True]
    df = spark.createDataFrame([("A", D0 + timedelta(days=i), f) for i, f in enumerate(flags)], "symbol string, date date, f boolean")
    assert [r["n"] for r in limits.with_streaks(df, {"f": "n"}).orderBy("date").collect()] == [0, 1, 2, 0, 1, 0, 1]


def test_adjustment_takes_the_latest_factor(spark):
    bars = spark.createDataFrame(
        [("A", D0 + timedelta(days=i), 8.0, 8.0, 8.0, 8.0, 1.0, 8.0) for i in range(4)] + [("B", D0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        BARS
    )
    events = spark.createDataFrame(
        [("A", D0 + timedelta(days=2), 2.0), ("A", D0 - timedelta(days=5), 4.0), ("A", D0 + timedelta(days=2), 2.0)],
        "symbol string, trade_date date, ex_factor double"
    )
    out = limits.adjust_prices(bars, events).orderBy("symbol", "date").collect()
    assert [r["close"] for r in out] == [4.0, 4.0, 8.0, 8.0, 1.0] and [r["ex_rights"] for r in out] == [False, False, True, False, False]


def test_filters_fail_closed(bars):
    assert filters.apply_scope(bars, "sector", ["600001.SH"]).count() == 0
    assert filters.match_conditions(bars, [{"field": "nope", "op": ">", "value": 1}]).count() == 0
    for bad in ("close > (select 1)", "1; drop table x"):
        with pytest.raises(ValueError):
            filters.screen_sql(bars, [bad])
    with pytest.raises(ValueError):
        filters.custom_signal([{"left": "close", "op": ">", "right": "secret"}], {"close"})
    with pytest.raises(ValueError):
        filters.custom_signal([{"left": "close", "op": ">", "right": 1, "left_lag": 61}], {"close"})


def test_watchlist_keeps_every_symbol_in_order(spark, bars):
    day = bars.filter(F.col("date") == F.lit(D0))
    watch = spark.createDataFrame([("X", 1), ("300002.SZ", 2), ("600001.SH", 3)], "symbol string, position int")
    out = joins.watchlist_panel(watch, day).collect()
    assert [r["symbol"] for r in out] == ["X", "300002.SZ", "600001.SH"] and out[0]["close"] is None and out[1]["close"] is not None


def test_external_join_never_multiplies_rows(spark, bars):
    ext = spark.createDataFrame(
        [("600001.SH", D0, "a"), ("600001.SH", D0 + timedelta(days=1), "b"), ("600001.SH", D0 + timedelta(days=1), "c")],
        "symbol string, date date, tag string"
    )
    out = joins.with_external_columns(bars, ext, "cfg", ["tag"])
    assert out.count() == bars.count() and {r[0] for r in out.filter("symbol = '600001.SH'").select("cfg__tag").distinct().collect()} == {"c"}


def test_range_join_equals_a_plain_one(bars):
    numbered = joins.numbered(bars)
    entries = numbered.filter("n % 7 = 3").select("symbol", F.col("n").alias("entry_n"))
    got = joins.entry_exit_range_join(entries, numbered.select("symbol", "n"), 5).count()
    plain = entries.join(numbered.select("symbol", "n"), "symbol").filter("n > entry_n AND n <= entry_n + 5").count()
    assert got == plain > 0


PANEL = (
    "symbol string, date date, open double, high double, low double, close double, volume double, entry boolean, exit boolean, "
    "score double, signal_limit_up boolean, signal_limit_down boolean"
)


def trade_case(spark, rows):
    """(open, high, low, close, volume, entry, exit, limit_down) of one symbol's days."""
    return trades.prepared(
        spark.createDataFrame(
            [("A", D0 + timedelta(days=i), o, h, low, c, v, e, x, 1.0, False, d) for i, (o, h, low, c, v, e, x, d) in enumerate(rows)],
            PANEL
        )
    )


def flat(c=10.0, entry=False, exit_=False, volume=100.0, down=False):
    return (c, c + 0.5, c - 0.2, c, volume, entry, exit_, down)


def labelled(panel, hold=5, **rules):
    return trades.label_trades(panel, D0, D0 + timedelta(days=99), hold, **{"stop": -0.1, **rules}).collect()


def test_gap_through_the_stop_sells_at_the_open(spark):
    (t,) = labelled(trade_case(spark, [flat(entry=True), flat(), (8.0, 8.5, 7.5, 8.2, 100.0, False, False, False), flat()]))
    assert (t["reason"], t["exit_price"], t["duration"]) == ("stop_loss", 8.0, 2)


def test_stop_comes_before_max_hold_on_the_same_bar(spark):
    (t,) = labelled(trade_case(spark, [flat(entry=True), (10.0, 10.2, 8.8, 9.5, 100.0, False, False, False), flat()]), hold=1)
    assert t["reason"] == "stop_loss" and abs(t["exit_price"] - 9.0) < 1e-9


def test_trailing_line_uses_the_peak_before_the_bar(spark):
    rows = [flat(entry=True), (10.0, 13.0, 9.9, 12.5, 100.0, False, False, False), (12.5, 12.6, 11.0, 11.5, 100.0, False, False, False), flat()]
    (t,) = labelled(trade_case(spark, rows), profit_trail=0.1, profit_start=0.2)
    assert t["reason"] == "trailing_take_profit" and abs(t["exit_price"] - 11.7) < 1e-9 and t["duration"] == 2


def test_blocked_exit_moves_to_the_first_bar_that_sells(spark):
    one = (9.0, 9.0, 9.0, 9.0, 100.0, False, False, True)
    (t,) = labelled(trade_case(spark, [flat(entry=True), (9.0, 9.0, 9.0, 9.0, 100.0, False, True, True), one, flat(9.5), flat()]), stop=-0.5)
    assert (t["reason"], t["exit_price"], t["blocked_days"]) == ("signal", 9.5, 2)


def test_entries_are_guarded(spark):
    panel = trade_case(spark, [(10.0, 10.0, 10.0, 10.0, 0.0, True, False, False), flat(entry=True), flat()])
    passed, refused = trades.entry_guards(trades.candidate_entries(panel, D0, D0 + timedelta(days=9)))
    assert passed.count() == 1 and refused.collect()[0].asDict() == {"reason": "suspended", "n": 1}


def test_sortino_and_costs(spark):
    assert abs(
        udf.sortino(pd.Series([-0.1, -0.1])) + math.sqrt(252)
    ) < 1e-9 and udf.sortino(pd.Series([0.1, 0.2])) is None and udf.sortino(pd.Series([0.1])) == 0
    assert udf.max_drawdown(pd.Series([1.0, 2.0, 1.0])) == -0.5
    t = spark.createDataFrame([(10.0, 11.0, 1, 3)], "entry_price double, exit_price double, entry_n int, exit_n int")
    assert abs(trades.trade_costs(t, 0.001, 0.0, 0.001).first()["pnl_pct"] - (11 * 0.998 / (10 * 1.001) - 1)) < 1e-12


def test_grids_and_folds():
    assert trades.grid_values({"min": 1, "max": 2, "step": 0.4}) == [1, 1.4, 1.8, 2]
    assert trades.grid_values([1, 1, 2]) == [1, 2] and trades.param_grid({"a": [1, 2], "b": {"values": [3]}}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    for bad, allowed in (({"a": [9]}, {"a": (0, 5)}), ({"z": [1]}, {"a": (0, 5)}), ({"a": list(range(60)), "b": list(range(60))}, None)):
        with pytest.raises(ValueError):
            trades.param_grid(bad, allowed)
    folds = trades.walkforward_folds(D0, D0 + timedelta(days=99), 50, 20, 20)
    assert [f[3] - f[2] for f in folds] == [timedelta(days=1)] * 2 and folds[-1][4] <= D0 + timedelta(days=99)


def test_bootstrap_needs_three_trades(spark):
    t = spark.createDataFrame([("A", D0, D0, 0.1), ("A", D0, D0, -2.0)], "symbol string, entry_date date, exit_date date, pnl_pct double")
    assert trades.bootstrap_drawdown(t).first()["mc_maxdd_p50"] is None
    more = t.unionByName(t)
    assert trades.bootstrap_drawdown(more, simulations=20).collect() == trades.bootstrap_drawdown(more, simulations=20).collect()


def test_buckets_and_scores(spark):
    df = spark.createDataFrame([(D0, f"S{i}", float(i)) for i in range(7)], "date date, symbol string, f double")
    assert [r["b"] for r in df.withColumn("b", factor.bucket_in_date("f", 3, ["date"])).orderBy("f").collect()] == [1, 1, 1, 2, 2, 3, 3]
    one = spark.createDataFrame([(D0, "A", 3.0), (D0, "B", 3.0)], "date date, symbol string, f double")
    assert {r[0] for r in one.select(strategies.minmax_score({"f": 1.0})).collect()} == {50.0}


def test_levels(spark, bars):
    chips = levels.chip_distribution(bars.withColumn("turnover_rate", F.lit(0.0)))
    total = chips.groupBy("symbol").agg(F.sum("chips").alias("s")).orderBy("symbol").collect()
    assert [r["symbol"] for r in total] == ["300002.SZ", "600001.SH"]
    want = bars.groupBy("symbol").agg(F.sum("volume").alias("v")).filter("symbol LIKE '6%'").first()["v"]
    assert abs(total[1]["s"] - want) < 1e-6
    reset = levels.chip_distribution(bars.withColumn("turnover_rate", F.when(F.col("date") == D0 + timedelta(days=90), 100.0).otherwise(0.0)))
    kept = bars.filter((F.col("symbol") == "600001.SH") & (F.col("date") >= D0 + timedelta(days=90))).agg(F.sum("volume")).first()[0]
    assert abs(reset.filter("symbol = '600001.SH'").agg(F.sum("chips")).first()[0] - kept) < 1e-6


def test_session_minutes(spark):
    at = lambda h, m: datetime(2024, 1, 3, h, m)
    rows = [(at(9, 0),), (at(9, 31),), (at(12, 0),), (at(13, 1),), (at(16, 0),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp")
    assert [r[0] for r in df.select(C.trading_minutes_elapsed(F.col("ts"))).collect()] == [0, 1, 120, 121, 240, 240]
    assert [r[0] for r in df.limit(5).select(C.session_phase(F.col("ts"))).collect()] == ["preopen", "morning", "lunch", "afternoon", "close"]


def test_schema_evolves(spark, tmp_path):
    path = str(tmp_path / "daily")
    spark.createDataFrame([("A", D0, 1.0)], "symbol string, date date, close double").write.partitionBy("date").parquet(path)
    spark.createDataFrame(
        [("A", D0 + timedelta(days=1), 2.0, 5, 7)],
        "symbol string, date date, close double, volume int, quote_ts long"
    ).write.mode("append").partitionBy("date").parquet(path)
    out = io.scan_daily(spark, path).orderBy("date").collect()
    assert [(r["volume"], r["quote_ts"]) for r in out] == [(None, None), (5.0, 7)] and io.scan_daily(spark, path).schema == io.DAILY


def test_full_rebuild_is_guarded(bars):
    with pytest.raises(ValueError):
        io.guard_full_rebuild(bars, bars.filter(F.col("date") > D0))


def test_names_and_breadth(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a(x)", "a", "(y)"])
    assert io.clean_column_names(df).columns == ["a", "a_2", "column"]
    day = spark.createDataFrame(
        [(D0, "A", 0.1, 1.0), (D0, "B", -0.1, 1.0), (D0, "C", None, 1.0), (D0, "D", 0.3, 1.0)],
        "date date, symbol string, change_pct double, amount double"
    )
    out = breadth.market_breadth(day).first()
    assert (out["up"], out["down"], out["total"], out["median_pct"]) == (2, 1, 4, 0.1)


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in windows.finite_or_null(df).collect()] == [None, None, 1.0, None]


def test_blocked_exit_waits_more_than_sixty_bars(spark):
    one = (8.1, 8.1, 8.1, 8.1, 100.0, False, False, True)
    (t,) = labelled(trade_case(spark, [flat(entry=True), (9.0, 9.0, 9.0, 9.0, 100.0, False, True, True), *[one] * 70, flat(9.5), flat()]), stop=-0.5)
    assert (t["exit_price"], t["exit_n"], t["blocked_days"]) == (9.5, 73, 71)


def test_exit_that_never_sells_keeps_its_bar(spark):
    (t,) = labelled(
        trade_case(spark, [flat(entry=True), (9.0, 9.0, 9.0, 9.0, 100.0, False, True, True), (8.1, 8.1, 8.1, 8.1, 100.0, False, False, True)]),
        stop=-0.5
    )
    assert (t["exit_price"], t["exit_n"], t["blocked_days"]) == (9.0, 2, 0)


def test_strategy_parameters_are_the_declared_ones_and_others_are_refused():
    from tidepanel.plans import strategies as K

    assert sum(len(s.params) for s in K.REGISTRY.values()) == 73 and all(
        set(s.entry) == {k for k, v in s.params.items() if isinstance(v, bool)} for s in K.REGISTRY.values()
    )
    s = K.REGISTRY["consecutive_limit_ups"]
    assert K.resolve_params(s, {"min_boards": 3}, {"use_boards_filter": False}) == {
        "require_limit_up": True,
        "use_boards_filter": False,
        "min_boards": 3
    }
    with pytest.raises(ValueError, match="streak_min"):
        K.resolve_params(s, explicit={"streak_min": 3})


def test_strategy_switches_and_asset_types(spark):
    from tidepanel.plans import strategies as K

    df = spark.createDataFrame(
        [("600001.SH", "A", "stock", 10.0, 11.0), ("510300.SH", "B", "etf", 10.0, 11.0), ("600002.SH", "C", "stock", 11.0, 10.0)],
        "symbol string, name string, type string, open double, close double"
    ).withColumns({"date": F.lit("2024-01-02").cast("date"), "low_60d": F.lit(12.0), "vol_ratio_5d": F.lit(1.0)})
    s, none = K.REGISTRY["n_day_low_reversal"], {}
    pick = lambda **more: sorted(
        r["symbol"] for r in df.withColumn("entry", K.entry_of(s, basic=none, **more)).filter("entry").collect()
    )
    assert pick() == []
    assert pick(params={"use_volume_filter": False}) == ["510300.SH", "600001.SH"]
    assert pick(params={"use_volume_filter": False, "require_bullish_candle": False}, asset_type="stock") == ["600001.SH", "600002.SH"]
    with pytest.raises(ValueError, match="not for etf"):
        K.entry_of(K.REGISTRY["strong_open"], asset_type="etf")


def test_near_limit_up_knows_the_limit_of_special_names(spark):
    from tidepanel.plans import strategies as K

    rows = [
        ("600001.SH", "A", 0.065),
        ("600002.SH", "*st B", 0.015),
        ("600003.SH", "ST C", 0.025),
        ("300001.SZ", "ST D", 0.16),
        ("600004.SH", None, 0.065)
    ]
    df = spark.createDataFrame(rows, "symbol string, name string, change_pct double").withColumn("type", F.lit("stock"))
    entry = K.entry_of(K.REGISTRY["near_limit_up"], {"min_change": 1.0}, {})
    assert sorted(
        r["symbol"] for r in df.withColumn("entry", entry).filter("entry").collect()
    ) == ["300001.SZ", "600001.SH", "600002.SH", "600004.SH"]


def test_listing_age_leaves_out_a_symbols_first_bars(spark):
    from tidepanel.operators.filters import basic_filter

    df = spark.range(10).select(
        F.lit("a").alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.lit(5.0).alias("close"),
        F.lit(1.0).alias("amount"),
        F.lit(1.0).alias("turnover_rate"),
        F.lit(1.0).alias("total_shares"),
        F.lit(1.0).alias("float_shares")
    )
    assert df.withColumn("fits", basic_filter({"exclude_new_days": 7})).filter("fits").count() == 3


def test_blocked_exit_waits_however_long(spark):
    from tidepanel.operators import trades as T

    bars = [("a", k, 0.0 if 3 <= k < 103 else 5.0, k == 1, k == 3) for k in range(1, 120)]
    panel = spark.createDataFrame(bars, "symbol string, n int, volume double, entry boolean, exit boolean").withColumns(
        {"date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")), "_tradable": F.col("volume") > 0, "_stuck_down": F.lit(False), "last_n": F.lit(119)}
    ).withColumns({c: F.col("n") * 1.0 for c in ("open", "high", "low", "close")})
    entries = panel.filter("entry").withColumn("entry_price", F.lit(1.0))
    out = T.defer_blocked(T.label_exits(entries, panel, 50)).first()
    assert (out["exit_n"], out["exit_price"], out["blocked_days"], out["reason"]) == (103, 103.0, 100, "signal")


def test_cooldown_carries_its_last_firing_from_batch_to_batch(spark):
    from tidepanel.streaming.stream import cooldown_batch

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    hits = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("rule"),
        F.lit("s").alias("symbol"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts")
    )
    try:
        spark.conf.set(name, 7)
        got = sorted((r["rule"], int(r["ts"].timestamp())) for r in cooldown_batch(hits, 600).collect())
    finally:
        spark.conf.set(name, before)
    want = []
    for rule in ("a", "b"):
        last = None
        for k in range(1000):
            if (k % 3 == 0) == (rule == "a") and (last is None or k * 60 - last >= 600):
                last = k * 60
                want.append((rule, last))
    assert got == sorted(want)


def test_ranks_by_amount_do_not_hang_on_the_order_of_sums(spark):
    from tidepanel.plans.catalog_indicators import settled

    rows = spark.createDataFrame([("b", D0, 0.1 + (0.2 + 0.3)), ("a", D0, (0.1 + 0.2) + 0.3 - 2**-52), ("c", D0, (0.1 + 0.2) + 0.3)], "symbol string, date date, amount double")
    got = settled(rows).select("symbol", filters.rank_of("amount").alias("pos"), factor.bucket_in_date("amount", 3, ["date"]).alias("bucket")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]


def test_nulls_rank_behind_all_values(spark):
    rows = spark.createDataFrame([("a", D0, None, None), ("b", D0, 1.0, 5.0), ("c", D0, 2.0, 5.0), (None, D0, 2.0, 4.0)], "symbol string, date date, amount double, volume double")
    ranks = filters.rank_of("amount"), factor.average_rank("volume", ["date"]), factor.bucket_in_date("amount", 4, ["date"])
    got = rows.select("symbol", *[c.alias(f"c{k}") for k, c in enumerate(ranks)]).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 4, 4.0, 4), ("b", 3, 2.5, 1), ("c", 1, 2.5, 2), (None, 2, 1.0, 3)]


def test_strategies_are_compiled_together(spark):
    """No condition stands in a higher-order function, where it would be interpreted row by row."""
    from tidepanel.plans import strategies as K

    row = spark.createDataFrame([("600001.SH", D0, "stock", 2.0, 1.0, 3.0), ("600001.SH", D0 + timedelta(days=1), "etf", 2.0, 1.0, 1.0)], "symbol string, date date, type string, close double, boll_upper double, vol_ratio_5d double")
    out = K.run_all(row, ["boll_breakout"], {})
    assert [tuple(r) for r in out.collect()] == [("600001.SH", D0, "boll_breakout")]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
