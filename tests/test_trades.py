"""The backtest core against a walk over bars, one position at a time."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import trades as T

D0 = date(2024, 1, 1)
PANEL = "symbol string, date date, open double, high double, low double, close double, volume double, entry boolean, exit boolean, score double, strong boolean, signal_limit_up boolean, signal_limit_down boolean"
COSTS = (0.0003, 0.0005, 0.0005)


def bars_of(seed, symbols=3, days=60):
    rng, rows = random.Random(seed), []
    for k in range(symbols):
        close = 10.0
        for day in range(days):
            open_ = close * rng.choice([1, 1, 1, 0.9, 1.1, rng.uniform(0.95, 1.05)])
            close = round(open_ * rng.uniform(0.9, 1.1), 2)
            high, low = max(open_, close) * rng.uniform(1, 1.06), min(open_, close) * rng.uniform(0.94, 1)
            down = rng.random() < 0.15
            if down:
                open_ = high = low = close
            volume = 0.0 if down and rng.random() < 0.4 else 100.0
            rows.append((f"S{k}", D0 + timedelta(days=day), open_, high, low, close, volume, rng.random() < 0.2, rng.random() < 0.05, 1.0, rng.random() < 0.5, False, down))
    return rows


def walk(rows, hold, stop, take, trail, start, drop, fill, exit_fill, keep=lambda r: True):
    """(symbol, entry date, reason, exit price, exit date, blocked days) of every trade."""
    out = set()
    for symbol in sorted({r[0] for r in rows}):
        own = [dict(zip([c.split()[0] for c in PANEL.split(", ")], r)) for r in rows if r[0] == symbol]
        for b in own:
            flat = b["high"] - b["low"] <= max(b["close"] * 1e-4, 0.01)
            b["trades"] = not (b["volume"] == 0 and flat)
            b["sells"] = b["trades"] and not (flat and b["signal_limit_down"])
        for k, b in enumerate(own):
            signal = k - 1 if fill == "next_open" else k
            if signal < 0 or not own[signal]["entry"] or not keep(own[signal]) or not b["trades"]:
                continue
            price = b["open"] if fill == "next_open" else b["close"]
            peak = max(price, b["high"])
            for n in range(k + 1, len(own)):
                x = own[n]
                order = x["open"] if exit_fill == "next_open" else x["close"]
                leaves = own[n - 1]["exit"] if exit_fill == "next_open" else x["exit"]
                lines = [(price * (1 - stop), "stop_loss")] if stop is not None else []
                lines += [(peak * (1 - trail), "trailing_stop")] if trail is not None else []
                if start is not None and peak > price and peak / price - 1 >= start:
                    lines.append((peak * (1 - drop), "trailing_take_profit"))
                line, reason = max(lines, key=lambda i: i[0]) if lines else (-1.0, None)
                goal = math.inf if take is None else price * (1 + take)
                if x["low"] <= line:
                    got = (reason, min(x["open"], line))
                elif x["high"] >= goal:
                    got = ("take_profit", max(x["open"], goal))
                elif leaves or n - k >= hold or n == len(own) - 1:
                    got = ("signal" if leaves else "max_hold" if n - k >= hold else "end", order)
                else:
                    peak = max(peak, x["high"])
                    continue
                at = n
                if not x["sells"] and (later := next((m for m in range(n + 1, len(own)) if own[m]["sells"]), None)):
                    at, got = later, (got[0], own[later]["open" if exit_fill == "next_open" else "close"])
                out.add((symbol, b["date"], got[0], round(got[1], 9), own[at]["date"], at - n))
                break
    return out


def plain(df):
    return {(r["symbol"], r["entry_date"], r["reason"], round(r["exit_price"], 9), r["exit_date"], r["blocked_days"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return bars_of(1)


@pytest.fixture(scope="module")
def panel(spark, rows):
    return T.prepared(spark.createDataFrame(rows, PANEL)).cache()


END = D0 + timedelta(days=99)


@pytest.mark.parametrize("fill", ["close", "next_open"])
@pytest.mark.parametrize("exit_fill", ["close", "next_open"])
def test_all_lines_at_once_equal_the_walk(panel, rows, fill, exit_fill):
    rules = {"take": 0.15, "trail": 0.12, "profit_start": 0.05, "profit_trail": 0.04}
    got = plain(T.label_trades(panel, D0, END, 6, 0.08, fill, exit_fill=exit_fill, **rules))
    assert got == walk(rows, 6, 0.08, 0.15, 0.12, 0.05, 0.04, fill, exit_fill)
    assert {"stop_loss", "trailing_stop", "trailing_take_profit"} <= {t[2] for t in got}


def test_every_trial_equals_its_own_labelling(panel, rows):
    rng, trials = random.Random(3), []
    for _ in range(40):
        some = lambda *xs: rng.choice([None, *xs])
        trials.append({"hold": rng.choice([1, 3, 7, 20]), "stop": some(0.03, -0.08, 0.2), "take": some(0.02, 0.1), "trail": some(0.05, 0.15), "profit_start": some(0.0, 0.04, 0.1), "profit_trail": some(0.02, 0.06), "variant": rng.randrange(2)})
    variants = [F.col("entry"), F.col("entry") & F.col("strong")]
    for fill, exit_fill in (("close", "next_open"), ("next_open", "close")):
        swept = T.sweep(panel, trials, D0, END, fill, exit_fill=exit_fill, variants=variants).collect()
        for k, t in enumerate(trials):
            got = {(r["symbol"], r["entry_date"], r["reason"], round(r["exit_price"], 9), r["exit_date"], r["blocked_days"]) for r in swept if r["trial_id"] == k}
            both = t["profit_start"] is not None and t["profit_trail"] is not None
            stop = None if t["stop"] is None else abs(t["stop"])
            keep = (lambda b: b["strong"]) if t["variant"] else (lambda b: True)
            assert got == walk(rows, t["hold"], stop, t["take"], t["trail"], t["profit_start"] if both else None, t["profit_trail"], fill, exit_fill, keep), t
    one = T.sweep(panel, trials[:1] and [{"hold": 6, "stop": 0.08}], D0, END)
    assert sorted(map(str, one.drop("trial_id").select("symbol", "entry_n", "reason", "exit_price", "pnl_pct").collect())) == sorted(map(str, T.label_trades(panel, D0, END, 6, 0.08).select("symbol", "entry_n", "reason", "exit_price", "pnl_pct").collect()))


def test_a_sweep_keeps_few_bars(panel):
    """Between the join and the trials a row an entry is left, with no more events than the grid has values."""
    trials = [{"hold": h, "stop": s} for h in (5, 50) for s in (0.02, 0.05, 0.1)]
    _, values = T.trial_frame(panel.sparkSession, trials)
    entries, _ = T.entry_guards(T.candidate_entries(panel, D0, END))
    events = T._events(T._held_bars(entries, panel, 50, "close"), values)
    assert events.count() == events.select("symbol", "entry_n").distinct().count()
    assert events.agg(F.max(F.size("events"))).first()[0] <= 2 + 3 + 2
    with pytest.raises(ValueError):
        T.sweep(panel, [], D0, END)


TRADES = "trial_id int, symbol string, entry_date date, exit_date date, pnl_pct double, duration int"


def test_curve_has_every_date(spark):
    day = lambda k: D0 + timedelta(days=k)
    made = spark.createDataFrame([(1, "a", day(0), day(2), 0.1, 2), (1, "b", day(0), day(2), 0.3, 2), (1, "a", day(3), day(5), -0.5, 2), (2, "a", day(0), day(6), 0.5, 2)], TRADES)
    dates = spark.createDataFrame([(day(k),) for k in range(7)], "date date")
    curve = {(r["trial_id"], r["date"]): (r["ret"], r["n"], r["equity"]) for r in T.slot_portfolio(made, dates, ("trial_id",)).collect()}
    assert len(curve) == 14
    for key, (ret, n, equity) in {(1, day(1)): (0, 0, 1.0), (1, day(2)): (0.2, 2, 1.2), (1, day(4)): (0, 0, 1.2), (1, day(6)): (0, 0, 0.6), (2, day(5)): (0, 0, 1.0), (2, day(6)): (0.5, 1, 1.5)}.items():
        assert curve[key][1] == n and np.allclose([curve[key][0], curve[key][2]], [ret, equity])
    got = T.curve_stats(T.slot_portfolio(made.filter("trial_id = 1"), dates)).first()
    r = np.array([0, 0, 0.2, 0, 0, -0.5, 0])
    assert np.isclose(got["sharpe"], r.mean() / r.std() * math.sqrt(252)) and np.isclose(got["sortino"], r.mean() / math.sqrt((np.minimum(r, 0) ** 2).mean()) * math.sqrt(252))
    assert np.isclose(got["max_drawdown"], -0.5) and np.isclose(got["total_return"], -0.4)
    own = dates.select(F.lit(1).alias("trial_id"), "date").unionByName(dates.filter("date >= '2024-01-05'").select(F.lit(2).alias("trial_id"), "date"))
    assert T.slot_portfolio(made, own, ("trial_id",)).filter("trial_id = 2").count() == 3


def test_figures_of_trades(spark):
    made = spark.createDataFrame([(1, "a", D0, D0, r, d) for r, d in ((0.2, 1), (0.4, 3), (0.0, 5), (-0.1, 7))] + [(2, "a", D0, D0, 0.1, 1)], TRADES)
    got = {r["trial_id"]: r for r in T.trade_stats(made, ("trial_id",)).collect()}
    assert np.isclose(got[1]["profit_factor"], 0.3 / 0.05) and np.isclose(got[1]["avg_loss"], 0.05) and got[1]["avg_holding_days"] == 4
    assert got[2]["profit_factor"] is None and got[2]["avg_loss"] == 0


def test_bootstrap_of_every_key_in_one_pass(spark):
    rng = np.random.default_rng(5)
    made = {k: rng.normal(0, 0.1, n) for k, n in ((1, 50), (2, 3), (3, 2), (None, 400))}
    rows = [(k, f"s{i:04}", D0, D0, float(x), 1) for k, xs in made.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, TRADES)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 7)
        got = {r["trial_id"]: (r["mc_maxdd_p50"], r["mc_maxdd_p95"]) for r in T.bootstrap_drawdown(df, ("trial_id",), 100).collect()}
    finally:
        spark.conf.set(name, before)
    for k, xs in made.items():
        if len(xs) < 3:
            assert got[k] == (None, None)
            continue
        worst = []
        for sim in range(1, 101):
            equity = np.cumprod(1 + np.maximum(xs, -0.9999)[T.draws(len(xs), sim)])
            worst.append((equity / np.maximum.accumulate(equity) - 1).min())
        assert np.allclose(got[k], [np.percentile(worst, 50), np.percentile(worst, 5)])
        assert got[k][1] <= got[k][0] <= 0
    share = np.bincount(np.concatenate([T.draws(50, k) for k in range(1, 1001)]), minlength=50) / 50_000
    assert share.min() > 0.018 and share.max() < 0.022


def test_objectives_and_their_directions(spark):
    made = spark.createDataFrame([(t, f"s{k}", D0, D0 + timedelta(days=k + 1), 0.01 * (t + 1) * (-1 if k == 2 else 1), 5 - t) for t in range(3) for k in range(4)], TRADES)
    dates = spark.createDataFrame([(D0 + timedelta(days=k),) for k in range(8)], "date date")
    assert len(T.OBJECTIVES) == 14
    for objective in T.OBJECTIVES:
        ranked = T.rank_trials(made, dates, objective).orderBy("rank").collect()
        assert len(ranked) == 3
        first = {"avg_holding_days": 2, "max_drawdown": 0, "mc_maxdd_p50": 0, "mc_maxdd_p95": 0, "avg_pnl": 2, "total_return": 2}.get(objective)
        assert first is None or ranked[0]["trial_id"] == first, objective
    assert T.rank_trials(made, dates, "avg_pnl", direction="min").orderBy("rank").first()["trial_id"] == 0
    with pytest.raises(ValueError):
        T.rank_trials(made, dates, "luck")


def test_a_window_ends_its_trades(spark, panel, rows):
    """A fold's trades are those of bars cut at the fold's end."""
    first, last = D0 + timedelta(days=10), D0 + timedelta(days=30)
    trials = [{"hold": 15, "stop": 0.1}]
    windows = spark.createDataFrame([(0, True, first, last)], "fold int, tested boolean, first date, last date")
    calm = [r[:-1] + (False,) for r in rows]
    prepared = T.prepared(spark.createDataFrame(calm, PANEL))
    got = T.windowed_trades(T.sweep(prepared, trials, D0, END), prepared, windows)
    cut = [r for r in calm if r[1] <= last]
    assert plain(got) == {t for t in walk(cut, 15, 0.1, None, None, None, None, "close", "close") if t[1] >= first}


def test_walkforward_and_its_summary(spark):
    rows = [(t, "a", date(2024, m, 1), date(2024, m, 9), 0.01 * (t + 1) * (1 if m < 7 else -1), 8) for t in range(3) for m in range(1, 13)]
    bars = spark.range(366).select(F.lit("a").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") + 1).cast("int").alias("n"), F.lit(10.0).alias("close"))
    number = lambda c: F.datediff(F.col(c), F.lit("2024-01-01").cast("date")) + 1
    cost = (1 + COSTS[0] + COSTS[1]) / (1 - sum(COSTS))
    trades = spark.createDataFrame(rows, TRADES).withColumns({"entry_n": number("entry_date"), "exit_n": number("exit_date"), "entry_price": F.lit(10.0), "reason": F.lit("signal"), "blocked_days": F.lit(0)})
    trades = trades.withColumn("exit_price", 10 * (1 + F.col("pnl_pct")) * cost)
    folds = T.fold_frame(spark, [(0, date(2024, 1, 1), date(2024, 6, 30), date(2024, 7, 1), date(2024, 12, 31)), (1, date(2025, 1, 1), date(2025, 6, 30), date(2025, 7, 1), date(2025, 12, 31))])
    for objective in ("avg_pnl", "total_return", "max_drawdown", "sortino"):
        result = T.walkforward(trades, folds, bars, objective)
        out = result.collect()
        assert len(out) == 1 and out[0]["n_trades"] == 6
        if objective in ("avg_pnl", "total_return"):
            assert out[0]["trial_id"] == 2 and out[0]["degradation"] > 0
        whole = T.out_of_sample(result, 2, objective).first()
        assert (whole["n_folds"], whole["skipped"], whole["consistency"]) == (1, 1, 0.0)
        assert np.isclose(whole["compounded_oos_return"], out[0]["total_return"]) and out[0]["total_return"] < 0


def test_signal_backtest_acts_on_the_next_open(spark, rows):
    df = spark.createDataFrame(rows, PANEL).withColumns({"buy": F.col("entry"), "sell": F.col("exit"), "rsi_14": F.lit(50.0)}).drop("entry", "exit")
    got = plain(T.signal_backtest(df, ["buy"], ["sell"], D0, END, 8, (20.0, 80.0), stop=0.1))
    assert got == walk(rows, 8, 0.1, None, None, None, None, "next_open", "next_open")


def test_labelling_deals_bars_out_once(panel, spark):
    """An entry's next bars come by a window over its symbol: no join, no exchange but the windows' own, no frame up to a series' end that is gone through for every bar."""
    text = T.label_trades(T.prepared(spark.createDataFrame(bars_of(1), PANEL)), D0, END, 6, 0.08, "next_open")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1
    assert "1, unboundedfollowing" not in text


def test_a_last_bar_has_no_exit(spark):
    """An entry on a symbol's last bar has no bar to leave on; one bar before it leaves at the end of data."""
    rows = T.prepared(spark.createDataFrame(bars_of(1), PANEL)).withColumns({"entry": F.col("n") >= F.col("last_n") - 1, "exit": F.lit(False), "_tradable": F.lit(True), "_stuck_up": F.lit(False)})
    got = T.label_trades(rows, D0, END, 6, None).collect()
    assert len(got) == rows.select("symbol").distinct().count() and {(r["reason"], r["duration"]) for r in got} == {("end", 1)}
