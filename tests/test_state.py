"""State that a later run, or a later trigger, starts from."""

import random
import re
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import indicators, limits, recursive
from tidepanel.operators.recursive import RECURSIVE
from tidepanel.streaming import stream as Z

D0 = date(2024, 1, 1)


def bars_of(seed, symbols=6, days=90):
    rng = random.Random(seed)
    rows = []
    for k in range(symbols):
        first = rng.randrange(days - 3) if k else 0
        for day in range(first, days):
            close = rng.uniform(5, 15) if day % 7 else 10.0
            rows.append((f"S{k}", D0 + timedelta(days=day), close + rng.random(), close - rng.random(), close, float(rng.randrange(3)), rng.random() < 0.6, rng.random() < 0.3))
    return rows


SCHEMA = "symbol string, date date, high double, low double, close double, volume double, signal_limit_up boolean, signal_limit_down boolean"


def plain(rows, columns):
    return sorted((r["symbol"], r["date"], *(r[c] for c in columns)) for r in rows)


def test_increments_equal_one_run_to_the_last_bit(spark):
    df = spark.createDataFrame(bars_of(1), SCHEMA)
    whole = plain(recursive.with_recursive(df).collect(), RECURSIVE)
    states, got = None, []
    for ends in (1, 2, 5, 20, 21, 60, 90):
        upto = df.filter(F.col("date") < F.lit(D0 + timedelta(days=ends)))
        rows = recursive.with_recursive(upto, RECURSIVE, state="state") if states is None else recursive.resumed(upto, states)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        new = recursive.states_of(rows, states)
        states = spark.createDataFrame(new.collect(), new.schema)
        assert states.count() == upto.select("symbol").distinct().count()
        got += rows.collect()
    assert len(got) == len(whole)
    for a, b in zip(plain(got, RECURSIVE), whole):
        assert a == b


def test_states_come_to_first_bars_alone(spark):
    """Bars are dealt and sorted once, before the states are joined to them."""
    df = spark.createDataFrame(bars_of(1), SCHEMA)
    early = df.filter(F.col("date") < F.lit(D0 + timedelta(days=20)))
    states = recursive.states_of(recursive.with_recursive(early, ("ema5",), state="state"))
    states = spark.createDataFrame(states.collect(), states.schema)
    text = recursive.resumed(df.repartition("symbol"), states)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#", text)) == 1 and len(re.findall(r"Sort \[symbol#", text)) == 1


def test_only_prices_go_through_the_recursion(spark):
    """All other columns stay in Spark, whatever their type; a filter behind it takes no bar out of it."""
    df = spark.createDataFrame(bars_of(1), SCHEMA).withColumn("span", F.make_interval(days=F.lit(1)))
    rows = recursive.with_recursive(df, ["rsi_14"])
    assert rows.columns == [*df.columns, "rsi_14"] and rows.filter(F.col("span").isNotNull()).count() == df.count()
    whole = {(r["symbol"], r["date"]): r["rsi_14"] for r in rows.drop("span").collect()}
    late = rows.filter(F.col("date") >= F.lit(D0 + timedelta(days=40))).drop("span").collect()
    assert late and all(whole[r["symbol"], r["date"]] == r["rsi_14"] for r in late)


@pytest.mark.parametrize("wanted", [["rsi_14"], ["macd_dea", "rsi_6"], ["kdj_j"], ["atr_14", "ema60"], ["macd_hist", "kdj_d"]])
def test_some_recursive_columns_equal_those_of_all(wanted):
    rng, starts = np.random.default_rng(5), np.array([0, 1, 41, 60])
    close = rng.random(100) * 9 + 1
    prices = close, close + rng.random(100), close - rng.random(100)
    all_, some = recursive.lockstep(*prices, starts)[0], recursive.lockstep(*prices, starts, wanted=wanted)[0]
    assert all(np.array_equal(all_[c], some[c], equal_nan=True) for c in wanted)


def test_lockstep_takes_no_bars():
    out, states = recursive.lockstep(*(np.zeros(0) for _ in range(3)), np.zeros(0, dtype=np.int64))
    assert len(out["ema5"]) == 0 and states.shape == (0, recursive.STATE)


def test_streamed_triggers_equal_the_batch(spark, tmp_path):
    rows = bars_of(2, 3, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    source = str(tmp_path / "bars")
    for k, (a, b) in enumerate(((0, 1), (1, 4), (4, 40), (40, 41), (41, 80))):
        df.filter(F.col("date").between(F.lit(D0 + timedelta(days=a)), F.lit(D0 + timedelta(days=b - 1)))).repartition(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with Z.rocksdb(spark):
        got = Z.run_to_table(spark, Z.streaming_indicators(stream), str(tmp_path / "out"), str(tmp_path / "check")).collect()
    batch = indicators.with_indicators(df, set(Z.Indicators.WINDOWED))
    batch = limits.with_streaks(recursive.with_recursive(batch), {"signal_limit_up": "consecutive_limit_ups", "signal_limit_down": "consecutive_limit_downs"})
    columns = [c.split()[0] for c in Z.Indicators.OUT.split(", ")][2:]
    a, b = plain(got, columns), plain(batch.select("symbol", "date", *columns).collect(), columns)
    assert len(a) == len(b) == len(rows)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        for c, p, q in zip(columns, x[2:], y[2:]):
            assert (p is None or p != p) == (q is None) and (q is None or abs(p - q) < 1e-9), (x[:2], c)


def test_cooldown_state_ends_with_the_cooldown(spark, tmp_path):
    """Hits of one hour, then of the next days alone: the first keys' state goes once the watermark has passed their cooldown."""
    t0 = datetime(2024, 1, 1, 9)
    batches = [[("r", f"s{k}", t0 + timedelta(minutes=k % 50)) for k in range(40)], *[[("r", "late", t0 + timedelta(days=d))] for d in range(1, 5)]]
    source, schema = str(tmp_path / "hits"), "rule string, symbol string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    seen = []
    with Z.rocksdb(spark):
        query = Z.cooldown(stream, 3600).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(seen) >= 40 and seen[-1] < 10
    fired = spark.sql("SELECT * FROM fired").collect()
    assert len(fired) == 44 and {r["symbol"] for r in fired} == {"late", *(f"s{k}" for k in range(40))}


def test_cooldown_silences_over_triggers(spark, tmp_path):
    t0, source, schema = datetime(2024, 1, 1, 9), str(tmp_path / "hits"), "rule string, symbol string, ts timestamp"
    times = [0, 30, 59, 60, 61, 119, 121, 300]
    for k, m in enumerate(times):
        spark.createDataFrame([("r", "s", t0 + timedelta(minutes=m))], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    with Z.rocksdb(spark):
        out = Z.run_to_table(spark, Z.cooldown(stream, 3600), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r["ts"] - t0).total_seconds() / 60 for r in out.collect()) == [0, 60, 121, 300]


@pytest.mark.parametrize("kind", ["sum", "min", "max"])
def test_trailing_windows(kind):
    values = np.array([3.0, 1.0, np.nan, 2.0, 5.0, 4.0])
    f = {"sum": sum, "min": min, "max": max}[kind]
    for n in (1, 2, 3):
        for new in range(1, 7):
            got = Z.trailing(values, n, kind, new)
            for k, at in enumerate(range(6 - new, 6)):
                own = values[max(0, at - n + 1) : at + 1]
                want = f(own) if len(own) == n and not np.isnan(own).any() else np.nan
                assert np.isclose(got[k], want, equal_nan=True)


def test_streamed_indicator_bars_are_written_by_all_tasks(spark, monkeypatch):
    """The stream's bars lie in as many parts as the session deals rows into, not in two."""
    from tidepanel.plans import catalog_io as C

    class Seen(Exception):
        pass

    def written(s, df, **options):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(C, "streamed", written)
    try:
        C._z02(spark, "/root/testdata/sf0.001")
    except Seen as seen:
        assert "REPARTITION_BY_NUM" not in str(seen)
    else:
        raise AssertionError("nothing was written")
