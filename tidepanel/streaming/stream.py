"""Streaming twins of the panel operators.

Event time is a timestamp under a watermark: late rows within it change open windows,
later ones are dropped. Order is the event's, not the arrival's.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import continuous_trading, intraday_volume_ratio, session_phase
from ..operators.filters import in_scope, match_conditions, matches
from ..operators.recursive import RECURSIVE, lockstep
from ..sources.io import upsert_by_date

LATENESS = "10 minutes"


def ticks(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events with a timestamp event time, watermarked, each (symbol, ts, id) once."""
    out = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return out.dropDuplicatesWithinWatermark(["symbol", "ts", "event_id"])


def _ohlcv() -> list[Column]:
    seq = F.struct("ts", "event_id")
    return [
        F.min_by("value", seq).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", seq).alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum("value").alias("amount")
    ]


def tumbling_bars(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """OHLCV bars of each symbol and window, for append mode."""
    return events.groupBy("symbol", F.window("ts", width).alias("w")).agg(*_ohlcv()).select(
        "symbol",
        F.col("w.start").alias("start"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "amount"
    )


def phase_bars(events: DataFrame) -> DataFrame:
    """Bars of each symbol, day and session phase, under the same watermark."""
    return events.groupBy("symbol", F.window("ts", "1 day").alias("w"), session_phase(F.col("ts")).alias("phase")).agg(*_ohlcv()).select(
        "symbol",
        F.to_date("w.start").alias("date"),
        "phase",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "amount"
    )


def session_gate(quotes: DataFrame) -> DataFrame:
    """Quotes of continuous trading whose snapshot is of their own day."""
    return quotes.filter(continuous_trading(F.col("ts")) & (F.to_date("ts") == F.to_date("snapshot")))


def scaled_volume_ratio(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("vol_ratio", intraday_volume_ratio(F.col("vol_ratio"), F.col("ts")))


def quotes_to_bars(quotes: DataFrame) -> DataFrame:
    """The day's bar of each symbol from its last quote; bad prices become the last price."""
    seq = F.struct("ts", "event_id")
    last = quotes.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        *[F.max_by(c, seq).alias(c) for c in ("last_price", "open", "high", "low", "volume", "amount")],
        F.max("ts").alias("quote_ts")
    )
    good = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.col("last_price")).otherwise(F.col(c)).alias(c)
    return last.select(
        "symbol",
        "date",
        good("open"),
        good("high"),
        good("low"),
        F.col("last_price").alias("close"),
        "volume",
        "amount",
        F.unix_millis("quote_ts").alias("quote_ts")
    )


def upsert_stream(quotes: DataFrame, path: str, checkpoint: str):
    """Every batch's bars merged into the daily table, the latest quote of a key winning."""

    def batch(df: DataFrame, _: int) -> None:
        upsert_by_date(df.sparkSession, path, quotes_to_bars(df), ["symbol", "date"], ["quote_ts"])

    return quotes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evaluate_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``rule, symbol, ts`` of every row that matches a rule, within the rule's scope; one pass for all rules."""
    if not rules:
        return df.select(F.lit("").alias("rule"), "symbol", "ts").limit(0)
    hits = [
        F.when(in_scope(r["scope"], r.get("symbols")) & matches(r["conditions"], r.get("logic", "and"), df.columns), F.lit(r["id"])) for r in rules
    ]
    return df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("rule"), "symbol", "ts")


def seal_alerts(quotes: DataFrame, threshold: float, by_amount: bool = False) -> DataFrame:
    """Limit-ups whose seal is thin: 0 < volume (or its worth) <= threshold."""
    worth = F.col("bid1_vol") * 100 * F.col("close") if by_amount else F.col("bid1_vol")
    return quotes.filter((worth > 0) & (worth <= threshold))


def any_signal_alerts(df: DataFrame, signals: list[str]) -> DataFrame:
    return match_conditions(df, [{"field": s, "op": "truth", "value": None} for s in signals], "or")


def enrich_alerts(alerts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Alerts with the labels of a static table."""
    return alerts.join(dimension, "symbol", "left")


def firings(at: np.ndarray, last: np.datetime64 | None, seconds: int) -> list[int]:
    """Which of the sorted times fire, each at least ``seconds`` after the one before; ``last`` fired before them."""
    wait, out, k = np.timedelta64(seconds, "s"), [], 0 if last is None else int(np.searchsorted(at, last + np.timedelta64(seconds, "s")))
    while k < len(at):
        out.append(k)
        k = max(k + 1, int(np.searchsorted(at, at[k] + wait)))
    return out


class Cooldown(StatefulProcessor):
    """Lets a (rule, symbol) fire again after so many seconds of event time.

    A firing sets a timer; when the watermark passes the cooldown's end the state goes, for
    no hit that the watermark admits could still be silenced by it.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = np.sort(np.concatenate([part["ts"].to_numpy("datetime64[us]") for part in rows]))
        last = np.datetime64(self.last.get()[0], "us") if self.last.exists() else None
        fired = at[firings(at, last, self.seconds)]
        if len(fired):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((pd.Timestamp(fired[-1]).to_pydatetime(),))
            self.handle.registerTimer(int(fired[-1].astype("datetime64[ms]").astype(np.int64)) + 1000 * self.seconds)
            yield pd.DataFrame({"rule": key[0], "symbol": key[1], "ts": fired})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def cooldown(hits: DataFrame, seconds: int = 3600, lateness: str | None = LATENESS) -> DataFrame:
    """``rule, symbol, ts`` of the hits that fire; hits within the cooldown are silent, hits later than ``lateness`` are dropped.

    ``lateness`` None keeps the stream's own watermark on ``ts``.
    """
    timed = hits if lateness is None else hits.withWatermark("ts", lateness)
    return timed.groupBy("rule", "symbol").transformWithStateInPandas(Cooldown(seconds), "rule string, symbol string, ts timestamp", "Append", "EventTime")


def cooldown_batch(hits: DataFrame, seconds: int = 3600) -> DataFrame:
    """The same for a table: hits stream through in order, and a (rule, symbol) carries its last firing from batch to batch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            at, fired = batch.column(2).cast(pa.timestamp("us")).to_numpy(zero_copy_only=False), []
            edges = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for a, b in zip(edges, edges[1:]):
                if names[a] != key:
                    key, last = names[a], None
                own = [a + k for k in firings(at[a:b], last, seconds)]
                last = at[own[-1]] if own else last
                fired += own
            yield batch.take(pa.array(fired, pa.int64()))

    rows = hits.select("rule", "symbol", "ts").filter("ts IS NOT NULL").repartition("rule", "symbol").sortWithinPartitions("rule", "symbol", "ts")
    return rows.mapInArrow(of, "rule string, symbol string, ts timestamp")


class PoolDiff(StatefulProcessor):
    """What a strategy's pool gained and lost against its last pool; the first pool is silent, more than ``most`` changes make one row.

    Rows are ``strategy, run, symbol``. A run of a strategy has a row without a symbol,
    so that an empty pool is a pool too; runs that arrive together are taken in order.
    """

    def __init__(self, most: int = 5):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pool = handle.getValueState("pool", "symbols array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pools: dict[int, set[str]] = {}
        for part in rows:
            for run, symbols in part.groupby("run")["symbol"]:
                pools.setdefault(run, set()).update(symbols.dropna())
        before = set(self.pool.get()[0]) if self.pool.exists() else None
        for run in sorted(pools):
            now = pools[run]
            if before is not None:
                found = [(s, "new") for s in sorted(now - before)] + [(s, "dropped") for s in sorted(before - now)]
                if len(found) > self.most:
                    found = [(f"{len(found)} symbols", "batch")]
                if found:
                    yield pd.DataFrame({"strategy": key[0], "run": run, "symbol": [s for s, _ in found], "change": [c for _, c in found]})
            before = now
        self.pool.update((sorted(before or ()),))

    def close(self) -> None:
        pass


def pool_rows(hits: DataFrame, strategies: DataFrame, run: int) -> DataFrame:
    """``strategy, run, symbol`` of one run: the hits, and a row without a symbol for every strategy that ran."""
    marks = strategies.select("strategy", F.lit(None).cast("string").alias("symbol"))
    return hits.select("strategy", "symbol").distinct().unionByName(marks).withColumn("run", F.lit(run))


def pool_changes(pools: DataFrame, most: int = 5) -> DataFrame:
    return pools.groupBy("strategy").transformWithStateInPandas(
        PoolDiff(most),
        "strategy string, run int, symbol string, change string",
        "Append",
        "None"
    )


#: Averages of closes and of volumes, and the span of the extremes.
_MA, _VOL_MA, _SPAN, _RATIO = (5, 10, 20, 30, 60), (5, 10), 60, 5
#: Flags whose true bars in a row are counted.
_STREAKS = {"signal_limit_up": "consecutive_limit_ups", "signal_limit_down": "consecutive_limit_downs"}


def trailing(values: np.ndarray, n: int, kind: str, new: int) -> np.ndarray:
    """Sum, least or most of the last ``n`` values at each of the last ``new`` places; NaN where one is missing or there are fewer."""
    out = np.full(new, np.nan)
    full = min(new, len(values) - n + 1)
    if full > 0:
        windows = np.lib.stride_tricks.sliding_window_view(values[len(values) - full - n + 1 :], n)
        out[new - full :] = {"sum": np.sum, "min": np.min, "max": np.max}[kind](windows, axis=1)
    return out


class Indicators(StatefulProcessor):
    """Indicators of a symbol's bars as they come.

    State is what the next bar needs: the recursive state, rings of the last closes and
    volumes, and the streaks. A trigger's bars are worked on together, as arrays.
    """

    STATE = "recursive array<double>, closes array<double>, volumes array<double>, streaks array<int>"
    WINDOWED = (*(f"ma{n}" for n in _MA), *(f"vol_ma{n}" for n in _VOL_MA), "vol_ratio_5d", "high_60d", "low_60d")
    OUT = "symbol string, date date, " + ", ".join(f"{c} double" for c in (*RECURSIVE, *WINDOWED)) + "".join(f", {c} int" for c in _STREAKS.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = [part for part in rows if len(part)]
        if not parts:
            return
        whole = {c: np.concatenate([p[c].to_numpy() if c in p else np.zeros(len(p), dtype=bool) for p in parts]) for c in ("date", "high", "low", "close", "volume", *_STREAKS)}
        order = np.argsort(whole["date"], kind="stable")
        high, low, close, volume = (whole[c][order].astype(float) for c in ("high", "low", "close", "volume"))
        old, closes, volumes, streaks = self.state.get() if self.state.exists() else (None, [], [], [0] * len(_STREAKS))
        n = len(close)
        out, new = lockstep(close, high, low, np.array([0]), None if old is None else np.array([old], dtype=float))
        closes, volumes = np.concatenate([np.array(closes, dtype=float), close]), np.concatenate([np.array(volumes, dtype=float), volume])
        out |= {f"ma{k}": trailing(closes, k, "sum", n) / k for k in _MA} | {f"vol_ma{k}": trailing(volumes, k, "sum", n) / k for k in _VOL_MA}
        before = trailing(volumes[:-1], _RATIO, "sum", n) / _RATIO
        out |= {"vol_ratio_5d": volume / np.where(before == 0, np.nan, before), "high_60d": trailing(closes, _SPAN, "max", n), "low_60d": trailing(closes, _SPAN, "min", n)}
        counted = []
        for flag, last in zip(_STREAKS, streaks):
            hit = np.array([x is not None and x == x and bool(x) for x in whole[flag][order].tolist()])
            at = np.arange(n)
            miss = np.maximum.accumulate(np.where(hit, -1, at))
            out[_STREAKS[flag]] = np.where(miss < 0, at + 1 + last, at - miss).astype(np.int32)
            counted.append(int(out[_STREAKS[flag]][-1]))
        self.state.update((new[0].tolist(), closes[-_SPAN + 1 :].tolist(), volumes[-max(*_VOL_MA, _RATIO) :].tolist(), counted))
        yield pd.DataFrame({"symbol": key[0], "date": whole["date"][order], **{c: out[c] for c in (*RECURSIVE, *self.WINDOWED, *_STREAKS.values())}})

    def close(self) -> None:
        pass


def streaming_indicators(bars: DataFrame) -> DataFrame:
    """Recursive indicators, averages, extremes and streaks of a stream of daily bars; equal to the batch ones while a symbol's bars come in order.

    Streaks count the flags that the bars bring along, and are 0 without. The state store
    must be RocksDB (``rocksdb``).
    """
    return bars.groupBy("symbol").transformWithStateInPandas(Indicators(), Indicators.OUT, "Append", "None")


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a query over all that is available and gives its result, which the tasks write to ``path`` as Parquet."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode(mode)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that custom state needs, for the queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
