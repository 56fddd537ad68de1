"""Indicators whose value depends on their own value a bar before.

``with_recursive`` streams the prices of bars sorted by symbol and date through Arrow
batches; all other columns stay in Spark. Whole symbols are gathered until ``CHUNK``
rows are there and then advance in step, one bar of all of them at a time, so that a bar
costs a few array operations and no group costs a call. A task holds one chunk, or one
symbol if that is longer. Only the means that the wanted columns rest on are worked out.
``ema_fold`` is the same recursion by SQL's ``aggregate`` on the ordered array, for
short series: it costs the square of a symbol's length but runs no Python.

A bar without a value (KDJ's range being zero) keeps the state and gives null.

What a symbol's next bar needs of all before it is a state of ``STATE`` numbers: the
means, how many bars there were, the last close, and the last eight highs and lows. A
table of states, a row a symbol, lets a later run start from where the last one
ended, with the same results to the last bit as one run over everything.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import by_symbol

EMA = (5, 10, 20, 30, 60)
RSI = (6, 14, 24)
RECURSIVE = (*[f"ema{n}" for n in EMA], "macd_dif", "macd_dea", "macd_hist", "kdj_k", "kdj_d", "kdj_j", "atr_14", *[f"rsi_{n}" for n in RSI])
#: Rows of whole symbols that are worked on together.
CHUNK = 1 << 16

_SPANS = (*EMA, 12, 26)
#: Bars before a bar that KDJ looks back on.
_BACK = 8
#: Weights of the new value in each mean: of the closes, the true range, and gains and losses in turn.
_ALPHAS = np.array([*[2 / (n + 1) for n in _SPANS], 1 / 14, *[1 / n for n in RSI for _ in (0, 1)]])[:, None]


def ewm(values: pd.Series, alpha: float, ignore_na: bool = True) -> pd.Series:
    """Exponential mean seeded with the first value; a gap keeps the state, or makes it decay if not ``ignore_na``."""
    return values.ewm(alpha=alpha, adjust=False, ignore_na=ignore_na).mean().where(values.notna() | (not ignore_na))


#: Numbers of a state: means, dea, k, d, last close, bars so far, and ``_BACK`` highs and lows, the latest last.
STATE = len(_ALPHAS) + 5 + 2 * _BACK
_DEA, _CLOSE, _BARS, _HIGHS = len(_ALPHAS), len(_ALPHAS) + 3, len(_ALPHAS) + 4, len(_ALPHAS) + 5


def fresh_states(n: int) -> np.ndarray:
    """States of ``n`` symbols before their first bars."""
    out = np.full((n, STATE), np.nan)
    out[:, _BARS] = 0
    return out


def _next(state: np.ndarray, x: np.ndarray, alpha) -> np.ndarray:
    """The means after one more value; a NaN keeps the state."""
    new = np.where(np.isnan(state), x, state + alpha * (x - state))
    return np.where(np.isnan(x), state, new)


def _used(wanted: Sequence[str]) -> list[int]:
    """The rows of ``_ALPHAS`` that the ``wanted`` columns rest on."""
    spans = [n for n in EMA if f"ema{n}" in wanted] + ([12, 26] if any(c.startswith("macd") for c in wanted) else [])
    gains = [len(_SPANS) + 1 + 2 * r + k for r, n in enumerate(RSI) if f"rsi_{n}" in wanted for k in (0, 1)]
    return sorted([_SPANS.index(n) for n in spans] + ([len(_SPANS)] if "atr_14" in wanted else []) + gains)


def _inputs(close: np.ndarray, high: np.ndarray, low: np.ndarray, place: np.ndarray, used: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """What the first means take in (a row for each of ``used``) and KDJ's raw value, for all bars; ``place`` counts a symbol's bars from 0."""
    before = np.where(place > 0, np.concatenate([[np.nan], close[:-1]]), np.nan)
    spread = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    move = np.nan_to_num(close - before)
    least, most = low.copy(), high.copy()
    for k in range(1, _BACK + 1):
        least[k:], most[k:] = np.minimum(least[k:], low[:-k]), np.maximum(most[k:], high[:-k])
    width = np.where((place >= _BACK) & (most != least), most - least, np.nan)
    ups = [np.maximum(x, 0) for x in (move, -move)]
    rows = [*[close] * len(_SPANS), spread, *[x for _ in RSI for x in ups]]
    return np.stack([rows[k] for k in used]) if used else np.empty((0, len(close))), 100 * (close - least) / width


def _recalled(values: np.ndarray, starts: np.ndarray, old: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``values`` with the last ``known`` of ``old`` set before each symbol's."""
    parts = []
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(values)))):
        parts += [old[k, old.shape[1] - known[k] :], values[a:b]]
    return np.concatenate(parts) if parts else values


def lockstep(
    close: np.ndarray, high: np.ndarray, low: np.ndarray, starts: np.ndarray, states: np.ndarray | None = None, wanted: Sequence[str] | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The ``wanted`` recursive columns (all if None) of bars sorted by symbol and date, and each symbol's state behind its last bar.

    ``starts``: where each symbol begins; ``states``: a row a symbol, from an earlier run.
    The state is whole only if all columns are wanted.
    """
    used = list(range(len(_ALPHAS))) if wanted is None else _used(wanted)
    wanted = RECURSIVE if wanted is None else wanted
    n, symbols = len(close), len(starts)
    old = fresh_states(symbols) if states is None else states
    known = np.minimum(old[:, _BARS], _BACK).astype(np.int64)
    lengths = np.diff(np.append(starts, n))
    own = np.ones(n + int(known.sum()), dtype=bool)
    shifted = starts + np.cumsum(known) - known
    if known.any():
        closes = np.full((symbols, _BACK), np.nan)
        closes[:, -1] = old[:, _CLOSE]
        high, low, close = (_recalled(v, starts, o, known) for v, o in ((high, old[:, _HIGHS : _HIGHS + _BACK]), (low, old[:, _HIGHS + _BACK :]), (close, closes)))
        own = np.ones(len(close), dtype=bool)
        own[np.concatenate([np.arange(a, a + k) for a, k in zip(shifted, known)])] = False
    place = np.arange(len(close)) - np.repeat(shifted, lengths + known) + np.repeat(old[:, _BARS].astype(np.int64) - known, lengths + known)
    taken, raw = _inputs(close, high, low, place, used)
    taken, raw, shown = taken[:, own], raw[own], close[own]
    order = np.argsort(-lengths, kind="stable")
    first, rows = starts[order], lengths[order]
    means, (dea, k, d) = old[order][:, used].T.copy(), old[order, _DEA : _DEA + 3].T.copy()
    # Bars are laid out step by step, so that a step is one stretch of every array.
    steps = np.arange(int(rows.max(initial=0)))
    there = np.searchsorted(-rows, -steps, "left")  # symbols with more bars than a step's number
    begin = np.cumsum(there) - there
    at = first[np.arange(n) - np.repeat(begin, there)] + np.repeat(steps, there)
    taken, stepped, alphas = taken[:, at], raw[at], _ALPHAS[used]
    out, late = np.empty((len(used), n)), np.empty((3, n))
    row = {x: i for i, x in enumerate(used)}
    fast, slow = row.get(_SPANS.index(12)), row.get(_SPANS.index(26))
    macd, kdj = fast is not None and slow is not None, any(c.startswith("kdj") for c in wanted)
    for m, a in zip(there.tolist(), begin.tolist()):
        b = a + m
        means[:, :m] = now = out[:, a:b] = _next(means[:, :m], taken[:, a:b], alphas)
        if macd:
            dea[:m] = late[0, a:b] = _next(dea[:m], now[fast] - now[slow], 0.2)
        if kdj:
            x = stepped[a:b]
            k[:m] = late[1, a:b] = _next(k[:m], x, 1 / 3)
            d[:m] = late[2, a:b] = np.where(np.isnan(x), d[:m], _next(d[:m], k[:m], 1 / 3))
    back = np.empty(n, dtype=np.int64)
    back[at] = np.arange(n)
    missing = np.isnan(shown)
    mean = lambda x: out[row[x]][back]
    hidden = lambda x: np.where(missing, np.nan, x)
    columns = {f"ema{s}": hidden(mean(_SPANS.index(s))) for s in EMA if f"ema{s}" in wanted}
    if macd:
        dif, slower = hidden(mean(_SPANS.index(12)) - mean(_SPANS.index(26))), late[0][back]
        columns |= {"macd_dif": dif, "macd_dea": hidden(slower), "macd_hist": 2 * (dif - slower)}
    if kdj:
        kk, dd = (np.where(np.isnan(raw), np.nan, late[x][back]) for x in (1, 2))
        columns |= {"kdj_k": kk, "kdj_d": dd, "kdj_j": 3 * kk - 2 * dd}
    if "atr_14" in wanted:
        x = len(_SPANS)
        columns["atr_14"] = np.where(np.isnan(taken[row[x]][back]), np.nan, mean(x))
    for r, s in enumerate(RSI):
        if f"rsi_{s}" in wanted:
            gain, loss = (mean(len(_SPANS) + 1 + 2 * r + x) for x in (0, 1))
            columns[f"rsi_{s}"] = 100 - 100 / (1 + gain / np.where(loss == 0, 1e-12, loss))
    new = np.full((symbols, STATE), np.nan)
    new[np.ix_(order, used)], new[order, _DEA : _DEA + 3] = means.T, np.stack([dea, k, d]).T
    new[:, _BARS] = old[:, _BARS] + lengths
    ends = shifted + known + lengths
    new[:, _CLOSE] = np.where(known + lengths > 0, close[np.maximum(ends - 1, 0)], np.nan) if len(close) else old[:, _CLOSE]
    for back in range(_BACK):
        there = back < known + lengths
        at = np.where(there, ends - 1 - back, 0)
        for k_, values in enumerate((high, low)):
            new[:, _HIGHS + k_ * _BACK + _BACK - 1 - back] = np.where(there, values[at], np.nan) if len(values) else np.nan
    return columns, new


def with_recursive(df: DataFrame, wanted: Sequence[str] = RECURSIVE, states: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """``df`` with the ``wanted`` recursive columns.

    ``states`` (``symbol, date, state``) are where symbols start from; only bars after a
    state's date stay. With ``state`` the last row of each symbol gets its state in that
    column, which is null elsewhere: the next run's ``states``.
    """
    wanted = list(wanted)
    rows = df.withColumn("_n", F.row_number().over(by_symbol()))
    given = [F.col("_n"), F.col("_n") == 1]
    if states is not None:
        # Bars are in order before the joins, so that no sort holds states; a state comes to its symbol's first new bar alone.
        rows = rows.withColumn("_before", F.lag("date").over(by_symbol()))
        mine = F.col("symbol") == F.col("_symbol")
        rows = rows.join(states.select(F.col("symbol").alias("_symbol"), F.col("date").alias("_seen")), mine, "left").filter("_seen IS NULL OR date > _seen")
        rows = rows.withColumn("_first", (F.col("_n") == 1) | F.coalesce(F.col("_before") <= F.col("_seen"), F.lit(False))).drop("_symbol", "_seen", "_before")
        rows = rows.join(states.select(F.col("symbol").alias("_symbol"), F.col("state").alias("_from")), mine & F.col("_first"), "left").drop("_symbol")
        given = [F.col("_n"), F.col("_first"), F.col("_from")]
    if not wanted and not state:
        return rows.select(*df.columns)
    kind = "struct<" + ", ".join([f"`{c}`: double" for c in wanted] + ([f"`{state}`: array<double>"] if state else [])) + ">"
    prices = [F.col(c).cast("double") for c in ("close", "high", "low")]
    # Not deterministic: the order of rows counts, so no filter may move below it.
    worked = F.arrow_udf(_worker(wanted, state), kind).asNondeterministic()
    return rows.withColumn("_r", worked(*given[:2], *prices, *given[2:])).select(*df.columns, *[F.col("_r")[c].alias(c) for c in (*wanted, *([state] if state else []))])


def _worker(wanted: list[str], state: str | None):
    """The function of batches ``number, first, close, high, low`` (and ``from``) to the results."""

    def worked(columns: list[np.ndarray], old: list[pa.Array], starts: np.ndarray) -> pa.StructArray:
        close, high, low = columns[2:]
        states = None
        if old:
            states = fresh_states(len(starts))
            for k, x in enumerate(old[0].take(pa.array(starts)).to_pylist()):
                if x is not None:
                    states[k] = x
        found, new = lockstep(close, high, low, starts, states, None if state else wanted)
        out = [pa.array(found[c], from_pandas=True) for c in wanted]
        if state:
            ends = np.zeros(len(close), dtype=bool)
            ends[np.append(starts[1:], len(close)) - 1] = True
            nth = np.cumsum(ends) - 1
            out.append(pa.array(list(new), pa.list_(pa.float64())).take(pa.array(np.where(ends, nth, 0), mask=~ends)))
        return pa.StructArray.from_arrays(out, [*wanted, *([state] if state else [])])

    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: list[tuple] = []
        rows = 0
        for number, first, *more in batches:
            prices = [x.fill_null(float("nan")).to_numpy(zero_copy_only=False) for x in more[:3]]
            held.append(([number.to_numpy(zero_copy_only=False), first.to_numpy(zero_copy_only=False), *prices], more[3:]))
            rows += len(number)
            if rows >= CHUNK:
                columns, old = _joined(held)
                starts = _starts(columns)
                if len(starts) > 1:
                    end = int(starts[-1])
                    yield worked([c[:end] for c in columns], [x.slice(0, end) for x in old], starts[:-1])
                    columns, old = [c[end:] for c in columns], [x.slice(end) for x in old]
                held, rows = [(columns, old)], len(columns[0])
        if rows:
            columns, old = _joined(held)
            yield worked(columns, old, _starts(columns))

    of.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return of


def _joined(held: list[tuple[list[np.ndarray], list[pa.Array]]]) -> tuple[list[np.ndarray], list[pa.Array]]:
    columns = [np.concatenate(c) for c in zip(*(c for c, _ in held))]
    return columns, [pa.concat_arrays(x) for x in zip(*(x for _, x in held))]


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where each symbol begins."""
    number, first = columns[0], columns[1].astype(bool)
    if len(number) and not (first[0] and (first[1:] | (np.diff(number) == 1)).all()):
        raise ValueError("bars are not in order of symbol and date")
    return np.flatnonzero(first)


def resumed(bars: DataFrame, states: DataFrame, wanted: Sequence[str] = RECURSIVE) -> DataFrame:
    """The ``wanted`` columns of the bars after each symbol's state (``symbol, date, state``), and new states in ``state``.

    Symbols without a state start afresh. A symbol whose earlier bars have changed must be
    taken out of ``states``. Keep a symbol's old state where it has no new bar.
    """
    return with_recursive(bars, wanted, states, "state")


def states_of(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``symbol, date, state``: the state table after a run, of symbols without a new bar as it was ``before``."""
    now = rows.filter("state IS NOT NULL").select("symbol", "date", "state")
    return now if before is None else now.unionByName(before.select("symbol", "date", "state").join(now, "symbol", "left_anti"))


def ewm_gap_decay(df: DataFrame, column: str, alpha: float, name: str) -> DataFrame:
    """``name``: the exponential mean of ``column`` whose weights decay over null bars too."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def of(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date", kind="stable", ignore_index=True)
        return bars.assign(**{name: ewm(bars[column].astype("float64"), alpha, ignore_na=False)})

    return df.groupBy("symbol").applyInPandas(of, schema)


def ema_fold(df: DataFrame, column: str, n: int) -> DataFrame:
    """``symbol, date, ema{n}`` of each symbol's last bar: one fold over its bars in order.

    A symbol's bars, some thousands at most, stand in one array.
    """
    alpha = 2 / (n + 1)
    bars = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", F.col(column).alias("x")))).alias("bars"))
    values = F.transform("bars", lambda b: b["x"])
    out = F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.element_at(values, 1), lambda a, x: x * alpha + a * (1 - alpha))
    return bars.select("symbol", F.element_at("bars", -1)["date"].alias("date"), out.alias(f"ema{n}"))
