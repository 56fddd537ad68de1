"""Queries: bars, indicators, limits, signals, strategies."""

import math

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import limits, recursive, windows
from ..operators.breadth import table_profile
from ..operators.factor import average_rank, bucket_in_date, compound, qcut_in_date
from ..operators.filters import rank_of
from ..operators.joins import delay_signal, first_signal_id, forward_return, with_instruments
from . import bindings as B
from . import strategies as K
from .catalog import query

W = "PARTITION BY symbol ORDER BY date"


def full_sql(n: int, agg: str, c: str) -> str:
    w = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = agg.replace("?", c) if "?" in agg else f"{agg}({c})"
    return f"CASE WHEN count({c}) {w} = {n} THEN {call} {w} END"


def lag_sql(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


PREV5 = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
WINDOW_SQL = {
    "prev_close": lag_sql("close"),
    **{f"ma{n}": full_sql(n, "avg", "close") for n in I.MA},
    "boll_std": full_sql(20, "stddev_samp", "close"),
    **{f"vol_ma{n}": full_sql(n, "avg", "volume") for n in (5, 10)},
    "vol_ratio_5d": f"volume / nullif(CASE WHEN count(volume) {PREV5} = 5 THEN avg(volume) {PREV5} END, 0)",
    "high_60d": full_sql(60, "max", "close"),
    "low_60d": full_sql(60, "min", "close"),
    **{f"momentum_{n}d": f"close / nullif({lag_sql('close', n)}, 0) - 1" for n in I.MOMENTUM},
    "change_pct": f"close / nullif({lag_sql('close')}, 0) - 1",
    "change_amount": f"close - {lag_sql('close')}",
    "amplitude": f"CASE WHEN {lag_sql('close')} > 0 THEN (high - low) / {lag_sql('close')} END",
}
DERIVED_SQL = {
    "boll_upper": "ma20 + 2 * boll_std",
    "boll_lower": "ma20 - 2 * boll_std",
    "annual_vol_20d": f"({full_sql(20, 'stddev_samp', 'change_pct')}) * {math.sqrt(252)!r}::DOUBLE",
}


def over_sql(a: str, b: str) -> str:
    return f"({a} > {b} AND {lag_sql(a)} <= {lag_sql(b)})"


def under_sql(a: str, b: str) -> str:
    return f"({a} < {b} AND {lag_sql(a)} >= {lag_sql(b)})"


SIGNAL_SQL = {
    "signal_ma_golden_5_20": over_sql("ma5", "ma20"),
    "signal_ma_dead_5_20": under_sql("ma5", "ma20"),
    "signal_ma_golden_20_60": over_sql("ma20", "ma60"),
    **{f"signal_ma{n}_breakout": over_sql("close", f"ma{n}") for n in (5, 10, 20)},
    **{f"signal_ma{n}_breakdown": under_sql("close", f"ma{n}") for n in (5, 10, 20)},
    "signal_n_day_high": "close >= high_60d",
    "signal_n_day_low": "close <= low_60d",
    "signal_boll_breakout_upper": "close > boll_upper",
    "signal_boll_breakdown_lower": "close < boll_lower",
    "signal_volume_surge": "vol_ratio_5d >= 2.0",
}
#: ``ind1``: window columns; ``ind``: derived ones and everything of ``ind1``.
IND = (
    f"ind1 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in WINDOW_SQL.items())} FROM bars),\nind AS (SELECT *, "
    f"{', '.join(f'{v} AS {k}' for k, v in DERIVED_SQL.items())} FROM ind1)"
)
SIG = f"sig AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SIGNAL_SQL.items())} FROM ind)"

#: The recursion, one step a bar.
_EMAS = {f"ema{n}": n for n in (5, 10, 12, 20, 26, 30, 60)}
_STEP = ", ".join(f"r.{k} + (n.close - r.{k}) * (2.0::DOUBLE / {v + 1}) AS {k}" for k, v in _EMAS.items())
_DIF = f"((r.ema12 + (n.close - r.ema12) * (2.0::DOUBLE / 13)) - (r.ema26 + (n.close - r.ema26) * (2.0::DOUBLE / 27)))"
_KNEXT = "CASE WHEN n.rsv IS NULL THEN r.k WHEN r.k IS NULL THEN n.rsv ELSE r.k + (n.rsv - r.k) / 3.0::DOUBLE END"
_GL = lambda n: f"r.g{n} + (n.gain - r.g{n}) / {n}.0::DOUBLE AS g{n}, r.l{n} + (n.loss - r.l{n}) / {n}.0::DOUBLE AS l{n}"
REC = f"""num0 AS (SELECT *, row_number() OVER ({W}) AS rn, {lag_sql('close')} AS pc, {full_sql(9, 'min', 'low')} AS ln, {full_sql(9, 'max', 'high')} AS hn FROM bars),
num AS MATERIALIZED (SELECT symbol, date, rn, close, CASE WHEN hn <> ln THEN 100 * (close - ln) / (hn - ln) END AS rsv,
  CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  coalesce(greatest(close - pc, 0.0::DOUBLE), 0.0::DOUBLE) AS gain, coalesce(greatest(pc - close, 0.0::DOUBLE), 0.0::DOUBLE) AS loss FROM num0),
rec AS (
  SELECT symbol, date, rn, {', '.join(f'close AS {k}' for k in _EMAS)}, 0.0::DOUBLE AS dea, rsv AS k, rsv AS d, rsv AS rsv, tr AS atr, {', '.join(f'gain AS g{n}, loss AS l{n}' for n in (6, 14, 24))} FROM num WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.date, n.rn, {_STEP}, r.dea + ({_DIF} - r.dea) * 0.2::DOUBLE AS dea, {_KNEXT} AS k,
    CASE WHEN n.rsv IS NULL THEN r.d WHEN r.d IS NULL THEN {_KNEXT} ELSE r.d + ({_KNEXT} - r.d) / 3.0::DOUBLE END AS d, n.rsv AS rsv,
    r.atr + (n.tr - r.atr) / 14.0::DOUBLE AS atr, {', '.join(_GL(n) for n in (6, 14, 24))}
  FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn + 1),
recind AS (SELECT symbol, date, ema5, ema10, ema20, ema30, ema60, ema12 - ema26 AS macd_dif, dea AS macd_dea, 2 * (ema12 - ema26 - dea) AS macd_hist,
  CASE WHEN rsv IS NOT NULL THEN k END AS kdj_k, CASE WHEN rsv IS NOT NULL THEN d END AS kdj_d, CASE WHEN rsv IS NOT NULL THEN 3 * k - 2 * d END AS kdj_j, atr AS atr_14,
  {', '.join(f'100 - 100 / (1 + g{n} / CASE WHEN l{n} = 0 THEN 1e-12 ELSE l{n} END) AS rsi_{n}' for n in (6, 14, 24))} FROM rec)"""


def indicator_frame(spark, sf_dir, needed=None):
    return I.with_indicators(B.bars(spark, sf_dir), needed)


# Window indicators, by their inventory numbers.
_E = {
    "e01_prev_close": ("prev_close",), "e02_ma": tuple(f"ma{n}" for n in I.MA), "e05_boll": ("boll_upper", "boll_lower"), "e08_vol_ma": ("vol_ma5", "vol_ma10"),
    "e09_vol_ratio": ("vol_ratio_5d",), "e10_high_low_60d": ("high_60d", "low_60d"), "e11_momentum": tuple(f"momentum_{n}d" for n in I.MOMENTUM),
    "e12_change": ("change_pct", "change_amount"), "e13_amplitude": ("amplitude",), "e14_annual_vol": ("annual_vol_20d",),
}
for _name, _cols in _E.items():
    query(
        _name,
        B.with_("bars", more=IND) + f"SELECT symbol, date, {', '.join(_cols)} FROM ind"
    )(lambda s, d, c=_cols: indicator_frame(s, d, set(c)).select("symbol", "date", *c))

# Recursive indicators.
_R = {
    "e03_ema": tuple(f"ema{n}" for n in (5, 10, 20, 30, 60)),
    "e04_macd": ("macd_dif", "macd_dea", "macd_hist"),
    "e06_kdj": ("kdj_k", "kdj_d", "kdj_j"),
    "e07_atr": ("atr_14",),
    "e15_rsi": ("rsi_6", "rsi_14", "rsi_24")
}
for _name, _cols in _R.items():
    query(
        _name,
        B.with_("bars", more=REC, recursive=True) + f"SELECT symbol, date, {', '.join(_cols)} FROM recind"
    )(lambda s, d, c=_cols: indicator_frame(s, d, set(c)).select("symbol", "date", *c))
query(
    "r1_recursive_map",
    B.with_("bars", more=REC, recursive=True) + f"SELECT symbol, date, {', '.join(recursive.RECURSIVE)} FROM recind"
)(lambda s, d: recursive.with_recursive(B.bars(s, d)).select("symbol", "date", *recursive.RECURSIVE))


query(
    "r2_recursive_fold",
    B.with_("bars", more=REC, recursive=True) + "SELECT symbol, max(date) AS date, arg_max(ema10, date) AS ema10 FROM recind GROUP BY symbol"
)(lambda s, d: recursive.ema_fold(B.bars(s, d), "close", 10))


# Signals.
query(
    "e25_cross_signals",
    B.with_("bars", more=f"{IND},\n{SIG}") + f"SELECT symbol, date, {', '.join(k for k in SIGNAL_SQL if 'ma' in k and 'n_day' not in k)} FROM sig"
)(
    lambda s, d: indicator_frame(s, d, {k for k in SIGNAL_SQL}).select("symbol", "date", *[k for k in SIGNAL_SQL if "ma" in k and "n_day" not in k])
)
query(
    "e25_macd_signals",
    B.with_("bars", more=REC, recursive=True) +
    f"SELECT symbol, date, {over_sql('macd_dif', 'macd_dea')} AS signal_macd_golden, {under_sql('macd_dif', 'macd_dea')} AS "
    f"signal_macd_dead FROM recind"
)(
    lambda s, d: indicator_frame(s, d, {"signal_macd_golden", "signal_macd_dead"}).select("symbol", "date", "signal_macd_golden", "signal_macd_dead")
)
_LEVEL = ("signal_n_day_high", "signal_n_day_low", "signal_boll_breakout_upper", "signal_boll_breakdown_lower", "signal_volume_surge")
query(
    "e26_level_signals",
    B.with_("bars", more=f"{IND},\n{SIG}") + f"SELECT symbol, date, {', '.join(_LEVEL)} FROM sig"
)(lambda s, d: indicator_frame(s, d, set(_LEVEL)).select("symbol", "date", *_LEVEL))

# Generic windows.
_SPARSE = "sparse AS (SELECT symbol, date, close, CASE WHEN volume > 30 THEN close END AS x FROM bars)"


def _sparse(s, d):
    return B.bars(s, d).select("symbol", "date", "close", F.when(F.col("volume") > 30, F.col("close")).alias("x"))


query(
    "e27_valid_shift",
    B.with_("bars", more=_SPARSE) + f"SELECT symbol, date, lag(x, 2 IGNORE NULLS) OVER ({W}) AS back2, lead(x, 1 IGNORE NULLS) OVER ({W}) AS next1 FROM sparse"
)(
    lambda s, d: _sparse(s, d).select("symbol", "date", windows.valid_shift("x", 2).alias("back2"), windows.valid_shift("x", -1).alias("next1"))
)
_ROLL = {"s7": (7, "sum", "sum"), "m7": (7, "mean", "avg"), "lo7": (7, "min", "min"), "hi7": (7, "max", "max")}
query(
    "e28_rolling",
    B.with_("bars") + f"SELECT symbol, date, {', '.join(full_sql(n, a, 'close') + ' AS ' + k for k, (n, _, a) in _ROLL.items())}, "
    f"{full_sql(7, 'stddev_pop', 'close')} AS sp7, {full_sql(7, 'stddev_samp', 'close')} AS ss7 FROM bars"
)(
    lambda s, d: B.bars(s, d).select(
        "symbol",
        "date",
        *[windows.rolling("close", n, kind).alias(k) for k, (n, kind, _) in _ROLL.items()],
        windows.rolling("close", 7, "std", 0).alias("sp7"),
        windows.rolling("close", 7, "std", 1).alias("ss7")
    )
)
query(
    "e29_rolling_quantile",
    B.with_("bars") + f"SELECT symbol, date, {full_sql(10, 'quantile_cont(?, 0.8)', 'close')} AS q80 FROM bars"
)(lambda s, d: B.bars(s, d).select("symbol", "date", windows.rolling("close", 10, "quantile", q=0.8).alias("q80")))
_EWM = f"""{_SPARSE},
sp AS (SELECT *, row_number() OVER ({W}) AS rn FROM sparse),
vv AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS vn, pow(0.8::DOUBLE, rn - lag(rn) OVER ({W})) AS old FROM sp WHERE x IS NOT NULL),
rr AS (SELECT symbol, date, vn, x AS y FROM vv WHERE vn = 1
  UNION ALL SELECT n.symbol, n.date, n.vn, (n.old * r.y + 0.2::DOUBLE * n.x) / (n.old + 0.2::DOUBLE) AS y FROM rr r JOIN vv n ON n.symbol = r.symbol AND n.vn = r.vn + 1)"""
query(
    "e30_ewm_gap_decay",
    B.with_("bars", more=_EWM, recursive=True) +
    f"SELECT symbol, date, close, x, last_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "
    f"ewm FROM sp LEFT JOIN rr USING (symbol, date)"
)(lambda s, d: recursive.ewm_gap_decay(_sparse(s, d), "x", 0.2, "ewm"))
query(
    "e31_safe_divide",
    B.with_(
        "bars",
        more=f"c AS (SELECT symbol, date, close - {lag_sql('close')} AS step, amount FROM bars)"
    ) + "SELECT symbol, date, amount / nullif(round(step, 6), 0) AS r FROM c",
    2
)(
    lambda s, d: B.bars(s, d).select(
        "symbol",
        "date",
        "amount",
        F.round(F.col("close") - windows.lag("close"), 6).alias("step")
    ).select("symbol", "date", windows.safe_divide(F.col("amount"), F.col("step")).alias("r"))
)

# Adjustment and limits.
ADJ = f"""ev AS (SELECT symbol, trade_date, max(ex_factor) AS f FROM factors GROUP BY 1, 2),
cum AS (SELECT symbol, trade_date, product(f) OVER (PARTITION BY symbol ORDER BY trade_date) AS cum FROM ev),
tot AS (SELECT symbol, product(f) AS total FROM ev GROUP BY 1),
adj0 AS (SELECT b.*, coalesce(c.cum, 1.0::DOUBLE) / coalesce(t.total, 1.0::DOUBLE) AS adj_ratio, e.symbol IS NOT NULL AS ex_rights
  FROM bars b ASOF LEFT JOIN cum c ON b.symbol = c.symbol AND b.date >= c.trade_date LEFT JOIN tot t ON t.symbol = b.symbol LEFT JOIN ev e ON e.symbol = b.symbol AND e.trade_date = b.date),
adj AS (SELECT symbol, date, open * adj_ratio AS open, high * adj_ratio AS high, low * adj_ratio AS low, close * adj_ratio AS close, volume, amount, close AS raw_close, high AS raw_high, low AS raw_low, adj_ratio, ex_rights FROM adj0)"""
_CENTS = lambda p, k: f"((floor({p} * 100 + 0.5)::BIGINT * ({k}) + 50) // 100)::DOUBLE / 100"
_SHARE = (
    "CASE WHEN left(symbol, 3) IN ('300', '301', '688', '689') THEN 20 WHEN symbol LIKE '%.BJ' THEN 30 WHEN regexp_matches(name, "
    "'(?i)ST|退') THEN 5 ELSE 10 END"
)
LIM = f"""lim0 AS (SELECT a.*, i.name, i.type, i.float_shares, i.total_shares, i.dim_limit_up, i.dim_limit_down FROM adj a LEFT JOIN instruments i USING (symbol)),
lim1 AS (SELECT *, CASE WHEN abs(adj_ratio - {lag_sql('adj_ratio')}) > 1e-6 THEN {lag_sql('close')} ELSE {lag_sql('raw_close')} END AS prev_ref_close, {_SHARE} AS pct FROM lim0),
lim2 AS (SELECT *, date = max(date) OVER () AND dim_limit_up < 10000 AS use_up, date = max(date) OVER () AND dim_limit_down < 10000 AS use_down FROM lim1),
lim3 AS (SELECT * EXCLUDE (pct, use_up, use_down), CASE WHEN use_up THEN dim_limit_up ELSE {_CENTS('prev_ref_close', '100 + pct')} END AS limit_up, CASE WHEN use_down THEN dim_limit_down ELSE {_CENTS('prev_ref_close', '100 - pct')} END AS limit_down FROM lim2),
lim4 AS (SELECT *, raw_close >= limit_up - 0.005 AS signal_limit_up, raw_close <= limit_down + 0.005 AS signal_limit_down FROM lim3),
lim5 AS (SELECT *, (low <= limit_down + 0.005) AND NOT coalesce(signal_limit_down, false) AND close > open AS signal_limit_down_recovery, (raw_high >= limit_up - 0.005) AND NOT coalesce(signal_limit_up, false) AS signal_broken_limit_up,
  row_number() OVER ({W}) AS rn FROM lim4),
lim AS (SELECT * EXCLUDE (rn), (rn - coalesce(max(CASE WHEN NOT coalesce(signal_limit_up, false) THEN rn END) OVER ({W}), 0))::INTEGER AS consecutive_limit_ups,
  (rn - coalesce(max(CASE WHEN NOT coalesce(signal_limit_down, false) THEN rn END) OVER ({W}), 0))::INTEGER AS consecutive_limit_downs FROM lim5)"""
LIMITS = B.with_("bars", "factors", "instruments", more=f"{ADJ},\n{LIM}")


def adjusted(spark, sf_dir):
    return limits.adjust_prices(B.bars(spark, sf_dir), B.factors(spark, sf_dir))


def limit_frame(spark, sf_dir):
    dims = B.instruments(spark, sf_dir).select("symbol", "name", "type", "float_shares", "total_shares", "dim_limit_up", "dim_limit_down")
    return limits.with_limits(adjusted(spark, sf_dir).join(dims, "symbol", "left"), newest=B.newest_date(spark, sf_dir))


query(
    "j01_adjust_prices",
    B.with_("bars", "factors", more=ADJ) + "SELECT symbol, date, open, high, low, close, raw_close, adj_ratio, ex_rights FROM adj"
)(
    lambda s, d: adjusted(s, d).select("symbol", "date", "open", "high", "low", "close", "raw_close", "adj_ratio", "ex_rights")
)
query(
    "e17_ex_rights",
    B.with_("bars", "factors", more=ADJ) + "SELECT symbol, date FROM adj WHERE ex_rights"
)(lambda s, d: adjusted(s, d).filter("ex_rights").select("symbol", "date"))
query(
    "e32_cum_factor",
    B.with_(
        "factors",
        more="ev AS (SELECT symbol, trade_date, max(ex_factor) AS f FROM factors GROUP BY 1, 2)"
    ) + "SELECT symbol, trade_date, product(f) OVER (PARTITION BY symbol ORDER BY trade_date) AS cum FROM ev"
)(
    lambda s, d: B.factors(s, d).groupBy("symbol", F.col("trade_date").alias("date")).agg(F.max("ex_factor").alias("f")).select(
        "symbol",
        F.col("date").alias("trade_date"),
        F.product("f").over(windows.so_far()).alias("cum")
    )
)
_LIMIT_COLS = (
    "prev_ref_close",
    "limit_up",
    "limit_down",
    "signal_limit_up",
    "signal_limit_down",
    "signal_limit_down_recovery",
    "signal_broken_limit_up",
    "consecutive_limit_ups",
    "consecutive_limit_downs"
)
query(
    "e18_e24_limits",
    LIMITS + f"SELECT symbol, date, {', '.join(_LIMIT_COLS)} FROM lim"
)(lambda s, d: limit_frame(s, d).select("symbol", "date", *_LIMIT_COLS))
query(
    "e16_turnover_rate",
    B.with_("bars", "instruments") + "SELECT symbol, date, CASE WHEN float_shares > 0 THEN volume * 10000 / float_shares END AS turnover_rate FROM bars LEFT JOIN "
    "instruments USING (symbol)"
)(
    lambda s, d: with_instruments(B.bars(s, d), B.instruments(s, d), ["float_shares"]).select(
        "symbol",
        "date",
        limits.turnover_rate(F.col("volume"), F.col("float_shares")).alias("turnover_rate")
    )
)

# Cross-section and forward looks.
def settled(df):
    """Amounts to six digits: a sum's last bits depend on the order of its rows, so that equal amounts would not tie."""
    return df.withColumn("amount", F.round("amount", 6))


query(
    "e33_rank_in_date",
    B.with_("bars") + "SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY amount DESC, symbol)::INTEGER AS pos, rank() OVER "
    "(PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS avg_rank FROM bars"
)(
    lambda s, d: settled(B.bars(s, d)).select("symbol", "date", rank_of("amount").alias("pos"), average_rank("volume", ["date"]).alias("avg_rank"))
)
query(
    "e34_qcut_in_date",
    B.with_(
        "bars",
        more="q AS (SELECT date, quantile_cont(amount, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM bars GROUP BY date)"
    ) + "SELECT symbol, b.date, len(list_filter(cuts, lambda x: b.amount > x))::INTEGER AS bin FROM bars b JOIN q ON q.date = b.date"
)(
    lambda s, d: B.bars(s, d).select("symbol", "date", qcut_in_date("amount", 5).alias("bin"))
)
query(
    "e35_bucket_in_date",
    B.with_("bars") + "SELECT symbol, date, (floor((row_number() OVER (PARTITION BY date ORDER BY amount, symbol) - 1) * 5 / count(*) OVER "
    "(PARTITION BY date)) + 1)::INTEGER AS bucket FROM bars"
)(
    lambda s, d: settled(B.bars(s, d)).select("symbol", "date", bucket_in_date("amount", 5, ["date"]).alias("bucket"))
)


def minmax_sql(weights: dict[str, float], universe: str | None = None) -> str:
    total, parts = sum(weights.values()), []
    for c, w in weights.items():
        v = f"CASE WHEN {universe} THEN {c} END" if universe else c
        low, high = f"min({v}) OVER (PARTITION BY date)", f"max({v}) OVER (PARTITION BY date)"
        one = f"CASE WHEN {high} > {low} THEN ({c} - {low}) / ({high} - {low}) ELSE 0.5::DOUBLE END"
        parts.append(f"({f'CASE WHEN {universe} THEN {one} ELSE 0.0::DOUBLE END' if universe else one}) * {w / total!r}::DOUBLE")
    return f"coalesce(({' + '.join(parts)}) * 100, 0.0::DOUBLE)"


_SCORE = {"vol_ratio_5d": 0.4, "change_pct": 0.3, "momentum_20d": 0.3}
query("e36_minmax_score", B.with_("bars", more=IND) + f"SELECT symbol, date, {minmax_sql(_SCORE, '(amount > 30000)')} AS score FROM ind")(
    lambda s, d: indicator_frame(s, d, set(_SCORE)).select("symbol", "date", K.minmax_score(_SCORE, F.col("amount") > 30000).alias("score"))
)
query("e37_drawdown", B.with_("bars") + f"SELECT symbol, date, close / max(close) OVER ({W}) - 1 AS dd FROM bars")(
    lambda s, d: B.bars(s, d).select("symbol", "date", (F.col("close") / F.max("close").over(windows.so_far()) - 1).alias("dd"))
)
query("e38_compound_nav", B.with_("bars", more=IND) + f"SELECT symbol, date, exp(sum(ln(1 + change_pct / 10000)) OVER ({W})) AS nav FROM ind")(
    lambda s, d: indicator_frame(s, d, {"change_pct"}).select(
        "symbol",
        "date",
        compound(F.col("change_pct") / 10000, windows.by_symbol()).alias("nav")
    )
)
query(
    "e39_forward_return",
    B.with_("bars") + f"SELECT symbol, date, lead(close, 5) OVER ({W}) / nullif(close, 0) - 1 AS fwd FROM bars"
)(lambda s, d: B.bars(s, d).select("symbol", "date", forward_return(5).alias("fwd")))
query(
    "e40_delay_signal",
    B.with_(
        "bars",
        more="f AS (SELECT symbol, date, close > open AS up FROM bars)"
    ) + f"SELECT symbol, date, coalesce(lag(up, 2) OVER ({W}), false) AS up_delayed, CASE WHEN lag(up, 2) OVER ({W}) THEN lag(date, "
    f"2) OVER ({W}) END AS up_source_date FROM f"
)(
    lambda s, d: delay_signal(B.bars(s, d).select("symbol", "date", (F.col("close") > F.col("open")).alias("up")), "up", 2).drop("up")
)
query(
    "e41_first_signal",
    B.with_("bars", more=f"{IND},\n{SIG}") +
    "SELECT symbol, date, CASE WHEN signal_volume_surge THEN 'signal_volume_surge' WHEN signal_n_day_high THEN "
    "'signal_n_day_high' WHEN signal_ma5_breakout THEN 'signal_ma5_breakout' END AS first_signal FROM sig"
)(
    lambda s, d: indicator_frame(s, d, {"signal_volume_surge", "signal_n_day_high", "signal_ma5_breakout"}).select(
        "symbol",
        "date",
        first_signal_id(["signal_volume_surge", "signal_n_day_high", "signal_ma5_breakout"]).alias("first_signal")
    )
)
query(
    "s28_table_profile",
    B.with_("bars") + "SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT symbol) AS symbols, count(DISTINCT "
    "date) AS dates FROM bars"
)(lambda s, d: table_profile(B.bars(s, d)))


# Strategies: one wide frame, in Spark and in SQL.
def strategy_frame(spark, sf_dir, needed=None):
    """Adjusted bars with limits, shares and all indicators."""
    df = limit_frame(spark, sf_dir)
    df = df.withColumn("turnover_rate", limits.turnover_rate(F.col("volume"), F.col("float_shares")))
    return I.with_indicators(df, needed)


WIDE = f"""{ADJ},
{LIM},
wide1 AS (SELECT *, CASE WHEN float_shares > 0 THEN volume * 10000 / float_shares END AS turnover_rate, {', '.join(f'{v} AS {k}' for k, v in WINDOW_SQL.items())} FROM lim),
wide AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in DERIVED_SQL.items())} FROM wide1)"""
_BD = under_sql("close", "ma20")
_DEAD = under_sql("ma5", "ma20")
_VOL, _CHG, _CANDLE, _RISING = "vol_ratio_5d >= {vol_ratio_min}::DOUBLE", "change_pct > {min_change}::DOUBLE / 100", "close > open", "momentum_20d > 0"
_NEAR = "(close > ma20 * (1 - {{ma_proximity}}::DOUBLE{0}) AND close < ma20 * (1 + {{ma_proximity}}::DOUBLE{0}))"
_OWN = (
    "CASE WHEN left(symbol, 3) IN ('300', '301', '688') THEN 0.20::DOUBLE WHEN symbol LIKE '%.BJ' THEN 0.30::DOUBLE WHEN "
    "contains(upper(coalesce(name, '')), 'ST') THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END"
)
_BOARDS = "consecutive_limit_ups >= {min_boards}"
#: Per strategy: the condition that each parameter switches, and the exit.
STRATEGY_SQL = {
    "boll_breakout": ({"require_boll_breakout": "close > boll_upper", "use_volume_filter": _VOL}, "close < boll_lower"),
    "broken_board_recovery": (
        {"require_limit_up": "signal_limit_up", "use_volume_filter": _VOL, "use_change_filter": "change_pct > {change_pct_min}::DOUBLE"},
        _BD
    ),
    "bullish_alignment": (
        {"require_ma_alignment": "(ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60)", "require_positive_momentum": _RISING},
        f"({_DEAD} OR {_BD})"
    ),
    "consecutive_limit_ups": ({"require_limit_up": "signal_limit_up", "use_boards_filter": _BOARDS}, "false"),
    "high_turnover_surge": ({"use_turnover_filter": "turnover_rate > {min_turnover}::DOUBLE", "use_change_filter": _CHG}, _BD),
    "limit_up_momentum": ({"use_change_filter": _CHG, "use_boards_filter": _BOARDS}, "false"),
    "low_volatility_leader": (
        {"require_positive_momentum": _RISING, "use_volatility_filter": "annual_vol_20d < {vol_max}::DOUBLE", "require_above_ma20": "close > ma20"},
        _BD
    ),
    "ma_golden_cross": ({"require_ma_golden": over_sql("ma5", "ma20"), "use_volume_filter": _VOL, "require_above_ma60": "close > ma60"}, _DEAD),
    "macd_golden": ({"require_macd_golden": over_sql("macd_dif", "macd_dea"), "use_volume_filter": _VOL}, under_sql("macd_dif", "macd_dea")),
    "n_day_low_reversal": ({"require_n_day_low": "close <= low_60d", "require_bullish_candle": _CANDLE, "use_volume_filter": _VOL}, _BD),
    "near_limit_up": ({"use_change_filter": _CHG, "use_limit_gap_filter": f"change_pct < {_OWN} - {{limit_gap}}::DOUBLE / 100"}, _BD),
    "oversold_bounce": ({"use_rsi_filter": "rsi_14 < {rsi_max}::DOUBLE", "require_bullish_candle": _CANDLE, "use_volume_filter": _VOL}, _BD),
    "oversold_reversal": ({"use_rsi_filter": "rsi_14 < {rsi_max}::DOUBLE", "use_change_filter": _CHG, "require_above_ma5": "close > ma5"}, _BD),
    "pullback_ma20_bounce": (
        {
            "use_ma20_proximity": _NEAR.format(" * 0.01::DOUBLE"),
            "require_ma_alignment": "(ma5 > ma20 AND ma20 > ma60)",
            "require_positive_change": "change_pct > 0"
        },
        f"({_BD} OR {_DEAD})"
    ),
    "pullback_to_support": (
        {
            "use_ma20_proximity": _NEAR.format(""),
            "use_volume_filter": "vol_ratio_5d < {vol_ratio_max}::DOUBLE",
            "require_above_ma60": "close > ma60",
            "require_positive_momentum": _RISING
        },
        _BD
    ),
    "strong_open": (
        {
            "use_open_gap_filter": f"open > {lag_sql('close')} * (1 + {{min_open_gap}}::DOUBLE / 100)",
            "require_close_above_open": _CANDLE,
            "use_change_filter": _CHG
        },
        _BD
    ),
    "trend_breakout": ({"require_above_ma60": "close > ma60", "require_n_day_high": "close >= high_60d", "use_volume_filter": _VOL}, _BD),
    "volume_price_surge": ({"require_ma20_breakout": over_sql("close", "ma20"), "use_volume_filter": _VOL, "require_bullish_candle": _CANDLE}, _BD),
}
#: The panel's prices and amounts lie outside the default bounds, so queries give bounds of its own size, by strategy.
PANEL_BASIC = {
    "trend_breakout": {"price_min": 1100, "price_max": 60000, "market_cap_min": 20e8, "amount_min": 2e4, "exclude_st": True, "exclude_new_days": 60}
}
_BASIC_SQL = {
    "trend_breakout": f"close >= 1100 AND close <= 60000 AND close * total_shares >= 2e9 AND amount >= 20000 AND NOT regexp_matches(name, '(?i)ST|退') "
    f"AND row_number() OVER ({W}) > 60"
}
#: Its volatility is a hundred times that of shares, so the default bound would leave no row.
PANEL_PARAMS = {"low_volatility_leader": {"vol_max": 30.0}}


def entry_sql(id_: str, params: dict | None = None) -> str:
    """A strategy's entry with these parameters instead of its defaults."""
    s = K.REGISTRY[id_]
    p = s.params | (params or {})
    own = [rule.format(**p) for switch, rule in STRATEGY_SQL[id_][0].items() if p[switch]]
    own += [_BASIC_SQL[id_]] if id_ in _BASIC_SQL else []
    return " AND ".join([*own, f"type IN ({', '.join(repr(x) for x in s.asset_types)})"])


_RECURSIVE = {"macd_golden", "oversold_bounce", "oversold_reversal"}
_DIMS = [
    "symbol",
    "date",
    "name",
    "type",
    "total_shares",
    "float_shares",
    "open",
    "close",
    "amount",
    "turnover_rate",
    "signal_limit_up",
    "consecutive_limit_ups"
]


def strategy_needs(s: K.Strategy) -> set[str]:
    """What a strategy reads, whatever its parameters."""
    text = " ".join([*STRATEGY_SQL[s.id][0].values(), STRATEGY_SQL[s.id][1]])
    return {c for c in I.ALL if c in text} | set(s.scoring) | set(_DIMS)


def _with_rec(sql_tail: str, rec: bool) -> str:
    if not rec:
        return B.with_("bars", "factors", "instruments", more=WIDE) + sql_tail.replace("$WIDE", "wide")
    chain = REC.replace("FROM bars)", "FROM adj)")
    return B.with_(
        "bars",
        "factors",
        "instruments",
        more=f"{WIDE},\n{chain},\nboth_ AS (SELECT w.*, r.macd_dif, r.macd_dea, r.rsi_14 FROM wide w JOIN recind r USING (symbol, date))",
        recursive=True
    ) + sql_tail.replace("$WIDE", "both_")


def _register(name: str, s: K.Strategy, params: dict | None) -> None:
    entry, basic = entry_sql(s.id, params), PANEL_BASIC.get(s.id, {})
    tail = (
        f"SELECT symbol, date, score, exit FROM (SELECT *, {minmax_sql(s.scoring, 'entry')} AS score FROM "
        f"(SELECT *, coalesce({entry}, false) AS entry, coalesce({STRATEGY_SQL[s.id][1]}, false) AS exit FROM $WIDE) AS e) AS x WHERE entry"
    )
    query(name, _with_rec(tail, s.id in _RECURSIVE), 4)(
        lambda spark, d: K.picks(strategy_frame(spark, d, strategy_needs(s)), s, params, basic).select("symbol", "date", "score", "exit")
    )


def other_params(s: K.Strategy) -> dict:
    """A strategy's parameters with its first condition switched off and its numbers moved."""
    moved = {k: v * (2 if isinstance(v, int) else 0.75) for k, v in s.params.items() if not isinstance(v, bool)}
    return {next(iter(s.entry)): False, **moved}


for _k, _s in enumerate(K.REGISTRY.values(), 1):
    _register(f"k{_k:02d}_{_s.id}", _s, PANEL_PARAMS.get(_s.id))
    _register(f"k{_k:02d}_{_s.id}_params", _s, other_params(_s))

_EACH = " UNION ALL ".join(
    f"SELECT '{i}' AS strategy, symbol, date FROM (SELECT *, ({entry_sql(i)}) AS entry FROM $WIDE) AS q WHERE entry" for i in STRATEGY_SQL
)
query("k19_run_all", _with_rec(f"SELECT strategy, symbol, date FROM ({_EACH}) AS u", True))(
    lambda s, d: K.run_all(strategy_frame(s, d, set().union(*[strategy_needs(x) for x in K.REGISTRY.values()])), basic=PANEL_BASIC)
)


@query(
    "k20_user_strategy",
    B.with_("bars", more=IND) + "SELECT * EXCLUDE (prev_close) FROM (SELECT symbol, date, open, high, low, close, volume, amount, amplitude, prev_close FROM "
    "ind) AS t WHERE amplitude > 0.3"
)
def _user(spark, sf_dir):
    K.register("wide_range", lambda df, p: df.filter(F.col("amplitude") > p.get("least", 0.2)))
    return K.run_user("wide_range", indicator_frame(spark, sf_dir, {"amplitude"}), {"least": 0.3})


@query("first_slice_ma_golden_ranked", None, 4)
def flagship(spark, sf_dir):
    """The newest day's golden crosses, scored and ranked."""
    s = K.REGISTRY["ma_golden_cross"]
    return K.rank_result(K.picks(strategy_frame(spark, sf_dir, strategy_needs(s)), s, basic={}), s).select("symbol", "date", "close", "score")
