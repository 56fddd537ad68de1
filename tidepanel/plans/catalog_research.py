"""Queries: factor research, levels, trade labelling, sweeps and folds."""

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import factor as Q
from ..operators import levels as L
from ..operators import trades as T
from ..operators.indicators import with_indicators
from ..operators.limits import turnover_rate
from ..operators.breadth import latest_periods
from . import bindings as B
from . import strategies as K
from .catalog import query
from .catalog_indicators import IND, REC, W, WIDE, adjusted, entry_sql, full_sql, indicator_frame, lag_sql, minmax_sql, strategy_frame, strategy_needs
from .catalog_io import scratch

bars = B.bars


def panel(s, d):
    """Brand bars with indicators: 25 symbols with long series."""
    return with_indicators(B.brand_bars(s, d), {"momentum_20d", "change_pct", "ma5", "ma20", "vol_ratio_5d", "amplitude"})


PIND = IND.replace("FROM bars)", "FROM brand_bars)")
_REB = {
    "daily": "SELECT DISTINCT date FROM brand_bars",
    "weekly": "SELECT DISTINCT date FROM brand_bars WHERE isodow(date) = 1",
    "monthly": "SELECT min(date) AS date FROM brand_bars GROUP BY date_trunc('month', date)",
}


def ret_sql(freq: str) -> str:
    return f"reb AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM ({_REB[freq]})), pr AS (SELECT b.symbol, b.date, r.next_date, n.close / nullif(b.close, 0) - 1 AS ret FROM brand_bars b JOIN reb r USING (date) LEFT JOIN brand_bars n ON n.symbol = b.symbol AND n.date = r.next_date)"


for _f in _REB:
    query(f"q01_calendar_{_f}", B.with_("brand_bars") + _REB[_f])(lambda s, d, f=_f: Q.rebalance_calendar(B.brand_bars(s, d), f))
    query(
        f"q02_period_return_{_f}",
        B.with_("brand_bars", more=ret_sql(_f)) + "SELECT symbol, date, ret FROM pr"
    )(lambda s, d, f=_f: Q.period_return(B.brand_bars(s, d), f).select("symbol", "date", "ret"))


def factor_rows(s, d, freq="daily", name="momentum_20d"):
    p = panel(s, d)
    return p.select("symbol", "date", F.col(name).alias("factor")).join(Q.period_return(p, freq).select("symbol", "date", "ret"), ["symbol", "date"])


_FR = PIND + ",\n" + ret_sql("daily") + ",\nfr AS (SELECT i.symbol, i.date, i.momentum_20d AS factor, p.ret FROM ind i JOIN pr p USING (symbol, date))"
_AVR = lambda c, k: f"rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0::DOUBLE"
_CORR = "round((avg(a * b) - avg(a) * avg(b)) / nullif(sqrt(greatest((avg(a * a) - avg(a) * avg(a)) * (avg(b * b) - avg(b) * avg(b)), 0.0)), 0), 4)"
IC = (
    f"rk AS (SELECT date, {_AVR('factor', 'date')} AS a, {_AVR('ret', 'date')} AS b FROM fr WHERE factor IS NOT NULL AND ret IS "
    f"NOT NULL), ic AS (SELECT date, {_CORR} AS ic, count(*) AS n FROM rk GROUP BY date)"
)
query("q03_rank_ic", B.with_("brand_bars", more=f"{_FR}, {IC}") + "SELECT * FROM ic")(lambda s, d: Q.rank_ic(factor_rows(s, d)))
query(
    "q04_ic_summary",
    B.with_("brand_bars", more=f"{_FR}, {IC}") +
    "SELECT avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, count_if(ic > 0) / count(ic)::DOUBLE AS win_rate, count(ic) AS periods, "
    "avg(ic) / nullif(stddev_pop(ic), 0) AS ir FROM ic",
    4
)(lambda s, d: Q.ic_summary(Q.rank_ic(factor_rows(s, d))))
_BUCKET = "(floor((row_number() OVER (PARTITION BY date ORDER BY factor, symbol) - 1) * 5 / count(*) OVER (PARTITION BY date)) + 1)::INTEGER"
# Returns of this made-up panel are hundreds of percent; a ten-thousandth of them keeps the curves in range.
NAV = (
    f"bk AS (SELECT symbol, date, factor, ret / 10000 AS ret, {_BUCKET} AS grp FROM fr WHERE factor IS NOT NULL AND ret IS NOT "
    f"NULL), gm AS (SELECT date, grp, avg(ret) AS ret FROM bk GROUP BY 1, 2), nav AS (SELECT date, grp, ret, round(exp(sum(ln(1 "
    f"+ ret)) OVER (PARTITION BY grp ORDER BY date)), 4) AS nav FROM gm)"
)
_NAVQ = B.with_("brand_bars", more=f"{_FR}, {NAV}")


def navs(s, d):
    return Q.group_nav(factor_rows(s, d).withColumn("ret", F.col("ret") / 10000))


query("q05_group_nav", _NAVQ + 'SELECT date, grp AS "group", ret, nav FROM nav')(navs)
_FIG = lambda v, keys, start=", 1.0": f"""st AS (SELECT {keys}, date, {v} AS v, {v} / greatest(max({v}) OVER (PARTITION BY {keys} ORDER BY date), 1.0) - 1 AS dd, {v} / nullif(coalesce(lag({v}) OVER (PARTITION BY {keys} ORDER BY date){start}), 0) - 1 AS r FROM $T)"""
_YEARS = "greatest((max(date) - min(date)) / 365.25::DOUBLE, 1 / 365.25::DOUBLE)"
query(
    "q06_group_stats",
    _NAVQ.rstrip() + ", " + _FIG("nav", "grp", "").replace("$T", "nav") +
    f'\nSELECT grp AS "group", arg_max(v, date) - 1 AS total_return, pow(greatest(arg_max(v, date), 1e-9), 1 / {_YEARS}) - 1 AS '
    f'annual_return, min(dd) AS max_drawdown, coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 0.0) AS sharpe, coalesce(count_if(r > 0) / '
    f'nullif(count(r), 0)::DOUBLE, 0.0) AS win_rate FROM st GROUP BY grp',
    2
)(lambda s, d: Q.group_stats(navs(s, d), "daily"))
query(
    "q07_long_short",
    _NAVQ.rstrip() + ", " + _FIG("nav", "grp").replace("$T", "nav") +
    ", p AS (SELECT date, (max(CASE WHEN grp = 5 THEN r END) - max(CASE WHEN grp = 1 THEN r END)) / 2 AS ret FROM st GROUP BY "
    "date), q AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS nav FROM p WHERE ret IS NOT NULL)\nSELECT *, "
    "nav / greatest(max(nav) OVER (ORDER BY date), 1.0) - 1 AS drawdown FROM q",
    4
)(lambda s, d: Q.long_short(navs(s, d), 5))
_CAT = ", ".join(Q.FACTORS)
PREC = REC.replace("FROM bars)", "FROM brand_bars)")


def factor_panel(s, d):
    """Brand bars with all factors; every brand has a million shares."""
    bars = B.brand_bars(s, d).withColumn("turnover_rate", turnover_rate(F.col("volume"), F.lit(1e6)))
    return with_indicators(bars, set(Q.FACTORS) - {"turnover_rate"})


_ALL_FACTORS = f"""{PIND},
{PREC},
af AS (SELECT i.*, volume * 10000 / 1e6::DOUBLE AS turnover_rate, r.* EXCLUDE (symbol, date) FROM ind i JOIN recind r USING (symbol, date)),
{ret_sql("weekly")},
lg AS (UNPIVOT (SELECT symbol, date, {_CAT} FROM af) ON {_CAT} INTO NAME factor_name VALUE factor),
fr AS (SELECT l.factor_name, l.symbol, l.date, l.factor, p.ret FROM lg l JOIN pr p USING (symbol, date) WHERE ret IS NOT NULL AND factor IS NOT NULL)"""
_FQ = B.with_("brand_bars", more=_ALL_FACTORS, recursive=True).rstrip()
_FIC = f"""rk AS (SELECT factor_name, date, {_AVR('factor', 'factor_name, date')} AS a, {_AVR('ret', 'factor_name, date')} AS b FROM fr), ic AS (SELECT factor_name, date, {_CORR} AS ic FROM rk GROUP BY 1, 2)"""
_SUMMARY = (
    "avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, count_if(ic > 0) / count(ic)::DOUBLE AS win_rate, count(ic) AS periods, "
    "avg(ic) / nullif(stddev_pop(ic), 0) AS ir"
)
query(
    "q08_factor_catalog",
    f"{_FQ},\n{_FIC}\nSELECT factor_name, {_SUMMARY} FROM ic WHERE ic IS NOT NULL GROUP BY factor_name",
    3
)(lambda s, d: Q.factor_catalog(factor_panel(s, d), freq="weekly", bars=B.brand_bars(s, d)))
_FNAV = f"""bk AS (SELECT factor_name, date, ret / 10000 AS ret, {_BUCKET.replace("PARTITION BY date", "PARTITION BY factor_name, date")} AS grp FROM fr), gm AS (SELECT factor_name, date, grp, avg(ret) AS ret FROM bk GROUP BY ALL),
nav AS (SELECT factor_name, date, grp, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY factor_name, grp ORDER BY date)), 4) AS nav FROM gm)"""
query(
    "q08_factor_groups",
    f"{_FQ},\n{_FNAV}, " + _FIG("nav", "factor_name, grp", "").replace("$T", "nav") +
    f'\nSELECT factor_name, grp AS "group", arg_max(v, date) - 1 AS total_return, pow(greatest(arg_max(v, date), 1e-9), 1 / '
    f'{_YEARS}) - 1 AS annual_return, min(dd) AS max_drawdown, coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(52), 0.0) AS sharpe, coalesce(count_if(r '
    f'> 0) / nullif(count(r), 0)::DOUBLE, 0.0) AS win_rate FROM st GROUP BY ALL',
    2
)(
    lambda s, d: Q.factor_groups(factor_panel(s, d), freq="weekly", scale=1e-4, bars=B.brand_bars(s, d))
)

# Levels.
_LAST = "lastb AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"


def level_sql(kind: str, values: dict[str, str], source: str, strength: str | dict[str, str] = "medium") -> str:
    of = lambda k: strength if isinstance(strength, str) else strength[k]
    return " UNION ALL ".join(
        f"SELECT symbol, '{kind}' AS type, '{k}' AS label, ({v})::DOUBLE AS value, '{of(k)}' AS strength FROM {source} WHERE ({v}) IS NOT NULL" for k,
        v in values.items()
    )


_P = "((high + low + close) / 3)"
_PIV = {
    "P": _P,
    "R1": f"2 * {_P} - low",
    "S1": f"2 * {_P} - high",
    "R2": f"{_P} + (high - low)",
    "S2": f"{_P} - (high - low)",
    "R3": f"high + 2 * ({_P} - low)",
    "S3": f"low - 2 * (high - {_P})"
}
_PIV_STRENGTH = {"P": "strong", "R1": "medium", "S1": "medium", "R2": "medium", "S2": "medium", "R3": "weak", "S3": "weak"}
query("l02_pivots", B.with_("bars", more=_LAST) + level_sql("pivot", _PIV, "lastb", _PIV_STRENGTH))(lambda s, d: L.pivots(bars(s, d)))
_BACK = "bk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars)"
query(
    "l03_extremes",
    B.with_(
        "bars",
        more=f"{_BACK}, ex AS (SELECT symbol, CASE WHEN count(*) >= 60 THEN max(high) FILTER (back <= 60) END AS high_60, CASE WHEN count(*) >= 60 THEN min(low) FILTER (back <= 60) END "
        f"AS low_60, CASE WHEN count(*) >= 250 THEN max(high) FILTER (back <= 250) END AS high_250, CASE WHEN count(*) >= 250 THEN min(low) FILTER (back <= 250) END AS low_250 FROM bk GROUP BY symbol)"
    ) + level_sql("extreme", {c: c for c in ("high_60", "low_60", "high_250", "low_250")}, "ex", "strong")
)(lambda s, d: L.extremes(bars(s, d)))
_AROUND = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_SWING = (
    f"sw0 AS (SELECT symbol, date, CASE WHEN count(*) {_AROUND} = 11 AND high = max(high) {_AROUND} THEN high END AS top, CASE "
    f"WHEN count(*) {_AROUND} = 11 AND low = min(low) {_AROUND} THEN low END AS bottom FROM bars), sw AS (SELECT symbol, 'swing' "
    f"AS type, 'top' AS label, top AS value, 'medium' AS strength FROM sw0 WHERE top IS NOT NULL UNION ALL SELECT symbol, 'swing', "
    f"'bottom', bottom, 'medium' FROM sw0 WHERE bottom IS NOT NULL)"
)


def near_sql(source: str, tolerance: float, k: int, where: str = "true") -> str:
    """Chains of close levels as one, and the nearest ``k`` of each label."""
    w = "PARTITION BY symbol, type, label ORDER BY value"
    return f"""m0 AS (SELECT *, CASE WHEN value > lag(value) OVER ({w}) * {1 + tolerance!r}::DOUBLE OR lag(value) OVER ({w}) IS NULL THEN 1 ELSE 0 END AS st FROM {source}),
m1 AS (SELECT *, sum(st) OVER ({w}) AS run FROM m0), m2 AS (SELECT symbol, type, label, max(value) AS value, max(strength) AS strength FROM m1 GROUP BY symbol, type, label, run),
m3 AS (SELECT m2.*, l.close, CASE WHEN value > l.close * 1.001 THEN 'resistance' WHEN value < l.close * 0.999 THEN 'support' ELSE 'near' END AS side FROM m2 JOIN lastb l USING (symbol)),
m4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, type, label ORDER BY round(abs(value - close), 6), value)::INTEGER AS rank FROM m3 WHERE {where})
SELECT symbol, type, label, value, strength, side, rank FROM m4 WHERE rank <= {k}"""


#: Tops above the close and bottoms below it.
_OUTSIDE = "(label = 'top' AND side = 'resistance') OR (label = 'bottom' AND side = 'support')"
_NEAR_COLS = ("symbol", "type", "label", "value", "strength", "side", "rank")
query("l04_swing_points", B.with_("bars", more=_SWING) + "SELECT * FROM sw")(lambda s, d: L.swing_points(bars(s, d)))
query("l04_swings", B.with_("bars", more=f"{_LAST}, {_SWING}, " + near_sql("sw", 0.01, 2, _OUTSIDE)))(lambda s, d: L.swings(bars(s, d)).select(*_NEAR_COLS))
query(
    "l05_bollinger",
    B.with_(
        "bars",
        more=IND + ", li AS (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"
    ) + level_sql("bollinger", {"upper": "boll_upper", "mid": "ma20", "lower": "boll_lower"}, "li")
)(lambda s, d: L.bands(indicator_frame(s, d, {"ma20", "boll_upper", "boll_lower"})))
_ATR = REC + f", atr AS (SELECT b.*, a.atr_14, {', '.join(full_sql(n, 'avg', 'close') + f' AS m{n}' for n in (20, 60, 120))} FROM bars b JOIN recind a USING (symbol, date)), la AS (SELECT * FROM atr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"
_KEL = {
    f"{name}_{side}": f"m{n} {sign} {k} * atr_14" for name,
    n,
    k in (("short", 20, 2.0), ("mid", 60, 2.5), ("long", 120, 3.0)) for side,
    sign in (("upper", "+"), ("lower", "-"))
}
query(
    "l06_keltner",
    B.with_("bars", more=_ATR, recursive=True) + level_sql("keltner", _KEL, "la")
)(lambda s, d: L.keltner(indicator_frame(s, d, {"atr_14"} | set(bars(s, d).columns))))
query(
    "l07_atr_bands",
    B.with_("bars", more=_ATR, recursive=True) + level_sql(
        "atr",
        {f"{side}{k}": f"close {side} {k} * atr_14" for k in (1.5, 2.0) for side in ("+", "-")},
        "la",
        {"+1.5": "weak", "-1.5": "weak", "+2.0": "medium", "-2.0": "medium"}
    )
)(lambda s, d: L.atr_bands(indicator_frame(s, d, {"atr_14"} | set(bars(s, d).columns))))
_GAP = f"""gb AS (SELECT *, {lag_sql('high')} AS ph, {lag_sql('low')} AS pl, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
gg AS (SELECT symbol, date, back, CASE WHEN low > ph THEN 'up' WHEN high < pl THEN 'down' END AS label, CASE WHEN low > ph THEN ph ELSE high END AS lo, CASE WHEN low > ph THEN low ELSE pl END AS hi FROM gb WHERE back < 120 AND (low > ph OR high < pl)),
gp AS (SELECT symbol, 'gap' AS type, label, (lo + hi) / 2 AS value, 'medium' AS strength, date FROM gg g WHERE NOT EXISTS (SELECT 1 FROM gb x WHERE x.symbol = g.symbol AND x.back < g.back AND x.low <= g.hi AND x.high >= g.lo))"""
query(
    "l08_open_gaps",
    B.with_("bars", more=_GAP) + "SELECT symbol, date, label, value FROM gp"
)(lambda s, d: L.open_gaps(bars(s, d)).select("symbol", "date", "label", "value"))
query("l08_gaps", B.with_("bars", more=f"{_LAST}, {_GAP}, " + near_sql("gp", 0.005, 3)))(lambda s, d: L.gaps(bars(s, d)).select(*_NEAR_COLS))
_FIB = (
    f"{_BACK}, fb AS (SELECT symbol, max(high) AS h, min(low) AS l, arg_max(back, (high, back)) AS hb, arg_min(back, (low, -back)) "
    f"AS lb FROM bk WHERE back <= 120 GROUP BY symbol HAVING max(high) > min(low))"
)
query(
    "l09_fibonacci",
    B.with_("bars", more=_FIB) + level_sql(
        "fibonacci",
        {str(r): f"CASE WHEN hb < lb THEN h - (h - l) * {r}::DOUBLE ELSE l + (h - l) * {r}::DOUBLE END" for r in L.FIBONACCI},
        "fb"
    )
)(lambda s, d: L.fibonacci(bars(s, d)))
_ROUND = (
    "rs AS (SELECT symbol, close, CASE WHEN close < 10 THEN 0.5 WHEN close < 20 THEN 1 WHEN close < 100 THEN 5 WHEN close < 500 "
    "THEN 10 ELSE 50 END::DOUBLE AS step FROM lastb WHERE close > 0), rm AS (SELECT *, m * step AS value FROM (SELECT *, "
    "unnest(generate_series(ceil(close * 0.9::DOUBLE / step)::BIGINT, floor(close * 1.1::DOUBLE / step)::BIGINT)) AS m FROM rs) "
    "q), rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(value - close), value) AS rank FROM rm)"
)
query(
    "l10_round_numbers",
    B.with_("bars", more=f"{_LAST}, {_ROUND}") + "SELECT symbol, 'round' AS type, value, 'weak' AS strength FROM rn WHERE rank <= 8 AND abs(value - close) / close >= 0.01"
)(lambda s, d: L.round_numbers(bars(s, d)).drop("label"))
query(
    "l11_nearest_summary",
    B.with_(
        "bars",
        more=f"{_LAST}, pv AS ({level_sql('pivot', _PIV, 'lastb', _PIV_STRENGTH)}), ns AS (SELECT p.*, CASE WHEN value > close * 1.001 THEN 'resistance' "
        f"WHEN value < close * 0.999 THEN 'support' ELSE 'near' END AS side, round(abs(value - close), 6) AS away FROM pv p JOIN lastb USING (symbol))"
    ) + "SELECT symbol, type, label, value, strength, side, row_number() OVER (PARTITION BY symbol, type ORDER BY away, label, "
    "value)::INTEGER AS rank FROM ns QUALIFY rank <= 2"
)(
    lambda s, d: L.nearest_summary(L.pivots(bars(s, d)), bars(s, d)).select(*_NEAR_COLS)
)
CHIP = f"""tb AS (SELECT b.*, CASE WHEN float_shares > 0 THEN volume * 10000 / float_shares END AS turnover_rate FROM bars b LEFT JOIN instruments USING (symbol)),
c0 AS (SELECT *, max(high) OVER (PARTITION BY symbol) AS hi, min(low) OVER (PARTITION BY symbol) AS lo, count(*) OVER (PARTITION BY symbol) AS n, least(greatest(coalesce(turnover_rate, 0.0), 0.0), 100.0) / 100 AS t FROM tb),
c1 AS (SELECT *, coalesce(sum(CASE WHEN t < 1 THEN ln(1 - t) ELSE 0 END) OVER w, 0.0) AS lg, coalesce(max((t >= 1)::INTEGER) OVER w, 0) AS reset FROM c0 WHERE n >= 20 AND hi > lo AND lo > 0 WINDOW w AS (PARTITION BY symbol ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT symbol, volume, lg, lo, (hi - lo) / 40 AS step, least(floor((low - lo) / ((hi - lo) / 40)), 39)::INTEGER AS a, least(floor((high - lo) / ((hi - lo) / 40)), 39)::INTEGER AS b FROM c1 WHERE reset = 0 AND volume > 0),
c3 AS (SELECT symbol, lo, step, unnest(generate_series(a, b))::INTEGER AS bin, volume / (b - a + 1) * exp(lg) AS share FROM c2),
ch AS (SELECT symbol, bin, any_value(lo) + (bin + 0.5::DOUBLE) * any_value(step) AS mid, sum(share) AS chips FROM c3 GROUP BY symbol, bin HAVING sum(share) > 0)"""


def turnover_bars(s, d):
    return strategy_frame(s, d, {"symbol"}).select(
        "symbol",
        "date",
        F.col("raw_high").alias("high"),
        F.col("raw_low").alias("low"),
        F.col("raw_close").alias("close"),
        "volume",
        "turnover_rate"
    )


query(
    "l01_chip_distribution",
    B.with_("bars", "instruments", more=CHIP) + "SELECT symbol, bin, mid, chips FROM ch"
)(lambda s, d: L.chip_distribution(turnover_bars(s, d)))
query(
    "l01_chip_levels",
    B.with_(
        "bars",
        "instruments",
        more=CHIP + ", cr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY chips DESC, bin) AS rank, avg(chips) OVER (PARTITION "
        "BY symbol) AS mean FROM ch)"
    ) + "SELECT symbol, 'chips' AS type, CASE WHEN rank = 1 THEN 'POC' ELSE 'dense' END AS label, round(mid, 2) AS value, CASE WHEN "
    "rank = 1 THEN 'strong' ELSE 'medium' END AS strength FROM cr WHERE rank = 1 OR (rank <= 3 AND chips > mean)",
    1
)(lambda s, d: L.chip_levels(turnover_bars(s, d)))


_PROFILE = {"symbol", "date", "open", "high", "low", "close", "volume", "turnover_rate", "ma20", "boll_upper", "boll_lower", "atr_14", "change_pct"}


def profile_frame(spark, sf_dir):
    """``strategy_frame`` of the profile's columns; only those go through the recursion, and no limits are worked out."""
    shares = B.instruments(spark, sf_dir).select("symbol", "float_shares")
    df = adjusted(spark, sf_dir).join(shares, "symbol", "left").withColumn("turnover_rate", turnover_rate(F.col("volume"), F.col("float_shares")))
    return with_indicators(df.select("symbol", "date", "open", "high", "low", "close", "volume", "turnover_rate"), _PROFILE)


@query("d05_stock_profile")
def _profile(spark, sf_dir):
    """The nearest levels of all families of every symbol.

    The frame that all families read is written once, its bars counted from the end, so that
    no family orders it again to find a symbol's last bars.
    """
    path = scratch(spark, "profile")
    L.counted_back(profile_frame(spark, sf_dir)).write.parquet(path)
    df = spark.read.parquet(path)
    summary = L.nearest_summary(L.all_levels(df), df).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("type", "side", "rank", F.round("value", 4).alias("value")))).alias("levels")
    )
    return L.last_bars(df).select("symbol", "date", "close", "change_pct").join(summary, "symbol", "left")


def _of(sql: str) -> str:
    """A family's SQL over the profile's frame in place of the bars."""
    return sql.replace("FROM bars b ", "FROM pb b ").replace("FROM bars", "FROM pb")


_PROFILE_SQL = {
    "pivot": level_sql("pivot", _PIV, "lastb", _PIV_STRENGTH),
    "extreme": "SELECT * FROM (" + level_sql("extreme", {c: c for c in ("high_60", "low_60", "high_250", "low_250")}, "pex", "strong") + ")",
    "bollinger": level_sql("bollinger", {"upper": "boll_upper", "mid": "ma20", "lower": "boll_lower"}, "lastb"),
    "keltner": level_sql("keltner", _KEL, "lastb"),
    "atr": level_sql("atr", {f"{side}{k}": f"close {side} {k} * atr_14" for k in (1.5, 2.0) for side in ("+", "-")}, "lastb", {"+1.5": "weak", "-1.5": "weak", "+2.0": "medium", "-2.0": "medium"}),
    "fibonacci": level_sql("fibonacci", {str(r): f"CASE WHEN hb < lb THEN h - (h - l) * {r}::DOUBLE ELSE l + (h - l) * {r}::DOUBLE END" for r in L.FIBONACCI}, "fb"),
    "round": "SELECT symbol, 'round' AS type, printf('%,.2f', value) AS label, value, 'weak' AS strength FROM rn WHERE rank <= 8 AND abs(value - close) / close >= 0.01",
    "chips": "SELECT symbol, 'chips' AS type, CASE WHEN rank = 1 THEN 'POC' ELSE 'dense' END AS label, round(mid, 2) AS value, CASE WHEN rank = 1 THEN 'strong' ELSE 'medium' END AS strength FROM cr WHERE rank = 1 OR (rank <= 3 AND chips > mean)",
    "swing": f"SELECT symbol, type, label, value, strength FROM (WITH {near_sql('sw', 0.01, 2, _OUTSIDE)})",
    "gap": f"SELECT symbol, type, label, value, strength FROM (WITH {near_sql('gp', 0.005, 3)})",
}
_PROFILE_CTES = f"""{WIDE},
{REC.replace("FROM bars)", "FROM adj)")},
pb AS (SELECT w.*, r.atr_14, {', '.join(full_sql(n, 'avg', 'w.close').replace('PARTITION BY symbol ORDER BY date', 'PARTITION BY w.symbol ORDER BY w.date') + f' AS m{n}' for n in (20, 60, 120))} FROM wide w JOIN recind r USING (symbol, date)),
{_of(_LAST)}, {_of(_BACK)},
pex AS (SELECT symbol, CASE WHEN count(*) >= 60 THEN max(high) FILTER (back <= 60) END AS high_60, CASE WHEN count(*) >= 60 THEN min(low) FILTER (back <= 60) END AS low_60,
  CASE WHEN count(*) >= 250 THEN max(high) FILTER (back <= 250) END AS high_250, CASE WHEN count(*) >= 250 THEN min(low) FILTER (back <= 250) END AS low_250 FROM bk GROUP BY symbol),
{_of(_SWING)}, {_of(_GAP)},
fb AS (SELECT symbol, max(high) AS h, min(low) AS l, arg_max(back, (high, back)) AS hb, arg_min(back, (low, -back)) AS lb FROM bk WHERE back <= 120 GROUP BY symbol HAVING max(high) > min(low)),
{_ROUND},
{CHIP.replace(CHIP[: CHIP.index("c0 AS")], "tb AS (SELECT symbol, date, high, low, close, volume, turnover_rate FROM pb)," + chr(10))},
cr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY chips DESC, bin) AS rank, avg(chips) OVER (PARTITION BY symbol) AS mean FROM ch),
lv AS ({' UNION ALL '.join(f'SELECT symbol, type, label, value, strength FROM ({q})' for q in _PROFILE_SQL.values())}),
nr AS (SELECT v.symbol, v.type, v.value, CASE WHEN v.value > close * 1.001 THEN 'resistance' WHEN v.value < close * 0.999 THEN 'support' ELSE 'near' END AS side,
  row_number() OVER (PARTITION BY v.symbol, v.type ORDER BY round(abs(v.value - close), 6), v.label, v.value)::INTEGER AS rank FROM lv v JOIN lastb USING (symbol))"""
query(
    "d05_profile_levels",
    B.with_("bars", "factors", "instruments", more=_PROFILE_CTES, recursive=True) + "SELECT l.symbol, l.date, l.close, l.change_pct, nr.type, nr.side, nr.rank, round(nr.value, 4) AS value FROM lastb l LEFT JOIN nr ON nr.symbol = l.symbol AND nr.rank <= 2",
    3
)(lambda s, d: _profile(s, d).select("symbol", "date", "close", "change_pct", F.explode_outer("levels").alias("l")).select("symbol", "date", "close", "change_pct", "l.*"))


_LAST20 = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 20"
query(
    "d05_profile_bars",
    B.with_(
        "bars",
        "factors",
        "instruments",
        more=WIDE
    ) + f"SELECT symbol, date, close, volume, turnover_rate, ma20, boll_upper, boll_lower, change_pct FROM wide {_LAST20}"
)(
    lambda s, d: L.from_end(strategy_frame(s, d, _PROFILE - {"atr_14"}), 20).select(
        "symbol",
        "date",
        "close",
        "volume",
        "turnover_rate",
        "ma20",
        "boll_upper",
        "boll_lower",
        "change_pct"
    )
)
query(
    "d05_profile_statements",
    B.with_(
        "bars",
        more="st AS (SELECT symbol, last_day(date) AS period_end, sum(amount) AS revenue FROM bars GROUP BY 1, 2)"
    ) + "SELECT symbol, period_end, revenue, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC)::INTEGER AS rank FROM st QUALIFY rank <= 2",
    2
)(
    lambda s, d: latest_periods(B.bars(s, d).groupBy("symbol", F.last_day("date").alias("period_end")).agg(F.sum("amount").alias("revenue")), 2)
)


# Trades: the strategy "ma5 above ma20 with volume" on the brand panel.
START, END, HOLD, STOP = "1996-01-01", "2000-12-31", 10, 0.3


def trade_panel(s, d, *more):
    df = panel(s, d)
    up = F.coalesce(F.col("change_pct") > 0.5, F.lit(False))
    df = df.withColumns(
        {
            "entry": F.coalesce((F.col("ma5") > F.col("ma20")) & (F.col("vol_ratio_5d") >= 1.2), F.lit(False)),
            "exit": F.coalesce(F.col("close") < F.col("ma20") * 0.8, F.lit(False)),
            "score": F.coalesce(F.col("momentum_20d"), F.lit(0.0)),
            "signal_limit_up": up,
            "signal_limit_down": F.coalesce(F.col("change_pct") < -0.6, F.lit(False))
        }
    )
    return T.prepared(
        df.select(
            "symbol",
            "date",
            "open",
            "high",
            "low",
            "close",
            "volume",
            "amount",
            "entry",
            "exit",
            "score",
            "signal_limit_up",
            "signal_limit_down",
            *more
        )
    )


_FLATBAR = "(greatest(open, high, low, close) - least(open, high, low, close) <= greatest(abs(close) * 1e-4, 0.01))"
TPANEL = f"""{PIND},
tp0 AS (SELECT symbol, date, open, high, low, close, volume, amount, coalesce(ma5 > ma20 AND vol_ratio_5d >= 1.2, false) AS entry, coalesce(close < ma20 * 0.8::DOUBLE, false) AS exit, coalesce(momentum_20d, 0.0) AS score,
  coalesce(change_pct > 0.5, false) AS up, coalesce(change_pct < -0.6, false) AS dn FROM ind),
tp AS (SELECT *, (open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT (volume = 0 AND {_FLATBAR})) AS tradable, {_FLATBAR} AND up AS stuck_up, {_FLATBAR} AND dn AS stuck_dn,
  row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY symbol) AS last_n FROM tp0)"""


def entries_sql(opened: bool = False) -> str:
    """Candidate entries, why they are refused, and those that stay (a low score is no reason here)."""
    flag, price = (f"coalesce(lag(entry) OVER ({W}), false)", "open") if opened else ("entry", "close")
    return f"""en0 AS (SELECT * EXCLUDE (filled), {price} AS entry_price FROM (SELECT *, {flag} AS filled FROM tp) AS f WHERE filled AND date BETWEEN DATE '{START}' AND DATE '{END}'),
en1 AS (SELECT *, CASE WHEN NOT tradable THEN 'suspended' WHEN NOT coalesce(entry_price > 0, false) THEN 'bad_price' WHEN stuck_up THEN 'limit_up' WHEN score < -0.5 THEN 'score' END AS why FROM en0),
en AS (SELECT * FROM en1 WHERE why IS NULL OR why = 'score')"""


TBARS, TPANEL = TPANEL, f"{TPANEL},\n{entries_sql()}"


def label_sql(trials: str, opened: bool = False, entries: str = "en", takes: str = "true") -> str:
    """Exits of every trial (``tg``: trial_id, variant, hold, stop, take, trail, ps, pt) by trying bar after bar, and their deferral and costs."""
    exit_, at = (f"coalesce(lag(exit) OVER ({W}), false)", "open") if opened else ("exit", "close")
    return f"""tg(trial_id, variant, hold, stop, take, trail, ps, pt) AS ({trials}),
xb AS (SELECT symbol, n, date, open, high, low, close, {at} AS px, {exit_} AS exit, last_n, tradable AND NOT stuck_dn AS sellable FROM tp),
jx AS (SELECT e.*, b.n AS bn, b.date AS bd, b.open AS bo, b.high AS bh, b.low AS bl, b.px, b.exit AS bx, b.last_n AS bm, b.sellable
  FROM {entries} e JOIN xb b ON b.symbol = e.symbol AND b.n > e.n AND b.n <= e.n + (SELECT max(hold) FROM tg)),
jp AS (SELECT *, greatest(entry_price, high, max(bh) OVER (PARTITION BY symbol, n ORDER BY bn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak FROM jx),
jt AS (SELECT j.*, g.*, entry_price * (1 - stop) AS l1, peak * (1 - trail) AS l2, CASE WHEN peak > entry_price AND peak / entry_price - 1 >= ps THEN peak * (1 - pt) END AS l3
  FROM jp j JOIN tg g ON bn - n <= g.hold AND {takes}),
jl AS (SELECT *, greatest(l1, l2, l3) AS line, entry_price * (1 + take) AS goal FROM jt),
jr AS (SELECT *, CASE WHEN bl <= line THEN CASE line WHEN l1 THEN 'stop_loss' WHEN l2 THEN 'trailing_stop' ELSE 'trailing_take_profit' END WHEN bh >= goal THEN 'take_profit'
  WHEN bx THEN 'signal' WHEN bn - n >= hold THEN 'max_hold' WHEN bn = bm THEN 'end' END AS reason,
  CASE WHEN bl <= line THEN least(bo, line) WHEN bh >= goal THEN greatest(bo, goal) ELSE px END AS price FROM jl),
ex AS (SELECT trial_id, symbol, n AS entry_n, date AS entry_date, entry_price, reason, price, bd AS exit_date, bn AS exit_n, sellable FROM jr WHERE reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY trial_id, symbol, n ORDER BY bn) = 1),
nx AS (SELECT x.symbol, x.n, min(b.n) AS m FROM xb x JOIN xb b ON b.symbol = x.symbol AND b.n > x.n AND b.sellable WHERE NOT x.sellable GROUP BY 1, 2),
td AS (SELECT e.trial_id, e.symbol, e.entry_n, e.entry_date, e.entry_price, e.reason, coalesce(b.px, e.price) AS exit_price, coalesce(b.date, e.exit_date) AS exit_date,
  coalesce(b.n, e.exit_n) AS exit_n, coalesce(b.n - e.exit_n, 0)::INTEGER AS blocked_days
  FROM ex e LEFT JOIN nx ON NOT e.sellable AND nx.symbol = e.symbol AND nx.n = e.exit_n LEFT JOIN xb b ON b.symbol = e.symbol AND b.n = nx.m),
tr AS (SELECT *, exit_price * (1 - 0.0003::DOUBLE - 0.0005::DOUBLE - 0.0005::DOUBLE) / (entry_price * (1 + 0.0003::DOUBLE + 0.0005::DOUBLE)) - 1 AS pnl_pct, (exit_n - entry_n)::INTEGER AS duration FROM td)"""


ONE = f"SELECT 0, 0, {HOLD}, {STOP}::DOUBLE, 1.5::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE, 0.4::DOUBLE"
_T = B.with_("brand_bars", more=f"{TPANEL},\n{label_sql(ONE)}")
_T_OPEN = B.with_("brand_bars", more=f"{TBARS},\n{entries_sql(True)},\n{label_sql(ONE, True)}")
_T_MIXED = B.with_("brand_bars", more=f"{TPANEL},\n{label_sql(ONE, True)}")
RULES = {"take": 1.5, "trail": 0.5, "profit_start": 0.1, "profit_trail": 0.4}


def trades(s, d):
    return T.label_trades(trade_panel(s, d), START, END, HOLD, STOP, **RULES)


query(
    "b01_candidate_entries",
    B.with_("brand_bars", more=TPANEL) + "SELECT symbol, date, entry_price FROM en0"
)(lambda s, d: T.candidate_entries(trade_panel(s, d), START, END).select("symbol", "date", "entry_price"))
query(
    "b02_entry_guards",
    B.with_("brand_bars", more=TPANEL) + "SELECT why AS reason, count(*) AS n FROM en1 WHERE why IS NOT NULL GROUP BY 1"
)(lambda s, d: T.entry_guards(T.candidate_entries(trade_panel(s, d), START, END), -0.5)[1])
query("b03_label_exits", _T + "SELECT symbol, entry_n, reason, price, exit_date FROM ex")(
    lambda s, d: (
        lambda p: T.label_exits(T.entry_guards(T.candidate_entries(p, START, END))[0], p, HOLD, STOP, **RULES).select(
            "symbol",
            F.col("entry_n").cast("bigint").alias("entry_n"),
            "reason",
            "price",
            "exit_date"
        )
    )(trade_panel(s, d))
)
query("b03_exit_reasons", _T_MIXED + "SELECT reason, count(*) AS n, count_if(NOT sellable) AS blocked, avg(exit_n - entry_n) AS held FROM ex GROUP BY 1")(
    lambda s, d: (
        lambda p: T.label_exits(T.entry_guards(T.candidate_entries(p, START, END))[0], p, HOLD, STOP, exit_fill="next_open", **RULES).groupBy("reason").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("sellable")).alias("blocked"),
            F.avg(F.col("exit_n") - F.col("entry_n")).alias("held")
        )
    )(trade_panel(s, d))
)
_TC = ("symbol", "entry_date", "entry_price", "reason", "exit_price", "exit_date", "blocked_days", "pnl_pct", "duration")
query("b04_b05_trades", _T + f"SELECT {', '.join(_TC)} FROM tr")(lambda s, d: trades(s, d).select(*_TC))
query("b04_next_open_trades", _T_OPEN + f"SELECT {', '.join(_TC)} FROM tr")(
    lambda s, d: T.label_trades(trade_panel(s, d), START, END, HOLD, STOP, "next_open", **RULES).select(*_TC)
)
query("b04_close_in_open_out", _T_MIXED + f"SELECT {', '.join(_TC)} FROM tr")(
    lambda s, d: T.label_trades(trade_panel(s, d), START, END, HOLD, STOP, exit_fill="next_open", **RULES).select(*_TC)
)
query(
    "b08_trade_stats",
    _T + "SELECT *, CASE WHEN avg_loss > 0 THEN avg_win / avg_loss END AS profit_factor FROM (SELECT count(*) AS n_trades, count_if(pnl_pct > 0) / count(*)::DOUBLE AS win_rate, "
    "coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0.0) AS avg_win, coalesce(abs(avg(pnl_pct) FILTER (pnl_pct <= 0)), 0.0) AS avg_loss, avg(pnl_pct) AS avg_pnl, max(pnl_pct) AS best, "
    "min(pnl_pct) AS worst, median(pnl_pct) AS median_pnl, avg(duration) AS avg_holding_days FROM tr) AS t",
    5
)(lambda s, d: T.trade_stats(trades(s, d)))
SLOT = (
    "cal AS (SELECT DISTINCT date FROM tp), sl AS (SELECT exit_date AS date, avg(pnl_pct / 10000) AS ret, count(*) AS n FROM tr GROUP BY 1), "
    "eq AS (SELECT date, coalesce(ret, 0.0) AS ret, coalesce(n, 0) AS n, exp(sum(ln(1 + greatest(coalesce(ret, 0.0), -0.9999::DOUBLE))) OVER (ORDER BY date)) AS equity "
    "FROM cal LEFT JOIN sl USING (date))"
)


def small_trades(s, d):
    return trades(s, d).withColumn("pnl_pct", F.col("pnl_pct") / 10000)


query("b07_slot_portfolio", _T.rstrip() + ", " + SLOT + " SELECT * FROM eq")(
    lambda s, d: T.slot_portfolio(small_trades(s, d), B.bar_dates(s, d))
)
_WEIGHT = """en2 AS (SELECT *, CASE WHEN sum(greatest(score, 0.0)) OVER (PARTITION BY date) > 0 THEN greatest(score, 0.0) / sum(greatest(score, 0.0)) OVER (PARTITION BY date)
  ELSE 1 / count(*) OVER (PARTITION BY date)::DOUBLE END AS weight FROM (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) <= 3) AS t)"""
_WSLOT = """cal AS (SELECT DISTINCT date FROM tp),
sl AS (SELECT exit_date AS date, coalesce(sum(pnl_pct / 10000 * weight) / nullif(sum(weight), 0), 0.0) AS ret, count(*) AS n FROM tr JOIN en2 ON en2.symbol = tr.symbol AND en2.n = tr.entry_n GROUP BY 1)
SELECT date, coalesce(ret, 0.0) AS ret, coalesce(n, 0) AS n, exp(sum(ln(1 + greatest(coalesce(ret, 0.0), -0.9999::DOUBLE))) OVER (ORDER BY date)) AS equity FROM cal LEFT JOIN sl USING (date)"""


@query("b07_score_weighted", B.with_("brand_bars", more=f"{TPANEL},\n{_WEIGHT},\n{label_sql(ONE, entries='en2')}").rstrip() + ",\n" + _WSLOT)
def _score_weighted(s, d):
    """The day's three best-scored entries, weighted by their scores."""
    p = trade_panel(s, d)
    picked = T.weighted_slots(T.entry_guards(T.candidate_entries(p, START, END))[0], 3, "score_weight")
    made = T.trade_costs(T.defer_blocked(T.label_exits(picked, p, HOLD, STOP, **RULES)))
    made = made.join(picked.select("symbol", F.col("n").alias("entry_n"), "weight"), ["symbol", "entry_n"])
    return T.slot_portfolio(made.withColumn("pnl_pct", F.col("pnl_pct") / 10000), B.bar_dates(s, d), weight="weight")


query(
    "b07_daily_top_n",
    B.with_("brand_bars", more=TPANEL) + "SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol)::INTEGER AS slot FROM en0 QUALIFY slot <= 3"
)(lambda s, d: T.daily_top_n_slots(T.candidate_entries(trade_panel(s, d), START, END), 3).select("symbol", "date", "slot"))
query(
    "b09_curve_stats",
    _T.rstrip() + ", " + SLOT + f", st AS (SELECT date, equity AS v, equity / greatest(max(equity) OVER (ORDER BY date), 1.0) - 1 AS dd, equity / "
    f"nullif(coalesce(lag(equity) OVER (ORDER BY date), 1.0), 0) - 1 AS r FROM eq), g AS (SELECT arg_max(v, date) - 1 AS "
    f"total_return, min(dd) AS max_drawdown, avg(r) / nullif(stddev_pop(r), 0) * sqrt(252) AS sharpe, avg(r) / "
    f"nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) * sqrt(252) AS sortino, pow(greatest(arg_max(v, date), 1e-9), 1 / {_YEARS}) "
    f"- 1 AS annual_return FROM st) SELECT *, annual_return / nullif(abs(max_drawdown), 0) AS calmar FROM g",
    2
)(lambda s, d: T.curve_stats(T.slot_portfolio(small_trades(s, d), B.bar_dates(s, d))))
query(
    "b10_per_symbol",
    _T + "SELECT symbol, count(*) AS n, exp(sum(ln(1 + greatest(pnl_pct, -0.9999::DOUBLE)))) - 1 AS total_return, count_if(pnl_pct "
    "> 0) / count(*)::DOUBLE AS win_rate, max(pnl_pct) AS best, min(pnl_pct) AS worst FROM (SELECT symbol, pnl_pct / 10000 AS "
    "pnl_pct FROM tr) AS t GROUP BY symbol",
    4
)(lambda s, d: T.per_symbol_stats(small_trades(s, d)))
query(
    "b11_histogram",
    _T + "SELECT least(floor(round((greatest(-0.2::DOUBLE, least(0.2::DOUBLE, pnl_pct)) + 0.2::DOUBLE) / 0.02::DOUBLE, 9)), "
    "19)::INTEGER AS bin, count(*) AS n FROM tr GROUP BY 1"
)(lambda s, d: T.return_histogram(trades(s, d)))


def boot_sql(trades: str = "tr", key: str = "0") -> str:
    """Worst drawdowns of simulations that draw trades by the same hash of whole numbers."""
    return f"""tk AS (SELECT {key} AS key, greatest(pnl_pct, -0.9999::DOUBLE) AS r, row_number() OVER (PARTITION BY {key} ORDER BY symbol, entry_date, exit_date, pnl_pct) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM {trades}),
s0 AS (SELECT key, n, k, sim, (k * 7919 + sim * 104729 + 42) % 2147483647 * 48271 % 2147483647 AS x FROM tk, range(1, 1001) s(sim) WHERE n >= 3 AND sim <= greatest(200, 2000000 // n)),
s1 AS (SELECT key, n, k, sim, xor(x, x >> 15) * 69621 % 2147483647 AS x FROM s0),
s2 AS (SELECT key, k, sim, xor(x, x >> 12) * 16807 % 2147483647 % n + 1 AS pick FROM s1),
nv AS (SELECT s2.key, sim, s2.k, sum(ln(1 + r)) OVER (PARTITION BY s2.key, sim ORDER BY s2.k) AS nav FROM s2 JOIN tk ON tk.key = s2.key AND tk.k = pick),
wd AS (SELECT key, sim, min(dd) AS dd FROM (SELECT key, sim, exp(nav - max(nav) OVER (PARTITION BY key, sim ORDER BY k)) - 1 AS dd FROM nv) AS x GROUP BY ALL),
mc AS (SELECT key, quantile_cont(dd, 0.5) AS mc_maxdd_p50, quantile_cont(dd, 0.05) AS mc_maxdd_p95 FROM wd GROUP BY key)"""


query("b12_bootstrap_drawdown", _T.rstrip() + f",\n{boot_sql()}\nSELECT mc_maxdd_p50, mc_maxdd_p95 FROM mc", 5)(lambda s, d: T.bootstrap_drawdown(trades(s, d)))
_FORWARD = TPANEL + f", fw AS (SELECT *, (lead(close, 5) OVER ({W}) / nullif(close, 0) - 1) / 10000 AS fwd FROM tp), fd AS (SELECT date, avg(fwd) AS ret, count(*) AS n FROM fw WHERE entry AND fwd IS NOT NULL GROUP BY date), fe AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity FROM fd), fc AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY date), 1.0) - 1 AS drawdown FROM fe)"
query("b13_forward_eval", B.with_("brand_bars", more=_FORWARD) + "SELECT * FROM fc")(lambda s, d: T.forward_eval(trade_panel(s, d), 5, 1e-4))


def market_close(s, d):
    """The market as benchmark: the mean close of each date."""
    return B.bars(s, d).groupBy("date").agg(F.avg("close").alias("close"))


query(
    "b13_forward_stats",
    B.with_("brand_bars", "bars", more=_FORWARD + ", bm AS (SELECT date, avg(close) AS close FROM bars GROUP BY date)") + """SELECT p.*, q.*, h.*, total_return - benchmark_return AS excess FROM
(SELECT count(*) AS n_candidates, avg(fwd) AS avg_return, median(fwd) AS median_return, count_if(fwd > 0) / count(*)::DOUBLE AS win_rate,
  avg(fwd) FILTER (fwd > 0) / nullif(abs(avg(fwd) FILTER (fwd <= 0)), 0) AS profit_factor, max(fwd) AS best, min(fwd) AS worst FROM fw WHERE entry AND fwd IS NOT NULL) p,
(SELECT count(*) AS n_days, avg(n) AS avg_daily_candidates, arg_max(equity, date) - 1 AS total_return, min(drawdown) AS max_drawdown, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe FROM fc) q,
(SELECT arg_max(close, date) / arg_min(close, date) - 1 AS benchmark_return FROM bm WHERE date BETWEEN (SELECT min(date) FROM fc) AND (SELECT max(date) FROM fc)) h"""
)(lambda s, d: T.forward_stats(trade_panel(s, d), 5, market_close(s, d), 1e-4))
query(
    "b14_signal_backtest",
    B.with_("bars", more=IND) + "SELECT symbol, date, coalesce(close > boll_upper, false) OR coalesce(vol_ratio_5d >= 2.0, false) AS entry, coalesce(close "
    "< boll_lower, false) AS exit FROM ind"
)(
    lambda s, d: T.signal_panel(
        indicator_frame(s, d, {"signal_boll_breakout_upper", "signal_volume_surge", "signal_boll_breakdown_lower"}),
        ["signal_boll_breakout_upper", "signal_volume_surge"],
        ["signal_boll_breakdown_lower"]
    ).select("symbol", "date", "entry", "exit")
)
_SIGNALS = (["signal_boll_breakout_upper", "signal_volume_surge"], ["signal_boll_breakdown_lower"])
_SIGNAL_BARS = f"""{IND}, {REC}, rs AS (SELECT symbol, date, rsi_14 FROM recind),
tp AS (SELECT i.symbol, i.date, open, high, low, close, coalesce(close > boll_upper, false) OR coalesce(vol_ratio_5d >= 2.0, false) OR coalesce(rsi_14 < 20, false) AS entry,
  coalesce(close < boll_lower, false) OR coalesce(rsi_14 > 80, false) AS exit, 0.0 AS score, false AS stuck_up, false AS stuck_dn,
  (open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT (volume = 0 AND {_FLATBAR})) AS tradable, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, count(*) OVER (PARTITION BY symbol) AS last_n
  FROM ind i LEFT JOIN rs USING (symbol, date))"""


@query("b14_signal_trades", B.with_("bars", more=f"{_SIGNAL_BARS},\n{entries_sql(True)},\n{label_sql(f'SELECT 0, 0, 20, 0.08::DOUBLE, NULL::DOUBLE, 0.2::DOUBLE, NULL::DOUBLE, NULL::DOUBLE', True)}", recursive=True) + f"SELECT {', '.join(_TC)} FROM tr")
def _signal_trades(s, d):
    """A backtest on Bollinger, volume and RSI signals, acted on at the next open."""
    df = indicator_frame(s, d, {"signal_boll_breakout_upper", "signal_volume_surge", "signal_boll_breakdown_lower", "rsi_14"})
    return T.signal_backtest(df, *_SIGNALS, START, END, 20, (20.0, 80.0), stop=0.08, trail=0.2).select(*_TC)


query(
    "b06_minute_fill",
    B.with_(
        "minutes",
        more="o AS (SELECT symbol, datetime::DATE AS date, avg(close) AS line, arg_max(close, datetime) AS daily_price FROM minutes GROUP "
        "BY 1, 2), f AS (SELECT symbol, datetime::DATE AS date, arg_min(open, datetime) AS mo, arg_max(close, datetime) AS mc, "
        "max(high) AS mh, min(low) AS ml FROM minutes GROUP BY 1, 2)"
    ) + "SELECT symbol, date, CASE WHEN mo >= line THEN mo WHEN mh >= line THEN line ELSE mc END AS fill_price FROM o JOIN f USING (symbol, date)"
)(
    lambda s, d: (
        lambda m: T.minute_fill_price(
            m.groupBy("symbol", F.to_date("datetime").alias("date")).agg(
                F.avg("close").alias("line"),
                F.max_by("close", "datetime").alias("daily_price")
            ).withColumn("side", F.lit("buy")),
            m
        ).select("symbol", "date", "fill_price")
    )(B.minutes(s, d))
)
GRID = {"stop": [0.5, 0.1], "hold": {"min": 3, "max": 9, "step": 3}, "take": [None, 1.5], "trail": [None, 0.4], "profit": [None, 0.2], "variant": [0, 1]}
#: Entries of two sets of strategy parameters: least volume ratios.
VOLUME_RATIOS = (1.2, 2.0)
TRIALS = [{**t, "profit_start": t["profit"], "profit_trail": t["profit"] and 0.3} for t in T.param_grid(GRID)]
_number = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
_TRIALS_SQL = "VALUES " + ", ".join(
    f"({k}, {t['variant']}, {t['hold']}, {', '.join(_number(t[r]) for r in ('stop', 'take', 'trail', 'profit_start', 'profit_trail'))})" for k, t in enumerate(TRIALS)
)
_VOLUME = f"tv AS (SELECT symbol, date, coalesce(ma5 > ma20, false) AS trend, vol_ratio_5d FROM ind)"
_SW = B.with_("brand_bars", more=f"{TPANEL},\n{_VOLUME},\nev AS (SELECT en.*, vol_ratio_5d AS vr FROM en JOIN tv USING (symbol, date)),\n{label_sql(_TRIALS_SQL, entries='ev', takes='(variant = 0 OR vr >= 2.0)')}")


def swept(s, d):
    """All trials over exit rules and two sets of entry parameters."""
    p = trade_panel(s, d, "ma5", "ma20", "vol_ratio_5d")
    conditions = [F.coalesce((F.col("ma5") > F.col("ma20")) & (F.col("vol_ratio_5d") >= v), F.lit(False)) for v in VOLUME_RATIOS]
    return T.sweep(p, TRIALS, START, END, variants=conditions)


_BY_REASON = ("stop_loss", "trailing_stop", "trailing_take_profit", "take_profit", "signal", "max_hold", "end")
query(
    "b16_sweep_trades",
    _SW + "SELECT trial_id, count(*) AS n, avg(pnl_pct) AS avg_pnl, sum(blocked_days)::BIGINT AS blocked, " + ", ".join(f"count_if(reason = '{r}') AS {r}" for r in _BY_REASON) + " FROM tr GROUP BY 1",
    5
)(
    lambda s, d: swept(s, d).groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("pnl_pct").alias("avg_pnl"),
        F.sum("blocked_days").alias("blocked"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in _BY_REASON)
    )
)
query(
    "b16_sweep_ranked",
    _SW + "SELECT trial_id, n_trades, avg_pnl, row_number() OVER (ORDER BY round(avg_pnl, 6) DESC NULLS LAST, trial_id)::INTEGER AS "
    "rank FROM (SELECT trial_id, count(*) AS n_trades, avg(pnl_pct) AS avg_pnl FROM tr GROUP BY 1) q",
    5
)(lambda s, d: T.rank_trials(swept(s, d), B.bar_dates(s, d)).select("trial_id", "n_trades", "avg_pnl", "rank"))
query(
    "b16_sweep_by_holding",
    _SW + "SELECT trial_id, avg_holding_days, row_number() OVER (ORDER BY round(avg_holding_days, 6), trial_id)::INTEGER AS rank FROM (SELECT trial_id, avg(duration) AS avg_holding_days FROM tr GROUP BY 1) q"
)(lambda s, d: T.rank_trials(swept(s, d), B.bar_dates(s, d), "avg_holding_days").select("trial_id", "avg_holding_days", "rank"))
#: Few trials, and small returns, where every trade is drawn hundreds of times.
FEW = [t for t in TRIALS if t["hold"] == 9 and t["take"] is None and t["variant"] == 1 and t["trail"] is None]
_FEW_SQL = "VALUES " + ", ".join(f"({k}, 1, {t['hold']}, {', '.join(_number(t[r]) for r in ('stop', 'take', 'trail', 'profit_start', 'profit_trail'))})" for k, t in enumerate(FEW))
_SW_FEW = B.with_("brand_bars", more=f"{TPANEL},\n{_VOLUME},\nev AS (SELECT en.*, vol_ratio_5d AS vr FROM en JOIN tv USING (symbol, date)),\n{label_sql(_FEW_SQL, entries='ev', takes='vr >= 2.0')}")


def few_swept(s, d):
    p = trade_panel(s, d, "ma5", "ma20", "vol_ratio_5d")
    condition = F.coalesce((F.col("ma5") > F.col("ma20")) & (F.col("vol_ratio_5d") >= 2.0), F.lit(False))
    return T.sweep(p, [{**t, "variant": 0} for t in FEW], START, END, variants=[condition])


query(
    "b16_sweep_by_drawdown",
    _SW_FEW.rstrip() + f",\nsm AS (SELECT * REPLACE (pnl_pct / 100 AS pnl_pct) FROM tr),\n{boot_sql('sm', 'trial_id')}\n"
    "SELECT key AS trial_id, mc_maxdd_p95, row_number() OVER (ORDER BY round(mc_maxdd_p95, 6) DESC, key)::INTEGER AS rank FROM mc",
    5
)(lambda s, d: T.rank_trials(few_swept(s, d).withColumn("pnl_pct", F.col("pnl_pct") / 100), B.bar_dates(s, d), "mc_maxdd_p95").select("trial_id", "mc_maxdd_p95", "rank"))
query(
    "b15_param_grid",
    "WITH k AS (SELECT DISTINCT l_linenumber AS k FROM lineitem) SELECT (row_number() OVER (ORDER BY a.k, b.k) - 1)::INTEGER AS trial_id, round(a.k * 0.05::DOUBLE, 10) AS stop, (2 * b.k)::DOUBLE AS hold FROM k a, k b"
)(lambda s, d: (lambda n: T.grid_frame(s, {"stop": {"min": 0.05, "max": 0.05 * n, "step": 0.05}, "hold": {"min": 2, "max": 2 * n, "step": 2}}))(B.table(s, d, "lineitem").agg(F.max("l_linenumber")).first()[0]))
query(
    "u04_param_product",
    "SELECT (row_number() OVER (ORDER BY a.i, b.i) - 1)::INTEGER AS trial_id, a.stop, b.hold::DOUBLE AS hold FROM (VALUES (0, "
    "-0.5::DOUBLE), (1, -0.2::DOUBLE), (2, -0.1::DOUBLE)) a(i, stop) CROSS JOIN (SELECT DISTINCT dense_rank() OVER (ORDER BY "
    "r_regionkey) AS i, 3 * dense_rank() OVER (ORDER BY r_regionkey) AS hold FROM region) b"
)(
    lambda s, d: T.grid_frame(s, {"stop": [-0.5, -0.2, -0.1], "hold": {"min": 3, "max": 3 * B.table(s, d, "region").count(), "step": 3}})
)
FOLDS = T.walkforward_folds(date(1996, 1, 1), date(2000, 12, 31), 365, 180, 180)
_FOLD_SQL = "fd(fold, train_start, train_end, test_start, test_end) AS (VALUES " + ", ".join(
    f"({k}, DATE '{a}', DATE '{b}', DATE '{c}', DATE '{e}')" for k,
    a,
    b,
    c,
    e in FOLDS
) + ")"
query(
    "b17_folds",
    B.with_("brand_bars", more=_FOLD_SQL) + "SELECT fold, count(*) AS test_bars FROM fd JOIN brand_bars ON date BETWEEN test_start AND test_end GROUP BY fold"
)(
    lambda s, d: B.brand_bars(s, d).join(
        F.broadcast(T.fold_frame(s, FOLDS)),
        F.col("date").between(F.col("test_start"), F.col("test_end"))
    ).groupBy("fold").agg(F.count(F.lit(1)).alias("test_bars"))
)
#: The sweep's trades of each fold's windows, from bars that end with the window.
_WALK = _SW.rstrip() + f""", {_FOLD_SQL},
wn AS (SELECT fold, false AS tested, train_start AS a, train_end AS z FROM fd UNION ALL SELECT fold, true, test_start, test_end FROM fd),
lb AS (SELECT fold, tested, symbol, max(n) AS last_n, arg_max(close, n) AS last_close, max(date) AS last_date FROM wn JOIN tp ON date <= z GROUP BY ALL),
wt AS (SELECT fold, tested, t.*, exit_n > last_n AS late, last_n, last_close, last_date FROM tr t JOIN wn ON entry_date BETWEEN a AND z JOIN lb USING (fold, tested, symbol) WHERE entry_n < last_n),
ws AS (SELECT fold, tested, trial_id, symbol, entry_date, CASE WHEN late THEN last_date ELSE exit_date END AS exit_date, CASE WHEN late THEN last_n ELSE exit_n END - entry_n AS duration,
  1e-4::DOUBLE * (CASE WHEN late THEN last_close ELSE exit_price END * (1 - 0.0003::DOUBLE - 0.0005::DOUBLE - 0.0005::DOUBLE) / (entry_price * (1 + 0.0003::DOUBLE + 0.0005::DOUBLE)) - 1) AS pnl_pct FROM wt),
wc AS (SELECT fold, tested, date FROM wn JOIN (SELECT DISTINCT date FROM tp) ON date BETWEEN a AND z),
wr AS (SELECT fold, tested, trial_id, exit_date AS date, avg(pnl_pct) AS ret FROM ws GROUP BY ALL),
we AS (SELECT k.*, c.date, coalesce(r.ret, 0.0) AS ret FROM (SELECT DISTINCT fold, tested, trial_id FROM ws) k JOIN wc c USING (fold, tested) LEFT JOIN wr r USING (fold, tested, trial_id, date)),
wq AS (SELECT fold, tested, trial_id, date, exp(sum(ln(1 + greatest(ret, -0.9999::DOUBLE))) OVER (PARTITION BY fold, tested, trial_id ORDER BY date)) AS v FROM we),
wx AS (SELECT fold, tested, trial_id, date, v, v / coalesce(lag(v) OVER (PARTITION BY fold, tested, trial_id ORDER BY date), 1.0) - 1 AS r FROM wq),
wv AS (SELECT fold, tested, trial_id, arg_max(v, date) - 1 AS total_return, avg(r) / nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) * sqrt(252) AS sortino FROM wx GROUP BY ALL),
wg AS (SELECT v.*, n_trades FROM wv v JOIN (SELECT fold, tested, trial_id, count(*) AS n_trades FROM ws GROUP BY ALL) USING (fold, tested, trial_id)),
bt AS (SELECT fold, trial_id, sortino FROM wg WHERE NOT tested QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(sortino, 6) DESC NULLS LAST, trial_id) = 1),
wf AS (SELECT b.fold, b.trial_id, b.sortino AS train_value, g.n_trades, g.sortino, g.total_return, round(b.sortino, 6) - round(g.sortino, 6) AS degradation FROM bt b JOIN wg g ON g.tested AND g.fold = b.fold AND g.trial_id = b.trial_id)
"""
query("b18_walkforward", _WALK + "SELECT * FROM wf", 4)(
    lambda s, d: walked(s, d).select("fold", "trial_id", "train_value", "n_trades", "sortino", "total_return", "degradation")
)


def walked(s, d):
    """The sweep's trades, written once, and each fold's best trial by Sortino on its test window."""
    path = scratch(s, "sweep")
    swept(s, d).write.parquet(path)
    bars = B.brand_bars(s, d)
    numbered_bars = bars.select("symbol", "date", "close").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    return T.walkforward(s.read.parquet(path), T.fold_frame(s, FOLDS), numbered_bars, scale=1e-4)


query(
    "b18_out_of_sample",
    _WALK + f"SELECT count(*) AS n_folds, {len(FOLDS)} - count(*) AS skipped, product(1 + coalesce(total_return, 0.0)) - 1 AS compounded_oos_return, avg(train_value) AS avg_is_objective, "
    "avg(sortino) AS avg_oos_objective, avg(train_value) - avg(sortino) AS degradation, count_if(total_return > 0) / count(*)::DOUBLE AS consistency FROM wf",
    4
)(lambda s, d: T.out_of_sample(walked(s, d), len(FOLDS)))
query(
    "t02_rank_strategy",
    B.with_(
        "bars",
        "factors",
        "instruments",
        more=WIDE
    ) + f"SELECT symbol, date, score FROM (SELECT *, {minmax_sql(K.REGISTRY['strong_open'].scoring, 'entry')} AS score FROM (SELECT "
    f"*, coalesce({entry_sql('strong_open')}, false) AS entry FROM wide) e) x WHERE entry AND date = DATE '1998-06-30' ORDER BY "
    f"score DESC, symbol LIMIT 50"
)(
    lambda s, d: K.rank_result(
        K.apply(
            strategy_frame(s, d, strategy_needs(K.REGISTRY["strong_open"])),
            K.REGISTRY["strong_open"],
            basic={}
        ).filter("date = DATE '1998-06-30'"),
        K.REGISTRY["strong_open"]
    ).select("symbol", "date", "score")
)
query(
    "t05_daily_slots",
    B.with_("bars") + "SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY amount DESC, symbol)::INTEGER AS slot FROM bars QUALIFY slot <= 2"
)(lambda s, d: T.daily_top_n_slots(bars(s, d).withColumn("score", F.col("amount")), 2).select("symbol", "date", "slot"))
