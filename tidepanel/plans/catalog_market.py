"""Queries: filters, joins, breadth, rotation, dashboards, sets, scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as C
from ..operators import breadth as A
from ..operators import filters as X
from ..operators import joins as J
from ..operators import rotation as R
from ..operators.limits import classify_board, limit_pct
from ..operators.windows import finite_or_null, lag
from . import bindings as B
from .catalog import query, written
from .catalog_indicators import ADJ, IND, LIM, LIMITS, SIG, WIDE, W, indicator_frame, lag_sql, limit_frame, strategy_frame

BOARD = (
    "CASE WHEN symbol LIKE '%.BJ' THEN '北交所' WHEN left(symbol, 3) IN ('300', '301') THEN '创业板' WHEN left(symbol, 3) IN ('688', "
    "'689') THEN '科创板' WHEN symbol LIKE '%.SH' THEN '沪主板' WHEN symbol LIKE '%.SZ' THEN '深主板' ELSE '其他' END"
)
bars, dims = B.bars, B.instruments
WIDE_ALL = B.with_("bars", "factors", "instruments", more=WIDE)

# Filters. Halts are made of the bars themselves: rows with little volume lose their prices.
_HALT = (
    "h AS (SELECT symbol, date, CASE WHEN volume < 10 THEN 0 ELSE open END AS open, CASE WHEN volume < 10 THEN 0 ELSE high END "
    "AS high, low, close, CASE WHEN volume < 10 THEN 0 ELSE volume END AS volume FROM bars)"
)


def halted(s, d):
    small = F.col("volume") < 10
    return bars(s, d).select(
        "symbol",
        "date",
        *[F.when(small, 0.0).otherwise(F.col(c)).alias(c) for c in ("open", "high")],
        "low",
        "close",
        F.when(small, 0.0).otherwise(F.col("volume")).alias("volume")
    )


query(
    "f01_filter_halt_days",
    B.with_("bars", more=_HALT) + "SELECT symbol, date, close FROM h WHERE NOT (open = 0 AND high = 0)"
)(lambda s, d: X.filter_halt_days(halted(s, d)).select("symbol", "date", "close"))
query(
    "f02_true_suspension",
    B.with_(
        "bars",
        more=f"{_HALT}, p AS (SELECT *, close / nullif({lag_sql('close')}, 0) - 1 AS change_pct FROM h)"
    ) + "SELECT symbol, date FROM p WHERE coalesce(volume, 0) > 0 OR coalesce(change_pct, 0) <> 0"
)(
    lambda s, d: X.filter_true_suspension(
        halted(s, d).withColumn("change_pct", F.try_divide(F.col("close"), lag("close")) - 1)
    ).select("symbol", "date")
)
_BASIC = {
    "price_min": 1000,
    "price_max": 2500,
    "market_cap_min": 5e9,
    "float_cap_max": 4e10,
    "amount_min": 10000,
    "turnover_min": 0.01,
    "exclude_st": True,
    "exclude_new_days": 20,
    "boards": ["创业板", "沪主板", "北交所"]
}
query(
    "f03_basic_filter",
    WIDE_ALL + f"SELECT symbol, date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS nth FROM wide) AS n WHERE nth "
    f"> 20 AND close >= 1000 AND close <= 2500 AND close * total_shares >= 5e9 AND close * float_shares <= 4e10 AND amount >= "
    f"10000 AND turnover_rate >= 0.01 AND NOT regexp_matches(name, '(?i)ST|退') AND {BOARD} IN ('创业板', '沪主板', '北交所')"
)(
    lambda s, d: strategy_frame(
        s,
        d,
        {"symbol", "date", "close", "amount"}
    ).withColumn("fits", X.basic_filter(_BASIC)).filter("fits").select("symbol", "date")
)
query(
    "f04_screen_sql",
    B.with_("bars", more=IND) + "SELECT symbol, date, amount FROM ind WHERE close > ma20 AND vol_ratio_5d >= 1.5 ORDER BY amount DESC, symbol LIMIT 50"
)(
    lambda s, d: X.screen_sql(
        indicator_frame(s, d, {"ma20", "vol_ratio_5d"}),
        ["close > ma20", "vol_ratio_5d >= 1.5"],
        "amount desc",
        50
    ).select("symbol", "date", "amount")
)
_RULE = [
    {"left": "close", "op": ">", "right": "ma5"},
    {"left": "close", "left_lag": 1, "op": "<=", "right": "ma5", "right_lag": 1},
    {"left": "volume", "op": ">=", "right": 20}
]
_RULE_SQL = f"close > ma5 AND {lag_sql('close')} <= {lag_sql('ma5')} AND volume >= 20"
query("f05_custom_signal", B.with_("bars", more=IND) + f"SELECT symbol, date, ({_RULE_SQL}) AS sig FROM ind")(
    lambda s, d: (lambda df: df.select("symbol", "date", X.custom_signal(_RULE, set(df.columns)).alias("sig")))(indicator_frame(s, d, {"ma5"}))
)
query("f06_inject_signals", B.with_("bars", more=IND) + f"SELECT symbol, date, ({_RULE_SQL}) AS mine FROM ind")(
    lambda s, d: X.inject_signals(
        indicator_frame(s, d, {"ma5"}),
        {"mine": _RULE, "missing": [{"left": "absent", "op": ">", "right": 1}]}
    ).select("symbol", "date", "mine")
)
query(
    "f07_match_conditions",
    B.with_("bars", more=f"{IND},\n{SIG}") + "SELECT symbol, date FROM sig WHERE coalesce(signal_volume_surge, false) OR coalesce(change_pct >= 1, false)"
)(
    lambda s, d: X.match_conditions(
        indicator_frame(s, d, {"signal_volume_surge", "change_pct"}),
        [{"field": "signal_volume_surge", "op": "truth", "value": None}, {"field": "change_pct", "op": ">=", "value": 1}],
        "or"
    ).select("symbol", "date")
)
query("f08_apply_scope", B.with_("bars") + "SELECT symbol, date FROM bars WHERE symbol IN ('600002.SH', '688001.SH')")(
    lambda s, d: X.apply_scope(
        bars(s, d),
        "symbols",
        ["600002.SH", "688001.SH"]
    ).unionByName(X.apply_scope(bars(s, d), "sector")).select("symbol", "date")
)
query(
    "f09_classify_board",
    B.with_("instruments") + f"SELECT symbol, {BOARD} AS board FROM instruments"
)(lambda s, d: dims(s, d).select("symbol", classify_board(F.col("symbol")).alias("board")))
query(
    "f10_limit_pct",
    B.with_("instruments") + "SELECT symbol, CASE WHEN left(symbol, 3) IN ('300', '301', '688', '689') THEN 0.20::DOUBLE WHEN symbol LIKE '%.BJ' THEN "
    "0.30::DOUBLE WHEN regexp_matches(name, '(?i)ST|退') THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END AS pct FROM instruments"
)(
    lambda s, d: dims(s, d).select("symbol", limit_pct(F.col("symbol"), F.col("name")).alias("pct"))
)
query("f11_finite_or_null", B.with_("bars") + "SELECT symbol, date, CASE WHEN volume > 30 AND volume <= 40 THEN close END AS x FROM bars")(
    lambda s, d: finite_or_null(
        bars(s, d).select(
            "symbol",
            "date",
            F.when(F.col("volume") <= 30, float("nan")).when(F.col("volume") > 40, float("inf")).otherwise(F.col("close")).alias("x")
        )
    )
)
query(
    "f12_last_trading_days",
    B.with_("bars") + "SELECT symbol, date FROM bars WHERE date IN (SELECT DISTINCT date FROM bars WHERE date <= DATE '1998-06-30' ORDER BY date DESC LIMIT 5)"
)(lambda s, d: X.last_trading_days(bars(s, d), 5, "1998-06-30").select("symbol", "date"))
query("f13_select_needed", B.with_("bars", more=f"{IND},\n{SIG}") + "SELECT symbol, date, boll_upper, signal_ma_golden_5_20 FROM sig")(
    lambda s, d: indicator_frame(s, d, {"boll_upper", "signal_ma_golden_5_20"}).select("symbol", "date", "boll_upper", "signal_ma_golden_5_20")
)
query(
    "f14_market_cap",
    B.with_("bars", "instruments") + "SELECT symbol, date, close * total_shares AS market_cap, close * float_shares AS float_cap FROM bars LEFT JOIN instruments USING (symbol)",
    2
)(
    lambda s, d: X.with_market_caps(
        J.with_instruments(bars(s, d), dims(s, d), ["total_shares", "float_shares"])
    ).select("symbol", "date", "market_cap", "float_cap")
)
query(
    "f15_search_instruments",
    B.with_(
        "instruments",
        more="m AS (SELECT symbol, name, CASE WHEN upper(symbol) LIKE '300%' OR upper(code) LIKE '300%' OR upper(name) LIKE '300%' THEN "
        "0 WHEN upper(symbol) LIKE '%300%' OR upper(code) LIKE '%300%' OR upper(name) LIKE '%300%' THEN 1 END AS match_rank FROM instruments)"
    ) + "SELECT symbol, name, match_rank FROM m WHERE match_rank IS NOT NULL ORDER BY match_rank, symbol LIMIT 12"
)(
    lambda s, d: X.search_instruments(dims(s, d), "300", 12).select("symbol", "name", "match_rank")
)
query(
    "f16_fill_bad_ohlc",
    B.with_("bars", more=_HALT) + "SELECT symbol, date, CASE WHEN coalesce(open, 0) = 0 THEN close ELSE open END AS open, CASE WHEN coalesce(high, 0) = 0 THEN "
    "close ELSE high END AS high, CASE WHEN coalesce(low, 0) = 0 THEN close ELSE low END AS low, close FROM h"
)(
    lambda s, d: X.fill_bad_ohlc(halted(s, d)).select("symbol", "date", "open", "high", "low", "close")
)
_TRADE = (
    "(open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT (volume = 0 AND greatest(open, high, low, close) - least(open, "
    "high, low, close) <= greatest(abs(close) * 1e-4, 0.01)))"
)
query(
    "f17_tradable",
    B.with_("bars", more=_HALT) + f"SELECT symbol, date, {_TRADE} AS tradable FROM h"
)(lambda s, d: halted(s, d).select("symbol", "date", X.tradable_flag().alias("tradable")))
_FLAT = "greatest(open, high, low, close) - least(open, high, low, close) <= greatest(abs(close) * 1e-4, 0.01)"
query(
    "f18_one_price_limit",
    LIMITS + f"SELECT symbol, date FROM lim WHERE {_TRADE} AND {_FLAT} AND coalesce(signal_limit_up, false)"
)(lambda s, d: limit_frame(s, d).filter(X.one_price_limit_flag("signal_limit_up")).select("symbol", "date"))
query(
    "f19_date_window",
    B.with_("bars") + "SELECT symbol, date, date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AS formal FROM bars"
)(lambda s, d: bars(s, d).select("symbol", "date", X.in_window("1997-01-01", "1997-12-31").alias("formal")))

# Joins. A day's bars: those of the last date on which the symbol's number is even, and so on; lists come from the dimension.
_DAY = "day AS (SELECT * FROM bars WHERE date = (SELECT max(date) FROM bars WHERE date <= DATE '1998-06-30'))"


def one_day(df, at="1998-06-30"):
    return X.last_trading_days(df, 1, at)


query(
    "j02_with_instruments",
    B.with_("bars", "instruments") + "SELECT symbol, date, name, total_shares FROM bars LEFT JOIN instruments USING (symbol)"
)(lambda s, d: J.with_instruments(bars(s, d), dims(s, d), ["name", "total_shares"]).select("symbol", "date", "name", "total_shares"))
query(
    "j03_watchlist_panel",
    B.with_("bars", "instruments", more=_DAY) +
    "SELECT symbol, position, close FROM (SELECT symbol, row_number() OVER (ORDER BY balance, symbol)::INTEGER AS position FROM "
    "instruments UNION ALL SELECT 'XXX.SZ', 0) w LEFT JOIN day USING (symbol)"
)(
    lambda s, d: J.watchlist_panel(
        dims(s, d).select(
            "symbol",
            F.row_number().over(Window.orderBy("balance", "symbol")).alias("position")
        ).unionByName(s.createDataFrame([("XXX.SZ", 0)], "symbol string, position int")), one_day(bars(s, d))
    ).select("symbol", "position", "close")
)
query(
    "j04_external_columns",
    B.with_(
        "bars",
        more="late AS (SELECT * FROM bars WHERE date = (SELECT max(date) FROM bars))"
    ) + "SELECT b.symbol, b.date, l.volume AS ext__volume FROM bars b LEFT JOIN late l USING (symbol)"
)(
    lambda s, d: J.with_external_columns(bars(s, d), bars(s, d), "ext", ["volume"]).select("symbol", "date", "ext__volume")
)
EXPLODED = (
    "lab AS (SELECT DISTINCT upper(symbol) AS symbol, trim(x) AS label FROM (SELECT symbol, unnest(regexp_split_to_array(labels, "
    "'[、,，;；|/\\s]+')) AS x FROM instruments) WHERE lower(trim(x)) NOT IN ('', 'nan', 'none', 'null'))"
)
query(
    "j05_explode_dimension",
    B.with_("bars", "instruments", more=EXPLODED) + "SELECT symbol, date, label FROM bars JOIN lab USING (symbol)"
)(lambda s, d: J.explode_dimension_join(bars(s, d), dims(s, d), "labels").select("symbol", "date", "label"))
query(
    "j06_symbol_or_code",
    B.with_(
        "bars",
        "instruments",
        more=f"{_DAY}, k AS (SELECT CASE WHEN total_shares > 2e7 THEN symbol ELSE code END AS key, industry FROM instruments)"
    ) + "SELECT symbol, coalesce(a.industry, b.industry) AS industry FROM day LEFT JOIN k a ON a.key = symbol LEFT JOIN k b ON b.key "
    "= split_part(symbol, '.', 1)"
)(
    lambda s, d: J.join_symbol_or_code(
        one_day(bars(s, d)),
        dims(s, d).select(F.when(F.col("total_shares") > 2e7, F.col("symbol")).otherwise(F.col("code")).alias("key"), "industry"),
        "key",
        ["industry"]
    ).select("symbol", "industry")
)
_CAL = (
    "cal AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev_date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT "
    "DISTINCT date FROM bars))"
)
query(
    "j07_prior_day_state",
    B.with_("bars", more=_CAL) + "SELECT b.symbol, b.date, p.close AS prev_day_close FROM bars b JOIN cal USING (date) LEFT JOIN bars p ON p.symbol = b.symbol "
    "AND p.date = cal.prev_date"
)(lambda s, d: J.prior_day_state(bars(s, d), "close", "prev_day_close").select("symbol", "date", "prev_day_close"))
_REB = "reb AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars WHERE isodow(date) = 1))"
query(
    "j08_next_rebalance",
    B.with_("bars", more=_REB) + "SELECT b.symbol, b.date, r.next_date, b.close, n.close AS next_close FROM bars b JOIN reb r USING (date) LEFT JOIN bars "
    "n ON n.symbol = b.symbol AND n.date = r.next_date"
)(
    lambda s, d: J.next_rebalance_price(bars(s, d).filter(F.weekday("date") == 0), bars(s, d))
)
query("j09_mark_hits", B.with_("bars") + "SELECT symbol, date, amount > 100000 AS hit FROM bars")(
    lambda s, d: J.mark_hits(bars(s, d), bars(s, d).filter("amount > 100000"), ["symbol", "date"]).select("symbol", "date", "hit")
)
query(
    "j10_pool_diff",
    B.with_(
        "bars",
        more="a AS (SELECT DISTINCT symbol FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-01-05'), z AS (SELECT DISTINCT "
        "symbol FROM bars WHERE date BETWEEN DATE '1997-01-06' AND DATE '1997-01-10')"
    ) + "SELECT symbol, 'new' AS change FROM (SELECT * FROM z EXCEPT SELECT * FROM a) UNION ALL SELECT symbol, 'dropped' FROM (SELECT "
    "* FROM a EXCEPT SELECT * FROM z)"
)(
    lambda s, d: J.pool_diff(
        bars(s, d).filter("date BETWEEN DATE '1997-01-01' AND DATE '1997-01-05'"),
        bars(s, d).filter("date BETWEEN DATE '1997-01-06' AND DATE '1997-01-10'")
    )
)


def depth(s, d):
    """An order book: what stands on the ask and bid side follows the shares."""
    k = (F.col("total_shares") / 1e6).cast("bigint") % 4
    asks = F.when(k == 0, F.array(F.lit(0), F.lit(5))).when(k == 1, F.array(F.lit(7))).when(k == 2, F.array().cast("array<int>")).cast("array<bigint>")
    return dims(s, d).select(
        "symbol",
        asks.alias("ask_volumes"),
        F.array(F.when(k == 0, 9).otherwise(k * 4), F.lit(1)).cast("array<bigint>").alias("bid_volumes")
    )


_SEALS = (
    "dp AS (SELECT symbol, (total_shares / 1e6)::BIGINT % 4 AS k FROM instruments), sl AS (SELECT symbol, CASE k WHEN 0 THEN "
    "true WHEN 1 THEN false END AS sealed_up, CASE k WHEN 0 THEN 9 ELSE k * 4 END AS bid1_vol FROM dp)"
)
query("j11_seal_overlay", LIMITS.rstrip() + f""",
{_SEALS}
SELECT symbol, date, CASE WHEN sealed_up IS NULL THEN 'pending' WHEN sealed_up THEN 'real' ELSE 'fake' END AS seal_status, coalesce(sealed_up, true) AS is_limit_up, bid1_vol FROM lim LEFT JOIN sl USING (symbol) WHERE signal_limit_up""")(
    lambda s, d: J.seal_overlay(limit_frame(s, d), J.depth_seals(depth(s, d))).filter("signal_limit_up").select(
        "symbol",
        "date",
        "seal_status",
        "is_limit_up",
        "bid1_vol"
    )
)
query("j12_fill_missing_names", B.with_("instruments") + "SELECT symbol, name FROM instruments")(
    lambda s, d: J.fill_missing_names(
        dims(s, d).select("symbol", F.when(F.col("balance") > 0, "").otherwise(F.col("name")).alias("name")),
        dims(s, d).select("symbol", "name")
    ).select("symbol", "name")
)
query("j13_asset_type", B.with_("bars", "instruments") + "SELECT DISTINCT symbol, type AS asset_type FROM bars JOIN instruments USING (symbol)")(
    lambda s, d: J.resolve_asset_type(bars(s, d).select("symbol").distinct(), dims(s, d).filter("type = 'etf'"), dims(s, d).filter("type = 'index'"))
)
query(
    "j14_range_join",
    B.with_(
        "bars",
        more=f"n AS (SELECT *, row_number() OVER ({W}) AS n FROM bars)"
    ) + "SELECT symbol, entry_n, n, close FROM (SELECT symbol, amount, n AS entry_n, unnest([1, 2, 3, 4, 5]) + n AS n, unnest([c1, c2, c3, c4, c5]) AS close, last FROM (SELECT *, "
    + ", ".join(f"lead(close, {k}) OVER ({W}) AS c{k}" for k in range(1, 6))
    + ", count(*) OVER (PARTITION BY symbol) AS last FROM n) l) u WHERE amount > 100000 AND n <= last"
)(
    lambda s, d: (
        lambda nb: J.entry_exit_range_join(
            nb.filter("amount > 100000").select("symbol", F.col("n").alias("entry_n")),
            nb.select("symbol", "n", "close"),
            5
        )
    )(J.numbered(bars(s, d))).select("symbol", "entry_n", F.col("n").cast("bigint").alias("n"), "close")
)
query(
    "j15_dedup_last",
    B.with_("bars") + "SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY symbol"
)(lambda s, d: J.dedup_last(bars(s, d), ["symbol"], ["date"]).select("symbol", "date", "close"))
query(
    "j16_benchmark_excess",
    B.with_(
        "bars",
        "brand_bars",
        more="c AS (SELECT date, avg(close) AS value FROM bars GROUP BY 1), k AS (SELECT date, avg(close) AS close FROM brand_bars GROUP "
        "BY 1), j AS (SELECT * FROM c JOIN k USING (date))"
    ) + "SELECT arg_max(value, date) / arg_min(value, date) - 1 AS total_return, arg_max(close, date) / arg_min(close, date) - 1 "
    "AS benchmark_return, arg_max(value, date) / arg_min(value, date) - arg_max(close, date) / arg_min(close, date) AS excess_return FROM j"
)(
    lambda s, d: J.benchmark_excess(
        bars(s, d).groupBy("date").agg(F.avg("close").alias("value")),
        B.brand_bars(s, d).groupBy("date").agg(F.avg("close").alias("close"))
    )
)
query(
    "j17_normalize_symbol",
    B.with_("instruments") + "SELECT code, CASE WHEN balance > 3000 THEN symbol WHEN code LIKE '6%' THEN code || '.SH' ELSE code || '.SZ' END AS symbol FROM instruments"
)(lambda s, d: J.normalize_symbol(dims(s, d).select("code"), dims(s, d).filter("balance > 3000")).select("code", "symbol"))
query(
    "j18_resolve_codes",
    B.with_("instruments") + "SELECT code, CASE WHEN balance > 0 THEN symbol END AS symbol, CASE WHEN balance > 0 THEN name END AS name, balance > 0 AS "
    "matched, balance > 5000 AS listed FROM instruments"
)(
    lambda s, d: J.resolve_code_list(
        dims(s, d).select("code"),
        dims(s, d).filter("balance > 0"),
        dims(s, d).filter("balance > 5000")
    ).select("code", "symbol", "name", "matched", "listed")
)

# Breadth.
query(
    "a01_symbols_lagging",
    B.with_("bars") + "SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol HAVING max(date) < DATE '2001-10-29'"
)(lambda s, d: A.symbols_lagging(bars(s, d), "2001-10-29"))
query(
    "a02_latest_two_quotes",
    B.with_(
        "bars",
        more="r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE date <= DATE '1998-06-30'), "
        "t AS (SELECT symbol, max(CASE WHEN k = 1 THEN date END) AS date, max(CASE WHEN k = 1 THEN close END) AS close, max(CASE "
        "WHEN k = 2 THEN close END) AS prev_close FROM r GROUP BY symbol)"
    ) + "SELECT *, close - prev_close AS change, (close - prev_close) / nullif(prev_close, 0) AS change_pct FROM t"
)(lambda s, d: A.latest_two_quotes(bars(s, d), "1998-06-30"))
_RATIO = lambda a, b: f"round_even({a} / nullif({b}, 0)::DOUBLE, 4)"
_UP, _DOWN = "count_if(change_pct > 0)", "count_if(change_pct < 0)"
BREADTH = f"""br AS (SELECT date, count(*) AS total, {_UP} AS up, {_DOWN} AS down, count_if(change_pct = 0) AS flat, {_RATIO(_UP, 'count(*)')} AS up_share, avg(change_pct) AS avg_pct, count_if(change_pct >= 0.03) AS strong_up,
 count_if(change_pct <= -0.03) AS strong_down, sum(amount) AS total_amount, avg(amount) AS avg_amount, list_sort(list(change_pct) FILTER (change_pct IS NOT NULL))[count(change_pct) // 2 + 1] AS median_pct FROM ind GROUP BY date)"""
query(
    "a03_a04_market_breadth",
    B.with_("bars", more=f"{IND},\n{BREADTH}") + "SELECT * FROM br"
)(lambda s, d: A.market_breadth(indicator_frame(s, d, {"change_pct"})))
query(
    "a05_board_breakdown",
    B.with_("bars", more=IND) + f"SELECT {BOARD} AS board, count(*) AS n, {_UP} AS up, {_DOWN} AS down, sum(amount) AS amount, {_RATIO(_UP, 'count(*)')} AS "
    f"up_share FROM ind GROUP BY 1",
    2
)(lambda s, d: A.board_breakdown(indicator_frame(s, d, {"change_pct"})))
LSTATS = (
    f"ls AS (SELECT date, count_if(signal_limit_up) AS limit_up, count_if(signal_broken_limit_up) AS broken, "
    f"count_if(signal_limit_down) AS limit_down, max(consecutive_limit_ups) AS max_streak, {_RATIO('count_if(signal_limit_up)', '(count_if(signal_limit_up) + count_if(signal_broken_limit_up))')} "
    f"AS seal_rate FROM $T GROUP BY date)"
)
query(
    "a06_limit_stats",
    B.with_("bars", "factors", "instruments", more=f"{ADJ},\n{LIM},\n{LSTATS.replace('$T', 'lim')}") + "SELECT * FROM ls"
)(lambda s, d: A.limit_stats(limit_frame(s, d)))
query(
    "a07_limit_tiers",
    LIMITS.rstrip() + ",\nt AS (SELECT *, row_number() OVER (PARTITION BY consecutive_limit_ups ORDER BY amount DESC, symbol) AS rank FROM lim "
    "WHERE consecutive_limit_ups >= 1)\nSELECT consecutive_limit_ups, count(*) AS n, list(symbol ORDER BY rank) FILTER (rank "
    "<= 5) AS symbols FROM t GROUP BY 1"
)(lambda s, d: A.limit_tiers(limit_frame(s, d)))
_ABOVE = lambda m: f"{_RATIO(f'count_if(close >= {m})', 'count(*)')} AS above_{m}"
TREND = (
    f"tr AS (SELECT date, {', '.join(_ABOVE(f'ma{k}') for k in (5, 20, 60))}, count_if(close >= high_60d) AS new_highs, "
    f"count_if(close <= low_60d) AS new_lows FROM $T GROUP BY date)"
)
_TREND_COLS = {"ma5", "ma20", "ma60", "signal_n_day_high", "signal_n_day_low"}
query(
    "a08_trend_counts",
    B.with_("bars", more=f"{IND},\n{TREND.replace('$T', 'ind')}") + "SELECT * FROM tr"
)(lambda s, d: A.trend_counts(indicator_frame(s, d, _TREND_COLS)))
ACTIVE = (
    f"ac AS (SELECT date, coalesce(avg(turnover_rate), 0.0) AS avg_turnover, count_if(turnover_rate >= 5) AS high_turnover, coalesce(avg(vol_ratio_5d), 1.0) "
    f"AS avg_vol_ratio, {_RATIO('count_if(vol_ratio_5d >= 1.5)', 'count(*)')} AS active_share FROM wide GROUP BY date)"
)
_OVER_COLS = _TREND_COLS | {"vol_ratio_5d", "change_pct", "symbol", "date"}
query("a09_activity_stats", WIDE_ALL.rstrip() + f",\n{ACTIVE}\nSELECT * FROM ac")(lambda s, d: A.activity_stats(strategy_frame(s, d, _OVER_COLS)))
_BAND = (
    "CASE WHEN p >= 0.05::DOUBLE THEN 7 WHEN p >= 0.03::DOUBLE THEN 6 WHEN p >= 0.01::DOUBLE THEN 5 WHEN p >= 0 THEN 4 WHEN p "
    ">= -0.01::DOUBLE THEN 3 WHEN p >= -0.03::DOUBLE THEN 2 WHEN p >= -0.05::DOUBLE THEN 1 WHEN p IS NOT NULL THEN 0 END"
)
_BANDS = ", ".join(f"({k}, '{name}')" for k, (_, name) in enumerate(A.BANDS))
query(
    "a10_pct_bands",
    B.with_(
        "bars",
        more=f"{IND}, c AS (SELECT {_BAND} AS band, count(*) AS n FROM (SELECT change_pct AS p FROM ind) GROUP BY 1)"
    ) + f"SELECT b.band::INTEGER AS band, b.label, coalesce(c.n, 0) AS n, round_even(coalesce(c.n, 0) / (SELECT sum(n) FROM c WHERE "
    f"band IS NOT NULL)::DOUBLE, 4) AS share FROM (VALUES {_BANDS}) b(band, label) LEFT JOIN c USING (band)"
)(lambda s, d: A.pct_bands(indicator_frame(s, d, {"change_pct"})))
_CL = lambda x: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"
_Z = lambda c: f"coalesce({c}::DOUBLE, 0.0)"
_SC = lambda v, low, high: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(round(({v} - ({low})::DOUBLE) / (({high})::DOUBLE - ({low})::DOUBLE) * 100, 9), 0)))"
_MX = lambda *parts: f"round_even(round({' + '.join(f'{_SC(*p)} * {w}::DOUBLE' for p, w in parts)}, 9), 0)"
_ALL100 = lambda v: f"({v}) / total::DOUBLE * 100"
_RADAR = {
    "radar_index": _SC("avg_index_pct", -2.5, 2.5),
    "radar_profit": _MX(
        (("up_pct", 20, 80), 0.45),
        ((_Z("avg_pct"), -0.02, 0.02), 0.25),
        ((_Z("median_pct"), -0.02, 0.02), 0.20),
        ((_ALL100("strong_up - strong_down"), -8, 8), 0.10)
    ),
    "radar_money": _MX((("vol_ratio", 0.6, 1.8), 0.70), (("high_vol_pct", 2, 12), 0.30)),
    "radar_speculation": _MX((("limit_up", 5, 90), 0.25), (("seal_rate", 30, 85), 0.35), (("max_boards", 1, 8), 0.25), (("tier2", 0, 30), 0.15)),
    "radar_resilience": "100 - " + _MX((("down_pct", 20, 80), 0.55), ((_ALL100("strong_down"), 1, 12), 0.45)),
    "radar_mainline": "CASE WHEN mainline_avg IS NULL THEN 50.0::DOUBLE ELSE " + _MX(
        (("mainline_avg", -0.005, 0.03), 0.65),
        (("mainline_cover_pct", 1, 12), 0.35)
    ) + " END",
}
_PC = lambda a, b: f"coalesce(({a}) * 100.0::DOUBLE / nullif({b}, 0), 0.0::DOUBLE)"
_LUP = "count(*) FILTER (WHERE coalesce(signal_limit_up, false) OR consecutive_limit_ups > 0)"
_BRK = "count(*) FILTER (WHERE signal_broken_limit_up)"
_AB = ", ".join(
    f"count(*) FILTER (WHERE close >= ma{k}) AS above_ma{k}, {_PC(f'count(*) FILTER (WHERE close >= ma{k})', 'count(*)')} AS above_ma{k}_pct" for k in (5, 20, 60)
)
_BN = ", ".join(
    f"count(*) FILTER (WHERE ({_BAND.replace('p >=', 'change_pct >=').replace('p IS', 'change_pct IS')}) = {k}) AS band{k}" for k in range(len(A.BANDS))
)
OVERVIEW = f"""{WIDE}, {EXPLODED},
live AS (SELECT * FROM wide WHERE coalesce(type, '') <> 'index' AND (coalesce(volume, 0) > 0 OR coalesce(change_pct, 0.0) <> 0)),
lb AS (SELECT 'concept' AS kind, symbol, label FROM lab UNION SELECT 'industry', symbol, split_part(industry, '-', 2) FROM instruments),
lm AS (SELECT date, kind, label, avg(change_pct) AS avg_pct, count(*) AS n FROM live JOIN lb USING (symbol) GROUP BY ALL),
ml AS (SELECT date, max(avg_pct) AS mainline_avg, max(n) AS mainline_n FROM (SELECT * FROM lm WHERE avg_pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, kind ORDER BY round(avg_pct, 9) DESC, label) <= 3) AS t GROUP BY date),
ix AS (SELECT date, avg(change_pct) * 100 AS avg_index_pct FROM wide WHERE type = 'index' GROUP BY date),
sm AS (SELECT date, count(*) AS total, {_UP} AS up, {_DOWN} AS down, avg(change_pct) AS avg_pct, list_sort(list(change_pct) FILTER (change_pct IS NOT NULL))[count(change_pct) // 2 + 1] AS median_pct,
  count_if(change_pct >= 0.03) AS strong_up, count_if(change_pct <= -0.03) AS strong_down, sum(amount) AS total_amount, avg(amount) AS avg_amount,
  {_LUP} AS limit_up, {_BRK} AS broken, count_if(signal_limit_down) AS limit_down, max(coalesce(consecutive_limit_ups, 0)) AS max_boards, count_if(consecutive_limit_ups >= 2) AS tier2, {_PC(_LUP, f'({_LUP} + {_BRK})')} AS seal_rate,
  {_AB}, count(*) FILTER (WHERE close >= high_60d) AS new_high, count(*) FILTER (WHERE close <= low_60d) AS new_low,
  avg(turnover_rate) AS avg_turnover, count_if(turnover_rate >= 5) AS high_turnover, coalesce(avg(vol_ratio_5d), 1.0::DOUBLE) AS vol_ratio, {_PC('count(*) FILTER (WHERE vol_ratio_5d >= 1.5)', 'count(*)')} AS high_vol_pct, {_BN} FROM live GROUP BY date),
ov0 AS (SELECT sm.*, mainline_avg, coalesce(avg_index_pct, 0.0::DOUBLE) AS avg_index_pct, total - up - down AS flat, {_PC('up', 'total')} AS up_pct, {_PC('down', 'total')} AS down_pct, {_PC('mainline_n', 'total')} AS mainline_cover_pct FROM sm LEFT JOIN ml USING (date) LEFT JOIN ix USING (date)),
ov1 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _RADAR.items())} FROM ov0),
ov2 AS (SELECT *, round_even(round(({' + '.join(_RADAR)}) / 6, 9), 0) AS emotion FROM ov1),
ov AS (SELECT *, CASE WHEN emotion >= 70 THEN 'strong' WHEN emotion >= 55 THEN 'warm' WHEN emotion >= 45 THEN 'swinging' WHEN emotion >= 30 THEN 'cool' ELSE 'frozen' END AS mood FROM ov2)"""
_OVER = B.with_("bars", "factors", "instruments", more=OVERVIEW)


_OVER_READS = (
    "symbol", "date", "close", "volume", "amount", "change_pct", "turnover_rate", "vol_ratio_5d", "ma5", "ma20", "ma60", "signal_n_day_high", "signal_n_day_low",
    "signal_limit_up", "signal_limit_down", "signal_broken_limit_up", "consecutive_limit_ups", "type", "concepts", "industry",
)


def overview_frame(s, d):
    """The wide frame with each symbol's concepts and second-level industry."""
    own = dims(s, d).select(
        "symbol",
        F.array_distinct(J.labels_of(F.col("labels"))).alias("concepts"),
        A.industry_level(F.col("industry"), 2).alias("industry")
    )
    return strategy_frame(s, d, _OVER_COLS).join(own, "symbol", "left")


def overview(s, d):
    return A.market_overview(written(overview_frame(s, d).select(*_OVER_READS), "overview"))


query(
    "a11_emotion_radar",
    _OVER + f"SELECT date, {', '.join(_RADAR)}, emotion, mood FROM ov",
    4
)(lambda s, d: overview(s, d).select("date", *_RADAR, "emotion", "mood"))
query("d01_market_overview", _OVER + "SELECT * FROM ov")(overview)
query(
    "d04_recap_blocks",
    _OVER + "SELECT date, total, up, down, up_pct, avg_pct, total_amount, limit_up, broken, limit_down, max_boards, seal_rate, emotion, mood FROM ov"
)(lambda s, d: A.recap_blocks(overview(s, d)))


def overview_day(s, d, at):
    """The rows of the last date up to ``at``, written once."""
    rows = strategy_frame(s, d, _OVER_COLS | {"type"}).filter("type <> 'index'")
    return written(one_day(rows, at).select("symbol", "date", "amount", "change_pct", "turnover_rate", "consecutive_limit_ups"), "overview_day")


_TOPS = {
    "top_gainers": ("change_pct", "DESC"),
    "top_losers": ("change_pct", "ASC"),
    "turnover_leaders": ("amount", "DESC"),
    "active_leaders": ("turnover_rate", "DESC")
}
_TOP_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS block, row_number() OVER (ORDER BY {c} {way}, symbol)::INTEGER AS rank, symbol AS name, 1::BIGINT AS n, "
    f"{c}::DOUBLE AS value FROM dy WHERE {c} IS NOT NULL QUALIFY rank <= 8" for k,
    (c, way) in _TOPS.items()
)
_END_SQL = " UNION ALL ".join(
    f"SELECT kind || '_{end}' AS block, row_number() OVER (PARTITION BY kind ORDER BY round(value, 9) {way}, name)::INTEGER AS "
    f"rank, name, n, value FROM dm QUALIFY rank <= 5" for end,
    way in (("leading", "DESC"), ("lagging", "ASC"))
)
query("d01_overview_lists", _OVER.rstrip() + f""",
dy AS (SELECT * FROM live WHERE date = (SELECT max(date) FROM live WHERE date <= DATE '1998-06-30')),
dm AS (SELECT kind, label AS name, count(*) AS n, avg(change_pct) AS value FROM dy JOIN lb USING (symbol) WHERE change_pct IS NOT NULL GROUP BY ALL),
bd AS (SELECT {BOARD} AS name, count(*) AS n, sum(amount) AS value FROM dy GROUP BY 1), ti AS (SELECT consecutive_limit_ups AS k, count(*) AS n, sum(amount) AS value FROM dy WHERE consecutive_limit_ups > 0 GROUP BY 1)
SELECT 'boards' AS block, row_number() OVER (ORDER BY value DESC, name)::INTEGER AS rank, name, n, value FROM bd UNION ALL SELECT 'tiers', row_number() OVER (ORDER BY k DESC)::INTEGER, k::VARCHAR, n, value FROM ti UNION ALL {_TOP_SQL} UNION ALL {_END_SQL}""")(
    lambda s, d: (
        lambda day, own: A.overview_lists(
            day,
            own.select(
                F.lit("concept").alias("kind"),
                "symbol",
                F.explode(F.array_distinct(J.labels_of(F.col("labels")))).alias("label")
            ).unionByName(own.select(F.lit("industry").alias("kind"), "symbol", A.industry_level(F.col("industry"), 2).alias("label")))
        )
    )(
        overview_day(s, d, "1998-06-30"), dims(s, d)
    )
)
query(
    "d02_market_snapshot",
    B.with_("bars", "instruments", more=IND) +
    "SELECT symbol, date, change_pct, amount, close * total_shares AS market_cap, close * float_shares AS float_cap FROM ind "
    "LEFT JOIN instruments USING (symbol)",
    2
)(
    lambda s, d: A.market_snapshot(
        J.with_instruments(indicator_frame(s, d, {"change_pct"}), dims(s, d), ["total_shares", "float_shares"])
    ).drop("close")
)
def ladder_sql(way: str) -> str:
    left, sealed, volume = ("signal_broken_limit_up", "sealed_up", "bid1") if way == "up" else ("signal_limit_down_recovery", "sealed_down", "ask1")
    return LIMITS.rstrip() + f""",
dp AS (SELECT symbol, (total_shares / 1e6)::BIGINT % 4 AS k FROM instruments), bk AS (SELECT symbol, CASE k WHEN 0 THEN 0 WHEN 1 THEN 7 END AS ask1, CASE k WHEN 0 THEN 9 ELSE k * 4 END AS bid1 FROM dp),
sl AS (SELECT *, CASE WHEN ask1 IS NOT NULL THEN ask1 = 0 AND bid1 > 0 END AS sealed_up, CASE WHEN ask1 IS NOT NULL THEN bid1 = 0 AND ask1 > 0 END AS sealed_down FROM bk),
l AS (SELECT symbol, date, coalesce(signal_limit_{way}, false) AS u, coalesce({left}, false) AS b, consecutive_limit_{way}s AS c, {lag_sql(f'consecutive_limit_{way}s')} AS p FROM lim),
x AS (SELECT symbol, date, CASE WHEN u THEN 'main' WHEN b THEN 'broken' WHEN p >= 1 THEN 'failed' END AS status, (CASE WHEN u THEN c ELSE coalesce(p, 0) + 1 END)::INTEGER AS boards FROM l),
ladder AS (SELECT x.*, {volume} AS seal_volume, CASE WHEN status <> 'main' THEN NULL WHEN {sealed} IS NULL THEN 'pending' WHEN {sealed} THEN 'real' ELSE 'fake' END AS seal_status FROM x LEFT JOIN sl USING (symbol) WHERE status IS NOT NULL)
"""


def ladder(s, d, way):
    return A.limit_ladder(
        limit_frame(s, d).withColumn("prev_streak", lag(f"consecutive_limit_{way}s")),
        way,
        J.depth_seals(depth(s, d))
    ).select("symbol", "date", "status", "boards", "seal_volume", "seal_status")


for _way, _name in (("up", "d03_limit_ladder"), ("down", "d03_limit_down_ladder")):
    query(_name, ladder_sql(_way) + "SELECT * FROM ladder")(lambda s, d, way=_way: ladder(s, d, way))
_TIERS = ", ".join(
    [f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in ("main", "broken", "failed")] + [
        f"count(*) FILTER (WHERE seal_status = '{k}') AS \"{k}\"" for k in ("real", "fake", "pending")
    ]
)
query(
    "d03_ladder_tiers",
    ladder_sql("up") + f"SELECT date, boards, {_TIERS} FROM ladder GROUP BY 1, 2"
)(lambda s, d: A.ladder_tiers(ladder(s, d, "up")))
_DAY_IND = "day AS (SELECT * FROM ind WHERE date = (SELECT max(date) FROM ind WHERE date <= DATE '1998-06-30'))"
DRANK = (
    "dr AS (SELECT label, count(*) AS n, avg(change_pct) AS avg_pct, count_if(change_pct > 0) AS up, count_if(change_pct < 0) "
    "AS down, sum(amount) AS amount, arg_max(symbol, (change_pct, symbol)) AS leader FROM day JOIN lab USING (symbol) WHERE "
    "change_pct IS NOT NULL GROUP BY label), dk AS (SELECT *, row_number() OVER (ORDER BY avg_pct DESC, label)::INTEGER AS "
    "rank_top, row_number() OVER (ORDER BY avg_pct, label)::INTEGER AS rank_low FROM dr)"
)
query(
    "a12_dimension_rank",
    B.with_("bars", "instruments", more=f"{IND}, {_DAY_IND}, {EXPLODED}, {DRANK}") + "SELECT * FROM dk WHERE rank_top <= 5 OR rank_low <= 5"
)(lambda s, d: A.dimension_rank(one_day(indicator_frame(s, d, {"change_pct"})), dims(s, d), "labels"))
query(
    "a13_industry_level",
    B.with_("instruments") + "SELECT symbol, split_part(industry, '-', 1) AS l1, split_part(industry, '-', 2) AS l2, split_part(industry, '-', 2) AS l3 FROM instruments"
)(lambda s, d: dims(s, d).select("symbol", *[A.industry_level(F.col("industry"), k).alias(f"l{k}") for k in (1, 2, 3)]))
MEANS = "cm AS (SELECT date, label, avg(change_pct) AS avg_pct FROM ind JOIN lab USING (symbol) WHERE change_pct IS NOT NULL GROUP BY 1, 2)"


def means(s, d):
    return R.concept_daily_mean(J.explode_dimension_join(indicator_frame(s, d, {"change_pct"}), dims(s, d), "labels"))


_CM = B.with_(
    "bars",
    "instruments",
    more=f"{IND}, {EXPLODED}, {MEANS}, ld AS (SELECT DISTINCT date FROM cm ORDER BY date DESC LIMIT 10), rk AS (SELECT *, row_number() "
    f"OVER (PARTITION BY date ORDER BY avg_pct DESC, label)::INTEGER AS rank FROM cm WHERE date IN (SELECT date FROM ld))"
)
query("a14_concept_daily_mean", _CM + "SELECT * FROM cm")(means)
query(
    "a15_rotation_matrix",
    _CM + "SELECT date, list(label ORDER BY rank) AS labels FROM rk GROUP BY date"
)(lambda s, d: R.rotation_matrix(means(s, d), 10, B.bar_dates(s, d)))
_VECTORS = _CM.rstrip() + """,
sz AS (SELECT count(*) AS days FROM ld),
vr AS (SELECT label, list(rank ORDER BY date) AS ra, list(round_even(avg_pct, 4) ORDER BY date) AS pa, count(*) AS k FROM rk GROUP BY label),
vx AS (SELECT label, days, list_concat(ra, list_transform(range(days - k), lambda i: 999)) AS ranks, list_concat(pa, list_transform(range(days - k), lambda i: 0.0::DOUBLE)) AS pcts FROM vr, sz),
vy AS (SELECT *, list_avg(ranks) AS mean, list_avg(ranks[-least(3, days):]) AS recent, ranks[1] AS first, ranks[-1] AS latest FROM vx),
vz AS (SELECT *, round_even(mean, 1) AS avg_rank, round_even(sqrt(list_sum(list_transform(ranks, lambda x: (x - mean) * (x - mean))) / days), 1) AS rank_std FROM vy)"""
_CLASS = f"""{_VECTORS},
cl AS (SELECT 'persistent_leaders' AS class, label, ranks, pcts, avg_rank, rank_std, avg_rank AS a, 0.0 AS b FROM vz WHERE recent <= 10 AND latest <= 10
  UNION ALL SELECT 'rising', label, ranks, pcts, avg_rank, rank_std, latest - first, 0.0 FROM vz WHERE first > 30 AND latest <= 20 AND first - latest >= 20
  UNION ALL SELECT 'fading', label, ranks, pcts, avg_rank, rank_std, first - latest, 0.0 FROM vz WHERE first <= 10 AND latest > 30 AND latest - first >= 20
  UNION ALL SELECT 'institutional', label, ranks, pcts, avg_rank, rank_std, rank_std, avg_rank FROM vz WHERE rank_std <= 5 AND avg_rank <= 20
  UNION ALL SELECT 'hot_money', label, ranks, pcts, avg_rank, rank_std, -rank_std, 0.0 FROM vz WHERE rank_std >= 20)
SELECT * EXCLUDE (a, b), row_number() OVER (PARTITION BY class ORDER BY a, b, label)::INTEGER AS place FROM cl QUALIFY place <= 8"""
query("a16_rotation_signals", _CLASS)(lambda s, d: R.rotation_signals(means(s, d), 10, B.bar_dates(s, d)))
query("a16_rank_vectors", _VECTORS + " SELECT label, days::INTEGER AS days, ranks, pcts, avg_rank, rank_std, recent, first, latest FROM vz")(lambda s, d: R.rank_vectors(means(s, d), 10, B.bar_dates(s, d)))
_C01 = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
_LOGP = lambda x, most: _C01(f"ln(1 + greatest({x}, 0.0)) / ln(1 + {most}::DOUBLE)")
_HEAT_COLS = {"symbol", "date", "amount", "change_pct", "turnover_rate", "vol_ratio_5d", "consecutive_limit_ups", "float_shares"}
query("a17_concept_heat", WIDE_ALL.rstrip() + f""",
day AS (SELECT *, close * float_shares AS market_cap FROM wide WHERE date = (SELECT max(date) FROM wide WHERE date <= DATE '1998-06-30')), {EXPLODED},
h AS (SELECT label, symbol, change_pct AS p, turnover_rate, vol_ratio_5d, amount,
  100 * ({_C01('(coalesce(change_pct, 0.0) + 0.02::DOUBLE) / 0.12::DOUBLE')} * 0.35::DOUBLE + {_LOGP('coalesce(turnover_rate, 0.0)', 30)} * 0.22::DOUBLE + {_LOGP('coalesce(amount, 0.0)', 20_000_000_000)} * 0.18::DOUBLE
   + {_LOGP('coalesce(market_cap, 0.0)', 300_000_000_000)} * 0.15::DOUBLE + {_C01('(coalesce(vol_ratio_5d, 1.0) - 1) / 4')} * 0.07::DOUBLE + {_C01('coalesce(consecutive_limit_ups, 0) / 5')} * 0.03::DOUBLE) AS leader_score
  FROM day JOIN lab USING (symbol)),
g AS (SELECT label, count(*) AS n, avg(p) AS avg_pct, median(p) AS median_pct, count_if(p > 0) AS up, count_if(p < 0) AS down, count(p) AS known, count_if(p >= 0.05::DOUBLE) AS strong, count_if(p <= -0.05::DOUBLE) AS weak,
  coalesce(sum(amount), 0.0) AS amount, avg(turnover_rate) AS avg_turnover, avg(vol_ratio_5d) AS avg_vol_ratio, arg_max(symbol, (leader_score, symbol)) AS leader, max(leader_score) AS leader_score FROM h GROUP BY label),
u AS (SELECT *, CASE WHEN known > 0 THEN up / known ELSE 0.0 END AS up_rate, greatest(1.0, n * 0.18::DOUBLE) AS many, coalesce(avg_pct, 0.0) AS mean FROM g)
SELECT label, n, avg_pct, median_pct, up, down, strong, weak, amount, avg_turnover, avg_vol_ratio, leader, leader_score, greatest(n - up - down, 0) AS flat, up_rate,
  100 * ({_C01('(mean + 0.02::DOUBLE) / 0.09::DOUBLE')} * 0.38::DOUBLE + {_C01('(up_rate - 0.35::DOUBLE) / 0.55::DOUBLE')} * 0.2::DOUBLE + {_C01('strong / many')} * 0.16::DOUBLE + {_LOGP('amount', 80_000_000_000)} * 0.12::DOUBLE + {_C01('leader_score / 100')} * 0.14::DOUBLE) AS heat,
  100 * ({_C01('(0.01::DOUBLE - mean) / 0.08::DOUBLE')} * 0.55::DOUBLE + {_C01('weak / many')} * 0.45::DOUBLE) AS risk FROM u""", 5)(
    lambda s, d: R.concept_heat(
        J.explode_dimension_join(one_day(strategy_frame(s, d, _HEAT_COLS | {"close"})).withColumn("market_cap", F.col("close") * F.col("float_shares")), dims(s, d), "labels")
    )
)
query(
    "a18_group_means",
    B.with_("instruments") + "SELECT type, avg(total_shares) AS total_shares, avg(float_shares) AS float_shares, avg(balance) AS balance FROM instruments GROUP BY type",
    3
)(lambda s, d: A.group_numeric_means(dims(s, d).select("type", "symbol", "total_shares", "float_shares", "balance"), "type"))
query(
    "a19_quote_metrics",
    B.with_("bars", more=IND) + f"SELECT date, avg(change_pct) AS avg_pct, {_UP} AS up, {_DOWN} AS down, count_if(change_pct = 0) AS flat FROM ind GROUP BY date"
)(lambda s, d: A.quote_metrics(indicator_frame(s, d, {"change_pct"}), "date"))
query(
    "a20_analysis_template",
    B.with_("instruments") + "SELECT industry, count(*) AS n, avg(balance) AS avg_balance, max(total_shares) AS most FROM instruments GROUP BY industry "
    "ORDER BY avg_balance DESC, industry LIMIT 10",
    4
)(
    lambda s, d: A.analysis_template(
        dims(s, d),
        ["industry"],
        [("n", "count", "symbol"), ("avg_balance", "avg", "balance"), ("most", "max", "total_shares")],
        ("avg_balance", True),
        10
    )
)
_IN = lambda n, c: f"CASE WHEN rn <= {n} THEN {c} END"
_TAIL = [f"sum({_IN(n, 'close')}) AS sum_close_{n}" for n in (4, 9, 19, 29, 59)] + [
    f"sqrt(sum(pow({_IN(19, 'close')}, 2))) AS sum_sq_19",
    f"max({_IN(59, 'close')}) AS max_close_59",
    f"min({_IN(59, 'close')}) AS min_close_59"
]
_TAIL += [
    f"max(CASE WHEN rn = {n} THEN close END) AS close_{n}_ago" for n in (1, 5, 10, 20, 30, 60)
] + [f"sum({_IN(n, 'volume')}) AS sum_volume_{n}" for n in (4, 5, 9)] + [f"max({_IN(8, 'high')}) AS max_high_8", f"min({_IN(8, 'low')}) AS min_low_8"]
query(
    "a21_tail_state",
    B.with_(
        "bars",
        more="t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars)"
    ) + f"SELECT symbol, {', '.join(_TAIL)} FROM t WHERE rn <= 60 GROUP BY symbol"
)(lambda s, d: A.tail_state(bars(s, d)).withColumn("sum_sq_19", F.sqrt("sum_sq_19")))
query(
    "a22_minute_vwap",
    B.with_("minutes") + "SELECT symbol, datetime::DATE AS date, coalesce(sum(amount) / nullif(sum(volume), 0), arg_max(close, datetime)) AS vwap "
    "FROM minutes GROUP BY 1, 2"
)(lambda s, d: A.minute_vwap(B.minutes(s, d)))
query(
    "a23_minute_completeness",
    B.with_("minutes") + "SELECT symbol, datetime::DATE AS date, count(*) AS bars, count(*) / 60.0::DOUBLE AS share, count(*) >= 54 AS complete FROM "
    "minutes GROUP BY 1, 2"
)(lambda s, d: A.minute_completeness(B.minutes(s, d), 60))
_STMT = "st AS (SELECT symbol, last_day(date) AS period_end, sum(amount) AS revenue FROM bars GROUP BY 1, 2)"


def statements(s, d):
    return bars(s, d).groupBy("symbol", F.last_day("date").alias("period_end")).agg(F.sum("amount").alias("revenue"))


query(
    "a24_latest_periods",
    B.with_("bars", more=_STMT) + "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC)::INTEGER AS rank FROM st QUALIFY rank <= 4",
    2
)(lambda s, d: A.latest_periods(statements(s, d), 4))
query(
    "a25_coverage",
    B.with_("bars", "instruments", "minutes") +
    "SELECT 'bars' AS name, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM bars UNION ALL SELECT 'instruments', "
    "count(*), count(DISTINCT symbol) FROM instruments UNION ALL SELECT 'minutes', count(*), count(DISTINCT symbol) FROM minutes"
)(
    lambda s, d: A.coverage({"bars": bars(s, d), "instruments": dims(s, d), "minutes": B.minutes(s, d)})
)
_HITS = (
    "hits AS (SELECT 'a' AS strategy, symbol FROM bars WHERE volume > 80 UNION ALL SELECT 'b', symbol FROM bars WHERE close > "
    "open * 1.5 UNION ALL SELECT 'c', symbol FROM bars WHERE date = DATE '1998-01-05')"
)


def hits(s, d):
    b = bars(s, d)
    pick = lambda n, c: b.filter(c).select(F.lit(n).alias("strategy"), "symbol")
    return pick("a", "volume > 80").unionByName(pick("b", "close > open * 1.5")).unionByName(pick("c", "date = DATE '1998-01-05'"))


query(
    "a26_selection_summary",
    B.with_("bars", more=_HITS) + "SELECT symbol, count(DISTINCT strategy) AS n_strategies, list_sort(list(DISTINCT strategy)) AS strategies FROM hits GROUP BY symbol"
)(lambda s, d: A.selection_summary(hits(s, d))[1])
query(
    "a26_selection_counts",
    B.with_("bars", more=_HITS) + "SELECT strategy, count(DISTINCT symbol) AS n_symbols FROM hits GROUP BY strategy"
)(lambda s, d: A.selection_summary(hits(s, d))[0])
query(
    "a27_bars_from_ticks",
    "SELECT user_id::VARCHAR AS symbol, date_trunc('day', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS "
    "high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2"
)(
    lambda s, d: A.bars_from_ticks(
        B.table(s, d, "events").withColumn("symbol", F.col("user_id").cast("string"))
    ).withColumn("start", F.col("start").cast("timestamp_ntz"))
)

# Top-k, order and sets.
query(
    "t01_top_rows",
    B.with_("bars", more=IND) + "SELECT symbol, date, change_pct FROM ind WHERE change_pct IS NOT NULL AND date = DATE '1998-01-05' ORDER BY change_pct DESC, symbol LIMIT 8"
)(
    lambda s, d: A.top_rows(
        indicator_frame(s, d, {"change_pct"}).filter("date = DATE '1998-01-05'"),
        "change_pct"
    ).select("symbol", "date", "change_pct")
)
query(
    "t03_top_k_per_group",
    B.with_("bars") + "SELECT symbol, date, amount, row_number() OVER (PARTITION BY date ORDER BY amount DESC, symbol)::INTEGER AS rank FROM bars QUALIFY rank <= 3"
)(lambda s, d: A.top_k_per_group(bars(s, d), ["date"], "amount", 3).select("symbol", "date", "amount", "rank"))
query(
    "t04_status_order",
    LIMITS.rstrip() + ",\nx AS (SELECT symbol, date, consecutive_limit_ups AS boards, CASE WHEN signal_limit_up THEN 'main' WHEN "
    "signal_broken_limit_up THEN 'broken' ELSE 'failed' END AS status FROM lim)\nSELECT * FROM x ORDER BY boards DESC, CASE "
    "status WHEN 'main' THEN 0 WHEN 'broken' THEN 1 ELSE 2 END, symbol"
)(
    lambda s, d: A.status_order(
        limit_frame(s, d).select(
            "symbol",
            "date",
            F.col("consecutive_limit_ups").alias("boards"),
            F.when(F.col("signal_limit_up"), "main").when(F.col("signal_broken_limit_up"), "broken").otherwise("failed").alias("status")
        )
    )
)
query(
    "u01_union_by_name",
    B.with_("bars", "instruments") + "SELECT symbol, date, close, NULL::VARCHAR AS name FROM bars UNION ALL SELECT symbol, NULL, NULL, name FROM instruments"
)(lambda s, d: bars(s, d).select("symbol", "date", "close").unionByName(dims(s, d).select("symbol", "name"), allowMissingColumns=True))
query(
    "u02_difference",
    B.with_("bars") + "SELECT DISTINCT date FROM bars WHERE date NOT IN (SELECT date FROM bars WHERE symbol LIKE '600%')"
)(lambda s, d: bars(s, d).select("date").distinct().join(bars(s, d).filter("symbol LIKE '600%'").select("date"), "date", "left_anti"))
query(
    "u03_intersection",
    B.with_("bars") + "SELECT date FROM bars WHERE symbol LIKE '600%' INTERSECT SELECT date FROM bars WHERE symbol LIKE '688%'"
)(lambda s, d: bars(s, d).filter("symbol LIKE '600%'").select("date").intersect(bars(s, d).filter("symbol LIKE '688%'").select("date")))

# Scalar functions.
query(
    "c01_strings",
    B.with_("instruments") + "SELECT symbol, symbol LIKE '300%' AS starts, symbol LIKE '%.SZ' AS ends, contains(name, '#') AS has, regexp_matches(name, "
    "'0{5}') AS rx, upper(name) AS up, split_part(symbol, '.', 2) AS ex, replace(name, '#', '-') AS rep FROM instruments"
)(
    lambda s, d: dims(s, d).select(
        "symbol",
        F.col("symbol").startswith("300").alias("starts"),
        F.col("symbol").endswith(".SZ").alias("ends"),
        F.col("name").contains("#").alias("has"),
        F.col("name").rlike("0{5}").alias("rx"),
        F.upper("name").alias("up"),
        F.split_part("symbol", F.lit("."), F.lit(2)).alias("ex"),
        F.replace("name", F.lit("#"), F.lit("-")).alias("rep")
    )
)
query(
    "c02_split_labels",
    B.with_("instruments", more=EXPLODED) + "SELECT symbol, label FROM lab"
)(lambda s, d: J.exploded_labels(dims(s, d), "labels"))
query(
    "c03_dates",
    B.with_("bars") + "SELECT DISTINCT date, isodow(date)::INTEGER - 1 AS weekday, strftime(date, '%Y-%m') AS month, strftime(date, '%Y%m%d') AS compact FROM bars"
)(
    lambda s, d: bars(s, d).select(
        "date",
        F.weekday("date").alias("weekday"),
        C.month_key(F.col("date")).alias("month"),
        F.date_format("date", "yyyyMMdd").alias("compact")
    ).distinct()
)
_M = "(hour(ts) * 60 + minute(ts))"
_GONE = f"CASE WHEN {_M} < 570 THEN 0 WHEN {_M} < 690 THEN {_M} - 570 + second(ts) / 60 WHEN {_M} < 780 THEN 120 WHEN {_M} < 900 THEN {_M} - 660 + second(ts) / 60 ELSE 240 END"
query("c04_trading_minutes", f"SELECT event_id, ({_GONE})::DOUBLE AS elapsed FROM events")(
    lambda s, d: B.table(s, d, "events").select("event_id", C.trading_minutes_elapsed(F.col("ts").cast("timestamp")).alias("elapsed"))
)
query(
    "c05_math",
    "SELECT event_id, floor(value)::BIGINT AS fl, sqrt(abs(value)) AS sq, pow(value / 100, 2) AS pw, ln(1 + abs(value)) AS lg, "
    "greatest(10.0::DOUBLE, least(50.0::DOUBLE, value)) AS cl, floor(abs(value) * 100 + 0.5) / 100.0::DOUBLE AS hu, "
    "round_even(value, 1) AS he FROM events"
)(
    lambda s, d: B.table(s, d, "events").select(
        "event_id",
        F.floor("value").alias("fl"),
        F.sqrt(F.abs("value")).alias("sq"),
        F.pow(F.col("value") / 100, F.lit(2)).alias("pw"),
        F.log1p(F.abs("value")).alias("lg"),
        C.clip(F.col("value"), 10.0, 50.0).alias("cl"),
        C.half_up(F.abs("value")).alias("hu"),
        C.half_even(F.col("value"), 1).alias("he")
    )
)
query(
    "c06_horizontal",
    B.with_("bars") + "SELECT symbol, date, greatest(open, high, close) AS g, least(open, low, NULL) AS l, coalesce(close > open, false) OR "
    "coalesce(volume > 50, false) AS any_, coalesce(close > open, false) AND coalesce(volume > 50, false) AS all_ FROM bars"
)(
    lambda s, d: bars(s, d).select(
        "symbol",
        "date",
        F.greatest("open", "high", "close").alias("g"),
        F.least(F.col("open"), F.col("low"), F.lit(None).cast("double")).alias("l"),
        C.any_true(F.col("close") > F.col("open"), F.col("volume") > 50).alias("any_"),
        C.all_true(F.col("close") > F.col("open"), F.col("volume") > 50).alias("all_")
    )
)
query(
    "c07_arrays",
    B.with_(
        "instruments",
        more="x AS (SELECT symbol, string_split(labels, ';') AS a FROM instruments)"
    ) + "SELECT symbol, a[1] AS first_, array_to_string(a, '|') AS joined, len(a)::INTEGER AS n FROM x"
)(
    lambda s, d: dims(s, d).select("symbol", F.split("labels", ";").alias("a")).select(
        "symbol",
        F.try_element_at("a", F.lit(1)).alias("first_"),
        F.array_join("a", "|").alias("joined"),
        F.size("a").alias("n")
    )
)
query("c08_json", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")(
    lambda s, d: B.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
)
query(
    "c09_conditional",
    B.with_("instruments") + "SELECT symbol, CASE WHEN balance > 0 THEN 'p' ELSE 'n' END AS w, coalesce(dim_limit_down, dim_limit_up, -1.0) AS co, "
    "nullif(float_shares, 0) AS nf FROM instruments"
)(
    lambda s, d: dims(s, d).select(
        "symbol",
        F.when(F.col("balance") > 0, "p").otherwise("n").alias("w"),
        F.coalesce("dim_limit_down", "dim_limit_up", F.lit(-1.0)).alias("co"),
        F.nullif("float_shares", F.lit(0.0)).alias("nf")
    )
)
query("c10_period_offset", B.with_("bars") + "SELECT DISTINCT date, date - 5 AS d5, date - 60 AS m2, date - 365 AS y1 FROM bars")(
    lambda s, d: bars(s, d).select(
        "date",
        C.period_offset(F.col("date"), 5, "day").alias("d5"),
        C.period_offset(F.col("date"), 2, "month").alias("m2"),
        C.period_offset(F.col("date"), 1, "year").alias("y1")
    ).distinct()
)
