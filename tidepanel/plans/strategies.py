"""The strategies: parameters, entry, exit, scoring weights, stop and longest hold.

Each is a description of Columns over the indicator frame; ``apply`` turns one into
``entry, exit, score`` columns, ``picks`` scores the entries alone, and ``run_all``
evaluates any number of strategies in one pass over one frame.

A parameter ``use_...`` or ``require_...`` switches its condition; the numbers beside
it set bounds. Ids that a strategy doesn't declare are refused.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import DEFAULT_BASIC, basic_filter
from ..operators.windows import by_date, cross_over, cross_under, lag

STOCK, STOCK_ETF = ("stock",), ("stock", "etf")


@dataclass(frozen=True)
class Strategy:
    id: str
    params: dict
    #: Conditions by the id of the parameter that switches each.
    entry: dict[str, Callable[[dict], Column]]
    exit: Callable[[], Column] | None
    scoring: dict[str, float]
    stop: float
    hold: int
    limit: int = 100
    asset_types: tuple[str, ...] = STOCK
    #: What differs from ``DEFAULT_BASIC``.
    basic: dict = field(default_factory=dict)
    timeframes: tuple[str, ...] = ("1d",)


c = F.col


def _below20() -> Column:
    return cross_under("close", "ma20")


def _dead() -> Column:
    return cross_under("ma5", "ma20")


def _below20_or_dead() -> Column:
    return _below20() | _dead()


def _volume(p: dict) -> Column:
    return c("vol_ratio_5d") >= p["vol_ratio_min"]


def _change(p: dict) -> Column:
    return c("change_pct") > p["min_change"] / 100


def _candle(p: dict) -> Column:
    return c("close") > c("open")


def _rising(p: dict) -> Column:
    return c("momentum_20d") > 0


def _above(average: str) -> Callable[[dict], Column]:
    return lambda p: c("close") > c(average)


def _rsi(p: dict) -> Column:
    return c("rsi_14") < p["rsi_max"]


def _boards(p: dict) -> Column:
    return c("consecutive_limit_ups") >= p["min_boards"]


def _near20(unit: float) -> Callable[[dict], Column]:
    """Strictly within a share of the average, on both sides."""
    return lambda p: (c("close") > c("ma20") * (1 - p["ma_proximity"] * unit)) & (c("close") < c("ma20") * (1 + p["ma_proximity"] * unit))


def _own_limit() -> Column:
    """The day's limit as ``near_limit_up`` takes it: wide boards by prefix, then the exchange, then ST names."""
    s, special = c("symbol"), F.contains(F.upper(F.coalesce("name", F.lit(""))), F.lit("ST"))
    wide = s.startswith("300") | s.startswith("301") | s.startswith("688")
    return F.when(wide, 0.20).when(s.endswith(".BJ"), 0.30).when(special, 0.05).otherwise(0.10)


# Defaults of the parameters, weights, stops, holds, limits and asset types.
_ALL = (
    Strategy(
        "boll_breakout",
        {"require_boll_breakout": True, "use_volume_filter": True, "vol_ratio_min": 1.5},
        {"require_boll_breakout": _above("boll_upper"), "use_volume_filter": _volume},
        lambda: c("close") < c("boll_lower"),
        {"vol_ratio_5d": 0.4, "change_pct": 0.3, "momentum_20d": 0.3}, -0.06, 15, 100, STOCK_ETF,
    ),
    Strategy(
        "broken_board_recovery",
        {"require_limit_up": True, "use_volume_filter": True, "vol_ratio_min": 1.5, "use_change_filter": True, "change_pct_min": 0.03},
        {
            "require_limit_up": lambda p: c("signal_limit_up"),
            "use_volume_filter": _volume,
            "use_change_filter": lambda p: c("change_pct") > p["change_pct_min"]
        },
        _below20,
        {"change_pct": 0.4, "vol_ratio_5d": 0.3, "momentum_5d": 0.3}, -0.06, 10,
    ),
    Strategy(
        "bullish_alignment",
        {"require_ma_alignment": True, "require_positive_momentum": True},
        {
            "require_ma_alignment": lambda p: (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")) & (c("ma20") > c("ma60")),
            "require_positive_momentum": _rising
        },
        _below20_or_dead,
        {"momentum_60d": 0.4, "momentum_20d": 0.3, "turnover_rate": 0.3}, -0.06, 20, 100, STOCK_ETF,
    ),
    Strategy(
        "consecutive_limit_ups",
        {"require_limit_up": True, "use_boards_filter": True, "min_boards": 2},
        {"require_limit_up": lambda p: c("signal_limit_up"), "use_boards_filter": _boards},
        None,
        {"consecutive_limit_ups": 0.5, "change_pct": 0.3, "amount": 0.2}, -0.05, 5,
    ),
    Strategy(
        "high_turnover_surge",
        {"use_turnover_filter": True, "min_turnover": 5.0, "use_change_filter": True, "min_change": 3.0},
        {"use_turnover_filter": lambda p: c("turnover_rate") > p["min_turnover"], "use_change_filter": _change},
        _below20,
        {"turnover_rate": 0.4, "change_pct": 0.3, "momentum_5d": 0.3}, -0.05, 10, 50,
    ),
    Strategy(
        "limit_up_momentum",
        {"use_change_filter": True, "min_change": 5.0, "use_boards_filter": True, "min_boards": 1},
        {"use_change_filter": _change, "use_boards_filter": _boards},
        None,
        {"consecutive_limit_ups": 0.4, "change_pct": 0.3, "amount": 0.3}, -0.05, 5, 50,
    ),
    Strategy(
        "low_volatility_leader",
        {"require_positive_momentum": True, "use_volatility_filter": True, "vol_max": 0.30, "require_above_ma20": True},
        {
            "require_positive_momentum": _rising,
            "use_volatility_filter": lambda p: c("annual_vol_20d") < p["vol_max"],
            "require_above_ma20": _above("ma20")
        },
        _below20,
        {"momentum_60d": 0.4, "momentum_20d": 0.3, "turnover_rate": 0.3}, -0.05, 30, 100, STOCK_ETF,
    ),
    Strategy(
        "ma_golden_cross",
        {"require_ma_golden": True, "use_volume_filter": True, "vol_ratio_min": 1.2, "require_above_ma60": True},
        {"require_ma_golden": lambda p: cross_over("ma5", "ma20"), "use_volume_filter": _volume, "require_above_ma60": _above("ma60")},
        _dead,
        {"momentum_20d": 0.5, "vol_ratio_5d": 0.3, "change_pct": 0.2}, -0.06, 15, 100, STOCK_ETF,
    ),
    Strategy(
        "macd_golden",
        {"require_macd_golden": True, "use_volume_filter": True, "vol_ratio_min": 1.5},
        {"require_macd_golden": lambda p: cross_over("macd_dif", "macd_dea"), "use_volume_filter": _volume},
        lambda: cross_under("macd_dif", "macd_dea"),
        {"momentum_60d": 0.4, "vol_ratio_5d": 0.3, "change_pct": 0.3}, -0.07, 20, 100, STOCK_ETF,
    ),
    Strategy(
        "n_day_low_reversal",
        {"require_n_day_low": True, "require_bullish_candle": True, "use_volume_filter": True, "vol_ratio_min": 1.5},
        {"require_n_day_low": lambda p: c("close") <= c("low_60d"), "require_bullish_candle": _candle, "use_volume_filter": _volume},
        _below20,
        {"change_pct": 0.4, "vol_ratio_5d": 0.3, "momentum_5d": 0.3}, -0.06, 15, 100, STOCK_ETF,
    ),
    Strategy(
        "near_limit_up",
        {"use_change_filter": True, "min_change": 7.0, "use_limit_gap_filter": True, "limit_gap": 3.0},
        {"use_change_filter": _change, "use_limit_gap_filter": lambda p: c("change_pct") < _own_limit() - p["limit_gap"] / 100},
        _below20,
        {"change_pct": 0.5, "amount": 0.3, "momentum_5d": 0.2}, -0.05, 5, 50,
    ),
    Strategy(
        "oversold_bounce",
        {"use_rsi_filter": True, "rsi_max": 30.0, "require_bullish_candle": True, "use_volume_filter": True, "vol_ratio_min": 1.2},
        {"use_rsi_filter": _rsi, "require_bullish_candle": _candle, "use_volume_filter": _volume},
        _below20,
        {"change_pct": 0.3, "vol_ratio_5d": 0.3, "momentum_5d": 0.2, "rsi_14": 0.2}, -0.05, 15, 100, STOCK_ETF,
    ),
    Strategy(
        "oversold_reversal",
        {"use_rsi_filter": True, "rsi_max": 30.0, "use_change_filter": True, "min_change": 1.0, "require_above_ma5": True},
        {"use_rsi_filter": _rsi, "use_change_filter": _change, "require_above_ma5": _above("ma5")},
        _below20,
        {"change_pct": 0.4, "rsi_14": 0.3, "vol_ratio_5d": 0.3}, -0.05, 15, 50,
    ),
    Strategy(
        "pullback_ma20_bounce",
        {"use_ma20_proximity": True, "ma_proximity": 2.0, "require_ma_alignment": True, "require_positive_change": True},
        {
            "use_ma20_proximity": _near20(0.01),
            "require_ma_alignment": lambda p: (c("ma5") > c("ma20")) & (c("ma20") > c("ma60")),
            "require_positive_change": lambda p: c("change_pct") > 0
        },
        _below20_or_dead,
        {"momentum_60d": 0.4, "change_pct": 0.3, "momentum_20d": 0.3}, -0.05, 15, 50,
    ),
    Strategy(
        "pullback_to_support",
        {
            "use_ma20_proximity": True,
            "ma_proximity": 0.02,
            "use_volume_filter": True,
            "vol_ratio_max": 0.8,
            "require_above_ma60": True,
            "require_positive_momentum": True
        },
        {
            "use_ma20_proximity": _near20(1.0),
            "use_volume_filter": lambda p: c("vol_ratio_5d") < p["vol_ratio_max"],
            "require_above_ma60": _above("ma60"),
            "require_positive_momentum": _rising
        },
        _below20,
        {"momentum_60d": 0.4, "momentum_20d": 0.3, "turnover_rate": 0.3}, -0.05, 20, 100, STOCK_ETF,
    ),
    Strategy(
        "strong_open",
        {"use_open_gap_filter": True, "min_open_gap": 3.0, "require_close_above_open": True, "use_change_filter": True, "min_change": 3.0},
        {
            "use_open_gap_filter": lambda p: c("open") > lag("close") * (1 + p["min_open_gap"] / 100),
            "require_close_above_open": _candle,
            "use_change_filter": _change
        },
        _below20,
        {"change_pct": 0.4, "amplitude": 0.2, "amount": 0.4}, -0.05, 10, 50,
    ),
    Strategy(
        "trend_breakout",
        {"require_above_ma60": True, "require_n_day_high": True, "use_volume_filter": True, "vol_ratio_min": 2.0},
        {"require_above_ma60": _above("ma60"), "require_n_day_high": lambda p: c("close") >= c("high_60d"), "use_volume_filter": _volume},
        _below20,
        {"momentum_60d": 0.4, "vol_ratio_5d": 0.3, "change_pct": 0.3}, -0.08, 20, 100, STOCK_ETF,
        {"price_min": 5, "price_max": 200, "market_cap_min": 20e8, "amount_min": 1e8, "exclude_st": True, "exclude_new_days": 60},
    ),
    Strategy(
        "volume_price_surge",
        {"require_ma20_breakout": True, "use_volume_filter": True, "vol_ratio_min": 2.0, "require_bullish_candle": True},
        {"require_ma20_breakout": lambda p: cross_over("close", "ma20"), "use_volume_filter": _volume, "require_bullish_candle": _candle},
        _below20,
        {"vol_ratio_5d": 0.4, "change_pct": 0.3, "momentum_20d": 0.3}, -0.06, 15, 100, STOCK_ETF,
    ),
)
REGISTRY: dict[str, Strategy] = {s.id: s for s in _ALL}
USER: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register(name: str, fn: Callable[[DataFrame, dict], DataFrame]) -> None:
    """A user's strategy: a function of the indicator frame and the parameters that gives the rows it picks."""
    USER[name] = fn


def run_user(name: str, df: DataFrame, params: dict | None = None) -> DataFrame:
    return USER[name](df, params or {})


def resolve_params(s: Strategy, saved: dict | None = None, explicit: dict | None = None) -> dict:
    """Defaults, then saved values, then explicit ones."""
    given = {**(saved or {}), **(explicit or {})}
    if unknown := sorted(set(given) - set(s.params)):
        raise ValueError(f"{s.id} has no parameter {', '.join(unknown)}")
    return {**s.params, **given}


def entry_of(s: Strategy, params: dict | None = None, basic: dict | None = None, asset_type: str | None = None) -> Column:
    """Whether a row is an entry: all conditions that are switched on, the basic filter, and the asset types (column ``type``).

    ``basic`` replaces the strategy's filter, which is ``DEFAULT_BASIC`` with its own bounds.
    ``asset_type`` narrows the strategy's own types to one, which it must support.
    """
    if asset_type is not None and asset_type not in s.asset_types:
        raise ValueError(f"{s.id} is not for {asset_type}; it is for {', '.join(s.asset_types)}")
    p = resolve_params(s, explicit=params)
    kinds = s.asset_types if asset_type is None else (asset_type,)
    conditions = [basic_filter({**DEFAULT_BASIC, **s.basic} if basic is None else basic), c("type").isin(*kinds)]
    return F.coalesce(
        reduce(lambda a, b: a & b, [rule(p) for switch, rule in s.entry.items() if p[switch]], conditions[0] & conditions[1]),
        F.lit(False)
    )


def minmax_score(weights: dict[str, float], universe: Column | None = None) -> Column:
    """Per date, the weighted sum of columns scaled between their least and most in the universe, times 100; 0.5 where flat."""
    total, parts = sum(weights.values()), []
    for name, w in weights.items():
        value = c(name) if universe is None else F.when(universe, c(name))
        low, high = F.min(value).over(by_date()), F.max(value).over(by_date())
        one = F.when(high > low, (c(name) - low) / (high - low)).otherwise(0.5)
        parts.append((one if universe is None else F.when(universe, one).otherwise(0.0)) * (w / total))
    return F.coalesce(sum(parts[1:], parts[0]) * 100, F.lit(0.0))


def apply(df: DataFrame, s: Strategy, params: dict | None = None, basic: dict | None = None, asset_type: str | None = None) -> DataFrame:
    """``df`` with ``entry``, ``exit`` and ``score``."""
    out = df.withColumn("entry", entry_of(s, params, basic, asset_type)).withColumn(
        "exit",
        F.coalesce(s.exit(), F.lit(False)) if s.exit else F.lit(False)
    )
    return out.withColumn("score", minmax_score(s.scoring, c("entry")))


def picks(df: DataFrame, s: Strategy, params: dict | None = None, basic: dict | None = None, asset_type: str | None = None) -> DataFrame:
    """The entries of ``apply`` with their scores; only they are dealt out by date."""
    exits = F.coalesce(s.exit(), F.lit(False)) if s.exit else F.lit(False)
    own = df.withColumns({"entry": entry_of(s, params, basic, asset_type), "exit": exits}).filter("entry")
    return own.withColumn("score", minmax_score(s.scoring))


def rank_result(df: DataFrame, s: Strategy, by: str = "score") -> DataFrame:
    """The picks in order, up to the strategy's limit."""
    return df.filter("entry").orderBy(c(by).desc(), "symbol").limit(s.limit)


def run_all(df: DataFrame, ids: list[str] | None = None, basic: dict[str, dict] | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """``strategy, symbol, date`` of every entry of every strategy, in one pass; ``params`` and ``basic`` by strategy."""
    chosen = [REGISTRY[i] for i in (ids or REGISTRY)]
    wide = df.withColumns({s.id: entry_of(s, (params or {}).get(s.id), None if basic is None else basic.get(s.id, {})) for s in chosen})
    # The gaps go after the explode: inside a higher-order function all conditions would be interpreted for every row.
    hits = F.array(*[F.when(c(s.id), F.lit(s.id)) for s in chosen])
    return wide.select("symbol", "date", F.explode(hits).alias("strategy")).filter("strategy IS NOT NULL")
