"""Row filters, predicates compiled from plain descriptions, and flags."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .limits import SPECIAL, classify_board
from .windows import by_symbol, lag

OPERATORS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b
}
MOST_CONDITIONS, MOST_LAG = 8, 60


def filter_halt_days(df: DataFrame) -> DataFrame:
    """Without the days on which open and high are both 0."""
    return df.filter(~F.coalesce((F.col("open") == 0) & (F.col("high") == 0), F.lit(False)))


def filter_true_suspension(df: DataFrame) -> DataFrame:
    """Rows with volume or with a price change."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.filter((zero("volume") > 0) | (zero("change_pct") != 0))


# The bounds that hold where a strategy sets none and the caller asks for them.
DEFAULT_BASIC = {
    "price_min": 3,
    "price_max": 300,
    "market_cap_min": 10e8,
    "amount_min": 0.2e8,
    "exclude_st": True,
    "exclude_new_days": 30,
    "boards": ["沪主板", "深主板", "创业板", "科创板", "北交所"],
}


def basic_filter(spec: dict) -> Column:
    """Bounds on price, capitalisation, amount and turnover; ST names, boards, and a symbol's first bars."""
    cap = {"market_cap": F.col("close") * F.col("total_shares"), "float_cap": F.col("close") * F.col("float_shares")}
    columns = {"price": F.col("close"), "amount": F.col("amount"), "turnover": F.col("turnover_rate")} | cap
    out = [F.lit(True)]
    for name, c in columns.items():
        out += [c >= spec[f"{name}_min"]] if spec.get(f"{name}_min") is not None else []
        out += [c <= spec[f"{name}_max"]] if spec.get(f"{name}_max") is not None else []
    if spec.get("exclude_st"):
        out.append(~F.coalesce(F.col("name").rlike(SPECIAL), F.lit(False)))
    if spec.get("exclude_new_days"):
        out.append(F.row_number().over(by_symbol()) > spec["exclude_new_days"])
    if spec.get("boards"):
        out.append(classify_board(F.col("symbol")).isin(list(spec["boards"])))
    return F.coalesce(reduce(lambda a, b: a & b, out), F.lit(False))


_UNSAFE = re.compile(r"[;]|--|/\*|\b(select|from|join|union|with|insert|drop|exists)\b", re.IGNORECASE)


def screen_sql(df: DataFrame, conditions: list[str], order: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet all SQL conditions; subqueries and statements are refused."""
    for c in [*conditions, order or ""]:
        if _UNSAFE.search(c):
            raise ValueError(f"not a plain condition: {c}")
    out = reduce(lambda d, c: d.filter(F.expr(c)), conditions, df)
    if order:
        name, _, way = order.partition(" ")
        out = out.orderBy(F.expr(name).desc() if way.lower() == "desc" else F.expr(name), "symbol")
    return out.limit(limit) if limit else out


def custom_signal(conditions: list[dict], fields: set[str]) -> Column:
    """``left[-d] op right`` conditions, AND-ed; ``right`` is a number or a field with a lag."""
    if not 0 < len(conditions) <= MOST_CONDITIONS:
        raise ValueError(f"1 to {MOST_CONDITIONS} conditions")

    def side(name, days: int) -> Column:
        if not isinstance(name, str):
            return F.lit(float(name))
        if name not in fields or not 0 <= days <= MOST_LAG:
            raise ValueError(f"unknown field or lag: {name}, {days}")
        return lag(name, days) if days else F.col(name)

    return reduce(
        lambda a, b: a & b,
        [OPERATORS[c["op"]](side(c["left"], c.get("left_lag", 0)), side(c["right"], c.get("right_lag", 0))) for c in conditions]
    )


def inject_signals(df: DataFrame, signals: dict[str, list[dict]]) -> DataFrame:
    """``df`` with every signal whose fields it has."""
    fields = set(df.columns)
    has = lambda cs: all(x in fields for c in cs for x in (c["left"], c["right"]) if isinstance(x, str))
    return df.withColumns({k: custom_signal(cs, fields) for k, cs in signals.items() if has(cs)})


def matches(conditions: list[dict], logic: str, fields: list[str]) -> Column:
    """Whether all (any) conditions ``{field, op, value}`` hold, ``op`` being ``truth`` or a comparison; a missing field matches nothing."""
    if not conditions or any(c["field"] not in fields for c in conditions):
        return F.lit(False)
    one = lambda c: F.col(c["field"]) if c["op"] == "truth" else OPERATORS[c["op"]](F.col(c["field"]), F.lit(c["value"]))
    parts = [F.coalesce(one(c), F.lit(False)) for c in conditions]
    return reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), parts)


def match_conditions(df: DataFrame, conditions: list[dict], logic: str = "and") -> DataFrame:
    """The rows that match."""
    return df.filter(matches(conditions, logic, df.columns))


def in_scope(scope: str, symbols: list[str] | None = None) -> Column:
    """``all``, ``symbols``; any other scope matches nothing."""
    if scope == "all":
        return F.lit(True)
    return F.coalesce(F.col("symbol").isin(symbols), F.lit(False)) if scope == "symbols" and symbols else F.lit(False)


def apply_scope(df: DataFrame, scope: str, symbols: list[str] | None = None) -> DataFrame:
    return df.filter(in_scope(scope, symbols))


def last_trading_days(df: DataFrame, n: int, as_of=None) -> DataFrame:
    """Rows of the last ``n`` dates that are present up to ``as_of``."""
    rows = df if as_of is None else df.filter(F.col("date") <= F.lit(as_of).cast("date"))
    days = rows.select("date").distinct().orderBy(F.col("date").desc()).limit(n)
    return rows.join(F.broadcast(days), "date", "left_semi")  # n rows


def with_market_caps(df: DataFrame) -> DataFrame:
    return df.withColumns({"market_cap": F.col("close") * F.col("total_shares"), "float_cap": F.col("close") * F.col("float_shares")})


def search_instruments(df: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Symbols, codes or names that start with the text, then those that contain it."""
    u, t = [F.upper(c) for c in ("symbol", "code", "name")], text.upper()
    starts, holds = (reduce(lambda a, b: a | b, [getattr(c, f)(t) for c in u]) for f in ("startswith", "contains"))
    rank = F.when(starts, 0).when(holds, 1)
    return df.withColumn("match_rank", rank).filter("match_rank IS NOT NULL").orderBy("match_rank", "symbol").limit(limit)


def fill_bad_ohlc(df: DataFrame) -> DataFrame:
    """Open, high and low of 0 or null become the close."""
    return df.withColumns({c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low")})


def _range() -> Column:
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    return F.greatest(*prices) - F.least(*prices)


def _tolerance() -> Column:
    return F.greatest(F.abs("close") * 1e-4, F.lit(0.01))


def tradable_flag() -> Column:
    """All prices present and positive, and not a bar without volume and range."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    fine = reduce(lambda a, b: a & b, [F.coalesce(p > 0, F.lit(False)) for p in prices])
    return fine & ~((F.coalesce(F.col("volume"), F.lit(0)) == 0) & (_range() <= _tolerance()))


def one_price_limit_flag(flag: str) -> Column:
    """A tradable bar at one price with the limit flag set."""
    return tradable_flag() & (_range() <= _tolerance()) & F.coalesce(F.col(flag), F.lit(False))


def in_window(start, end) -> Column:
    """Whether a row is in the formal window, not in the warm-up before it."""
    return F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def rank_of(column: str) -> Column:
    return F.row_number().over(Window.partitionBy("date").orderBy(F.col(column).desc(), F.col("symbol").asc_nulls_last()))
