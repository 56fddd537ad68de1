"""Technical indicators and boolean signals of daily bars.

``with_indicators(df, needed)`` adds the asked columns and nothing else: a column's
dependencies are resolved by name and Catalyst prunes what no result uses. Bars are
counted, not days, for a long panel has no row where a symbol has no bar.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recursive import RECURSIVE, with_recursive
from .windows import cross_over, cross_under, finite_or_null, full, lag, last_rows, safe_divide

MA, MOMENTUM = (5, 10, 20, 30, 60), (5, 10, 20, 30, 60)


def _previous_mean(n: int) -> Column:
    w = last_rows(1).rowsBetween(-n, -1)
    return F.when(F.count("volume").over(w) == n, F.avg("volume").over(w))


def _window_columns() -> dict[str, Column]:
    close, volume = F.col("close"), F.col("volume").cast("double")
    out = {"prev_close": lag("close")}
    out |= {f"ma{n}": full(n, F.avg, "close") for n in MA}
    out |= {"boll_std": full(20, F.stddev_samp, "close")}
    out |= {f"vol_ma{n}": full(n, F.avg, volume) for n in (5, 10)}
    out |= {"vol_ratio_5d": safe_divide(volume, _previous_mean(5))}
    out |= {"high_60d": full(60, F.max, "close"), "low_60d": full(60, F.min, "close")}
    out |= {f"momentum_{n}d": safe_divide(close, lag("close", n)) - 1 for n in MOMENTUM}
    out |= {"change_pct": safe_divide(close, lag("close")) - 1, "change_amount": close - lag("close")}
    out |= {"amplitude": F.when(lag("close") > 0, (F.col("high") - F.col("low")) / lag("close"))}
    return out


def _derived_columns() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Columns that rest on others."""
    ma20, std = F.col("ma20"), F.col("boll_std")
    return {
        "boll_upper": (("ma20", "boll_std"), ma20 + 2 * std),
        "boll_lower": (("ma20", "boll_std"), ma20 - 2 * std),
        "annual_vol_20d": (("change_pct",), full(20, F.stddev_samp, "change_pct") * math.sqrt(252)),
    }


def _signals() -> dict[str, tuple[tuple[str, ...], Column]]:
    """The eleven crosses and the five level signals: their columns and conditions."""
    crosses = {
        "signal_ma_golden_5_20": ("ma5", "ma20", cross_over),
        "signal_ma_dead_5_20": ("ma5", "ma20", cross_under),
        "signal_ma_golden_20_60": ("ma20", "ma60", cross_over),
        "signal_macd_golden": ("macd_dif", "macd_dea", cross_over),
        "signal_macd_dead": ("macd_dif", "macd_dea", cross_under),
        **{f"signal_ma{n}_breakout": ("close", f"ma{n}", cross_over) for n in (5, 10, 20)},
        **{f"signal_ma{n}_breakdown": ("close", f"ma{n}", cross_under) for n in (5, 10, 20)},
    }
    out = {k: ((a, b), f(a, b)) for k, (a, b, f) in crosses.items()}
    close = F.col("close")
    return out | {
        "signal_n_day_high": (("high_60d",), close >= F.col("high_60d")),
        "signal_n_day_low": (("low_60d",), close <= F.col("low_60d")),
        "signal_boll_breakout_upper": (("boll_upper",), close > F.col("boll_upper")),
        "signal_boll_breakdown_lower": (("boll_lower",), close < F.col("boll_lower")),
        "signal_volume_surge": (("vol_ratio_5d",), F.col("vol_ratio_5d") >= 2.0),
    }


WINDOW_NAMES = tuple(
    [
        "prev_close",
        *[f"ma{n}" for n in MA],
        "boll_std",
        "vol_ma5",
        "vol_ma10",
        "vol_ratio_5d",
        "high_60d",
        "low_60d",
        *[f"momentum_{n}d" for n in MOMENTUM],
        "change_pct",
        "change_amount",
        "amplitude"
    ]
)
DERIVED_NAMES = ("boll_upper", "boll_lower", "annual_vol_20d")
SIGNAL_NAMES = (
    "signal_ma_golden_5_20",
    "signal_ma_dead_5_20",
    "signal_ma_golden_20_60",
    "signal_macd_golden",
    "signal_macd_dead",
    *[f"signal_ma{n}_break{x}" for n in (5, 10, 20) for x in ("out", "down")],
    "signal_n_day_high",
    "signal_n_day_low",
    "signal_boll_breakout_upper",
    "signal_boll_breakdown_lower",
    "signal_volume_surge"
)
ALL = (*WINDOW_NAMES, *RECURSIVE, *DERIVED_NAMES, *SIGNAL_NAMES)


def closure(needed: set[str] | None) -> set[str]:
    """``needed`` with all it rests on."""
    if needed is None:
        return set(ALL)
    rests_on = {k: set(v[0]) for k, v in (_derived_columns() | _signals()).items()}
    out, todo = set(), list(needed)
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += rests_on.get(name, ())
    return out


def with_indicators(df: DataFrame, needed: set[str] | None = None) -> DataFrame:
    """``df`` (symbol, date, open, high, low, close, volume) with the ``needed`` columns, all of them if None."""
    want, given = closure(needed), df.columns
    # Recursion comes first: behind its pass rows are dealt by symbol anew, once for all windows, and before it they are narrow.
    out = with_recursive(df, sorted(want & set(RECURSIVE), key=RECURSIVE.index)) if want & set(RECURSIVE) else df
    out = out.withColumns({k: v for k, v in _window_columns().items() if k in want})
    out = out.withColumns({k: v for k, (_, v) in _derived_columns().items() if k in want})
    out = finite_or_null(out, want)
    out = out.withColumns({k: v for k, (_, v) in _signals().items() if k in want})
    return out if needed is None else out.select(*given, *[c for c in out.columns if c in needed and c not in given])
