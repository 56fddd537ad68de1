"""Functions callable from SQL: aggregates over returns and values, and a table of round price levels."""

import math

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def sortino(returns: pd.Series) -> float:
    """Mean over downside deviation (against 0, over all steps) times the root of 252; null without a loss, 0 for fewer than two steps."""
    r = returns.dropna()
    if len(r) < 2:
        return 0.0
    down = math.sqrt((r.clip(upper=0) ** 2).mean())
    return float(r.mean() / down * math.sqrt(252)) if down > 0 else None


def max_drawdown(values: pd.Series) -> float:
    """Least value over the running maximum, less 1, in the order given."""
    v = values.dropna()
    return float((v / v.cummax() - 1).min()) if len(v) else None


class ExplodeLevels:
    """Round price levels within 10 % of a close, without those within 1 %."""

    def eval(self, close: float):
        if close is None or not close > 0:
            return
        step = 0.5 if close < 10 else 1.0 if close < 50 else 5.0 if close < 100 else 10.0 if close < 500 else 50.0
        for m in range(math.ceil(close * 0.9 / step), math.floor(close * 1.1 / step) + 1):
            if abs(m * step - close) / close > 0.01:
                yield m * step, abs(m * step - close)


def register(spark: SparkSession) -> None:
    spark.udf.register("sortino", F.pandas_udf(sortino, "double"))
    spark.udf.register("max_drawdown", F.pandas_udf(max_drawdown, "double"))
    spark.udtf.register("explode_levels", F.udtf(ExplodeLevels, returnType="value double, distance double"))
