"""Window helpers of the (symbol, date) panel.

Every per-symbol operator uses the same partitioning and order, so Spark plans one
exchange and one sort for any number of them.
"""

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, agg, column: str | Column) -> Column:
    """``agg`` over the last ``n`` rows, null until ``n`` values are there."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c).over(last_rows(n)) == n, agg(c).over(last_rows(n)))


def rolling(column: str, n: int, kind: str, ddof: int = 1, q: float = 0.5) -> Column:
    """Strict rolling ``sum``, ``mean``, ``min``, ``max``, ``std`` or ``quantile``."""
    aggs = {
        "sum": F.sum,
        "mean": F.avg,
        "min": F.min,
        "max": F.max,
        "std": F.stddev_samp if ddof else F.stddev_pop,
        "quantile": lambda c: F.percentile(c, q)
    }
    return full(n, aggs[kind], column)


def lag(column: str | Column, n: int = 1) -> Column:
    return F.lag(column, n).over(by_symbol())


def lead(column: str | Column, n: int = 1) -> Column:
    return F.lead(column, n).over(by_symbol())


def valid_shift(column: str, n: int) -> Column:
    """The ``n``-th previous (next, if negative) value that isn't null."""
    name = "lag" if n >= 0 else "lead"
    return F.expr(f"{name}({column}, {abs(n)}) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY date)")


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or NaN."""
    return F.try_divide(a, F.when(~F.isnan(b), b))


def cross_over(a: str, b: str) -> Column:
    """Now above, at the bar before not above."""
    return (F.col(a) > F.col(b)) & (lag(a) <= lag(b))


def cross_under(a: str, b: str) -> Column:
    return (F.col(a) < F.col(b)) & (lag(a) >= lag(b))


def finite_or_null(df, columns=None):
    """NaN and infinities to null in every float column."""
    floats = [c for c, t in df.dtypes if t in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in floats})
