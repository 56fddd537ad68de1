"""Support and resistance levels of all symbols at once, the last bar being the reference.

Every function gives ``symbol, type, label, value, strength``; :func:`sided` adds the
side of the close (within 0.1 % is ``near``).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import full, lag

FIBONACCI = (0.236, 0.382, 0.5, 0.618, 0.786)
def _symbol():
    return Window.partitionBy("symbol")


def _rows(df: DataFrame, kind: str, values: dict[str, Column], strength: str | dict[str, str] = "medium") -> DataFrame:
    """The values as rows; ``strength`` of all, or by label."""
    of = lambda k: strength if isinstance(strength, str) else strength[k]
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("value"), F.lit(of(k)).alias("strength")) for k, v in values.items()])
    return df.select("symbol", F.lit(kind).alias("type"), F.explode(pairs).alias("p")).select(
        "symbol",
        "type",
        "p.label",
        "p.value",
        "p.strength"
    ).filter("value IS NOT NULL")


def from_end(bars: DataFrame, most: int | None = None) -> DataFrame:
    """Bars with ``back``, 1 on the symbol's last one; bars that have it already aren't ordered again."""
    out = bars if "back" in bars.columns else bars.withColumn("back", F.row_number().over(_symbol().orderBy(F.col("date").desc())))
    return out if most is None else out.filter(F.col("back") <= most)


def counted_back(bars: DataFrame) -> DataFrame:
    """Bars with ``back``, counted in the order of dates, in which other windows of the frame have sorted them."""
    return bars.withColumn("back", F.count(F.lit(1)).over(_symbol()).cast("int") - F.row_number().over(_symbol().orderBy("date")) + 1)


def last_bars(bars: DataFrame) -> DataFrame:
    return from_end(bars, 1).drop("back")


def sided(levels: DataFrame, bars: DataFrame) -> DataFrame:
    close = last_bars(bars).select("symbol", "close")
    v, c = F.col("value"), F.col("close")
    return levels.join(close, "symbol").withColumn("side", F.when(v > c * 1.001, "resistance").when(v < c * 0.999, "support").otherwise("near"))


def pivots(bars: DataFrame) -> DataFrame:
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    p = (h + low + c) / 3
    return _rows(
        last_bars(bars),
        "pivot",
        {"P": p, "R1": 2 * p - low, "S1": 2 * p - h, "R2": p + (h - low), "S2": p - (h - low), "R3": h + 2 * (p - low), "S3": low - 2 * (h - p)},
        {"P": "strong", "R1": "medium", "R2": "medium", "R3": "weak", "S1": "medium", "S2": "medium", "S3": "weak"}
    )


def extremes(bars: DataFrame) -> DataFrame:
    """Highest and lowest of the last 60 and 250 bars, of symbols that have so many."""
    tail = from_end(bars, 250)
    within = lambda n, c: F.when(F.col("back") <= n, F.col(c))
    whole = lambda n, x: F.when(F.count(F.lit(1)) >= n, x)
    out = tail.groupBy("symbol").agg(*[whole(n, f(within(n, c))).alias(f"{c}_{n}") for n in (60, 250) for c, f in (("high", F.max), ("low", F.min))])
    return _rows(out, "extreme", {f"{c}_{n}": F.col(f"{c}_{n}") for n in (60, 250) for c in ("high", "low")}, "strong")


def swing_points(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Bars that are the highest (lowest) of the ``reach`` on either side, both sides being there."""
    w = _symbol().orderBy("date").rowsBetween(-reach, reach)
    whole = F.count(F.lit(1)).over(w) == 2 * reach + 1
    out = bars.select(
        "symbol",
        "date",
        F.when(whole & (F.col("high") == F.max("high").over(w)), F.col("high")).alias("top"),
        F.when(whole & (F.col("low") == F.min("low").over(w)), F.col("low")).alias("bottom")
    )
    pick = lambda c: out.filter(F.col(c).isNotNull()).select(
        "symbol",
        F.lit("swing").alias("type"),
        F.lit(c).alias("label"),
        F.col(c).alias("value"),
        F.lit("medium").alias("strength")
    )
    return pick("top").unionByName(pick("bottom"))


def merge_close(levels: DataFrame, tolerance: float) -> DataFrame:
    """Levels of a symbol and type whose rising chain has steps within the tolerance become one, the largest."""
    w = Window.partitionBy("symbol", "type", "label").orderBy("value")
    starts = F.coalesce(F.col("value") > F.lag("value").over(w) * (1 + tolerance), F.lit(True)).cast("int")
    return levels.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(w)).groupBy("symbol", "type", "label", "_run").agg(
        F.max("value").alias("value"),
        F.max("strength").alias("strength")
    ).drop("_run")


def nearest(levels: DataFrame, bars: DataFrame, k: int, by: str = "side") -> DataFrame:
    """The ``k`` levels of each symbol and type that are nearest to the close (to six digits), for each side, or each label, or (``type``) in all."""
    rows = sided(levels, bars)
    w = Window.partitionBy(*dict.fromkeys(("symbol", "type", by))).orderBy(F.round(F.abs(F.col("value") - F.col("close")), 6), "label", "value")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def swings(bars: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` tops above the close and the ``k`` bottoms below it that are nearest to it, those close to one another as one."""
    merged = merge_close(swing_points(bars), 0.01)
    close = last_bars(bars).select("symbol", "close")
    v, c, top = F.col("value"), F.col("close"), F.col("label") == "top"
    outside = merged.join(close, "symbol").filter((top & (v > c * 1.001)) | (~top & (v < c * 0.999))).drop("close")
    return nearest(outside, bars, k, "label")


def bands(df: DataFrame) -> DataFrame:
    """Bollinger bands of the last bar; needs ``ma20`` and ``boll_*``."""
    return _rows(last_bars(df), "bollinger", {"upper": F.col("boll_upper"), "mid": F.col("ma20"), "lower": F.col("boll_lower")})


def keltner(df: DataFrame) -> DataFrame:
    """Three Keltner channels; needs ``atr_14``."""
    out = last_bars(from_end(df, 120).withColumns({f"_ma{n}": full(n, F.avg, "close") for n in (20, 60, 120)}))
    a = F.col("atr_14")
    return _rows(
        out,
        "keltner",
        {
            f"{name}_{side}": F.col(f"_ma{n}") + sign * k * a for name,
            n,
            k in (("short", 20, 2.0), ("mid", 60, 2.5), ("long", 120, 3.0)) for side,
            sign in (("upper", 1), ("lower", -1))
        }
    )


def atr_bands(df: DataFrame) -> DataFrame:
    c, a = F.col("close"), F.col("atr_14")
    values = {f"{side}{k}": c + sign * k * a for k in (1.5, 2.0) for side, sign in (("+", 1), ("-", -1))}
    return _rows(last_bars(df), "atr", values, {k: "weak" if "1.5" in k else "medium" for k in values})


def open_gaps(bars: DataFrame, most: int = 120) -> DataFrame:
    """Gaps between two of the last ``most`` bars that no later bar overlaps; the join's fan-out is bounded by ``most``."""
    tail = from_end(bars, most)
    rows = tail.withColumns({"_high": lag("high"), "_low": lag("low")}).filter(F.col("back") < most)
    up, down = F.col("low") > F.col("_high"), F.col("high") < F.col("_low")
    low, high = F.when(up, F.col("_high")).when(down, F.col("high")), F.when(up, F.col("low")).when(down, F.col("_low"))
    rows = rows.select(
        "symbol",
        "date",
        "back",
        F.when(up, "up").when(down, "down").alias("label"),
        low.alias("lo"),
        high.alias("hi")
    ).filter("label IS NOT NULL")
    after = tail.select("symbol", F.col("back").alias("b"), F.col("low").alias("l"), F.col("high").alias("h"))
    filled = rows.join(after, "symbol").filter("b < back AND l <= hi AND h >= lo").select("symbol", "date").distinct()
    return rows.join(filled, ["symbol", "date"], "left_anti").select(
        "symbol",
        F.lit("gap").alias("type"),
        "label",
        ((F.col("lo") + F.col("hi")) / 2).alias("value"),
        F.lit("medium").alias("strength"),
        "date"
    )


def gaps(bars: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` gaps up and the ``k`` gaps down that are nearest to the close."""
    return nearest(merge_close(open_gaps(bars), 0.005), bars, k, "label")


def fibonacci(bars: DataFrame, most: int = 120) -> DataFrame:
    """Five ratios on the swing of the last ``most`` bars, down from the high if it came later, else up from the low."""
    tail = from_end(bars, most)
    ends = tail.groupBy("symbol").agg(
        F.max("high").alias("h"),
        F.min("low").alias("l"),
        F.max_by("back", F.struct("high", "back")).alias("hb"),
        F.min_by("back", F.struct("low", -F.col("back"))).alias("lb")
    )
    h, low = F.col("h"), F.col("l")
    level = lambda r: F.when(F.col("hb") < F.col("lb"), h - (h - low) * r).otherwise(low + (h - low) * r)
    return _rows(ends.filter("h > l"), "fibonacci", {str(r): level(r) for r in FIBONACCI})


def round_step(price: Column) -> Column:
    return F.when(price < 10, 0.5).when(price < 20, 1.0).when(price < 100, 5.0).when(price < 500, 10.0).otherwise(50.0)


def round_numbers(bars: DataFrame, k: int = 8) -> DataFrame:
    """Multiples of the price's step within 10 %, the ``k`` nearest, without those within 1 %."""
    last = last_bars(bars).filter("close > 0").select("symbol", "close", round_step(F.col("close")).alias("step"))
    first, end = F.ceil(F.col("close") * 0.9 / F.col("step")), F.floor(F.col("close") * 1.1 / F.col("step"))
    rows = last.filter(first <= end).withColumn("m", F.explode(F.sequence(first, end))).withColumn("value", F.col("m") * F.col("step"))
    away = F.abs(F.col("value") - F.col("close"))
    near = rows.withColumn("rank", F.row_number().over(_symbol().orderBy(away, "value"))).filter(F.col("rank") <= k)
    return near.filter(away / F.col("close") >= 0.01).select(
        "symbol",
        F.lit("round").alias("type"),
        F.format_number("value", 2).alias("label"),
        "value",
        F.lit("weak").alias("strength")
    )


def chip_distribution(bars: DataFrame, bins: int = 40, least: int = 20) -> DataFrame:
    """``symbol, bin, mid, chips``: volumes spread over each bar's price bins, thinned by the turnover of later bars.

    What is left of a bar's volume is the product of (1 - turnover) over later bars, as
    a suffix sum of logarithms; after a bar with a turnover of 100 % nothing from before
    is left.
    """
    whole = _symbol()
    rows = bars.withColumns(
        {"_hi": F.max("high").over(whole), "_lo": F.min("low").over(whole), "_n": F.count(F.lit(1)).over(whole)}
    ).filter(f"_n >= {int(least)} AND _hi > _lo AND _lo > 0")
    t = F.least(F.greatest(F.coalesce("turnover_rate", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) / 100
    later = whole.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_t", t).withColumns(
        {
            "_log": F.sum(F.when(F.col("_t") < 1, F.log1p(-F.col("_t"))).otherwise(0.0)).over(later),
            "_reset": F.max((F.col("_t") >= 1).cast("int")).over(later)
        }
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    place = lambda c: F.least(F.floor((F.col(c) - F.col("_lo")) / step), F.lit(bins - 1)).cast("int")
    rows = rows.filter("coalesce(_reset, 0) = 0 AND volume > 0").withColumns({"_a": place("low"), "_b": place("high"), "_step": step})
    share = F.col("volume") / (F.col("_b") - F.col("_a") + 1) * F.exp(F.coalesce("_log", F.lit(0.0)))
    spread = rows.select("symbol", F.explode(F.sequence("_a", "_b")).alias("bin"), share.alias("chips"), "_lo", "_step")
    return spread.groupBy("symbol", "bin").agg(F.sum("chips").alias("chips"), F.first("_lo").alias("_lo"), F.first("_step").alias("_step")).select(
        "symbol",
        "bin",
        (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_step")).alias("mid"),
        "chips"
    ).filter("chips > 0")


def chip_levels(bars: DataFrame, bins: int = 40) -> DataFrame:
    """The densest bin (point of control) and up to two more above the mean."""
    chips = chip_distribution(bars, bins)
    rows = chips.withColumns({"rank": F.row_number().over(_symbol().orderBy(F.col("chips").desc(), "bin")), "mean": F.avg("chips").over(_symbol())})
    picked = rows.filter("rank = 1 OR (rank <= 3 AND chips > mean)")
    return picked.select(
        "symbol",
        F.lit("chips").alias("type"),
        F.when(F.col("rank") == 1, "POC").otherwise("dense").alias("label"),
        F.round("mid", 2).alias("value"),
        F.when(F.col("rank") == 1, "strong").otherwise("medium").alias("strength")
    )


def all_levels(df: DataFrame) -> DataFrame:
    """All families together; ``df`` is the indicator frame with ``atr_14`` and ``turnover_rate``."""
    cols = ["symbol", "type", "label", "value", "strength"]
    families = (pivots, extremes, bands, keltner, atr_bands, fibonacci, round_numbers, chip_levels)
    parts = [f(df).select(*cols) for f in families] + [f(df).select(*cols) for f in (swings, gaps)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def nearest_summary(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """The two nearest levels of each type."""
    return nearest(levels, bars, 2, "type")
