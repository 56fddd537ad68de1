"""Joins of the panel with dimensions, lists, dates and events.

Dimensions are left to adaptive execution, which measures a side before it
broadcasts it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import lag, lead

DELIMITERS = r"[、,，;；|/\s]+"
EMPTY_LABELS = ("", "nan", "none", "null")


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row in ``order``; never an arbitrary one."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_instruments(bars: DataFrame, dimension: DataFrame, columns: list[str]) -> DataFrame:
    return bars.join(dedup_last(dimension, ["symbol"], columns).select("symbol", *columns), "symbol", "left")


def watchlist_panel(watchlist: DataFrame, day: DataFrame) -> DataFrame:
    """Every listed symbol in the list's order (``position``), with nulls where the day has no row."""
    return watchlist.join(day, "symbol", "left").orderBy("position")


def with_external_columns(df: DataFrame, external: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    """The newest partition's fields as ``prefix__field``; the row count never changes."""
    newest = external.agg(F.max("date").alias("date"))
    latest = dedup_last(external.join(F.broadcast(newest), "date", "left_semi"), ["symbol"], fields)  # one row
    return df.join(latest.select("symbol", *[F.col(f).alias(f"{prefix}__{f}") for f in fields]), "symbol", "left")


def labels_of(text: Column) -> Column:
    """The labels of a delimited string, without empty ones."""
    return F.filter(F.transform(F.split(text, DELIMITERS), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*EMPTY_LABELS))


def exploded_labels(dimension: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Distinct ``symbol, name`` pairs, symbols in upper case."""
    return dimension.select(F.upper("symbol").alias("symbol"), F.explode(labels_of(F.col(column))).alias(name)).distinct()


def explode_dimension_join(bars: DataFrame, dimension: DataFrame, column: str, name: str = "label") -> DataFrame:
    return bars.withColumn("symbol", F.upper("symbol")).join(exploded_labels(dimension, column, name), "symbol")


def join_symbol_or_code(df: DataFrame, keyed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each symbol's row of ``keyed`` by full symbol, else by bare code."""
    keys = df.select("symbol").distinct().select(
        "symbol",
        F.posexplode(F.array("symbol", F.split_part("symbol", F.lit("."), F.lit(1)))).alias("way", "wanted")
    )
    hits = keys.join(keyed.select(F.col(key).alias("wanted"), *columns), "wanted")
    w = Window.partitionBy("symbol").orderBy("way", *columns)
    first = hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("symbol", *columns)
    return df.join(first, "symbol", "left")


def calendar(df: DataFrame) -> DataFrame:
    """The dates present with the one before and after; one row a trading day."""
    w = Window.orderBy("date")
    return df.select("date").distinct().select("date", F.lag("date").over(w).alias("prev_date"), F.lead("date").over(w).alias("next_date"))


def prior_day_state(df: DataFrame, column: str, name: str) -> DataFrame:
    """The column's value on the trading day before, null if the symbol had no bar then."""
    days = calendar(df).select("date", "prev_date")
    before = df.select(F.col("symbol"), F.col("date").alias("prev_date"), F.col(column).alias(name))
    return df.join(F.broadcast(days), "date").join(before, ["symbol", "prev_date"], "left")  # a row a day


def mark_hits(df: DataFrame, hits: DataFrame, keys: list[str], name: str = "hit") -> DataFrame:
    return df.join(hits.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pool_diff(before: DataFrame, after: DataFrame, key: str = "symbol") -> DataFrame:
    """``key, change``: what came and what went."""
    new = after.select(key).distinct().join(before, key, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(before.select(key).distinct().join(after, key, "left_anti").withColumn("change", F.lit("dropped")))


def seal_overlay(day: DataFrame, depth: DataFrame) -> DataFrame:
    """Order-book seals on limit hits: ``real``, ``fake`` or ``pending``; a fake one is no limit-up any more."""
    out = day.join(depth, "symbol", "left")
    status = F.when(~F.col("signal_limit_up"), None).when(F.col("sealed_up").isNull(), "pending").when(F.col("sealed_up"), "real").otherwise("fake")
    return out.withColumn("seal_status", status).withColumn(
        "is_limit_up",
        F.col("signal_limit_up") & ~F.coalesce(F.col("seal_status") == "fake", F.lit(False))
    )


def depth_seals(depth: DataFrame) -> DataFrame:
    """Seals from order-book arrays: no ask volume seals up, no bid volume seals down; empty arrays leave nulls."""
    first = lambda c: F.try_element_at(c, F.lit(1))
    ask, bid = first(F.col("ask_volumes")), first(F.col("bid_volumes"))
    return depth.select(
        "symbol",
        F.when(ask.isNotNull() & bid.isNotNull(), (ask == 0) & (bid > 0)).alias("sealed_up"),
        F.when(ask.isNotNull() & bid.isNotNull(), (bid == 0) & (ask > 0)).alias("sealed_down"),
        ask.alias("ask1_vol"),
        bid.alias("bid1_vol")
    )


def fill_missing_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Null and empty names from a second source."""
    other = names.groupBy("symbol").agg(F.max("name").alias("_new"))
    return df.join(other, "symbol", "left").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "_new")).drop("_new")


def resolve_asset_type(df: DataFrame, etf: DataFrame, index: DataFrame) -> DataFrame:
    mark = lambda x, n: x.select("symbol").distinct().withColumn(n, F.lit(True))
    out = df.join(mark(etf, "_etf"), "symbol", "left").join(mark(index, "_index"), "symbol", "left")
    return out.withColumn("asset_type", F.when(F.col("_etf"), "etf").when(F.col("_index"), "index").otherwise("stock")).drop("_etf", "_index")


def numbered(bars: DataFrame, name: str = "n") -> DataFrame:
    """Bars with their number in the symbol's series, from 1."""
    return bars.withColumn(name, F.row_number().over(Window.partitionBy("symbol").orderBy("date")))


def entry_exit_range_join(entries: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """Every entry with the symbol's next ``hold`` bars.

    Both sides carry bar numbers ``entry_n`` and ``n``. The equality key holds a block
    of ``hold`` bars as well: an entry reaches into two blocks at most, so long
    series are never compared pair by pair.
    """
    block = lambda c: F.floor(c / F.lit(hold))
    left = entries.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("entry_n") + 1), block(F.col("entry_n") + hold)))))
    right = bars.withColumn("_block", block(F.col("n")))
    return left.join(right, ["symbol", "_block"]).filter("n > entry_n AND n <= entry_n + " + str(int(hold))).drop("_block")


def benchmark_excess(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Total return of a curve (date, value), of the benchmark (date, close) over the same dates, and the excess."""
    both = curve.join(benchmark, "date")
    ends = both.agg(*[f(c, "date").alias(f"{n}_{c}") for c in ("value", "close") for n, f in (("first", F.min_by), ("last", F.max_by))])
    total = lambda c: F.try_divide(F.col(f"last_{c}"), F.col(f"first_{c}")) - 1
    return ends.select(
        total("value").alias("total_return"),
        total("close").alias("benchmark_return"),
        (total("value") - total("close")).alias("excess_return")
    )


def normalize_symbol(df: DataFrame, dimension: DataFrame, code: str = "code") -> DataFrame:
    """``symbol`` of a bare code: by the dimension, else 6 is Shanghai and the rest Shenzhen."""
    known = dimension.groupBy(F.col("code").alias(code)).agg(F.min("symbol").alias("_known"))
    guess = F.concat(F.col(code), F.when(F.col(code).startswith("6"), ".SH").otherwise(".SZ"))
    return df.join(known, code, "left").withColumn("symbol", F.coalesce("_known", guess)).drop("_known")


def resolve_code_list(codes: DataFrame, dimension: DataFrame, watchlist: DataFrame) -> DataFrame:
    """``code, symbol, name, matched, listed`` of every code asked for."""
    known = dedup_last(dimension, ["code"], ["symbol"]).select("code", "symbol", "name")
    out = codes.join(known, "code", "left").withColumn("matched", F.col("symbol").isNotNull())
    return mark_hits(out, watchlist, ["symbol"], "listed")


def next_rebalance_price(rebalance: DataFrame, bars: DataFrame) -> DataFrame:
    """Close on each rebalance date and on the next one."""
    days = rebalance.select("date").distinct().withColumn("next_date", F.lead("date").over(Window.orderBy("date")))
    now = bars.join(F.broadcast(days), "date")  # a row a rebalance date
    later = bars.select("symbol", F.col("date").alias("next_date"), F.col("close").alias("next_close"))
    return now.join(later, ["symbol", "next_date"], "left").select("symbol", "date", "next_date", "close", "next_close")


def forward_return(n: int) -> Column:
    return F.try_divide(lead("close", n), F.col("close")) - 1


def delay_signal(df: DataFrame, flag: str, n: int = 1) -> DataFrame:
    """The flag moved to the symbol's ``n``-th next bar, with the date it came from."""
    return df.withColumns({f"{flag}_delayed": F.coalesce(lag(flag, n), F.lit(False)), f"{flag}_source_date": F.when(lag(flag, n), lag("date", n))})


def first_signal_id(signals: list[str]) -> Column:
    """The first true signal in the list's order."""
    return F.coalesce(*[F.when(F.col(s), F.lit(s)) for s in signals])
