"""The panel read from the star-schema tables, in Spark and in SQL.

* ``bars``: ``lineitem`` by supplier: one symbol a supplier, price = extended price
  over quantity, in the order of order and line.
* ``brand_bars``: the same by part brand: few symbols with long series.
* ``instruments``: ``supplier`` with shares, ST names, nation and region.
* ``factors``: two adjustment events for a third of the suppliers.
* ``minutes``: ``events`` by type and minute.

The symbol's prefix and suffix follow the supplier's key, so that every board occurs.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix and exchange by key modulo 6.
BOARDS = (("300", "SZ"), ("688", "SH"), ("600", "SH"), ("000", "SZ"), ("830", "BJ"), ("301", "SZ"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: Column) -> Column:
    text = key.cast("string")
    digits = F.lpad(text, F.greatest(F.length(text), F.lit(3)), "0")
    out = F.lit(None).cast("string")
    for k, (prefix, exchange) in enumerate(BOARDS):
        out = F.when(key % 6 == k, F.concat(F.lit(prefix), digits, F.lit("." + exchange))).otherwise(out)
    return out


def _symbol_sql(key: str) -> str:
    digits = f"lpad({key}::VARCHAR, greatest(length({key}::VARCHAR), 3)::INTEGER, '0')"
    return "CASE " + " ".join(f"WHEN {key} % 6 = {k} THEN '{p}' || {digits} || '.{x}'" for k, (p, x) in enumerate(BOARDS)) + " END"


def _bars_of(rows: DataFrame) -> DataFrame:
    """Daily bars of rows ``symbol, date, seq, price, quantity, value``."""
    return rows.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("value").alias("amount"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_partkey",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        price.alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("value")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by symbol before they are summed (a bar has hardly more than one), which the windows behind need anyway."""
    lines = _lines(spark, sf_dir).withColumn("symbol", symbol_of(F.col("l_suppkey")))
    return _bars_of(lines.select("symbol", "date", "seq", "price", "quantity", "value").repartition("symbol"))


def bar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days with a bar, from the date column alone."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


def newest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``newest``: the last day with a bar, from the date column alone."""
    return table(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("newest"))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return _bars_of(_lines(spark, sf_dir).join(parts, "l_partkey"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key, symbol = F.col("s_suppkey"), symbol_of(F.col("s_suppkey"))
    total = (1 + key % 50).cast("double") * 1e6
    return s.select(
        symbol.alias("symbol"),
        F.when(key % 13 == 0, F.concat(F.lit("ST "), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.split_part(symbol, F.lit("."), F.lit(1)).alias("code"),
        F.when(key % 19 == 0, "etf").when(key % 23 == 0, "index").otherwise("stock").alias("type"),
        total.alias("total_shares"),
        F.when(key % 17 == 0, 0.0).otherwise(total * 0.6).alias("float_shares"),
        F.when(key % 11 == 0, 2000.0).when(key % 7 == 0, 100000.0).alias("dim_limit_up"),
        F.when(key % 11 == 0, 900.0).alias("dim_limit_down"),
        F.concat_ws(";", "n_name", F.concat(F.lit("K"), (key % 9).cast("string")), F.lit("nan")).alias("labels"),
        F.concat_ws("-", "r_name", "n_name").alias("industry"),
        F.col("s_acctbal").alias("balance"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").filter(key % 3 == 0).select(
        symbol_of(key).alias("symbol"),
        key.alias("k"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    )
    return rows.select(
        "symbol",
        F.date_add(F.lit("1996-01-01").cast("date"), ((F.col("k") * 37) % 800 + F.col("n") * 700).cast("int")).alias("trade_date"),
        (1.0 + (F.col("k") % 5) * 0.1 + F.col("n") * 0.25).alias("ex_factor")
    )


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("datetime"),
        F.struct("ts", "event_id").alias("seq"),
        "value"
    )
    return e.groupBy("symbol", "datetime").agg(
        F.min_by("value", "seq").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "seq").alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum("value").alias("amount")
    )


_BAR_SQL = "arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(quantity) AS volume, sum(value) AS amount"
#: Common table expressions with the same names and columns.
CTE = {
    "lines": "lines AS (SELECT l_suppkey, l_partkey, l_shipdate::DATE AS date, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice "
    "/ l_quantity AS price, l_quantity AS quantity, l_extendedprice AS value FROM lineitem)",
    "bars": f"bars AS (SELECT {_symbol_sql('l_suppkey')} AS symbol, date, {_BAR_SQL} FROM lines GROUP BY 1, 2)",
    "brand_bars": f"brand_bars AS (SELECT p_brand AS symbol, date, {_BAR_SQL} FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)",
    "instruments": f"""instruments AS (SELECT {_symbol_sql('s_suppkey')} AS symbol, CASE WHEN s_suppkey % 13 = 0 THEN 'ST ' || s_name ELSE s_name END AS name,
        split_part({_symbol_sql('s_suppkey')}, '.', 1) AS code, CASE WHEN s_suppkey % 19 = 0 THEN 'etf' WHEN s_suppkey % 23 = 0 THEN 'index' ELSE 'stock' END AS type,
        (1 + s_suppkey % 50)::DOUBLE * 1e6 AS total_shares, CASE WHEN s_suppkey % 17 = 0 THEN 0.0::DOUBLE ELSE (1 + s_suppkey % 50)::DOUBLE * 1e6 * 0.6::DOUBLE END AS float_shares,
        CASE WHEN s_suppkey % 11 = 0 THEN 2000.0::DOUBLE WHEN s_suppkey % 7 = 0 THEN 100000.0::DOUBLE END AS dim_limit_up, CASE WHEN s_suppkey % 11 = 0 THEN 900.0::DOUBLE END AS dim_limit_down,
        n_name || ';K' || (s_suppkey % 9)::VARCHAR || ';nan' AS labels, r_name || '-' || n_name AS industry, s_acctbal AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "factors": f"""factors AS (SELECT {_symbol_sql('s_suppkey')} AS symbol, DATE '1996-01-01' + ((s_suppkey * 37) % 800 + n * 700)::INTEGER AS trade_date,
        1.0::DOUBLE + (s_suppkey % 5) * 0.1::DOUBLE + n * 0.25::DOUBLE AS ex_factor FROM supplier, (VALUES (0), (1)) t(n) WHERE s_suppkey % 3 = 0)""",
    "minutes": "minutes AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS datetime, arg_min(value, (ts, event_id)) AS open, "
    "max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(value) AS amount "
    "FROM events GROUP BY 1, 2)",
}
_NEEDS = {"bars": ("lines",), "brand_bars": ("lines",)}


def with_(*names: str, more: str = "", recursive: bool = False) -> str:
    """``WITH`` and the named expressions, each with what it needs, and ``more`` behind them."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*_NEEDS.get(name, ()), name) if x not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([CTE[x] for x in order] + ([more] if more else [])) + "\n"
