"""Queries: scans, normalisers, sinks, streams and registered functions."""


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import udf as V
from ..operators import recursive, windows
from ..operators.filters import match_conditions
from ..operators.joins import labels_of
from ..operators.recursive import RECURSIVE
from ..operators.windows import full
from ..sources import io as S
from ..streaming import stream as Z
from . import bindings as B
from .catalog import query, scratch
from .catalog_indicators import IND, LIMITS, REC, SIG, W, full_sql, indicator_frame, limit_frame
from .catalog_market import depth


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of users' events: many symbols, one month."""
    e = B.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"),
        F.to_date("ts").alias("date"),
        F.struct("ts", "event_id").alias("seq"),
        "value"
    )
    return e.groupBy("symbol", "date").agg(
        F.min_by("value", "seq").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "seq").alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum("value").alias("amount")
    )


EB = (
    "eb AS (SELECT user_id::VARCHAR AS symbol, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, "
    "min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2)"
)
WEB = f"WITH {EB}\n"
eb = event_bars


def stored(spark, sf_dir, df=None, columns=None):
    """The event bars written by date; the path."""
    path = scratch(spark, "daily")
    df = eb(spark, sf_dir) if df is None else df
    df.repartition("date").write.partitionBy("date").parquet(path)
    return path


@query(
    "s01_scan_daily",
    WEB + "SELECT symbol, date, open, close, volume::DOUBLE AS volume, NULL::BIGINT AS quote_ts FROM eb WHERE date BETWEEN DATE "
    "'2024-01-05' AND DATE '2024-01-20' AND symbol IN ('1', '2', '3', '5', '8', '13')"
)
def _s01(s, d):
    return S.scan_daily(
        s,
        stored(s, d),
        "2024-01-05",
        "2024-01-20",
        ["1", "2", "3", "5", "8", "13"]
    ).select("symbol", "date", "open", "close", "volume", "quote_ts")


@query(
    "s02_scan_enriched",
    WEB + "SELECT symbol, date, close, close AS raw_close, NULL::DOUBLE AS turnover_rate FROM eb WHERE date >= DATE '2024-01-10'"
)
def _s02(s, d):
    return S.scan_enriched(
        s,
        stored(s, d, eb(s, d).withColumn("raw_close", F.col("close"))),
        ["symbol", "date", "close", "raw_close", "turnover_rate"],
        "2024-01-10"
    )


query(
    "s03_minute_range",
    B.with_("minutes") + "SELECT symbol, close, volume FROM minutes WHERE symbol IN ('click', 'view', 'purchase') AND datetime::DATE BETWEEN DATE "
    "'2024-01-03' AND DATE '2024-01-09' ORDER BY symbol, datetime"
)(lambda s, d: S.scan_minute_range(B.minutes(s, d), ["click", "view", "purchase"], "2024-01-03", "2024-01-09").select("symbol", "close", "volume"))
query(
    "s04_minute_dates",
    B.with_("minutes", more=EB) + "SELECT symbol, close, volume FROM minutes WHERE datetime::DATE IN (SELECT date FROM eb WHERE symbol = '7')"
)(lambda s, d: S.scan_minute_dates(B.minutes(s, d), eb(s, d).filter("symbol = '7'")).select("symbol", "close", "volume"))
query(
    "s05_all_assets",
    B.with_("bars", "brand_bars", more=EB) +
    "SELECT symbol, date, close, 'stock' AS asset_type FROM bars UNION ALL SELECT symbol, date, close, 'index' FROM brand_bars "
    "UNION ALL SELECT symbol, date, close, 'etf' FROM eb"
)(
    lambda s, d: S.scan_all_assets(
        {"stock": B.bars(s, d), "index": B.brand_bars(s, d), "etf": eb(s, d).drop("amount")}
    ).select("symbol", "date", "close", "asset_type")
)


@query("s06_csv_any_encoding", B.with_("instruments") + "SELECT symbol, '名称' || name AS name FROM instruments")
def _s06(s, d):
    """Half of the table in one encoding and half in another, in one folder each of one parent."""
    path, half = scratch(s, "csv"), F.abs(F.xxhash64("symbol")) % 2
    rows = B.instruments(s, d)
    before = s.conf.get("spark.sql.legacy.javaCharsets")
    s.conf.set("spark.sql.legacy.javaCharsets", "true")  # the writer knows GB18030 under this setting alone
    try:
        for k, encoding in enumerate(("GB18030", "UTF-8")):
            own = rows.filter(half == k).select(F.col("symbol").alias("股票代码"), F.concat(F.lit("名称"), "name").alias("name(x)"))
            own.write.csv(f"{path}/{encoding}", header=True, encoding=encoding)
    finally:
        s.conf.set("spark.sql.legacy.javaCharsets", before)
    return S.read_csv_any_encoding(s, path + "/*/*.csv").select("symbol", "name")


@query("s07_json_rows", B.with_("instruments") + "SELECT symbol, balance FROM instruments")
def _s07(s, d):
    """Payloads of about twenty rows each."""
    block = F.floor(F.row_number().over(Window.partitionBy("industry").orderBy("symbol")) / 20)
    rows = B.instruments(s, d).withColumn("block", block).groupBy("industry", "block").agg(F.collect_list(F.struct("symbol", "balance")).alias("list"))
    return S.read_json_rows(
        rows.select(F.to_json(F.struct(F.array(F.struct("list")).alias("data"))).alias("payload")),
        "payload",
        "data.0.list",
        "symbol string, balance double"
    )


query(
    "s08_map_fields",
    B.with_("instruments") + "SELECT symbol AS sym, total_shares AS shares FROM instruments"
)(lambda s, d: S.map_fields(B.instruments(s, d), {"symbol": "sym", "total_shares": "shares", "absent": "x"}))
query("s09_transforms", B.with_("bars") + "SELECT symbol, close * 100 AS a, amount / 100 AS b, volume / 10000 AS c, date AS dt FROM bars", 5)(
    lambda s, d: S.apply_transforms(
        B.bars(s, d).select(
            "symbol",
            F.col("close").cast("string").alias("a"),
            F.col("amount").alias("b"),
            F.col("volume").alias("c"),
            F.date_format("date", "dd/MM/yyyy").alias("dt")
        ),
        {"a": "x100", "b": "d100", "c": "d10000", "dt": "parse_date(dd/MM/yyyy)"}
    )
)
query("s10_normalize_daily", WEB + "SELECT symbol, date, open, close, volume::DOUBLE AS volume FROM eb WHERE volume > 1")(
    lambda s, d: S.normalize_daily(
        eb(s, d).select(
            F.col("symbol").alias("ts_code"),
            F.date_format("date", "yyyyMMdd").alias("trade_date"),
            F.when(F.col("volume") > 1, F.col("open")).otherwise(0.0).cast("string").alias("open"),
            F.when(F.col("volume") > 1, F.col("high")).otherwise(0.0).alias("high"),
            "low",
            "close",
            F.col("volume").cast("string").alias("vol"),
            F.col("amount").alias("amt")
        )
    ).select("symbol", "date", "open", "close", "volume")
)
query("s11_normalize_minute", B.with_("minutes") + "SELECT symbol, epoch_ms(datetime) AS ms, close, volume::DOUBLE AS volume FROM minutes")(
    lambda s, d: S.normalize_minute(
        B.minutes(s, d).withColumn("timestamp", F.unix_millis("datetime")).drop("datetime")
    ).select("symbol", F.unix_millis("datetime").alias("ms"), "close", "volume")
)
query("s12_normalize_factors", B.with_("factors") + "SELECT symbol, trade_date, ex_factor FROM factors")(
    lambda s, d: S.normalize_adj_factors(
        B.factors(s, d).select(
            "symbol",
            F.unix_millis(F.col("trade_date").cast("timestamp")).alias("trade_date"),
            F.col("ex_factor").cast("string").alias("ex_factor")
        )
    )
)
query("s13_normalize_instruments", B.with_("instruments") + "SELECT symbol, code, total_shares, float_shares FROM instruments")(
    lambda s, d: S.normalize_instruments(
        (lambda i: i.unionByName(i))(
            B.instruments(s, d).select("symbol", "name", F.lit("").alias("code"), F.struct("total_shares", "float_shares").alias("ext"))
        )
    ).select("symbol", "code", "total_shares", "float_shares")
)
query(
    "s14_flatten_labels",
    B.with_("instruments") + "SELECT symbol, array_to_string(list_filter(string_split(labels, ';'), lambda x: lower(trim(x)) NOT IN ('', 'nan', 'none')), "
    "';') AS label FROM instruments"
)(
    lambda s, d: B.instruments(s, d).select(
        "symbol",
        S.flatten_labels(F.concat(F.split("labels", ";"), F.array(F.lit(None).cast("string")))).alias("label")
    )
)
query(
    "s15_cast_to_config",
    B.with_("instruments") + "SELECT symbol, replace(labels, ';', ';') AS labels, balance::BIGINT AS balance FROM (SELECT symbol, labels, trunc(balance) "
    "AS balance FROM instruments)"
)(
    lambda s, d: S.cast_to_config(
        B.instruments(s, d).select("symbol", F.split("labels", ";").alias("labels"), "balance"),
        {"labels": "string", "balance": "int"}
    )
)
query(
    "s16_infer_fields",
    B.with_("instruments") + "SELECT column_name AS name, CASE column_type WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'int' "
    "ELSE 'string' END AS type FROM (DESCRIBE SELECT * FROM instruments)"
)(lambda s, d: s.createDataFrame([(f["name"], f["type"]) for f in S.infer_fields(B.instruments(s, d))], "name string, type string"))
_LOOKS = lambda c: f"avg(regexp_matches({c}, '^[0-9]{{6,}}(\\.(SH|SZ|BJ))?$')::INTEGER)::DOUBLE AS {c}"
query(
    "s17_detect_keys",
    B.with_("instruments") + f"SELECT {_LOOKS('symbol')}, {_LOOKS('name')}, {_LOOKS('code')}, {_LOOKS('industry')} FROM instruments"
)(lambda s, d: S.detect_key_columns(B.instruments(s, d).select("symbol", "name", "code", "industry", "balance")))
query("s18_clean_names", B.with_("instruments") + "SELECT symbol AS code, name AS code_2 FROM instruments")(
    lambda s, d: S.clean_column_names(B.instruments(s, d).select(F.col("symbol").alias("code(x)"), F.col("name").alias("code(y)")))
)


@query(
    "s19_upsert_by_date",
    WEB + "SELECT symbol, date, CASE WHEN date >= DATE '2024-01-15' AND volume > 1 THEN close * 2 ELSE close END AS close FROM eb"
)
def _s19(s, d):
    path = scratch(s, "upsert")
    S.upsert_by_date(s, path, eb(s, d), ["symbol", "date"], ["close"])
    S.upsert_by_date(
        s,
        path,
        eb(s, d).filter("date >= DATE '2024-01-15' AND volume > 1").withColumn("close", F.col("close") * 2),
        ["symbol", "date"],
        ["close"]
    )
    return s.read.parquet(path).select("symbol", "date", "close")


query(
    "s20_merge_factors",
    B.with_("factors") + "SELECT symbol, trade_date, CASE WHEN ex_factor > 1.3 THEN ex_factor + 1 ELSE ex_factor END AS ex_factor FROM factors"
)(lambda s, d: S.merge_factors(B.factors(s, d), B.factors(s, d).filter("ex_factor > 1.3").withColumn("ex_factor", F.col("ex_factor") + 1))[0])
query("s20_changed_symbols", B.with_("factors") + "SELECT DISTINCT symbol FROM factors WHERE ex_factor > 1.3")(
    lambda s, d: S.merge_factors(
        B.factors(s, d),
        B.factors(s, d).withColumn("ex_factor", F.when(F.col("ex_factor") > 1.3, F.col("ex_factor") + 1).otherwise(F.col("ex_factor")))
    )[1]
)
query("s21_write_external", B.with_("instruments") + "SELECT symbol, CASE WHEN balance > 0 THEN 'new' ELSE 'old' END AS note FROM instruments")(
    lambda s, d: S.write_external(
        B.instruments(s, d).select("symbol", F.lit("old").alias("note")),
        B.instruments(s, d).filter("balance > 0").select("symbol", F.lit("new").alias("note")),
        "snapshot",
        ["note"]
    )
)
query(
    "s22_external_latest",
    WEB + "SELECT symbol, close FROM eb WHERE date = (SELECT max(date) FROM eb)"
)(lambda s, d: S.read_external_latest(eb(s, d)).select("symbol", "close"))


query("s23_guard_rebuild", WEB + "SELECT symbol, date, close FROM eb WHERE volume > 1")(
    lambda s, d: S.guard_full_rebuild(eb(s, d).filter("volume > 2"), eb(s, d).filter("volume > 1")).select("symbol", "date", "close")
)
query(
    "s23_lost_dates",
    WEB + "SELECT DISTINCT date FROM eb EXCEPT SELECT date FROM eb WHERE symbol = '7'"
)(lambda s, d: S.lost_dates(eb(s, d), eb(s, d).filter("symbol = '7'")))


def _halted(s, d):
    return eb(s, d).withColumns({c: F.when(F.col("volume") == 1, 0.0).otherwise(F.col(c)) for c in ("open", "high")})


query("s24_halt_dry_run", WEB + "SELECT date, count(*) AS n FROM eb WHERE volume = 1 GROUP BY date")(lambda s, d: S.halt_rows_per_date(_halted(s, d)))
query(
    "s24_purge_halts",
    WEB + "SELECT symbol, date, close FROM eb WHERE volume <> 1"
)(lambda s, d: S.purge_halt_rows(_halted(s, d)).select("symbol", "date", "close"))
query("s25_symbol_to_date", WEB + "SELECT symbol, date, close FROM eb")(
    lambda s, d: S.repartition_symbol_to_date(
        eb(s, d).unionByName(eb(s, d).withColumn("close", F.col("close") - 1)).unionByName(eb(s, d).withColumn("date", F.lit(None).cast("date")))
    ).select("symbol", "date", "close")
)


def alert_log(s, d):
    return B.table(s, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, "monitor").otherwise("manual").alias("source"),
        F.col("event_type").alias("type")
    )


query(
    "s26_recent_alerts",
    "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 100"
)(lambda s, d: S.recent_alerts(alert_log(s, d), "2024-01-20", "monitor").select("id"))
query(
    "s26_retention",
    "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-08' ORDER BY ts DESC, event_id LIMIT 5000"
)(lambda s, d: S.retained_alerts(alert_log(s, d), "2024-01-08").select("id"))


@query(
    "s27_incremental_enrich",
    WEB + f"SELECT symbol, date, ma3 FROM (SELECT symbol, date, {full_sql(3, 'avg', 'close')} AS ma3 FROM eb) x WHERE date > DATE "
    f"'2024-01-20' OR symbol = '4'"
)
def _s27(s, d):
    compute = lambda df: df.select("symbol", "date", full(3, F.avg, "close").alias("ma3"))
    # History counts trading days; the month is shorter than 60, so all of it is read.
    return S.incremental_enrich(eb(s, d), eb(s, d).filter("date <= DATE '2024-01-20'"), compute, s.createDataFrame([("4",)], "symbol string"))


@query(
    "s27_resumed_recursion",
    B.with_("bars", more=REC, recursive=True) + f"SELECT symbol, date, {', '.join(RECURSIVE)} FROM recind WHERE date > DATE '1996-06-30'"
)
def _s27_resumed(s, d):
    """All bars up to a day give the state table, which is written; later bars start from it, in two runs."""
    bars, path = B.bars(s, d), scratch(s, "states")
    first = recursive.with_recursive(bars.filter("date <= DATE '1996-06-30'"), ("ema5",), state="state")
    recursive.states_of(first).write.parquet(path)
    states, later = s.read.parquet(path), scratch(s, "rows")
    recursive.resumed(bars.filter("date <= DATE '1997-12-31'"), states).write.parquet(later)
    middle = s.read.parquet(later)
    last = recursive.resumed(bars, recursive.states_of(middle, states))
    return middle.unionByName(last).select("symbol", "date", *RECURSIVE)


# Streams over the event file.
def event_stream(spark, sf_dir):
    """The event table as a stream; the pattern lets it be one file as well as a folder."""
    shape = B.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]").withColumn("symbol", F.col("event_type"))


def run(spark, stream, mode="append"):
    with Z.rocksdb(spark):
        return Z.run_to_table(spark, stream, scratch(spark, "result"), scratch(spark, "query"), mode)


def streamed(spark, df, **options):
    """A table written to the shared folder and read as a stream."""
    path = scratch(spark, "stream")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).options(**options).parquet(path)


_TB = lambda w, key="": f"SELECT event_type AS symbol, date_trunc('{w}', ts) AS start{key}, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY ALL"


@query("z04_tumbling_bars", _TB("hour"))
def _z04(s, d):
    """All windows, by the complete mode, so that the last one, still open for late rows, is there as well."""
    out = run(s, Z.tumbling_bars(event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_PHASE = "CASE WHEN m < 570 THEN 'preopen' WHEN m <= 690 THEN 'morning' WHEN m < 780 THEN 'lunch' WHEN m <= 900 THEN 'afternoon' ELSE 'close' END"


@query(
    "z05_phase_bars",
    f"SELECT event_type AS symbol, ts::DATE AS date, {_PHASE} AS phase, arg_min(value, (ts, event_id)) AS open, max(value) AS "
    f"high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(value) AS amount FROM (SELECT "
    f"*, hour(ts) * 60 + minute(ts) AS m FROM events) e GROUP BY ALL"
)
def _z05(s, d):
    return run(s, Z.phase_bars(event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))), "complete")


@query(
    "z01_quote_upsert",
    "SELECT event_type AS symbol, ts::DATE AS date, arg_max(value, (ts, event_id)) AS close, epoch(date_trunc('second', "
    "max(ts)))::BIGINT AS quote_s FROM events GROUP BY ALL"
)
def _z01(s, d):
    path = scratch(s, "quotes")
    stream = event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumns(
        {
            "last_price": F.col("value"),
            "open": F.lit(0.0),
            "high": F.col("value"),
            "low": F.lit(None).cast("double"),
            "volume": F.lit(1.0),
            "amount": F.col("value")
        }
    )
    Z.upsert_stream(stream, path, scratch(s, "query")).awaitTermination()
    return s.read.parquet(path).select("symbol", "date", "close", F.floor(F.col("quote_ts") / 1000).alias("quote_s"))


#: Bars in a row that rose, and that fell: places since the last bar that didn't.
_STREAK_SQL = f"""mv AS (SELECT symbol, date, row_number() OVER ({W}) AS k, close / nullif(lag(close) OVER ({W}), 0) - 1 AS move FROM bars),
st AS (SELECT symbol, date, (k - coalesce(max(CASE WHEN coalesce(move > 0, false) THEN NULL ELSE k END) OVER ({W}), 0))::INTEGER AS ups,
  (k - coalesce(max(CASE WHEN coalesce(move < 0, false) THEN NULL ELSE k END) OVER ({W}), 0))::INTEGER AS downs FROM mv)"""


@query(
    "z02_stateful_indicators",
    "WITH RECURSIVE " + EB.replace("eb AS", "bars AS", 1) + ",\n" + REC + ",\n" + IND + ",\n" + _STREAK_SQL +
    f"\nSELECT r.symbol, r.date, {', '.join(f'r.{c}' for c in RECURSIVE)}, {', '.join(f'i.{c}' for c in Z.Indicators.WINDOWED)}, ups AS consecutive_limit_ups, downs AS consecutive_limit_downs "
    "FROM recind r JOIN ind i USING (symbol, date) JOIN st USING (symbol, date)"
)
def _z02(s, d):
    """Bars written and streamed by file, each symbol's bars in order; equal to the batch indicators."""
    move = windows.safe_divide(F.col("close"), windows.lag("close")) - 1
    flagged = eb(s, d).withColumns({"signal_limit_up": move > 0, "signal_limit_down": move < 0})
    return run(s, Z.streaming_indicators(streamed(s, flagged)))


query(
    "z03_volume_scaling",
    "SELECT event_id, value * 240.0::DOUBLE / greatest(CASE WHEN m < 570 THEN 0 WHEN m < 690 THEN m - 570 + second(ts) / 60 WHEN m < 780 THEN "
    "120 WHEN m < 900 THEN m - 660 + second(ts) / 60 ELSE 240 END, 1) AS vol_ratio FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events) e"
)(
    lambda s, d: run(
        s,
        Z.scaled_volume_ratio(
            event_stream(s, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("vol_ratio"))
        ).select("event_id", "vol_ratio")
    )
)
_RULES = [
    {"id": "big", "scope": "all", "conditions": [{"field": "value", "op": ">", "value": 150}]},
    {"id": "some", "scope": "symbols", "symbols": ["click"], "conditions": [{"field": "value", "op": "<", "value": 1}]},
    {"id": "never", "scope": "sector", "conditions": [{"field": "value", "op": ">", "value": 0}]}
]
_RULE_HITS = (
    "hits AS (SELECT 'big' AS rule, event_type AS symbol, ts, event_id FROM events WHERE value > 150 UNION ALL SELECT 'some', "
    "event_type, ts, event_id FROM events WHERE event_type = 'click' AND value < 1)"
)


def rule_hits(df):
    return Z.evaluate_rules(df.withColumn("ts", F.col("ts").cast("timestamp")), _RULES)


@query("z06_rules_on_stream", f"WITH {_RULE_HITS} SELECT rule, symbol, date_trunc('second', ts) AS at FROM hits")
def _z06(s, d):
    return run(s, rule_hits(event_stream(s, d))).select("rule", "symbol", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"))


def _hits(s, d):
    return rule_hits(B.table(s, d, "events").withColumn("symbol", F.col("event_type")))


#: Each firing is the first hit an hour or more after the one before.
_COOL = f"""WITH RECURSIVE {_RULE_HITS},
f AS (SELECT rule, symbol, min(ts) AS ts FROM hits GROUP BY 1, 2
  UNION ALL SELECT h.rule, h.symbol, min(h.ts) AS ts FROM f JOIN hits h ON h.rule = f.rule AND h.symbol = f.symbol AND h.ts >= f.ts + INTERVAL 1 HOUR GROUP BY 1, 2)
SELECT rule, symbol, date_trunc('second', ts) AS at FROM f"""


def _seconds(df):
    return df.select("rule", "symbol", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"))


query("z07_cooldown_batch", _COOL)(lambda s, d: _seconds(Z.cooldown_batch(_hits(s, d), 3600)))
query("z07_cooldown_stream", _COOL)(lambda s, d: _seconds(run(s, Z.cooldown(rule_hits(event_stream(s, d)), 3600))))

#: The pools of odd and even days: busy users, users with a large value on one of the first odd days (none on even ones), and few of them.
_POOLS = f"""WITH {EB}, h AS (SELECT 'busy' AS strategy, day(date) % 2 AS k, symbol FROM eb WHERE volume > 3 UNION SELECT 'gone', 1, symbol FROM eb WHERE day(date) = 3 AND high > 150 UNION SELECT 'few', day(date) % 2, symbol FROM eb WHERE symbol IN ('1', '2', '3', '4') AND day(date) IN (4, 5)),
p AS (SELECT strategy, symbol FROM h WHERE k = 1), q AS (SELECT strategy, symbol FROM h WHERE k = 0),
c AS (SELECT *, 'new' AS change FROM (SELECT * FROM q EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'dropped' FROM (SELECT * FROM p EXCEPT SELECT * FROM q)),
n AS (SELECT *, count(*) OVER (PARTITION BY strategy) AS n FROM c)
SELECT strategy, symbol, change FROM n WHERE n <= 5 UNION ALL SELECT DISTINCT strategy, n || ' symbols', 'batch' FROM n WHERE n > 5"""


@query("z08_pool_changes", _POOLS)
def _z08(s, d):
    """Two runs of three strategies, each all files that a trigger of one stream finds; a pool without symbols is a pool too."""
    b, day = eb(s, d), F.dayofmonth("date")
    picks = b.filter("volume > 3").select(F.lit("busy").alias("strategy"), (day % 2).alias("k"), "symbol")
    picks = picks.unionByName(b.filter((day == 3) & (F.col("high") > 150)).select(F.lit("gone").alias("strategy"), F.lit(1).alias("k"), "symbol"))
    picks = picks.unionByName(
        b.filter(day.isin(4, 5) & F.col("symbol").isin("1", "2", "3", "4")).select(F.lit("few").alias("strategy"), (day % 2).alias("k"), "symbol")
    )
    strategies, path = s.createDataFrame([("busy",), ("gone",), ("few",)], "strategy string"), scratch(s, "pools")
    out, query_path = scratch(s, "result"), scratch(s, "query")
    for n, k in enumerate((1, 0)):
        Z.pool_rows(picks.filter(F.col("k") == k), strategies, n).write.mode("append").parquet(path)
        files = s.readStream.schema("strategy string, symbol string, run int").parquet(path)
        with Z.rocksdb(s):
            changes = Z.run_to_table(s, Z.pool_changes(files), out, query_path)
    return changes.select("strategy", "symbol", "change")


_BID1 = "CASE (total_shares / 1e6)::BIGINT % 4 WHEN 0 THEN 9 ELSE (total_shares / 1e6)::BIGINT % 4 * 4 END"
query("z09_seal_alerts", LIMITS + f"SELECT symbol, date, {_BID1} AS bid1_vol FROM lim WHERE signal_limit_up AND {_BID1} BETWEEN 1 AND 10")(
    lambda s, d: run(
        s,
        Z.seal_alerts(
            streamed(s, limit_frame(s, d).filter("signal_limit_up").select("symbol", "date", "close")).join(
                depth(s, d).select("symbol", F.try_element_at("bid_volumes", F.lit(1)).alias("bid1_vol")),
                "symbol"
            ),
            10
        ).select("symbol", "date", "bid1_vol")
    )
)
query(
    "z10_any_signal_alerts",
    B.with_("bars", more=f"{IND},\n{SIG}") + "SELECT symbol, date FROM sig WHERE coalesce(signal_volume_surge, false) OR coalesce(signal_n_day_high, false)"
)(
    lambda s, d: run(
        s,
        Z.any_signal_alerts(
            streamed(
                s,
                indicator_frame(s, d, {"signal_volume_surge", "signal_n_day_high"}).select(
                    "symbol",
                    "date",
                    "signal_volume_surge",
                    "signal_n_day_high"
                )
            ),
            ["signal_volume_surge", "signal_n_day_high"]
        ).select("symbol", "date")
    )
)
_THRESHOLDS = [{"field": "change_pct", "op": ">=", "value": 1.0}, {"field": "vol_ratio_5d", "op": ">=", "value": 3.0}]
query(
    "z10_threshold_alerts",
    B.with_("bars", more=IND) + "SELECT symbol, date FROM ind WHERE coalesce(change_pct >= 1, false) OR coalesce(vol_ratio_5d >= 3, false)"
)(
    lambda s, d: run(
        s,
        match_conditions(
            streamed(s, indicator_frame(s, d, {"change_pct", "vol_ratio_5d"}).select("symbol", "date", "change_pct", "vol_ratio_5d")),
            _THRESHOLDS,
            "or"
        ).select("symbol", "date")
    )
)
_MIN = "hour(ts) * 60 + minute(ts)"
query("z11_session_gate", f"SELECT event_id FROM events WHERE isodow(ts) < 6 AND ({_MIN} BETWEEN 570 AND 690 OR {_MIN} BETWEEN 780 AND 900)")(
    lambda s, d: run(
        s,
        Z.session_gate(event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("snapshot", F.col("ts"))).select("event_id")
    )
)


@query("z12_dedup_watermark", "SELECT event_id, event_type AS symbol FROM events")
def _z12(s, d):
    """Every event twice in the stream, once in the result."""
    both = event_stream(s, d)
    return run(s, Z.ticks(both.unionByName(both), "40 days").select("event_id", "symbol"))


#: Events of users who are suppliers too, with the supplier's name, concepts and industry.
_ALERTS = f"hits AS (SELECT 'big' AS rule, {B._symbol_sql('user_id')} AS symbol, ts FROM events WHERE value > 150)"


@query(
    "z13_alert_enrichment",
    B.with_("instruments", more=_ALERTS) + "SELECT rule, symbol, date_trunc('second', ts) AS at, name, industry, list_filter(string_split(labels, ';'), lambda x: x "
    "<> 'nan') AS concepts FROM hits LEFT JOIN instruments USING (symbol)"
)
def _z13(s, d):
    """A stream joined to the static dimension, whose concept strings are split once."""
    static = B.instruments(s, d).select("symbol", "name", "industry", labels_of(F.col("labels")).alias("concepts"))
    hits = Z.evaluate_rules(
        event_stream(s, d).withColumns({"ts": F.col("ts").cast("timestamp"), "symbol": B.symbol_of(F.col("user_id"))}),
        _RULES[:1]
    )
    return run(s, Z.enrich_alerts(hits, static)).select(
        "rule",
        "symbol",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"),
        "name",
        "industry",
        "concepts"
    )


# Functions callable from SQL.
@query(
    "v04_sql_aggregates",
    f"WITH {EB}, r AS (SELECT symbol, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM eb), "
    f"g AS (SELECT symbol, count(ret) AS n, avg(ret) AS m, sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0.0), 2) END)) "
    f"AS dn FROM r GROUP BY symbol) SELECT symbol, CASE WHEN n < 2 THEN 0.0::DOUBLE WHEN dn > 0 THEN m / dn * sqrt(252) END AS sortino FROM g",
    5
)
def _v04(s, d):
    V.register(s)
    eb(s, d).selectExpr(
        "symbol",
        "try_divide(close, lag(close) OVER (PARTITION BY symbol ORDER BY date)) - 1 AS ret"
    ).createOrReplaceTempView("event_returns")
    return s.sql("SELECT symbol, sortino(ret) AS sortino FROM event_returns GROUP BY symbol")


@query(
    "v05_levels_udtf",
    f"WITH {EB}, l AS (SELECT symbol, arg_max(close, date) AS close FROM eb GROUP BY symbol), s AS (SELECT *, CASE WHEN close "
    f"< 10 THEN 0.5 WHEN close < 50 THEN 1 WHEN close < 100 THEN 5 WHEN close < 500 THEN 10 ELSE 50 END::DOUBLE AS step FROM l "
    f"WHERE close > 0), m AS (SELECT *, unnest(generate_series(ceil(close * 0.9::DOUBLE / step)::BIGINT, floor(close * 1.1::DOUBLE "
    f"/ step)::BIGINT)) * step AS value FROM s) SELECT symbol, value FROM m WHERE abs(value - close) / close > 0.01"
)
def _v05(s, d):
    V.register(s)
    eb(s, d).groupBy("symbol").agg(F.max_by("close", "date").alias("close")).createOrReplaceTempView("event_last_close")
    return s.sql("SELECT symbol, value FROM event_last_close, LATERAL explode_levels(close)")
