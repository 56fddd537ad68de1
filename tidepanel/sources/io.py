"""Scans, normalisers and sinks of the panel tables.

Schemas are explicit and only grow: a missing column reads as null, an extra one is
ignored, whole numbers become doubles.
"""

import json
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.filters import filter_halt_days
from ..operators.joins import dedup_last

_D, _S = T.DoubleType(), T.StringType()
# The tables' columns.
DAILY = T.StructType(
    [
        T.StructField("symbol", _S),
        T.StructField("date", T.DateType()),
        *[T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume", "amount")],
        T.StructField("quote_ts", T.LongType())
    ]
)
ENRICHED = T.StructType(
    [
        *DAILY.fields,
        *[T.StructField(c, _D) for c in ("raw_close", "raw_high", "raw_low", "turnover_rate")],
        T.StructField("consecutive_limit_ups", T.IntegerType()),
        T.StructField("consecutive_limit_downs", T.IntegerType())
    ]
)
MINUTE = T.StructType(
    [
        T.StructField("symbol", _S),
        T.StructField("datetime", T.TimestampType()),
        *[T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume", "amount")]
    ]
)

#: Vendor column names and ours.
ALIASES = {"ts_code": "symbol", "trade_date": "date", "vol": "volume", "amt": "amount", "timestamp": "datetime", "time": "datetime"}
TRANSFORMS = {
    "x100": lambda c: c.try_cast("double") * 100,
    "d100": lambda c: F.try_divide(c.try_cast("double"), F.lit(100.0)),
    "d10000": lambda c: F.try_divide(c.try_cast("double"), F.lit(10000.0))
}
ENCODINGS = ("utf-8", "gb18030", "gbk", "gb2312", "big5")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the schema's columns and types: missing ones null, extra ones gone."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Where a table keeps its manifest of layouts; readers skip names that begin so. And how many footers are asked for at once.
_MANIFEST, _FOOTERS = "_layouts.json", 16


def layouts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """File schemas (JSON) of a table partitioned by date, each with its dates; empty if it has no such partitions.

    The schema of a date is that of one of its files. A manifest beside the partitions
    remembers them with their times of change, so that only new and changed partitions
    have a footer read; where it can't be written, each call asks anew.
    """
    fs, place = hadoop(spark, path)
    found = {}
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("date="):
            found[name[5:]] = (int(status.getModificationTime()), status.getPath().toString())
    manifest = spark._jvm.org.apache.hadoop.fs.Path(place, _MANIFEST)
    known = {}
    if found and fs.exists(manifest):
        stream = fs.open(manifest)
        known = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
    new = [d for d, (changed, _) in found.items() if d not in known or known[d][0] != changed]

    def schema_of(day: str) -> str:
        return spark.read.parquet(found[day][1]).schema.json()

    if new:
        with ThreadPoolExecutor(_FOOTERS) as pool:
            known = {d: x for d, x in known.items() if d in found} | {d: [found[d][0], x] for d, x in zip(new, pool.map(schema_of, new))}
        try:
            out = fs.create(manifest, True)
            out.write(bytearray(json.dumps(known).encode()))
            out.close()
        except Py4JJavaError:
            pass
    by_schema: dict[str, list[str]] = {}
    for day in sorted(found):
        by_schema.setdefault(known[day][1], []).append(day)
    return by_schema


def _ranges(days: list[str], all_days: list[str]) -> Column:
    """Whether a row's date is among ``days``, as ranges of ``all_days`` that follow one another."""
    place = {d: k for k, d in enumerate(all_days)}
    runs: list[list[str]] = []
    for d in days:
        if runs and place[d] == place[runs[-1][1]] + 1:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    return reduce(lambda a, b: a | b, [F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in runs])


def _scan(spark: SparkSession, path: str, schema: T.StructType, start=None, end=None, symbols=None) -> DataFrame:
    """The table in the schema's columns and types: each layout is read by its own explicit schema, so that no footer is opened but those of the files that are read."""
    of_dates = layouts(spark, path)
    days = sorted(d for own in of_dates.values() for d in own)
    inside = lambda d: (start is None or d >= str(start)) and (end is None or d <= str(end))
    parts = []
    for own, held in of_dates.items():
        if wanted := [d for d in held if inside(d)]:
            fields = [f for f in T.StructType.fromJson(json.loads(own)).fields if f.name != "date"]
            layout = T.StructType([*fields, T.StructField("date", T.DateType())])
            parts.append(conform(spark.read.schema(layout).parquet(path).filter(_ranges(wanted, days)), schema))
    if parts:
        df = reduce(lambda a, b: a.unionByName(b), parts)
    elif of_dates:
        df = spark.createDataFrame([], schema)
    else:  # files without date partitions
        df = conform(spark.read.option("mergeSchema", True).parquet(path), schema)
        df = df if start is None else df.filter(F.col("date") >= F.lit(start).cast("date"))
        df = df if end is None else df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df if symbols is None else df.filter(F.col("symbol").isin(list(symbols)))


def scan_daily(spark: SparkSession, path: str, start=None, end=None, symbols=None) -> DataFrame:
    """Daily bars; date bounds prune partitions, symbols are pushed to the files."""
    return _scan(spark, path, DAILY, start, end, symbols)


def scan_enriched(spark: SparkSession, path: str, columns: list[str] | None = None, start=None, end=None) -> DataFrame:
    df = _scan(spark, path, ENRICHED, start, end)
    return df.select(*columns) if columns else df


def scan_minute_range(minutes: DataFrame, symbols: list[str], start, end) -> DataFrame:
    day = F.to_date("datetime")
    return minutes.filter(
        F.col("symbol").isin(symbols) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).orderBy("symbol", "datetime")


def scan_minute_dates(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """Minutes of the listed trading days only."""
    return minutes.withColumn("date", F.to_date("datetime")).join(days.select("date").distinct(), "date", "left_semi")


def scan_all_assets(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of several asset types as one, each row with its ``asset_type``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("asset_type", F.lit(k)) for k, df in frames.items()])


def encoding_of(head: bytes) -> str:
    """The first of ``ENCODINGS`` that decodes a file's first bytes."""
    for name in ENCODINGS:
        for cut in range(4):  # the sample may end inside a character
            try:
                head[: len(head) - cut or None].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    return "utf-8"


def sniff_encodings(spark: SparkSession, path: str, sample: int = 1 << 16) -> dict[str, list[str]]:
    """The files of a path (a file, a folder or a pattern) by encoding; of each file ``sample`` bytes are read, whatever its size."""
    fs, place = hadoop(spark, path)
    files = []
    for status in fs.globStatus(place) or []:
        files += list(fs.listStatus(status.getPath())) if status.isDirectory() else [status]
    names = sorted(f.getPath().toString() for f in files if f.isFile() and f.getPath().getName()[0] not in "._" and f.getLen())

    def head(name: str) -> str:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(name))
        try:
            return encoding_of(bytes(stream.readNBytes(sample)))
        finally:
            stream.close()

    out: dict[str, list[str]] = {}
    with ThreadPoolExecutor(_FOOTERS) as pool:
        for name, encoding in zip(names, pool.map(head, names)):
            out.setdefault(encoding, []).append(name)
    return out


def read_csv_any_encoding(spark: SparkSession, path: str, symbol_names: tuple[str, ...] = ("symbol", "code", "ts_code", "代码", "股票代码")) -> DataFrame:
    """CSV files, each in any of the known encodings; the column that names symbols becomes ``symbol``.

    There is one reader for each encoding; the files of one have their columns in one order.
    """
    parts = []
    for encoding, files in sniff_encodings(spark, path).items():
        if encoding != "utf-8":  # Spark reads other character sets only with this setting, which it looks up when the plan runs
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        parts.append(clean_column_names(spark.read.csv(files, header=True, encoding=encoding)))
    if not parts:
        raise FileNotFoundError(path)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    hit = next(
        (c for c in df.columns for s in symbol_names if c.strip().lower() == s),
        None
    ) or next((c for c in df.columns for s in symbol_names if s in c.lower()), None)
    return df.withColumnRenamed(hit, "symbol") if hit and hit != "symbol" else df


def read_json_rows(df: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """Rows of the array at a dotted path (numbers index arrays) in a JSON column."""
    json_path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    rows = F.from_json(F.get_json_object(F.col(column), json_path), f"array<struct<{schema}>>")
    return df.select(F.explode(rows).alias("_r")).select("_r.*")


def map_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped columns only, under our names."""
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items() if a in df.columns])


def apply_transforms(df: DataFrame, transforms: dict[str, str]) -> DataFrame:
    """``column: transform``, the transform being ``x100``, ``d100``, ``d10000``, ``parse_date(fmt)`` or ``parse_datetime(fmt)``."""

    def one(name: str, spec: str) -> Column:
        if spec in TRANSFORMS:
            return TRANSFORMS[spec](F.col(name))
        if m := re.fullmatch(r"parse_date(time)?\((.+)\)", spec):
            return F.try_to_timestamp(F.col(name), F.lit(m[2])) if m[1] else F.try_to_timestamp(F.col(name), F.lit(m[2])).cast("date")
        raise ValueError(f"unknown transform: {spec}")

    return df.withColumns({k: one(k, v) for k, v in transforms.items()})


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})


def any_date(c: Column, kind: str) -> Column:
    """A date from a date, a timestamp, epoch milliseconds, or text as 2024-01-31 or 20240131."""
    if kind in ("bigint", "int"):
        return F.when(c > 100_000_000, F.timestamp_millis(c).cast("date")).otherwise(
            F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date")
        )
    if kind == "string":
        return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"), c.try_cast("date"))
    return c.cast("date")


def normalize_daily(df: DataFrame) -> DataFrame:
    """Vendor rows as canonical daily bars, without halts; what can't be read is null."""
    df = _renamed(df)
    kinds = dict(df.dtypes)
    df = df.withColumn("date", any_date(F.col("date"), kinds["date"])).withColumns(
        {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume", "amount") if c in kinds}
    )
    return filter_halt_days(conform(df, DAILY)).filter("symbol IS NOT NULL AND date IS NOT NULL")


def normalize_minute(df: DataFrame) -> DataFrame:
    """Epoch milliseconds or text times to timestamps, canonical columns."""
    df = _renamed(df)
    kind, c = dict(df.dtypes)["datetime"], F.col("datetime")
    at = F.timestamp_millis(c) if kind in ("bigint", "int") else c.try_cast("timestamp")
    return conform(df.withColumn("datetime", at), MINUTE).filter("datetime IS NOT NULL")


def normalize_adj_factors(df: DataFrame) -> DataFrame:
    kind, c = dict(df.dtypes)["trade_date"], F.col("trade_date")
    return df.select("symbol", any_date(c, kind).alias("trade_date"), F.col("ex_factor").try_cast("double").alias("ex_factor")).dropna()


def normalize_instruments(df: DataFrame) -> DataFrame:
    """Nested ``ext`` flattened, the code from the symbol where missing, one row a symbol."""
    if "ext" in df.columns:
        df = df.select(*[c for c in df.columns if c != "ext"], "ext.*")
    code = F.split_part("symbol", F.lit("."), F.lit(1))
    df = df.withColumn("code", F.coalesce(F.nullif(F.trim("code"), F.lit("")), code) if "code" in df.columns else code)
    return dedup_last(df, ["symbol"], [c for c in ("as_of", "name") if c in df.columns])


def flatten_labels(labels: Column, joiner: str = ";") -> Column:
    """An array of labels as one string, without null, ``nan`` and ``none``."""
    return F.array_join(F.filter(labels, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin("", "nan", "none")), joiner)


def cast_to_config(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Declared types string, int, float, bool; lists become strings joined by ``;``."""
    names, kinds = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean"}, dict(df.dtypes)
    one = lambda c, t: F.array_join(
        F.transform(F.col(c), lambda x: x.cast("string")),
        ";"
    ) if kinds[c].startswith("array") else F.col(c).try_cast(names[t])
    return df.withColumns({c: one(c, t) for c, t in types.items() if c in kinds})


def infer_fields(df: DataFrame) -> list[dict]:
    """``name, type`` of every column, the type being string, int, float or bool."""
    kind = lambda t: "bool" if t == "boolean" else "int" if t in ("tinyint", "smallint", "int", "bigint") else "float" if t in ("float", "double") or t.startswith("decimal") else "string"
    return [{"name": c, "type": kind(t)} for c, t in df.dtypes]


def detect_key_columns(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Share of each text column's values that look like a symbol or a bare code; of any ``sample`` of them, if asked for."""
    texts = [c for c, t in df.dtypes if t == "string"]
    head = df if sample is None else df.limit(sample)
    share = lambda c, p: F.coalesce(F.avg(F.col(c).rlike(p).cast("double")), F.lit(0.0)).alias(c)
    return head.agg(*[share(c, r"^\d{6,}(\.(SH|SZ|BJ))?$") for c in texts])


def clean_column_names(df: DataFrame) -> DataFrame:
    """Names without ``(...)``, repeated ones numbered."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        c = re.sub(r"[（(].*?[）)]", "", c).strip() or "column"
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*names)


def merged(old: DataFrame, new: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Old and new rows, the new one where a key repeats, and of several new ones the last in order of ``tie``."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return dedup_last(both, keys, ["_seq", *tie]).drop("_seq")


def upsert_by_date(spark: SparkSession, path: str, new: DataFrame, keys: list[str], tie: list[str], schema: T.StructType | None = None) -> None:
    """Merges rows into ``date`` partitions; only the partitions that ``new`` touches are read and rewritten."""
    days = [r[0] for r in new.select("date").distinct().collect()]  # partitions, not rows
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there:
        old = spark.read.option("mergeSchema", True).parquet(path).filter(F.col("date").isin(days))
        rows = merged(conform(old, schema) if schema else old, new, keys, tie)
    else:
        rows = dedup_last(new, keys, tie)
    if there:  # the result is materialised before its own source is overwritten
        rows = rows.checkpoint()
    rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def merge_factors(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged factor table and the symbols that ``new`` changes."""
    changed = new.join(old, ["symbol", "trade_date", "ex_factor"], "left_anti").select("symbol").distinct()
    return merged(old, new, ["symbol", "trade_date"], ["ex_factor"]), changed


def read_external_latest(df: DataFrame, day=None) -> DataFrame:
    """A snapshot table whole, a dated one at ``day`` or at its newest date."""
    if "date" not in df.columns:
        return df
    if day is not None:
        return df.filter(F.col("date") == F.lit(day).cast("date"))
    return df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row


def lost_dates(existing: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``date``: the dates that ``rebuilt`` lacks."""
    return existing.select("date").distinct().join(rebuilt.select("date").distinct(), "date", "left_anti")


def guard_full_rebuild(existing: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``rebuilt``, or a refusal if it would lose dates."""
    if missing := [str(r[0]) for r in lost_dates(existing, rebuilt).orderBy("date").limit(5).collect()]:
        raise ValueError(f"the rebuild lacks dates: {missing}")
    return rebuilt


def halt_rows_per_date(df: DataFrame) -> DataFrame:
    """The dry run of a purge: halt rows per date."""
    return df.filter("open = 0 AND high = 0").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def purge_halt_rows(df: DataFrame) -> DataFrame:
    return filter_halt_days(df)


def repartition_symbol_to_date(df: DataFrame) -> DataFrame:
    """Rows of the old symbol layout ready for the date layout: no null times, one row a key."""
    return dedup_last(df.filter("date IS NOT NULL"), ["symbol", "date"], ["quote_ts", "close"] if "quote_ts" in df.columns else ["close"])


def write_external(old: DataFrame | None, new: DataFrame, mode: str, fields: list[str]) -> DataFrame:
    """The table after writing ``new``: a snapshot merges by symbol, a timeseries by symbol and date."""
    keys = ["symbol"] if mode == "snapshot" else ["symbol", "date"]
    return dedup_last(new, keys, fields) if old is None else merged(old, new, keys, fields)


def recent_alerts(log: DataFrame, since, source: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    out = log.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    out = out if source is None else out.filter(F.col("source") == source)
    out = out if kind is None else out.filter(F.col("type") == kind)
    return out.orderBy(F.col("ts").desc(), "id").limit(limit)


def retained_alerts(log: DataFrame, since, most: int = 5000) -> DataFrame:
    """Alerts since a time, the newest ``most``."""
    return log.filter(F.col("ts") >= F.lit(since).cast("timestamp")).orderBy(F.col("ts").desc(), "id").limit(most)


def incremental_dates(bars: DataFrame, target: DataFrame, history: int = 60) -> tuple[DataFrame, DataFrame]:
    """The dates that the target lacks, and the bars needed to compute them: those dates' and ``history`` trading days before the first."""
    missing = bars.select("date").distinct().join(target.select("date").distinct(), "date", "left_anti")
    order = bars.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    first = order.join(missing, "date").agg(F.min("k").alias("first"))
    needed = order.join(F.broadcast(first), F.col("k") >= F.col("first") - history).select("date")  # one row
    return missing, bars.join(F.broadcast(needed), "date", "left_semi")  # a row a date


def incremental_enrich(bars: DataFrame, target: DataFrame, compute, changed_symbols: DataFrame | None = None, history: int = 60) -> DataFrame:
    """Rows to upsert: ``compute`` on missing dates with their history, and on all dates of symbols whose factors changed."""
    missing, needed = incremental_dates(bars, target, history)
    new = compute(needed).join(F.broadcast(missing), "date", "left_semi")
    if changed_symbols is None:
        return new
    whole = compute(bars.join(changed_symbols, "symbol", "left_semi"))
    return new.join(changed_symbols, "symbol", "left_anti").unionByName(whole)
