"""The registered queries, each with the SQL it must equal where SQL can say it.

Doubles are rounded on both sides, for sums of floats depend on their order.
"""

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, tuple[str, int]] = {}


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles to so many digits, without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 7):
    """Registers a query function and its SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            # DuckDB's count_if is null where no condition is known; a filtered count is 0.
            SQL[name] = (re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(*) FILTER (WHERE \1)", sql), digits)
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under ``spark.checkpoint.dir``, or a temporary one where that isn't set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-tidepanel-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, for results that read it several times: its windows would be worked out for each."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rounded_sql(sql: str, doubles: list[str], digits: int) -> str:
    if not doubles:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0::DOUBLE AS {c}' for c in doubles)}) FROM ({sql}) AS t"


#: Columns and DuckDB types of the input tables, to learn which result columns are doubles.
_TABLES = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
}


def oracle_sql() -> dict[str, str]:
    import duckdb

    con = duckdb.connect()
    for name, columns in _TABLES.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
    out = {}
    for name, (sql, digits) in SQL.items():
        doubles = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall() if r[1] == "DOUBLE"]
        out[name] = rounded_sql(sql, doubles, digits)
    con.close()
    return out
