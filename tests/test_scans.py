"""Scans over files of several layouts and encodings."""

import os
from datetime import date

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidepanel.sources import io as S

PRICES = {"open": 10.0, "high": 10.5, "low": 9.8, "close": 10.2, "amount": 10200.0}


def put(root, day, **columns):
    folder = root / f"date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    table = pa.table({"symbol": ["600000.SH"], **{k: pa.array([v]) if not isinstance(v, pa.Array) else v for k, v in {**PRICES, **columns}.items()}})
    pq.write_table(table, folder / "part.parquet")


@pytest.fixture
def daily(tmp_path):
    root = tmp_path / "daily"
    put(root, "2026-07-08", volume=1000.0)
    put(root, "2026-07-09", volume=1200, quote_ts=1783560600000)
    put(root, "2026-07-10", volume=1300.0)
    return root


def test_daily_scan_of_files_with_and_without_a_column(spark, daily):
    df = S.scan_daily(spark, str(daily))
    rows = df.orderBy("date").collect()
    assert [r["volume"] for r in rows] == [1000.0, 1200.0, 1300.0] and dict(df.dtypes)["volume"] == "double"
    assert [r["quote_ts"] for r in rows] == [None, 1783560600000, None] and dict(df.dtypes)["quote_ts"] == "bigint"
    assert [r["date"] for r in rows] == [date(2026, 7, 8), date(2026, 7, 9), date(2026, 7, 10)]
    assert S.scan_daily(spark, str(daily), "2026-07-09", "2026-07-09").count() == 1
    assert S.scan_daily(spark, str(daily), "2027-01-01").count() == 0 and S.scan_daily(spark, str(daily), symbols=["x"]).count() == 0


def test_enriched_scan_of_unsigned_streaks(spark, tmp_path):
    root = tmp_path / "enriched"
    more = {"raw_close": 10.2, "raw_high": 10.5, "raw_low": 9.8, "turnover_rate": 1.1, **{f"consecutive_limit_{x}": pa.array([2], pa.uint32()) for x in ("ups", "downs")}}
    put(root, "2026-07-08", volume=1000.0, **more)
    put(root, "2026-07-09", volume=1200, quote_ts=1783560600000, **more)
    df = S.scan_enriched(spark, str(root))
    assert sorted(r["consecutive_limit_ups"] for r in df.collect()) == [2, 2] and dict(df.dtypes)["volume"] == "double"


def test_scan_prunes_partitions_and_asks_each_footer_once(spark, daily, monkeypatch):
    plan = S.scan_daily(spark, str(daily), "2026-07-09")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert os.path.exists(daily / "_layouts.json")
    asked = []
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **k: asked.append(paths) or real(self, *paths, **k))
    S.layouts(spark, str(daily))
    assert asked == []
    put(daily, "2026-07-11", volume=5.0, extra="x")
    assert sum(len(d) for d in S.layouts(spark, str(daily)).values()) == 4 and len(asked) == 1
    assert S.scan_daily(spark, str(daily)).count() == 4 and "extra" not in S.scan_daily(spark, str(daily)).columns


def test_files_without_date_partitions_are_read_as_they_are(spark, tmp_path):
    pd.DataFrame({"symbol": ["a"], "date": [date(2026, 7, 8)], "close": [1.0]}).to_parquet(tmp_path / "x.parquet")
    assert S.scan_daily(spark, str(tmp_path), "2026-07-01").select("symbol", "close", "open").first() == ("a", 1.0, None)


def test_two_encodings_in_one_folder(spark, tmp_path):
    for name, encoding, rows in (("a.csv", "gb18030", "600001,甲\n600002,乙\n"), ("b.csv", "utf-8", "600003,丙\n"), ("c.csv", "utf-8", "")):
        (tmp_path / name).write_bytes(("股票代码,名称\n" + rows).encode(encoding) if rows else b"")
    df = S.read_csv_any_encoding(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("symbol", F.col(df.columns[1])).collect())) == [("600001", "甲"), ("600002", "乙"), ("600003", "丙")]
    found = S.sniff_encodings(spark, str(tmp_path / "*.csv"))
    assert {k: [os.path.basename(f) for f in v] for k, v in found.items()} == {"gb18030": ["a.csv"], "utf-8": ["b.csv"]}


def test_a_large_file_is_told_by_its_first_bytes(spark, tmp_path):
    """Four GB that are holes but for the head: nothing but the head is read."""
    path = tmp_path / "large.csv"
    with open(path, "wb") as f:
        f.write(("代码,名称\n" + "600001,平安\n" * 10_000).encode("gbk"))
        f.truncate(4 << 30)
    assert list(S.sniff_encodings(spark, str(path), 1 << 12)) == ["gb18030"]
    os.remove(path)
