"""Every registered panel query against its SQL on the smallest tables, where they are there."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tidepanel.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


#: One query of each module and kind; the driver compares all of them at a larger size.
CHOSEN = [
    "e02_ma", "e06_kdj", "e15_rsi", "e25_cross_signals", "e36_minmax_score", "j01_adjust_prices", "e18_e24_limits", "k08_ma_golden_cross", "k09_macd_golden", "k19_run_all", "f03_basic_filter", "f05_custom_signal", "j05_explode_dimension", "j14_range_join",
    "a07_limit_tiers", "a16_rotation_signals", "d01_market_overview", "q03_rank_ic", "q06_group_stats", "l01_chip_distribution", "l08_gaps", "l10_round_numbers", "b04_b05_trades", "b09_curve_stats", "b18_walkforward", "s19_upsert_by_date", "s27_incremental_enrich", "z02_stateful_indicators", "z04_tumbling_bars", "v04_sql_aggregates",
    "k11_near_limit_up", "k14_pullback_ma20_bounce_params", "d01_overview_lists", "d03_limit_down_ladder", "q08_factor_catalog", "b12_bootstrap_drawdown", "z07_cooldown_stream", "z08_pool_changes", "z13_alert_enrichment", "s23_lost_dates", "r2_recursive_fold", "a17_concept_heat", "b13_forward_stats", "b14_signal_trades", "b16_sweep_trades", "b16_sweep_by_drawdown", "b18_out_of_sample", "l04_swings", "s06_csv_any_encoding", "s27_resumed_recursion",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*columns).collect())
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[k]) for k in order) for r in result.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_entry_works_without_the_corpus_subpackage(tmp_path, pipeline_left):
    """In a copy without the corpus folders, with or without the pipeline's file, the other queries are there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tidepanel", tmp_path / "tidepanel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline_left and os.path.exists(f"{root}/corpus_pipeline.py") else [])):
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), 'e02_ma' in q and 'e02_ma' in s, [n for n in q if n.startswith('op') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    n, there, corpus = out.stdout.split(maxsplit=2)
    assert int(n) > 250 and there == "True" and corpus.strip() == "[]", out.stderr


@pytest.mark.parametrize("name", ["d01_market_overview", "d01_overview_lists"])
def test_the_overview_works_its_windows_out_once(spark, name):
    """The frame is written before it is summed in several ways: no bars are made in the plan of the result."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_bars_are_dealt_by_symbol_once(spark):
    """Making bars, adjusting them and the windows behind take one exchange of the lines."""
    from tidepanel.operators.windows import lag
    from tidepanel.plans.catalog_indicators import adjusted

    df = adjusted(spark, SF)
    plan = df.select("symbol", "date", lag("close").alias("before"))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "s_suppkey" not in x]
    assert sum("REPARTITION_BY_COL" in x for x in lines) == 1 and "Union" not in plan


def test_profile_bars_are_counted_from_the_end_once(spark):
    """With ``back`` in the frame the families don't order all bars again for the last ones, and find the same."""
    from tidepanel.operators import levels as L
    from tidepanel.plans import catalog_research as R

    df = R.profile_frame(spark, SF).localCheckpoint()
    counted = L.counted_back(df).localCheckpoint()
    windows = lambda x: sum("Window [" in line for line in L.all_levels(x)._jdf.queryExecution().executedPlan().toString().splitlines())
    assert windows(counted) <= windows(df) - 8, (windows(counted), windows(df))
    rows = lambda x: sorted("|".join(map(plain, r)) for r in L.nearest_summary(L.all_levels(x), x).select("symbol", "type", "side", "rank", "value").collect())
    assert rows(counted) == rows(df)


def test_profile_levels_equal_their_sql(spark, con):
    test_equals_its_sql(spark, con, "d05_profile_levels")
