from collections import Counter

from tidepanel.llm import line_dedup as L


def brute(rows, ratio, least):
    pages = Counter(h for _, _, h in rows)
    counts = Counter((h, x) for _, t, h in rows if t is not None for x in set(t.split("\n")) if x)
    bad = {k for k, n in counts.items() if n >= least and n / pages[k[0]] > ratio}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for i, t, h in rows), key=str)


def test_matches_brute_force_and_passes_columns(spark):
    rows = [(i, f"top\nown {i}\n\ntop\nend", "a") for i in range(9)] + [(20 + i, f"top\nown {i}", "b") for i in range(3)]
    rows += [(40, None, "a"), (41, "", "a"), (42, "top", None), (None, "top\nx", "a"), (0, "top\nown 0\n\ntop\nend", "a"), (50, "y\n" * 5000, "c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, __lines long, __host long")
    for ratio, least, broadcast in ((0.5, 3, 100), (0.5, 3, 0), (0.95, 2, 100), (0.05, 5, 100)):
        out = L.drop_lines(df, ratio=ratio, min_pages=least, broadcast_lines=broadcast)
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute(rows, ratio, least)


def test_report_and_empty(spark):
    df = spark.createDataFrame([(i, f"top\nown {i}", "a") for i in range(6)] + [(9, None, "a")], "doc_id long, text string, source string")
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in L.line_report(df).collect()}
    assert out[0] == ("own 0", 2, 1) and out[9] == (None, 0, 0)
    assert L.line_report(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert "Python" not in L.line_report(df)._jdf.queryExecution().toString()


def test_long_pages_of_boilerplate_take_linear_time(spark):
    """A host with 40,000 boilerplate lines, each looked up once a page that has it."""
    text = "\n".join(f"line {k}" for k in range(40_000))
    df = spark.createDataFrame([(i, f"{text}\nown {i}", "a") for i in range(6)], "doc_id long, text string, source string")
    for broadcast in (100_000, 0):
        out = L.drop_lines(df, broadcast_lines=broadcast)
        assert sorted(r["text"] for r in out.collect()) == [f"own {i}" for i in range(6)]
    assert "array_contains" not in L.line_report(df)._jdf.queryExecution().toString()
