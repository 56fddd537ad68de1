import hashlib
import zlib
from collections import Counter, defaultdict

from tidepanel.llm import sharding as S

SCHEMA = "doc_id long, text string, source string, shard int, slot string"


def digest(*parts):
    return int(hashlib.md5(":".join([S.SEED, *("" if p is None else str(p) for p in parts)]).encode()).hexdigest()[: S._DIGITS], 16)


def brute(rows, shards):
    """(doc_id, source, size, crc, shard, slot) by sorting everything in one place."""
    strata = defaultdict(list)
    for doc, text, source in rows:
        body = (text or "").encode()
        size, crc = len(body) + 1, zlib.crc32(body)
        strata["" if source is None else "=" + source].append((digest(doc, crc, size), doc is not None, doc or 0, size, crc))
    order = []
    for name, own in strata.items():
        shift = digest(name) / S._SPAN
        order += [((k + shift) / len(own), name, *row) for k, row in enumerate(sorted(own))]
    order.sort()
    bounds = [-(-len(order) * k // shards) for k in range(shards + 1)]
    out = []
    for k in range(shards):
        out += [(r[4] if r[3] else None, r[5], r[6], k, slot) for slot, r in enumerate(order[bounds[k] : bounds[k + 1]])]
    return Counter(out)


def run(spark, rows, shards=8):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return S.shard_rows(df, shards).collect()


def test_equals_a_single_sort(spark):
    rows = [(k, f"text {k % 37}" * (k % 5), ["hot", "hot", "a", "b", None][k % 5]) for k in range(500)]
    rows += [(7, "same", "hot")] * 300 + [(None, None, None)] * 3 + [(None, "", "a"), (1000, "é中", ""), (1001, "z" * 100_000, "once")]
    for shards in (1, 3, 8):
        got = run(spark, rows, shards)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == brute(rows, shards)


def test_every_shard_matches_the_mixture(spark):
    rows = [(k, str(k), "hot" if k % 3 else f"s{k % 30}") for k in range(2400)]
    got = run(spark, rows)
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    whole = Counter(r["stratum"] for r in got)
    for (_, stratum), n in Counter((r["shard"], r["stratum"]) for r in got).items():
        assert abs(n - whole[stratum] / 8) <= 1 + len(whole) / 8
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, "a", "x"), (2, None, None)])
    assert sorted((r["size"], r["text_crc32"]) for r in got) == [(1, 0), (2, zlib.crc32(b"a"))]
    assert {r["slot"] for r in got} == {0}


def test_report_columns_and_no_python(spark):
    df = S.shard_report(spark.createDataFrame([(1, "a", "x", 1, "")], SCHEMA))
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "fraction": "double"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = [(k, f"t{k}", "ab"[k % 2]) for k in range(100)] + [(5, "t5", "b")] * 4 + [(None, None, None)] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    S.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in back) == Counter(rows)
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in back) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in S.shard_rows(df, 4).collect())
