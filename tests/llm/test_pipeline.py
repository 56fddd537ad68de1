import duckdb
import pandas as pd
import pytest

import corpus_pipeline as P
from tidepanel.llm import decontaminate, line_dedup, packing, quality_knn, simhash_dedup

GOOD = "the quiet river ran past old houses and people talked of rain while evening fell upon field hill and road".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import random

    rng, folder = random.Random(2), tmp_path_factory.mktemp("sf")
    docs = [
        (
            i,
            "\n".join(["common line on all pages", *(" ".join(rng.choice(GOOD) for _ in range(30)) for _ in range(4))]),
            "en",
            f"s{i % 2}"
        ) for i in range(60)
    ]
    docs += [(100 + i, " ".join(rng.choice(["BUY!!", "$$$", "NOW###"]) for _ in range(60)), "en", "s0") for i in range(20)]
    docs += [(200 + i, docs[3][1], "en", "s1") for i in range(3)]
    passage = " ".join(f"{rng.choice(GOOD)}{k}" for k in range(30))
    docs += [(300, docs[5][1] + "\n" + passage, "en", "s0"), (301, None, "en", None)]
    pd.DataFrame(
        [(*d, len(d[1] or "")) for d in docs],
        columns=["doc_id", "text", "lang", "source", "n_chars"]
    ).to_parquet(folder / "documents.parquet")
    pd.DataFrame(
        [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)],
        columns=["doc_id", "quality", "toxic"]
    ).to_parquet(folder / "labels.parquet")
    pd.DataFrame([(1, passage)], columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    return str(folder)


def test_stages_follow_each_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = docs
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in kept.items()}
    assert not [i for i in ids["quality"] if 100 <= i < 200] and set(range(60)) <= set(ids["quality"])
    assert sorted(ids["line_dedup"]) == sorted(ids["quality"]) and not kept["line_dedup"].filter("text LIKE '%common line%'").count()
    assert not [i for i in ids["simhash"] if 200 <= i < 300] and 3 in ids["simhash"]
    assert 300 not in ids["decontamination"] and set(range(60)) - set(ids["simhash"]) == set(range(60)) - set(ids["decontamination"])
    assert set(ids["packing"]) == set(ids["decontamination"])
    # Which of two pieces of one length goes where depends on the order of rows.
    one, two = P.run(spark, tables).collect(), docs.collect()
    assert sorted(r[:5] for r in one) == sorted(r[:5] for r in two)
    assert sorted((r["length"], r["sequence_id"], r["offset"]) for r in one) == sorted((r["length"], r["sequence_id"], r["offset"]) for r in two)


def test_line_stage_equals_its_sql(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, text FROM ({line_dedup.SQL})").fetchall(), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in P.lines(spark, docs, tables).collect()), key=str) == want


def test_every_stage_calls_its_operator(spark, tables, monkeypatch):
    docs, called = spark.read.parquet(f"{tables}/documents.parquet"), []
    operators = ((quality_knn, "keep_good"), (line_dedup, "drop_lines"), (simhash_dedup, "keep_one"), (decontaminate, "drop_contaminated"), (packing, "pack_documents"))
    for module, name in operators:
        monkeypatch.setattr(module, name, lambda df, *a, own=name, **k: called.append(own) or df)
    for _, stage in P.STAGES:
        stage(spark, docs, tables)
    assert called == [name for _, name in operators] and P.ORACLE_SQL is None


def test_short_benchmark_items_remove_nothing(spark, tables, tmp_path):
    import shutil

    folder = shutil.copytree(tables, tmp_path / "sf")
    pd.DataFrame([(1, "river"), (2, "quiet river ran"), (3, None), (4, "five words are looked for")], columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert P.decontamination(spark, docs, str(folder)).count() == docs.count()
    assert sorted(r["item_id"] for r in P.short_items(spark, str(folder)).collect()) == [1, 2, 3]


def test_empty_table_repeated_rows_and_clashing_columns(spark, tables, tmp_path):
    import shutil

    folder = shutil.copytree(tables, tmp_path / "sf")
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    docs = pd.concat([docs, docs.head(3), docs.tail(2)]).assign(score=1.5, node="x", row=2, item_id=3, ids=None, line="l")
    docs.to_parquet(folder / "documents.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, df, str(folder))
        assert name == "packing" or out.columns == df.columns
        df = spark.createDataFrame(out.collect(), out.schema)
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    assert {0, 1, 2} <= set(ids) and ids.count(0) == 1
    docs.head(0).astype({"ids": "string"}).to_parquet(folder / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(folder / "documents.parquet") + ".d")
    shutil.rmtree(folder / "documents.parquet", ignore_errors=True)
    (folder / "documents.parquet").unlink(missing_ok=True)
    shutil.move(str(folder / "documents.parquet") + ".d", folder / "documents.parquet")
    assert P.run(spark, str(folder)).count() == 0


def test_texts_are_named_by_128_bits(spark):
    rows = spark.createDataFrame([("A b",), ("a  B",), ("ab",), (None,)], "text string").select(simhash_dedup.text_name("text").alias("name")).collect()
    names = [bytes(r["name"]) for r in rows]
    assert len(names[0]) == 16 and names[0] == names[1] and len(set(names)) == 3
