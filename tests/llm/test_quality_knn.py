import random
import zlib

import numpy as np
import pytest

from tidepanel.llm import quality_knn as Q

GOOD, BAD = "the quiet river ran past old houses and people talked of rain".split(), "BUY NOW!!! $$$ ### CLICK &&& %%%".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(rng.choice(GOOD if good else BAD) for _ in range(rng.randint(30, 90)))
        rows.append((i, text, int(good)))
    return rows


def tables(spark, rows):
    return spark.createDataFrame(
        [(i, t, 1.0) for i, t, _ in rows],
        "doc_id long, text string, score double"
    ), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def test_held_out_accuracy(spark, corpus):
    df, labels = tables(spark, corpus)
    out = Q.quality_report(df, labels).collect()
    truth = {i: q for i, _, q in corpus}
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out) and len(out) == len(corpus)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_held_out_labels_and_ids_do_not_change_scores(spark, corpus):
    df, labels = tables(spark, corpus)
    flipped = [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, t, q in corpus]
    a, b = Q.quality_report(df, labels), Q.quality_report(*tables(spark, flipped))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_scores_match_brute_force(corpus):
    counts = np.stack([Q.terms(t) for _, t, _ in corpus])
    labels = np.array([q for *_, q in corpus])
    voter = Q.Voter(counts[:150], labels[:150], len(counts), (counts > 0).sum(axis=0))
    for row in range(150, 170):
        v = voter.latent(counts[row : row + 1])[0]
        near = voter.vectors @ v
        top = sorted(range(150), key=lambda k: (-round(float(near[k]) * 1e6), k))[: Q.NEIGHBOURS]
        w = np.maximum(near[top], 1e-6).astype(np.float64) ** Q.SHARPNESS
        assert abs((w * labels[top]).sum() / w.sum() - voter.scores(counts[row : row + 1])[0]) < 1e-5


def test_pieces_do_not_change_terms(monkeypatch):
    text = "Ein Text, mit Wörtern! " * 40
    whole = Q.terms(text)
    monkeypatch.setattr(Q, "PIECE", 50)
    assert np.abs(Q.terms(text) - whole).max() <= 60 and Q.terms(text).sum() >= whole.sum()


def test_edge_cases(spark, corpus):
    rows = [*corpus, (None, None, 1), (900, "", 1), (901, None, 0), (902, "x " * 100000, 1), (5, "again", 0)]
    df, labels = tables(spark, rows)
    out = Q.quality_report(df, labels.unionByName(spark.createDataFrame([(7, None), (12345, 1)], "doc_id long, quality int"))).collect()
    assert len(out) == len(rows) and all(r["score"] is not None for r in out)
    none = Q.quality_report(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.quality_report(df.limit(0), labels).count() == 0
    assert Q.keep_good(df, labels).columns == df.columns


def test_labels_without_documents_take_no_place_in_the_sample(spark, corpus):
    df, labels = tables(spark, corpus)
    strange = spark.range(1_000_000, 1_010_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    a, b = Q.train(df, labels, sample=100), Q.train(df, labels.unionByName(strange), sample=100)
    assert len(a.labels) == len(b.labels) == 100 and (a.vectors == b.vectors).all()
