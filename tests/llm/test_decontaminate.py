import itertools
import random
import resource

import numpy as np

from tidepanel.llm import decontaminate as D

WORDS = [f"w{i}" for i in range(3000)]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(docs, items):
    out = set()
    for k, (_, text) in enumerate(docs):
        a = (text or "").lower().split()
        for i, item in items:
            b = (item or "").lower().split()
            if not b:
                continue
            w = min(D.WINDOW, len(b))
            for d in range(-len(b) + 1, len(a)):
                low, high = max(d, 0), min(d + len(b), len(a))
                equal = [a[p] == b[p - d] for p in range(low, high)]
                if any(sum(equal[s : s + w]) * D.WINDOW >= D.MATCHES * w for s in range(len(equal) - w + 1)):
                    out.add((k, i))
    return out


def case():
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randint(1, 40)))) for i in range(25)]
    docs = []
    for k in range(80):
        body = words(rng, rng.randint(0, 120))
        if k % 2:
            part = rng.choice(items)[1].split()
            part = part[rng.randint(0, 3) :]
            for p in rng.sample(range(len(part)), len(part) // 8):
                part[p] = rng.choice(WORDS)
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((k, " ".join(body).upper() if k % 3 else "  ".join(body)))
    return docs, items


def test_finds_what_brute_force_finds(spark, monkeypatch):
    docs, items = case()
    want = brute(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leak_report(df, bench).collect()}
    assert got == want and want
    blocks = {
        (r["doc_id"], r["leak"]["item_id"]) for r in D.with_leaks(df, bench, block_words=60).selectExpr("doc_id", "explode(leaks) AS leak").collect()
    }
    assert blocks == got == {(r["doc_id"], r["item_id"]) for r in D.leak_report(df, bench, block_words=60).collect()}
    monkeypatch.setattr(D, "SLICE", 64)
    small = D.Index(items)
    assert {(k, i) for k, (_, t) in enumerate(docs) for i, _ in small.overlaps(*split(t))[0]} == got


def split(text):
    w, _ = D.word_hashes(np.frombuffer(text.encode() + b"\n", dtype=np.uint8))
    return w, np.array([0, len(w)])


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer("One two, três ".encode() * 50 + b"x" * 500 + b" end", dtype=np.uint8)
    whole = D.word_hashes(data)
    monkeypatch.setattr(D, "SLICE", 20)
    parts = D.word_hashes(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == 152


def test_edge_cases(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [
        (1, passage),
        (1, passage),
        (None, "x " + passage.upper() + "!"),
        (3, None),
        (4, ""),
        (5, "alpha beta"),
        (6, passage[5:] * 1),
        (7, "word " * 20000 + passage)
    ]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, __leaks long")
    bench = spark.createDataFrame([(None, passage), (2, passage), (3, "alpha beta"), (4, None), (5, "")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in D.leak_report(df, bench).collect())
    assert got == sorted([(d, i) for d in ("1", "1", "None", "7") for i in ("None", "2", "3")] + [("5", "3")])
    long_ones = {(str(r["doc_id"]), str(r["item_id"])) for r in D.leak_report(df, bench, least_words=3).collect()}
    assert long_ones == {(d, i) for d in ("1", "None", "7") for i in ("None", "2")}
    bench = bench.filter("item_id IS DISTINCT FROM 3")
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert D.leak_report(df.limit(0), bench).count() == 0
    assert D.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_masks_cover_every_admitted_pattern_of_every_length():
    for n in range(1, 18):
        w = min(D.WINDOW, n)
        wrong = w - -(-D.MATCHES * w // D.WINDOW)
        item = [f"i{k}" for k in range(n)]
        index = D.Index([(7, " ".join(item))])
        for first in range(n - w + 1):
            for places in itertools.combinations(range(w), wrong):
                text = [f"x{k}" for k in range(n)]
                text[first : first + w] = [f"y{k}" if k in places else item[first + k] for k in range(w)]
                assert index.overlaps(*split(" ".join(text)))[0] == [(7, w - wrong)], (n, first, places)
            for places in itertools.combinations(range(w), wrong + 1) if n <= w else ():
                assert not index.overlaps(*split(" ".join(f"y{k}" if k in places else x for k, x in enumerate(item))))[0]


def test_one_word_over_and_over_takes_little_memory():
    index = D.Index([(k, "same " * 200) for k in range(3)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert index.overlaps(*split("same " * 80_000))[0] == [(0, 13), (1, 13), (2, 13)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
