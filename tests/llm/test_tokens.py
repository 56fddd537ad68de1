import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidepanel.llm import packing as P
from tidepanel.llm import token_store as S
from tidepanel.llm import tokens as K

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library(name):
    path = K.tokenizer_path(name)
    ours, theirs, rng = K.Encoder(path), Tokenizer.from_file(path), random.Random(5)
    alphabet = [*"aB'sstre 1\n\t .,é́ \x85\x1c\xa0|<>!ΣσİǅẞΩ½"]
    alphabet += [" ", " ", "\n", "  ", "<|endoftext|>", "the", "don't", "ﬁ", "中文"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert ours.ids(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_text_equals_the_library(name):
    path = K.tokenizer_path(name)
    ours, theirs, rng = K.Encoder(path), Tokenizer.from_file(path), np.random.default_rng(5)
    for _ in range(300):
        ids = rng.integers(0, ours.vocabulary, rng.integers(0, 12))
        assert ours.text(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(K, "TABLE_WORDS", 3)
    monkeypatch.setattr(K, "TABLE_STEMS", 2)
    path, text = K.tokenizer_path(NAMES[1]), "one two three, four! five one two six seven three"
    assert K.Encoder(path).ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def brute_best_fit(lengths, capacity):
    left, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in range(len(left)) if left[b] >= lengths[i]]
        b = min(fits, key=lambda b: left[b]) if fits else len(left)
        if not fits:
            left.append(capacity)
        left[b] -= lengths[i]
        out.append(b)
    return len(left), sorted(left)


def placed(lengths, capacity):
    """Bins and offsets of ``lengths``, each with its number within its length, and the runs."""
    counts, ranks = defaultdict(int), []
    for x in lengths.tolist():
        ranks.append(counts[x])
        counts[x] += 1
    runs, n = P.best_fit_decreasing(counts, capacity)
    return *P.places(runs, lengths, np.array(ranks, dtype=np.int64)), runs, n


def test_best_fit_matches_a_linear_search():
    rng = np.random.default_rng(2)
    for n, most in ((0, 65), (1, 65), (5, 65), (300, 65), (300, 9), (600, 20), (400, 33)):
        lengths = rng.integers(1, most, n)
        bins, offsets, _, number = placed(lengths, 64)
        used = np.bincount(bins, weights=lengths) if n else np.zeros(0)
        assert len(used) == number and (len(used), sorted(64 - used)) == brute_best_fit(lengths.tolist(), 64)
        for b in range(len(used)):
            own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in own] == np.cumsum([0, *[x for _, x in own][:-1]]).tolist()


def test_runs_do_not_grow_with_the_corpus():
    """Ten million documents take about as many runs as a hundred thousand, and next to no room is lost."""
    rng, sizes = np.random.default_rng(4), []
    for n in (100_000, 10_000_000):
        values, counts = np.unique((rng.pareto(1.2, n) * 150 + 5).astype(np.int64).clip(1, 2048), return_counts=True)
        runs, number = P.best_fit_decreasing(dict(zip(values.tolist(), counts.tolist())), 2048)
        assert number <= 1.001 * (values * counts).sum() / 2048 + 1
        sizes.append(len(runs))
    assert sizes[1] < 1.5 * sizes[0] < 40_000


ROWS = [
    (3, "a long " * 3000),
    (1, "short one"),
    (None, "no id"),
    (2, None),
    (1, "short one"),
    (7, ""),
    (None, "no id either"),
    (-(1 << 62), "least"),
    (1 << 62, "most")
]


def rows(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, piece int")


def test_packing_places_every_piece_once(spark):
    encode = Tokenizer.from_file(K.tokenizer_path(NAMES[1])).encode
    out = P.pack_documents(rows(spark)).collect()
    want = []
    for doc, text in ROWS:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[x for _, x in own][:-1]]).tolist() and sum(x for _, x in own) <= 2048
    assert P.pack_documents(rows(spark).limit(0)).count() == 0


def test_partitions_do_not_change_the_number_of_sequences(spark):
    lengths = np.random.default_rng(6).integers(1, 65, 2000)
    df = spark.createDataFrame([(None if k % 3 else k, 0, 0, int(x), 1) for k, x in enumerate(lengths)], P._PIECE)
    for parts in (1, 7, 40):
        out = P.pack(df.repartition(parts), 64).toPandas()
        assert sorted(64 - out.groupby("sequence_id")["length"].sum()) == brute_best_fit(lengths.tolist(), 64)[1]
        assert (out.groupby(["sequence_id", "offset"]).size() == 1).all() and (out["offset"] + out["length"]).max() <= 64


def test_store_reads_back_what_it_wrote(spark, tmp_path):
    encode = Tokenizer.from_file(K.tokenizer_path(NAMES[0])).encode
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for doc, text in order:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for shard_bytes in (1 << 20, 40, 1):
        folder = f"file://{tmp_path}/{shard_bytes}"
        manifest = S.write_store(rows(spark), folder, shard_bytes=shard_bytes)
        got = sorted((tuple(r) for r in S.read_store(rows(spark), folder, manifest).collect()), key=lambda r: r[1])
        assert got == want
        other = spark.createDataFrame([(99,)], "doc_id long")
        assert S.read_store(other, folder, manifest).first()["n_tokens"] is None
    assert S.store_report(rows(spark).limit(0)).count() == 0


def test_many_rows_of_one_id_reach_many_shards(spark, tmp_path):
    texts = [(5, "same text")] * 300 + [(None, f"text {k}") for k in range(200)] + [(k, "other") for k in range(10)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/hot"
    manifest = S.write_store(df, folder, shard_bytes=600)
    spread = manifest.collect()
    assert len(spread) > 15 and max(m["documents"] for m in spread) < 150
    got = S.read_store(df, folder, manifest).collect()
    assert len(got) == 510 and len({r["start"] for r in got}) == 510 and all(r["n_tokens"] for r in got)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    more = df.unionByName(df.filter("doc_id = 5"))
    assert S.read_store(more, folder, manifest).filter("n_tokens IS NULL").count() == 301


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    mph = S.PerfectHash.build(keys)
    again, _ = S.PerfectHash.load(mph.dump(), 0)
    assert sorted(again.slot(keys).tolist()) == list(range(len(keys)))
