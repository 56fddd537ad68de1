import random

import xxhash

from tidepanel.llm import simhash_dedup as S


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    words = [w.decode() for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_brute_force():
    for text in [None, "", " \n", "One", "One TWO", "one two Three", "É À b c d é", "a\x0bb\x1cc d\xa0e f", "x " * 50]:
        assert S.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_blocks_do_not_change_the_fingerprint(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text) == whole


def test_components_match_all_pairs(spark):
    rng = random.Random(7)
    prints = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(60):  # chains whose neighbours differ in 1 to 3 bits
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.append(x)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
    prints = sorted(set(prints), key=lambda x: rng.random())
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    want = brute_components(prints)
    groups = {r["fp"]: r["component_id"] for r in S.groups_of(df).collect()}
    assert [groups[x] for x in signed] == want
    near = {(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 2}
    for cell in (0, 3, 10**6):  # every cell refined, some, none
        got = {tuple(sorted((r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1))) for r in S.links(df.select("fp"), cell).collect()}
        assert near and (got == near if cell > 3 else {x for p in got for x in p} == {x for p in near for x in p})


def test_star_of_thousands_has_linear_links(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(62)
    prints = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(a)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = S.links(df)
    assert links.count() <= 65 * len(prints)
    assert S.components(links).select("root").distinct().count() == 1


def test_edge_cases(spark):
    rows = [
        (None, "same words here now"),
        (5, "same words here now"),
        (3, "same words here now"),
        (9, None),
        (8, ""),
        (9, None),
        (None, "lonely other words apart"),
        (1, "x " * 3000)
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    out = S.report(df).collect()
    assert len(out) == len(rows)
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in out), key=str)
    assert got == sorted([("None", 3), ("5", 3), ("3", 3), ("9", 8), ("8", 8), ("9", 8), ("None", None), ("1", 1)], key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted(
        [("3", "same words here now"), ("8", ""), ("None", "lonely other words apart"), ("1", "x " * 3000)]
    )
    assert S.report(df.limit(0)).count() == 0
    assert S.keep_one(df.limit(0)).count() == 0


def test_stage_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f g", 7, 8, 9), (2, "a b c d e f g", 7, 8, 9)],
        "doc_id long, text string, __NODE int, __root int, __component int"
    )
    assert [tuple(r) for r in S.keep_one(df).collect()] == [(1, "a b c d e f g", 7, 8, 9)]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_stage_drops_near_copies_of_similarity_four_fifths(spark):
    rng, texts = random.Random(5), []
    for k in range(40):  # each changed word spoils five shingles of 200
        words = [f"w{rng.randrange(5000)}" for _ in range(204)]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for i in rng.sample(range(10, 190), rng.choice([1, 2, 3, 4, 6, 9])):
                other[i] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(other))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i // 4 * 4, i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 50 < len(set(root)) < len(texts) - 50
    kept = S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(root)


def test_stage_groups_copies_edited_more_and_less_as_brute_force_does(spark):
    """A group in which many texts aren't similar to its leader, some only to each other."""
    rng, texts = random.Random(9), []
    words = [f"w{k}" for k in range(204)]
    for k in range(120):
        other = list(words)
        for i in rng.sample(range(0, 200, 5), rng.randint(1, 9)):
            other[i] = rng.choice([f"v{i}", f"u{k}", f"t{rng.randrange(4)}"])
        texts.append(" ".join(other))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert len(set(root)) > 10 and max(map(root.count, set(root))) > 20
    kept = S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(root)


def test_stage_drops_a_large_group_and_its_bridges(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(204)]
    texts = [" ".join(f"v{n}" if i == rng_i else w for i, w in enumerate(words)) for n, rng_i in enumerate(rng.choices(range(20, 180), k=300))]
    step = list(words)
    for k in range(5):  # a chain that leads away from the group
        for i in (20 * k + 100, 20 * k + 110):
            step[i] = f"x{i}"
        texts.append(" ".join(step))
    kept = S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_parity_sketches_differ_in_no_more_slots_than_sets_in_elements():
    rng = random.Random(8)
    for n in (0, 1, 30, 900):
        one = {rng.getrandbits(64) for _ in range(n)}
        two = {x for x in one if rng.random() > 0.1} | {rng.getrandbits(64) for _ in range(n // 9)}
        a, b = (S.parity(S.np.array(sorted(x), dtype=S.np.uint64)) for x in (one, two))
        slots = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in a ^ b)
        assert slots <= len(one ^ two) <= (slots * 1.7 if n < 900 else 10**6)


def test_stage_verifies_few_pairs_of_a_large_group(spark, monkeypatch):
    """Copies edited in two or three places each are similar to hardly any other; they meet in buckets, but only pairs that may be similar are measured."""
    rng, words = random.Random(4), [f"w{k}" for k in range(150)]
    texts = []
    for k in range(400):
        other = list(words)
        for i in rng.sample(range(5, 145), rng.randint(2, 3)):
            other[i] = f"v{k}x{i}"
        texts.append(" ".join(other))
    measured, common = [], S.common
    monkeypatch.setattr(S, "common", lambda pairs, sets: measured.append(pairs.count()) or common(pairs, sets))
    kept = {r["doc_id"] for r in S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root, prints = list(range(len(texts))), [S.fingerprint(t, 5) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 2 or jaccard(texts[i], texts[j]) >= 0.8):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert kept == set(root) and len(measured) == 2
    assert measured[1] < 5 * len(texts), measured
