import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidepanel.llm import alignment as A
from tidepanel.llm.tokens import tokenizer_path

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, uid int, pairs string"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def letters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts, both):
    """Whole texts through the libraries, links by comparing ranges."""
    a, b = both
    byte = letters()
    docs = []
    for doc, text in texts:
        spans = None
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            own_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
            own_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
                spans = []
                for ids, own in ((ids_a, own_a), (ids_b, own_b)):
                    at, out = 0, []
                    for k, x in zip(ids, own):
                        out.append((k, at, at + len(x)))
                        at += len(x)
                    spans.append(out)
        docs.append((doc, spans))
    count, links_of = Counter(), []
    for _, spans in docs:
        links = []
        if spans:
            low = 0
            for ka, sa, ea in spans[0]:
                while spans[1][low][2] <= sa:
                    low += 1
                j = low
                while j < len(spans[1]) and spans[1][j][1] < ea:
                    links.append((ka, spans[1][j][0]))
                    j += 1
        count.update(links)
        links_of.append(links)
    top = defaultdict(int)
    for (_, kb), n in count.items():
        top[kb] = max(top[kb], n)
    out = []
    for (doc, spans), links in zip(docs, links_of):
        if not spans:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if low < e <= high) for side in spans) if len(cuts) < 2000 else None)
            low = high
        if groups[0] is None:  # the same in one pass
            groups, i, j = [], 0, 0
            for high in cuts:
                ga, gb = [], []
                while i < len(spans[0]) and spans[0][i][2] <= high:
                    ga.append(str(spans[0][i][0]))
                    i += 1
                while j < len(spans[1]) and spans[1][j][2] <= high:
                    gb.append(str(spans[1][j][0]))
                    j += 1
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        best, total = sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links)
        out.append((doc, len(spans[0]), len(spans[1]), len(groups), len(links), best, total, sha))
    return Counter(out)


def odd_text(rng, n):
    words = ["the", "word,", "Ünïcode", "日本語テキスト", "🙂🙃", "x" * 40, "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "12345", "ﬁne", "é", "Å", "ẞ", "ａｂ", "...", "​", "tion", "﻿", " ", "it's."]
    gaps = [" ", " ", " ", " ", "\n", "\n\n", "  ", " \n ", "\n   "] + (["\t", "　", "\r\n", "\x1c", " "] if rng.random() < 0.3 else [])
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))


def texts_of(seed, n=60):
    rng = random.Random(seed)
    out = [(k, odd_text(rng, rng.randrange(1, 60))) for k in range(n)]
    out += [(1000, None), (1001, ""), (1002, " "), (1003, "\n"), (1004, "a"), (1005, "under▁score"), (1006, " lead and trail "), (None, "no id here"), (1, "again"), (1, "again"), (1007, "\n\nx"), (1008, "a\x00b c"), (1009, "x" * 3000), (1010, "日" * 700)]
    return out


def test_equals_whole_texts(spark, both):
    texts = texts_of(1)
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], SCHEMA)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in A.alignment_report(df).collect())
    assert got == brute(texts, both)


def test_long_texts_in_short_ranges_and_a_shuffled_join(spark, both):
    """Every text of 50 bytes or more is cut into ranges, which fall inside tokens, and composed by pairs."""
    texts = texts_of(2, 25) + [(5000, "plain words " * 300 + "z" * 500 + " end"), (5001, "ok " * 200 + "a▁b" + " ok" * 50)]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], SCHEMA)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in A.alignment_report(df, size=50, fan=2, broadcast_pairs=0).collect())
    assert got == brute(texts, both)


def test_composition_is_associative(both):
    one, rng = A.aligner(PATHS), random.Random(4)
    for _ in range(20):
        text = odd_text(rng, 30).replace("▁", "")
        if one.whole(text) is None:
            continue
        own = [A.fragment(one, *c) for c in A.chunks(one, text, rng.randrange(8, 40))]

        def fold(parts):
            if len(parts) == 1:
                return parts[0]
            k = rng.randrange(1, len(parts))
            return fold(parts[:k]).then(one, fold(parts[k:]))

        flat = lambda f: (f.first, f.prefix, [(g, list(n)) for _, g, n in f.closed], f.suffix)
        left = own[0]
        for part in own[1:]:
            left = left.then(one, part)
        assert flat(fold(own)) == flat(fold(own)) == flat(left)
        assert not any(left.suffix)


def test_ranges_cover_the_text():
    one = A.aligner(PATHS)
    text = "ab cd " * 500 + "q" * 1000 + " tail"
    parts = list(A.chunks(one, text, 64))
    assert [p[1] for p in parts][1:] == [p[2] for p in parts][:-1] and parts[0][1] == 0 and parts[-1][2] == len(text) + 1
    assert max(len(p[4]) for p in parts) < 1200 and sum(len(p[4]) for p in parts) < 2 * len(text)


def test_empty_table(spark):
    assert A.alignment_report(spark.createDataFrame([], SCHEMA)).collect() == []
