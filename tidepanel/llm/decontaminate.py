"""Benchmark decontamination by spaced-seed hashing.

A mask selects some positions of a window of words and ignores the rest; the
selected words' hashes make the window's key. Keys of the test items are joined
with keys of the training texts, so a substituted word costs only the masks that
select it. Around every hit the text and the item are compared word by word: they
overlap if some window of ``WINDOW`` words (the whole item, if shorter) has at
least ``MATCHES`` of ``WINDOW`` words equal.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower
case; punctuation and white space only part them.

Scale: the hash index over the test items goes to the tasks in blocks of at most
``BLOCK_WORDS`` words; every block is one pass over the texts, so a benchmark of
any size is joined whole while a task's memory stays bounded. The texts are never
shuffled, whatever the number of hits.

The masks of a window length cover every pattern of substitutions that the rule
admits there, so nothing it accepts is missed: 13 words with 3 substituted, 9 to
12 with 2, 5 to 8 with 1; shorter items must occur word by word.

Cases: a null or empty text overlaps nothing, an item without words matches
nothing; an item of few words matches wherever they occur, unless ``least_words``
sets a least number; repeated items are all reported, items with a null id as
null; rows with null or repeated ids are judged one by one; texts and items of one
word over and over take memory in proportion to their length; either table may be
empty; all columns pass through, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, text_batches

WINDOW, MATCHES = 13, 10
#: Selected (1) and ignored (0) positions, by the length of the window.
MASKS = (
    {n: ("1" * n,) for n in range(1, 5)}
    | {5: ("1111", "11011", "10111", "11101")}
    | {n: ("1111", "11011") for n in (6, 7, 8)}
    | {
        9: ("110111", "1111001", "110001011", "101000111"),
        10: ("110111", "111000101", "101011101"),
        11: ("1101011", "11100000111"),
        12: ("1101011", "1110001001"),
        13: ("110111", "1101000011", "1100000100011"),
    }
)
#: Items of fewer words match nothing.
LEAST_WORDS = 1
BLOCK_WORDS = 2_000_000
#: Hits held at once.
PAIRS = 1 << 18
#: Bytes hashed at once.
SLICE = 1 << 20

_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte a 64-bit value, equal for both cases of a letter, zero where words part; powers of an odd base."""
    rng = np.random.default_rng(20240229)
    values = rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
    for upper in range(65, 91):
        values[upper] = values[upper + 32]
    for b in range(128):
        if not chr(b).isalnum():
            values[b] = 0
    powers = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=_U), dtype=_U)
    return values, powers


_VALUES, _POWERS = _tables()


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of every word in ``data`` (bytes)."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):  # cut where words part
            gaps = np.flatnonzero(_VALUES[data[at:end]] == 0)
            while not len(gaps) and end < len(data):
                end = min(len(data), end + SLICE)
                gaps = np.flatnonzero(_VALUES[data[at:end]] == 0)
            end = at + int(gaps[-1]) + 1 if len(gaps) and end < len(data) else end
        values = _VALUES[data[at:end]]
        inside = values != 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        first, last = edges[::2], edges[1::2]
        if len(first):
            place = np.arange(len(values)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(values)]])))
            with np.errstate(over="ignore"):
                terms = values * _POWERS[place & 255]
                total = np.concatenate([[_U(0)], np.cumsum(terms, dtype=_U)])
                own = total[last] - total[first] + (last - first).astype(_U)
                own = (own ^ (own >> _U(32))) * _U(0xD6E8FEB86659FD93)
            hashes.append(own ^ (own >> _U(29)))
            starts.append(first + at)
        at = end
    none = np.zeros(0, dtype=_U)
    return np.concatenate([none, *hashes]), np.concatenate([np.zeros(0, dtype=np.int64), *starts])


def seed_keys(words: np.ndarray, mask: str) -> np.ndarray:
    """The key of the mask's window at every place where it fits."""
    n = len(words) - len(mask) + 1
    out = np.zeros(max(0, n), dtype=_U)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1" and n > 0:
                out = (out ^ words[k : k + n]) * _U(0xFF51AFD7ED558CCD)
                out ^= out >> _U(31)
    return out


class Index:
    """Keys of a block of test items."""

    def __init__(self, items: list[tuple[int | None, str | None]], least_words: int = LEAST_WORDS):
        self.ids, self.words, first = [], [], 0
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for id_, text in items:
            words, _ = word_hashes(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8))
            if len(words) < max(1, least_words):
                continue
            for m in MASKS[min(WINDOW, len(words))]:
                keys = seed_keys(words, m)
                found.setdefault(m, []).append((keys, first + np.arange(len(keys))))
            self.ids.append(id_)
            self.words.append(words)
            first += len(words)
        self.firsts = np.cumsum([0, *map(len, self.words)])
        self.all = np.concatenate([np.zeros(0, dtype=_U), *self.words])
        self.seeds = {}
        for m, parts in found.items():
            keys, places = np.concatenate([k for k, _ in parts]), np.concatenate([p for _, p in parts])
            order = np.argsort(keys, kind="stable")
            bits = max(16, int(len(keys) * 16).bit_length())
            seen = np.zeros(1 << bits, dtype=bool)
            seen[(keys >> _U(64 - bits)).astype(np.int64)] = True
            self.seeds[m] = (keys[order], places[order], seen, _U(64 - bits))

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``words`` and in the items' words whose keys are equal, about ``PAIRS`` at once."""
        for m, (keys, places, seen, shift) in self.seeds.items():
            own = seed_keys(words, m)
            at = np.flatnonzero(seen[(own >> shift).astype(np.int64)])
            low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(n)
            for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
                one = np.searchsorted(ends, pair, "right")
                yield at[one], places[low[one] + pair - (ends[one] - n[one])]

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int | None, int]]]:
        """For each text (``words[bounds[k]:bounds[k + 1]]``) the items it overlaps, with the most matching words of a window."""
        out: list[list[tuple[int | None, int]]] = [[] for _ in range(len(bounds) - 1)]
        best: dict[tuple[int, int], int] = {}
        verified: set[tuple[int, int, int]] = set()
        done = np.zeros(0, dtype=np.int64)
        span = len(words) + max(map(len, self.words)) + 1
        for ours, theirs in self.hits(words):
            text, item = np.searchsorted(bounds, ours, "right") - 1, np.searchsorted(self.firsts, theirs, "right") - 1
            both = text * len(self.words) + item
            code = (both * span + ours - (theirs - self.firsts[item]) + span - len(words))[~np.isin(both, done)]
            for both, d in np.stack(np.divmod(np.unique(code), span), axis=1).tolist():
                (t, i), d = divmod(both, len(self.words)), d - (span - len(words))
                window = min(WINDOW, len(self.words[i]))
                if best.get((t, i)) == window or (t, i, d) in verified:
                    continue
                verified.add((t, i, d))
                most = self._matches(words, int(bounds[t]), int(bounds[t + 1]), i, d, window)
                if most * WINDOW >= MATCHES * window:
                    best[t, i] = max(best.get((t, i), 0), most)
                    if most == window:
                        done = np.append(done, both)
        for (t, i), most in sorted(best.items()):
            out[t].append((self.ids[i], most))
        return out

    def _matches(self, words: np.ndarray, first: int, last: int, i: int, d: int, window: int) -> int:
        """The most equal words of a window of item ``i`` laid at ``d`` over the text ``words[first:last]``."""
        length = len(self.words[i])
        low, high = max(d, first), min(d + length, last)
        if high - low < window:
            return 0
        total = np.concatenate([[0], np.cumsum(words[low:high] == self.words[i][low - d : high - d])])
        return int((total[window:] - total[:-window]).max())


_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matches", T.IntegerType())]))


def _leaks_udf(spark: SparkSession, items: list[tuple[int | None, str | None]], least_words: int):
    shared = spark.sparkContext.broadcast(items)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, least_words)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("matches", pa.int32())]))
        for texts in batches:
            found: list[list[tuple[int | None, int]]] = []
            part: list[bytes] = []
            size = 0

            def flush():
                data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
                words, starts = word_hashes(data)
                ends = np.cumsum([0, *[len(x) + 1 for x in part]])
                found.extend(index.overlaps(words, np.searchsorted(starts, ends)))

            for one in texts:
                part.append((one.as_py() or "").encode("utf-8", "replace"))
                size += len(part[-1])
                if size >= SLICE:
                    flush()
                    part, size = [], 0
            if part:
                flush()
            yield pa.array([[{"item_id": i, "matches": m} for i, m in x] for x in found], kind)

    return F.arrow_udf(of, _LEAKS)


def _blocks(benchmark: DataFrame, key: str, text: str, block_words: int):
    """The items in blocks of at most about ``block_words`` words."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).cast("long"), F.col(text)).toLocalIterator():
        words = len((row[1] or "").split())
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += words
    if block:
        yield block


def with_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    least_words: int = LEAST_WORDS,
    to: str = "leaks"
) -> DataFrame:
    """``df`` with ``to``: the items that each row's text overlaps, with the words that match in the best window.

    A benchmark of more than ``block_words`` words takes several passes, between
    which the rows are written to the shared folder.
    """
    text_batches(df.sparkSession)
    none = F.lit(None).cast(_LEAKS)
    out = df.withColumn(to, F.coalesce(none, F.array().cast(_LEAKS)))
    for k, block in enumerate(_blocks(benchmark, item_key, item_text, block_words)):
        if k:
            out = cut(out)
        own = _leaks_udf(df.sparkSession, block, least_words)(F.col(text))
        out = df.withColumn(to, own) if not k else out.withColumn(to, F.concat(to, own))
    return out


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    block_words: int = BLOCK_WORDS,
    least_words: int = LEAST_WORDS
) -> DataFrame:
    """The rows of ``df`` whose text overlaps no item."""
    (leaks,) = free_names(df, "leaks")
    return with_leaks(df, benchmark, text, block_words=block_words, least_words=least_words, to=leaks).filter(F.size(leaks) == 0).drop(leaks)


def short_items(benchmark: DataFrame, least_words: int, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, text`` of the items of fewer words than ``least_words``, which :func:`drop_contaminated` doesn't look for."""
    words = F.regexp_count(F.coalesce(F.col(item_text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return benchmark.filter(words < least_words).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))


def leak_report(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    block_words: int = BLOCK_WORDS,
    least_words: int = LEAST_WORDS
) -> DataFrame:
    """``doc_id, item_id, matches`` of every text and item that overlap; a pass over ``df`` for each block of items."""
    text_batches(df.sparkSession)
    rows, out = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), None
    for block in _blocks(benchmark, "item_id", "text", block_words):
        leaks = _leaks_udf(df.sparkSession, block, least_words)(F.col("text"))
        found = rows.select("doc_id", F.explode(leaks).alias("leak")).select("doc_id", "leak.item_id", "leak.matches")
        out = found if out is None else out.union(found)
    if out is None:
        out = rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("matches")).limit(0)
    return out
