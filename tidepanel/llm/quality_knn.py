"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

1. Terms of a text: hashed byte trigrams, four-grams of character classes, and
   bucketed figures on repetition and length. Their document frequencies are
   counted over all documents.
2. A truncated singular value decomposition of the weighted terms of a bounded
   sample of labelled texts (``SAMPLE``, those with the least hashes of their ids)
   gives ``DIMENSIONS`` latent axes.
3. The labelled vectors, at most ``SAMPLE`` times ``DIMENSIONS`` numbers, are
   broadcast. Every document's exact cosine products with all of them are computed
   block by block; the ``NEIGHBOURS`` largest vote, each with a power of its
   similarity as weight.

Only texts make a score: ids choose the sample, and labels are the neighbours'.

Cases: a null text counts as empty; an empty text has its own bucketed terms and is
scored like any other; several labels of one id average; labels that are null or
have no document teach nothing; without any taught label each score is 0.5; rows
repeat as they come; an empty table gives an empty result; all columns pass
through, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_batches
from .decontaminate import word_hashes

SAMPLE = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 6
GRAMS = 2048
CLASSES = 6
#: Rows scored at once.
ROWS = 256
#: Bytes of one text whose terms are counted at once.
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Byte to class: lower case and beyond ASCII, upper case, digit, white space, common punctuation, other."""
    out = np.full(256, 5, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 0 if b >= 128 or "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in " \t\r\n" else 4 if c in ".,;:'\"-()" else 5
    return out


_CLASS = _classes()
_SHAPES = CLASSES**4
_BUCKETS = 12
#: Groups of terms, each of which is scaled to length 1: trigrams, class four-grams, and one group for each figure.
GROUPS = (GRAMS, _SHAPES, *[_BUCKETS] * 5)
TERMS = sum(GROUPS)


def terms(text: str | None) -> np.ndarray:
    """Counts of a text's terms, group after group."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(TERMS, dtype=np.float32)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + 3].astype(np.int64)
        if len(part) >= 3:
            grams = (part[:-2] * 65599 + part[1:-1] * 2654435 + part[2:] * 40503) * 2654435761 >> 11
            out[:GRAMS] += np.bincount(grams % GRAMS, minlength=GRAMS)
        if len(part) >= 4:
            c = _CLASS[part]
            out[GRAMS : GRAMS + _SHAPES] += np.bincount(((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:], minlength=_SHAPES)
    words, starts = word_hashes(data)
    n = len(words)
    counts = np.unique(words, return_counts=True)[1] if n else np.zeros(0)
    figures = (
        np.log2(len(data) + 1) / 20,
        len(counts) / n**0.8 / 2 if n else 0,
        (counts.max() / n) * 4 if n else 0,
        (words[1:] == words[:-1]).mean() if n > 1 else 0,
        len(data) / n / 16 if n else 1,
    )
    for k, x in enumerate(figures):
        low = min(_BUCKETS - 1.001, max(0.0, float(x) * (_BUCKETS - 1)))
        first = GRAMS + _SHAPES + k * _BUCKETS + int(low)
        out[first], out[first + 1] = 1 - (low - int(low)) + 1e-3, low - int(low)
    return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each group's log counts times inverse document frequencies, scaled to length 1."""
    out, at = counts.astype(np.float32), 0
    np.log1p(out, out=out)
    out *= idf
    for k, size in enumerate(GROUPS):
        norm = np.linalg.norm(out[:, at : at + size], axis=1, keepdims=True)
        out[:, at : at + size] *= (1.0 if k < 2 else 0.6) / np.maximum(norm, 1e-9)
        at += size
    return out


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """How many texts there are and how many hold each term, over all of ``df``.

    Each task gives one row for each term it saw; their sums, ``TERMS`` rows whatever
    the corpus size, go to the driver.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for one in batch.column(0):
                seen[:-1] += terms(one.as_py()) > 0
                seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    seen = np.zeros(TERMS + 1, dtype=np.int64)
    for row in df.select(F.col(text)).mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[row["term"]] = row["n"]
    return int(seen[-1]), seen[:-1]


class Voter:
    """Labelled latent vectors, and the way from counts to latent vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, n: int, seen: np.ndarray):
        self.idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
        weighed = np.empty((len(counts), TERMS), dtype=np.float32)
        for at in range(0, len(counts), ROWS):
            weighed[at : at + ROWS] = _weigh(counts[at : at + ROWS], self.idf)
        rng = np.random.default_rng(11)
        k = min(DIMENSIONS, len(weighed))
        basis = np.linalg.qr(weighed.T @ (weighed @ rng.standard_normal((TERMS, min(k + 16, TERMS))).astype(np.float32)))[0]
        for _ in range(3):
            basis = np.linalg.qr(weighed.T @ (weighed @ basis))[0]
        axes = np.linalg.svd(weighed @ basis, full_matrices=False)[2][:k]
        self.axes = (basis @ axes.T).astype(np.float32)
        self.vectors, self.labels = self._unit(weighed @ self.axes), labels.astype(np.float32)

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(_weigh(counts, self.idf) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        # Whole-number ranks with the place as tie-break, so that equal products always choose the same neighbours.
        ranked = np.round(near * 1e6).astype(np.int64) * near.shape[1] - np.arange(near.shape[1])
        top = np.argpartition(ranked, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)


def held_out(key: Column) -> Column:
    """Whether an id's labels are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Voter | None:
    """A voter taught by at most ``sample`` labelled rows that aren't held out."""
    text_batches(df.sparkSession)
    known = labels.filter(
        F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))
    ).groupBy(F.col(key).alias("id")).agg(F.avg(label).alias("label"))
    # Labels without a document would fill the sample and teach nothing.
    present = known.join(df.select(F.col(key).alias("id")), "id", "left_semi")
    chosen = present.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.minimum(terms(x.as_py()), 60000).astype(np.float16).tobytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(got, pa.binary())], names=["id", "label", "counts"])

    taught = rows.mapInArrow(of, "id long, label double, counts binary").groupBy("id").agg(
        F.min("label").alias("label"),
        F.min("counts").alias("counts")
    )
    found = taught.orderBy("id").limit(sample).collect()
    if not found:
        return None
    counts, taught_labels = np.empty((len(found), TERMS), dtype=np.float16), np.array([r["label"] for r in found])
    for k in range(len(found)):
        counts[k], found[k] = np.frombuffer(found[k]["counts"], dtype=np.float16), None
    return Voter(counts, taught_labels, *document_frequencies(df, text))


def with_scores(df: DataFrame, voter: Voter | None, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 in column ``to``."""
    if voter is None:
        return df.withColumn(to, F.lit(0.5))
    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(voter)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [np.zeros(0)]
            for at in range(0, len(texts), ROWS):
                out.append(shared.value.scores(np.stack([terms(x.as_py()) for x in texts[at : at + ROWS]])))
            yield pa.array(np.concatenate(out).clip(0, 1), pa.float64())

    return df.withColumn(to, F.arrow_udf(of, "double")(F.col(text)))


def quality_report(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scored = with_scores(rows, train(rows, labels), "text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with a score of at least one half."""
    (score,) = free_names(df, "score")
    return with_scores(df, train(df, labels, key, text), text, score).filter(F.col(score) >= 0.5).drop(score)
