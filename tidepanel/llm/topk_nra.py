"""Exact top-k inner products by no-random-access aggregation.

Every dimension is a list of the candidates, sorted by their components. A query
reads a list from the top if its own component is positive and from the bottom if
it is negative, so that entries come in falling order of what they add to the
score. All lists are read in step, a ``STEPS``-th of their length at a time, each from where its
cursor stands. What is seen of a candidate gives its bounds: an entry not seen yet
adds at most what stands at its list's cursor and at least what stands at the
list's end. The k-th largest lower bound is the bar; a candidate whose upper bound
falls short of it is an outsider. A query stops reading once no more than
``RESOLVED`` candidates can still qualify (or the lists end), and then the final
scores of those are resolved. Nothing is approximate.

Scale: queries go to the tasks in blocks of at most ``QUERIES`` vectors; each block
is one pass over the candidates and is finished, merged and written by itself, so
neither the plan nor the driver grows with the number of blocks. A task holds one
block of queries, lists of ``CANDIDATES`` vectors, and k rows for each query, which
is also what it gives on; the bar of what it has read before spares later lists.

Cases: vectors that are null, empty, or hold a null or non-finite component take
no part; missing components of a shorter vector count as zero; rows that repeat a
query's id are not its candidates, other repeated rows are candidates each; equal
scores go to the smaller id; a query id that repeats with several vectors has the
best of all; null ids are neither queries nor candidates; empty tables give empty
results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder

K = 20
QUERIES = 16_384
CANDIDATES = 2048
#: Queries whose bounds are held at once in a task.
QUERY_ROWS = 256
#: Lists are read in so many steps at most.
STEPS = 8
#: A query stops reading at so many candidates that can still qualify; final scores are resolved so many at once.
RESOLVED, PAIRS = 4 * K, 1 << 18


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``id, v``: whole-number vectors of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & (F.size("x") > 0) & fine)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    row, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(start, sizes)
    out[row[place < dims], place[place < dims]] = flat[place < dims]
    return out


class Lists:
    """A block of candidates as one sorted list a dimension: rising components, and whose they are."""

    def __init__(self, vectors: np.ndarray, kind: type):
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1).astype(kind)
        self.dims, self.n = self.order.shape
        self.low, self.high = self.values[:, :1], self.values[:, -1:]


class Aggregator:
    """The best k of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.query = np.zeros(0, np.int64)
        self.score, self.candidate = self.query.copy(), self.query.copy()
        self.bar = np.full(len(ids), np.iinfo(np.int64).min)
        self.entries = self.read = self.scored = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in a block of candidates."""
        if not len(ids):
            return
        most = 4.0 * max(np.abs(self.queries).max(initial=1), 1) * max(np.abs(vectors).max(initial=1), 1) * self.queries.shape[1]
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        lists = Lists(vectors, kind)
        for at in range(0, len(self.ids), QUERY_ROWS):
            self._read(np.arange(at, min(at + QUERY_ROWS, len(self.ids))), lists, ids, vectors)

    def _read(self, own: np.ndarray, lists: Lists, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Reads the lists for some queries until no outsider can qualify, and resolves the rest."""
        kind, n = lists.values.dtype.type, lists.n
        q = self.queries[own].T.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        other = ids[:, None] != self.ids[None, own]
        # Lower bounds, from every entry at its list's end: what an entry adds beyond that is never negative.
        lower = np.repeat(lists.low.T @ up + lists.high.T @ down, n, axis=0)
        bar = self.bar[own]
        unseen_up, unseen_down = np.ones((n, lists.dims), dtype=kind), np.ones((n, lists.dims), dtype=kind)
        step, start, each = -(-n // STEPS), 0, np.arange(lists.dims)[:, None]
        self.entries += n * lists.dims * len(own)
        while len(own):
            end = min(n, start + step)
            # The entries read in this step, by candidate, so that one product adds them for all queries.
            tops, bottoms = lists.order[:, n - end : n - start], lists.order[:, start:end]
            new_up, new_down = np.zeros((n, lists.dims), dtype=kind), np.zeros((n, lists.dims), dtype=kind)
            new_up[tops, each] = lists.values[:, n - end : n - start] - lists.low
            new_down[bottoms, each] = lists.values[:, start:end] - lists.high
            unseen_up[tops, each] = unseen_down[bottoms, each] = 0
            lower += new_up @ up
            lower += new_down @ down
            self.read += (end - start) * lists.dims * len(own)
            rest = unseen_up @ ((lists.values[:, n - end, None] - lists.low) * up) + unseen_down @ (
                (lists.values[:, end - 1, None] - lists.high) * down
            )
            # The k-th lower bound counts where at least k candidates lie beyond the bar.
            above = np.flatnonzero((other & (lower > bar)).sum(axis=0) >= self.k)
            if len(above):
                known = np.where(other[:, above], lower[:, above], np.iinfo(np.int64).min).T.copy()
                bar[above] = np.partition(known, n - self.k, axis=1)[:, n - self.k].astype(np.int64)
            rest += lower
            open_ = other & (rest >= bar)
            done = np.full(len(own), end == n) | (open_.sum(axis=0) <= RESOLVED)
            if done.any():
                self._resolve(own[done], open_[:, done], ids, vectors, kind)
                go = ~done
                own, bar, up, down, lower, other = own[go], bar[go], up[:, go], down[:, go], lower[:, go], other[:, go]
            start = end

    def _resolve(self, own: np.ndarray, open_: np.ndarray, ids: np.ndarray, vectors: np.ndarray, kind: type) -> None:
        """Final scores of the candidates that can still qualify."""
        i, j = np.nonzero(open_.T)
        self.scored += len(i)
        for s in range(0, len(i), PAIRS):
            a, b = own[i[s : s + PAIRS]], j[s : s + PAIRS]
            self._merge(a, np.einsum("ij,ij->i", self.queries[a].astype(kind), vectors[b].astype(kind)).astype(np.int64), ids[b])

    def _merge(self, query: np.ndarray, score: np.ndarray, candidate: np.ndarray) -> None:
        fine = score >= self.bar[query]
        touched = np.zeros(len(self.ids), dtype=bool)
        touched[query] = True
        held = touched[self.query]
        q, s, c = (np.concatenate([a[held], b[fine]]) for a, b in ((self.query, query), (self.score, score), (self.candidate, candidate)))
        order = np.lexsort([c, -s, q])
        q, s, c = q[order], s[order], c[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = rank == self.k - 1
        self.bar[q[last]] = s[last]
        keep = rank < self.k
        self.query, self.score, self.candidate = (
            np.concatenate([a[~held], b[keep]]) for a,
            b in ((self.query, q), (self.score, s), (self.candidate, c))
        )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs as :func:`quantised` gives them."""
    spark = candidates.sparkSession
    blocks, folder = max(1, -(-queries.count() // block)), None
    for n in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).dropDuplicates().toArrow()
        if not own.num_rows:
            continue
        dims = int(np.diff(own["v"].combine_chunks().offsets.to_numpy()).max())
        shared = spark.sparkContext.broadcast((own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), dims)))

        def of(batches: Iterator[pa.RecordBatch], shared=shared, dims=dims) -> Iterator[pa.RecordBatch]:
            best = Aggregator(*shared.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, CANDIDATES):
                    part = batch.slice(at, CANDIDATES)
                    best.add(part.column(0).to_numpy(), _matrix(pa.concat_arrays([part.column(1)]), dims))
            for at in range(0, len(best.query), 1 << 16):
                rows = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.ids[best.query[rows]]), pa.array(best.candidate[rows]), pa.array(best.score[rows])],
                    names=["query_id", "vec_id", "score"]
                )

        found = _best(candidates.mapInArrow(of, "query_id long, vec_id long, score long"), k)
        if blocks == 1:
            return found
        folder = folder or shared_folder(spark, "top-k")
        found.write.mode("append").parquet(folder)
    if folder is None:
        return _best(candidates.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0), k)
    return spark.read.parquet(folder)


def search_report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20) -> DataFrame:
    """The best ``K`` of every row whose id is divisible by ``every``, against all rows."""
    vectors = quantised(df, key, vector)
    return top_k(vectors.filter(F.col("id") % every == 0), vectors)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
