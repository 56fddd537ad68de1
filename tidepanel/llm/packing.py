"""Best-fit decreasing packing of token pieces into sequences.

A segment tree over the remaining capacities tells the tightest open sequence
that still takes a piece, in a number of steps logarithmic in the capacity. Pieces
of one length are interchangeable, and so are sequences of one remaining capacity:
best fit treats the pieces of a length, falling, as runs over ranges of equal
sequences, and the runs say where the n-th piece of each length goes. So one
packing holds for all documents together, however many they are.

Scale: documents become narrow rows of (id, piece, length, checksum), written to the
shared folder and never shuffled with their texts. Only the number of pieces of
each length, at most ``capacity`` figures, goes to the driver; the runs come back to
the tasks. A range is split by a length at most, so the runs number a few thousand
whatever the corpus. A piece's number within its length is its number within its
partition and length, plus what the partitions before it hold; no length gathers
its rows in one task.

Cases: a null or empty text is one end id; a text longer than the capacity is
cut into whole pieces and one rest; repeated rows are documents of their own;
rows with a null id are packed like any other; the order of equal lengths is that
of the partitions, then of id and piece; an empty table gives an empty result;
only the named columns are read.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_batches
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0


class TightestFit:
    """Ranges of open bins (first, number) by remaining capacity, found by a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, left: int, first: int, number: int) -> None:
        if not left or not number:
            return
        self.bins[left].append((first, number))
        at = left + self.size
        while at:
            self.open[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """A range of bins with the least remaining capacity of at least ``need``, taken out: first, number, capacity."""
        at, open_ = need + self.size, self.open
        if not open_[at]:
            while at > 1 and (at & 1 or not open_[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if open_[2 * at] else 2 * at + 1
        left = at - self.size
        first, number = self.bins[left].pop()
        while at:
            open_[at] -= 1
            at >>= 1
        return first, number, left


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Packs ``counts[length]`` pieces of each length; gives the runs and the number of bins.

    A run (length, rank, each, bin, offset) says: the pieces of ``length`` from number
    ``rank`` on go to the bins from ``bin`` on, ``each`` to a bin, from ``offset`` there.
    """
    tree, runs, n = TightestFit(capacity), [], 0
    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            found = tree.take(length)
            if found is None:
                found = n, -(-todo // (capacity // length)), capacity
                n += found[1]
            first, number, left = found
            each = left // length
            full, rest = divmod(min(todo, number * each), each)
            runs.append((length, rank, each, first, capacity - left))
            tree.add(left - each * length, first, full)
            tree.add(left - rest * length, first + full, int(rest > 0))
            used = full + (rest > 0)
            tree.add(left, first + used, number - used)
            rank, todo = rank + full * each + rest, todo - full * each - rest
    return np.array(runs, dtype=np.int64).reshape(-1, 5), n


def places(runs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces with these lengths and numbers within their lengths."""
    keys = runs[:, 1] - (runs[:, 0] << 40)
    run = runs[np.searchsorted(keys, ranks - (lengths << 40), "right") - 1]
    bins, nth = np.divmod(ranks - run[:, 1], run[:, 2])
    return run[:, 3] + bins, run[:, 4] + nth * lengths


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids with ``end_id`` behind them."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    text_batches(df.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            rows = []
            for doc, one in enumerate(batch.column(1)):
                ids = np.append(encode(one.as_py()), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            at = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[0])), pa.array(at[1].astype(np.int32)), *map(pa.array, at[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(of, _PIECE)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows``, as :func:`pieces` gives them, with ``sequence_id`` and ``offset``."""
    held = cut(rows.withColumn("part", F.spark_partition_id()))
    counts = cut(held.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = held.sparkSession.sparkContext.broadcast(best_fit_decreasing(totals, capacity)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = held.withColumn("rank", nth - 1).join(firsts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first"))
    named = [x.split()[0] for x in _PIECE.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = places(shared.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in named), pa.array(bins), pa.array(offsets)],
                names=[*named, "sequence_id", "offset"]
            )

    return ranked.select(*named, "rank").mapInArrow(of, f"{_PIECE}, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(df, key, text, tokenizer, capacity), capacity)
