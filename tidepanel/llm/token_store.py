"""Binary token store: raw id payloads with a minimal perfect hash index.

Each shard holds the documents of one range of ids, in ascending order, as two
files in a folder that driver and executors share:

* ``shard-NNNNN.bin``: the ids one after another, unsigned little-endian, 16 bits
  wide if the vocabulary fits, else 32.
* ``shard-NNNNN.mph``: a header, the bit arrays of a minimal perfect hash (levels
  of collision-free positions, Limasset et al. 2017) over the document keys, and
  for every slot a 32-bit key fingerprint, the payload offset and the length.

A key costs a constant number of probes; a key that was never stored is refused by
its fingerprint (but for one in 2^32).

Scale: the texts are shuffled once, by ranges of the id, then of the text's first
characters, then of a salt, so that many rows of one id are dealt to many shards. A
shard holds about ``SHARD_BYTES`` of text, and there are at most ``MOST_SHARDS``, so
the manifest, a row a shard, is small whatever the corpus. A task streams its
documents to the payload and keeps 24 bytes of index a document. Files are written
under a task's own name and renamed, so a task that runs again or twice leaves whole
files.

Cases: a null text counts as empty and has the end id alone; a row with a null id
comes before all others; repeated ids are stored one by one, in order of their
texts' first characters, under the keys (id, 0), (id, 1), ... of each shard they
reach; an empty table gives no shards; only the named columns are read.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_folder, text_batches
from .tokens import encoder, tokenizer_path

#: Bytes of text a shard, about, and the most shards; beyond that shards grow.
SHARD_BYTES, MOST_SHARDS = 40 << 20, 50_000
#: Rows looked up at once.
CHUNK = 1 << 16
END_ID = 0
MAGIC = b"TPMPH01\n"
_GAMMA = 2.0
#: Bits of a level that share a whole rank; inside, 16 bits count on.
_RANKED = 512
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of SplitMix64, seeded."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & ((1 << 64) - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def key_hash(ids: np.ndarray, valid: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64 bits of (id, nth); equal inputs alone give equal bits while nth is 0."""
    own = np.where(valid, ids, 0).astype(np.int64).view(_U)
    return _mix(own, 1) ^ _mix(nth.astype(_U) + (~valid).astype(_U) * _U(1 << 40), 2)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1 without gaps."""

    def __init__(self, levels: list[np.ndarray], seed: int):
        self.levels, self.seed, self.ranks, at = levels, seed, [], 0
        for bits in levels:
            whole = np.cumsum(bits, dtype=np.int64) - bits
            blocks = whole[::_RANKED]
            self.ranks.append((blocks + at, (whole - np.repeat(blocks, _RANKED)[: len(bits)]).astype(np.uint16)))
            at += int(bits.sum())
        self.n = at

    @classmethod
    def build(cls, keys: np.ndarray, seed: int = 0) -> "PerfectHash":
        levels, rest = [], keys
        while len(rest):
            if len(levels) > 60:
                raise ValueError("keys repeat")
            size = max(64, int(_GAMMA * len(rest)))
            at = (_mix(rest, 16 + seed * 64 + len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            rest = rest[~alone[at]]
        return cls(levels, seed)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level knows it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], 16 + self.seed * 64 + k) % _U(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            blocks, inside = self.ranks[k]
            out[open_[hit]] = blocks[at[hit] // _RANKED] + inside[at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        sizes = [len(b) for b in self.levels]
        return struct.pack(f"<II{len(sizes)}Q", self.seed, len(sizes), *sizes) + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple["PerfectHash", int]:
        seed, n = struct.unpack_from("<II", data, at)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, at + 8), at + 8 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-size // 8), offset=at))[:size])
            at += -(-size // 8)
        return cls(levels, seed), at


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class ShardWriter:
    def __init__(self, folder: str, shard: int, width: int):
        self.fs, self.root = _files(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.width, self.tag = shard, width, uuid.uuid4().hex
        self.payload = self.fs.open_output_stream(f"{self.root}/.{shard:05d}-{self.tag}.bin")
        self.ids: list[int] = []
        self.valid: list[bool] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.payload.write(ids.astype(f"<u{self.width}").tobytes())
        self.ids.append(key or 0)
        self.valid.append(key is not None)
        self.sizes.append(len(ids))

    def close(self) -> int:
        self.payload.close()
        ids, valid, sizes = np.array(self.ids, dtype=np.int64), np.array(self.valid), np.array(self.sizes, dtype=np.int64)
        nth = _nth(ids, valid)
        keys = key_hash(ids, valid, nth)
        mph = PerfectHash.build(keys)
        slot, start = mph.slot(keys), np.cumsum(sizes) - sizes
        prints, starts, lengths = np.zeros(len(ids), "<u4"), np.zeros(len(ids), "<u8"), np.zeros(len(ids), "<u8")
        prints[slot], starts[slot], lengths[slot] = (_mix(keys, 3) >> _U(32)).astype("<u4"), start, sizes
        index = MAGIC + struct.pack("<II", self.width, len(ids)) + mph.dump() + prints.tobytes() + starts.tobytes() + lengths.tobytes()
        temporary = f"{self.root}/.{self.shard:05d}-{self.tag}"
        with self.fs.open_output_stream(temporary + ".mph") as out:
            out.write(index)
        for kind in ("bin", "mph"):
            self.fs.move(f"{temporary}.{kind}", f"{self.root}/shard-{self.shard:05d}.{kind}")
        return int(sizes.sum())


def _nth(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each; equal keys stand together."""
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(first, at, 0))


class ShardReader:
    """Keyed access to one shard, from its files alone."""

    def __init__(self, folder: str, shard: int):
        fs, root = _files(folder)
        with fs.open_input_stream(f"{root}/shard-{shard:05d}.mph") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"shard {shard} isn't a token index")
        self.width, self.n = struct.unpack_from("<II", data, 8)
        self.mph, at = PerfectHash.load(data, 16)
        self.prints = np.frombuffer(data, "<u4", self.n, at)
        self.starts = np.frombuffer(data, "<u8", self.n, at + 4 * self.n).astype(np.int64)
        self.lengths = np.frombuffer(data, "<u8", self.n, at + 12 * self.n).astype(np.int64)
        self.payload = fs.open_input_file(f"{root}/shard-{shard:05d}.bin")

    def find(self, ids: np.ndarray, valid: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start (in ids, in the shard) and length of every key; -1 where it isn't stored."""
        keys = key_hash(ids, valid, nth)
        slot = self.mph.slot(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (_mix(keys[known], 3) >> _U(32)).astype("<u4")
        return np.where(known, self.starts[slot], -1), np.where(known, self.lengths[slot], -1)

    def ids(self, start: int, length: int) -> np.ndarray:
        self.payload.seek(start * self.width)
        return np.frombuffer(self.payload.read(length * self.width), f"<u{self.width}").astype("<u4")


_MANIFEST = ("shard int", "min_id long", "max_id long", "nulls long", "at_min long", "at_max long", "documents long", "tokens long")


def write_store(
    df: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Writes the shards to ``folder``; gives the manifest, a row a shard.

    Least and largest id, how many rows have none, how many have the least and the
    largest, documents, tokens, and ``first``, the ids before the shard.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // shard_bytes)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, writer = encoder(path), None
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or ShardWriter(folder, TaskContext.get().partitionId(), 2 if max(one.vocabulary, end_id + 1) <= 1 << 16 else 4)
                writer.add(doc, np.append(one.ids(body.as_py()), np.uint32(end_id)))
        if writer:
            tokens, known = writer.close(), np.array(writer.ids, dtype=np.int64)[np.array(writer.valid)]
            ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
            row = [
                writer.shard,
                *ends,
                len(writer.ids) - len(known),
                *(int((known == x).sum()) if len(known) else 0 for x in ends),
                len(writer.ids),
                tokens
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int32() if k == 0 else pa.int64()) for k, x in enumerate(row)],
                names=[x.split()[0] for x in _MANIFEST]
            )

    by_id = F.col("id").asc_nulls_first()
    salted = rows.withColumn("start", F.substring("text", 1, 32)).withColumn("salt", F.rand(5))
    # Whole texts are no sort keys: their first characters and a hash are.
    dealt = salted.repartitionByRange(shards, by_id, "start", "salt").sortWithinPartitions(by_id, "start", F.xxhash64("text")).select("id", "text")
    manifest = cut(dealt.mapInArrow(of, ", ".join(_MANIFEST)))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return cut(manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))))


class Places:
    """Where the rows of an id are: runs of (shard, number of the first row there, rows)."""

    def __init__(self, manifest: list):
        rows = sorted(manifest, key=lambda m: m["shard"])
        self.shards, self.firsts = [m["shard"] for m in rows], [m["first"] for m in rows]
        self.nulls = [(k, m["nulls"]) for k, m in enumerate(rows) if m["nulls"]]
        self.known = [(k, m) for k, m in enumerate(rows) if m["min_id"] is not None]
        self.low, self.high = (np.array([m[c] for _, m in self.known], dtype=np.int64) for c in ("min_id", "max_id"))

    def _held(self, place: int, id_: int) -> int:
        """Rows of an id in a shard at whose edge, or throughout which, it stands."""
        m = self.known[place][1]
        return m["documents"] - m["nulls"] if m["min_id"] == m["max_id"] == id_ else m["at_max"] if m["max_id"] == id_ else m["at_min"]

    def runs(self, ids: np.ndarray, valid: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows of (position in ``ids``, shard's place, first number, rows), the position's rows in order."""
        if not self.shards:
            return np.stack([np.arange(len(ids)), np.full(len(ids), -1), np.zeros(len(ids), np.int64), rows], axis=1)
        last = len(self.known) - 1
        low, high = np.searchsorted(self.high, ids, "left"), np.searchsorted(self.low, ids, "right") - 1
        plain = valid & (high <= low) if last >= 0 else np.zeros(len(ids), dtype=bool)
        place = np.array([k for k, _ in self.known] or [0])[np.clip(low, 0, max(last, 0))]
        at = np.flatnonzero(plain)
        out = [np.stack([at, place[at], np.zeros(len(at), np.int64), rows[at]], axis=1)]
        for i in np.flatnonzero(~plain).tolist():
            held = [(self.known[k][0], self._held(k, int(ids[i]))) for k in range(int(low[i]), int(high[i]) + 1)] if valid[i] else self.nulls
            todo, shard = int(rows[i]), -1
            for shard, n in held:
                out.append(np.array([[i, shard, 0, min(n, todo)]]))
                todo -= min(n, todo)
            if todo:
                out.append(np.array([[i, shard, held[-1][1] if held else 0, todo]]))
        return np.concatenate(out)


def read_store(keys: DataFrame, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of ``keys``, by keyed access to the files.

    The manifest, at most ``MOST_SHARDS`` rows, goes to the tasks. A key that isn't
    stored has nulls.
    """
    places = Places(manifest.collect())
    wanted = keys.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, valid = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            runs = places.runs(ids, valid, batch.column("rows").to_numpy())
            ends = np.cumsum(runs[:, 3])
            for at in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                row = np.arange(at, min(at + CHUNK, int(ends[-1])))
                own = np.searchsorted(ends, row, "right")
                run = runs[own]
                nth = run[:, 2] + row - (ends[own] - run[:, 3])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(run[:, 0])), pa.array(run[:, 1].astype(np.int32)), pa.array(nth)],
                    names=["doc_id", "at", "nth"]
                )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[int, ShardReader] = {}
        for batch in batches:
            ids, valid = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            shard, nth = batch.column("at").to_numpy(), batch.column("nth").to_numpy()
            start, length, crc = np.full(len(ids), -1), np.full(len(ids), -1), np.zeros(len(ids), np.int64)
            for s in np.unique(shard[shard >= 0]).tolist():
                if s not in readers:
                    readers.clear()
                    readers[s] = ShardReader(folder, places.shards[s])
                own = np.flatnonzero(shard == s)
                start[own], length[own] = readers[s].find(ids[own], valid[own], nth[own])
                for k in own[np.argsort(start[own], kind="stable")].tolist():
                    if length[k] >= 0:
                        crc[k] = zlib.crc32(readers[s].ids(int(start[k]), int(length[k])).tobytes())
                start[own] += np.where(length[own] >= 0, places.firsts[s], 0)
            none = length < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64(), mask=none) for x in (start, length, crc))],
                names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    located = wanted.mapInArrow(locate, "doc_id long, at int, nth long")
    dealt = located.repartition(max(1, len(places.shards)), "at").sortWithinPartitions("at", "doc_id", "nth")
    return dealt.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_report(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes ``df`` to a new store in the shared folder and reads every document back."""
    folder = shared_folder(df.sparkSession, "token-store")
    manifest = write_store(df, folder, key, text, tokenizer)
    return read_store(df, folder, manifest, key)
