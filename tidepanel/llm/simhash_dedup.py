"""SimHash near-duplicates by a segment-popcount embedding.

1. Each text gets a 64-bit fingerprint: a bit is 1 if it is set in more than half
   of the XXH64 values of its word shingles.
2. A fingerprint's 22 segments (three bits each, the last one) map to their popcounts. The Manhattan
   distance of two such vectors never exceeds the Hamming distance of the
   fingerprints. The grid range-join puts every distinct fingerprint into the
   cells within Manhattan distance 1 of its vector: two vectors within distance 2
   meet in a cell, and vectors farther apart do not.
3. Fingerprints that share a cell make pairs, and each pair is verified: at most 2
   bits of ``a ^ b`` are set. A cell of more than ``CELL`` fingerprints is refined
   instead of paired: its fingerprints are embedded again with 64 segments of one
   bit. That vector is the fingerprint itself, so two share one of its cells if and
   only if they differ in at most 2 bits, at most 65 share one, and each is linked
   to the least. No group makes all its pairs, however large it is.
4. Links make components by alternating large-star and small-star steps, with
   checkpoints between the rounds.

The pipeline's stage (``keep_one``) takes five-word shingles and also links texts of
Jaccard similarity 0.8 or more. Their fingerprints differ in some 10 of 64 bits, a
distance at which the grid rules out next to nothing; so min-hash bands propose
those pairs, and each link is verified on the whole shingle sets.

Cases: a null text counts as an empty one; texts without words have fingerprint
zero and link like any other; equal fingerprints are always linked; repeated rows
keep their places; a null id keeps its row, and its component's id is the least
id that is not null, or null if there is none; an empty table gives an empty
result; only the named columns are read, so clashing names do no harm.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, free_names, text_batches

SHINGLE_WORDS = 3
#: Words of a shingle in the pipeline's stage.
STAGE_WORDS = 5
#: Bands of min-hashes that propose pairs to the stage: similarity 0.8 is missed with probability 3e-6.
BANDS, BAND_ROWS = 24, 4
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def digests(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 values of the word shingles of one text as rows of eight bytes, ``BLOCK`` shingles at once."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]])
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    for at in range(0, n, BLOCK):
        part = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist())])
        yield np.frombuffer(part, dtype=np.uint8).reshape(-1, 8)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Signed 64-bit SimHash of digests; zero if there are none."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for part in parts:
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of one text."""
    return majority(digests(text, shingle))


def fingerprint_udf(shingle: int):
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(x.as_py(), shingle) for x in batch], pa.int64())

    return F.arrow_udf(of, T.LongType())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp`` for every row of ``df``."""
    text_batches(df.sparkSession)
    return df.select(F.col(key).alias("id"), fingerprint_udf(shingle)(F.col(text)).alias("fp"))


#: Every third bit: the lowest of each of the 21 three-bit segments, and bit 63, a segment by itself.
_LOW_BITS = sum(1 << i for i in range(0, 63, 3)) - (1 << 63)


#: Fingerprints of one cell that are paired; a cell of more is refined.
CELL = 24
#: The exact test of a pair.
VERIFIED = "bit_count(u ^ v) <= 2"


def _popcounts(fp: str) -> Column:
    """The popcounts of the 22 segments, each in its own segment's bits."""
    return F.expr(" + ".join(f"(shiftrightunsigned({fp}, {i}) & {_LOW_BITS}L)" for i in range(3)))


def _grid_cells(own: str) -> Column:
    """The cells within Manhattan distance 1 of the vector, itself first; null where a count would leave its range."""
    count = f"(shiftrightunsigned({own}, 3 * i) & 7L)"
    up = f"transform(sequence(0, 21), i -> if({count} < if(i < 21, 3, 1), {own} + shiftleft(1L, 3 * i), null))"
    down = f"transform(sequence(0, 21), i -> if({count} > 0, {own} - shiftleft(1L, 3 * i), null))"
    return F.expr(f"concat(array({own}), {up}, {down})")


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """``u, v``: fingerprints (column ``fp``, distinct) with a chain of direct links between them wherever two differ in at most 2 bits."""
    cells = fps.select("fp", _popcounts("fp").alias("own")).select("fp", F.explode(_grid_cells("own")).alias("cell")).filter("cell IS NOT NULL")
    shared = cut(cells.groupBy("cell").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    several = cut(cells.join(shared.filter("n > 2").select("cell", "n"), "cell"))
    one, two = (several.filter(F.col("n") <= cell).select("cell", F.col("fp").alias(end)) for end in ("u", "v"))
    pairs = one.join(two, (one["cell"] == two["cell"]) & (F.col("u") < F.col("v")) & F.expr(VERIFIED)).select("u", "v")
    direct = shared.filter("n = 2").select("u", "v").filter(VERIFIED).union(pairs)
    crowded = several.filter(F.col("n") > cell).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    least = F.min("fp").over(Window.partitionBy("value"))
    refined = crowded.select("fp", F.explode(flips).alias("value")).select("fp", least.alias("least")).filter("fp <> least")
    return direct.union(refined.select(F.col("least").alias("u"), F.col("fp").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node in ``edges`` (``u, v``), the root being the component's least node.

    Large-star and small-star steps (Kiveris et al. 2014): each is one grouping
    and one join, and no neighbourhood is ever collected into a list.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v")

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("m").alias("u"), "v")
        return moved.union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()

    edges, before = cut(edges), None
    for _ in range(max_rounds):
        edges = cut(small(large(edges)))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()


def groups_of(prints: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint in ``prints`` (``id, fp``)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(links(distinct.select("fp")))
    found = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return cut(found.drop("first_id").join(named, "root").select("fp", "root", "component_id"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp, root, component_id`` for every row: ``root`` is the component's least fingerprint, ``component_id`` its least id."""
    prints = cut(fingerprints(df, key, text, shingle))
    return prints.join(groups_of(prints), "fp").select("id", "fp", "root", "component_id")


def normal_words(text: str) -> Column:
    """The lower-case words (ASCII, as in ``digests``) of a column, one blank between them."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t\n\x0B\f\r]+", " "))


def text_name(text: str) -> Column:
    """128 bits that stand for a text's word sequence: texts by the billion have no two alike by chance."""
    return F.unhex(F.md5(normal_words(text).cast("binary")))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of one text."""
    parts = [p.view(">u8").ravel() for p in digests(text, shingle)]
    return np.unique(np.concatenate(parts).astype(np.uint64)) if parts else np.zeros(0, dtype=np.uint64)


_rng = np.random.default_rng(10)
_ODD, _XOR = (_rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """One value for each band of ``BAND_ROWS`` min-hashes; two sets of similarity s share at least one with probability 1 - (1 - s^BAND_ROWS)^BANDS."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        np.minimum(least, ((hashes[at : at + (1 << 10), None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def sketches(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``id, node, fp, bands`` of every row; ``node`` names the text's word sequence."""
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), text_name(text).alias("node"), F.col(text).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, values = [], []
            for x in batch.column(2):
                parts = list(digests(x.as_py(), shingle))
                prints.append(majority(parts))
                flat = np.concatenate(parts).view(">u8").ravel().astype(np.uint64) if parts else np.zeros(0, dtype=np.uint64)
                values.append(bands(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(values, pa.list_(pa.int64()))],
                names=["id", "node", "fp", "bands"]
            )

    schema = T.StructType(
        [rows.schema["id"], rows.schema["node"], T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    return rows.mapInArrow(of, schema)


#: Longs of a set's parity sketch.
PARITY = 16


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * ``PARITY`` slots whether an odd number of the hashes falls into it; two sketches differ in no more slots than the sets in elements."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def set_udf(shingle: int):
    """``grams, parity`` of a text."""
    longs = pa.list_(pa.int64())

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([x.view(np.int64) for x in sets], longs), pa.array([parity(x) for x in sets], longs)], names=["grams", "parity"])

    return F.arrow_udf(of, "grams array<long>, parity array<long>")


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v, common``: how many shingles (``node, grams``) the texts of each pair share."""
    one = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"))


def lone_shingles(sets: DataFrame) -> DataFrame:
    """``node, n, lone`` of every set: its shingles, and those that no other set has."""
    owners = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    lone = owners.filter("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    return sets.select("node", F.size("grams").alias("n")).join(lone, "node", "left").select("node", "n", F.coalesce("lone", F.lit(0)).alias("lone"))


#: Similarity 0.8 or more: common / (n + n_v - common) >= 4 / 5.
SIMILAR = "9 * common >= 4 * (n + n_v)"
#: What two sets can have in common at most: within the leader, and among what neither has alone. Below it the pair isn't similar.
POSSIBLE = "9 * (least(held, held_v) + least(extra, extra_v)) >= 4 * (n + n_v)"
#: Similar sets differ in at most a ninth of their sizes' sum, and so do their parity sketches.
ALIKE = f"9 * ({' + '.join(f'bit_count(parity[{k}] ^ parity_v[{k}])' for k in range(PARITY))}) <= n + n_v"


def near_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], edges: DataFrame) -> DataFrame:
    """``edges`` and such further links that all similar texts which share a band are connected.

    ``nodes`` has ``node, bands``. The leader of a band's bucket is its text with the
    least share of shingles that no other text has, the one nearest to what its near
    copies were made of. Every text is measured exactly against its leaders; most are
    connected by that. What remains are texts apart from their leader. Such a text
    and another of its bucket share at most what both share with the leader and what
    both have besides, shingles of one text alone left out. Their parity sketches count
    from below in how many shingles the two differ, wherever the texts were edited; pairs
    that could be similar by both bounds, few even in a large group, are verified.
    """
    slots = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("last")).filter("least <> last").select("bucket")
    members = cut(slots.join(shared, "bucket", "left_semi"))
    sets = cut(sets_of(cut(members.select("node").distinct())))
    sizes = cut(lone_shingles(sets))
    sized = members.join(sizes, "node")
    leads = sized.groupBy("bucket").agg(
        F.min(F.struct((F.col("lone") / F.col("n")).alias("share"), F.col("node").alias("lead"), F.col("n").alias("n_v"))).alias("first")
    )
    led = cut(sized.join(leads.select("bucket", "first.lead", "first.n_v"), "bucket"))
    ends = led.filter("node <> lead").groupBy(
        F.col("node").alias("u"),
        F.col("lead").alias("v")
    ).agg(F.min("n").alias("n"), F.min("n_v").alias("n_v"))
    measured = cut(common(ends.select("u", "v"), sets).join(ends, ["u", "v"]))
    edges = cut(edges.union(measured.filter(SIMILAR).select("u", "v")))
    roots = components(edges)
    main = roots.select(F.col("node").alias("lead"), F.col("root").alias("main"))
    own = measured.select(F.col("u").alias("node"), F.col("v").alias("lead"), "common")
    placed = led.join(own, ["node", "lead"], "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(main, "lead", "left")
    placed = placed.select(
        "bucket",
        "node",
        "root",
        F.coalesce("main", "lead").alias("main"),
        "n",
        F.coalesce("common", F.col("n") - F.col("lone")).alias("held"),
        "lone"
    )
    placed = cut(placed.select("bucket", "node", "root", "main", "n", "held", (F.col("n") - F.col("lone") - F.col("held")).alias("extra")))
    strays = placed.filter("root <> main AND 5 * (held + extra) >= 4 * n").drop("main")
    parities = sets.select("node", "parity")
    others = placed.drop("main").join(strays.select("bucket").distinct(), "bucket", "left_semi").join(parities, "node")
    others = others.select(*[F.col(c).alias(f"{c}_v") for c in others.columns])
    rest = strays.join(parities, "node").join(others, F.expr(f"bucket = bucket_v AND root <> root_v AND {POSSIBLE} AND {ALIKE}"))
    rest = cut(rest.select(F.least("node", "node_v").alias("u"), F.greatest("node", "node_v").alias("v")).distinct())
    counted = common(rest, sets).join(sizes.select(F.col("node").alias("u"), "n"), "u").join(
        sizes.select(F.col("node").alias("v"), F.col("n").alias("n_v")),
        "v"
    )
    return edges.union(counted.filter(SIMILAR).select("u", "v"))


#: Rows of three numbers at most that are broadcast to the texts.
FEW = 200_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (written already), marked for a broadcast if they are at most ``FEW``."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = STAGE_WORDS) -> DataFrame:
    """Of each group of near copies the one row of ``df`` with the least id, all columns kept.

    Texts are linked if their fingerprints differ in at most 2 bits or their
    shingle sets have Jaccard similarity 0.8 or more. Only rows that repeat a
    group's least id are grouped; there is no such pass over a table whose ids are
    unique. Texts meet only what is known of groups of two rows or more, which is
    broadcast while it has at most ``FEW`` rows and joined by a shuffle beyond that.
    """
    sketch = cut(sketches(df, key, text, shingle))
    nodes = cut(
        sketch.groupBy("node").agg(
            F.min("id").alias("first_id"),
            F.count(F.lit(1)).alias("rows"),
            F.first("fp").alias("fp"),
            F.first("bands").alias("bands")
        )
    )
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    near = links(heads.select("fp"))
    for end in ("u", "v"):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}")), end)
    near = near.select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))
    named = text_name(text)
    texts = df.select(named.alias("node"), F.col(text).alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return texts.join(few(wanted), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).select(
            "node",
            set_udf(shingle)("text").alias("of")
        ).select("node", "of.grams", "of.parity")

    roots = components(near_links(nodes.select("node", "bands"), sets_of, cut(same.union(near))))
    node, root, component = free_names(df, "node", "root", "component")
    placed = nodes.join(roots, "node", "left").select("node", "rows", "first_id", F.coalesce("root", "node").alias("root"))
    groups = placed.groupBy("root").agg(F.min("first_id").alias("component"), F.sum("rows").alias("rows")).filter("rows > 1")
    groups = cut(
        placed.select("node", "root").join(groups, "root").select(
            F.col("node").alias(node),
            F.col("root").alias(root),
            F.col("component").alias(component)
        )
    )
    first = F.col("id").eqNullSafe(F.col(component))
    tied = cut(
        sketch.select("id", F.col("node").alias(node)).join(few(groups), node).filter(first).groupBy(root).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(root)
    )
    rows = df.withColumn(node, named).join(few(groups), node, "left").filter(F.col(root).isNull() | F.col(key).eqNullSafe(F.col(component)))
    if not tied.isEmpty():
        rows = rows.join(tied, root, "left_anti").unionByName(rows.join(tied, root, "left_semi").dropDuplicates([root]))
    return rows.select(*[rows[c] for c in df.columns])


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = near_duplicates(df, key, text)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
