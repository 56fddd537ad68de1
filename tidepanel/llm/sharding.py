"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Each stratum (source) is shuffled by a seeded digest of its rows and ranked; a row's
fraction is (rank + u) / (rows of the stratum), where u in [0, 1) is a seeded figure
of the stratum, so that small strata don't pile up at one place. All rows in order of
their fractions are cut into shards whose row counts differ by at most one: any run
of that order, and so every shard, holds each stratum in its share of the whole, to
within one row at either end.

Scale: no window holds a stratum. Both rankings (within the strata, and over all by
fraction) cut their range into about sqrt(rows) buckets: digests and fractions are
spread evenly, so a bucket holds about sqrt(rows) rows, is ranked by itself, and
starts at the sum of the buckets before it. Texts are read once, for their size and
checksum; what is shuffled is one narrow row for each different row, with a count, so
that a row that repeats a million times is one row until the ranks are dealt out.

Law: ``rows`` (shard sizes at most one apart). Equal texts aren't kept together; the
method knows no groups, and one text may fill more than a shard.

Cases: a null text counts as empty (size 1, checksum 0); null strata form one
stratum; null keys are keys; repeated rows each get a place of their own; rows of
equal digests go by key, size and checksum; more shards than rows leaves shards
empty; an empty table gives an empty result; ``shard_rows`` reads only the named
columns, ``write_shards`` writes those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SHARDS, SEED = 8, "7"
#: Hexadecimal digits of a digest that make a whole number below 2^52, exact as a double.
_DIGITS, _SPAN = 13, 1 << 52


def _digest(*parts: Column) -> Column:
    """0 up to 2^52, from the parts as text; a null part counts as empty."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")


def _bucket(share: Column, buckets: int) -> Column:
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("long")


def shard_rows(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", stratum: str = "source") -> DataFrame:
    """``doc_id, stratum, size, text_crc32, fraction, shard, slot`` of every row.

    ``stratum`` is a name that is never null: "=" and the source, or empty for none.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    identity = ["stratum", "doc_id", "size", "text_crc32"]
    different = cut(rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies")))
    total = different.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, math.isqrt(total))

    # Ranks within the strata.
    shuffled = different.withColumn("digest", _digest(F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    shuffled = shuffled.withColumn("bucket", _bucket(F.col("digest") / F.lit(float(_SPAN)), buckets))
    whole = Window.partitionBy("stratum")
    sums = shuffled.groupBy("stratum", "bucket").agg(F.sum("copies").alias("here")).select(
        "stratum",
        "bucket",
        (F.sum("here").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"),
        F.sum("here").over(whole).alias("of"),
    )
    own = Window.partitionBy("stratum", "bucket").orderBy("digest", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = shuffled.join(sums, ["stratum", "bucket"]).withColumn("rank", F.col("before") + F.sum("copies").over(own) - F.col("copies"))
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    shift = _digest(F.col("stratum")) / F.lit(float(_SPAN))
    placed = each.select(*identity, "digest", "copy", ((F.col("rank") + F.col("copy") + shift) / F.col("of")).alias("fraction"))

    # Ranks of the fractions over all strata.
    placed = placed.withColumn("bucket", _bucket(F.col("fraction"), buckets))
    along = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("here")).select("bucket", (F.sum("here").over(along) - F.col("here")).alias("before"))
    order = Window.partitionBy("bucket").orderBy("fraction", "stratum", "digest", "doc_id", "size", "text_crc32", "copy")
    at = placed.join(starts, "bucket").withColumn("at", F.col("before") + F.row_number().over(order) - 1)
    shard = F.floor(F.col("at") * shards / F.lit(max(1, total))) if total * shards >= 1 << 53 else F.expr(f"at * {shards} div {max(1, total)}")
    return at.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "stratum",
        "size",
        "text_crc32",
        "fraction",
        "shard",
        (F.col("at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", stratum: str = "source") -> None:
    """Writes ``doc_id, source, text`` with their slots to ``folder``, a Parquet folder ``shard=n`` each, files in order of slots.

    Rows of equal key, stratum, size and checksum count as equal; each of them gets
    one of the places of all of them.
    """
    places = shard_rows(df, shards, key, text, stratum)
    body = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        F.col(stratum).alias("source"),
        F.col(text).alias("text"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).dropDuplicates(["stratum", "doc_id", "size", "text_crc32"])
    same = ["stratum", "size", "text_crc32"]
    joined = places.join(texts.withColumnRenamed("doc_id", "id"), [*(places[c] == texts[c] for c in same), places["doc_id"].eqNullSafe(F.col("id"))])
    out = joined.select(places["doc_id"], "source", "text", "shard", "slot")
    out.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def shard_report(df: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document, and its ``fraction``."""
    return shard_rows(df).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "fraction",
    )


SQL = f"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits),
sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum, strlen(coalesce(text, '')) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table),
shuffled AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size), 1, {_DIGITS}))::BIGINT AS digest,
    ('0x' || substr(md5('{SEED}:' || stratum), 1, {_DIGITS}))::BIGINT / {float(_SPAN)}::DOUBLE AS shift
  FROM sized),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, size, text_crc32) - 1 + shift) / count(*) OVER (PARTITION BY stratum) AS fraction
  FROM shuffled),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, digest, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked),
dealt AS (SELECT *, place * {SHARDS} // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (place - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, fraction
FROM dealt
"""
