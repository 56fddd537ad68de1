"""Line dedup by site-relative frequency, in DataFrame functions alone.

A line is boilerplate on a host if the share of the host's pages that hold it
exceeds ``ratio`` and at least ``min_pages`` of them do. Such lines are dropped
from the host's pages.

Cases: a null text stays null and has no lines; an empty line is never
boilerplate and stays; a line that repeats inside one page counts once for that
page; every row counts as one page, repeated rows too; null hosts form one host;
an empty table gives an empty result; extra columns pass through ``drop_lines``
untouched, whatever their names, but for the text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names

#: Shares and counts from which a line is boilerplate.
RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines up to this many (about 16 bytes each) are broadcast; more go through a shuffled join.
BROADCAST_LINES = 100_000


def _key(line: Column) -> Column:
    """128 bits in place of the line, so that no text is shuffled for counting."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate_lines(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, key`` of the boilerplate lines, ``key`` as made by :func:`_key`.

    Lines that fewer than ``min_pages`` pages hold go before the totals are
    joined, so that the join sees few rows whatever the corpus size.
    """
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter("line <> ''")
    counts = lines.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    joined = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return joined.filter(F.col("n") * F.lit(1.0) / F.col("pages") > ratio).select("c.host", "key")


def drop_lines(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """``df`` with the boilerplate lines taken out of ``text``.

    Lines are joined to the boilerplate one by one, whatever a page's and a host's number
    of them, and the pages that lose some are put together again. The boilerplate is
    broadcast while it has at most ``broadcast_lines`` lines; beyond that the join is
    shuffled, where adaptive execution splits a hot line.
    """
    row, kept, lost = free_names(df, "row", "kept", "lost")
    flagged = cut(boilerplate_lines(df, text, host, ratio, min_pages)).select(F.col("host").alias("of"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.lit(True).alias("bad"))
    if flagged.count() <= broadcast_lines:
        flagged = F.broadcast(flagged)
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    others = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(df.columns) if c.lower() != text.lower()])
    lines = numbered.select(F.col(row).alias("row"), F.col(host).alias("host"), others.alias("others"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("at", "line"))
    key = _key(F.col("line"))
    lines = lines.select("row", "host", "at", "line", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("others")).alias("others"), key["a"].alias("a"), key["b"].alias("b"))
    same = F.col("host").eqNullSafe(F.col("of")) & (lines["a"] == flagged["a"]) & (lines["b"] == flagged["b"]) & (F.col("line") != "")
    judged = lines.join(flagged, same, "left")
    whole = judged.groupBy("row").agg(
        F.first("others", ignorenulls=True).alias("others"),
        F.sort_array(F.collect_list(F.when(F.col("bad").isNull() & F.col("line").isNotNull(), F.struct("at", "line")))).alias(kept),
        (F.count("at") > 0).alias(lost)
    )
    back = F.when(F.col(lost), F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    places = iter(range(len(df.columns)))
    return whole.select(*[back.alias(c) if c.lower() == text.lower() else F.col(f"others.c{k}").alias(c) for k, c in zip(places, df.columns)])


def line_report(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every page."""
    count = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda x: x != "")), F.lit(0)).cast("long")
    pages = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source")).withColumn("n_lines", count(F.col("text")))
    out = drop_lines(pages)
    return out.select("doc_id", "text", "n_lines", (F.col("n_lines") - count(F.col("text"))).alias("n_dropped"))


SQL = f"""
WITH hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
bad AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.line <> '' GROUP BY l.source, l.line, h.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) * 1.0::DOUBLE / h.pages > {RATIO}::DOUBLE),
per_host AS (SELECT source, list(line) AS bad_lines FROM bad GROUP BY source),
kept AS (
  SELECT d.doc_id, d.text AS was,
    CASE WHEN b.bad_lines IS NULL THEN d.text
      ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: x = '' OR NOT list_contains(b.bad_lines, x)), chr(10)) END AS text
  FROM documents d LEFT JOIN per_host b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, text,
  coalesce(len(list_filter(string_split(was, chr(10)), lambda x: x <> '')), 0)::BIGINT AS n_lines,
  (coalesce(len(list_filter(string_split(was, chr(10)), lambda x: x <> '')), 0)
   - coalesce(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')), 0))::BIGINT AS n_dropped
FROM kept
"""
