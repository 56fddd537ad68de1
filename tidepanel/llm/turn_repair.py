"""Conversation structure repair by weighted interval parsing.

A conversation is right if its role initials match ``(s?(ua)+)?``. Each row can be
kept, given another role, deleted or preceded by inserted turns, at the costs below;
the cheapest repair is found by CYK parsing over spans of rows.

Grammar, in Chomsky normal form: the symbol ``p>q`` derives a span that leads the
pattern from state p to state q (0 nothing yet, 1 after s, 2 after u, 3 after a).

    p>q -> p>r r>q                for every r
    p>q -> one row, edited, and any turns inserted behind it
    S   -> inserted turns, then 0>0 or 0>3

A chart cell of a span holds for each symbol the least (cost, audit); the audit
spells the edits (K keep, R rerole, D delete, I insert), equal costs going to the
ASCII-least. Two audits of one span and cost are never a beginning of one another,
as the longer would hold more insertions and cost more; so least parts make least
wholes. As the binary rules let every state stand between, each way to split a span
gives the same cell: it is enough to combine halves, bottom-up by span lengths 1, 2,
4, ... The tests hold this against a chart over all splits.

Scale: flags and sort keys are made where the rows lie. The rows, without their
texts, are dealt by ranges of (conversation, turn, ...), so a conversation of any
length is spread over tasks; each task parses its spans, and a conversation's spans,
at most one a task, are combined in order. Only the digest of a repaired
conversation needs its texts one after another: they are streamed in order by one
task for each conversation, in constant memory beside the audit.

Cases: null conversation ids are one conversation; a null turn comes first; turns of
equal number go by role and text; a null role or text counts as one space; a role of
another initial fits nowhere and is reroled or deleted; a conversation without rows
has cost 0 and an empty audit; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NONE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
_STATES = 4
#: Where a role's initial leads.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
#: White space of a blank row.
_WHITE = " \t\n\x0b\x0c\r"

Cell = tuple  # of _STATES * _STATES entries: None or (cost, audit)


def _least(x, y):
    return y if x is None or y is not None and y < x else x


def combine(x: Cell, y: Cell) -> Cell:
    """The cell of two spans that follow one another."""
    out = [None] * (_STATES * _STATES)
    for p in range(_STATES):
        for r in range(_STATES):
            if (a := x[p * _STATES + r]) is not None:
                for q in range(_STATES):
                    if (b := y[r * _STATES + q]) is not None:
                        at = p * _STATES + q
                        out[at] = _least(out[at], (a[0] + b[0], a[1] + b[1]))
    return tuple(out)


def _insertions() -> Cell:
    """Closure of inserting a user's or an assistant's turn, over no row."""
    none = tuple((0, "") if p == q else None for p in range(_STATES) for q in range(_STATES))
    once = list(none)
    for (p, role), q in _NEXT.items():
        if role in _ROLES:
            once[p * _STATES + q] = _least(once[p * _STATES + q], (INSERT, "I"))
    out = none
    for _ in range(_STATES):
        out = combine(out, tuple(once))
    return out


INSERTIONS = _insertions()


@functools.lru_cache(maxsize=64)
def row_cell(symbol: str) -> Cell:
    """One row: "d" must go; else its initial (s, u, a, or o for another), upper case if truncated."""
    out = [None] * (_STATES * _STATES)
    for p in range(_STATES):
        out[p * _STATES + p] = (DELETE, "D")
        if symbol == "d":
            continue
        more = TRUNCATED if symbol.isupper() else 0
        for edit, cost, roles in (("K", 0, symbol.lower()), ("R", REROLE, "ua")):
            for role in roles:
                if (q := _NEXT.get((p, role))) is not None:
                    out[p * _STATES + q] = _least(out[p * _STATES + q], (cost + more, edit))
    return combine(tuple(out), INSERTIONS)


@functools.lru_cache(maxsize=1 << 14)
def _short(symbols: str) -> Cell:
    return span_cell(symbols)


def span_cell(symbols: str) -> Cell:
    """A span's cell: halves whose lengths are powers of two, as far as possible."""
    if len(symbols) == 1:
        return row_cell(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    of = _short if half <= 8 else span_cell
    return combine(of(symbols[:half]), of(symbols[half:]))


def best(cells: list[Cell]) -> tuple[int, str]:
    """Cost and audit of a conversation, from the cells of its spans in order; neighbours are combined level by level."""
    while len(cells) > 1:
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    whole = combine(INSERTIONS, cells[0]) if cells else INSERTIONS
    return min(whole[q] for q in _ENDS if whole[q] is not None)


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text)s; ``rows`` gives one row for each letter but I."""
    state, at, n = 0, 0, len(audit) - audit.count("D")
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _NEXT[state, role[:1]]
        else:
            role = _ROLES["a" if state == 2 else "u"]
            state = _NEXT[state, role[0]]
        at += 1
        yield role, text
    if at != n or state not in _ENDS:
        raise ValueError("the audit doesn't fit its rows")


#: Order of a conversation's rows, made of their columns alone; rows that still tie are equal.
_ORDER = ("turn", "by_role", "by_text", "by_hash")


def _turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return rows.withColumns({"by_role": F.substring("role", 1, 32), "by_text": F.substring("text", 1, 64), "by_hash": F.xxhash64("role", "text")})


def flags(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` without role and text: sort keys, ``initial`` and ``fault``, and a number ``uid``."""
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    narrow = cut(
        turns.select(
            "conv_id",
            *_ORDER,
            F.xxhash64(F.lit(1), "role", "text").alias("by_more"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
            F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT_OFF).alias("own"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    place = F.struct(*_ORDER, "uid")
    firsts = narrow.groupBy("conv_id", "by_hash", "by_more").agg(F.min(place).alias("first"))
    n, f = narrow.alias("n"), firsts.alias("f")
    same = F.col("n.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("n.by_hash") == F.col("f.by_hash")) & (F.col("n.by_more") == F.col("f.by_more"))
    seen = F.col("f.first.uid") != F.col("n.uid")
    fault = F.when(F.col("own") == BLANK, BLANK).when(seen, DUPLICATE).otherwise(F.col("own"))
    return n.join(f, same).select(*(F.col(f"n.{c}") for c in ("conv_id", *_ORDER, "initial", "uid")), fault.alias("fault"))


_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal")
_ENDS_OF = ("first_initial", "last_initial", "min_turn", "max_turn", "turns")
_SPAN = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int32()), *((c, pa.int64()) for c in _COUNTS), *((c, pa.string()) for c in _ENDS_OF[:2]), *((c, pa.int64()) for c in _ENDS_OF[2:])]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_SPAN_DDL = "conv_id long, seq int, n_rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, min_turn long, max_turn long, turns long, costs array<long>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


class _Run:
    """Rows of one conversation that follow one another in a task."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.initials = conv, [], []
        self.faults = [0, 0, 0, 0]
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        self.initials.append(initial)
        self.symbols.append("d" if fault in (BLANK, DUPLICATE) else initial.upper() if fault == CUT_OFF else initial)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def row(self, seq: int) -> tuple:
        cell = span_cell("".join(self.symbols))
        illegal = sum(a + b not in _LEGAL for a, b in zip(self.initials, self.initials[1:]))
        ends = (self.initials[0], self.initials[-1], self.low, self.high, self.turns)
        return (self.conv, seq, len(self.symbols), *self.faults[1:], illegal, *ends, [-1 if x is None else x[0] for x in cell], [None if x is None else x[1] for x in cell])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def spans(flagged: DataFrame) -> DataFrame:
    """A row for each conversation and task: counts, ends and chart cell of the rows that the task has of it, in order of ``seq``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, done, seq = None, [], TaskContext.get().partitionId()
        for batch in batches:
            for conv, turn, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if run is None or run.conv != conv:
                    if run:
                        done.append(run.row(seq))
                    run = _Run(conv)
                run.add(turn, initial, fault)
            if done:
                yield _batch(done, _SPAN)
                done.clear()
        if run:
            yield _batch([run.row(seq)], _SPAN)

    keys = ("conv_id", *_ORDER, "uid")
    return flagged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "initial", "fault").mapInArrow(of, _SPAN_DDL)


_PLAN = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in (*_COUNTS, "cost")), ("audit", pa.string())])
_PLAN_DDL = "conv_id long, gaps long, n_rows long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plan(parts: list[dict]) -> tuple:
    """One conversation, from its spans in order."""
    counts = [sum(p[c] for p in parts) for c in _COUNTS]
    counts[-1] += sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["min_turn"] is not None]
    distinct = sum(p["turns"] for p in known) - sum(a["max_turn"] == b["min_turn"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["max_turn"] - known[0]["min_turn"] + 1 - distinct if known else 0
    cells = [tuple(None if c < 0 else (c, a) for c, a in zip(p["costs"], p["audits"])) for p in parts]
    return (parts[0]["conv_id"], gaps, *counts, *best(cells))


def plans(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``, counts of rows and faults, ``cost`` and ``audit`` of every conversation that has rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, done = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if parts and parts[0]["conv_id"] != row["conv_id"]:
                    done.append(_plan(parts))
                    parts = []
                parts.append(row)
            if done:
                yield _batch(done, _PLAN)
                done.clear()
        if parts:
            yield _batch([_plan(parts)], _PLAN)

    return spans(flags(turns)).repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(of, _PLAN_DDL)


def _in_order(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order; conversations one after another."""
    head = planned.select("conv_id", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in (*zip(_ORDER, ("long", "string", "string", "long")), ("role", "string"), ("text", "string"))))
    body = turns.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), *_ORDER, "role", "text")
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).select("conv_id", "kind", "audit", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Of every conversation the id and its repaired turns, which must be used up before the next."""
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(5))))
    for conv, kind, audit, _, _ in rows:
        if kind:
            raise ValueError("a row without its plan")
        own = ((role, text) for _, _, _, role, text in rows)
        yield conv, replay(audit, own)


def repaired_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, position, role, text`` of all repaired conversations; a conversation of which nothing is left has no row."""
    text_batches(df.sparkSession)
    turns = _turns(df, conversation, turn, role, text)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, out in _conversations(batches):
            for k, said in enumerate(out):
                done.append((conv, k, *said))
                if len(done) == 1000:
                    yield _batch(done, schema)
                    done.clear()
        if done:
            yield _batch(done, schema)

    return _in_order(turns, plans(turns)).mapInArrow(of, "conv_id long, position long, role string, text string")


_EMPTY = hashlib.sha256(b"").hexdigest()


def repair_digests(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The plans of :func:`plans` with ``repaired_sha256``, of the repaired ``role:text`` lines."""
    text_batches(df.sparkSession)
    turns = _turns(df, conversation, turn, role, text)
    planned = cut(plans(turns))
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, out in _conversations(batches):
            digest, between = hashlib.sha256(), b""
            for said in out:
                digest.update(between + ":".join(said).encode("utf-8", "replace"))
                between = b"\n"
            done.append((conv, digest.hexdigest()))
            if len(done) == 1000:
                yield _batch(done, schema)
                done.clear()
        if done:
            yield _batch(done, schema)

    digests = _in_order(turns, planned).mapInArrow(of, "conv_id long, repaired_sha256 string").alias("d")
    p = planned.alias("p")
    return p.join(digests, F.col("p.conv_id").eqNullSafe(F.col("d.conv_id"))).select("p.*", "repaired_sha256")


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that a checksum of conversation and turn chooses: a test bed for the repair."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("harm"))
    hurt = rows.filter("harm <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def repair_report(df: DataFrame) -> DataFrame:
    """Damages every conversation, repairs it, and tells faults, cost, audit and digest of each original ``conv_id``."""
    ids = df.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = repair_digests(damage(df))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows")
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"),
    )


SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits),
keyed AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS harm
  FROM conversations, crc_table),
damaged AS (
  SELECT rid, k, conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(2) c(k) WHERE harm <> 0 AND (k = 0 OR harm = 3)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 32), substr(text, 1, 64), rid, k) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS initial
  FROM damaged),
flagged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN bare = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE}
      WHEN right(bare, 1) IN ('.', '!', '?') THEN {NONE} ELSE {CUT_OFF} END AS fault
  FROM ordered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank,
    count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {CUT_OFF}) AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flagged GROUP BY conv_id),
steps(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, cost, edits, lines) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 2, 'I', chr(10) || 'user:'),
  (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:')),
edited AS (
  SELECT conv_id, i, p, p AS q, {DELETE} AS cost, 'D' AS edit, '' AS line FROM flagged, range(4) s(p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = {CUT_OFF} THEN {TRUNCATED} ELSE 0 END, 'K', chr(10) || role || ':' || text
  FROM flagged JOIN steps USING (initial) WHERE fault NOT IN ({BLANK}, {DUPLICATE})
  UNION ALL SELECT conv_id, i, p, q, {REROLE} + CASE WHEN fault = {CUT_OFF} THEN {TRUNCATED} ELSE 0 END, 'R',
    chr(10) || CASE WHEN s.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || text
  FROM flagged, steps s WHERE fault NOT IN ({BLANK}, {DUPLICATE}) AND s.initial <> 's'),
moves AS (SELECT e.conv_id, e.i, e.p, n.q, e.cost + n.cost AS cost, e.edit || n.edits AS edits, e.line || n.lines AS lines FROM edited e JOIN inserts n ON n.p = e.q),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, n.q, n.cost::BIGINT AS cost, n.edits AS audit, n.lines FROM counts, inserts n WHERE n.p = 0
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, m.q, min({{'cost': (w.cost + m.cost)::BIGINT, 'audit': w.audit || m.edits}}) AS best,
      arg_min(w.lines || m.lines, {{'cost': (w.cost + m.cost)::BIGINT, 'audit': w.audit || m.edits}}) AS lines
    FROM walk w JOIN moves m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1 AND m.p = w.q GROUP BY ALL)),
ended AS (
  SELECT w.conv_id, min({{'cost': w.cost, 'audit': w.audit}}) AS best, arg_min(w.lines, {{'cost': w.cost, 'audit': w.audit}}) AS lines
  FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE w.q IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(n, 0)::BIGINT AS n_rows,
  coalesce(best.audit, '') AS audit, sha256(substr(coalesce(lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
