"""Cross-tokenizer alignment by an associative monoid of fragments.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with
byte fallback) the text, before which it sets the space itself; so the tokens of both
are byte ranges of the same bytes. Where an A and a B token end together is a cut;
cuts part the tokens into groups. Two tokens are linked if their ranges overlap.

A byte range of a document is a :class:`Fragment`: the tokens that end in it up to
its first cut (open prefix), the groups between cuts (closed), the tokens after the
last cut (open suffix). Fragments of ranges that follow one another compose: the left
suffix and the right prefix close one group. Composition is associative, so a
document may be cut anywhere, in the middle of a token too, and composed in any tree.

Documents of up to ``CHUNK`` bytes are one range. Longer ones are cut into ranges of
``CHUNK`` bytes, dealt over all tasks, encoded there with the few bytes around that
tokens at the edges need, and composed by a tree of fan-in ``FAN``, in which only open
ends and joint groups travel.

Encoding goes by units, a run of white space with what follows up to the next: no
token of either tokenizer crosses a unit's start (checked on the vocabularies; else a
text is one unit). Units repeat, so a bounded table keeps those lately seen.

How many links hold a pair of ids linked is summed over the corpus with partial
sums; the pair table has at most a row for each two ids of the vocabularies, and is
broadcast only if it counts at most ``PAIRS`` rows, else joined by a shuffle.

Cases: a text that is null, empty, or whose A or B bytes aren't a space and the text
(a text with U+2581, say) has no tokens and zeros; repeated rows are documents each,
all counted; null ids stay; an empty table gives an empty result; a text without
white space is one unit of one task, whatever its length; only the named columns are
read.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import cut, shared_folder, text_batches
from .tokens import _LETTERS, by_rank, tokenizer_path

#: Bytes of a range of a long document, and how many fragments compose at once.
CHUNK, FAN = 1 << 16, 16
#: Rows of the pair table (about 24 bytes each) up to which it is broadcast.
PAIRS = 2_000_000
#: Units kept by one worker, in each of two generations, and the longest kept.
TABLE, KEPT_CHARS = 200_000, 64

#: White space other than a space or a line end, and what Python alone takes for white space.
_ODD = re.compile(r"[^\S \n]")
_PLAIN_CUT, _SAFE_CUT = re.compile(r"(?<=[^ \n])[ \n]"), re.compile(r"(?<=\S) (?=\S)")
_PLAIN_UNIT = re.compile(r"[ \n]+[^ \n]*")
_SPACE = "▁"


class _Units(dict):
    """Records of units; two generations, so that a full table forgets what wasn't seen lately."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, unit: str):
        out = self.old.get(unit, self)
        if out is self:
            out = self.make(unit)
        if len(unit) <= KEPT_CHARS:
            self.turn(1)
            self[unit] = out
        return out

    def turn(self, more: int) -> None:
        """Makes room for so many records."""
        if len(self) + more > TABLE:
            self.old = dict(self)
            self.clear()


class Aligner:
    """Both tokenizers, and what they make of units of text."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: b for b, c in _LETTERS.items()}
        self.size_a = self.a.get_vocab_size()
        self.bytes_a = [bytes(letters.get(ord(c), 63) for c in self.a.id_to_token(k) or "") for k in range(self.size_a)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.head = self.b.encode("\n")
        with open(a_path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.by_unit = before.get("type") == "ByteLevel" and before.get("use_regex") and b"".join(map(self.bytes_b.__getitem__, self.head)) == b" \n" and not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)
        ranked = by_rank(self.a, kind) if self.by_unit else None
        self.encode_a: Callable[[str], list[int]] = ranked.encode_ordinary if ranked else lambda text: self.a.encode(text, add_special_tokens=False).ids
        self.array_a, self.array_b = np.array(self.lengths_a), np.array(self.lengths_b)
        self.line_a = self.a.encode("\n", add_special_tokens=False).ids[0]
        #: Ids as text, with what stands behind them inside a group and at its end: first those of A, then those of B.
        self.words = [f"{k}{c}".encode() for size, end in ((self.size_a, "|"), (len(pieces), ";")) for k in range(size) for c in (",", end)]
        self.units = _Units(self._record)

    def plain(self, text: str) -> bool:
        return not _ODD.search(text)

    def cuts(self, whole: str) -> Iterator[int]:
        """Where units but the first start in ``whole``, a space and the text."""
        if self.by_unit:
            for m in (_PLAIN_CUT if self.plain(whole) else _SAFE_CUT).finditer(whole):
                yield m.start()

    def split(self, whole: str) -> list[str]:
        if self.by_unit and self.plain(whole):
            return _PLAIN_UNIT.findall(whole)
        at = [0, *self.cuts(whole), len(whole)]
        return [whole[i:j] for i, j in zip(at, at[1:])]

    def tokens(self, unit: str) -> tuple[list[int], list[int]] | None:
        """A and B ids of a unit; None if their bytes aren't the unit's."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        # What follows a line end gets no space set before it; the head, a space and the line end, is as it stands alone.
        b = self.b.encode("\n" + unit)[len(self.head) :] if self.by_unit else self.b.encode(unit[1:])
        raw = unit.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return a, b

    def groups(self, a: list[int], b: list[int]) -> tuple[bytes, list[int]]:
        """Groups as text, and the links as b * (size of A) + a, of tokens that cover the same bytes."""
        size_a, la, lb, done, links, first_a, first_b, i, j = self.size_a, self.lengths_a, self.lengths_b, [], [], 0, 0, 0, 0
        end_a, end_b, last_a, last_b = la[a[0]], lb[b[0]], len(a) - 1, len(b) - 1
        while True:
            links.append(b[j] * size_a + a[i])
            if end_a == end_b:
                i, j = i + 1, j + 1
                done.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                if i > last_a or j > last_b:
                    return ";".join(done).encode(), links
                first_a, first_b = i, j
                end_a, end_b = end_a + la[a[i]], end_b + lb[b[j]]
            elif end_a < end_b:
                i += 1
                end_a += la[a[i]]
            else:
                j += 1
                end_b += lb[b[j]]

    def _record(self, unit: str) -> tuple[int, bytes, bytes] | bool:
        """A unit's tokens (A, and B times 2^32), groups and links; False if it has none."""
        if (both := self.tokens(unit)) is None:
            return False
        groups, links = self.groups(*both)
        return len(both[0]) + (len(both[1]) << 32), groups, np.array(links, dtype=np.int64).tobytes()

    def _learn(self, units: list[str]) -> None:
        """Puts records of new units into the table, with one call of each tokenizer: units, each a space and a word, stand in lines.

        A line end is a token of its own in both and ends a group.
        """
        raw = "".join(u + "\n" for u in units)
        a = np.array(self.encode_a(raw))
        b = np.array(self.b.encode("\n" + raw)[len(self.head) :])
        line_a, line_b = np.flatnonzero(a == self.line_a), np.flatnonzero(b == self.head[-1])
        data = raw.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        if not same or not len(line_a) == len(line_b) == len(units):
            for unit in units:
                self.units[unit] = self._record(unit)
            return
        ends_a, ends_b = np.cumsum(self.array_a[a]), np.cumsum(self.array_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        words = np.empty(len(a) + len(b), dtype=np.int64)
        words[at_a] = 2 * a + (cuts[group_a] == ends_a)
        words[at_b] = 2 * self.size_a + 2 * b + (cuts[group_b] == ends_b)
        words = list(map(self.words.__getitem__, words.tolist()))
        ends = np.union1d(ends_a, ends_b)
        links = (b[np.searchsorted(ends_b, ends)] * self.size_a + a[np.searchsorted(ends_a, ends)]).tobytes()
        starts = np.concatenate([[0], ends_a[line_a][:-1]])
        columns = (
            np.diff(line_a, prepend=-1) - 1 + (np.diff(line_b, prepend=-1) - 1 << 32),
            np.concatenate([[0], at_a[line_a][:-1] + 2]),
            at_a[line_a],
            8 * np.searchsorted(ends, starts, "right"),
            8 * np.searchsorted(ends, ends_a[line_a - 1], "right"),
        )
        for unit, n, i, j, low, high in zip(units, *(c.tolist() for c in columns)):
            self.units[unit] = n, b"".join(words[i:j])[:-1], links[low:high]

    def records(self, units: list[str]) -> list:
        """Every unit's record; those that the table lacks are made together."""
        out = list(map(self.units.get, units))
        if None in out:
            new = [u for u in dict.fromkeys(u for u, r in zip(units, out) if r is None) if len(u) <= KEPT_CHARS and u not in self.units.old and u[0] == " " and len(u) > 1 and u.find(" ", 1) < 0 and "\n" not in u]
            if new and self.by_unit and not _ODD.search("".join(new)):
                self.units.turn(len(new))
                self._learn(new)
            out = list(map(self.units.__getitem__, units))
        return out

    def whole(self, text: str | None) -> tuple[int, int, tuple[bytes, ...], np.ndarray] | None:
        """Numbers of A and B tokens, groups and links of a text; None if it has no tokens."""
        if not text:
            return None
        records = self.records(self.split(" " + text))
        if False in records:
            return None
        counts, groups, links = zip(*records)
        n = sum(counts)
        return n & 0xFFFFFFFF, n >> 32, groups, np.frombuffer(b"".join(links), dtype=np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """This process's aligner for two tokenizer files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


Open = tuple  # (A ids, B ids)
_NONE: Open = ([], [])


class Fragment:
    """A byte range: open prefix, closed pieces in order, open suffix; without a cut all its tokens are prefix.

    A piece is (number of the range in which it ends, groups, links). ``first`` is
    the number of the range that has the first cut, None without a cut.
    """

    __slots__ = ("closed", "first", "prefix", "suffix")

    def __init__(self, first: int | None, prefix: Open, closed: list, suffix: Open):
        self.first, self.prefix, self.closed, self.suffix = first, prefix, closed, suffix

    @classmethod
    def of(cls, one: Aligner, k: int, start: int, low: int, high: int, a: list[int], b: list[int]) -> "Fragment":
        """Of the tokens that end in (low, high], from tokens that cover bytes from ``start`` on."""
        ends_a, ends_b = start + np.cumsum([one.lengths_a[x] for x in a]), start + np.cumsum([one.lengths_b[x] for x in b])
        (a0, a1), (b0, b1) = (np.searchsorted(e, (low, high), "right").tolist() for e in (ends_a, ends_b))
        cuts = np.intersect1d(ends_a[a0:a1], ends_b[b0:b1], assume_unique=True)
        if not len(cuts):
            return cls(None, (a[a0:a1], b[b0:b1]), [], _NONE)
        (fa, la), (fb, lb) = ((np.searchsorted(e, cuts[[0, -1]]) + 1).tolist() for e in (ends_a, ends_b))
        closed = [(k, *one.groups(a[fa:la], b[fb:lb]))] if fa < la else []
        return cls(k, (a[a0:fa], b[b0:fb]), closed, (a[la:a1], b[lb:b1]))

    def then(self, one: Aligner, right: "Fragment") -> "Fragment":
        """The fragment of this range and the one behind it."""
        left_open = self.prefix if self.first is None else self.suffix
        both = (left_open[0] + right.prefix[0], left_open[1] + right.prefix[1])
        if self.first is None:
            return Fragment(right.first, both, right.closed, right.suffix)
        if right.first is None:
            return Fragment(self.first, self.prefix, self.closed, both)
        return Fragment(self.first, self.prefix, [*self.closed, (right.first, *one.groups(*both)), *right.closed], right.suffix)


def chunks(one: Aligner, text: str, size: int = CHUNK) -> Iterator[tuple[int, int, int, int, str]]:
    """Ranges of a space and the text: (number, low, high, where the context starts, context), in bytes.

    Bounds lie anywhere, but not in a unit of over a quarter of a range, which goes to
    one range whole; so contexts overlap by a unit and no more.
    """
    whole = " " + text
    k = low = context = context_char = start = start_char = 0

    def ends() -> Iterator[int]:
        yield from one.cuts(whole)
        yield len(whole)

    for end_char in ends():
        end = start + len(whole[start_char:end_char].encode())
        if end >= low + size:
            high = end if end - start > size // 4 else low + size
            yield k, low, high, context, whole[context_char:end_char]
            k, low = k + 1, high
            context, context_char = (end, end_char) if high == end else (start, start_char)
        start, start_char = end, end_char
    if low < start:
        yield k, low, start, context, whole[context_char:]


def fragment(one: Aligner, k: int, low: int, high: int, context: int, text: str) -> Fragment | None:
    """The fragment of a range; None if its bytes aren't those of both tokenizers."""
    out, inner, at = None, [], context

    def put(right: Fragment | None) -> None:
        nonlocal out
        if right is not None:
            out = right if out is None else out.then(one, right)

    def close() -> None:
        """Units that lie in the range are one fragment: their first group is the prefix, the others are closed."""
        if inner:
            first, *rest = inner
            prefix = tuple([int(x) for x in side.split(b",")] for side in first[1].split(b";", 1)[0].split(b"|"))
            links = np.frombuffer(b"".join(r[2] for r in inner), dtype=np.int64)[len(prefix[0]) + len(prefix[1]) - 1 :]
            groups = [*first[1].split(b";", 1)[1:], *(r[1] for r in rest)]
            put(Fragment(k, prefix, [(k, b";".join(groups), links.tolist())] if groups else [], _NONE))
            inner.clear()

    for unit in one.split(text):
        end = at + len(unit.encode())
        if low <= at and end <= high:
            if (record := one.units[unit]) is False:
                return None
            inner.append(record)
        else:
            close()
            if (both := one.tokens(unit)) is None:
                return None
            put(Fragment.of(one, k, at, low, high, *both))
        at = end
    close()
    return out


def _links(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs, times = np.unique(links, return_counts=True)
    return pairs, times.astype(np.int32)


_DOC = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_DOC_SCHEMA = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
#: Documents of one batch of results.
_ROWS = 256


def _flush(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()


def _short(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, done = aligner(paths), []
        for batch in batches:
            for uid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = one.whole(text.as_py())
                if got is None:
                    done.append((uid, doc, 0, 0, 0, 0, "", [], []))
                else:
                    n_a, n_b, groups, links = got
                    text_of = b";".join(groups)
                    done.append((uid, doc, n_a, n_b, text_of.count(b"|"), len(links), hashlib.sha256(text_of).hexdigest(), *_links(links)))
                if len(done) == _ROWS:
                    yield from _flush(done, _DOC_SCHEMA)
        yield from _flush(done, _DOC_SCHEMA)

    return rows.mapInArrow(of, _DOC)


_PIECE = "uid long, doc_id long, k int, joint boolean, ok boolean, groups binary, pairs array<long>, times array<int>, node binary"
_PIECE_SCHEMA = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("joint", pa.bool_()), ("ok", pa.bool_()), ("groups", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("node", pa.binary())])


def _leaves(rows: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """A row for each range: its closed groups and links, and what is left of its fragment."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(paths)
        for batch in batches:
            for uid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for k, low, high, context, part in chunks(one, text.as_py(), size):
                    columns = [pa.array([uid]), pa.array([doc], pa.int64()), pa.array([k], pa.int32()), pa.array([low]), pa.array([high]), pa.array([context]), pa.array([part])]
                    yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "k", "low", "high", "context", "part"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, done = aligner(paths), []
        for batch in batches:
            for uid, doc, k, low, high, context, part in zip(*(batch.column(c).to_pylist() for c in range(7))):
                got = fragment(one, k, low, high, context, part)
                if got is None:
                    done.append((uid, doc, k, False, False, b"", [], [], None))
                else:
                    groups = b";".join(p[1] for p in got.closed)
                    links = np.array([x for p in got.closed for x in p[2]], dtype=np.int64)
                    done.append((uid, doc, k, False, True, groups, *_links(links), pickle.dumps((got.first, got.prefix, [], got.suffix))))
            yield from _flush(done, _PIECE_SCHEMA)

    dealt = rows.mapInArrow(deal, "uid long, doc_id long, k int, low long, high long, context long, part string").repartition("uid", "k")
    return dealt.mapInArrow(of, _PIECE)


def _compose(nodes: DataFrame, paths: tuple[str, str], fan: int) -> DataFrame:
    """``uid, doc_id, k, ok, node`` of every ``fan`` fragments that follow one another."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("ok", pa.bool_()), ("node", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, own, done = aligner(paths), None, []

        def close() -> None:
            done.append((*own[:3], own[3] is not None, own[3] and pickle.dumps((own[3].first, own[3].prefix, own[3].closed, own[3].suffix))))

        for batch in batches:
            for uid, doc, k, ok, node in zip(*(batch.column(c).to_pylist() for c in range(5))):
                right = Fragment(*pickle.loads(node)) if ok else None
                if own is None or own[0] != uid or own[2] != k // fan:
                    if own:
                        close()
                    own = [uid, doc, k // fan, right]
                else:
                    own[3] = own[3].then(one, right) if own[3] is not None and right is not None else None
            yield from _flush(done, schema)
        if own:
            close()
        yield from _flush(done, schema)

    rows = nodes.select("uid", "doc_id", "k", "ok", "node").withColumn("up", F.floor(F.col("k") / fan))
    return rows.repartition("uid", "up").sortWithinPartitions("uid", "up", "k").drop("up").mapInArrow(of, "uid long, doc_id long, k int, ok boolean, node binary")


def _long(rows: DataFrame, paths: tuple[str, str], size: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Documents of several ranges, as :func:`_short` gives them but for pairs and times, and their links by piece."""
    leaves = cut(_leaves(rows, paths, size))
    most = leaves.agg(F.max("k")).first()[0]
    nodes, left = leaves, 1 + (most or 0)
    while True:
        nodes = cut(_compose(nodes, paths, fan))
        left = -(-left // fan)
        if left == 1:
            break

    def joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, done = aligner(paths), []
        for batch in batches:
            for uid, doc, node in zip(*(batch.column(c).to_pylist() for c in range(3))):
                first, prefix, closed, suffix = pickle.loads(node)
                if any(suffix):
                    raise ValueError("tokens are left at the end of a document")
                for k, groups, links in [(first, *one.groups(*prefix)), *closed]:
                    done.append((uid, doc, k, True, True, groups, *_links(np.array(links, dtype=np.int64)), None))
                    if len(done) == _ROWS:
                        yield from _flush(done, _PIECE_SCHEMA)
        yield from _flush(done, _PIECE_SCHEMA)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = None, []
        schema = pa.schema(list(_DOC_SCHEMA)[:7])

        def close() -> None:
            uid, doc, ok, sha, commas, bars, links, ids_a = own
            done.append((uid, doc, ids_a, links + bars - ids_a, bars, links, sha.hexdigest()) if ok else (uid, doc, 0, 0, 0, 0, ""))

        for batch in batches:
            for uid, doc, ok, groups, times in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if own is None or own[0] != uid:
                    if own:
                        close()
                    own = [uid, doc, True, hashlib.sha256(), 0, 0, 0, 0]
                if groups:
                    own[3].update(b";" * bool(own[5]) + groups)
                    own[5] += groups.count(b"|")
                    own[6] += times
                    own[7] += sum(g.split(b"|", 1)[0].count(b",") + 1 for g in groups.split(b";"))
                own[2] &= ok
            yield from _flush(done, schema)
        if own:
            close()
        yield from _flush(done, schema)

    found = nodes.filter("ok").select("uid", "doc_id", "node").mapInArrow(joints, _PIECE)
    failed = nodes.filter(~F.col("ok")).select("uid", F.lit(True).alias("failed"))
    pieces = cut(leaves.unionByName(found).join(failed, "uid", "left").withColumn("ok", F.col("failed").isNull()).drop("failed", "node"))
    total = F.aggregate("times", F.lit(0).cast("long"), lambda s, x: s + x)
    in_order = pieces.select("uid", "doc_id", "ok", "groups", total.alias("links"), "k", "joint").repartition("uid").sortWithinPartitions("uid", "k", F.col("joint").desc())
    docs = in_order.select("uid", "doc_id", "ok", "groups", "links").mapInArrow(digest, _DOC.split(", pairs")[0])
    return docs, pieces.filter("ok").select("uid", "pairs", "times")


def align_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, size: int = CHUNK, fan: int = FAN
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents (``uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256``) and their
    links (``uid, pairs, times``), a pair being b * (size of A's vocabulary) + a."""
    paths = (a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model"))
    text_batches(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) >= size
    place = shared_folder(df.sparkSession, "alignment")
    _short(rows.filter(~is_long), paths).write.option("compression", "zstd").parquet(place)
    short = df.sparkSession.read.parquet(place)
    docs, links = _long(rows.filter(is_long).withColumn("uid", -1 - F.col("uid")), paths, size, fan)
    columns = [x.split()[0] for x in _DOC.split(", ")]
    return short.select(*columns[:7]).unionByName(docs), short.select("uid", "pairs", "times").unionByName(links)


def pair_counts(links: DataFrame, size_a: int) -> DataFrame:
    """``pair, count, best``: links of the corpus that hold the pair, and whether no pair of its B id has more."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    of_b = Window.partitionBy(F.expr(f"pair div {size_a}"))
    return each.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


def alignment_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, size: int = CHUNK, fan: int = FAN, broadcast_pairs: int = PAIRS
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    docs, links = align_documents(df, key, text, a, b, size, fan)
    docs = cut(docs)
    counts = cut(pair_counts(links, Tokenizer.from_file(a or tokenizer_path("byte_bpe_50k.json")).get_vocab_size()))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    each = links.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return docs.join(sums, "uid", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")),
        "groups_sha256",
    )
