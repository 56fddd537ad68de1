import hashlib
import heapq
import random
import zlib
from collections import defaultdict

from tidepanel.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit int"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        yield from [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)


def cheapest(rows):
    """Least (cost, audit, repaired) by uniform-cost search over (row, state), edits tried one by one."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(queue, (cost + 2, audit + "I", i, role[0], (*out, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in step:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, new[0], (*out, f"{new}:{text}")))


def brute(rows, hurt=damaged):
    own = defaultdict(list)
    for conv, *_ in rows:
        own[conv] = own[conv]
    for conv, turn, role, text in hurt(rows):
        own[conv].append((turn is not None, turn or 0, role, text))
    out = set()
    for conv, mine in own.items():
        mine.sort()
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for known, t, _, _ in mine if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest([(r, t, f) for (_, _, r, t), f in zip(mine, faults)])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def rows_of(seed, conversations=120, most=14):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for k in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"])
            text = rng.choice(["a.", "b!", "c", " ", "", None, "long é text?\n", "x. \t", "y"])
            rows.append((conv, rng.choice([k, k, k, k + 2, None]), role, text))
    return rows


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return [tuple(r[c] for c in COLUMNS) for r in T.repair_report(df).collect()]


def test_equals_uniform_cost_search(spark):
    rows = rows_of(3) + [(None, 0, "user", "q?"), (None, None, "assistant", "a."), (-5, 1, "system", "s.")] + [(900, 1, "user", "same.")] * 7
    rows += [(901, k, "user" if k % 3 else "assistant", f"t{k % 50}.") for k in range(300)]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table_and_dropped_conversation(spark):
    assert run(spark, []) == []
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_halves_give_the_cell_of_all_splits():
    rng = random.Random(5)
    for _ in range(60):
        s = "".join(rng.choice("suaoSUAOd") for _ in range(rng.randrange(1, 12)))
        chart = {(i, i + 1): T.row_cell(c) for i, c in enumerate(s)}
        for length in range(2, len(s) + 1):
            for i in range(len(s) - length + 1):
                ways = [T.combine(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
                cell = []
                for entries in zip(*ways):
                    known = [e for e in entries if e is not None]
                    assert len(known) in (0, len(entries)) and len(set(known)) <= 1
                    cell.append(known[0] if known else None)
                chart[i, i + length] = tuple(cell)
        assert T.span_cell(s) == chart[0, len(s)]


def test_spans_of_a_long_conversation_over_many_tasks(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"t{k}" + rng.choice([".", ""])) for k in range(3000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    flagged = T.flags(T._turns(df, "conv_id", "turn", "role", "text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert T.spans(flagged).count() > 1
        got = T.repair_digests(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(rows, hurt=list)
    assert {tuple(r[c] for c in COLUMNS) for r in got} == want
    turns = T.repaired_turns(df).orderBy("position").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == got[0]["repaired_sha256"]
