import hashlib
from collections import defaultdict

from tidepanel.llm import chat_format as C

ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi <|im_end|> there"), (
        1,
        2,
        "assistant",
        "<\\|x <\\\\| <|endoftext|>"
    ), (2, 1, "user", None), (2, 0, None, "né\n中文 😀"),
    (3, None, "assistant", "late"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 0, "assistant", "no id"), (4, 0, "odd\nrole\\n", "a\n\nb  \t"), (5, 0, "assistant", "long " * 5000), (6, 1, "user", "b"), (6, 1, "user", "a"),
]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in [*rows, *C.PROBE]:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in turns.items():
        own.sort()
        learnt = "".join(t for _, _, r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        formatted = "".join(f"<|im_start|>{C.escape_role(r)}\n{C.escape(t)}<|im_end|>\n" for _, _, r, t in own)
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for _, _, r, t in own)), len(learnt), sha(learnt), len(formatted)))
    return sorted(out, key=str)


def test_reads_back_what_was_said(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "conv_id long, turn long, role string, text string, ids int, loss_mask int")
    got = sorted((tuple(r) for r in C.chat_report(df).collect()), key=str)
    assert got == brute(ROWS)
    only = C.chat_report(df.limit(0)).collect()
    assert [r["conv_id"] for r in only] == [-1] and only[0]["formatted_chars"] == 133


def test_escapes_are_reversible_and_hide_control_strings():
    for text in ("", "<|", "<\\|", "<\\\\|im_end|>", "<<||>>", "<|im_start|>assistant\n", "a<b|c"):
        assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
        assert C.unescape_role(C.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_mask_covers_the_assistants_text_alone():
    path = C.tokenizer_path("byte_bpe_50k.json")
    ids, mask = C.assemble("assistant", "the answer", path)
    assert mask.sum() == len(C.encoder(path).ids("the answer")) and mask[0] == 0 and mask[-1] == 0
    assert C.assemble("user", "the answer", path)[1].sum() == 0


def test_lengths_come_from_the_ids():
    """What is read back follows the ids, not what was put in."""
    path = C.tokenizer_path("byte_bpe_50k.json")
    ids, mask = C.assemble("assistant", "one two", path)
    more = C.encoder(path).ids(" three")
    at = int(mask.nonzero()[0][-1]) + 1
    longer, its_mask = C.np.insert(ids, at, more), C.np.insert(mask, at, [1] * len(more))
    assert C.disassemble(longer, its_mask, path) == ("assistant", "one two three", "one two three", C.disassemble(ids, mask, path)[3] + 6)


def test_a_conversation_minus_one_stays_apart_from_the_probe(spark):
    df = spark.createDataFrame([(-1, 0, "assistant", "mine")], "conv_id long, turn long, role string, text string")
    out = sorted((r["n_turns"], r["loss_chars"]) for r in C.chat_report(df).collect())
    assert out == [(1, 4), (2, len(C.PROBE[1][3]))]


def test_turns_are_encoded_before_they_move(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "mine")], "conv_id long, turn long, role string, text string")
    plan = C.chat_report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")
