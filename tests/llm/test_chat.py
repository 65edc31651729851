import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from wirelark.llm import chat

TEMPLATE = chat.Template(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<s><s></s>", "é👍\x00", "[ROLE]user[SEP]hi[/ROLE]", " x " * 30_000, "<|endoftext|>"]
marks = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "s>", "INST]", "/", "a", "é"]), max_size=12).map("".join)


@given(marks)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def wanted(rows):
    turns = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))]
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [chat.CHUNK, 5])
def test_round_trip(spark, chunk, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    roles = ["user", "assistant", "system", "tool[SEP]\\", None, "assistant"]
    talks = {c: [(t, roles[(t + c) % 6], ODD[(t * 7 + c) % len(ODD)]) for t in range(c * 3)] for c in range(1, 9)}
    talks[None] = [(0, "user", "no id"), (None, "assistant", "no turn")]
    talks[99] = [(i, "assistant", f"turn {i}") for i in range(2000)]
    rows = [(c, t, r, x, "mine") for c, own in talks.items() for t, r, x in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(5)
    chunks = chat.assemble(chat.encode_turns(df, TEMPLATE), TEMPLATE)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chunks, TEMPLATE).collect()}
    assert got == {c: wanted(own) for c, own in talks.items()}


def test_chunks_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 50)
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", "some words here " * 4) for t in range(40)], "conv_id long, turn long, role string, text string")
    chunks = sorted(chat.assemble(chat.encode_turns(df, TEMPLATE), TEMPLATE).collect(), key=lambda r: r["chunk"])
    assert len(chunks) > 5 and [r["at"] for r in chunks] == [sum(len(c.ids) for c in chunks[:i]) for i in range(len(chunks))]
    first = chat.tokenizer_of(TEMPLATE.path, TEMPLATE.pattern).first
    assert all(not on or i < first for c in chunks for i, on in zip(c.ids, c.loss))
    assert chunks[0].ids[0] == first + chat.BEGIN and chunks[-1].ids[-1] == first + chat.END


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = chat.read_back(chat.assemble(chat.encode_turns(df, TEMPLATE), TEMPLATE), TEMPLATE).first()
    assert one.n_turns == 4 and one.loss_chars == 0 and one.loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.read_back(chat.assemble(chat.encode_turns(df.limit(0), TEMPLATE), TEMPLATE), TEMPLATE).count() == 0
