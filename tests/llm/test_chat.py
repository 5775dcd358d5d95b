"""Formatted chats against a plain rendering, the loss spans by slicing it."""

import random
import re

import pytest

from tidewright.llm import chat

CONTROL = re.compile(r"([<\[])(\\*)" + chat.CONTROL_TAIL)
UNDO = re.compile(r"([<\[])\\(\\*)" + chat.CONTROL_TAIL)


def plain(turns):
    """The formatted text and the loss texts of sorted turns."""
    out, loss, last = "", [], None
    for _, role, text in turns:
        escaped = CONTROL.sub(r"\1\\\2\3", text)
        if role != last:
            out += (chat.END if last is not None else "") + chat.TURN + CONTROL.sub(r"\1\\\2\3", role) + chat.TEXT
        else:
            out += chat.MORE
        out += escaped
        last = role
        if role == chat.LOSS_ROLE:
            loss.append(text)
    return out + chat.END, loss


@pytest.mark.parametrize("seed", range(3))
def test_spans_and_texts(spark, seed):
    r = random.Random(seed)
    bits = ["<|end|>\n", "</s>", "[INST]", "<\\|text|>", "héllo 🎈", " ", "<<SYS>>", "<|more|>", "x" * 50, ""]
    chats = {c: [(t, r.choice(("user", "assistant", "assistant", "tool<|end|>")), "".join(r.choice(bits) for _ in range(r.randrange(4)))) for t in range(n)] for c, n in enumerate((1, 2, 3, 4, 5, 9, 17, 300))}
    df = spark.createDataFrame([(c, *t) for c, ts in chats.items() for t in ts], "conv_id long, turn int, role string, text string").orderBy("text")
    got = {x.conv_id: x for x in chat.format_chats(df).collect()}
    for c, turns in chats.items():
        text, loss = plain(turns)
        assert got[c].formatted == text
        assert [UNDO.sub(r"\1\2\3", text[s.begin : s.begin + s.length]) for s in got[c].loss_spans] == loss


def test_a_very_long_conversation(spark):
    n = 60_000
    df = spark.range(n).selectExpr("7L AS conv_id", "int(id) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('n', id) AS text")
    got = chat.chat_digests(df).first()
    assert (got.n_turns, got.n_blocks, got.loss_chars) == (n, n, sum(len(f"n{i}") for i in range(1, n, 2)))


def test_the_loss_text_is_what_the_mask_covers(spark):
    import hashlib

    from pyspark.sql import functions as F

    r = random.Random(12)
    say = lambda: "".join(r.choice(["<|end|>\n", "[INST]", "<\\|turn|>", "é", "word ", "\n", ""]) for _ in range(r.randint(0, 6)))
    turns = [(c, t, r.choice(["assistant", "user", "assistant"]), say()) for c in range(12) for t in range(r.choice((0, 1, 5, 40)))]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {x.conv_id: x for x in chat.chat_digests(df).collect()}
    for c in {t[0] for t in turns}:
        loss = "".join(x[3] for x in turns if x[0] == c and x[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # another mask gives another text
    formatted = chat.format_chats(df).select(chat.masked_text(F.col("formatted"), F.array(F.struct(F.lit(2).alias("begin"), F.lit(4).alias("length")))).alias("m")).collect()
    assert {x.m for x in formatted} == {"turn"}
