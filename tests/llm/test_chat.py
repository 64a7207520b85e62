import hashlib
import itertools

from pyspark.sql import functions as F

from spokeworks.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BITS = ["", "\\", "\n", "<|", "|", "\\n", "<|b|>", "<|p|>", "<|im_start|>", "<|im_end|>\n", "n", "$1", "ä\U0001f600", "\\|"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, said in turns.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        out[conv] = (len(said), digest("".join(f"{r}\n{t}\n" for _, r, t in said)), len(loss), digest(loss))
    return out


def test_round_trip_of_control_strings(spark):
    rows = []
    for conv, (a, b) in enumerate(itertools.product(BITS, BITS)):
        rows += [(conv, 0, a + b, b + a), (conv, 1, "assistant", a + b + a), (conv, 2, "user", b)]
    rows += [(None, None, None, None), (None, 1, "assistant", None), (None, 1, "assistant", None), (9999, 5, "assistant", "x")]
    rows += [(8888, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"t": F.lit("clash"), "p": F.lit(1), "example": F.lit(2)})
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest_examples(chat.expand_targets(frame)).collect()}
    assert got == expected(rows)


def test_every_reply_is_one_example(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3"), (2, 0, "user", "only")]
    found = sorted(chat.expand_targets(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [(r.conv_id, r.example, r.text[r.loss_start :][: r.loss_chars] if r.loss_chars else None) for r in found] == [(1, 0, "a1"), (1, 1, "a2"), (1, 2, None), (2, 0, None)]
    assert found[0].text == "<|im_start|>user\nq1<|im_end|>\n<|im_start|>assistant\na1<|im_end|>\n"
    assert all(b.text.startswith(a.text) for a, b in zip(found[:2], found[1:3]))


def test_plan_and_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    result = chat.digest_examples(chat.expand_targets(frame))
    assert result.count() == 0
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
