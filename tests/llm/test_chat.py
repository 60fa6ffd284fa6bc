import hashlib
import random

from pyspark.sql import functions as F

from tidewell.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escapes_reverse():
    r = random.Random(1)
    for _ in range(500):
        role, text = ("".join(r.choice("\\<n\n/turn>a ") for _ in range(r.randint(0, 12))) for _ in range(2))
        formatted = f"<turn>{C.escape(role, True)}\n{C.escape(text)}</turn>\n"
        assert C.read_example(formatted * 2) == [(role, text)] * 2


def test_examples_and_summary(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "<turn>x</turn>"), (1, 4, "assistant", "\\n <b>"), (1, 5, "user", "bye"),
        (2, 0, "user", None), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (None, None, None, None), (4, 1, "assistant", "é" * 70_000),
    ]
    conv = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("example", F.lit("x"))
    examples = {(r.conv_id, r.example): r for r in C.expand(conv).collect()}
    assert [k for k in examples if k[0] == 1] == [(1, 0), (1, 1), (1, 2)]
    one = examples[1, 1]
    assert C.unescape(one.text[one.loss_start : one.loss_end]) == "\\n <b>"
    assert C.read_example(one.text) == [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "<turn>x</turn>"), ("assistant", "\\n <b>")]
    assert examples[1, 2].loss_start is None
    got = {r.conv_id: r for r in C.summarise(C.expand(conv)).collect()}
    by: dict = {}
    for c, _, role, text in rows:
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(e.text) for k, e in examples.items() if k[0] == c)
    assert C.summarise(C.expand(conv.limit(0))).count() == 0
