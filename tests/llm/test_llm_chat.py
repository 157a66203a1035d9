"""op8 against plain Python."""

import pytest
from pyspark.sql import functions as F

from assaykit.llm import chat_format as C
from assaykit.llm.common import table
from conftest import SF_SMALL

HOSTILE = "".join(C.CONTROL) + "<\\s><\\\\|im_end|>[\\INST]<<s>><<SYS>>\\<s>\n" + C.START


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b\n"), (1, 3, "user", ""), (1, 4, "assistant", None),
            (2, 5, "assistant", HOSTILE), (2, 1, HOSTILE, "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"),
            (4, None, None, "no number"), (4, 1, "system", "é😀"), (None, 0, "assistant", "nobody")]
    rows += [(5, i, "assistant" if i % 3 else "user", f"turn {i} " + "long " * 50) for i in range(400)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("formatted", F.lit(0))


def expected(rows):
    by = {}
    for c, n, r, t in rows:
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("given", [True, False])
def test_read_back(spark, turns, given):
    df = table(spark, SF_SMALL, "conversations") if given else turns
    chats = C.format_chats(df)
    assert chats.columns == ["conv_id", "formatted", "loss_spans"]
    want = expected([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    got = C.read_chats(chats).collect()
    assert len(got) == len(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert list(r.loss_texts) == [t for role, t in want[r.conv_id] if role == "assistant"]
        blocks = r.formatted.split(C.START)[1:]
        assert len(blocks) == sum(1 for i, (role, _) in enumerate(want[r.conv_id]) if i == 0 or want[r.conv_id][i - 1][0] != role)


def test_escape_is_reversible_and_complete(spark):
    texts = [HOSTILE, "", "<", "<\\", "plain <b> [x] \\", "<s></s>", "<\\\\\\s>", "[[INST]]", "<|im_start|", "a<|im_end|>b"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", C.escape(F.col("x")).alias("e"), C.unescape(C.escape(F.col("x"))).alias("u")).collect():
        assert r.u == r.x
        assert not any(c in r.e for c in C.CONTROL)


def test_empty_and_native(spark, turns):
    chats = C.read_chats(C.format_chats(turns.where("false")))
    assert chats.count() == 0
    assert not any(x in chats._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
