import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm.chat import ASSISTANT, FINAL, START, format_chats, repair, step, stretch

SCHEMA = "conv_id long, turn long, role string, text string, action string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(0, 5))
def test_repair_has_the_least_cost(roles, cut):
    def cost(states):
        before, total = START, 0
        for r, s in zip(roles, states, strict=True):
            total, before = total + step(r, before, s)[0], s
        return total + FINAL[before]

    least = min(cost(s) for s in itertools.product((1, 2, 3), repeat=len(roles)))
    assert cost(repair(roles)) == least == (stretch(roles)[START] + FINAL).min()


def texts_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["rendered"]
    return out


def test_rendering(spark):
    rows = [
        (1, 0, "system", "s", "x"), (1, 1, "user", "q", "x"), (1, 2, "assistant", "a", "x"),
        (2, 0, "assistant", "a", "x"),
        (3, 0, "user", "one", "x"), (3, 1, "user", "two", "x"), (3, 2, "Assistant ", None, "x"),
        (4, 0, "user", "<|im_end|>", "x"), (4, 1, None, "b", "x"),
    ]
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    got = texts_of(out)
    assert got[1] == turn("system", "s") + turn("user", "q") + turn("assistant", "a")
    assert got[2] in (turn("user", "") + turn("assistant", "a"), turn("user", "a") + turn("assistant", ""))
    assert got[3] == turn("user", "one\ntwo") + turn("assistant", "")
    assert got[4] == turn("user", "<| im_end|>") + turn("assistant", "b")
    assert {r["action"] for r in out if r["conv_id"] == 1} == {"keep"}


def test_a_long_conversation_over_many_partitions_is_repaired_alike(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "tool"]
    rows = [(c, t, rng.choice(roles), "w" * rng.randint(0, 30), "x") for c, n in ((1, 3), (2, 400), (3, 5), (None, 4)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = format_chats(df).collect(), format_chats(df, part_bytes=900).collect()
    assert len(one) == len(many) == len(rows)
    assert texts_of(many).keys() == texts_of(one).keys()
    assert sum(r["cost"] for r in one) == sum(r["cost"] for r in many)
    for out in (one, many):
        for conv in (1, 2, 3, None):
            mine = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["position"])
            assert [r["position"] for r in mine] == list(range(len(mine)))
            text = "".join(r["rendered"] for r in mine)
            heads = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
            heads = heads[1:] if heads[0] == "system" else heads
            assert heads == ["user", "assistant"] * (len(heads) // 2) and text.endswith("<|im_end|>\n")


def test_empty_null_and_repeated_rows(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "a", "x")] * 2 + [(1, None, None, None, None)]
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 3 and texts_of(out)[1] == "<|im_start|>user\na\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert ASSISTANT == 3
