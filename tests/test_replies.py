"""Agent turns and the human replies to them."""

import random

import pytest

import tokentariff as tt

TURNS = "conv_id long, turn long, role string, text string"


def paired(rows):
    out = []
    for conv in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r[1:] for r in rows if r[0] == conv and r[1] is not None
                       and r[2] in ("assistant", "user")),
                      key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
        for this, after in zip(mine, mine[1:] + [None]):
            if this[1] == "assistant":
                human = after is not None and after[1] == "user"
                out.append((conv, this[0], this[2], *((after[0], after[2]) if human else (None, None))))
    return sorted(out, key=repr)


def result(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def some_turns():
    rng = random.Random(4)
    rows = []
    for i in range(700):
        conv = rng.choice([1, 1, 1, 2, 3, None])
        rows.append((conv, rng.choice([None, i, i * 7, i * 7]), rng.choice(
            ["assistant", "user", "system", None, "assistant"]), rng.choice([None, "", f"t{i}"])))
    return rows


@pytest.mark.parametrize("block", [1, 3, 100, 65_536])
def test_pairs_across_blocks(spark, block):
    """Blocks with one turn, empty blocks between, and conversations within one block."""
    rows = some_turns()
    assert result(tt.turn_replies(spark.createDataFrame(rows, TURNS), block=block)) == paired(rows)


def test_reply_is_the_first_human_turn_before_the_next_agent_turn(spark):
    rows = [(1, 0, "assistant", "a"), (1, 1, "system", "s"), (1, 2, "user", "u"), (1, 3, "user", "v"),
            (1, 4, "assistant", "b"), (1, 5, "assistant", "c"), (1, -3, "user", "before")]
    frame = spark.createDataFrame(rows, TURNS)
    assert result(tt.turn_replies(frame, block=2)) == [
        (1, 0, "a", 2, "u"), (1, 4, "b", None, None), (1, 5, "c", None, None)]
    assert tt.turn_replies(frame.limit(0)).collect() == []


def test_texts_are_shuffled_once(spark):
    """Only one exchange carries all texts; numbers of blocks are found without them."""
    frame = spark.createDataFrame(some_turns(), TURNS)
    plan = tt.turn_replies(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 1 and "CartesianProduct" not in plan
