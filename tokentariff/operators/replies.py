"""Pair each agent turn with the human reply to it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN_BLOCK = 1_024
AGENT, HUMAN = "assistant", "user"


def turn_replies(turns: DataFrame, agent: str = AGENT, human: str = HUMAN,
                 block: int = TURN_BLOCK) -> DataFrame:
    """``conv_id, turn, text, reply_turn, reply`` of every agent turn.

    The reply is the first human turn after it and before the agent's next; turns of other roles in
    between are skipped. An agent turn that the agent or nobody follows has a null reply. Turns without
    a conversation or a number pair with nothing and are left out; of turns with the same number the order
    is that of role and text.

    Turns are shuffled once, by conversation and block of turn numbers, so that a long conversation is
    many groups. The last turn of a block is followed by the first one of the next block that has turns:
    the numbers of these blocks are found without texts, and one row is carried back for each.
    """
    both = (turns.select("conv_id", "turn", "role", "text",
                         F.floor(F.col("turn") / block).alias("_block"))
            .where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
                   & F.col("role").isin(agent, human))
            .repartition("conv_id", "_block"))
    turn = F.struct("turn", "role", "text")
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    next_ = both.withColumn("_next", F.lead(turn).over(inside))
    following = Window.partitionBy("conv_id").orderBy("_block")
    linked = (both.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
              .withColumn("_after", F.lead("_block").over(following))
              .where(F.col("_after").isNotNull()).select("conv_id", "_block", "_after"))
    firsts = (both.groupBy("conv_id", "_block").agg(F.min(turn).alias("_carried"))
              .withColumnRenamed("_block", "_after"))
    carried = linked.join(firsts, ["conv_id", "_after"]).select("conv_id", "_block", "_carried")
    follower = F.coalesce(F.col("_next"), F.col("_carried"))
    replied = follower["role"] == human
    return (next_.join(carried, ["conv_id", "_block"], "left").where(F.col("role") == agent)
            .select("conv_id", "turn", "text",
                    F.when(replied, follower["turn"]).alias("reply_turn"),
                    F.when(replied, follower["text"]).alias("reply")))
