"""Sessions and supplied pieces in the expected shape, derived from the test tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN_BLOCK = 65_536


def order_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One session per order; its line items give the token counts."""
    lines = (spark.read.parquet(f"{folder}/lineitem.parquet")
             .groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.count("*").alias("n_lines"),
                  F.sum(_nearest(F.col("l_quantity"))).alias("qty"),
                  F.sum(_nearest(F.col("l_extendedprice") * 100)).alias("cents")))
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    key = F.col("o_orderkey")
    turns = 1 + (key % 11) * 3
    tokens = F.floor(F.col("cents") / 100.0)
    agent = (F.when(key % 5 == 0, "Claude Code").when(key % 5 == 1, "claude-code")
             .when(key % 5 == 2, "Claude Code").when(key % 5 == 3, "CLAUDE CODE"))
    return orders.join(lines, "o_orderkey", "left").select(
        key.alias("session_id"),
        agent.alias("agent"),
        F.when(key % 13 != 0, F.col("qty") * 40).alias("input_tokens"),
        (F.col("qty") * 90).alias("output_tokens"),
        tokens.alias("cache_creation_tokens"),
        (tokens * turns * (1 + key % 4)).alias("cache_read_tokens"),
        F.when(key % 17 != 0, F.col("n_lines") * turns).alias("api_call_count"))


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with their token estimate, the tokens before them and the user turns up to them.

    The running totals are built in two steps, within a block of turns and over the blocks of a
    conversation, so that no task has to hold a whole long conversation.
    """
    # One shuffle of the turns, with estimates in place of the texts, serves both uses below: all
    # its columns are used on either side, so neither is pruned to another plan.
    opens = F.col("role") == "user"
    turns = (spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role",
        F.floor((F.length("text") + 3) / 4.0).alias("tok"),
        F.floor(F.col("turn") / TURN_BLOCK).alias("block"))
        .where(F.col("conv_id").isNotNull() & F.col("block").isNotNull())
        .repartition("conv_id", "block"))
    earlier = (Window.partitionBy("conv_id").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = (turns.groupBy("conv_id", "block")
              .agg(F.sum("tok").alias("tok"), F.count_if(opens).alias("opens"),
                   F.max("turn").alias("last"))
              .select("conv_id", "block", "last",
                      _or_zero(F.sum("tok").over(earlier)).alias("tok_before"),
                      _or_zero(F.sum("opens").over(earlier)).alias("opens_before")))
    inside = (Window.partitionBy("conv_id", "block").orderBy("turn")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (turns.join(starts, ["conv_id", "block"]).where(F.col("turn") <= F.col("last"))
            .withColumn("ctx", F.col("tok_before") + F.sum("tok").over(inside) - F.col("tok"))
            .withColumn("opened", F.col("opens_before") + F.sum(opens.cast("long")).over(inside))
            .select("conv_id", "turn", "role", "tok", "ctx", "opened"))


def conversation_pieces(turns: DataFrame) -> DataFrame:
    """Supplied pieces: one opens at every user turn. With the counts of their turns; assistant
    turns are the calls."""
    piece = F.greatest(F.col("opened"), F.lit(1).cast("long")) - 1
    reply = F.col("role") == "assistant"
    return (turns.groupBy(F.col("conv_id").alias("session_id"), piece.alias("chunk_idx"))
            .agg(F.sum("tok").alias("height"),
                 _sum_where(~reply, F.col("tok")).alias("input_tokens"),
                 _sum_where(reply, F.col("tok")).alias("output_tokens"),
                 _sum_where(reply, F.col("ctx")).alias("cache_read_tokens"),
                 F.count_if(reply).alias("api_call_count")))


def conversation_sessions(pieces: DataFrame) -> DataFrame:
    """The session rows that go with the pieces: sums of their counts."""
    return (pieces.groupBy("session_id")
            .agg(F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"),
                 F.sum("height").alias("cache_creation_tokens"),
                 F.sum("cache_read_tokens").alias("cache_read_tokens"),
                 F.sum("api_call_count").alias("api_call_count")))


def conversation_calls(turns: DataFrame) -> DataFrame:
    """Transcript rows: assistant turns are the calls, other turns add the tokens they hand in."""
    reply = F.col("role") == "assistant"
    return turns.select(
        F.col("conv_id").alias("session_id"), F.lit("Claude Code").alias("agent"),
        F.when(~reply, F.col("tok")).alias("input_tokens"),
        F.when(reply, F.col("tok")).alias("output_tokens"),
        F.col("tok").alias("cache_creation_tokens"),
        F.when(reply, F.col("ctx")).alias("cache_read_tokens"), reply.alias("is_call"))


def event_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Timed calls: every event of a user is one, of a size that follows its value."""
    tokens = F.floor(F.col("value") * 100)
    agent = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("agent-"), F.col("event_type")))
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").alias("session_id"), agent.alias("agent"), _utc("ts").alias("ts"),
        F.when(F.col("event_id") % 7 != 0, tokens).alias("input_tokens"),
        (tokens * 2).alias("output_tokens"), tokens.alias("cache_creation_tokens"),
        (tokens * 9).alias("cache_read_tokens"))


def event_work(spark: SparkSession, folder: str) -> DataFrame:
    """Timed work: clicks and views are a person's, the rest is the agent's and lasts a minute for each
    unit of its value."""
    micros = F.unix_micros(_utc("ts")) + F.floor(F.col("value") * 60_000_000)
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").alias("session_id"), _utc("ts").alias("ts"),
        F.timestamp_micros(micros).alias("ended"),
        F.col("event_type").isin("click", "view").alias("human"))


def symbol_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A simple detector of bad documents, the share of symbols in the text, beside their labels."""
    text = F.col("text")
    rest = F.translate(text, "#*$%&|<>", "")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", ((F.length(text) - F.length(rest)) / F.nullif(F.length(text), F.lit(0)))
        .alias("score"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(
        "doc_id", (1 - F.col("quality")).alias("label"))
    return documents.join(labels, "doc_id")


def _utc(name: str) -> Column:
    """A timestamp without zone as the moment it names in UTC, in any session's zone."""
    return F.concat(F.col(name).cast("string"), F.lit("Z")).cast("timestamp")


def _nearest(value: Column) -> Column:
    """Nearest whole number of a positive value; ``round`` would go through decimals."""
    return F.floor(value + 0.5)


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def _sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast("long")))
