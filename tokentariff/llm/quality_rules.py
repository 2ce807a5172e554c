"""Quality rules: statistics of a text, and lines that many documents of a host share.

Every line is normalised (blanks at the ends cut, lower-cased) and hashed; hashes and lengths are
written to the shared folder once. What a document loses is summed from them, so a caller that doesn't
take the cleaned texts shuffles none. For every host the distinct documents that hold a line are counted; exact
copies of a text count as one document, since copies are for deduplication to remove. Lines found
in more than ``limit`` distinct texts of their host are removed from the text that is returned, and a
document is depleted, and rejected, if fewer than ``least_left`` percent of its normalised
characters remain in it.

Null and empty texts have no words and fail the base rules. A null host is a host of its own.
Repeated rows get equal results. A line or host of very many rows is summed in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentariff.llm.text import (BLANK_CLASS, BLANKS, let, packed, unpacked, without,
                                  work_folder, written)

SYMBOLS = "#*$%&|<>"
LIMIT = 10
LEAST_LEFT = 50
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
QUALITY = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "chars_left_percent", "depleted", "kept")


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_CLASS + "+", -1), lambda w: w != "")


PLACE_BITS = 24
HASH = -(1 << PLACE_BITS)
PLACE = (1 << PLACE_BITS) - 1


def _swept(places: Column, size: int) -> Column:
    """Words under windows that start at these rising places."""
    gaps = F.transform(places, lambda p, i: F.least(
        F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def repeated_words(documents: DataFrame, size: int = 3) -> DataFrame:
    """Replace the array ``_words`` by n_repeat_words: the words inside windows of ``size`` words
    that occur twice or more in the array.

    Windows are sorted as longs, a hash above a place, and neighbours with the same hash are
    compared word by word. Should such a comparison fail, or places need more bits, the windows of
    that text are sorted as strings instead; the result is exact either way.
    """
    words, n = F.col("_words"), F.size("_words")
    starts = F.slice(words, F.lit(1), F.greatest(n - size + 1, F.lit(0)))

    def window(first: Column, i: Column) -> list[Column]:
        return [first, *[F.get(words, i + k) for k in range(1, size)]]

    packed = F.sort_array(F.transform(starts, lambda w, i: F.xxhash64(*window(w, i)).bitwiseAND(
        F.lit(HASH)).bitwiseOR(i.cast("long"))))
    sorted_ = documents.withColumn("_packed", packed)
    at = F.col("_packed")
    pairs = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))), lambda k: F.coalesce(
            F.get(at, k).bitwiseXOR(F.get(at, k - 1)).bitwiseAND(F.lit(HASH)) == 0, F.lit(False)))
    paired = sorted_.withColumn("_pairs", F.transform(pairs, lambda k: F.struct(
        F.get(at, k - 1).bitwiseAND(F.lit(PLACE)).cast("int").alias("a"),
        F.get(at, k).bitwiseAND(F.lit(PLACE)).cast("int").alias("b"))))
    sure = F.forall("_pairs", lambda p: F.forall(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda k: F.get(words, p["a"] + k) == F.get(words, p["b"] + k)))
    quick = F.sort_array(F.array_distinct(F.concat(
        F.transform("_pairs", lambda p: p["a"]), F.transform("_pairs", lambda p: p["b"]))))
    strings = F.array_sort(F.transform(starts, lambda w, i: F.struct(
        F.concat_ws(" ", *window(w, i)).alias("s"), i.alias("i"))))
    exact = let(strings, lambda all_: F.sort_array(F.transform(F.filter(all_, lambda x, k: F.coalesce(
        x["s"] == F.get(all_, k + 1)["s"], F.lit(False)) | F.coalesce(
        x["s"] == F.when(k > 0, F.get(all_, k - 1))["s"], F.lit(False))), lambda x: x["i"])))
    placed = paired.withColumn("_places", F.when((n < PLACE) & sure, quick).otherwise(exact))
    return placed.withColumn("n_repeat_words", _swept(F.col("_places"), size).cast("long")).drop(
        "_words", "_packed", "_pairs", "_places")


def base_rules(documents: DataFrame) -> DataFrame:
    """The documents without their texts, with n_words, four statistics and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    counted = documents.select(
        *rest, words_in(text).alias("_words"),
        F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        .alias("n_dup_lines")).withColumn("n_words", F.size("_words").cast("long"))
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return repeated_words(counted).withColumn("base_failed", (n < MIN_WORDS) | (
        repeated * 100 > n * MAX_REPEATED_PERCENT))


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def host_lines(documents: DataFrame, host: str) -> DataFrame:
    """(doc, text_id, host, place, hash, chars) of every line that isn't blank."""
    return (documents.select(
        F.col("doc_id").alias("doc"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"),
        F.col(host).alias("host"),
        F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
        .select("doc", "text_id", "host", "place", normal_line(F.col("line")).alias("line"))
        .where(F.col("line") != "")
        .select("doc", "text_id", "host", "place", F.unhex(F.md5("line")).alias("hash"),
                F.length("line").alias("chars")))


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(_host, _hash) of the lines found in more than ``limit`` distinct texts of the host."""
    once = lines.groupBy("host", "hash", "text_id").agg(F.lit(1).alias("one"))
    return (once.groupBy("host", "hash").agg(F.sum("one").alias("n_docs"))
            .where(F.col("n_docs") > limit)
            .select(F.col("host").alias("_host"), F.col("hash").alias("_hash")))


def losses(lines: DataFrame, often: DataFrame) -> DataFrame:
    """(_doc, _text, _of, _chars, _gone, _places) of the texts that lose lines: their characters, those that go
    and the places of the lines that go. Rows of the same id, host and text have the same places."""
    gone = F.col("_hash").isNotNull()
    return (lines.join(often, F.col("host").eqNullSafe(F.col("_host"))
                       & (F.col("hash") == F.col("_hash")), "left")
            .groupBy(F.col("doc").alias("_doc"), F.col("text_id").alias("_text"),
                     F.col("host").alias("_of"))
            .agg(F.sum("chars").alias("_chars"),
                 F.sum(F.when(gone, F.col("chars")).otherwise(0)).alias("_gone"),
                 F.sort_array(F.collect_set(F.when(gone, F.col("place")))).alias("_places"))
            .where(F.col("_gone") > 0))


def quality_rules(documents: DataFrame, host: str = "source", limit: int = LIMIT,
                  least_left: int = LEAST_LEFT) -> DataFrame:
    """All columns, ``text`` without the frequent lines, with the base statistics of the text as it
    was, chars_left_percent, depleted and kept. A text that loses no line stays as it is."""
    columns = documents.columns
    needed = tuple(dict.fromkeys(("doc_id", "text", host)))
    documents = packed(documents, *needed)
    lines = written(host_lines(documents, host), work_folder(documents.sparkSession, "lines"))
    often = frequent_lines(lines, limit)
    base = base_rules(documents.withColumns({
        "_md5": F.unhex(F.md5(F.coalesce("text", F.lit("")))), "_whole": F.col("text")}))
    cut = base.join(
        losses(lines, often), F.col("doc_id").eqNullSafe(F.col("_doc"))
        & (F.col("_md5") == F.col("_text")) & F.col(f"`{host}`").eqNullSafe(F.col("_of")), "left")
    percent = F.coalesce(100.0 * (F.col("_chars") - F.col("_gone")) / F.col("_chars"), F.lit(100.0))
    split = F.split("_whole", "\n", -1)
    # The kept lines lie between the places; -1 and the number of lines close both ends.
    ends = F.concat(F.array(F.lit(-1)), F.col("_places"), F.array(F.size(split)))
    kept_lines = let(split, lambda lines: let(ends, lambda at: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.slice(
            lines, F.get(at, k - 1) + 2, F.get(at, k) - F.get(at, k - 1) - 1)))))
    text = F.when(F.col("_places").isNotNull(), F.array_join(kept_lines, "\n")).otherwise(
        F.col("_whole"))
    before = [text.alias(c) if c == "text" else column for c, column in zip(
        [c for c in columns if c.lower() not in QUALITY], unpacked(
            columns, needed, **{c: F.lit(None) for c in QUALITY}))]
    return cut.select(*before, *[F.col(c) for c in QUALITY[:6]], percent.alias("chars_left_percent"),
                      (percent < least_left).alias("depleted"),
                      (~F.col("base_failed") & (percent >= least_left)).alias("kept"))
