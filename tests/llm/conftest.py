import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for their own columns.
CLASHING = ("n_words", "spans", "items", "score", "predicted", "hash", "key", "id", "n", "host",
            "component", "size", "taken", "target", "row", "doc", "place", "path", "rule", "_row",
            "_given", "_doc", "_key", "rows", "level", "weight")

SENTENCE = "the quick brown fox jumps over a lazy dog while many other animals look on in wonder"


def edge_rows():
    """Nulls in any column, empty and blank texts, a long one, ties and repeated rows."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    shared = "This line of well over forty characters stands in many of the documents. "
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
        (None, SENTENCE, "en", "a", 5), (None, None, None, None, None),
        (5, long, "en", "a", len(long)), (6, SENTENCE, "en", "b", 1), (6, SENTENCE, "en", "b", 1),
        (7, SENTENCE, "en", None, 1), (8, SENTENCE.upper(), "en", "c", 1), (9, "one", "en", "c", 3),
        (10, "x\ny\n\nz\n", "de", "c", 7), (11, "emoji \U0001F600 and éß ​ end", "de", "c", 9),
        (12, "same same same same same same same same", "de", "c", 9),
    ]
    return rows + [(20 + i, f"{shared}\nown line {i}\n{shared.upper()}", "fr", "a", 1)
                   for i in range(8)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with extra columns that bear the operators' own names."""
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(edge_rows(), DOCUMENTS)
    return frame.withColumns({name: F.lit(f"extra {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
