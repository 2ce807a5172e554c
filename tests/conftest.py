import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_sessions(spark):
    """Build a sessions frame from (input, output, written, read, calls) rows."""
    from tests.brute import FIELDS
    from tokentariff.sources import SESSION_SCHEMA

    def make(rows, agent="Claude Code"):
        table = [(i, agent, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(table, SESSION_SCHEMA), [dict(zip(FIELDS, r)) for r in table]
    return make


@pytest.fixture(scope="session")
def random_sessions(make_sessions):
    """Sessions of all shapes: whole, split once or many times, without calls or cache reads."""
    import random
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        calls = rng.choice([0, 1, 2, 5, 40, 300])
        top = rng.choice([0, 1_000, 99_999, 100_000, 100_001, 150_000, 200_000, 450_000, 3_333_333])
        rows.append((rng.randrange(50_000), rng.randrange(90_000), rng.randrange(400_000),
                     top * max(calls, 1) // 2, calls))
    return make_sessions(rows)
