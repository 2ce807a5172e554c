"""Reading, checking and staging the sessions table, and the plans on top of it."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import tokentariff as tt
from tests.conftest import DATA
from tokentariff.sources import SESSION_SCHEMA, shared_folder
from tokentariff.sources import samples


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sessions") / "sessions.parquet")
    wide = samples.order_sessions(spark, f"{DATA}/sf0.001").withColumn("notes", F.lit("long text"))
    wide.repartition(3).write.parquet(path)
    return path


def _plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_load(spark, table):
    sessions = tt.load_sessions(spark, table)
    assert sessions.columns == SESSION_SCHEMA.fieldNames()
    assert sessions.count() == 900
    assert {r["agent"] for r in sessions.select("agent").distinct().collect()} == {
        "Claude Code", "claude-code"}
    assert tt.load_sessions(spark, table, agents=["CLAUDE CODE"]).count() == 300


def test_ids_and_counts_of_other_types(spark):
    raw = spark.createDataFrame(
        [("u-1", "Claude Code", 1, 2.0, 3, None, 5)],
        "sid string, agent string, input_tokens int, output_tokens double,"
        "cache_creation_tokens int, cache_read_tokens int, api_call_count int")
    sessions = tt.select_sessions(raw, id_column="sid")
    assert tuple(sessions.first()) == ("u-1", "Claude Code", 1, 2, 3, 0, 5)
    assert {t for _, t in sessions.dtypes[2:]} == {"bigint"}


@pytest.mark.parametrize("wrong", [1.9, float("nan"), 1e30])
def test_counts_that_are_not_whole_are_refused(spark, wrong):
    raw = spark.createDataFrame(
        [(1, "claude-code", 1, wrong, 3, None, 5)],
        "session_id long, agent string, input_tokens int, output_tokens double,"
        "cache_creation_tokens int, cache_read_tokens int, api_call_count int")
    with pytest.raises(Exception, match="output_tokens must hold whole numbers"):
        tt.select_sessions(raw).collect()


def test_wrong_tables_are_refused(spark):
    with pytest.raises(ValueError, match="agent"):
        tt.select_sessions(spark.range(3).withColumnRenamed("id", "session_id"))
    good = spark.createDataFrame([], SESSION_SCHEMA)
    with pytest.raises(ValueError, match="output_tokens"):
        tt.select_sessions(good.withColumn("output_tokens", F.lit("many")))


def test_scan_reads_only_what_is_needed(spark, table):
    plan = _plan(tt.split_grid(tt.load_sessions(spark, table)))
    assert "PushedFilters: [In(agent, [Claude Code,claude-code])]" in plan
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "notes" not in schema and "session_id" not in schema
    # The sums by threshold, and their few rows into one partition; each in the tree and its detail.
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 4


def test_reports_shuffle_nothing_more_than_the_grid(spark, table):
    grid = tt.split_grid(tt.load_sessions(spark, table))
    for report in (tt.savings_table, tt.overhead_breakdown, tt.threshold_sweep,
                   tt.best_threshold):
        assert _plan(report(grid)).count("Exchange") == _plan(grid).count("Exchange")


def test_narrow_jobs_do_not_shuffle(spark, table):
    sessions = tt.load_sessions(spark, table)
    for frame in (tt.session_cost(sessions), tt.session_split(sessions),
                  tt.chunk_prices(sessions, 100_000, compact=True)):
        assert "Exchange" not in _plan(frame)


def test_no_python_in_the_plans(spark, table):
    sessions = tt.load_sessions(spark, table)
    pieces = tt.chunk_prices(sessions, 100_000)
    for frame in (tt.split_grid(sessions), pieces,
                  tt.price_supplied_chunks(sessions, pieces, 400, 0.1)):
        plan = _plan(frame)
        assert "Python" not in plan and "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_staged_is_read_back_and_removed(spark, table):
    sessions = tt.load_sessions(spark, table)
    with tt.staged(sessions) as copy:
        assert copy.dtypes == sessions.dtypes
        assert sorted(copy.collect()) == sorted(sessions.collect())
        path = os.path.dirname(urlparse(copy.inputFiles()[0]).path)
        assert path.startswith(shared_folder(spark))
    assert not os.path.exists(path)


def test_turn_totals_do_not_depend_on_the_block(spark, monkeypatch):
    folder = f"{DATA}/sf0.001"
    whole = sorted(samples.conversation_turns(spark, folder).collect())
    monkeypatch.setattr(samples, "TURN_BLOCK", 2)
    assert sorted(samples.conversation_turns(spark, folder).collect()) == whole


def test_conversations_are_scanned_once(spark):
    pieces = samples.conversation_pieces(samples.conversation_turns(spark, f"{DATA}/sf0.001"))
    pieces.collect()
    plan = pieces._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1


def test_reports_print_every_row(spark, table, capsys):
    from tokentariff.__main__ import main
    thresholds = [str(t) for t in range(50_000, 50_000 + 300)]
    main([table, "--thresholds", *thresholds, "--sweep", "100000"])
    printed = capsys.readouterr().out
    assert all(f"|{t} " in printed for t in thresholds)


def test_study_reads_sessions_once_for_all_but_the_distribution(spark, table):
    study = tt.run_study(tt.load_sessions(spark, table))
    want = tt.corpus_baseline(tt.session_cost(tt.load_sessions(spark, table)))
    assert tuple(study.baseline.first()) == pytest.approx(tuple(want.first()))
    assert "InMemoryTableScan" in _plan(study.baseline)
    assert "InMemoryTableScan" in _plan(study.sweep)
    study.totals.unpersist()


def test_stream_gives_the_same_as_a_read(spark, table, tmp_path):
    want = tt.load_sessions(spark, table)
    stream = tt.stream_sessions(
        spark, table, schema=spark.read.parquet(table).schema, maxFilesPerTrigger=1)

    def drain(frame, name, mode):
        query = (frame.writeStream.outputMode(mode).format("memory").queryName(name)
                 .option("checkpointLocation", str(tmp_path / name))
                 .trigger(availableNow=True).start())
        query.awaitTermination(120)
        return spark.table(name)

    got = drain(tt.session_split(stream, [100_000], [0.1]), "split_stream", "append")
    assert sorted(got.collect(), key=str) == sorted(
        tt.session_split(want, [100_000], [0.1]).collect(), key=str)
    grid = drain(tt.split_grid(stream), "grid_stream", "complete").orderBy("threshold", "alpha")
    batch = tt.split_grid(want).orderBy("threshold", "alpha")
    for g, w in zip(grid.collect(), batch.collect(), strict=True):
        assert tuple(g) == pytest.approx(tuple(w))
