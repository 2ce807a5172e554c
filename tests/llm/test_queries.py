"""Registered queries against their SQL, and the pipeline against a plain Python version."""

import pytest

from tests.conftest import DATA
from tests.oracle import compare, connect
from tokentariff.llm import queries as llm


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    con = connect(folder)
    assert compare(llm.queries()[name](spark, folder), con, llm.oracle_sql()[name])[:3] == []


def test_queries_are_registered():
    import __spark_entry__
    import corpus_pipeline
    assert set(llm.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
