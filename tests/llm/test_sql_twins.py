import pytest

import __spark_entry__ as entry
from irforge.llm.registry import LLM_QUERIES, LLM_SQL
from oracle_check import compare, duck
from tests.conftest import SF_SMALL


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries()) and set(LLM_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_duckdb_twin(spark, name):
    line, ok = compare(spark, name, LLM_QUERIES[name], LLM_SQL[name], SF_SMALL, duck(SF_SMALL))
    assert ok, line


def test_rows_only_operators_are_known():
    import corpus_pipeline

    assert set(LLM_QUERIES) - set(LLM_SQL) == {q for q in LLM_QUERIES if int(q[2:].split("_")[0]) in (2, 3, 4, 7, 8, 9, 10, 13)}
    assert corpus_pipeline.ORACLE_SQL is None
