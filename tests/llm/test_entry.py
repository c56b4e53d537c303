import __spark_entry__
from pageline.llm.queries import ORACLES, QUERIES


def test_all_queries_of_the_subpackage_are_registered():
    assert __spark_entry__._missing is None
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13
