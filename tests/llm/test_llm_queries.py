"""Every query of these operators over whole small tables, beside its SQL."""

import pytest

from arborspark.llm.queries import oracle_sql, queries
from compare import canonical, duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir).toPandas()
    want = duck(sf_dir).execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in queries()] == [f"op{n}" for n in range(1, 11)]
