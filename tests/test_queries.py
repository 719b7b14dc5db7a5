"""Every registered query of the catalog engine against DuckDB."""

import pytest
from oracle import duck, spark_rows

from brindle import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = spark_rows(Q.queries()[name](spark, FOLDER))
    sql = Q.oracle_sql().get(name)
    if sql:
        assert got == duck(sql, FOLDER)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["kind", "name_key", "kind_rank", "stage", "name_ru"] and df.count() >= 0
