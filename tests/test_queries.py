import pytest

from relspark import queries as Q

from .compare import DATA, check


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_duckdb(spark, name):
    check(spark, Q.queries()[name], Q.oracle_sql()[name])


def test_nested_interface(spark):
    rows = Q.interface_nested(spark, f"{DATA}/sf0.001").collect()
    assert rows and all(r["nation"]["id"] is not None and isinstance(r["nation"]["region"], int) for r in rows)
