"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import expected, rows

from gridmill.queries import catalogue3

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue3.QUERIES))
def test_query(spark, name):
    got = catalogue3.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue3.ORACLE_SQL:
        want = expected(catalogue3.ORACLE_SQL[name], FOLDER)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
