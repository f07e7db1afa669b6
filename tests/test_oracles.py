import pytest

from conftest import values
from lectern.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        assert values(found) == values(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(found)
