import pytest

from meridia.plans import registry
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert not difference(df, sql, SF)
