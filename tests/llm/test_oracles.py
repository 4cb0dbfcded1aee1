import pytest
from oracle import DATA, agree

from rangelake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    agree(spark, QUERIES[name], ORACLE_SQL[name])
