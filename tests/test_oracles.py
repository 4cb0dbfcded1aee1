import pytest
from oracle import DATA, agree

from __spark_entry__ import JSON_QUERIES as QUERIES
from __spark_entry__ import JSON_SQL as ORACLE_SQL
from rangelake.plans.queries import KINDS, docs


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, name):
    agree(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("kind", sorted(KINDS))
def test_documents_hold_whole_tables(spark, kind):
    table, _, key, *_ = KINDS[kind]
    keys = spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().count()
    assert docs(spark, str(DATA), kind).count() == keys


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name, table, more", [("scan_multi", "orders", ("o_custkey", 2)), ("path_nested", "orders", None), ("path_index", "orders", None), ("scan_nested_depth", "events", None)])
def test_scans_find_each_row(spark, name, table, more):
    rows = spark.read.parquet(f"{DATA}/{table}.parquet")
    assert QUERIES[name](spark, str(DATA)).count() == rows.count() + (more[1] * rows.select(more[0]).distinct().count() if more else 0)
