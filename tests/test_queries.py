import pytest

from strandline.plans import registry
from tests.checking import assert_same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, data_dir, name):
    assert_same(registry.queries()[name], registry.oracle_sql()[name], spark, data_dir)


def test_entry_runs(spark, data_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_bbox_filter_reaches_the_scan(spark, tmp_path):
    from strandline.operators import catalogue

    spark.range(10).selectExpr("id", "id + 0.0D as xmin", "id + 1.0D as xmax", "id + 0.0D as ymin", "id + 1.0D as ymax").write.parquet(str(tmp_path / "f"))
    plan = spark.read.parquet(str(tmp_path / "f")).where(catalogue.overlaps(2, 2, 3, 3))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(xmin,3.0)" in plan.split("PushedFilters")[1]
