import pytest
from compare import same_rows

from chronopix import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, name):
    same_rows(spark, plans.queries()[name], plans.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_confusion_on_the_border_of_two_classes(spark, tmp_path):
    """At a price of 22080 the index of the brighter band is 0.4 or next to it, by the order of steps."""
    row = "1L AS l_orderkey, 'R' AS l_returnflag, 1L AS l_suppkey, 10.0D AS l_quantity, 0.05D AS l_discount, 0.02D AS l_tax"
    spark.sql(f"SELECT {row}, explode(array(22080.0D, 4416.0D, 12000.0D)) AS l_extendedprice").toPandas().to_parquet(tmp_path / "lineitem.parquet")
    same_rows(spark, plans.queries()["a15_confusion"], plans.oracle_sql()["a15_confusion"], str(tmp_path))
