"""Identities and tolerant comparison of loaded rows."""

import pytest
from pyspark.sql import functions as F

from boundlab.sources import loaders


def test_row_label(spark):
    both = spark.createDataFrame([(7, "x")], "activity_id long, row_id string")
    assert both.select(loaders.row_label(both).alias("l")).first()["l"] == "x"
    one = both.drop("row_id")
    assert one.select(loaders.row_label(one).alias("l")).first()["l"] == "7"
    with pytest.raises(ValueError, match="neither"):
        loaders.row_label(one.select(F.lit(1).alias("other")))


@pytest.mark.parametrize("value", [0.0, 0.05, -3.0, 1e6])
def test_close_to(spark, value):
    near = 1e-8 + 1e-5 * abs(value)
    rows = spark.createDataFrame([(value,), (value + 0.9 * near,), (value - 0.9 * near,), (value + 1.2 * near,), (None,)], "v double")
    assert [r["c"] for r in rows.select(loaders.close_to(F.col("v"), value).alias("c")).collect()] == [True, True, True, False, None]
