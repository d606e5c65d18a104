"""The pairs of a local line are added up as they come, and lookups carry only the columns a query uses."""

import __spark_entry__ as entry
from fleetspark.operators.neighbors import local_line
from pyspark.sql import functions as F

from conftest import DATA


def test_pairs_are_not_sorted(spark):
    df = spark.range(500).select(F.col("id").alias("run_id"), F.lit("a").alias("k"), (F.col("id") * 60.0).alias("t"), (F.col("id") % 7.0).alias("y"))
    out = local_line(df, df, ["k"], "t", "run_id", "y", 6.0, F.lit(True), "L_")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("L_est is null").count() == 0


def test_lookups_leave_out_columns_nobody_reads(spark):
    for name in ("nearest_in_time", "sequence_neighbors"):
        assert "o_custkey" not in entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
