"""Kernel means of dense labels come from blocks of time: the rows meet no cells by a join."""

from pyspark.sql import functions as F

from fleetspark.operators import arrivals as A


def test_near_rows_do_not_meet_cells_by_a_join(spark, monkeypatch):
    def cells(*_):
        raise AssertionError("a row was copied for each cell that it meets")

    monkeypatch.setattr(A, "_kernels_of_cells", cells)
    df = spark.range(400).select(F.col("id").alias("run_id"), F.lit("a").alias("regime"), (F.col("id") * 60.0).alias("t_end"), (F.col("id") % 7.0).alias("y"), (F.col("id") % 3 > 0).alias("measured"))
    out = A.two_sided(df, df.filter("measured"), ["regime"], A.Clock(delay=3600.0, lag=6 * 3600.0), dense_times=0.0)
    assert out.filter("K025 is null or K4 is null").count() == 0
