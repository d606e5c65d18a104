"""A saved pipeline scores alike in the session that fitted it, after a reload, and in another process."""

import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetspark.operators import ml

from conftest import DATA

SCHEMA = "id long, a double, b int, c double, y double"
OTHER = """
import json, sys
from pyspark.sql import SparkSession
from fleetspark.operators import ml
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.read.parquet(sys.argv[1])
print("RESULT" + json.dumps({r["id"]: r["pred"] for r in ml.score_saved(df, sys.argv[2]).collect()}))
"""


def made(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.random(), r.randrange(5)
        rows.append((i, a if r.random() > 0.1 else None, b, None, 50 * a + 10 * b - 20 if r.random() > 0.05 else None))
    return rows


def test_scores_are_equal_in_a_second_session(spark, tmp_path):
    df = spark.createDataFrame(made(300), SCHEMA)
    path, table = str(tmp_path / "model"), str(tmp_path / "table")
    assert ml.fit_saved(df, ["a", "b", "c"], "y", 40.0, path) == ["a", "b"]
    here = {r["id"]: r["pred"] for r in ml.score_saved(df, path).collect()}
    assert len(here) == 300 and all(0 <= v <= 40 for v in here.values()) and len(set(here.values())) > 20
    assert min(here.values()) == 0.0  # the clip is part of what was saved
    df.write.parquet(table)
    done = subprocess.run([sys.executable, "-c", OTHER, table, path], capture_output=True, text=True, timeout=240, check=True)
    there = json.loads(next(x for x in done.stdout.splitlines() if x.startswith("RESULT"))[6:])
    assert {int(k): v for k, v in there.items()} == here


def test_columns_of_the_table_stay(spark, tmp_path):
    df = spark.createDataFrame(made(80), SCHEMA).withColumn("pred", F.lit("old")).withColumn("features", F.lit(1))
    ml.fit_saved(df, ["a", "b"], "y", 40.0, str(tmp_path / "m"))
    out = ml.score_saved(df.drop("y"), str(tmp_path / "m"))
    assert out.columns == ["id", "a", "b", "c", "features", "pred"] and dict(out.dtypes)["pred"] == "double"
    with pytest.raises(ValueError):
        ml.fit_saved(df.filter("y IS NULL"), ["a"], "y", 1.0, str(tmp_path / "n"))


def test_query_scores_every_later_row(spark):
    out = entry.queries()["saved_model_scores"](spark, DATA).collect()
    assert out and len({(r["tool"], r["id"]) for r in out}) == len(out)
    for k in range(3):
        values = [r[f"pred_{k}"] for r in out if r[f"pred_{k}"] is not None]
        assert all(0 <= v <= 259200 for v in values)
