"""Online service loop: every micro-batch is scored with the latest saved model; arrived labels refit it on schedule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import new_path


class RefitService:
    """foreachBatch sink for rows with ``kind`` 1 (to score) and 0 (labels).

    Each batch adds one row of sums of products to the training table; a ridge refit adds these rows up, so it never rereads
    history. Models are saved as one small row per refit and the latest is loaded for each batch, so a restarted service goes on
    where it was. Missing inputs are replaced by the mean of the training inputs: no run is left out. A retried batch replaces itself.
    """

    def __init__(self, spark, cols: list[str], label: str, every: int = 1, least: int = 60, ridge: float = 0.1, folder: str | None = None):
        self.spark, self.cols, self.label, self.every, self.least, self.ridge = spark, cols, label, every, least, ridge
        base = folder or new_path(spark, "service")
        self.sums, self.out, self.models = f"{base}/sums", f"{base}/scored", f"{base}/models"
        self.saved = "intercept double, weights array<double>, means array<double>, n double, refit long"

    def model(self):
        """The latest saved model, or None."""
        # each refit writes its own folder, listed by the partition column
        seen = self._table(self.models, self.saved)
        return seen.orderBy(F.desc("refit")).first() if seen is not None else None

    def _table(self, path: str, schema: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def _score(self, runs: DataFrame) -> DataFrame:
        m = self.model()
        if m is None:
            return runs.withColumn("pred", F.lit(None).cast("double"))
        pred = F.lit(m["intercept"])
        for c, w, mean in zip(self.cols, m["weights"], m["means"]):
            pred = pred + F.lit(w) * (F.coalesce(F.col(c), F.lit(mean)) - F.lit(mean))
        return runs.withColumn("pred", pred)

    def _moments(self, labelled: DataFrame) -> DataFrame:
        v = [*[F.col(c) for c in self.cols], F.col(self.label)]
        whole = labelled.dropna(subset=[*self.cols, self.label])
        return whole.agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in v]).alias("s"),
                         F.array(*[F.coalesce(F.sum(x * y), F.lit(0.0)) for x in v for y in v]).alias("ss"))

    def _refit(self, number: int) -> None:
        k = len(self.cols) + 1
        sums = self._table(self.sums, "n double, s array<double>, ss array<double>")
        row = sums.agg(F.sum("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(k)]), F.array(*[F.sum(F.get("ss", F.lit(i))) for i in range(k * k)])).first()
        n, s, ss = row[0] or 0.0, np.array(row[1], float), np.array(row[2], float).reshape(k, k)
        if n < self.least:
            return
        cov = ss / n - np.outer(s, s) / n**2
        weights = np.linalg.solve(cov[:-1, :-1] + self.ridge * np.diag(np.maximum(np.diag(cov)[:-1], 1e-12)), cov[:-1, -1])
        made = [(float(s[-1] / n), weights.tolist(), (s[:-1] / n).tolist(), n, number)]
        self.spark.createDataFrame(made, self.saved).coalesce(1).write.mode("overwrite").parquet(f"{self.models}/batch={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            self._score(batch.filter("kind = 1")).write.mode("overwrite").parquet(f"{self.out}/batch={number}")
            self._moments(batch.filter("kind = 0")).write.mode("overwrite").parquet(f"{self.sums}/batch={number}")
            if number % self.every == 0:
                self._refit(number)
        finally:
            batch.unpersist()

    def scored(self, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields]).add("pred", "double").add("batch", "long")).parquet(self.out)
