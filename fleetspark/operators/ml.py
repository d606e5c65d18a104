"""Preprocessing and Spark ML members: classifiers, regressors, screening, clusters, meta-learners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, join_keys
from .quantiles import quantiles

SEED = 7


# -- preprocessing --------------------------------------------------------------------------------------
def standardise(df: DataFrame, cols: list[str], fit: Column) -> DataFrame:
    """(x - mean) / deviation from the fit rows only; nulls become 0."""
    row = df.filter(fit).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = join_keys(df, row, [])
    z = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9), F.lit(0.0)) for c in cols}
    return x.withColumns(z).drop(*[f"_{n}_{c}" for c in cols for n in ("m", "s")])


def impute_median(df: DataFrame, cols: list[str], fit: Column) -> DataFrame:
    """Nulls replaced by the fit rows' median, with an ``{col}_missing`` flag."""
    x = join_keys(df, quantiles(df.filter(fit), [], cols, {"med": 0.5}), [])
    flags = {f"{c}_missing": F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in cols}
    x = x.withColumns(flags)
    return x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med")) for c in cols}).drop(*[f"{c}_med" for c in cols])


def normal_scores(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Quantile-normal transform: inverse normal of the mid-rank share, from counts of distinct values."""
    per = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_k"))
    o = Ordered(per, keys, col).running({"_cum": ("sum", F.col("_k"))})
    total = per.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    r = join_keys(o.result(), total, keys)
    p = (F.col("_cum") - F.col("_k") / 2) / F.col("_n")
    return join_keys(df, r.select(*keys, col, probit(p).alias(out)), [*keys, col])


def probit(p: Column) -> Column:
    """Inverse normal distribution (Acklam's rational approximation, error below 1.2e-9)."""
    # fixed values: numerator and denominator coefficients of the central and tail parts
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]

    def poly(cs, x):
        out = F.lit(0.0)
        for k in cs:
            out = out * x + k
        return out

    q = p - 0.5
    tail = lambda u: poly(c, u) / poly(d, u)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(q * poly(a, q * q) / poly(b, q * q))


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    filled = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=[f"_x_{c}" for c in cols], outputCol="features").transform(filled)


def _tidy(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop("features", "rawPrediction", *[f"_x_{c}" for c in cols])


# -- members ----------------------------------------------------------------------------------------------
def fit_class_probabilities(train: DataFrame, test: DataFrame, cols: list[str], label: str, weight: str, trees: int = 20,
                            depth: int = 5, out: str = "proba") -> DataFrame:
    """Weighted multiclass forest; ``proba`` is an array over classes 0..max(label)."""
    model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth,
                                   seed=SEED).fit(_assembled(train.withColumn(label, F.col(label).cast("double")), cols))
    x = model.transform(_assembled(test, cols))
    return _tidy(x.withColumn(out, vector_to_array("probability")).drop("probability", "prediction"), cols)


def fit_regressor_by_folds(train: DataFrame, test: DataFrame, cols: list[str], label: str, fold: str, cap: float,
                           grid: dict[str, list] | None = None, out: str = "pred") -> DataFrame:
    """Boosted regressor on a capped label, parameters chosen over whole-tool folds, predictions clipped to [0, cap].

    Without any label the predictions are null.
    """
    data = _assembled(train.filter(F.col(label).isNotNull()).withColumns({label: F.least(F.col(label), F.lit(float(cap))), fold: F.col(fold).cast("int")}), cols)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, maxDepth=3, seed=SEED, predictionCol=out)
    pg = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [2, 3]}).items():
        pg = pg.addGrid(getattr(gbt, name), values)
    last = data.agg(F.max(fold)).head()[0]  # one number
    if last is None:
        return test.withColumn(out, F.lit(None).cast("double"))
    k = last + 1
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=pg.build(), numFolds=k, foldCol=fold, seed=SEED,
                        evaluator=RegressionEvaluator(labelCol=label, predictionCol=out, metricName="mae"))
    x = cv.fit(data).transform(_assembled(test, cols))
    return _tidy(x.withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(float(cap)))), cols)


# -- saved models -----------------------------------------------------------------------------------------
def fit_saved(train: DataFrame, cols: list[str], label: str, cap: float, path: str, out: str = "pred", iters: int = 10, depth: int = 3) -> list[str]:
    """Fit a boosted regressor on a capped label and save it whole: medians for nulls, assembly, trees, clip to [0, cap].

    Everything that scoring needs is in the saved pipeline, so a later session needs only its path. Columns that are null in all
    labelled rows are left out; returns those used. Without any label nothing can be fitted.
    """
    data = train.filter(F.col(label).isNotNull()).withColumns({c: F.col(c).cast("double") for c in cols} | {label: F.least(F.col(label), F.lit(float(cap)))})
    counts = data.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols]).head()  # one row of counts
    live = [c for c in cols if counts[c] > 0]
    if not counts["_n"] or not live:
        raise ValueError(f"no labelled row for {label}")
    filled = [f"{out}_in_{c}" for c in live]
    keep = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{f}`" for c, f in zip(live, filled)) + " FROM __THIS__")
    stages = [keep, Imputer(strategy="median", inputCols=filled, outputCols=[f"{f}_full" for f in filled]),
              VectorAssembler(inputCols=[f"{f}_full" for f in filled], outputCol=f"{out}_features"),
              GBTRegressor(featuresCol=f"{out}_features", labelCol=label, predictionCol=f"{out}_raw", maxIter=iters, maxDepth=depth, seed=SEED),
              SQLTransformer(statement=f"SELECT *, least(greatest(`{out}_raw`, 0.0D), {float(cap)}D) AS `{out}` FROM __THIS__")]
    Pipeline(stages=stages).fit(data).write().overwrite().save(path)
    return live


def score_saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` and the prediction of the pipeline saved at ``path``; nothing is fitted."""
    model = PipelineModel.load(path)
    out = model.stages[-2].getPredictionCol().removesuffix("_raw")
    kept = [c for c in df.columns if c != out]
    return model.transform(df.select(*[f"`{c}`" for c in kept])).select(*[f"`{c}`" for c in kept], out)


def importances(train: DataFrame, cols: list[str], label: str, weight: str | None = None, share: float = 1.0, iters: int = 10) -> DataFrame:
    """Gain share per column of a short boosted classifier on a sample of the rows, largest first."""
    data = train if share >= 1 else train.sample(share, seed=SEED)
    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=iters, maxDepth=3, seed=SEED,
                          **({"weightCol": weight} if weight else {})).fit(_assembled(data.withColumn(label, F.col(label).cast("double")), cols))
    return _importance_rows(train, cols, model)


def _importance_rows(df: DataFrame, cols: list[str], model) -> DataFrame:
    gains = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(g)) for c, g in zip(cols, gains)], "feature string, share double").orderBy(F.desc("share"), "feature")


def screen_columns(train: DataFrame, cols: list[str], label: str, k: int) -> list[str]:
    """The ``k`` columns with most gain in a short boosted regressor fitted on the training rows only."""
    counts = train.agg(*[F.count(c).alias(c) for c in cols]).head()
    live = [c for c in cols if counts[c] > 0]
    if len(live) <= k:
        return live
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=5, maxDepth=3, seed=SEED).fit(_assembled(train, live))
    gains = dict(zip(live, model.featureImportances.toArray()))
    return sorted(live, key=lambda c: (-gains[c], live.index(c)))[:k]


def fit_predict(train: DataFrame, test: DataFrame, cols: list[str], label: str, make: Callable[[], object], groups: list | None = None,
                group: str | None = None, out: str = "pred") -> DataFrame:
    """One model per listed group value, or a single one. ``make`` returns a Spark ML regressor.

    Test rows of a group that is not listed, or null, stay without a prediction.
    """
    if groups is None:
        model = make().setParams(featuresCol="features", labelCol=label, predictionCol=out).fit(_assembled(train, cols))
        return _tidy(model.transform(_assembled(test, cols)), cols)
    parts = [fit_predict(train.filter(F.col(group) == g), test.filter(F.col(group) == g), cols, label, make, out=out) for g in groups]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    rest = test.filter(F.coalesce(~F.col(group).isin(list(groups)), F.lit(True))).withColumn(out, F.lit(None).cast("double"))
    return x.unionByName(rest, allowMissingColumns=True)


def boosted(iters: int = 10, depth: int = 3, seed: int = SEED) -> Callable[[], object]:
    return lambda: GBTRegressor(maxIter=iters, maxDepth=depth, seed=seed)


def ridge(reg: float = 1.0) -> Callable[[], object]:
    return lambda: LinearRegression(elasticNetParam=0.0, regParam=reg)


def physics_ridge(train: DataFrame, cols: list[str], label: str, group: str, groups: list, reg: float = 0.1) -> DataFrame:
    """Ridge coefficients per group as (group, term, coefficient) rows."""
    out = []
    for g in groups:
        m = LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0, regParam=reg).fit(_assembled(train.filter(F.col(group) == g), cols))
        out += [(g, "intercept", float(m.intercept))] + [(g, c, float(v)) for c, v in zip(cols, m.coefficients)]
    return train.sparkSession.createDataFrame(out, f"{group} string, term string, coefficient double")


def evaluate_variants(train: DataFrame, test: DataFrame, ids: list[str], label: str, variants: dict[str, dict], group: str, groups: list) -> DataFrame:
    """Long predictions (ids..., label, variant, pred) of every variant {cols, make, per_group}."""
    parts = []
    for name, v in variants.items():
        p = fit_predict(train, test, v["cols"], label, v["make"], groups if v.get("per_group") else None, group)
        parts.append(p.select(*ids, group, label, F.lit(name).alias("variant"), "pred"))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x


def clusters_and_components(df: DataFrame, ids: list[str], cols: list[str], k: int, components: int) -> DataFrame:
    """Cluster id, distance to its centre, cluster share and leading principal components per row."""
    x = _assembled(df, cols)
    km = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(x)
    pca = PCA(k=components, inputCol="features", outputCol="_pca").fit(x)
    y = pca.transform(km.transform(x))
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in km.clusterCenters()])
    gap = F.zip_with(vector_to_array("features"), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    y = y.withColumns({"centre_distance": F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)), "_pc": vector_to_array("_pca")})
    size = y.groupBy("cluster").agg(F.count(F.lit(1)).alias("_k"))
    total = size.agg(F.sum("_k").alias("_n"))
    y = join_keys(y, join_keys(size, total, []).select("cluster", (F.col("_k") / F.col("_n")).alias("cluster_share")), ["cluster"])
    return y.select(*ids, "cluster", "centre_distance", "cluster_share", *[F.col("_pc")[i].alias(f"pc{i}") for i in range(components)])


def greedy_selection(df: DataFrame, members: list[str], score: Callable[[DataFrame, list[str]], float], least_gain: float) -> list[str]:
    """Forward selection over members: add the best one while the score falls by at least ``least_gain``."""
    chosen, best = [], float("inf")
    while len(chosen) < len(members):
        trial = {m: score(df, [*chosen, m]) for m in members if m not in chosen}
        m = min(trial, key=lambda k: (trial[k], k))
        if best - trial[m] < least_gain:
            break
        chosen, best = [*chosen, m], trial[m]
    return chosen
