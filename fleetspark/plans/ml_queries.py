"""Spark ML members on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ttf_class
from ..operators import blend as B
from ..operators import folds as FO
from ..operators import ml
from ..operators import scoring as SC
from ..operators.arrivals import past_block
from ..operators.events import operating_state
from ..operators.rolling import rolling_stats
from ..operators.sampling import time_split
from ..sources.store import write_predictions
from .blend_queries import M, MEMBERS, members
from .filter_queries import with_lives
from .neighbor_queries import NOLAG, regime_rows
from ..scratch import cut, new_path
from .registry import query
from .telemetry_queries import GAP, ROLLS, tool_rows, ttf
from .views import FAULTS, REGIMES, runs, sql

X = ["s1", "s2", "recipe_step", "runnum"]
TTF_GRID = {"maxDepth": [2, 3], "stepSize": [0.05, 0.1]}
#: Column scales, neighbour counts and state columns of the nearest-state search.
SCALES, KS, STATE = [0.0, 0.5, 1.0, 2.0, 4.0], [3, 5, 10], ["hours", "usage", "pad", "film", "duration"]


def split_rows(spark, sf):
    rows = tool_rows(spark, sf)
    df = time_split(ttf(spark, sf, rows), ["tool"], "t", rows=rows).withColumns({"cls": ttf_class("ttf_0"), "w": F.lit(1.0)})
    return df.filter("NOT is_val"), df.filter("is_val")


@query("class_probabilities")
def _(spark, sf):
    train, val = split_rows(spark, sf)
    return ml.fit_class_probabilities(train, val, X, "cls", "w", trees=5, depth=4).select("tool", "id", "proba")


@query("ttf_regressor_by_tool_folds")
def _(spark, sf):
    train, val = split_rows(spark, sf)
    train, out = cut(FO.group_kfold(train, "tool", 3)), cut(val)
    for k in FAULTS:
        out = ml.fit_regressor_by_folds(train, out, X, f"ttf_{k}", "fold", 259200.0, TTF_GRID, f"pred_{k}")
    return out.select("tool", "id", *[f"pred_{k}" for k in FAULTS])


ROW_FEATURES = ["s1", "s2", "recipe_step", "runnum", "dt", "since_gap", "since_stop", "since_recipe_change", "since_runnum_change",
                *[f"{c}_{s}_{n}" for c in ("s1", "s2") for n in ROLLS for s in ("mean", "std", "dev")]]


def feature_rows(spark, sf):
    """Row features of the telemetry with the times to the next faults and the split."""
    rows = tool_rows(spark, sf)
    df = operating_state(ttf(spark, sf, rows), ["tool"], "t", ["id"], ["recipe", "runnum"], {"gap": GAP, "stop": 2 * GAP})
    df = rolling_stats(df, ["tool"], "t", ["id"], [(c, n, w) for c in ("s1", "s2") for n, w in ROLLS.items()], ("mean", "std", "dev"), rows)
    return time_split(df, ["tool"], "t", rows=rows)


@query("saved_model_scores")
def _(spark, sf):
    """Fit and save one pipeline for each fault, then load each by its path, score the later rows, write the scores and read them back."""
    df, folder = cut(feature_rows(spark, sf)), new_path(spark, "models")
    train, out = df.filter("NOT is_val"), df.filter("is_val")
    for k in FAULTS:
        if train.filter(F.col(f"ttf_{k}").isNotNull()).head(1):
            ml.fit_saved(train, ROW_FEATURES, f"ttf_{k}", 259200.0, f"{folder}/ttf_{k}", f"pred_{k}")
            out = ml.score_saved(out, f"{folder}/ttf_{k}")
        else:
            out = out.withColumn(f"pred_{k}", F.lit(None).cast("double"))
    path = new_path(spark, "scores")
    write_predictions(out.select("tool", "id", "t", *[f"pred_{k}" for k in FAULTS]), path, "tool", "t")
    return spark.read.schema("id long, t double, " + ", ".join(f"pred_{k} double" for k in FAULTS) + f", tool {dict(df.dtypes)['tool']}").option("header", True).csv(path)


@query("feature_importance")
def _(spark, sf):
    train, _ = split_rows(spark, sf)
    near = F.when(F.coalesce(F.col("ttf_0") < 86400, F.lit(False)), 1.0).otherwise(0.0)
    return ml.importances(train.withColumn("near", near), X, "near", "w", 0.3, 5)


HX = ["usage", "pad", "film", "P_last1", "P_mean3", "P_mean10", "P_age1"]


def history_table(spark, sf):
    df = with_lives(spark, sf, "run_id", "grp", "regime", "t_start", "t_end", "usage", "pad", "film", "split", "is_ref", "measured", "y")
    labels = df.filter("measured").select("run_id", "regime", "t_end", "y")
    out = past_block(df.drop("grp", "t_start", "measured"), labels, ["regime"], NOLAG, rows=regime_rows(spark, sf), only=HX)
    return out.select("run_id", "regime", "split", "is_ref", "y", *HX)


@query("screened_member_per_regime")
def _(spark, sf):
    df = cut(history_table(spark, sf))
    train, test = df.filter("is_ref"), df.filter("NOT is_ref")
    cols = ml.screen_columns(train, HX, "y", 4)
    return ml.fit_predict(train, test, cols, "y", ml.boosted(5, 3), REGIMES, "regime").select("run_id", "regime", "pred")


@query("variant_leaderboard")
def _(spark, sf):
    df = cut(runs(spark, sf))
    train, test = df.filter("is_ref"), df.filter("NOT is_ref")
    variants = {"ridge": {"cols": ["usage", "pad", "film"], "make": ml.ridge(1.0)}, "ridge_regime": {"cols": ["usage", "pad"], "make": ml.ridge(1.0), "per_group": True},
                "trees": {"cols": ["usage", "pad", "film"], "make": ml.boosted(5, 3)}}
    long = ml.evaluate_variants(train, test, ["run_id"], "y", variants, "regime", REGIMES)
    return SC.leaderboard(long, "variant", "y", "pred")


@query("physics_ridge")
def _(spark, sf):
    return ml.physics_ridge(runs(spark, sf).filter("is_ref"), ["usage", "pad", "film", "duration"], "y", "regime", REGIMES)


@query("clusters_and_components")
def _(spark, sf):
    from .blend_queries import DIMS, vectors
    return ml.clusters_and_components(vectors(spark, sf), ["vec_id"], [f"e{i}" for i in range(DIMS)], 4, 3)


@query("meta_learner")
def _(spark, sf):
    df = cut(FO.kfold(members(runs(spark, sf)), ["run_id"], 3).withColumns({"stage_b": F.when(F.col("stage") == "B", 1.0).otherwise(0.0)}))
    parts = [ml.fit_predict(df.filter(F.col("fold") != k), df.filter(F.col("fold") == k), [*MEMBERS, "stage_b"], "y", ml.ridge(0.1), out="meta") for k in range(3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("run_id", "fold", "meta")


@query("greedy_member_selection")
def _(spark, sf):
    df = cut(FO.kfold(members(runs(spark, sf)), ["run_id"], 3).withColumn("pc", F.coalesce("pc", (F.col("pa") + F.col("pb")) / 2)).select("run_id", "regime", "fold", "y", *MEMBERS))

    def score(d, names):
        x = B.nested_blend(d, "fold", 3, ["regime"], names, "y")
        return x.agg(F.avg((F.col("blend") - F.col("y")) * (F.col("blend") - F.col("y")))).head()[0]  # one number

    chosen = ml.greedy_selection(df, MEMBERS, score, 0.05)
    return df.agg(*[F.avg((F.col(m) - F.col("y")) * (F.col(m) - F.col("y"))).alias(m) for m in chosen])


@query("median_impute_and_flags", sql("runs", f"""+{M}, md AS (SELECT median(pc) AS m FROM mem WHERE is_ref),
  res AS (SELECT run_id, coalesce(pc, m) AS pc, (pc IS NULL)::INT::DOUBLE AS pc_missing FROM mem, md)""", "run_id", "pc pc_missing"))
def _(spark, sf):
    return ml.impute_median(members(runs(spark, sf)), ["pc"], F.col("is_ref")).select("run_id", "pc", "pc_missing")


@query("normal_scores")
def _(spark, sf):
    return ml.normal_scores(runs(spark, sf), ["regime"], "film", "score").select("run_id", "score")


@query("weighted_state_regressor")
def _(spark, sf):
    from ..operators.neighbors import weighted_state_regressor
    df = cut(runs(spark, sf).withColumn("hours", F.col("t_start") / 3600))
    return weighted_state_regressor(df, df.filter("is_ref"), ["regime"], STATE, "run_id", "y", SCALES, KS, regime_rows(spark, sf))
