"""Screening, folds, search and persistence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import panel
from rosterlake.plans import ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 600
    a, b = rng.normal(size=n), rng.normal(size=n)
    minutes = np.where(a + rng.normal(0, 0.5, n) > 0, 90, np.where(b > 0, 20, 0))
    pdf = pd.DataFrame({
        "id": np.arange(n), "season_name": np.where(np.arange(n) < 300, "2024-25", "2025-26"), "round": np.arange(n) // 20 % 15 + 1, "a": a, "b": b,
        "copy": a * 2 + 0.01 * b, "flat": 1.0, "minutes": minutes.astype(float), "total_points": (minutes / 30 + b).round(2),
    })
    df = spark.createDataFrame(pdf).withColumns({**ml.target_columns("minutes"), "gap": F.lit(None).cast("double")})
    return panel.add_season_weight(df, "season_name").persist()


FEATURES = ["flat", "a", "copy", "gap", "b"]


def test_screen_drops_flat_empty_and_correlated(rows):
    for fill in ("zero", "median"):
        model = ml.FeatureScreen(inputCols=FEATURES, fill=fill).fit(rows)
        assert model.getOrDefault(model.keptCols) == ["a", "b"]


def test_correlated_against_any_earlier_feature():
    m = np.array([[1, 0.95, 0.5], [0.95, 1, 0.95], [0.5, 0.95, 1]])
    assert ml.correlated(m, ["x", "y", "z"], 0.9) == ["y", "z"]


def test_season_weights_and_folds(rows):
    w = {r["season_name"]: r["season_weight"] for r in rows.select("season_name", "season_weight").distinct().collect()}
    assert w == {"2024-25": pytest.approx(0.7), "2025-26": 1.0}
    folds = panel.forward_folds(rows, ["season_name", "round"], 3).orderBy("period_index").collect()
    assert [r["fold"] for r in folds] == sorted(r["fold"] for r in folds) and {r["fold"] for r in folds} == {0, 1, 2, 3}
    assert sum(r["fold"] == 3 for r in folds) == 30 // 4


def test_search_selects_scores_and_reloads(rows, tmp_path):
    gbt = ml.Candidate("gbt", lambda p: ml.GBTClassifier(**{"maxIter": 2, "maxDepth": 2, **p}), lambda p: ml.GBTRegressor(**{"maxIter": 2, "maxDepth": 2, **p}), {"maxDepth": [1, 3]})
    forest = ml.Candidate("random_forest", lambda p: ml.RandomForestClassifier(numTrees=3, seed=1), None)
    first = ml.search(rows, gbt, "classifier", FEATURES, "starts", ["season_name", "round"], "season_weight", folds=2, tries=1)
    other = ml.search(rows, forest, "classifier", FEATURES, "starts", ["season_name", "round"], "season_weight", folds=2, tries=0)
    assert first.mean > 0.7 and len(first.scores) == 2
    best = ml.select_best([first, other], "starts")
    assert best.mean == max(first.mean, other.mean)
    assert dict(ml.feature_importance(first.model, 5))["a"] > 0
    ml.save_models([first], str(tmp_path))
    again = ml.load_model(str(tmp_path), "gbt", "starts")
    a = [r[0] for r in first.model.transform(rows).orderBy("id").select("prediction").collect()]
    assert a == [r[0] for r in again.transform(rows).orderBy("id").select("prediction").collect()]


def test_one_class_start_target_is_an_error(rows):
    with pytest.raises(ValueError, match="one class"):
        ml.train_all(rows.withColumn("starts", F.lit(1)), FEATURES, [ml.BOOSTED], ["season_name", "round"])


def test_draws_are_seeded():
    space = {"x": [1, 2, 3], "y": [1, 2]}
    assert ml.draws(space, 4, 42) == ml.draws(space, 4, 42) and ml.draws(space, 4, 42)[0] == {}
    assert len(ml.draws({"x": [1]}, 12, 42)) == 2


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0)], "label int, prediction int")
    assert ml.balanced_accuracy(df).first()[0] == pytest.approx((2 / 3 + 1) / 2)
    assert ml.mean_absolute_error(df).first()[0] == 0.25


def test_resampling_balances_the_classes(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0, 1.0 if i < 500 else 0.5) for i in range(1_000)] + [(5_000, None, 1.0)], "id int, y int, w double")
    plain = {r.y: r.n for r in ml.resampled(df, "y").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert plain == {0: 900, 1: 900}
    weighted = ml.resampled(df, "y", "w")
    n = {(r.y, r.late): r.n for r in weighted.groupBy("y", (F.col("id") >= 500).alias("late")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[(0, False)] == 450 and 180 < n[(0, True)] < 270 and abs(n[(1, False)] + n[(1, True)] - 675) < 120
    assert ml.resampled(df.limit(0), "y").count() == 0
    assert sorted(r.id for r in weighted.collect()) == sorted(r.id for r in ml.resampled(df.repartition(3), "y", "w").collect())


def test_neural_folds_and_their_metric_in_sql(rows, tmp_path):
    import duckdb

    candidate = ml.neural(hidden=(6,), maxIter=30)
    found = ml.search(rows, candidate, "classifier", FEATURES, "starts", ["season_name", "round"], "season_weight", folds=2, tune=False)
    assert found.mean > 0.75 and len(found.scores) == 2
    stages = [type(s).__name__ for s in found.model.stages]
    assert stages == ["FeatureScreenModel", "StandardScalerModel", "MultilayerPerceptronClassificationModel"]
    path = str(tmp_path / "predictions")
    ml.fold_predictions(rows, candidate, "classifier", FEATURES, "starts", ["season_name", "round"], None, "season_weight", folds=2).select("id", "fold", "starts", "prediction").write.parquet(path)
    sql = f"""select fold, avg(r) from (select fold, starts, avg((prediction = starts)::int) as r from '{path}/*.parquet' group by 1, 2) group by 1 order by 1"""
    again = duckdb.sql(sql).fetchall()
    assert [f for f, _ in again] == [1, 2] and [r for _, r in again] == pytest.approx(found.scores, abs=0.02)
    learned_from = ml.resampled(rows, "starts", "season_weight")
    standard = found.model.stages[1].transform(found.model.stages[0].transform(learned_from)).select(ml.vector_to_array("features").alias("f"))
    means = standard.agg(F.avg(F.col("f")[0]), F.stddev_samp(F.col("f")[0])).first()
    assert means[0] == pytest.approx(0.0, abs=1e-9) and means[1] == pytest.approx(1.0)
    ml.save_models([found], str(tmp_path))
    again = ml.load_model(str(tmp_path), "neural", "starts")
    assert again.transform(rows).agg(F.sum("prediction")).first()[0] == found.model.transform(rows).agg(F.sum("prediction")).first()[0]
