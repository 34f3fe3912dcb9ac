import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hourgrid.models.configurations import BASE_FEATURES, FORECAST_FEATURES, add_predictions, demand_pipeline, predict_all, train_models, train_together
from hourgrid.models.importance import permutation_importance, permuted_features, top_features, with_position
from hourgrid.functions.time import naive
from hourgrid.models.poisson_trees import PoissonTrees, poisson_deviance
from hourgrid.models.trees import Tree, bin_edges, codes_of
from hourgrid.operators.quality import DataQualityError
from hourgrid.plans.evaluation import run_backtest, run_final_test
from hourgrid.plans.features import build_features
from hourgrid.session import materialize
from tests.helpers import dense, weather_for


@pytest.fixture(scope="module")
def training(spark):
    """Counts whose mean depends on two columns and not on the third."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, (1500, 3))
    y = rng.poisson(np.exp(0.2 * x[:, 0] + 0.5 * (x[:, 1] > 5)))
    rows = [(i, f"s{i % 4}", *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, station_id string, a double, b double, noise double, pickups int")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def vectors(training):
    return VectorAssembler(inputCols=["a", "b", "noise"], outputCol="features").transform(training).cache()


@pytest.fixture(scope="module")
def fitted(vectors):
    return PoissonTrees(trees=12, cut_lineage_every=5, learning_rate=0.2).fit(vectors)


def test_deviance_falls_with_every_tree(vectors, fitted):
    deviance = poisson_deviance(F.col("pickups"), F.col("prediction"))
    deviances = [fitted.first(n).transform(vectors).agg(deviance).first()[0] for n in range(0, 13, 3)]
    assert all(after < before for before, after in zip(deviances, deviances[1:]))
    constant = vectors.agg(F.avg("pickups")).first()[0]
    assert fitted.first(0).transform(vectors).first()["prediction"] == pytest.approx(constant)


def test_leaf_values_are_penalised_newton_steps(vectors, fitted):
    """The second tree's leaves, recomputed from the predictions after the first."""
    first, second = fitted.first(1), fitted.steps[1]
    rows = second.tree.transform(first.transform(vectors).drop("leaf").withColumnRenamed("prediction", "mu"))
    groups = rows.groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        (0.2 * F.sum(F.col("pickups") - F.col("mu")) / (F.sum("mu") + 1.0)).alias("value"), F.count("*").alias("n")
    )
    found = groups.collect()
    assert 2 <= len(found) <= 32 and min(r["n"] for r in found) >= 20
    for r in found:
        assert second.values[r["leaf"]] == pytest.approx(r["value"], rel=1e-9)


def test_prediction_is_the_sum_of_the_steps(vectors, fitted):
    row = vectors.first()
    eta = fitted.base + sum(s.values[int(s.tree.predictLeaf(row["features"]))] for s in fitted.steps)
    scored = fitted.transform(vectors.where(F.col("id") == row["id"])).first()
    assert scored["prediction"] == pytest.approx(math.exp(eta))
    assert not [c for c in scored.asDict() if c.startswith("_leaf")]


def test_fit_does_not_depend_on_lineage_cuts(vectors, fitted):
    again = PoissonTrees(trees=12, cut_lineage_every=100, learning_rate=0.2).fit(vectors)
    for one, other in zip(fitted.steps, again.steps):
        assert one.values == pytest.approx(other.values)


def test_labels_must_have_a_positive_mean(vectors):
    with pytest.raises(ValueError, match="positive mean"):
        PoissonTrees(trees=1).fit(vectors.withColumn("pickups", F.lit(0)))


def test_no_trees_predict_the_mean(vectors):
    model = PoissonTrees(trees=0).fit(vectors)
    mean = vectors.agg(F.avg("pickups")).first()[0]
    assert model.steps == [] and model.transform(vectors).first()["prediction"] == pytest.approx(mean)


def test_unknown_station_gets_no_station_effect(training, spark):
    model = demand_pipeline(["station_id", "a"], "prediction", trees=3).fit(training)
    vector = model.transform(training.limit(1).withColumn("station_id", F.lit("new"))).first()["_prediction_features"]
    assert list(vector.toArray()[:-1]) == [0.0] * 4
    assert add_predictions(training, model).columns == [*training.columns, "prediction"]


def test_configurations_are_trained_alike(training):
    models = train_models({"all": training, "half": training.where("id < 700")}, {"small": ["a"], "large": ["a", "b"]}, trees=2)
    assert set(models) == {(t, n) for t in ("all", "half") for n in ("small", "large")}
    scored = predict_all(training, [models["all", "small"], models["all", "large"]])
    assert scored.columns[-2:] == ["small", "large"] and scored.count() == 1500


def test_feature_lists():
    assert len(BASE_FEATURES) == 15 and len(FORECAST_FEATURES) == 22


def test_positions_are_gapless_and_depend_on_the_salt(training):
    one = [r["p"] for r in with_position(training, ["id"], 1, 7, "p").orderBy("id").collect()]
    two = [r["p"] for r in with_position(training, ["id"], 2, 7, "p").orderBy("id").collect()]
    assert sorted(one) == sorted(two) == list(range(1500)) and one != two


def test_permutation_keeps_values_and_pairs_rows_once(training):
    small = training.select("id", "a", "b")
    shuffled = permuted_features(small, ["a", "b"], ["id"], repeats=2, seed=5, buckets=4)
    assert shuffled.count() == 1500 * 2 * 2
    original = {r["id"]: (r["a"], r["b"]) for r in small.collect()}
    for feature, index in (("a", 0), ("b", 1)):
        got = shuffled.where((F.col("feature") == feature) & (F.col("repeat") == 1)).collect()
        assert sorted(r[feature] for r in got) == sorted(v[index] for v in original.values())
        other = "b" if feature == "a" else "a"
        assert all(r[other] == original[r["id"]][1 - index] for r in got)
        moved = sum(r[feature] != original[r["id"]][index] for r in got)
        assert moved > 1400


def test_importance_ranks_the_real_features(training):
    features = ["a", "b", "noise"]
    model = demand_pipeline(features, "prediction", trees=8, learning_rate=0.3).fit(training)
    found = permutation_importance(model, training, features, keys=["id"], repeats=3)
    by_name = {r["feature"]: r for r in found.collect()}
    assert by_name["a"]["MAE_increase"] > by_name["b"]["MAE_increase"] > abs(by_name["noise"]["MAE_increase"])
    assert by_name["a"]["importance_std"] >= 0
    assert [r["feature"] for r in top_features(found, 2).collect()] == ["b", "a"]


def pandas_metrics(rows, predictions):
    pdf = rows.toPandas()
    return {
        label: pytest.approx((np.abs(pdf[c] - pdf["pickups"]).mean(), np.sqrt(((pdf[c] - pdf["pickups"]) ** 2).mean())))
        for label, c in predictions.items()
    }


@pytest.fixture(scope="module")
def features(spark):
    df, _ = dense(spark, 3, 24 * 24)
    return materialize(build_features(df, weather_for(spark, "2024-01-01", 24 * 24)), "features").cache()


SMALL = {"small": ("station_id", "hour", "lag_24"), "large": ("station_id", "hour", "lag_24", "lag_168", "temperature_c")}


def test_final_test_metrics_are_those_of_the_scored_rows(features):
    metrics, scored = run_final_test(features, date(2024, 1, 21), date(2024, 1, 24), 3 * 3 * 24, SMALL, trees=3)
    got = {r["model"]: (r["MAE"], r["RMSE"]) for r in metrics.collect()}
    assert got == pandas_metrics(scored, {"yesterday": "lag_24", "last_week": "lag_168", "small": "small", "large": "large"})
    assert scored.agg(F.min("timestamp"), F.max("timestamp")).first() == (datetime(2024, 1, 21), datetime(2024, 1, 23, 23))
    with pytest.raises(DataQualityError, match="final test: expected 5"):
        run_final_test(features, date(2024, 1, 21), date(2024, 1, 24), 5, SMALL, trees=1)


def test_backtest_trains_on_earlier_rows_only(features):
    starts = [date(2024, 1, 18), date(2024, 1, 20)]
    got = {(r["validation_week"], r["model"]): (r["MAE"], r["RMSE"]) for r in run_backtest(features, starts, 2, {"small": SMALL["small"]}, trees=2).collect()}
    assert len(got) == 2 * 3
    for start in starts:
        first, last = naive(start), naive(start + timedelta(days=2))
        by_hand = demand_pipeline(SMALL["small"], "small", trees=2).fit(features.where(F.col("timestamp") < first))
        scored = add_predictions(features.where((F.col("timestamp") >= first) & (F.col("timestamp") < last)), by_hand)
        want = pandas_metrics(scored, {"yesterday": "lag_24", "last_week": "lag_168", "small": "small"})
        assert {m: got[start, m] for m in want} == want


def test_importance_equals_scoring_every_shuffle_by_hand(training):
    columns = ["a", "b"]
    model = demand_pipeline(columns, "prediction", trees=4, learning_rate=0.3).fit(training)

    def mae(df):
        pdf = add_predictions(df, model).toPandas()
        return np.abs(pdf["prediction"] - pdf["pickups"]).mean()

    rows = training.select("id", "a", "b", "pickups")
    shuffled = permuted_features(rows, columns, ["id"], 2, 42, 8).cache()
    found = {r["feature"]: r for r in permutation_importance(model, training, columns, keys=["id"], repeats=2).collect()}
    for f in columns:
        gains = [mae(shuffled.where((F.col("feature") == f) & (F.col("repeat") == k))) - mae(rows) for k in (1, 2)]
        assert found[f]["MAE_increase"] == pytest.approx(np.mean(gains))
        assert found[f]["importance_std"] == pytest.approx(np.std(gains), abs=1e-12)


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_number_of_models(spark, features):
    """A level of all models' trees is one pass: a shuffle and its result."""
    folds = {d: F.col("timestamp") < naive(date(2024, 1, d)) for d in (18, 20, 22)}
    count = lambda trees, sets, own: jobs_of(spark, f"fit-{trees}-{len(sets)}", lambda: train_together(features, sets, own, trees=trees, max_depth=3))
    one = {"small": SMALL["small"]}
    few, more = count(1, {18: folds[18]}, one), count(3, {18: folds[18]}, one)
    assert more - few <= 2 * 2 * 3
    assert count(3, folds, SMALL) - count(1, folds, SMALL) <= 2 * 2 * 3


def test_models_fitted_together_are_those_of_separate_fits(features):
    starts = [date(2024, 1, 18), date(2024, 1, 21)]
    together = train_together(features, {s: F.col("timestamp") < naive(s) for s in starts}, SMALL, trees=4, cut_lineage_every=2)
    for (start, name), model in together.items():
        alone = demand_pipeline(SMALL[name], name, trees=4).fit(features.where(F.col("timestamp") < naive(start)))
        a, b = (add_predictions(features, m).orderBy("station_id", "timestamp").select(name).toPandas()[name] for m in (model, alone))
        np.testing.assert_allclose(a, b)
        assert set(model.stages[-1].steps[0].tree.feature) <= set(range(len(SMALL[name]) - 1 + 3))


def test_bins_of_few_and_of_many_values(spark):
    rng = np.random.default_rng(1)
    many, few = rng.normal(size=3000), rng.integers(0, 5, 3000).astype(float)
    rows = spark.createDataFrame([([float(a), float(b), 1.0], i < 2000) for i, (a, b) in enumerate(zip(many, few, strict=True))], "v array<double>, first boolean")
    (wide, five, one), (all_wide, *_) = bin_edges(rows.withColumn("every", F.lit(True)), "v", ["first", "every"])
    assert five.tolist() == [0.5, 1.5, 2.5, 3.5] and len(one) == 0 and 200 < len(wide) < 256
    sizes = np.bincount(codes_of(many[:2000, None], [wide])[:, 0], minlength=len(wide) + 1)
    assert sizes.max() < 3 * 2000 / 256 and not np.array_equal(wide, all_wide)


def test_trees_send_rows_to_their_leaves():
    tree = Tree((1, 0), (0.5, 2.0), (1, ~0), (~2, ~1))
    assert tree.leaf_of(np.array([[1.0, 0.0], [2.5, 0.5], [1.0, 0.6], [2.0, 0.5], [np.nan, 0.1], [1.0, np.nan]])).tolist() == [0, 1, 2, 0, 1, 2]
    assert Tree((), (), (), ()).leaf_of(np.zeros((2, 1))).tolist() == [0, 0]


def test_first_split_is_the_best_of_all(spark, training, vectors):
    """Every threshold of every feature, tried by hand."""
    (step,) = PoissonTrees(trees=1, max_depth=1).fit(vectors).steps
    pdf = training.toPandas()
    mu = pdf["pickups"].mean()

    def gain(inside):
        g, h = (pdf["pickups"] - mu)[inside].sum(), mu * inside.sum()
        return g * g / (h + 1)

    tried = {}
    for at, name in enumerate(["a", "b", "noise"]):
        values = np.sort(pdf[name].to_numpy())
        for low in values[19:-20:5]:
            left = pdf[name] <= low
            tried[at, low] = gain(left) + gain(~left)
    chosen = pdf.iloc[:, 2 + step.tree.feature[0]] <= step.tree.threshold[0]
    assert gain(chosen) + gain(~chosen) > 0.99 * max(tried.values())
    assert step.tree.feature[0] == max(tried, key=tried.get)[0]
