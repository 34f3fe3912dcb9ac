"""Features, baselines, folds, and models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.models.configurations import (
    FORECAST_FEATURES,
    demand_pipeline,
    station_encoder,
    train_together,
)
from hourgrid.models.importance import BUCKETS, permutation_importance, permuted_features, top_features
from hourgrid.models.poisson_trees import PoissonTreesModel, poisson_deviance
from hourgrid.functions.time import naive
from hourgrid.operators.evaluation import (
    best_other,
    fixed_test,
    improvement_by_model,
    improvement_over_best,
    metrics_by_model,
    summarize_folds,
    trailing_split,
)
from hourgrid.operators import reports
from hourgrid.operators.history import add_history
from hourgrid.operators.reports import error_frame
from hourgrid.plans.evaluation import backtest_baselines, evaluate_baselines, run_backtest, run_final_test
from hourgrid.schemas import BASELINES, LAG_FEATURES, ROLLING_FEATURES
from hourgrid.session import materialize
from queries import base
from queries.base import Query, r, rounded, rounded_columns, with_ctes

TREES = 200
#: Trees of the model whose features are permuted; the shuffles are what that query is about.
IMPORTANCE_TREES = 20
#: Models of one split a tree on whole numbers, which SQL can grow step by step.
STUMPS = {
    "stumps": ("hour", "day_of_week", "lag_24"),
    "stumps_weather": ("hour", "day_of_week", "lag_24", "weather_code", "is_precipitating"),
}
STUMP_TREES = 4
STUMP_RATE = 0.3
STUMP_SETTINGS = {"trees": STUMP_TREES, "learning_rate": STUMP_RATE, "max_depth": 1, "l2": 1.0, "min_rows_per_leaf": 20, "cut_lineage_every": 3}
#: All numeric features.
PERMUTED = tuple(f for f in FORECAST_FEATURES if f != "station_id")
REPEATS = 5


def lags(spark, sf_dir) -> DataFrame:
    lagged = add_history(base.grid_of_all(spark, sf_dir), "station_id", "pickups", rolling_hours=None)
    return lagged.na.drop(subset=list(LAG_FEATURES))


def rolling(spark, sf_dir) -> DataFrame:
    rolled = add_history(base.grid_of_all(spark, sf_dir), "station_id", "pickups", lags=())
    return rounded(rolled.na.drop(subset=list(ROLLING_FEATURES)))


def baseline_eval(spark, sf_dir) -> DataFrame:
    return rounded(evaluate_baselines(base.grid(spark, sf_dir)))


def holdout_sizes(spark, sf_dir) -> DataFrame:
    """Rows and bounds of both sides of the trailing split."""
    train, test = trailing_split(base.grid(spark, sf_dir), 7)
    first, last = F.min("timestamp").alias("first_hour"), F.max("timestamp").alias("last_hour")

    def measured(side: DataFrame, name: str) -> DataFrame:
        return side.agg(first, last, F.count("*").alias("rows")).select(F.lit(name).alias("part"), "*")

    return measured(train, "train").unionByName(measured(test, "test"))


def fold_metrics(spark, sf_dir) -> DataFrame:
    return backtest_baselines(base.history(spark, sf_dir), base.FOLD_STARTS, base.FOLD_DAYS)


def summary(spark, sf_dir) -> DataFrame:
    return materialize(summarize_folds(fold_metrics(spark, sf_dir)), "summary")


def locked_test(spark, sf_dir) -> DataFrame:
    rows = materialize(base.history(spark, sf_dir), "history")
    test = fixed_test(rows, base.TEST_START, base.TEST_END, base.TEST_ROWS)
    return rounded(metrics_by_model(test, BASELINES).orderBy("MAE"))


def poisson_eval(spark, sf_dir) -> DataFrame:
    features = base.staged_features(spark, sf_dir)
    metrics, _ = run_final_test(features, base.TEST_START, base.TEST_END, base.TEST_ROWS, trees=TREES)
    return rounded(metrics)


def poisson_backtest(spark, sf_dir) -> DataFrame:
    """All folds and both configurations, against the best baseline."""
    results = run_backtest(base.staged_features(spark, sf_dir), base.FOLD_STARTS, base.FOLD_DAYS, trees=TREES)
    staged = materialize(summarize_folds(results), "summary")
    return rounded(improvement_over_best(staged, "gradient_boosting_weather"))


def stump_test(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Metrics of both stump models and both baselines on the locked test, and the scored rows."""
    features = base.staged_features(spark, sf_dir)
    return run_final_test(features, base.TEST_START, base.TEST_END, base.TEST_ROWS, STUMPS, **STUMP_SETTINGS)


def stump_predictions(spark, sf_dir) -> DataFrame:
    _, scored = stump_test(spark, sf_dir)
    return rounded(scored.select("timestamp", "station_id", "pickups", *STUMPS))


def stump_backtest(spark, sf_dir) -> DataFrame:
    features = base.staged_features(spark, sf_dir)
    return rounded(run_backtest(features, base.FOLD_STARTS, base.FOLD_DAYS, STUMPS, **STUMP_SETTINGS))


def one_hot(spark, sf_dir) -> DataFrame:
    """The encoder learns the selected stations and meets all of them."""
    selected = base.grid(spark, sf_dir).select("station_id").distinct()
    encoder = Pipeline(stages=station_encoder("index", "encoded")).fit(selected)
    encoded = encoder.transform(base.station_totals(spark, sf_dir)).withColumn("values", vector_to_array("encoded"))
    return encoded.select(
        "station_id", F.size("values").alias("width"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("hits")
    )


def poisson_training(spark, sf_dir) -> DataFrame:
    """Per tree of a stump model: its split and leaf values, and the deviance of the training rows after it."""
    features = base.staged_features(spark, sf_dir)
    before = F.col("timestamp") < naive(base.TEST_START)
    (model,) = train_together(features, {"all": before}, {"stumps_weather": STUMPS["stumps_weather"]}, **STUMP_SETTINGS).values()
    *prepare, boosted = model.stages
    scored = features.where(before)
    for stage in prepare:
        scored = stage.transform(scored)
    scored = scored.withColumn("eta_0", F.lit(boosted.base))
    for n, step in enumerate(boosted.steps, 1):
        only = PoissonTreesModel(0.0, [step], boosted.features, "")
        scored = scored.withColumn(f"eta_{n}", F.col(f"eta_{n - 1}") + only.eta(F.col(boosted.features)))
    deviances = [poisson_deviance(F.col("pickups"), F.exp(f"eta_{n}")).alias(f"d{n}") for n in range(1, STUMP_TREES + 1)]
    one_row = scored.agg(F.count("*").alias("rows"), F.avg(F.exp("eta_0")).alias("base_mean"), *deviances)
    per_tree = []
    for n, step in enumerate(boosted.steps, 1):
        (at,), (threshold,) = step.tree.feature, step.tree.threshold
        left, right = (step.values[~child] for (child,) in (step.tree.left, step.tree.right))
        split = [F.lit(STUMPS["stumps_weather"][at]).alias("feature"), F.lit(threshold).alias("threshold"), F.lit(left).alias("left_value"), F.lit(right).alias("right_value")]
        per_tree.append(F.struct(F.lit(n).alias("tree"), "rows", "base_mean", *split, F.col(f"d{n}").alias("deviance")))
    return rounded(one_row.select(F.inline(F.array(*per_tree))))


def prediction_range(spark, sf_dir) -> DataFrame:
    """Of both configurations."""
    _, scored = stump_test(spark, sf_dir)
    ranges = []
    for name in STUMPS:
        frame = error_frame(scored, name, ["timestamp", "station_id", "pickups"])
        ranges.append(reports.prediction_range(frame).select(F.lit(name).alias("model"), "*"))
    return rounded(ranges[0].unionByName(ranges[1]))


def importance(spark, sf_dir) -> DataFrame:
    features = base.staged_features(spark, sf_dir)
    train = features.where(F.col("timestamp") < naive(base.TEST_START))
    model = demand_pipeline(FORECAST_FEATURES, "prediction", trees=IMPORTANCE_TREES).fit(train)
    test = fixed_test(features, base.TEST_START, base.TEST_END)
    return rounded(top_features(permutation_importance(model, test, FORECAST_FEATURES, repeats=REPEATS)))


def blend_importance(spark, sf_dir) -> DataFrame:
    """The twelve features whose shuffles hurt a fixed weighted sum of all features most."""
    features = base.staged_features(spark, sf_dir)
    blend = PipelineModel([SQLTransformer(statement=f"SELECT *, {_blend()} AS prediction FROM __THIS__")])
    test = fixed_test(features, base.TEST_START, base.TEST_END)
    return rounded(top_features(permutation_importance(blend, test, PERMUTED, repeats=REPEATS)))


def _blend(prefix: str = "", swapped: str = "", value: str = "") -> str:
    """A weighted sum of all numeric features, each with a weight of its own; ``swapped`` stands for ``value``."""
    return " + ".join(f"{0.02 * (i % 7 + 1):.2f} * CAST({value if f == swapped else prefix + f} AS DOUBLE)" for i, f in enumerate(PERMUTED))


def _blend_importance_sql() -> str:
    """Both orders of each repeat by row number over the md5 of the row key, and equal numbers joined."""
    order = lambda salt: f"""row_number() OVER (ORDER BY md5(station_id || '|' || CAST("timestamp" AS VARCHAR) || '|{salt}'), station_id, "timestamp") - 1"""
    parts = [f"""SELECT '{f}' AS feature, repeat, avg(abs({_blend("r.", f, f"d.{f}")} - r.pickups)) AS m FROM receivers r JOIN donors d USING (place) GROUP BY repeat""" for f in PERMUTED]
    return with_ctes(
        "test",
        tail=f""", receivers AS MATERIALIZED (SELECT *, {order(42)} AS place FROM test),
            donors AS MATERIALIZED ({" UNION ALL ".join(f"SELECT *, {i} AS repeat, {order(42 + i)} AS place FROM test" for i in range(1, REPEATS + 1))}),
            base AS (SELECT avg(abs({_blend()} - pickups)) AS m FROM test),
            swapped AS ({" UNION ALL ".join(parts)})
            SELECT feature, {r("avg(swapped.m - base.m)")} AS "MAE_increase", {r("stddev_pop(swapped.m - base.m)")} AS importance_std
            FROM swapped, base GROUP BY feature ORDER BY avg(swapped.m - base.m) DESC, feature LIMIT 12""",
    )


def permuted_totals(spark, sf_dir) -> DataFrame:
    """A shuffle moves values between rows and changes none: each feature keeps its total and range."""
    rows = base.staged_features(spark, sf_dir).select("station_id", "timestamp", *PERMUTED)
    shuffled = permuted_features(rows, PERMUTED, ["station_id", "timestamp"], REPEATS, 42, BUCKETS)
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("double")) for f in PERMUTED])
    return rounded(
        shuffled.groupBy("feature", "repeat").agg(
            F.count("*").alias("rows"),
            F.sum(value).alias("total"),
            F.sum(value * value).alias("total_squares"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        ),
        4,
    )


def _permuted_sql() -> str:
    parts = [
        f"""SELECT '{f}' AS feature, repeat, count(*) AS "rows", {r(f"CAST(sum({f}) AS DOUBLE)", 4)} AS total,
            {r(f"CAST(sum({f} * {f}) AS DOUBLE)", 4)} AS total_squares,
            {r(f"CAST(min({f}) AS DOUBLE)", 4)} AS lowest, {r(f"CAST(max({f}) AS DOUBLE)", 4)} AS highest
            FROM features CROSS JOIN (VALUES {", ".join(f"({i})" for i in range(1, REPEATS + 1))}) t(repeat)
            GROUP BY repeat"""
        for f in PERMUTED
    ]
    return with_ctes("features", tail=" UNION ALL ".join(parts))


def with_stumps(starts, tail: str) -> str:
    """Both stump models from the rows before each of ``starts``: ``s0`` to the last state, one split (``t1``, ...) after the other."""
    used = STUMPS["stumps_weather"]
    uses = ", ".join(f"('{model}', {used.index(f) + 1})" for model, own in STUMPS.items() for f in own)
    ctes = [
        f"""x AS MATERIALIZED (SELECT station_id, "timestamp", unnest(range(1, {len(used) + 1})) AS feature, unnest([{", ".join(f"{f}::DOUBLE" for f in used)}]) AS value FROM features)""",
        f"uses(model, feature) AS (VALUES {uses})",
        f"""s0 AS MATERIALIZED (SELECT start, model, station_id, "timestamp", pickups, "timestamp" < start AS train,
            ln(avg(pickups) FILTER ("timestamp" < start) OVER (PARTITION BY start, model)) AS eta
            FROM features, (VALUES {", ".join(f"(DATE '{d}')" for d in starts)}) f(start), (SELECT DISTINCT model FROM uses))""",
    ]
    for k in range(1, STUMP_TREES + 1):
        ctes += [
            f"""h{k} AS (SELECT start, model, feature, value, sum(pickups - exp(eta)) AS g, sum(exp(eta)) AS h, count(*) AS n
                FROM s{k - 1} JOIN x USING (station_id, "timestamp") JOIN uses USING (model, feature) WHERE train GROUP BY ALL)""",
            f"""c{k} AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER a AS gw, sum(h) OVER a AS hw, sum(n) OVER a AS nw, lead(value) OVER w AS above FROM h{k}
                WINDOW w AS (PARTITION BY start, model, feature ORDER BY value), a AS (PARTITION BY start, model, feature))""",
            f"""t{k} AS MATERIALIZED (SELECT start, model, feature, (value + above) / 2 AS threshold, {STUMP_RATE} * gl / (hl + 1) AS left_value, {STUMP_RATE} * (gw - gl) / (hw - hl + 1) AS right_value FROM c{k}
                WHERE above IS NOT NULL AND least(nl, nw - nl) >= 20 AND least(hl, hw - hl) >= 0.001 QUALIFY row_number() OVER (PARTITION BY start, model
                ORDER BY round(gl * gl / (hl + 1) + (gw - gl) * (gw - gl) / (hw - hl + 1) - gw * gw / (hw + 1), 6) DESC, feature, value) = 1)""",
            f"""s{k} AS MATERIALIZED (SELECT s.* REPLACE (eta + CASE WHEN value <= threshold THEN left_value ELSE right_value END AS eta)
                FROM s{k - 1} s JOIN t{k} USING (start, model) JOIN x USING (station_id, "timestamp", feature))""",
        ]
    ctes.append(f"""scored AS (SELECT start, model, station_id, "timestamp", pickups, exp(eta) AS prediction FROM s{STUMP_TREES})""")
    return with_ctes("features", tail=", " + ",\n".join(ctes) + "\n" + tail)


LOCKED = f"""start = DATE '{base.TEST_START}' AND "timestamp" >= start AND "timestamp" < TIMESTAMP '{base.TEST_END} 00:00:00'"""


def _compared(period: str, keys: str = "") -> str:
    """MAE and RMSE of stumps and baselines over the scored rows of ``period``."""
    baselines = f"""SELECT DISTINCT start, b.model, station_id, "timestamp", f.pickups, CASE b.model WHEN 'yesterday' THEN lag_24 ELSE lag_168 END AS prediction
        FROM scored JOIN features f USING (station_id, "timestamp"), (VALUES ('yesterday'), ('last_week')) b(model)"""
    errors = f"""{r("avg(abs(prediction - pickups))")} AS "MAE", {r("sqrt(avg((prediction - pickups) * (prediction - pickups)))")} AS "RMSE\""""
    return f"""SELECT {keys} model, {errors} FROM (SELECT * FROM scored UNION ALL {baselines}) WHERE {period} GROUP BY ALL"""


SUMMARY_COLUMNS = ", ".join(f"{r(c)} AS {c}" for c in ("mean_MAE", "std_MAE", "mean_RMSE", "std_RMSE"))

QUERIES = {
    "lag_features": Query(
        lags,
        with_ctes(
            "history_all",
            tail=f"""SELECT "timestamp", station_id, pickups, {", ".join(LAG_FEATURES)} FROM history_all
                     WHERE lag_24 IS NOT NULL AND lag_48 IS NOT NULL AND lag_168 IS NOT NULL AND lag_336 IS NOT NULL""",
        ),
    ),
    "rolling_features": Query(
        rolling,
        with_ctes(
            "history_all",
            tail=f"""SELECT "timestamp", station_id, pickups, {rounded_columns(ROLLING_FEATURES)} FROM history_all
                     WHERE rolling_mean_168 IS NOT NULL AND rolling_std_168 IS NOT NULL""",
        ),
    ),
    "model_features": Query(
        lambda spark, sf_dir: rounded(base.features(spark, sf_dir).select(*base.FEATURE_COLUMNS)),
        with_ctes("features", tail=f"SELECT {rounded_columns(base.FEATURE_COLUMNS)} FROM features"),
    ),
    "baseline_eval": Query(
        baseline_eval,
        with_ctes(
            "history",
            tail=f"""SELECT model, {r("avg(abs(e))")} AS "MAE", {r("sqrt(avg(e * e))")} AS "RMSE" FROM (
                SELECT unnest(['yesterday', 'last_week']) AS model, unnest([lag_24 - pickups, lag_168 - pickups]) AS e
                FROM history WHERE lag_24 IS NOT NULL AND lag_168 IS NOT NULL
                AND "timestamp" >= (SELECT CAST(max("timestamp") AS DATE) - 6 FROM history)) GROUP BY model""",
        ),
    ),
    "trailing_holdout": Query(
        holdout_sizes,
        with_ctes(
            "grid",
            tail="""SELECT CASE WHEN "timestamp" < (SELECT CAST(max("timestamp") AS DATE) - 6 FROM grid) THEN 'train' ELSE 'test' END AS part,
                    min("timestamp") AS first_hour, max("timestamp") AS last_hour, count(*) AS "rows" FROM grid GROUP BY 1""",
        ),
    ),
    "backtest_baselines": Query(
        lambda spark, sf_dir: rounded(fold_metrics(spark, sf_dir)),
        with_ctes("fold_metrics", tail=f"""SELECT validation_week, model, {r("MAE")} AS "MAE", {r("RMSE")} AS "RMSE" FROM fold_metrics"""),
    ),
    "backtest_summary": Query(
        lambda spark, sf_dir: rounded(summary(spark, sf_dir).orderBy("mean_MAE")),
        with_ctes("summary", tail=f"SELECT model, {SUMMARY_COLUMNS} FROM summary"),
    ),
    "best_baseline": Query(
        lambda spark, sf_dir: rounded(best_other(summary(spark, sf_dir), "gradient_boosting")),
        with_ctes("summary", tail=f"""SELECT model AS best_model, {r("mean_MAE")} AS "best_MAE" FROM summary ORDER BY mean_MAE, model LIMIT 1"""),
    ),
    "backtest_improvement": Query(
        lambda spark, sf_dir: rounded(improvement_by_model(summary(spark, sf_dir), "yesterday")),
        with_ctes(
            "summary",
            tail=f"""SELECT s.model, {r("(b.mean_MAE - s.mean_MAE) / b.mean_MAE")} AS "MAE_improvement",
                     {r("(b.mean_RMSE - s.mean_RMSE) / b.mean_RMSE")} AS "RMSE_improvement"
                     FROM summary s JOIN summary b ON b.model = 'yesterday' WHERE s.model <> 'yesterday'""",
        ),
    ),
    "locked_test_baselines": Query(
        locked_test,
        with_ctes(
            "test",
            tail=f"""SELECT 'yesterday' AS model, {r("avg(abs(lag_24 - pickups))")} AS "MAE",
                     {r("sqrt(avg((lag_24 - pickups) * (lag_24 - pickups)))")} AS "RMSE" FROM test UNION ALL
                     SELECT 'last_week', {r("avg(abs(lag_168 - pickups))")},
                     {r("sqrt(avg((lag_168 - pickups) * (lag_168 - pickups)))")} FROM test""",
        ),
    ),
    "one_hot_station": Query(
        one_hot,
        with_ctes(
            "by_station",
            "top",
            tail="""SELECT station_id, CAST((SELECT count(*) FROM top) AS INTEGER) AS width,
                    CAST(max(station_id IN (SELECT station_id FROM top)) AS DOUBLE) AS hits
                    FROM by_station GROUP BY station_id""",
        ),
    ),
    "permuted_features": Query(permuted_totals, _permuted_sql()),
    "poisson_training": Query(
        poisson_training,
        with_stumps(
            [base.TEST_START],
            " UNION ALL ".join(
                f"""SELECT {k} AS tree, count(*) AS "rows", {r("avg(pickups)")} AS base_mean, {list(STUMPS["stumps_weather"])}[any_value(feature)] AS feature, {r("any_value(threshold)")} AS threshold,
                {r("any_value(left_value)")} AS left_value, {r("any_value(right_value)")} AS right_value,
                {r("avg(2 * (CASE WHEN pickups > 0 THEN pickups * (ln(pickups) - eta) ELSE 0 END - pickups + exp(eta)))")} AS deviance
                FROM s{k} JOIN t{k} USING (start, model) WHERE train AND model = 'stumps_weather'"""
                for k in range(1, STUMP_TREES + 1)
            ),
        ),
    ),
    "stump_predictions": Query(
        stump_predictions,
        with_stumps([base.TEST_START], f"""SELECT "timestamp", station_id, pickups, {", ".join(f"{r(f"max(prediction) FILTER (model = '{m}')")} AS {m}" for m in STUMPS)} FROM scored WHERE {LOCKED} GROUP BY ALL"""),
    ),
    "stumps_vs_baselines": Query(lambda spark, sf_dir: rounded(stump_test(spark, sf_dir)[0]), with_stumps([base.TEST_START], _compared(LOCKED))),
    "stump_backtest": Query(
        stump_backtest,
        with_stumps(base.FOLD_STARTS, _compared(f"""\"timestamp\" >= start AND \"timestamp\" < start + INTERVAL {base.FOLD_DAYS} DAY""", "start AS validation_week,")),
    ),
    "poisson_prediction_range": Query(
        prediction_range,
        with_stumps(
            [base.TEST_START],
            f"""SELECT model, {r("avg(pickups)")} AS actual_mean, {r("avg(prediction)")} AS predicted_mean, {r("min(prediction)")} AS predicted_min,
                {r("max(prediction)")} AS predicted_max, max(pickups) AS actual_max FROM scored WHERE {LOCKED} GROUP BY model""",
        ),
    ),
    "poisson_boost_eval": Query(poisson_eval),
    "poisson_boost_backtest": Query(poisson_backtest),
    "blend_importance": Query(blend_importance, _blend_importance_sql()),
    "permutation_importance": Query(importance),
}
