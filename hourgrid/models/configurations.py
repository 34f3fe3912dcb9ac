"""Named model configurations and their pipelines."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.models.poisson_trees import Fit, PoissonTrees, PoissonTreesModel, Settings, Step, fit_together
from hourgrid.schemas import BASE_NUMERIC_FEATURES, CATEGORICAL_FEATURE, WEATHER_FEATURES

BASE_FEATURES = (CATEGORICAL_FEATURE, *BASE_NUMERIC_FEATURES)
FORECAST_FEATURES = BASE_FEATURES + WEATHER_FEATURES

CONFIGURATIONS = {
    "gradient_boosting": BASE_FEATURES,
    "gradient_boosting_weather": FORECAST_FEATURES,
}


def station_encoder(index: str, one_hot: str) -> list[StringIndexer | OneHotEncoder]:
    """One column per station seen in training; a station not seen there gets all zeros."""
    return [
        StringIndexer(inputCol=CATEGORICAL_FEATURE, outputCol=index, handleInvalid="keep"),
        OneHotEncoder(inputCol=index, outputCol=one_hot, dropLast=True),
    ]


def demand_pipeline(features: Sequence[str], prediction: str, label: str = "pickups", **boosting) -> Pipeline:
    """One-hot station, every other feature as a number, boosted trees."""
    numeric = [f for f in features if f != CATEGORICAL_FEATURE]
    vector = f"_{prediction}_features"
    stages = []
    inputs = list(numeric)
    if CATEGORICAL_FEATURE in features:
        index, one_hot = f"_{prediction}_index", f"_{prediction}_onehot"
        stages += station_encoder(index, one_hot)
        inputs.insert(0, one_hot)
    stages += [
        VectorAssembler(inputCols=inputs, outputCol=vector),
        PoissonTrees(features=vector, label=label, prediction=prediction, **boosting),
    ]
    return Pipeline(stages=stages)


def add_predictions(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Score ``df`` and keep its columns and the prediction; helper columns are dropped."""
    scored = model.transform(df)
    return scored.drop(*[c for c in scored.columns if c.startswith("_")])


def train_models(
    training: Mapping[Hashable, DataFrame],
    configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS,
    parallelism: int = 4,
    **boosting,
) -> dict[tuple[Hashable, str], PipelineModel]:
    """One fitted pipeline per training set and configuration, all with the same parameters.

    Fits are independent, so up to ``parallelism`` of them submit their jobs at the same time, as
    MLlib's own cross-validation does; while one reduces its split statistics another uses the cores.
    """
    tasks = [(label, name) for label in training for name in configurations]

    @inheritable_thread_target(next(iter(training.values())).sparkSession)
    def fit(task: tuple[Hashable, str]) -> PipelineModel:
        label, name = task
        return demand_pipeline(configurations[name], name, **boosting).fit(training[label])

    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return dict(zip(tasks, pool.map(fit, tasks), strict=True))


def train_together(
    rows: DataFrame,
    training: Mapping[Hashable, Column],
    configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS,
    label: str = "pickups",
    **boosting,
) -> dict[tuple[Hashable, str], PipelineModel]:
    """One fitted pipeline per training set, a condition on ``rows``, and configuration, grown side by side.

    The models are those that separate fits would give. The station encoder learns from all training sets; a station
    that one of them lacks is a constant there, which no split can use.
    """
    any_set = F.lit(False)
    for condition in training.values():
        any_set = any_set | condition
    used = rows.where(any_set)
    numeric = list(dict.fromkeys(f for features in configurations.values() for f in features if f != CATEGORICAL_FEATURE))
    encoded, stages, stations = [], [], 0
    if any(CATEGORICAL_FEATURE in features for features in configurations.values()):
        encoder = Pipeline(stages=station_encoder("_index", "_onehot")).fit(used)
        encoded, stages, stations = ["_onehot"], encoder.stages, len(encoder.stages[0].labels)
    assembled = PipelineModel([*stages, VectorAssembler(inputCols=[*encoded, *numeric], outputCol="_vector")]).transform(used)

    def slots(features: Sequence[str]) -> list[int]:
        """Where a configuration's vector has its entries in the common one."""
        own = list(range(stations)) if CATEGORICAL_FEATURE in features else []
        return own + [stations + numeric.index(f) for f in features if f != CATEGORICAL_FEATURE]

    tasks = [(at, chosen, name) for at, chosen in enumerate(training) for name in configurations]
    fits = [Fit(at, tuple(slots(configurations[name]))) for at, _, name in tasks]
    fitted = fit_together(assembled, "_vector", label, list(training.values()), fits, Settings(**boosting))
    models = {}
    for (_, chosen, name), fit, (base, steps) in zip(tasks, fits, fitted, strict=True):
        features, vector = configurations[name], f"_{name}_features"
        inputs = (encoded if CATEGORICAL_FEATURE in features else []) + [f for f in features if f != CATEGORICAL_FEATURE]
        position = {slot: i for i, slot in enumerate(fit.features)}
        moved = [Step(s.tree.moved(position), s.values) for s in steps]
        needed = stages if CATEGORICAL_FEATURE in features else []
        model = PoissonTreesModel(base, moved, vector, name)
        models[chosen, name] = PipelineModel([*needed, VectorAssembler(inputCols=inputs, outputCol=vector), model])
    return models


def predict_all(df: DataFrame, models: Iterable[PipelineModel]) -> DataFrame:
    """One prediction column per model, in the row it belongs to."""
    for model in models:
        df = add_predictions(df, model)
    return df
