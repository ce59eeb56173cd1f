"""Training, selection and scoring with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import CORRELATION_THRESHOLD, MIN_VARIANCE
from rosterlake.operators.panel import forward_folds, recent_rows
from rosterlake.session import stored


def target_columns(minutes: str) -> dict[str, Column]:
    """Starts = 60 minutes or more, appears = any (M2)."""
    played = F.coalesce(F.col(minutes), F.lit(0.0))
    return {"starts": (played >= 60).cast("int"), "appears": (played > 0).cast("int")}


# --- feature screen --------------------------------------------------------------------------

def screen_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count and population variance per feature, in one pass."""
    stats = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in features], *[F.var_pop(c).alias(f"v_{c}") for c in features]
    )
    return stats.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"v_{c}").alias("variance"))
                for c in features
            ])
        ).alias("s")
    ).select("s.*")


def correlated(matrix, names: Sequence[str], threshold: float) -> list[str]:
    """Every feature correlated above the threshold with *any* earlier one, dropped or not."""
    return [
        names[j] for j in range(len(names))
        if any(abs(matrix[i, j]) > threshold for i in range(j))
    ]


class _ScreenParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "features to screen", TypeConverters.toListString)
    keptCols = Param(Params._dummy(), "keptCols", "features kept", TypeConverters.toListString)
    minVariance = Param(Params._dummy(), "minVariance", "population variance floor", TypeConverters.toFloat)
    maxCorrelation = Param(Params._dummy(), "maxCorrelation", "absolute correlation limit", TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "vector of kept features", TypeConverters.toString)
    fill = Param(Params._dummy(), "fill", "'zero' or 'median'", TypeConverters.toString)
    fillValues = Param(Params._dummy(), "fillValues", "fill per kept feature", TypeConverters.toListFloat)


class FeatureScreen(Estimator, _ScreenParams, DefaultParamsReadable, DefaultParamsWritable):
    """Drops empty, constant and strongly correlated features; assembles the rest."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", minVariance=MIN_VARIANCE,
                 maxCorrelation=CORRELATION_THRESHOLD, fill="zero"):
        super().__init__()
        self._setDefault(outputCol="features", minVariance=MIN_VARIANCE,
                         maxCorrelation=CORRELATION_THRESHOLD, fill="zero")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FeatureScreenModel":
        names = self.getOrDefault(self.inputCols)
        stats = {r["feature"]: r for r in screen_statistics(dataset, names).collect()}
        varied = [
            c for c in names
            if stats[c]["n"] > 0 and (stats[c]["variance"] or 0.0) > self.getOrDefault(self.minVariance)
        ]
        if self.getOrDefault(self.fill) == "median":
            imputer = Imputer(strategy="median", inputCols=varied, outputCols=[f"_{c}" for c in varied])
            fitted = imputer.fit(dataset.select(*[F.col(c).cast("double").alias(c) for c in varied]))
            row = fitted.surrogateDF.first()
            fills = {c: float(row[c]) for c in varied}
        else:
            fills = dict.fromkeys(varied, 0.0)
        if not varied:
            raise ValueError("no feature varies")
        filled = dataset.select(
            *[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in varied]
        )
        vectors = VectorAssembler(inputCols=varied, outputCol="_v").transform(filled)
        matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
        dropped = set(correlated(matrix, varied, self.getOrDefault(self.maxCorrelation)))
        kept = [c for c in varied if c not in dropped]
        model = FeatureScreenModel()
        return model._set(
            inputCols=names, keptCols=kept, fillValues=[fills[c] for c in kept],
            outputCol=self.getOrDefault(self.outputCol),
        )


class FeatureScreenModel(Model, _ScreenParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept, fills = self.getOrDefault(self.keptCols), self.getOrDefault(self.fillValues)
        filled = dataset.withColumns(
            {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(kept, fills)}
        )
        assembled = VectorAssembler(
            inputCols=[f"_f_{c}" for c in kept], outputCol=self.getOrDefault(self.outputCol)
        ).transform(filled)
        return assembled.drop(*[f"_f_{c}" for c in kept])


# --- candidates --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Candidate:
    name: str
    classifier: Callable[[dict], Estimator]
    regressor: Callable[[dict], Estimator] | None
    space: dict[str, list] = field(default_factory=dict)
    weighted: bool = True
    scaled: bool = False


def _gbt(params: dict) -> dict:
    return {"maxDepth": 6, "maxIter": 30, "stepSize": 0.08, "minInstancesPerNode": 20, "seed": 42, **params}


def _forest(params: dict) -> dict:
    return {"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 42, **params}


BOOSTED = Candidate(
    "gbt",
    lambda p: GBTClassifier(**_gbt(p)),
    lambda p: GBTRegressor(**_gbt(p)),
    {
        "maxDepth": [4, 6, 8],
        "stepSize": [0.04, 0.06, 0.08, 0.12],
        "maxIter": [20, 30, 40],
        "minInstancesPerNode": [10, 20, 30, 40],
    },
)
FOREST = Candidate(
    "random_forest",
    lambda p: RandomForestClassifier(**_forest(p)),
    lambda p: RandomForestRegressor(**_forest(p)),
    {
        "numTrees": [50, 100, 200],
        "maxDepth": [8, 10, 15],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "0.6"],
    },
)


class Perceptron(MultilayerPerceptronClassifier):
    """A perceptron whose first layer has as many nodes as the features that it is fitted on, and whose last has two."""

    hidden: tuple[int, ...] = (64, 32)

    def _fit(self, dataset: DataFrame):
        inputs = dataset.select(F.size(vector_to_array(self.getFeaturesCol()))).first()
        sized = self.copy()
        sized.setLayers([inputs[0] if inputs else 1, *self.hidden, 2])
        return super(Perceptron, sized)._fit(dataset)


def neural(hidden: tuple[int, ...] = (64, 32), **defaults) -> Candidate:
    """Classifier only (Spark ML has no neural regressor). It takes no row weights: the classes are balanced by resampling."""
    def build(params: dict) -> Perceptron:
        out = Perceptron(**{"maxIter": 100, "seed": 42, **defaults, **params})
        out.hidden = hidden
        return out

    return Candidate("neural", build, None, {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.03, 0.1]}, weighted=False, scaled=True)


def resampled(df: DataFrame, label: str, weight: str | None = None, seed: int = 42) -> DataFrame:
    """Rows repeated so that every class weighs as much as the largest one, and inside a class each row by its ``weight``: by
    whole copies, and one more where a hash of the row falls below the rest. No row of the largest class goes missing without
    a weight; with one, a row of weight w stays with probability w over the largest weight. The hash makes it repeatable."""
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    totals = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.sum(w).alias("n"), F.max(w).alias("w")).collect()  # one row a class
    top_weight, most = max((r.w for r in totals), default=1.0) or 1.0, max((r.n for r in totals), default=0.0)
    rates = {r[label]: most / r.n / top_weight for r in totals if r.n}
    rate = F.lit(0.0)
    for value, times in rates.items():
        rate = F.when(F.col(label) == F.lit(value), w * times).otherwise(rate)
    if weight is None and rates:
        rate = F.greatest(rate, F.when(F.col(label).isNotNull(), F.lit(1.0)).otherwise(0.0))
    part = F.pmod(F.xxhash64(F.lit(seed), *[c for c in df.columns]), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(F.col("_rate")) + (part < F.col("_rate") - F.floor(F.col("_rate"))).cast("int")).cast("int")
    return df.withColumn("_rate", rate).withColumn("_copies", copies).filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    ).drop("_rate", "_copies", "_copy")


def fit_candidate(
    train: DataFrame, candidate: Candidate, kind: str, features: Sequence[str], label: str, params: dict | None = None, weight: str | None = None,
) -> PipelineModel:
    """The candidate's pipeline fitted on ``train``: with row weights where it takes them, else on resampled classes."""
    if kind == "classifier" and not candidate.weighted:
        train = resampled(train, label, weight)
    return model_pipeline(candidate, kind, features, label, params, weight).fit(train)


def with_fold(df: DataFrame, period: Sequence[str], folds: int) -> DataFrame:
    """Every row with the fold of its period, 0 without one. The periods are stored: a table of known size, and a small one, does
    not make Spark shuffle the rows in each of the many passes that training takes over them."""
    periods = stored(forward_folds(df, period, folds), "folds")
    return df.join(periods, list(period), "left").withColumn("fold", F.coalesce("fold", F.lit(0)))


def fold_predictions(
    df: DataFrame, candidate: Candidate, kind: str, features: Sequence[str], label: str, period: Sequence[str],
    params: dict | None = None, weight: str | None = None, folds: int = 3,
) -> DataFrame:
    """Every row of the test folds with the prediction of the model fitted on all earlier folds, and its ``fold``: what the
    metrics of the search are made of. A fold whose past has one class only, or no row, has no predictions."""
    placed = with_fold(df, period, folds)
    classes = {r.fold: r.classes for r in placed.groupBy("fold").agg(F.countDistinct(label).alias("classes")).collect()}  # one row a fold
    out = None
    for fold in range(1, folds + 1):
        known = [c for f, c in classes.items() if f < fold]
        if not known or (kind == "classifier" and max(known) < 2):
            continue
        model = fit_candidate(placed.filter(F.col("fold") < fold), candidate, kind, features, label, params, weight)
        part = model.transform(placed.filter(F.col("fold") == fold)).select(*df.columns, "fold", "prediction")
        out = part if out is None else out.unionByName(part)
    return placed.select(*df.columns, "fold", F.lit(None).cast("double").alias("prediction")).limit(0) if out is None else out


def model_pipeline(
    candidate: Candidate, kind: str, features: Sequence[str], label: str, params: dict | None = None,
    weight: str | None = None, fill: str = "zero",
) -> Pipeline:
    """Screen -> (standardise) -> estimator (M3)."""
    build = candidate.classifier if kind == "classifier" else candidate.regressor
    estimator = build(params or {})
    estimator = estimator.setLabelCol(label).setFeaturesCol("features")
    if weight and candidate.weighted:
        estimator = estimator.setWeightCol(weight)
    if not candidate.scaled:
        return Pipeline(stages=[FeatureScreen(inputCols=list(features), fill=fill), estimator])
    screen = FeatureScreen(inputCols=list(features), outputCol="_raw_features", fill=fill)
    scaler = StandardScaler(inputCol="_raw_features", outputCol="features", withMean=True)
    return Pipeline(stages=[screen, scaler, estimator])


# --- metrics and search ---------------------------------------------------------------------------

def balanced_accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean recall over the classes present, from confusion counts (M8)."""
    recall = scored.groupBy(label).agg(
        (F.count_if(F.col(label) == F.col(prediction)) / F.count(F.lit(1))).alias("recall")
    )
    return recall.agg(F.avg("recall").alias("balanced_accuracy"))


def mean_absolute_error(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.agg(F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"))


def draws(space: dict[str, list], count: int, seed: int) -> list[dict]:
    """Distinct seeded parameter draws; the defaults come first."""
    rng = random.Random(seed)
    chosen: list[dict] = [{}]
    for _ in range(50 * count):
        if len(chosen) > count:
            break
        draw = {k: rng.choice(v) for k, v in sorted(space.items())}
        if draw not in chosen:
            chosen.append(draw)
    return chosen


def cross_validate(
    df: DataFrame, candidate: Candidate, kind: str, features: Sequence[str], label: str,
    params: dict, weight: str | None, folds: int, sizes: dict[int, tuple[int, int]],
) -> list[float]:
    """Metric per forward fold; ``df`` carries the fold column of :func:`forward_folds` and
    ``sizes`` the (rows, classes) of each fold."""
    scores = []
    for fold in range(1, folds + 1):
        earlier = [sizes[f] for f in range(fold) if f in sizes]
        if not earlier or fold not in sizes:
            continue
        train, test = df.filter(F.col("fold") < fold), df.filter(F.col("fold") == fold)
        if kind == "classifier" and max(classes for _, classes in earlier) < 2:
            continue
        fitted = fit_candidate(train, candidate, kind, features, label, params, weight)
        scored = fitted.transform(test)
        metric = balanced_accuracy(scored, label) if kind == "classifier" else mean_absolute_error(scored, label)
        value = metric.first()[0]
        if value is not None:
            scores.append(float(value))
    return scores


@dataclass
class Fitted:
    candidate: str
    kind: str
    label: str
    model: PipelineModel
    params: dict
    scores: list[float]

    @property
    def mean(self) -> float | None:
        return sum(self.scores) / len(self.scores) if self.scores else None

    @property
    def std(self) -> float | None:
        if not self.scores:
            return None
        return (sum((s - self.mean) ** 2 for s in self.scores) / len(self.scores)) ** 0.5


def search(
    df: DataFrame, candidate: Candidate, kind: str, features: Sequence[str], label: str,
    period: Sequence[str], weight: str | None = None, folds: int = 3, tries: int = 12, seed: int = 42,
    tune: bool = True, selection_rows: int | None = None, order: Sequence[str] | None = None,
    parallelism: int = 4,
) -> Fitted:
    """Randomised search over forward folds, then a fit on all rows (M7). ``tune=False`` scores the
    defaults only; so does a label of one class, for which no draw can have a score. A draw that
    cannot be fitted is an error. The search uses all rows; ``selection_rows`` bounds it to the
    most recent ones, for classifiers only. Rows without a period are never tested, only trained on."""
    if selection_rows is not None and kind != "classifier":
        raise ValueError("only the search of a classifier may be bounded to recent rows")
    sample = df if selection_rows is None else recent_rows(df, order or period, selection_rows)
    with_folds = with_fold(sample, period, folds).persist()
    try:
        sizes = {
            r["fold"]: (r["n"], r["classes"])
            for r in with_folds.groupBy("fold").agg(
                F.count(F.lit(1)).alias("n"),
                (F.countDistinct(label) if kind == "classifier" else F.lit(2)).alias("classes"),
            ).collect()
        }
        classes = max((c for _, c in sizes.values()), default=0)
        options = draws(candidate.space, tries, seed) if tune and classes > 1 and tries else [{}]

        def attempt(params: dict) -> list[float]:
            return cross_validate(with_folds, candidate, kind, features, label, params, weight, folds, sizes)

        with ThreadPool(max(1, min(parallelism, len(options)))) as pool:
            results = pool.map(inheritable_thread_target(df.sparkSession)(attempt), options)
        best: tuple[float, dict, list[float]] | None = None
        for params, scores in zip(options, results):
            if not scores:
                continue
            mean = sum(scores) / len(scores)
            key = mean if kind == "classifier" else -mean
            if best is None or key > best[0]:
                best = (key, params, scores)
        _, params, scores = best or (0.0, {}, [])
    finally:
        with_folds.unpersist()
    model = fit_candidate(df, candidate, kind, features, label, params, weight)
    return Fitted(candidate.name, kind, label, model, params, scores)


def train_all(
    df: DataFrame, features: Sequence[str], candidates: Sequence[Candidate], period: Sequence[str],
    weight: str | None = None, points_rows: Column | None = None, **kwargs,
) -> list[Fitted]:
    """Start, appearance and points model of every candidate. The points model learns from
    ``points_rows``, by default those that started (M2). ``starts`` needs both classes: a proxy
    made from the features would leak (V7). A bound on the search holds for the classifiers."""
    counts = df.agg(F.count_if(F.col("starts") == 1), F.count(F.lit(1))).first()
    if counts[0] in (0, counts[1]):
        raise ValueError("start target has one class only; match minutes are needed")
    started = df.filter(F.col("starts") == 1 if points_rows is None else points_rows)
    if started.isEmpty():
        raise ValueError("no row to learn points from")
    for_points = {k: v for k, v in kwargs.items() if k != "selection_rows"}
    out = []
    for c in candidates:
        out.append(search(df, c, "classifier", features, "starts", period, weight, **kwargs))
        out.append(search(df, c, "classifier", features, "appears", period, weight, **kwargs))
        if c.regressor:
            out.append(search(started, c, "regressor", features, "total_points", period, weight, **for_points))
    return out


def selection_summary(fitted: Sequence[Fitted]) -> list[dict]:
    return [
        {"model": f.candidate, "target": f.label, "kind": f.kind, "mean": f.mean, "std": f.std, "folds": len(f.scores)}
        for f in fitted
    ]


def select_best(fitted: Sequence[Fitted], label: str) -> Fitted:
    """Best candidate for one target; the first one where no metric exists (M9)."""
    mine = [f for f in fitted if f.label == label]
    scored = [f for f in mine if f.scores]
    if not scored:
        return mine[0]
    return max(scored, key=lambda f: f.mean if f.kind == "classifier" else -f.mean)


def model_scores(df: DataFrame, fitted: Sequence[Fitted], keys: Sequence[str]) -> DataFrame:
    """Every candidate scores every row, in long form: keys, model, p_start, p_appear, points."""
    out = None
    for name in dict.fromkeys(f.candidate for f in fitted):
        by_label = {f.label: f for f in fitted if f.candidate == name}
        if "total_points" not in by_label:
            continue
        scored = df
        for label, column in (("starts", "p_start"), ("appears", "p_appear")):
            scored = by_label[label].model.transform(scored).withColumn(
                column, vector_to_array("probability")[1]
            ).drop("probability", "rawPrediction", "prediction", "features", "_raw_features")
        scored = by_label["total_points"].model.transform(scored).withColumnRenamed("prediction", "points_hat")
        part = scored.select(*keys, F.lit(name).alias("model"), "p_start", "p_appear", "points_hat")
        out = part if out is None else out.unionByName(part)
    return out


def save_models(fitted: Sequence[Fitted], path: str) -> None:
    for f in fitted:
        f.model.write().overwrite().save(f"{path}/{f.candidate}/{f.label}")


def load_model(path: str, candidate: str, label: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/{candidate}/{label}")


def feature_importance(model: PipelineModel, top: int) -> list[tuple[str, float]]:
    """Largest non-zero weights with their feature names (K4)."""
    kept = next(s for s in model.stages if isinstance(s, FeatureScreenModel))
    names = kept.getOrDefault(kept.keptCols)
    weights = model.stages[-1].featureImportances.toArray()
    pairs = [(n, float(w)) for n, w in zip(names, weights) if w != 0.0]
    return sorted(pairs, key=lambda p: (-abs(p[1]), p[0]))[:top]
