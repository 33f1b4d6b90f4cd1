"""How useful a synthetic table is: train on it (or on real rows), test on real rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.operators.encoders import bench_features
from tracekit.operators.sampling import exact_sample, two_way_split
from tracekit.session import cut

FEATURES, LABEL = "features_vec", "label"


def as_training(df: DataFrame, target: str, features: str = "features", positive=None) -> DataFrame:
    """Feature array to an ML vector and the target to a double; one-vs-rest when a positive value is given."""
    y = (F.col(target) == F.lit(positive)) if positive is not None else F.col(target)
    return df.withColumns({FEATURES: array_to_vector(F.col(features).cast("array<double>")), LABEL: y.cast("double")})


def learners(n_features: int, n_classes: int, seed: int = 0) -> dict[str, Estimator]:
    """The simple classifiers; Spark trees end at depth 30 and the SVM is scored by its margin."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    out: dict[str, Estimator] = {
        "logistic": LogisticRegression(maxIter=50, regParam=1e-3, **common),
        "tree": DecisionTreeClassifier(maxDepth=28, minInstancesPerNode=5, seed=seed, **common),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=10, seed=seed, **common),
        "perceptron": MultilayerPerceptronClassifier(layers=[n_features, 16, max(n_classes, 2)], maxIter=50, seed=seed, **common),
    }
    if n_classes == 2:
        out["svm"] = LinearSVC(maxIter=50, regParam=1e-3, **common)
    return out


def regressors(seed: int = 0) -> dict[str, Estimator]:
    """The simple regressors; a perceptron regressor does not exist in Spark."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    return {
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "tree": DecisionTreeRegressor(maxDepth=28, minInstancesPerNode=5, seed=seed, **common),
        "forest": RandomForestRegressor(numTrees=20, maxDepth=10, seed=seed, **common),
    }


def boosted(task: str, n_classes: int = 2, validation: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 0) -> Estimator:
    """Gradient boosted trees, stopped early on the rows flagged by ``validation``; several classes one-vs-rest."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "maxIter": rounds, "maxDepth": depth, "seed": seed}
    if validation:
        common["validationIndicatorCol"] = validation
    if task == "regression":
        return GBTRegressor(**common)
    if n_classes > 2:
        return BoostedClasses(GBTClassifier(**common), n_classes)
    return GBTClassifier(**common)


class BoostedClasses:
    """One boosted binary model per class, each stopped early on its own; the class of the highest probability wins.

    Spark's one-vs-rest wrapper hides the validation column, so early stopping needs the models one by one.
    """

    def __init__(self, binary: GBTClassifier, n_classes: int, models: Sequence = ()):
        self.binary, self.n_classes, self.models = binary, n_classes, list(models)

    def fit(self, rows: DataFrame) -> BoostedClasses:
        one = lambda c: self.binary.copy().fit(rows.withColumn(LABEL, (F.col(LABEL) == c).cast("double")))
        return BoostedClasses(self.binary, self.n_classes, [one(c) for c in range(self.n_classes)])

    def transform(self, rows: DataFrame) -> DataFrame:
        out, chances = rows, []
        for c, model in enumerate(self.models):
            names = [f"_prediction{c}", f"_raw{c}", f"_chance{c}"]
            model = model.copy().setPredictionCol(names[0]).setRawPredictionCol(names[1]).setProbabilityCol(names[2])
            out = model.transform(out)
            chances.append(F.get(vector_to_array(names[2]), 1))
        best = F.array(*chances)
        out = out.withColumn("prediction", (F.array_position(best, F.array_max(best)) - 1).cast("double"))
        return out.drop(*[f"_{n}{c}" for c in range(self.n_classes) for n in ("prediction", "raw", "chance")])


def early_stopping_rows(train: DataFrame, val: DataFrame, name: str = "is_val") -> DataFrame:
    return train.withColumn(name, F.lit(False)).unionByName(val.withColumn(name, F.lit(True)))


# ---- scores -----------------------------------------------------------------------------

def confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by, LABEL, "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro F1 and support-weighted F1 from a confusion table."""
    by = list(by)
    actual = cells.groupBy(*by, F.col(LABEL).alias("c")).agg(F.sum("n").alias("na"))
    given = cells.groupBy(*by, F.col("prediction").alias("c")).agg(F.sum("n").alias("np"))
    hit = cells.where(F.col(LABEL) == F.col("prediction")).groupBy(*by, F.col(LABEL).alias("c")).agg(F.sum("n").alias("nh"))
    per = actual.join(given, [*by, "c"], "full").join(hit, [*by, "c"], "left").fillna(0, ["na", "np", "nh"])
    f1 = 2 * F.col("nh") / (F.col("na") + F.col("np"))
    return per.groupBy(*by).agg(
        (F.sum("nh") / F.sum("na")).alias("accuracy"), F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("na")) / F.sum("na")).alias("weighted_f1"))


def evaluate(pred: DataFrame, n_classes: int) -> dict[str, float]:
    """Accuracy, F1 (macro for two classes, weighted otherwise) and AUC where the learner gives a score."""
    row = class_scores(confusion(pred)).first()
    out = {"acc": row["accuracy"], "f1": row["macro_f1"] if n_classes == 2 else row["weighted_f1"]}
    if n_classes == 2 and "rawPrediction" in pred.columns:
        out["roc_auc"] = BinaryClassificationEvaluator(labelCol=LABEL).evaluate(pred)
    return out


def regression_scores(pred: DataFrame) -> dict[str, float]:
    e = F.col(LABEL) - F.col("prediction")
    row = pred.agg(F.avg(e * e).alias("mse"), F.var_pop(LABEL).alias("v")).first()
    return {"r2": 1 - row["mse"] / row["v"] if row["v"] else 0.0, "rmse": row["mse"] ** 0.5}


# ---- comparisons ------------------------------------------------------------------------

def train_on_both(model: Estimator, real: DataFrame, syn: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """(key, actual, from_real, from_synthetic) for the same real test rows."""
    out = test.select(key, F.col(LABEL).alias("actual"))
    for name, rows in (("from_real", real), ("from_synthetic", syn)):
        out = out.join(model.fit(rows).transform(test).select(key, F.col("prediction").alias(name)), key)
    return out


def utility_difference(
    models: Mapping[str, Estimator], real: DataFrame, synthetics: Sequence[DataFrame], test: DataFrame, n_classes: int
) -> DataFrame:
    """(learner, metric, real, synthetic, difference): synthetic is the mean over the given tables."""
    rows = []
    for name, model in models.items():
        base = evaluate(model.fit(real).transform(test), n_classes)
        made = [evaluate(model.fit(s).transform(test), n_classes) for s in synthetics]
        for metric, value in base.items():
            mean = sum(m[metric] for m in made) / len(made)
            rows.append((name, metric, value, mean, value - mean))
    return real.sparkSession.createDataFrame(rows, "learner string, metric string, real double, synthetic double, difference double")


def training_source(real: DataFrame, syn: DataFrame, kind: str) -> DataFrame:
    if kind not in ("real", "synthetic", "merged"):
        raise ValueError(f"unknown training source {kind}")
    return real if kind == "real" else syn if kind == "synthetic" else real.unionByName(syn)


def score_learners(
    models: Mapping[str, Estimator], sources: Mapping[str, DataFrame], tests: Mapping[str, DataFrame], score: Callable
) -> DataFrame:
    """Long scores (source, learner, split, metric, value) of every learner on every source and split."""
    rows, spark = [], None
    for source, train in sources.items():
        spark = train.sparkSession
        train = cut(train, "train")
        for name, model in models.items():
            fitted = model.fit(train)
            for split, test in tests.items():
                rows += [(source, name, split, m, float(v)) for m, v in score(fitted.transform(test)).items()]
    return spark.createDataFrame(rows, "source string, learner string, split string, metric string, value double")


def repeat_scores(
    datasets: Callable[[int], tuple[Mapping[str, DataFrame], Mapping[str, DataFrame]]], models: Callable[[int], Mapping[str, Estimator]],
    dataset_seeds: Sequence[int], model_seeds: Sequence[int], score: Callable,
) -> DataFrame:
    """The scores of ``score_learners`` for every dataset seed and model seed, written as one table with both seeds.

    ``datasets(seed)`` returns the training sources and the tests made with that seed, ``models(seed)`` the learners.
    """
    long = None
    for d in dataset_seeds:
        sources, tests = datasets(d)
        for m in model_seeds:
            rows = score_learners(models(m), sources, tests, score).withColumns({"dataset_seed": F.lit(d), "model_seed": F.lit(m)})
            long = rows if long is None else long.unionByName(rows)
    return cut(long, "scores")


def summarize_scores(scores: DataFrame, by: Sequence[str] = ("source", "split", "metric")) -> DataFrame:
    """count, mean and standard deviation (population) over seeds and learners."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def discriminate(model: Estimator, real: DataFrame, syn: DataFrame, key: str, seed, ratio: float = 0.5) -> DataFrame:
    """(key, label, prediction) on the held-out part: can real (1) and synthetic (0) rows be told apart?"""
    # as many rows of either kind: a larger table would be the safer guess for every row
    n = min(real.count(), syn.count())
    real, syn = (exact_sample(d, n, f"{seed}-{name}", key) for d, name in ((real, "real"), (syn, "synthetic")))
    both = real.withColumn(LABEL, F.lit(1.0)).unionByName(syn.withColumn(LABEL, F.lit(0.0)))
    both = cut(two_way_split(both, ratio, seed, key, LABEL), "labelled")
    fitted = model.fit(both.where("split = 'train'"))
    return fitted.transform(both.where("split = 'test'")).select(key, LABEL, "prediction")


def copying_test(model: Estimator, train: DataFrame, test: DataFrame, syn: DataFrame, key: str) -> DataFrame:
    """(key, prediction): do synthetic rows look like the training rows (1) or like unseen ones (0)?"""
    both = cut(train.withColumn(LABEL, F.lit(1.0)).unionByName(test.withColumn(LABEL, F.lit(0.0))), "labelled")
    return model.fit(both).transform(syn).select(key, "prediction")


def prepare(real: DataFrame, others: Sequence[DataFrame], numeric, categorical, target: str, positive=None) -> list[DataFrame]:
    return [cut(as_training(d, target, positive=positive), "features") for d in bench_features(real, others, numeric, categorical)]
