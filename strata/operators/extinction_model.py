"""A random forest that tells which genera are absent from the next bin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.ranking import shuffled_rank
from strata.functions.shared import written

FEATURES = ("geographic_range", "abundance", "lat_range", "env_breadth", "age")
TARGET = "extinct_next_bin"


@dataclass
class ExtinctionModel:
    pipeline: PipelineModel
    features: tuple[str, ...]
    train: DataFrame
    test: DataFrame

    @property
    def forest(self) -> RandomForestClassificationModel:
        return self.pipeline.stages[-1]


def stratified_split(features: DataFrame, share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Exactly ``share`` of each class (rounded down) to train on, the rest to test; the same rows whatever the partitioning."""
    ranked = shuffled_rank(features, [TARGET], F.xxhash64("genus", "time_bin", F.lit(seed)), "_rank")
    sizes = F.broadcast(features.groupBy(TARGET).agg(F.count("*").alias("_n")))
    marked = ranked.join(sizes, TARGET).withColumn("_train", F.col("_rank") < F.floor(F.col("_n") * share)).drop("_rank", "_n")
    return marked.filter("_train").drop("_train"), marked.filter("not _train").drop("_train")


def split_sizes(features: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Rows of each class on either side of ``stratified_split``."""
    train, test = stratified_split(features, share, seed)
    sides = train.select(TARGET, F.lit("train").alias("side")).unionByName(test.select(TARGET, F.lit("test").alias("side")))
    return sides.groupBy("side", TARGET).agg(F.count("*").alias("n"))


def fit(features: DataFrame, names: tuple[str, ...] = FEATURES, trees: int = 100, depth: int = 10, share: float | None = 0.7, least: int = 100, seed: int = 42) -> ExtinctionModel | None:
    """None with fewer than ``least`` rows or with one class only.  ``share`` None: all rows are trained on and tested.

    Both sides of the split are written once: fitting and scoring read them several times, and each time the ranks would be sorted anew.
    """
    features = features.fillna(0, list(names))
    counts = {r[TARGET]: r["n"] for r in features.groupBy(TARGET).agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if total < least or len(counts) < 2:
        return None
    train, test = (written(side, "forest") for side in stratified_split(features, share, seed)) if share else (features, features)
    weight = F.when(F.col(TARGET) == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    assembled = VectorAssembler(inputCols=list(names), outputCol="features")
    forest = RandomForestClassifier(labelCol=TARGET, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    model = forest.fit(assembled.transform(train.withColumn("weight", weight)))
    return ExtinctionModel(PipelineModel([assembled, model]), names, train, test)


def metrics(model: ExtinctionModel) -> DataFrame:
    """One row: sizes, accuracy, area under the curve (0.5 if undefined), and precision, recall and F1 of both classes."""
    scored = model.pipeline.transform(model.test).select(TARGET, "prediction", "rawPrediction")
    label, said = F.col(TARGET), F.col("prediction").cast("long")
    count = lambda a, b: F.count_if((label == a) & (said == b)).alias(f"n{a}{b}")
    sums = scored.agg(count(0, 0), count(0, 1), count(1, 0), count(1, 1))
    auc = BinaryClassificationEvaluator(labelCol=TARGET, rawPredictionCol="rawPrediction").evaluate(scored)
    n = lambda a, b: F.col(f"n{a}{b}")
    total = n(0, 0) + n(0, 1) + n(1, 0) + n(1, 1)
    out = [total.alias("test_rows"), F.try_divide(n(0, 0) + n(1, 1), total).alias("accuracy"), F.lit(float(auc) if auc == auc else 0.5).alias("roc_auc")]
    for k, name in ((0, "survivor"), (1, "extinct")):
        precision, recall = F.try_divide(n(k, k), n(0, k) + n(1, k)), F.try_divide(n(k, k), n(k, 0) + n(k, 1))
        out += [precision.alias(f"{name}_precision"), recall.alias(f"{name}_recall"), F.try_divide(2 * precision * recall, precision + recall).alias(f"{name}_f1")]
    return sums.select(*out)


def feature_importances(model: ExtinctionModel) -> DataFrame:
    found = [(n, float(v)) for n, v in zip(model.features, model.forest.featureImportances.toArray())]
    return model.train.sparkSession.createDataFrame(found, "feature string, importance double").orderBy(F.desc("importance"), "feature")
