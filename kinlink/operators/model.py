"""Gradient-boosted matcher over pair features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Presets of learning: full matcher, fast variant and notebook variant. Spark grows trees by depth, so a number of
#: leaves becomes the depth that holds it.
PRESETS: dict[str, dict] = {
    "matcher": {"rounds": 60, "step": 0.1, "depth": 5, "subsample": 0.8},
    "fast": {"rounds": 350, "step": 0.08, "depth": 6, "subsample": 0.8},
    "notebook": {"rounds": 600, "step": 0.05, "depth": 6, "subsample": 0.8},
}


def save(model: PipelineModel, path: str) -> None:
    """Writes a fitted matcher over an older one."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 60, step: float = 0.1, depth: int = 5, subsample: float = 0.8, validation: str | None = None, seed: int = 42) -> PipelineModel:
    """A fitted pipeline of assembler and boosted trees; ``validation`` marks rows for early stopping."""
    from pyspark.ml import Pipeline

    trees = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=subsample, featureSubsetStrategy="0.8", seed=seed)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with prob, the probability of the label 1."""
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, larger first."""
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def quality(model: PipelineModel, rows: DataFrame, label: str = "label") -> dict[str, float]:
    """Areas under the ROC and the precision-recall curve."""
    out = model.transform(rows.withColumn(label, F.col(label).cast("double")))
    return {m: BinaryClassificationEvaluator(labelCol=label, metricName=m).evaluate(out) for m in ("areaUnderROC", "areaUnderPR")}
