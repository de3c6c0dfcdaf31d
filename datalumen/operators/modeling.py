"""Baseline random forests with feature preparation, metrics and importances."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import FeatureHasher, Imputer, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalumen.functions.columns import col, is_numeric, is_text, join_null_safe
from datalumen.operators.quantiles import BRACKETS, quantiles
from datalumen.session import checkpointed, sent

TREES = 50
SEED = 42
MIN_ROWS = 15
#: Places that the levels of a text column are hashed to, the same at every size of the table.
HASH_WIDTH = 256
#: Bytes of rows, as the forest keeps them (a number per feature and per tree), that one task reads in each round.
TASK_BYTES = 128_000_000


class NotTrainable(ValueError):
    """The table does not allow a model; the message says why."""


def problem_type(df: DataFrame, target: str) -> str:
    """Classification for text, booleans and up to ten distinct values, else regression."""
    field = df.schema[target]
    if is_text(field) or isinstance(field.dataType, T.BooleanType):
        return "classification"
    few = df.select(col(target)).filter(col(target).isNotNull()).distinct().limit(11).count() <= 10
    return "classification" if few else "regression"


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """Columns left once ids, dates and the target are gone."""
    return [
        f.name for f in df.schema
        if f.name != target and not f.name.lower().endswith("id") and "date" not in f.name.lower()
        and (is_numeric(f) or is_text(f) or isinstance(f.dataType, T.BooleanType))
    ]


def feature_stages(df: DataFrame, features: list[str], width: int = HASH_WIDTH) -> tuple[DataFrame, list, list[str]]:
    """Stages for median fill and hashed text: the levels of each text column share ``width`` places, however many there are.

    Places without a level, and other features that never vary, are left out, since they would stand in the way of the trees' choice.
    """
    numbers = [c for c in features if not is_text(df.schema[c])]
    frame = df.withColumns({c: col(c).cast("double") for c in numbers})
    stages, inputs = [], []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=[f"num_{c}" for c in numbers]))
        inputs += [f"num_{c}" for c in numbers]
    for c in features:
        if c not in numbers:
            stages.append(FeatureHasher(inputCols=[c], outputCol=f"hash_{c}", numFeatures=width))
            inputs.append(f"hash_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="every"))
    stages.append(VarianceThresholdSelector(featuresCol="every", outputCol="features", varianceThreshold=0.0))
    return frame, stages, inputs


def task_count(rows: int, features: int) -> int:
    """Tasks among which that many rows are dealt so that each keeps at most ``TASK_BYTES`` of them."""
    return max(1, ceil(rows * (4 * (features + TREES) + 100) / TASK_BYTES))


def test_quarter(df: DataFrame, by: list[str], name: str = "_test", tasks: int | None = None) -> DataFrame:
    """Add whether a row is in the test quarter: ceil(n / 4) of the n rows of each group, by a number drawn for each row.

    The rows are written down with their numbers (in the shared checkpoint folder), so that the split survives retries; the border number of each
    group is an exact quantile, sent to the rows unless there are very many groups. With more than one of ``tasks`` the rows are dealt among so
    many by their numbers, as a file of few blocks would leave them to few; rows of one task are joined as Spark sees fit.
    """
    rows = df.withColumn("_draw", F.rand(SEED))
    drawn = checkpointed(rows.repartition(tasks, "_draw").sortWithinPartitions("_draw") if (tasks or 1) > 1 else rows)
    border = quantiles(drawn, ["_draw"], [0.25], by).select(*[col(k) for k in by], F.get("_draw", 0).alias("_border"))
    met = join_null_safe(drawn, border if tasks == 1 else sent(border, BRACKETS), by) if by else drawn.withColumn("_border", checkpointed(border).scalar())
    return met.select(*[col(c) for c in df.columns], (F.col("_draw") <= F.col("_border")).alias(name))


def split_sizes(df: DataFrame, target: str) -> DataFrame:
    """Rows, training rows and test rows of each class of the target."""
    rows = test_quarter(df.filter(col(target).isNotNull()).select(col(target)), [target])
    return rows.groupBy(col(target).alias("target_class")).agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("_test")).alias("train_rows"), F.count_if("_test").alias("test_rows"))


@dataclass(frozen=True)
class Baseline:
    kind: str
    model: PipelineModel
    metrics: DataFrame
    importance: DataFrame


def train_baseline(df: DataFrame, target: str, kind: str | None = None, width: int = HASH_WIDTH) -> Baseline:
    """Fit 50 trees on three quarters of the rows (of each class) and score the rest; ``width`` is that of hashed text."""
    rows = df.filter(col(target).isNotNull())
    n = rows.count()
    if n < MIN_ROWS:
        raise NotTrainable(f"fewer than {MIN_ROWS} rows")
    kind = kind or problem_type(rows, target)
    features = feature_columns(rows, target)
    if not features:
        raise NotTrainable("no predictor left once ids and dates are gone")
    # The stages know the columns by number, since they take no names with dots.
    short = [f"c{i}" for i in range(len(features))]
    frame = rows.select(*[col(c).alias(s) for c, s in zip(features, short)], col(target).alias("_target"))
    places = sum(width if is_text(frame.schema[s]) else 1 for s in short)
    frame = test_quarter(frame, ["_target"] if kind == "classification" else [], tasks=task_count(n, places))
    frame, stages, inputs = feature_stages(frame, short, width)
    classes = 0
    if kind == "classification":
        if rows.select(col(target)).distinct().limit(2).count() < 2:
            raise NotTrainable("the target has one class only")
        # Labels are indexed over all rows: a class may occur on one side of the split only.
        frame = frame.withColumn("_target", F.col("_target").cast("string"))
        index = StringIndexer(inputCol="_target", outputCol="label").fit(frame)
        frame, classes = index.transform(frame), len(index.labels)
        forest = RandomForestClassifier(numTrees=TREES, seed=SEED)
    else:
        frame = frame.withColumn("label", F.col("_target").cast("double"))
        forest = RandomForestRegressor(numTrees=TREES, seed=SEED)
    train, test = frame.filter(~F.col("_test")), frame.filter("_test")
    prepared = Pipeline(stages=stages).fit(train)
    if not prepared.stages[-1].selectedFeatures:
        raise NotTrainable("no predictor varies")
    model = PipelineModel([*prepared.stages, forest.fit(prepared.transform(train))])
    scored = model.transform(test)
    metrics = _metrics(scored, kind, classes)
    sizes = frame.agg(F.count_if(~F.col("_test")).alias("train"), F.count_if("_test").alias("test")).first()
    found = [("train_rows", float(sizes["train"])), ("test_rows", float(sizes["test"])), *metrics.items()]
    spark = df.sparkSession
    return Baseline(
        kind, model, spark.createDataFrame(found, "metric string, value double").withColumn("value", F.round("value", 4)),
        spark.createDataFrame(_importance(model, inputs, features, width), "feature string, importance double, importance_pct double"))


def _metrics(scored: DataFrame, kind: str, classes: int) -> dict[str, float]:
    """Scores of the test rows in one pass (two with a binary target)."""
    if kind == "regression":
        gap = F.col("prediction") - F.col("label")
        sums = scored.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.var_pop("label").alias("spread")).first()
        r2 = 1 - sums["mse"] / sums["spread"] if sums["spread"] else 0.0
        return {"mae": sums["mae"], "rmse": sums["mse"] ** 0.5, "r2": r2}
    pairs = {(r["label"], r["prediction"]): r["n"] for r in scored.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()}
    total = sum(pairs.values())
    true, said = {}, {}
    for (label, guess), n in pairs.items():
        true[label] = true.get(label, 0) + n
        said[guess] = said.get(guess, 0) + n
    precision = recall = f1 = 0.0
    for label, n in true.items():
        hit = pairs.get((label, label), 0)
        p, r = hit / said[label] if label in said else 0.0, hit / n
        precision, recall, f1 = precision + p * n / total, recall + r * n / total, f1 + (2 * p * r / (p + r) * n / total if hit else 0.0)
    out = {"accuracy": sum(n for (label, guess), n in pairs.items() if label == guess) / total,
           "precision": precision, "recall": recall, "f1_score": f1}
    if classes == 2:
        out["roc_auc"] = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)
    return out


def _importance(model: PipelineModel, inputs: list[str], features: list[str], width: int, top: int = 5) -> list[tuple[str, float, float]]:
    """Importances summed back to their source column, the best five with their share among the five."""
    sizes = [width if name.startswith("hash_") else 1 for name in inputs]
    values = np.zeros(sum(sizes))
    values[list(model.stages[-2].selectedFeatures)] = model.stages[-1].featureImportances.toArray()
    totals, start = {}, 0
    for name, size in zip(inputs, sizes):
        source = features[int(name.split("_c", 1)[1])]
        totals[source] = totals.get(source, 0.0) + float(values[start:start + size].sum())
        start += size
    best = sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
    whole = sum(v for _, v in best)
    return [(k, round(v, 6), round(100 * v / whole, 2) if whole else 0.0) for k, v in best]
