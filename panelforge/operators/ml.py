"""Supervised checks: grouped cross-validation, baselines, confusion metrics, rule trees."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stash
from .partitions import dominant_label


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): largest groups first, each to the lightest fold so far; a row for each group in one task of an executor."""

    def deal(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["n", group], ascending=[False, True], kind="stable")
        load, fold = [(0, k) for k in range(folds)], []
        for n in t.n:
            held, k = heapq.heappop(load)
            fold.append(k)
            heapq.heappush(load, (held + int(n), k))
        return t[[group]].assign(fold=np.array(fold, np.int32))

    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    # written, so that later joins know its size and broadcast it only if it is small
    return stash(sizes.groupBy().applyInPandas(deal, f"{group} {dict(rows.dtypes)[group]}, fold int"))


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """rows with fold: each class dealt round by hash order of the key."""
    return rows.selectExpr("*", f"cast(pmod(row_number() over (partition by {label} order by xxhash64({key}), {key}) - 1, {folds}) as int) as fold")


def separated(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """(groups, shared): shared counts groups that are in more than one fold; grouped folds must give 0."""
    x = rows.groupBy(group).agg(F.count_distinct(fold).alias("f"))
    return x.agg(F.count("*").alias("groups"), F.count_if(F.col("f") > 1).alias("shared"))


def majority_baseline(rows: DataFrame, label: str, key: str) -> DataFrame:
    """(key, fold, truth, predicted): each fold is predicted the most frequent class of the others; ties to the smaller."""
    folds = rows.select(F.col("fold").alias("held")).distinct()
    train = rows.crossJoin(F.broadcast(folds)).where("fold <> held").select("held", label)  # one row for each fold
    best = dominant_label(train, ["held"], label).select(F.col("held").alias("fold"), F.col("modal").alias("predicted"))
    return rows.join(F.broadcast(best), "fold").select(key, "fold", F.col(label).alias("truth"), "predicted")


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def scores(predictions: DataFrame) -> DataFrame:
    """(n, accuracy, balanced_accuracy, macro_f1) over the classes that occur on either side."""
    c = confusion(predictions)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    t = c.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("actual"), F.sum(hit).alias("tp"))
    p = c.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("claimed"))
    x = t.join(p, "c", "full").na.fill(0)
    f1 = F.when(F.col("actual") + F.col("claimed") > 0, 2 * F.col("tp") / (F.col("actual") + F.col("claimed"))).otherwise(0.0)
    return x.agg(F.sum("actual").alias("n"), (F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, F.col("tp") / F.col("actual"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def cross_validate(rows: DataFrame, features: list[str], label: str, key: str, model: str = "logistic", seed: int = 0, trees: int = 60) -> DataFrame:
    """(key, fold, truth, predicted, p_truth): median imputation, scaling, class-balanced multinomial logistic or random forest per fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = stash(rows.select(key, "fold", F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in features)))
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    filled = [f"{c}_i" for c in features]
    last = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", maxIter=50, regParam=0.01) if model == "logistic" else RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, minInstancesPerNode=3, seed=seed)
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), last]
    out = None
    for k in folds:
        train = rows.where(F.col("fold") != k)
        n = train.groupBy("_y").agg(F.count("*").alias("_n"))
        total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
        weights = n.crossJoin(F.broadcast(total)).select("_y", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("_w"))  # a row for each class
        fit = Pipeline(stages=steps).fit(train.join(F.broadcast(weights), "_y"))
        own = F.element_at(vector_to_array("probability"), (F.col("_y") + 1).cast("int"))
        got = fit.transform(rows.where(F.col("fold") == k)).select(key, "fold", F.col("_y").cast("bigint").alias("truth"), F.col("prediction").cast("bigint").alias("predicted"), F.coalesce(own, F.lit(0.0)).alias("p_truth"))
        out = got if out is None else out.unionByName(got)
    return out


def log_loss(predictions: DataFrame) -> DataFrame:
    """(n, log_loss): mean negative log of the probability given to the truth, held off zero."""
    return predictions.agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(F.col("p_truth"), F.lit(1e-15)))).alias("log_loss"))


def class_recall(predictions: DataFrame, least: float) -> DataFrame:
    """(truth, n, recall, named): classes whose recall is at least ``least`` may be named."""
    x = predictions.groupBy("truth").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("recall"))
    return x.withColumn("named", F.col("recall") >= least)


def rule_tree(rows: DataFrame, features: list[str], label: str, depth: int = 3) -> DataFrame:
    """(line, rule): a shallow decision tree as text."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows.select(F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in features)))
    text = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, minInstancesPerNode=3, seed=0).fit(x).toDebugString
    for k, name in reversed(list(enumerate(features))):
        text = text.replace(f"feature {k} ", f"{name} ")
    return rows.sparkSession.createDataFrame(list(enumerate(text.splitlines()[1:])), "line bigint, rule string")
