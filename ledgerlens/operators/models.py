"""Models as ML pipelines: logistic regression, boosted trees, searches, univariate and add-one logits, importances."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import finite, known_or
from ledgerlens.operators.metrics import pr_point, rank_metrics, top_decile_lift


def prepared(df: DataFrame, features: Sequence[str], label: str = "fraud", id_col: str = "id") -> DataFrame:
    """Id, label and features as finite doubles, with the weights that balance the classes."""
    a = df.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"), *(finite(F.col(c).cast("double")).alias(c) for c in features))
    n, pos = a.agg(F.count("label"), F.sum("label")).first()
    pos = pos or 0.0
    return a.withColumn("weight", F.when(F.col("label") == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1))))


def fit_logit(train: DataFrame, features: Sequence[str], *, iterations: int = 100) -> PipelineModel:
    """Scaled, class-balanced, ridge with the unit penalty of a summed loss."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=False), LogisticRegression(weightCol="weight", regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False, maxIter=iterations)]
    return Pipeline(stages=stages).fit(train)


def fit_plain_logit(train: DataFrame, features: Sequence[str], label: str = "fraud", *, iterations: int = 100) -> PipelineModel:
    """Neither weighted nor penalised: the maximum likelihood."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), LogisticRegression(labelCol=label, regParam=0.0, standardization=True, maxIter=iterations, tol=1e-10)]
    return Pipeline(stages=stages).fit(train)


def fit_trees(train: DataFrame, features: Sequence[str], *, validation: str | None = None, **options) -> PipelineModel:
    """Boosted trees; ``validation`` names a boolean column of rows for early stopping."""
    gbt = GBTClassifier(**({"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42, "weightCol": "weight"} | options))
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt]).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``id, label, score``: the probability of class 1."""
    return model.transform(df).select("id", "label", vector_to_array("probability")[1].alias("score"))


def random_search(train: DataFrame, valid: DataFrame, features: Sequence[str], space: Mapping[str, Sequence], *, trials: int = 10, seed: int = 42, min_recall: float | None = None) -> tuple[PipelineModel, list[dict]]:
    """Seeded draws of tree parameters; the best by average precision on ``valid``, or by precision under a recall floor there."""
    draw, best, log = random.Random(seed), None, []
    train, valid = train.cache(), valid.cache()
    try:
        for t in range(trials):
            options = {k: draw.choice(list(v)) for k, v in space.items()}
            model = fit_trees(train, features, **options)
            scored = score(model, valid)
            if min_recall is None:
                value = rank_metrics(scored).first().prauc
            else:
                top = pr_point(scored, min_recall).first()
                value = top.precision if top else -1.0
            log.append({"trial": t, "value": value} | options)
            if best is None or value is not None and value > best[0]:
                best = (value, model)
    finally:
        train.unpersist()
        valid.unpersist()
    return best[1], log


def one_hot(categories: Sequence[str]) -> Pipeline:
    """Categories to indicator vectors; null is ``UNK`` (see ``with_unknown``), unseen ones are all zeros but their own slot."""
    return Pipeline(stages=[*(StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categories), OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_vec" for c in categories], dropLast=False, handleInvalid="keep")])


def with_unknown(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    return df.withColumns({c: known_or(F.col(c).cast("string")) for c in categories})


def baseline_frame(df: DataFrame, *, drop: Sequence[str] = ("id", "date", "amount"), categories: Sequence[str] = ("mcc",)) -> DataFrame:
    """What a baseline model may see: no ids, dates and raw amounts; categories as text, null as ``UNK``."""
    return with_unknown(df.drop(*drop), categories)


def imputed(columns: Sequence[str]) -> Pipeline:
    """Medians for missing numbers, then scaling."""
    return Pipeline(stages=[Imputer(inputCols=list(columns), outputCols=[f"{c}_filled" for c in columns], strategy="median"), VectorAssembler(inputCols=[f"{c}_filled" for c in columns], outputCol="filled"), StandardScaler(inputCol="filled", outputCol="features", withMean=True)])


def _glm(df: DataFrame, features: Sequence[str], label: str):
    data = VectorAssembler(inputCols=list(features), outputCol="__features").transform(df.select("id", F.col(label).cast("double").alias("label"), *(finite(F.col(c).cast("double")).alias(c) for c in features)))
    return GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__features", maxIter=50).fit(data), data


def univariate_logits(df: DataFrame, features: Sequence[str], label: str = "fraud") -> DataFrame:
    """One logit per feature: coefficient, odds ratio and p value. Features without variation are left out."""
    moving = df.agg(*((F.max(c) > F.min(c)).alias(c) for c in features)).first().asDict()
    rows = []
    for c in (c for c in features if moving[c]):
        model, _ = _glm(df, [c], label)
        coef = float(model.coefficients[0])
        rows.append((c, coef, math.exp(min(coef, 700.0)), float(model.summary.pValues[0])))
    return df.sparkSession.createDataFrame(rows, "feature string, coef double, odds_ratio double, p_value double")


def add_one_lifts(df: DataFrame, baseline: Sequence[str], candidates: Sequence[str], label: str = "fraud", q: float = 0.9) -> DataFrame:
    """How the top decile's lift changes when one candidate joins the baseline."""

    def lift(features: Sequence[str]) -> float:
        model, data = _glm(df, features, label)
        return top_decile_lift(model.transform(data).select("label", F.col("prediction").alias("score")), q).first().lift

    base = lift(baseline)
    rows = [(c, base, with_it, with_it - base) for c in candidates if c not in baseline for with_it in [lift([*baseline, c])]]
    return df.sparkSession.createDataFrame(rows, "feature string, base_lift double, lift double, delta double").orderBy(F.desc("delta"))


def masking_importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Loss of average precision when one feature is replaced by its mean: model-agnostic, no shuffle of rows."""
    base = rank_metrics(score(model, df)).first().prauc
    means = df.agg(*(F.avg(c).alias(c) for c in features)).first()
    rows = [(c, base - rank_metrics(score(model, df.withColumn(c, F.lit(means[c])))).first().prauc) for c in features]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def tree_importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(features, values)], "feature string, importance double")


def drop_one(train: DataFrame, valid: DataFrame, features: Sequence[str], **options) -> DataFrame:
    """Average precision without each feature, against all of them."""
    ap = lambda some: rank_metrics(score(fit_trees(train, some, **options), valid)).first().prauc
    base = ap(list(features))
    rows = [(c, base, without, base - without) for c in features for without in [ap([f for f in features if f != c])]]
    return train.sparkSession.createDataFrame(rows, "feature string, base double, without double, loss double")
