"""Sentence selection: pair features, a weighted logistic model and threshold sweeps."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.numbers import ratio
from attestra.operators.models import weighted_scaler

FEATURES = ["jaccard", "claim_coverage", "number_match", "negation_match", "length_ratio"]


def features(pairs: DataFrame, claim: str = "claim_text", sentence: str = "text") -> DataFrame:
    """Overlap, number and negation agreement, and length ratio of claim and sentence."""
    c, s = T.token_set(F.col(claim)), T.token_set(F.col(sentence))
    n, m = T.numbers(F.col(claim)), T.numbers(F.col(sentence))
    return pairs.withColumns({
        "jaccard": T.jaccard(c, s), "claim_coverage": T.coverage(c, s), "number_match": F.when(F.size(n) == 0, 1.0).otherwise(T.coverage(n, m)),
        "negation_match": (F.col(claim).rlike(T.NEGATION) == F.col(sentence).rlike(T.NEGATION)).cast("double"), "length_ratio": ratio(F.least(F.length(claim), F.length(sentence)), F.greatest(F.length(claim), F.length(sentence))),
    })


def balanced_weights(rows: DataFrame, claim: str = "claim_id", label: str = "label") -> DataFrame:
    """Weights that give each class of a claim half of the claim's weight, and each claim the same."""
    size = F.count(F.lit(1)).over(Window.partitionBy(claim, label))
    classes = F.size(F.collect_set(label).over(Window.partitionBy(claim)))
    return rows.withColumn("weight", 1.0 / (size * classes))


def scaled(rows: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """``rows`` with each feature less its mean, in deviations."""
    return rows.withColumns({f"scaled_{c}": (F.col(c) - F.lit(mean)) / F.lit(spread) for c, (mean, spread) in moments.items()})


def fit(rows: DataFrame, label: str = "label"):
    """A logistic regression on features standardised by the weights of the training rows: the moments and the fitted model."""
    moments = weighted_scaler(rows, FEATURES)
    stages = [VectorAssembler(inputCols=[f"scaled_{c}" for c in FEATURES], outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", standardization=False, regParam=1e-3, maxIter=60)]
    return moments, Pipeline(stages=stages).fit(scaled(rows, moments))


def score(model, rows: DataFrame) -> DataFrame:
    moments, fitted = model
    made = fitted.transform(scaled(rows, moments)).withColumn("score", vector_to_array("probability")[1])
    return made.select(*rows.columns, "score")


def sweep(scored: DataFrame, thresholds: list[float], label: str = "label", least_recall: float = 0.0) -> DataFrame:
    """(threshold, precision, recall, f1, best): pooled scores at each threshold; best is the highest F1 (then threshold) among those of ``least_recall``."""
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    counts = scored.select("score", label, grid).groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("got"), F.count_if((F.col("score") >= F.col("threshold")) & (F.col(label) == 1)).alias("hit"), F.count_if(F.col(label) == 1).alias("want"))
    made = counts.select("threshold", ratio(F.col("hit"), F.col("got")).alias("precision"), ratio(F.col("hit"), F.col("want")).alias("recall"))
    made = made.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rank = F.row_number().over(Window.orderBy((F.col("recall") < least_recall).cast("int"), F.desc("f1"), F.desc("threshold")))  # one row a threshold
    return made.withColumn("best", (rank == 1) & (F.col("recall") >= least_recall))
