"""Decision metrics, for all topics and thresholds in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.numeric import ratio

THRESHOLDS = tuple(i / 10 for i in range(1, 10))
_EPSILON = 1e-12


def _confusion(predictions: DataFrame, threshold: Column, keys: Sequence[str]) -> DataFrame:
    hit, y = F.col("prob") >= threshold, F.col("label")
    return predictions.groupBy(*keys).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
    )


def _rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(tp * 2, tp * 2 + fp + fn))
    )


def metrics_at(predictions: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """Accuracy, F1, precision and recall; a probability on the threshold counts as positive."""
    return _rates(_confusion(predictions, F.lit(threshold), keys))


def threshold_sweep(predictions: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                    keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """The same at every threshold; predictions are multiplied in place, not joined."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = predictions.select(*keys, "prob", "label", steps.alias("threshold"))
    return _rates(_confusion(rows, F.col("threshold"), [*keys, "threshold"]))


def cross_entropy(pos_weight: Column | float = 1.0) -> Column:
    """Weighted binary cross-entropy of ``prob`` and ``label``, clamped away from infinity."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(pos_weight)
    y, p = F.col("label"), F.col("prob")
    log = lambda x: F.ln(F.greatest(x, F.lit(_EPSILON)))
    return -(weight * y * log(p) + (1 - y) * log(1 - p))


def mean_batch_loss(losses: DataFrame, keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """Mean of the batch means, so a short last batch weighs as much as a full one."""
    per_batch = losses.groupBy(*keys, "batch_id").agg(F.avg("loss").alias("_mean"))
    return per_batch.groupBy(*keys).agg(F.avg("_mean").alias("avg_loss"), F.count("*").alias("n_batches"))
