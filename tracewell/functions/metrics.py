"""Detection metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall(hits: Column, n_truth: Column) -> Column:
    return hits / F.greatest(n_truth, F.lit(1))


def precision(hits: Column, false_positives: Column) -> Column:
    return hits / F.greatest(hits + false_positives, F.lit(1))


def f1(precision_: Column, recall_: Column, guard: float | None = None) -> Column:
    """Harmonic mean; 0 when both are 0, or with a `guard` floor on the denominator."""
    total = precision_ + recall_
    if guard is not None:
        return 2 * precision_ * recall_ / F.greatest(total, F.lit(guard))
    return F.when(total > 0, 2 * precision_ * recall_ / total).otherwise(F.lit(0.0))


def with_metrics(df, hits="hits", false_positives="total_fp", n_truth="n_truth", duration_s=None, guard=None):
    """Adds recall, precision, f1 and, with a duration in seconds, fp_rate_hz."""
    out = df.withColumn("recall", recall(F.col(hits), F.col(n_truth))).withColumn(
        "precision", precision(F.col(hits), F.col(false_positives))
    )
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall"), guard))
    if duration_s is not None:
        seconds = duration_s if isinstance(duration_s, Column) else F.lit(float(duration_s))
        out = out.withColumn("fp_rate_hz", F.col(false_positives) / seconds)
    return out
