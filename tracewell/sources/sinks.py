"""Text and table sinks for events, decisions and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The column order of the curve log.
CURVE = ["threshold", "hits", "misses", "total_fp", "recall", "precision", "f1", "fp_rate_hz"]


def append_spike_lines(detections: DataFrame, path: str) -> None:
    """One sample index per line."""
    detections.select(F.col("sample").cast("string").alias("value")).write.mode("append").text(path)


def append_code_lines(onsets: DataFrame, path: str) -> None:
    """`code,sample` per line."""
    onsets.select(F.concat_ws(",", "code", "sample").alias("value")).write.mode("append").text(path)


def decision_lines(decisions: DataFrame) -> DataFrame:
    """Decision records as log lines (columns code, syllable_t, n_events, trigger_t, outcome)."""
    head = F.concat(F.col("outcome"), F.lit(" syllable_code="), F.col("code"), F.lit(" syllable_t="), F.col("syllable_t"))
    fired = F.concat(head, F.lit(" count="), F.col("n_events"), F.lit(" triggering_spike_t="), F.col("trigger_t"))
    silent = F.concat(head, F.lit(" final_count="), F.col("n_events"))
    return decisions.select(F.when(F.col("outcome") == "TRIGGER", fired).otherwise(silent).alias("value"))


def append_decision_lines(decisions: DataFrame, path: str) -> None:
    decision_lines(decisions).write.mode("append").text(path)


def write_curve_csv(curve: DataFrame, path: str, keys: list[str]) -> None:
    curve.select(*keys, *CURVE).write.mode("overwrite").option("header", True).csv(path)


def write_curve_json(curve: DataFrame, path: str) -> None:
    curve.write.mode("overwrite").json(path)
