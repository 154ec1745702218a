"""Threshold sweeps and operating points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.blocks import BLOCK
from tracewell.functions.metrics import with_metrics
from tracewell.operators.matching import NEAR, attribute, best_nearby, mark_near
from tracewell.operators.quantiles import exact_quantiles
from tracewell.session import cut_lineage, join_dimension

GRID_STEPS = 60


def threshold_grid(
    peaks: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    steps: int = GRID_STEPS,
    low: float = 0.5,
    high: float = 0.9999,
    method: str = "linear",
) -> DataFrame:
    """Evenly spaced thresholds between two percentiles: keys, `idx`, `threshold`."""
    ends = exact_quantiles(peaks, keys, F.col(score), {"_lo": low, "_hi": high}, method)
    lo, hi = F.col("_lo"), F.col("_hi")
    return ends.select(*keys, F.posexplode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("idx", "_i"), lo, hi).select(
        *keys, "idx", (lo + (hi - lo) * F.col("_i") / F.lit(steps - 1)).alias("threshold")
    )


def _passed(score: Column) -> Column:
    """How many thresholds of the ascending grid the score exceeds."""
    return F.size(F.filter(F.col("_grid"), lambda t: score > t))


def sweep(
    peaks: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    tolerance: int,
    interferers: DataFrame | None = None,
    interferer_id: str = "unit_id",
    sample: str = "sample",
    score: str = "score",
    truth_time: str = "spike_time",
    grid: DataFrame | None = None,
    duration_s: float | Column | None = None,
    method: str = "linear",
    guard: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The whole precision/recall curve in one pass.

    Every truth point knows the best peak around it and every peak knows whether it is a
    false positive; both are then counted by how many thresholds they exceed, and the
    counts are accumulated from the highest threshold down. Nothing is repeated per
    threshold. With `interferers`, `fp_by_interferer` maps the unit to its share of the
    false positives.
    """
    keys = list(keys)
    peaks = cut_lineage(peaks.select(*keys, sample, score))
    if grid is None:
        grid = threshold_grid(peaks, keys, score, method=method)
    packed = grid.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "threshold"))), lambda s: s["threshold"]
        ).alias("_grid")
    )
    packed = cut_lineage(packed)
    n_truth = cut_lineage(truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth")))
    most = n_truth.agg(F.max("n_truth")).first()[0] or 0
    best = best_nearby(truth.select(*keys, truth_time), peaks, keys, truth_time, sample, score, tolerance, "_best", block)
    hit_levels = (
        join_dimension(best, packed, keys, spread=truth_time, stage=False, largest=most)
        .groupBy(*keys, F.coalesce(_passed(F.col("_best")), F.lit(0)).alias("_level"))
        .agg(F.count(F.lit(1)).alias("_truth"))
    )
    marked = mark_near(peaks.select(*keys, sample, score), truth, keys, sample, truth_time, tolerance, tolerance)
    most = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    levelled = join_dimension(marked, packed, keys, spread=sample, stage=False, largest=most).withColumn(
        "_level", _passed(F.col(score))
    )
    peak_levels = levelled.groupBy(*keys, "_level").agg(
        F.count(F.lit(1)).alias("_detections"),
        F.count_if(~F.col(NEAR)).alias("_fp"),
    )
    # Level L means thresholds 0 .. L-1 are exceeded: threshold i counts all levels > i.
    levels = hit_levels.unionByName(peak_levels, allowMissingColumns=True)
    steps = packed.select(*keys, F.posexplode("_grid").alias("idx", "threshold")).withColumn(
        "_level", F.col("idx") + 1
    )
    down = Window.partitionBy(*keys).orderBy(F.col("_level").desc())

    def upto(name: str) -> Column:
        return F.coalesce(F.sum(name).over(down), F.lit(0)).cast("bigint")

    totals = levels.groupBy(*keys, "_level").agg(
        *[F.sum(c).alias(c) for c in ("_truth", "_detections", "_fp")]
    )
    curve = (
        steps.join(totals, [*keys, "_level"], "left")
        .withColumn("hits", upto("_truth"))
        .withColumn("n_detections", upto("_detections"))
        .withColumn("total_fp", upto("_fp"))
        .join(n_truth, keys, "left")
        .withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
        .withColumn("misses", F.col("n_truth") - F.col("hits"))
    )
    curve = with_metrics(curve, duration_s=duration_s, guard=guard)
    out = [*keys, "idx", "threshold", "hits", "misses", "total_fp", "n_detections", "n_truth", "recall", "precision", "f1"]
    if duration_s is not None:
        out.append("fp_rate_hz")
    if interferers is None:
        return curve.select(*out)
    by_unit = sweep_attribution(
        levelled.where(~F.col(NEAR)).select(*keys, sample, "_level"),
        interferers, keys, steps, sample, truth_time, interferer_id, tolerance,
    )
    as_map = by_unit.groupBy(*keys, "idx").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(interferer_id, "fp")))).alias("fp_by_interferer")
    )
    return curve.select(*out).join(as_map, [*keys, "idx"], "left")


def sweep_attribution(
    false_positives: DataFrame,
    interferers: DataFrame,
    keys: Sequence[str],
    steps: DataFrame,
    sample: str,
    time: str,
    unit: str,
    tolerance: int,
) -> DataFrame:
    """Long form (keys, idx, unit, fp): false positives that coincide with each unit."""
    keys = list(keys)
    named = attribute(false_positives, interferers, keys, sample, time, unit, tolerance)
    counts = named.groupBy(*keys, unit, "_level").agg(F.count(F.lit(1)).alias("_fp"))
    units = interferers.select(*keys, unit).distinct()
    down = Window.partitionBy(*keys, unit).orderBy(F.col("_level").desc())
    return (
        steps.join(units, keys)
        .join(counts, [*keys, unit, "_level"], "left")
        .withColumn("fp", F.coalesce(F.sum("_fp").over(down), F.lit(0)).cast("bigint"))
        .select(*keys, "idx", unit, "fp")
    )


def best_f1(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the highest F1; the lowest threshold index wins ties."""
    row = F.struct(*[c for c in curve.columns if c not in keys])
    return (
        curve.groupBy(*keys)
        .agg(F.max_by(row, F.struct(F.col("f1"), -F.col("idx"))).alias("_row"))
        .select(*keys, "_row.*")
    )


def best_recall(
    curve: DataFrame, keys: Sequence[str], max_fp_rate_hz: float, fallback: bool = True
) -> DataFrame:
    """Highest recall among rows with fp_rate_hz <= limit, first index on ties.

    Where no row qualifies: the lowest false-positive rate (`fallback`) or no row at all.
    """
    row = F.struct(*[c for c in curve.columns if c not in keys])
    allowed = F.col("fp_rate_hz") <= max_fp_rate_hz
    best = F.max_by(row, F.when(allowed, F.struct(F.col("recall"), -F.col("idx"))))
    lowest = F.min_by(row, F.struct(F.col("fp_rate_hz"), F.col("idx")))
    picked = F.coalesce(best, lowest) if fallback else best
    return curve.groupBy(*keys).agg(picked.alias("_row")).where("_row is not null").select(*keys, "_row.*")


def evaluate(
    detections: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    tolerance: int,
    sample: str = "sample",
    truth_time: str = "spike_time",
    duration_s: float | Column | None = None,
    guard: float | None = None,
) -> DataFrame:
    """Hits, misses, false positives and metrics of a finished set of detections."""
    keys = list(keys)
    found = mark_near(truth, detections, keys, truth_time, sample, tolerance, tolerance)
    hits = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_truth"), F.count_if(F.col(NEAR)).alias("hits")
    )
    marked = mark_near(detections, truth, keys, sample, truth_time, tolerance, tolerance)
    fps = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_detections"), F.count_if(~F.col(NEAR)).alias("total_fp")
    )
    both = hits.join(fps, keys, "full").na.fill(0, ["n_truth", "hits", "n_detections", "total_fp"])
    both = both.withColumn("misses", F.col("n_truth") - F.col("hits"))
    return with_metrics(both, duration_s=duration_s, guard=guard)


def robust_threshold(
    scores: DataFrame,
    keys: Sequence[str],
    spikes: DataFrame,
    template_length: int,
    template_offset: int,
    k: float = 5.0,
    spike_keys: Sequence[str] | None = None,
    sample: str = "sample",
    score: str = "score",
    spike_time: str = "spike_time",
) -> DataFrame:
    """median + k * scaled MAD of the score away from known spikes.

    Samples inside [t - offset - T // 2, t + T + offset) of any spike are left out; a key
    without a free sample uses all of its samples.
    """
    keys = list(keys)
    before = template_length + template_offset - 1
    after = template_offset + template_length // 2
    # staged: the scores are made once for the passes below
    masked = cut_lineage(mark_near(scores, spikes, list(spike_keys or keys), sample, spike_time, before, after, "_busy"))
    free = masked.groupBy(*keys).agg(F.count_if(~F.col("_busy")).alias("_free"))
    # Only keys that have no free sample at all fall back to everything.
    used = join_dimension(masked, free, keys, spread=sample).where(~F.col("_busy") | (F.col("_free") == 0))
    middle = cut_lineage(exact_quantiles(used, keys, F.col(score), {"median": 0.5}))
    centred = join_dimension(used, middle, keys, spread=sample, stage=False)
    spread = exact_quantiles(
        centred, keys, F.abs(F.col(score) - F.col("median")), {"mad": 0.5}
    )
    scale = F.lit(1.4826)  # fixed value: MAD -> Gaussian standard deviation
    return middle.join(spread, keys).withColumn(
        "threshold", F.col("median") + F.lit(float(k)) * (F.col("mad") * scale)
    )
