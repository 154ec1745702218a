"""Learned linear filters: snippet sets, augmentation, hinge-loss fit, hard negatives.

A snippet row is (recording_id, unit_id, spike_time, values) with `values` channel by
channel. Random choices are seeded hashes of row identity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.blocks import BLOCK, Running, ordinal, scan
from tracewell.functions.hashing import integer_between, normal, uniform
from tracewell.operators.intervals import free_segments
from tracewell.operators.templates import cap_per_group, hash_order
from tracewell.session import cut_lineage, join_dimension

UNIT = ["recording_id", "unit_id"]
NOISE_UNIT = -1


def noise_centres(
    spikes: DataFrame,
    lengths: DataFrame,
    template_length: int,
    offset: int,
    n: int = 5000,
    seed: int | str = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Up to n samples per recording away from all spikes, as spikes of unit -1.

    Free means outside [t - offset - T, t + T + offset) of every spike. Gaps are never unfolded:
    the free samples are numbered by the running total of the gaps' lengths, one number is
    drawn from each of n equal parts, and an as-of scan finds the gap that holds it.
    """
    free = free_segments(
        spikes, ["recording_id"], "spike_time", offset + template_length, template_length + offset, lengths
    )
    n_samples = lengths.select("recording_id", F.col("n_samples").alias("_n"))
    start = F.greatest(F.col("start"), F.lit(offset + 1))
    end = F.least(F.col("end"), F.col("_n") - template_length + offset)
    gaps = (
        free.join(n_samples, "recording_id")
        .select("recording_id", start.cast("bigint").alias("start"), (end - start).cast("bigint").alias("_size"))
        .where(F.col("_size") > 0)
    )
    gaps = cut_lineage(
        scan(gaps, ["recording_id"], "start", {"_at": Running("sum", F.col("_size"), False)}, block)
        .withColumn("_at", F.coalesce("_at", F.lit(0)))
    )
    total, i = F.col("_total"), F.col("_i")
    parts = F.least(F.lit(n).cast("bigint"), total)
    drawn = gaps.groupBy("recording_id").agg(F.sum("_size").alias("_total")).select(
        "recording_id", total, parts.alias("_m"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_i")
    )
    low = F.floor((i * total - F.pmod(i * total, F.col("_m"))) / F.col("_m"))
    high = F.floor(((i + 1) * total - F.pmod((i + 1) * total, F.col("_m"))) / F.col("_m"))
    number = low + F.floor(uniform(seed, F.col("recording_id"), i) * (high - low))
    both = gaps.select(
        "recording_id", "_at", F.struct("start", F.col("_at").alias("first")).alias("_gap"), F.lit(0).alias("_drawn")
    ).unionByName(
        drawn.select("recording_id", number.cast("bigint").alias("_at"), F.lit(1).alias("_drawn")), allowMissingColumns=True
    )
    found = scan(both, ["recording_id"], "_at", {"_in": Running("last", F.col("_gap"))}, block, ties=["_drawn"])
    return found.where("_drawn = 1").select(
        "recording_id",
        (F.col("_in.start") + F.col("_at") - F.col("_in.first")).alias("spike_time"),
        F.lit(NOISE_UNIT).cast("bigint").alias("unit_id"),
    )


def roll(values: Column, length: int, shift: Column) -> Column:
    """Every channel's window of `length` values shifted with wrap-around."""
    return F.transform(
        values,
        lambda v, i: F.element_at(
            values, (F.floor(i / length) * length + F.pmod(i % length - shift, F.lit(length)) + 1).cast("int")
        ),
    )


def numbered(snippets: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Snippets with a dense number 0 .. n-1 per group."""
    extra = [] if "unit_id" in keys else ["unit_id"]
    ranked = ordinal(snippets, keys, "spike_time", "_n", ties=extra)
    return ranked.withColumn("_n", F.col("_n") - 1)


def draws(numbered_snippets: DataFrame, keys: Sequence[str], n_out: int) -> DataFrame:
    """One row per wanted draw with the size of the group it draws from."""
    sizes = numbered_snippets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))))


def augment(
    positives: DataFrame,
    n_out: int,
    template_length: int,
    seed: int = 0,
    max_jitter: int = 3,
    amplitude: tuple[float, float] = (0.7, 1.3),
    noise_std: Column | float = 0.0,
) -> DataFrame:
    """n_out variations per unit: shifted in time, scaled, optionally with added noise."""
    pool = cut_lineage(numbered(positives))
    who = [F.col("recording_id"), F.col("unit_id"), F.col("draw")]
    low, high = amplitude
    chosen = (
        draws(pool, UNIT, n_out)
        .withColumn("_n", F.floor(uniform(f"{seed}pick", *who) * F.col("_size")).cast("bigint"))
        .withColumn("shift", integer_between(-max_jitter, max_jitter, f"{seed}shift", *who))
        .withColumn("amplitude", F.lit(low) + uniform(f"{seed}amp", *who) * F.lit(high - low))
        .join(pool, [*UNIT, "_n"])
    )
    scaled = F.transform(roll(F.col("values"), template_length, F.col("shift")), lambda v: v * F.col("amplitude"))
    if isinstance(noise_std, Column) or noise_std > 0:
        level = noise_std if isinstance(noise_std, Column) else F.lit(noise_std)
        noisy = F.transform(scaled, lambda v, i: v + normal(f"{seed}noise", *who, i) * level)
    else:
        noisy = scaled
    return chosen.select(*UNIT, "spike_time", "draw", noisy.alias("values"))


def overlay(
    positives: DataFrame,
    others: DataFrame,
    n_out: int,
    template_length: int,
    seed: int = 0,
    max_shift: int = 20,
) -> DataFrame:
    """n_out sums per unit of one of its snippets and a shifted snippet of another unit of
    the recording."""
    pool = cut_lineage(numbered(positives))
    rival = cut_lineage(numbered(others, ["recording_id"]))
    sizes = rival.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_rivals"))
    who = [F.col("recording_id"), F.col("unit_id"), F.col("draw")]
    second = rival.select("recording_id", F.col("_n").alias("_m"), F.col("values").alias("_other"))
    picked = (
        draws(pool, UNIT, n_out)
        .join(sizes, "recording_id")
        .withColumn("_n", F.floor(uniform(f"{seed}pick", *who) * F.col("_size")).cast("bigint"))
        .withColumn("_m", F.floor(uniform(f"{seed}other", *who) * F.col("_rivals")).cast("bigint"))
        .withColumn("shift", integer_between(-max_shift, max_shift, f"{seed}shift", *who))
        .join(pool, [*UNIT, "_n"])
        .join(second, ["recording_id", "_m"])
    )
    moved = roll(F.col("_other"), template_length, F.col("shift"))
    return picked.select(
        *UNIT, "spike_time", "draw", F.zip_with("values", moved, lambda a, b: a + b).alias("values")
    )


def weighted(examples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `weight`: n_negative / n_positive for positives (label 1), 1 for the rest."""
    counts = examples.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") != 1).alias("_neg")
    )
    if keys:
        joined = join_dimension(examples, counts, list(keys), spread=F.xxhash64("values"))
        ratio = F.col("_neg") / F.greatest(F.col("_pos"), F.lit(1))
    else:
        joined, total = examples, counts.first()
        ratio = F.lit(total["_neg"] / max(total["_pos"], 1))
    return joined.withColumn("weight", F.when(F.col("label") == 1, ratio).otherwise(F.lit(1.0))).drop("_pos", "_neg")


def fit_linear(examples: DataFrame, reg: float = 1e-4, max_iter: int = 100) -> LinearSVCModel:
    """Weighted hinge-loss linear model on (values, label, weight)."""
    features = examples.select(
        array_to_vector("values").alias("features"), F.col("label").cast("double").alias("label"), "weight"
    )
    svc = LinearSVC(regParam=reg, maxIter=max_iter, weightCol="weight", standardization=True)
    return svc.fit(features)


@dataclass(frozen=True)
class HingeFit:
    weights: np.ndarray
    bias: float
    loss: float
    #: passes over the examples
    rounds: int


def hinge_sums(examples: DataFrame, point: np.ndarray) -> np.ndarray:
    """Weighted squared hinge loss at (weights, bias), its gradient, and the sum of the weights.

    Tasks hand on one row each; the sums are d + 3 numbers.
    """
    d = len(point) - 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 3)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0)
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            y = np.where(batch.column(1).to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            short = np.maximum(0.0, 1 - y * (x @ point[:d] + point[d]))
            slope = -2 * weight * y * short
            total[0] += (weight * short**2).sum()
            total[1 : d + 1] += slope @ x
            total[d + 1] += slope.sum()
            total[d + 2] += weight.sum()
        yield pa.record_batch([pa.array(np.arange(d + 3)), pa.array(total)], ["i", "v"])

    chosen = examples.select("values", F.col("label").cast("double"), F.col("weight").cast("double"))
    rows = chosen.mapInArrow(add, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(d + 3)
    for r in rows:
        out[r.i] = r.v
    return out


def fit_hinge(
    examples: DataFrame, width: int, reg: float = 1e-4, max_rounds: int = 100, tolerance: float = 1e-6,
    start: tuple[Sequence[float], float] | None = None, memory: int = 10,
) -> HingeFit:
    """Weighted squared hinge loss with a ridge, minimised from given weights and bias.

    A quasi-Newton descent: every round is one pass over the staged examples (values, label, weight)
    that returns a loss and a gradient, so it scales with the tasks; the driver keeps `memory` past
    steps of `width` numbers. The loss is convex: a start only changes the number of rounds.
    """
    rows = cut_lineage(examples)
    point = np.zeros(width + 1)
    if start is not None:
        point[:width], point[width] = np.asarray(start[0], dtype=float), start[1]
    ridge = np.append(np.full(width, reg), 0.0)
    rounds = 0

    def at(p: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal rounds
        rounds += 1
        sums = hinge_sums(rows, p)
        scale = max(sums[-1], 1e-300)
        return sums[0] / scale + 0.5 * float(ridge @ p**2), sums[1:-1] / scale + ridge * p

    loss, slope = at(point)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while rounds < max_rounds and np.abs(slope).max() > tolerance:
        direction, used = slope.copy(), []
        for s, g in reversed(steps):
            share = (s @ direction) / (s @ g)
            used.append(share)
            direction -= share * g
        if steps:
            s, g = steps[-1]
            direction *= (s @ g) / (g @ g)
        for (s, g), share in zip(steps, reversed(used)):
            direction += s * (share - (g @ direction) / (s @ g))
        size = 1.0 if steps else 1.0 / max(1.0, np.abs(slope).sum())
        while rounds < max_rounds:
            trial = point - size * direction
            new_loss, new_slope = at(trial)
            if new_loss <= loss - 1e-4 * size * (slope @ direction):
                break
            size /= 2
        else:
            break
        s, g = trial - point, new_slope - slope
        if s @ g > 1e-12 * (g @ g):
            steps = [*steps, (s, g)][-memory:]
        point, loss, slope = trial, new_loss, new_slope
    return HingeFit(point[:width], float(point[width]), float(loss), rounds)


def linear_score(values: Column, weights: Sequence[float], bias: float) -> Column:
    """w . x + b inside the JVM."""
    products = F.zip_with(values, F.lit(np.asarray(weights, dtype=float)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(bias)), lambda acc, p: acc + p)


def taps_from_weights(weights: Column, n_channels: int, template_length: int) -> Column:
    """Channel-major weights -> time-major taps (and back with the arguments swapped)."""
    order = F.sequence(F.lit(0), F.lit(n_channels * template_length - 1))
    return F.transform(
        order,
        lambda i: F.element_at(
            weights, (i % n_channels * template_length + F.floor(i / n_channels) + 1).cast("int")
        ),
    )


def hard_negatives(
    snippets: DataFrame, weights: Sequence[float], bias: float, per_unit: int = 500
) -> DataFrame:
    """Known non-target snippets that score above 0: the highest ones of every unit."""
    scored = snippets.withColumn("score", linear_score(F.col("values"), weights, bias)).where("score > 0")
    return cap_per_group(scored, UNIT, per_unit, F.struct(-F.col("score"), F.col("spike_time")))


def diagnostics(examples: DataFrame, weights: Sequence[float], bias: float) -> DataFrame:
    """Share of each label scored above 0."""
    scored = examples.withColumn("score", linear_score(F.col("values"), weights, bias))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("score") > 0).cast("int")).alias("share_above_0")
    )


def weights_from_taps(taps: Sequence[float], n_channels: int, template_length: int) -> np.ndarray:
    """Time-major taps of a fitted filter as channel-major weights, to start a fit from."""
    return np.asarray(taps, dtype=float).reshape(template_length, n_channels).T.ravel()


def train_with_mining(
    positives: DataFrame,
    negatives: DataFrame,
    minable: DataFrame,
    rounds: int = 3,
    per_unit: int = 500,
    reg: float = 1e-4,
    max_iter: int = 100,
) -> LinearSVCModel:
    """Fit, mine the interferers the model still accepts, append, refit; stop when none."""
    pos = positives.select("values", F.lit(1.0).alias("label"))
    neg = negatives.select("values", F.lit(0.0).alias("label"))
    examples = cut_lineage(pos.unionByName(neg))
    pool = cut_lineage(minable)
    model = fit_linear(weighted(examples), reg, max_iter)
    for _ in range(rounds):
        mined = hard_negatives(pool, model.coefficients.toArray(), model.intercept, per_unit)
        extra = cut_lineage(mined.select("values", F.lit(0.0).alias("label")))
        if extra.isEmpty():
            break
        examples = examples.unionByName(extra)  # both are staged
        model = fit_linear(weighted(examples), reg, max_iter // 2)
    return model
