"""Fitting and calibrating filters for many targets and recordings in one job."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import peaks as pk
from tracewell.operators import signal, solve, sweep, templates
from tracewell.session import cut_lineage

KEYS = ["recording_id", "target_id"]


@dataclass(frozen=True)
class FitSettings:
    template_length: int = 61
    offset: int = 20
    n_channels: int = 5
    ridge: float = 1e-3
    max_spikes: int | None = None
    max_noise_samples: int | None = None
    orientation: str = "reference"


@dataclass
class Fit:
    filters: DataFrame
    waveforms: DataFrame
    selected: DataFrame
    products: DataFrame


def fit(
    chunks: DataFrame,
    length: int,
    spikes: DataFrame,
    targets: DataFrame,
    interferers: DataFrame,
    settings: FitSettings = FitSettings(),
    order=None,
) -> Fit:
    """Templates, channels, noise statistics and filters for every target.

    `chunks` are preprocessed; `spikes` (recording_id, unit_id, spike_time), `targets`
    (recording_id, target_id), `interferers` (recording_id, target_id, unit_id). Noise is
    measured away from the spikes of a target and its interferers.
    """
    T, off = settings.template_length, settings.offset
    wanted = interferers.select("recording_id", "unit_id").unionByName(
        targets.select("recording_id", F.col("target_id").alias("unit_id"))
    ).distinct()
    used = spikes.join(wanted, ["recording_id", "unit_id"], "left_semi")
    lengths = cut_lineage(templates.lengths_of(chunks))
    waveforms = cut_lineage(
        templates.mean_waveforms(chunks, length, used, T, off, settings.max_spikes, order, lengths)
    )
    local = local_units(targets, interferers)
    times = local.join(spikes, ["recording_id", "unit_id"]).select(*KEYS, "spike_time").distinct()
    return solved(chunks, length, waveforms, targets, interferers, times, targets.join(lengths, "recording_id"), settings)


def local_units(targets: DataFrame, interferers: DataFrame) -> DataFrame:
    """recording_id, target_id, unit_id of the target itself and its interferers."""
    return interferers.select(*KEYS, "unit_id").unionByName(
        targets.select(*KEYS, F.col("target_id").alias("unit_id"))
    )


def solved(
    chunks: DataFrame, length: int, waveforms: DataFrame, targets: DataFrame, interferers: DataFrame,
    times: DataFrame, spans: DataFrame, settings: FitSettings,
) -> Fit:
    """Channels, noise and filters from mean waveforms.

    `times`: recording_id, target_id, spike_time of what is no noise; `spans`: n_samples of each target.
    """
    T, off = settings.template_length, settings.offset
    selected = cut_lineage(
        templates.select_channels(
            templates.channel_energy(waveforms), interferers, settings.n_channels, targets
        )
    )
    quiet = solve.quiet_segments(times, spans, T, off, settings.max_noise_samples)
    chans = selected.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel"))), lambda s: s["channel"]).alias("channels")
    )
    segments = cut_lineage(quiet.join(chans, KEYS))
    products = cut_lineage(solve.lagged_products(chunks, length, segments, T))
    filters = cut_lineage(
        solve.solve_filters(waveforms, selected, interferers, products, T, settings.ridge, settings.orientation)
    )
    return Fit(filters, waveforms, selected, products)


def problems(fitted: Fit, targets: DataFrame, spikes: DataFrame) -> DataFrame:
    """Targets without a filter and why: no spikes, no usable spikes, no quiet segment."""
    own = spikes.select("recording_id", F.col("unit_id").alias("target_id")).distinct()
    seen = own.withColumn("_spikes", F.lit(True))
    usable = fitted.selected.select(*KEYS).distinct().withColumn("_usable", F.lit(True))
    left = targets.join(fitted.filters, KEYS, "left_anti").select(*KEYS)
    reason = (
        F.when(F.col("_spikes").isNull(), "no spikes")
        .when(F.col("_usable").isNull(), "no usable spikes")
        .otherwise("no spike-free segment")
    )
    return left.join(seen, KEYS, "left").join(usable, KEYS, "left").select(*KEYS, reason.alias("reason"))


def require_filters(fitted: Fit, targets: DataFrame, spikes: DataFrame) -> Fit:
    """The fit itself, or an error naming some of the targets that could not be fitted."""
    failed = problems(fitted, targets, spikes).limit(20).collect()
    if failed:
        named = ", ".join(f"{r.recording_id}/{r.target_id}: {r.reason}" for r in failed)
        raise ValueError(f"targets without a filter: {named}")
    return fitted


def cut_chunks(chunks: DataFrame, splits: DataFrame, side: str) -> DataFrame:
    """The chunk rows before ("train") or from ("test") each recording's split sample.

    The chunk holding the split is cut; sample numbers stay absolute.
    """
    width = F.size("channels")
    joined = chunks.join(splits, "recording_id")
    end = F.col("start_sample") + F.col("n_samples")
    if side == "train":
        n = F.least(end, F.col("split")) - F.col("start_sample")
        cut = joined.where(F.col("start_sample") < F.col("split")).select(
            "recording_id", "chunk_id", "start_sample", n.cast("int").alias("n_samples"), "channels",
            F.slice("values", F.lit(1), F.greatest(n * width, F.lit(0)).cast("int")).alias("values"),
        )
        return cut
    skip = F.greatest(F.col("split") - F.col("start_sample"), F.lit(0))
    return joined.where(end > F.col("split")).select(
        "recording_id", "chunk_id", (F.col("start_sample") + skip).alias("start_sample"),
        (F.col("n_samples") - skip).cast("int").alias("n_samples"), "channels",
        F.slice("values", (skip * width + 1).cast("int"), F.greatest((F.col("n_samples") - skip) * width, F.lit(0)).cast("int")).alias("values"),
    )


class Calibration(NamedTuple):
    """Filters with thresholds, the curves, and (recording_id, target_id, reason) without."""

    filters: DataFrame
    curve: DataFrame
    failed: DataFrame


def calibrate(
    chunks: DataFrame,
    length: int,
    spikes: DataFrame,
    targets: DataFrame,
    interferers: DataFrame,
    fs: float,
    settings: FitSettings = FitSettings(),
    train_fraction: float = 0.5,
    suppression: str = "priority",
    criterion: str = "best_f1",
    max_fp_rate_hz: float = 1.0,
    order=None,
) -> Calibration:
    """Fit on the first part, sweep the rest, keep that very filter with its threshold.

    `suppression` is "priority" (highest first) or "window". Every target asked for is either
    among the filters or among the failed ones, with the reason.
    """
    T = settings.template_length
    lengths = templates.lengths_of(chunks)
    splits = cut_lineage(templates.split_at(lengths, train_fraction))
    train_spikes = templates.train_part(spikes, splits, "spike_time")
    train = cut_chunks(chunks, splits, "train")
    fitted = fit(train, length, train_spikes, targets, interferers, settings, order)
    test = cut_chunks(chunks, splits, "test")
    late = spikes.join(splits, "recording_id").where(F.col("spike_time") >= F.col("split")).drop("split")
    seconds = splits.join(lengths, "recording_id").select(
        "recording_id", ((F.col("n_samples") - F.col("split")) / F.lit(float(fs))).alias("_seconds")
    )
    done = _operating_points(
        test, length, fitted.filters, late, targets, interferers, seconds, T, suppression, criterion, max_fp_rate_hz
    )
    return done._replace(failed=problems(fitted, targets, train_spikes).unionByName(done.failed))


def calibrate_existing(
    chunks: DataFrame,
    length: int,
    filters: DataFrame,
    spikes: DataFrame,
    interferers: DataFrame,
    fs: float,
    template_length: int,
    suppression: str = "window",
    criterion: str = "best_f1",
    max_fp_rate_hz: float = 1.0,
) -> Calibration:
    """Thresholds for filters as they are, swept over whole recordings; nothing is fitted.

    The targets are those of `filters`; their own thresholds are replaced.
    """
    targets = filters.select(*KEYS).distinct()
    seconds = templates.lengths_of(chunks).select(
        "recording_id", (F.col("n_samples") / F.lit(float(fs))).alias("_seconds")
    )
    return _operating_points(
        chunks, length, filters, spikes, targets, interferers, seconds, template_length, suppression, criterion, max_fp_rate_hz
    )


def _operating_points(
    chunks: DataFrame, length: int, filters: DataFrame, spikes: DataFrame, targets: DataFrame,
    interferers: DataFrame, seconds: DataFrame, T: int, suppression: str, criterion: str, max_fp_rate_hz: float,
) -> Calibration:
    tolerance, apart = T // 4, T // 2
    if suppression == "window":
        found = signal.detect(chunks, length, filters, T, suppress=apart, edge="zero", thresholded=False)
    else:
        found = pk.priority_peaks(signal.candidates(chunks, length, filters, T), KEYS, apart)
    truth = targets.join(spikes.withColumnRenamed("unit_id", "target_id"), KEYS).select(*KEYS, "spike_time")
    others = interferers.join(spikes, ["recording_id", "unit_id"]).select(*KEYS, "unit_id", "spike_time")
    curve = sweep.sweep(found, truth, KEYS, tolerance, interferers=others, guard=1e-9)
    curve = cut_lineage(
        curve.join(seconds, "recording_id").withColumn("fp_rate_hz", F.col("total_fp") / F.col("_seconds")).drop("_seconds")
    )
    rates = curve.drop("fp_by_interferer")
    best = (
        sweep.best_f1(rates, KEYS)
        if criterion == "best_f1"
        else sweep.best_recall(rates, KEYS, max_fp_rate_hz)
    )
    chosen = filters.drop("threshold").join(best.select(*KEYS, "threshold"), KEYS)
    swept = curve.select(*KEYS).distinct()
    silent = filters.select(*KEYS).distinct().join(swept, KEYS, "left_anti").withColumn("reason", F.lit("no candidate peaks"))
    unmet = swept.join(best.select(*KEYS), KEYS, "left_anti").withColumn(
        "reason", F.lit("no threshold within the false positive rate")
    )
    return Calibration(chosen, curve, silent.unionByName(unmet))


def data_fractions(
    chunks: DataFrame,
    length: int,
    spikes: DataFrame,
    targets: DataFrame,
    interferers: DataFrame,
    fs: float,
    threshold: float,
    fractions: tuple[float, ...] = (0.05, 0.10, 0.25),
    settings: FitSettings = FitSettings(),
    order=None,
) -> DataFrame:
    """Refit on growing first parts and score the rest at one fixed threshold.

    The signal is read once for all fractions: a target stands once per fraction, with its own end of
    training, and only sparse rows are multiplied. Sums of waveforms are taken per stretch between two
    ends and added up over the stretches before each end (with `max_spikes`, which chooses among all
    spikes of a part, per fraction).
    """
    T, off, n = settings.template_length, settings.offset, len(fractions)
    shares = F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.lit(float(f)).alias("train_fraction")) for i, f in enumerate(sorted(fractions))
    ])).alias("share")
    lengths = cut_lineage(templates.lengths_of(chunks))
    parts = cut_lineage(
        lengths.select("recording_id", "n_samples", shares).select(
            "recording_id", "n_samples", "share.*",
            F.floor(F.col("n_samples") * F.col("share.train_fraction")).cast("bigint").alias("split"),
        )
    )

    def coded(df: DataFrame, *ids: str) -> DataFrame:
        """The rows once per fraction, ids with its number; `split` is where its training ends."""
        joined = df.join(parts.select("recording_id", "part", "split"), "recording_id")
        for c in ids:
            joined = joined.withColumn(c, F.col(c) * n + F.col("part"))
        return joined

    all_targets = cut_lineage(coded(targets, "target_id").drop("part"))
    all_rivals = cut_lineage(coded(interferers, "target_id", "unit_id").drop("part", "split"))
    all_spikes = cut_lineage(coded(spikes, "unit_id").drop("part"))
    wanted = local_units(all_targets, all_rivals).select("recording_id", "unit_id").distinct()
    if settings.max_spikes is None:
        # a spike counts from the first part on in which it is usable
        ends_of = parts.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("part", "split"))).alias("ends"))
        fits = F.filter("ends", lambda e: F.col("spike_time") < e["split"] - T + off)
        first = F.try_element_at(fits, F.lit(1))["part"]
        usable = spikes.join(ends_of, "recording_id").withColumn("unit_id", F.col("unit_id") * n + first)
        usable = usable.where("unit_id is not null").drop("ends")
        wanted = wanted.withColumn("unit_id", F.explode(F.sequence(F.col("unit_id") - F.pmod("unit_id", F.lit(n)), F.col("unit_id")))).distinct()
    else:
        usable = all_spikes.where(F.col("spike_time") < F.col("split") - T + off).drop("split")
    usable = usable.join(wanted, ["recording_id", "unit_id"], "left_semi")
    waveforms = templates.mean_waveforms(
        chunks, length, usable, T, off, settings.max_spikes, order, lengths
    )
    if settings.max_spikes is None:
        part = F.pmod("unit_id", F.lit(n)).cast("int")
        later = waveforms.withColumn("part", F.explode(F.sequence(part, F.lit(n - 1)))).withColumn(
            "unit_id", F.floor(F.col("unit_id") / n) * n + F.col("part")
        )
        waveforms = later.groupBy("recording_id", "unit_id", "k", "channel").agg(
            (F.sum(F.col("value") * F.col("n_used")) / F.sum("n_used")).alias("value"), F.sum("n_used").alias("n_used")
        )
    early = all_spikes.where("spike_time < split").drop("split")
    times = local_units(all_targets, all_rivals).join(early, ["recording_id", "unit_id"]).select(*KEYS, "spike_time").distinct()
    spans = all_targets.select(*KEYS, F.col("split").alias("n_samples"))
    fitted = solved(
        chunks, length, cut_lineage(waveforms), all_targets.drop("split"), all_rivals, times, spans, settings
    )
    ends = all_targets.select(*KEYS, F.col("split").alias("from_sample"))
    filters = cut_lineage(fitted.filters.withColumn("threshold", F.lit(float(threshold))).join(ends, KEYS))
    tops = signal.candidates(chunks, length, filters, T, minimum=float(threshold))
    found = cut_lineage(pk.priority_peaks(tops, KEYS, T // 2))
    late = all_spikes.where("spike_time >= split").select("recording_id", F.col("unit_id").alias("target_id"), "spike_time")
    truth = all_targets.select(*KEYS).join(late, KEYS).select(*KEYS, "spike_time")
    result = sweep.evaluate(found, truth, KEYS, T // 4, guard=1e-9)
    seconds = parts.select(
        "recording_id", "part", "train_fraction",
        (F.col("split") / F.lit(float(fs))).alias("train_s"),
        ((F.col("n_samples") - F.col("split")) / F.lit(float(fs))).alias("test_s"),
    )
    return (
        result.withColumn("part", F.pmod("target_id", F.lit(n)).cast("int"))
        .withColumn("target_id", F.floor(F.col("target_id") / n))
        .join(seconds, ["recording_id", "part"])
        .drop("part")
        .withColumn("fp_rate_hz", F.col("total_fp") / F.col("test_s"))
    )
