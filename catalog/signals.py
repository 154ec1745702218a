"""Dense signal operators on the eight-channel and one-channel recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import BLOCK, CHANNELS, CHUNK, EV, KEYS, MULTI, TRUTH, events, series, signal, truth
from tracewell.operators import matching, peaks, signal as dense, sweep
from tracewell.operators.signal import Cleaning
from tracewell.session import cut_lineage
from tracewell.sources import chunks as ch

FS, FC = 3000.0, 300.0
# One integer filter on two channels (time-major) and one on the single channel.
PAIR = [1.0, 2.0, 0.0, -1.0, 3.0, 1.0, 2.0, 2.0, -1.0, 1.0]
SINGLE = [-1.0, 2.0, 4.0, 1.0, -2.0]
HEIGHT = 30000

COEF = f"""c0 as (select 2 * pi() * {FC} / {FS} as w), c1 as (select cos(w) as cw, sin(w) / (2 / sqrt(2.0)) as al from c0),
co as (select (1 + cw) / 2 / (1 + al) as b0, -(1 + cw) / (1 + al) as b1, (1 + cw) / 2 / (1 + al) as b2,
              -2 * cw / (1 + al) as a1, (1 - al) / (1 + al) as a2 from c1)"""
CAUSAL = f"""{COEF},
y as (
  select recording_id, channel, sample, cast(value as double) as x1, 0.0::double as x2,
         b0 * value as y1, 0.0::double as y2 from m, co where sample = 0
  union all
  select y.recording_id, y.channel, m.sample, cast(m.value as double), y.x1,
         b0 * m.value + b1 * y.x1 + b2 * y.x2 - a1 * y.y1 - a2 * y.y2, y.y1
  from y join m on m.recording_id = y.recording_id and m.channel = y.channel and m.sample = y.sample + 1, co)"""
# Odd extension by nine samples at both ends, then the recursion forward and backward,
# starting from a constant input at rest.
ZERO_PHASE = f"""{COEF},
len as (select recording_id, max(sample) as e from m group by 1),
x as (
  select recording_id, channel, sample, cast(value as double) as v from m
  union all select m.recording_id, m.channel, -m.sample, 2 * f.value - m.value from m
    join m f on f.recording_id = m.recording_id and f.channel = m.channel and f.sample = 0 where m.sample between 1 and 9
  union all select m.recording_id, m.channel, 2 * e - m.sample, 2 * f.value - m.value from m join len using (recording_id)
    join m f on f.recording_id = m.recording_id and f.channel = m.channel and f.sample = e where m.sample between e - 9 and e - 1),
fw as (
  select recording_id, channel, sample, v as x1, v as x2, (b0 + b1 + b2) * v as y1, 0.0::double as y2 from x, co where sample = -9
  union all
  select q.recording_id, q.channel, x.sample, x.v, q.x1, b0 * x.v + b1 * q.x1 + b2 * q.x2 - a1 * q.y1 - a2 * q.y2, q.y1
  from fw q join x on x.recording_id = q.recording_id and x.channel = q.channel and x.sample = q.sample + 1, co),
bw as (
  select recording_id, channel, sample, y1 as x1, y1 as x2, (b0 + b1 + b2) * y1 as z1, 0.0::double as z2
  from fw join len using (recording_id), co where sample = e + 9
  union all
  select q.recording_id, q.channel, f.sample, f.y1, q.x1, b0 * f.y1 + b1 * q.x1 + b2 * q.x2 - a1 * q.z1 - a2 * q.z2, q.z1
  from bw q join fw f on f.recording_id = q.recording_id and f.channel = q.channel and f.sample = q.sample - 1, co)"""


def taps_sql(taps, channels=(0,)):
    cells = ", ".join(
        f"({i // len(channels)}, {channels[i % len(channels)]}, {int(w)})" for i, w in enumerate(taps)
    )
    return f"taps(k, channel, w) as (values {cells})"


FIR = f"""{taps_sql(SINGLE)}, d as (
  select n.recording_id, n.sample, cast(sum(x.v * w) as bigint) as score from ev n, taps
  join ev x on x.recording_id = n.recording_id and x.sample = n.sample - 2 + taps.k group by 1, 2)"""


def packed(spark, sf):
    """The chunk table: ingested once per query, then read as stored."""
    return cut_lineage(ch.pack(signal(spark, sf), CHUNK))


def packed_single(spark, sf):
    one = series(spark, sf).select("recording_id", "sample", F.lit(0).alias("channel"), F.col("score").alias("value"))
    return cut_lineage(ch.pack(one, 4 * CHUNK))


def bank(spark, sf, taps, channels, left, threshold=0.0):
    """The same filter for every recording, as a filter table."""
    return (
        events(spark, sf)
        .select("recording_id")
        .distinct()
        .select(
            "recording_id",
            F.lit(1).cast("bigint").alias("target_id"),
            F.array(*[F.lit(c) for c in channels]).alias("channels"),
            F.array(*[F.lit(t) for t in taps]).alias("taps"),
            F.lit(left).alias("left_margin"),
            F.lit(float(threshold)).alias("threshold"),
        )
    )


def long_rounded(chunks):
    return ch.unpack(chunks).withColumn("value", F.round("value", 4))


def whole(df):
    return df.withColumn("score", F.round("score").cast("bigint"))


@query(
    "car_median",
    f"""with {MULTI} select recording_id, sample, channel,
    value - median(value) over (partition by recording_id, sample) as value from m""",
)
def car_median(spark, sf):
    return ch.unpack(dense.clean(packed(spark, sf), CHUNK, Cleaning(highpass=None)))


@query(
    "car_median_long",
    f"""with {MULTI} select recording_id, sample, channel,
    value - median(value) over (partition by recording_id, sample) as value from m""",
)
def car_median_long(spark, sf):
    return dense.common_reference(signal(spark, sf))


@query(
    "highpass_causal",
    f"with recursive {MULTI}, {CAUSAL} select recording_id, sample, channel, round(y1, 4) as value from y",
)
def highpass_causal(spark, sf):
    return long_rounded(dense.clean(packed(spark, sf), CHUNK, Cleaning(FS, FC, "causal", False)))


@query(
    "highpass_carried",
    f"with recursive {MULTI}, {CAUSAL} select recording_id, sample, channel, round(y1, 4) as value from y",
)
def highpass_carried(spark, sf):
    return long_rounded(dense.highpass_carried(packed(spark, sf), CHUNK, FC, FS))


@query(
    "highpass_zero_phase",
    f"""with recursive {MULTI}, {ZERO_PHASE} select recording_id, sample, channel, round(z1, 4) as value
    from bw join len using (recording_id) where sample between 0 and e""",
)
def highpass_zero_phase(spark, sf):
    return long_rounded(dense.clean(packed(spark, sf), CHUNK, Cleaning(FS, FC, "zero_phase", False)))


@query(
    "clean_pipeline",
    f"""with recursive {MULTI}, {CAUSAL},
    car as (select recording_id, sample, channel, y1 - median(y1) over (partition by recording_id, sample) as v from y)
    select recording_id, sample, channel, round(v, 4) as value from car where channel in (1, 4)""",
)
def clean_pipeline(spark, sf):
    """High-pass, then the reference over the whole group, then the filter's channels."""
    return long_rounded(dense.clean(packed(spark, sf), CHUNK, Cleaning(FS, FC, "causal", True, (1, 4))))


def pair_sql(left, where):
    return f"""with {MULTI}, {taps_sql(PAIR, (1, 4))}, last as (select recording_id, max(sample) as e from m group by 1),
    n as (select distinct recording_id, sample from m)
    select n.recording_id, n.sample, cast(sum(x.value * w) as bigint) as score from n join last using (recording_id), taps
    join m x on x.recording_id = n.recording_id and x.channel = taps.channel and x.sample = n.sample - {left} + taps.k
    where {where} group by 1, 2"""


@query("fir_trace", pair_sql(2, "true"))
def fir_trace(spark, sf):
    out = dense.score_trace(packed(spark, sf), CHUNK, bank(spark, sf, PAIR, [1, 4], 2), 5)
    return whole(out).drop("target_id")


@query("fir_trace_shared", pair_sql(2, "true"))
def fir_trace_shared(spark, sf):
    """Many filters of one recording share the transforms of its channels; one of them is shown."""
    one = bank(spark, sf, PAIR, [1, 4], 2)
    more = [bank(spark, sf, PAIR, [c, (c + 3) % CHANNELS], 2).withColumn("target_id", F.lit(c + 100).cast("bigint")) for c in range(3)]
    filters = one
    for other in more:
        filters = filters.unionByName(other)
    out = dense.score_trace(packed(spark, sf), CHUNK, filters, 5, method="fft").join(one.select("recording_id", "target_id"), ["recording_id", "target_id"], "left_semi")
    return whole(out.withColumn("score", F.round("score"))).drop("target_id")


@query("fir_trace_valid", pair_sql(2, "n.sample >= 2 and n.sample + 2 <= e"))
def fir_trace_valid(spark, sf):
    out = dense.score_trace(packed(spark, sf), CHUNK, bank(spark, sf, PAIR, [1, 4], 2), 5, edge="valid")
    return whole(out).drop("target_id")


@query("learned_trace", pair_sql(1, "n.sample >= 1 and n.sample + 3 < e"))
def learned_trace(spark, sf):
    """The learned filter's score is aligned at the spike: left margin = template offset."""
    out = dense.score_trace(packed(spark, sf), CHUNK, bank(spark, sf, PAIR, [1, 4], 1), 5, edge="open")
    return whole(out).drop("target_id")


WIN = """win as (select recording_id, sample, score,
    max(score) over (partition by recording_id order by sample range between 2 preceding and 1 preceding) as l,
    max(score) over (partition by recording_id order by sample range between 1 following and 2 following) as r
  from d)"""
DETECT = f"""{FIR}, {WIN}, det as (select recording_id, sample, score from win
  where score > coalesce(l, -1e18) and score > coalesce(r, -1e18) and score > {HEIGHT})"""


@query("detect_peaks", f"with {EV}, {DETECT} select recording_id, sample, score from det")
def detect_peaks(spark, sf):
    out = dense.detect(
        packed_single(spark, sf), 4 * CHUNK, bank(spark, sf, SINGLE, [0], 2, HEIGHT), 5, edge="zero"
    )
    return whole(out).drop("target_id")


@query(
    "detector_eval",
    f"""with {EV}, {TRUTH}, {DETECT},
    h as (select recording_id, count(*) as n_truth, count(*) filter (where exists (select 1 from det d
            where d.recording_id = t.recording_id and abs(d.sample - t.t) <= 1)) as hits from truth t group by 1),
    f as (select recording_id, count(*) as n_detections, count(*) filter (where not exists (select 1 from truth t
            where t.recording_id = d.recording_id and abs(d.sample - t.t) <= 1)) as total_fp from det d group by 1),
    p as (select *, n_truth - hits as misses, hits / greatest(n_truth, 1)::double as recall,
            hits / greatest(hits + total_fp, 1)::double as precision from h join f using (recording_id))
    select recording_id, n_truth, hits, misses, n_detections, total_fp, round(recall, 6) as recall,
      round(precision, 6) as precision,
      round(case when recall + precision > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1
    from p""",
)
def detector_eval(spark, sf):
    found = cut_lineage(detect_peaks(spark, sf))
    out = sweep.evaluate(found, truth(spark, sf), KEYS, tolerance=1)
    return out.select(
        *[F.round(c, 6).alias(c) if c in ("recall", "precision", "f1") else F.col(c) for c in out.columns]
    )


@query(
    "impulse_trace",
    f"""with {EV}, {TRUTH} select recording_id, sample, v as score, cast(exists (select 1 from truth t
      where t.recording_id = e.recording_id and t.t = e.sample) as int) as impulse from ev e
    where exists (select 1 from truth t where t.recording_id = e.recording_id and e.sample between t.t - 1 and t.t + 2)""",
)
def impulse_trace(spark, sf):
    return dense.impulse_trace(series(spark, sf), truth(spark, sf), 1, 2)


@query(
    "diagnostic_window",
    f"""with {EV}, {TRUTH}, t0 as (select recording_id, min(t) as t0 from truth where t >= 1000 group by 1),
    r as (select 'trace' as kind, recording_id, sample, cast(v as double) as score from ev
      union all select 'detection', recording_id, sample, cast(v as double) from ev where v > 20000
      union all select 'truth', recording_id, t, null from truth)
    select kind, recording_id, sample, score from r join t0 using (recording_id) where abs(sample - t0) <= 150""",
)
def diagnostic_window(spark, sf):
    trace = series(spark, sf)
    return dense.diagnostic_window(trace, trace.where(peaks.above("score", 20000)), truth(spark, sf), 1000, 150)


@query(
    "range_fetch",
    f"""with {MULTI} select recording_id, sample, channel, cast(value as double) as value from m
    where sample >= 37 and sample < 337 and (sample - 37) % 3 = 0 and channel in (2, 5)""",
)
def range_fetch(spark, sf):
    return ch.fetch(packed(spark, sf), 37, 300, channels=[2, 5], downsample=3)


@query(
    "latest_fetch",
    f"""with {MULTI}, l as (select recording_id, max(sample) + 1 as e from m group by 1)
    select recording_id, sample, channel, cast(value as double) as value from m join l using (recording_id)
    where sample >= greatest(e - 400, 0)""",
)
def latest_fetch(spark, sf):
    return ch.fetch_latest(packed(spark, sf), 400)


@query(
    "counts_to_volts",
    f"""with {MULTI} select recording_id, sample, channel, cast(value as double) as value,
      round(value * ((channel + 1) * 0.001::double), 6) as volts from m""",
)
def counts_to_volts(spark, sf):
    long = ch.unpack(packed(spark, sf))
    scale = signal(spark, sf).select("channel").distinct().withColumn(
        "volts_per_count", (F.col("channel") + 1) * F.lit(0.001)
    )
    return ch.to_volts(long, scale).withColumn("volts", F.round("volts", 6))


@query(
    "continuity_check",
    """with l as (select distinct l_suppkey as recording_id, l_orderkey as pos, 1 + l_orderkey % 3 as n from lineitem),
    s as (select *, max(pos + n) over (partition by recording_id order by pos
          rows between unbounded preceding and 1 preceding) as expected from l)
    select recording_id, expected, pos as found from s where expected <> pos""",
)
def continuity_check(spark, sf):
    from tracewell.operators.edges import continuity

    spans = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .select(
            F.col("l_suppkey").alias("recording_id"),
            F.col("l_orderkey").alias("start_sample"),
            (1 + F.col("l_orderkey") % 3).alias("n_samples"),
        )
        .distinct()
    )
    return continuity(spans, KEYS)
