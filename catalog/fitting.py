"""Templates, channel and interferer selection, noise statistics, filters and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.signals import packed
from catalog.views import CHANNELS, CHUNK, EV, KEYS, MULTI, UNITS, signal, units
from tracewell.operators import solve, templates as tp
from tracewell.plans import fit as plans
from tracewell.session import cut_lineage

T, OFF, CAP, PICKED, RIVALS, FS = 5, 2, 20, 3, 2, 100.0
SETTINGS = plans.FitSettings(T, OFF, PICKED, 1e-3)

LEN = "len as (select recording_id, max(sample) + 1 as n from m group by 1)"
VALID = f"""{LEN}, vs as (select s.* from spk s join len using (recording_id) where t > {OFF} and t < n - {T} + {OFF}),
cs as (select * from (select *, row_number() over (partition by recording_id, unit_id order by md5(t::varchar)) as rn from vs) where rn <= {CAP})"""
WAVE = f"""{VALID}, wf as (select c.recording_id, c.unit_id, cast(k as int) as k, m.channel, sum(m.value)::double / count(*) as value,
  count(*) as n_used from vs c, range({T}) r(k) join m on m.recording_id = c.recording_id and m.sample = c.t - {OFF} + k group by 1, 2, 3, 4),
en as (select recording_id, unit_id, channel, sum(value * value) as energy, max(value) - min(value) as peak_to_peak from wf group by 1, 2, 3)"""
LABELS = "lab as (select distinct user_id % 50 as unit_id, case when user_id % 50 % 7 = 3 then 'Noise' else 'good' end as label from ev)"
ACTIVE = f"""{LABELS}, act as (select recording_id, unit_id, count(*) as n_spikes,
  row_number() over (partition by recording_id order by count(*) desc, unit_id) as activity_rank
  from spk join lab using (unit_id) where lower(label) <> 'noise' group by 1, 2),
tg as (select recording_id, unit_id as target_id from act),
riv as (select * from (select tg.recording_id, target_id, a.unit_id, a.n_spikes,
  row_number() over (partition by tg.recording_id, target_id order by activity_rank) as pick
  from tg join act a on a.recording_id = tg.recording_id and a.unit_id <> target_id) where pick <= {RIVALS})"""
SELECTED = f"""own as (select tg.recording_id, target_id, channel, energy from tg join en on en.recording_id = tg.recording_id and en.unit_id = target_id),
rv as (select r.recording_id, target_id, channel, max(energy) as e from riv r join en using (recording_id, unit_id) group by 1, 2, 3),
sel as (select * from (select *, row_number() over (partition by recording_id, target_id order by ratio desc, channel) as rank from (
  select o.recording_id, o.target_id, o.channel,
    case when o.energy >= 0.05::double * max(o.energy) over (partition by o.recording_id, o.target_id)
      then o.energy / (coalesce(rv.e, 0) + 1e-9::double) else '-infinity'::double end as ratio
  from own o left join rv using (recording_id, target_id, channel))) where rank <= {PICKED})"""
QUIET = f"""loc as (select recording_id, target_id, target_id as unit_id from tg union all select recording_id, target_id, unit_id from riv),
qt as (select distinct l.recording_id, l.target_id, s.t from loc l join spk s using (recording_id, unit_id)),
busy as (select distinct q.recording_id, q.target_id, i as sample from qt q join len using (recording_id), range(-{OFF}, {T - 1 + OFF}) r(j),
  lateral (select q.t + j as i) where i >= 0 and i < n),
fr as (select tg.recording_id, tg.target_id, x.sample, x.sample - row_number() over (partition by tg.recording_id, tg.target_id order by x.sample) as g
  from tg join (select distinct recording_id, sample from m) x on x.recording_id = tg.recording_id
  where not exists (select 1 from busy b where b.recording_id = tg.recording_id and b.target_id = tg.target_id and b.sample = x.sample)),
seg as (select recording_id, target_id, min(sample) as "start", max(sample) + 1 as "end", count(*) as length
  from fr group by recording_id, target_id, g having count(*) >= {2 * T})"""


def order():
    return F.md5(F.col("spike_time").cast("string"))


def labels(spark, sf):
    unit = F.col("unit_id")
    return (
        units(spark, sf).select("unit_id").distinct()
        .withColumn("label", F.when(unit % 7 == 3, "Noise").otherwise("good"))
    )


def waveforms(spark, sf):
    return tp.mean_waveforms(packed(spark, sf), CHUNK, units(spark, sf), T, OFF)


def ranked(spark, sf):
    return tp.activity(units(spark, sf), labels(spark, sf))


def targets(spark, sf):
    return ranked(spark, sf).select("recording_id", F.col("unit_id").alias("target_id"))


def rivals(spark, sf):
    return tp.most_active(ranked(spark, sf), targets(spark, sf), RIVALS)


def fitted(spark, sf):
    return plans.fit(
        packed(spark, sf), CHUNK, units(spark, sf), cut_lineage(targets(spark, sf)),
        cut_lineage(rivals(spark, sf)), SETTINGS,
    )


@query(
    "snippet_gather",
    f"""with {MULTI}, {UNITS}, {VALID} select v.recording_id, unit_id, t as spike_time,
    cast((i - 1) // {T} as int) as channel, cast((i - 1) % {T} as int) as k, cast(m.value as double) as value
    from vs v, range(1, {CHANNELS * T + 1}) r(i) join m on m.recording_id = v.recording_id
      and m.sample = v.t - {OFF} + (i - 1) % {T} and m.channel = (i - 1) // {T}""",
)
def snippet_gather(spark, sf):
    rows = tp.snippets(packed(spark, sf), CHUNK, units(spark, sf), T, OFF)
    return rows.select("recording_id", "unit_id", "spike_time", F.posexplode("values").alias("_i", "value")).select(
        "recording_id", "unit_id", "spike_time", F.floor(F.col("_i") / T).cast("int").alias("channel"),
        (F.col("_i") % T).cast("int").alias("k"), "value",
    )


@query("valid_spikes", f"with {MULTI}, {UNITS}, {VALID} select recording_id, t as spike_time, unit_id from vs")
def valid_spikes(spark, sf):
    return tp.valid_spikes(units(spark, sf), tp.lengths_of(packed(spark, sf)), T, OFF)


@query("capped_spikes", f"with {MULTI}, {UNITS}, {VALID} select recording_id, t as spike_time, unit_id from cs")
def capped_spikes(spark, sf):
    return tp.cap_per_group(valid_spikes(spark, sf), ["recording_id", "unit_id"], CAP, order())


@query(
    "snippet_average",
    f"with {MULTI}, {UNITS}, {WAVE} select recording_id, unit_id, k, channel, round(value, 6) as value, n_used from wf",
)
def snippet_average(spark, sf):
    return waveforms(spark, sf).withColumn("value", F.round("value", 6))


@query(
    "channel_energy",
    f"""with {MULTI}, {UNITS}, {WAVE} select recording_id, unit_id, channel, round(energy / 1e6::double, 4) as energy_millions,
    round(peak_to_peak, 6) as peak_to_peak from en""",
)
def channel_energy(spark, sf):
    return tp.channel_energy(waveforms(spark, sf)).select(
        "recording_id", "unit_id", "channel", F.round(F.col("energy") / 1e6, 4).alias("energy_millions"),
        F.round("peak_to_peak", 6).alias("peak_to_peak"),
    )


@query(
    "peak_channel",
    f"""with {MULTI}, {UNITS}, {WAVE} select recording_id, unit_id, channel from (select *, row_number() over
    (partition by recording_id, unit_id order by peak_to_peak desc, channel) as rn from en) where rn = 1""",
)
def peak_channel(spark, sf):
    return tp.peak_channels(waveforms(spark, sf))


@query(
    "unit_activity",
    f"with {MULTI}, {UNITS}, {ACTIVE} select recording_id, unit_id, n_spikes, cast(activity_rank as int) as activity_rank from act",
)
def unit_activity(spark, sf):
    return ranked(spark, sf)


@query(
    "activity_topn",
    f"with {MULTI}, {UNITS}, {ACTIVE} select recording_id, target_id, unit_id, n_spikes, cast(pick as int) as pick from riv",
)
def activity_topn(spark, sf):
    return rivals(spark, sf).drop("activity_rank")


@query(
    "spatial_pick",
    f"""with {MULTI}, {UNITS}, {ACTIVE}, {WAVE},
    pc as (select recording_id, unit_id, channel from (select *, row_number() over
      (partition by recording_id, unit_id order by peak_to_peak desc, channel) as rn from en) where rn = 1),
    pos as (select pc.*, (channel % 2) * 30.0::double as x, channel * 20.0::double as y from pc),
    pool as (select tg.recording_id, target_id, a.unit_id, activity_rank
      from tg join act a on a.recording_id = tg.recording_id and a.unit_id <> target_id),
    d as (select p.recording_id, p.target_id, p.unit_id, activity_rank, sqrt(power(u.x - o.x, 2) + power(u.y - o.y, 2)) as distance
      from pool p join pos u on u.recording_id = p.recording_id and u.unit_id = p.unit_id
      join pos o on o.recording_id = p.recording_id and o.unit_id = p.target_id)
    select recording_id, target_id, unit_id, cast(pick as int) as pick, round(distance, 6) as distance from (select *, row_number() over
      (partition by recording_id, target_id order by distance, activity_rank) as pick from d) where pick <= 4""",
)
def spatial_pick(spark, sf):
    sites = signal(spark, sf).select("recording_id", "channel").distinct().select(
        "recording_id", "channel", (F.col("channel") % 2 * F.lit(30.0)).alias("x"), (F.col("channel") * F.lit(20.0)).alias("y")
    )
    out = tp.nearest_units(
        ranked(spark, sf), targets(spark, sf), tp.peak_channels(waveforms(spark, sf)), sites, 4
    )
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "select_channels",
    f"""with {MULTI}, {UNITS}, {ACTIVE}, {WAVE}, {SELECTED}
    select recording_id, target_id, channel, cast(rank as int) as rank, round(ratio, 6) as ratio from sel""",
)
def select_channels(spark, sf):
    energies = cut_lineage(tp.channel_energy(waveforms(spark, sf)))
    out = tp.select_channels(energies, rivals(spark, sf), PICKED, targets(spark, sf))
    return out.withColumn("ratio", F.round("ratio", 6))


@query(
    "quiet_segments",
    f"""with {MULTI}, {UNITS}, {ACTIVE}, {LEN}, {QUIET} select recording_id, target_id, "start", "end", length from seg""",
)
def quiet_segments(spark, sf):
    own, near = targets(spark, sf), rivals(spark, sf)
    local = near.select("recording_id", "target_id", "unit_id").unionByName(
        own.withColumn("unit_id", F.col("target_id"))
    )
    times = local.join(units(spark, sf), ["recording_id", "unit_id"]).select("recording_id", "target_id", "spike_time").distinct()
    return solve.quiet_segments(times, own.join(tp.lengths_of(packed(spark, sf)), KEYS), T, OFF)


@query(
    "lag_covariance",
    f"""with {MULTI}, {UNITS}, {ACTIVE}, {WAVE}, {SELECTED}, {QUIET},
    z0 as (select s.recording_id, s.target_id, s."start" as st, m.sample, m.channel, m.value::double as v from seg s
      join sel c on c.recording_id = s.recording_id and c.target_id = s.target_id
      join m on m.recording_id = s.recording_id and m.channel = c.channel and m.sample >= s."start" and m.sample < s."end"),
    z as (select *, count(*) over w as n, count(*) over w * v - sum(v) over w as z from z0
      window w as (partition by recording_id, target_id, st, channel)),
    tot as (select recording_id, target_id, sum(length) as total from seg group by 1, 2),
    -- n v - sum is a whole number: exact sums per segment, divided once
    seg_sums as (select a.recording_id, a.target_id, a.st, cast(lag as int) as lag, a.channel as early, b.channel as late,
        sum(a.z * b.z) / any_value(a.n * a.n)::double as s
      from z a, range({T}) r(lag) join z b on b.recording_id = a.recording_id and b.target_id = a.target_id and b.st = a.st
        and b.sample = a.sample + lag group by 1, 2, 3, 4, 5, 6)
    select recording_id, target_id, lag, early, late, round(sum(s) / any_value(total) / 1e6::double, 4) as millions
    from seg_sums join tot using (recording_id, target_id) group by 1, 2, 3, 4, 5""",
)
def lag_covariance(spark, sf):
    return fitted(spark, sf).products.withColumn("millions", F.round(F.col("value") / 1e6, 4)).drop("value")


@query(
    "lcmv_gain",
    f"""with {MULTI}, {UNITS}, {ACTIVE}, {LEN}, {QUIET}, ok as (select distinct recording_id, target_id from seg)
    select recording_id, target_id, unit_id, case when unit_id = target_id then 1.0::double else 0.0::double end as gain
    from loc join ok using (recording_id, target_id)""",
)
def lcmv_gain(spark, sf):
    """Every fitted filter passes its target with gain 1 and blocks its interferers."""
    result = fitted(spark, sf)
    gains = solve.gains(result.filters, result.waveforms, rivals(spark, sf).join(result.filters, ["recording_id", "target_id"], "left_semi"))
    return gains.withColumn("gain", F.round("gain", 4) + F.lit(0.0))


@query("fit_filters")
def fit_filters(spark, sf):
    result = fitted(spark, sf).filters
    return result.select("recording_id", "target_id", "channels", F.transform("taps", lambda w: F.round(w, 9)).alias("taps"))


@query(
    "fit_problems",
    f"""with {MULTI}, {UNITS}, {ACTIVE}, {VALID}, {QUIET},
    t as (select recording_id, target_id from tg union all select distinct recording_id, cast(-7 as bigint) from tg)
    select recording_id, target_id, case when target_id = -7 then 'no spikes'
      when not exists (select 1 from vs where vs.recording_id = t.recording_id and vs.unit_id = target_id) then 'no usable spikes'
      else 'no spike-free segment' end as reason
    from t where not exists (select 1 from seg where seg.recording_id = t.recording_id and seg.target_id = t.target_id)""",
)
def fit_problems(spark, sf):
    """Targets that got no filter; one unit that never fires is asked for on purpose."""
    known = cut_lineage(targets(spark, sf))
    silent = known.select("recording_id").distinct().withColumn("target_id", F.lit(-7).cast("bigint"))
    asked = cut_lineage(known.unionByName(silent))
    spikes = units(spark, sf)
    result = plans.fit(packed(spark, sf), CHUNK, spikes, asked, cut_lineage(rivals(spark, sf)), SETTINGS)
    return plans.problems(result, asked, spikes)


@query("calibration")
def calibration(spark, sf):
    """Fit on the first half, sweep the second, one operating point per target."""
    filters = plans.calibrate(
        packed(spark, sf), CHUNK, units(spark, sf), cut_lineage(targets(spark, sf)),
        cut_lineage(rivals(spark, sf)), FS, SETTINGS, suppression="window",
    ).filters
    return filters.select("recording_id", "target_id", F.round("threshold", 6).alias("threshold"))


@query("calibration_priority")
def calibration_priority(spark, sf):
    curve = plans.calibrate(
        packed(spark, sf), CHUNK, units(spark, sf), cut_lineage(targets(spark, sf)),
        cut_lineage(rivals(spark, sf)), FS, SETTINGS, criterion="best_recall",
    ).curve
    return curve.drop("fp_by_interferer").select(
        "recording_id", "target_id", "idx", "hits", "total_fp", "n_detections", F.round("f1", 6).alias("f1")
    )


@query("data_fraction")
def data_fraction(spark, sf):
    out = plans.data_fractions(
        packed(spark, sf), CHUNK, units(spark, sf), cut_lineage(targets(spark, sf)),
        cut_lineage(rivals(spark, sf)), FS, 0.5, (0.25, 0.5), SETTINGS,
    )
    return out.select("recording_id", "target_id", "train_fraction", "n_truth", "hits", "total_fp", F.round("f1", 6).alias("f1"))


@query(
    "clip_to_last_spike",
    f"""with {MULTI}, {UNITS}, {LEN}, l as (select recording_id, least(any_value(n), max(t) + 2) as cut from spk join len using (recording_id) group by 1)
    select recording_id, sample, channel, value from m join l using (recording_id) where sample < cut""",
)
def clip_to_last_spike(spark, sf):
    limits = tp.clip_length(packed(spark, sf), units(spark, sf), 2.0)
    return tp.clip_chunks(signal(spark, sf), limits)


@query(
    "time_split",
    f"""with {MULTI}, {UNITS}, {LEN}, sp as (select recording_id, cast(floor(n * 0.3::double) as bigint) as split from len)
    select recording_id, unit_id, case when t < split then t else t - split end as spike_time,
      case when t < split then 'train' else 'test' end as part from spk join sp using (recording_id)""",
)
def time_split(spark, sf):
    splits = tp.split_at(tp.lengths_of(packed(spark, sf)), 0.3)
    spikes = units(spark, sf)
    train = tp.train_part(spikes, splits, "spike_time").withColumn("part", F.lit("train"))
    return train.unionByName(tp.test_part(spikes, splits, "spike_time").withColumn("part", F.lit("test")))


@query(
    "signal_split",
    f"""with {MULTI}, {LEN}, sp as (select recording_id, cast(floor(n * 0.3::double) as bigint) as split from len)
    select recording_id, case when sample < split then 'train' else 'test' end as part, count(*) as n,
      min(sample) as first, max(sample) as last, sum(value * (sample + channel)) as checksum from m join sp using (recording_id) group by 1, 2""".replace(
        "sum(value * (sample + channel))", "cast(sum(value * (sample + channel)) as bigint)"
    ),
)
def signal_split(spark, sf):
    from tracewell.sources.chunks import unpack

    chunks = packed(spark, sf)
    splits = tp.split_at(tp.lengths_of(chunks), 0.3)
    both = None
    for side in ("train", "test"):
        part = unpack(plans.cut_chunks(chunks, splits, side)).withColumn("part", F.lit(side))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("recording_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample").alias("first"), F.max("sample").alias("last"),
        F.sum((F.col("value") * (F.col("sample") + F.col("channel"))).cast("bigint")).alias("checksum"),
    )


@query(
    "global_std",
    f"with {MULTI} select recording_id, round(stddev_pop(value), 4) as std from m group by 1",
)
def global_std(spark, sf):
    from tracewell.sources.chunks import unpack

    return unpack(packed(spark, sf)).groupBy("recording_id").agg(F.round(F.stddev_pop("value"), 4).alias("std"))


@query(
    "position_lookup",
    f"""with {MULTI}, {UNITS}, {WAVE}, pc as (select recording_id, unit_id, channel from (select *, row_number() over
      (partition by recording_id, unit_id order by peak_to_peak desc, channel) as rn from en) where rn = 1)
    select recording_id, unit_id, channel, case when channel < 4 then channel * 16.0::double else channel::double end as x,
      case when channel < 4 then 5.0::double else 0.0::double end as y from pc""",
)
def position_lookup(spark, sf):
    """Channel positions with the fallback (index in group, 0) where geometry is missing."""
    from tracewell.session import join_dimension
    from tracewell.sources.metadata import position_or_index

    known = signal(spark, sf).select("recording_id", "channel").distinct().where("channel < 4").select(
        "recording_id", "channel", (F.col("channel") * F.lit(16.0)).alias("gx"), F.lit(5.0).alias("gy")
    )
    found = join_dimension(tp.peak_channels(waveforms(spark, sf)), known, ["recording_id", "channel"], "left")
    x, y = position_or_index(F.col("gx"), F.col("gy"), F.col("channel"))
    return found.select("recording_id", "unit_id", "channel", x.alias("x"), y.alias("y"))
