"""Learned filters: snippet sets, augmentation, hinge fit, hard negatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.fitting import LEN, OFF, T, VALID, order
from catalog.registry import query
from catalog.signals import packed
from catalog.views import CHANNELS, CHUNK, EV, KEYS, MULTI, UNITS, lengths, read, truth, units
from tracewell.operators import learned, signal, sweep, templates as tp
from tracewell.session import cut_lineage
from tracewell.sources.filters import left_margin

N_OUT = 10
SNIP = f"""{VALID}, sn as (select v.recording_id, v.unit_id, v.t as spike_time,
  list(m.value::double order by m.channel, m.sample) as vals from vs v join m on m.recording_id = v.recording_id
  and m.sample between v.t - {OFF} and v.t - {OFF} + {T - 1} group by 1, 2, 3),
num as (select *, row_number() over (partition by recording_id, unit_id order by spike_time) - 1 as n,
  count(*) over (partition by recording_id, unit_id) as size from sn),
rnum as (select *, row_number() over (partition by recording_id order by spike_time, unit_id) - 1 as rn,
  count(*) over (partition by recording_id) as rsize from sn)"""
# A fixed integer weight vector so that scores are exact on both sides.
WEIGHTS = [(-1) ** i * (i % 7 - 2) for i in range(CHANNELS * T)]
WLIST = "[" + ", ".join(str(w) for w in WEIGHTS) + "]"
BIAS = -20000
SCORED = f"sc as (select *, list_sum(list_transform(list_zip(vals, {WLIST}), lambda p: p[1] * p[2])) + {BIAS} as score from sn)"


def uniform_sql(seed: str, *columns: str) -> str:
    inner = ", ".join([f"'{seed}'", *columns])
    return f"(('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::bigint / 4294967296.0::double)"


def snippets(spark, sf):
    return tp.snippets(packed(spark, sf), CHUNK, units(spark, sf), T, OFF)


@query(
    "noise_sample",
    f"""with {EV}, tr as (select recording_id, sample as t from ev where event_type = 'purchase'),
    n as (select recording_id, max(sample) + 1 as n from ev group by 1),
    fr as (select distinct e.recording_id, e.sample from ev e join n using (recording_id) where e.sample > 1 and e.sample < n - 3 + 1
      and not exists (select 1 from tr where tr.recording_id = e.recording_id and e.sample >= tr.t - 4 and e.sample < tr.t + 4)),
    nr as (select *, row_number() over (partition by recording_id order by sample) - 1 as r, count(*) over (partition by recording_id) as total from fr),
    d as (select recording_id, total, i, i * total // least(300, total) as lo, (i + 1) * total // least(300, total) as hi
      from (select distinct recording_id, total from nr), range(300) r(i) where i < least(300, total))
    select d.recording_id, sample as spike_time, cast(-1 as bigint) as unit_id from d join nr on nr.recording_id = d.recording_id
      and nr.r = lo + cast(floor({uniform_sql('noise', 'd.recording_id', 'i')} * (hi - lo)) as bigint)""",
)
def noise_sample(spark, sf):
    """Template length 3, offset 1: centres outside [t - 4, t + 4) of every spike."""
    return learned.noise_centres(truth(spark, sf), lengths(spark, sf), 3, 1, 300, "noise")


@query(
    "snippet_sets",
    f"""with {MULTI}, {UNITS}, {SNIP} select recording_id, case when unit_id < 10 then 'positive' else 'interferer' end as source,
    count(*) as n, cast(sum(list_sum(vals)) as bigint) as total from sn group by 1, 2""",
)
def snippet_sets(spark, sf):
    source = F.when(F.col("unit_id") < 10, "positive").otherwise("interferer")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return snippets(spark, sf).groupBy("recording_id", source.alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).cast("bigint").alias("total")
    )


@query(
    "augment",
    f"""with {MULTI}, {UNITS}, {SNIP}, g as (select distinct recording_id, unit_id, size from num),
    d as (select *, cast(floor({uniform_sql('7pick', 'recording_id', 'unit_id', 'draw')} * size) as bigint) as pick,
      -3 + cast(floor({uniform_sql('7shift', 'recording_id', 'unit_id', 'draw')} * 7) as int) as shift,
      0.7::double + {uniform_sql('7amp', 'recording_id', 'unit_id', 'draw')} * (1.3::double - 0.7::double) as amp
      from g, range({N_OUT}) r(draw))
    select d.recording_id, d.unit_id, spike_time, cast(draw as int) as draw, cast(i as int) as i,
      round(vals[(i // {T}) * {T} + ((i % {T} - shift) % {T} + {T}) % {T} + 1] * amp
        + sqrt(-2 * ln(1 - {uniform_sql('7noisea', 'd.recording_id', 'd.unit_id', 'draw', 'i')}))
        * cos(2 * pi() * {uniform_sql('7noiseb', 'd.recording_id', 'd.unit_id', 'draw', 'i')}) * 10, 4) as value
    from d join num on num.recording_id = d.recording_id and num.unit_id = d.unit_id and num.n = d.pick, range({CHANNELS * T}) q(i)""",
)
def augment(spark, sf):
    out = learned.augment(snippets(spark, sf), N_OUT, T, seed=7, noise_std=10.0)
    return out.select(
        "recording_id", "unit_id", "spike_time", "draw", F.posexplode("values").alias("i", "value")
    ).withColumn("value", F.round("value", 4))


@query(
    "overlay",
    f"""with {MULTI}, {UNITS}, {SNIP}, g as (select distinct recording_id, unit_id, size from num),
    rs as (select distinct recording_id, rsize from rnum),
    d as (select *, cast(floor({uniform_sql('9pick', 'recording_id', 'unit_id', 'draw')} * size) as bigint) as pick,
      cast(floor({uniform_sql('9other', 'recording_id', 'unit_id', 'draw')} * rsize) as bigint) as other,
      -20 + cast(floor({uniform_sql('9shift', 'recording_id', 'unit_id', 'draw')} * 41) as int) as shift
      from g join rs using (recording_id), range({N_OUT}) r(draw))
    select d.recording_id, d.unit_id, num.spike_time, cast(draw as int) as draw, cast(i as int) as i,
      num.vals[i + 1] + o.vals[(i // {T}) * {T} + ((i % {T} - shift) % {T} + {T}) % {T} + 1] as value
    from d join num on num.recording_id = d.recording_id and num.unit_id = d.unit_id and num.n = d.pick
    join rnum o on o.recording_id = d.recording_id and o.rn = d.other, range({CHANNELS * T}) q(i)""",
)
def overlay(spark, sf):
    cut = snippets(spark, sf)
    out = learned.overlay(cut, cut, N_OUT, T, seed=9)
    return out.select("recording_id", "unit_id", "spike_time", "draw", F.posexplode("values").alias("i", "value"))


@query(
    "class_weights",
    """select vec_id, case when label = 0 then 1.0::double else 0.0::double end as label,
    round(case when label = 0 then (select count(*) filter (where label <> 0) / greatest(count(*) filter (where label = 0), 1)::double from embeddings)
      else 1 end, 6) as weight from embeddings""",
)
def class_weights(spark, sf):
    return learned.weighted(examples(spark, sf)).select("vec_id", "label", F.round("weight", 6).alias("weight"))


def examples(spark, sf):
    return read(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("values"),
        F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("label"),
    )


HINGE_BIAS = 0.25


def hinge_weights():
    return [((7 * i) % 11 - 5) / 10 for i in range(64)]


@query(
    "hinge_sums",
    f"""with c as (select vec_id, embedding, case when label = 0 then 1.0::double else -1.0::double end as y,
      case when label = 0 then (select count(*) filter (where label <> 0) / greatest(count(*) filter (where label = 0), 1)::double from embeddings)
      else 1 end as weight from embeddings),
    s as (select *, greatest(0, 1 - y * ({HINGE_BIAS}::double + list_sum(list_transform(range(64), lambda i:
      embedding[i + 1]::double * (((7 * i) % 11 - 5) / 10.0::double))))) as short from c),
    g as (select *, -2 * weight * y * short as slope from s)
    select 0::bigint as i, round(sum(weight * short * short), 6) as v from g
    union all select i + 1, round(sum(slope * embedding[i + 1]::double), 6) from g, range(64) r(i) group by i
    union all select 65, round(sum(slope), 6) from g union all select 66, round(sum(weight), 6) from g""",
)
def hinge_sums(spark, sf):
    """Loss, gradient and weight at one point: what a round of the fit moves."""
    sums = learned.hinge_sums(learned.weighted(examples(spark, sf)), np.array([*hinge_weights(), HINGE_BIAS]))
    rows = spark.createDataFrame(list(enumerate(sums.tolist())), "i bigint, v double")
    return rows.withColumn("v", F.round("v", 6))


@query("hinge_warm_start")
def hinge_warm_start(spark, sf):
    """The fit from zero, and from the other learned filter: one loss, fewer rounds."""
    rows = cut_lineage(learned.weighted(examples(spark, sf)))
    cold = learned.fit_hinge(rows, 64, reg=0.01, max_rounds=60)
    warm = learned.fit_hinge(rows, 64, reg=0.01, max_rounds=60, start=(cold.weights * 1.05, cold.bias))
    out = [("zero", round(cold.loss, 6), cold.rounds), ("near", round(warm.loss, 6), warm.rounds)]
    return spark.createDataFrame(out, "start string, loss double, rounds bigint")


@query("svm_scores")
def svm_scores(spark, sf):
    rows = examples(spark, sf)
    model = learned.fit_linear(learned.weighted(rows), reg=0.01, max_iter=20)
    return rows.select(
        "vec_id", "label", F.round(learned.linear_score(F.col("values"), model.coefficients.toArray(), model.intercept), 6).alias("score")
    )


@query(
    "taps_reshape",
    """select vec_id, cast(i as int) as i, embedding[(i % 4) * 16 + i // 4 + 1]::double as tap from embeddings, range(64) r(i)""",
)
def taps_reshape(spark, sf):
    """64 weights of 4 channels x 16 samples as time-major taps."""
    taps = learned.taps_from_weights(F.col("values"), 4, 16)
    return examples(spark, sf).select("vec_id", F.posexplode(taps).alias("i", "tap"))


@query(
    "hard_negatives",
    f"""with {MULTI}, {UNITS}, {SNIP}, {SCORED}
    select recording_id, unit_id, spike_time, score from (select *, row_number() over
      (partition by recording_id, unit_id order by score desc, spike_time) as rn from sc where score > 0) where rn <= 5""",
)
def hard_negatives(spark, sf):
    return learned.hard_negatives(snippets(spark, sf), WEIGHTS, BIAS, 5).drop("values")


@query(
    "training_diagnostics",
    f"""with {MULTI}, {UNITS}, {SNIP}, {SCORED} select case when unit_id < 10 then 1.0::double else 0.0::double end as label, count(*) as n,
    round(avg(case when score > 0 then 1 else 0 end), 6) as share_above_0 from sc group by 1""",
)
def training_diagnostics(spark, sf):
    rows = snippets(spark, sf).withColumn("label", F.when(F.col("unit_id") < 10, 1.0).otherwise(0.0))
    out = learned.diagnostics(rows, WEIGHTS, BIAS)
    return out.withColumn("share_above_0", F.round("share_above_0", 6))


@query("learned_threshold")
def learned_threshold(spark, sf):
    """Train with hard-negative mining, export as a filter, threshold from its own trace."""
    chunks, spikes = packed(spark, sf), cut_lineage(units(spark, sf))
    cut = cut_lineage(tp.snippets(chunks, CHUNK, spikes, T, OFF))
    pos, neg = cut.where("unit_id < 10"), cut.where("unit_id >= 10")
    model = learned.train_with_mining(pos, neg, neg, rounds=2, per_unit=50, reg=0.01, max_iter=20)
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()])
    bank = chunks.select("recording_id").distinct().select(
        "recording_id", F.lit(0).cast("bigint").alias("target_id"),
        F.sequence(F.lit(0), F.lit(CHANNELS - 1)).alias("channels"),
        learned.taps_from_weights(weights, CHANNELS, T).alias("taps"),
        F.lit(OFF).alias("left_margin"), F.lit(0.0).alias("threshold"),
    )
    trace = signal.score_trace(chunks, CHUNK, bank, T, edge="open")
    trace = trace.withColumn("score", F.col("score") + F.lit(float(model.intercept)))
    out = sweep.robust_threshold(trace, ["recording_id", "target_id"], spikes, T, OFF, spike_keys=KEYS)
    return out.select("recording_id", "target_id", F.round("threshold", 4).alias("threshold"))
