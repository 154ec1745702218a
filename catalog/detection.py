"""Peaks, matching, sweeps and operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.signals import FIR, SINGLE, WIN, bank, packed_single
from catalog.views import BLOCK, CHUNK, EV, KEYS, OTHERS, TRUTH, events, lengths, others, series, truth
from tracewell.operators import matching, peaks, quantiles, sweep
from tracewell.plans import fit as plans
from tracewell.session import cut_lineage

REACH, TOLERANCE, HEIGHT = 10, 2, 9000

NMS = """win as (
  select recording_id, sample, v as score,
    max(v) over (partition by recording_id order by sample range between 10 preceding and 1 preceding) as l,
    max(v) over (partition by recording_id order by sample range between 1 following and 10 following) as r
  from ev),
pk as (select recording_id, sample, score from win
       where score > coalesce(l, -1) and score > coalesce(r, -1))"""
NEAR_T = "exists (select 1 from truth x where x.recording_id = p.recording_id and abs(x.t - p.sample) <= 2)"
FP = f"fp as (select p.* from pk p where not {NEAR_T})"
GRID = """ends as (
  select recording_id, quantile_cont(cast(score as double), 0.5) as lo,
         quantile_cont(cast(score as double), 0.9999) as hi
  from pk group by 1),
grid as (select recording_id, cast(i as int) as idx, lo + (hi - lo) * i / 59 as threshold
         from ends, range(60) r(i))"""
SWEEP = f"""pkf as (select p.*, not {NEAR_T} as is_fp from pk p),
hit as (select g.recording_id, g.idx, count(*) as hits from grid g
        join (select t.recording_id, t.t, max(p.score) as best from truth t join pk p
              on p.recording_id = t.recording_id and abs(p.sample - t.t) <= 2 group by 1, 2) b
        on b.recording_id = g.recording_id and b.best > g.threshold group by 1, 2),
det as (select g.recording_id, g.idx, count(*) as n_detections,
               count(*) filter (where p.is_fp) as total_fp
        from grid g join pkf p on p.recording_id = g.recording_id and p.score > g.threshold group by 1, 2),
nt as (select recording_id, count(*) as n_truth from truth group by 1),
dur as (select recording_id, (max(sample) + 1) / 100.0 as seconds from ev group by 1),
base as (select g.recording_id, g.idx, g.threshold, coalesce(h.hits, 0) as hits,
                coalesce(d.n_detections, 0) as n_detections, coalesce(d.total_fp, 0) as total_fp,
                coalesce(n.n_truth, 0) as n_truth, u.seconds
         from grid g left join hit h using (recording_id, idx) left join det d using (recording_id, idx)
         left join nt n using (recording_id) join dur u using (recording_id)),
rates as (select *, n_truth - hits as misses, hits / greatest(n_truth, 1)::double as recall,
                 hits / greatest(hits + total_fp, 1)::double as precision,
                 total_fp / seconds::double as fp_rate_hz from base),
curve as (select *, case when recall + precision > 0 then 2 * precision * recall / (precision + recall)
                    else 0 end as f1 from rates)"""
CURVE_COLUMNS = """recording_id, idx, round(threshold, 6) as threshold, hits, misses, total_fp, n_detections,
  n_truth, round(recall, 6) as recall, round(precision, 6) as precision, round(f1, 6) as f1,
  round(fp_rate_hz, 6) as fp_rate_hz"""


def found(spark, sf):
    return peaks.window_peaks(series(spark, sf), KEYS, REACH, block=BLOCK)


def with_seconds(curve, spark, sf):
    seconds = lengths(spark, sf).select("recording_id", (F.col("n_samples") / 100.0).alias("_s"))
    return (
        curve.join(seconds, KEYS).withColumn("fp_rate_hz", F.col("total_fp") / F.col("_s")).drop("_s")
    )


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


RATES = ("threshold", "recall", "precision", "f1", "fp_rate_hz")


def curve(spark, sf):
    return with_seconds(
        sweep.sweep(found(spark, sf), truth(spark, sf), KEYS, TOLERANCE, block=BLOCK), spark, sf
    )


@query(
    "nms_window",
    f"with {EV}, {NMS} select recording_id, sample, score from pk",
)
def nms_window(spark, sf):
    return found(spark, sf)


@query(
    "nms_window_live",
    f"""with {EV}, {NMS}, last as (select recording_id, max(sample) as newest from ev group by 1)
    select recording_id, sample, score from pk join last using (recording_id)
    where score > {HEIGHT} and sample + 10 <= newest""",
)
def nms_window_live(spark, sf):
    return peaks.window_peaks(
        series(spark, sf), KEYS, REACH, threshold=float(HEIGHT), complete=False, block=BLOCK
    )


@query(
    "local_maxima",
    f"""with {EV}, s as (select recording_id, sample, v as score,
        row_number() over (partition by recording_id order by sample)
        - row_number() over (partition by recording_id, v order by sample) as grp from ev),
    runs as (select recording_id, score, grp, min(sample) as a, max(sample) as b from s group by 1, 2, 3),
    n as (select *, lag(score) over w as before, lead(score) over w as after from runs
          window w as (partition by recording_id order by a))
    select recording_id, (a + b) // 2 as sample, score from n where score > before and score > after""",
)
def local_maxima(spark, sf):
    return peaks.local_maxima(series(spark, sf), KEYS, block=BLOCK)


@query("nms_priority")
def nms_priority(spark, sf):
    tops = peaks.local_maxima(series(spark, sf), KEYS, block=BLOCK)
    return peaks.priority_peaks(tops, KEYS, REACH, block=4 * BLOCK)


@query(
    "run_peaks",
    f"""with {EV}, hi as (select recording_id, sample, v as score,
        sample - row_number() over (partition by recording_id order by sample) as grp from ev where v > 3000)
    select recording_id, arg_min(sample, (-score, sample)) as sample, max(score) as score,
           min(sample) as run_start, count(*) as run_length
    from hi group by recording_id, grp""",
)
def run_peaks(spark, sf):
    return peaks.run_peaks(series(spark, sf), KEYS, 3000, block=BLOCK)


@query(
    "match_hits",
    f"""with {EV}, {TRUTH}, {NMS} select recording_id, t as spike_time from truth t where exists
    (select 1 from pk p where p.recording_id = t.recording_id and abs(p.sample - t.t) <= 2)""",
)
def match_hits(spark, sf):
    return matching.match_within(truth(spark, sf), found(spark, sf), KEYS, "spike_time", "sample", TOLERANCE)


@query("match_false_positives", f"with {EV}, {TRUTH}, {NMS}, {FP} select recording_id, sample, score from fp")
def match_false_positives(spark, sf):
    return matching.unmatched(found(spark, sf), truth(spark, sf), KEYS, "sample", "spike_time", TOLERANCE)


@query(
    "fp_attribution",
    f"""with {EV}, {TRUTH}, {OTHERS}, {NMS}, {FP}
    select fp.recording_id, unit_id, count(distinct sample) as fp from fp join others o
    on o.recording_id = fp.recording_id and abs(o.t - fp.sample) <= 2 group by 1, 2""",
)
def fp_attribution(spark, sf):
    named = matching.attribute(
        match_false_positives(spark, sf), others(spark, sf), KEYS, "sample", "spike_time", "unit_id", TOLERANCE
    )
    return named.groupBy("recording_id", "unit_id").agg(F.count(F.lit(1)).alias("fp"))


@query(
    "hit_near_truth",
    f"""with {EV}, {TRUTH}, h as (select t.recording_id, t.t, exists (select 1 from ev e
        where e.recording_id = t.recording_id and e.v > {HEIGHT} and e.sample >= t.t - 15 and e.sample < t.t + 15) as hit
        from truth t)
    select recording_id, count(*) as n_truth, count(*) filter (where hit) as hits from h group by 1""",
)
def hit_near_truth(spark, sf):
    loud = series(spark, sf).where(peaks.above("score", HEIGHT))
    marked = matching.mark_near(truth(spark, sf), loud, KEYS, "spike_time", "sample", 15, 14, "hit")
    return marked.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_truth"), F.count_if("hit").alias("hits")
    )


@query(
    "score_percentiles",
    f"""with {EV}, r as (select recording_id, v, row_number() over (partition by recording_id order by v) as rk,
        count(*) over (partition by recording_id) as n from ev)
    select recording_id, round(quantile_cont(cast(v as double), 0.5), 6) as linear_50,
      round(quantile_cont(cast(v as double), 0.9999), 6) as linear_9999,
      cast(max(v) filter (where rk = cast(floor(0.5 * (n - 1) + 0.5) as bigint) + 1) as double) as nearest_50,
      cast(max(v) filter (where rk = cast(floor(0.9999 * (n - 1) + 0.5) as bigint) + 1) as double) as nearest_9999
    from r group by 1""",
)
def score_percentiles(spark, sf):
    """With a coarse sketch, so that small groups are bracketed like large ones."""
    trace = series(spark, sf)
    linear = quantiles.exact_quantiles(
        trace, KEYS, F.col("score"), {"linear_50": 0.5, "linear_9999": 0.9999}
    )
    nearest = quantiles.exact_quantiles(
        trace, KEYS, F.col("score"), {"nearest_50": 0.5, "nearest_9999": 0.9999}, "nearest"
    )
    return rounded(linear, "linear_50", "linear_9999").join(nearest, KEYS)


@query(
    "global_quantiles",
    """select round(quantile_cont(l_extendedprice, 0.5), 6) as p50,
       round(quantile_cont(l_extendedprice, 0.9999), 6) as p9999 from lineitem""",
)
def global_quantiles(spark, sf):
    """With a coarse sketch, so that small tables are bracketed like large ones."""
    prices = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(
        quantiles.exact_quantiles(prices, [], F.col("l_extendedprice"), {"p50": 0.5, "p9999": 0.9999}),
        "p50", "p9999",
    )


@query("threshold_grid", f"with {EV}, {NMS}, {GRID} select recording_id, idx, round(threshold, 6) as threshold from grid")
def threshold_grid(spark, sf):
    return rounded(sweep.threshold_grid(found(spark, sf), KEYS), "threshold")


@query("threshold_sweep", f"with {EV}, {TRUTH}, {NMS}, {GRID}, {SWEEP} select {CURVE_COLUMNS} from curve")
def threshold_sweep(spark, sf):
    return rounded(curve(spark, sf), *RATES)


@query(
    "sweep_attribution",
    f"""with {EV}, {TRUTH}, {OTHERS}, {NMS}, {GRID}, {FP},
    near as (select distinct fp.recording_id, fp.sample, fp.score, o.unit_id from fp join others o
             on o.recording_id = fp.recording_id and abs(o.t - fp.sample) <= 2)
    select g.recording_id, g.idx, u.unit_id, count(n.sample) as fp from grid g
    join (select distinct recording_id, unit_id from others) u on u.recording_id = g.recording_id
    left join near n on n.recording_id = g.recording_id and n.unit_id = u.unit_id and n.score > g.threshold
    group by 1, 2, 3""",
)
def sweep_attribution(spark, sf):
    with_map = sweep.sweep(
        found(spark, sf), truth(spark, sf), KEYS, TOLERANCE, interferers=others(spark, sf), block=BLOCK
    )
    return with_map.select("recording_id", "idx", F.explode("fp_by_interferer").alias("unit_id", "fp"))


@query(
    "best_f1",
    f"""with {EV}, {TRUTH}, {NMS}, {GRID}, {SWEEP},
    pick as (select *, row_number() over (partition by recording_id order by f1 desc, idx) as rn from curve)
    select {CURVE_COLUMNS} from pick where rn = 1""",
)
def best_f1(spark, sf):
    return rounded(sweep.best_f1(curve(spark, sf), KEYS), *RATES)


@query(
    "best_recall_fp",
    f"""with {EV}, {TRUTH}, {NMS}, {GRID}, {SWEEP},
    pick as (select *, row_number() over (partition by recording_id order by
      case when fp_rate_hz <= 0.05 then 0 else 1 end,
      case when fp_rate_hz <= 0.05 then -recall else fp_rate_hz end, idx) as rn from curve)
    select {CURVE_COLUMNS} from pick where rn = 1""",
)
def best_recall_fp(spark, sf):
    return rounded(sweep.best_recall(curve(spark, sf), KEYS, 0.05), *RATES)


MASKED = """free as (select e.recording_id, e.v from ev e where not exists (select 1 from truth t
   where t.recording_id = e.recording_id and e.sample >= t.t - 4 and e.sample < t.t + 7))"""


@query(
    "mad_threshold",
    f"""with {EV}, {TRUTH}, {MASKED},
    med as (select recording_id, quantile_cont(cast(v as double), 0.5) as median from free group by 1),
    dev as (select f.recording_id, quantile_cont(abs(v - median), 0.5) as mad from free f join med using (recording_id) group by 1)
    select recording_id, median, mad, round(median + 5 * (mad * 1.4826), 6) as threshold
    from med join dev using (recording_id)""",
)
def mad_threshold(spark, sf):
    out = sweep.robust_threshold(series(spark, sf), KEYS, truth(spark, sf), template_length=5, template_offset=2)
    return rounded(out, "threshold")


@query(
    "method_comparison",
    f"""with {EV}, {TRUTH}, {NMS},
    hi as (select recording_id, sample, v as score,
        sample - row_number() over (partition by recording_id order by sample) as grp from ev where v > {HEIGHT}),
    det as (select 'windowed' as method, recording_id, sample from pk where score > {HEIGHT}
            union all select 'run' as method, recording_id, arg_min(sample, (-score, sample)) as sample
            from hi group by recording_id, grp),
    k as (select distinct method, recording_id from det),
    h as (select k.method, k.recording_id, count(*) as n_truth, count(*) filter (where exists (select 1 from det d
            where d.method = k.method and d.recording_id = k.recording_id and abs(d.sample - t.t) <= 2)) as hits
          from k join truth t using (recording_id) group by 1, 2),
    f as (select d.method, d.recording_id, count(*) as n_detections, count(*) filter (where not exists (select 1 from truth t
            where t.recording_id = d.recording_id and abs(d.sample - t.t) <= 2)) as total_fp from det d group by 1, 2)
    select method, recording_id, n_truth, hits, n_truth - hits as misses, n_detections, total_fp,
      round(hits / greatest(n_truth, 1)::double, 6) as recall,
      round(hits / greatest(hits + total_fp, 1)::double, 6) as precision
    from h join f using (method, recording_id)""",
)
def method_comparison(spark, sf):
    trace = series(spark, sf)
    windowed = peaks.window_peaks(trace, KEYS, REACH, threshold=float(HEIGHT), block=BLOCK)
    run = peaks.run_peaks(trace, KEYS, HEIGHT, block=BLOCK)
    both = windowed.select(F.lit("windowed").alias("method"), "recording_id", "sample").unionByName(
        run.select(F.lit("run").alias("method"), "recording_id", "sample")
    )
    both = cut_lineage(both)
    expected = both.select("method", "recording_id").distinct().join(truth(spark, sf), KEYS)
    out = sweep.evaluate(both, expected, ["method", *KEYS], TOLERANCE)
    return rounded(out.drop("f1"), "recall", "precision")


# The queries above match within 2 samples; half a window of five taps matches within 1.
SWEEP_NEAR = SWEEP.replace("<= 2", "<= 1")


@query(
    "calibration_existing",
    f"""with {EV}, {TRUTH}, {FIR}, {WIN}, pk as (select recording_id, sample, score from win
      where score > coalesce(l, -1e18) and score > coalesce(r, -1e18)), {GRID}, {SWEEP_NEAR},
    pick as (select *, row_number() over (partition by recording_id order by f1 desc, idx) as rn from curve)
    select recording_id, round(p.threshold, 6) as threshold, c.idx, c.hits, c.total_fp, c.n_detections, round(c.f1, 6) as f1
    from curve c join (select recording_id, threshold from pick where rn = 1) p using (recording_id)""",
)
def calibration_existing(spark, sf):
    """A known filter over whole recordings: the curve and, on every row, the chosen threshold."""
    filters = bank(spark, sf, SINGLE, [0], 2, 0.0)
    spikes = truth(spark, sf).join(filters.select(*KEYS, F.col("target_id").alias("unit_id")), KEYS)
    nobody = filters.select(*KEYS, "target_id", F.lit(-1).cast("bigint").alias("unit_id")).limit(0)
    done = plans.calibrate_existing(packed_single(spark, sf), 4 * CHUNK, filters, spikes, nobody, 100.0, 5)
    chosen = done.filters.select("recording_id", "threshold")
    out = done.curve.drop("threshold").join(chosen, KEYS)
    return rounded(out.select("recording_id", "threshold", "idx", "hits", "total_fp", "n_detections", "f1"), "threshold", "f1")
