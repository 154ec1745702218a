"""Digital words, sync edges, codes and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import BLOCK, EV, KEYS, SPAN, TRUTH, events, lengths, read, series, truth
from tracewell.functions.digital import extract_bit, extract_field
from tracewell.operators import edges, intervals, windows

FS = 100.0
WORD = f"{EV}, dw as (select recording_id, sample, cast(v as int) as word, (v >> 6) & 1 as b, (v >> 5) & 7 as code from ev)"
EDGES = """eb as (select *, lag(b) over (partition by recording_id order by sample) as pb from dw),
edge as (select recording_id, sample, row_number() over (partition by recording_id order by sample) as edge_seq
         from eb where pb = 0 and b <> 0)"""
SYL = "syl as (select recording_id, sample from ev where event_type = 'signup')"
SPK = "spk as (select recording_id, sample as s from ev where event_type = 'click')"
ONSETS = """rr as (select recording_id, sample, code, sample - row_number() over (partition by recording_id, code order by sample) as g from dw),
kept as (select recording_id, code, min(sample) as sample from rr group by recording_id, code, g having count(*) >= 2),
ons as (select recording_id, sample, cast(code as int) as code from (select *,
  lag(code, 1, 0) over (partition by recording_id order by sample) as last from kept) where code <> last and code <> 0)"""
# The second stream: orders, one word per order key, same recordings.
ODW = f"""ow as (select 'rec' || (o_orderkey // {SPAN}) as recording_id, o_orderkey % {SPAN} as sample,
  (cast(round(o_totalprice * 100) as bigint) >> 6) & 1 as b from orders),
oe as (select *, lag(b) over (partition by recording_id order by sample) as pb from ow),
oedge as (select recording_id, sample, row_number() over (partition by recording_id order by sample) as edge_seq
          from oe where pb = 0 and b <> 0)"""


def words(spark, sf):
    return events(spark, sf).select("recording_id", "sample", F.col("v").cast("int").alias("word"))


def sync_edges(spark, sf):
    return edges.rising_edges(words(spark, sf), KEYS, extract_bit(F.col("word"), 6), block=BLOCK)


def order_edges(spark, sf):
    stream = read(spark, sf, "orders").select(
        F.concat(F.lit("rec"), F.floor(F.col("o_orderkey") / SPAN)).alias("recording_id"),
        (F.col("o_orderkey") % SPAN).alias("sample"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("word"),
    )
    return edges.rising_edges(stream, KEYS, F.getbit("word", F.lit(6)), block=BLOCK)


def onsets(spark, sf):
    return edges.code_onsets(words(spark, sf), KEYS, extract_field(F.col("word"), [5, 6, 7]), 2, block=BLOCK)


def syllables(spark, sf):
    return events(spark, sf).where("event_type = 'signup'").select("recording_id", "sample")


def spikes(spark, sf):
    return events(spark, sf).where("event_type = 'click'").select("recording_id", F.col("sample").alias("s"))


@query(
    "bit_field",
    f"""with {EV} select recording_id, sample, cast((v >> 6) & 1 as int) as sync_bit, cast((v >> 5) & 7 as int) as code,
    cast((((v * 3 + 32768) % 65536) >> 15) & 1 as int) as high_bit from ev""",
)
def bit_field(spark, sf):
    w = F.col("word")
    # A word that overflows the signed range must still read as unsigned.
    wrapped = ((w * 3 + 32768) % 65536 - 65536).cast("int")
    return words(spark, sf).select(
        "recording_id",
        "sample",
        extract_bit(w, 6).alias("sync_bit"),
        extract_field(w, [5, 6, 7]).alias("code"),
        extract_bit(wrapped, 15).alias("high_bit"),
    )


@query("rising_edges", f"with {WORD}, {EDGES} select recording_id, sample, edge_seq from edge")
def rising_edges(spark, sf):
    return sync_edges(spark, sf)


@query(
    "edge_asof",
    f"""with {WORD}, {EDGES}, {SPK} select p.recording_id, p.s, e.sample as edge_sample, e.edge_seq,
    round((p.s - e.sample) / {FS}, 6) as time_rel_s from spk p asof left join edge e
    on e.recording_id = p.recording_id and p.s >= e.sample""",
)
def edge_asof(spark, sf):
    out = edges.last_edge(spikes(spark, sf), sync_edges(spark, sf), KEYS, "s", FS, block=BLOCK)
    return out.withColumn("time_rel_s", F.round("time_rel_s", 6))


@query("debounce_onsets", f"with {WORD}, {ONSETS} select recording_id, sample, code from ons")
def debounce_onsets(spark, sf):
    return onsets(spark, sf)


@query(
    "usable_onsets",
    f"""with {WORD}, {EDGES}, {ONSETS} select o.recording_id, o.sample, o.code, e.sample as edge_sample, e.edge_seq,
    round((o.sample - e.sample) / {FS}, 6) as time_rel_s from ons o asof join edge e
    on e.recording_id = o.recording_id and o.sample >= e.sample""",
)
def usable_onsets(spark, sf):
    out = edges.usable_onsets(onsets(spark, sf), sync_edges(spark, sf), KEYS, FS, 2, block=BLOCK)
    return out.withColumn("time_rel_s", F.round("time_rel_s", 6))


@query(
    "onsets_at_confirmation",
    f"""with {WORD}, {EDGES}, {ONSETS}, oc as (select *, sample + 1 as c from ons)
    select o.recording_id, o.sample, o.code, e.sample as edge_sample, e.edge_seq,
    round((o.sample - e.sample) / {FS}, 6) as time_rel_s from oc o asof join edge e
    on e.recording_id = o.recording_id and o.c >= e.sample""",
)
def onsets_at_confirmation(spark, sf):
    out = edges.usable_onsets(
        onsets(spark, sf), sync_edges(spark, sf), KEYS, FS, 2, seen_at="confirmation", block=BLOCK
    )
    return out.withColumn("time_rel_s", F.round("time_rel_s", 6))


@query(
    "sample_mapping",
    f"""with {WORD}, {EDGES}, {ODW}, {SPK} select p.recording_id, p.s, e.sample as edge_sample, e.edge_seq,
    o.sample + cast(round((p.s - e.sample) * 250.0::double / 100.0::double) as bigint) as mapped_sample
    from spk p asof join edge e on e.recording_id = p.recording_id and p.s >= e.sample
    join oedge o on o.recording_id = p.recording_id and o.edge_seq = e.edge_seq""",
)
def sample_mapping(spark, sf):
    return edges.map_samples(
        spikes(spark, sf), sync_edges(spark, sf), order_edges(spark, sf), KEYS, 100.0, 250.0, "s", BLOCK
    )


@query(
    "chunk_toggle",
    f"""with {EV}, d as (select recording_id, sample // 20 as chunk_id, arg_max(v, sample) - arg_min(v, sample) as delta,
      count(*) as n from ev group by 1, 2),
    x as (select *, cast(case when delta > 3000 then 1 when delta < -3000 then 0 end as int) as level from d where n >= 2),
    y as (select *, lag(level, 1, 0) over (partition by recording_id order by chunk_id) as held from x where level is not null)
    select recording_id, chunk_id, delta, level from y where level <> held""",
)
def chunk_toggle(spark, sf):
    return edges.level_toggles(series(spark, sf), KEYS, 20, 3000, value="score", block=BLOCK)


@query(
    "window_pairs",
    f"""with {EV}, {SYL}, {SPK} select a.recording_id, a.sample, b.s from syl a join spk b
    on b.recording_id = a.recording_id and b.s - a.sample between 2 and 50""",
)
def window_pairs(spark, sf):
    return windows.interval_join(syllables(spark, sf), spikes(spark, sf), KEYS, "sample", "s", 2, 50)


KTH = f"""{SYL}, {SPK}, pr as (select a.recording_id, a.sample, b.s,
    row_number() over (partition by a.recording_id, a.sample order by b.s) as rn
  from syl a join spk b on b.recording_id = a.recording_id and b.s - a.sample between 0 and 12),
ct as (select a.recording_id, a.sample, count(p.s) as n_events, max(p.s) filter (where p.rn = 3) as trigger_sample
  from syl a left join pr p on p.recording_id = a.recording_id and p.sample = a.sample group by 1, 2)"""


@query("window_counts", f"with {EV}, {KTH} select recording_id, sample, n_events, trigger_sample from ct")
def window_counts(spark, sf):
    return windows.window_counts(syllables(spark, sf), spikes(spark, sf), KEYS, "sample", "s", 0, 12, 3, BLOCK)


@query(
    "trigger_decisions",
    f"""with {EV}, {KTH} select recording_id, sample, least(n_events, 3) as n_events, trigger_sample,
    case when trigger_sample is null then 'NO_TRIGGER' else 'TRIGGER' end as outcome from ct""",
)
def trigger_decisions(spark, sf):
    return windows.decisions(syllables(spark, sf), spikes(spark, sf), KEYS, "sample", "s", 0, 12, 3, BLOCK)


MERGED = """mx as (select *, max(hi) over (partition by recording_id order by lo rows between unbounded preceding and 1 preceding) as pm from iv),
isl as (select *, sum(case when pm is null or lo > pm then 1 else 0 end) over (partition by recording_id order by lo) as g from mx),
mrg as (select recording_id, min(lo) as "start", max(hi) as "end" from isl group by recording_id, g)"""


@query(
    "pulse_intervals",
    f"""with {EV}, {KTH}, iv as (select recording_id, trigger_sample as lo, max(trigger_sample + 9) as hi from ct
      where trigger_sample is not null group by 1, 2), {MERGED}
    select recording_id, "start", "end" from mrg""",
)
def pulse_intervals(spark, sf):
    fired = window_counts(spark, sf).where("trigger_sample is not null")
    return intervals.pulse_intervals(fired, KEYS, "trigger_sample", 9, BLOCK)


@query(
    "free_segments",
    f"""with {EV}, {TRUTH}, n as (select recording_id, max(sample) + 1 as n from ev group by 1),
    iv as (select recording_id, greatest(t - 2, 0) as lo, max(least(t + 5 - 1 + 2, n)) as hi from truth join n using (recording_id) group by 1, 2),
    {MERGED},
    g as (select recording_id, coalesce(lag("end") over w, 0) as "start", "start" as "end" from mrg
          window w as (partition by recording_id order by "start")
          union all select recording_id, max("end"), max(n) from mrg join n using (recording_id) group by 1)
    select recording_id, "start", "end", "end" - "start" as length from g where "end" - "start" >= 10""",
)
def free_segments(spark, sf):
    """Template length 5, offset 2: masked [t - 2, t + 6), gaps of at least two templates."""
    return intervals.free_segments(
        truth(spark, sf), KEYS, "spike_time", 2, 6, lengths(spark, sf), 10, BLOCK
    )
