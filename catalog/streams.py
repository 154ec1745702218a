"""Streaming queries: `availableNow` over files written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.digital import EDGES, FS, KTH, MERGED, ODW, ONSETS, WORD, spikes, syllables, words
from catalog.files import make_folder, write_raw
from catalog.registry import query
from catalog.signals import DETECT, FIR, HEIGHT, SINGLE, WIN, bank, packed_single, whole
from catalog.views import CHUNK, EV, KEYS, SPAN, events, read, series
from tracewell.functions.digital import extract_bit, extract_field
from tracewell.operators import signal as dense
from tracewell.operators.signal import CHUNK_SCHEMA, Cleaning
from tracewell.session import cut_lineage, scratch_path
from tracewell.sources.chunks import attach_halo, pack, unpack
from tracewell.sources.raw import register
from tracewell.streaming import chunks as st
from tracewell.streaming import processors, sinks, triggers

PLAIN = Cleaning(highpass=None, reference=False)


def in_order(df, time, batches: int = 3):
    """The rows in `batches` turns in time order."""
    staged = cut_lineage(df)
    span = (staged.agg(F.max(time)).first()[0] or 0) + 1
    return in_turns(staged.withColumn("_part", F.floor(F.col(time) * batches / span)), batches)


def in_turns(rows, turns: int):
    """Steps that append the staged rows of the turns `_part` = 0, 1, ... to a folder, and the folder.

    A turn is one batch of the stream that reads the folder, however many files its rows make.
    """
    folder = scratch_path(rows.sparkSession, "turns")
    rows.where("false").drop("_part").write.parquet(folder)

    def step(i):
        return lambda: rows.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(folder)

    return [step(i) for i in range(turns)], folder


def chunk_turns(spark, sf):
    return in_order(packed_single(spark, sf), "start_sample")


@query("stream_chunks", f"with {EV} select recording_id, sample, cast(0 as int) as channel, cast(v as double) as value from ev")
def stream_chunks(spark, sf):
    turns, folder = chunk_turns(spark, sf)
    return st.run_available(unpack(st.read_stream(spark, folder, CHUNK_SCHEMA)), turns=turns)


LIVE_DEF = f"""{FIR}, lim as (select recording_id, max(sample) as e from ev group by 1),
dv as (select d.* from d join lim using (recording_id) where sample >= 2 and sample <= e - 2),
winv as (select recording_id, sample, score,
    max(score) over (partition by recording_id order by sample range between 2 preceding and 1 preceding) as l,
    max(score) over (partition by recording_id order by sample range between 1 following and 2 following) as r from dv),
live as (select recording_id, sample, score from winv join lim using (recording_id)
where score > coalesce(l, -1e18) and score > coalesce(r, -1e18) and score > {HEIGHT} and sample + 2 <= e - 2)"""
LIVE = f"{LIVE_DEF} select recording_id, sample, score from live"


@query("stream_detect", f"with {EV}, {LIVE}")
def stream_detect(spark, sf):
    """State carried from chunk to chunk: filter registers, recent samples, last decision."""
    turns, folder = chunk_turns(spark, sf)
    stream = st.read_stream(spark, folder, CHUNK_SCHEMA)
    found = processors.detect_stream(stream, bank(spark, sf, SINGLE, [0], 2, HEIGHT), 5, PLAIN)
    return whole(st.run_available(found, turns=turns)).drop("target_id")


@query("stream_detect_overlap", f"with {EV}, {DETECT} select recording_id, sample, score from det")
def stream_detect_overlap(spark, sf):
    """Overlapping fetches: chunks arrive with their halo, the stream is a stateless map."""
    haloed = attach_halo(packed_single(spark, sf), 4 * CHUNK, 6, 6)
    turns, folder = in_order(haloed, "start_sample")
    stream = st.read_stream(spark, folder, CHUNK_SCHEMA + ", lead int, trail int")
    found = dense.detect(
        stream, 4 * CHUNK, bank(spark, sf, SINGLE, [0], 2, HEIGHT), 5, edge="zero", haloed=True
    )
    return whole(st.run_available(found, turns=turns)).drop("target_id")


def decoded(spark, sf):
    w = F.col("word")
    rows = words(spark, sf).select(
        "recording_id", "sample", extract_bit(w, 6).alias("bit"), extract_field(w, [5, 6, 7]).alias("code")
    )
    turns, folder = in_order(rows, "sample")
    stream = st.read_stream(spark, folder, "recording_id string, sample bigint, bit int, code int")
    return st.run_available(processors.decode_stream(stream, 2), turns=turns)


@query("stream_edges", f"with {WORD}, {EDGES} select recording_id, sample, edge_seq from edge")
def stream_edges(spark, sf):
    return decoded(spark, sf).where("kind = 'edge'").select("recording_id", "sample", "edge_seq")


@query(
    "stream_debounce",
    f"""with {WORD}, {EDGES}, {ONSETS} select o.recording_id, o.sample, o.code, e.sample as edge_sample, e.edge_seq
    from ons o asof join edge e on e.recording_id = o.recording_id and o.sample >= e.sample""",
)
def stream_debounce(spark, sf):
    return decoded(spark, sf).where("kind = 'onset' and edge_sample is not null").drop("kind")


def decision_rows(spark, sf):
    anchors = syllables(spark, sf).select("recording_id", F.lit("anchor").alias("kind"), "sample", F.lit(1).alias("code"))
    hits = spikes(spark, sf).select("recording_id", F.lit("event").alias("kind"), F.col("s").alias("sample"), F.lit(0).alias("code"))
    # Time keeps moving after the last event, which closes the last windows.
    end = events(spark, sf).groupBy("recording_id").agg((F.max("sample") + 1000).alias("sample")).select(
        "recording_id", F.lit("clock").alias("kind"), "sample", F.lit(0).alias("code")
    )
    return anchors.unionByName(hits).unionByName(end)


ROWS = "recording_id string, kind string, sample bigint, code int"


def decision_stream(spark, sf):
    turns, folder = in_order(decision_rows(spark, sf), "sample")
    stream = st.read_stream(spark, folder, ROWS)
    return processors.decided(processors.decide_stream(stream, 0, 12, 3, FS)), turns


@query(
    "stream_decisions",
    f"""with {EV}, {KTH} select recording_id, sample, cast(1 as int) as code, case when trigger_sample is null then 'NO_TRIGGER' else 'TRIGGER' end as outcome,
    least(n_events, 3) as n_events, trigger_sample from ct""",
)
def stream_decisions(spark, sf):
    decisions, turns = decision_stream(spark, sf)
    return st.run_available(decisions, turns=turns)


@query(
    "stream_triggers",
    f"""with {EV}, {KTH}, iv as (select recording_id, trigger_sample as lo, max(trigger_sample + 9) as hi from ct
      where trigger_sample is not null group by 1, 2), {MERGED} select recording_id, "start", "end" from mrg""",
)
def stream_triggers(spark, sf):
    folder, checkpoint = scratch_path(spark, "triggers"), scratch_path(spark, "offsets")
    decisions, turns = decision_stream(spark, sf)
    st.run_turns(lambda: triggers.write_triggers(decisions, folder, checkpoint, 9), turns)
    return triggers.output_line(spark, folder)


def once_failing(stream, folder, flag):
    """A batch writer that keeps each batch in its own folder and fails once, after writing."""

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        if flag:
            flag.pop()
            raise RuntimeError("planted")

    def run(checkpoint):
        started = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        try:
            started.start().awaitTermination()
        except Exception as error:
            if "planted" not in str(error):
                raise
            return run(checkpoint)

    return run


@query(
    "stream_source_offsets",
    f"with {EV} select recording_id, sample, cast(v % 20000 as double) as value from ev",
)
def stream_source_offsets(spark, sf):
    """Growing raw recordings: the first part, a failed batch, an empty poll, then the rest."""
    one = series(spark, sf).select(
        "recording_id", "sample", F.lit(0).alias("channel"), F.pmod("score", F.lit(20000)).alias("value")
    )
    raw, out, checkpoint = (scratch_path(spark, name) for name in ("raw", "out", "offsets"))
    make_folder(raw)
    chunks = cut_lineage(pack(one, 100))
    write_raw(chunks.where("chunk_id < 5"), raw)
    stream = (
        register(spark).readStream.format("interleaved16").option("n_channels", 1).option("chunk_samples", 100)
        .load(raw)
    )
    run = once_failing(stream, out, [True])
    run(checkpoint)
    run(checkpoint)
    write_raw(chunks.where("chunk_id >= 5"), raw)
    run(checkpoint)
    got = spark.read.parquet(out)
    return unpack(got).select("recording_id", "sample", "value")


def synced(spark, sf):
    """Chunk rows of the one-channel recording with the sync bit of each sample."""
    bits = words(spark, sf).select(
        "recording_id", F.floor(F.col("sample") / (4 * CHUNK)).alias("chunk_id"),
        F.struct("sample", extract_bit(F.col("word"), 6).alias("bit")).alias("at"),
    ).groupBy("recording_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["bit"]).alias("sync"))
    return packed_single(spark, sf).join(bits, ["recording_id", "chunk_id"])


def stamped_rows(spark, sf):
    turns, folder = in_order(synced(spark, sf), "start_sample")
    stream = st.read_stream(spark, folder, CHUNK_SCHEMA + ", sync array<int>")
    found = processors.detect_stream(stream, bank(spark, sf, SINGLE, [0], 2, HEIGHT), 5, PLAIN, sync=True)
    return st.run_available(found, turns=turns)


@query(
    "stream_spike_events",
    f"""with {WORD}, {EDGES}, {LIVE_DEF} select p.recording_id, p.sample, p.score, e.sample as edge_sample, e.edge_seq,
    round((p.sample - e.sample) / {FS}, 6) as time_rel_s from live p asof join edge e
    on e.recording_id = p.recording_id and p.sample >= e.sample""",
)
def stream_spike_events(spark, sf):
    """Detections of a live stream with the last edge of its sync bit; none before the first."""
    found = processors.usable_spikes(stamped_rows(spark, sf), FS)
    return whole(found).drop("target_id").withColumn("time_rel_s", F.round("time_rel_s", 6))


FS2 = 250.0
LO, HI, K = -40, 60, 2
# The second stream: order words, their edges and debounced codes, on a clock of their own.
ONSETS2 = """ow2 as (select recording_id, sample, b, (w >> 5) & 7 as code from (select 'rec' || (o_orderkey // SPAN) as recording_id,
  o_orderkey % SPAN as sample, cast(round(o_totalprice * 100) as bigint) as w, (cast(round(o_totalprice * 100) as bigint) >> 6) & 1 as b from orders)),
rr2 as (select recording_id, sample, code, sample - row_number() over (partition by recording_id, code order by sample) as g from ow2),
kept2 as (select recording_id, code, min(sample) as sample from rr2 group by recording_id, code, g having count(*) >= 2),
ons2 as (select recording_id, sample, cast(code as int) as code from (select *,
  lag(code, 1, 0) over (partition by recording_id order by sample) as last from kept2) where code <> last and code <> 0)""".replace("SPAN", str(SPAN))


def order_words(spark, sf):
    w = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return read(spark, sf, "orders").select(
        F.concat(F.lit("rec"), F.floor(F.col("o_orderkey") / SPAN)).alias("recording_id"),
        (F.col("o_orderkey") % SPAN).alias("sample"),
        F.getbit(w, F.lit(6)).cast("int").alias("bit"), F.shiftright(w, 5).bitwiseAND(F.lit(7)).cast("int").alias("code"),
    )


@query(
    "stream_live_decisions",
    f"""with {WORD}, {EDGES}, {LIVE_DEF}, {ODW}, {ONSETS2},
    stamped as (select p.recording_id, p.sample as s from live p asof join edge e on e.recording_id = p.recording_id and p.sample >= e.sample),
    placed as (select o.recording_id, o.code, e1.sample + cast(round((o.sample - e.sample) * 100.0::double / {FS2}::double) as bigint) as sample
      from ons2 o asof join oedge e on e.recording_id = o.recording_id and o.sample >= e.sample
      join edge e1 on e1.recording_id = o.recording_id and e1.edge_seq = e.edge_seq),
    an as (select distinct recording_id, sample, code from placed),
    pr as (select a.recording_id, a.sample, a.code, b.s, row_number() over (partition by a.recording_id, a.sample, a.code order by b.s) as rn
      from an a join stamped b on b.recording_id = a.recording_id and b.s - a.sample between {LO} and {HI})
    select a.recording_id, a.sample, a.code, case when max(p.s) filter (where p.rn = {K}) is null then 'NO_TRIGGER' else 'TRIGGER' end as outcome,
      least(count(p.s), {K}) as n_events, max(p.s) filter (where p.rn = {K}) as trigger_sample
    from an a left join pr p on p.recording_id = a.recording_id and p.sample = a.sample and p.code = a.code group by 1, 2, 3""",
)
def stream_live_decisions(spark, sf):
    """Two live streams at different rates: detect and stamp, debounce and stamp, decide on one clock.

    Each step is a query of its own with its own checkpoint; their tables are what travels.
    """
    stamped = stamped_rows(spark, sf)
    turns, folder = in_order(order_words(spark, sf), "sample")
    words2 = st.read_stream(spark, folder, "recording_id string, sample bigint, bit int, code int")
    decoded2 = st.run_available(processors.decode_stream(words2, 2), turns=turns)
    rows = processors.stamped_rows(stamped, 10).unionByName(processors.onset_rows(decoded2, FS2, FS))
    # both inputs' clocks go on after their last row, which closes the last windows
    end = rows.select("recording_id").distinct().select(
        "recording_id", F.lit("clock").alias("kind"), F.lit(None).cast("bigint").alias("sample"), F.lit(None).cast("int").alias("code"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("source"), F.lit(1 << 40).alias("clock"), F.lit(None).cast("bigint").alias("edge_seq"),
    )
    late = 100_000  # the two tables are read one after the other, so one clock runs ahead
    turn = F.when(F.col("source") == 0, 0).otherwise(1)
    joined = rows.withColumn("_part", turn).unionByName(end.withColumn("_part", F.lit(2)))
    turns, folder = in_turns(cut_lineage(joined), 3)
    stream = st.read_stream(spark, folder, processors.LIVE_ROWS)
    decisions = processors.decide_aligned_stream(stream, LO, HI, K, FS, late)
    return processors.decided(st.run_available(decisions, turns=turns))


LATENESS = 20
# Every seventh event comes one turn later than its place.
DELAYED = f"""rws as (select recording_id, sample, 1 as code, 0 as more from syl union all
    select recording_id, s, 0, case when (s + 3) % 7 = 0 then 1 else 0 end from spk),
fin as (select recording_id, max(sample) + 1000 as sample, 0 as code, 0 as more from ev group by 1),
span as (select max(sample) + 1 as n from (select sample from rws union all select sample from fin)),
trn as (select r.*, floor(sample * 3 / n) + more as turn from rws r, span
    union all select f.*, floor(sample * 3 / n) from fin f, span),
tm as (select recording_id, turn, max(max(sample)) over (partition by recording_id order by turn rows between unbounded preceding and 1 preceding) as newest
    from trn group by recording_id, turn)"""


def delayed_stream(spark, sf):
    rows = cut_lineage(decision_rows(spark, sf))
    span = (rows.agg(F.max("sample")).first()[0] or 0) + 1
    more = F.when((F.col("kind") == "event") & ((F.col("sample") + 3) % 7 == 0), 1).otherwise(0)
    turns, folder = in_turns(rows.withColumn("_part", F.floor(F.col("sample") * 3 / span) + more), 4)
    return processors.decide_stream(st.read_stream(spark, folder, ROWS), 0, 12, 3, FS, LATENESS), turns


@query(
    "stream_late_rows",
    f"""with {EV}, {KTH}, {DELAYED} select recording_id, sample, cast(code as int) as code from trn join tm using (recording_id, turn)
    where sample < newest - {LATENESS} and sample < (select min(f.sample) from fin f where f.recording_id = trn.recording_id)""",
)
def stream_late_rows(spark, sf):
    """The side table of rows that came later than allowed."""
    rows, turns = delayed_stream(spark, sf)
    return processors.late_rows(st.run_available(rows, turns=turns))


@query(
    "stream_spike_lines",
    f"with {EV}, {LIVE_DEF} select sample::varchar as value from live",
)
def stream_spike_lines(spark, sf):
    """Detections appended as lines by the streaming sink, read back through its manifests."""
    turns, chunks = chunk_turns(spark, sf)
    found = processors.detect_stream(st.read_stream(spark, chunks, CHUNK_SCHEMA), bank(spark, sf, SINGLE, [0], 2, HEIGHT), 5, PLAIN)
    folder, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "offsets")
    st.run_turns(lambda: sinks.start_lines(sinks.spike_lines(found), folder, checkpoint), turns)
    return sinks.read_lines(spark, folder)
