"""Scans and sinks: files are written from the driver tables by Spark, then read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.signals import PAIR, bank, packed
from catalog.views import CHANNELS, EV, KEYS, MULTI, OTHERS, SPAN, events, others, read, signal
from catalog.detection import CURVE_COLUMNS, GRID, NMS, RATES, SWEEP, TRUTH, curve, nms_window, rounded
from catalog.digital import KTH, ONSETS, WORD, onsets, window_counts
from tracewell.operators.signal import blocks_of
from tracewell.session import scratch_path
from tracewell.sources import chunks as ch
from tracewell.sources import filters as fl
from tracewell.sources import metadata as md
from tracewell.sources import sinks
from tracewell.sources.files import resolve
from tracewell.sources.raw import layouts, register


def make_folder(folder):
    system, inner = resolve(folder)
    system.create_dir(inner, recursive=True)


#: chunks of a recording that one part may hold
PART_CHUNKS = 64


def write_raw(chunks, folder):
    """Chunk rows as raw int16 parts `<recording>/part-<start>.bin`, written by the tasks.

    Chunks that follow each other are one part, up to PART_CHUNKS of them; a missing one begins a new part.
    """
    stretch = F.floor(F.col("chunk_id") / PART_CHUNKS)
    dealt = chunks.repartition("recording_id", stretch).sortWithinPartitions("recording_id", "start_sample")

    def write(batches):
        system, inner = resolve(folder)
        out, follows = None, None
        try:
            for block in (block for batch in batches for block in blocks_of(batch)):
                if (block.recording_id, block.chunk_id // PART_CHUNKS, block.start) != follows:
                    if out is not None:
                        out.close()
                    system.create_dir(f"{inner}/{block.recording_id}", recursive=True)
                    out = system.open_output_stream(f"{inner}/{block.recording_id}/part-{block.start}.bin")
                out.write(block.x.astype("<i2").tobytes())
                follows = block.recording_id, block.chunk_id // PART_CHUNKS, block.start + block.n
        finally:
            if out is not None:
                out.close()
        yield from ()

    dealt.mapInArrow(write, "done int").count()


def write_npy(values, path):
    """One npy file from a single-column frame, written by one task (the format is one file)."""

    def write(batches):
        data = np.concatenate([b.column(0).to_numpy() for b in batches])
        system, inner = resolve(path)
        with system.open_output_stream(inner) as out:
            np.lib.format.write_array(out, data)
        yield from ()

    values.coalesce(1).mapInArrow(write, "done int").count()


def scan(spark, folder, **options):
    reader = register(spark).read.format("interleaved16").option("n_channels", CHANNELS)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


@query(
    "raw_scan",
    f"""with {MULTI} select recording_id, sample, channel, cast(value % 30000 as double) as value from m
    where channel in (1, 3, 6)""",
)
def raw_scan(spark, sf):
    folder = scratch_path(spark, "raw")
    small = signal(spark, sf).withColumn("value", F.col("value") % 30000)
    write_raw(ch.pack(small, 100), folder)
    return ch.unpack(scan(spark, folder, chunk_samples=64, columns="1,3,6", chunks_per_task=3))


@query(
    "raw_scan_halo",
    f"""with {MULTI}, e as (select recording_id, max(sample) + 1 as e from m group by 1),
    c as (select distinct recording_id, sample // 64 as chunk_id from m)
    select recording_id, chunk_id, cast(least(20, chunk_id * 64) as int) as lead,
      cast(least(10, greatest(e - (chunk_id + 1) * 64, 0)) as int) as trail,
      (select cast(sum(value % 30000) as bigint) from m where m.recording_id = c.recording_id and m.sample >= chunk_id * 64 - 20
        and m.sample < (chunk_id + 1) * 64 + 10) as total
    from c join e using (recording_id)""",
)
def raw_scan_halo(spark, sf):
    """Overlapping byte ranges: every chunk arrives with its halo, nothing is shuffled."""
    folder = scratch_path(spark, "raw")
    small = signal(spark, sf).withColumn("value", F.col("value") % 30000)
    write_raw(ch.pack(small, 100), folder)
    rows = scan(spark, folder, chunk_samples=64, halo_before=20, halo_after=10)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v).cast("bigint")
    return rows.select("recording_id", "chunk_id", "lead", "trail", total.alias("total"))


@query(
    "raw_range_scan",
    f"""with {MULTI} select recording_id, sample, channel, cast(value % 30000 as double) as value from m
    where recording_id in ('rec0', 'rec2') and sample >= 128 and sample < 448""",
)
def raw_range_scan(spark, sf):
    """Only the byte ranges of the wanted recordings and samples become tasks."""
    folder = scratch_path(spark, "raw")
    write_raw(ch.pack(signal(spark, sf).withColumn("value", F.col("value") % 30000), 100), folder)
    return ch.unpack(scan(spark, folder, chunk_samples=64, recordings="rec0,rec2", from_sample=128, to_sample=448))


@query(
    "raw_layouts",
    f"""with {MULTI} select recording_id, sample, channel, cast(value % 30000 as double) as value from m
    where (recording_id = 'rec0' and channel in (0, 2)) or (recording_id <> 'rec0' and channel <> 5)""",
)
def raw_layouts(spark, sf):
    """Recordings with different numbers of stored channels in one folder, each with its keep mask."""
    folder = scratch_path(spark, "raw")
    small = signal(spark, sf).withColumn("value", F.col("value") % 30000)
    write_raw(ch.pack(small.where("recording_id != 'rec0' or channel < 3"), 100), folder)
    first = F.col("recording_id") == "rec0"
    table = small.select("recording_id").distinct().select(
        "recording_id", F.when(first, 3).otherwise(CHANNELS).alias("n_channels"),
        F.when(first, F.array(F.lit(0), F.lit(2))).otherwise(F.array(*(F.lit(c) for c in range(CHANNELS) if c != 5))).alias("columns"),
    )
    reader = register(spark).read.format("interleaved16").option("layout", layouts(table)).option("chunk_samples", 64)
    return ch.unpack(reader.load(folder))


CUST = """c as (select 'c' || c_custkey as recording_id, c_custkey as k, c_nationkey as n, c_name, c_mktsegment as s from customer)"""


def metadata_texts(spark, sf):
    """A metadata document per customer, with comments, repeats and embedded separators."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("imSampRate="), (F.lit(29000) + n).cast("string")),
        F.lit(""),
        F.lit("a line without separator"),
        F.concat(F.lit("nSavedChans="), n + 3),
        F.concat(F.lit("~snsSaveChanSubset="), F.lit("0:"), n, F.lit(", "), n + 5, F.lit(","), n + 7, F.lit(":"), n + 8),
        F.concat(F.lit("snsApLfSy="), n, F.lit(",0,"), k % 3),
        F.concat(F.lit("note=a=b="), F.col("c_mktsegment")),
        F.concat(F.lit("twice="), F.lit("old")),
        F.concat(F.lit("~twice="), F.col("c_name")),
    )
    return read(spark, sf, "customer").select(
        F.concat(F.lit("c"), k).alias("recording_id"), lines.alias("text")
    )


@query(
    "metadata_scan",
    f"""with {CUST}
    select recording_id, 'imSampRate' as key, cast(29000 + n as varchar) as value from c
    union all select recording_id, 'nSavedChans', cast(n + 3 as varchar) from c
    union all select recording_id, 'snsSaveChanSubset', '0:' || n || ', ' || (n + 5) || ',' || (n + 7) || ':' || (n + 8) from c
    union all select recording_id, 'snsApLfSy', n || ',0,' || (k % 3) from c
    union all select recording_id, 'note', 'a=b=' || s from c
    union all select recording_id, 'twice', c_name from c""",
)
def metadata_scan(spark, sf):
    return md.key_values(metadata_texts(spark, sf))


SAVED = """saved as (
  select recording_id, n, k, i as position, case when i <= n then i when i = n + 1 then n + 5 else i + 5 end as channel
  from (select *, unnest(range(n + 4)) as i from c))"""


@query(
    "channel_spec",
    f"with {CUST}, {SAVED} select recording_id, cast(position as int) as position, cast(channel as int) as channel from saved",
)
def channel_spec(spark, sf):
    recs = md.recordings(md.key_values(metadata_texts(spark, sf)))
    return recs.select("recording_id", F.posexplode("saved_channels").alias("position", "channel"))


@query(
    "recording_metadata",
    f"""with {CUST} select recording_id, cast(29000 + n as double) as fs, cast(n + 3 as int) as n_saved,
    cast(n + 4 as int) as n_channels, cast(k % 3 as int) as n_sync from c""",
)
def recording_metadata(spark, sf):
    recs = md.recordings(md.key_values(metadata_texts(spark, sf)))
    return recs.select("recording_id", "fs", "n_saved", F.size("saved_channels").alias("n_channels"), "n_sync")


@query(
    "keep_mask",
    f"""with {CUST}, {SAVED} select recording_id, cast(channel as int) as channel, cast(position as int) as position from saved
    where position < n + 4 - k % 3 and channel % 2 = k % 2 and channel not in (3, 8)""",
)
def keep_mask(spark, sf):
    """Not sync, in the channel map, not bad."""
    recs = md.recordings(md.key_values(metadata_texts(spark, sf)))
    listed = recs.select("recording_id", F.explode("saved_channels").alias("channel"))
    parity = F.regexp_extract("recording_id", r"\d+", 0).cast("bigint") % 2
    mapped = listed.where(F.col("channel") % 2 == parity)
    bad = listed.where(F.col("channel").isin(3, 8))
    return md.keep_channels(recs, mapped, bad)


@query(
    "channel_map_json",
    """with p as (select *, p_partkey as k from part)
    select 'p' || k as recording_id, cast(0 as int) as position, cast(k % 384 as int) as channel,
      case when k % 2 = 0 then cast(k % 48 as double) + 0.5::double end as x, case when k % 2 = 0 then 20.0::double end as y from p
    union all select 'p' || k, 1, cast(k % 384 + 1 as int), case when k % 2 = 0 then -1.0::double end,
      case when k % 2 = 0 then cast(p_size as double) end from p""",
)
def channel_map_json(spark, sf):
    k = F.col("p_partkey")
    head = F.concat(F.lit('{"chanMap": ['), k % 384, F.lit(", "), k % 384 + 1, F.lit("]"))
    places = F.concat(
        F.lit(', "xc": ['), k % 48, F.lit('.5, -1.0], "yc": [20.0, '), F.col("p_size"), F.lit("]")
    )
    text = F.concat(head, F.when(k % 2 == 0, places).otherwise(F.lit("")), F.lit("}"))
    documents = read(spark, sf, "part").select(F.concat(F.lit("p"), k).alias("recording_id"), text.alias("text"))
    return md.channel_map(documents)


@query(
    "geometry_pivot",
    """select 's' || s_nationkey as recording_id, cast(s_suppkey as int) as channel, cast(s_suppkey % 4 as int) as shank,
    cast(s_suppkey % 4 * 250 as double) as x, cast(s_suppkey * 15 as double) as z, s_suppkey % 7 <> 0 as used from supplier""",
)
def geometry_pivot(spark, sf):
    k = F.col("s_suppkey")
    prefix = F.concat(F.lit("ch"), k)
    cells = [
        (F.concat(prefix, F.lit("_s")), k % 4),
        (F.concat(prefix, F.lit("_x")), k % 4 * 250),
        (F.concat(prefix, F.lit("_z")), k * 15),
        (F.concat(prefix, F.lit("_u")), (k % 7 != 0).cast("int")),
        (F.lit("head_numShanks"), F.lit(4)),
    ]
    fields = F.array(*[F.struct(n.alias("key"), v.cast("string").alias("value")) for n, v in cells])
    kv = read(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_nationkey")).alias("recording_id"), F.explode(fields).alias("f")
    ).select("recording_id", "f.key", "f.value")
    return md.geometry(kv)


@query(
    "shank_map",
    """with o as (select o_orderkey as k, unnest(range(o_custkey % 4)) as i, o_custkey from orders)
    select k as o_orderkey, cast(i as int) as channel, cast(i % 2 as int) as shank, cast(o_custkey % 10 as int) as col,
      cast(k % 50 as int) as "row", i <> 1 as used from o""",
)
def shank_map(spark, sf):
    orders = read(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entries = F.transform(
        F.when(c % 4 > 0, F.sequence(F.lit(0).cast("bigint"), c % 4 - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.concat(F.lit("("), i % 2, F.lit(","), c % 10, F.lit(", "), k % 50, F.lit(","), F.when(i != 1, "1").otherwise("0"), F.lit(")")),
    )
    text = F.when(F.size(entries) > 0, F.concat_ws("", entries)).otherwise(F.lit("()"))
    return md.shank_map(orders.select("o_orderkey", text.alias("text")), "text", ["o_orderkey"])


@query(
    "tuple_list",
    """with o as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_suppkey from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(0 as int) as position, cast(l_partkey as varchar) as id,
      cast(l_linenumber as varchar) as n_shanks, 'NP' || l_returnflag as part_number from o where l_linenumber <> 3
    union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, '7', '4', 'NP2' from o where l_linenumber <> 3""",
)
def tuple_list(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = read(spark, sf, "lineitem")
    text = F.concat(
        F.lit("("), F.col("l_partkey"), F.lit(","), F.col("l_linenumber"), F.lit(",NP"), F.col("l_returnflag"), F.lit(")(7,4,NP2)")
    )
    text = F.when(F.col("l_linenumber") == 3, F.lit("()")).otherwise(text)
    return md.tuples(rows.select(*keys, text.alias("t")), "t", ["id", "n_shanks", "part_number"], keys)


@query(
    "stream_layout",
    """select o_orderkey, cast(o_orderkey % 384 + o_custkey % 2 * 384 as int) as sync_index,
    cast(o_orderkey % 8 + o_custkey % 8 + 2 as int) as word_index from orders""",
)
def stream_layout(spark, sf):
    """Probe streams: AP + LF; auxiliary streams: MN + MA + XA."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    probe = F.array(k % 384, c % 2 * 384, F.lit(1)).cast("array<int>")
    auxiliary = F.array(k % 8, c % 8, F.lit(2), F.lit(1)).cast("array<int>")
    return read(spark, sf, "orders").select(
        "o_orderkey", md.digital_index(probe).alias("sync_index"), md.digital_index(auxiliary).alias("word_index")
    )


def stream_rows(spark, sf):
    k = F.col("p_partkey")
    pairs = {
        "js": k % 3, "ip": k % 5, "sampRate": F.lit(30000) + k % 7, "nSamples": k * 1000, "maxInt": F.lit(512),
        "vMin": F.lit("-0.6"), "vMax": F.lit("0.6"), "gain": F.lit(80), "fileStart": k * 3, "serial": F.col("p_brand"),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in pairs.items()])
    kv = read(spark, sf, "part").select(F.concat(F.lit("p"), k).alias("recording_id"), F.explode(cells).alias("c"))
    return md.streams(kv.select("recording_id", "c.key", "c.value"))


@query(
    "stream_attributes",
    """select 'p' || p_partkey as recording_id, cast(p_partkey % 3 as int) as js, cast(p_partkey % 5 as int) as ip,
    cast(30000 + p_partkey % 7 as double) as fs, p_partkey * 1000 as n_samples, cast(512 as int) as max_int,
    -0.6::double as v_min, 0.6::double as v_max, 80.0::double as gain, p_partkey * 3 as file_start, p_brand as serial,
    round(0.6::double / 512 / 80 * 1e6::double, 6) as microvolts_per_count from part""",
)
def stream_attributes(spark, sf):
    return stream_rows(spark, sf).withColumn(
        "microvolts_per_count", F.round(F.col("volts_per_count") * 1e6, 6)
    ).drop("volts_per_count")


@query(
    "substream_counts",
    "select cast(p_partkey % 3 as int) as js, count(distinct p_partkey % 5) as n_substreams from part group by 1",
)
def substream_counts(spark, sf):
    return md.substreams(stream_rows(spark, sf))


@query(
    "spike_table_npy",
    """select 'events' as recording_id, event_id * 7 - 500 as spike_time, user_id % 10 as unit_id
    from events where event_id * 7 - 500 >= 0""",
)
def spike_table_npy(spark, sf):
    folder = scratch_path(spark, "spikes")
    make_folder(folder)
    ev = read(spark, sf, "events").select("event_id", "user_id").orderBy("event_id")
    write_npy(ev.select((F.col("event_id") * 7 - 500).alias("t")), f"{folder}/spike_times.npy")
    write_npy(ev.select((F.col("user_id") % 10).cast("int").alias("u")), f"{folder}/spike_clusters.npy")
    return md.read_spikes(spark, folder, "events")


@query(
    "unit_labels_tsv",
    """select c_custkey as unit_id, lower(c_mktsegment) as label from customer where lower(c_mktsegment) <> 'machinery'""",
)
def unit_labels_tsv(spark, sf):
    folder = scratch_path(spark, "labels")
    read(spark, sf, "customer").select(
        F.col("c_custkey").alias("cluster_id"), F.lower("c_mktsegment").alias("group")
    ).write.csv(f"{folder}/cluster_group.tsv", sep="\t", header=True)
    return md.read_labels(spark, folder).where("label <> 'machinery'")


@query(
    "bad_channel_list",
    """select s_suppkey as channel, s_name from supplier where s_suppkey % 6 <> 1""",
)
def bad_channel_list(spark, sf):
    path = scratch_path(spark, "bad")
    suppliers = read(spark, sf, "supplier")
    suppliers.where("s_suppkey % 6 = 1").select(F.col("s_suppkey").cast("string").alias("value")).write.text(path)
    bad = md.read_bad_channels(spark, path)
    return suppliers.select(F.col("s_suppkey").alias("channel"), "s_name").join(bad, "channel", "left_anti")


UNIT_FILTERS = """u as (select user_id as target_id, count(*) as n, sum(cast(round(value * 100) as bigint)) as v from events group by 1)"""


def unit_filters(spark, sf):
    per_user = read(spark, sf, "events").groupBy(F.col("user_id").alias("target_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v")
    )
    return per_user.select(
        F.lit("r").alias("recording_id"),
        "target_id",
        F.array((F.col("n") % 8).cast("int"), F.lit(9)).alias("channels"),
        F.array(F.col("n").cast("double"), F.lit(0.5), F.col("v").cast("double"), F.lit(-2.0)).alias("taps"),
        F.lit(1).alias("left_margin"),
        (F.col("v") / 4).alias("threshold"),
    )


@query(
    "filter_bank",
    f"""with {UNIT_FILTERS} select target_id, cast(n % 8 as int) as channel_0, cast(n as double) as tap_0,
    cast(v as double) as tap_2, v / 4 as threshold from u""",
)
def filter_bank(spark, sf):
    path = scratch_path(spark, "filters")
    fl.write_filters(unit_filters(spark, sf), path)
    return fl.read_filters(spark, path).select(
        "target_id", F.col("channels")[0].alias("channel_0"), F.col("taps")[0].alias("tap_0"),
        F.col("taps")[2].alias("tap_2"), "threshold",
    )


@query(
    "filter_import",
    f"""with {UNIT_FILTERS} select target_id, cast(n % 8 as int) as channel_0, cast(n as double) as tap_0,
    cast(v as double) as tap_2, v / 4 as threshold from u""",
)
def filter_import(spark, sf):
    """The three binary files per target, decoded and validated."""
    folder = scratch_path(spark, "legacy")
    make_folder(folder)

    def write(batches):
        system, inner = resolve(folder)
        for batch in batches:
            for row in batch.to_pylist():
                for name, kind, value in (
                    ("channels", "<i4", row["channels"]),
                    ("filter", "<f8", row["taps"]),
                    ("threshold", "<f8", [row["threshold"]]),
                ):
                    with system.open_output_stream(f"{inner}/{name}_{row['target_id']}.bin") as out:
                        out.write(np.array(value, dtype=kind).tobytes())
        yield from ()

    unit_filters(spark, sf).mapInArrow(write, "done int").count()
    return fl.import_legacy(spark, folder, 2).select(
        "target_id", F.col("channels")[0].alias("channel_0"), F.col("taps")[0].alias("tap_0"),
        F.col("taps")[2].alias("tap_2"), "threshold",
    )


@query(
    "threshold_update",
    f"""with {UNIT_FILTERS} select target_id, cast(v as double) as tap_2,
    case when target_id % 5 = 2 then n + 0.25::double else v / 4 end as threshold from u""",
)
def threshold_update(spark, sf):
    path = scratch_path(spark, "filters")
    filters = unit_filters(spark, sf)
    fl.write_filters(filters, path)
    new = filters.where("target_id % 5 = 2").select(
        "recording_id", "target_id", (F.col("taps")[0] + 0.25).alias("threshold")
    )
    fl.update_thresholds(spark, path, new)
    return fl.read_filters(spark, path).select("target_id", F.col("taps")[2].alias("tap_2"), "threshold")


@query("spike_sink", f"with {EV}, {NMS} select cast(sample as varchar) as value from pk")
def spike_sink(spark, sf):
    path = scratch_path(spark, "spikes")
    found = nms_window(spark, sf)
    sinks.append_spike_lines(found, path)
    return spark.read.text(path)


@query("code_sink", f"with {WORD}, {ONSETS} select code || ',' || sample as value from ons")
def code_sink(spark, sf):
    path = scratch_path(spark, "codes")
    sinks.append_code_lines(onsets(spark, sf), path)
    return spark.read.text(path)


@query(
    "decision_sink",
    f"""with {EV}, {KTH} select case when trigger_sample is null
      then 'NO_TRIGGER syllable_code=1 syllable_t=' || sample || ' final_count=' || n_events
      else 'TRIGGER syllable_code=1 syllable_t=' || sample || ' count=3 triggering_spike_t=' || trigger_sample end as value
    from ct""",
)
def decision_sink(spark, sf):
    from catalog.digital import trigger_decisions

    path = scratch_path(spark, "decisions")
    made = trigger_decisions(spark, sf).select(
        "*", F.lit(1).alias("code"), F.col("sample").alias("syllable_t"), F.col("trigger_sample").alias("trigger_t")
    )
    sinks.append_decision_lines(made, path)
    return spark.read.text(path)


@query(
    "curve_sink",
    f"""with {EV}, {TRUTH}, {NMS}, {GRID}, {SWEEP}, c as (select {CURVE_COLUMNS} from curve)
    select recording_id, threshold, hits, misses, total_fp, recall, precision, f1, fp_rate_hz from c""",
)
def curve_sink(spark, sf):
    path = scratch_path(spark, "curve")
    sinks.write_curve_csv(rounded(curve(spark, sf), *RATES), path, KEYS)
    return spark.read.csv(
        path, header=True, enforceSchema=False,
        schema="recording_id string, threshold double, hits bigint, misses bigint, total_fp bigint, "
        "recall double, precision double, f1 double, fp_rate_hz double",
    )
