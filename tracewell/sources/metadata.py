"""Recording metadata, channel lists, geometry and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.files import exists


def key_values(texts: DataFrame, text: str = "text") -> DataFrame:
    """(recording_id, text) -> (recording_id, key, value) from `key=value` lines.

    The first `=` splits, leading `~` are dropped from keys, lines without `=` are
    ignored, and the last line of a repeated key wins. A recording has one text, so its
    keys are found in its row: nothing is sorted or moved.
    """
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, "\r", "")))
    parts = F.transform(F.filter(lines, lambda line: F.contains(line, F.lit("="))), lambda line: F.split(line, "=", 2))
    cells = texts.select("recording_id", F.reverse(parts).alias("cells"))
    keys = F.transform("cells", lambda cell: F.regexp_replace(cell[0], "^~+", ""))
    found = cells.select("recording_id", "cells", keys.alias("keys"))
    key = F.explode(F.array_distinct("keys")).alias("key")
    last = F.element_at("cells", F.array_position(F.col("keys"), F.col("key")).cast("int"))
    return found.select("recording_id", "cells", "keys", key).select("recording_id", "key", last[1].alias("value"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files (one per recording) as key/value rows; the id is the file stem."""
    texts = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.meta)?$", 1).alias("recording_id"),
        F.col("value").alias("text"),
    )
    return key_values(texts)


def wide(kv: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per recording with the named keys; `fields` maps key -> output column.

    Rows go to their recording's partition before they are sorted for it, not after, so that a task
    sorts a partition and never a whole split.
    """
    return kv.repartition("recording_id").groupBy("recording_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(c) for k, c in fields.items()]
    )


def expand_channels(spec: Column) -> Column:
    """`0:5,7,10:12` -> array of channel ids, ranges inclusive, order kept."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def span(p: Column) -> Column:
        ends = F.split(p, ":")
        return F.when(
            F.contains(p, F.lit(":")), F.sequence(ends[0].cast("int"), ends[1].cast("int"))
        ).otherwise(F.array(p.cast("int")))

    return F.flatten(F.transform(parts, span))


def sync_count(counts: Column) -> Column:
    """Number of trailing sync channels: the last field of `ap,lf,sy`; 0 when absent."""
    return F.coalesce(F.element_at(F.split(counts, ","), -1).cast("int"), F.lit(0))


def recordings(kv: DataFrame) -> DataFrame:
    """Typed metadata: fs, n_saved, saved_channels, n_sync."""
    # Key names of the metadata format.
    raw = wide(
        kv,
        {
            "imSampRate": "fs",
            "nSavedChans": "n_saved",
            "snsSaveChanSubset": "subset",
            "snsApLfSy": "counts",
        },
    )
    return raw.select(
        "recording_id",
        F.col("fs").cast("double").alias("fs"),
        F.col("n_saved").cast("int").alias("n_saved"),
        expand_channels(F.col("subset")).alias("saved_channels"),
        sync_count(F.col("counts")).alias("n_sync"),
    )


def keep_channels(
    recs: DataFrame, channel_map: DataFrame | None = None, bad: DataFrame | None = None
) -> DataFrame:
    """Channels to load, with their column position: not sync, mapped, not bad.

    `channel_map` and `bad` hold (recording_id, channel).
    """
    kept = recs.select(
        "recording_id", F.size("saved_channels").alias("_n"), "n_sync",
        F.posexplode("saved_channels").alias("position", "channel"),
    ).where(F.col("position") < F.col("_n") - F.col("n_sync"))
    if channel_map is not None:
        kept = kept.join(channel_map, ["recording_id", "channel"], "left_semi")
    if bad is not None:
        kept = kept.join(bad, ["recording_id", "channel"], "left_anti")
    return kept.select("recording_id", "channel", "position")


def channel_map(documents: DataFrame, text: str = "text") -> DataFrame:
    """JSON with parallel arrays chanMap and optional xc, yc -> one row per channel.

    Without positions x and y are null.
    """
    parsed = F.from_json(text, "chanMap array<int>, xc array<double>, yc array<double>")
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(
        F.col("j.chanMap").alias("c"), F.coalesce("j.xc", none).alias("x"), F.coalesce("j.yc", none).alias("y")
    )
    return (
        documents.select("recording_id", parsed.alias("j"))
        .select("recording_id", F.posexplode(zipped).alias("position", "c"))
        .select(
            "recording_id", "position", F.col("c.c").alias("channel"),
            F.col("c.x"), F.col("c.y"),
        )
    )


def position_or_index(x: Column, y: Column, index: Column) -> tuple[Column, Column]:
    """Fallback position of a channel without geometry: (index in its group, 0)."""
    known = x.isNotNull() & y.isNotNull()
    return (
        F.when(known, x).otherwise(index.cast("double")),
        F.when(known, y).otherwise(F.lit(0.0)),
    )


def geometry(kv: DataFrame) -> DataFrame:
    """`ch<N>_{s,x,z,u}` keys -> (recording_id, channel, shank, x, z, used)."""
    pattern = r"^ch(\d+)_([sxzu])$"
    cells = kv.select(
        "recording_id",
        F.regexp_extract("key", pattern, 1).alias("ch"),
        F.regexp_extract("key", pattern, 2).alias("field"),
        "value",
    ).where("field <> ''")
    wide_ = cells.groupBy("recording_id", F.col("ch").cast("int").alias("channel"))
    return (
        wide_.pivot("field", ["s", "x", "z", "u"])
        .agg(F.first("value"))
        .select(
            "recording_id", "channel", F.col("s").cast("int").alias("shank"),
            F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"),
            (F.col("u") == "1").alias("used"),
        )
    )


def tuples(rows: DataFrame, text: str, names: list[str], keys: list[str]) -> DataFrame:
    """`(a,b,c)(d,e,f)` -> one row per tuple with string fields; `()` gives no row."""
    found = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1))
    exploded = rows.select(*keys, F.posexplode(found).alias("position", "_t"))
    parts = F.split("_t", ",")
    return exploded.select(*keys, "position", *[F.trim(parts[i]).alias(n) for i, n in enumerate(names)])


def shank_map(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """`(shank,col,row,used)` entries as integers, in channel order."""
    parsed = tuples(rows, text, ["shank", "col", "row", "used"], keys)
    return parsed.select(
        *keys, F.col("position").alias("channel"),
        *[F.col(c).cast("int").alias(c) for c in ("shank", "col", "row")],
        (F.col("used") == "1").alias("used"),
    )


def digital_index(counts: Column) -> Column:
    """Column of the digital or sync channel: all counts before the last type, summed.

    Probe streams count (AP, LF, SY); auxiliary streams (MN, MA, XA, DW).
    """
    before = F.slice(counts, 1, F.size(counts) - 1)
    return F.aggregate(before, F.lit(0), lambda acc, n: acc + n)


def streams(kv: DataFrame) -> DataFrame:
    """Stream attributes per recording: rate, length, range and the resulting V per count."""
    raw = wide(
        kv,
        {
            "js": "js", "ip": "ip", "sampRate": "fs", "nSamples": "n_samples", "maxInt": "max_int",
            "vMin": "v_min", "vMax": "v_max", "gain": "gain", "fileStart": "file_start", "serial": "serial",
        },
    )
    types = {
        "js": "int", "ip": "int", "fs": "double", "n_samples": "bigint", "max_int": "int",
        "v_min": "double", "v_max": "double", "gain": "double", "file_start": "bigint", "serial": "string",
    }
    typed = raw.select("recording_id", *[F.col(c).cast(t).alias(c) for c, t in types.items()])
    return typed.withColumn(
        "volts_per_count", F.col("v_max") / F.col("max_int") / F.col("gain")
    )


def substreams(table: DataFrame) -> DataFrame:
    """Number of substreams per stream kind; ip runs from 0 to n - 1."""
    return table.groupBy("js").agg(F.countDistinct("ip").alias("n_substreams"))


def read_spikes(
    spark: SparkSession, folder: str, recording_id: str, labels: str = "spike_clusters.npy"
) -> DataFrame:
    """Two aligned npy files zipped by position; negative times dropped."""
    from tracewell.sources.raw import register

    register(spark)
    times = spark.read.format("npy1d").load(f"{folder}/spike_times.npy")
    ids = spark.read.format("npy1d").load(f"{folder}/{labels}")
    return zip_spikes(times, ids, recording_id)


def zip_spikes(times: DataFrame, ids: DataFrame, recording_id: str) -> DataFrame:
    """(pos, value) twice -> spikes; a position without a partner is an error."""
    both = times.withColumnRenamed("value", "t").join(ids.withColumnRenamed("value", "u"), "pos", "full")
    paired = F.col("t").isNotNull() & F.col("u").isNotNull()
    checked = F.when(paired, F.col("t")).otherwise(
        F.raise_error("spike times and labels differ in length").cast("bigint")
    )
    return (
        both.select(F.lit(recording_id).alias("recording_id"), checked.alias("spike_time"), F.col("u").alias("unit_id"))
        .where("spike_time >= 0")
    )


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Unit labels from the first of the two label files that exists; empty when none."""
    for name in ("cluster_group.tsv", "cluster_KSLabel.tsv"):
        if exists(f"{folder}/{name}"):
            return spark.read.csv(
                f"{folder}/{name}", sep="\t", header=True, enforceSchema=True,
                schema="unit_id bigint, label string",
            )
    return spark.createDataFrame([], "unit_id bigint, label string")


def read_bad_channels(spark: SparkSession, path: str) -> DataFrame:
    """One integer per line; a missing file means no bad channels."""
    if not exists(path):
        return spark.createDataFrame([], "channel int")
    return spark.read.text(path).select(F.trim("value").cast("int").alias("channel")).where("channel is not null")


def not_noise(label: Column) -> Column:
    """Keeps units that are unlabelled or labelled anything but noise (any case)."""
    return F.lower(F.coalesce(label, F.lit(""))) != "noise"
