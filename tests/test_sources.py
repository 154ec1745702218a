import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.sources import chunks as ch, filters as fl, metadata as md
from tracewell.sources.raw import register


def test_raw_scan_of_one_file(spark, tmp_path):
    x = np.arange(-300, 305, dtype="<i2")  # 605 values: the last sample of 4 channels is partial
    x.tofile(tmp_path / "probe.bin")
    rows = (
        register(spark).read.format("interleaved16").option("n_channels", 4).option("chunk_samples", 50)
        .option("columns", "1,3").option("channel_ids", "10,11,12,13").option("chunks_per_task", 2)
        .load(str(tmp_path / "probe.bin"))
    )
    got = ch.unpack(rows).orderBy("sample", "channel").collect()
    full = x[:604].reshape(-1, 4)
    assert [r.channel for r in got[:2]] == [11, 13] and len(got) == 2 * 151
    assert [r.value for r in got] == full[:, [1, 3]].ravel().tolist()
    assert {r.recording_id for r in rows.collect()} == {"probe"}


@pytest.mark.parametrize("dtype,shape", [("<i4", (9,)), ("<i8", (9, 1)), ("<u4", (9,)), ("<u8", (1, 9))])
def test_npy(spark, tmp_path, dtype, shape):
    np.save(tmp_path / "v.npy", np.arange(9, dtype=dtype).reshape(shape))
    rows = register(spark).read.format("npy1d").option("values_per_task", 4).load(str(tmp_path / "v.npy"))
    assert sorted((r.pos, r.value) for r in rows.collect()) == [(i, i) for i in range(9)]


def test_npy_rejects_other_content(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.ones(3))
    with pytest.raises(Exception, match="one dimension of integers"):
        register(spark).read.format("npy1d").load(str(tmp_path / "f.npy")).collect()


def test_spikes_and_labels(spark, tmp_path):
    np.save(tmp_path / "spike_times.npy", np.array([-5, 3, 9]))
    np.save(tmp_path / "spike_clusters.npy", np.array([1, 1, 2], dtype="<i4"))
    got = md.read_spikes(spark, str(tmp_path), "r").collect()
    assert sorted((r.spike_time, r.unit_id) for r in got) == [(3, 1), (9, 2)]
    np.save(tmp_path / "spike_templates.npy", np.array([1, 1]))
    with pytest.raises(Exception, match="differ in length"):
        md.read_spikes(spark, str(tmp_path), "r", "spike_templates.npy").collect()
    assert md.read_labels(spark, str(tmp_path)).count() == 0
    (tmp_path / "cluster_KSLabel.tsv").write_text("cluster_id\tKSLabel\n1\tmua\n")
    assert md.read_labels(spark, str(tmp_path)).first().label == "mua"
    (tmp_path / "cluster_group.tsv").write_text("cluster_id\tgroup\n1\tgood\n2\tNoise\n")
    labels = md.read_labels(spark, str(tmp_path))
    assert [r.unit_id for r in labels.where(md.not_noise(F.col("label"))).collect()] == [1]


def test_metadata_lines(spark, tmp_path):
    (tmp_path / "a.meta").write_text("~x=1\r\n\nno separator\nname=p=q\nx=2\nimSampRate=29999.5\nnSavedChans=4\nsnsSaveChanSubset=0:2,5,7:8\nsnsApLfSy=5,0,1\n")
    kv = md.read_metadata(spark, str(tmp_path))
    got = {r.key: r.value for r in kv.collect()}
    assert got["x"] == "2" and got["name"] == "p=q" and "no separator" not in got
    rec = md.recordings(kv).first()
    assert (rec.recording_id, rec.fs, rec.saved_channels, rec.n_sync) == ("a", 29999.5, [0, 1, 2, 5, 7, 8], 1)
    kept = md.keep_channels(md.recordings(kv), bad=spark.createDataFrame([("a", 5)], "recording_id string, channel int"))
    assert sorted((r.channel, r.position) for r in kept.collect()) == [(0, 0), (1, 1), (2, 2), (7, 4)]


def test_missing_bad_channel_file(spark, tmp_path):
    assert md.read_bad_channels(spark, str(tmp_path / "none")).count() == 0


def test_legacy_filters(spark, tmp_path):
    np.array([4, 9], dtype="<i4").tofile(tmp_path / "channels_7.bin")
    np.arange(6, dtype="<f8").tofile(tmp_path / "filter_7.bin")
    np.array([0.5]).tofile(tmp_path / "threshold_7.bin")
    row = fl.import_legacy(spark, str(tmp_path), 3).first()
    assert (row.target_id, row.channels, row.taps, row.threshold, row.left_margin) == (7, [4, 9], [0, 1, 2, 3, 4, 5], 0.5, 1)
    with pytest.raises(Exception, match="do not fit together"):
        fl.import_legacy(spark, str(tmp_path), 4).collect()
    (tmp_path / "filter_7.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="not a multiple"):
        fl.import_legacy(spark, str(tmp_path), 3).collect()


def test_options_choose_what_is_planned(spark, tmp_path):
    import numpy as np

    from tracewell.sources.raw import RawReader, layouts, register

    for name, width in (("a", 2), ("b", 3), ("c", 2)):
        np.arange(1000 * width, dtype="<i2").tofile(f"{tmp_path}/{name}.bin")
    table = spark.createDataFrame([("b", 3, [2, 0])], "recording_id string, n_channels int, columns array<int>")
    options = {"n_channels": "2", "chunk_samples": "100", "chunks_per_task": "2", "halo_before": "5", "layout": layouts(table)}

    def plan(**chosen):
        reader = RawReader({"path": str(tmp_path), **options, **chosen})
        return [(p.recording_id, p.first_chunk, p.last_chunk) for p in reader.partitions()]

    assert len(plan()) == 15
    assert plan(recordings="b", from_sample="250", to_sample="500") == [("b", 2, 4), ("b", 4, 5)]
    assert plan(recordings="a,x", from_sample="900") == [("a", 9, 10)]
    assert plan(to_sample="0") == []
    with pytest.raises(ValueError, match="neither"):
        RawReader({"path": str(tmp_path), "layout": options["layout"]}).partitions()
    rows = register(spark).read.format("interleaved16").options(**options, recordings="b", from_sample=250, to_sample=500).load(str(tmp_path))
    got = rows.orderBy("start_sample").collect()
    assert [(r.start_sample, r.lead, r.channels) for r in got] == [(200, 5, [2, 0]), (300, 5, [2, 0]), (400, 5, [2, 0])]
    assert got[1]["values"][10:14] == [902.0, 900.0, 905.0, 903.0]
    assert rows.rdd.getNumPartitions() == 2
    none = register(spark).read.format("interleaved16").options(**options, recordings="x").load(str(tmp_path))
    assert none.count() == 0
