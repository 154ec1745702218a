"""Turns of the live queries: one batch each, however many files they make."""

import os

from pyspark.sql import functions as F

from catalog.streams import in_turns
from tracewell.session import cut_lineage
from tracewell.streaming import chunks as st


def test_a_turn_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    rows = spark.range(120).select("id", (F.col("id") % 3).alias("_part")).repartition(6)
    turns, folder = in_turns(cut_lineage(rows), 3)
    paths = {}
    monkeypatch.setattr(st, "scratch_path", lambda _, name: paths.setdefault(name, str(tmp_path / name)))
    got = st.run_available(st.read_stream(spark, folder, "id long"), turns=turns)
    assert sorted(r.id for r in got.collect()) == list(range(120))
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    batches = [f for f in os.listdir(f"{paths['offsets']}/commits") if f.isdigit()]
    assert len(files) > 12 and len(batches) == 3


def test_no_rows_at_all(spark):
    turns, folder = in_turns(cut_lineage(spark.range(0).withColumn("_part", F.lit(0))), 3)
    assert st.run_available(st.read_stream(spark, folder, "id long"), turns=turns).count() == 0
