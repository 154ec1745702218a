"""Metadata keys are found in their row, and only one recording's partition is ever sorted."""

from tracewell.sources import metadata as md

TEXTS = [("a", "x=1\r\n~x=2\n = 3\nno separator\n~~y=p=q\n\nx =4"), ("b", None), ("c", ""), ("d", "x=")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_line_wins_without_a_sort(spark):
    kv = md.key_values(spark.createDataFrame(TEXTS, "recording_id string, text string"))
    assert sorted(tuple(r) for r in kv.collect()) == [("a", "", " 3"), ("a", "x", "2"), ("a", "x ", "4"), ("a", "y", "p=q"), ("d", "x", "")]
    assert "Sort" not in plan(kv) and "Exchange" not in plan(kv)


def test_rows_are_moved_before_they_are_sorted(spark):
    kv = md.key_values(spark.createDataFrame(TEXTS, "recording_id string, text string"))
    found = md.wide(kv, {"x": "x", "y": "y"})
    assert sorted(tuple(r) for r in found.collect()) == [("a", "2", "p=q"), ("d", "", None)]
    steps = plan(found.repartition(1).select("x"))
    assert steps.count("hashpartitioning(recording_id") == 1
    assert steps.rindex("Sort") < steps.index("hashpartitioning(recording_id")
