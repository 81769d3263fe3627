"""Calendar weeks and weekly volume on micro-tables."""

import datetime as dt

from revq.operators.weekly import weekly_series, weekly_volume


def test_weekly_series_monday_weeks(spark):
    ts = [dt.datetime(2024, 1, 10, 9), dt.datetime(2024, 1, 14, 23), dt.datetime(2024, 1, 15, 0), dt.datetime(2024, 1, 30, 12)]
    ev = spark.createDataFrame([(t, "click", 1.0) for t in ts], "ts timestamp_ntz, event_type string, value double")
    got = {r.week_start.isoformat(): r for r in weekly_series(ev).collect()}
    assert sorted(got) == ["2024-01-08", "2024-01-15", "2024-01-29"]  # Monday starts
    assert got["2024-01-08"].n == 2 and got["2024-01-15"].n == 1
    assert got["2024-01-15"].prev_n == 2 and got["2024-01-15"].change_pct == -50
    assert got["2024-01-29"].prev_n is None  # the week before it is empty: no comparison


def test_weekly_volume_labels(spark):
    rows = [(dt.datetime(2024, 2, 21),)] * 26 + [(dt.datetime(2024, 2, 14),)] * 38
    r = weekly_volume(spark.createDataFrame(rows, "ingested_at timestamp_ntz"), "2024-02-27").first()
    assert (r.this_week, r.prev_week, r.change_pct, r.change_label) == (26, 38, -32, "-32%")
    empty_prev = weekly_volume(spark.createDataFrame(rows[:26], "ingested_at timestamp_ntz"), "2024-02-27").first()
    assert empty_prev.change_label == "N/A (no previous week data)"
