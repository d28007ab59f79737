"""Default channel names, trial order and window defaults."""

from pyspark.sql import functions as F

from tidemark.operators import signals as sg
from tidemark.operators import windows as wd


def test_names_by_position_unless_all_are_given(spark):
    rows = [("a", "dreamer", 0, "F8"), ("a", "dreamer", 1, "O1"), ("b", "DREAMER", 0, "F8"), ("b", "DREAMER", 1, None),
            ("c", None, 0, None), ("c", None, 1, "x")] + [("d", "dreamer", i, None) for i in range(15)]
    df = sg.with_channel_names(spark.createDataFrame(rows, "segment_id string, dataset string, position int, channel string"))
    names = {(r.segment_id, r.position): r.channel for r in df.collect()}
    assert len(names) == len(rows)
    assert [names["a", 0], names["a", 1]] == ["F8", "O1"]
    assert [names["b", 0], names["b", 1]] == ["AF3", "F7"]
    assert [names["c", 0], names["c", 1]] == ["EEG_1", "EEG_2"]
    assert names["d", 14] == "EEG_15"  # one channel more than the montage has


def test_trials_are_placed_by_onset_and_type(spark):
    rows = [("r", 1, "700", "5", "2"), ("r", 2, "10", "5", "9"), ("r", 3, "10", "5", "1"), ("r", 4, "10", "5", "1"), ("r", 5, "x", "5", "1"),
            ("r", 6, "0", "5", "10"), (None, 7, "3", "0", "4")]
    df = spark.createDataFrame(rows, "r string, id int, onset string, duration string, trial_type string")
    got = {x.id: x.trial_index for x in wd.target_events(df, ["r"], ("id",)).collect()}
    assert got == {3: 0, 4: 1, 2: 2, 1: 3, 7: 0}


def test_window_defaults(spark):
    df = spark.createDataFrame([("WESAD",), ("case",), ("none",), (None,)], "d string")
    static, dynamic = wd.default_windows(F.col("d")), wd.default_windows(F.col("d"), dynamic=True)
    rows = {r.d: r[1:] for r in df.select("d", *static, *dynamic).collect()}
    assert rows["WESAD"] == (30.0, 30.0, 10.0, 5.0) and rows["case"] == (10.0, 10.0, 5.0, 2.0)
    assert rows["none"] == rows[None] == (None,) * 4
