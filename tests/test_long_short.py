from lumenframe.operators import optics


def test_long_and_short_channels_in_one_pass(spark):
    geo = spark.createDataFrame([("S", 0.0, 0.0, 0.0), ("D", 0.0, 0.0, 2.0), ("E", 1.0, 0.0, 0.0)], "label string, x double, y double, z double")
    ts = spark.createDataFrame([("a", "S", "D", 0, 1.0), ("b", "S", "E", 0, 2.0), ("c", "E", "E", 0, 3.0)], "channel string, source string, detector string, sample long, value double")
    marked = optics.marked_long(ts, optics.channel_distances(ts, geo), 1.0)
    assert {r.channel: r.long for r in marked.collect()} == {"a": True, "b": True, "c": False}
    long, short = optics.split_long_short(ts, geo, 1.0)
    assert sorted(r.channel for r in long.collect()) == ["a", "b"] and [r.channel for r in short.collect()] == ["c"]
    assert long.columns == short.columns == ts.columns
