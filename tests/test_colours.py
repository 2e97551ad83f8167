from lumenframe.operators import views


def test_bytes_half_way_round_up_whatever_the_last_bit(spark):
    # 180 * (1 - 0.425) is 103.5 and 180 + 75 * 0.5 is 217.5; sums in another order leave a little less
    rows = spark.createDataFrame([("top", 1.0), ("a", 0.425), ("b", 0.5), ("c", 0.5 - 4e-16)], "channel string, value double")
    got = {r.channel: (r.r, r.g, r.b, r.a) for r in views.colours(rows).collect()}
    assert got == {"top": (255, 0, 0, 255), "a": (212, 104, 104, 255), "b": (218, 90, 90, 255), "c": (218, 90, 90, 255)}
