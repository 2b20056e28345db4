from fixtures import P2OBS

from tidemark.functions import codecs
from tidemark.operators import p2, sketches, states


def test_folds_go_on_from_states(spark, tmp_path):
    rows = [(k, i, x) for k in "ab" for i, x in enumerate(P2OBS)]
    df = spark.createDataFrame(rows + [("c", 30, 1.0)], "k string, seq int, x double")
    for cut in (2, 7):
        states.histogram_state(df.where(f"seq < {cut}"), "x", "seq", 4, ["k"]).write.mode("overwrite").parquet(str(tmp_path / "h"))
        whole = states.histogram_state(df.where(f"seq >= {cut}"), "x", "seq", 4, ["k"], spark.read.parquet(str(tmp_path / "h")))
        got = states.markers(whole, ["k"], lambda b: codecs.unpack_histogram(b, 4))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, p2.histogram(df, "x", "seq", 4, ["k"]).collect()), key=repr)


def test_sketch_goes_on(spark):
    shape = sketches.Shape(0.1, 0.1)
    df = spark.createDataFrame([("g", i, f"k{i % 5}", 1 if i % 4 else -1) for i in range(60)], "g string, seq int, k string, n int")
    half = states.sketch_state(df.where("seq < 25"), "k", "n", "seq", shape, ["g"])
    whole = states.sketch_state(df.where("seq >= 25"), "k", "n", "seq", shape, ["g"], half).collect()[0]["state"]
    once = states.sketch_state(df, "k", "n", "seq", shape, ["g"]).collect()[0]["state"]
    assert bytes(whole) == bytes(once)
