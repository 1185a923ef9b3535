"""Streams give what the batch operators give."""

import tempfile
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from ticklake.operators import indicators as ind, labels as lab, quality as q
from ticklake.streaming import ticks as st

c = F.col


def arrive(spark, df, cuts):
    path = tempfile.mkdtemp(prefix="stream-") + "/in"
    for a, b in zip(cuts, cuts[1:]):
        df.where((c("Timestamp") >= F.lit(a).cast("timestamp_ntz")) & (c("Timestamp") < F.lit(b).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(path)
    return st.tick_stream(spark, path, df.schema)


CUTS = ["2024-01-01", "2024-01-01 20:00", "2024-01-03", "2024-01-03 01:00", "2024-02-01"]


def tmp():
    return tempfile.mkdtemp(prefix="stream-") + "/x"


def seqs(df, *cols):
    return df.select("seq", *cols).toPandas().sort_values("seq").reset_index(drop=True)


def test_stream_features_equal_batch(spark, ticks):
    out = tmp()
    op = ind.sma("mid", 20, "m")
    st.stream_operator(arrive(spark, ticks, CUTS), op, 32, out, tmp(), tmp())
    pd.testing.assert_frame_equal(seqs(spark.read.parquet(out), "m"), seqs(op(ticks), "m"))


def test_stream_labels_equal_batch(spark, ticks):
    out, state = tmp(), tmp()
    label = lab.multi_horizon([3, 7])
    st.stream_labels(arrive(spark, ticks, CUTS), label, 7, out, state, tmp())
    st.flush_labels(spark, label, len(CUTS) - 2, out, state)
    cols = ["direction_3", "volatility_7"]
    pd.testing.assert_frame_equal(seqs(spark.read.parquet(out), *cols), seqs(label(ticks), *cols))


def test_stream_filter_equals_batch(spark, ticks):
    d = ticks.withColumns({"Bid": c("mid") - 0.01, "Ask": c("mid") + 0.01 + c("Volume") * 0.001})
    out = tmp()
    st.run_available(st.filter_stream(arrive(spark, d, CUTS), 2.0), out, tmp())
    want = seqs(q.online_filter(d, 2.0).where("accepted"))
    assert seqs(spark.read.parquet(out))["seq"].tolist() == want["seq"].tolist()


def test_merged_moments_equal_whole(spark, ticks):
    a, b = st.batch_moments(ticks.where("seq % 3 = 0"), ["mid"]), st.batch_moments(ticks.where("seq % 3 > 0"), ["mid"])
    x, y = st.merge_moments(a, b).first(), st.batch_moments(ticks, ["mid"]).first()
    assert x["n"] == y["n"] and abs(x["mean"] - y["mean"]) < 1e-9 and abs(x["m2"] / y["m2"] - 1) < 1e-9


def feed(spark, rows, cuts):
    """``(Symbol, minute, seq, mid)`` rows as a stream whose files end at the minutes ``cuts``."""
    at = lambda m: None if m is None else datetime(2024, 1, 1) + timedelta(minutes=m)
    path = tempfile.mkdtemp(prefix="feed-") + "/in"
    schema = "Symbol string, Timestamp timestamp_ntz, seq long, mid double"
    for lo, hi in zip([-1, *cuts], [*cuts, 1 << 40]):
        part = [(k, at(m), i, x) for k, m, i, x in rows if lo < (m or 0) <= hi]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return st.tick_stream(spark, path, spark.createDataFrame([], schema).schema)


A = [("x", 0, 1, 10.0), ("x", 2, 2, 11.0), ("x", 2, 3, 11.5), ("x", 9, 4, 12.0), (None, 3, 5, 1.0), ("y", 40, 6, 5.0), ("x", 500, 7, 1.0)]
B = [("x", 1, 11, 10.1), ("x", 2, 12, 30.0), ("x", 2, 13, 31.0), (None, 3, 14, 2.0), ("x", None, 15, 3.0), ("z", 9, 16, 4.0), ("y", 40, 17, 5.0), ("x", 9, 18, 12.1), ("x", 500, 19, 1.0)]


def test_live_feed_keeps_the_second_feed_where_the_first_is_silent(spark):
    out = tmp()
    st.run_available(st.live_feed(feed(spark, A, [5, 100]), feed(spark, B, [5, 100]), "30 minutes"), out, tmp())
    got = sorted(r.seq for r in spark.read.parquet(out).collect())
    taken = {(k, m) for k, m, *_ in A if k is not None}
    assert got == sorted([r[2] for r in A] + [r[2] for r in B if r[0] is None or r[1] is None or (r[0], r[1]) not in taken])


def test_one_feed_alone(spark):
    only = [("x", m, m, 1.0) for m in (1, 5, 200)]
    for a, b, want in ((only, [], [1, 5, 200]), ([("q", 400, 9, 1.0)], [*only, ("x", 900, 900, 1.0)], [1, 5, 9, 200])):
        out = tmp()
        st.run_available(st.live_feed(feed(spark, a, [50]), feed(spark, b, [50]), "10 minutes"), out, tmp())
        assert sorted(r.seq for r in spark.read.parquet(out).collect()) == want


def test_divergence_starts_and_resolves(spark):
    gaps = [(0, 0.1), (12, 2.0), (14, 3.0), (21, 1.5), (35, 0.2), (41, 0.1), (55, 4.0), (69, 0.0), (400, 0.0)]
    a = [("x", m, m, 10.0) for m, _ in gaps]
    b = [("x", m, m, 10.0 + g) for m, g in gaps]
    out = tmp()
    windows = st.feed_windows(feed(spark, a, [20, 60]), feed(spark, b, [20, 60]), "5 minutes", "10 minutes")
    st.divergence_alarms(windows, 1.0, out, tmp(), tmp())
    got = sorted((round((r["at"].replace(tzinfo=None) - pd.Timestamp("2024-01-01")).total_seconds() / 60), round(r.divergence, 6), r.resolved) for r in spark.read.parquet(out).collect())
    assert got == [(14, 3.0, False), (21, 1.5, False), (35, 0.0, True), (55, 4.0, False), (69, 0.0, True)]


def test_check_batches_scores_spread_and_residual(spark, ticks):
    out, bad, state = tmp(), tmp(), tmp()
    wide = F.when(c("seq") % 50 == 7, 5.0).otherwise(0.01 + c("seq") % 3 * 0.001)
    off = F.when(c("seq") % 40 == 9, 9.0).otherwise(c("seq") % 5 * 0.01)
    d = ticks.select("Symbol", "Timestamp", "seq", "mid", (c("mid") - wide).alias("Bid"), c("mid").alias("Ask"), c("mid").alias("prediction"), (c("mid") + off).alias("target"))
    st.check_batches(arrive(spark, d, CUTS), ["mid"], out, bad, state, tmp(), max_rate=1.0)
    got = spark.read.parquet(out)
    assert "spread" not in got.columns and got.count() == d.count()
    pdf = d.toPandas().sort_values("Timestamp")
    parts = [pdf[(pdf.Timestamp >= a) & (pdf.Timestamp < b)] for a, b in zip(CUTS, CUTS[1:])]
    want, seen = {}, pdf.iloc[:0]
    for part in parts:
        seen = pd.concat([seen, part])
        total = 0
        for f in (lambda x: x.mid, lambda x: x.Ask - x.Bid, lambda x: x.target - x.prediction):
            total = total + ((f(part) - f(seen).mean()).abs() / f(seen).std() > 3).astype(int) * (len(seen) > 10)
        want.update(zip(part.seq, total))
    assert {r.seq: r.anomalies for r in got.select("seq", "anomalies").collect()} == want and sum(want.values()) > 0
