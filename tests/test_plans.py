"""The ordered-data kit against pandas, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from ticklake.operators import indicators as ind
from ticklake.plans.asof import asof_join
from ticklake.plans.ordered import IDX, Order, full, linear_scan, rolling, row_index, running
from ticklake.plans.steps import finite_machine, settled_scan
from ticklake.plans.values import average_ranks, exact_quantiles

SMALL = Order(bucket_seconds=7200, block_rows=16, scan_rows=32)


def back(df, cols):
    return df.select("seq", *cols).toPandas().sort_values("seq").reset_index(drop=True)


def grouped(series, fn):
    return series.groupby("Symbol", group_keys=False)["mid"].transform(fn)


def test_row_index_is_dense(ticks, series):
    got = back(row_index(ticks, SMALL), [IDX])
    assert (got[IDX].to_numpy() == series.groupby("Symbol").cumcount().to_numpy()).all()


@pytest.mark.parametrize("n", [1, 2, 5, 40, 200])
def test_rolling_mean_over_block_edges(ticks, series, n):
    got = back(ind.sma("mid", n, "m")(ticks, SMALL), ["m"])
    want = grouped(series, lambda s: s.rolling(n).mean())
    np.testing.assert_allclose(got["m"], want, rtol=1e-9, equal_nan=True)


def test_rolling_ahead(ticks, series):
    def fn(d, w):
        return d.withColumn("x", F.max("mid").over(w.rowsBetween(1, 9)))

    got = back(rolling(ticks, fn, 0, 9, SMALL), ["x"])
    want = grouped(series, lambda s: s[::-1].rolling(9, min_periods=1).max()[::-1].shift(-1))
    np.testing.assert_allclose(got["x"], want, equal_nan=True)


def test_window_with_null_inside_is_null(spark):
    rows = [("A", i, None if i == 3 else float(i)) for i in range(8)]
    d = spark.createDataFrame(rows, "Symbol string, seq long, mid double").withColumn("Timestamp", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    got = back(rolling(d, lambda d, w: d.withColumn("m", full(F.avg, "mid", 3, w)), 2, 0, SMALL), ["m"])["m"]
    assert got.isna().tolist() == [True, True, False, True, True, True, False, False]


def test_running_kinds(ticks, series):
    outs = {
        "s": ("sum", F.col("Volume")),
        "hi": ("max", F.col("mid")),
        "lo": ("min", F.col("mid")),
        "n": ("count", F.when(F.col("mid") > 50, 1)),
        "l": ("last", F.when(F.col("Volume") > 40, F.col("mid"))),
    }
    got = back(running(ticks, outs, SMALL), list(outs))
    g = series.groupby("Symbol")
    np.testing.assert_allclose(got["s"], g["Volume"].cumsum())
    np.testing.assert_allclose(got["hi"], g["mid"].cummax())
    np.testing.assert_allclose(got["lo"], g["mid"].cummin())
    assert (got["n"] == (series["mid"] > 50).groupby(series["Symbol"]).cumsum()).all()
    want = series["mid"].where(series["Volume"] > 40).groupby(series["Symbol"]).ffill()
    np.testing.assert_allclose(got["l"], want, equal_nan=True)


def test_running_reverse_and_exclusive(ticks, series):
    x = {"l": ("last", F.when(F.col("Volume") > 40, F.col("mid")))}
    got = back(running(ticks, x, SMALL, reverse=True), ["l"])
    v = series["mid"].where(series["Volume"] > 40)
    np.testing.assert_allclose(got["l"], v.groupby(series["Symbol"]).bfill(), equal_nan=True)
    got = back(running(ticks, x, SMALL, exclusive=True), ["l"])
    want = v.groupby(series["Symbol"]).ffill().groupby(series["Symbol"]).shift()
    np.testing.assert_allclose(got["l"], want, equal_nan=True)


def test_ema_over_blocks(ticks, series):
    got = back(ind.ema(ticks, {"e": ("mid", 12)}, SMALL), ["e"])
    want = grouped(series, lambda s: s.ewm(span=12, adjust=False).mean())
    np.testing.assert_allclose(got["e"], want, rtol=1e-10)


def test_linear_scan_spreads_missing(ticks):
    a = F.when(F.col(IDX) == 0, 0.0).when(F.col(IDX) == 50, None).otherwise(0.5)
    got = back(linear_scan(ticks, {"y": (a, F.lit(1.0))}, SMALL).where("Symbol = 'A'"), ["y"])["y"]
    assert got[:50].notna().all() and got[50:].isna().all()


def test_ram_decay_matches_pandas(ticks, series):
    got = back(ind.ram_decay(ticks, 0.1, order=SMALL), ["ram"])
    r = grouped(series, lambda s: s.pct_change())
    e = r.groupby(series["Symbol"]).apply(lambda s: (s.ewm(alpha=0.1, adjust=False).mean() / s.ewm(alpha=0.1, adjust=False).std()).fillna(0), include_groups=False)
    np.testing.assert_allclose(got["ram"], e.reset_index(level=0, drop=True).sort_index(), rtol=1e-6, atol=1e-9)


@settings(max_examples=8, deadline=None)
@given(hs.lists(hs.tuples(hs.sampled_from("AB"), hs.integers(0, 40)), max_size=25), hs.lists(hs.tuples(hs.sampled_from("AB"), hs.integers(0, 40)), max_size=12), hs.booleans())
def test_asof_equals_brute_force(spark, left, right, forward):
    ddl = "Symbol string, t long, id long"
    stamp = lambda d: d.withColumn("Timestamp", F.timestamp_seconds(F.col("t") * 1000).cast("timestamp_ntz"))
    lf = stamp(spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(left)], ddl)).withColumnRenamed("id", "seq")
    rf = stamp(spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(right)], ddl)).withColumnRenamed("Timestamp", "d")
    got = asof_join(lf, rf.select("Symbol", "d", "id"), ["id"], "d", ["id"], Order(bucket_seconds=5000), forward=forward)
    got = {r["seq"]: r["id"] for r in got.collect()}
    for i, (s, t) in enumerate(left):
        if forward:
            hits = [(rt, j) for j, (rs, rt) in enumerate(right) if rs == s and rt >= t]
            want = min(hits)[1] if hits else None
        else:
            hits = [(rt, j) for j, (rs, rt) in enumerate(right) if rs == s and rt <= t]
            want = max(hits)[1] if hits else None
        assert got[i] == want


def test_asof_max_age(spark):
    ts = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    left = spark.createDataFrame([("A", ts(10), 0), ("A", ts(100), 1)], "Symbol string, Timestamp timestamp_ntz, seq long")
    right = spark.createDataFrame([("A", ts(5), 1.5)], "Symbol string, d timestamp_ntz, v double")
    got = asof_join(left, right, ["v"], "d", max_age_seconds=30).orderBy("seq").collect()
    assert [r["v"] for r in got] == [1.5, None]


def test_exact_quantiles_through_brackets(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.exponential(10, 5000), 1)  # many ties
    b = np.full(600, 4.25)
    d = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "k string, v double")
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = {(r["k"], r["prob"]): r["value"] for r in exact_quantiles(d, ["k"], "v", probs, accuracy=100).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile(a, p), abs=1e-12)
        assert got["b", p] == 4.25


def test_average_ranks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(list("xyz"), 400, p=[0.8, 0.15, 0.05]), "v": rng.integers(0, 30, 400).astype(float), "i": range(400)})
    got = average_ranks(spark.createDataFrame(pdf), ["k"], "v", "r").toPandas().sort_values("i")
    assert (got["r"].to_numpy() == pdf.groupby("k")["v"].rank().to_numpy()).all()


def test_finite_machine(ticks, series):
    step = lambda s, row: 0 if row[0] < 48 else 1 if row[0] > 52 else s
    got = back(finite_machine(ticks, ["mid"], step, 2, 0, "st", SMALL), ["st"])["st"]
    want = []
    for _, g in series.groupby("Symbol", sort=False):
        s = 0
        for m in g["mid"]:
            s = step(s, (m,))
            want.append(s)
    assert got.tolist() == want


def test_settled_scan_with_long_memory(spark, ticks, series):
    """Every block needs the exact state of the one before: worst case of the rounds."""
    from pyspark.sql import types as T

    def run(state, rows):
        (x,), out = state, []
        for (m,) in rows:
            x = (x * 3 + round(m)) % 101
            out.append((x,))
        return out, [x]

    outs = T.StructType([T.StructField("h", T.DoubleType())])
    got = back(settled_scan(ticks.where("Symbol <> 'A' or seq < 100"), ["mid"], outs, [1.0], run, lambda e, s: s, SMALL), ["h"])["h"]
    want = []
    sub = series[(series["Symbol"] != "A") | (series["seq"] < 100)]
    for _, g in sub.groupby("Symbol", sort=False):
        want += [o[0] for o in run((1.0,), [(m,) for m in g["mid"]])[0]]
    assert got.tolist() == want
