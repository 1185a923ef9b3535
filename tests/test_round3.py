"""Rows with a NULL key in every machine, and the rebuilt operators against loops."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.operators import context, drift, indicators, labels, mljobs, pairs, quality, registry, reports, signals, similar
from ticklake.sources import stores
from ticklake.plans.ordered import IDX, Order, linear_scan, own_index
from ticklake.plans.steps import finite_machine, settled_scan
from ticklake.plans.values import digits, quantile_arrays
from ticklake.streaming import ticks

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def nulled(spark):
    """Two series that are alike but for their key, one of them NULL."""
    rows = []
    for key in ("A", None):
        for i in range(60):
            mid = 10 + math.sin(i / 3) + (i % 7) / 10
            rows.append((key, T0 + dt.timedelta(minutes=i), i, mid, mid - 0.01, mid + 0.01 + (i % 5) / 100, float(i % 11), (i * 37 % 100) / 100))
    return spark.createDataFrame(rows, "Symbol string, Timestamp timestamp_ntz, seq long, mid double, Bid double, Ask double, Volume double, prob double").repartition(3).cache()


def both(df, *cols):
    """The rows of key A and of the NULL key, without the key."""
    rows = df.collect()
    out = [sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in rows if (r["Symbol"] is None) == null), key=str) for null in (False, True)]
    return out


def alike(df, *cols, n=60):
    a, b = both(df, *cols)
    assert len(a) == n and a == b


SMALL = Order(scan_rows=16, block_rows=16)


def test_null_keys_stay_in_machines(nulled):
    step = lambda s, v: (s + int(v[0] > 10)) % 3
    alike(finite_machine(nulled, ["mid"], step, 3, 0, "state", SMALL), "seq", "state")

    def run(entry, rows):
        out, now = [], entry[0]
        for (v,) in rows:
            now = 0.5 * now + v
            out.append((now,))
        return out, (now,)

    d = settled_scan(nulled, ["mid"], T.StructType([T.StructField("y", T.DoubleType())]), [0.0], run, lambda entry, s: s, SMALL)
    alike(d, "seq", "y")


def test_null_keys_stay_in_operators(nulled):
    alike(quality.zscore_filter(nulled, ["mid"], 1.0), "seq", "mid")
    alike(quality.online_filter(nulled, 2.0, SMALL), "seq", "accepted")
    alike(quality.robust_preprocess(nulled, ["mid"]), "seq", "mid")
    a, b = both(labels.purged_folds(nulled, 3, 2, "Volume", 1), "seq", "fold", "part")
    assert a and a == b
    alike(signals.delayed_quotes(nulled, 1500), "seq", "fill_Bid", "fill_Ask")
    a, b = both(reports.walk_forward_windows(nulled, 20, 10, 10, SMALL), "seq", "window")
    assert a and a == b
    a, b = both(reports.walk_forward_rmse(nulled, "mid", 20, 10, 10, SMALL), "window", "rmse")
    assert a and a == b
    a, b = both(drift.mean_shift(nulled, ["mid"]), "middle", "mean_before", "mean_after")
    assert len(a) == 1 and a == b


def test_null_pair_keys_stay(spark):
    rows = [(a, "B", T0 + dt.timedelta(minutes=i), float(i % 7), float(i % 5)) for a in ("A", None) for i in range(50)]
    df = spark.createDataFrame(rows, "a string, b string, Timestamp timestamp_ntz, x double, y double")
    got = pairs.hedge_spread(df, 10).collect()
    one = [sorted((r.x, r.y, round(r.spread, 9)) for r in got if (r.a is None) == null) for null in (False, True)]
    assert len(one[0]) == 50 and one[0] == one[1]


# --- nearest earlier rows ---


def brute_nearest(i, v, k):
    out = {}
    for n in range(len(i)):
        d = np.round(((v[:n] - v[n]) ** 2).sum(axis=1), 9)
        out[int(i[n])] = [int(x) for x in np.lexsort((i[:n], d))[:k]]
    return out


def points(n, seed, width=5):
    """Correlated points with repeats: most of the spread lies in few directions, as in components."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)) * np.array([4.0, 2.0, 0.7, 0.3, 0.2])[:width]
    v[rng.integers(0, n, n // 10)] = v[0]  # many equal rows
    return v


def as_table(spark, series):
    rows = [(key, i, *map(float, x), float(i % 13)) for key, v in series.items() for i, x in enumerate(v)]
    names = [f"pc_{d}" for d in range(5)]
    return spark.createDataFrame(rows, "Symbol string, i long, " + ", ".join(f"{n} double" for n in names) + ", r double"), names


def test_nearest_earlier_against_all_pairs(spark):
    series = {"A": points(1500, 1), None: points(400, 2), "B": points(3, 3), "C": np.zeros((200, 5))}
    table, names = as_table(spark, series)
    got = similar.nearest_earlier(table, ["Symbol"], names, 4, block=16).collect()
    for key, v in series.items():
        want = brute_nearest(np.arange(len(v)), v, 4)
        rows = {r.i: [e.j for e in r.near] for r in got if r.Symbol == key}
        assert rows == {i: js for i, js in want.items() if js}


def test_nearest_earlier_skips_most_pairs(spark):
    n = 8000
    table, names = as_table(spark, {"A": points(n, 4)})
    blocks = similar.cell_blocks(table, ["Symbol"], names, 32).cache()
    first = similar.first_pass(blocks, ["Symbol"], 5, 5).cache()
    open_ = similar.open_pairs(blocks, first, ["Symbol"], names)
    compared = open_.agg(F.sum(F.size("rows") * F.col("p_n"))).first()[0] + (similar.BEFORE + 1) * sum(r.n * r.n for r in blocks.select(F.size("x").alias("n")).collect())
    assert compared < 0.2 * n * n / 2
    plan = similar.nearest_earlier(table, ["Symbol"], names, 5, block=32)._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(Symbol#\d+, \d+", plan)  # rows never meet on the key alone


def test_similar_days_edges(spark):
    rows = [("A", T0 + dt.timedelta(days=i), 0, float(i), None if i == 2 else 1.0) for i in range(4)] + [(None, T0, 0, None, 2.0)]
    df = spark.createDataFrame(rows, "Symbol string, Timestamp timestamp_ntz, seq long, x double, r double")
    got = {(r.Symbol, r.x): (r.nn_return_mean, r.nn_vol) for r in similar.similar_days(df, ["x"], "r", 2).collect()}
    assert len(got) == 5 and got["A", 0.0] == got[None, None] == (0.0, 0.0) and got["A", 1.0] == (1.0, 0.0)
    assert similar.similar_days(df.where("false"), ["x"], "r").count() == 0


# --- quantiles by radix selection ---


@pytest.mark.parametrize("accuracy", [1, 8, 1 << 16])
def test_quantiles_of_awkward_values(spark, accuracy):
    rng = np.random.default_rng(8)
    a = np.concatenate((rng.normal(0, 1, 300), rng.normal(0, 1e9, 50), [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 2.0**60, 1 - 2**-53]))
    series = {"a": a, "b": np.array([7.5]), None: np.round(rng.normal(0, 3, 200)), "d": np.array([-1.0, float("inf"), float("-inf"), 2.0])}
    rows = [(k, float(x)) for k, v in series.items() for x in v] + [("a", None), ("only null", None)]
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in quantile_arrays(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", probs, "q", accuracy).collect()}
    assert set(got) == set(series)
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(list(np.quantile(series[k], probs)), rel=1e-12, abs=1e-12)
    assert got["d"][2] == 0.5


def test_digits_rise(spark):
    rng = np.random.default_rng(2)
    x = np.sort(np.concatenate((rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), *[[2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, np.inf)] for e in range(-999, 1023, 7)])))
    got = [r.d for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double").select("i", digits(F.col("v")).alias("d")).orderBy("i").collect()]
    assert got == sorted(got)


def test_index_of_quantiles_and_shifts(spark, tmp_path):
    rng = np.random.default_rng(5)
    e, a = rng.normal(0, 1, 400), rng.normal(0.5, 1, 300)
    left = spark.createDataFrame([(float(x), 1.0) for x in e], "x double, flat double")
    right = spark.createDataFrame([(float(x), 2.0) for x in a], "x double, flat double")
    cuts = np.quantile(e, np.arange(11) / 10)
    want = 0.0
    p, q = (np.histogram(v, cuts)[0] for v in (e, a))
    for u, v in zip(p / p.sum(), q / q.sum()):
        u, v = u or 1e-6, v or 1e-6
        want += (u - v) * math.log(u / v)
    got = {r.column: r.psi for r in drift.psi(left, right, ["x", "flat"]).collect()}
    assert got["x"] == pytest.approx(want, rel=1e-9) and got["flat"] == 0.0
    for d, name in ((left, "l"), (right, "r")):
        d.write.parquet(str(tmp_path / name))
    plan = drift.psi(*(spark.read.parquet(str(tmp_path / n)) for n in "lr"), ["x", "flat"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


# --- recurrences ---


def test_linear_scan_over_pieces(spark):
    """Many pieces, resets, NULL steps (which spread as NULL), a NULL key, and a chain on one numbering."""
    rng = np.random.default_rng(6)
    rows = []
    for key, n in (("A", 500), (None, 60), ("B", 1)):
        for i in range(n):
            rows.append((key, T0 + dt.timedelta(minutes=7 * i), i, float(rng.normal()), float(rng.uniform(0.2, 1.01))))
    df = spark.createDataFrame(rows, "Symbol string, Timestamp timestamp_ntz, seq long, x double, k double").repartition(4)
    order = Order(bucket_seconds=3600)
    a = F.when(F.col(IDX) % 97 == 0, 0.0).otherwise(F.col("k"))
    d = linear_scan(df, {"y": (a, F.col("x"))}, order, keep_index=True)
    d = linear_scan(d, {"z": (F.when(F.col(IDX) == 0, 0.0).otherwise(0.5), F.when(F.col(IDX) == 300, F.lit(None)).otherwise(F.col("y")))}, order)
    got = {(r.Symbol, r.seq): (r.y, r.z) for r in d.collect()}
    assert len(got) == len(rows) and IDX in d.columns and IDX not in own_index(df, d).columns
    y = z = 0.0
    for key, _, i, x, k in rows:
        y = (0.0 if i % 97 == 0 else k) * (y if i else 0.0) + x
        z = (0.5 * z if i else 0.0) + (math.nan if i == 300 else y)
        assert got[key, i][0] == pytest.approx(y, rel=1e-9, abs=1e-12)
        assert got[key, i][1] == (None if math.isnan(z) else pytest.approx(z, rel=1e-9, abs=1e-12))


def test_recurrence_plan(spark, nulled, tmp_path):
    nulled.write.parquet(str(tmp_path / "t"))
    plan = indicators.ema(spark.read.parquet(str(tmp_path / "t")), {"e": ("mid", 5)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 3 and plan.count("Exchange hashpartitioning") <= 5


# --- keywords, pairs, pieces and streams without caps ---


@pytest.mark.parametrize("words,listed,frame", [(5, 100_000, 64 << 20), (500, 40, 500), (50_000, 20_000, 2000)])
def test_keywords_against_brute_force(spark, words, listed, frame):
    rng = np.random.default_rng(words)
    letters = list("abcdeé ")
    kw = [(f"S{i % max(words // 3, 1)}", "".join(rng.choice(letters, int(rng.integers(1, 9))))) for i in range(words)] + [("S0", " "), ("S1", None), ("S2", " AB ")]
    texts = [(i, "".join(rng.choice(letters, int(rng.integers(0, 60)))).upper() if i % 3 else "".join(rng.choice(letters, 30))) for i in range(60)] + [(99, None), (100, ""), (1, "bad CAB")]
    got = context.keyword_matches(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(kw, "symbol string, keyword string"), max_listed=listed, frame_bytes=frame).collect()
    by = {}
    for s, w in kw:
        if w and w.strip():
            by.setdefault(w.strip().lower(), set()).add(s)
    want = {(i, s) for i, t in texts if t for w, ss in by.items() if w in t.lower() for s in ss}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_keywords(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert context.keyword_matches(texts, spark.createDataFrame([], "symbol string, keyword string")).count() == 0


def test_pairs_of_common_times(spark):
    rows = [(s, T0 + dt.timedelta(hours=h)) for s, hs in (("a", (0, 1)), ("b", (1,)), ("c", (2,)), (None, (0, 1, 2))) for h in hs]
    df = spark.createDataFrame(rows, "Symbol string, Timestamp timestamp_ntz")
    assert {tuple(r) for r in pairs.pair_list(df).collect()} == {("a", "b"), ("b", "a")}
    assert pairs.all_pairs(df) == [("a", "b")] and pairs.pair_list(df, ["a", "c"]).count() == 0


def test_per_key_sees_no_edge(nulled):
    def fn(pdf):
        return pdf[["Symbol", "seq"]].assign(m=pdf["mid"].rolling(5).mean())

    got = registry.per_key(nulled, fn, "Symbol string, seq long, m double", SMALL, back=4)
    alike(got, "seq", "m")
    pdf = nulled.where("Symbol = 'A'").toPandas().sort_values("seq")
    want = pdf["mid"].rolling(5).mean()
    have = {r.seq: r.m for r in got.where("Symbol = 'A'").collect()}
    assert all((have[i] is None) == math.isnan(w) and (math.isnan(w) or have[i] == pytest.approx(w)) for i, w in zip(pdf["seq"], want))


def test_stream_lookback_is_checked(nulled):
    with pytest.raises(ValueError, match="back"):
        ticks.stream_operator(nulled, indicators.sma("mid", 20), 10, "x", "y", "z")


# --- regimes on growing history ---


def brute_regimes(x, step, k, rounds):
    """A fit per cut on all rows before it (columns are rows of one key, by place)."""
    out, n = [], len(x)
    last = max(n // step, 1) - 1
    for i in range(n):
        cut = min(i // step, last)
        history = x[: (cut + 1) * step] if n >= step else x
        centre, _ = mljobs.weighted_centres(history, np.ones(len(history)), k, rounds)
        centre = centre[np.argsort(centre[:, 0], kind="stable")]
        out.append(int(((centre - x[i]) ** 2).sum(axis=1).argmin()))
    return out


@pytest.mark.parametrize("n,step", [(900, 100), (50, 100), (430, 7)])
def test_regimes_against_a_fit_per_cut(spark, monkeypatch, n, step):
    """Few distinct points: nothing is lost in merging, over several spans of blocks."""
    monkeypatch.setattr(mljobs, "SPAN", 4)
    rng = np.random.default_rng(n)
    x = np.round(np.concatenate([rng.normal(m, 1, (n // 3 + 1, 2)) for m in (0, 4, 9)])[rng.permutation(n)], 0)[:n]
    df = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=i), i, float(a), float(b)) for i, (a, b) in enumerate(x)], "Symbol string, Timestamp timestamp_ntz, seq long, x double, y double").repartition(4)
    got = {r.seq: r.regime for r in mljobs.regimes(df, ["x", "y"], 3, step).collect()}
    assert [got[i] for i in range(n)] == brute_regimes(x, step, 3, 50)


def test_regimes_of_many_points(spark):
    """Compressed history still parts clear groups; NULLs and NULL keys stay; empty tables too."""
    rng = np.random.default_rng(1)
    rows = [(key, T0 + dt.timedelta(minutes=i), i, float(rng.normal((0, 50, 100)[i % 3], 1)) if i % 3 or i % 30 else None) for key in ("A", None) for i in range(1500)]
    df = spark.createDataFrame(rows, "Symbol string, Timestamp timestamp_ntz, seq long, x double")
    got = mljobs.regimes(df, ["x"], 3, 200, features=32).collect()
    assert len(got) == 3000 and all(r.regime == r.seq % 3 for r in got)
    assert mljobs.regimes(df.where("false"), ["x"]).count() == 0


def test_weighted_centres():
    x = np.array([[0.0], [1.0], [10.0], [11.0], [10.0]])
    centre, weight = mljobs.weighted_centres(x, np.array([1.0, 1, 1, 1, 2]), 2, 10)
    assert centre.ravel().tolist() == [0.5, 10.25] and weight.tolist() == [2, 4]
    centre, weight = mljobs.weighted_centres(x, np.ones(5), 9, 10)
    assert len(centre) == 4 and weight.tolist() == [1, 1, 2, 1]


# --- quarantine and compaction ---


def test_quarantine_in_one_pass(spark, nulled, tmp_path):
    df = nulled.withColumn("mid", F.when(F.col("seq") % 4 != 0, F.col("mid")))
    suite = {"expectations": [{"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": x}} for x in ("mid", "Symbol", "nowhere")]}
    target = str(tmp_path / "t")
    report, digest = stores.quarantine(df, suite, target)
    assert [(r.unexpected, r.success) for r in report.collect()] == [(30, False), (60, False), (120, False)]
    good, bad = stores.good_rows(spark, target), stores.bad_rows(spark, target)
    assert good.columns == bad.columns == df.columns
    assert good.count() == 45 and good.where("mid is null or Symbol is null").count() == 0 and bad.count() == 75
    assert digest == stores.table_hash(df).first()["hash"]


def files_by_date(path):
    return {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in path.glob("date=*")}


def test_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    path, staging = tmp_path / "t", str(tmp_path / "s")
    rows = [(T0 + dt.timedelta(days=d, minutes=i), i) for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, seq long").withColumn("date", F.to_date("Timestamp"))
    df.where("date < '2024-01-03'").repartition(6).write.partitionBy("date").parquet(str(path))
    df.where("date = '2024-01-03'").coalesce(1).write.mode("append").partitionBy("date").parquet(str(path))
    before = files_by_date(path)
    assert len(before["date=2024-01-01"]) > 1 and len(before["date=2024-01-03"]) == 1

    def broken(*_):
        raise RuntimeError("lost")

    import shutil

    with monkeypatch.context() as m:  # breaks off when the first partition is gone and the new files are not there yet
        from pyspark.sql.readwriter import DataFrameWriter

        write = DataFrameWriter.parquet

        def parquet(self, to, *a, **k):
            if to == str(path):
                shutil.rmtree(path / "date=2024-01-01")
                broken()
            return write(self, to, *a, **k)

        m.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(RuntimeError):
            stores.compact(spark, str(path), staging, 100)
    assert spark.read.parquet(str(path)).count() == 80
    stores.compact(spark, str(path), staging, 100)  # finishes from what is staged
    after = files_by_date(path)
    assert after["date=2024-01-03"] == before["date=2024-01-03"] and [len(v) for v in after.values()] == [1, 1, 1]
    assert sorted((r.Timestamp, r.seq) for r in spark.read.parquet(str(path)).collect()) == sorted(rows)
    stores.compact(spark, str(path), staging, 100)  # nothing crowded: nothing is written
    assert files_by_date(path) == after
