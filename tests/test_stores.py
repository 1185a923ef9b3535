"""Round trips of sinks and stores."""

import tempfile

from pyspark.sql import functions as F

from ticklake.sources import scans, stores

c = F.col


def tmp():
    return tempfile.mkdtemp(prefix="store-") + "/t"


def test_sink_compaction_and_incremental_read(spark, ticks):
    p = tmp()
    for i in range(3):
        stores.save_by_date(ticks.where(c("seq") % 3 == i), p)
    stores.compact(spark, p, tmp())
    assert scans.tick_parquet(spark, p).count() == ticks.count()
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    d = scans.since(spark, p, cut, 1)
    assert d.where("is_new").count() == ticks.where(c("Timestamp") > cut).count()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_append_is_idempotent(spark, ticks):
    p = tmp()
    for _ in range(2):
        stores.append_new(ticks, p, ["seq"])
    assert spark.read.parquet(p).count() == ticks.count()


def test_hash_ignores_order_and_sees_changes(spark, ticks):
    h = lambda d: stores.table_hash(d).first()["hash"]
    assert h(ticks) == h(ticks.orderBy(c("seq").desc()))
    assert h(ticks) != h(ticks.withColumn("mid", F.when(c("seq") == 5, 0.0).otherwise(c("mid"))))


def test_feature_tables(spark, ticks):
    s = stores.FeatureTables(spark, tmp())
    v = s.register(ticks, {"n": 1}, "raw")
    assert s.latest() == v and s.load(v).count() == ticks.count()
    assert s.get_or_set({"n": 1}, "raw", lambda: 1 / 0).count() == ticks.count()
    s.purge(v)
    assert s.latest() is None


def test_context_csv_and_fallback(spark, ticks):
    import os

    root = tempfile.mkdtemp(prefix="ctx-")
    os.makedirs(f"{root}/esg")
    with open(f"{root}/esg/AAA.csv", "w") as f:
        f.write("day,esg\n2024-01-01,1.5\nbad,2\n2024-01-02,x\n")
    got = scans.context_csv(spark, f"{root}/esg", "esg").orderBy("Date").collect()
    assert [(r["Symbol"], r["esg"]) for r in got] == [("AAA", 1.5), ("AAA", None)]
    ticks.select("Timestamp", "mid").write.parquet(f"{root}/BBB.parquet")
    assert scans.first_source(spark, "BBB", root).count() == ticks.count()


def test_series_specs_and_observation_maps(spark):
    assert scans.series_spec("fred::GDP?units=pc1&x=2") == {"provider": "fred", "id": "GDP", "params": {"units": "pc1", "x": "2"}}
    text = '{"obs": {"0": [1.5], "1": [null], "2": [3.0]}, "dates": [{"id": "2024-01"}, {"id": "2024-02"}, {"id": "2024-03-05"}]}'
    d = spark.createDataFrame([(text,)], "value string")
    got = [(str(r["Date"]), r["value"]) for r in scans.landed_observations(d, "obs", "dates").orderBy("Date").collect()]
    assert got == [("2024-01-01", 1.5), ("2024-03-05", 3.0)]
