"""Sinks and table stores on Parquet (IO06, IO08-IO12, IO22-IO29)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scans import path_exists, remove

c = F.col


def save_by_date(df: DataFrame, path: str, ts: str = "Timestamp", mode: str = "append", rows_per_file: int = 20_000_000, tasks_per_day: int = 16) -> None:
    """IO06/IO09 append to ``date`` partitions with zstd.

    A day is spread over a few tasks by a hash, so a busy day is not one
    writer; ``maxRecordsPerFile`` bounds the files.
    """
    d = df.withColumn("date", F.to_date(ts)).withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(tasks_per_day)))
    d = d.repartition("date", "__s").drop("__s").sortWithinPartitions("date", ts)
    d.write.mode(mode).partitionBy("date").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def new_rows(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IO08/IO24 rows whose key is not in ``seen``; each key once."""
    return df.dropDuplicates(list(keys)).join(seen.select(*keys), list(keys), "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """IO24 append rows of new keys only; running it twice adds nothing."""
    spark = df.sparkSession
    out = new_rows(df, spark.read.parquet(path), keys) if path_exists(spark, path) else df.dropDuplicates(list(keys))
    out.write.mode("append").parquet(path)


def crowded(spark: SparkSession, path: str, target_rows: int) -> DataFrame:
    """IO11 ``date, files, wanted`` of the partitions that have more files than their rows need."""
    d = spark.read.parquet(path).groupBy("date", c("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    d = d.groupBy("date").agg(F.count("file").alias("files"), F.greatest(F.ceil(F.sum("n") / target_rows), F.lit(1).cast("long")).alias("wanted"))
    return d.where("files > wanted")


def compact(spark: SparkSession, path: str, staging: str, target_rows: int = 5_000_000) -> None:
    """IO11 rewrite the crowded partitions of a date-partitioned table with few files; the others keep theirs.

    The new files are complete in ``staging`` before a partition is touched, and
    stay there until all are swapped in.  If that breaks off, the next call with the
    same ``staging`` finishes it, so nothing is lost in between.  One writer at a time.
    """
    zstd = {"compression": "zstd"}
    if not path_exists(spark, f"{staging}/_SUCCESS"):
        many = crowded(spark, path, target_rows)
        if many.isEmpty():
            return
        df = spark.read.parquet(path)
        d = df.join(many.select("date", "wanted"), "date").withColumn("__s", F.pmod(F.xxhash64(*df.columns), c("wanted")))
        d.repartition("date", "__s").drop("__s", "wanted").write.mode("overwrite").partitionBy("date").options(**zstd).parquet(staging)
    done = spark.read.parquet(staging)
    done.write.mode("overwrite").partitionBy("date").options(partitionOverwriteMode="dynamic", **zstd).parquet(path)
    remove(spark, staging)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    """IO12 migrate tick CSV files."""
    from .scans import tick_csv

    save_by_date(tick_csv(spark, source), target)


# ---------------------------------------------------------------- event and metric logs


def record_events(df: DataFrame, path: str) -> None:
    """IO22 append (timestamp, type, payload) rows by type and date."""
    d = df.select("timestamp", "type", "payload", F.to_date("timestamp").alias("date"))
    d.repartition("type", "date").write.mode("append").partitionBy("type", "date").parquet(path)


def replay_events(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """IO22 events of a type (a pruned read), with the payload parsed by ``schema``."""
    df = spark.read.parquet(path)
    if kind is not None:
        df = df.where(c("type") == kind)
    return df if schema is None else df.withColumn("payload", F.from_json("payload", schema))


def record_metrics(df: DataFrame, path: str) -> None:
    """IO23 append metric rows; tags are a map, so new tags need no schema change."""
    df.select("timestamp", "name", "value", "tags", F.to_date("timestamp").alias("date")).write.mode("append").partitionBy("date").parquet(path)


def query_metrics(df: DataFrame, name: str | None = None, start: Column | None = None, end: Column | None = None, tags: Mapping[str, str] | None = None) -> DataFrame:
    """IO23 metrics by name, time and tags; an unknown tag finds nothing."""
    if name is not None:
        df = df.where(c("name") == name)
    if start is not None:
        df = df.where(c("timestamp") >= start)
    if end is not None:
        df = df.where(c("timestamp") <= end)
    for k, v in (tags or {}).items():
        df = df.where(F.coalesce(c("tags")[k] == v, F.lit(False)))
    return df


def to_messages(df: DataFrame, key: str | None = None, interval: Sequence[str] | None = None) -> DataFrame:
    """IO25 rows as JSON messages (``key``, ``value``); mean and bounds wrapped as one struct."""
    if interval:
        mean, low, high = interval
        df = df.withColumn(mean, F.struct(c(mean).alias("mean"), c(low).alias("lower"), c(high).alias("upper"))).drop(low, high)
    k = c(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def from_messages(df: DataFrame, schema: str) -> DataFrame:
    """IO25 messages back to rows."""
    return df.select(F.from_json(c("value").cast("string"), schema).alias("m")).select("m.*")


# ---------------------------------------------------------------- versions, hashes, lineage


def hash_sums(df: DataFrame) -> list[Column]:
    """IO28 row count and the sums of two row hashes."""
    cols = [c(x) for x in sorted(df.columns)]
    wide = lambda x: F.coalesce(F.sum(x.cast("decimal(20,0)")).cast("string"), F.lit("0"))
    return [F.count(F.lit(1)).alias("rows"), wide(F.xxhash64(*cols)).alias("h1"), wide(F.hash(*cols)).alias("h2")]


def table_hash(df: DataFrame) -> DataFrame:
    """IO28 order-free content hash: sums of two row hashes and the row count."""
    return df.agg(*hash_sums(df)).select("rows", F.sha2(F.concat_ws("|", c("rows").cast("string"), "h1", "h2"), 256).alias("hash"))


def config_hash(config: Mapping) -> str:
    """IO28 hash of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class FeatureTables:
    """IO26/IO27 versioned feature tables: a folder per version and an index table."""

    SCHEMA = "version string, created timestamp, config string, raw_hash string, rows long, dropped boolean"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.index = spark, root, f"{root}/_index"

    def _log(self, version: str, config: Mapping, raw_hash: str, rows: int, dropped: bool) -> None:
        row = self.spark.createDataFrame(
            [(version, json.dumps(config, sort_keys=True, default=str), raw_hash, rows, dropped)],
            "version string, config string, raw_hash string, rows long, dropped boolean",
        )
        row.withColumn("created", F.current_timestamp()).write.mode("append").parquet(self.index)

    def versions(self) -> DataFrame:
        """Live versions, the newest entry of each."""
        if not path_exists(self.spark, self.index):
            return self.spark.createDataFrame([], self.SCHEMA)
        d = self.spark.read.parquet(self.index)
        last = d.groupBy("version").agg(F.max_by(F.struct("created", "config", "raw_hash", "rows", "dropped"), "created").alias("r"))
        return last.select("version", "r.*").where(~c("dropped"))

    def register(self, df: DataFrame, config: Mapping, raw_hash: str = "") -> str:
        version = config_hash({"config": config, "raw": raw_hash})[:16]
        path = f"{self.root}/{version}"
        df.write.mode("overwrite").parquet(path)
        self._log(version, config, raw_hash, self.spark.read.parquet(path).count(), False)
        return version

    def load(self, version: str) -> DataFrame:
        if self.versions().where(c("version") == version).limit(1).count() == 0:
            raise KeyError(version)
        return self.spark.read.parquet(f"{self.root}/{version}")

    def latest(self) -> str | None:
        row = self.versions().orderBy(c("created").desc()).limit(1).collect()
        return row[0]["version"] if row else None

    def purge(self, version: str) -> None:
        """Take a version out of the index; its files are for the storage's own clean-up."""
        self._log(version, {}, "", 0, True)

    def get_or_set(self, config: Mapping, raw_hash: str, build) -> DataFrame:
        """IO27 the stored table of (config, raw data), built only on a miss."""
        version = config_hash({"config": config, "raw": raw_hash})[:16]
        try:
            return self.load(version)
        except KeyError:
            self.register(build(), config, raw_hash)
            return self.load(version)


def log_lineage(spark: SparkSession, path: str, rows: Sequence[tuple[str, str, str, str]]) -> None:
    """IO29 append (run, raw file, transform, output column) rows, once per job."""
    d = spark.createDataFrame(list(rows), "run_id string, raw_file string, transform string, output string")
    d.withColumn("logged", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def lineage(spark: SparkSession, path: str, run_id: str | None = None, output: str | None = None) -> DataFrame:
    """IO29 lineage rows by run or output column."""
    d = spark.read.parquet(path)
    if run_id is not None:
        d = d.where(c("run_id") == run_id)
    return d if output is None else d.where(c("output") == output)


def quarantine(df: DataFrame, suite: Mapping, target: str, ts: str = "Timestamp") -> tuple[DataFrame, str]:
    """F10/IO31 store ``df`` under ``target`` by ``quarantined`` and date: rows that break an expectation apart from the others.

    One pass: the report's counts and the content hash of the rows are observed
    while they are written.  Gives the report and the hash; ``good_rows`` and ``bad_rows`` read the two sides.
    """
    from ..operators.quality import expectation_counts, expectation_report, row_expectations

    bad: Column = F.lit(False)
    for broken in row_expectations(df, suite).values():
        bad = bad | broken
    seen = Observation()
    counts = expectation_counts(df, suite)
    d = df.observe(seen, *counts, *hash_sums(df)).withColumn("quarantined", bad).withColumn("date", F.to_date(ts))
    d.write.mode("append").partitionBy("quarantined", "date").option("compression", "zstd").parquet(target)
    got = seen.get
    names = [n for n in got if n.startswith("__")]
    row = df.sparkSession.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"`{n}` long" for n in names))
    return expectation_report(row, df.columns, suite), hashlib.sha256("|".join(str(got[n]) for n in ("rows", "h1", "h2")).encode()).hexdigest()


def _side(spark: SparkSession, target: str, bad: bool) -> DataFrame:
    return spark.read.parquet(target).where(c("quarantined") == bad).drop("quarantined", "date")


def good_rows(spark: SparkSession, target: str) -> DataFrame:
    """F10 the rows under ``target`` that met all expectations."""
    return _side(spark, target, False)


def bad_rows(spark: SparkSession, target: str) -> DataFrame:
    """F10 the rows under ``target`` that broke one."""
    return _side(spark, target, True)


def ingest(spark: SparkSession, raw: str, target: str, suite: Mapping, lineage_path: str, run_id: str) -> DataFrame:
    """IO31 read raw CSV once: check expectations, store good and bad rows apart, record hash and lineage; gives the report."""
    from .scans import tick_csv

    df = tick_csv(spark, raw)
    report, digest = quarantine(df, suite, target)
    log_lineage(spark, lineage_path, [(run_id, raw, "ingest", x) for x in df.columns] + [(run_id, raw, "hash", digest)])
    return report.withColumn("run_id", F.lit(run_id))
