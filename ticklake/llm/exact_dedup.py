"""Exact deduplication with keyed streaming state on disk."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.scans import path_exists
from .common import keep, shared_folder

# State lives in RocksDB files of the executors, with its log in the shared
# folder: a lost executor loads it from there.  Nothing in it expires.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition holds megabytes of empty space
}
BATCH_BYTES = 4 << 30  # of landed keys (about 100 bytes a row) in a micro-batch
ROWS_PER_SALT = 1_000  # copies that are compared with one copy of the kept text

KEY = "digest binary, missing boolean, doc_id long, file string, row long"


def normalised(text: str = "text") -> Column:
    """Runs of space and 0x09-0x0D become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def with_locator(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file, __row``, where each row's content lies; a frame that is no Parquet scan is written first."""
    at = (F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    try:
        return docs.select("*", *at)
    except AnalysisException:
        return keep(docs).select("*", *at)


def update_index(spark: SparkSession, landed: str, folder: str) -> DataFrame:
    """Stream the keys landed so far into the state of ``folder``; return the index of all keys ever seen.

    State per digest: identifier and content locator of its smallest document,
    and the number of rows.  A later call goes on from the state of the last one.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in STATE.items():
        own.conf.set(key, value)
    keys = own.readStream.schema(KEY).option("maxBytesPerTrigger", BATCH_BYTES).parquet(landed)
    first = F.min(F.struct("missing", "doc_id", "file", "row")).alias("first")
    seen = keys.groupBy("digest").agg(first, F.count("*").alias("size"))

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    run = seen.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start()
    run.awaitTermination()
    changes = spark.read.schema("digest binary, first struct<missing boolean, doc_id long, file string, row long>, size long, batch long").parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max_by(F.struct("first", "size"), "batch").alias("s")).select("digest", "s.first", "s.size")


def landed_before(spark: SparkSession, keys: DataFrame, located: DataFrame) -> DataFrame:
    """``text, doc_id, __file, __row`` of the rows that earlier calls landed, fetched by their locators from their own files."""
    here = located.select(F.col("__file").alias("file")).distinct()
    files = [unquote(r.file) for r in keys.select("file").distinct().join(here, "file", "left_anti").collect()]  # names only
    if not files:
        return located.select("text", "doc_id", "__file", "__row").limit(0)
    read = spark.read.parquet(*files).select(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return read.join(keys.select(F.col("file").alias("__file"), F.col("row").alias("__row")), ["__file", "__row"], "left_semi").select("text", "doc_id", "__file", "__row")


def exact_duplicates(docs: DataFrame, *, digest=sha256, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(docs with locators, verdicts)`` of ``docs(doc_id, text)``.

    Verdicts, one per row: ``doc_id, keep_id, group_size, kept, digest, __file,
    __row``.  Texts are equal if they are identical after :func:`normalised`; of
    equal texts the row with the smallest doc_id stays.

    The scan lands a narrow key per row (digest, id, locator), which a streaming
    aggregation takes into its keyed state.  Rows of digests that came more than
    once are hits: their whole bytes are compared with those of the kept row,
    which is found by its locator and copied once per ``ROWS_PER_SALT`` hits, so
    that a group with very many copies is dealt over many tasks.  Rows with other
    bytes (a collision of ``digest``) are grouped anew by their bytes.

    With ``folder``, a call goes on from the state that earlier calls left there, and
    the verdicts cover their rows too; texts that were kept then are read from
    their own files, which must still be there.

    Null text counts as empty, and empty texts are equal.  A null doc_id sorts
    last; of rows with equal ids and texts one stays.  Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    located = with_locator(docs)
    text = normalised()
    ident = F.col("doc_id").cast("long")
    landed = f"{folder}/landed"
    goes_on = path_exists(spark, landed)
    keys = located.select(digest(text).alias("digest"), ident.isNull().alias("missing"), ident.alias("doc_id"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    keys.write.mode("append").parquet(landed)
    keys = spark.read.schema(KEY).parquet(landed)
    index = keep(update_index(spark, landed, folder))

    twice = index.where("size > 1").select("digest", F.col("first.file").alias("kfile"), F.col("first.row").alias("krow"), F.ceil(F.col("size") / ROWS_PER_SALT).cast("int").alias("salts"))
    rows = located.select("text", "doc_id", "__file", "__row")
    if goes_on:
        rows = rows.unionByName(landed_before(spark, keys, located))
    hits = rows.select(digest(text).alias("digest"), text.alias("text"), ident.alias("doc_id"), F.col("__file").alias("file"), F.col("__row").alias("row")).join(twice, "digest")
    first = (F.col("file") == F.col("kfile")) & (F.col("row") == F.col("krow"))
    stays = hits.where(first).select("digest", F.col("text").alias("ktext"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = hits.where(~first).select("digest", "text", "doc_id", "file", "row", F.pmod(F.xxhash64("file", "row"), "salts").cast("int").alias("salt"))
    odd = keep(other.join(stays, ["digest", "salt"]).where("text != ktext").select("digest", "text", "doc_id", "file", "row"))

    found = keys.join(index, "digest").select("digest", "doc_id", "file", "row", "first", "size")
    if not odd.isEmpty():  # never with a sound digest
        own = odd.groupBy("digest", "text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "file", "row")).alias("f2"), F.count("*").alias("s2"))
        odd_rows = odd.join(own, ["digest", "text"]).select("file", "row", "f2", "s2")
        lost = odd.groupBy("digest").agg(F.count("*").alias("lost"))
        found = found.join(lost, "digest", "left").join(odd_rows, ["file", "row"], "left")
        found = found.select("digest", "doc_id", "file", "row", F.coalesce("f2", "first").alias("first"), F.coalesce(F.col("s2"), F.col("size") - F.coalesce("lost", F.lit(0))).alias("size"))
    kept = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    return located, found.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "digest", F.col("file").alias("__file"), F.col("row").alias("__row"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    located, verdicts = exact_duplicates(docs)
    gone = keep(verdicts.where(~F.col("kept")).select("__file", "__row"))
    return located.join(gone, ["__file", "__row"], "left_anti").select(*docs.columns)
