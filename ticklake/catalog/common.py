"""Registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


class Tables:
    """The given tables and the market tables derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def ticks(self) -> DataFrame:
        e = self.events
        k = F.get_json_object("props", "$.k").cast("double")
        return e.select(
            F.col("event_id").alias("seq"),
            F.col("ts").alias("Timestamp"),
            F.col("event_type").alias("Symbol"),
            F.col("user_id"),
            F.col("value").alias("mid"),
            F.col("value").alias("Close"),
            (F.col("value") - 0.01).alias("Bid"),
            (F.col("value") + 0.01).alias("Ask"),
            (F.col("value") + k * 0.01).alias("High"),
            (F.col("value") - k * 0.01).alias("Low"),
            k.alias("Volume"),
            k.alias("BidVolume"),
            (F.col("user_id") % 50 + 1).cast("double").alias("AskVolume"),
        )

    @property
    def quotes(self) -> DataFrame:
        """Ticks whose spread varies."""
        return self.ticks.withColumn("Ask", F.col("mid") + 0.01 + F.col("Volume") * 0.0005)

    @property
    def preds(self) -> DataFrame:
        """Scored rows: probability, outcome, regime and a value."""
        t = self.ticks
        return t.select(
            F.col("seq").alias("id"),
            "Timestamp",
            (F.col("Volume") / 100).alias("prob"),
            (F.col("mid") > 20).cast("int").alias("y"),
            (F.col("user_id") % 3).cast("int").alias("regime"),
            F.col("Symbol").alias("model"),
            F.col("mid").alias("value"),
        )

    @property
    def hourly(self) -> DataFrame:
        """Last mid per symbol and hour: a table with equal times across symbols."""
        t = self.ticks.groupBy("Symbol", F.date_trunc("hour", "Timestamp").cast("timestamp_ntz").alias("Timestamp"))
        return t.agg(F.max_by("mid", F.struct("Timestamp", "seq")).alias("Close")).withColumn("seq", F.lit(0).cast("long"))

    @property
    def fills(self) -> DataFrame:
        """Line items as fills; ``fid`` orders them fully (rows alike in all columns are interchangeable)."""
        li = self.lineitem
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("symbol"),
            F.col("l_suppkey").alias("broker"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
            F.col("l_quantity").alias("volume"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_shipdate").alias("Timestamp"),
        )

    @property
    def trades(self) -> DataFrame:
        o = self.orders
        return o.select(
            F.col("o_orderkey").alias("trade_id"),
            F.col("o_custkey").alias("customer"),
            F.col("o_orderpriority").alias("model"),
            F.col("o_orderstatus").alias("regime"),
            F.col("o_orderdate").alias("exit_time"),
            ((F.col("o_totalprice") - 250000.0) / 1000.0).alias("pnl"),
        )


TICKS_SQL = """t AS (SELECT event_id AS seq, ts AS "Timestamp", event_type AS "Symbol", user_id, value AS mid, value AS "Close",
 value-0.01 AS "Bid", value+0.01 AS "Ask", value + k*0.01 AS "High", value - k*0.01 AS "Low", k AS "Volume", k AS "BidVolume",
 CAST(user_id%50+1 AS DOUBLE) AS "AskVolume", row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i
 FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k FROM events))"""
QUOTES_SQL = TICKS_SQL + """, q AS (SELECT * REPLACE (mid + 0.01 + "Volume"*0.0005 AS "Ask") FROM t)"""
PREDS_SQL = TICKS_SQL + """, p AS (SELECT seq AS id, "Timestamp", "Volume"/100 AS prob, CAST(mid>20 AS INT) AS y, CAST(user_id%3 AS INT) AS regime, "Symbol" AS model, mid AS value FROM t)"""
HOURLY_SQL = """h AS (SELECT event_type AS "Symbol", date_trunc('hour', ts) AS "Timestamp", arg_max(value, (ts, event_id)) AS "Close" FROM events GROUP BY 1,2)"""
FILLS_SQL = """f AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS symbol, l_suppkey AS broker,
 CASE WHEN l_returnflag='R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS volume, l_extendedprice/l_quantity AS price,
 l_discount AS discount, l_tax AS tax, l_shipdate AS "Timestamp" FROM lineitem)"""
TRADES_SQL = """tr AS (SELECT o_orderkey AS trade_id, o_custkey AS customer, o_orderpriority AS model, o_orderstatus AS regime,
 o_orderdate AS exit_time, (o_totalprice-250000.0)/1000.0 AS pnl FROM orders)"""
# window of a symbol in time order
W = 'PARTITION BY "Symbol" ORDER BY "Timestamp", seq'


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def rr(*cols: str, nd: int | None = 6) -> str:
    """Rounded output columns for the SQL side; ``name=expr`` or ``name``."""
    out = []
    for c in cols:
        name, _, expr = c.partition("=")
        if nd is None:  # single precision: for values whose last decimals are exact halves
            out.append(f"CAST({expr or name} AS FLOAT) + CAST(0.0 AS FLOAT) AS {name}")
        else:
            out.append(f"round({expr or name}, {nd}) + 0.0 AS {name}")
    return ", ".join(out)


def shown(df: DataFrame, keys: str, cols: str, nd: int | None = 6) -> DataFrame:
    """Key columns as they are, value columns rounded."""
    return df.select(*keys.split(), *[rd(F.col(x), nd).alias(x) for x in cols.split()])


def rd(x: Column, nd: int | None = 6) -> Column:
    if nd is None:
        return x.cast("float") + F.lit(0.0).cast("float")
    return F.round(x.cast("double"), nd) + F.lit(0.0)


def full_sql(agg: str, x: str, n: int, w: str = W) -> str:
    """Rolling aggregate that is NULL until all ``n`` values are there."""
    frame = f"({w} ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"
