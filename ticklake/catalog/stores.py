"""Queries over scans, sinks and stores (IO): tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.ordered import with_row
from ..session import shared_folder
from ..sources import scans, stores
from .common import TICKS_SQL, query, rr, with_

c = F.col


@query("io02_parquet_scan", "SELECT event_id, ts AS \"Timestamp\", value FROM events")
def _(t):
    p = shared_folder(t.spark)
    t.events.select("event_id", c("ts").alias("Timestamp"), "value").write.parquet(p)
    return scans.tick_parquet(t.spark, p)


@query("io01_csv_scan", with_(TICKS_SQL) + """SELECT time_bucket(INTERVAL '1 millisecond', "Timestamp") AS "Timestamp", count(*) AS n, round(sum("Bid"),4) AS bid FROM t GROUP BY 1""")
def _(t):
    p = shared_folder(t.spark)
    d = t.ticks.select(F.date_format("Timestamp", "yyyyMMdd HH:mm:ss:SSS").alias("Timestamp"), "Bid", "Ask", "BidVolume", "AskVolume")
    d.write.csv(p, header=True)
    d = scans.tick_csv(t.spark, p)
    return d.groupBy("Timestamp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Bid"), 4).alias("bid"))


@query("io06_date_sink", 'SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1')
def _(t):
    p = shared_folder(t.spark)
    stores.save_by_date(t.ticks, p)
    return t.spark.read.parquet(p).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("io07_incremental", "SELECT event_id AS seq, ts>TIMESTAMP '2024-01-20 06:00:00' AS is_new FROM events WHERE ts>=TIMESTAMP '2024-01-18 06:00:00'")
def _(t):
    p = shared_folder(t.spark)
    stores.save_by_date(t.ticks, p)
    return scans.since(t.spark, p, F.lit("2024-01-20 06:00:00").cast("timestamp_ntz"), 2).select("seq", "is_new")


@query("io08_delta", "SELECT event_id AS seq FROM events WHERE event_id%3<>0")
def _(t):
    return stores.new_rows(t.ticks, t.ticks.where("seq % 3 = 0"), ["seq"]).select("seq")


@query("io11_compaction", 'SELECT CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value),4) AS v FROM events GROUP BY 1')
def _(t):
    p, staging = shared_folder(t.spark), shared_folder(t.spark)
    stores.save_by_date(t.ticks, p)
    stores.compact(t.spark, p, staging)
    return t.spark.read.parquet(p).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mid"), 4).alias("v"))


@query("io13_book_arrays", with_(TICKS_SQL) + "SELECT seq, mid-0.01 AS best_bid, mid+0.02 AS best_ask FROM t")
def _(t):
    from .market import _book

    return _book(t).select("seq", c("bids")[0]["px"].alias("best_bid"), c("asks")[0]["px"].alias("best_ask"))


@query("io18_macro_long", "SELECT CAST(ts AS DATE) AS \"Date\", event_type AS \"Region\", u.s AS series, round(avg(CASE WHEN u.s='gdp' THEN value ELSE value/2 END),6) AS value FROM events, (VALUES ('gdp'),('cpi')) u(s) GROUP BY ALL")
def _(t):
    from ..operators.context import macro_long
    from .common import rd

    w = t.events.groupBy(F.to_date("ts").alias("Date"), c("event_type").alias("Region")).agg(F.avg("value").alias("gdp"), (F.avg("value") / 2).alias("cpi"))
    return macro_long(w, ["gdp", "cpi"]).withColumn("value", rd(c("value")))


@query("io19_records", "SELECT CAST(ts AS DATE) AS \"Date\", value FROM events WHERE event_id%7<>0")
def _(t):
    """Each event as the payload of one provider, by turns."""
    day, v = F.to_date("ts").cast("string"), F.when(c("event_id") % 7 == 0, ".").otherwise(c("value").cast("string"))
    fill = lambda text, *xs: F.concat(*[y for i, p in enumerate(text.split("~")) for y in ([xs[i - 1]] if i else []) + [F.lit(p)]])
    sdmx = ',"structure":{"dimensions":{"observation":[{"id":"geo","values":[{"id":"UK"}]},{"id":"TIME_PERIOD","values":[{"id":"1999"},{"id":"~"}]}]}}}'
    payloads = {
        "fred": fill('{"observations":[{"date":"~","value":"~"}]}', day, v),
        "worldbank": fill('[{"page":1},[{"date":"~","value":"~"}]]', day, v),
        "imf": fill('{"CompactData":{"DataSet":{"Series":{"Obs":[{"@TIME_PERIOD":"~","@OBS_VALUE":"~"}]}}}}', day, v),
        "finnhub": fill('[{"datetime":~,"value":"~"}]', (F.unix_date(F.to_date("ts")).cast("long") * 86_400).cast("string"), v),
        "bcb": fill('[{"data":"~","valor":"~"}]', F.date_format("ts", "dd/MM/yyyy"), F.translate(v, ".", ",")),
        "statcan": fill('{"vectorDataPoints":[{"vectorId":"v1","refPer2":"~","value":"~"}]}', day, v),
        "bankofcanada": fill('{"observations":[{"d":"~","FX":{"v":"~"}}]}', day, v),
        "opencanada": fill('{"result":{"records":[{"_id":1,"REF_DATE":"~","VALUE":"~"}]}}', day, v),
        "ons": fill('{"observations":[{"dimensions":{"time":{"id":"time","option":{"id":"~"}}},"observation":"~"}]}', day, v),
        "dbnomics": fill('{"series":{"docs":[{"period_start_day":["~"],"value":["~"]}]}}', day, v),
        "eurostat": fill('{"dataSets":[{"observations":{"0:1":["~"]}}]' + sdmx, v, day),
        "ecb": fill('{"dataSets":[{"series":{"0:0":{"observations":{"1":["~"]}}}}]' + sdmx, v, day),
    }
    out = None
    for k, (shape, text) in enumerate(payloads.items()):
        rows = scans.landed_records(t.events.where(F.pmod("event_id", F.lit(len(payloads))) == k).select(text.alias("value")), shape)
        out = rows if out is None else out.union(rows)
    return out


@query("io20_market_days", "SELECT CAST(ts AS DATE) AS \"Date\", upper(event_type) AS report_ticker, value AS open_interest, 0.0::DOUBLE AS daily_volume FROM events")
def _(t):
    p = shared_folder(t.spark)
    t.events.select(F.to_date("ts").cast("string").alias("date"), c("event_type").alias("report_ticker"), c("value").alias("open_interest"), F.lit("n/a").alias("daily_volume")).write.json(p)
    raw = t.spark.read.schema(scans.schemas.MARKET_DAY).json(p)
    return scans.typed_market_days(raw).select("Date", "report_ticker", "open_interest", "daily_volume")


@query("io22_event_log", "SELECT ts AS \"timestamp\", CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events WHERE event_type='click'")
def _(t):
    p = shared_folder(t.spark)
    stores.record_events(t.events.select(c("ts").alias("timestamp"), c("event_type").alias("type"), c("props").alias("payload")), p)
    return stores.replay_events(t.spark, p, "click", "k bigint").select("timestamp", c("payload.k").alias("k"))


@query("io23_metrics", "SELECT event_type AS name, count(*) AS n, count(*) FILTER (user_id=7 AND ts>=TIMESTAMP '2024-01-10') AS tagged FROM events GROUP BY 1")
def _(t):
    m = t.events.select(c("event_id").alias("id"), c("ts").alias("timestamp"), c("event_type").alias("name"), "value", F.create_map(F.lit("user"), c("user_id").cast("string")).alias("tags"))
    every = stores.query_metrics(m).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    some = stores.query_metrics(m, None, F.lit("2024-01-10").cast("timestamp_ntz"), None, {"user": "7"}).groupBy("name").agg(F.count(F.lit(1)).alias("tagged"))
    return every.join(some, "name", "left").fillna(0, ["tagged"])


@query("io24_append_once", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def _(t):
    p = shared_folder(t.spark)
    o = t.orders
    stores.append_new(o.where("o_orderkey % 2 = 0"), p, ["o_orderkey"])
    stores.append_new(o, p, ["o_orderkey"])
    stores.append_new(o, p, ["o_orderkey"])
    return t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query("io25_messages", "SELECT event_id AS id, value AS mean, value-1 AS lower, value+1 AS upper FROM events")
def _(t):
    d = t.events.select(c("event_id").alias("id"), c("value").alias("p"), (c("value") - 1).alias("lo"), (c("value") + 1).alias("hi"))
    m = stores.to_messages(d, "id", ("p", "lo", "hi"))
    return stores.from_messages(m, "id bigint, p struct<mean: double, lower: double, upper: double>").select("id", "p.mean", "p.lower", "p.upper")


@query("io26_feature_tables", "SELECT event_id AS seq, value AS mid FROM events")
def _(t):
    store = stores.FeatureTables(t.spark, shared_folder(t.spark))
    store.register(t.ticks.select("seq", "mid"), {"window": 5}, "abc")
    return store.get_or_set({"window": 5}, "abc", lambda: t.ticks.limit(0)).select("seq", "mid")


@query("io28_hash")
def _(t):
    return stores.table_hash(t.ticks)


@query("io29_lineage", "SELECT 'r1' AS run_id, 'events' AS raw_file, 'sma' AS transform, event_type AS output FROM events GROUP BY event_type")
def _(t):
    p = shared_folder(t.spark)
    d = t.events.select(F.lit("r1").alias("run_id"), F.lit("events").alias("raw_file"), F.lit("sma").alias("transform"), c("event_type").alias("output")).distinct()
    d.withColumn("logged", F.current_timestamp()).write.parquet(p)
    return stores.lineage(t.spark, p, "r1").select("run_id", "raw_file", "transform", "output")


def _split_files(t, columns, ext="parquet"):
    """A file (folder) of ticks for each symbol; gives the folder and the symbols."""
    p, names = shared_folder(t.spark), ("click", "error", "purchase", "signup", "view")
    for n in names:
        w = t.ticks.where(c("Symbol") == n).select(*columns).write
        w.csv(f"{p}/{n}.csv", header=True) if ext == "csv" else w.parquet(f"{p}/{n}.parquet")
    return p, names


@query("io04_many_symbols", with_(TICKS_SQL) + 'SELECT "Symbol", seq, mid FROM t')
def _(t):
    p, names = _split_files(t, ["Timestamp", "seq", "mid"])
    return scans.many_symbols(t.spark, {n: f"{p}/{n}.parquet" for n in names}).select("Symbol", "seq", "mid")


@query("io05_first_source", with_(TICKS_SQL) + """SELECT "Symbol", count(*) AS n, round(sum("Bid"),4) AS bid FROM t WHERE "Symbol" IN ('click','view') GROUP BY 1""")
def _(t):
    """One symbol from its Parquet history, one from its CSV."""
    p, fmt = shared_folder(t.spark), F.date_format("Timestamp", "yyyyMMdd HH:mm:ss:SSS").alias("Timestamp")
    t.ticks.where("Symbol = 'click'").write.parquet(f"{p}/click.parquet")
    t.ticks.where("Symbol = 'view'").select(fmt, "Bid", "Ask", "BidVolume", "AskVolume").write.csv(f"{p}/view.csv", header=True)
    d = [scans.first_source(t.spark, s, p).select("Symbol", "Bid") for s in ("click", "view")]
    return d[0].unionByName(d[1]).groupBy("Symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Bid"), 4).alias("bid"))


@query("io12_csv_to_parquet", with_(TICKS_SQL) + 'SELECT CAST("Timestamp" AS DATE) AS date, count(*) AS n, round(sum("Ask"),4) AS ask FROM t GROUP BY 1')
def _(t):
    p, out = shared_folder(t.spark), shared_folder(t.spark)
    d = t.ticks.select(F.date_format("Timestamp", "yyyyMMdd HH:mm:ss:SSS").alias("Timestamp"), "Bid", "Ask", "BidVolume", "AskVolume")
    d.write.csv(p, header=True)
    stores.csv_to_parquet(t.spark, p, out)
    return t.spark.read.parquet(out).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Ask"), 4).alias("ask"))


def _context(t, value, expr):
    """Daily values of every symbol as one CSV for each, read by the context loader and joined as of the ticks."""
    from ..operators.context import add_context
    from .common import shown

    p = shared_folder(t.spark)
    day = t.ticks.groupBy("Symbol", F.to_date("Timestamp").alias("Date")).agg(expr.alias(value))
    for n in ("click", "error", "purchase", "signup", "view"):
        day.where(c("Symbol") == n).select(c("Date").cast("string"), value).coalesce(1).write.csv(f"{p}/{n}", header=True)
    named = {n: t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/{n}") for n in ("click", "error", "purchase", "signup", "view")}
    folder = shared_folder(t.spark)
    for n, path in named.items():  # one file for each symbol, under its name
        fs = path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
        part = next(x.getPath() for x in fs.listStatus(path) if x.getPath().getName().endswith(".csv"))
        to = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.csv")
        fs.mkdirs(to.getParent())
        fs.rename(part, to)
    return shown(add_context(t.ticks, scans.context_csv(t.spark, folder, value), [value]), "seq", value)


def _context_sql(value, expr):
    return with_(TICKS_SQL, f'd AS (SELECT "Symbol", CAST("Timestamp" AS DATE) dt, {expr} v FROM t GROUP BY 1, 2)') + f'SELECT seq, {rr(f"{value}=coalesce(v,0)")} FROM t LEFT JOIN d ON d."Symbol"=t."Symbol" AND d.dt=CAST(t."Timestamp" AS DATE)'


@query("io14_alternative_data", _context_sql("esg_score", "avg(mid)"))
def _(t):
    return _context(t, "esg_score", F.avg("mid"))


@query("io15_corporate_actions", _context_sql("dividend", "max(\"Volume\")/100"))
def _(t):
    return _context(t, "dividend", F.max("Volume") / 100)


@query("io17_options", _context_sql("implied_vol", "min(mid)"))
def _(t):
    return _context(t, "implied_vol", F.min("mid"))


@query("io21_index", """SELECT CAST(ts AS DATE) AS day, round(min(value),4) AS low, round(max(value),4) AS high FROM events GROUP BY 1""")
def _(t):
    p = shared_folder(t.spark)
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.min("value"), 4).alias("low "), F.round(F.max("value"), 4).alias(" high"))
    d.write.csv(p, header=True)
    return scans.index_csv(t.spark, p)


@query("io30_external", with_(TICKS_SQL, 'x AS (SELECT "Timestamp", max(mid) m FROM t WHERE seq%2=0 GROUP BY 1)') + 'SELECT seq, m AS ext_level FROM t LEFT JOIN x USING ("Timestamp")')
def _(t):
    table = t.ticks.where("seq % 2 = 0").groupBy("Timestamp").agg(F.max("mid").alias("level"))
    return scans.external_context(t.ticks, table, {"Timestamp": "Timestamp", "level": "ext_level"}).select("seq", "ext_level")


SUITE = {
    "expectations": [
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "Bid"}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "Volume"}},
        {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
    ]
}
HOLES = """h AS (SELECT seq, CASE WHEN seq%7=0 THEN NULL ELSE "Bid" END b, CASE WHEN seq%5=0 THEN NULL ELSE "Volume" END v FROM t)"""


def _holed(t):
    bid, volume = F.when(c("seq") % 7 != 0, c("Bid")), F.when(c("seq") % 5 != 0, c("Volume"))
    return t.ticks.select("Timestamp", "seq", bid.alias("Bid"), volume.alias("Volume"))


@query("f10_quarantine", with_(TICKS_SQL, HOLES) + "SELECT seq, b IS NULL OR v IS NULL AS quarantined FROM h")
def _(t):
    p = shared_folder(t.spark)
    stores.quarantine(_holed(t), SUITE, p)
    good, bad = (f(t.spark, p).select("seq", F.lit(q).alias("quarantined")) for f, q in ((stores.good_rows, False), (stores.bad_rows, True)))
    return good.unionByName(bad)


@query("f10_quarantine_report", with_(TICKS_SQL, HOLES) + """SELECT 'Bid' AS "column", count(*) FILTER (b IS NULL) AS unexpected FROM h UNION ALL SELECT 'Volume', count(*) FILTER (v IS NULL) FROM h UNION ALL SELECT '', 0""")
def _(t):
    return stores.quarantine(_holed(t), SUITE, shared_folder(t.spark))[0].select("column", "unexpected")


@query("io31_ingest", with_(TICKS_SQL, "g AS (SELECT * FROM t WHERE seq%7<>0)") + 'SELECT count(*) AS good, (SELECT count(*) FROM t WHERE seq%7=0) AS bad, round(sum("Ask"),4) AS ask, 6::BIGINT AS lineage FROM g')
def _(t):
    raw, out, lineage = (shared_folder(t.spark) for _ in range(3))
    bid = F.when(c("seq") % 7 != 0, c("Bid")).alias("Bid")
    t.ticks.select(F.date_format("Timestamp", "yyyyMMdd HH:mm:ss:SSS").alias("Timestamp"), bid, "Ask", "BidVolume", "AskVolume").write.csv(raw, header=True)
    stores.ingest(t.spark, raw, out, {"expectations": SUITE["expectations"][:1]}, lineage, "run")
    d = stores.good_rows(t.spark, out).agg(F.count(F.lit(1)).alias("good"), F.round(F.sum("Ask"), 4).alias("ask"))
    d = with_row(d, stores.bad_rows(t.spark, out).agg(F.count(F.lit(1)).alias("bad")))
    return with_row(d, t.spark.read.parquet(lineage).agg(F.count(F.lit(1)).alias("lineage")))
