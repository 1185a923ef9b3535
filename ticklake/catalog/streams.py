"""Streaming queries (T): the events table arrives in time-ordered files; results equal the batch definition."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import indicators as ind, labels as lab, quality as q
from ..plans.ordered import micros
from ..session import shared_folder
from ..sources.scans import path_exists
from ..streaming import ticks as st
from .quality import F04
from .common import QUOTES_SQL, TICKS_SQL, W, full_sql, query, rr, shown, with_

c = F.col
PIECES, FILES = 4, 4  # files that arrive together make a batch
BATCH_ROWS = 4_000_000  # of a batch whose rows a task sorts by key


def _arrive(t, table=None, even=False, most=None):
    """The table as files that arrive one after the other, and a stream over them; ``even``: pieces of equal time, else of about equal rows.

    ``most``: more pieces than ``PIECES`` where one would have more rows than that.
    """
    d = t.quotes if table is None else table
    pieces = PIECES if most is None else max(PIECES, -(-d.count() // most))
    path = shared_folder(t.spark)
    at = F.coalesce(micros("Timestamp"), F.lit(-(1 << 62)))
    if even:
        lo, hi = d.agg(F.min(micros("Timestamp")), F.max(micros("Timestamp"))).first()
        cuts = [] if lo is None else [lo + (hi - lo) * i // PIECES for i in range(1, PIECES)]
    else:
        cuts = d.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], max(1000, 100 * pieces))).first()[0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):  # the first and the last piece are open
        piece = d if lo is None else d.where(at > lo)
        piece = piece if hi is None else piece.where(at <= hi)
        piece.repartition(FILES).write.mode("append").parquet(path)
    return st.tick_stream(t.spark, path, d.schema, FILES)


def _run(t, stream, **kw):
    out, ck = shared_folder(t.spark), shared_folder(t.spark)
    st.run_available(stream, out, ck, **kw)
    return t.spark.read.parquet(out)


@query("t01_tick_stream", with_(QUOTES_SQL) + 'SELECT seq, mid FROM q')
def _(t):
    return _run(t, _arrive(t).select("seq", "mid"))


@query("t02_stream_features", with_(TICKS_SQL) + f"SELECT seq, {rr('ma_20='+full_sql('avg','mid',20))} FROM t")
def _(t):
    out, state, ck = (shared_folder(t.spark) for _ in range(3))
    st.stream_operator(_arrive(t), ind.sma("mid", 20), 512, out, state, ck)
    return shown(t.spark.read.parquet(out), "seq", "ma_20")


@query("t03_stream_labels", with_(TICKS_SQL, f"s AS (SELECT *, lead(mid,5) OVER ({W}) f5 FROM t)") + "SELECT seq, CAST(CASE WHEN f5/nullif(mid,0)-1>0 THEN 1 ELSE 0 END AS TINYINT) AS direction_5 FROM s")
def _(t):
    out, state, ck = (shared_folder(t.spark) for _ in range(3))
    label = lab.multi_horizon([5])
    st.stream_labels(_arrive(t), label, 5, out, state, ck)
    st.flush_labels(t.spark, label, PIECES - 1, out, state)
    return t.spark.read.parquet(out).select("seq", "direction_5")


@query("t04_stream_filter", "WITH RECURSIVE " + QUOTES_SQL + ", " + F04 + ' SELECT s.seq, s."Symbol" FROM s JOIN r ON s."Symbol"=r."Symbol" AND s.i=r.i WHERE r.ok')
def _(t):
    d = t.quotes.select("Symbol", "Timestamp", "seq", "Bid", "Ask")
    return _run(t, st.filter_stream(_arrive(t, d, most=BATCH_ROWS)).select("seq", "Symbol"))


BATCHES = """p AS (SELECT *, mid AS prediction, mid + sin(seq)*("Volume"-48) AS target FROM q),
 e AS (SELECT min(epoch_us("Timestamp")) lo, max(epoch_us("Timestamp")) hi FROM p),
 d AS (SELECT p.*, (epoch_us("Timestamp")>lo+(hi-lo)//4)::INT + (epoch_us("Timestamp")>lo+(hi-lo)*2//4)::INT + (epoch_us("Timestamp")>lo+(hi-lo)*3//4)::INT AS batch FROM p, e),
 v AS (UNPIVOT (SELECT seq, batch, mid, "Volume", "Ask"-"Bid" AS spread, target-prediction AS residual FROM d) ON mid, "Volume", spread, residual INTO NAME name VALUE x),
 s AS (SELECT b.batch, name, count(*) n, avg(x) m, stddev_samp(x) sd FROM (SELECT DISTINCT batch FROM d) b JOIN v ON v.batch<=b.batch GROUP BY 1,2),
 f AS (SELECT seq, v.batch, CAST(sum(CASE WHEN n>10 AND sd>0 AND abs((x-m)/sd)>1.8 THEN 1 ELSE 0 END) AS INT) AS anomalies FROM v JOIN s USING (batch, name) GROUP BY 1,2),
 g AS (SELECT b.batch, sum(anomalies)/count(*) > 0.15 AS quarantined FROM (SELECT DISTINCT batch FROM d) b JOIN f ON f.batch<=b.batch GROUP BY 1)"""


@query("t05_batch_check", with_(QUOTES_SQL, BATCHES) + "SELECT seq, anomalies, quarantined FROM f JOIN g USING (batch)")
def _(t):
    out, bad, state, ck = (shared_folder(t.spark) for _ in range(4))
    d = t.quotes.withColumns({"prediction": c("mid"), "target": c("mid") + F.sin("seq") * (c("Volume") - 48)})
    d = _arrive(t, d, even=True)
    st.check_batches(d, ["mid", "Volume"], out, bad, state, ck, z=1.8, max_rate=0.15)
    schema = T.StructType([*d.schema.fields, T.StructField("anomalies", T.IntegerType())])
    seen = [t.spark.read.schema(schema).parquet(p).select("seq", "anomalies", F.lit(p == bad).alias("quarantined")) for p in (out, bad) if path_exists(t.spark, p)]
    return seen[0] if len(seen) == 1 else seen[0].unionByName(seen[1])  # passed and quarantined batches


def _features(t):
    return _arrive(t, t.ticks.select("Timestamp", "seq", c("Symbol").alias("feature"), (c("mid") / 10).alias("value")))


PAGE_HINKLEY = """x AS (SELECT "Symbol" AS feature, "Timestamp", mid/10 AS v, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Timestamp", seq) AS k FROM t),
 r AS (SELECT feature, "Timestamp", k, 1.0::DOUBLE AS n, v AS mean, -0.005::DOUBLE AS m, -0.005::DOUBLE AS low, false AS hit, 0.0::DOUBLE AS level FROM x WHERE k=1
 UNION ALL SELECT feature, "Timestamp", k, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0 ELSE mean END, CASE WHEN hit THEN 0 ELSE m END, CASE WHEN hit THEN 0 ELSE low END, hit, level FROM (
  SELECT feature, "Timestamp", k, n, mean, m, least(low, m) AS low, m - least(low, m) > 50 AS hit, m - least(low, m) AS level FROM (
   SELECT x.feature, x."Timestamp", x.k, r.n + 1 AS n, r.mean + (x.v - r.mean)/(r.n + 1) AS mean, r.m + x.v - (r.mean + (x.v - r.mean)/(r.n + 1)) - 0.005 AS m, r.low FROM r JOIN x ON x.feature=r.feature AND x.k=r.k+1)))"""


@query("t06_page_hinkley", "WITH RECURSIVE " + TICKS_SQL + ", " + PAGE_HINKLEY + ' SELECT feature, "Timestamp", round(level,4) AS level FROM r WHERE hit')
def _(t):
    return shown(_run(t, st.page_hinkley(_features(t), tie=["seq"])), "feature Timestamp", "level", 4)


@query("t06_adaptive_window")
def _(t):
    return _run(t, st.adaptive_window(_features(t), tie=["seq"]))


@query("t07_scaler", with_(TICKS_SQL) + f"SELECT seq, {rr('mid=(mid-avg(mid) OVER ())/stddev_pop(mid) OVER ()')} FROM t")
def _(t):
    d = t.ticks
    parts = [st.batch_moments(d.where(c("seq") % 3 == i), ["mid"]) for i in range(3)]
    m = st.merge_moments(st.merge_moments(parts[0], parts[1]), parts[2])
    return shown(st.scale(d, m, ["mid"]), "seq", "mid")


@query("t07_robust_scaler", with_(TICKS_SQL, "q5 AS (SELECT quantile_cont(mid,[0.01,0.25,0.5,0.75,0.99]) x FROM t)") + f"SELECT seq, {rr('mid=(greatest(least(mid,x[5]),x[1])-x[3])/(x[4]-x[2])')} FROM t, q5")
def _(t):
    return shown(st.robust_scale(t.ticks, ["mid"]), "seq", "mid")


HEALTH = f"""x AS (SELECT "Symbol" AS algorithm, "Timestamp", i + 1 AS k, epoch("Timestamp") AS now, count(*) OVER w AS n, avg("Volume"-48) OVER w AS m,
 stddev_samp("Volume"-48) OVER w AS sd, avg(CASE WHEN "Volume">48 THEN 1.0 ELSE 0.0 END) OVER w AS win FROM t WINDOW w AS ({W} ROWS 99 PRECEDING)),
 y AS (SELECT *, CASE WHEN n>1 THEN m/(sd+1e-8)*sqrt(n) ELSE 0 END AS sharpe FROM x),
 r AS (SELECT *, CASE WHEN sharpe>=0 AND win>=0.5 THEN -1.0::DOUBLE ELSE now+86400 END AS until FROM y WHERE k=1
 UNION ALL SELECT y.*, CASE WHEN r.until<0 OR y.now>=r.until THEN CASE WHEN y.sharpe>=0 AND y.win>=0.5 THEN -1.0 ELSE y.now+86400 END ELSE r.until END FROM r JOIN y ON y.algorithm=r.algorithm AND y.k=r.k+1)"""


@query("t08_health", "WITH RECURSIVE " + TICKS_SQL + ", " + HEALTH + f' SELECT algorithm, "Timestamp", until<0 AS enabled, {rr("sharpe", "win_rate=win")} FROM r')
def _(t):
    d = t.ticks.select("Timestamp", "seq", c("Symbol").alias("algorithm"), (c("Volume") - 48).alias("pnl"))
    out = _run(t, st.algorithm_health(_arrive(t, d, most=BATCH_ROWS), cooldown_seconds=86_400.0, tie=["seq"]))
    return shown(out, "algorithm Timestamp enabled", "sharpe win_rate")


@query("t09_recorder", 'SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1')
def _(t):
    out, ck = shared_folder(t.spark), shared_folder(t.spark)
    st.record(_arrive(t), out, ck)
    return t.spark.read.parquet(out).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("t10_feed_gaps", with_(TICKS_SQL) + 'SELECT "Symbol", "Timestamp", round("Volume"*0.01,6) AS gap, "Volume"*0.01>0.9 AS alert FROM t WHERE user_id%2=0')
def _(t):
    a = _arrive(t)
    b = _arrive(t, t.ticks.where(c("user_id") % 2 == 0).withColumn("mid", c("mid") + c("Volume") * 0.01))
    d = _run(t, st.feed_gaps(a, b, "1 hour", 0.9))
    return shown(d.withColumn("Timestamp", c("Timestamp").cast("timestamp_ntz")).withColumn("alert", F.round("gap", 6) > 0.9), "Symbol Timestamp alert", "gap")


def _two_feeds(t):
    """A feed without every third user, and one with the even users only whose prices are off by a part of the volume."""
    a = t.ticks.where(c("user_id") % 3 > 0)
    b = t.ticks.where(c("user_id") % 2 == 0).withColumn("mid", c("mid") + c("Volume") * 0.01)
    return [_arrive(t, d.select("Symbol", "Timestamp", "seq", "mid"), even=True) for d in (a, b)]


TWO_FEEDS = """a AS (SELECT * FROM t WHERE user_id%3>0), b AS (SELECT * REPLACE (mid+"Volume"*0.01 AS mid) FROM t WHERE user_id%2=0),
 wm AS (SELECT least((SELECT max("Timestamp") FROM a), (SELECT max("Timestamp") FROM b)) - INTERVAL '1 hour' AS wm)"""


@query("t10_live_feed", with_(TICKS_SQL, TWO_FEEDS) + """SELECT 'a' AS feed, seq, round(mid,6) AS mid FROM a
 UNION ALL SELECT 'b', seq, round(mid,6) FROM b, wm WHERE "Timestamp"<=wm AND NOT EXISTS (SELECT 1 FROM a WHERE a."Symbol"=b."Symbol" AND a."Timestamp"=b."Timestamp")""")
def _(t):
    a, b = _two_feeds(t)
    d = _run(t, st.live_feed(a.withColumn("feed", F.lit("a")), b.withColumn("feed", F.lit("b")), "1 hour"))
    return shown(d, "feed seq", "mid")


@query("t10_divergence", with_(TICKS_SQL, TWO_FEEDS, """g AS (SELECT a."Symbol", a."Timestamp", abs(a.mid-b.mid) AS gap FROM a JOIN b ON a."Symbol"=b."Symbol" AND a."Timestamp"=b."Timestamp"),
 n AS (SELECT "Symbol", time_bucket(INTERVAL '1 hour', "Timestamp") AS start, max(round(gap,9)) AS top, arg_max("Timestamp", (round(gap,9), -epoch_us("Timestamp"))) AS "at" FROM g GROUP BY 1,2),
 k AS (SELECT *, coalesce(lag(top) OVER (PARTITION BY "Symbol" ORDER BY start), 0)>0.9 AS was FROM n, wm WHERE start + INTERVAL '1 hour'<=wm)""")
 + 'SELECT "Symbol", "at", round(CASE WHEN top>0.9 THEN top ELSE 0 END,6) AS divergence, NOT top>0.9 AS resolved FROM k WHERE top>0.9 OR was')
def _(t):
    a, b = _two_feeds(t)
    out, state, ck = (shared_folder(t.spark) for _ in range(3))
    windows = st.feed_windows(a, b, "1 hour", "1 hour").withColumn("largest", F.round("largest", 9))
    st.divergence_alarms(windows, 0.9, out, state, ck)
    d = t.spark.read.parquet(out)
    return shown(d.withColumn("at", c("at").cast("timestamp_ntz")), "Symbol at resolved", "divergence")


BARS = """b AS (SELECT "Symbol", time_bucket(INTERVAL '1 hour', "Timestamp") s, avg(mid) m, max(mid) hi, count(*) n FROM t GROUP BY 1,2)"""


@query("t13_bars", with_(TICKS_SQL, BARS) + """SELECT "Symbol", s AS start, n, round(m,6) AS mean, hi AS high FROM b WHERE s + INTERVAL '1 hour' <= (SELECT max("Timestamp") FROM t) - INTERVAL '2 hours'""")
def _(t):
    d = _run(t, st.bars(_arrive(t), "1 hour", "2 hours"))
    return shown(d.withColumn("start", c("start").cast("timestamp_ntz")), "Symbol start n high", "mean")


@query("t13_sliding", with_(TICKS_SQL, """b AS (SELECT "Symbol", s - INTERVAL 30 MINUTE * o AS s, mid FROM (SELECT *, time_bucket(INTERVAL '30 minutes', "Timestamp") s FROM t), unnest([0,1]) u(o))""")
 + """SELECT "Symbol", s AS start, count(*) AS n, round(avg(mid),6) AS mean, min(mid) AS low FROM b GROUP BY 1,2 HAVING s + INTERVAL '1 hour' <= (SELECT max("Timestamp") FROM t) - INTERVAL '2 hours'""")
def _(t):
    d = _run(t, st.bars(_arrive(t), "1 hour", "2 hours", "30 minutes"))
    return shown(d.withColumn("start", c("start").cast("timestamp_ntz")), "Symbol start n low", "mean")


@query("t13_sessions", with_(TICKS_SQL, """m AS (SELECT "Symbol", "Timestamp", coalesce(("Timestamp" - lag("Timestamp") OVER y) >= INTERVAL '10 minutes', true)::INT AS new FROM t WINDOW y AS (PARTITION BY "Symbol" ORDER BY "Timestamp", seq)),
 k AS (SELECT *, sum(new) OVER (PARTITION BY "Symbol" ORDER BY "Timestamp" ROWS UNBOUNDED PRECEDING) AS nr FROM m)""")
 + """SELECT "Symbol", min("Timestamp") AS start, max("Timestamp") + INTERVAL '10 minutes' AS "end", count(*) AS n FROM k GROUP BY "Symbol", nr
 HAVING max("Timestamp") + INTERVAL '10 minutes' <= (SELECT max("Timestamp") FROM t) - INTERVAL '2 hours'""")
def _(t):
    d = _run(t, st.sessions(_arrive(t), "10 minutes", "2 hours"))
    return d.withColumns({x: c(x).cast("timestamp_ntz") for x in ("start", "end")})


@query("t14_dedupe", "SELECT event_id AS seq FROM events")
def _(t):
    d = t.ticks.unionByName(t.ticks)
    return _run(t, st.dedupe(_arrive(t, d), ["seq"], "1 day").select("seq"))


@query("t15_equity", with_(TICKS_SQL, f"""e AS (SELECT *, sum("Volume"-48) OVER ({W}) eq FROM t), p AS (SELECT *, max(eq) OVER ({W}) pk, avg("Volume"-48) OVER ({W} ROWS 49 PRECEDING) m, stddev_pop("Volume"-48) OVER ({W} ROWS 49 PRECEDING) s FROM e)""") + f"SELECT seq, {rr('equity=eq','drawdown=pk-eq','sharpe=CASE WHEN s>0 THEN m/s ELSE 0 END')} FROM p")
def _(t):
    d = t.ticks.select("Timestamp", "seq", c("Symbol").alias("strategy"), (c("Volume") - 48).alias("pnl"))
    return shown(_run(t, st.equity(_arrive(t, d, most=BATCH_ROWS))), "seq", "equity drawdown sharpe")
