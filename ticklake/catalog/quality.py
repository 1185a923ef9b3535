"""Queries over cleaning, gates and drift (F, W44-W46, A26-A29)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import drift, quality as q
from ..plans.ordered import Order
from .common import PREDS_SQL, QUOTES_SQL, TICKS_SQL, W, query, rd, rr, shown, with_

c = F.col
K = 'seq, "Symbol"'

FLAGS = f"""m AS (SELECT *, ("Ask"+"Bid")/2 md, "Ask"-"Bid" sp FROM q), fl AS (SELECT *, NOT (i=0 OR "Timestamp">lag("Timestamp") OVER ({W})) bad_time, NOT (sp>=0 AND sp<=0.05) bad_spread,
 NOT (i=0 OR coalesce(abs(md/nullif(lag(md) OVER ({W}),0)-1)<=3.0, false)) bad_jump FROM m)"""


@query("f01_sanitize", with_(QUOTES_SQL, FLAGS) + f"SELECT {K}, {rr('Bid=\"Bid\"','Ask=\"Ask\"')} FROM fl WHERE NOT (bad_time OR bad_spread OR bad_jump)")
def _(t):
    return shown(q.sanitize_ticks(t.quotes, 3.0), "seq Symbol", "Bid Ask")


@query("f01_removals", with_(QUOTES_SQL, FLAGS) + """SELECT "Symbol", count(*) FILTER (bad_time) n_bad_time, count(*) FILTER (bad_spread) n_bad_spread, count(*) FILTER (bad_jump) n_bad_jump,
 count(*) FILTER (NOT (bad_time OR bad_spread OR bad_jump)) n_kept FROM fl GROUP BY 1""")
def _(t):
    return q.removal_counts(q.tick_flags(t.quotes, 3.0))


@query("f02_zscore", with_(TICKS_SQL) + f"""SELECT {K}, round(CASE WHEN abs(mid-avg(mid) OVER p)/stddev_pop(mid) OVER p > 2 THEN NULL ELSE mid END, 6) AS mid, "Volume" FROM t WINDOW p AS (PARTITION BY "Symbol")""")
def _(t):
    return shown(q.zscore_filter(t.ticks, ["mid", "Volume"], 2.0), "seq Symbol Volume", "mid")


@query("f03_median", with_(TICKS_SQL, f"a AS (SELECT *, quantile_cont(mid,0.5) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) md FROM t)", f"b AS (SELECT *, quantile_cont(abs(mid-md),0.5) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) mad FROM a)") + f"SELECT {K}, CASE WHEN abs(mid-md)>5*nullif(mad,0) THEN NULL ELSE mid END AS mid FROM b")
def _(t):
    return q.median_filter(t.ticks, ["mid"]).select("seq", "Symbol", "mid")


F04 = """s AS MATERIALIZED (SELECT *, "Ask"-"Bid" sp, ("Ask"+"Bid")/2 md FROM q),
 r AS (SELECT "Symbol", i, true ok, 1::BIGINT n, sp m, 0.0::DOUBLE m2, 0.0::DOUBLE jm, 0.0::DOUBLE jm2, md pm, "Timestamp" lt FROM s WHERE i=0
 UNION ALL SELECT "Symbol", i, ok, CASE WHEN ok THEN n+1 ELSE n END, CASE WHEN ok THEN m+(sp-m)/(n+1) ELSE m END, CASE WHEN ok THEN m2+(sp-m)*(sp-(m+(sp-m)/(n+1))) ELSE m2 END,
  CASE WHEN ok THEN jm+(j-jm)/(n+1) ELSE jm END, CASE WHEN ok THEN jm2+(j-jm)*(j-(jm+(j-jm)/(n+1))) ELSE jm2 END, CASE WHEN ok THEN md ELSE pm END, CASE WHEN ok THEN ts ELSE lt END
 FROM (SELECT r."Symbol", s.i, s.sp, s.md, s.md-r.pm j, s."Timestamp" ts, r.n, r.m, r.m2, r.jm, r.jm2, r.pm, r.lt,
  NOT (s."Timestamp"<=r.lt OR s."Ask"<=s."Bid" OR (r.n>10 AND r.m2>0 AND abs(s.sp-r.m)>3*sqrt(r.m2/(r.n-1))) OR (r.n>10 AND r.jm2>0 AND abs(s.md-r.pm-r.jm)>3*sqrt(r.jm2/(r.n-1)))) ok
  FROM r JOIN s ON s."Symbol"=r."Symbol" AND s.i=r.i+1))"""


@query("f04_online_filter", "WITH RECURSIVE " + QUOTES_SQL + ", " + F04 + ' SELECT s.seq, s."Symbol", r.ok AS accepted FROM s JOIN r ON s."Symbol"=r."Symbol" AND s.i=r.i')
def _(t):
    return q.online_filter(t.quotes).select("seq", "Symbol", "accepted")


@query("f05_anomalies", with_(TICKS_SQL) + 'SELECT seq, "Symbol", mid, "Volume" FROM (SELECT *, abs(mid-avg(mid) OVER ())/stddev_pop(mid) OVER () z1, abs("Volume"-avg("Volume") OVER ())/stddev_pop("Volume") OVER () z2 FROM t) WHERE greatest(z1,z2)>3')
def _(t):
    return q.split_anomalies(t.ticks, ["mid", "Volume"])[1].select("seq", "Symbol", "mid", "Volume")


@query("f06_robust", with_(TICKS_SQL, f"a AS (SELECT *, quantile_cont(mid,0.5) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) md FROM t)", f"b AS (SELECT *, list_sort(list(md) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) l FROM a)",
 "d AS (SELECT *, list_avg(CASE WHEN len(l)*0.2>=1 THEN l[2:len(l)-1] ELSE l END) v FROM b)") + f"SELECT {K}, {rr('mid=greatest(least(v, avg(v) OVER p + 2*stddev_pop(v) OVER p), avg(v) OVER p - 2*stddev_pop(v) OVER p)')} FROM d WINDOW p AS (PARTITION BY \"Symbol\")")
def _(t):
    return shown(q.robust_preprocess(t.ticks, ["mid"], trim=0.2, z=2.0), "seq Symbol", "mid")


@query("f07_recency", with_(TICKS_SQL) + """SELECT "Symbol", max("Timestamp") AS latest, round(epoch(TIMESTAMP '2024-01-31 00:00:00'-max("Timestamp")),6) AS age_seconds, epoch(TIMESTAMP '2024-01-31 00:00:00'-max("Timestamp"))<=1800 AS fresh FROM t GROUP BY 1""")
def _(t):
    d = q.recency(t.ticks, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 1800)
    return shown(d, "Symbol latest fresh", "age_seconds")


@query("f08_weight", with_(TICKS_SQL) + f"""SELECT {K}, {rr('quality=1/(1+(abs(mid-avg(mid) OVER ())/stddev_pop(mid) OVER ()+abs("Volume"-avg("Volume") OVER ())/stddev_pop("Volume") OVER ())/2)')} FROM t""")
def _(t):
    return shown(q.quality_weight(t.ticks, ["mid", "Volume"]), "seq Symbol", "quality")


@query("f09_schema", """SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NOT NULL AND TRY_CAST(event_id AS DOUBLE) IS NULL) AS uncastable, count(*) FILTER (event_id IS NULL) AS nulls FROM events
 UNION ALL SELECT 'event_type', count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NULL), count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NULL) FROM events""")
def _(t):
    schema = T.StructType([T.StructField("event_id", T.DoubleType(), False), T.StructField("event_type", T.DoubleType(), False)])
    return q.coerce(t.events, schema)[1]


SUITE = {
    "expectations": [
        {"expectation_type": "expect_table_columns_to_match_set", "kwargs": {"column_set": ["Timestamp", "Bid", "Ask"], "exact_match": False}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "Bid"}},
        {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "Size"}},
        {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 1000}},
    ]
}


@query("f10_expectations", with_(TICKS_SQL) + """SELECT 'expect_table_columns_to_match_set' AS expectation, '' AS "column", 0::BIGINT AS unexpected, true AS success
 UNION ALL SELECT 'expect_column_values_to_not_be_null', 'Bid', count(*) FILTER ("Bid" IS NULL), count(*) FILTER ("Bid" IS NULL)=0 FROM t
 UNION ALL SELECT 'expect_column_to_exist', 'Size', 1, false
 UNION ALL SELECT 'expect_table_row_count_to_be_between', '', CASE WHEN count(*) BETWEEN 1 AND 1000 THEN 0 ELSE 1 END, count(*) BETWEEN 1 AND 1000 FROM t""")
def _(t):
    return q.expectations(t.ticks, SUITE)


@query("f11_nulls", """SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS nulls FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents""")
def _(t):
    return q.null_counts(t.documents, ["text", "lang"])


@query("f12_select", with_(TICKS_SQL) + 'SELECT seq, "BidVolume", "AskVolume", "Volume" FROM t')
def _(t):
    rules = [("flow", "contains", "Volume"), ("price", "exact", "mid"), ("time", "prefix", "Time")]
    return q.select_families(t.ticks, ["flow"], rules, always=["seq"])


@query("f14_sanitizer", with_(TICKS_SQL, "b AS (SELECT seq, CASE WHEN \"Volume\">50 THEN \"Volume\" END v, mid FROM t)") + "SELECT seq, round(coalesce(v,(SELECT quantile_cont(v,0.5) FROM b)),6) AS v, mid, 0.0::DOUBLE AS extra FROM b")
def _(t):
    d = t.ticks.select("seq", F.when(c("Volume") > 50, c("Volume").cast("string")).otherwise("bad").alias("v"), "mid")
    s = q.Sanitizer().fit(d, ["v", "mid"])
    s.fill["extra"] = 0.0
    return s.transform(d).select("seq", rd(c("v")).alias("v"), "mid", "extra")


@query("f15_signal_gate", with_(TICKS_SQL) + 'SELECT seq, CASE WHEN "Volume">20 AND mid>10 AND "AskVolume"<40 THEN "Volume"/100 ELSE 0 END AS prob FROM t')
def _(t):
    d = t.ticks
    p = q.signal_gate(c("Volume") / 100, [c("Volume") > 20, c("mid") > 10, c("AskVolume") < 40])
    return d.select("seq", p.alias("prob"))


@query("f16_threshold", with_(PREDS_SQL) + "SELECT id, CAST(prob >= CASE regime WHEN 0 THEN 0.4 WHEN 1 THEN 0.7 ELSE 0.5 END AS INT) AS pred FROM p")
def _(t):
    return q.regime_threshold(t.preds, {0: 0.4, 1: 0.7}, 0.5, regime="regime").select("id", "pred")


@query("f17_limits", with_(QUOTES_SQL) + 'SELECT seq, "Ask"-"Bid"<=0.05 AS spread_ok, coalesce(abs("Ask"-mid)/nullif(abs(mid),0)<=0.01,false) AS slippage_ok FROM q')
def _(t):
    d = t.quotes
    return d.select("seq", q.spread_ok(0.05).alias("spread_ok"), F.coalesce(q.slippage_ok(0.01, "mid", "Ask"), F.lit(False)).alias("slippage_ok"))


@query("f20_downcast", with_(TICKS_SQL) + 'SELECT CAST(seq AS INT) AS seq, CAST(mid AS FLOAT) AS mid FROM t')
def _(t):
    return q.downcast(t.ticks.select("seq", "mid"))


@query("w44_gaps", with_(TICKS_SQL) + f"SELECT {K}, coalesce(epoch_us(\"Timestamp\")-epoch_us(lag(\"Timestamp\") OVER ({W}))>3600000000,false) AS gap FROM t")
def _(t):
    return q.gaps(3600)(t.ticks).select("seq", "Symbol", "gap")


GRID = """a AS (SELECT "Symbol", epoch_us("Timestamp")//1000000 s, mid FROM t), m AS (SELECT "Symbol", s, max(mid) v FROM a GROUP BY 1,2), sp AS (SELECT "Symbol", min(s) s0, max(s) s1 FROM m GROUP BY 1),
 g AS (SELECT "Symbol", s0, unnest(range(0,(s1-s0)//600+1)) g FROM sp), j AS (SELECT g."Symbol", g.s0+g.g*600 s, g.g, m.v FROM g LEFT JOIN m ON m."Symbol"=g."Symbol" AND m.s=g.s0+g.g*600),
 k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN g END IGNORE NULLS) OVER (PARTITION BY "Symbol" ORDER BY g) pg, last_value(v IGNORE NULLS) OVER (PARTITION BY "Symbol" ORDER BY g) pv,
  first_value(CASE WHEN v IS NOT NULL THEN g END IGNORE NULLS) OVER (PARTITION BY "Symbol" ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ng,
  first_value(v IGNORE NULLS) OVER (PARTITION BY "Symbol" ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nv FROM j)"""


@query("w45_grid", with_(TICKS_SQL, GRID) + 'SELECT "Symbol", make_timestamp(s*1000000) AS "Timestamp", round(coalesce(v, pv+(nv-pv)*((g-pg)::DOUBLE/nullif(ng-pg,0)), pv, nv),6)+0.0 AS v FROM k')
def _(t):
    d = t.ticks.groupBy("Symbol", F.date_trunc("second", "Timestamp").cast("timestamp_ntz").alias("Timestamp")).agg(F.max("mid").alias("v"))
    return shown(q.interpolate_grid(d, ["v"], 600), "Symbol Timestamp", "v")


@query("w46_fill", with_(TICKS_SQL, 'a AS (SELECT *, CASE WHEN "Volume">70 THEN mid END v FROM t)') + f"""SELECT {K}, coalesce(last_value(v IGNORE NULLS) OVER ({W}), first_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM a""")
def _(t):
    d = t.ticks.withColumn("v", F.when(c("Volume") > 70, c("mid")))
    return q.fill_within(d, ["v"]).select("seq", "Symbol", "v")


HALVES = "e AS (SELECT * FROM p WHERE \"Timestamp\"<TIMESTAMP '2024-01-16'), u AS (SELECT * FROM p WHERE \"Timestamp\">=TIMESTAMP '2024-01-16')"


def psi_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", coalesce(sum((pe-pa)*ln(pe/pa)),0) AS psi FROM (SELECT CASE WHEN ne=0 THEN 1e-6 ELSE ne/sum(ne) OVER () END pe, CASE WHEN na=0 THEN 1e-6 ELSE na/sum(na) OVER () END pa FROM
 (SELECT b, (SELECT count(*) FROM e WHERE {col}>=lo AND ({col}<hi OR (hi=top AND {col}=top)))::DOUBLE ne, (SELECT count(*) FROM u WHERE {col}>=lo AND ({col}<hi OR (hi=top AND {col}=top)))::DOUBLE na
 FROM (SELECT x b, x lo, lead(x) OVER (ORDER BY x) hi, max(x) OVER () top FROM (SELECT DISTINCT unnest((SELECT quantile_cont({col}, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FROM e)) x)) WHERE hi IS NOT NULL))"""


def _halves(t):
    p = t.preds
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return p.where(c("Timestamp") < cut), p.where(c("Timestamp") >= cut)


@query("a26_psi", with_(PREDS_SQL, HALVES) + f'SELECT "column", round(psi,6)+0.0 AS psi FROM ({psi_sql("prob")} UNION ALL {psi_sql("value")})')
def _(t):
    return shown(drift.psi(*_halves(t), ["prob", "value"]), "column", "psi")


def ks_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", max(abs(c1/n1-c2/n2)) ks, max(n1) n1, max(n2) n2 FROM (SELECT DISTINCT {col} v, (sum(s) OVER (ORDER BY {col}))::DOUBLE c1, (sum(1-s) OVER (ORDER BY {col}))::DOUBLE c2, (sum(s) OVER ())::DOUBLE n1, (sum(1-s) OVER ())::DOUBLE n2 FROM
 (SELECT {col}, 1 s FROM e UNION ALL SELECT {col}, 0 FROM u))"""


@query("a27_ks", with_(PREDS_SQL, HALVES) + f'SELECT "column", {rr("ks","p_value=2*exp(-2*n1*n2/(n1+n2)*ks*ks)")} FROM ({ks_sql("prob")} UNION ALL {ks_sql("value")})')
def _(t):
    return shown(drift.ks(*_halves(t), ["prob", "value"]), "column", "ks p_value")


@query("a28_drift_report", with_(PREDS_SQL, HALVES) + f'SELECT "column", {rr("ks","psi")}, 2*exp(-2*n1*n2/(n1+n2)*ks*ks)<0.05 AS ks_alert, psi>0.2 AS psi_alert FROM ({ks_sql("prob")} UNION ALL {ks_sql("value")}) JOIN ({psi_sql("prob")} UNION ALL {psi_sql("value")}) USING ("column")')
def _(t):
    return shown(drift.drift_report(*_halves(t), ["prob", "value"]), "column ks_alert psi_alert", "ks psi")


@query("a28_importance", with_(PREDS_SQL) + """SELECT o.feature, round(o.v,6) AS old, round(n.v,6) AS new, abs(n.v-o.v)/abs(o.v)>0.1 AS drifted FROM (SELECT model feature, avg(value) v FROM p WHERE id%2=0 GROUP BY 1) o JOIN (SELECT model feature, avg(value) v FROM p WHERE id%2=1 GROUP BY 1) n USING (feature)""")
def _(t):
    p = t.preds
    imp = lambda d: d.groupBy(c("model").alias("feature")).agg(F.avg("value").alias("importance"))
    d = drift.importance_drift(imp(p.where("id % 2 = 0")), imp(p.where("id % 2 = 1")), 0.1)
    return shown(d, "feature drifted", "old new")


@query("a29_mean_shift", with_(TICKS_SQL, 'n AS (SELECT *, count(*) OVER (PARTITION BY "Symbol") n FROM t)') + """SELECT "Symbol", c AS "column", n//2 AS middle, round(avg(v) FILTER (i<n//2),6) AS mean_before, round(avg(v) FILTER (i>=n//2),6) AS mean_after, abs(avg(v) FILTER (i>=n//2)-avg(v) FILTER (i<n//2))>1 AS change
 FROM (SELECT "Symbol", i, n, 'mid' c, mid v FROM n UNION ALL SELECT "Symbol", i, n, 'Volume', "Volume" FROM n) GROUP BY ALL""")
def _(t):
    return shown(drift.mean_shift(t.ticks, ["mid", "Volume"]), "Symbol column middle change", "mean_before mean_after")
