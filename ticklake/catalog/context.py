"""Queries over context joins, news and text (J, U, K02, K07, W43, X13-X23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx, indicators as ind, news as nw, quality as q, reports as rep, signals as sg
from ..operators.base import apply_together
from ..plans.asof import asof_join
from ..plans.ordered import TICKS, Order
from .common import HOURLY_SQL, PREDS_SQL, TICKS_SQL, TRADES_SQL, W, full_sql, query, rd, rr, shown, with_

c = F.col
TREND = TICKS.with_keys("Symbol")


def _slow(t):
    """A slow series per symbol: the daily mean, dated at the start of its day."""
    d = t.ticks.groupBy("Symbol", F.to_date("Timestamp").cast("timestamp_ntz").alias("Date"))
    return d.agg(F.avg("mid").alias("day_mean"), F.max("Volume").alias("day_volume"))


SLOW = """s AS (SELECT "Symbol", CAST(CAST("Timestamp" AS DATE) AS TIMESTAMP) "Date", avg(mid) day_mean, max("Volume") day_volume FROM t GROUP BY 1,2)"""


@query("flagship_features", with_(TICKS_SQL, SLOW, f"""k AS (SELECT *, i=0 OR abs(mid/nullif(lag(mid) OVER ({W}),0)-1)<=5 ok FROM t),
 g AS (SELECT * FROM k WHERE ok), g1 AS (SELECT *, mid-lag(mid) OVER ({W}) d, coalesce(mid/nullif(lag(mid) OVER ({W}),0)-1,0) ret FROM g),
 g2 AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d,0) END up, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END dn FROM g1),
 g3 AS (SELECT *, {full_sql('avg','mid',20)} ma, {full_sql('stddev_samp','mid',20)} sd, {full_sql('avg','up',14)} au, {full_sql('avg','dn',14)} ad FROM g2),
 a AS (SELECT g3.*, s.day_mean FROM g3 ASOF LEFT JOIN s ON g3."Symbol"=s."Symbol" AND g3."Timestamp">=s."Date" + INTERVAL '1 day'),
 r AS (SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Timestamp" DESC, seq DESC) rn FROM a)""") + f"""SELECT "Symbol", seq, {rr('mid','ret','ma_20=ma','boll_upper=ma+2*sd','rsi_14=100-100/(1+au/nullif(ad,0))','day_mean=coalesce(day_mean,0)')} FROM r WHERE rn=1""")
def _(t):
    """Clean ticks, indicators in one pass, yesterday's context as of each tick, newest row per symbol."""
    d = q.sanitize_ticks(t.ticks, 5.0)
    d = apply_together(d, [ind.bollinger("mid", 20), ind.rsi("mid", 14), RETURN])
    known = _slow(t).withColumn("Date", c("Date") + F.expr("INTERVAL 1 DAY"))
    d = cx.add_context(d, known, ["day_mean"])
    d = rep.latest_per_key(d.select("Symbol", "Timestamp", "seq", "mid", "ret", "boll_ma", "boll_upper", "rsi_14", "day_mean"), ["Symbol"], ["Timestamp", "seq"])
    return shown(d.withColumnRenamed("boll_ma", "ma_20"), "Symbol seq", "mid ret ma_20 boll_upper rsi_14 day_mean")


RETURN = ind.RowOp("return", ("mid",), 1, lambda d, w: d.withColumn("ret", F.coalesce(c("mid") / F.nullif(F.lag("mid").over(w), F.lit(0.0)) - 1, F.lit(0.0))))


@query("j01_asof", with_(TICKS_SQL, SLOW) + f"""SELECT t.seq, t."Symbol", {rr('day_mean=coalesce(s.day_mean,0)','day_volume=coalesce(s.day_volume,0)')} FROM t ASOF LEFT JOIN s ON t."Symbol"=s."Symbol" AND t."Timestamp">=s."Date" """)
def _(t):
    return shown(cx.add_context(t.ticks, _slow(t), ["day_mean", "day_volume"]), "seq Symbol", "day_mean day_volume")


@query("j01_asof_orders", """SELECT l.o_orderkey, coalesce(r.o_orderkey,-1) AS prev_order, r.o_orderdate AS prev_date FROM orders l LEFT JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders x WHERE x.o_custkey=l.o_custkey AND x.o_orderdate<l.o_orderdate ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) r ON true""")
def _(t):
    o = t.orders
    left = o.select("o_orderkey", "o_custkey", "o_orderdate")
    day_on = (c("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 1 SECOND")).alias("d")  # an order counts from after its own time
    right = o.select("o_custkey", day_on, c("o_orderdate").alias("prev_date"), c("o_orderkey").alias("prev_order"))
    order = Order(("o_custkey",), "o_orderdate", ("o_orderkey",), 365 * 86_400)
    return asof_join(left, right, ["prev_order", "prev_date"], "d", ["prev_order"], order).fillna(-1, ["prev_order"]).select("o_orderkey", "prev_order", "prev_date")


@query("j02_lookup", with_(TICKS_SQL) + f"""SELECT t.seq, {rr('impact=p.v')} FROM t LEFT JOIN (SELECT event_type s, ts, value/100 v FROM events WHERE user_id%2=0) p ON p.s=t."Symbol" AND p.ts=t."Timestamp" """)
def _(t):
    imp = t.ticks.where("user_id % 2 = 0").select("Symbol", "Timestamp", (c("mid") / 100).alias("impact"))
    return shown(cx.lookup(t.ticks, imp, ["Symbol", "Timestamp"], ["impact"]), "seq", "impact")


@query("j03_asof_keyless", with_(TICKS_SQL, 'x AS (SELECT date_trunc(\'hour\',"Timestamp")+INTERVAL \'1 hour\' h, avg(mid) idx FROM t GROUP BY 1)') + f"""SELECT t.seq, {rr('idx')} FROM t ASOF LEFT JOIN x ON t."Timestamp">=x.h""")
def _(t):
    x = t.ticks.groupBy((F.date_trunc("hour", "Timestamp").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")).alias("h")).agg(F.avg("mid").alias("idx"))
    return shown(cx.add_market_context(t.ticks, x, ["idx"], "h"), "seq", "idx")


MACRO = """m AS (SELECT CAST(CAST("Timestamp" AS DATE) AS TIMESTAMP) d, CAST(user_id%3 AS VARCHAR) rg, avg(mid) gdp, max("Volume") cpi FROM t GROUP BY 1,2), tk AS (SELECT *, CAST(user_id%3 AS VARCHAR) rg FROM t)"""


@query("j04_macro", with_(TICKS_SQL, MACRO) + f"""SELECT tk.seq, {rr('macro_gdp=coalesce(m.gdp,0)','macro_cpi=coalesce(n.cpi,0)')} FROM tk ASOF LEFT JOIN m ON tk.rg=m.rg AND tk."Timestamp">=m.d+INTERVAL '12 hours' ASOF LEFT JOIN m n ON tk.rg=n.rg AND tk."Timestamp">=n.d+INTERVAL '36 hours'""")
def _(t):
    tk = t.ticks.withColumn("Region", (c("user_id") % 3).cast("string"))
    wide = tk.groupBy(F.to_date("Timestamp").cast("timestamp_ntz").alias("Date"), "Region").agg(F.avg("mid").alias("gdp"), F.max("Volume").alias("cpi"))
    d = cx.add_macro(tk, cx.macro_long(wide, ["gdp", "cpi"]), ["gdp", "cpi"], {"gdp": 12 * 3600, "macro_cpi": 36 * 3600})
    return shown(d, "seq", "macro_gdp macro_cpi")


QW = """w AS (SELECT "Symbol" s, "Timestamp" st, "Timestamp"+INTERVAL '90 minutes' en FROM t WHERE "Volume">95)"""


@query("j05_quiet", with_(TICKS_SQL, QW) + 'SELECT seq, EXISTS (SELECT 1 FROM w WHERE w.s=t."Symbol" AND t."Timestamp" BETWEEN w.st AND w.en) AS quiet FROM t')
def _(t):
    w = t.ticks.where("Volume > 95").select("Symbol", c("Timestamp").alias("start"), (c("Timestamp") + F.expr("INTERVAL 90 MINUTES")).alias("end"))
    return cx.in_windows(t.ticks, w).select("seq", "quiet")


@query("j06_time_join", with_(HOURLY_SQL, 'x AS (SELECT "Timestamp", avg("Close") m FROM h WHERE "Symbol"<>\'view\' GROUP BY 1)') + 'SELECT h."Symbol", h."Timestamp", round(m,6) AS ext FROM h LEFT JOIN x USING ("Timestamp")')
def _(t):
    h = t.hourly
    ext = h.where("Symbol <> 'view'").groupBy("Timestamp").agg(F.avg("Close").alias("ext"))
    return shown(cx.join_on_time(h, ext), "Symbol Timestamp", "ext")


@query("j07_dimension", f"SELECT l_orderkey, l_linenumber, l_quantity, coalesce(s_acctbal,0) AS s_acctbal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal>0) ON s_suppkey=l_suppkey")
def _(t):
    dim = t.supplier.where("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey")
    return cx.add_dimension(t.lineitem, dim, "l_suppkey", ["s_acctbal"]).select("l_orderkey", "l_linenumber", "l_quantity", "s_acctbal")


@query("j07_funding", with_(TICKS_SQL, "i AS (SELECT event_type s, avg(value)/1000 sr, max(value) mr FROM events WHERE event_type<>'view' GROUP BY 1)") + f"SELECT seq, {rr('swap_rate=coalesce(sr,0)','account_leverage=coalesce(1/mr,0)')} FROM t LEFT JOIN i ON s=\"Symbol\"")
def _(t):
    info = t.ticks.where("Symbol <> 'view'").groupBy("Symbol").agg((F.avg("mid") / 1000).alias("swap_rate"), F.max("mid").alias("margin_requirement"))
    return shown(cx.funding_costs(t.ticks, info), "seq", "swap_rate account_leverage")


FEEDS = "a AS (SELECT * FROM t WHERE user_id%2=0), b AS (SELECT * REPLACE (mid+1 AS mid) FROM t WHERE user_id%2=1 OR user_id%3=0)"


@query("u02_merge_feeds", with_(TICKS_SQL, FEEDS) + 'SELECT seq, mid FROM a UNION ALL SELECT seq, mid FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a."Symbol"=b."Symbol" AND a."Timestamp"=b."Timestamp")')
def _(t):
    a, b = t.ticks.where("user_id % 2 = 0"), t.ticks.where("user_id % 2 = 1 or user_id % 3 = 0").withColumn("mid", c("mid") + 1)
    return nw.merge_feeds(a, b).select("seq", "mid")


@query("j10_anti", with_(TICKS_SQL) + 'SELECT seq FROM t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id%2=0 AND e.event_id=t.seq)')
def _(t):
    return t.ticks.join(t.ticks.where("user_id % 2 = 0").select("seq"), "seq", "left_anti").select("seq")


@query("j11_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal>5000)")
def _(t):
    rich = t.customer.where("c_acctbal > 5000").select(c("c_custkey").alias("o_custkey"))
    return t.orders.join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("j12_full_outer", with_(TICKS_SQL, """a AS (SELECT date_trunc('hour', "Timestamp") d, "Symbol" s, avg(mid) revenue FROM t WHERE user_id%2=0 GROUP BY 1,2), b AS (SELECT date_trunc('hour', "Timestamp") d, "Symbol" s, max("Volume") pe FROM t WHERE user_id%2=1 OR user_id%3=0 GROUP BY 1,2)""") + 'SELECT d AS "Date", s AS "Symbol", round(revenue,6) AS revenue, pe FROM a FULL JOIN b USING (d,s)')
def _(t):
    tk = t.ticks.withColumn("Date", F.date_trunc("hour", "Timestamp").cast("timestamp_ntz"))
    a = tk.where("user_id % 2 = 0").groupBy("Date", "Symbol").agg(F.avg("mid").alias("revenue"))
    b = tk.where("user_id % 2 = 1 or user_id % 3 = 0").groupBy("Date", "Symbol").agg(F.max("Volume").alias("pe"))
    return cx.statements_and_ratios(a, b).select("Date", "Symbol", rd(c("revenue")).alias("revenue"), "pe")


@query("j13_keywords", "SELECT doc_id AS id, k AS symbol FROM documents, (VALUES ('the','the'),('eau','eau'),('ung','ung'),('q','q')) v(k,w) WHERE contains(lower(text), w)")
def _(t):
    kw = t.spark.createDataFrame([("the", "the"), ("eau", "eau"), ("ung", "ung"), ("q", "q")], "symbol string, keyword string")
    return cx.keyword_matches(t.documents.select(c("doc_id").alias("id"), "text"), kw)


@query("j14_tickers", """WITH s AS (SELECT DISTINCT upper(event_type)||'USD' sym FROM events), v AS (SELECT sym, sym v FROM s UNION SELECT sym, left(sym, length(sym)-3) FROM s), k AS (SELECT DISTINCT upper(left(event_type, 3))||CASE WHEN user_id%2=0 THEN '' ELSE upper(substr(event_type,4)) END t FROM events UNION SELECT DISTINCT upper(event_type)||'USD-24' FROM events)
 SELECT DISTINCT sym AS "Symbol", t AS ticker FROM v, k WHERE starts_with(t, v) OR starts_with(v, t)""")
def _(t):
    e = t.events
    s = e.select(F.concat(F.upper("event_type"), F.lit("USD")).alias("Symbol")).distinct()
    u = F.upper("event_type")
    tk = e.select(F.when(c("user_id") % 2 == 0, F.substring(u, 1, 3)).otherwise(u).alias("ticker")).unionByName(e.select(F.concat(u, F.lit("USD-24")).alias("ticker"))).distinct()
    return cx.ticker_matches(s, tk)


BRK = """q AS (SELECT "Symbol", user_id%4 broker, arg_max(mid, ("Timestamp",seq)) m FROM t GROUP BY 1,2)"""


@query("j15_broker_spreads", with_(TICKS_SQL, BRK) + f"SELECT a.\"Symbol\", a.broker AS a, b.broker AS b, {rr('spread=abs(a.m-b.m)')} FROM q a JOIN q b ON a.\"Symbol\"=b.\"Symbol\" AND a.broker<b.broker")
def _(t):
    return shown(cx.broker_spreads(t.ticks.withColumn("broker", c("user_id") % 4)), "Symbol a b", "spread")


@query("j15_arbitrage", with_(TICKS_SQL, BRK) + "SELECT a.\"Symbol\", a.broker AS a, b.broker AS b, CASE WHEN a.m<b.m THEN a.broker ELSE b.broker END AS buy_at FROM q a JOIN q b ON a.\"Symbol\"=b.\"Symbol\" AND a.broker<b.broker WHERE abs(a.m-b.m)>10")
def _(t):
    return cx.arbitrage(t.ticks.withColumn("broker", c("user_id") % 4), 10.0).select("Symbol", "a", "b", "buy_at")


EV = """e AS (SELECT "Symbol", "Timestamp" ts FROM t WHERE "Volume">97)"""


@query("j16_nearest_event", with_(TICKS_SQL, EV) + f"""SELECT seq, {rr('minutes_to_event=nt','minutes_from_event=lt','nearest_news_minutes=least(abs(nt),abs(lt))', nd=None)}, CAST(coalesce(nt>=0 AND nt<=60,false) AS INT) AS upcoming_red_news FROM (SELECT t.seq, ((SELECT epoch_us(min(ts)) FROM e WHERE e."Symbol"=t."Symbol" AND e.ts>=t."Timestamp")-epoch_us(t."Timestamp"))/60e6 nt, (epoch_us(t."Timestamp")-(SELECT epoch_us(max(ts)) FROM e WHERE e."Symbol"=t."Symbol" AND e.ts<=t."Timestamp"))/60e6 lt FROM t)""")
def _(t):
    e = t.ticks.where("Volume > 97").select("Symbol", c("Timestamp").alias("event_ts"))
    return shown(cx.event_distance(t.ticks, e), "seq upcoming_red_news", "minutes_to_event minutes_from_event nearest_news_minutes", None)


@query("j16_first_event", with_(TICKS_SQL, EV, "f AS (SELECT min(ts) e FROM e)") + f"""SELECT seq, {rr('minutes_to_event=(epoch_us(f.e)-epoch_us(t."Timestamp"))/60e6', nd=None)}, CAST((epoch_us(f.e)-epoch_us(t."Timestamp"))/60e6 BETWEEN 0 AND 60 AS INT) AS upcoming_red_news FROM t, f""")
def _(t):
    e = t.ticks.where("Volume > 97").select("Symbol", c("Timestamp").alias("event_ts"))
    return shown(cx.event_distance(t.ticks, e, first_only=True), "seq upcoming_red_news", "minutes_to_event", None)


KG = """co AS (SELECT c_name company, n_name currency, c_mktsegment sector FROM customer JOIN nation ON n_nationkey=c_nationkey), ev AS (SELECT s_suppkey id, n_name currency FROM supplier JOIN nation ON n_nationkey=s_nationkey)"""


def _graph(t):
    co = t.customer.join(t.nation, c("n_nationkey") == c("c_nationkey")).select(c("c_name").alias("company"), c("n_name").alias("currency"), c("c_mktsegment").alias("sector"))
    ev = t.supplier.join(t.nation, c("n_nationkey") == c("s_nationkey")).select(c("s_suppkey").alias("id"), c("n_name").alias("currency"))
    return co, ev


@query("j20_graph_scores", with_(KG) + "SELECT company, (SELECT count(*) FROM ev WHERE ev.currency=co.currency)::DOUBLE AS risk_score, (count(*) OVER (PARTITION BY sector)-1)::DOUBLE AS opportunity_score FROM co")
def _(t):
    co, ev = _graph(t)
    return cx.graph_scores(co, co.select("company", "sector"), co.select("company", "currency"), ev)


@query("j20_degree", with_(HOURLY_SQL) + 'SELECT x."Timestamp", x."Symbol" AS src, count(*) AS degree FROM h x JOIN h y ON x."Timestamp"=y."Timestamp" AND x."Symbol"<>y."Symbol" WHERE abs(x."Close"-y."Close")>20 GROUP BY 1,2')
def _(t):
    from ..operators import pairs as pr

    d = pr.pair_rows(t.hourly, pr.pair_list(t.hourly), "Close")
    e = d.select("Timestamp", c("a").alias("src"), c("b").alias("dst"), (c("x") - c("y")).alias("weight"))
    return cx.node_degree(e, 20.0)


@query("j21_graph_edges", with_(KG) + "SELECT company AS src, currency AS dst, 'country' AS relation FROM co UNION ALL SELECT currency, CAST(id AS VARCHAR), 'event' FROM ev UNION ALL SELECT company, sector, 'sector' FROM co UNION ALL SELECT s_name, c_name, 'supply_chain' FROM supplier JOIN customer ON s_nationkey=c_nationkey AND c_custkey%100=s_suppkey")
def _(t):
    co, ev = _graph(t)
    sup = t.supplier.join(t.customer, (c("s_nationkey") == c("c_nationkey")) & (c("c_custkey") % 100 == c("s_suppkey"))).select(c("s_name").alias("supplier"), c("c_name").alias("customer"))
    return cx.knowledge_edges(sup, co.select("company", "sector"), co.select("company", "currency"), ev)


@query("j23_news_pnl", with_(TICKS_SQL) + f"""SELECT "Symbol" AS symbol, {rr('pnl=sum("Volume"-40)','pnl_news=sum(("Volume"-40)*(1+CASE WHEN user_id%2=0 THEN mid/500 ELSE 0 END))', nd=4)} FROM t GROUP BY 1""")
def _(t):
    tk = t.ticks
    tr = tk.select(c("Symbol").alias("symbol"), c("Timestamp").alias("timestamp"), (c("Volume") - 40).alias("pnl"))
    se = tk.where("user_id % 2 = 0").select(c("Symbol").alias("symbol"), c("Timestamp").alias("timestamp"), (c("mid") / 500).alias("sentiment"))
    return shown(nw.pnl_with_news(tr, se).groupBy("symbol").agg(F.sum("pnl").alias("pnl"), F.sum("pnl_news").alias("pnl_news")), "symbol", "pnl pnl_news", 4)


SIZE = """z AS (SELECT seq, "AskVolume" sz, CASE WHEN user_id%2=0 THEN 1 ELSE -1 END dr, "Volume">90 qt, mid/100-0.3 im, "Volume"/100 un FROM t), z2 AS (SELECT *, CASE WHEN un>0.5 THEN sz*0.5 ELSE sz END s1 FROM z)"""


@query("f18_order_size", with_(TICKS_SQL, SIZE) + f"SELECT seq, {rr('adjusted=CASE WHEN qt THEN 0 WHEN abs(im)>0.5 AND im*dr<0 THEN 0 WHEN abs(im)>0.5 THEN s1*1.2 ELSE s1 END')} FROM z2")
def _(t):
    d = t.ticks.select("seq", c("AskVolume").alias("size"), F.when(c("user_id") % 2 == 0, 1).otherwise(-1).alias("direction"), (c("Volume") > 90).alias("quiet"), (c("mid") / 100 - 0.3).alias("impact"), (c("Volume") / 100).alias("uncertainty"))
    return shown(sg.adjust_order_size(d), "seq", "adjusted")


@query("f19_regimes", with_(PREDS_SQL) + "SELECT id, regime IN (0,2) AS long_ok FROM p")
def _(t):
    return t.preds.select("id", sg.allowed("regime", [0, 2]).alias("long_ok"))


@query("u01_union", "SELECT event_id AS id, event_type AS kind, NULL::DOUBLE AS amount FROM events UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def _(t):
    return nw.union_all(t.events.select(c("event_id").alias("id"), c("event_type").alias("kind")), t.orders.select(c("o_orderkey").alias("id"), c("o_totalprice").alias("amount")))


@query("u03_headlines", "SELECT source, lang, text, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def _(t):
    return nw.dedupe_first(t.documents.select("doc_id", "source", "lang", "text"), ["source", "lang", "text"], "doc_id")


U04 = """e AS (SELECT event_id, user_id id, CAST(ts AS DATE) d, event_type cur, CASE WHEN event_id%3=0 THEN NULL ELSE CAST(event_id AS VARCHAR) END actual, ['s'||(event_id%4), 's'||(event_id%5)] src FROM events),
 p AS (SELECT id, d, cur, arg_min(actual, event_id) FILTER (actual IS NOT NULL) actual FROM e GROUP BY 1,2,3), l AS (SELECT id, d, cur, list_sort(list(DISTINCT s)) s FROM (SELECT id, d, cur, unnest(src) s FROM e) GROUP BY 1,2,3)"""


@query("u04_events", "WITH " + U04 + ' SELECT p.id, p.d AS "timestamp", p.cur AS currency, p.actual, array_to_string(l.s, \',\') AS sources FROM p JOIN l USING (id, d, cur)')
def _(t):
    e = t.events.select(
        c("user_id").alias("id"), F.to_date("ts").alias("timestamp"), c("event_type").alias("currency"), F.lit("x").alias("event"),
        F.when(c("event_id") % 3 != 0, c("event_id").cast("string")).alias("actual"),
        F.array(F.concat(F.lit("s"), (c("event_id") % 4).cast("string")), F.concat(F.lit("s"), (c("event_id") % 5).cast("string"))).alias("sources"), c("event_id").alias("o"),
    )
    return nw.dedupe_events(e, "o").select("id", "timestamp", "currency", "actual", F.array_join("sources", ",").alias("sources"))


U05 = """n AS (SELECT event_id o, 'k'||(user_id%20) title, date_trunc('day', ts) ts, ['a'||(event_id%6), 'a'||(event_id%4)] sy FROM events), x AS (SELECT o, title, ts, unnest(sy) s FROM n), ow AS (SELECT title, ts, s, min(o) own FROM x GROUP BY 1,2,3),
 lk AS (SELECT DISTINCT x.o, ow.own FROM x JOIN ow USING (title, ts, s)), mg AS (SELECT lk.own, list_sort(list(DISTINCT x.s)) s FROM lk JOIN x ON x.o=lk.o GROUP BY 1)"""


@query("u05_news", "WITH " + U05 + " SELECT own AS o, array_to_string(s, ',') AS symbols FROM mg")
def _(t):
    e = t.events.select(
        c("event_id").alias("o"), F.concat(F.lit("k"), (c("user_id") % 20).cast("string")).alias("title"), F.date_trunc("day", "ts").alias("timestamp"),
        F.array(F.concat(F.lit("a"), (c("event_id") % 6).cast("string")), F.concat(F.lit("a"), (c("event_id") % 4).cast("string"))).alias("symbols"),
    )
    return nw.dedupe_news(e, "o").select("o", F.array_join("symbols", ",").alias("symbols"))


@query("u06_distinct", "SELECT DISTINCT event_type AS \"Symbol\" FROM events")
def _(t):
    return t.ticks.select("Symbol").distinct()


W43 = """v AS (SELECT *, lag(mid,0) OVER o v0, lag(mid,1) OVER o v1, lag(mid,2) OVER o v2 FROM t WINDOW o AS (PARTITION BY "Symbol" ORDER BY "Timestamp", seq))"""


@query("w43_vectors", with_(TICKS_SQL, W43) + "SELECT seq, round(CASE WHEN i>=2 THEN v0 ELSE 0 END,6) AS mid_0, round(CASE WHEN i>=2 THEN v1 WHEN i=1 THEN v0 ELSE 0 END,6) AS mid_1, round(CASE WHEN i>=2 THEN v2 WHEN i=1 THEN v1 ELSE v0 END,6) AS mid_2 FROM v")
def _(t):
    return shown(nw.previous_vectors(t.ticks, ["mid"], 3, TICKS), "seq", "mid_0 mid_1 mid_2")


@query("k02_headlines", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) rn FROM documents) WHERE rn<=5")
def _(t):
    return nw.top_headlines(t.documents, 5, Order(("source",), "n_chars", ("doc_id",))).select("source", "doc_id")


TOK = """tk AS (SELECT doc_id id, unnest(w) w, generate_subscripts(w,1) p FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z]{3,}'), lambda x: x NOT IN ('the','and','for','that','with','from','this','have','will','into','their','after','over','amid','amidst','company','companies','month','year','years','today','week','ahead','firm','firms')) w FROM documents))"""


@query("k07_keywords", with_(TOK, "g AS (SELECT id, w, count(*) n, min(p) p FROM tk GROUP BY 1,2)") + "SELECT id, w AS keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) rn FROM g) WHERE rn<=6")
def _(t):
    return nw.top_keywords(t.documents.select(c("doc_id").alias("id"), "text"), 6).select("id", "keyword", "n")


POSL = "'" + "','".join(tx.POSITIVE) + "'"
NEGL = "'" + "','".join(tx.NEGATIVE) + "'"


# texts with words of the lists: the event type, value and a word chosen by the row
HEAD = """hd AS (SELECT event_id id, (['Shares beat','Stocks fall,','Merger (up)','Oil rumor','GDP growth.','Bank rates: loss'])[user_id%6+1]||' '||event_type||' in '||(['quarter','long-term note','markets!','earnings surge'])[user_id%4+1]||' '||repeat('very ', CAST(user_id%30 AS INT)) AS title FROM events)"""


def _heads(t):
    e = t.events
    a = F.array(*[F.lit(x) for x in ("Shares beat", "Stocks fall,", "Merger (up)", "Oil rumor", "GDP growth.", "Bank rates: loss")])
    b = F.array(*[F.lit(x) for x in ("quarter", "long-term note", "markets!", "earnings surge")])
    u = c("user_id")
    title = F.concat(F.get(a, (u % 6).cast("int")), F.lit(" "), "event_type", F.lit(" in "), F.get(b, (u % 4).cast("int")), F.lit(" "), F.expr("repeat('very ', cast(user_id % 30 as int))"))
    return e.select(c("event_id").alias("id"), title.alias("title"))


SENT = f"w AS (SELECT id, list_transform(list_filter(string_split_regex(title,'\\s+'), lambda x: x<>''), lambda x: lower(trim(x, '.,!?;:''()[]{{}}<>'))) w FROM hd), s AS (SELECT id, len(list_filter(w, lambda x: x IN ({POSL}))) p, len(list_filter(w, lambda x: x IN ({NEGL}))) n FROM w)"


@query("x13_sentiment", with_(HEAD, SENT) + "SELECT id, CASE WHEN p+n=0 THEN 0.0::DOUBLE ELSE round((p-n)/(p+n),6) END AS sentiment FROM s")
def _(t):
    return _heads(t).select("id", rd(tx.headline_sentiment(c("title"))).alias("sentiment"))


FS = "(CASE WHEN regexp_matches(lower(title),'beat|beats|surge|rally|gain|up') THEN 1.0 ELSE 0.0 END-CASE WHEN regexp_matches(lower(title),'fall|drops|miss|down|loss|warning') THEN 1.0 ELSE 0.0 END)::DOUBLE"


@query("x14_flag_sentiment", with_(HEAD) + f"SELECT id, {FS} AS sentiment FROM hd")
def _(t):
    return _heads(t).select("id", tx.flag_sentiment(c("title")).alias("sentiment"))


@query("x15_importance", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'red' WHEN '3-MEDIUM' THEN 'orange' WHEN '4-NOT SPECIFIED' THEN 'not specified' ELSE 'yellow' END AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 1.0::DOUBLE WHEN '3-MEDIUM' THEN 0.6::DOUBLE WHEN '4-NOT SPECIFIED' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM orders")
def _(t):
    x = F.regexp_replace(F.substring("o_orderpriority", 3, 20), "URGENT", "RED")
    return t.orders.select(c("o_orderkey").alias("id"), tx.importance_name(x).alias("name"), tx.importance_weight(x).alias("weight"))


EFF = f"""f1 AS (SELECT id, title, {FS} se, CASE WHEN regexp_matches(lower(title),'merger|long-term|ban') THEN 1 ELSE 0 END st, CASE WHEN regexp_matches(lower(title),'earnings|quarter|loss') THEN 1 ELSE 0 END md, CASE WHEN regexp_matches(lower(title),'rumor|note') THEN 1 ELSE 0 END sh FROM hd),
 f2 AS (SELECT *, greatest(0.5, least(greatest(0.3+0.4*st+0.2*md-0.2*sh,0.05),1)) im, least(greatest(0.6*st+0.25*md-0.35*sh,-0.6),1) bi FROM f1),
 f3 AS (SELECT *, least(greatest((45+110*im+180*abs(se))*least(greatest(1+0.35*bi,0.6),1.8)*1.15,15),720) mi FROM f2), f4 AS (SELECT *, tanh(mi/180) sc, least(abs(se)*(0.55+0.25*tanh(mi/180)+0.2*im),1) sv FROM f3)"""


@query("x16_effect_length", with_(HEAD, EFF) + f"SELECT id, {rr('effect_minutes=mi','effect_half_life=least(greatest(mi*(0.35+0.45*im+0.2*abs(se)),10),720)','length_score=sc','importance_score=im')} FROM f4")
def _(t):
    h = _heads(t)
    return shown(h.withColumns(tx.effect_length(c("title"), tx.flag_sentiment(c("title")), F.lit(0.5))), "id", "effect_minutes effect_half_life length_score importance_score")


@query("x17_severity", with_(HEAD, EFF) + f"SELECT id, len(list_filter(string_split_regex(title,'\\s+'), lambda x: x<>''))::DOUBLE AS word_count, {rr('severity=sv','sentiment_effect=se*sv')} FROM f4")
def _(t):
    return shown(nw.score_headlines(_heads(t)), "id word_count", "severity sentiment_effect")


def topic_sql() -> str:
    return "||".join(f"CASE WHEN list_has_any(w, [{','.join(repr(x) for x in ws)}]) THEN '{k},' ELSE '' END" for k, ws in tx.TOPICS.items())


@query("x18_topics", with_(HEAD, "w AS (SELECT id, list_filter(regexp_extract_all(lower(title),'[A-Za-z]{3,}'), lambda x: x NOT IN ('the','and','for','that','with','from')) w FROM hd)") + f"SELECT id, {topic_sql()} AS topics FROM w")
def _(t):
    return _heads(t).select("id", F.concat_ws("", F.transform(tx.topics(c("title")), lambda x: F.concat(x, F.lit(",")))).alias("topics"))


@query("x19_summary", """WITH a AS (SELECT doc_id id, trim(regexp_replace(text,'\\s+',' ','g')) t FROM documents), b AS (SELECT id, t, regexp_extract(t, '^(.*?[.!?])(\\s+|$)', 1) f FROM a), d AS (SELECT id, t, CASE WHEN f='' THEN t ELSE f END f FROM b)
 SELECT id, CASE WHEN t='' THEN NULL WHEN length(f)>120 THEN rtrim(left(f,119))||'…' ELSE f END AS summary FROM d""")
def _(t):
    return t.documents.select(c("doc_id").alias("id"), tx.summary(c("text")).alias("summary"))


@query("x20_variants", "WITH s AS (SELECT DISTINCT upper(event_type)||(['/USD','-PERP','USDT'])[user_id%3+1] s FROM events), v AS (SELECT s, s v FROM s UNION SELECT s, replace(s,'/','') FROM s UNION SELECT s, replace(s,'-','') FROM s UNION SELECT s, left(s,length(s)-3) FROM s WHERE s LIKE '%USD' UNION SELECT s, left(s,length(s)-4) FROM s WHERE s LIKE '%USDT' OR s LIKE '%PERP') SELECT s AS symbol, v AS variant FROM v")
def _(t):
    ends = F.array(F.lit("/USD"), F.lit("-PERP"), F.lit("USDT"))
    s = t.events.select(F.concat(F.upper("event_type"), F.get(ends, (c("user_id") % 3).cast("int"))).alias("symbol")).distinct()
    return s.select("symbol", F.explode(tx.symbol_variants(c("symbol"))).alias("variant"))


@query("x22_json", "SELECT event_id AS id, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS value FROM events")
def _(t):
    payload = F.concat(F.lit('{"data":{"rows":['), c("props"), F.lit("]}}"))
    r = F.explode(tx.records_at(payload, "data.rows", "struct<k: double>"))
    return t.events.select(c("event_id").alias("id"), r.alias("r")).select("id", c("r.k").alias("value"))


@query("x22_observations", "SELECT event_id AS id, CAST(i AS VARCHAR) AS idx, value*(i+1) AS value FROM events, (SELECT unnest([0,1]) i)")
def _(t):
    payload = F.concat(F.lit('{"obs":{"0":['), c("value").cast("string"), F.lit('],"1":['), (c("value") * 2).cast("string"), F.lit("]}}"))
    return t.events.select(c("event_id").alias("id"), F.explode(tx.observation_map(payload, "obs")).alias("idx", "v")).select("id", "idx", c("v")[0].alias("value"))


EMB = """w AS (SELECT doc_id id, unnest(string_split_regex(lower(text),'\\s+')) w FROM documents), s AS (SELECT id, CAST(('0x'||right(md5(w),2)) AS INT)%32 slot, count(*)::DOUBLE n FROM w WHERE w<>'' GROUP BY 1,2)"""


@query("x23_embedding", with_(EMB) + f"SELECT id, CAST(slot AS INT) AS slot, {rr('weight=n/sqrt(sum(n*n) OVER (PARTITION BY id))')} FROM s")
def _(t):
    return shown(nw.embed_long(t.documents.select(c("doc_id").alias("id"), "text")), "id slot", "weight")


SIM = """wq AS (SELECT item_id id, unnest(string_split_regex(lower(text),'\\s+')) w FROM benchmark), sq AS (SELECT id, CAST(('0x'||right(md5(w),2)) AS INT)%32 slot, count(*)::DOUBLE n FROM wq WHERE w<>'' GROUP BY 1,2),
 vd AS (SELECT id, slot, n/sqrt(sum(n*n) OVER (PARTITION BY id)) v FROM s), vq AS (SELECT id, slot, n/sqrt(sum(n*n) OVER (PARTITION BY id)) v FROM sq),
 dt AS (SELECT vq.id qid, vd.id, round(1-sqrt(greatest(2-2*sum(vq.v*vd.v),0))/2,12) sim FROM vq JOIN vd USING (slot) GROUP BY 1,2), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) rn FROM dt)"""


@query("j19_similar", with_(EMB, SIM) + "SELECT qid, round(avg(sim),6) AS similarity FROM rk WHERE rn<=5 GROUP BY 1")
def _(t):
    d = t.documents.select(c("doc_id").alias("id"), "text")
    s = nw.similar_events(d, t.benchmark.select(c("item_id").alias("qid"), "text"), 5)
    return shown(nw.mean_similarity(s), "qid", "similarity")


@query("t11_news_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' AND event_type='click'")
def _(t):
    d = t.events.withColumn("timestamp", c("ts")).withColumn("symbols", F.array("event_type"))
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return nw.news_between(d, ts("2024-01-05"), ts("2024-01-07"), "click").select("event_id")


@query("t11_live_news", "SELECT event_id FROM events WHERE ts>=TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR")
def _(t):
    return nw.live_news(t.events.withColumn("timestamp", c("ts")), F.lit("2024-01-30").cast("timestamp_ntz")).select("event_id")
