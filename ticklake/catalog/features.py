"""Queries over registered features, exposures and smoothing (P, A35, W08, W14, W21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind, pairs as pr, registry as reg, risk
from ..plans.ordered import Order
from .common import HOURLY_SQL, TICKS_SQL, W, full_sql, query, rr, shown, with_
from .market import PAIRS, SES, _pairs

c = F.col


@query("p01_feature_table", with_(TICKS_SQL, f"m AS (SELECT *, {full_sql('max','mid',20)} hi FROM t)") + f"SELECT seq, {rr('donchian_high=hi',f'mid_lag2=lag(mid,2) OVER ({W})','mid_mean5='+full_sql('avg','mid',5),'microprice_delta=(\"Ask\"*\"BidVolume\"+\"Bid\"*\"AskVolume\")/(\"BidVolume\"+\"AskVolume\")-(\"Bid\"+\"Ask\")/2', nd=None)} FROM m")
def _(t):
    d = reg.build_features(t.ticks, ["donchian", "auto_indicator", "ram", "microprice", "time"])
    return shown(d, "seq", "donchian_high mid_lag2 mid_mean5 microprice_delta", None)


@query("p03_checked_feature", with_(TICKS_SQL) + "SELECT seq, round(mid*2,6) AS twice FROM t WHERE mid IS NOT NULL")
def _(t):
    """A registered operator with the columns it needs and those it must leave without NULL."""
    reg.feature("twice", requires=["mid"], no_null=["twice"])(lambda d, o: d.withColumn("twice", F.round(c("mid") * 2, 6)))
    try:
        return reg.build_features(t.ticks.where("mid is not null"), ["twice"]).select("seq", "twice")
    finally:
        del reg.FEATURES["twice"]


@query("p04_custom_columns", with_(TICKS_SQL) + f"SELECT seq, {rr(f'mid_range=max(mid) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)-min(mid) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} FROM t")
def _(t):
    spread = lambda x, w: F.max(x).over(w.rowsBetween(-3, 0)) - F.min(x).over(w.rowsBetween(-3, 0))
    return shown(ind.lags_and_stats(["mid"], custom={"range": spread}, custom_back=3)(t.ticks), "seq", "mid_range")


@query("p06_per_key", with_(TICKS_SQL) + f"SELECT seq, {rr(f'mean9=CASE WHEN count(*) OVER ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)=9 THEN avg(mid) OVER ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) END')} FROM t")
def _(t):
    """A pandas function over blocks of a symbol with the rows before them."""
    d = reg.per_key(t.ticks, lambda pdf: pdf[["seq"]].assign(mean9=pdf["mid"].rolling(9).mean()), "seq long, mean9 double", Order(block_rows=512), back=8)
    return shown(d, "seq", "mean9")


@query("p07_text_scores", "SELECT doc_id, CAST(length(text)-length(replace(text,'e','')) AS DOUBLE) AS score FROM documents")
def _(t):
    return reg.score_text(t.documents, lambda xs: [x.count("e") for x in xs]).select("doc_id", "score")


@query("w08_vwap_session", with_(TICKS_SQL, SES, "n AS (SELECT *, CASE WHEN l>=28800 AND l<57600 THEN 'london' WHEN n>=28800 AND n<61200 THEN 'new_york' WHEN k>=32400 AND k<61200 THEN 'tokyo' ELSE 'other' END ses FROM z)") + f"""SELECT seq, {rr('vwap_session=sum(mid*"Volume") OVER s/nullif(sum("Volume") OVER s,0)','vwap_day=sum(mid*"Volume") OVER d/nullif(sum("Volume") OVER d,0)')} FROM n
 WINDOW d AS (PARTITION BY "Symbol", CAST("Timestamp" AS DATE) ORDER BY "Timestamp", seq ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY "Symbol", CAST("Timestamp" AS DATE), ses ORDER BY "Timestamp", seq ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return shown(ind.anchored_vwaps(t.ticks), "seq", "vwap_session vwap_day")


KS = f"""c0 AS (SELECT *, mid-lag(mid) OVER ({W}) ch FROM t), rv AS (SELECT "Symbol", var_samp(ch) rr FROM c0 GROUP BY 1), u AS MATERIALIZED (SELECT t.*, rr FROM t JOIN rv USING ("Symbol")),
 k AS (SELECT "Symbol", i, mid::DOUBLE y, 1.0::DOUBLE p FROM u WHERE i=0 UNION ALL SELECT u."Symbol", u.i, k.y+(k.p+0.01)/(k.p+0.01+rr)*(u.mid-k.y), (1-(k.p+0.01)/(k.p+0.01+rr))*(k.p+0.01) FROM k JOIN u ON u."Symbol"=k."Symbol" AND u.i=k.i+1)"""


@query("w14_kalman_smooth", "WITH RECURSIVE " + TICKS_SQL + ", " + KS + f" SELECT u.seq, {rr('kalman_price=k.y','kalman_volatility=sqrt(k.p)')} FROM u JOIN k ON k.\"Symbol\"=u.\"Symbol\" AND k.i=u.i")
def _(t):
    return shown(ind.kalman_smooth(t.ticks), "seq", "kalman_price kalman_volatility")


@query("w21_learned_lags", with_(TICKS_SQL) + f"SELECT seq, {rr(f'mid_lag4=lag(mid,4) OVER ({W})','mid_mean7='+full_sql('avg','mid',7))} FROM t")
def _(t):
    return shown(ind.learned_lags("mid", [{"lag": 4, "window": 7}])(t.ticks), "seq", "mid_lag4 mid_mean7")


EXPO = """cr AS (SELECT a, b, corr(x,y) corr FROM pl GROUP BY 1,2), po AS (SELECT "Symbol" s, sum(CASE WHEN user_id%2=0 THEN mid ELSE -1.01*mid END) v FROM t GROUP BY 1), bk AS (SELECT s, CASE WHEN v>0 THEN 'long' ELSE 'short' END book, abs(v) v FROM po),
 tm AS (SELECT book, v*v x FROM bk UNION ALL SELECT p.book, p.v*q.v*cr.corr FROM cr JOIN bk p ON p.s=cr.a JOIN bk q ON q.s=cr.b AND q.book=p.book)"""


def _positions(t):
    return t.ticks.select(c("Symbol").alias("symbol"), F.when(c("user_id") % 2 == 0, c("mid")).otherwise(-1.01 * c("mid")).alias("notional"))


@query("a35_netted", with_(TICKS_SQL, HOURLY_SQL, PAIRS, EXPO) + f"SELECT book, {rr('exposure=sqrt(greatest(sum(x),0))', nd=None)} FROM tm GROUP BY 1")
def _(t):
    return shown(risk.netted_exposure(_positions(t), pr.pair_correlation(_pairs(t))), "book", "exposure", None)


@query("a35_weighted", with_(TICKS_SQL, HOURLY_SQL, PAIRS, EXPO) + f"SELECT a, b, {rr('exposure=p.v*q.v*corr', nd=None)} FROM (SELECT a, b, corr FROM cr UNION ALL SELECT s, s, 1.0 FROM po) x JOIN po p ON p.s=x.a JOIN po q ON q.s=x.b")
def _(t):
    return shown(risk.weighted_exposures(_positions(t), pr.pair_correlation(_pairs(t))), "a b", "exposure", None)


@query("a35_currency", "SELECT c_custkey AS id, round(c_acctbal*CASE WHEN c_nationkey<20 THEN 1+c_nationkey/10.0 ELSE 1 END,6) AS converted FROM customer")
def _(t):
    rates = t.nation.where("n_nationkey < 20").select(c("n_nationkey").alias("currency"), (1 + c("n_nationkey") / 10.0).alias("rate"))
    d = risk.convert_currency(t.customer, rates, "c_nationkey", "c_acctbal")
    return shown(d.withColumnRenamed("c_custkey", "id"), "id", "converted")
