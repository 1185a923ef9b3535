"""Queries over roll-ups, reports and risk (A, K06, W36, W42, W52-W54)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as rep, risk
from ..plans.ordered import Order
from .common import FILLS_SQL, PREDS_SQL, QUOTES_SQL, TICKS_SQL, TRADES_SQL, W, full_sql, query, rd, rr, shown, with_

c = F.col
MONTH = 30 * 86_400
TRADE = Order(("model",), "exit_time", ("trade_id",), MONTH)
FILL = Order(("symbol",), "Timestamp", ("order_id", "line", "side", "volume", "price"), MONTH * 6)
PRED = Order(("model",), "Timestamp", ("id",))
WT = "PARTITION BY model ORDER BY exit_time, trade_id"
RET = "x AS (SELECT *, pnl/100000 AS r FROM tr)"

BARS = """b AS (SELECT "Symbol", time_bucket(INTERVAL '{n}', "Timestamp") b, avg(mid) m, stddev_samp(mid) s FROM t GROUP BY 1,2)"""


@query("a01_timeframes", with_(TICKS_SQL, BARS.format(n="1 hour"), BARS.replace("b AS (", "b4 AS (", 1).format(n="4 hours")) + f"""SELECT seq, t."Symbol", {rr('mid_1h_mean=b.m','mid_1h_std=b.s','mid_4h_mean=b4.m','mid_4h_std=b4.s')} FROM t
 JOIN b ON b."Symbol"=t."Symbol" AND b.b=time_bucket(INTERVAL '1 hour', t."Timestamp") JOIN b4 ON b4."Symbol"=t."Symbol" AND b4.b=time_bucket(INTERVAL '4 hours', t."Timestamp")""")
def _(t):
    d = rep.aggregate_timeframes(t.ticks, ["mid"], {"1h": 3600, "4h": 14400})
    return shown(d, "seq Symbol", "mid_1h_mean mid_1h_std mid_4h_mean mid_4h_std")


TF = f"""k AS (SELECT *, epoch_us("Timestamp")//3600000000 b FROM t), bars AS (SELECT "Symbol", b, arg_max(mid, ("Timestamp",seq)) px FROM k GROUP BY 1,2),
 cal AS (SELECT "Symbol", unnest(range(min(b), max(b)+1)) b FROM bars GROUP BY 1), f AS (SELECT cal."Symbol", cal.b, px FROM cal LEFT JOIN bars USING ("Symbol", b)),
 d AS (SELECT *, px-lag(px) OVER (PARTITION BY "Symbol" ORDER BY b) d FROM f), u AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d,0) END up, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END dn FROM d),
 v AS (SELECT *, {full_sql('avg','px',5,'PARTITION BY "Symbol" ORDER BY b')} ma, {full_sql('avg','up',4,'PARTITION BY "Symbol" ORDER BY b')} au, {full_sql('avg','dn',4,'PARTITION BY "Symbol" ORDER BY b')} ad FROM u)"""


@query("a02_timeframe_indicators", with_(TICKS_SQL, TF) + f"SELECT seq, k.\"Symbol\", {rr('ma_1h=ma','rsi_1h=100-100/(1+au/nullif(ad,0))')} FROM k LEFT JOIN v ON v.\"Symbol\"=k.\"Symbol\" AND v.b=k.b")
def _(t):
    return shown(rep.timeframe_indicators(t.ticks, {"1h": 3600}, 5, 4), "seq Symbol", "ma_1h rsi_1h")


PM = """r AS (SELECT CAST(ts AS DATE) "Date", upper(event_type)||'-'||(user_id%7) tk, value oi, value/2 dv, value/4 bv, value hi, value lo, upper(event_type) ev FROM events),
 g AS (SELECT "Date", tk, ev, sum(oi) oi, sum(dv) dv, sum(bv) bv, max(hi) hi, min(lo) lo FROM r GROUP BY 1,2,3), tt AS (SELECT "Date", sum(oi) oi, sum(dv) dv, max(hi) hi, min(lo) lo, count(*) n FROM g GROUP BY 1),
 o AS (SELECT "Date", ev, sum(oi) oi, max(hi) hi FROM g GROUP BY 1,2), s AS (SELECT DISTINCT upper(event_type) ev FROM events)"""


@query("a03_market_rollup", with_(PM) + f"""SELECT tt."Date", s.ev AS "Symbol", tt.n AS market_count, {rr('total_open_interest=tt.oi','total_daily_volume=tt.dv','total_high=tt.hi','total_low=tt.lo','symbol_open_interest=coalesce(o.oi,0)','symbol_high=coalesce(o.hi,0)', nd=4)} FROM tt, s LEFT JOIN o ON o."Date"=tt."Date" AND o.ev=s.ev""")
def _(t):
    e = t.events
    raw = e.select(
        F.to_date("ts").alias("Date"),
        F.concat(F.upper("event_type"), F.lit("-"), (c("user_id") % 7).cast("string")).alias("report_ticker"),
        c("value").alias("open_interest"), (c("value") / 2).alias("daily_volume"), (c("value") / 4).alias("block_volume"),
        c("value").alias("high"), c("value").alias("low"),
    )
    names = e.select(F.upper("event_type").alias("Symbol")).distinct()
    mapping = raw.select("report_ticker").distinct().select("report_ticker", F.split("report_ticker", "-")[0].alias("Symbol"))
    d = rep.prediction_market_rollup(raw, mapping, names)
    return shown(d, "Date Symbol market_count", "total_open_interest total_daily_volume total_high total_low symbol_open_interest symbol_high", 4)


ORA = """e AS (SELECT event_type symbol, CAST(user_id%2 AS VARCHAR) oracle, value/500 p, CASE WHEN k>10 THEN k ELSE 1 END w, ts FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS DOUBLE) k FROM events)),
 s AS (SELECT symbol, oracle, avg(p) prob_mean, sum(p*w)/sum(w) prob_weighted, quantile_cont(p,0.5) prob_median, stddev_pop(p) prob_std, count(*) event_count, least((ln(1+sum(w))+0.25*count(*))/10,1) confidence, max(ts) latest_update FROM e GROUP BY 1,2)"""


def _oracle_events(t):
    tk = t.ticks
    return tk.select(
        c("Symbol").alias("symbol"), (c("user_id") % 2).cast("string").alias("oracle"), (c("mid") / 500).alias("probability"),
        F.when(c("Volume") > 10, c("Volume")).otherwise(0.0).alias("weight"), c("Timestamp").alias("closing_time"), c("Timestamp").alias("collected_at"),
    )


@query("a04_oracle_summary", with_(ORA) + f"SELECT symbol, oracle, event_count, latest_update, {rr('prob_mean','prob_weighted','prob_median','prob_std','confidence')} FROM s")
def _(t):
    return shown(rep.oracle_summary(_oracle_events(t)), "symbol oracle event_count latest_update", "prob_mean prob_weighted prob_median prob_std confidence")


@query("a05_oracle_features", with_(ORA) + f"""SELECT symbol, {rr("o0_prob_mean=max(prob_mean) FILTER (oracle='0')","o1_event_count=max(event_count) FILTER (oracle='1')",'oracle_prob_weighted=avg(prob_weighted)','oracle_prob_median=avg(prob_median)','oracle_event_count=sum(event_count)')} FROM s GROUP BY 1""")
def _(t):
    d = rep.oracle_features(rep.oracle_summary(_oracle_events(t)), ["0", "1"])
    d = d.withColumnsRenamed({"0_prob_mean": "o0_prob_mean", "1_event_count": "o1_event_count"})
    return shown(d, "symbol", "o0_prob_mean o1_event_count oracle_prob_weighted oracle_prob_median oracle_event_count")


def _closed_trades(t):
    tk = t.ticks
    return tk.select(
        c("Symbol"), c("Timestamp").alias("entry_time"),
        F.timestamp_micros((F.unix_micros(c("Timestamp").cast("timestamp")) + c("Volume").cast("long") * 7_000_000)).cast("timestamp_ntz").alias("exit_time"),
        c("mid").alias("entry_price"), (c("mid") + c("Volume") / 10 - 3).alias("exit_price"), c("AskVolume").alias("volume"),
        F.when(c("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (c("Volume") - 40).alias("pnl"),
    )


@query("a06_trade_summary", with_(TICKS_SQL) + f"""SELECT "Symbol", {rr('avg_hold_seconds=avg("Volume"*7)','turnover=sum(abs(mid*"AskVolume")+abs((mid+"Volume"/10-3)*"AskVolume"))', nd=3)} FROM t GROUP BY 1""")
def _(t):
    return shown(rep.trade_summary(_closed_trades(t), ["Symbol"]), "Symbol", "avg_hold_seconds turnover", 3)


@query("a06_pnl_by_duration", with_(TICKS_SQL) + 'SELECT CAST(floor("Volume"*7/60) AS BIGINT) AS duration, sum("Volume"-40) AS pnl FROM t GROUP BY 1')
def _(t):
    return rep.pnl_by_duration(_closed_trades(t))


@query("a07_pnl", with_(TICKS_SQL) + f"""SELECT "Symbol", {rr('pnl=sum(("Volume"/10-3)*"AskVolume"*CASE WHEN user_id%2=0 THEN 1 ELSE -1 END)', nd=4)} FROM t GROUP BY 1""")
def _(t):
    d = _closed_trades(t)
    p = rep.trade_pnl(c("side"), c("entry_price"), c("exit_price"), c("volume"))
    return shown(d.groupBy("Symbol").agg(F.sum(p).alias("pnl")), "Symbol", "pnl", 4)


@query("a08_broker_costs", with_(FILLS_SQL) + f"SELECT broker, count(*) AS fills, {rr('latency_ms=avg(line*1500)','slippage_bps=avg(discount*10000)','latency_p95=quantile_cont(line*1500.0,0.95)', nd=4)} FROM f GROUP BY 1")
def _(t):
    d = t.fills.withColumn("order_ts", c("Timestamp")).withColumn(
        "fill_ts", F.timestamp_micros(F.unix_micros(c("Timestamp").cast("timestamp")) + c("line") * 1_500_000).cast("timestamp_ntz")
    )
    d = rep.broker_costs(d.withColumn("slippage_bps", c("discount") * 10000))
    return shown(d, "broker fills", "latency_ms slippage_bps latency_p95", 4)


@query("a09_fill_quality", with_(FILLS_SQL) + f"""SELECT *, fill_ratio<0.7 AS low_fill, cancel_rate>0.5 AS high_cancel, slippage>0.05 AS high_slippage FROM (SELECT broker, {rr("fill_ratio=sum(CASE WHEN side='buy' THEN 1.0 ELSE 0 END)/count(*)",'cancel_rate=sum(CASE WHEN line>5 THEN 1.0 ELSE 0 END)/count(*)','slippage=avg(discount)')} FROM f GROUP BY 1)""")
def _(t):
    d = t.fills.select("broker", F.lit(1.0).alias("placed"), F.when(c("side") == "buy", 1.0).otherwise(0.0).alias("filled"), F.when(c("line") > 5, 1.0).otherwise(0.0).alias("cancelled"), c("discount").alias("slippage"))
    d = rep.fill_quality(d, ["broker"], 0.7, 0.05)
    return shown(d, "broker low_fill high_cancel high_slippage", "fill_ratio cancel_rate slippage")


@query("a10_regime_pnl", with_(TRADES_SQL, "d AS (SELECT CAST(exit_time AS DATE) date, model, regime, sum(pnl) pnl_daily FROM tr GROUP BY 1,2,3)") + f"""SELECT date, model, regime, {rr('pnl_daily','pnl_weekly=sum(pnl_daily) OVER (PARTITION BY model, regime, date_trunc(\'week\', date - INTERVAL 1 DAY))', nd=7)} FROM d""")
def _(t):
    return shown(rep.regime_pnl(t.trades), "date model regime", "pnl_daily pnl_weekly", 7)


@query("a11_monthly", with_(TRADES_SQL, 'd AS (SELECT CAST(exit_time AS DATE) date, sum(pnl) "return", avg(pnl) sharpe, min(pnl) drawdown FROM tr GROUP BY 1)') + f"""SELECT strftime(date,'%Y-%m') AS month, {rr('return=sum("return")','sharpe=avg(sharpe)','drawdown=min(drawdown)', nd=6)} FROM d GROUP BY 1""")
def _(t):
    d = t.trades.groupBy(F.to_date("exit_time").alias("date")).agg(F.sum("pnl").alias("return"), F.avg("pnl").alias("sharpe"), F.min("pnl").alias("drawdown"))
    return shown(rep.monthly_report(d), "month", "return sharpe drawdown", 6)


POS = """o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Timestamp", order_id, line, side, volume, price) rn, CASE WHEN side='sell' THEN -volume ELSE volume END v FROM f),
 p AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY rn) cv FROM o), l AS (SELECT *, max(CASE WHEN abs(cv)<1e-9 THEN rn END) OVER (PARTITION BY symbol) fl FROM p)"""


@query("a12_positions", with_(FILLS_SQL, POS) + f"SELECT symbol, sum(v) AS volume, CAST(sum(v*price)/sum(v) AS FLOAT) AS avg_price FROM l WHERE rn>coalesce(fl,0) GROUP BY symbol")
def _(t):
    return rep.open_positions(t.fills, FILL).withColumn("avg_price", c("avg_price").cast("float"))


@query("a13_win_rates", with_(TRADES_SQL) + f"SELECT model AS name, {rr('accuracy=avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0 END)')} FROM tr GROUP BY 1 UNION ALL SELECT '__overall__', round(avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0 END),6) FROM tr")
def _(t):
    return shown(rep.win_rates(t.trades, "model", "accuracy"), "name", "accuracy")


@query("a13_reasons", "SELECT role AS name, round(avg(CASE WHEN length(text)%2=0 THEN 1.0 ELSE 0 END),6) AS accuracy FROM conversations GROUP BY 1 UNION ALL SELECT '__overall__', round(avg(CASE WHEN length(text)%2=0 THEN 1.0 ELSE 0 END),6) FROM conversations")
def _(t):
    d = t.conversations.select("role", F.when(F.length("text") % 2 == 0, 1).otherwise(-1).alias("pnl"))
    return shown(rep.win_rates(d, "role", "accuracy"), "name", "accuracy")


@query("a13_importance", "SELECT key AS feature, round(avg(CAST(value AS DOUBLE)),6) AS importance FROM (SELECT unnest(['k']) key, json_extract_string(props,'$.k') value FROM events) GROUP BY 1")
def _(t):
    d = t.events.select(F.from_json("props", "map<string,double>").alias("feature_importance"))
    return shown(rep.mean_importance(d), "feature", "importance")


SB = """h AS (SELECT *, pnl/100000 r, row_number() OVER (PARTITION BY model, regime ORDER BY exit_time DESC, trade_id DESC) rn FROM tr), w AS (SELECT * FROM h WHERE rn<=252),
 a AS (SELECT model, regime, 'hold' algorithm, exit_time, trade_id, r x FROM w UNION ALL SELECT model, regime, 'flip', exit_time, trade_id, CASE WHEN trade_id%2=0 THEN r ELSE -r END FROM w),
 g AS (SELECT *, product(1+x) OVER (PARTITION BY model, regime, algorithm ORDER BY exit_time, trade_id) gr FROM a), k AS (SELECT *, max(gr) OVER (PARTITION BY model, regime, algorithm ORDER BY exit_time, trade_id) pk FROM g)"""


@query("a14_scoreboard", with_(TRADES_SQL, SB) + f"SELECT model, regime, algorithm, {rr('pnl=sum(x)','sharpe=avg(x)/(stddev_pop(x)+1e-9)','drawdown=max(pk-gr)','daily_loss=-min(least(x,0))', nd=8)}, max(pk-gr)>0.03 AS total_limit_violation FROM k GROUP BY 1,2,3")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    acts = {"hold": F.lit(1.0), "flip": F.when(c("trade_id") % 2 == 0, 1.0).otherwise(-1.0)}
    s = risk.scoreboard(d, acts, "r", 252, TRADE.with_keys("model", "regime"), total_limit=0.03)
    return shown(s, "model regime algorithm total_limit_violation", "pnl sharpe drawdown daily_loss", 8)


WF = f"""n AS (SELECT *, row_number() OVER ({WT})-1 j, count(*) OVER (PARTITION BY model) n FROM x), v AS (SELECT n.*, w.w FROM n, LATERAL (SELECT unnest(range(0, 1+(n.n-250)//75)) w) w WHERE j>=w.w*75+200 AND j<w.w*75+250)"""


@query("a15_walk_forward", with_(TRADES_SQL, RET, WF, "g AS (SELECT *, product(1+r) OVER (PARTITION BY model, w ORDER BY j) gr FROM v)", "k AS (SELECT *, max(gr) OVER (PARTITION BY model, w ORDER BY j) pk FROM g)", "s AS (SELECT model, w, avg(r)/stddev_pop(r) sh, min(gr/pk-1) dd FROM k GROUP BY 1,2)") + f"SELECT model, count(*) AS windows, {rr('avg_sharpe=avg(sh)','worst_drawdown=min(dd)', nd=8)} FROM s GROUP BY 1")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    return shown(rep.walk_forward_metrics(d, "r", 200, 50, 75, TRADE), "model windows", "avg_sharpe worst_drawdown", 8)


@query("a15_walk_forward_rmse", with_(TRADES_SQL, RET, WF, WF.split(", v AS")[0].replace("n AS", "n2 AS", 1), "tv AS (SELECT n2.model, w.w, avg(r) mu FROM n2, LATERAL (SELECT unnest(range(0, 1+(n2.n-250)//75)) w) w WHERE j>=w.w*75 AND j<w.w*75+200 GROUP BY 1,2)") + f"SELECT v.model, w AS \"window\", {rr('rmse=sqrt(avg(power(r-mu,2)))', nd=8)} FROM v JOIN tv USING (model, w) GROUP BY 1,2")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    return shown(rep.walk_forward_rmse(d, "r", 200, 50, 75, TRADE), "model window", "rmse", 8)


@query("w36_windows", with_(TRADES_SQL, RET, WF) + "SELECT trade_id, w AS \"window\" FROM v")
def _(t):
    return rep.walk_forward_windows(t.trades, 200, 50, 75, TRADE).select("trade_id", "window")


@query("a16_benchmark", with_(TRADES_SQL, RET, f"z AS (SELECT *, CASE WHEN trade_id%3=0 THEN 0.0 ELSE r*1000 END pos, quantile_cont(r,0.05) OVER (PARTITION BY model) va FROM x)", f"y AS (SELECT *, abs(pos-lag(pos) OVER ({WT})) dp FROM z)") + f"SELECT model, {rr('sharpe=sqrt(252)*avg(r)/stddev_pop(r)','cvar=avg(r) FILTER (r<=va)','turnover=sum(dp)', nd=8)} FROM y GROUP BY 1")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000).withColumn("pos", F.when(c("trade_id") % 3 == 0, 0.0).otherwise(c("r") * 1000))
    return shown(risk.benchmark(d, "r", "pos", TRADE), "model", "sharpe cvar turnover", 8)


RANK = "(rank() OVER ({w}) + (count(*) OVER ({p}) - 1)/2.0)"


def rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pp = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return RANK.format(w=f"{p}ORDER BY {col}", p=pp)


@query("a17_ic", with_(PREDS_SQL, f"r AS (SELECT regime, {rank_sql('prob','regime')} a, {rank_sql('value','regime')} b FROM p)") + f"SELECT regime, count(*) AS n, {rr('ic=corr(a,b)')} FROM r GROUP BY 1")
def _(t):
    return shown(risk.spearman(t.preds, "prob", "value", ["regime"]), "regime n", "ic")


@query("a17_ic_overall", with_(PREDS_SQL, f"r AS (SELECT {rank_sql('prob')} a, {rank_sql('value')} b FROM p)") + f"SELECT count(*) AS n, {rr('ic=corr(a,b)')} FROM r")
def _(t):
    return shown(risk.spearman(t.preds, "prob", "value"), "n", "ic")


LONGF = "l AS (SELECT 'prob' feature, prob v, value pn FROM p UNION ALL SELECT 'regime', regime::DOUBLE, value FROM p)"


@query("a18_feature_pnl", with_(PREDS_SQL, LONGF, f"r AS (SELECT *, {rank_sql('v','feature')} a, {rank_sql('pn','feature')} b FROM l)") + f"SELECT feature, {rr('pearson=corr(v,pn)','spearman=corr(a,b)')} FROM r GROUP BY 1")
def _(t):
    return shown(risk.feature_pnl_correlation(t.preds, ["prob", "regime"], "value"), "feature", "pearson spearman")


MODELS = "m AS (SELECT prob m1, prob*prob m2, 1-prob/(1+regime) m3, y FROM p)"


def _models(t):
    return t.preds.select(c("prob").alias("m1"), (c("prob") * c("prob")).alias("m2"), (1 - c("prob") / (1 + c("regime"))).alias("m3"), "y")


PAIRS3 = " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, corr({a}-y,{b}-y) corr FROM m" for a in ("m1", "m2", "m3") for b in ("m1", "m2", "m3") if a != b)


@query("a19_error_corr", with_(PREDS_SQL, MODELS) + f"SELECT a, b, round(corr,6)+0.0 AS corr FROM ({PAIRS3})")
def _(t):
    return shown(risk.error_correlations(_models(t), ["m1", "m2", "m3"], "y"), "a b", "corr")


@query("a19_diversity", with_(PREDS_SQL, MODELS, f"e AS (SELECT a, greatest(1-avg(abs(corr)),0) w FROM ({PAIRS3}) GROUP BY 1)") + "SELECT a AS model, round(w/sum(w) OVER (),6)+0.0 AS weight FROM e")
def _(t):
    return shown(risk.diversity_weights(risk.error_correlations(_models(t), ["m1", "m2", "m3"], "y")), "model", "weight")


DD = f"""g AS (SELECT *, product(1+r) OVER ({WT}) gr, sum(r) OVER ({WT}) cu FROM x), k AS (SELECT *, max(gr) OVER ({WT}) pk, max(cu) OVER ({WT}) cp, row_number() OVER (PARTITION BY model ORDER BY exit_time DESC, trade_id DESC) rn FROM g)"""


@query("a20_drawdown", with_(TRADES_SQL, RET, DD) + f"SELECT model, {rr('dd_pct=min(gr/pk-1)','dd_abs=max(pk-gr)','dd_sum=max(cp-cu)','dd_sum_ratio=max((cp-cu)/greatest(cp,1e-8))','total_return=max(CASE WHEN rn=1 THEN gr-1 END)', nd=7)} FROM k GROUP BY 1")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    return shown(risk.performance(d, "r", TRADE), "model", "dd_pct dd_abs dd_sum dd_sum_ratio total_return", 7)


@query("a21_sharpe", with_(TRADES_SQL, RET) + f"SELECT model, count(*) AS n, {rr('sharpe=sqrt(252)*avg(r)/stddev_pop(r)','sharpe_raw=avg(r)/stddev_pop(r)','sharpe_eps=avg(r)/(stddev_pop(r)+1e-9)','sharpe_n=avg(r)/(stddev_samp(r)+1e-8)*sqrt(count(*))','win_rate=avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END)')} FROM x GROUP BY 1")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    return shown(risk.performance(d, "r", TRADE), "model n", "sharpe sharpe_raw sharpe_eps sharpe_n win_rate")


CL = f"""o AS (SELECT *, CAST(prob>=0.6 AS INT) pr, CASE WHEN prob>=0.6 THEN CASE WHEN y=1 THEN 1.0 ELSE -1.0 END ELSE 0 END r FROM p), cu AS (SELECT *, sum(r) OVER (PARTITION BY model ORDER BY "Timestamp", id) s FROM o), pk AS (SELECT *, max(s) OVER (PARTITION BY model ORDER BY "Timestamp", id) k FROM cu),
 ag AS (SELECT model, avg(r) er, stddev_pop(r) sd, max(k-s)::DOUBLE dd, 2.0*count(*) FILTER (y=1 AND pr=1)/nullif(sum(pr)+sum(y),0) f1 FROM pk GROUP BY 1)"""


@query("a22_classification", with_(PREDS_SQL, CL) + f"SELECT model, {rr('expected_return=er','drawdown=dd','sharpe=er/(sd+1e-9)','calmar=er/(dd+1e-9)','f1','objective=f1+er-dd')} FROM ag")
def _(t):
    d = t.preds.withColumn("pr", (c("prob") >= 0.6).cast("int"))
    return shown(risk.classification_risk(d, "y", "pr", PRED), "model", "expected_return drawdown sharpe calmar f1 objective")


@query("a23_bootstrap_sharpe")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    return risk.bootstrap_sharpe(d, "r", "trade_id", 50, keys=["model"])


@query("a23_bootstrap_classes")
def _(t):
    d = t.preds.withColumn("pr", (c("prob") >= 0.6).cast("int"))
    return risk.bootstrap_classification(d, "y", "pr", "id", 50)


@query("a24_decayed_var", with_(TRADES_SQL, "a AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY exit_time DESC, trade_id DESC)-1 age FROM tr)") + f"SELECT model, {rr('var=-quantile_cont(pnl*power(0.94::DOUBLE,age),0.01)')} FROM a WHERE age<500 GROUP BY 1")
def _(t):
    return shown(risk.decayed_var(t.trades, "pnl", TRADE), "model", "var")


@query("a24_cvar", with_(TRADES_SQL, "a AS (SELECT *, quantile_cont(pnl,0.05) OVER (PARTITION BY model) q FROM tr)") + f"SELECT model, {rr('var=max(q)','cvar=avg(pnl) FILTER (pnl<=q)')} FROM a GROUP BY 1")
def _(t):
    return shown(risk.cvar(t.trades, ["model"], "pnl"), "model", "var cvar")


@query("a24_tail", with_(TRADES_SQL, "e AS (SELECT model, CASE WHEN pnl<-200 THEN -pnl-200 END x FROM tr)", "s AS (SELECT model, count(*) total, count(x) n_exceed, avg(x) mean_excess, var_samp(x) v FROM e GROUP BY 1)") + f"SELECT model, total, n_exceed, {rr('mean_excess','shape=0.5*(1-mean_excess*mean_excess/v)','tail_prob=CASE WHEN n_exceed>=3 THEN n_exceed/total ELSE 0 END')} FROM s")
def _(t):
    return shown(risk.tail_exceedances(t.trades, ["model"], "pnl", 200), "model total n_exceed", "mean_excess shape tail_prob")


ST = """d AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY exit_time, trade_id) rn FROM tr),
 a AS (SELECT model, exit_time, trade_id, 'baseline' scenario, pnl p FROM d UNION ALL SELECT model, exit_time, trade_id, 'y2000', pnl FROM d WHERE exit_time>=TIMESTAMP '2000-03-01' AND exit_time<TIMESTAMP '2000-06-01'
 UNION ALL SELECT model, exit_time, trade_id, 'synthetic', CASE WHEN rn=1 THEN pnl-0.1 ELSE pnl END FROM d UNION ALL SELECT model, exit_time, trade_id, 'crash', pnl*0.7 FROM d),
 u AS (SELECT *, sum(p) OVER q cu, row_number() OVER q n FROM a WINDOW q AS (PARTITION BY model, scenario ORDER BY exit_time, trade_id)), k AS (SELECT *, max(cu) OVER (PARTITION BY model, scenario ORDER BY exit_time, trade_id) pk FROM u),
 s AS (SELECT model, scenario, sum(p) pnl, -min(cu-pk) dd, max(CASE WHEN cu-pk=0 THEN n-1 END) rec, sum(abs(p)) liq FROM k GROUP BY 1,2)"""


@query("a25_stress", with_(TRADES_SQL, ST) + f"""SELECT s.model, s.scenario, {rr('pnl=s.pnl','max_drawdown=s.dd','recovery=s.rec','liquidity=s.liq',"hedge=CASE WHEN s.scenario='baseline' THEN 1 ELSE 1-s.dd/b.dd END", nd=4)}, CASE WHEN s.dd>10000 THEN 'disable' WHEN s.dd>5000 THEN 'adjust' ELSE 'ok' END AS action FROM s JOIN s b ON b.model=s.model AND b.scenario='baseline'""")
def _(t):
    d = risk.stress(t.trades, "pnl", TRADE, {"y2000": ("2000-03-01", "2000-05-31")}, 0.1, {"crash": -0.3}, max_drawdown=10000)
    return shown(d, "model scenario action", "pnl max_drawdown recovery liquidity hedge", 4)


CONF = "q AS (SELECT regime, quantile_cont(abs(y-prob),0.9) q FROM p GROUP BY 1)"


@query("a30_conformal", with_(PREDS_SQL, CONF) + f"SELECT regime, {rr('q=max(q.q)','coverage=avg(CASE WHEN y>=prob-q.q AND y<=prob+q.q THEN 1.0 ELSE 0 END)')} FROM p JOIN q USING (regime) GROUP BY 1")
def _(t):
    p = t.preds
    q = risk.conformal_quantiles(p, c("y") - c("prob"))
    cov = risk.coverage(risk.conformal_intervals(p, "prob", q), "y")
    return shown(q.join(cov, "regime"), "regime", "q coverage")


F1 = """d AS (SELECT regime, prob, sum(y) tp, count(*) n FROM p GROUP BY 1,2), k AS (SELECT *, sum(tp) OVER o ctp, sum(n) OVER o cn, sum(tp) OVER (PARTITION BY regime) pos FROM d WINDOW o AS (PARTITION BY regime ORDER BY prob DESC)),
 f AS (SELECT *, 2*(ctp/cn)*(ctp/pos)/(ctp/cn+ctp/pos+1e-12) f1 FROM k)"""


@query("a31_thresholds", with_(PREDS_SQL, F1) + f"SELECT regime, {rr('threshold','f1')} FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY round(f1,12) DESC, prob) rn, prob threshold FROM f) WHERE rn=1")
def _(t):
    return shown(risk.f1_thresholds(t.preds, "y", "prob"), "regime", "threshold f1")


@query("a32_reliability", with_(PREDS_SQL) + f"SELECT CAST(least(floor(prob*10),9) AS INT) AS bin, count(*) AS n, {rr('mean_prob=avg(prob)','rate=avg(y)')} FROM p GROUP BY 1")
def _(t):
    return shown(risk.reliability(t.preds, "y", "prob"), "bin n", "mean_prob rate")


@query("a32_brier", with_(PREDS_SQL) + f"SELECT regime, {rr('brier=avg(power(prob-y,2))')} FROM p GROUP BY 1")
def _(t):
    return shown(risk.brier(t.preds, "y", "prob", ["regime"]), "regime", "brier")


NIG = """s AS (SELECT model, count(*) n, avg(r*1000) m, var_pop(r*1000) v FROM x GROUP BY 1), q AS (SELECT *, n*m/(1+n) mu, 1+n/2.0 al, 1+0.5*v*n+n*m*m/(2*(1+n)) be FROM s), z AS (SELECT *, greatest(mu/sqrt(be/(al-1)+1e-9)*n/(n+10),0) sc FROM q)"""


@query("a33_bayesian", with_(TRADES_SQL, RET, NIG) + f"SELECT model, n, {rr('mu','alpha=al','beta=be','weight=CASE WHEN sum(sc) OVER ()>0 THEN sc/sum(sc) OVER () ELSE 1.0/count(*) OVER () END')} FROM z")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100)
    return shown(risk.bayesian_weights(d, "model", "r"), "model n", "mu alpha beta weight")


@query("a34_budget", with_(TRADES_SQL, RET, DD, "s AS (SELECT model, 1/((abs(min(gr/pk-1))+1e-6)*(stddev_samp(r)+1e-6)+1e-12) iv FROM k GROUP BY 1)") + f"SELECT model, {rr('budget=1000*iv/sum(iv) OVER ()', nd=5)} FROM s")
def _(t):
    d = t.trades.withColumn("r", c("pnl") / 100000)
    return shown(risk.budget(d, "r", TRADE, 1000.0), "model", "budget", 5)


@query("a34_softmax", with_(TRADES_SQL, "s AS (SELECT model, avg(pnl) p, stddev_pop(pnl)/100 r FROM tr GROUP BY 1)", "e AS (SELECT model, exp(p-r-max(p-r) OVER ()) e FROM s)") + f"SELECT model, {rr('weight=e/sum(e) OVER ()')} FROM e")
def _(t):
    d = t.trades.groupBy("model").agg(F.avg("pnl").alias("p"), (F.stddev_pop("pnl") / 100).alias("r"))
    return shown(risk.softmax_weights(d, "p", "r"), "model", "weight")


@query("a36_consensus", with_(TICKS_SQL, """g AS (SELECT date_trunc('hour',"Timestamp") hr, greatest(least("Volume"/50-1,1),-1) v, "AskVolume" w FROM t)""", "m AS (SELECT hr, sum(v*w)/sum(w) mean FROM g GROUP BY 1)") + f"SELECT hr, {rr('mean=max(mean)','consensus=greatest(least(1-sum(abs(v-mean)*w)/sum(w),1),0)')} FROM g JOIN m USING (hr) GROUP BY 1")
def _(t):
    d = t.ticks.select(F.date_trunc("hour", "Timestamp").cast("timestamp_ntz").alias("hr"), (c("Volume") / 50 - 1).alias("s"), "AskVolume")
    return shown(risk.consensus(d, ["hr"], "s", c("AskVolume")), "hr", "mean consensus")


@query("a37_logit", with_(PREDS_SQL, "m AS (SELECT id, prob*0.98+0.01 a, prob*prob*0.98+0.01 b FROM p)") + f"SELECT id, {rr('prob=1/(1+exp(-(ln(a/(1-a+1e-12))+ln(b/(1-b+1e-12)))/2))')} FROM m")
def _(t):
    p = c("prob")
    return t.preds.select("id", rd(risk.logit_average([p * 0.98 + 0.01, p * p * 0.98 + 0.01])).alias("prob"))


@query("a38_factors", with_(TICKS_SQL, 's AS (SELECT "Symbol", sum("Volume"*"Volume") xx, sum("Volume"*"AskVolume") xz, sum("AskVolume"*"AskVolume") zz, sum("Volume"*mid) xy, sum("AskVolume"*mid) zy FROM t GROUP BY 1)') + f"SELECT \"Symbol\", {rr('beta_Volume=(zz*xy-xz*zy)/(xx*zz-xz*xz)','beta_AskVolume=(xx*zy-xz*xy)/(xx*zz-xz*xz)')} FROM s")
def _(t):
    return shown(risk.factor_exposures(t.ticks, "mid", ["Volume", "AskVolume"]), "Symbol", "beta_Volume beta_AskVolume")


DML = """d AS (SELECT seq%2 f, "Volume" x, mid y, CAST("AskVolume">25 AS DOUBLE) tt FROM t), co AS (SELECT f, regr_slope(tt,x) ts, regr_intercept(tt,x) ti, regr_slope(y,x) ys, regr_intercept(y,x) yi FROM d GROUP BY 1),
 r AS (SELECT tt-(ti+ts*x) rt, y-(yi+ys*x) ry FROM d JOIN co ON co.f<>d.f)"""


@query("a39_treatment", with_(TICKS_SQL, DML) + f"SELECT {rr('effect=sum(rt*ry)/sum(rt*rt)', nd=5)} FROM r")
def _(t):
    d = t.ticks.withColumn("tt", (c("AskVolume") > 25).cast("double"))
    e = risk.treatment_effect(d, "tt", "mid", ["Volume"], c("seq") % 2)
    # the estimate is one number; it is put next to the table it was made from
    return d.groupBy().agg(F.round(F.lit(e), 5).alias("effect"))


@query("a40_coverage", with_(PREDS_SQL) + f"SELECT regime AS alpha, count(*) AS n, {rr('coverage=avg(CASE WHEN value>=prob*30 THEN 1.0 ELSE 0 END)')} FROM p GROUP BY 1")
def _(t):
    d = t.preds.withColumn("v", c("prob") * 30).withColumnRenamed("regime", "alpha")
    return shown(risk.quantile_coverage(d, "value", "v"), "alpha n", "coverage")


@query("a41_divergence", with_(TICKS_SQL, 'g AS (SELECT *, "Volume"*0.01 gap FROM t WHERE user_id%3=0)') + f"""SELECT "Symbol", count(*) AS overlap, arg_max("Timestamp", (round(gap,6), -epoch_us("Timestamp"))) AS max_at, {rr('mean_diff=avg(gap)','max_diff=max(gap)')}, max(gap)>0.9 AS alert FROM g GROUP BY 1""")
def _(t):
    a = t.ticks.withColumn("mid", F.lit(0.0))
    b = t.ticks.where(c("user_id") % 3 == 0).withColumn("mid", c("Volume") * 0.01)
    return shown(rep.feed_divergence(a, b, 0.9), "Symbol overlap max_at alert", "mean_diff max_diff")


@query("a41_events", with_(TICKS_SQL, f"g AS (SELECT *, \"Volume\">80 o, coalesce(lag(\"Volume\">80) OVER ({W}),false) w FROM t)") + "SELECT seq, CASE WHEN o AND NOT w THEN 'raised' ELSE 'resolved' END AS event FROM g WHERE o<>w")
def _(t):
    return rep.divergence_events(t.ticks, c("Volume"), 80).select("seq", "event")


@query("a42_fold_inventory", with_(TRADES_SQL, RET, WF) + "SELECT model, w AS \"window\", count(*) AS n FROM v GROUP BY 1,2")
def _(t):
    return rep.walk_forward_windows(t.trades, 200, 50, 75, TRADE).groupBy("model", "window").agg(F.count(F.lit(1)).alias("n"))


@query("a43_event_impact", with_(TICKS_SQL) + f"""SELECT user_id, {rr('impact=coalesce(sum(("Volume"/50-1)*"AskVolume")/nullif(sum("AskVolume"),0),0)')} FROM t GROUP BY 1""")
def _(t):
    d = t.ticks.withColumn("s", c("Volume") / 50 - 1)
    return shown(rep.event_impact(d, "user_id", "s", "AskVolume"), "user_id", "impact")


@query("a44_covariance", with_(TICKS_SQL) + """SELECT 'mid' AS a, 'mid' AS b, round(avg(mid),5) AS mean_a, round(covar_pop(mid,mid),5) AS cov FROM t UNION ALL SELECT 'mid','Volume',round(avg(mid),5),round(covar_pop(mid,"Volume"),5) FROM t UNION ALL SELECT 'Volume','Volume',round(avg("Volume"),5),round(covar_pop("Volume","Volume"),5) FROM t""")
def _(t):
    return shown(risk.covariance_summary(t.ticks, ["mid", "Volume"]), "a b", "mean_a cov", 5)


@query("k06_tail", with_(TRADES_SQL) + "SELECT model, trade_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY exit_time DESC, trade_id DESC) rn FROM tr) WHERE rn<=100")
def _(t):
    return risk.last_rows(t.trades, 100, TRADE).select("model", "trade_id")


@query("w42_latest", with_(TRADES_SQL) + "SELECT customer, arg_max(trade_id,(exit_time,trade_id)) AS trade_id, arg_max(pnl,(exit_time,trade_id)) AS pnl FROM tr GROUP BY 1")
def _(t):
    return rep.latest_per_key(t.trades.select("customer", "exit_time", "trade_id", "pnl"), ["customer"], ["exit_time", "trade_id"]).select("customer", "trade_id", "pnl")


@query("w52_health", with_(TRADES_SQL, f"h AS (SELECT *, avg(pnl) OVER q m, stddev_samp(pnl) OVER q s, count(*) OVER q n, avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0 END) OVER q wr FROM tr WINDOW q AS ({WT} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))") + f"SELECT trade_id, {rr('sharpe=CASE WHEN n>1 THEN m/(s+1e-8)*sqrt(n) ELSE 0 END','win_rate=wr')}, CASE WHEN n>1 THEN m/(s+1e-8)*sqrt(n) ELSE 0 END>=0 AND wr>=0.5 AS healthy FROM h")
def _(t):
    return shown(rep.rolling_health(t.trades, "pnl", 100, TRADE), "trade_id healthy", "sharpe win_rate")


@query("w53_prediction_drift", with_(PREDS_SQL, 'h AS (SELECT *, abs(prob-avg(prob) OVER (PARTITION BY model ORDER BY "Timestamp", id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) d FROM p)') + f"SELECT id, {rr('drift=d')}, coalesce(d>0.40001,false) AS drifted FROM h")
def _(t):
    return shown(rep.prediction_drift(t.preds, "prob", 20, 0.40001, PRED), "id drifted", "drift")


@query("w54_latency", with_(PREDS_SQL) + f"SELECT id, {rr('latency_avg=avg(value) OVER (PARTITION BY model ORDER BY \"Timestamp\", id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} FROM p")
def _(t):
    return shown(rep.mean_latency(t.preds, "value", 7, PRED), "id", "latency_avg")
