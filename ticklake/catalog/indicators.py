"""Queries over the indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators.base import apply_together
from .common import TICKS_SQL, W, full_sql, query, rr, shown, with_

T = with_(TICKS_SQL)
TR = f'greatest("High"-"Low", abs("High"-lag(mid) OVER ({W})), abs("Low"-lag(mid) OVER ({W})))'
K = 'seq, "Symbol"'
KS = "seq Symbol"


@query("w01_sma", T + f"SELECT {K}, {rr('ma_5','ma_20','ma_240')} FROM (SELECT *, {full_sql('avg','mid',5)} ma_5, {full_sql('avg','mid',20)} ma_20, {full_sql('avg','mid',240)} ma_240 FROM t)")
def _(t):
    return shown(apply_together(t.ticks, [ind.sma("mid", n) for n in (5, 20, 240)]), KS, "ma_5 ma_20 ma_240")


BOLL = f"b AS (SELECT *, {full_sql('avg','mid',20)} ma, {full_sql('stddev_samp','mid',20)} sd FROM t)"


@query("w02_bollinger", with_(TICKS_SQL, BOLL) + f"""SELECT {K}, {rr('boll_ma=ma','boll_upper=ma+2*sd','boll_lower=ma-2*sd','boll_width=4*sd/ma')},
 CAST(CASE WHEN mid>ma+2*sd THEN 1 WHEN mid<ma-2*sd THEN -1 ELSE 0 END AS INT) AS boll_break FROM b""")
def _(t):
    d = ind.bollinger()(t.ticks)
    return shown(d, KS + " boll_break", "boll_ma boll_upper boll_lower boll_width")


@query("w03_atr", with_(TICKS_SQL, f"r AS (SELECT *, {TR} tr FROM t)") + f"""SELECT {K}, {rr('atr_14=a','atr_stop_long=mid-3*a','atr_stop_short=mid+3*a')}
 FROM (SELECT *, {full_sql('avg','tr',14)} a FROM r)""")
def _(t):
    return shown(ind.atr(14)(t.ticks), KS, "atr_14 atr_stop_long atr_stop_short")


@query("w03_atr_mid", with_(TICKS_SQL, f"r AS (SELECT *, abs(mid-lag(mid) OVER ({W})) tr FROM t)") + f"SELECT {K}, {rr('atr_mid=a')} FROM (SELECT *, {full_sql('avg','tr',14)} a FROM r)")
def _(t):
    return shown(ind.atr_mid(14)(t.ticks), KS, "atr_mid")


RSI = f"""r AS (SELECT *, mid-lag(mid) OVER ({W}) d FROM t), u AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d,0) END up, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END dn FROM r),
 v AS (SELECT *, {full_sql('avg','up',14)} au, {full_sql('avg','dn',14)} ad FROM u)"""


@query("w04_rsi", with_(TICKS_SQL, RSI) + f"SELECT {K}, {rr('rsi_14=100-100/(1+au/nullif(ad,0))','rsi_full=CASE WHEN ad=0 THEN 100 ELSE 100-100/(1+au/nullif(ad,0)) END')} FROM v")
def _(t):
    d = apply_together(t.ticks, [ind.rsi(), ind.rsi(out="rsi_full", zero_loss="100")])
    return shown(d, KS, "rsi_14 rsi_full")


def ema_sql(src: str, x: str, span: float | None = None, alpha: float | None = None) -> str:
    """Closed form of the exponential average of ``x`` in ``src``: a weighted sum over all earlier rows."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    return f"""(SELECT p.seq, sum(q.{x} * CASE WHEN q.i=0 THEN power({1-a!r}::DOUBLE, p.i) ELSE {a!r}::DOUBLE*power({1-a!r}::DOUBLE, p.i-q.i) END) y
 FROM {src} p JOIN {src} q ON p."Symbol"=q."Symbol" AND q.i<=p.i GROUP BY p.seq)"""


@query("w05_ema", T + f"SELECT t.seq, t.\"Symbol\", {rr('ema_12=a.y','ema_26=b.y')} FROM t JOIN {ema_sql('t','mid',12)} a USING (seq) JOIN {ema_sql('t','mid',26)} b USING (seq)")
def _(t):
    return shown(ind.ema(t.ticks, {"ema_12": ("mid", 12), "ema_26": ("mid", 26)}), KS, "ema_12 ema_26")


MACD = f"m AS MATERIALIZED (SELECT t.seq, t.\"Symbol\", t.i, a.y-b.y AS macd FROM t JOIN {ema_sql('t','mid',12)} a USING (seq) JOIN {ema_sql('t','mid',26)} b USING (seq))"


@query("w06_macd", with_(TICKS_SQL, MACD) + f"SELECT m.seq, m.\"Symbol\", {rr('macd=m.macd','macd_signal=s.y')}, CAST(sign(round(m.macd-s.y,9)) AS INT) AS macd_cross FROM m JOIN {ema_sql('m','macd',9)} s USING (seq)")
def _(t):
    d = ind.macd(t.ticks)
    return shown(d.withColumn("macd_cross", F.signum(F.round("macd_hist", 9)).cast("int")), KS + " macd_cross", "macd macd_signal")


@query("w07_stochastic", with_(TICKS_SQL, f"""s AS (SELECT *, {full_sql('min','"Low"',14)} lo, {full_sql('max','"High"',14)} hi FROM t), k AS (SELECT *, 100*(mid-lo)/nullif(hi-lo,0) sk FROM s)""") + f"SELECT {K}, {rr('stoch_k=sk','stoch_d=sd')} FROM (SELECT *, {full_sql('avg','sk',3)} sd FROM k)")
def _(t):
    return shown(ind.stochastic()(t.ticks), KS, "stoch_k stoch_d")


@query("w08_vwap", T + f"""SELECT {K}, {rr('vwap=sum(mid*"Volume") OVER a/nullif(sum("Volume") OVER a,0)','vwap_day=sum(mid*"Volume") OVER d/nullif(sum("Volume") OVER d,0)')} FROM t
 WINDOW a AS ({W} ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY "Symbol", CAST("Timestamp" AS DATE) ORDER BY "Timestamp", seq ROWS UNBOUNDED PRECEDING)""")
def _(t):
    d = ind.vwap(t.ticks, "vwap")
    d = ind.vwap(d.withColumn("day", F.to_date("Timestamp")), "vwap_day", anchors=("day",))
    return shown(d, KS, "vwap vwap_day")


PRICE_MA = ", ".join(f"{full_sql('avg','m',n)} ma_{n}" for n in (5, 10, 30, 60))
PRICE = f"""p AS (SELECT *, ("Ask"+"Bid")/2 m, "Ask"-"Bid" sp FROM t),
 p1 AS (SELECT *, coalesce(m/nullif(lag(m) OVER ({W}),0)-1,0) ret, abs(m-lag(m) OVER ({W})) tr0, coalesce(m-lag(m) OVER ({W}),0) mc FROM p),
 p2 AS (SELECT *, coalesce(tr0,0) tr FROM p1),
 p3 AS (SELECT *, {PRICE_MA}, {full_sql('avg','m',240)} ma_h4, {full_sql('avg','m',20)} bm, {full_sql('stddev_samp','m',20)} bs, {full_sql('avg','tr',14)} atr_14,
  {full_sql('max','m',20)} donchian_high, {full_sql('min','m',20)} donchian_low, {full_sql('stddev_samp','ret',30)} volatility_30 FROM p2)"""
PRICE_COLS = "mid_change return ma_5 ma_10 ma_30 ma_60 ma_h4 boll_upper boll_lower atr_14 atr_stop_long donchian_high donchian_low volatility_30 hour_sin hour_cos"


@query("w09_price", with_(TICKS_SQL, PRICE) + f"""SELECT {K}, CAST(hour("Timestamp") AS INT) AS hour, CAST(coalesce(CAST(ma_5>ma_10 AS INT),0) AS INT) AS ma_cross,
 {rr('mid_change=mc','return=ret','ma_5','ma_10','ma_30','ma_60','ma_h4','boll_upper=bm+2*bs','boll_lower=bm-2*bs','atr_14','atr_stop_long=m-3*atr_14','donchian_high','donchian_low','volatility_30','hour_sin=sin(2*pi()*hour("Timestamp")/24)','hour_cos=cos(2*pi()*hour("Timestamp")/24)', nd=6)} FROM p3""")
def _(t):
    return shown(ind.price_block()(t.ticks.drop("mid")), KS + " hour ma_cross", PRICE_COLS, 6)


@query("w10_donchian", with_(TICKS_SQL, f"d AS (SELECT *, {full_sql('max','mid',20)} hi, {full_sql('min','mid',20)} lo FROM t)") + f"""SELECT {K}, {rr('donchian_high=hi','donchian_low=lo')},
 CAST(CASE WHEN mid>lag(hi) OVER ({W}) THEN 1 WHEN mid<lag(lo) OVER ({W}) THEN -1 ELSE 0 END AS INT) AS donchian_break FROM d""")
def _(t):
    return shown(ind.donchian()(t.ticks), KS + " donchian_break", "donchian_high donchian_low")


@query("w11_keltner", with_(TICKS_SQL, f"a AS (SELECT *, abs(mid-lag(mid) OVER ({W})) tr FROM t)", f"d AS (SELECT *, {full_sql('avg','mid',20)} + 2*{full_sql('avg','tr',20)} hi, {full_sql('avg','mid',20)} - 2*{full_sql('avg','tr',20)} lo FROM a)".replace("+ 2*CASE", "+ 2*CASE")) + f"""SELECT {K}, {rr('keltner_high=hi','keltner_low=lo')},
 CAST(CASE WHEN mid>lag(hi) OVER ({W}) THEN 1 WHEN mid<lag(lo) OVER ({W}) THEN -1 ELSE 0 END AS INT) AS keltner_break FROM d""")
def _(t):
    return shown(ind.keltner()(t.ticks), KS + " keltner_break", "keltner_high keltner_low")


SQUEEZE = f"""s AS (SELECT t.*, e.y ema, {TR} tr FROM t JOIN {ema_sql('t','mid',20)} e USING (seq)),
 s2 AS (SELECT *, {full_sql('avg','mid',20)} ma, {full_sql('stddev_samp','mid',20)} sd, {full_sql('avg','tr',20)} atr FROM s),
 s3 AS (SELECT *, ma+2*sd bu, ma-2*sd bl, ema+1.5*atr ku, ema-1.5*atr kl FROM s2),
 s4 AS (SELECT *, coalesce(bu<ku AND bl>kl, false) o FROM s3), s5 AS (SELECT *, coalesce(lag(o) OVER ({W}),false) AND NOT o lft FROM s4)"""


@query("w12_squeeze", with_(TICKS_SQL, SQUEEZE) + f"SELECT {K}, {rr('bb_width=(bu-bl)/ma','kc_upper=ku','kc_lower=kl')}, CAST(CASE WHEN lft AND mid>bu THEN 1 WHEN lft AND mid<bl THEN -1 ELSE 0 END AS INT) AS squeeze_break FROM s5")
def _(t):
    return shown(ind.squeeze(t.ticks), KS + " squeeze_break", "bb_width kc_upper kc_lower")


def cross_sql(p: str, line: str, alias: str) -> str:
    lp, ll = f"lag({p}) OVER ({W})", f"lag({line}) OVER ({W})"
    return f"CAST(CASE WHEN {p}>{line} AND {lp}<={ll} THEN 1 WHEN {p}<{line} AND {lp}>={ll} THEN -1 ELSE 0 END AS INT) AS {alias}"


REC = "WITH RECURSIVE "
KAMA = f"""e AS (SELECT *, abs(mid-lag(mid) OVER ({W})) m FROM t), e2 AS (SELECT *, abs(mid-lag(mid,10) OVER ({W}))/nullif({full_sql('sum','m',10)},0) er FROM e),
 e3 AS MATERIALIZED (SELECT *, power(er*({2/3!r}::DOUBLE-{2/31!r}::DOUBLE)+{2/31!r}::DOUBLE,2) sc FROM e2),
 k AS (SELECT "Symbol", i, mid y FROM e3 WHERE i=9 UNION ALL SELECT e3."Symbol", e3.i, k.y+e3.sc*(e3.mid-k.y) FROM k JOIN e3 ON e3."Symbol"=k."Symbol" AND e3.i=k.i+1),
 z AS (SELECT e3.*, coalesce(k.y, e3.mid) kama FROM e3 LEFT JOIN k ON k."Symbol"=e3."Symbol" AND k.i=e3.i)"""


@query("w13_kama", REC + TICKS_SQL + ", " + KAMA + f"SELECT {K}, {rr('kama')}, {cross_sql('mid','kama','kama_cross')} FROM z")
def _(t):
    return shown(ind.kama(t.ticks), KS + " kama_cross", "kama")


KMA = """u AS MATERIALIZED (SELECT * FROM t), k AS (SELECT "Symbol", i, mid::DOUBLE y, 1.0::DOUBLE p FROM u WHERE i=0 UNION ALL
 SELECT u."Symbol", u.i, k.y + (k.p+1e-5)/(k.p+1e-5+1e-2)*(u.mid-k.y), (1-(k.p+1e-5)/(k.p+1e-5+1e-2))*(k.p+1e-5) FROM k JOIN u ON u."Symbol"=k."Symbol" AND u.i=k.i+1),
 z AS (SELECT u.*, k.y kma FROM u JOIN k ON k."Symbol"=u."Symbol" AND k.i=u.i)"""


@query("w14_kalman", REC + TICKS_SQL + ", " + KMA + f"SELECT {K}, {rr('kma')}, {cross_sql('mid','kma','kma_cross')} FROM z")
def _(t):
    return shown(ind.kalman_ma(t.ticks), KS + " kma_cross", "kma")


SUPER = f"""r AS (SELECT *, {TR} tr FROM t), a AS (SELECT *, {full_sql('avg','tr',10)} atr FROM r), b AS (SELECT *, ("High"+"Low")/2+3*atr ub, ("High"+"Low")/2-3*atr lb FROM a),
 x AS (SELECT *, CASE WHEN i>=10 AND mid>lag(ub) OVER ({W}) THEN 1 WHEN i>=10 AND mid<lag(lb) OVER ({W}) THEN -1 END hit FROM b),
 y AS (SELECT *, last_value(hit IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) dir FROM x), z AS (SELECT *, CASE WHEN i>=10 THEN CASE WHEN dir=1 THEN lb ELSE ub END END st FROM y)"""


@query("w15_supertrend", with_(TICKS_SQL, SUPER) + f"SELECT {K}, {rr('supertrend=st')}, {cross_sql('mid','st','supertrend_break')} FROM z")
def _(t):
    return shown(ind.supertrend(t.ticks), KS + " supertrend_break", "supertrend")


OBV = f"""a AS (SELECT *, ("High"+"Low"+mid)/3 ty FROM t), b AS (SELECT *, CASE WHEN ty>lag(ty) OVER ({W}) THEN ty*"Volume" ELSE 0 END pf, CASE WHEN ty<lag(ty) OVER ({W}) THEN ty*"Volume" ELSE 0 END nf,
 coalesce(sign(mid-lag(mid) OVER ({W})),0)*"Volume" sv FROM a), d AS (SELECT *, {full_sql('sum','pf',14)} ps, {full_sql('sum','nf',14)} ns, sum(sv) OVER ({W} ROWS UNBOUNDED PRECEDING) obv FROM b)"""


@query("w16_volume", with_(TICKS_SQL, OBV) + f"SELECT {K}, {rr('obv','mfi=100-100/(1+ps/nullif(ns,0))')} FROM d")
def _(t):
    return shown(ind.obv_mfi(t.ticks), KS, "obv mfi")


@query("w17_ram", with_(TICKS_SQL, f"a AS (SELECT *, mid/nullif(lag(mid) OVER ({W}),0)-1 r FROM t)", f"b AS (SELECT *, {full_sql('avg','r',20)} m, {full_sql('stddev_samp','r',20)} s FROM a)") + f"SELECT {K}, {rr('ram=coalesce(m/nullif(s,0),0)')} FROM b")
def _(t):
    return shown(ind.ram()(t.ticks), KS, "ram")


RAMD = f"""a AS (SELECT *, mid/nullif(lag(mid) OVER ({W}),0)-1 r FROM t), p AS (SELECT seq, "Symbol", i-1 AS i, r FROM a WHERE i>0),
 q AS (SELECT p.seq, sum(q.r*w) m, sum(q.r*q.r*w) s2, sum(w*w) w2, max(p.i) i FROM (SELECT p.seq, p.i, q.r, CASE WHEN q.i=0 THEN power(0.9::DOUBLE,p.i) ELSE 0.1*power(0.9::DOUBLE,p.i-q.i) END w FROM p JOIN p q ON p."Symbol"=q."Symbol" AND q.i<=p.i) p(seq,i,r,w), LATERAL (SELECT p.r AS r) q GROUP BY p.seq)"""


@query("w17_ram_decay", with_(TICKS_SQL, RAMD) + f"SELECT t.seq, t.\"Symbol\", {rr('ram=coalesce(CASE WHEN q.i>=1 THEN m/nullif(sqrt(greatest((s2-m*m)/(1-w2),0)),0) END,0)')} FROM t LEFT JOIN q USING (seq)")
def _(t):
    return shown(ind.ram_decay(t.ticks, 0.1), KS, "ram")


FLOW = f"""a AS (SELECT *, coalesce(("BidVolume"-"AskVolume")/nullif("BidVolume"+"AskVolume",0),0) imbalance, sum("BidVolume"-"AskVolume") OVER ({W} ROWS UNBOUNDED PRECEDING) cvd FROM t),
 b AS (SELECT *, {full_sql('avg','imbalance',10)} imbalance_roll_mean, {full_sql('stddev_samp','imbalance',10)} imbalance_roll_std, {full_sql('avg','cvd',10)} cvd_roll_mean, {full_sql('stddev_samp','cvd',10)} cvd_roll_std FROM a)"""
FLOW_COLS = "imbalance cvd imbalance_roll_mean imbalance_roll_std cvd_roll_mean cvd_roll_std"


@query("w18_order_flow", with_(TICKS_SQL, FLOW) + f"SELECT {K}, {rr(*FLOW_COLS.split())} FROM b")
def _(t):
    return shown(ind.order_flow(t.ticks), KS, FLOW_COLS)


@query("w19_divergence", with_(TICKS_SQL, f"""a AS (SELECT *, mid-lag(mid) OVER ({W}) dp, "Volume"-lag("Volume") OVER ({W}) di FROM t)""") + f"SELECT {K}, CAST(CASE WHEN dp>0 AND di<0 THEN -1 WHEN dp<0 AND di>0 THEN 1 ELSE 0 END AS INT) AS div_vol FROM a")
def _(t):
    return ind.divergence("Volume", out="div_vol")(t.ticks).select("seq", "Symbol", "div_vol")


@query("w20_cross", with_(TICKS_SQL, f"a AS (SELECT *, {full_sql('avg','mid',10)} s, {full_sql('avg','mid',30)} l FROM t)") + f"SELECT {K}, {cross_sql('s','l','ma_cross_signal')} FROM a")
def _(t):
    d = apply_together(t.ticks, [ind.sma("mid", 10), ind.sma("mid", 30)])
    return ind.cross_signal("ma_10", "ma_30")(d).select("seq", "Symbol", "ma_cross_signal")


@query("w21_lags", T + f"SELECT {K}, {rr(f'mid_lag1=lag(mid) OVER ({W})', f'mid_lag3=lag(mid,3) OVER ({W})', 'mid_mean5='+full_sql('avg','mid',5), 'mid_std10='+full_sql('stddev_samp','mid',10))} FROM t")
def _(t):
    return shown(ind.lags_and_stats(["mid", "Volume"])(t.ticks), KS, "mid_lag1 mid_lag3 mid_mean5 mid_std10")


@query("w22_volatility", T + f"SELECT {K}, {rr('volatility_30='+full_sql('stddev_samp','mid',30))} FROM t")
def _(t):
    return shown(ind.volatility("mid", 30)(t.ticks), KS, "volatility_30")


LISTS = f"l AS (SELECT *, CASE WHEN i>=127 THEN list(mid) OVER ({W} ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) END x FROM t)"


@query("w23_fractal", with_(TICKS_SQL, LISTS, "g AS (SELECT *, list_sum([abs(x[j+1]-x[j]) FOR j IN range(1,128)]) ln, list_max([abs(v-x[1]) FOR v IN x]) dd FROM l)") + f"SELECT {K}, {rr('fractal_dim=fd','hurst=1/fd')} FROM (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN ln=0 OR dd=0 THEN 1 ELSE log10(128)/(log10(128)+log10(dd/ln)) END fd FROM g)")
def _(t):
    return shown(ind.fractal()(t.ticks), KS, "fractal_dim hurst")


@query("w24_spectral", with_(TICKS_SQL, LISTS) + f"""SELECT {K}, {rr('spec_energy=CASE WHEN x IS NOT NULL THEN (128*list_sum([v*v FOR v IN x])+power(list_sum(x),2)+power(list_sum([x[j]*CASE WHEN j%2=0 THEN 1 ELSE -1 END FOR j IN range(1,129)]),2))/2 END', nd=4)} FROM l""")
def _(t):
    return shown(ind.spectral_energy()(t.ticks), KS, "spec_energy", 4)


@query("w25_fft", with_(TICKS_SQL, LISTS) + f"""SELECT {K}, {rr('fft_mag_1_128=CASE WHEN x IS NOT NULL THEN sqrt(power(list_sum([x[j]*cos(2*pi()*(j-1)/128) FOR j IN range(1,129)]),2)+power(list_sum([x[j]*sin(2*pi()*(j-1)/128) FOR j IN range(1,129)]),2)) END','fft_mag_13_128=CASE WHEN x IS NOT NULL THEN sqrt(power(list_sum([x[j]*cos(2*pi()*13*(j-1)/128) FOR j IN range(1,129)]),2)+power(list_sum([x[j]*sin(2*pi()*13*(j-1)/128) FOR j IN range(1,129)]),2)) END', nd=5)} FROM l""")
def _(t):
    return shown(ind.fft_magnitude((0.01, 0.1))(t.ticks), KS, "fft_mag_1_128 fft_mag_13_128", 5)


@query("w27_seasonal", with_(TICKS_SQL, f"a AS (SELECT *, avg(mid) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) trend FROM t)") + f"SELECT {K}, {rr('trend','seasonal=avg(mid-trend) OVER (PARTITION BY \"Symbol\", i%24)')} FROM a")
def _(t):
    return shown(ind.trend_seasonal(t.ticks), KS, "trend seasonal")


TS = with_(TICKS_SQL, LISTS.replace("127", "29"), "g AS (SELECT *, list_avg(x) mu, list_var_pop(x) v FROM l)")


@query("w56_window_stats", TS + f"""SELECT {K}, {rr('abs_change=CASE WHEN x IS NOT NULL THEN list_sum([abs(x[j+1]-x[j]) FOR j IN range(1,30)]) END',
 'autocorr_1=CASE WHEN x IS NOT NULL THEN list_sum([(x[j+1]-mu)*(x[j]-mu) FOR j IN range(1,30)])/29/nullif(v,0) END',
 'complexity=CASE WHEN x IS NOT NULL THEN sqrt(list_sum([power(x[j+1]-x[j],2) FOR j IN range(1,30)])/nullif(v,0)) END',
 'skewness=CASE WHEN x IS NOT NULL THEN list_skewness(x) END','kurtosis=CASE WHEN x IS NOT NULL THEN list_kurtosis(x) END', nd=5)} FROM g""")
def _(t):
    return shown(ind.window_stats()(t.ticks), KS, "abs_change autocorr_1 complexity skewness kurtosis", 5)


@query("w58_variance", T + """, u AS (SELECT p.seq, sum((0.1+0.1*power(coalesce(r.mid,0)/1000,2))*power(0.8::DOUBLE, p.i-1-r.i)) v FROM t p JOIN t r ON p."Symbol"=r."Symbol" AND r.i<p.i GROUP BY 1)
 SELECT t.seq, t."Symbol", round(sqrt(coalesce(u.v,0)),6)+0.0 AS garch_vol FROM t LEFT JOIN u USING (seq)""")
def _(t):
    d = t.ticks.withColumn("r", F.col("mid") / 1000)
    return shown(ind.variance_recursion(d, "r"), KS, "garch_vol")


EXIT = f"""a AS (SELECT *, CASE WHEN user_id%3=0 THEN NULL ELSE user_id%2 END rg, "Volume"/1000 vol, abs(mid-lag(mid) OVER ({W})) tr FROM t),
 b AS (SELECT *, {full_sql('avg','tr',14)}*3 rc, last_value(rg IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) br FROM a),
 d AS (SELECT *, CASE WHEN vol>0.06 THEN 1.5 WHEN vol<0.03 THEN 0.8 ELSE 1.0 END * CASE WHEN rg<>br THEN 1.2 ELSE 1.0 END sc FROM b)"""


@query("w59_exit_levels", with_(TICKS_SQL, EXIT) + f"SELECT {K}, {rr('base_sl=mid-rc','base_tp=mid+rc','adaptive_sl=mid-rc*sc','adaptive_tp=mid+rc*sc')} FROM d")
def _(t):
    d = t.ticks.withColumn("rg", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 2)).withColumn("vol", F.col("Volume") / 1000)
    return shown(ind.exit_levels(d, "mid", "vol", "rg", threshold=0.06), KS, "base_sl base_tp adaptive_sl adaptive_tp")


@query("w60_index", with_(TICKS_SQL, f"a AS (SELECT *, mid/nullif(lag(mid) OVER ({W}),0)-1 r FROM t)") + f"SELECT {K}, {rr('sp_ret=r','sp_vol='+full_sql('stddev_samp','r',21))} FROM a")
def _(t):
    return shown(ind.index_features(t.ticks, "sp"), KS, "sp_ret sp_vol")
