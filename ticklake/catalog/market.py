"""Queries over pairs, labels, signals and scalar functions (J08, K, W26-W51, W57, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import indicators as ind, labels as lab, pairs as pr, signals as sg
from ..operators.base import apply_together
from ..plans.ordered import TICKS, Order
from .common import FILLS_SQL, HOURLY_SQL, PREDS_SQL, QUOTES_SQL, TICKS_SQL, W, full_sql, query, rd, rr, shown, with_

c = F.col
K = 'seq, "Symbol"'
HOUR = Order(("Symbol",), "Timestamp", ("seq",), 30 * 86_400)
PW = 'PARTITION BY a, b ORDER BY "Timestamp"'
PO = pr.pair_order(HOUR)
PAIRS = """pl AS (SELECT x."Symbol" a, y."Symbol" b, x."Timestamp", x."Close" x, y."Close" y FROM h x JOIN h y ON x."Timestamp"=y."Timestamp" AND x."Symbol"<>y."Symbol")"""
KP = 'a, b, "Timestamp"'


def _pairs(t, both=True):
    h = t.hourly
    return pr.pair_rows(h, pr.pair_list(h, both_ways=both), "Close")


LISTS = f"l AS (SELECT *, CASE WHEN i>=127 THEN list(mid) OVER ({W} ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) END x FROM t)"
DB4 = "[-0.23037781330885523,0.7148465705525415,-0.6308807679295904,-0.02798376941698385,0.18703481171888114,0.030841381835986965,-0.032883011666982945,-0.010597401784997278]::DOUBLE[]"
WAV = f"""wv AS (SELECT *, CASE WHEN x IS NOT NULL THEN [list_sum([({DB4})[j+1] * x[CASE WHEN 2*k+1-j<0 THEN j-2*k-2 WHEN 2*k+1-j>127 THEN 254-2*k+j ELSE 2*k+1-j END + 1] FOR j IN range(0,8)]) FOR k IN range(0,67)] END d FROM l)"""


@query("w26_wavelet", with_(TICKS_SQL, LISTS, WAV) + f"SELECT {K}, {rr('wavelet_energy=list_sum([v*v FOR v IN d])','wavelet_abs=list_avg([abs(v) FOR v IN d])', nd=5)} FROM wv")
def _(t):
    return shown(ind.wavelet()(t.ticks), "seq Symbol", "wavelet_energy wavelet_abs", 5)


@query("w28_relative_strength", with_(HOURLY_SQL) + """SELECT "Symbol", "Timestamp", round(("Close"-avg("Close") OVER p)/nullif(stddev_pop("Close") OVER p,0),6)+0.0 AS rel_strength FROM h WINDOW p AS (PARTITION BY "Timestamp")""")
def _(t):
    return shown(pr.relative_strength(t.hourly, "Close"), "Symbol Timestamp", "rel_strength")


@query("w29_long_short", with_(HOURLY_SQL, """r AS (SELECT *, row_number() OVER (PARTITION BY "Timestamp" ORDER BY "Close" DESC, "Symbol") hi, row_number() OVER (PARTITION BY "Timestamp" ORDER BY "Close", "Symbol") lo, count(*) OVER (PARTITION BY "Timestamp") n FROM h)""") + """SELECT "Symbol", "Timestamp", CASE WHEN n>=2 AND hi=1 THEN 1.0::DOUBLE WHEN n>=2 AND lo=1 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM r""")
def _(t):
    return pr.strongest_weakest(t.hourly, "Close", 0.5).select("Symbol", "Timestamp", "signal")


CORR = f"""c AS (SELECT *, CASE WHEN count(*) OVER w=30 THEN corr(x,y) OVER w END corr, x/nullif(y,0) ratio FROM pl WINDOW w AS ({PW} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


@query("j08_pair_rows", with_(HOURLY_SQL, PAIRS) + f"SELECT {KP}, x, y FROM pl")
def _(t):
    return _pairs(t)


@query("w30_pair_corr", with_(HOURLY_SQL, PAIRS, CORR) + f"SELECT {KP}, {rr('corr','ratio')} FROM c")
def _(t):
    return shown(pr.pair_features(_pairs(t), 30, PO), "a b Timestamp", "corr ratio")


NAMES = ("click", "error", "purchase", "signup", "view")
WIDE = {f"corr_{a}_{b}": f"coalesce(max(corr) FILTER (a='{a}' AND b='{b}'),0)" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]}


@query("w30_wide", with_(HOURLY_SQL, PAIRS, CORR) + f"""SELECT "Timestamp", {rr(*[f"{k}={v}" for k, v in WIDE.items()])} FROM c GROUP BY 1""")
def _(t):
    """All pairs of the symbols there are."""
    pairs = pr.all_pairs(t.hourly)
    d = pr.widen_pairs(pr.pair_features(_pairs(t), 30, PO), pairs)
    return shown(d, "Timestamp", " ".join(f"corr_{a}_{b}" for a, b in pairs))


@query("w31_confirmation", with_(HOURLY_SQL, PAIRS, CORR, """z AS (SELECT a, b, arg_max(corr,"Timestamp") cr, arg_max(y,"Timestamp") y FROM c GROUP BY 1, 2)""") + "SELECT a AS \"Symbol\", round(sum(cr*sign(y)),6)+0.0 AS score FROM z WHERE cr IS NOT NULL GROUP BY 1")
def _(t):
    """Every symbol against all others."""
    return shown(pr.confirmation(pr.pair_features(_pairs(t), 30, PO)), "Symbol", "score")


@query("w32_adjacency", with_(HOURLY_SQL, PAIRS, CORR) + f"SELECT \"Timestamp\", a AS src, b AS dst, {rr('weight=coalesce(corr,0)')} FROM c")
def _(t):
    return shown(pr.adjacency(pr.pair_features(_pairs(t), 30, PO)), "Timestamp src dst", "weight")


@query("w32_graph", with_(HOURLY_SQL, PAIRS) + f"SELECT a AS src, b AS dst, {rr('weight=corr(x,y)')} FROM pl WHERE a<b GROUP BY a, b HAVING abs(corr(x,y))>=0.01")
def _(t):
    return shown(pr.correlation_graph(_pairs(t, False), 0.01), "src dst", "weight")


@query("k03_top_pairs", with_(HOURLY_SQL, PAIRS) + f"SELECT a, b, {rr('corr=corr(x,y)')} FROM pl WHERE a<b GROUP BY a,b ORDER BY abs(round(corr(x,y),12)) DESC, a, b LIMIT 4")
def _(t):
    return shown(pr.top_pairs(_pairs(t, False), 4), "a b", "corr")


COH = f"""q AS (SELECT *, CASE WHEN row_number() OVER ({PW})>=64 THEN list(x) OVER w END lx, CASE WHEN row_number() OVER ({PW})>=64 THEN list(y) OVER w END ly FROM pl WINDOW w AS ({PW} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
 ct AS (SELECT *, [v-list_avg(lx) FOR v IN lx] cx, [v-list_avg(ly) FOR v IN ly] cy FROM q WHERE lx IS NOT NULL),
 ft AS (SELECT a, b, "Timestamp", unnest(range(0,33)) k, cx, cy FROM ct),
 fv AS (SELECT a, b, "Timestamp", k, list_sum([cx[j]*cos(2*pi()*k*(j-1)/64) FOR j IN range(1,65)]) xr, -list_sum([cx[j]*sin(2*pi()*k*(j-1)/64) FOR j IN range(1,65)]) xi, list_sum([cy[j]*cos(2*pi()*k*(j-1)/64) FOR j IN range(1,65)]) yr, -list_sum([cy[j]*sin(2*pi()*k*(j-1)/64) FOR j IN range(1,65)]) yi FROM ft),
 fs AS (SELECT a, b, "Timestamp", power(sum(xr*yr+xi*yi),2)+power(sum(xr*yi-xi*yr),2) num, sum(xr*xr+xi*xi)*sum(yr*yr+yi*yi) den FROM fv GROUP BY 1,2,3)"""


@query("w33_coherence", with_(HOURLY_SQL, PAIRS, COH) + f"SELECT pl.a, pl.b, pl.\"Timestamp\", {rr('coherence=CASE WHEN den=0 THEN 0 ELSE num/den END')} FROM pl LEFT JOIN fs USING (a, b, \"Timestamp\")")
def _(t):
    return shown(pr.coherence(_pairs(t), 64, PO), "a b Timestamp", "coherence")


def _warped(rows: str, n: int, name: str = "w") -> str:
    """The cost table of ``x`` and ``y`` of every row of ``rows``, a diagonal at a time; the result is ``{name}_done.dist``."""
    inf = "'infinity'::DOUBLE"
    cell = f"CASE WHEN i >= greatest(1, d + 1 - {n}) AND i <= least({n}, d) THEN (x[i] - y[d + 1 - i]) * (x[i] - y[d + 1 - i]) + least(last[i], last[i + 1], before[i]) ELSE {inf} END"
    start = f"[{inf} FOR i IN range({n + 1})]"
    return (
        f"{name}(id, x, y, d, last, before) AS (SELECT id, x, y, 1, {start}, list_prepend(0.0::DOUBLE, [{inf} FOR i IN range({n})]) FROM {rows} "
        f"UNION ALL SELECT id, x, y, d + 1, [{cell} FOR i IN range({n + 1})], last FROM {name} WHERE d < {2 * n}), {name}_done AS (SELECT id, sqrt(last[{n + 1}]) dist FROM {name} WHERE d = {2 * n})"
    )


def _motif(name: str, values: str) -> str:
    return f"{name}_in AS (SELECT seq id, l x, {values} y FROM tw WHERE i >= 15), " + _warped(f"{name}_in", 16, name)


DTW = f"""pw AS (SELECT *, row_number() OVER () id, CASE WHEN count(*) OVER ({PW} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30 THEN list(x) OVER ({PW} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END lx,
 list(y) OVER ({PW} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) ly FROM pl WHERE a<b), pin AS (SELECT id, lx x, ly y FROM pw WHERE lx IS NOT NULL)"""
TW = f"tw AS (SELECT seq, i, list(mid) OVER ({W} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) l FROM t)"


@query("w34_dtw_pairs", with_(HOURLY_SQL, PAIRS, DTW, _warped("pin", 30)).replace("WITH", "WITH RECURSIVE", 1) + f"SELECT {KP}, {rr('dtw=dist')} FROM pw LEFT JOIN w_done USING (id)")
def _(t):
    return shown(pr.dtw_pairs(_pairs(t, False), 30, PO), "a b Timestamp", "dtw")


@query("w34_dtw_motifs", with_(TICKS_SQL, TW, _motif("r", "[i * 3.0::DOUBLE FOR i IN range(16)]"), _motif("s", "[CASE WHEN i IN (7, 8) THEN 90.0::DOUBLE ELSE 0.0 END FOR i IN range(16)]")).replace("WITH", "WITH RECURSIVE", 1)
 + f"SELECT {K}, {rr('dtw_rise=r.dist', 'dtw_spike=s.dist')} FROM t LEFT JOIN r_done r ON r.id = seq LEFT JOIN s_done s ON s.id = seq")
def _(t):
    motifs = {"rise": [float(i * 3) for i in range(16)], "spike": [0.0] * 7 + [90.0, 90.0] + [0.0] * 7}
    return shown(pr.dtw_motifs(t.ticks, "mid", motifs), "seq Symbol", "dtw_rise dtw_spike")


HEDGE = f"""be AS (SELECT a, b, regr_slope(x,y) hedge FROM pl GROUP BY 1,2), sp AS (SELECT pl.*, hedge, x-hedge*y spread FROM pl JOIN be USING (a,b)),
 zz AS (SELECT *, (spread-{full_sql('avg','spread',20,PW)})/nullif({full_sql('stddev_samp','spread',20,PW)},0) z FROM sp)"""


@query("w35_hedge", with_(HOURLY_SQL, PAIRS, HEDGE) + f"SELECT {KP}, {rr('hedge','spread','z')} FROM zz WHERE a<b")
def _(t):
    return shown(pr.hedge_spread(_pairs(t, False), 20, PO), "a b Timestamp", "hedge spread z")


@query("w47_pair_entries", with_(HOURLY_SQL, PAIRS, HEDGE, f"e AS (SELECT *, lag(z) OVER ({PW}) p FROM zz WHERE a<b)") + 'SELECT "Timestamp", CAST(max(CASE WHEN z<-1 AND p>=-1 THEN 1 ELSE 0 END) AS INT) AS pair_long, CAST(max(CASE WHEN z>1 AND p<=1 THEN 1 ELSE 0 END) AS INT) AS pair_short FROM e GROUP BY 1')
def _(t):
    return pr.z_crossings(pr.hedge_spread(_pairs(t, False), 20, PO), -1.0, 1.0, PO)


W48 = f"""n AS MATERIALIZED (SELECT *, row_number() OVER ({PW}) j, spread-lag(spread) OVER ({PW}) mv FROM zz WHERE a<b),
 r AS (SELECT a, b, j, CASE WHEN z<-1 THEN 1 WHEN z>1 THEN -1 ELSE 0 END pos, 0 was FROM n WHERE j=1 UNION ALL
 SELECT n.a, n.b, n.j, CASE WHEN n.z IS NULL THEN r.pos WHEN r.pos=0 THEN CASE WHEN n.z<-1 THEN 1 WHEN n.z>1 THEN -1 ELSE 0 END WHEN r.pos=1 THEN CASE WHEN n.z>-0.5 THEN 0 ELSE 1 END ELSE CASE WHEN n.z<0.5 THEN 0 ELSE -1 END END, r.pos FROM r JOIN n ON n.a=r.a AND n.b=r.b AND n.j=r.j+1)"""


@query("w48_pair_positions", "WITH RECURSIVE " + HOURLY_SQL + ", " + PAIRS + ", " + HEDGE + ", " + W48 + f" SELECT n.a, n.b, n.\"Timestamp\", CAST(pos AS INT) AS position, CAST(CASE WHEN pos=1 AND was=0 THEN 1 ELSE 0 END AS INT) AS pair_long, {rr('pair_pnl=coalesce(CASE WHEN z IS NOT NULL THEN pos*mv END,0)')} FROM n JOIN r ON r.a=n.a AND r.b=n.b AND r.j=n.j")
def _(t):
    d = pr.pair_positions(pr.hedge_spread(_pairs(t, False), 20, PO), 1.0, 0.5, PO)
    return shown(d, "a b Timestamp position pair_long", "pair_pnl")


@query("w48_signal_totals", "WITH RECURSIVE " + HOURLY_SQL + ", " + PAIRS + ", " + HEDGE + ", " + W48 + f" SELECT n.\"Timestamp\", CAST(sum(CASE WHEN pos=1 AND was=0 THEN 1 ELSE 0 END) AS BIGINT) AS pair_long, CAST(sum(CASE WHEN pos=-1 AND was=0 THEN 1 ELSE 0 END) AS BIGINT) AS pair_short, {rr('pair_pnl=sum(coalesce(CASE WHEN z IS NOT NULL THEN pos*mv END,0))')} FROM n JOIN r ON r.a=n.a AND r.b=n.b AND r.j=n.j GROUP BY 1")
def _(t):
    d = pr.pair_positions(pr.hedge_spread(_pairs(t, False), 20, PO), 1.0, 0.5, PO)
    return shown(pr.pair_signal_totals(d), "Timestamp pair_long pair_short", "pair_pnl")


@query("w55_latest_corr", with_(HOURLY_SQL, PAIRS, 'r AS (SELECT *, row_number() OVER (PARTITION BY a,b ORDER BY "Timestamp" DESC) rn FROM pl)') + f"SELECT a, b, count(*) AS n, {rr('corr=corr(x,y)')} FROM r WHERE rn<=100 GROUP BY 1,2")
def _(t):
    return shown(pr.latest_correlations(_pairs(t), 100), "a b n", "corr")


# ---------------------------------------------------------------- labels and splits


@query("w37_split", with_(TICKS_SQL) + f"SELECT {K}, i<1500 AS is_train FROM t")
def _(t):
    return lab.split_first(t.ticks, 1500).select("seq", "Symbol", "is_train")


FOLDS = """n AS (SELECT *, count(*) OVER (PARTITION BY "Symbol") n FROM t), f AS (SELECT n.*, k.k fold, n.n-(4-k.k)*(n.n//5) st, n.n//5 bl FROM n, (SELECT unnest(range(0,4)) k) k),
 p AS (SELECT *, CASE WHEN i>=st AND i<st+bl THEN 'val' WHEN i<st-20 THEN 'train' END part FROM f), g AS (SELECT DISTINCT "Symbol", fold, user_id FROM p WHERE part='val')"""


@query("w38_folds", with_(TICKS_SQL, FOLDS) + f"SELECT {K}, CAST(fold AS INT) AS fold, part FROM p WHERE part IS NOT NULL")
def _(t):
    return lab.purged_folds(t.ticks, 4, 20).select("seq", "Symbol", "fold", "part")


@query("w38_grouped_folds", with_(TICKS_SQL, FOLDS) + f"SELECT {K}, CAST(fold AS INT) AS fold, part FROM p WHERE part='val' OR (part='train' AND NOT EXISTS (SELECT 1 FROM g WHERE g.\"Symbol\"=p.\"Symbol\" AND g.fold=p.fold AND g.user_id=p.user_id))")
def _(t):
    return lab.purged_folds(t.ticks, 4, 20, "user_id").select("seq", "Symbol", "fold", "part")


@query("w39_sequences", with_(TICKS_SQL, f"s AS (SELECT *, list(mid) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) l, lead(mid) OVER ({W}) nx FROM t)") + f"SELECT {K}, CAST(nx>20 AS INT) AS label, {rr('first=l[1]','last=l[5]')} FROM s WHERE i>=5 AND nx IS NOT NULL")
def _(t):
    d = lab.sequences(t.ticks.withColumn("r", c("mid") - 20), ["mid", "Volume"], 5, "r")
    d = d.withColumns({"first": c("mid_seq")[0], "last": c("mid_seq")[4]})
    return shown(d, "seq Symbol label", "first last")


TB = f"""s AS (SELECT *, list(mid) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) fu FROM t), u AS (SELECT *, list_position([v>=mid*(1+0.5) FOR v IN fu], true) up, list_position([v<=mid*(1-0.5) FOR v IN fu], true) dn FROM s)"""


@query("w40_triple_barrier", with_(TICKS_SQL, TB) + f"SELECT {K}, CAST(CASE WHEN coalesce(nullif(up,0),11)<coalesce(nullif(dn,0),11) THEN 1 WHEN coalesce(nullif(dn,0),11)<coalesce(nullif(up,0),11) THEN -1 ELSE 0 END AS INT) AS label FROM u")
def _(t):
    return lab.triple_barrier("mid", 0.5, 0.5, 10)(t.ticks).select("seq", "Symbol", "label")


MH = f"""s AS (SELECT *, lead(mid,5) OVER ({W}) f5, coalesce(power(lead(mid) OVER ({W})/nullif(mid,0)-1,2),0) sq FROM t), u AS (SELECT *, sum(sq) OVER ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) v FROM s)"""


@query("w41_multi_horizon", with_(TICKS_SQL, MH) + f"SELECT {K}, CAST(CASE WHEN f5/nullif(mid,0)-1>0 THEN 1 ELSE 0 END AS TINYINT) AS direction_5, CAST(CASE WHEN f5 IS NULL THEN 0 ELSE coalesce(abs(f5/nullif(mid,0)-1),0) END AS FLOAT) AS abs_return_5, CAST(CASE WHEN f5 IS NULL THEN 0 ELSE sqrt(v) END AS FLOAT) AS volatility_5 FROM u")
def _(t):
    return lab.multi_horizon([5, 1])(t.ticks).select("seq", "Symbol", "direction_5", "abs_return_5", "volatility_5")


@query("f21_uncertain", with_(PREDS_SQL) + "SELECT id FROM (SELECT id, -(greatest(least(prob,1-1e-12),1e-12)*ln(greatest(least(prob,1-1e-12),1e-12))+greatest(least(1-prob,1-1e-12),1e-12)*ln(greatest(least(1-prob,1-1e-12),1e-12))) e FROM p) ORDER BY round(e,12) DESC, id LIMIT 25")
def _(t):
    return lab.most_uncertain(t.preds, 25).select("id")


@query("f21_low_confidence", with_(PREDS_SQL) + "SELECT id, round(greatest(prob,1-prob),6) AS confidence FROM p WHERE greatest(prob,1-prob)<0.605 AND id NOT IN (SELECT id FROM p WHERE y=1)")
def _(t):
    p = t.preds
    return shown(lab.low_confidence(p, 0.605, queued=p.where("y = 1").select("id")), "id", "confidence")


@query("f21_pseudo", with_(PREDS_SQL, "q AS (SELECT *, CAST(prob>0.5 AS INT) l FROM p WHERE greatest(prob,1-prob)>=0.895)") + f"SELECT {rr('precision=count(*) FILTER (y=1 AND l=1)/nullif(sum(l),0)','recall=count(*) FILTER (y=1 AND l=1)/nullif(sum(y),0)')} FROM q")
def _(t):
    return shown(lab.label_quality(lab.pseudo_labels(t.preds, 0.895)), "", "precision recall")


@query("j17_merge_labels", "SELECT d.doc_id AS id, CAST(coalesce(l.quality, -1) AS INT) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    lb = t.labels.select(c("doc_id").alias("id"), c("quality").alias("label"), F.lit(0).alias("o"))
    lb = lb.unionByName(lb.withColumn("label", F.lit(9)).withColumn("o", F.lit(1)))
    return lab.merge_labels(t.documents.select(c("doc_id").alias("id"), F.lit(-1).alias("label")), lb, "label", "o").select("id", "label")


@query("a42_queue_stats", with_(PREDS_SQL) + "SELECT count(*) AS queued, count(*) FILTER (y=1) AS ready_for_merge FROM p WHERE greatest(prob,1-prob)<0.605")
def _(t):
    return lab.low_confidence(t.preds, 0.605).agg(F.count(F.lit(1)).alias("queued"), F.count_if(c("y") == 1).alias("ready_for_merge"))


# ---------------------------------------------------------------- signals


def _with_indicators(t):
    ops = [ind.sma("mid", 10, "short_ma"), ind.sma("mid", 30, "long_ma"), ind.bollinger("mid", 20), ind.rsi("mid", 14, "rsi"), ind.atr(14, "mid", "mid", "mid")]
    d = apply_together(t.ticks, ops).withColumnRenamed("atr_14", "atr_val")
    return d.withColumn("mfi", c("Volume")).withColumn("market_regime", (c("user_id") % 3).cast("int"))


SIG = f"""s1 AS (SELECT *, coalesce(abs(mid-lag(mid) OVER ({W})),0) tr, mid-lag(mid) OVER ({W}) d FROM t), s2 AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d,0) END up, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END dn FROM s1),
 s3 AS (SELECT *, {full_sql('avg','mid',10)} sm, {full_sql('avg','mid',30)} lm, {full_sql('avg','mid',20)} bm, {full_sql('stddev_samp','mid',20)} bs, {full_sql('avg','tr',14)} atr, {full_sql('avg','up',14)} au, {full_sql('avg','dn',14)} ad FROM s2),
 s4 AS (SELECT *, coalesce(100-100/(1+au/nullif(ad,0)),50) rsi, lag(sm) OVER ({W}) ps, lag(lm) OVER ({W}) pl0 FROM s3),
 s5 AS (SELECT *, CASE WHEN pl0 IS NULL THEN 0 ELSE coalesce(ps,0) END p1, coalesce(pl0,0) p2 FROM s4),
 s6 AS (SELECT *, CASE WHEN sm IS NULL OR lm IS NULL OR atr IS NULL THEN 0 WHEN sm>lm AND p1<=p2 AND rsi<70 AND mid<bm+2*bs THEN 1 WHEN sm<lm AND p1>=p2 AND rsi>30 AND mid>bm-2*bs THEN -1 ELSE 0 END sg FROM s5)"""


@query("w49_entry_signal", with_(TICKS_SQL, SIG) + f"SELECT {K}, CAST(sg AS INT) AS signal, {rr('confidence=CASE WHEN sg<>0 THEN coalesce((sm-lm)/nullif(atr,0),0) ELSE 0 END')} FROM s6")
def _(t):
    return shown(sg.entry_signal(_with_indicators(t), "mid"), "seq Symbol signal", "confidence")


@query("w49_confirmed_signal", with_(TICKS_SQL, SIG, f"""s7 AS (SELECT *, sum("BidVolume"-"AskVolume") OVER ({W}) cvd, "BidVolume"-30 mpd FROM s6), s8 AS (SELECT *, lag(cvd) OVER ({W}) pc FROM s7)""") + f"""SELECT {K}, CAST(CASE WHEN sg=1 AND (mpd<=0 OR NOT (cvd>0 AND (pc IS NULL OR cvd>pc))) THEN 0 WHEN sg=-1 AND (mpd>=0 OR NOT (cvd<0 AND (pc IS NULL OR cvd<pc))) THEN 0 ELSE sg END AS INT) AS signal FROM s8""")
def _(t):
    from ..plans.ordered import running

    d = running(_with_indicators(t), {"cvd": ("sum", c("BidVolume") - c("AskVolume"))})
    d = d.withColumn("microprice_delta", c("BidVolume") - 30)
    return sg.entry_signal(d, "mid").select("seq", "Symbol", "signal")


@query("w50_positions")
def _(t):
    d = sg.run_positions(sg.entry_signal(_with_indicators(t), "mid"), "mid", trail=0.3, take_trail=0.4, max_loss=0.5, long_regimes=[0, 1])
    return shown(d, "seq Symbol", "action long_stop short_stop")


DELAY = """dl AS (SELECT a.seq, a."Symbol", b.mid fm FROM t a ASOF LEFT JOIN (SELECT "Symbol" s2, "Timestamp" t2, mid FROM t) b ON a."Symbol"=b.s2 AND a."Timestamp"+INTERVAL '3600 seconds'<=b.t2), en AS (SELECT "Symbol", arg_max(mid,("Timestamp",seq)) em FROM t GROUP BY 1)"""


@query("w51_delayed_quote", with_(TICKS_SQL, DELAY) + "SELECT dl.seq, dl.\"Symbol\", round(coalesce(fm, em),6) AS fill_mid FROM dl JOIN en USING (\"Symbol\")")
def _(t):
    return shown(sg.delayed_quotes(t.ticks, 3_600_000), "seq Symbol", "fill_mid")


W51 = """u AS MATERIALIZED (SELECT * FROM t), r AS (SELECT "Symbol", i, CASE WHEN "Volume"/100>0.6 THEN 1 ELSE 0 END held, CASE WHEN "Volume"/100>0.6 THEN "Ask" ELSE 0 END en, CASE WHEN "Volume"/100>0.6 THEN "Ask"-30 ELSE 0 END sp, NULL::DOUBLE g FROM u WHERE i=0
 UNION ALL SELECT "Symbol", i, CASE WHEN held=0 THEN go WHEN mid<=ns THEN 0 ELSE 1 END, CASE WHEN held=0 THEN CASE WHEN go=1 THEN ask ELSE 0 END WHEN mid<=ns THEN 0 ELSE en END, CASE WHEN held=0 THEN CASE WHEN go=1 THEN ask-30 ELSE 0 END WHEN mid<=ns THEN 0 ELSE ns END, CASE WHEN held=1 AND mid<=ns THEN (bid-en)/en END
 FROM (SELECT u."Symbol", u.i, u.mid, u."Ask" ask, u."Bid" bid, CASE WHEN u."Volume"/100>0.6 THEN 1 ELSE 0 END go, r.held, r.en, greatest(r.sp, u.mid-30) ns FROM r JOIN u ON u."Symbol"=r."Symbol" AND u.i=r.i+1))"""


@query("w51_trades", "WITH RECURSIVE " + TICKS_SQL + ", " + W51 + f" SELECT u.seq, u.\"Symbol\", {rr('trade_return=g')} FROM r JOIN u ON u.\"Symbol\"=r.\"Symbol\" AND u.i=r.i WHERE g IS NOT NULL")
def _(t):
    d = t.ticks.withColumn("prob", c("Volume") / 100)
    return shown(sg.extract_trades(d, "prob", F.lit(0.6), 30.0), "seq Symbol", "trade_return")


@query("w57_vwap_slices", with_(FILLS_SQL) + f"SELECT o.o_orderkey AS order_id, v.bucket, {rr('slice_qty=o.o_totalprice*v.volume/sum(v.volume) OVER (PARTITION BY o.o_orderkey)', nd=None)} FROM orders o JOIN (SELECT order_id, line bucket, sum(volume) volume FROM f GROUP BY 1,2) v ON v.order_id=o.o_orderkey")
def _(t):
    v = t.fills.groupBy(c("order_id").alias("key"), c("line").alias("bucket")).agg(F.sum("volume").alias("volume"))
    o = t.orders.select(c("o_orderkey").alias("order_id"), c("o_orderkey").alias("key"), c("o_totalprice").alias("qty"))
    d = sg.vwap_slices(o, v, "key").where(c("bucket").isNotNull())
    return shown(d, "order_id bucket", "slice_qty", None)


@query("w57_twap_slices", "SELECT o_orderkey AS order_id, CAST(s AS INT) AS slice, round(o_totalprice/7,6) AS slice_qty FROM orders, (SELECT unnest(range(0,7)) s)")
def _(t):
    return shown(sg.twap_slices(t.orders.select(c("o_orderkey").alias("order_id"), c("o_totalprice").alias("qty")), 7), "order_id slice", "slice_qty")


@query("w57_fixed_slices", "SELECT o_orderkey AS order_id, s AS slice, round(least(150000, o_totalprice-s*150000),6) AS slice_qty FROM (SELECT *, unnest(range(0, CAST(ceil(o_totalprice/150000) AS BIGINT))) s FROM orders WHERE o_totalprice>0)")
def _(t):
    return shown(sg.fixed_slices(t.orders.select(c("o_orderkey").alias("order_id"), c("o_totalprice").alias("qty")), 150000.0), "order_id slice", "slice_qty")


# ---------------------------------------------------------------- scalar functions


@query("x01_time", with_(TICKS_SQL) + f"""SELECT seq, {rr('hour_of_day_sin=sin(2*pi()*(hour("Timestamp")+minute("Timestamp")/60)/24)','hour_of_day_cos=cos(2*pi()*(hour("Timestamp")+minute("Timestamp")/60)/24)','day_of_week_sin=sin(2*pi()*(isodow("Timestamp")-1)/7)','day_of_week_cos=cos(2*pi()*(isodow("Timestamp")-1)/7)')} FROM t""")
def _(t):
    return shown(t.ticks.withColumns(mk.time_features()), "seq", "hour_of_day_sin hour_of_day_cos day_of_week_sin day_of_week_cos")


# in January all three zones are on winter time: London +0, New York -5, Tokyo +9 hours
SES = """s AS (SELECT *, epoch_us("Timestamp")/1e6 e FROM t), z AS (SELECT *, e%86400 l, (e-18000)%86400 n, (e+32400)%86400 k FROM s)"""


@query("x02_session", with_(TICKS_SQL, SES) + "SELECT seq, CASE WHEN l>=28800 AND l<57600 THEN 'london' WHEN n>=28800 AND n<61200 THEN 'new_york' WHEN k>=32400 AND k<61200 THEN 'tokyo' END AS session FROM z")
def _(t):
    return t.ticks.select("seq", mk.session().alias("session"))


@query("x03_session_features", with_(TICKS_SQL, SES) + f"SELECT seq, CAST(l>=28800 AND l<57600 AS INT) AS session_london, {rr('london_sin=CASE WHEN l>=28800 AND l<57600 THEN sin(2*pi()*(l-28800)/28800) ELSE 0 END','tokyo_cos=CASE WHEN k>=32400 AND k<61200 THEN cos(2*pi()*(k-32400)/28800) ELSE 0 END')} FROM z")
def _(t):
    d = t.ticks.withColumns({**mk.session_onehot(), **mk.session_cycle()})
    return shown(d, "seq session_london", "london_sin tokyo_cos")


@query("x04_market_open", with_(TICKS_SQL) + 'SELECT seq, isodow("Timestamp")<6 AS is_open FROM t')
def _(t):
    return t.ticks.select("seq", mk.market_open().alias("is_open"))


@query("x05_mid", with_(QUOTES_SQL) + f"""SELECT seq, {rr('m=("Bid"+"Ask")/2','spread="Ask"-"Bid"')} FROM q""")
def _(t):
    return t.quotes.select("seq", rd(mk.mid()).alias("m"), rd(c("Ask") - c("Bid")).alias("spread"))


@query("x06_microprice", with_(QUOTES_SQL) + f"""SELECT seq, {rr('microprice=("Ask"*"BidVolume"+"Bid"*"AskVolume")/("BidVolume"+"AskVolume")','microprice_delta=("Ask"*"BidVolume"+"Bid"*"AskVolume")/("BidVolume"+"AskVolume")-("Bid"+"Ask")/2', nd=None)} FROM q""")
def _(t):
    return shown(mk.microprice(t.quotes), "seq", "microprice microprice_delta", None)


def _book(t):
    d = t.ticks
    lv = {}
    for i in range(1, 4):
        lv[f"BidPrice{i}"] = c("mid") - 0.01 * i - c("Volume") * 0.001 * (i - 1)
        lv[f"BidVolume{i}"] = c("Volume") + i
        lv[f"AskPrice{i}"] = c("mid") + 0.02 * i
        lv[f"AskVolume{i}"] = c("AskVolume") * i
    return mk.fold_levels(d.select("seq", "Symbol", "Timestamp", "mid", "Volume", "AskVolume").withColumns(lv))


BOOK = """b AS (SELECT seq, mid, [mid-0.01, mid-0.02-"Volume"*0.001, mid-0.03-"Volume"*0.001*2] bp, ["Volume"+1,"Volume"+2,"Volume"+3] bv, [mid+0.02, mid+0.02*2, mid+0.02*3] ap, ["AskVolume","AskVolume"*2,"AskVolume"*3] av FROM t),
 bs AS (SELECT *, list_sum(bv) sb, list_sum(av) sa, list_sum([(ap[i]-bp[i])*(bv[i]+av[i]) FOR i IN [1,2,3]])/list_sum([bv[i]+av[i] FOR i IN [1,2,3]]) vw FROM b)"""


@query("x07_book", with_(TICKS_SQL, BOOK) + f"SELECT seq, {rr('depth_imbalance=(sb-sa)/(sb+sa)','vw_spread=vw','market_impact=vw*(sb-sa)/(sb+sa)','total_depth=sb+sa','slippage=abs(vw)+abs(vw*(sb-sa)/(sb+sa))')} FROM bs")
def _(t):
    return shown(_book(t).withColumns(mk.book_features()), "seq", "depth_imbalance vw_spread market_impact total_depth slippage")


@query("x08_exhaustion", with_(TICKS_SQL, BOOK, "q AS (SELECT *, (bp[1]+ap[1])/2 m, 3*(ap[1]-bp[1]) r FROM bs)", "w AS (SELECT seq, list_sum([CASE WHEN m-bp[i]<=r THEN bv[i] ELSE 0 END FOR i IN [1,2,3]])/nullif(list_sum([CASE WHEN ap[i]-m<=r THEN av[i] ELSE 0 END FOR i IN [1,2,3]]),0) lr FROM q)") + f"SELECT seq, {rr('liq_ratio=coalesce(lr,0)')}, CAST(CASE WHEN coalesce(lr,0)>2 THEN 1 WHEN coalesce(lr,0)<0.5 THEN -1 ELSE 0 END AS INT) AS liq_exhaustion FROM w")
def _(t):
    return shown(mk.liquidity_exhaustion(_book(t)), "seq liq_exhaustion", "liq_ratio")


@query("x09_book_walk", with_(TICKS_SQL, BOOK, "q AS (SELECT *, (bp[1]+ap[1])/2 m, least(av[1],60) q1, least(av[2],60-least(av[1],60)) q2 FROM bs)", "w AS (SELECT *, least(av[3],60-q1-q2) q3 FROM q)") + f"SELECT seq, {rr('slip=CASE WHEN sa>=60 THEN ((q1*ap[1]+q2*ap[2]+q3*ap[3])/60-m)/m*10000 END')} FROM w")
def _(t):
    return _book(t).select("seq", rd(mk.walk_slippage(F.lit(60.0), F.lit("buy"))).alias("slip"))


@query("x10_fills", with_(TICKS_SQL, BOOK) + f"SELECT seq, {rr('buy_fill=mid+vw/2+vw*(sb-sa)/(sb+sa)','sell_fill=mid-vw/2-vw*(sb-sa)/(sb+sa)', nd=None)} FROM bs")
def _(t):
    return shown(_book(t).withColumns(mk.book_features()).withColumns(mk.simulated_fills()), "seq", "buy_fill sell_fill", None)


@query("x11_entry_value", with_(TICKS_SQL) + f"""SELECT seq, {rr('v=0.5*("Volume"/100)-0.3*("AskVolume"/100)+(tanh(mid/100)+tanh("Volume"/50))/2-0.01')} FROM t""")
def _(t):
    v = mk.entry_value(c("Volume") / 100, c("AskVolume") / 100, F.array(c("mid") / 100, c("Volume") / 50), cost=0.01)
    return t.ticks.select("seq", rd(v).alias("v"))


@query("x12_size", with_(PREDS_SQL) + f"SELECT id, {rr('kelly=least(1000*greatest(least(2*prob-1,1),0)*prob/(1+prob/10),400)','var_size=1000*0.01/greatest(prob+0.01,1e-12)','vol_size=CASE WHEN prob>0 THEN 10/prob ELSE 0 END')} FROM p")
def _(t):
    p, cap = c("prob"), F.lit(1000.0)
    return t.preds.select(
        "id",
        rd(mk.position_size(cap, "kelly", prob=p, confidence=p, slippage=p / 10, liquidity=F.lit(400.0))).alias("kelly"),
        rd(mk.position_size(cap, "var", risk=p + 0.01)).alias("var_size"),
        rd(mk.position_size(cap, "vol", risk=p)).alias("vol_size"),
    )


@query("x21_odds", with_(PREDS_SQL) + f"SELECT id, {rr('odds=CASE WHEN prob>0 AND prob<1 THEN prob/(1-prob) END','confidence=greatest(least((ln(1+greatest(value,0))+0.25*regime)/10,1),0)')} FROM p")
def _(t):
    from ..operators.reports import confidence

    return t.preds.select("id", rd(mk.odds(c("prob"))).alias("odds"), rd(confidence(c("value"), c("regime"))).alias("confidence"))


@query("x24_entropy", with_(PREDS_SQL, "e AS (SELECT id, greatest(least(prob,1-1e-12),1e-12) a, greatest(least(1-prob,1-1e-12),1e-12) b FROM p)") + f"SELECT id, {rr('entropy=-(a*ln(a)+b*ln(b))')} FROM e")
def _(t):
    return t.preds.select("id", rd(lab.entropy([1 - c("prob"), c("prob")])).alias("entropy"))


@query("x25_expected_score", with_(PREDS_SQL) + f"SELECT id, {rr('score=1/(1+power(10,(1500+prob*100-(1500+value))/400))')} FROM p")
def _(t):
    return t.preds.select("id", rd(mk.expected_score(c("value") + 1500, c("prob") * 100 + 1500)).alias("score"))


@query("x27_formulas", with_(TICKS_SQL) + f"""SELECT seq, {rr('f1=mid*2+sqrt("Volume")','f2=(mid*2+sqrt("Volume"))/greatest("AskVolume",1)')} FROM t""")
def _(t):
    fs = [{"name": "f1", "formula": "mid * 2 + sqrt(Volume)"}, {"name": "f2", "formula": "f1 / greatest(AskVolume, 1)"}]
    return shown(mk.apply_formulas(t.ticks, fs), "seq", "f1 f2")


@query("x28_compare", with_(TICKS_SQL) + """SELECT seq, mid>"Volume" AS a, "Volume"<=30 AS b FROM t""")
def _(t):
    d = t.ticks
    return d.select("seq", mk.compare(d, "mid", ">", "Volume").alias("a"), mk.compare(d, "Volume", "<=", 30).alias("b"))


@query("x29_interval", with_(PREDS_SQL) + f"SELECT id, {rr('ci_lower=prob-1.96*sqrt(value/1000)','ci_upper=prob+1.96*sqrt(value/1000)','size=100*greatest(1-abs(2*1.96*sqrt(value/1000)),0)')} FROM p")
def _(t):
    d = t.preds.withColumns(mk.credible_interval(c("prob"), c("value") / 1000))
    return shown(d.withColumn("size", mk.shrink_by_width(F.lit(100.0), c("ci_lower"), c("ci_upper"))), "id", "ci_lower ci_upper size")


@query("x30_min_max", with_(TICKS_SQL) + f"""SELECT seq, {rr('mid=(mid-min(mid) OVER w)/(max(mid) OVER w-min(mid) OVER w)')} FROM t WINDOW w AS (PARTITION BY "Symbol")""")
def _(t):
    return shown(mk.min_max(t.ticks, ["mid"], ["Symbol"]), "seq", "mid")
