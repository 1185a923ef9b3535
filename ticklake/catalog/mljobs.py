"""Queries over the model-side jobs (M, J18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind, labels as lab, mljobs as ml
from ..operators.base import apply_together
from ..operators.similar import similar_days
from ..plans.ordered import Order, with_row
from .common import PREDS_SQL, TICKS_SQL, W, query, rr, shown, with_

c = F.col
DAY = Order(("Symbol",), "Timestamp", (), 3650 * 86_400)


def _train(t):
    """Features with the direction of the next move as label."""
    d = apply_together(t.ticks, [ind.sma("mid", 5), ind.sma("mid", 10), ind.volatility("mid", 30), ind.rsi("mid", 14)])
    d = lab.multi_horizon([1])(d)
    return d.withColumn("label", c("direction_1").cast("double"))


COLS = ["ma_5", "ma_10", "volatility_30", "rsi_14"]


@query("m01_baskets", with_(TICKS_SQL) + "SELECT count(*) AS n FROM t")
def _(t):
    _, ranges = ml.market_baskets(t.ticks, ["mid", "Volume"], 6, 200)
    return ranges.agg(F.sum("n").alias("n"))


def _lloyd(step: int, k: int, rounds: int) -> str:
    """k-means of one column's history at every cut, by its value counts: quantile starts, then ``rounds`` steps."""
    ctes = [
        f"b AS (SELECT *, least(i // {step}, greatest((max(i) OVER () + 1) // {step}, 1) - 1) AS cut FROM t)",
        f"h AS (SELECT c.cut, \"Volume\" v, count(*)::DOUBLE w FROM (SELECT DISTINCT cut FROM b) c JOIN b ON b.i < (c.cut + 1) * {step} GROUP BY 1, 2)",
        "u AS (SELECT *, sum(w) OVER (PARTITION BY cut ORDER BY v) cum, sum(w) OVER (PARTITION BY cut) total FROM h)",
        f"c0 AS (SELECT cut, j, min(v) FILTER (cum >= (j + 0.5) / {k} * total) m FROM u, range({k}) r(j) GROUP BY 1, 2)",
    ]
    for n in range(rounds):
        ctes.append(f"n{n} AS (SELECT h.cut, v, w, arg_min(j, struct_pack(d := (v - m) * (v - m), j := j)) j FROM h JOIN c{n} USING (cut) GROUP BY 1, 2, 3)")
        ctes.append(f"c{n + 1} AS (SELECT c.cut, c.j, coalesce(sum(w * v) / sum(w), any_value(m)) m FROM c{n} c LEFT JOIN n{n} n ON n.cut = c.cut AND n.j = c.j GROUP BY 1, 2)")
    return ", ".join(ctes)


@query("m02_regimes", with_(TICKS_SQL, _lloyd(400, 3, 30)) + 'SELECT seq, CAST(arg_min(j, struct_pack(d := ("Volume" - m) * ("Volume" - m), j := j)) AS INTEGER) AS regime FROM b JOIN c30 USING (cut) GROUP BY seq')
def _(t):
    return ml.regimes(t.ticks, ["Volume"], 3, 400, rounds=30).select("seq", "regime")


PC = """s AS (SELECT avg(mid) am, avg("Volume") av, covar_samp(mid,mid) a, covar_samp(mid,"Volume") b, covar_samp("Volume","Volume") d FROM t), e AS (SELECT *, (a+d)/2+sqrt(power((a-d)/2,2)+b*b) l FROM s),
 v AS (SELECT *, (l-d)/sqrt(power(l-d,2)+b*b) vx, b/sqrt(power(l-d,2)+b*b) vy FROM e), g AS (SELECT *, CASE WHEN (abs(vx)>=abs(vy) AND vx<0) OR (abs(vx)<abs(vy) AND vy<0) THEN -1 ELSE 1 END sg FROM v)"""


@query("m03_components", with_(TICKS_SQL, PC) + f"SELECT seq, {rr('pc_0=sg*((mid-am)*vx+(\"Volume\"-av)*vy)')} FROM t, g")
def _(t):
    return shown(ml.principal_components(t.ticks, ["mid", "Volume"], 1)[0], "seq", "pc_0")


@query("m04_pair_components")
def _(t):
    from ..operators import pairs as pr
    from .market import PO, _pairs

    names = pr.all_pairs(t.hourly)
    wide = pr.widen_pairs(pr.pair_features(_pairs(t), 30, PO), names)
    d, _ = ml.principal_components(wide, [f"corr_{a}_{b}" for a, b in names], 2, "pair_pca")
    return shown(d, "Timestamp", "pair_pca_0 pair_pca_1")


@query("m05_selection")
def _(t):
    d = _train(t).withColumn("copy", c("ma_5") * 2)
    keep = ml.select_features(d, [*COLS, "copy"], "label", reg=0.0001)
    return d.select("seq", *keep)


@query("m06_information", with_(PREDS_SQL, "b AS (SELECT CAST(least(greatest(ceil(prob*4)-1,0),3) AS INT) b, y FROM p)") + "SELECT 'regime' AS feature, true AS positive UNION ALL SELECT 'prob', true FROM b GROUP BY 1")
def _(t):
    return ml.mutual_information(t.preds, ["prob", "regime"], "y").select("feature", (c("score") >= 0).alias("positive"))


@query("m06_importances")
def _(t):
    d = _train(t)
    return with_row(ml.tree_importances(d, COLS, "label"), d.agg(F.count(F.lit(1)).alias("rows")))


@query("m07_classifier", None)
def _(t):
    d = _train(t)
    return ml.predict(ml.fit_classifier(d, COLS, "label"), d).select("seq", "prob", "label")


@query("m07_scored", with_(TICKS_SQL) + f"""SELECT seq, i>=29 AS scored, CAST(CASE WHEN lead(mid,1) OVER ({W})/nullif(mid,0)-1>0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM t""")
def _(t):
    """Every row stays, and those with all features have a probability."""
    d = _train(t)
    return ml.predict(ml.fit_classifier(d, COLS, "label"), d).select("seq", F.coalesce(c("prob").between(0, 1), F.lit(False)).alias("scored"), "label")


@query("m08_isotonic")
def _(t):
    p = t.preds.withColumn("label", c("y").cast("double"))
    return ml.apply_calibration(ml.calibrate(p, "prob", "label", "isotonic"), p, "prob").select("id", "calibrated")


@query("m08_platt")
def _(t):
    p = t.preds.withColumn("label", c("y").cast("double"))
    return ml.apply_calibration(ml.calibrate(p, "prob", "label"), p, "prob").select("id", "calibrated")


@query("m08_meta")
def _(t):
    p = t.preds.withColumn("pred", (c("prob") > 0.5).cast("int"))
    return ml.meta_labels(p, ["prob", "value", "regime"], "y", "pred").select("id", "meta_prob")


@query("m09_impact")
def _(t):
    return ml.impact_scores(t.ticks, ["Volume", "AskVolume"], "mid").select("seq", "impact", "uncertainty")


@query("m10_coral", with_(TICKS_SQL) + """SELECT round(avg(mid),4) AS m1, round(covar_pop(mid,"Volume"),3) AS cv FROM t WHERE user_id%2=0""")
def _(t):
    src, tgt = t.ticks.where("user_id % 2 = 0"), t.ticks.where("user_id % 2 = 1")
    m = ml.coral_map(src, tgt, ["mid", "Volume"])
    d = ml.coral_align(tgt, m, ["mid", "Volume"])
    return d.agg(F.round(F.avg("mid"), 4).alias("m1"), F.round(F.covar_pop("mid", "Volume"), 3).alias("cv"))


@query("m11_training_table", with_(TICKS_SQL) + "SELECT count(*) + count(*) FILTER (\"Volume\">90) AS n, count(*) FILTER (\"Volume\">90) AS pseudo FROM t")
def _(t):
    d = t.ticks.select("seq", "mid")
    lb = lab.triple_barrier("mid", 0.5, 0.5, 10)(t.ticks).select("seq", "label")
    ps = t.ticks.where("Volume > 90").select("seq", "mid", F.lit(1).alias("label"))
    out = ml.training_table(d, lb, ["seq"], ps)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("is_pseudo")).alias("pseudo"))


@query("m12_replay", with_(PREDS_SQL) + "SELECT 'v'||regime AS version, count(*) AS n, round(avg(abs(prob-prob*prob)),6) AS mae FROM p GROUP BY 1")
def _(t):
    p = t.preds
    new = p.select("id", F.concat(F.lit("v"), c("regime").cast("string")).alias("version"), (c("prob") * c("prob")).alias("prob"))
    return shown(ml.replay_error(p.select("id", "prob"), new, ["id"]), "version n", "mae")


@query("m13_exit_policy")
def _(t):
    d = _train(t).withColumn("gain", c("label") - 0.5)
    return ml.exit_policy(d, COLS, "gain").select("seq", "hold_prob", "should_exit")


def _similar(days: str) -> str:
    """All pairs of the rows of ``days``, which has ``a``, ``b``, ``r`` and the row number ``i``."""
    return days + """,
 n AS (SELECT p."Symbol", p.i, q.r, row_number() OVER (PARTITION BY p."Symbol", p.i ORDER BY round(power(p.a-q.a,2)+power(p.b-q.b,2),9), q.i) rn FROM d p JOIN d q ON p."Symbol"=q."Symbol" AND q.i<p.i),
 g AS (SELECT "Symbol", i, avg(r) m, stddev_pop(r) s FROM n WHERE rn<=5 GROUP BY 1,2)"""


DAYS = """d AS (SELECT "Symbol", CAST("Timestamp" AS DATE) dt, avg(mid) a, avg("Volume") b, max(mid)/100 r, row_number() OVER (PARTITION BY "Symbol" ORDER BY CAST("Timestamp" AS DATE)) i FROM t GROUP BY 1,2)"""


@query("j18_similar_days", with_(TICKS_SQL, _similar(DAYS)) + f"SELECT d.\"Symbol\", CAST(d.dt AS TIMESTAMP) AS \"Timestamp\", {rr('nn_return_mean=coalesce(m,0)','nn_vol=coalesce(s,0)')} FROM d LEFT JOIN g ON g.\"Symbol\"=d.\"Symbol\" AND g.i=d.i")
def _(t):
    d = t.ticks.groupBy("Symbol", F.to_date("Timestamp").cast("timestamp_ntz").alias("Timestamp")).agg(
        F.avg("mid").alias("a"), F.avg("Volume").alias("b"), (F.max("mid") / 100).alias("r")
    )
    return shown(similar_days(d, ["a", "b"], "r", 5, order=DAY), "Symbol Timestamp", "nn_return_mean nn_vol")


@query("j18_similar_ticks", with_(TICKS_SQL, _similar('d AS (SELECT "Symbol", seq, i, mid a, "Volume" b, mid/100 r FROM t)')) + f"SELECT seq, {rr('nn_return_mean=coalesce(m,0)','nn_vol=coalesce(s,0)')} FROM d LEFT JOIN g ON g.\"Symbol\"=d.\"Symbol\" AND g.i=d.i")
def _(t):
    """Every tick against all earlier ones of its symbol."""
    d = t.ticks.select("Symbol", "Timestamp", "seq", "mid", "Volume", (c("mid") / 100).alias("r"))
    return shown(similar_days(d, ["mid", "Volume"], "r", 5), "seq", "nn_return_mean nn_vol")
