"""Model-side table jobs on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import IDX, TICKS, Order, attach, row_index
from ..plans.values import quantile_arrays
from ..session import checkpoint
from .base import safe_div

c = F.col


def assemble(df: DataFrame, cols: Sequence[str], out: str = "__x", fill: float | None = 0.0) -> DataFrame:
    d = df if fill is None else df.fillna(fill, list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(d)


def market_baskets(df: DataFrame, cols: Sequence[str], k: int = 4, min_count: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """M01 k-means baskets; baskets under ``min_count`` rows join the nearest larger centre.

    Gives the rows with ``basket`` and a table of basket sizes and value ranges.
    """
    d = assemble(df, cols)
    model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__k").fit(d)
    d = model.transform(d).drop("__x")
    sizes = {r["__k"]: r["count"] for r in d.groupBy("__k").count().collect()}  # k rows
    centres = {i: np.array(v) for i, v in enumerate(model.clusterCenters())}
    weight = {i: sizes.get(i, 0) for i in centres}
    to = {i: i for i in centres}
    while len(centres) > 1:
        small = min(centres, key=lambda i: (weight[i], i))
        if weight[small] >= min_count:
            break
        rest = [i for i in centres if i != small]
        near = min(rest, key=lambda i: (float(np.linalg.norm(centres[i] - centres[small])), i))
        total = max(weight[near] + weight[small], 1)
        centres[near] = (centres[near] * weight[near] + centres[small] * weight[small]) / total
        weight[near] = total
        del centres[small]
        to = {i: near if v == small else v for i, v in to.items()}
    names = {v: n for n, v in enumerate(sorted(set(to.values())))}
    label = F.lit(0)
    for i, v in to.items():
        label = F.when(c("__k") == i, names[v]).otherwise(label)
    d = d.withColumn("basket", label).drop("__k")
    ranges = d.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{n}_{x}") for x in cols for n, f in (("min", F.min), ("max", F.max))])
    return d, ranges


PIECE_ROWS = 50_000  # rows that one task compresses
SPAN = 256  # blocks whose history one task merges


def weighted_centres(x: np.ndarray, w: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``(centres, weights)`` of weighted k-means: started at quantiles along the first column, ``rounds`` steps at most.

    Up to ``k`` distinct points are their own centres.
    """
    x, at = np.unique(x, axis=0, return_inverse=True)
    w = np.bincount(at.ravel(), w, len(x))
    if len(x) <= k:
        return x, w
    cum = np.cumsum(w)
    centre = x[np.searchsorted(cum, (np.arange(k) + 0.5) / k * cum[-1])]
    for _ in range(rounds):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.bincount(near, w, k)
        mean = np.stack([np.bincount(near, w * col, k) for col in x.T], axis=1) / np.where(total > 0, total, 1)[:, None]
        new = np.where(total[:, None] > 0, mean, centre)
        if (new == centre).all():
            break
        centre = new
    near = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    total = np.bincount(near, w, k)
    return centre[total > 0], total[total > 0]


def _features(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The weighted centres of all rows of ``t(centres, weights)``, put together."""
    x = t["centres"].combine_chunks().flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, t["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def regimes(df: DataFrame, cols: Sequence[str], k: int = 3, step: int = 500, order: Order = TICKS, features: int = 256, rounds: int = 50) -> DataFrame:
    """M02 regime per row: every ``step`` rows k-means is fitted anew on the history so far and labels the block that ends there.

    Rows past the last whole block take its fit.  Labels are ordered by the first
    feature of the centre, so they keep their meaning between fits; NULL reads as 0.

    Blocks are compressed to at most ``features`` weighted centres side by side,
    which are merged in order, first within spans of blocks and then over the
    spans, so that every fit finds its history as two such sets.  The number of jobs
    does not depend on the rows.  With up to ``features`` distinct points nothing is lost.
    """
    width, names = len(cols), [f"__f{i}" for i in range(len(cols))]
    d = row_index(df, order)
    size = d.agg(F.max(IDX).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if size.n is None:
        return df.withColumn("regime", F.lit(0))
    last = max((size.n + 1) // step, 1) - 1
    pieces = size.rows // (last + 1) // PIECE_ROWS + 1
    d = d.withColumn("__cut", F.least(F.floor(c(IDX) / step), F.lit(last)).cast("long"))
    seen = d.where((c(IDX) < (last + 1) * step) | F.lit(last == 0)).select("__cut", F.pmod(F.xxhash64(IDX, *order.keys), F.lit(pieces)).alias("__p"), *[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(n) for x, n in zip(cols, names)])
    cf = "__cut long, centres array<array<double>>, weights array<double>"

    def table(cut: list, sets: list[tuple[np.ndarray, np.ndarray]], key: str = "__cut") -> pa.Table:
        lists = pa.list_(pa.list_(pa.float64()))
        return pa.table({key: pa.array(cut, pa.int64()), "centres": pa.array([x.tolist() for x, _ in sets], lists), "weights": pa.array([w.tolist() for _, w in sets], pa.list_(pa.float64()))})

    def compress(t: pa.Table) -> pa.Table:
        x = np.stack([t[n].to_numpy() for n in names], axis=1)
        return table([t["__cut"][0].as_py()], [weighted_centres(x, np.ones(len(x)), features, 5)])

    def merged(t: pa.Table, key: str) -> tuple[list, list]:
        """For each value of ``key``, in order, what its rows and all before them come to."""
        now, keys, sets = (np.empty((0, width)), np.empty(0)), [], []
        for v in sorted(set(t[key].to_pylist())):
            own = _features(t.filter(pc.equal(t[key], v)), width)
            now = weighted_centres(*(np.concatenate(p) for p in zip(now, own)), features, 5)
            keys.append(v)
            sets.append(now)
        return keys, sets

    def fit(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for i in range(len(t)):
                row = t[i : i + 1]
                own = _features(row, width)
                if row["before"][0].is_valid:
                    own = tuple(np.concatenate(p) for p in zip(_features(row.select(["before", "bw"]).rename_columns(["centres", "weights"]), width), own))
                centre, _ = weighted_centres(*own, k, rounds)
                yield table(row["__cut"].to_pylist(), [(centre[np.argsort(centre[:, 0], kind="stable")], np.ones(len(centre)))]).to_batches()[0]

    blocks = seen.groupBy("__cut", "__p").applyInArrow(compress, cf)
    local = checkpoint(blocks.groupBy(F.floor(c("__cut") / SPAN).alias("__span")).applyInArrow(lambda t: table(*merged(t, "__cut")), cf))
    ends = local.groupBy(F.floor(c("__cut") / SPAN).alias("__span")).agg(F.max_by(F.struct("centres", "weights"), "__cut").alias("e")).select("__span", "e.centres", "e.weights")
    spans = ends.groupBy((c("__span") < 0).alias("__all")).applyInArrow(lambda t: table(*merged(t, "__span"), "__span"), cf.replace("__cut", "__span"))  # a row for every SPAN blocks
    before = spans.select((c("__span") + 1).alias("__span"), c("centres").alias("before"), c("weights").alias("bw"))
    history = local.withColumn("__span", F.floor(c("__cut") / SPAN)).join(before, "__span", "left").drop("__span")
    fits = checkpoint(history.mapInArrow(fit, cf).select("__cut", "centres"))
    x = F.array(*[F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in cols])
    dist = F.transform("centres", lambda m, i: F.struct(F.aggregate(F.zip_with(m, x, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v).alias("d"), i.alias("i")))
    return attach(d, fits, ["__cut"], [IDX, *order.keys]).withColumn("regime", F.array_min(dist)["i"]).select(*df.columns, "regime")


def principal_components(df: DataFrame, cols: Sequence[str], k: int, prefix: str = "pc") -> tuple[DataFrame, np.ndarray]:
    """M03/M04 scores on the first ``k`` components of the centred columns, and the loadings.

    The sign of a component is that of its largest loading.  An empty table has no components.
    """
    means = df.agg(*[F.avg(x).alias(x) for x in cols], F.count(F.lit(1)).alias("__n")).first()
    if not means["__n"]:
        return df.withColumns({f"{prefix}_{i}": F.lit(0.0) for i in range(k)}), np.zeros((len(cols), k))
    d = assemble(df.withColumns({f"__c_{x}": F.coalesce(c(x) - means[x], F.lit(0.0)) for x in cols}), [f"__c_{x}" for x in cols])
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(d)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    arr = vector_to_array("__p")
    d = model.transform(d).select(*df.columns, *[(arr[i] * float(signs[i])).alias(f"{prefix}_{i}") for i in range(k)])
    return d, loadings * signs


def factor_exposures_table(df: DataFrame, loadings: np.ndarray, cols: Sequence[str]) -> DataFrame:
    """M03 loadings as (asset, factor, exposure) rows."""
    rows = [(a, i, float(loadings[j, i])) for j, a in enumerate(cols) for i in range(loadings.shape[1])]
    return df.sparkSession.createDataFrame(rows, "asset string, factor int, exposure double")


def select_features(df: DataFrame, cols: Sequence[str], label: str, limit: float = 0.95, top_k: int | None = None, reg: float = 0.01) -> list[str]:
    """M05/K05 drop the later of two columns correlated above ``limit``, keep what an L1 model uses."""
    m = Correlation.corr(assemble(df, cols), "__x").first()[0].toArray()
    kept: list[int] = []
    for j in range(len(cols)):
        if all(not abs(m[i, j]) > limit for i in kept):
            kept.append(j)
    names = [cols[i] for i in kept]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__s", withMean=True), LogisticRegression(featuresCol="__s", labelCol=label, regParam=reg, elasticNetParam=1.0)])
    coef = np.abs(pipe.fit(df.fillna(0.0, names)).stages[-1].coefficients.toArray())
    ranked = sorted(((w, n) for w, n in zip(coef, names) if w > 0), key=lambda x: (-x[0], x[1]))
    return [n for _, n in ranked[:top_k]] or names


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """M06 information of each column, cut at its quantiles, about a class (an approximation by bins)."""
    long = df.select(c(label).alias("__y"), *[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(x) for x in cols]).unpivot(["__y"], list(cols), "feature", "v")
    cuts = quantile_arrays(long, ["feature"], "v", [i / bins for i in range(1, bins)], "__cuts")
    binned = long.join(F.broadcast(cuts), "feature")  # one row per requested column
    binned = binned.withColumn("__b", F.size(F.filter("__cuts", lambda x: x < c("v"))))
    n = binned.groupBy("feature", "__b", "__y").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy("feature").agg(F.sum("n").alias("t"))
    nb, ny = n.groupBy("feature", "__b").agg(F.sum("n").alias("nb")), n.groupBy("feature", "__y").agg(F.sum("n").alias("ny"))
    d = n.join(nb, ["feature", "__b"]).join(ny, ["feature", "__y"]).join(tot, "feature")
    return d.groupBy("feature").agg(F.sum(c("n") / c("t") * F.ln(c("n") * c("t") / (c("nb") * c("ny")))).alias("score"))


def tree_importances(df: DataFrame, cols: Sequence[str], label: str, seed: int = 0) -> DataFrame:
    """M06 importances of a random forest."""
    m = RandomForestRegressor(featuresCol="__x", labelCol=label, numTrees=20, maxDepth=5, seed=seed).fit(assemble(df, cols))
    rows = list(zip(cols, [float(x) for x in m.featureImportances.toArray()]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def fit_classifier(df: DataFrame, cols: Sequence[str], label: str, seed: int = 0):
    """M07 scaled gradient-boosted classifier."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(cols), outputCol="__v", handleInvalid="keep"),
            StandardScaler(inputCol="__v", outputCol="__s", withMean=True),
            GBTClassifier(featuresCol="__s", labelCol=label, maxIter=10, maxDepth=3, seed=seed),
        ]
    ).fit(df.dropna(subset=list(cols)))


def predict(model, df: DataFrame, out: str = "prob") -> DataFrame:
    """M07 probability of class 1; null where a feature is null or NaN.  Every row stays."""
    whole = ~F.exists(vector_to_array("__v"), lambda x: F.isnan(x))
    d = model.transform(df).withColumn(out, F.when(whole, vector_to_array("probability")[1]))
    return d.select(*df.columns, out)


def calibrate(df: DataFrame, prob: str, label: str, method: str = "platt"):
    """M08 calibration map of a probability; ``apply_calibration`` uses it."""
    d = assemble(df, [prob], "__p")
    if method == "platt":
        return LogisticRegression(featuresCol="__p", labelCol=label).fit(d)
    if method == "isotonic":
        return IsotonicRegression(featuresCol="__p", labelCol=label).fit(d)
    raise ValueError(f"unknown calibration {method!r}")


def apply_calibration(model, df: DataFrame, prob: str, out: str = "calibrated") -> DataFrame:
    d = model.transform(assemble(df, [prob], "__p"))
    value = vector_to_array("probability")[1] if "probability" in d.columns else c("prediction")
    return d.withColumn(out, value).select(*df.columns, out)


def meta_labels(df: DataFrame, cols: Sequence[str], y: str, pred: str, seed: int = 0) -> DataFrame:
    """M08 probability that the primary prediction is right."""
    d = assemble(df.withColumn("__ok", (c(y) == c(pred)).cast("double")), cols)
    m = RandomForestClassifier(featuresCol="__x", labelCol="__ok", numTrees=20, seed=seed).fit(d)
    return m.transform(d).withColumn("meta_prob", vector_to_array("probability")[1]).select(*df.columns, "meta_prob")


def impact_scores(df: DataFrame, cols: Sequence[str], target: str, forest: bool = False, seed: int = 0) -> DataFrame:
    """M09 fitted impact with the residual deviation as its uncertainty."""
    d = assemble(df, cols)
    est = RandomForestRegressor(numTrees=20, seed=seed) if forest else GBTRegressor(maxIter=10, maxDepth=3, seed=seed)
    d = est.setFeaturesCol("__x").setLabelCol(target).setPredictionCol("impact").fit(d).transform(d)
    sd = d.agg(F.stddev_pop(c(target) - c("impact"))).first()[0] or 0.0
    return d.select(*df.columns, "impact").withColumn("uncertainty", F.lit(float(sd)))


def coral_map(source: DataFrame, target: DataFrame, cols: Sequence[str], eps: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """M10 d x d matrix that gives target rows the covariance of the source, with both means."""

    def stats(df: DataFrame):
        pairs = [(a, b) for a in cols for b in cols]
        row = df.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[F.avg(x).alias(f"m_{x}") for x in cols]).first()
        cov = np.array([row[f"c{i}"] for i in range(len(pairs))], float).reshape(len(cols), len(cols))
        return cov + eps * np.eye(len(cols)), np.array([row[f"m_{x}"] for x in cols], float)

    def power(m: np.ndarray, p: float) -> np.ndarray:
        val, vec = np.linalg.eigh(m)
        return (vec * np.maximum(val, eps) ** p) @ vec.T

    (cs, ms), (ct, mt) = stats(source), stats(target)
    return power(ct, -0.5) @ power(cs, 0.5), ms, mt


def coral_align(df: DataFrame, mapping: tuple[np.ndarray, np.ndarray, np.ndarray], cols: Sequence[str]) -> DataFrame:
    """M10 apply the map: a small matrix product as column arithmetic."""
    m, source_mean, target_mean = mapping
    new = {}
    for j, x in enumerate(cols):
        total: Column = F.lit(float(source_mean[j]))
        for i, y in enumerate(cols):
            total = total + (c(y) - float(target_mean[i])) * float(m[i, j])
        new[x] = total
    return df.withColumns(new)


def training_table(features: DataFrame, labels: DataFrame, on: Sequence[str], pseudo: DataFrame | None = None) -> DataFrame:
    """M11 features with labels, plus pseudo-labelled rows."""
    d = features.join(labels, list(on)).withColumn("is_pseudo", F.lit(False))
    return d if pseudo is None else d.unionByName(pseudo.withColumn("is_pseudo", F.lit(True)), allowMissingColumns=True)


def replay_error(old: DataFrame, new: DataFrame, on: Sequence[str], version: str = "version") -> DataFrame:
    """M12 mean absolute difference of old and new probabilities per version."""
    d = old.select(*on, c("prob").alias("__o")).join(new.select(*on, version, c("prob").alias("__n")), list(on))
    return d.groupBy(version).agg(F.avg(F.abs(c("__o") - c("__n"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def exit_policy(df: DataFrame, cols: Sequence[str], gain: str, seed: int = 0) -> DataFrame:
    """M13 probability that holding on pays and whether to leave (2p - 1 < 0)."""
    d = df.withColumn("__y", (c(gain) > 0).cast("double"))
    out = predict(fit_classifier(d, cols, "__y", seed), d, "hold_prob")
    return out.withColumn("should_exit", 2 * c("hold_prob") - 1 < 0).drop("__y")
