"""Additive evidence models and the evidence matrix.

One model per (signal, fold left out): a penalised logistic regression on a
piecewise-linear basis, fitted by operators/additive.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import beside, percentiles, prefix_sums, uniform
from ..sources.tables import scan_once, shared_path
from .additive import fit_jobs, leaving_out


def model_frame(rows: DataFrame, key: str, covariates: list[str]) -> DataFrame:
    """A4: one row per key, signal and covariate, in long form."""
    return rows.select(key, "signal", "fold", "y", *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot([key, "signal", "fold", "y"], covariates, "covariate", "x")


def knots(rows: DataFrame, covariates: list[str], n_knots: int) -> DataFrame:
    """Quantile knots of every covariate by signal (a parameter table, a row for each signal); all covariates in one keyed job."""
    at = [(i + 1) / (n_knots + 1) for i in range(n_knots)]
    long = rows.select("signal", *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot(["signal"], covariates, "covariate", "x")
    q = percentiles(long, ["signal", "covariate"], "x", at)
    wide = q.groupBy("signal").agg(*[F.max(F.when(F.col("covariate") == c, F.col("q"))).alias(f"knots_{c}") for c in covariates])
    return scan_once(rows.select("signal").distinct().join(wide, "signal", "left"), shared_path(rows.sparkSession, "knots"))


def basis(rows: DataFrame, knot_table: DataFrame, covariates: list[str], n_knots: int) -> tuple[DataFrame, list[str]]:
    """Intercept, linear part and hinges at the knots, as column expressions."""
    d = rows.join(F.broadcast(knot_table), "signal").withColumn("z_0", F.lit(1.0))
    names = ["z_0"]
    for c in covariates:
        d = d.withColumn(f"z_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        names.append(f"z_{c}")
        for i in range(n_knots):
            d = d.withColumn(f"z_{c}_{i}", F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.get(f"knots_{c}", F.lit(i)), F.lit(0.0)))
            names.append(f"z_{c}_{i}")
    return d.drop(*[f"knots_{c}" for c in covariates]), names


def fit_additive(design: DataFrame, names: list[str], n_folds: int, ridge: float = 1.0, iterations: int = 8, roles: dict[int, list[int]] | None = None) -> DataFrame:
    """Coefficients (array), edf, deviance and null deviance for every (signal, role_fold).

    design: signal, fold, y, basis columns. role_fold 0 uses all rows, f leaves fold f out; roles names other sets
    of folds to leave out (A9: pairs).
    Columns are scaled by their root mean square so that one ridge serves all.
    """
    roles = {0: [], **{f: [f] for f in range(1, n_folds + 1)}} if roles is None else roles
    fits = fit_jobs(design, ["signal"], names, leaving_out(roles), ridge, iterations)
    return fits.withColumnRenamed("role", "role_fold").withColumns({c: F.col(c).cast("long") for c in ("n", "events")})


def weight_of_evidence(design: DataFrame, names: list[str], fitted: DataFrame, key: str, out_of_fold: bool = True) -> DataFrame:
    """Linear predictor minus the logit of the base rate, from stored coefficients (a small table)."""
    x = F.array(*[F.col(n) for n in names])
    f = fitted.select("signal", F.col("role_fold").alias("fold"), "b", "prior")
    j = design.join(F.broadcast(f), ["signal", "fold"]) if out_of_fold else design.join(F.broadcast(f.filter("fold = 0").drop("fold")), "signal")
    eta = F.aggregate(F.zip_with(x, "b", lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)
    return j.select(key, "signal", "fold", "y", (eta - F.col("prior")).alias("l"))


def terms(design: DataFrame, names: list[str], fitted: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Contribution of every term relative to its mean over the rows (the anchor), plus the reference evidence."""
    at = {n: i + 1 for i, n in enumerate(names)}
    j = design.join(F.broadcast(fitted.filter("role_fold = 0").select("signal", "b", "prior")), "signal")
    term = {t: sum((F.col(n) * F.element_at("b", at[n]) for n in cols), F.lit(0.0)) for t, cols in groups.items()}
    j = j.select(key, "signal", *[v.alias(f"f_{t}") for t, v in term.items()], (F.element_at("b", 1) - F.col("prior")).alias("f_base"))
    anchors = j.groupBy("signal").agg(*[F.avg(f"f_{t}").alias(f"m_{t}") for t in groups])
    j = j.join(F.broadcast(anchors), "signal")
    reference = F.col("f_base") + sum((F.col(f"m_{t}") for t in groups), F.lit(0.0))
    return j.select(key, "signal", *[(F.col(f"f_{t}") - F.col(f"m_{t}")).alias(t) for t in groups], reference.alias("reference"))


def coverage(evidence: DataFrame) -> DataFrame:
    """Rows scored, zeros, mean, sd, tails and extremes of l per signal."""
    plain = evidence.groupBy("signal").agg(F.count("l").alias("n"), F.count_if(F.col("l") == 0).alias("zeros"), F.avg("l").alias("mean"), F.stddev_samp("l").alias("sd"), F.min("l").alias("least"), F.max("l").alias("largest"))
    j = beside(plain, percentiles(evidence, ["signal"], "l", [0.05, 0.95]), ["signal"], few=True, how="left")
    return j.select("signal", "n", "zeros", "mean", "sd", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q95"), "least", "largest")


def triage(fits: DataFrame) -> DataFrame:
    """Flags by threshold, rows with any, most flags first."""
    explained = 1 - F.try_divide("deviance", "null_deviance")
    flags = F.array_compact(F.array(F.when(explained < 0, F.lit("worse_than_null")), F.when(F.col("events") < 10, F.lit("few_events")), F.when(F.col("edf") > F.col("events") / 5, F.lit("overfitted"))))
    return fits.withColumn("explained", explained).withColumn("flags", F.array_join(flags, ",")).withColumn("n_flags", F.size(flags)).filter("n_flags > 0").orderBy(F.desc("n_flags"), "signal", "role_fold")


def dominant_atom(frame: DataFrame) -> DataFrame:
    """Largest point mass of every covariate (ties to the smaller value)."""
    c = frame.groupBy("signal", "covariate", "x").agg(F.count(F.lit(1)).alias("m"))
    return c.groupBy("signal", "covariate").agg(F.min(F.struct((-F.col("m")).alias("m"), "x")).alias("a"), F.sum("m").alias("n")).select("signal", "covariate", F.col("a.x").alias("atom"), (-F.col("a.m") / F.col("n")).alias("share"))


def pair_fold_evidence(design: DataFrame, names: list[str], n_folds: int, key: str, **fit) -> DataFrame:
    """Evidence of every row from the fits that leave out its own fold and one other: key, signal, fold, other, y, l.

    A stack that is tested on fold `other` can be trained on these without having seen it.
    """
    pairs = {100 * a + b: [a, b] for a in range(1, n_folds + 1) for b in range(a + 1, n_folds + 1)}
    fitted = fit_additive(design, names, n_folds, roles=pairs, **fit)
    low, high = F.floor(F.col("role_fold") / 100).cast("int"), (F.col("role_fold") % 100).cast("int")
    both = F.array(F.struct(low.alias("fold"), high.alias("other")), F.struct(high.alias("fold"), low.alias("other")))
    f = fitted.select("signal", "b", "prior", F.explode(both).alias("p")).select("signal", "b", "prior", "p.*")
    eta = F.aggregate(F.zip_with(F.array(*[F.col(n) for n in names]), "b", lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)
    return design.join(F.broadcast(f), ["signal", "fold"]).select(key, "signal", "fold", "other", "y", (eta - F.col("prior")).alias("l"))


def permuted_nonzero(rows: DataFrame, key: str, value: str, within: list[str], seed: int) -> DataFrame:
    """Values other than 0 shuffled among the rows that have one, inside each group; zeros and unknown values stay where they are."""
    moved = F.coalesce(F.col(value) != 0, F.lit(False))
    return rows.filter(~moved).select(key, *within, value).unionByName(permuted(rows.filter(moved), key, value, within, seed).select(key, *within, value))


def permuted(rows: DataFrame, key: str, value: str, within: list[str], seed: int) -> DataFrame:
    """Values shuffled among the rows of a class, by joining hash order to key order."""
    at = lambda df, order: prefix_sums(df.withColumn("_one", F.lit(1)), within, order, ["_one"], few=True).withColumnRenamed("before__one", "_i")
    a = at(rows.select(key, *within), [key]).select(key, *within, "_i")
    b = at(rows.select(key, *within, value).withColumn("_u", uniform(F.lit(seed), F.col(key))), ["_u", key]).select(*within, value, "_i")
    return a.join(b, [*within, "_i"]).drop("_i")


def support(values: DataFrame, keys: list[str], x: str, y: str, n_grid: int, reach: int, least: int) -> DataFrame:
    """Rows and events in a moving window of grid cells, and whether a cell is supported."""
    limits = scan_once(percentiles(values, keys, x, [0.01, 0.99]).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), shared_path(values.sparkSession, "limits"))
    v = values.join(limits, keys).filter(F.col(x).between(F.col("lo"), F.col("hi")) & (F.col("hi") > F.col("lo")))
    cell = F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_grid), F.lit(n_grid - 1)).cast("int")
    g = v.withColumn("cell", cell).groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"))
    w = Window.partitionBy(*keys).orderBy("cell").rangeBetween(-reach, reach)
    return g.withColumn("n_near", F.sum("n").over(w)).withColumn("events_near", F.sum("events").over(w)).withColumn("supported", (F.col("n_near") >= least).cast("int"))


def support_2d(values: DataFrame, a: str, b: str, n_grid: int, least: int) -> DataFrame:
    """Counts on a grid of two covariates, summed over neighbouring cells."""
    lim = values.agg(F.min(a).alias("la"), F.max(a).alias("ha"), F.min(b).alias("lb"), F.max(b).alias("hb"))
    c = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0)) * n_grid), F.lit(n_grid - 1)).cast("int")
    cells = values.crossJoin(F.broadcast(lim)).select(c(a, "la", "ha").alias("i"), c(b, "lb", "hb").alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    around = F.explode(F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1)]))
    spread = cells.select("i", "j", "n", around.alias("s")).select((F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"), F.col("n").alias("near"))
    near = spread.groupBy("i", "j").agg(F.sum("near").alias("n_near"))
    return cells.join(near, ["i", "j"]).withColumn("supported", (F.col("n_near") >= least).cast("int"))


def curve_summary(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Range of a curve, number of extrema and direction; curves: keys, cell, f."""
    w = Window.partitionBy(*keys).orderBy("cell")
    d = curves.withColumn("d", F.col("f") - F.lag("f").over(w)).withColumn("turn", F.when(F.signum("d") * F.signum(F.lag("d").over(w)) < 0, 1).otherwise(0))
    return d.groupBy(*keys).agg((F.max("f") - F.min("f")).alias("range"), F.sum("turn").alias("extrema"), F.when(F.min("d") >= 0, "up").when(F.max("d") <= 0, "down").otherwise("mixed").alias("direction"))


def evidence_grid(keys: DataFrame, signals: DataFrame, evidence: DataFrame, key: str, fill: float | None = 0.0) -> DataFrame:
    """The dense key x signal table with 0 (or null) where unmeasured and a measured flag."""
    g = keys.select(key).distinct().crossJoin(F.broadcast(signals)).join(evidence.select(key, "signal", "l"), [key, "signal"], "left")
    g = g.withColumn("measured", F.col("l").isNotNull().cast("int"))
    return g if fill is None else g.fillna(fill, ["l"])


def derived_arm(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Difference of two arms, cell by cell."""
    j = a.select(key, "signal", F.col("l").alias("x")).join(b.select(key, "signal", F.col("l").alias("y")), [key, "signal"])
    return j.select(key, "signal", F.lit(name).alias("arm"), (F.col("x") - F.col("y")).alias("l"))


def scores(evidence: DataFrame, key: str) -> DataFrame:
    """Evidence summed over signals, per key and arm."""
    return evidence.groupBy(key, "arm").agg(F.sum("l").alias("score"))


def signal_pairs(cells: DataFrame, key: str, extra: tuple[str, ...] = (), own: bool = False) -> DataFrame:
    """extra, a, b, x, z: every pair of a key's known signals once, a before b (with own also each with itself); cells meet by key in one shuffle."""
    lines = cells.filter("l is not null").groupBy(key, *extra).agg(F.array_sort(F.collect_list(F.struct("signal", "l"))).alias("e"))  # signals are few
    pairs = F.expr(f"explode(flatten(transform(e, (p, i) -> transform(slice(e, i + {1 if own else 2}, size(e)), q -> named_struct('a', p.signal, 'b', q.signal, 'x', p.l, 'z', q.l)))))")
    return lines.select(*extra, pairs.alias("p")).select(*extra, "p.*")


def correlations(cells: DataFrame, key: str) -> DataFrame:
    """All pairs of signals, pairwise complete. cells: one row a key and signal."""
    return signal_pairs(cells, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "z").alias("r")).filter("r is not null")


def spectrum(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """First component's share, components to 80 and 90 %, participation ratio, eigenvalues over 1, per matrix variant."""

    def run(pdf):
        import pandas as pd

        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        M = np.eye(len(names))
        for a, b, r in zip(pdf["a"], pdf["b"], pdf["r"]):
            i, j = names.index(a), names.index(b)
            M[i, j] = M[j, i] = r
        e = np.sort(np.linalg.eigvalsh(M))[::-1]
        q = np.maximum(e, 0)
        c = np.cumsum(q) / q.sum()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "pc1": q[0] / q.sum(), "n80": int((c < 0.8).sum() + 1), "n90": int((c < 0.9).sum() + 1),
            "participation": q.sum() ** 2 / (q**2).sum(), "over_one": int((e > 1).sum()), "psd": int(e[-1] > -1e-9)}])

    return pairs.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", pc1 double, n80 int, n90 int, participation double, over_one int, psd int")


def within_class(cells: DataFrame, key: str) -> DataFrame:
    """Covariance of signal pairs pooled over outcome classes, pairwise complete. cells: one row a key and signal."""
    g = signal_pairs(cells, key, ("y",), own=True).groupBy("a", "b", "y").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("x", "z").alias("c"))
    return g.filter("n > 1").groupBy("a", "b").agg(F.try_divide(F.sum((F.col("n") - 1) * F.col("c")), F.sum(F.col("n") - 1)).alias("covariance"))


def pattern_weights(patterns: DataFrame, covariance: DataFrame, difference: DataFrame) -> DataFrame:
    """w = S^-1 d on the measured subset of each distinct missingness pattern (patterns: comma-joined signals).

    Unknown covariances count as 0. Where a difference is unknown (one outcome class) or the system has no solution, w is null.
    """
    S = {(r["a"], r["b"]): r["covariance"] for r in covariance.collect()}  # signals x signals
    d = {r["signal"]: r["d"] for r in difference.collect()}

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["pattern"]:
                names = [s for s in p.split(",") if s in d]
                if names:
                    M = np.array([[S.get((min(a, b), max(a, b))) or 0.0 for b in names] for a in names]) + 1e-9 * np.eye(len(names))
                    known = all(d[s] is not None for s in names) and np.linalg.matrix_rank(M) == len(names)
                    w = np.linalg.solve(M, [d[s] for s in names]).tolist() if known else [None] * len(names)
                    out += list(zip([p] * len(names), names, w))
            yield type(pdf)(out, columns=["pattern", "signal", "w"])

    return patterns.select("pattern").distinct().mapInPandas(run, "pattern string, signal string, w double")


def patterns(cells: DataFrame, key: str) -> DataFrame:
    """Missingness patterns, their counts, shares and rank."""
    p = cells.filter("measured = 1").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("pattern"))
    return p.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def stacked(design: DataFrame, features: list[str], y: str, non_negative: bool):
    """Logistic stack of evidence columns, unconstrained or with non-negative weights; returns (weights rows, model).

    Without both outcome classes nothing can be fitted: all weights are null and there is no model.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    if design.select(y).filter(F.col(y).isNotNull()).distinct().count() < 2:
        return design.sparkSession.createDataFrame([(f, None) for f in (*features, "intercept")], "feature string, weight double"), None
    v = VectorAssembler(inputCols=features, outputCol="v").transform(design.select(*features, F.col(y).cast("double").alias("label")))
    lr = LogisticRegression(featuresCol="v", labelCol="label", maxIter=50, standardization=False)
    if non_negative:
        lr = lr.setLowerBoundsOnCoefficients(Matrices.dense(1, len(features), [0.0] * len(features)))
    m = lr.fit(v)
    rows = [(f, float(w)) for f, w in zip(features, m.coefficients)] + [("intercept", float(m.intercept))]
    return design.sparkSession.createDataFrame(rows, "feature string, weight double"), m
