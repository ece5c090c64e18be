"""Likelihood-based random variables.

Iterative fits never see rows: Spark makes count cells, and the fits run over
those cells grouped by (signal, fold left out).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import logit, uniform
from ..sources.tables import scan_once, shared_path


def measured_rows(features: DataFrame, outcome: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """L1: measured rows with outcome and fold."""
    return features.filter("n_obs > 0").join(outcome, key).join(folds, key)


def without_each_fold(cells: DataFrame, keys: list[str], sums: list[str], n_folds: int) -> DataFrame:
    """L2: sums for 'all' (fold 0) and without each fold, by subtracting a fold's totals from the overall ones."""
    per = cells.groupBy(*keys, "fold").agg(*[F.sum(c).alias(c) for c in sums])
    roles = per.withColumn("role_fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds))))
    return roles.filter("fold != role_fold").groupBy(*keys, "role_fold").agg(*[F.sum(c).alias(c) for c in sums])


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def dirichlet_alpha(cells: DataFrame, keys: list[str], iterations: int = 200, floor: float = 1e-3) -> DataFrame:
    """L3: Dirichlet-multinomial concentration of three counts by fixed point.

    cells: keys, k_low, k_mid, k_high, m (rows with these counts). A category
    that never occurs makes the fit degenerate: alpha at the floor, flagged.
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        k = pdf[["k_low", "k_mid", "k_high"]].to_numpy(float)
        m = pdf["m"].to_numpy(float)
        n = k.sum(1)
        share = (k * m[:, None]).sum(0) / max((n * m).sum(), 1)
        dead = share <= 0
        a = np.maximum(share * 3, floor)
        distinct = [np.unique(k[:, j], return_inverse=True) for j in range(3)]
        n_values, n_at = np.unique(n, return_inverse=True)
        weights = [np.bincount(at, m) for _, at in distinct]
        n_weights = np.bincount(n_at, m)
        dig = np.vectorize(_digamma)
        for _ in range(iterations):
            total = a.sum()
            below = (n_weights * (dig(n_values + total) - _digamma(total))).sum()
            above = np.array([(w * (dig(v + x) - _digamma(x))).sum() for (v, _), w, x in zip(distinct, weights, a)])
            new = np.where(dead, floor, np.maximum(a * above / below if below > 0 else a, floor))
            if np.abs(new - a).max() < 1e-9:
                a = new
                break
            a = np.minimum(new, 1e6)
        first = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame([{**first, "a_low": a[0], "a_mid": a[1], "a_high": a[2], "rows": int(m.sum()), "degenerate": int(dead.any())}])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", a_low double, a_mid double, a_high double, rows long, degenerate int"
    return cells.groupBy(*keys).applyInPandas(fit, schema)


def prior_table(rows: DataFrame, n_folds: int) -> DataFrame:
    """L4: alpha, its sum, base rate, rows and events by signal and fold left out (0: none)."""
    cells = rows.groupBy("signal", "fold", "k_low", "k_mid", "k_high").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("events"))
    kept = without_each_fold(cells, ["signal", "k_low", "k_mid", "k_high"], ["m", "events"], n_folds)
    rate = kept.groupBy("signal", "role_fold").agg((F.sum("events") / F.sum("m")).alias("base_rate"), F.sum("events").alias("events"))
    a = dirichlet_alpha(kept, ["signal", "role_fold"])
    return a.join(rate, ["signal", "role_fold"]).withColumn("a_sum", F.col("a_low") + F.col("a_mid") + F.col("a_high"))


def shrunken(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """(k + alpha) / (n + sum alpha); priors keyed by signal and role_fold = the row's fold, a small table."""
    j = rows.join(F.broadcast(priors.select("signal", F.col("role_fold").alias("fold"), "a_low", "a_mid", "a_high", "base_rate")), ["signal", "fold"])
    n = F.col("n_obs") + F.col("a_low") + F.col("a_mid") + F.col("a_high")
    return j.withColumns({f"pi_{c}": (F.col(f"k_{c}") + F.col(f"a_{c}")) / n for c in ("low", "mid", "high")})


def least_squares(rows: DataFrame, keys: list[str], xs: list[str], y: str, iterations: int = 0) -> DataFrame:
    """Coefficients from normal equations; Spark sums the products, a small solve per group follows.
    A regressor without variance gets 0. Adds the residual variance."""
    cols = ["_1", *xs]
    d = rows.withColumn("_1", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i] + [F.sum(F.col(a) * F.col(y)).alias(f"t_{i}") for i,
        a in enumerate(cols)] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    g = d.groupBy(*keys).agg(*sums)
    p = len(cols)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                A, b = np.zeros((p, p)), np.array([r[f"t_{i}"] for i in range(p)], float)
                for i in range(p):
                    for j in range(i, p):
                        A[i, j] = A[j, i] = r[f"s_{i}_{j}"]
                live = [0] + [i for i in range(1, p) if A[i, i] - A[0, i] ** 2 / A[0, 0] > 1e-9]
                beta = np.zeros(p)
                beta[live] = np.linalg.lstsq(A[np.ix_(live, live)], b[live], rcond=None)[0]
                rss = max(r["yy"] - beta @ b, 0.0)
                out.append({**{k: r[k] for k in keys}, **{f"b_{c}": beta[i] for i, c in enumerate(["0", *xs])}, "s2": rss / max(A[0, 0] - len(live), 1.0), "rows": int(A[0, 0])})
            yield type(pdf)(out, columns=[*keys, "b_0", *[f"b_{x}" for x in xs], "s2", "rows"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", b_0 double, " + "".join(f"b_{x} double, " for x in xs) + "s2 double, rows long"
    return g.mapInPandas(solve, schema)


def tail_residual(rows: DataFrame, value: str, count: str) -> tuple[DataFrame, DataFrame]:
    """Value minus its linear fit on log1p(k), log n and {k > 0}: (coefficients, rows with residual)."""
    d = rows.filter(F.col(value).isNotNull()).withColumns({"x_k": F.log1p(F.col(count)), "x_n": F.log("n_obs"), "x_any": (F.col(count) > 0).cast("double")})
    coef = least_squares(d, ["signal"], ["x_k", "x_n", "x_any"], value)
    fit = F.col("b_0") + F.col("b_x_k") * F.col("x_k") + F.col("b_x_n") * F.col("x_n") + F.col("b_x_any") * F.col("x_any")
    return coef, d.join(F.broadcast(coef.drop("rows")), "signal").withColumn("residual", F.col(value) - fit)


def ordinal_residual(cells: DataFrame, keys: list[str], iterations: int = 60) -> DataFrame:
    """Proportional odds of an ordinal level on log1p(k) over (level, k, m) cells: cut-points as an array, slope."""

    def fit(pdf):
        import numpy as np
        import pandas as pd

        levels = np.sort(pdf["level"].unique())
        at = np.searchsorted(levels, pdf["level"].to_numpy())
        x, m = np.log1p(pdf["k"].to_numpy(float)), pdf["m"].to_numpy(float)
        cum = np.cumsum(np.bincount(at, m))[:-1] / m.sum()
        theta = np.log(np.clip(cum, 1e-6, 1 - 1e-6) / np.clip(1 - cum, 1e-6, 1))
        par = np.concatenate([theta, [0.0]])
        low, high = at - 1, at

        def grad(par):
            t = np.concatenate([[-40.0], par[:-1], [40.0]])
            s = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            a, b = s(t[low + 1] - par[-1] * x), s(t[high + 1] - par[-1] * x)
            p = np.maximum(b - a, 1e-12)
            da, db = a * (1 - a), b * (1 - b)
            g = np.zeros_like(par)
            for side, d, sign in ((low, da, -1), (high, db, 1)):
                ok = (side >= 0) & (side < len(par) - 1)
                np.add.at(g, side[ok], sign * (m * d / p)[ok])
            g[-1] = (m * -(db - da) * x / p).sum()
            return g

        for _ in range(iterations if len(levels) > 1 else 0):
            g = grad(par)
            H = np.stack([(grad(par + 1e-5 * e) - g) / 1e-5 for e in np.eye(len(par))], axis=1) - 1e-6 * np.eye(len(par))
            step = np.linalg.lstsq(H, g, rcond=None)[0]
            par = par - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "cuts": list(par[:-1]), "slope": float(par[-1]), "levels": list(levels.astype(float))}])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", cuts array<double>, slope double, levels array<double>"
    return cells.groupBy(*keys).applyInPandas(fit, schema)


def mid_pit(rows: DataFrame, fitted: DataFrame, level: str, count: str) -> DataFrame:
    """Logit of the mid-probability of an observed level under its fitted cut-points."""
    j = rows.join(F.broadcast(fitted), "signal").withColumn("_i", F.expr(f"array_position(levels, cast({level} as double))"))
    c = lambda i: F.when(i < 1, F.lit(0.0)).when(i > F.size("cuts"), F.lit(1.0)).otherwise(1 / (1 + F.exp(-(F.get("cuts", (i - 1).cast("int")) - F.col("slope") * F.log1p(F.col(count))))))
    mid = (c(F.col("_i") - 1) + c(F.col("_i"))) / 2
    return j.withColumn("residual", logit(F.greatest(F.least(mid, F.lit(1 - 1e-6)), F.lit(1e-6)))).drop("_i", "cuts", "levels", "slope")


def variance_components(features: DataFrame) -> DataFrame:
    """Pooled within mean square and between-row variance of the means, per signal."""
    return features.filter("n_obs > 1").groupBy("signal").agg(F.count(F.lit(1)).alias("rows"), F.try_divide(F.sum("within_ss"), F.sum(F.col("n_obs") - 1)).alias("within_ms"),
        F.var_samp("within_mean").alias("between_var"), F.avg(1.0 / F.col("n_obs")).alias("mean_inverse_n"))


def binomial_intensity(rows: DataFrame, keys: list[str], a: str, exposure: str, pool: int, iterations: int = 25) -> DataFrame:
    """Logit p = c0 + c1 log D over (a, D) cells by reweighted least squares."""
    cells = rows.filter(F.col(exposure) > 0).groupBy(*keys, F.least(F.col(a), F.lit(pool)).alias("a"), F.col(exposure).alias("d")).agg(F.count(F.lit(1)).alias("m"))

    def fit(pdf):
        import numpy as np
        import pandas as pd

        X = np.stack([np.ones(len(pdf)), np.log(pdf["d"].to_numpy(float))], axis=1)
        y, m, c = pdf["a"].to_numpy(float), pdf["m"].to_numpy(float), np.zeros(2)
        for _ in range(iterations):
            p = 1 / (1 + np.exp(-np.clip(X @ c, -30, 30)))
            w = m * pool * p * (1 - p) + 1e-12
            step = np.linalg.lstsq((X * w[:, None]).T @ X + 1e-9 * np.eye(2), X.T @ (m * (y - pool * p)), rcond=None)[0]
            c = c + np.clip(step, -2, 2)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "c0": c[0], "c1": c[1]}])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", c0 double, c1 double")


def pearson_residual(rows: DataFrame, fit: DataFrame, keys: list[str], a: str, exposure: str, pool: int) -> DataFrame:
    """(a - M p) / sqrt(M p (1 - p)); 0 where unexposed; a capped at M."""
    p = 1 / (1 + F.exp(-(F.col("c0") + F.col("c1") * F.log(exposure))))
    r = (F.least(F.col(a), F.lit(pool)) - pool * p) / F.sqrt(pool * p * (1 - p))
    fit = scan_once(fit, shared_path(rows.sparkSession, "intensity-fits"))  # its written size decides how it is joined
    return rows.join(fit, keys).withColumn("residual", F.when(F.col(exposure) > 0, r).otherwise(0.0)).drop("c0", "c1")


def lognormal_intensity(rows: DataFrame, keys: list[str], amount: str, exposure: str) -> DataFrame:
    """Slope, intercept and R2 of log amount on log exposure, their correlation, and what a bare rate A/D does."""
    d = rows.filter((F.col(amount) > 0) & (F.col(exposure) > 0)).withColumns({"ly": F.log(amount), "lx": F.log(exposure), "bare": F.log(F.col(amount) / F.col(exposure))})
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"),
        F.regr_r2("ly", "lx").alias("r2"), F.corr("ly", "lx").alias("correlation"), F.corr("bare", "lx").alias("bare_correlation"))


def shrinkage_weights(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Own-count weight n / (n + alpha sum) at the quartiles of coverage."""
    q = rows.groupBy("signal").agg(F.percentile("n_obs", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("n"))
    j = q.join(priors.filter("role_fold = 0").select("signal", "a_sum"), "signal")
    return j.select("signal", F.posexplode("n").alias("quartile", "n"), "a_sum").withColumn("weight", F.col("n") / (F.col("n") + F.col("a_sum")))


def predictive_check(rows: DataFrame, priors: DataFrame, seed: int) -> DataFrame:
    """Pearson dispersion of the low count under its beta-binomial, and observed against expected zero and full rates."""
    j = rows.join(F.broadcast(priors.filter("role_fold = 0").select("signal", "a_low", "a_sum")), "signal")
    p, n = F.col("a_low") / F.col("a_sum"), F.col("n_obs")
    var = n * p * (1 - p) * (F.col("a_sum") + n) / (F.col("a_sum") + 1)

    def none(pdf):  # chance of no low count: product over i of (b + i) / (a + b + i)
        import numpy as np
        import pandas as pd

        lg = np.vectorize(math.lgamma)
        b, s, n = pdf["b"], pdf["s"], pdf["n"]
        return pd.Series(np.exp(lg(b + n) - lg(b) - lg(s + n) + lg(s))) if len(pdf) else pd.Series([], dtype=float)

    cells = j.groupBy("signal", "n_obs", "a_low", "a_sum").agg(F.count(F.lit(1)).alias("m"), F.sum(((F.col("k_low") - n * p) ** 2) / var).alias("z2"),
        F.count_if(F.col("k_low") == 0).alias("zero"), F.count_if(F.col("k_low") == n).alias("full"), F.min(uniform(F.lit(seed), F.col("k_low"))).alias("u"))
    none_udf = F.pandas_udf(lambda s: none(s), "double")
    cells = cells.withColumn("p0", none_udf(F.struct((F.col("a_sum") - F.col("a_low")).alias("b"), F.col("a_sum").alias("s"), n.cast("double").alias("n"))))
    cells = cells.withColumn("p1", none_udf(F.struct(F.col("a_low").alias("b"), F.col("a_sum").alias("s"), n.cast("double").alias("n"))))
    m = F.sum("m")
    return cells.groupBy("signal").agg((F.sum("z2") / m).alias("dispersion"), (F.sum("zero") / m).alias("zero_seen"), (F.sum(F.col("p0") * F.col("m")) / m).alias("zero_expected"),
        (F.sum("full") / m).alias("full_seen"), (F.sum(F.col("p1") * F.col("m")) / m).alias("full_expected"))


def dispersion_drift(residuals: DataFrame, breaks: list[int]) -> DataFrame:
    """Mean squared residual in coverage bins and the ratio of the last to the first."""
    b = F.lit(0)
    for x in breaks:
        b = b + F.when(F.col("n_obs") > x, 1).otherwise(0)
    g = residuals.withColumn("coverage", b).groupBy("signal", "coverage").agg(F.avg(F.col("residual") ** 2).alias("d"))
    return g.groupBy("signal").agg(F.min_by("d", "coverage").alias("first"), F.max_by("d", "coverage").alias("last")).withColumn("ratio", F.try_divide("last", "first"))


def residual_diagnostics(residuals: DataFrame, count: str) -> DataFrame:
    """Between-count share of residual variance, residual sd, share beyond three sds, spread against coverage."""
    total = residuals.groupBy("signal").agg(F.var_pop("residual").alias("v"), F.avg("residual").alias("mu"), F.stddev_samp("residual").alias("sd"),
        F.corr(F.abs("residual"), F.col("n_obs").cast("double")).alias("spread_corr"), F.count(F.lit(1)).alias("n"))
    bins = residuals.groupBy("signal", count).agg(F.count(F.lit(1)).alias("m"), F.avg("residual").alias("r"))
    between = bins.join(total, "signal").groupBy("signal").agg((F.sum(F.col("m") * (F.col("r") - F.col("mu")) ** 2) / F.max("n")).alias("bv"))
    off = residuals.join(total.select("signal", "mu", "sd"), "signal").groupBy("signal").agg(F.avg((F.abs(F.col("residual") - F.col("mu")) > 3 * F.col("sd")).cast("double")).alias("off_scale"))
    return total.join(between, "signal").join(off, "signal").select("signal", "n", "sd", "spread_corr", "off_scale", F.try_divide("bv", "v").alias("dependence"))


def level_calibration(rows: DataFrame, fitted: DataFrame, level: str, count: str) -> DataFrame:
    """Observed and expected rows per level of the ordinal fit, over (k) cells."""
    cells = rows.groupBy("signal", F.col(count).alias("k"), F.col(level).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    per_k = cells.groupBy("signal", "k").agg(F.sum("m").alias("m")).join(F.broadcast(fitted), "signal").select("*", F.posexplode("levels").alias("i", "v"))
    c = lambda i: F.when(i < 1, F.lit(0.0)).when(i > F.size("cuts"), F.lit(1.0)).otherwise(1 / (1 + F.exp(-(F.get("cuts", (i - 1).cast("int")) - F.col("slope") * F.log1p("k")))))
    expected = per_k.groupBy("signal", "v").agg(F.sum(F.col("m") * (c(F.col("i") + 1) - c(F.col("i")))).alias("expected"))
    return expected.join(cells.groupBy("signal", "v").agg(F.sum("m").alias("observed")), ["signal", "v"], "left")


def fold_stability(parameters: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean, sd, coefficient of variation, range and sign flips of each parameter over the folds left out."""
    long = parameters.filter("role_fold > 0").unpivot([*keys, "role_fold"], names, "parameter", "v")
    g = long.groupBy(*keys, "parameter").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), (F.max("v") - F.min("v")).alias("range"), ((F.min("v") < 0) & (F.max("v") > 0)).cast("int").alias("flips"))
    return g.withColumn("cv", F.try_divide("sd", F.abs("mean")))


def step_at_zero(residuals: DataFrame, count: str, most: int) -> DataFrame:
    """Mean residual and standard error by capped count, and the jump from 0 to 1."""
    g = residuals.groupBy("signal", F.least(F.col(count), F.lit(most)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), (F.stddev_samp("residual") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    jump = g.groupBy("signal").agg((F.max(F.when(F.col("k") == 1, F.col("mean"))) - F.max(F.when(F.col("k") == 0, F.col("mean")))).alias("jump"))
    return g.join(jump, "signal", "left")
