"""Residual checks of fitted probabilities and counts by hash uniforms.

A randomised quantile residual is uniform under the model, so its distance from the
uniform law is taken with prefix sums over distinct values: no task sorts a signal.
Normal residuals come from a rational approximation of the inverse normal law, stated
as an expression that every engine reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import beside, prefix_sums, spearman, uniform
from ..sources.tables import scan_once, shared_path
from .metrics import discrimination

#: Coefficients of the published rational approximation of the inverse normal distribution (relative error below 1.2e-9).
CENTRE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
CENTRE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
EDGE = 0.02425


def _horner(coefficients: list[float], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def normal_quantile(p: str) -> str:
    """The inverse normal distribution as SQL text, for p held to 1e-12 from 0 and 1."""
    p = f"least(greatest({p}, CAST(1e-12 AS DOUBLE)), CAST(0.999999999999 AS DOUBLE))"
    r, low, high = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda q: f"{_horner(TAIL_TOP, q)} / {_horner(TAIL_BOTTOM, q)}"
    return f"(CASE WHEN {p} < {EDGE} THEN {tail(low)} WHEN {p} > {1 - EDGE} THEN -({tail(high)}) ELSE ({p} - 0.5) * {_horner(CENTRE_TOP, r)} / {_horner(CENTRE_BOTTOM, r)} END)"


def uniform_distance(values: DataFrame, keys: list[str], v: str) -> DataFrame:
    """keys, ks (largest distance of the values' distribution from the uniform law) and its asymptotic p, by prefix sums over distinct values."""
    cells = values.groupBy(*keys, F.col(v).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    n = cells.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    r = beside(prefix_sums(cells, keys, "_v", ["_m"], few=True), n, keys, few=True)
    d = r.groupBy(*keys).agg(F.max(F.greatest(F.col("_v") - F.col("before__m") / F.col("_n"), (F.col("before__m") + F.col("_m")) / F.col("_n") - F.col("_v"))).alias("ks"), F.max("_n").alias("_n"))
    x = (F.sqrt(F.col("_n").cast("double")) + 0.12 + 0.11 / F.sqrt(F.col("_n").cast("double"))) * F.col("ks")
    p = sum(((-1) ** (k - 1) * 2 * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    return d.select(*keys, "ks", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))).alias("ks_p"))


def quantile_residuals(scored: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds v, uniform under the fitted probability p of y, and its normal quantile z; the draw comes from a hash of key and signal."""
    u = uniform(F.lit(seed), F.col(key), F.col("signal"))
    low, width = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(0.0), F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return scored.withColumn("v", F.round(low + u * width, 9)).withColumn("z", F.round(F.expr(normal_quantile("v")), 9))


def tied_bins(scored: DataFrame, keys: list[str], value: str, n_bins: int, sums: dict[str, Column]) -> DataFrame:
    """Equal-count bins in which rows of one value stay together: keys, bin, n and the named sums."""
    cells = scored.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_m"), *[F.sum(c).alias(n) for n, c in sums.items()])
    n = cells.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    r = beside(prefix_sums(cells, keys, "_v", ["_m"], few=True), n, keys, few=True)
    bin_ = F.ceil((F.col("before__m") + 1) * n_bins / F.col("_n")).cast("int")
    return r.groupBy(*keys, bin_.alias("bin")).agg(F.sum("_m").alias("n"), *[F.sum(c).alias(c) for c in sums])


def residual_table(scored: DataFrame, key: str, covariates: list[str], seed: int, n_bins: int = 10, covariate_bins: int = 5, least_rows: int = 20, apart: float = 1e-4) -> DataFrame:
    """A row for each signal. scored: key, signal, y, p (fitted probability), covariates.

    ks, ks_p, variance, skew and excess kurtosis of the randomised quantile residuals and the share beyond 3; calibration in the
    large; tie-aware bins of p (bins, how many are more than 2 standard errors out, the largest z, the largest gap of bins
    with least_rows, Hosmer-Lemeshow); the largest block of one probability (share, observed, expected, z); the largest mean
    residual and z over bins of a covariate, and which covariate; the share of rows fitted closer than `apart` to 0 or 1.
    Null probabilities take no part.
    """
    scored = scored.filter("p is not null").withColumn("p10", F.round("p", 10))
    q = scan_once(quantile_residuals(scored, key, seed), shared_path(scored.sparkSession, "residuals"))
    z = F.col("z")
    plain = q.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg(z * z).alias("variance"), F.avg(z * z * z).alias("_m3"), F.avg(z * z * z * z).alias("_m4"), F.avg((F.abs(z) > 3).cast("double")).alias("beyond_3"),
                                    (F.avg("p") - F.avg("y")).alias("in_large"), F.avg(((F.col("p") < apart) | (F.col("p") > 1 - apart)).cast("double")).alias("separated"))
    plain = plain.withColumns({"skew": F.try_divide("_m3", F.pow("variance", F.lit(1.5))), "kurtosis": F.try_divide("_m4", F.col("variance") ** 2) - 3}).drop("_m3", "_m4")
    b = tied_bins(q, ["signal"], "p10", n_bins, {"events": F.col("y"), "expected": F.col("p")})
    share = F.col("expected") / F.col("n")
    out = F.try_divide(F.col("events") - F.col("expected"), F.sqrt(F.col("expected") * (1 - share)))
    bins = b.groupBy("signal").agg(F.count(F.lit(1)).alias("bins"), F.count_if(F.abs(out) > 2).alias("bins_out"), F.max(F.abs(out)).alias("bins_z"),
                                   F.max(F.when(F.col("n") >= least_rows, F.abs((F.col("events") - F.col("expected")) / F.col("n")))).alias("bins_gap"), F.sum(out * out).alias("hosmer_lemeshow"))
    blocks = q.groupBy("signal", "p10").agg(F.count(F.lit(1)).alias("m"), F.avg("y").alias("o"), F.avg("p").alias("e"))
    block = blocks.groupBy("signal").agg(F.max(F.struct("m", (-F.col("p10")).alias("_p"), "o", "e")).alias("k"))
    large = F.col("k.m") >= least_rows
    block = block.select("signal", F.col("k.m").alias("block"), F.when(large, F.col("k.o")).alias("block_seen"), F.when(large, F.col("k.e")).alias("block_expected"),
                         F.when(large, F.try_divide(F.col("k.o") - F.col("k.e"), F.sqrt(F.col("k.e") * (1 - F.col("k.e")) / F.col("k.m")))).alias("block_z"))
    long = q.select("signal", "z", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in covariates]).unpivot(["signal", "z"], covariates, "covariate", "x").filter("x is not null")
    c = tied_bins(long, ["signal", "covariate"], "x", covariate_bins, {"total": F.col("z")}).withColumn("mean", F.round(F.col("total") / F.col("n"), 9))
    c = c.groupBy("signal", "covariate").agg(F.max(F.abs("mean")).alias("mean"), F.max(F.abs("mean") * F.sqrt(F.col("n").cast("double"))).alias("z"))
    worst = c.groupBy("signal").agg(F.max("mean").alias("structure"), F.max("z").alias("structure_z"), F.min(F.struct((-F.col("mean")).alias("_m"), "covariate"))["covariate"].alias("structure_in"))
    return plain.join(uniform_distance(q, ["signal"], "v"), "signal").join(bins, "signal").join(block, "signal").join(worst, "signal", "left").withColumn("block", F.col("block") / F.col("n"))


def covariate_trends(scored: DataFrame, key: str, covariates: list[str], seed: int) -> DataFrame:
    """Signal, covariate and the rank correlation of the residual with it."""
    q = scan_once(quantile_residuals(scored.filter("p is not null"), key, seed), shared_path(scored.sparkSession, "residuals"))
    long = q.select("signal", "z", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in covariates]).unpivot(["signal", "z"], covariates, "covariate", "x")
    return spearman(long, ["signal", "covariate"], "z", "x", few=True)


def generalisation(cells: DataFrame) -> DataFrame:
    """A row for each signal. cells: signal, y, l_in and base_in (in sample), l_out and base_out (out of fold); base: the training rate.

    Deviance explained in sample and out of fold (against the training rates) and their difference; log-loss of the model and of
    the rates; AUROC, AUPRC and lift out of fold; spread, correlation and mean absolute difference of the two evidences.
    """
    log = lambda p: F.log(F.greatest(p, F.lit(1e-15)))
    p = lambda l, base: 1 / (1 + F.exp(-(F.col(l) + F.log(F.col(base) / (1 - F.col(base))))))
    loss = lambda q: -F.when(F.col("y") == 1, log(q)).otherwise(log(1 - q))
    s = {"in": loss(p("l_in", "base_in")), "in0": loss(F.col("base_in")), "out": loss(p("l_out", "base_out")), "out0": loss(F.col("base_out"))}
    g = cells.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), *[F.avg(c).alias(k) for k, c in s.items()], F.stddev_samp("l_in").alias("sd_in"), F.stddev_samp("l_out").alias("sd_out"),
                                    F.corr("l_in", "l_out").alias("correlation"), F.avg(F.abs(F.col("l_in") - F.col("l_out"))).alias("difference"))
    ranked = discrimination(cells.select("signal", F.col("l_out").alias("score"), "y"), ["signal"]).select("signal", "auroc", "auprc", "lift")
    explained = lambda a: 1 - F.try_divide(a, f"{a}0")
    return g.join(ranked, "signal").select("signal", "n", "events", explained("in").alias("explained_in"), explained("out").alias("explained_out"), (explained("in") - explained("out")).alias("optimism"),
                                           F.col("out").alias("loss_out"), F.col("out0").alias("loss_null"), "auroc", "auprc", "lift", "sd_in", "sd_out", "correlation", "difference")


# --- L13 --------------------------------------------------------------------------


def mass_table(sizes: DataFrame) -> DataFrame:
    """signal, category, n, k, below (chance of less than k) and mass (of k) of the beta-binomial, once for each size that occurs.

    sizes: signal, category, n, a, b (both positive). Logs of ratios are added up from k = 0, whose chance is a product over n.
    """
    from pyspark.sql import Window

    i = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("i")
    start = sizes.select("*", i).groupBy("signal", "category", "n", "a", "b").agg(F.sum(F.when(F.col("i") < F.col("n"), F.log((F.col("b") + F.col("i")) / (F.col("a") + F.col("b") + F.col("i")))).otherwise(0.0)).alias("l0"))
    t = start.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    up = F.when(F.col("k") == 0, 0.0).otherwise(F.log((F.col("n") - F.col("k") + 1) * (F.col("a") + F.col("k") - 1) / (F.col("k") * (F.col("b") + F.col("n") - F.col("k")))))
    w = Window.partitionBy("signal", "category", "n").orderBy("k")  # n + 1 rows
    t = t.withColumn("mass", F.exp(F.col("l0") + F.sum(up).over(w)))
    return t.withColumn("below", F.coalesce(F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("signal", "category", "n", "k", "below", "mass")


def predictive_pit(rows: DataFrame, priors: DataFrame, key: str, seed: int) -> DataFrame:
    """A row for each signal and category (low, mid, high): dispersion, none and all seen against expected, and the randomised
    probability integral transform: mean and sd of its normal quantiles, and its distance from the uniform law.

    rows: key, signal, n_obs, k_low, k_mid, k_high; priors: signal, a_low, a_mid, a_high (positive). Rows without observations take no part.
    """
    categories = ["low", "mid", "high"]
    a = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"a_{c}").cast("double").alias("a"), (F.col("a_low") + F.col("a_mid") + F.col("a_high") - F.col(f"a_{c}")).cast("double").alias("b")) for c in categories]))
    p = F.broadcast(priors.select("signal", a.alias("p")).select("signal", "p.*"))  # three rows a signal
    long = rows.filter("n_obs > 0").select(F.col(key).alias("key"), "signal", F.col("n_obs").cast("int").alias("n"), *[F.col(f"k_{c}").cast("int").alias(c) for c in categories]).unpivot(["key", "signal", "n"], categories, "category", "k")
    mass = scan_once(mass_table(long.select("signal", "category", "n").distinct().join(p, ["signal", "category"])), shared_path(rows.sparkSession, "masses"))
    j = long.join(mass, ["signal", "category", "n", "k"]).join(p, ["signal", "category"])
    j = j.withColumn("v", F.round(F.col("below") + uniform(F.lit(seed), F.col("key"), F.col("signal"), F.col("category")) * F.col("mass"), 9)).withColumn("z", F.round(F.expr(normal_quantile("v")), 9))
    j = scan_once(j, shared_path(rows.sparkSession, "pit"))
    by, s, n = ["signal", "category"], F.col("a") + F.col("b"), F.col("n")
    mu, var = n * F.col("a") / s, n * F.col("a") * F.col("b") * (s + n) / (s * s * (s + 1))
    none, whole = mass.filter("k = 0").select(*by, "n", F.col("mass").alias("p0")), mass.filter("k = n").select(*by, "n", F.col("mass").alias("p1"))
    sizes = j.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("m")).join(none, [*by, "n"]).join(whole, [*by, "n"])
    expected = sizes.groupBy(*by).agg((F.sum(F.col("p0") * F.col("m")) / F.sum("m")).alias("none_expected"), (F.sum(F.col("p1") * F.col("m")) / F.sum("m")).alias("all_expected"))
    seen = j.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("k") - mu) ** 2 / var).alias("dispersion"), F.avg((F.col("k") == 0).cast("double")).alias("none_seen"), F.avg((F.col("k") == n).cast("double")).alias("all_seen"),
                              F.avg("z").alias("pit_mean"), F.stddev_samp("z").alias("pit_sd"))
    return seen.join(expected, by).join(uniform_distance(j, by, "v"), by)
