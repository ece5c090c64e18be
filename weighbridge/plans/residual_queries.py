"""Residual checks under declared fits, so that SQL can state them, and under fitted models."""

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import likelihood as L
from ..operators import residuals as R
from ..operators.additive import fit_jobs
from ..sources import tables as S
from . import base as B
from .evidence_queries import COVARIATES, _fits, _rows
from .frozen_queries import ROWS, _alphas
from .metric_queries import auc_sql, lifted
from .registry import query

SEED, BINS, PARTS, LEAST = 7, 10, 5, 20
DECLARED = "round(1 / (1 + exp(1.1 - 0.12 * k_high + 0.07 * k_low)), 6)"


def _declared(spark, d):
    r = _rows(spark, d).select("user_id", "signal", "y", "k_low", "k_high", F.round("trend", 4).alias("trend"), F.expr(DECLARED).alias("p"))
    return S.scan_once(r, B.out(spark, "declared"))


Z = R.normal_quantile("v")
RESIDUALS = ROWS + f""",
sc AS (SELECT user_id, signal, y, k_low::DOUBLE AS k_low, k_high::DOUBLE AS k_high, round(trend, 4) AS trend, {DECLARED} AS p FROM rws),
qv AS (SELECT *, round(CASE WHEN y = 1 THEN 1 - p ELSE 0 END + {B.UNIFORM.format(f"concat_ws('|', {SEED}, user_id, signal)")} * CASE WHEN y = 1 THEN p ELSE 1 - p END, 9) AS v FROM sc),
q AS (SELECT *, round({Z}, 9) AS z FROM qv),
plain AS (SELECT signal, count(*) AS n, avg(z * z) AS variance, avg(z * z * z) / pow(avg(z * z), 1.5) AS skew, avg(z * z * z * z) / pow(avg(z * z), 2) - 3 AS kurtosis, avg((abs(z) > 3)::INT) AS beyond_3,
  avg(p) - avg(y) AS in_large, avg((p < 1e-4 OR p > 1 - 1e-4)::INT) AS separated FROM q GROUP BY 1),
ksd AS (SELECT signal, n, max(greatest(v - before / n, (before + m) / n - v)) AS ks FROM (
  SELECT signal, v, m, coalesce(sum(m) OVER (PARTITION BY signal ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(m) OVER (PARTITION BY signal) AS n FROM (SELECT signal, v, count(*) AS m FROM q GROUP BY ALL)) GROUP BY ALL),
ksx AS (SELECT signal, ks, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks AS x FROM ksd),
ksp AS (SELECT signal, ks, CASE WHEN x < 0.2 THEN 1 ELSE greatest(least((SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * x * x)) FROM range(1, 21) r(k)), 1), 0) END AS ks_p FROM ksx),
pb AS (SELECT *, ceil(rank() OVER (PARTITION BY signal ORDER BY p) * {BINS} / count(*) OVER (PARTITION BY signal)) AS b FROM q),
bn AS (SELECT signal, b, count(*) AS n, sum(y) AS o, sum(p) AS e FROM pb GROUP BY ALL),
bins AS (SELECT signal, count(*) AS bins, count_if(abs(t) > 2) AS bins_out, max(abs(t)) AS bins_z, max(abs((o - e) / n)) FILTER (n >= {LEAST}) AS bins_gap, sum(t * t) AS hosmer_lemeshow FROM (SELECT *, (o - e) / sqrt(e * (1 - e / n)) AS t FROM bn) GROUP BY 1),
blk AS (SELECT signal, p, count(*) AS m, avg(y) AS o, avg(p) AS e FROM q GROUP BY signal, p QUALIFY row_number() OVER (PARTITION BY signal ORDER BY count(*) DESC, p) = 1),
cv AS (SELECT signal, covariate, x, z FROM (SELECT signal, z, round(k_low, 6) AS k_low, round(k_high, 6) AS k_high, round(trend, 6) AS trend FROM q) UNPIVOT (x FOR covariate IN (k_low, k_high, trend))),
cb AS (SELECT signal, covariate, b, count(*) AS n, round(sum(z) / count(*), 9) AS mean FROM (SELECT *, ceil(rank() OVER (PARTITION BY signal, covariate ORDER BY x) * {PARTS} / count(*) OVER (PARTITION BY signal, covariate)) AS b FROM cv) GROUP BY ALL),
cw AS (SELECT signal, covariate, max(abs(mean)) AS m, max(abs(mean) * sqrt(n)) AS zz FROM cb GROUP BY ALL),
worst AS (SELECT signal, max(m) AS structure, max(zz) AS structure_z, arg_min(covariate, (-m, covariate)) AS structure_in FROM cw GROUP BY 1)"""


@query("residual_table", B.sql(RESIDUALS, f"""
SELECT signal, plain.n, variance, beyond_3, in_large, separated, skew, kurtosis, ks, ks_p, bins, bins_out, bins_z, bins_gap, hosmer_lemeshow, m / plain.n AS block,
  CASE WHEN m >= {LEAST} THEN o END AS block_seen, CASE WHEN m >= {LEAST} THEN e END AS block_expected, CASE WHEN m >= {LEAST} THEN (o - e) / sqrt(e * (1 - e) / m) END AS block_z, structure, structure_z, structure_in
FROM plain JOIN ksp USING (signal) JOIN bins USING (signal) JOIN blk USING (signal) LEFT JOIN worst USING (signal)""",
"variance beyond_3 in_large separated skew kurtosis ks ks_p bins_z bins_gap hosmer_lemeshow block block_seen block_expected block_z structure structure_z", 5))
def residual_table(spark, d):
    """Residual checks of declared probabilities."""
    t = R.residual_table(_declared(spark, d), "user_id", COVARIATES, SEED, BINS, PARTS, LEAST)
    kinds = dict(t.dtypes)
    return t.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in t.columns])


MID = "rank() OVER (PARTITION BY signal, covariate ORDER BY {0}) + (count(*) OVER (PARTITION BY signal, covariate, {0}) - 1) / 2"


@query("residual_trends", B.sql(RESIDUALS, f"SELECT signal, covariate, corr(rz, rx) AS spearman FROM (SELECT signal, covariate, {MID.format('z')} AS rz, {MID.format('x')} AS rx FROM cv) GROUP BY ALL", "spearman"))
def residual_trends(spark, d):
    """Rank correlation of the residuals with every covariate."""
    return B.rounded(R.covariate_trends(_declared(spark, d), "user_id", COVARIATES, SEED))


@query("residual_qc")
def residual_qc(spark, d):
    """Residual checks of the fitted out-of-fold probabilities, and the slope of the outcome on the evidence."""
    design, names, fits = _fits(spark, d)
    prior = F.broadcast(fits.select("signal", F.col("role_fold").alias("fold"), "prior"))  # a row a fit
    l = E.weight_of_evidence(design, names, fits, "user_id").join(prior, ["signal", "fold"])
    x = design.select("user_id", "signal", *[F.col(c) for c in COVARIATES])
    s = S.scan_once(l.withColumn("p", 1 / (1 + F.exp(-(F.col("l") + F.col("prior"))))).join(x, ["user_id", "signal"]), B.out(spark, "scored"))
    slope = fit_jobs(s.withColumn("one", F.lit(1.0)), ["signal"], ["one", "l"], {0: F.lit(1)}, ridge=1e-6).select("signal", F.col("b")[1].alias("slope"))
    return B.rounded(R.residual_table(s, "user_id", COVARIATES, SEED, BINS, PARTS, LEAST).join(slope, "signal"))


IN, OUT = "round(0.1 * k_high - 0.05 * k_low, 4)", "round(0.1 * k_high - 0.05 * k_low + 0.02 * (fold - 2) * k_high, 4)"
LOSS = "-CASE WHEN y = 1 THEN ln({0}) ELSE ln(1 - {0}) END"
GENERAL = ROWS + f""",
gc AS (SELECT signal, y, {IN} AS l_in, {OUT} AS l_out, 0.25::DOUBLE AS base_in, 0.2 + 0.05 * fold AS base_out FROM rws),
gp AS (SELECT *, 1 / (1 + exp(-(l_in + ln(base_in / (1 - base_in))))) AS p, 1 / (1 + exp(-(l_out + ln(base_out / (1 - base_out))))) AS q FROM gc),
gg AS (SELECT signal, count(*) AS n, sum(y)::BIGINT AS events, avg({LOSS.format('p')}) AS a, avg({LOSS.format('base_in')}) AS a0, avg({LOSS.format('q')}) AS b, avg({LOSS.format('base_out')}) AS b0,
  stddev_samp(l_in) AS sd_in, stddev_samp(l_out) AS sd_out, corr(l_in, l_out) AS correlation, avg(abs(l_in - l_out)) AS difference FROM gp GROUP BY 1),
rk AS ({lifted(auc_sql("(SELECT signal, l_out AS score, y FROM gc)", "signal"))})"""


@query("declared_generalisation", B.sql(GENERAL, "SELECT signal, gg.n, gg.events, 1 - a / a0 AS explained_in, 1 - b / b0 AS explained_out, b / b0 - a / a0 AS optimism, b AS loss_out, b0 AS loss_null, auroc, auprc, lift, sd_in, sd_out, correlation, difference FROM gg JOIN rk USING (signal)",
"explained_in explained_out optimism loss_out loss_null auroc auprc lift sd_in sd_out correlation difference"))
def declared_generalisation(spark, d):
    """In sample against out of fold, for declared evidence."""
    c = _rows(spark, d).select("signal", "y", F.expr(IN).cast("double").alias("l_in"), F.expr(OUT).cast("double").alias("l_out"), F.lit(0.25).alias("base_in"), (0.2 + 0.05 * F.col("fold")).alias("base_out"))
    return B.rounded(R.generalisation(c))


@query("generalisation")
def generalisation(spark, d):
    """In sample against out of fold, for the fitted models."""
    design, names, fits = _fits(spark, d)
    rate = F.broadcast(fits.select("signal", "role_fold", (F.col("events") / F.col("n")).alias("base")))  # a row a fit
    a = E.weight_of_evidence(design, names, fits, "user_id", False).join(rate.filter("role_fold = 0").drop("role_fold"), "signal").select("user_id", "signal", "y", F.col("l").alias("l_in"), F.col("base").alias("base_in"))
    b = E.weight_of_evidence(design, names, fits, "user_id").join(rate.withColumnRenamed("role_fold", "fold"), ["signal", "fold"]).select("user_id", "signal", F.col("l").alias("l_out"), F.col("base").alias("base_out"))
    return B.rounded(R.generalisation(S.scan_once(a.join(b, ["user_id", "signal"]), B.out(spark, "generalisation"))))


PIT = ROWS + f""",
al AS (SELECT signal, category, a, s - a AS b FROM (SELECT signal, a_low + a_mid + a_high AS s, a_low::DOUBLE AS low, a_mid::DOUBLE AS mid, a_high::DOUBLE AS high FROM alphas WHERE role_fold = 0) UNPIVOT (a FOR category IN (low, mid, high))),
lg AS (SELECT user_id, signal, n, category, k FROM (SELECT user_id, signal, n_obs::INT AS n, k_low::INT AS low, k_mid::INT AS mid, k_high::INT AS high FROM rws) UNPIVOT (k FOR category IN (low, mid, high))),
sz AS (SELECT DISTINCT signal, category, n, a, b FROM lg JOIN al USING (signal, category)),
l0 AS (SELECT signal, category, n, a, b, sum(ln((b + i) / (a + b + i))) AS l0 FROM (SELECT *, unnest(range(n)) AS i FROM sz) GROUP BY ALL),
mt AS (SELECT signal, category, n, k, exp(l0 + sum(CASE WHEN k = 0 THEN 0 ELSE ln((n - k + 1) * (a + k - 1) / (k * (b + n - k))) END) OVER (PARTITION BY signal, category, n ORDER BY k)) AS mass FROM (SELECT *, unnest(range(n + 1)) AS k FROM l0)),
ms AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY signal, category, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM mt),
pv AS (SELECT *, round(below + {B.UNIFORM.format("concat_ws('|', 11, user_id, signal, category)")} * mass, 9) AS v FROM lg JOIN ms USING (signal, category, n, k) JOIN al USING (signal, category)),
pz AS (SELECT *, round({Z}, 9) AS z FROM pv),
pk AS (SELECT signal, category, n, max(greatest(v - before / n, (before + m) / n - v)) AS ks FROM (SELECT signal, category, v, m, coalesce(sum(m) OVER (PARTITION BY signal, category ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(m) OVER (PARTITION BY signal, category) AS n FROM (SELECT signal, category, v, count(*) AS m FROM pz GROUP BY ALL)) GROUP BY ALL),
px AS (SELECT signal, category, ks, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks AS x FROM pk),
ex AS (SELECT signal, category, avg(p0) AS none_expected, avg(p1) AS all_expected FROM lg JOIN (SELECT signal, category, n, max(mass) FILTER (k = 0) AS p0, max(mass) FILTER (k = n) AS p1 FROM ms GROUP BY ALL) USING (signal, category, n) GROUP BY ALL),
pp AS (SELECT signal, category, count(*) AS rows, avg(pow(k - n * a / (a + b), 2) / (n * a * b * (a + b + n) / ((a + b) * (a + b) * (a + b + 1)))) AS dispersion, avg((k = 0)::INT) AS none_seen, avg((k = n)::INT) AS all_seen, avg(z) AS pit_mean, stddev_samp(z) AS pit_sd FROM pz GROUP BY ALL)"""


@query("declared_pit", B.sql(PIT, """
SELECT signal, category, rows, dispersion, none_seen, all_seen, pit_mean, pit_sd, none_expected, all_expected, ks,
  CASE WHEN x < 0.2 THEN 1 ELSE greatest(least((SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * x * x)) FROM range(1, 21) r(k)), 1), 0) END AS ks_p
FROM pp JOIN ex USING (signal, category) JOIN px USING (signal, category)""", "dispersion none_seen all_seen pit_mean pit_sd none_expected all_expected ks ks_p"))
def declared_pit(spark, d):
    """Randomised PIT of every count under declared priors."""
    return B.rounded(R.predictive_pit(_rows(spark, d), _alphas(spark).filter("role_fold = 0"), "user_id", 11))


@query("predictive_pit")
def predictive_pit(spark, d):
    """Randomised PIT of every count under the fitted priors."""
    r = S.scan_once(_rows(spark, d), B.out(spark, "rows"))
    return B.rounded(R.predictive_pit(r, L.prior_table(r, B.FOLDS).filter("role_fold = 0"), "user_id", 11))
