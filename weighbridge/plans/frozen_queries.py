"""Queries that apply declared parameters or fixed residuals, so that SQL can state what follows the fit."""

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import likelihood as L
from ..sources import tables as S
from . import base as B
from .evidence_queries import _rows
from .registry import query

#: signal, fold left out, alpha of low, mid and high counts, base rate
ALPHAS = [(s, f, 0.5 + 0.25 * i, 2.0 + f, 1.0 + 0.5 * i, 0.25) for i, s in enumerate(B.SIGNALS) for f in range(B.FOLDS + 1)]
ROWS = B.GRID + f""",
rws AS (SELECT g.*, y, fold FROM grid g JOIN people USING (user_id) WHERE n_obs > 0),
alphas(signal, role_fold, a_low, a_mid, a_high, base_rate) AS (VALUES {B._values(ALPHAS)}),
res AS (SELECT signal, n_obs, k_high, round(q95 - 2 * k_high, 2) + 0.0 AS residual FROM rws)"""


def _alphas(spark):
    t = S.spec_table(spark, ALPHAS, "signal string, role_fold int, a_low double, a_mid double, a_high double, base_rate double")
    return t.withColumn("a_sum", F.col("a_low") + F.col("a_mid") + F.col("a_high"))


def _residuals(spark, d):
    return _rows(spark, d).select("signal", "n_obs", "k_high", (F.round(F.col("q95") - 2 * F.col("k_high"), 2) + F.lit(0.0)).alias("residual"))


@query("frozen_shares", B.sql(ROWS, "SELECT user_id, signal, (k_low + a_low) / (n_obs + a_low + a_mid + a_high) AS pi_low, (k_mid + a_mid) / (n_obs + a_low + a_mid + a_high) AS pi_mid, (k_high + a_high) / (n_obs + a_low + a_mid + a_high) AS pi_high FROM rws JOIN alphas USING (signal) WHERE role_fold = fold", "pi_low pi_mid pi_high"))
def frozen_shares(spark, d):
    """Shrunken shares under declared priors, looked up by signal and the row's fold."""
    return B.rounded(L.shrunken(_rows(spark, d), _alphas(spark)).select("user_id", "signal", "pi_low", "pi_mid", "pi_high"))


@query("frozen_weights", B.sql(ROWS, "SELECT signal, i::BIGINT AS quartile, n, a_sum, n / (n + a_sum) AS weight FROM (SELECT signal, i, q[i + 1] AS n FROM (SELECT signal, quantile_cont(n_obs, [0.25, 0.5, 0.75]) AS q FROM rws GROUP BY 1), range(3) r(i)) JOIN (SELECT signal, a_low + a_mid + a_high AS a_sum FROM alphas WHERE role_fold = 0) USING (signal)", "n a_sum weight"))
def frozen_weights(spark, d):
    """Own-count weight at the quartiles of coverage under declared priors."""
    return B.rounded(L.shrinkage_weights(_rows(spark, d), _alphas(spark)).select("signal", F.col("quartile"), "n", "a_sum", "weight"))


@query("residual_drift", B.sql(ROWS, "SELECT signal, arg_min(m, c) AS first, arg_max(m, c) AS last, arg_max(m, c) / arg_min(m, c) AS ratio FROM (SELECT signal, (n_obs > 4)::INT + (n_obs > 8)::INT + (n_obs > 12)::INT AS c, avg(residual * residual) AS m FROM res GROUP BY ALL) GROUP BY 1", "first last ratio", 4))
def residual_drift(spark, d):
    """Mean squared residual in coverage bins, last against first."""
    out = L.dispersion_drift(_residuals(spark, d), [4, 8, 12])
    return out.select("signal", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("first", "last", "ratio")])


@query("residual_checks", B.sql(ROWS, """
SELECT t.signal, t.n, t.sd, t.spread_corr, o.off_scale, b.bv / t.v AS dependence FROM (SELECT signal, count(*) AS n, stddev_samp(residual) AS sd, var_pop(residual) AS v, avg(residual) AS mu, corr(abs(residual), n_obs) AS spread_corr FROM res GROUP BY 1) t
JOIN (SELECT signal, avg((abs(residual - mu) > 3 * sd)::INT) AS off_scale FROM res JOIN (SELECT signal, avg(residual) AS mu, stddev_samp(residual) AS sd FROM res GROUP BY 1) USING (signal) GROUP BY 1) o USING (signal)
JOIN (SELECT signal, sum(m * (r - mu) * (r - mu)) / sum(m) AS bv FROM (SELECT signal, k_high, count(*) AS m, avg(residual) AS r FROM res GROUP BY ALL) JOIN (SELECT signal, avg(residual) AS mu FROM res GROUP BY 1) USING (signal) GROUP BY 1) b USING (signal)""", "sd spread_corr off_scale dependence"))
def residual_checks(spark, d):
    """Dependence on the count, spread against coverage, off-scale share and sd."""
    return B.rounded(L.residual_diagnostics(_residuals(spark, d), "k_high"))


@query("residual_steps", B.sql(ROWS, """
SELECT signal, k::BIGINT AS k, n, mean, se, jump FROM (SELECT signal, least(k_high, 3) AS k, count(*) AS n, avg(residual) AS mean, stddev_samp(residual) / sqrt(count(*)) AS se FROM res GROUP BY ALL)
JOIN (SELECT signal, avg(residual) FILTER (k_high = 1) - avg(residual) FILTER (k_high = 0) AS jump FROM res GROUP BY 1) USING (signal)""", "mean se jump"))
def residual_steps(spark, d):
    """Mean residual by capped count and the jump from none to one."""
    return B.rounded(L.step_at_zero(_residuals(spark, d), "k_high", 3))


STABLE = B.sql(ROWS, """
SELECT signal, parameter, avg(v) AS mean, stddev_samp(v) AS sd, max(v) - min(v) AS range, (min(v) < 0 AND max(v) > 0)::BIGINT AS flips, stddev_samp(v) / nullif(abs(avg(v)), 0) AS cv
FROM (SELECT signal, f.role_fold, sum(k_high)::DOUBLE / sum(n_obs) AS share_high, sum(k_high - k_low)::DOUBLE / sum(n_obs) AS tilt FROM rws, range(1, 4) f(role_fold) WHERE fold <> f.role_fold GROUP BY ALL) UNPIVOT (v FOR parameter IN (share_high, tilt)) GROUP BY ALL""", "mean sd range cv")


@query("share_stability", STABLE)
def share_stability(spark, d):
    """Mean, sd, range, sign flips and variation of two shares over the folds left out."""
    t = L.without_each_fold(_rows(spark, d), ["signal"], ["n_obs", "k_high", "k_low"], B.FOLDS)
    t = t.select("signal", "role_fold", (F.col("k_high") / F.col("n_obs")).alias("share_high"), ((F.col("k_high") - F.col("k_low")) / F.col("n_obs")).alias("tilt"))
    return B.rounded(L.fold_stability(t, ["signal"], ["share_high", "tilt"]))


@query("deviance_triage", B.sql(ROWS, """
SELECT *, (len(flags) > 0)::BIGINT + (flags LIKE '%,%')::BIGINT + (flags LIKE '%,%,%')::BIGINT AS n_flags FROM (
  SELECT signal, 0::BIGINT AS role_fold, 1 - dev / nulldev AS explained, concat_ws(',', CASE WHEN 1 - dev / nulldev < 0 THEN 'worse_than_null' END, CASE WHEN ev < 10 THEN 'few_events' END, CASE WHEN 8 > ev / 5 THEN 'overfitted' END) AS flags
  FROM (SELECT signal, sum(y) AS ev, sum(k_high)::DOUBLE AS dev, count(*)::DOUBLE AS nulldev FROM rws GROUP BY 1)) WHERE flags <> ''""", "explained"))
def deviance_triage(spark, d):
    """Flags by threshold over a declared table of fits."""
    g = _rows(spark, d).groupBy("signal").agg(F.sum("y").alias("events"), F.sum("k_high").cast("double").alias("deviance"), F.count(F.lit(1)).cast("double").alias("null_deviance"))
    fits = g.withColumns({"edf": F.lit(8.0), "role_fold": F.lit(0)})
    return B.rounded(E.triage(fits).select("signal", "role_fold", "explained", "flags", "n_flags"))
