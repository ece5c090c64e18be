"""Queries: random variables, additive evidence, matrix geometry, learners and frozen application (L, A, E, B, T3)."""

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import learners, likelihood as L, transport
from ..sources import tables as S
from . import base as B
from .registry import query

COVARIATES = ["k_low", "k_high", "trend"]
PRIORS = [(s, 0.05 * i, -0.4 + 0.1 * i, 0.6 - 0.1 * i) for i, s in enumerate(B.SIGNALS)]


def _rows(spark, d, s=None):
    p = s.people if s else B.people(spark, d)
    return L.measured_rows(B.feature_grid(spark, d, s), p.select("user_id", "y"), p.select("user_id", "fold"), "user_id")


@query("measured_rows", B.sql(B.GRID, "SELECT signal, fold::BIGINT AS fold, count(*) AS rows, sum(n_obs)::BIGINT AS bins, sum(y)::BIGINT AS events FROM grid JOIN people USING (user_id) WHERE n_obs > 0 GROUP BY ALL"))
def measured_rows(spark, d):
    """L1, Q17."""
    return B.rounded(_rows(spark, d).groupBy("signal", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_obs").alias("bins"), F.sum("y").alias("events")))


@query("fold_totals", B.sql(B.GRID, "SELECT signal, r.role_fold::BIGINT AS role_fold, sum(n_obs)::BIGINT AS n_obs, sum(y)::BIGINT AS y FROM grid JOIN people USING (user_id), range(4) r(role_fold) WHERE n_obs > 0 AND fold <> role_fold GROUP BY ALL"))
def fold_totals(spark, d):
    """L2: totals without each fold."""
    return B.rounded(L.without_each_fold(_rows(spark, d), ["signal"], ["n_obs", "y"], B.FOLDS))


@query("prior_table")
def prior_table(spark, d):
    """L3, L4: Dirichlet-multinomial priors by signal and fold left out."""
    return B.rounded(L.prior_table(_rows(spark, d), B.FOLDS))


@query("shrunken_shares")
def shrunken_shares(spark, d):
    """Shrunken propensities under the out-of-fold prior."""
    r = _rows(spark, d)
    return B.rounded(L.shrunken(r, L.prior_table(r, B.FOLDS)).select("user_id", "signal", "pi_low", "pi_mid", "pi_high"))


@query("tail_residuals")
def tail_residuals(spark, d):
    """Linear tail residual and its diagnostics."""
    _, r = L.tail_residual(_rows(spark, d), "q95", "k_high")
    return B.rounded(L.residual_diagnostics(r, "k_high").join(L.dispersion_drift(r, [4, 8, 12]), "signal"))


@query("step_at_zero")
def step_at_zero(spark, d):
    """Mean residual by capped count."""
    _, r = L.tail_residual(_rows(spark, d), "q95", "k_high")
    return B.rounded(L.step_at_zero(r, "k_high", 3))


@query("ordinal_fit")
def ordinal_fit(spark, d):
    """Proportional odds over cells and its level calibration."""
    rows = _rows(spark, d).withColumn("level", F.least(F.floor(F.col("value_median") / 40.0), F.lit(3)).cast("double"))
    cells = rows.groupBy("signal", "level", F.col("k_high").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return B.rounded(L.level_calibration(rows, L.ordinal_residual(cells, ["signal"]), "level", "k_high"))


@query("ordinal_residuals")
def ordinal_residuals(spark, d):
    """Logit of the mid-probability of each observed level."""
    rows = _rows(spark, d).withColumn("level", F.least(F.floor(F.col("value_median") / 40.0), F.lit(3)).cast("double"))
    cells = rows.groupBy("signal", "level", F.col("k_high").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return B.rounded(L.mid_pit(rows, L.ordinal_residual(cells, ["signal"]), "level", "k_high").select("user_id", "signal", "level", "residual"))


@query("variance_components", B.sql(B.GRID, "SELECT signal, count(*) AS rows, sum(within_ss) / sum(n_obs - 1) AS within_ms, var_samp(within_mean) AS between_var, avg(1 / n_obs) AS mean_inverse_n FROM grid WHERE n_obs > 1 GROUP BY 1", "within_ms between_var mean_inverse_n", 4))
def variance_components(spark, d):
    """L8."""
    v = L.variance_components(B.feature_grid(spark, d))
    return v.select("signal", "rows", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("within_ms", "between_var", "mean_inverse_n")])


@query("binomial_intensity")
def binomial_intensity(spark, d):
    """Exposed count given exposure, Pearson residual sums."""
    r = _rows(spark, d)
    fit = L.binomial_intensity(r, ["signal"], "k_high", "n_obs", 24)
    out = L.pearson_residual(r, fit, ["signal"], "k_high", "n_obs", 24)
    return B.rounded(out.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd")))


@query("lognormal_intensity", B.sql(B.GRID, "SELECT signal, count(*) AS n, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept, regr_r2(ly, lx) AS r2, corr(ly, lx) AS correlation, corr(ly - lx, lx) AS bare_correlation FROM (SELECT signal, ln(within_mean * n_obs) AS ly, ln(n_obs) AS lx FROM grid WHERE n_obs > 0) GROUP BY 1", "slope intercept r2 correlation bare_correlation"))
def lognormal_intensity(spark, d):
    """Log amount on log exposure."""
    r = B.feature_grid(spark, d).filter("n_obs > 0").withColumn("amount", F.col("within_mean") * F.col("n_obs"))
    return B.rounded(L.lognormal_intensity(r, ["signal"], "amount", "n_obs"))


@query("prior_diagnostics")
def prior_diagnostics(spark, d):
    """Shrinkage weights and posterior predictive check."""
    r = _rows(spark, d)
    p = L.prior_table(r, B.FOLDS)
    w = L.shrinkage_weights(r, p).groupBy("signal").agg(F.max(F.when(F.col("quartile") == 1, F.col("weight"))).alias("median_weight"))
    return B.rounded(L.predictive_check(r, p, 3).join(w, "signal"))


@query("fold_stability")
def fold_stability(spark, d):
    """L17."""
    return B.rounded(L.fold_stability(L.prior_table(_rows(spark, d), B.FOLDS), ["signal"], ["a_low", "a_mid", "a_high"]))


def _design(spark, d):
    r = S.scan_once(_rows(spark, d).select("user_id", "signal", "fold", "y", *COVARIATES), B.out(spark, "covariates"))
    return E.basis(r, E.knots(r, COVARIATES, 1), COVARIATES, 1)


def _fits(spark, d):
    design, names = _design(spark, d)
    return design, names, E.fit_additive(design, names, B.FOLDS)


@query("model_frame", B.sql(B.GRID, "SELECT signal, covariate, count(*) AS n, sum(x) AS total, count(DISTINCT x) AS values FROM (SELECT signal, k_low::DOUBLE AS k_low, k_high::DOUBLE AS k_high, n_obs::DOUBLE AS n_obs FROM grid WHERE n_obs > 0) UNPIVOT (x FOR covariate IN (k_low, k_high, n_obs)) GROUP BY ALL", "total"))
def model_frame(spark, d):
    """A4: long covariate table."""
    f = E.model_frame(_rows(spark, d), "user_id", ["k_low", "k_high", "n_obs"])
    return B.rounded(f.groupBy("signal", "covariate").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.count_distinct("x").alias("values")))


@query("additive_fits")
def additive_fits(spark, d):
    """Coefficients and diagnostics of every job."""
    return B.rounded(_fits(spark, d)[2].select("signal", "role_fold", "edf", "deviance", "null_deviance", "n", "events", "prior"))


@query("fit_triage")
def fit_triage(spark, d):
    """Fits with any flag."""
    return B.rounded(E.triage(_fits(spark, d)[2]).select("signal", "role_fold", "explained", "flags", "n_flags"))


@query("weight_of_evidence")
def weight_of_evidence(spark, d):
    """Out-of-fold evidence."""
    design, names, fits = _fits(spark, d)
    return B.rounded(E.weight_of_evidence(design, names, fits, "user_id").select("user_id", "signal", "l"))


@query("term_contributions")
def term_contributions(spark, d):
    """Anchored contributions of every term."""
    design, names, fits = _fits(spark, d)
    return B.rounded(E.terms(design, names, fits, "user_id", {c: [n for n in names if n == f"z_{c}" or n.startswith(f"z_{c}_")] for c in COVARIATES}))


@query("evidence_coverage", B.sql(B.EVIDENCE, "SELECT signal, count(l) AS n, count_if(l = 0) AS zeros, avg(l) AS mean, stddev_samp(l) AS sd, quantile_cont(l, 0.05) AS q05, quantile_cont(l, 0.95) AS q95, min(l) AS least, max(l) AS largest FROM evidence GROUP BY 1", "mean sd q05 q95 least largest"))
def evidence_coverage(spark, d):
    """A10, E10."""
    return B.rounded(E.coverage(B.evidence(spark, d)))


@query("dominant_atom", B.sql(B.GRID, "SELECT signal, covariate, x AS atom, m / sum(m) OVER (PARTITION BY signal, covariate) AS share FROM (SELECT signal, covariate, x, count(*) AS m FROM (SELECT signal, k_low::DOUBLE AS k_low, k_high::DOUBLE AS k_high FROM grid WHERE n_obs > 0) UNPIVOT (x FOR covariate IN (k_low, k_high)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY signal, covariate ORDER BY m DESC, x) = 1", "atom share"))
def dominant_atom(spark, d):
    """A13."""
    return B.rounded(E.dominant_atom(E.model_frame(_rows(spark, d), "user_id", ["k_low", "k_high"])))


@query("permuted_within", B.sql(B.EVIDENCE, f"SELECT user_id, y, b.score FROM (SELECT user_id, y, row_number() OVER (PARTITION BY y ORDER BY user_id) AS i FROM scores) a JOIN (SELECT y, score, row_number() OVER (PARTITION BY y ORDER BY {B.UNIFORM.format(chr(39).join(['concat_ws(', '|', ', 12, user_id)']))}, user_id) AS i FROM scores) b USING (y, i)", "score").replace("SELECT user_id, y, b.score", "SELECT user_id, y::BIGINT AS y, b.score"))
def permuted_within(spark, d):
    """Scores shuffled within the outcome class."""
    return B.rounded(E.permuted(B.scores(spark, d), "user_id", "score", ["y"], 12).select("user_id", "y", "score"))


SUPPORT = B.sql(B.EVIDENCE, """SELECT signal, cell::BIGINT AS cell, n, events::BIGINT AS events, (sum(n) OVER w)::BIGINT AS n_near, (sum(events) OVER w)::BIGINT AS events_near, (sum(n) OVER w >= 20)::BIGINT AS supported
FROM (SELECT signal, least(floor((l - lo) / (hi - lo) * 10), 9)::INT AS cell, count(*) AS n, sum(y) AS events FROM evidence JOIN people USING (user_id) JOIN (SELECT signal, quantile_cont(l, 0.01) AS lo, quantile_cont(l, 0.99) AS hi FROM evidence GROUP BY 1) USING (signal) WHERE l BETWEEN lo AND hi AND hi > lo GROUP BY ALL)
WINDOW w AS (PARTITION BY signal ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")


def _support(spark, d):
    return E.support(B.evidence(spark, d).join(B.people(spark, d).select("user_id", "y"), "user_id"), ["signal"], "l", "y", 10, 1, 20)


@query("curve_support", SUPPORT)
def curve_support(spark, d):
    """Rows and events in a moving window of grid cells."""
    return B.rounded(_support(spark, d))


@query("support_2d", B.sql(B.DOCS, """SELECT i::BIGINT AS i, j::BIGINT AS j, n, (SELECT sum(n) FROM c b WHERE abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1)::BIGINT AS n_near, ((SELECT sum(n) FROM c b WHERE abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1) >= 20)::BIGINT AS supported FROM c a""").replace("FROM labels l JOIN documents d USING (doc_id))", "FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT least(floor((score - la) / (ha - la) * 8), 7)::INT AS i, least(floor((score2 - lb) / (hb - lb) * 8), 7)::INT AS j, count(*) AS n FROM ds, (SELECT min(score) la, max(score) ha, min(score2) lb, max(score2) hb FROM ds) GROUP BY ALL)"))
def support_2d(spark, d):
    """Support on a grid of two covariates."""
    return B.rounded(E.support_2d(B.doc_scores(spark, d), "score", "score2", 8, 20))


def _curves(spark, d, bags=None):
    s = _support(spark, d).filter("n > 0")
    return s.select("signal", "cell", (F.col("events") / F.col("n")).alias("f"))


CURVES = f"SELECT signal, cell, events / n AS f FROM ({SUPPORT})"


@query("curve_summary", f"SELECT signal, round(max(f) - min(f), 6) + 0.0 AS range, sum(turn)::BIGINT AS extrema, CASE WHEN min(d) >= 0 THEN 'up' WHEN max(d) <= 0 THEN 'down' ELSE 'mixed' END AS direction FROM (SELECT *, CASE WHEN sign(d) * sign(lag(d) OVER (PARTITION BY signal ORDER BY cell)) < 0 THEN 1 ELSE 0 END AS turn FROM (SELECT signal, cell, f, f - lag(f) OVER (PARTITION BY signal ORDER BY cell) AS d FROM ({CURVES}))) GROUP BY 1")
def curve_summary(spark, d):
    """A18."""
    return B.rounded(E.curve_summary(_curves(spark, d), ["signal"]))


@query("evidence_grid", B.sql(B.EVIDENCE, "SELECT p.user_id, r.signal, coalesce(l, 0) AS l, (l IS NOT NULL)::BIGINT AS measured FROM (SELECT DISTINCT user_id FROM people) p CROSS JOIN (SELECT signal FROM ranges) r LEFT JOIN evidence e ON e.user_id = p.user_id AND e.signal = r.signal", "l"))
def evidence_grid(spark, d):
    """Dense matrix with 0 where unmeasured."""
    return B.rounded(E.evidence_grid(B.people(spark, d), B.ranges(spark).select("signal"), B.evidence(spark, d), "user_id").select("user_id", "signal", "l", "measured"))


@query("derived_arms", B.sql(B.EVIDENCE, "SELECT user_id, 'cond' AS arm, sum(e.l - g.x) AS score FROM evidence e JOIN (SELECT user_id, signal, k_high / n_obs AS x FROM grid WHERE n_obs > 0) g USING (user_id, signal) GROUP BY 1", "score"))
def derived_arms(spark, d):
    """A derived arm and its row sums."""
    part = B.feature_grid(spark, d).filter("n_obs > 0").select("user_id", "signal", (F.col("k_high") / F.col("n_obs")).alias("l"))
    return B.rounded(E.scores(E.derived_arm(B.evidence(spark, d), part, "user_id", "cond"), "user_id"))


@query("evidence_correlations", B.sql(B.EVIDENCE, "SELECT x.signal AS a, y.signal AS b, count(*) AS n, corr(x.l, y.l) AS r FROM evidence x JOIN evidence y USING (user_id) WHERE x.signal < y.signal GROUP BY ALL HAVING corr(x.l, y.l) IS NOT NULL", "r"))
def evidence_correlations(spark, d):
    """Pairwise-complete correlations."""
    return B.rounded(E.correlations(B.evidence(spark, d), "user_id"))


@query("evidence_spectrum")
def evidence_spectrum(spark, d):
    """Spectra of two matrix variants in one job."""
    ev = B.evidence(spark, d)
    g = E.evidence_grid(B.people(spark, d), B.ranges(spark).select("signal"), ev, "user_id")
    both = E.correlations(ev, "user_id").withColumn("variant", F.lit("pairwise")).unionByName(E.correlations(g, "user_id").withColumn("variant", F.lit("filled")))
    return B.rounded(E.spectrum(both, ["variant"]))


@query("within_class_covariance", B.sql(B.EVIDENCE, "SELECT a, b, sum((n - 1) * c) / sum(n - 1) AS covariance FROM (SELECT x.signal AS a, z.signal AS b, y, count(*) AS n, covar_samp(x.l, z.l) AS c FROM evidence x JOIN evidence z USING (user_id) JOIN people USING (user_id) WHERE x.signal <= z.signal GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL", "covariance"))
def within_class_covariance(spark, d):
    """E11."""
    return B.rounded(E.within_class(B.evidence(spark, d).join(B.people(spark, d).select("user_id", "y"), "user_id"), "user_id"))


@query("pattern_table", B.sql(B.EVIDENCE, "SELECT pattern, count(*) AS n FROM (SELECT user_id, string_agg(signal, ',' ORDER BY signal) AS pattern FROM evidence GROUP BY 1) GROUP BY 1"))
def pattern_table(spark, d):
    """Missingness patterns."""
    return E.patterns(B.evidence(spark, d).withColumn("measured", F.lit(1)), "user_id")


@query("pattern_weights")
def pattern_weights(spark, d):
    """Gaussian weights per pattern."""
    ev = B.evidence(spark, d).join(B.people(spark, d).select("user_id", "y"), "user_id")
    diff = ev.groupBy("signal").agg((F.avg(F.when(F.col("y") == 1, F.col("l"))) - F.avg(F.when(F.col("y") == 0, F.col("l")))).alias("d"))
    return B.rounded(E.pattern_weights(E.patterns(ev.withColumn("measured", F.lit(1)), "user_id"), E.within_class(ev, "user_id"), diff))


def _wide(spark, d):
    w = learners.wide_design(B.evidence(spark, d), "user_id", "signal", "l", B.SIGNALS).fillna(0.0)
    return w.join(B.people(spark, d).select("user_id", "y", "fold"), "user_id")


@query("evidence_stack")
def evidence_stack(spark, d):
    """Logistic stacks, free and non-negative."""
    w = _wide(spark, d)
    a, b = (E.stacked(w, B.SIGNALS, "y", nn)[0].withColumn("kind", F.lit(k)) for nn, k in ((False, "free"), (True, "non_negative")))
    return B.rounded(a.unionByName(b))


WIDE = ", ".join(f"max(l) FILTER (signal = '{s}') AS {s}" for s in B.SIGNALS)


@query("wide_design", B.sql(B.EVIDENCE, f"SELECT user_id, {WIDE}, NULL::DOUBLE AS absent FROM evidence GROUP BY 1", " ".join(B.SIGNALS)))
def wide_design(spark, d):
    """Wide design in a declared column order."""
    return B.rounded(learners.aligned(learners.wide_design(B.evidence(spark, d), "user_id", "signal", "l", B.SIGNALS), ["user_id", *B.SIGNALS, "absent"]))


@query("boosted_scores")
def boosted_scores(spark, d):
    """Scores of one boosted fit, in sample but for the rows held out for early stopping."""
    w = learners.median_filled(learners.wide_design(B.evidence(spark, d), "user_id", "signal", "l", B.SIGNALS), B.SIGNALS)
    w = w.join(B.people(spark, d).select("user_id", "y", "fold"), "user_id").withColumn("held", F.col("fold") == 1)
    return B.rounded(learners.boosted(w, [c for c in w.columns if c.split("_")[0] in B.SIGNALS], "user_id", "y", "held")[0])


@query("boosted_importances")
def boosted_importances(spark, d):
    """Gain by feature and group."""
    w = _wide(spark, d).withColumn("held", F.col("fold") == 1)
    names = [f"{s}__l" for s in B.SIGNALS]
    w = w.select("user_id", "y", "held", *[F.col(s).alias(n) for s, n in zip(B.SIGNALS, names)])
    return B.rounded(learners.importances(learners.boosted(w, names, "user_id", "y", "held")[1], names, spark))


@query("frozen_scores", B.sql(B.GRID, f"SELECT user_id, signal, CASE WHEN n_obs > 0 THEN w_0 + w_low * k_low / n_obs + w_high * k_high / n_obs ELSE 0 END AS l FROM grid JOIN (VALUES {B._values(PRIORS)}) p(signal, w_0, w_low, w_high) USING (signal)", "l"))
def frozen_scores(spark, d):
    """Stored parameters applied, unmeasured 0."""
    return B.rounded(transport.apply_scores(B.feature_grid(spark, d), S.spec_table(spark, PRIORS, "signal string, w_0 double, w_low double, w_high double"), "user_id"))
