"""Queries: score metrics, inference and transport (M, T, K)."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reports as K
from ..operators import resampling, transport
from . import base as B
from .feature_queries import poisson_sql
from .registry import query


def auc_sql(source: str, keys: str, w: str = "1") -> str:
    """AUROC, AUPRC and lift by plain windows over distinct scores."""
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}(max(P) + max(N))::BIGINT AS n, max(P)::BIGINT AS events, max(P) / (max(P) + max(N)) AS rate,
  CASE WHEN max(P) * max(N) > 0 THEN sum(pos * (bn + neg / 2)) / (max(P) * max(N)) END AS auroc,
  CASE WHEN max(P) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * (P - bp) / (P - bp + N - bn) ELSE 0 END) / max(P) END AS auprc
FROM (SELECT *, coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS bp, coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS bn,
    (sum(pos) OVER ({part}))::DOUBLE AS P, (sum(neg) OVER ({part}))::DOUBLE AS N
  FROM (SELECT {k}score, sum({w} * y)::DOUBLE AS pos, sum({w} * (1 - y))::DOUBLE AS neg FROM {source} GROUP BY {k}score) WINDOW w AS ({part} ORDER BY score)) {by}"""


def lifted(inner: str) -> str:
    return f"SELECT *, auprc / nullif(rate, 0) AS lift FROM ({inner})"


@query("discrimination", B.sql(B.DOCS, lifted(auc_sql("ds", "grp")), "rate auroc auprc lift"))
def discrimination(spark, d):
    """Per group."""
    return B.rounded(M.discrimination(B.doc_scores(spark, d), ["grp"]))


@query("discrimination_all", B.sql(B.DOCS, lifted(auc_sql("(SELECT 'score' AS arm, score, y FROM ds UNION ALL SELECT 'score2', score2, y FROM ds)", "arm")), "rate auroc auprc lift"))
def discrimination_all(spark, d):
    """Arms through one path."""
    return B.rounded(M.discrimination(_arms(spark, d), ["arm"]))


def _arms(spark, d):
    x = B.doc_scores(spark, d)
    return x.select("doc_id", F.lit("score").alias("arm"), "score", "y").unionByName(x.select("doc_id", F.lit("score2").alias("arm"), F.col("score2").alias("score"), "y"))


@query("signal_discrimination", B.sql(B.EVIDENCE, lifted(auc_sql("(SELECT signal, l AS score, y FROM evidence JOIN people USING (user_id))", "signal")), "rate auroc auprc lift"))
def signal_discrimination(spark, d):
    """Per-signal discrimination."""
    return B.rounded(M.discrimination(B.evidence(spark, d).withColumnRenamed("l", "score").join(B.people(spark, d).select("user_id", "y"), "user_id"), ["signal"]))


BOOT = B.DOCS + f""",
bw AS (SELECT doc_id, b, {poisson_sql("u")} AS w FROM (SELECT doc_id, b, {B.UNIFORM.format("concat_ws('|', 6, b, doc_id)")} AS u FROM ds, range(1, 21) r(b))),
arms AS (SELECT doc_id, 'score' AS arm, score, y FROM ds UNION ALL SELECT doc_id, 'score2', score2, y FROM ds),
full_ AS ({auc_sql("arms", "arm")}),
drawn AS ({auc_sql("(SELECT arm, b, score, y, w FROM arms JOIN bw USING (doc_id) WHERE w > 0)", "arm, b", "w")})"""


@query("bootstrap_intervals", B.sql(BOOT, "SELECT f.*, auprc / nullif(rate, 0) AS lift, low, high, draws FROM full_ f LEFT JOIN (SELECT arm, quantile_cont(auroc, 0.025) AS low, quantile_cont(auroc, 0.975) AS high, count(*) AS draws FROM drawn WHERE auroc IS NOT NULL GROUP BY 1) USING (arm)", "rate auroc auprc lift low high"))
def bootstrap_intervals(spark, d):
    """Cluster-bootstrap intervals."""
    x = B.doc_scores(spark, d)
    return B.rounded(M.with_intervals(_arms(spark, d), ["arm"], "doc_id", resampling.bootstrap_units(x, "doc_id", 20, 6)))


@query("paired_bootstrap", B.sql(BOOT, "SELECT o AS difference, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, (count_if(abs(d - o) >= abs(o)) + 1) / (count(*) + 1) AS p FROM (SELECT x.auroc - y.auroc AS d FROM drawn x JOIN drawn y USING (b) WHERE x.arm = 'score' AND y.arm = 'score2'), (SELECT x.auroc - y.auroc AS o FROM full_ x, full_ y WHERE x.arm = 'score' AND y.arm = 'score2') GROUP BY o", "difference low high p"))
def paired_bootstrap(spark, d):
    """M9: paired difference under shared weights."""
    return B.rounded(M.paired_bootstrap(_arms(spark, d), "arm", "score", "score2", "doc_id", resampling.bootstrap_units(B.doc_scores(spark, d), "doc_id", 20, 6)))


DELONG = B.DOCS + """,
pl AS (SELECT a.doc_id, a.y, avg(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0 END) AS p1, avg(CASE WHEN b.score2 < a.score2 THEN 1.0 WHEN b.score2 = a.score2 THEN 0.5 ELSE 0 END) AS p2 FROM ds a JOIN ds b ON a.y <> b.y GROUP BY ALL),
st AS (SELECT y, count(*) AS n, avg(CASE WHEN y = 1 THEN p1 ELSE 1 - p1 END) AS m1, avg(CASE WHEN y = 1 THEN p2 ELSE 1 - p2 END) AS m2, var_samp(p1 - p2) AS v FROM pl GROUP BY 1)"""


@query("delong", B.sql(DELONG, "SELECT *, difference / se AS z FROM (SELECT max(m1) FILTER (y = 1) AS auc_a, max(m2) FILTER (y = 1) AS auc_b, max(m1) FILTER (y = 1) - max(m2) FILTER (y = 1) AS difference, sqrt(sum(v / n)) AS se FROM st)", "auc_a auc_b difference se z"))
def delong(spark, d):
    """M4: paired test from placement values (the SQL compares all pairs; the job does not)."""
    return B.rounded(M.delong(B.doc_scores(spark, d), "doc_id", "score", "score2"))


CUTS = B.DOCS + """,
ct AS (SELECT list_distinct(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM ds),
bn AS (SELECT len(list_filter(cuts, lambda c: c < score)) + 1 AS bin, y, score FROM ds, ct),
g AS (SELECT bin::BIGINT AS bin, count(*) AS n, sum(y)::BIGINT AS events, avg(score) AS mean_score, min(score) AS least, max(score) AS largest, avg(y) AS rate FROM bn GROUP BY 1),
bins AS (SELECT *, (rate + k / (2 * n)) / (1 + k / n) - z * sqrt(rate * (1 - rate) / n + k / (4 * n * n)) / (1 + k / n) AS low, (rate + k / (2 * n)) / (1 + k / n) + z * sqrt(rate * (1 - rate) / n + k / (4 * n * n)) / (1 + k / n) AS high
  FROM g, (SELECT 1.959963984540054 AS z, 1.959963984540054 * 1.959963984540054 AS k)),
b2 AS (SELECT * EXCLUDE (z, k) FROM (SELECT bins.*, 0 AS z, 0 AS k FROM (SELECT bin, n, events, mean_score, least, largest, rate, low, high FROM bins) bins))"""


def _bins(spark, d):
    x = B.doc_scores(spark, d)
    return M.risk_bins(x, M.cut_points(x, 10, strict=False))


@query("risk_bins", B.sql(CUTS, "SELECT bin, n, events, mean_score, least, largest, rate, low, high FROM bins", "mean_score least largest rate low high"))
def risk_bins(spark, d):
    """Own cut-points, Wilson intervals."""
    return B.rounded(_bins(spark, d))


@query("monotonicity", B.sql(CUTS, "SELECT count(*) AS bins, count_if(rate < pr) AS inversions, count_if(high < pl) AS significant, corr(bin, rk) AS spearman, arg_max(rate, bin) / nullif(arg_min(rate, bin), 0) AS rate_ratio FROM (SELECT *, lag(rate) OVER (ORDER BY bin) AS pr, lag(low) OVER (ORDER BY bin) AS pl, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2 AS rk FROM bins)", "spearman rate_ratio"))
def monotonicity(spark, d):
    """M6."""
    return B.rounded(M.monotonicity(_bins(spark, d)))


@query("calibration")
def calibration(spark, d):
    """M7: slope and intercept by site."""
    return B.rounded(M.calibration(B.scores(spark, d), ["site"]))


WITHIN = f"SELECT *, (n >= 15 AND events >= 10 AND events < n)::BIGINT AS eligible FROM ({lifted(auc_sql('ds', 'grp'))})"


@query("within_groups", B.sql(B.DOCS, WITHIN, "rate auroc auprc lift"))
def within_groups(spark, d):
    """Eligibility floors."""
    return B.rounded(M.within_groups(B.doc_scores(spark, d), "grp", 15, 10))


@query("over_groups", B.sql(B.DOCS, f"SELECT count(*) AS groups, quantile_cont(auroc, 0.25) AS q25, quantile_cont(auroc, 0.5) AS q50, quantile_cont(auroc, 0.75) AS q75 FROM ({WITHIN}) WHERE eligible = 1", "q25 q50 q75"))
def over_groups(spark, d):
    """Distribution over groups."""
    return B.rounded(M.over_groups(M.within_groups(B.doc_scores(spark, d), "grp", 15, 10), "auroc"))


@query("top_precision", B.sql(B.DOCS, "SELECT lang, max(k)::BIGINT AS k, avg(y) AS precision FROM (SELECT *, ceil(count(*) OVER (PARTITION BY lang) * 0.1) AS k, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rn FROM ds) WHERE rn <= k GROUP BY 1", "precision"))
def top_precision(spark, d):
    """M14."""
    return B.rounded(M.top_precision(B.doc_scores(spark, d), ["lang"], "doc_id", 0.1))


STRATA = B.sql(B.EVIDENCE, lifted(auc_sql("(SELECT CASE WHEN k > 2 THEN 'many' WHEN k > 0 THEN 'few' ELSE 'none' END AS stratum, score, y FROM scores JOIN (SELECT user_id, count_if(k_high > 0) AS k FROM grid GROUP BY 1) USING (user_id))", "stratum")), "rate auroc auprc lift")


@query("burden_strata", STRATA)
def burden_strata(spark, d):
    """Metrics within strata of how many signals are high."""
    k = B.feature_grid(spark, d).groupBy("user_id").agg(F.count_if(F.col("k_high") > 0).alias("k"))
    s = B.scores(spark, d).join(k, "user_id").withColumn("stratum", F.when(F.col("k") > 2, "many").when(F.col("k") > 0, "few").otherwise("none"))
    return B.rounded(M.discrimination(s, ["stratum"]))


SITES = B.EVIDENCE + f""",
arms AS (SELECT user_id, signal AS arm, l AS score, y, site FROM evidence JOIN people USING (user_id) UNION ALL SELECT user_id, 'sum', score, y, site FROM scores),
ss AS ({auc_sql("(SELECT * FROM arms WHERE site = 'odd')", "arm")}), tt AS ({auc_sql("(SELECT * FROM arms WHERE site = 'even')", "arm")})"""


@query("transport_table", B.sql(SITES, "SELECT arm, s.auroc AS site_auroc, s.auprc AS site_auprc, t.auroc AS train_auroc, t.auprc AS train_auprc, s.auroc - t.auroc AS difference, s.auprc / nullif(t.auprc, 0) AS ratio, CASE WHEN abs(t.auroc - 0.5) > 0.01 THEN (s.auroc - 0.5) / (t.auroc - 0.5) END AS retained FROM ss s JOIN tt t USING (arm)", "site_auroc site_auprc train_auroc train_auprc difference ratio retained"))
def transport_table(spark, d):
    """Site against training by arm."""
    p = B.people(spark, d).select("user_id", "y", "site")
    arms = B.evidence(spark, d).select("user_id", F.col("signal").alias("arm"), F.col("l").alias("score")).unionByName(B.scores(spark, d).select("user_id", F.lit("sum").alias("arm"), "score")).join(p, "user_id")
    side = lambda s: M.discrimination(arms.filter(F.col("site") == s), ["arm"])
    return B.rounded(transport.transport_table(side("odd"), side("even"), "arm"))


@query("available_contrasts", B.sql(B.EVIDENCE, "SELECT a, b FROM (VALUES ('click', 'view'), ('click', 'absent'), ('error', 'signup')) c(a, b) WHERE a IN (SELECT signal FROM evidence) AND b IN (SELECT signal FROM evidence)"))
def available_contrasts(spark, d):
    """T5."""
    pairs = spark.createDataFrame([("click", "view"), ("click", "absent"), ("error", "signup")], "a string, b string")
    return transport.available_contrasts(pairs, B.evidence(spark, d).select(F.col("signal").alias("arm")).distinct()).select("a", "b")


FROZEN = B.EVIDENCE + """,
ct AS (SELECT list_distinct(quantile_cont(score, [0.25, 0.5, 0.75])) AS cuts FROM scores WHERE site = 'even'),
rf AS (SELECT len(list_filter(cuts, lambda c: c < score)) + 1 AS bin, avg(y) AS reference_rate FROM scores, ct WHERE site = 'even' GROUP BY 1)"""


@query("reference_stratum", B.sql(FROZEN, "SELECT user_id, site, s.bin::BIGINT AS bin, reference_rate FROM (SELECT user_id, site, len(list_filter(cuts, lambda c: c < score)) + 1 AS bin FROM scores, ct) s LEFT JOIN rf USING (bin)", "reference_rate"))
def reference_stratum(spark, d):
    """One site's frozen cut-points and reference bins applied to every row of both."""
    s = B.scores(spark, d)
    train = s.filter("site = 'even'")
    cuts = M.cut_points(train, 4, strict=False)
    return B.rounded(transport.reference_stratum(s, cuts, M.risk_bins(train, cuts)).select("user_id", "site", "bin", "reference_rate"))


@query("merged_bins", B.sql(CUTS, "SELECT (floor((bin - 1) / 2) + 1)::BIGINT AS stratum, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events, sum(events) / sum(n) AS rate FROM bins GROUP BY 1", "rate"))
def merged_bins(spark, d):
    """Bins merged into wider strata."""
    return B.rounded(transport.merged_bins(_bins(spark, d), 2))


@query("percentile_against", B.sql(B.EVIDENCE, "SELECT s.user_id, s.site, avg((r.score <= s.score)::INT) AS percentile FROM scores s, (SELECT score FROM scores WHERE site = 'even') r GROUP BY ALL", "percentile"))
def percentile_against(spark, d):
    """K2: percentile of every row against one site's distribution."""
    s = B.scores(spark, d)
    return B.rounded(K.percentile_against(s.select("user_id", "site", "score"), s.filter("site = 'even'").select("score"), "score").select("user_id", "site", "percentile"))


@query("profiles", B.sql(B.EVIDENCE, f"SELECT fold::BIGINT AS fold, user_id, round(score, 6) + 0.0 AS score FROM scores QUALIFY row_number() OVER (PARTITION BY fold ORDER BY {B.UNIFORM.format(chr(39).join(['concat_ws(', '|', ', 8, user_id)']))}, user_id) = 1"))
def profiles(spark, d):
    """K3: one profile per band."""
    return B.rounded(K.profiles(B.scores(spark, d).select("fold", "user_id", "score"), "fold", "user_id", 8))


@query("redundancy", B.sql(B.GRID, "SELECT signal, count(*) AS n, avg((value_median = within_mean)::INT) AS equal, corr(value_median, within_mean) AS correlation FROM grid WHERE n_obs > 0 GROUP BY 1", "equal correlation"))
def redundancy(spark, d):
    """K6."""
    return B.rounded(K.redundancy(B.feature_grid(spark, d).filter("n_obs > 0"), "signal", "value_median", "within_mean"))
