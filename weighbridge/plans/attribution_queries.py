"""Queries: attribution comparison (D)."""

from pyspark.sql import functions as F

from ..functions.scalars import mean_above, percentiles
from ..operators import attribution as A
from ..operators import resampling
from ..sources import tables as S
from . import base as B
from .registry import query

V = B.VECTORS
DOMAIN_ROWS = [(f"s{i:02d}", f"d{i % 4}") for i in range(32)]
VD = V + f", doms(signal, domain) AS (VALUES {B._values(DOMAIN_ROWS)})"


def _cells(spark, d):
    a, b = B.vectors(spark, d)
    return A.paired(a.select("vec_id", "signal", "ord", "a"), b, "vec_id")


def _domains(spark):
    return spark.createDataFrame(DOMAIN_ROWS, "signal string, domain string")


MID = lambda v, part: f"rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2"


@query("attribution_set", B.sql(V, "SELECT method, count(*) AS n, sum(a) AS total FROM (SELECT 'a' AS method, a FROM va UNION ALL SELECT 'b', b FROM vb) GROUP BY 1", "total"))
def attribution_set(spark, d):
    """Methods in one long table."""
    a, b = B.vectors(spark, d)
    return B.rounded(A.attribution_set({"a": a, "b": b}, "vec_id").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("total")))


@query("cell_agreement", B.sql(V, f"SELECT signal, count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman, avg((sign(a) = sign(b))::INT) FILTER (greatest(abs(a), abs(b)) > 0.1) AS same_sign FROM (SELECT *, {MID('a', 'signal')} AS ra, {MID('b', 'signal')} AS rb FROM cells) GROUP BY 1", "pearson spearman same_sign"))
def cell_agreement(spark, d):
    """Agreement per signal."""
    return B.rounded(A.cell_agreement(_cells(spark, d), ["signal"], 0.1))


@query("rank_agreement", B.sql(V, f"SELECT vec_id, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT *, {MID('abs(a)', 'vec_id')} AS ra, {MID('abs(b)', 'vec_id')} AS rb FROM cells) GROUP BY 1", "rho"))
def rank_agreement(spark, d):
    """Within-key rank agreement."""
    return B.rounded(A.rank_agreement(_cells(spark, d), "vec_id"))


SPREAD = "SELECT count(x) AS n, min(x) AS least, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM "


@query("cosine_spread", B.sql(V, SPREAD + "(SELECT 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS x FROM cells GROUP BY vec_id)", "least q05 q25 q50 q75 q95 mean sd iqr"))
def cosine_spread(spark, d):
    """Cosine dissimilarity and its distribution (skew left out of the compared columns)."""
    gaps = S.scan_once(A.cosine_gap(_cells(spark, d), "vec_id"), B.out(spark, "gaps"))
    return B.rounded(A.spread(gaps, [], "cosine_gap").drop("skew"))


CONTRIB = """SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'click__x' WHEN 'N' THEN 'view__y' ELSE 'other__z' END AS feature, l_discount - 0.05 AS v FROM lineitem"""
PAIRING = [("click", "click"), ("view", "view"), ("view", "error")]


@query("rolled_contributions", f"SELECT l_orderkey, signal, round(sum(v / k), 6) + 0.0 AS a FROM ({CONTRIB}) JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM (VALUES {B._values(PAIRING)}) p(name, signal)) ON split_part(feature, '__', 1) = name GROUP BY ALL")
def rolled_contributions(spark, d):
    """Contributions to signals, an intervention's split over its signals."""
    return B.rounded(A.rolled_contributions(_contributions(spark, d), spark.createDataFrame(PAIRING, "name string, signal string"), "l_orderkey")[0])


def _contributions(spark, d):
    l = B.scan(spark, d, "lineitem")
    f = F.when(F.col("l_returnflag") == "A", "click__x").when(F.col("l_returnflag") == "N", "view__y").otherwise("other__z")
    return l.select("l_orderkey", f.alias("feature"), (F.col("l_discount") - 0.05).alias("v"))


@query("dropped_share", f"SELECT round(sum(CASE WHEN feature = 'other__z' THEN abs(v) ELSE 0 END) / sum(abs(v)), 6) + 0.0 AS dropped_share FROM ({CONTRIB})")
def dropped_share(spark, d):
    """Share of contributions without a signal."""
    return B.rounded(A.rolled_contributions(_contributions(spark, d), spark.createDataFrame(PAIRING, "name string, signal string"), "l_orderkey")[1])


@query("domain_share", B.sql(VD, "SELECT label AS bin, domain, v, v / sum(v) OVER (PARTITION BY label) AS share FROM (SELECT label::BIGINT AS label, domain, sum(greatest(a, 0)) AS v FROM va JOIN doms USING (signal) GROUP BY ALL)", "v share"))
def domain_share(spark, d):
    """Domain share of positive evidence by bin."""
    a, _ = B.vectors(spark, d)
    return B.rounded(A.domain_share(a.select("vec_id", "signal", "a"), _domains(spark), a.select("vec_id", F.col("label").alias("bin")).distinct(), "vec_id"))


CURVE = V + """, cc AS (SELECT signal, [quantile_cont(a, 0.25), quantile_cont(a, 0.5), quantile_cont(a, 0.75)] AS cuts FROM cells GROUP BY 1),
cv AS (SELECT signal, bin, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b FROM (SELECT c.*, len(list_filter(cuts, lambda z: z < a)) + 1 AS bin FROM cells c JOIN cc USING (signal)) GROUP BY ALL)"""


def _curve(spark, d):
    c = _cells(spark, d).withColumn("x", F.col("a"))
    return A.evidence_curve(c, percentiles(c, ["signal"], "x", [0.25, 0.5, 0.75], "cuts"))


@query("evidence_curve", B.sql(CURVE, "SELECT signal, bin::BIGINT AS bin, n, mean_a, mean_b FROM cv", "mean_a mean_b"))
def evidence_curve(spark, d):
    """Mean attribution in covariate bins."""
    return B.rounded(_curve(spark, d))


@query("curve_agreement", B.sql(CURVE, "SELECT signal, sum(n * (mean_a - ma) * (mean_b - mb)) / sqrt(sum(n * (mean_a - ma) ** 2) * sum(n * (mean_b - mb) ** 2)) AS correlation, sqrt(sum(n * (mean_a - mean_b) ** 2) / sum(n * mean_a ** 2)) AS distance FROM (SELECT *, sum(n * mean_a) OVER (PARTITION BY signal) / sum(n) OVER (PARTITION BY signal) AS ma, sum(n * mean_b) OVER (PARTITION BY signal) / sum(n) OVER (PARTITION BY signal) AS mb FROM cv) GROUP BY 1", "correlation distance"))
def curve_agreement(spark, d):
    """Agreement of two curves."""
    return B.rounded(A.curve_agreement(_curve(spark, d)))


def top_sql(k: int, v: str) -> str:
    return f"""SELECT vec_id, bit_or(CASE WHEN rn <= {k} THEN 1::BIGINT << ord ELSE 0 END) AS top, bit_or(CASE WHEN rk = kth THEN 1::BIGINT << ord ELSE 0 END) AS tied
FROM (SELECT *, max(CASE WHEN rn <= {k} THEN rk END) OVER (PARTITION BY vec_id) AS kth FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs({v}) DESC, ord) AS rn, rank() OVER (PARTITION BY vec_id ORDER BY abs({v}) DESC) AS rk FROM cells)) GROUP BY 1"""


@query("top_k", B.sql(V, top_sql(3, "a")))
def top_k(spark, d):
    """Top-k and tie masks."""
    return A.top_k(_cells(spark, d), ["vec_id"], 3)


@query("top_k_disagreement", B.sql(V + f", ta AS ({top_sql(3, 'a')}), tb AS ({top_sql(3, 'b')})",
    "SELECT vec_id, ((b.top & ~(a.top | a.tied)) <> 0 OR (a.top & ~(b.top | b.tied)) <> 0)::BIGINT AS disagrees FROM ta a JOIN tb b USING (vec_id)"))
def top_k_disagreement(spark, d):
    """Tie-aware disagreement."""
    c = _cells(spark, d)
    return B.rounded(A.top_k_disagrees(A.top_k(c, ["vec_id"], 3), A.top_k(c.withColumn("a", F.col("b")), ["vec_id"], 3), ["vec_id"]))


TOL = """SELECT delta, avg((kth - worst > delta)::INT) AS share FROM (SELECT vec_id, min(abs(a)) FILTER (ra <= 3) AS kth, min(abs(a)) FILTER (rb <= 3) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(a) DESC, ord) AS ra, row_number() OVER (PARTITION BY vec_id ORDER BY abs(b) DESC, ord) AS rb FROM cells) GROUP BY 1), (VALUES (0.0::DOUBLE), (0.05), (0.5)) t(delta) GROUP BY 1"""


@query("tolerant_disagreement", B.sql(V, TOL, "delta share"))
def tolerant_disagreement(spark, d):
    """Disagreement over a grid of tolerances."""
    return B.rounded(A.tolerant_disagreement(_cells(spark, d), "vec_id", 3, [0.0, 0.05, 0.5]))


@query("sign_flips", B.sql(V, "SELECT signal, tau, avg((a * b < 0 AND greatest(abs(a), abs(b)) > tau)::INT) AS flipped FROM cells, (VALUES (0.0::DOUBLE), (0.1), (0.2)) t(tau) GROUP BY ALL", "tau flipped"))
def sign_flips(spark, d):
    """D13."""
    return B.rounded(A.sign_flips(_cells(spark, d), ["signal"], [0.0, 0.1, 0.2]))


@query("tie_sets", B.sql(V, "SELECT vec_id, count(*) AS tied FROM (SELECT *, max(abs(a)) OVER (PARTITION BY vec_id) AS lead FROM cells) WHERE abs(a) >= lead - 0.05 GROUP BY 1"))
def tie_sets(spark, d):
    """D14."""
    return A.tie_sets(_cells(spark, d), "vec_id", 0.05)


@query("evidence_budget", B.sql(V, "SELECT vec_id, sum(abs(a)) AS budget, sum(a * a) / sum(abs(a)) ** 2 AS herfindahl, max(abs(a)) / sum(abs(a)) AS top_share FROM cells GROUP BY 1", "budget herfindahl top_share"))
def evidence_budget(spark, d):
    """D16."""
    return B.rounded(A.budget(_cells(spark, d), "vec_id"))


@query("displacements", B.sql(V, "SELECT signal, count(*) AS n, quantile_cont(abs(a - b), 0.5) AS delta, quantile_cont(abs(a - b), 0.9) AS q90, max(abs(a - b)) AS largest FROM cells GROUP BY 1", "delta q90 largest"))
def displacements(spark, d):
    """Noise-calibrated tolerance."""
    return B.rounded(A.displacements(_cells(spark, d), ["signal"]))


LEAD = V + """, ld AS (SELECT vec_id, signal AS leader, a AS value_a, b AS value_b, pos_b, n FROM (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, ord) AS rn, sum(greatest(b, 0)) OVER (PARTITION BY vec_id) AS pos_b FROM cells) WHERE rn = 1),
led AS (SELECT l.*, (SELECT count(*) FROM cells c WHERE c.vec_id = l.vec_id AND c.b > l.value_b) AS above, (SELECT count(*) FROM cells c WHERE c.vec_id = l.vec_id AND c.b > l.value_b) / (n - 1) AS displacement, value_b / nullif(pos_b, 0) AS share_b FROM ld l)"""


@query("leaders", B.sql(LEAD, "SELECT vec_id, leader, value_a, value_b, pos_b, n, above, displacement, share_b FROM led", "value_a value_b pos_b displacement share_b"))
def leaders(spark, d):
    """The leader and where the other side puts it."""
    return B.rounded(A.leaders(_cells(spark, d), "vec_id"))


@query("leader_collapse", B.sql(LEAD, "SELECT threshold, count(*) AS n, avg((share_b < threshold)::INT) AS collapsed, avg((displacement > 2 / 3)::INT) AS bottom_third, quantile_cont(displacement, 0.5) AS median_displacement FROM led, (VALUES (0.0::DOUBLE), (0.05)) t(threshold) GROUP BY 1", "threshold collapsed bottom_third median_displacement"))
def leader_collapse(spark, d):
    """D19, D31."""
    return B.rounded(A.leader_collapse(A.leaders(_cells(spark, d), "vec_id"), [0.0, 0.05]))


DOM = V + """, m AS (SELECT signal, 'share_a' AS metric, 1 - abs(a) AS value FROM cells UNION ALL SELECT signal, 'b', abs(b) FROM cells), r AS (SELECT *, rank() OVER (PARTITION BY signal ORDER BY value) + (count(*) OVER (PARTITION BY signal, value) - 1) / 2 AS rk FROM m)"""


@query("dominance", B.sql(DOM, "SELECT signal, count_if(metric = 'share_a') AS nx, count_if(metric = 'b') AS ny, (sum(rk) FILTER (metric = 'share_a') - count_if(metric = 'share_a') * (count_if(metric = 'share_a') + 1) / 2) / (count_if(metric = 'share_a') * count_if(metric = 'b')) AS dominance, quantile_cont(value, 0.5) FILTER (metric = 'share_a') - quantile_cont(value, 0.5) FILTER (metric = 'b') AS median_gap, quantile_cont(value, 0.95) FILTER (metric = 'share_a') - quantile_cont(value, 0.95) FILTER (metric = 'b') AS q95_gap FROM r GROUP BY 1", "dominance median_gap q95_gap"))
def dominance(spark, d):
    """Oriented metrics, dominance by ranks."""
    c = _cells(spark, d)
    m = c.select("signal", F.lit("share_a").alias("metric"), F.abs("a").alias("value")).unionByName(c.select("signal", F.lit("b").alias("metric"), F.abs("b").alias("value")))
    m = S.scan_once(A.oriented(m), B.out(spark, "sides"))
    return B.rounded(A.dominance(m, ["signal"], "metric", "value", "share_a", "b"))


BAGVAL = """x AS (SELECT l_linenumber AS bag_a, (l_linenumber * 3) % 7 + 1 AS bag_b, avg(l_discount) AS value, avg(l_tax) AS value2 FROM lineitem WHERE l_linenumber < (l_linenumber * 3) % 7 + 1 GROUP BY ALL)"""


@query("paired_over_bags", B.sql(BAGVAL, "SELECT least(bag_a, bag_b)::BIGINT AS lo, greatest(bag_a, bag_b)::BIGINT AS hi, value AS x, value2 AS y, value - value2 AS difference FROM x", "x y difference"))
def paired_over_bags(spark, d):
    """Paired difference over shared bag pairs."""
    l = B.scan(spark, d, "lineitem").select(F.col("l_linenumber").alias("bag_a"), ((F.col("l_linenumber") * 3) % 7 + 1).alias("bag_b"), "l_discount", "l_tax").filter("bag_a < bag_b")
    g = l.groupBy("bag_a", "bag_b").agg(F.avg("l_discount").alias("v1"), F.avg("l_tax").alias("v2"))
    return B.rounded(A.paired_over_bags(g.select("bag_a", "bag_b", F.col("v1").alias("value")), g.select(F.col("bag_b").alias("bag_a"), F.col("bag_a").alias("bag_b"), F.col("v2").alias("value"))))


def _replicates(spark, d):
    """Replicates of the embedding attributions: method a/b, bags 0-2 scale every value by a portable factor."""
    a, b = B.vectors(spark, d)
    long = A.attribution_set({"a": a, "b": b}, "vec_id").withColumn("bag", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    factor = F.lit(1.0) + F.col("bag") * (F.col("vec_id") % 5 + F.col("ord") % 3 - 3) / 20.0
    return long.withColumn("a", F.col("a") * factor).withColumn("replicate", F.concat_ws("-", "method", "bag"))


REPS = V + """, reps AS (SELECT method, vec_id, signal, ord, bag::BIGINT AS bag, a * (1 + bag * (vec_id % 5 + ord % 3 - 3) / 20) AS a, method || '-' || bag AS replicate
FROM (SELECT 'a' AS method, vec_id, signal, ord, a FROM va UNION ALL SELECT 'b', vec_id, signal, ord, b FROM vb), range(3) r(bag))"""


def _manifest(spark, d):
    m = _replicates(spark, d).select("replicate", "method", "bag").distinct()
    return m.select(F.col("replicate").alias("id"), "method", F.lit("r").alias("route"), F.col("bag").alias("boot"), F.lit(1).alias("seed"), F.lit(0).alias("draw"))


PAIRSQL = REPS + """, mf AS (SELECT DISTINCT replicate AS id, method, bag FROM reps),
prs AS (SELECT a.id AS id_a, b.id AS id_b, CASE WHEN (a.method <> b.method)::INT + (a.bag <> b.bag)::INT <> 1 THEN 'refused' WHEN a.bag <> b.bag THEN 'L3' ELSE 'L4' END AS level FROM mf a JOIN mf b ON a.id < b.id)"""


@query("contrasts", B.sql(PAIRSQL, "SELECT * FROM prs"))
def contrasts(spark, d):
    """Replicate pairs by what differs; confounded ones refused."""
    return A.contrasts(_manifest(spark, d))


SHAPES = REPS + """,
shp AS (SELECT replicate, count(*) AS cells, count_if(a IS NULL OR isnan(a)) AS not_finite, list(vec_id || '|' || signal ORDER BY vec_id, signal) AS members FROM reps GROUP BY 1)"""


@query("shape_check", B.sql(SHAPES, "SELECT replicate, cells, not_finite, (members = (SELECT members FROM shp ORDER BY replicate LIMIT 1) AND not_finite = 0)::BIGINT AS ok FROM shp"))
def shape_check(spark, d):
    """D25."""
    return B.rounded(A.shape_check(_replicates(spark, d), "vec_id"))


SWEEP = PAIRSQL + """, mm AS (SELECT level, id_a, id_b, x.vec_id, 1 - sum(x.a * y.a) / sqrt(sum(x.a * x.a) * sum(y.a * y.a)) AS cosine_gap, quantile_cont(abs(x.a - y.a), 0.5) AS displacement, avg((x.a * y.a < 0)::INT) AS flips
FROM prs JOIN reps x ON x.replicate = id_a JOIN reps y ON y.replicate = id_b AND y.vec_id = x.vec_id AND y.signal = x.signal WHERE level <> 'refused' GROUP BY ALL)"""


@query("metric_sweep", B.sql(SWEEP, "SELECT level, metric, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95 FROM mm UNPIVOT (value FOR metric IN (cosine_gap, displacement, flips)) GROUP BY ALL", "mean q50 q95"))
def metric_sweep(spark, d):
    """Every metric of every allowed contrast in one keyed job."""
    pairs = A.contrasts(_manifest(spark, d)).filter("level <> 'refused'")
    values = S.scan_once(A.metric_values(_replicates(spark, d), pairs, "vec_id"), B.out(spark, "metric-values"))
    return B.rounded(A.metric_sweep(values))


@query("bands", B.sql(REPS, "SELECT vec_id, signal, avg(a) + 1e-7 AS mean, quantile_cont(a, 0.025) + 1e-7 AS low, quantile_cont(a, 0.975) + 1e-7 AS high, quantile_cont(a, 0.975) - quantile_cont(a, 0.025) + 1e-7 AS width FROM reps WHERE method = 'a' GROUP BY ALL", "mean low high width", 4))
def bands(spark, d):
    """Bands over replicates."""
    b = A.bands(_replicates(spark, d).filter("method = 'a'"), "vec_id")
    return B.rounded(b.select("vec_id", "signal", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mean", "low", "high", "width")]))


@query("verdicts", "SELECT l_suppkey, CASE WHEN d IS NULL THEN 'unscored' WHEN d = 0 THEN 'excluded' WHEN s + r + d = 3 THEN 'admissible' WHEN s + r + d = 2 THEN 'trade_off' ELSE 'excluded' END AS verdict FROM (SELECT l_suppkey, (avg(l_discount) > 0.05)::INT AS s, (avg(l_tax) > 0.04)::INT AS r, CASE WHEN l_suppkey % 7 <> 0 THEN (avg(l_quantity) > 25)::INT END AS d FROM lineitem GROUP BY 1)")
def verdicts(spark, d):
    """Selection rules."""
    g = B.scan(spark, d, "lineitem").groupBy("l_suppkey").agg(*[mean_above(c, cut).cast("int").alias(name) for name, c, cut in (("stability", "l_discount", "0.05"), ("resolution", "l_tax", "0.04"), ("q", "l_quantity", "25"))])
    return A.verdict(g.withColumn("discrimination", F.when(F.col("l_suppkey") % 7 != 0, F.col("q")))).select("l_suppkey", "verdict")


@query("posterior_draws")
def posterior_draws(spark, d):
    """Spread of linear predictors under coefficient draws."""
    w = B.feature_grid(spark, d).filter("n_obs > 0").select("user_id", F.col("k_low").cast("double").alias("x1"), F.col("k_high").cast("double").alias("x2"))
    e = A.draws(w, ["x1", "x2"], [0.1, -0.2], [[0.01, 0.0], [0.0, 0.02]], 20, 3, "user_id")
    return B.rounded(e.groupBy("user_id").agg(F.avg("eta").alias("mean"), F.stddev_samp("eta").alias("sd")))


@query("group_disagreement", B.sql(V, "SELECT label::BIGINT AS label, count(*) AS n, avg(g) AS mean, (count(*) >= 20)::BIGINT AS eligible FROM (SELECT vec_id, label, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS g FROM cells GROUP BY ALL) GROUP BY 1", "mean"))
def group_disagreement(spark, d):
    """A pairwise metric within groups."""
    groups = B.vectors(spark, d)[0].select("vec_id", "label").distinct()
    return B.rounded(A.by_group(A.cosine_gap(_cells(spark, d), "vec_id"), groups, "vec_id", "label", "cosine_gap", 20))


LENGTHS = """
s AS (SELECT grp, lang, y, count(*) AS n, sum(score) AS total FROM ds GROUP BY ALL),
t AS (SELECT grp, lang, x, y FROM (SELECT grp, lang, total / n AS x FROM s WHERE y = 0) FULL JOIN (SELECT grp, lang, total / n AS y FROM s WHERE y = 1) USING (grp, lang))"""


@query("transport_join", B.sql(B.DOCS + "," + LENGTHS, "SELECT 'mean' AS \"table\", grp, lang, x, y, y - x AS difference FROM t", "x y difference"))
def transport_join(spark, d):
    """Mean length by source and language of all labelled documents, those of low and of high quality as the two sites; one-sided rows kept."""
    s = B.doc_scores(spark, d)
    m = lambda y: s.filter(F.col("y") == y).groupBy("grp", "lang").agg(F.avg("score").alias("value"))
    return B.rounded(A.transport_join({"mean": (m(0), m(1))}, ["grp", "lang"]))


@query("margin_bins", B.sql(V, "SELECT (m1 - m2 > 0.05)::INT + (m1 - m2 > 0.1)::BIGINT AS margin_bin, count(*) AS n, avg((la = lb)::INT) AS agree, avg(m1 - m2) AS mean_margin FROM (SELECT vec_id, max(a) FILTER (ra = 1) AS m1, max(a) FILTER (ra = 2) AS m2, max(ord) FILTER (ra = 1) AS la, max(ord) FILTER (rb = 1) AS lb FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, ord) AS ra, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, ord) AS rb FROM cells) GROUP BY 1) GROUP BY 1", "agree mean_margin"))
def margin_bins(spark, d):
    """Agreement by the leader's margin."""
    return B.rounded(A.margin_bins(_cells(spark, d), "vec_id", [0.05, 0.1]))


@query("domain_vectors", B.sql(VD, "SELECT vec_id, domain, sum(a) AS a FROM va JOIN doms USING (signal) GROUP BY ALL", "a"))
def domain_vectors(spark, d):
    """D9."""
    return B.rounded(A.by_domain(B.vectors(spark, d)[0], _domains(spark), ["vec_id"]))


@query("common_bags", "SELECT l_linenumber::BIGINT AS bag, count(DISTINCT l_returnflag) AS methods, (count(DISTINCT l_returnflag) = 3)::BIGINT AS complete FROM lineitem GROUP BY 1")
def common_bags(spark, d):
    """D35."""
    l = B.scan(spark, d, "lineitem").select(F.col("l_linenumber").alias("bag"), F.col("l_returnflag").alias("method"))
    return B.rounded(A.common_bags(l, 3))


BAGSQL = f"""bg AS (SELECT c_custkey, bag FROM customer, range(1, 5) r(bag) WHERE {B.UNIFORM.format("concat_ws('|', 9, 'bag', bag, c_custkey)")} < 0.6321205588285577)"""


@query("bag_membership", B.sql(BAGSQL, "SELECT bag, count(*) AS size, count(*) / 1000 AS fraction, sum(('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::UBIGINT)::BIGINT AS member_hash FROM bg GROUP BY 1", "fraction"))
def bag_membership(spark, d):
    """Size, fraction and membership hash."""
    return B.rounded(A.membership(resampling.bags(B.scan(spark, d, "customer"), "c_custkey", 4, 9), "c_custkey", 1000))


@query("excluded_bags", B.sql(BAGSQL, "SELECT bag, count(*) AS kept FROM bg WHERE bag <> 2 GROUP BY 1"))
def excluded_bags(spark, d):
    """A failed bag goes for every method; a stale exclusion does nothing."""
    b = resampling.bags(B.scan(spark, d, "customer"), "c_custkey", 4, 9)
    m = A.membership(b, "c_custkey", 1000).select("bag", "member_hash")
    failed = m.filter("bag = 2").unionByName(m.filter("bag = 3").withColumn("member_hash", F.col("member_hash") + 1))
    return B.rounded(A.not_excluded(b.join(m, "bag"), failed).groupBy("bag").agg(F.count(F.lit(1)).alias("kept")))


TOLS = V + ", nz AS (SELECT quantile_cont(abs(a - b), 0.5) FILTER (ord < 9) AS x, quantile_cont(abs(a - b), 0.5) FILTER (ord >= 9) AS y FROM cells)"


@query("tolerance_grid", B.sql(TOLS, "SELECT 'noise' AS kind, greatest(x, y) AS delta FROM nz UNION ALL SELECT 'absolute', unnest([0.01, 0.1]::DOUBLE[]) FROM nz", "delta"))
def tolerance_grid(spark, d):
    """D38."""
    n = A.displacements(_cells(spark, d).withColumn("method", F.when(F.col("ord") < 9, "a").otherwise("b")), ["method"]).select("method", "delta")
    return B.rounded(A.tolerance_grid(n, "a", "b", [0.01, 0.1]))


@query("additivity", B.sql(V, "SELECT max(abs(s - m)) AS largest, count(*) AS n FROM (SELECT vec_id, sum(a) AS s, round(sum(a), 2) AS m FROM va GROUP BY 1)", "largest"))
def additivity(spark, d):
    """Sum of contributions against a stored margin."""
    a, _ = B.vectors(spark, d)
    return B.rounded(A.additivity(a, a.groupBy("vec_id").agg(F.round(F.sum("a"), 2).alias("margin")), "vec_id"))
