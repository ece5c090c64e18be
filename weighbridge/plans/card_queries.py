"""Collapse decomposition, replicate plans, burden strata and cards."""

from pyspark.sql import functions as F

from ..operators import additive, attribution as A, metrics as M, reports as K, stability as T
from ..sources import tables as S
from . import base as B
from .evidence_queries import COVARIATES
from .refit_queries import _covariates
from .registry import query

SHARE, BAGS = 0.2, 10
COLLAPSE = B.EVIDENCE + f""",
ec AS (SELECT p.user_id, r.signal, list_position({B.SIGNALS!r}, r.signal)::BIGINT AS ord, coalesce(l, 0) AS a, (l IS NOT NULL)::INT AS measured, p.site || '-' || p.fold AS grp FROM people p CROSS JOIN ranges r LEFT JOIN evidence e ON e.user_id = p.user_id AND e.signal = r.signal),
cc AS (SELECT *, round(a - avg(a) OVER (PARTITION BY signal) + (1 - measured) * (user_id % 7 - 3) / 4, 4) AS b FROM ec),
led AS (SELECT user_id, grp, arg_min(signal, (-abs(b), ord)) AS leader, 1 - arg_min(measured, (-abs(b), ord)) AS unmeasured,
  (coalesce(arg_min(a, (-abs(b), ord)) / nullif(sum(greatest(a, 0)), 0), 0) < {SHARE})::INT AS collapsed, count_if(measured = 0) AS n_unmeasured FROM cc GROUP BY ALL HAVING sum(abs(b)) > 0)"""
PARTS = """count(*) AS n, avg(collapsed) AS collapse, avg(unmeasured) AS leader_unmeasured, avg(collapsed) FILTER (unmeasured = 1) AS collapse_given_unmeasured,
  avg(collapsed) FILTER (unmeasured = 0) AS collapse_given_measured, avg(unmeasured) FILTER (collapsed = 1) AS unmeasured_given_collapse, avg(n_unmeasured) AS n_unmeasured"""
DOUBLES = "collapse leader_unmeasured collapse_given_unmeasured collapse_given_measured unmeasured_given_collapse n_unmeasured"


def _led(spark, d):
    """Leaders of the evidence less its mean by signal, which gives unmeasured signals a value of their own, against the evidence itself."""
    p = B.people(spark, d).select("user_id", F.concat_ws("-", "site", "fold").alias("grp"))
    e = B.evidence(spark, d).select("user_id", "signal", "l")
    g = p.crossJoin(B.ranges(spark).select("signal")).join(e, ["user_id", "signal"], "left")  # a row for each user and declared signal
    ordinal = F.expr("array_position(array(" + ", ".join(f"'{s}'" for s in B.SIGNALS) + "), signal)").cast("long")
    g = S.scan_once(g.select("user_id", "grp", "signal", ordinal.alias("ord"), F.coalesce("l", F.lit(0.0)).alias("a"), F.col("l").isNotNull().cast("int").alias("measured")), B.out(spark, "grid"))
    mean = g.groupBy("signal").agg(F.avg("a").alias("mean"))
    cells = g.join(F.broadcast(mean), "signal").withColumn("b", F.round(F.col("a") - F.col("mean") + (1 - F.col("measured")) * (F.col("user_id") % 7 - 3) / 4.0, 4))  # a row a signal
    return S.scan_once(A.collapsed_leaders(cells, "user_id", SHARE, ("grp",)), B.out(spark, "leaders"))


@query("collapse_by_group", B.sql(COLLAPSE, f"SELECT grp, {PARTS} FROM led GROUP BY 1 UNION ALL SELECT 'all', {PARTS} FROM led", DOUBLES))
def collapse_by_group(spark, d):
    """Collapse of leaders split by measured and unmeasured ones, of every group and of all."""
    led = _led(spark, d)
    return B.rounded(A.collapse_decomposition(led, ["grp"]).unionByName(A.collapse_decomposition(led.withColumn("grp", F.lit("all")), ["grp"])))


@query("collapse_by_channel", B.sql(COLLAPSE, "SELECT leader AS signal, count(*) AS n, avg(collapsed) AS collapse, count(*) / sum(count(*)) OVER () AS share FROM led WHERE unmeasured = 1 GROUP BY 1", "collapse share"))
def collapse_by_channel(spark, d):
    """Signals that lead where they are unmeasured."""
    return B.rounded(A.unmeasured_channels(_led(spark, d), []))


MID = "rank() OVER (PARTITION BY x, y ORDER BY {0}) + (count(*) OVER (PARTITION BY x, y, {0}) - 1) / 2"


@query("collapse_correlations", B.sql(COLLAPSE, f"""SELECT x, y, count(*) AS groups, corr(ru, rv) AS spearman FROM (SELECT x, y, {MID.format('u')} AS ru, {MID.format('v')} AS rv FROM (
  SELECT p.x, p.y, p.u, p.v FROM (SELECT unnest([{{'x': 'leader_unmeasured', 'y': 'collapse', 'u': leader_unmeasured, 'v': collapse}}, {{'x': 'n_unmeasured', 'y': 'collapse', 'u': n_unmeasured, 'v': collapse}},
    {{'x': 'leader_unmeasured', 'y': 'collapse_given_measured', 'u': leader_unmeasured, 'v': collapse_given_measured}}]) AS p FROM (SELECT grp, {PARTS} FROM led GROUP BY 1) WHERE n >= 5) WHERE p.u IS NOT NULL AND p.v IS NOT NULL)) GROUP BY ALL""", "spearman").replace("corr(ru, rv)", "CASE WHEN isnan(corr(ru, rv)) THEN NULL ELSE corr(ru, rv) END"))
def collapse_correlations(spark, d):
    """Rank correlations over groups."""
    return B.rounded(A.collapse_correlations(A.collapse_decomposition(_led(spark, d), ["grp"]), 5, []))


#: Replicates by what line items hold: method = return flag, bag = line number - 1, seed and route by line status, draws for large quantities.
FAMILIES = {"bootstrap": "refit", "seeded": "refit", "posterior": "draws"}
MANIFEST = """
mf AS (SELECT method || '-' || route || '-' || boot || '-' || seed || '-' || draw AS id, * FROM (SELECT DISTINCT l_returnflag AS method,
  CASE WHEN l_quantity > 45 THEN 'posterior' WHEN l_linestatus = 'F' THEN 'seeded' ELSE 'bootstrap' END AS route, CASE WHEN l_quantity > 45 THEN 0 ELSE (l_linenumber - 1)::BIGINT END AS boot,
  CASE WHEN l_quantity > 45 OR l_linestatus <> 'F' THEN 0 ELSE l_linenumber % 3 END::BIGINT AS seed, CASE WHEN l_quantity > 45 THEN l_linenumber % 4 ELSE 0 END::BIGINT AS draw FROM lineitem))"""
PLAN = [(m, r, b, 0, 0) for m in "ANR" for r in ("bootstrap", "seeded") for b in range(6)] + [(m, "posterior", 0, 0, k) for m in "ANR" for k in range(1, 5)]


def _manifest(spark, d):
    large, late = F.col("l_quantity") > 45, F.col("l_linestatus") == "F"
    line = F.col("l_linenumber").cast("long")
    m = S.scan(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.when(large, "posterior").when(late, "seeded").otherwise("bootstrap").alias("route"), F.when(large, 0).otherwise(line - 1).cast("long").alias("boot"),
                                            F.when(large | ~late, 0).otherwise(line % 3).cast("long").alias("seed"), F.when(large, line % 4).otherwise(0).cast("long").alias("draw")).distinct()
    return S.scan_once(m.withColumn("id", F.concat_ws("-", "method", "route", "boot", "seed", "draw")), B.out(spark, "manifest"))


@query("manifest_coverage", B.sql(MANIFEST + f", plan(method, route, boot, seed, draw) AS (VALUES {B._values(PLAN)})", """
SELECT method, route, count_if(planned) AS planned, count_if(planned AND seen) AS present, count_if(planned AND NOT seen) AS missing, count_if(seen AND NOT planned) AS unplanned, 0::BIGINT AS repeated
FROM (SELECT coalesce(m.method, p.method) AS method, coalesce(m.route, p.route) AS route, p.method IS NOT NULL AS planned, m.method IS NOT NULL AS seen FROM plan p FULL JOIN mf m USING (method, route, boot, seed, draw)) GROUP BY ALL"""))
def manifest_coverage(spark, d):
    """A declared replicate plan against the manifest."""
    plan = S.spec_table(spark, PLAN, "method string, route string, boot long, seed long, draw long")
    return A.manifest_coverage(_manifest(spark, d), plan, ["method", "route", "boot", "seed", "draw"], ["method", "route"])


@query("contrast_levels", B.sql(MANIFEST, """
SELECT family, level, refused, count(*) AS pairs FROM (SELECT family, CASE WHEN refused IS NOT NULL THEN 'refused' WHEN dm THEN 'L4' WHEN dd THEN 'L3P' WHEN db AND ds THEN 'L3T' WHEN db THEN 'L3' WHEN ds THEN 'L2' ELSE 'L1' END AS level, refused FROM (
  SELECT *, CASE WHEN dm AND (db OR ds OR dd) THEN 'confounded' WHEN dd AND (db OR ds) THEN 'draw_mixed' WHEN db AND zb THEN 'full_sample' WHEN dd AND zd THEN 'centre' END AS refused FROM (
    SELECT a.family, a.method <> b.method AS dm, a.boot <> b.boot AS db, a.seed <> b.seed AS ds, a.draw <> b.draw AS dd, least(a.boot, b.boot) = 0 AS zb, least(a.draw, b.draw) = 0 AS zd
    FROM (SELECT *, CASE WHEN route = 'posterior' THEN 'draws' ELSE 'refit' END AS family FROM mf) a JOIN (SELECT *, CASE WHEN route = 'posterior' THEN 'draws' ELSE 'refit' END AS family FROM mf) b ON a.family = b.family AND a.id < b.id))) GROUP BY ALL"""))
def contrast_levels(spark, d):
    """Pairs of replicates at every level (L1 to L4, L3T, L3P), and the refused ones by reason."""
    return A.contrast_levels(_manifest(spark, d), FAMILIES).groupBy("family", "level", "refused").agg(F.count(F.lit(1)).alias("pairs"))


BURDEN = B.EVIDENCE + """,
iv AS (SELECT p.user_id, (SELECT count(*) FROM pressor x WHERE x.user_id = p.user_id)::DOUBLE AS active, round(coalesce((SELECT sum(intensity) FROM intake x WHERE x.user_id = p.user_id), 0), 2) AS intake FROM people p),
arms AS (SELECT user_id, signal, y, l AS a, round(l - k_high / n_obs, 4) AS b, active, intake, (active > 0)::BIGINT AS exposed, (active > 0)::BIGINT + (intake > 0)::BIGINT AS burden
  FROM evidence JOIN people USING (user_id) JOIN (SELECT user_id, signal, k_high, n_obs FROM grid) USING (user_id, signal) JOIN iv USING (user_id))"""
PAIRED = """
pr AS (SELECT p.grp, p.user_id AS pu, n.user_id AS nu, (p.a > n.a)::INT + 0.5 * (p.a = n.a)::INT AS ca, (p.b > n.b)::INT + 0.5 * (p.b = n.b)::INT AS cb FROM sc p JOIN sc n ON p.grp = n.grp AND p.y = 1 AND n.y = 0),
vp AS (SELECT grp, var_samp(c) / count(*) AS v, avg(a) AS auc_a, avg(b) AS auc_b FROM (SELECT grp, pu, avg(ca - cb) AS c, avg(ca) AS a, avg(cb) AS b FROM pr GROUP BY ALL) GROUP BY 1),
vn AS (SELECT grp, var_samp(c) / count(*) AS v FROM (SELECT grp, nu, avg(ca - cb) AS c FROM pr GROUP BY ALL) GROUP BY 1),
nn AS (SELECT grp, count(*) AS n, sum(y)::BIGINT AS events FROM sc GROUP BY 1),
dl AS (SELECT *, difference / se AS z FROM (SELECT nn.grp, n, events, auc_a, auc_b, auc_a - auc_b AS difference, sqrt(vp.v + vn.v) AS se, (n >= 20 AND events >= 5 AND n - events >= 5)::BIGINT AS reported FROM nn LEFT JOIN vp USING (grp) LEFT JOIN vn USING (grp)))"""
Z = "CASE WHEN se > 1e-9 THEN difference / se END"
CONTRAST = f"n, events, auc_a, auc_b, difference, se, {Z} AS z, {M.normal_tail(Z)} AS p, reported"
CONTRAST_DOUBLES = "auc_a auc_b difference se z p"


def _arms(spark, d):
    """Evidence (a) and evidence without the high counts (b) of measured signals, with the user's interventions."""
    c = _covariates(spark, d).select("user_id", "active", "intake").distinct()
    g = B.feature_grid(spark, d).filter("n_obs > 0").select("user_id", "signal", "k_high", "n_obs")
    a = B.evidence(spark, d).select("user_id", "signal", F.col("l").alias("a")).join(g, ["user_id", "signal"]).join(B.people(spark, d).select("user_id", "y"), "user_id").join(c, "user_id")
    a = a.withColumns({"b": F.round(F.col("a") - F.col("k_high") / F.col("n_obs"), 4), "exposed": (F.col("active") > 0).cast("int"), "burden": (F.col("active") > 0).cast("int") + (F.col("intake") > 0).cast("int")})
    return S.scan_once(a.select("user_id", "signal", "y", "a", "b", "active", "intake", "exposed", "burden"), B.out(spark, "arms"))


@query("exposure_contrast", B.sql(BURDEN + ", sc AS (SELECT *, signal || '|' || exposed AS grp FROM arms)," + PAIRED + """,
cl AS (SELECT signal || '|' || exposed AS grp, (count(DISTINCT active) <= 1)::BIGINT + (count(DISTINCT intake) <= 1)::BIGINT AS constant FROM arms GROUP BY 1)""",
f"SELECT split_part(grp, '|', 1) AS signal, split_part(grp, '|', 2)::BIGINT AS exposed, {CONTRAST}, constant, (constant = 2)::BIGINT AS clean FROM dl JOIN cl USING (grp)", CONTRAST_DOUBLES))
def exposure_contrast(spark, d):
    """Both arms among users exposed and not exposed to the intervention, with the paired test inside each, and whether the interventions are constant there."""
    a = _arms(spark, d)
    t = M.reported(M.delong_by(a, ["signal", "exposed"], "user_id", "a", "b"), 20, 5)
    return B.rounded(t.join(M.constant_columns(a, ["signal", "exposed"], ["active", "intake"]), ["signal", "exposed"]))


@query("burden_contrast", B.sql(BURDEN + ", sc AS (SELECT user_id, burden AS grp, max(y) AS y, round(sum(a), 4) AS a, round(sum(b), 4) AS b FROM arms GROUP BY ALL)," + PAIRED, f"SELECT grp AS burden, {CONTRAST} FROM dl", CONTRAST_DOUBLES))
def burden_contrast(spark, d):
    """Both arms' sums within strata of the number of interventions, with the paired test."""
    s = _arms(spark, d).groupBy("user_id", "burden").agg(F.max("y").alias("y"), F.round(F.sum("a"), 4).alias("a"), F.round(F.sum("b"), 4).alias("b"))
    return B.rounded(M.reported(M.delong_by(S.scan_once(s, B.out(spark, "sums")), ["burden"], "user_id", "a", "b"), 20, 5))


def _cards(spark, d):
    rows = _covariates(spark, d)
    terms = T.Terms((*COVARIATES, "active"))
    table = T.knots(rows, list(terms.covariates), 1)
    design, names = T.designed(rows, table, terms)
    fits = additive.fit_jobs(design, ["signal"], names, T.bag_weights(F.col("user_id"), BAGS, 61)).select("signal", "role", "b", "prior", "covariance")
    x, p = F.array(*[F.col(n) for n in names]), len(names)
    product = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.lit(0.0), lambda acc, i: acc + F.element_at("x", i + 1) * F.aggregate(F.zip_with(F.slice("covariance", i * p + 1, p), "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    scored = design.withColumn("x", x).join(F.broadcast(fits), "signal")  # fits: signals x replicates
    scored = scored.select("user_id", "signal", "role", (additive.linear(names) - F.col("prior")).alias("l"), F.when(F.col("role") == 0, F.sqrt(F.greatest(product, F.lit(0.0)))).alias("se"))
    replicates = S.scan_once(scored, B.out(spark, "replicates"))
    outside = K.outside_support(rows, "user_id", T.grids(rows, terms, 21, 5), list(terms.covariates))
    lines = S.scan_once(K.card_lines(replicates, "user_id", outside), B.out(spark, "lines"))
    lines = K.percentile_within(lines, lines.select("signal", "l"), ["signal"], ["l", "low", "high"], "l")
    return K.cards(S.scan_once(lines, B.out(spark, "lines")), replicates, "user_id", lines.groupBy("user_id").agg(F.sum("l").alias("score")))


@query("cards")
def cards(spark, d):
    """K1: a card of every user: sum of evidence with replicate and posterior bands, percentiles, strata and extrapolated signals."""
    c = _cards(spark, d).withColumns({"n_lines": F.size("lines"), "strongest": F.col("lines")[0]["signal"]})
    return B.rounded(c.drop("lines"))


@query("card_lines")
def card_lines(spark, d):
    """K1: the cards' lines: evidence of every signal with bands, percentiles and terms outside support."""
    c = _cards(spark, d).select("user_id", F.posexplode("lines").alias("place", "line"))
    return B.rounded(c.select("user_id", "place", "line.*").drop("m"))
