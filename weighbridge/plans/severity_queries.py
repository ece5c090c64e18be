"""Queries: severity assembly and its comparison, permutations, comparator designs, cross-fitting, sources and sinks."""

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import learners
from ..operators import metrics as M
from ..operators import severity as V
from ..sources import tables as S
from . import base as B
from .evidence_queries import _design
from .feature_queries import ORGAN, SEVERITY, _inputs, organ_score
from .metric_queries import auc_sql, lifted
from .registry import query

FLAGS = """
SELECT o_orderkey, greatest(coalesce(returned, 0), coalesce(discounted, 0), coalesce(urgent, 0))::BIGINT AS flag, (returned IS NULL)::BIGINT AS unknown
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS urgent FROM orders)
LEFT JOIN (SELECT l_orderkey AS o_orderkey, max((l_returnflag = 'R')::INT) AS returned, max((l_discount > 0.08)::INT) AS discounted FROM lineitem WHERE l_quantity > 25 GROUP BY 1) USING (o_orderkey)"""


@query("any_flags", FLAGS)
def any_flags(spark, d):
    """V7: greatest of several indicators, unknown as 0."""
    items = S.scan(spark, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    items = items.agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.max((F.col("l_discount") > 0.08).cast("int")).alias("discounted"))
    orders = S.scan(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("urgent"))
    flag = V.any_flag(F.col("returned"), F.col("discounted"), F.col("urgent"))
    return B.rounded(orders.join(items, "o_orderkey", "left").select("o_orderkey", flag.alias("flag"), F.col("returned").isNull().cast("int").alias("unknown")))


@query("assembled_inputs", """
SELECT c_custkey, c_mktsegment, orders, round(dearest, 6) + 0.0 AS dearest, events, round(least_value, 6) + 0.0 AS least_value, n_name FROM customer
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS orders, max(o_totalprice) AS dearest FROM orders GROUP BY 1) USING (c_custkey)
LEFT JOIN (SELECT user_id AS c_custkey, count(*) AS events, min(value) AS least_value FROM events GROUP BY 1) USING (c_custkey)
LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) USING (c_custkey)""")
def assembled_inputs(spark, d):
    """One-row-per-key inputs joined to the cohort."""
    c = S.scan(spark, d, "customer")
    orders = S.scan(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest"))
    events = S.scan(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("events"), F.min("value").alias("least_value"))
    nations = c.join(S.scan(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return B.rounded(V.assembled(c.select("c_custkey", "c_mktsegment"), [orders, events, nations], "c_custkey"))


RECORDED = B.sql(B.RAW, "SELECT user_id, 11 + (CASE WHEN fio2 >= 50 THEN gradient ELSE pao2 END IS NOT NULL)::BIGINT AS recorded FROM (SELECT user_id, min(bin_med) FILTER (signal = 'view') AS fio2, max(bin_med) FILTER (signal = 'click') AS gradient, min(bin_max) FILTER (signal = 'error') AS pao2 FROM hourly GROUP BY 1)")
ASSEMBLY = f"""
SELECT user_id, y::BIGINT AS y, fold::BIGINT AS fold, site, acute_score, acute_present, organ_score, organs_present, recorded, (coalesce(acute_present >= 10, false))::BIGINT AS covers_acute_present,
  (coalesce(organs_present >= 4, false))::BIGINT AS covers_organs_present, (coalesce(acute_present >= 10, false) AND coalesce(organs_present >= 4, false))::BIGINT AS covered, (recorded IS DISTINCT FROM acute_present)::BIGINT AS disagrees
FROM ({B.sql(B.PEOPLE, "SELECT user_id, y, fold, site FROM people")}) LEFT JOIN ({SEVERITY}) USING (user_id) LEFT JOIN ({ORGAN}) USING (user_id) LEFT JOIN ({RECORDED}) USING (user_id)"""


def _assembly(spark, d):
    given = _inputs(spark, d)
    oxygen = F.when(F.col("fio2") >= 50, F.col("gradient")).otherwise(F.col("pao2"))
    recorded = given.select("user_id", (F.lit(11) + oxygen.isNotNull().cast("long")).alias("recorded"))  # ten variables, consciousness, oxygenation
    acute = V.acute_score(given).select("user_id", "acute_score", "acute_present")
    out = V.severity_assembly(B.people(spark, d).select("user_id", "y", "fold", "site"), acute, organ_score(spark, d), recorded, "user_id")
    return S.scan_once(out, B.out(spark, "assembly"))  # every arm and site reads it


@query("severity_assembly", ASSEMBLY)
def severity_assembly(spark, d):
    """Both scores, coverage masks, joint mask and presence-count disagreement."""
    return B.rounded(_assembly(spark, d))


ARMS = f"(SELECT * FROM (SELECT site, y, 'acute' AS arm, acute_score::DOUBLE AS score, covered FROM ({ASSEMBLY}) UNION ALL SELECT site, y, 'organ', organ_score, covered FROM ({ASSEMBLY})) WHERE covered = 1)"


@query("severity_comparison", B.sql("", "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in "rate auroc auprc lift".split()) + f") FROM ({lifted(auc_sql(ARMS, 'arm, site'))})"))
def severity_comparison(spark, d):
    """Both scores on the rows that both cover, by site."""
    return B.rounded(M.discrimination(V.comparison_arms(_assembly(spark, d), {"acute": "acute_score", "organ": "organ_score"}, ["site", "y"]), ["arm", "site"]))


@query("severity_transport")
def severity_transport(spark, d):
    """Recalibrated scores and the evidence sum on the same rows: metrics at one site against the other's."""
    from ..operators import transport

    a = _assembly(spark, d).join(B.scores(spark, d).select("user_id", F.col("score").alias("evidence")), "user_id", "left")
    fitted = V.recalibrated(a.filter("acute_score is not null"), "acute_score", "y", "fold").select("user_id", F.col("l").alias("acute_l"))
    arms = V.comparison_arms(a.join(fitted, "user_id", "left"), {"acute": "acute_l", "organ": "organ_score", "evidence": "evidence"}, ["site", "y"])
    by = M.discrimination(arms, ["arm", "site"])
    return B.rounded(transport.transport_table(by.filter("site = 'odd'").drop("site"), by.filter("site = 'even'").drop("site"), "arm"))


DOMAIN_ORGAN = f"""
SELECT m.*, r.spearman FROM ({lifted(auc_sql("dom", "domain"))}) m LEFT JOIN (
  SELECT domain, corr(ra, rb) AS spearman FROM (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY score) + (count(*) OVER (PARTITION BY domain, score) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY domain ORDER BY other) + (count(*) OVER (PARTITION BY domain, other) - 1) / 2 AS rb FROM dom) GROUP BY 1) r USING (domain)"""


@query("domain_against_organ", B.sql(B.EVIDENCE + f", org AS ({ORGAN}), dom AS (SELECT domain, round(l, 4) + 0.0 AS score, y, organ_score AS other FROM (SELECT user_id, coalesce(domain, 'uncovered') AS domain, sum(l) AS l FROM evidence LEFT JOIN domains USING (signal) GROUP BY ALL) JOIN people USING (user_id) JOIN org USING (user_id))", DOMAIN_ORGAN, "rate auroc auprc lift spearman"))
def domain_against_organ(spark, d):
    """Evidence by domain, the uncovered one too, against the outcome and the organ score."""
    sums = V.by_domain(B.evidence(spark, d), B.domains(spark), "user_id").withColumn("l", F.round("l", 4) + F.lit(0.0))
    sums = S.scan_once(sums.join(B.people(spark, d).select("user_id", "y"), "user_id"), B.out(spark, "domains"))
    organ = S.scan_once(organ_score(spark, d).select("user_id", "organ_score"), B.out(spark, "organ"))
    return B.rounded(V.domains_against(sums.drop("y"), sums.select("user_id", "y").distinct(), organ, "user_id", "organ_score"))


_U = B.UNIFORM.format("concat_ws('|', 14, l_key)")
NONZERO = f"""
WITH r AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS l_key, l_returnflag, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL),
nz AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_key) AS i, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_U}, l_key) AS j FROM r WHERE l_tax <> 0)
SELECT l_key, l_returnflag, l_tax FROM r WHERE l_tax = 0 UNION ALL SELECT a.l_key, a.l_returnflag, b.l_tax FROM nz a JOIN nz b ON a.l_returnflag = b.l_returnflag AND a.i = b.j"""


@query("permuted_nonzero", NONZERO)
def permuted_nonzero(spark, d):
    """Values other than 0 shuffled within a class, zeros in place."""
    key = F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    rows = S.scan(spark, d, "lineitem").groupBy(key.alias("l_key"), "l_returnflag").agg(F.max("l_tax").alias("l_tax"))
    return E.permuted_nonzero(rows, "l_key", "l_tax", ["l_returnflag"], 14)


@query("pair_fold_evidence")
def pair_fold_evidence(spark, d):
    """Evidence with the row's fold and one other left out."""
    design, names = _design(spark, d)
    return B.rounded(E.pair_fold_evidence(design, names, B.FOLDS, "user_id"))


VALUES = ["n_obs", "value_median", "q05", "q95"]


@query("raw_design", B.sql(B.GRID, "SELECT user_id, " + ", ".join(f"max({v}) FILTER (signal = '{s}' AND n_obs > 0)::DOUBLE AS {s}__{v}" for s in B.SIGNALS for v in VALUES) + " FROM grid WHERE n_obs > 0 GROUP BY 1", " ".join(f"{s}__{v}" for s in B.SIGNALS for v in VALUES)))
def raw_design(spark, d):
    """B1: raw features of every signal, null where unmeasured."""
    g = B.feature_grid(spark, d).filter("n_obs > 0").select("user_id", "signal", *[F.col(v).cast("double").alias(v) for v in VALUES], F.lit(None).cast("double").alias("nowhere"))
    return B.rounded(learners.raw_design(g, "user_id", "signal", [*VALUES, "nowhere"], B.SIGNALS))


COVARIATES = ["k_low", "k_high", "trend"]


@query("constructed_design", B.sql(B.GRID, "SELECT g.*, coalesce(p, 0) AS pressor__exposure, coalesce(i, 0) AS intake__exposure FROM (SELECT user_id, " + ", ".join(f"max({c}) FILTER (signal = '{s}')::DOUBLE AS {s}__{c}" for s in B.SIGNALS for c in COVARIATES)
    + " FROM grid WHERE n_obs > 0 GROUP BY 1) g LEFT JOIN (SELECT user_id, count(*)::DOUBLE AS p FROM pressor GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*)::DOUBLE AS i FROM intake GROUP BY 1) USING (user_id)", " ".join(f"{s}__{c}" for s in B.SIGNALS for c in COVARIATES)))
def constructed_design(spark, d):
    """B2: modelled covariates and each intervention once."""
    g = B.feature_grid(spark, d).filter("n_obs > 0").select("user_id", "signal", *[F.col(c).cast("double").alias(c) for c in COVARIATES])
    long = g.unpivot(["user_id", "signal"], COVARIATES, "covariate", "x")
    bins = B.pressor_bins(spark, d).select("user_id", "intervention").unionByName(B.signup_bins(spark, d).select("user_id", "intervention"))
    exposure = bins.groupBy("user_id", "intervention").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return B.rounded(learners.constructed_design(long, exposure, "user_id", B.SIGNALS, COVARIATES, ["pressor", "intake"]))


@query("cross_fitted_boosting")
def cross_fitted_boosting(spark, d):
    """Boosted trees that never saw the row's fold, stopped early on an inner split."""
    w = learners.median_filled(learners.wide_design(B.evidence(spark, d), "user_id", "signal", "l", B.SIGNALS), B.SIGNALS)
    features = [c for c in w.columns if c != "user_id"]
    return B.rounded(learners.cross_fitted(w.join(B.people(spark, d).select("user_id", "y", "fold"), "user_id"), features, "user_id", "y", "fold", B.FOLDS))


LINES = "l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_returnflag"


@query("declared_scan", f"SELECT {LINES} FROM lineitem")
def declared_scan(spark, d):
    """The tables of a site by declared schema, as views."""
    tables = S.load_tables(spark, d, {"lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string", "orders": "o_orderkey bigint, o_orderstatus string"})
    return B.rounded(tables["lineitem"])


@query("clustered_table", f"SELECT {LINES} FROM lineitem")
def clustered_table(spark, d):
    """Partitioned by a small key and sorted inside, read back."""
    path = B.out(spark, "clustered")
    S.write_clustered(S.scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path, "l_returnflag", ["l_orderkey", "l_linenumber"])
    return B.rounded(spark.read.parquet(path))


@query("shared_slice", "SELECT o_orderpriority, n, round(total, 2) + 0.0 AS total FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) JOIN (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_orderpriority)")
def shared_slice(spark, d):
    """A filtered slice written once, read by two consumers."""
    part = S.scan_once(S.scan(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderpriority", "o_totalprice"), B.out(spark, "slice"))
    a = part.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return a.join(part.groupBy("o_orderpriority").agg((F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total")), "o_orderpriority")


@query("csv_round_trip", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size::BIGINT END AS p_size FROM part")
def csv_round_trip(spark, d):
    """A result saved as parquet and CSV with nulls empty, the CSV converted by declared schema."""
    path = B.out(spark, "result")
    S.save_result(S.scan(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size")), path)
    return B.rounded(S.csv_to_parquet(spark, f"{path}.csv", "p_partkey bigint, p_name string, p_size int", f"{path}-csv.parquet"))


SPEC = {"view": ("low", None), "click": (None, 8), "error": ("high", 4)}


@query("signal_spec", B.sql(B.RAW, "SELECT signal, coalesce(side, 'both') AS side, coalesce(basis, 6)::BIGINT AS basis, n FROM (SELECT signal, count(*) AS n FROM hourly GROUP BY 1) LEFT JOIN (VALUES ('view', 'low', NULL), ('click', NULL, 8), ('error', 'high', 4)) s(signal, side, basis) USING (signal)"))
def signal_spec(spark, d):
    """Declarations resolved from defaults plus overrides, joined by broadcast."""
    spec = S.resolved_spec(spark, B.SIGNALS, {"side": ("string", "both"), "basis": ("int", 6)}, {s: {"side": a, "basis": b} for s, (a, b) in SPEC.items()})
    return B.rounded(B.binned(spark, d).groupBy("signal").agg(F.count(F.lit(1)).alias("n")).join(spec, "signal").select("signal", "side", "basis", "n"))
