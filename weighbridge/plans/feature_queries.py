"""Queries: masks, features, severity scores, checks and splits (F, V, Q, P)."""

from pyspark.sql import functions as F

from ..operators import checks as Q
from ..operators import features, resampling, severity as V
from ..sources import tables as S
from . import base as B
from .registry import query

DOUBLES = "ref_low ref_high q05 q95 value_median value_min value_max within_mean within_ss range_mean trend"
COLS = "user_id, signal, ref_low, ref_high, n_obs, k_low, k_mid, k_high, q05, q95, value_median, value_min, value_max, within_mean, within_ss, range_mean, n_raw, early, late, first_low::BIGINT AS first_low, first_high::BIGINT AS first_high, first_bin::BIGINT AS first_bin, last_bin::BIGINT AS last_bin, n_masked, span::BIGINT AS span, trend, trend_defined::BIGINT AS trend_defined, missing::BIGINT AS missing"


@query("signal_features", B.sql(B.GRID, f"SELECT {COLS} FROM grid", DOUBLES))
def signal_features(spark, d):
    """The dense entity x signal feature grid after masking (flagship)."""
    return B.rounded(B.feature_grid(spark, d))


@query("masked_bins", B.sql(B.MASKED, "SELECT user_id, signal, bin::BIGINT AS bin FROM masked"))
def masked_bins(spark, d):
    """Union of onset and concurrent masks."""
    return B.rounded(B.masked(spark, d))


@query("surviving_bins", B.sql(B.MASKED, "SELECT user_id, signal, bin::BIGINT AS bin, n_raw FROM lat"))
def surviving_bins(spark, d):
    """anti join of masked bins."""
    return B.rounded(features.surviving(B.binned(spark, d), B.masked(spark, d), "user_id").select("user_id", "signal", "bin", "n_raw"))


@query("mask_counts", B.sql(B.MASKED, "SELECT user_id, signal, count(*) AS n_masked FROM masked GROUP BY ALL"))
def mask_counts(spark, d):
    """F7."""
    return features.mask_counts(B.masked(spark, d), "user_id")


F16 = B.sql(B.GRID, """SELECT signal, count(*) AS keys, avg((n_obs > 0)::INT) AS measured, avg((n_masked > 0)::INT) AS masked, avg((k_low > 0)::INT) AS any_low, avg((k_high > 0)::INT) AS any_high,
  avg((q05 = value_min)::INT) FILTER (n_obs > 0) AS q05_is_min, avg(trend_defined) AS trend_share, avg(y) FILTER (missing = 1) AS rate_missing, avg(y) FILTER (missing = 0) AS rate_measured, corr(n_obs, k_high) AS corr_n_high
  FROM grid JOIN people USING (user_id) GROUP BY 1""", "measured masked any_low any_high q05_is_min trend_share rate_missing rate_measured corr_n_high")


@query("feature_audit", F16)
def feature_audit(spark, d):
    """Coverage, excursion and missingness audit."""
    return B.rounded(features.feature_audit(B.feature_grid(spark, d), B.people(spark, d).select("user_id", "y"), "user_id"))


@query("typical_density", B.sql(B.GRID, "SELECT signal, quantile_cont(n_obs, 0.5) AS median_n FROM grid WHERE n_obs > 0 GROUP BY 1", "median_n"))
def typical_density(spark, d):
    """F18."""
    return B.rounded(features.typical_density(B.feature_grid(spark, d)))


EXT = ", ".join(f"min(bin_min) FILTER (signal = '{s}') AS {s}_min, max(bin_max) FILTER (signal = '{s}') AS {s}_max" for s in B.SIGNALS)


@query("extremes_pivot", B.sql(B.RAW, f"SELECT user_id, {EXT} FROM hourly GROUP BY 1", " ".join(f"{s}_min {s}_max" for s in B.SIGNALS)))
def extremes_pivot(spark, d):
    """V1, V4: extremes in one row per entity."""
    return B.rounded(V.extremes(B.binned(spark, d), "user_id", B.SIGNALS))


@query("lowest_row", "SELECT l_orderkey, l_extendedprice, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_quantity) = 1")
def lowest_row(spark, d):
    """V2, V5: whole row at the lowest value."""
    return B.rounded(V.row_at_lowest(S.scan(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_linenumber", "l_quantity"]))


@query("lowest_ratio", "SELECT l_suppkey, round(min(l_extendedprice / (l_quantity / 100)), 6) + 0.0 AS ratio FROM lineitem WHERE l_quantity BETWEEN 21 AND 100 AND l_extendedprice > 0 GROUP BY 1")
def lowest_ratio(spark, d):
    """V6: minimum of a gated ratio."""
    return B.rounded(V.lowest_ratio(S.scan(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity"))


@query("lowest_total", B.sql(B.RAW, "SELECT user_id, min(t) AS lowest_total FROM (SELECT user_id, min(bin_min) FILTER (signal = 'click') + min(bin_min) FILTER (signal = 'view') + coalesce(min(bin_min) FILTER (signal = 'error'), 5) AS t FROM hourly GROUP BY user_id, bin) WHERE t BETWEEN 3 AND 150 GROUP BY 1", "lowest_total"))
def lowest_total(spark, d):
    """V3: total per bin with a filled component, then its minimum inside a gate."""
    return B.rounded(V.hourly_total_low(B.binned(spark, d), "user_id", ["click", "view", "error"], "error", 5, 3, 150))


def _case(x, breaks, points):
    return "CASE WHEN " + x + " IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b} THEN {p}" for b, p in zip(breaks, points)) + f" ELSE {points[-1]} END"


_A = {v: f"greatest({_case(f'lo * {k}', *b)}, {_case(f'hi * {k}', *b)})" for (v, b), k in zip(V.APACHE_BANDS.items(), (0.5, 1, 1, 0.4, 0.09, 1.6, 0.05, 0.03, 0.5, 0.3))}
SEVERITY = B.sql(B.RAW, f"""
SELECT user_id, {' + '.join(f"coalesce(p_{v}, 0)" for v in _A)} + coalesce(p_gcs, 0) + coalesce(p_ox, 0) + p_age + CASE WHEN chronic = 1 THEN CASE WHEN class = 'elective_surgery' THEN 2 ELSE 5 END ELSE 0 END AS acute_score,
  {' + '.join(f"(p_{v} IS NOT NULL)::INT" for v in _A)} + (p_gcs IS NOT NULL)::INT + (p_ox IS NOT NULL)::INT AS acute_present
FROM (SELECT *, {', '.join(f"{s} * {2 if v == 'creatinine' else 1} AS p_{v}" if v == 'creatinine' else f"{s} AS p_{v}" for v, s in _A.items())}, CASE WHEN gcs BETWEEN 3 AND 15 THEN 15 - gcs END AS p_gcs,
    CASE WHEN fio2 >= 50 THEN {_case('gradient', *V.GRADIENT_BAND)} ELSE {_case('pao2', *V.PAO2_BAND)} END AS p_ox, coalesce({_case('age', *V.AGE_BAND)}, 0) AS p_age
  FROM (SELECT user_id, min(bin_min) AS lo, max(bin_max) AS hi, (count(*) % 16)::INT AS gcs, min(bin_med) FILTER (signal = 'view') AS fio2, max(bin_med) FILTER (signal = 'click') AS gradient,
      min(bin_max) FILTER (signal = 'error') AS pao2, (user_id % 90)::DOUBLE AS age, (user_id % 3 = 0)::INT AS chronic, CASE WHEN user_id % 2 = 0 THEN CASE WHEN user_id % 5 = 0 THEN 'elective_surgery' ELSE 'emergency_surgery' END ELSE 'medical' END AS class
    FROM hourly GROUP BY 1))""")
SEVERITY = f"SELECT user_id, acute_score::BIGINT AS acute_score, acute_present::BIGINT AS acute_present FROM ({SEVERITY})"


def _inputs(spark, d):
    med = lambda f, s, c: f(F.when(F.col("signal") == s, F.col(c)))
    g = B.binned(spark, d).groupBy("user_id").agg(F.min("bin_min").alias("lo"), F.max("bin_max").alias("hi"), (F.count(F.lit(1)) % 16).cast("int").alias("gcs"),
        med(F.min, "view", "bin_med").alias("fio2"), med(F.max, "click", "bin_med").alias("gradient"), med(F.min, "error", "bin_max").alias("pao2"))
    scale = dict(zip(V.APACHE_BANDS, (0.5, 1, 1, 0.4, 0.09, 1.6, 0.05, 0.03, 0.5, 0.3)))
    g = g.withColumns({f"{v}_{e}": F.col(c) * F.lit(float(k)) for v, k in scale.items() for e, c in (("min", "lo"), ("max", "hi"))})
    none = F.lit(None).cast("double")
    return g.withColumns({
        "bicarbonate_min": none, "bicarbonate_max": none, "age": (F.col("user_id") % 90).cast("double"), "acute_renal": F.lit(1), "chronic": (F.col("user_id") % 3 == 0).cast("int"),
        "class": V.admission_class(F.col("user_id") % 2 == 0, F.col("user_id") % 5 == 0),
    })


@query("acute_score", SEVERITY)
def acute_score(spark, d):
    """Band scores, worst of two ends, presence count."""
    return V.acute_score(_inputs(spark, d)).select("user_id", "acute_score", "acute_present")


ORGAN = B.sql(B.RAW, f"""
SELECT user_id, (coalesce(r, 0) + coalesce(co, 0) + coalesce(li, 0) + coalesce(cv, 0) + coalesce(ne, 0) + coalesce(re, 0))::BIGINT AS organ_score,
  ((r IS NOT NULL)::INT + (co IS NOT NULL)::INT + (li IS NOT NULL)::INT + (cv IS NOT NULL)::INT + (ne IS NOT NULL)::INT + (re IS NOT NULL)::INT)::BIGINT AS organs_present
FROM (SELECT user_id, CASE WHEN support = 1 THEN {_case('x', *V.SOFA_BANDS['respiration'])} ELSE least({_case('x', *V.SOFA_BANDS['respiration'])}, CASE WHEN x IS NULL THEN NULL ELSE 2 END) END AS r,
    {_case('y', *V.SOFA_BANDS['coagulation'])} AS co, {_case('z', *V.SOFA_BANDS['liver'])} AS li, {_case('w', *V.SOFA_BANDS['nervous'])} AS ne, {_case('z / 2', *V.SOFA_BANDS['renal'])} AS re,
    CASE WHEN press = 1 THEN CASE WHEN dose IS NULL THEN 3 WHEN dose > 0.1 THEN 4 ELSE 3 END WHEN ino = 1 THEN 2 WHEN x < 70 THEN 1 WHEN x IS NOT NULL THEN 0 END AS cv
  FROM (SELECT user_id, max(bin_max) FILTER (signal = 'view') AS x, min(bin_min) FILTER (signal = 'click') * 20 AS y, min(bin_min) FILTER (signal = 'error') AS z, (count(*) % 16)::DOUBLE AS w,
      (user_id % 2)::INT AS support, (user_id % 4 = 0)::INT AS press, (user_id % 3 = 0)::INT AS ino, CASE WHEN user_id % 8 = 0 THEN NULL ELSE (user_id % 5) / 20 END AS dose FROM hourly GROUP BY 1))""")


@query("organ_score", ORGAN)
def organ_score(spark, d):
    """Six organ scores with the support cap and the dose rules."""
    at = lambda f, s, c: f(F.when(F.col("signal") == s, F.col(c)))
    g = B.binned(spark, d).groupBy("user_id").agg(at(F.max, "view", "bin_max").alias("respiration"), (at(F.min, "click", "bin_min") * 20).alias("coagulation"),
        at(F.min, "error", "bin_min").alias("liver"), (F.count(F.lit(1)) % 16).cast("double").alias("nervous"))
    u = F.col("user_id")
    g = g.withColumns({"renal": F.col("liver") / 2, "map_min": F.col("respiration"), "support": (u % 2).cast("int"), "vasopressor": (u % 4 == 0).cast("int"), "inotrope": (u % 3 == 0).cast("int"), "dose": F.when(u % 8 != 0, (u % 5) / 20.0)})
    return V.organ_score(g).select("user_id", "organ_score", "organs_present")


_POINTS = {
    **{f"pts_{v}": f"{s} * 2" if v == "creatinine" else s for v, s in _A.items()},
    "pts_oxygen": f"CASE WHEN fio2 >= 50 THEN {_case('gradient', *V.GRADIENT_BAND)} ELSE {_case('pao2', *V.PAO2_BAND)} END",
    "pts_gcs": "CASE WHEN gcs BETWEEN 3 AND 15 THEN 15 - gcs END",
}
POINTS = B.sql(B.RAW + f""",
given AS (SELECT user_id, min(bin_min) AS lo, max(bin_max) AS hi, (count(*) % 16)::INT AS gcs, min(bin_med) FILTER (signal = 'view') AS fio2, max(bin_med) FILTER (signal = 'click') AS gradient,
  min(bin_max) FILTER (signal = 'error') AS pao2 FROM hourly GROUP BY 1),
pts AS (SELECT {', '.join(f'({s})::DOUBLE AS {n}' for n, s in _POINTS.items())} FROM given)""",
    f"SELECT item, avg((points IS NOT NULL)::INT) AS present, avg(points) AS mean_points, avg((points > 0)::INT) AS above_zero FROM (SELECT * FROM pts UNPIVOT INCLUDE NULLS (points FOR item IN ({', '.join(_POINTS)}))) GROUP BY 1", "present mean_points above_zero")


@query("points_table", POINTS)
def points_table(spark, d):
    """Presence and points of every item."""
    s = V.acute_score(_inputs(spark, d))
    return B.rounded(V.points_table(s, [c for c in s.columns if c.startswith("pts_")]))


AGREE = f"""SELECT 'a~b' AS pair, count(*) AS n, avg((a = b)::INT) AS exact, avg((abs(a - b) <= 1)::INT) AS within_one, avg(abs(a - b)) AS mad, corr(a, b) AS pearson, corr(ra, rb) AS spearman
FROM (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM (SELECT l_linenumber::DOUBLE AS a, (l_quantity % 7)::DOUBLE AS b FROM lineitem))"""


@query("score_agreement", B.sql("", "SELECT pair, n, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("exact", "within_one", "mad", "pearson", "spearman")) + f" FROM ({AGREE})"))
def score_agreement(spark, d):
    """Agreement of two scores."""
    l = S.scan(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("a"), (F.col("l_quantity") % 7).alias("b"))
    return B.rounded(V.agreement(l, [("a", "b")]))


@query("recalibrated_score")
def recalibrated_score(spark, d):
    """Cross-fitted recalibration of a band score."""
    s = V.acute_score(_inputs(spark, d)).select("user_id", "acute_score").join(B.people(spark, d).select("user_id", "y", "fold"), "user_id")
    return B.rounded(V.recalibrated(s, "acute_score", "y", "fold"))


@query("domain_sums", B.sql(B.EVIDENCE, "SELECT user_id, coalesce(domain, 'uncovered') AS domain, sum(l) AS l FROM evidence LEFT JOIN domains USING (signal) GROUP BY ALL", "l"))
def domain_sums(spark, d):
    """Evidence by domain."""
    return B.rounded(V.by_domain(B.evidence(spark, d), B.domains(spark), "user_id"))


@query("column_contract")
def column_contract(spark, d):
    """Q1."""
    return Q.columns_check(B.events(spark, d), "events", ["event_id", "ts", "user_id", "event_type", "value", "props", "site"])


@query("dependency_check", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_values, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def dependency_check(spark, d):
    """Q3."""
    return Q.dependency(S.scan(spark, d, "lineitem"), "l_suppkey", "l_partkey")


PAIRS = [("A", "F"), ("N", "O"), ("R", "F"), ("R", "X")]


@query("pair_grid", f"WITH d(l_returnflag, l_linestatus) AS (VALUES {', '.join(str(p) for p in PAIRS)}), o AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) SELECT *, 'observed_only' AS side FROM o ANTI JOIN d USING (l_returnflag, l_linestatus) UNION ALL SELECT *, 'declared_only' FROM d ANTI JOIN o USING (l_returnflag, l_linestatus)")
def pair_grid(spark, d):
    """Q4, S10."""
    return Q.pair_grid(S.scan(spark, d, "lineitem"), S.spec_table(spark, PAIRS, "l_returnflag string, l_linestatus string"), ["l_returnflag", "l_linestatus"])


CHECKS = B.sql(B.GRID, """SELECT unnest(['counts_add_up', 'null_when_missing', 'bins_in_window', 'trend_without_flag']) AS "check", 'features' AS "table", unnest([count_if(n_obs <> k_low + k_mid + k_high), count_if(missing = 1 AND q05 IS NOT NULL), count_if(n_obs > 24), count_if(trend_defined = 0 AND trend <> 0)])::BIGINT AS failures FROM grid""")


@query("row_checks", f"SELECT *, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({CHECKS})")
def row_checks(spark, d):
    """Q5, Q6, Q7, Q8, Q17: conditional nulls, counts and ranges in one pass."""
    c = F.col
    return B.rounded(Q.counted(B.feature_grid(spark, d), "features", {
        "counts_add_up": c("n_obs") != c("k_low") + c("k_mid") + c("k_high"), "null_when_missing": (c("missing") == 1) & c("q05").isNotNull(),
        "bins_in_window": c("n_obs") > 24, "trend_without_flag": (c("trend_defined") == 0) & (c("trend") != 0)}))


@query("grid_check", B.sql(B.GRID, "SELECT count(*) AS keys, sum(dup)::BIGINT AS repeated, count_if(n <> 5) AS incomplete FROM (SELECT user_id, count(*) - count(DISTINCT signal) AS dup, count(DISTINCT signal) AS n FROM grid GROUP BY 1)"))
def grid_check(spark, d):
    """Q6: dense grid."""
    return B.rounded(Q.grid_check(B.feature_grid(spark, d), "user_id", "signal", 5))


@query("orphans", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def orphans(spark, d):
    """Q6: referential integrity."""
    return Q.orphans(S.scan(spark, d, "lineitem"), S.scan(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("site_signatures")
def site_signatures(spark, d):
    """Q10: schema and level sets of two sites."""
    e = B.events(spark, d)
    return Q.same_signature(Q.signature(e.filter("user_id % 2 = 0").drop("props"), ["event_type"]), Q.signature(e.filter("user_id % 2 = 1"), ["event_type"]))


REPORT = f"""SELECT 'columns' AS "check", 'events' AS "table", CASE WHEN count(*) = 6 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS c) d JOIN (SELECT column_name AS c FROM (DESCRIBE events)) USING (c)
UNION ALL SELECT 'orphan_users', 'site', CASE WHEN count_if(user_id IS NULL) = 0 THEN 'PASS' ELSE 'WARN' END FROM events
UNION ALL SELECT 'broken', 'site', 'ERROR AnalysisException'
UNION ALL SELECT "check", "table", CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END FROM ({CHECKS})"""


@query("check_report", REPORT)
def check_report(spark, d):
    """Q11, Q19: all checks in one report; a failing job becomes a row."""
    e = B.events(spark, d)
    jobs = {"orphan_users": lambda: e.filter("user_id is null"), "broken": lambda: e.select("no_such_column")}
    return Q.report([Q.columns_check(e, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]), Q.captured(spark, jobs), row_checks(spark, d).select("check", "table", "status")])


@query("resampling_column", B.sql(B.PEOPLE, "SELECT count(*) AS rows, count(DISTINCT user_id) AS groups, count(DISTINCT y) AS strata, 0::BIGINT AS null_group, 0::BIGINT AS null_stratum FROM people"))
def resampling_column(spark, d):
    """Q12."""
    return Q.resampling_column(B.people(spark, d), "user_id", "y")


@query("tail_occupancy", B.sql(B.GRID, "SELECT signal, count_if(k_low > 0) AS low_rows, count_if(k_high > 0) AS high_rows, (count_if(k_low > 0) < 100)::BIGINT AS thin_low, (count_if(k_high > 0) < 100)::BIGINT AS thin_high FROM grid GROUP BY 1"))
def tail_occupancy(spark, d):
    """Q13."""
    return B.rounded(Q.tail_occupancy(B.feature_grid(spark, d), 100))


@query("level_sets", "WITH d AS (SELECT unnest([1, 2, 3, 4, 5, 6, 9])::INT AS l_linenumber), o AS (SELECT DISTINCT l_linenumber::INT AS l_linenumber FROM lineitem) SELECT l_linenumber::BIGINT AS l_linenumber, 'undeclared' AS side FROM o ANTI JOIN d USING (l_linenumber) UNION ALL SELECT l_linenumber, 'unseen' FROM d ANTI JOIN o USING (l_linenumber)")
def level_sets(spark, d):
    """Q2, Q14: ordinal scale both ways."""
    l = S.scan(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return B.rounded(Q.value_set(l, "l_linenumber", S.spec_table(spark, [(i,) for i in (1, 2, 3, 4, 5, 6, 9)], "l_linenumber int")))


@query("agent_pool", B.sql(B.RAW, "SELECT signal, max(n) AS largest, 30::BIGINT AS pool, (max(n) <= 30)::BIGINT AS ok FROM (SELECT signal, user_id, count(*) AS n FROM raw GROUP BY ALL) GROUP BY 1"))
def agent_pool(spark, d):
    """Q15."""
    n = B.raw(spark, d).groupBy("signal", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return B.rounded(Q.pool_check(n, S.spec_table(spark, [(s, 30) for s in B.SIGNALS], "signal string, pool int"), "signal", "n"))


@query("basis_room", B.sql(B.GRID, "SELECT signal, covariate, count(DISTINCT x) AS values, (count(DISTINCT x) >= 10)::BIGINT AS feasible FROM (SELECT signal, n_obs::DOUBLE AS n_obs, k_low::DOUBLE AS k_low, k_high::DOUBLE AS k_high FROM grid) UNPIVOT (x FOR covariate IN (n_obs, k_low, k_high)) GROUP BY ALL"))
def basis_room(spark, d):
    """Q16."""
    return B.rounded(Q.basis_room(B.feature_grid(spark, d), "signal", ["n_obs", "k_low", "k_high"], 10))


@query("shared_invariance", B.sql(B.GRID, "SELECT count(*) AS keys, count_if(d > 0) AS differ, max(d) AS largest FROM (SELECT user_id, max(n_masked) - min(n_masked) AS d FROM grid GROUP BY 1)"))
def shared_invariance(spark, d):
    """Q18."""
    return B.rounded(Q.shared_invariance(B.feature_grid(spark, d), ["user_id"], "n_masked"))


@query("table_equality", B.sql(B.GRID, "SELECT signal, count_if(b IS NULL) AS only_a, count_if(a IS NULL) AS only_b, round(max(abs(a - b)), 6) + 0.0 AS largest FROM (SELECT user_id, signal, value_max AS a FROM grid WHERE n_obs > 2) FULL JOIN (SELECT user_id, signal, value_median AS b FROM grid WHERE n_obs > 3) USING (user_id, signal) GROUP BY 1"))
def table_equality(spark, d):
    """Q22: two runs compared on keys and values."""
    g = B.feature_grid(spark, d)
    return B.rounded(Q.same_tables(g.filter("n_obs > 2").select("user_id", "signal", F.col("value_max").alias("v")), g.filter("n_obs > 3").select("user_id", "signal", F.col("value_median").alias("v")), ["user_id", "signal"], "v", "signal"))


SPLIT = B.PEOPLE + f""",
gr AS (SELECT user_id, max(y) AS stratum, count(*) AS rows, {B.UNIFORM.format("concat_ws('|', 3, user_id)")} AS u FROM events JOIN people USING (user_id) GROUP BY 1),
split AS (SELECT user_id, stratum, rows, CASE WHEN coalesce(sum(rows) OVER (PARTITION BY stratum ORDER BY u, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.8 * sum(rows) OVER (PARTITION BY stratum) THEN 'train' ELSE 'test' END AS split FROM gr),
fd AS (SELECT user_id, stratum, rows, ((row_number() OVER (PARTITION BY stratum ORDER BY {B.UNIFORM.format("concat_ws('|', 4, 'fold', user_id)")}, user_id) - 1) % 5 + 1)::BIGINT AS fold FROM split WHERE split = 'train')"""


def _groups(spark, d):
    rows = B.events(spark, d).join(B.people(spark, d).select("user_id", "y"), "user_id")
    return rows, resampling.grouped_split(rows, "user_id", "y", 0.8, 3)


@query("grouped_split", B.sql(SPLIT, "SELECT user_id, stratum::BIGINT AS stratum, rows, split FROM split"))
def grouped_split(spark, d):
    """Stratified split of whole groups."""
    return B.rounded(_groups(spark, d)[1])


def _folds(spark, d):
    rows, g = _groups(spark, d)
    return rows.join(resampling.grouped_folds(g.filter("split = 'train'"), "user_id", 5, 4).select("user_id", "fold"), "user_id")


@query("fold_summary", B.sql(SPLIT, "SELECT fold, count(*) AS rows, count(DISTINCT user_id) AS groups, sum(y)::BIGINT AS events, avg(y) AS rate FROM events JOIN people p USING (user_id) JOIN (SELECT user_id, fold FROM fd) f USING (user_id) GROUP BY 1".replace("SELECT fold", "SELECT f.fold"), "rate"))
def fold_summary(spark, d):
    """Folds within train."""
    return B.rounded(resampling.fold_summary(_folds(spark, d), "user_id", "y"))


FOLD_CHECKS = B.sql(SPLIT + """,
fr AS (SELECT e.user_id, p.y, f.fold FROM events e JOIN people p ON p.user_id = e.user_id JOIN fd f ON f.user_id = e.user_id),
per AS (SELECT fold, avg(y) AS r FROM fr GROUP BY 1)""", """SELECT (SELECT count_if(f > 1)::BIGINT FROM (SELECT user_id, count(DISTINCT fold) AS f FROM fr GROUP BY 1)) AS straddling,
  (SELECT count(*) FROM per) AS folds, (SELECT count_if(abs(r - (SELECT avg(y) FROM fr)) > 0.02)::BIGINT FROM per) AS off_rate""")


@query("fold_checks", FOLD_CHECKS)
def fold_checks(spark, d):
    """P4."""
    return B.rounded(resampling.fold_checks(_folds(spark, d), "user_id", "y", 0.02))


def poisson_sql(u: str) -> str:
    from ..functions.scalars import POISSON_CDF

    return "(" + " + ".join(f"({u} >= {c!r})::INT" for c in POISSON_CDF) + ")::BIGINT"


@query("bootstrap_units", f"SELECT c_custkey, b, w FROM (SELECT c_custkey, b, {poisson_sql('u')} AS w FROM (SELECT c_custkey, b, {B.UNIFORM.format(chr(39).join(['concat_ws(', '|', ', 9, b, c_custkey)']))} AS u FROM customer, range(1, 11) r(b))) WHERE w > 0")
def bootstrap_units(spark, d):
    """Poisson weights of whole units."""
    return B.rounded(resampling.bootstrap_units(S.scan(spark, d, "customer"), "c_custkey", 10, 9))


@query("bags", f"SELECT c_custkey, bag FROM customer, range(1, 5) r(bag) WHERE {B.UNIFORM.format(chr(39).join(['concat_ws(', '|', ', 9, ', 'bag', ', bag, c_custkey)']))} < 0.6321205588285577")
def bags(spark, d):
    """Bag members."""
    return B.rounded(resampling.bags(S.scan(spark, d, "customer"), "c_custkey", 4, 9))


@query("halves", f"SELECT c_custkey, CASE WHEN {B.UNIFORM.format(chr(39).join(['concat_ws(', '|', ', 9, ', 'half', ', c_custkey)']))} < 0.5 THEN 1 ELSE 2 END::BIGINT AS half FROM customer")
def halves(spark, d):
    """Disjoint halves."""
    return B.rounded(resampling.halves(S.scan(spark, d, "customer"), "c_custkey", 9))


@query("sampled_pairs", f"SELECT a, b FROM (SELECT DISTINCT l_linenumber::BIGINT AS a FROM lineitem) x, (SELECT DISTINCT l_linenumber::BIGINT AS b FROM lineitem) y WHERE a < b ORDER BY {B.UNIFORM.format(chr(39).join(['concat_ws(', '|', ', 2, a, b)']))}, a, b LIMIT 10")
def sampled_pairs(spark, d):
    """A seeded sample of replicate pairs."""
    return resampling.sampled_pairs(S.scan(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("m")).distinct(), "m", 10, 2)
