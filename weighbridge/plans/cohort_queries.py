"""Queries: scans, cohort, lattices and interventions (S, C, I, G)."""

from pyspark.sql import functions as F

from ..functions.scalars import capped_age, first_match, minute_offset, number_in, plausible
from ..operators import cohort, lattice, signals
from ..sources import tables as S
from . import base as B
from .registry import query


@query("first_order", "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_order(spark, d):
    """First order of every customer."""
    return B.rounded(cohort.first_row(S.scan(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice"))


LANDMARK = B.sql(B.PEOPLE, """SELECT user_id, epoch_us(landmark) // 1000000 AS landmark_s, y::BIGINT AS event, greatest(date_sub('hour', landmark, coalesce(event_at, last_ts)), 0)::BIGINT AS follow_up_hours,
  date_sub('hour', landmark, event_at)::BIGINT AS hours_to_event FROM people WHERE last_ts >= landmark""")


@query("landmark_cohort", LANDMARK)
def landmark_cohort(spark, d):
    """Followed to the landmark, survival from there."""
    c = cohort.included(B.people(spark, d), [F.col("last_ts") >= F.col("landmark")])
    c = cohort.survival(c, "event_at", "last_ts")
    return B.rounded(c.select("user_id", F.unix_seconds(F.col("landmark").cast("timestamp")).alias("landmark_s"), "event", "follow_up_hours", "hours_to_event"))


def _criteria():
    return [("priced", F.col("o_totalprice") > 0), ("open", F.col("o_orderstatus").isin("O", "F")), ("urgent", F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")), ("large", F.col("o_totalprice") > 100000)]


LADDER = """SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS step, unnest(['all', 'priced', 'open', 'urgent', 'large']) AS name, unnest([count(*), count_if(a), count_if(a AND b), count_if(a AND b AND c), count_if(a AND b AND c AND e)])::BIGINT AS n
FROM (SELECT coalesce(o_totalprice > 0, false) a, coalesce(o_orderstatus IN ('O', 'F'), false) b, coalesce(o_orderpriority[1] IN ('1', '2'), false) c, coalesce(o_totalprice > 100000, false) e FROM orders)"""


@query("attrition_ladder", LADDER)
def attrition_ladder(spark, d):
    """Rows left after each criterion."""
    return B.rounded(cohort.ladder(S.scan(spark, d, "orders"), _criteria()))


@query("ladder_reconciled", "SELECT n AS ladder_end, n AS stored, 1::BIGINT AS agrees FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority[1] IN ('1', '2'))")
def ladder_reconciled(spark, d):
    """C11: the ladder's end against the stored cohort."""
    o = S.scan(spark, d, "orders")
    return B.rounded(cohort.reconciled(cohort.ladder(o, _criteria()), cohort.included(o, [c for _, c in _criteria()])))


@query("surrogate_key", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name)::BIGINT AS key FROM customer")
def surrogate_key(spark, d):
    """Dense key of a text id."""
    return cohort.dense_key(S.scan(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "key").select("c_custkey", "key")


@query("cohort_audit", B.sql(B.PEOPLE, "SELECT site, count(*) AS n, sum(y)::BIGINT AS events, avg(y) AS rate, sum((last_ts < landmark)::INT)::BIGINT AS short FROM people GROUP BY 1", "rate"))
def cohort_audit(spark, d):
    """Audit by site with a data-quality flag."""
    return B.rounded(cohort.audit(B.people(spark, d).withColumn("short", F.col("last_ts") < F.col("landmark")), ["site"], "y", ["short"]))


GROUPS = """SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, count(*) AS copies, CASE WHEN count(DISTINCT l_returnflag) = 0 OR count_if(l_returnflag IS NULL) > 0 THEN 'missing' WHEN count(DISTINCT l_returnflag) > 1 THEN 'conflict' ELSE 'ok' END AS status FROM lineitem GROUP BY 1"""


@query("group_table", GROUPS)
def group_table(spark, d):
    """Order -> return flag, conflicts shown."""
    return S.group_table(S.scan(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag")


@query("group_match", "SELECT count_if(l AND r) AS matched, count_if(r IS NULL) AS without_group, count_if(l IS NULL) AS without_key FROM (SELECT DISTINCT o_orderkey AS k, true AS l FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS k, true AS r FROM lineitem) USING (k)")
def group_match(spark, d):
    """Keys matched both ways."""
    return S.match_counts(S.scan(spark, d, "orders").select(F.col("o_orderkey").alias("k")), S.scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("vocabulary", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def vocabulary(spark, d):
    """Values outside a closed vocabulary."""
    return S.outside_vocabulary(B.events(spark, d), "event_type", ["click", "view", "purchase"])


@query("load_guards", "SELECT sum((NOT c_acctbal BETWEEN 0 AND 9000)::INT)::BIGINT AS c_acctbal, sum((NOT c_nationkey BETWEEN 0 AND 20)::INT)::BIGINT AS c_nationkey FROM customer")
def load_guards(spark, d):
    """Implausible values nulled and counted in one pass."""
    return S.null_outside(S.stamp_site(S.scan(spark, d, "customer"), "a"), {"c_acctbal": (0, 9000), "c_nationkey": (0, 20)})[1]


@query("plausible_values", "SELECT c_custkey, round(CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END, 6) + 0.0 AS balance FROM customer")
def plausible_values(spark, d):
    """Plausibility range."""
    return B.rounded(S.stamp_site(S.scan(spark, d, "customer"), "a").select("c_custkey", plausible(F.col("c_acctbal"), 0, 9000).alias("balance")))


@query("text_numbers", "SELECT p_partkey, CASE WHEN n > 30 THEN 90 ELSE least(n, 90) END::BIGINT AS age, n::DOUBLE AS brand_no, '2000-01-01 00:00:00'::TIMESTAMP::DATE::VARCHAR AS epoch_day, epoch('2000-01-01'::TIMESTAMP)::BIGINT + 60 * n AS offset_s FROM (SELECT p_partkey, regexp_extract(p_brand, '#(\\d+)', 1)::BIGINT AS n FROM part)")
def text_numbers(spark, d):
    """Numbers out of text, capped age, minute offsets."""
    p = S.scan(spark, d, "part").withColumn("n", number_in(F.col("p_brand"), r"#(\d+)"))
    age = capped_age(F.when(F.col("n") > 30, "> 89").otherwise(F.col("n").cast("long").cast("string")))
    at = minute_offset(F.col("n").cast("int"))
    return B.rounded(p.select("p_partkey", age.alias("age"), F.col("n").alias("brand_no"), F.date_format(minute_offset(F.lit(0)), "yyyy-MM-dd").alias("epoch_day"), F.unix_seconds(at.cast("timestamp")).alias("offset_s")))


RULES = [("brass", "soft"), ("steel", "hard"), ("copper", "soft"), ("tin", "light")]


@query("ordered_rules", "SELECT p_partkey, CASE " + " ".join(f"WHEN lower(p_type) LIKE '%{p}%' THEN '{c}'" for p, c in RULES) + " END AS class FROM part")
def ordered_rules(spark, d):
    """First matching substring wins; rules are data."""
    return S.scan(spark, d, "part").select("p_partkey", first_match(F.col("p_type"), RULES).alias("class"))


@query("windowed_scan", B.sql(B.PEOPLE, "SELECT user_id, count(*) AS n FROM events JOIN people USING (user_id) WHERE ts >= intime AND ts < landmark GROUP BY 1"))
def windowed_scan(spark, d):
    """Source rows inside each member's own window."""
    return S.windowed_scan(B.events(spark, d), B.people(spark, d), "user_id", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("fingerprint")
def fingerprint(spark, d):
    """Content hash of an input."""
    return S.fingerprint(B.events(spark, d))


@query("bin_spine", B.sql(B.RAW, "SELECT p.user_id, b.bin::BIGINT AS bin, count(r.value) AS n FROM people p CROSS JOIN range(24) b(bin) LEFT JOIN raw r ON r.user_id = p.user_id AND r.bin = b.bin GROUP BY ALL"))
def bin_spine(spark, d):
    """All bins of every entity with the points in each."""
    points = B.raw(spark, d).groupBy("user_id", "bin").agg(F.count("value").alias("n"))
    return B.rounded(lattice.spine(B.people(spark, d), "user_id", B.BINS).join(points, ["user_id", "bin"], "left").fillna(0, ["n"]))


@query("interval_bins", B.sql(B.ACTIVE, "SELECT user_id, bin::BIGINT AS bin, intensity FROM pressor", "intensity"))
def interval_bins(spark, d):
    """Carried-forward intervals on the lattice, largest intensity per bin."""
    return B.rounded(B.pressor_bins(spark, d).select("user_id", "bin", "intensity"))


LATTICE = B.sql(B.ACTIVE, "SELECT user_id, 'pressor' AS intervention, bin::BIGINT AS bin, 'state' AS shape, intensity, 1::BIGINT AS active FROM pressor UNION ALL SELECT user_id, 'intake', bin, 'event', intensity, 1 FROM intake", "intensity")


def _lattice(spark, d):
    cols = ["user_id", "intervention", "bin", "shape", "intensity", "active"]
    return B.pressor_bins(spark, d).select(cols).unionByName(B.signup_bins(spark, d).select(cols))


@query("intervention_lattice", LATTICE)
def intervention_lattice(spark, d):
    """States and events in one long lattice."""
    return B.rounded(_lattice(spark, d))


INTERVENTION_FEATURES = B.sql(B.ACTIVE, """
SELECT p.user_id, d.intervention, d.shape, (r.n IS NOT NULL)::BIGINT AS ever_active, CASE WHEN shape = 'state' THEN coalesce(n, 0) / 24 END AS exposure, CASE WHEN shape = 'event' THEN coalesce(n, 0) END AS event_bins,
  CASE WHEN shape = 'event' THEN coalesce(total, 0) END AS event_total, peak, first_bin::BIGINT AS first_bin, coalesce(at0, 0)::BIGINT AS at_admission
FROM people p CROSS JOIN (VALUES ('pressor', 'state'), ('intake', 'event')) d(intervention, shape) LEFT JOIN (
  SELECT user_id, intervention, count(DISTINCT bin) AS n, sum(intensity) AS total, max(intensity) AS peak, min(bin) AS first_bin, max((bin = 0)::INT) AS at0
  FROM (SELECT *, 'pressor' AS intervention FROM pressor UNION ALL SELECT *, 'intake' FROM intake) GROUP BY ALL) r USING (user_id, intervention)""", "exposure event_total peak")


@query("intervention_features", INTERVENTION_FEATURES)
def intervention_features(spark, d):
    """Dense grid, roll-up, applicability by shape."""
    declared = spark.createDataFrame([("pressor", "state"), ("intake", "event")], "intervention string, shape string")
    g = lattice.completed(B.people(spark, d), "user_id", declared, "intervention", lattice.rolled_up(_lattice(spark, d), ["user_id", "intervention"]))
    g = lattice.by_shape(g, B.BINS)
    return B.rounded(g.select("user_id", "intervention", "shape", "ever_active", "exposure", "event_bins", "event_total", "peak", "first_bin", "at_admission"))


@query("onset_state", B.sql(B.RAW, "SELECT user_id, unnest(range(f, 24))::BIGINT AS bin FROM (SELECT user_id, min(bin) AS f FROM raw WHERE signal = 'error' AND value > 150 AND bin BETWEEN 0 AND 23 GROUP BY 1)"))
def onset_state(spark, d):
    """Active from the first onset to the end."""
    return B.rounded(lattice.onset_to_end(B.raw(spark, d).filter("signal = 'error' and value > 150 and bin between 0 and 23"), "user_id", "bin", B.BINS))


@query("agent_concurrency", B.sql(B.RAW, "SELECT user_id, n_agents, has_reference::BIGINT AS has_reference, max_concurrent FROM (SELECT user_id, count(DISTINCT signal) AS n_agents, max((signal = 'click')::INT) AS has_reference FROM raw WHERE value > 100 GROUP BY 1) JOIN (SELECT user_id, max(k) AS max_concurrent FROM (SELECT user_id, bin, count(DISTINCT signal) AS k FROM raw WHERE value > 100 GROUP BY ALL) GROUP BY 1) USING (user_id)"))
def agent_concurrency(spark, d):
    """Agents per entity and at most in one bin."""
    a = B.raw(spark, d).filter("value > 100")
    return B.rounded(lattice.agent_counts(a, ["user_id"], "signal", "click").join(lattice.max_concurrency(a, ["user_id"], "signal"), "user_id"))


@query("state_precedence", B.sql(B.RAW, "SELECT user_id, bin::BIGINT AS bin, CASE WHEN max((signal = 'error')::INT) = 1 THEN 'error' WHEN max((signal = 'purchase')::INT) = 1 THEN 'purchase' ELSE 'view' END AS signal FROM raw WHERE signal IN ('error', 'purchase', 'view') GROUP BY ALL"))
def state_precedence(spark, d):
    """Strongest state per bin."""
    return B.rounded(lattice.precedence(B.raw(spark, d), ["user_id", "bin"], "signal", ["error", "purchase", "view"]))


@query("presence_dose", B.sql(B.RAW, "SELECT a.user_id, a.bin::BIGINT AS bin, round(b.v, 6) + 0.0 AS intensity FROM (SELECT DISTINCT user_id, bin FROM raw WHERE signal = 'purchase') a LEFT JOIN (SELECT user_id, bin, max(value) AS v FROM raw WHERE signal = 'signup' GROUP BY ALL) b USING (user_id, bin)"))
def presence_dose(spark, d):
    """Presence from one source, dose from another."""
    r = B.raw(spark, d)
    return B.rounded(lattice.presence_with_dose(r.filter("signal = 'purchase'"), r.filter("signal = 'signup'").withColumn("dose", F.col("value")), ["user_id", "bin"]))


@query("source_fallback", B.sql(B.RAW, "SELECT user_id, bin::BIGINT AS bin, round(max(value), 6) + 0.0 AS value FROM (SELECT * FROM raw WHERE signal = 'signup' UNION ALL SELECT r.* FROM raw r WHERE signal = 'view' AND user_id NOT IN (SELECT user_id FROM raw WHERE signal = 'signup')) GROUP BY ALL"))
def source_fallback(spark, d):
    """Second source only where the first has nothing."""
    r = B.raw(spark, d)
    return B.rounded(lattice.fallback(r.filter("signal = 'signup'"), r.filter("signal = 'view'"), "user_id").groupBy("user_id", "bin").agg(F.max("value").alias("value")))


@query("equivalent_dose", "SELECT l_orderkey, sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 END * l_tax) AS dose FROM lineitem GROUP BY 1".replace("sum(",
    "round(sum(").replace("* l_tax) AS", "* l_tax), 6) + 0.0 AS"))
def equivalent_dose(spark, d):
    """Unit factor times potency, summed; unknown units add nothing."""
    return B.rounded(lattice.equivalent_dose(S.scan(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_returnflag", {"A": 1.0, "N": 0.5}, "l_tax"))


@query("modal_value", "SELECT l_suppkey, l_quantity, n FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1")
def modal_value(spark, d):
    """Commonest value, ties to the smaller."""
    return lattice.modal(S.scan(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("end_ladder", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(greatest(coalesce(CASE WHEN l_returnflag = 'R' THEN q + 30 END, CASE WHEN l_linestatus = 'O' THEN q * 20 END, 1440), q + 60), 1440) AS end_at, CASE WHEN p BETWEEN 5 AND 100 THEN round(p, 6) + 0.0 END AS percent FROM (SELECT *, l_quantity::BIGINT AS q, CASE WHEN l_discount <= 1 THEN l_discount * 100 ELSE l_discount END AS p FROM lineitem)")
def end_ladder(spark, d):
    """End-time ladder and fraction to percent."""
    q = F.col("l_quantity").cast("long")
    end = lattice.end_ladder(q, [F.when(F.col("l_returnflag") == "R", q + 30), F.when(F.col("l_linestatus") == "O", q * 20)], 60, 1440)
    return B.rounded(S.scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", end.cast("long").alias("end_at"), lattice.as_percent(F.col("l_discount"), 5, 100).alias("percent")))


@query("unpivot_measures", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, signal, round(value, 6) + 0.0 AS value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR signal IN (l_quantity, l_extendedprice, l_discount, l_tax))")
def unpivot_measures(spark, d):
    """G1: wide to long."""
    return B.rounded(signals.long_values(S.scan(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("binned_signals", B.sql(B.RAW, "SELECT user_id, signal, bin::BIGINT AS bin, n_raw, bin_min, bin_med, bin_max FROM hourly", "bin_min bin_med bin_max"))
def binned_signals(spark, d):
    """Bounded values on the lattice."""
    return B.rounded(B.binned(spark, d))


@query("rate_signal", B.sql(B.RAW, "SELECT user_id, bin::BIGINT AS bin, rate FROM (SELECT user_id, bin, greatest(sum(value), 0) / w AS rate FROM raw JOIN (SELECT user_id, max(value) AS w FROM raw WHERE signal = 'view' GROUP BY 1) USING (user_id) WHERE signal = 'signup' GROUP BY user_id, bin, w) WHERE rate BETWEEN 0 AND 20", "rate"))
def rate_signal(spark, d):
    """Volume over weight."""
    r = B.raw(spark, d)
    return B.rounded(signals.rate_signal(r.filter("signal = 'signup'"), r.filter("signal = 'view'").groupBy("user_id").agg(F.max("value").alias("weight")), "user_id", 0, 20))


@query("unit_bands", B.sql(B.RAW, "SELECT user_id, signal, CASE WHEN value BETWEEN 90 AND 110 THEN (value - 32) * (5 / 9.0) ELSE value END AS value FROM raw", "value"))
def unit_bands(spark, d):
    """Values in another unit's band are converted."""
    return B.rounded(B.raw(spark, d).select("user_id", "signal", signals.converted(F.col("value"), 90, 110, 5 / 9.0, 32.0).alias("value")))


@query("ordinal_components", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, signal, value::BIGINT AS value FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity::INT % 7 END AS verbal, l_suppkey::INT % 6 AS motor, l_partkey::INT % 5 AS eyes FROM lineitem) UNPIVOT (value FOR signal IN (verbal, motor, eyes)) WHERE (signal = 'verbal' AND value BETWEEN 1 AND 5) OR (signal = 'motor' AND value BETWEEN 1 AND 6) OR (signal = 'eyes' AND value BETWEEN 1 AND 4)")
def ordinal_components(spark, d):
    """Bounded ordinal components, one dropped where unassessable."""
    l = S.scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 7).alias("verbal"),
        (F.col("l_suppkey").cast("int") % 6).alias("motor"), (F.col("l_partkey").cast("int") % 5).alias("eyes"), (F.col("l_returnflag") == "R").cast("int").alias("unable"))
    return B.rounded(signals.components(l, ["l_orderkey", "l_linenumber"], {"verbal": (1, 5), "motor": (1, 6), "eyes": (1, 4)}, "unable"))


@query("unable_share", "SELECT c.c_custkey, coalesce(n, 0) AS n, coalesce(u, 0) AS unable, round(u / n, 6) + 0.0 AS share, (coalesce(u, 0) > 0)::BIGINT AS ever FROM customer c LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, count_if(o_orderstatus = 'P') AS u FROM orders GROUP BY 1) USING (c_custkey)")
def unable_share(spark, d):
    """Left join keeps entities without any assessment."""
    m = S.scan(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "P").cast("int").alias("flag"))
    return B.rounded(signals.unable_share(S.scan(spark, d, "customer"), m, "c_custkey", "flag"))


AUDIT = B.sql(B.RAW, "SELECT signal, count(*) AS keys, quantile_disc(bins, 0.25) AS q25, quantile_disc(bins, 0.5) AS q50, quantile_disc(bins, 0.75) AS q75, min(lo) AS low, max(hi) AS high, sum(raw)::BIGINT AS raw FROM (SELECT user_id, signal, count(*) AS bins, min(bin_min) AS lo, max(bin_max) AS hi, sum(n_raw) AS raw FROM hourly GROUP BY ALL) GROUP BY 1", "low high")


@query("signal_audit", AUDIT)
def signal_audit(spark, d):
    """Coverage quartiles and ranges."""
    return B.rounded(signals.coverage_audit(B.binned(spark, d), "user_id"))


@query("rejection_audit", B.sql(B.RAW, "SELECT signal, count(*) AS n, count_if(NOT value BETWEEN low AND high) AS rejected, avg((NOT value BETWEEN low AND high)::INT) AS share FROM raw JOIN bounds USING (signal) GROUP BY 1", "share"))
def rejection_audit(spark, d):
    """Share outside bounds."""
    return B.rounded(signals.rejection_audit(B.raw(spark, d), B.bounds(spark)))


@query("intervention_audit", B.sql(B.ACTIVE, "SELECT 'pressor' AS intervention, count(DISTINCT user_id) AS users, count(*) AS bins, avg(intensity) AS mean_intensity FROM pressor", "mean_intensity"))
def intervention_audit(spark, d):
    """Prevalence and mean intensity."""
    return B.rounded(B.pressor_bins(spark, d).groupBy("intervention").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("bins"), F.avg("intensity").alias("mean_intensity")))
