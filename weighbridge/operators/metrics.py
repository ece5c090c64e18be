"""Score metrics and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percentiles, prefix_sums
from ..sources.tables import scan_once, shared_path


def discrimination(scores: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """N, events, AUROC (mid-rank), AUPRC (tie blocks) and lift per key group.

    scores: keys, score, y. Rows become distinct scores first, then prefix sums
    dealt over buckets; every group of every arm is ranked in the same job.
    """
    w = F.col(weight) if weight else F.lit(1)
    cells = scores.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("neg"))
    ranked = prefix_sums(cells, keys, "score", ["pos", "neg"])
    totals = cells.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = ranked.join(totals, keys) if keys else ranked.crossJoin(totals)
    tp, fp = F.col("P") - F.col("before_pos"), F.col("N") - F.col("before_neg")  # at or above this score
    out = r.groupBy(*keys, "P", "N").agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)).alias("_u"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0)).alias("_a"),
    )
    base = F.col("P") / (F.col("P") + F.col("N"))
    auprc = F.try_divide("_a", "P")
    return out.select(*keys, (F.col("P") + F.col("N")).cast("long").alias("n"), F.col("P").cast("long").alias("events"), base.alias("rate"),
        F.try_divide(F.col("_u"), F.col("P") * F.col("N")).alias("auroc"), auprc.alias("auprc"), F.try_divide(auprc, base).alias("lift"))


def with_intervals(scores: DataFrame, keys: list[str], unit: str, units: DataFrame, statistic: str = "auroc") -> DataFrame:
    """M3: the statistic with 2.5 and 97.5 % bootstrap limits; units (unit, b, w) are resampled with all their rows."""
    drawn = discrimination(scores.join(units, unit), [*keys, "b"], "w").filter(F.col(statistic).isNotNull())
    limits = drawn.groupBy(*keys).agg(F.percentile(statistic, F.lit(0.025)).alias("low"), F.percentile(statistic, F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("draws"))
    return discrimination(scores, keys).join(limits, keys, "left")


def paired_bootstrap(scores: DataFrame, arm: str, a: str, b: str, unit: str, units: DataFrame, statistic: str = "auroc") -> DataFrame:
    """M9: difference of two arms under the same weights: observed, limits and the centred two-sided p."""
    both = scores.filter(F.col(arm).isin(a, b))
    side = lambda df, x: df.filter(F.col(arm) == x)
    full = discrimination(both, [arm])
    seen = side(full, a).select(F.col(statistic).alias("va")).crossJoin(side(full, b).select(F.col(statistic).alias("vb"))).select((F.col("va") - F.col("vb")).alias("difference"))
    drawn = discrimination(both.join(units, unit), [arm, "b"], "w")
    d = side(drawn, a).select("b", F.col(statistic).alias("x")).join(side(drawn, b).select("b", F.col(statistic).alias("y")), "b").select((F.col("x") - F.col("y")).alias("d"))
    d = d.crossJoin(seen)
    return d.groupBy("difference").agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"),
        ((F.count_if(F.abs(F.col("d") - F.col("difference")) >= F.abs(F.col("difference"))) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def delong(scores: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """M4: paired AUROC difference with DeLong variance from placement values (per arm, by prefix sums)."""
    long = scores.select(key, "y", F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(c).alias("score")) for n, c in (("a", a), ("b", b))])).alias("s")).select(key, "y", "s.*")
    cells = long.groupBy("arm", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = prefix_sums(cells, ["arm"], "score", ["pos", "neg"]).join(cells.groupBy("arm").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), "arm")
    place = r.select("arm", "score", ((F.col("before_neg") + F.col("neg") / 2.0) / F.col("N")).alias("v_pos"), (1 - (F.col("before_pos") + F.col("pos") / 2.0) / F.col("P")).alias("v_neg"))
    v = long.join(place, ["arm", "score"]).withColumn("v", F.when(F.col("y") == 1, F.col("v_pos")).otherwise(F.col("v_neg")))
    wide = v.groupBy(key, "y").agg(F.max(F.when(F.col("arm") == "a", F.col("v"))).alias("va"), F.max(F.when(F.col("arm") == "b", F.col("v"))).alias("vb"))
    s = wide.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"), F.var_samp(F.col("va") - F.col("vb")).alias("vd"))
    one = s.agg(F.max(F.when(F.col("y") == 1, F.col("ma"))).alias("auc_a"), F.max(F.when(F.col("y") == 1, F.col("mb"))).alias("auc_b"), F.sum(F.col("vd") / F.col("n")).alias("variance"))
    return one.select("auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("difference"), F.sqrt("variance").alias("se"), ((F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance")).alias("z"))


def cut_points(scores: DataFrame, n_bins: int, discrete: bool = False, strict: bool = True) -> DataFrame:
    """Inner cut-points (type 7, or observed values); strict raises on repeated ones, else they are merged."""
    at = [(i + 1) / n_bins for i in range(n_bins - 1)]
    if discrete:
        out = scores.agg(F.array(*[F.expr(f"percentile_disc({p!r}) within group (order by score)") for p in at]).alias("cuts"))
    else:
        out = percentiles(scores, [], "score", at, "cuts")
    if strict:
        ok = F.size(F.array_distinct("cuts")) == F.size("cuts")
        return out.select(F.when(F.assert_true(ok, F.lit("repeated cut-points")).isNull(), F.col("cuts")).alias("cuts"))
    return out.select(F.array_distinct("cuts").alias("cuts"))


def risk_bins(scores: DataFrame, cuts: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Right-closed bins by own or frozen cut-points: n, events, rate with its Wilson interval, mean, least and largest score."""
    s = scores.crossJoin(F.broadcast(cuts)).withColumn("bin", F.expr("size(filter(cuts, c -> c < score)) + 1"))
    g = s.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.avg("score").alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("largest"))
    p, n = F.col("events") / F.col("n"), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.withColumns({"rate": p, "low": mid - half, "high": mid + half})


def monotonicity(bins: DataFrame) -> DataFrame:
    """M6: inversions between neighbouring bins, those beyond their intervals, Spearman of bin and rate, rate ratio."""
    w = Window.orderBy("bin")  # a fixed number of bins
    b = bins.withColumn("prev", F.lag("rate").over(w)).withColumn("prev_low", F.lag("low").over(w)).withColumn("rk", F.rank().over(Window.orderBy("rate")) + (F.count(F.lit(1)).over(Window.partitionBy("rate")) - 1) / 2.0)
    return b.agg(F.count(F.lit(1)).alias("bins"), F.count_if(F.col("rate") < F.col("prev")).alias("inversions"), F.count_if(F.col("high") < F.col("prev_low")).alias("significant"),
        F.corr(F.col("bin").cast("double"), "rk").alias("spearman"), F.try_divide(F.max_by("rate", "bin"), F.min_by("rate", "bin")).alias("rate_ratio"))


def calibration(scores: DataFrame, keys: list[str], iterations: int = 8) -> DataFrame:
    """Logistic intercept and slope of y on the score per group, with Wald limits.

    All groups move together: each Newton step is one grouped aggregate, whose coefficients (a row a group) are written and
    joined to the rows as their size asks for.
    """
    spark = scores.sparkSession
    rows = scan_once(scores.select(*keys, F.col("score").cast("double").alias("x"), "y"), shared_path(spark, "calibration-rows"))  # read by every step
    b = rows.groupBy(*keys).agg(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"))
    for i in range(iterations):
        t = rows.join(b, keys)
        p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("x"))))
        w, r = p * (1 - p), F.col("y") - p
        s = t.groupBy(*keys).agg(F.sum(w).alias("s0"), F.sum(w * F.col("x")).alias("s1"), F.sum(w * F.col("x") ** 2).alias("s2"), F.sum(r).alias("g0"),
            F.sum(r * F.col("x")).alias("g1"), F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
        det = F.col("s0") * F.col("s2") - F.col("s1") ** 2
        step = s.filter(det > 1e-12).select(*keys, (F.col("b0") + (F.col("s2") * F.col("g0") - F.col("s1") * F.col("g1")) / det).alias("b0"),
            (F.col("b1") + (F.col("s0") * F.col("g1") - F.col("s1") * F.col("g0")) / det).alias("b1"), F.sqrt(F.col("s0") / det).alias("se"), "n", "rate")
        if i == iterations - 1:
            break
        b = scan_once(step.select(*keys, "b0", "b1"), shared_path(spark, "calibration"))
    return step.select(*keys, "n", F.col("b0").alias("intercept"), F.col("b1").alias("slope"), (F.col("b1") - 1.96 * F.col("se")).alias("slope_low"),
        (F.col("b1") + 1.96 * F.col("se")).alias("slope_high"), F.log(F.col("rate") / (1 - F.col("rate"))).alias("expected_intercept"))


def retained(site, train, near: float = 0.01):
    """Share of the above-chance part that is kept; null where training was near chance."""
    return F.when(F.abs(train - 0.5) > near, (site - 0.5) / (train - 0.5))


def within_groups(scores: DataFrame, group: str, least_rows: int, least_events: int) -> DataFrame:
    """Metrics inside each eligible group."""
    m = discrimination(scores, [group])
    return m.withColumn("eligible", ((F.col("n") >= least_rows) & (F.col("events") >= least_events) & (F.col("events") < F.col("n"))).cast("int"))


def over_groups(per_group: DataFrame, statistic: str) -> DataFrame:
    """Distribution of a statistic over eligible groups."""
    e = per_group.filter("eligible = 1")
    q = lambda p: F.percentile(statistic, F.lit(p))
    return e.agg(F.count(F.lit(1)).alias("groups"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"))


def top_precision(scores: DataFrame, keys: list[str], key: str, fraction: float) -> DataFrame:
    """Outcome rate among the ceil(f * n) best scores, ties by key.

    The rows at the edge are found from score totals, so only one score block per group is ranked.
    """
    n = scores.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * fraction).alias("k"))
    cells = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("d")).withColumn("neg_score", -F.col("score"))
    r = prefix_sums(cells, keys, "neg_score", ["m"]).join(n, keys)
    whole = r.filter("before_m + m <= k").groupBy(*keys).agg(F.sum("d").alias("d"))
    edge = r.filter("before_m < k and before_m + m > k").select(*keys, "score", "before_m", "k")
    part = scores.join(edge, [*keys, "score"]).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(key))).filter("_rn <= k - before_m").groupBy(*keys).agg(F.sum("y").alias("e"))
    out = n.join(whole, keys, "left").join(part, keys, "left")
    return out.select(*keys, F.col("k").cast("long").alias("k"), ((F.coalesce("d", F.lit(0)) + F.coalesce("e", F.lit(0))) / F.col("k")).alias("precision"))


def normal_tail(z: str) -> str:
    """Two-sided tail of the normal law as SQL text (a published approximation of the error function, error below 1.5e-7)."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + CAST(0.3275911 AS DOUBLE) * {x}))"
    # The coefficients of that approximation.
    poly = f"((((CAST(1.061405429 AS DOUBLE) * {t} - CAST(1.453152027 AS DOUBLE)) * {t} + CAST(1.421413741 AS DOUBLE)) * {t} - CAST(0.284496736 AS DOUBLE)) * {t} + CAST(0.254829592 AS DOUBLE)) * {t}"
    return f"({poly} * exp(-{x} * {x}))"


def delong_by(scores: DataFrame, keys: list[str], key: str, a: str, b: str) -> DataFrame:
    """The paired AUROC difference of columns a and b inside every group, all groups in one job.

    scores: keys, key, y, a, b. Placement values come from prefix sums over distinct scores of a group and arm. A group without
    both classes has null areas; a difference without variance has a null z and p. Rows where a or b is unknown take no part.
    """
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(c).cast("double").alias("score")) for n, c in (("a", a), ("b", b))])).alias("s")
    long = scores.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, key, "y", arms).select(*keys, key, "y", "s.*")
    group = [*keys, "arm"]
    cells = long.groupBy(*group, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = prefix_sums(cells, group, "score", ["pos", "neg"]).join(cells.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), group)
    place = r.select(*group, "score", F.try_divide(F.col("before_neg") + F.col("neg") / 2.0, F.col("N")).alias("v_pos"), (1 - F.try_divide(F.col("before_pos") + F.col("pos") / 2.0, F.col("P"))).alias("v_neg"))
    v = long.join(place, [*group, "score"]).withColumn("v", F.when(F.col("y") == 1, F.col("v_pos")).otherwise(F.col("v_neg")))
    wide = v.groupBy(*keys, key, "y").agg(F.max(F.when(F.col("arm") == "a", F.col("v"))).alias("va"), F.max(F.when(F.col("arm") == "b", F.col("v"))).alias("vb"))
    s = wide.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"), F.var_samp(F.col("va") - F.col("vb")).alias("vd"))
    pos = lambda c: F.max(F.when(F.col("y") == 1, F.col(c)))
    one = s.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("events"), pos("ma").alias("auc_a"),
        pos("mb").alias("auc_b"), F.when(F.count("vd") == 2, F.sum(F.col("vd") / F.col("n"))).alias("variance"))
    one = one.withColumns({"difference": F.col("auc_a") - F.col("auc_b"), "se": F.sqrt("variance")}).withColumn("z", F.when(F.col("variance") > 1e-18, F.col("difference") / F.col("se")))
    return one.withColumn("p", F.expr(normal_tail("z"))).select(*keys, "n", "events", "auc_a", "auc_b", "difference", "se", "z", "p")


def reported(table: DataFrame, least_rows: int, least_events: int) -> DataFrame:
    """Whether a group has the rows, events and non-events to be read."""
    enough = (F.col("n") >= least_rows) & (F.col("events") >= least_events) & (F.col("n") - F.col("events") >= least_events)
    return table.withColumn("reported", enough.cast("int"))


def constant_columns(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of each group how many of the columns hold one known value at most, and whether all do (a contrast is clean only there)."""
    one = lambda c: (F.coalesce(F.min(c) == F.max(c), F.lit(True))).cast("int")
    g = rows.groupBy(*keys).agg(*[one(c).alias(f"_{c}") for c in columns])
    n = sum((F.col(f"_{c}") for c in columns), F.lit(0))
    return g.select(*keys, n.alias("constant"), (n == len(columns)).cast("int").alias("clean"))
