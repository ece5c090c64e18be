"""Attribution comparison.

Long form throughout: (method, key, signal, ord, a), ord being the signal's
declared place, which breaks ties the way column order would. Pairs of methods
or replicates come from a small manifest and join on (key, signal); keys never
meet other keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import beside, percentiles, prefix_sums, spearman


def attribution_set(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All methods in one long table."""
    out = None
    for name, df in parts.items():
        p = df.select(F.lit(name).alias("method"), key, "signal", "ord", "a")
        out = p if out is None else out.unionByName(p)
    return out


def rolled_contributions(contributions: DataFrame, pairing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Feature contributions to signals by name prefix, an intervention's split equally over its signals; and the share dropped."""
    c = contributions.withColumn("prefix", F.split("feature", "__")[0])
    targets = pairing.groupBy(F.col("name").alias("prefix")).agg(F.collect_set("signal").alias("signals"))  # a declared table
    j = c.join(F.broadcast(targets), "prefix", "left")
    kept = j.filter("signals is not null").select(key, F.explode("signals").alias("signal"), (F.col("v") / F.size("signals")).alias("v")).groupBy(key, "signal").agg(F.sum("v").alias("a"))
    dropped = j.agg(F.try_divide(F.sum(F.when(F.col("signals").isNull(), F.abs("v")).otherwise(0.0)), F.sum(F.abs("v"))).alias("dropped_share"))
    return kept, dropped


def paired(a: DataFrame, b: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """D3: cells measured in both sets: key, signal, ord, a, b."""
    return a.select(*extra, key, "signal", "ord", "a").join(b.select(*extra, key, "signal", F.col("a").alias("b")), [*extra, key, "signal"])


def _ranked(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    d = df.withColumn("_v", value)
    return d.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy("_v")) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "_v")) - 1) / 2.0).drop("_v")


def cell_agreement(cells: DataFrame, by: list[str], floor: float) -> DataFrame:
    """Pearson, Spearman and sign agreement where either value exceeds the floor; groups are few, cells many."""
    big = F.greatest(F.abs("a"), F.abs("b")) > floor
    plain = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.avg(F.when(big, (F.signum("a") == F.signum("b")).cast("double"))).alias("same_sign"))
    return beside(plain, spearman(cells, by, "a", "b", few=True), by, few=True, how="left").select(*by, "n", "pearson", "spearman", "same_sign")


def rank_agreement(cells: DataFrame, key: str | list[str]) -> DataFrame:
    """Spearman of |a| and |b| inside every key."""
    keys = [key] if isinstance(key, str) else key
    r = _ranked(_ranked(cells, keys, F.abs("a"), "ra"), keys, F.abs("b"), "rb")
    return r.groupBy(*keys).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N, tails, quartiles, mean, sd, IQR and skew of a metric (written first if it is a sum of doubles: see percentiles)."""
    known = df.filter(F.col(value).isNotNull())
    plain = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"))
    j = beside(plain, percentiles(known, keys, value, [0.05, 0.25, 0.5, 0.75, 0.95]), keys, few=True)
    q = {n: F.col("q")[i].alias(n) for i, n in enumerate(["q05", "q25", "q50", "q75", "q95"])}
    return j.select(*keys, "n", "least", *q.values(), "mean", "sd", (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "skew")


def domain_share(cells: DataFrame, domains: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Share of positive evidence by domain within score bins."""
    p = cells.join(F.broadcast(domains), "signal").join(bins, key).groupBy("bin", "domain").agg(F.sum(F.greatest("a", F.lit(0.0))).alias("v"))
    return p.withColumn("share", F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("bin"))))


def evidence_curve(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """Mean of both attributions in bins of a covariate x (cut-points per signal)."""
    j = cells.join(F.broadcast(cuts), "signal").withColumn("bin", F.expr("size(filter(cuts, c -> c < x)) + 1"))
    return j.groupBy("signal", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))


def curve_agreement(curve: DataFrame) -> DataFrame:
    """Weighted correlation and normalised distance of two curves."""
    w = F.col("n")
    m = curve.groupBy("signal").agg((F.sum(w * F.col("mean_a")) / F.sum(w)).alias("ma"), (F.sum(w * F.col("mean_b")) / F.sum(w)).alias("mb"))
    j = curve.join(m, "signal")
    da, db = F.col("mean_a") - F.col("ma"), F.col("mean_b") - F.col("mb")
    return j.groupBy("signal").agg(F.try_divide(F.sum(w * da * db), F.sqrt(F.sum(w * da * da) * F.sum(w * db * db))).alias("correlation"),
        F.sqrt(F.try_divide(F.sum(w * (F.col("mean_a") - F.col("mean_b")) ** 2), F.sum(w * F.col("mean_a") ** 2))).alias("distance"))


def by_domain(cells: DataFrame, domains: DataFrame, keys: list[str]) -> DataFrame:
    """Attribution summed within domains."""
    return cells.join(F.broadcast(domains), "signal").groupBy(*keys, "domain").agg(F.sum("a").alias("a"))


def top_k(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Bit masks of the top-k set and of everything tied with the k-th, by |a|, ties by ord. ord is below 63."""
    w = Window.partitionBy(*keys).orderBy(F.desc("m"))
    r = cells.withColumn("m", F.abs("a")).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("m"), "ord"))).withColumn("rk", F.rank().over(w))
    kth = F.max(F.when(F.col("rn") <= k, F.col("rk"))).over(Window.partitionBy(*keys))
    bit = F.expr("shiftleft(1L, cast(ord as int))")
    return r.withColumn("kth", kth).groupBy(*keys).agg(F.bit_or(F.when(F.col("rn") <= k, bit).otherwise(F.lit(0).cast("long"))).alias("top"), F.bit_or(F.when(F.col("rk") == F.col("kth"), bit).otherwise(F.lit(0).cast("long"))).alias("tied"))


def top_k_disagrees(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """1 where one side's top-k has a member outside the other's top-k and ties."""
    j = a.join(b.select(*keys, F.col("top").alias("top_b"), F.col("tied").alias("tied_b")), keys)
    out = lambda x, y, t: F.col(x).bitwiseAND(F.bitwise_not(F.col(y).bitwiseOR(F.col(t)))) != 0
    return j.select(*keys, (out("top_b", "top", "tied") | out("top", "top_b", "tied_b")).cast("int").alias("disagrees"))


def tolerant_disagreement(cells: DataFrame, key: str, k: int, deltas: list[float], relative: bool = False) -> DataFrame:
    """Share of keys whose top-k of b holds a member that a puts more than delta below its k-th, for a grid of deltas."""
    r = cells.withColumn("ra", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("a")), "ord"))).withColumn("rb", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("b")), "ord")))
    g = r.groupBy(key).agg(F.min(F.when(F.col("ra") <= k, F.abs("a"))).alias("kth"), F.min(F.when(F.col("rb") <= k, F.abs("a"))).alias("worst"), F.max(F.abs("a")).alias("lead"))
    gap = F.col("kth") - F.col("worst")
    gap = F.try_divide(gap, F.col("lead")) if relative else gap
    return g.withColumn("gap", gap).withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas]))).groupBy("delta").agg(F.avg((F.col("gap") > F.col("delta")).cast("double")).alias("share"))


def sign_flips(cells: DataFrame, by: list[str], taus: list[float]) -> DataFrame:
    """Share of cells with opposite signs and a magnitude above tau."""
    d = cells.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    flip = (F.col("a") * F.col("b") < 0) & (F.greatest(F.abs("a"), F.abs("b")) > F.col("tau"))
    return d.groupBy(*by, "tau").agg(F.avg(flip.cast("double")).alias("flipped"))


def tie_sets(cells: DataFrame, key: str, delta: float) -> DataFrame:
    """How many cells lie within delta of the leader."""
    lead = F.max(F.abs("a")).over(Window.partitionBy(key))
    return cells.withColumn("lead", lead).groupBy(key).agg(F.count_if(F.abs("a") >= F.col("lead") - delta).alias("tied"))


def cosine_gap(cells: DataFrame, key: str) -> DataFrame:
    """1 - cosine of the two rows; null for a zero row."""
    return cells.groupBy(key).agg((1 - F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2)))).alias("cosine_gap"))


def budget(cells: DataFrame, key: str) -> DataFrame:
    """Total |a|, Herfindahl concentration and largest share."""
    m = F.abs("a")
    g = cells.groupBy(key).agg(F.sum(m).alias("budget"), F.sum(m * m).alias("sq"), F.max(m).alias("top"))
    return g.select(key, "budget", F.try_divide(F.col("sq"), F.col("budget") ** 2).alias("herfindahl"), F.try_divide("top", "budget").alias("top_share"))


def displacements(cells: DataFrame, by: list[str]) -> DataFrame:
    """Quantiles of |a - b| over replicate pairs; the median is the noise-calibrated tolerance."""
    d = cells.withColumn("d", F.abs(F.col("a") - F.col("b")))
    plain = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("largest"))
    j = beside(plain, percentiles(d, by, "d", [0.5, 0.9]), by, few=True, how="left")
    return j.select(*by, "n", F.col("q")[0].alias("delta"), F.col("q")[1].alias("q90"), "largest")


def leaders(cells: DataFrame, key: str) -> DataFrame:
    """a's leader (largest a, ties by ord): its signal, value, and its value, rank displacement and share in b."""
    g = cells.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("n >= 2")
    lead = F.min(F.struct((-F.col("a")).alias("m"), "ord", "signal", "b"))
    one = g.groupBy(key).agg(lead.alias("l"), F.sum(F.greatest("b", F.lit(0.0))).alias("pos_b"), F.max("n").alias("n"))
    one = one.select(key, F.col("l.signal").alias("leader"), (-F.col("l.m")).alias("value_a"), F.col("l.b").alias("value_b"), "pos_b", "n")
    above = g.join(one.select(key, "value_b"), key).groupBy(key).agg(F.count_if(F.col("b") > F.col("value_b")).alias("above"))
    return one.join(above, key).withColumn("displacement", F.try_divide(F.col("above").cast("double"), (F.col("n") - 1).cast("double"))).withColumn("share_b", F.try_divide("value_b", "pos_b"))


def leader_collapse(led: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of leaders whose share on the other side falls below each threshold, and how many land in the bottom third."""
    t = led.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return t.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("share_b") < F.col("threshold")).cast("double")).alias("collapsed"),
        F.avg((F.col("displacement") > 2 / 3).cast("double")).alias("bottom_third"), F.percentile("displacement", F.lit(0.5)).alias("median_displacement"))


def oriented(metrics: DataFrame, agreement_prefix: str = "share_") -> DataFrame:
    """Agreement metrics enter as 1 - value, so that larger is always further apart."""
    return metrics.withColumn("value", F.when(F.col("metric").startswith(agreement_prefix), 1 - F.col("value")).otherwise(F.col("value")))


def dominance(values: DataFrame, keys: list[str], side: str, value: str, x: str, y: str) -> DataFrame:
    """P(X > Y) + P(X = Y) / 2 by ranks, with the gaps of medians and 95th percentiles; unknown values are left out.

    Ranks are prefix sums over counts of distinct values. Rows of other sides count in the ranks and as not x.
    """
    known = values.filter(F.col(value).isNotNull())
    is_x = F.col(side) == x
    cells = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("m"), F.count_if(is_x).alias("mx"), F.count_if(F.col(side) == y).alias("my"))
    r = prefix_sums(cells, keys, "_v", ["m"], few=True)
    g = r.groupBy(*keys).agg(F.sum(F.col("mx") * (F.col("before_m") + (F.col("m") + 1) / 2.0)).alias("rs"), F.sum("mx").alias("nx"), F.sum("my").alias("ny"))
    for name, part in (("qx", known.filter(is_x)), ("qy", known.filter(~is_x))):
        g = beside(g, percentiles(part, keys, value, [0.5, 0.95], name), keys, few=True, how="left")
    u = F.try_divide(F.col("rs") - F.col("nx") * (F.col("nx") + 1) / 2, (F.col("nx") * F.col("ny")).cast("double"))
    gap = lambda i: F.col("qx")[i] - F.col("qy")[i]
    return g.select(*keys, "nx", "ny", u.alias("dominance"), gap(0).alias("median_gap"), gap(1).alias("q95_gap"))


def paired_over_bags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference over unordered bag pairs that both sides have; a repeated pair raises."""
    def keyed(df, name):
        k = df.select(F.least("bag_a", "bag_b").alias("lo"), F.greatest("bag_a", "bag_b").alias("hi"), "value")
        g = k.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("c"), F.max("value").alias(name))
        return g.select("lo", "hi", F.when(F.assert_true(F.col("c") == 1, F.lit("repeated bag pair")).isNull(), F.col(name)).alias(name))

    return keyed(a, "x").join(keyed(b, "y"), ["lo", "hi"]).withColumn("difference", F.col("x") - F.col("y"))


#: Replicates whose pairs are formed at most: a manifest is a table of dozens to hundreds of rows.
MOST_REPLICATES = 5_000


def contrasts(manifest: DataFrame) -> DataFrame:
    """Pairs of replicates by what differs: seed (L1), draw (L2), bag (L3), method within a route (L4), half bags (L3P); others are refused."""
    if (n := manifest.count()) > MOST_REPLICATES:
        raise ValueError(f"{n} replicates; a manifest may hold {MOST_REPLICATES}")
    cols = ["id", "method", "route", "boot", "seed", "draw"]
    a, b = (manifest.select(*[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    j = a.join(b, F.col("id_a") < F.col("id_b"))  # replicates, a few dozen rows by design
    same = lambda c: F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    n = sum(((~same(c)).cast("int") for c in cols[1:]), F.lit(0))
    level = F.when(n != 1, "refused").when(~same("seed"), "L1").when(~same("draw"), "L2").when(~same("boot"), "L3").when(~same("method"), "L4").otherwise("L3P")
    return j.withColumn("level", level).select("id_a", "id_b", "level")


def shape_check(replicates: DataFrame, key: str) -> DataFrame:
    """Replicates whose (key, signal) set or finiteness differs from the first one's."""
    g = replicates.groupBy("replicate").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.xxhash64(key, "signal").cast("decimal(38,0)")).alias("h"), F.count_if(F.isnan("a") | F.col("a").isNull()).alias("not_finite"))
    first = g.agg(F.min(F.struct("replicate", "cells", "h")).alias("f"))
    return g.crossJoin(F.broadcast(first)).select("replicate", "cells", "not_finite", ((F.col("cells") == F.col("f.cells")) & (F.col("h") == F.col("f.h")) & (F.col("not_finite") == 0)).cast("int").alias("ok"))


def verdict(metrics: DataFrame) -> DataFrame:
    """Admissible, trade_off, excluded or unscored from stability, resolution and discrimination (1 good, 0 bad)."""
    known = F.col("stability").isNotNull() & F.col("resolution").isNotNull() & F.col("discrimination").isNotNull()
    good = F.col("stability") + F.col("resolution") + F.col("discrimination")
    return metrics.withColumn("verdict", F.when(~known, "unscored").when(F.col("discrimination") == 0, "excluded").when(good == 3, "admissible").when(good == 2, "trade_off").otherwise("excluded"))


def bands(replicates: DataFrame, key: str) -> DataFrame:
    """2.5 and 97.5 % of every cell over replicates, width, and whether the leader is resolved from its runner-up."""
    q = lambda p: F.percentile("a", F.lit(p))
    b = replicates.groupBy(key, "signal").agg(F.avg("a").alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"))
    w = Window.partitionBy(key).orderBy(F.desc("mean"), "signal")
    r = b.withColumn("place", F.row_number().over(w)).withColumn("next_high", F.lead("high").over(w))
    return r.withColumn("width", F.col("high") - F.col("low")).withColumn("resolved", F.when(F.col("place") == 1, (F.col("low") > F.col("next_high")).cast("int")))


def draws(rows: DataFrame, names: list[str], mean: list[float], covariance, n: int, seed: int, key: str) -> DataFrame:
    """Linear predictors under coefficient draws; the draws (n x k numbers) are broadcast, rows stay put."""
    import numpy as np

    d = np.random.default_rng(seed).multivariate_normal(mean, covariance, n)
    t = rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "draw int, b array<double>")
    x = F.array(*[F.col(c).cast("double") for c in names])
    return rows.crossJoin(F.broadcast(t)).select(key, "draw", F.aggregate(F.zip_with(x, "b", lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c).alias("eta"))


def by_group(metric: DataFrame, groups: DataFrame, key: str, group: str, value: str, least: int) -> DataFrame:
    """A per-key metric as mean within groups of at least `least` keys."""
    g = metric.join(groups, key).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return g.withColumn("eligible", (F.col("n") >= least).cast("int"))


def transport_join(tables: dict[str, tuple[DataFrame, DataFrame]], keys: list[str]) -> DataFrame:
    """Metric tables of two sites joined on declared keys: differences, and rows of one side only."""
    out = None
    for name, (a, b) in tables.items():
        j = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys, "full").select(F.lit(name).alias("table"), *keys, "x", "y", (F.col("y") - F.col("x")).alias("difference"))
        out = j if out is None else out.unionByName(j)
    return out


def margin_bins(cells: DataFrame, key: str, breaks: list[float]) -> DataFrame:
    """Agreement on the leader by bins of the leader's margin over its runner-up."""
    r = cells.withColumn("ra", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("a"), "ord"))).withColumn("rb", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("b"), "ord")))
    p = r.groupBy(key).agg(F.max(F.when(F.col("ra") == 1, F.col("a"))).alias("m1"), F.max(F.when(F.col("ra") == 2, F.col("a"))).alias("m2"),
        F.max(F.when(F.col("ra") == 1, F.col("ord"))).alias("la"), F.max(F.when(F.col("rb") == 1, F.col("ord"))).alias("lb"))
    b = F.lit(0)
    for x in breaks:
        b = b + F.when(F.col("m1") - F.col("m2") > x, 1).otherwise(0)
    return p.filter("m2 is not null").withColumn("margin_bin", b).groupBy("margin_bin").agg(F.count(F.lit(1)).alias("n"),
        F.avg((F.col("la") == F.col("lb")).cast("double")).alias("agree"), F.avg(F.col("m1") - F.col("m2")).alias("mean_margin"))


def metric_values(replicates: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Level, metric, value: per pair of replicates and key, several metrics in one keyed job.
    replicates: replicate, key, signal, ord, a; pairs: a few replicate pairs (broadcast)."""
    p = F.broadcast(pairs.select("id_a", "id_b", "level"))
    x = replicates.select(F.col("replicate").alias("id_a"), key, "signal", "a").join(p, "id_a")
    y = replicates.select(F.col("replicate").alias("id_b"), key, "signal", F.col("a").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    cosine = 1 - F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2)))
    m = x.join(y, ["id_b", key, "signal"]).groupBy("level", "id_a", "id_b", key)
    m = m.agg(cosine.alias("cosine_gap"), F.percentile(gap, F.lit(0.5)).alias("displacement"), F.avg((F.col("a") * F.col("b") < 0).cast("double")).alias("flips"))
    return m.unpivot(["level", "id_a", "id_b", key], ["cosine_gap", "displacement", "flips"], "metric", "value").select("level", "metric", "value")


def metric_sweep(values: DataFrame) -> DataFrame:
    """metric_values, written first, as distributions over keys."""
    by = ["level", "metric"]
    plain = values.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    j = beside(plain, percentiles(values, by, "value", [0.5, 0.95]), by, few=True, how="left")
    return j.select(*by, "n", "mean", F.col("q")[0].alias("q50"), F.col("q")[1].alias("q95"))


def common_bags(replicates: DataFrame, n_methods: int) -> DataFrame:
    """Bags for which every method succeeded."""
    return replicates.groupBy("bag").agg(F.count_distinct("method").alias("methods")).withColumn("complete", (F.col("methods") == n_methods).cast("int"))


def membership(members: DataFrame, unit: str, n_units: int) -> DataFrame:
    """Size, fraction and membership hash of every bag."""
    h = F.conv(F.substring(F.md5(F.col(unit).cast("string")), 1, 8), 16, 10).cast("long")
    return members.groupBy("bag").agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) / n_units).alias("fraction"), F.sum(h).alias("member_hash"))


def not_excluded(replicates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Replicates whose (bag, membership hash) no method failed on; stale exclusions have another hash and do nothing."""
    return replicates.join(excluded.select("bag", "member_hash").distinct(), ["bag", "member_hash"], "left_anti")


def tolerance_grid(noise: DataFrame, a: str, b: str, absolute: list[float]) -> DataFrame:
    """The larger noise-calibrated delta of two methods plus an absolute grid; unscored when either is unknown."""
    d = noise.agg(F.max(F.when(F.col("method") == a, F.col("delta"))).alias("x"), F.max(F.when(F.col("method") == b, F.col("delta"))).alias("y"))
    own = d.select(F.lit("noise").alias("kind"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("delta"))
    return own.unionByName(d.select(F.lit("absolute").alias("kind"), F.explode(F.array(*[F.lit(float(v)) for v in absolute])).alias("delta")))


def additivity(contributions: DataFrame, margins: DataFrame, key: str) -> DataFrame:
    """Largest difference between the sum of contributions and the margin."""
    return contributions.groupBy(key).agg(F.sum("a").alias("s")).join(margins, key).agg(F.max(F.abs(F.col("s") - F.col("margin"))).alias("largest"), F.count(F.lit(1)).alias("n"))


def collapsed_leaders(cells: DataFrame, key: str, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """b's leader of every key (largest |b|, ties by ord): its signal, whether it is measured, and whether its share of a's
    positive evidence is below `share` (an a without positive evidence has a share of 0). cells: by, key, signal, ord, a, b, measured, with every signal of a key.
    """
    keys = [*by, key]
    lead = F.min(F.struct((-F.abs("b")).alias("m"), "ord", "signal", "a", "measured"))
    g = cells.groupBy(*keys).agg(lead.alias("l"), F.sum(F.greatest("a", F.lit(0.0))).alias("positive"), F.count_if(F.col("measured") == 0).alias("n_unmeasured"), F.sum(F.abs("b")).alias("total"))
    collapsed = (F.coalesce(F.try_divide("l.a", "positive"), F.lit(0.0)) < share).cast("int")
    return g.filter("total > 0").select(*keys, F.col("l.signal").alias("leader"), (1 - F.col("l.measured")).cast("int").alias("unmeasured"), collapsed.alias("collapsed"), "n_unmeasured")


def collapse_decomposition(led: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: leaders, share collapsed, share unmeasured, collapse given either, share unmeasured among the collapsed, mean number of unmeasured signals."""
    u, c = F.col("unmeasured"), F.col("collapsed")
    given = lambda x, when: F.avg(F.when(when, x.cast("double")))
    return led.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("collapse"), F.avg(u).alias("leader_unmeasured"), given(c, u == 1).alias("collapse_given_unmeasured"), given(c, u == 0).alias("collapse_given_measured"),
                                given(u, c == 1).alias("unmeasured_given_collapse"), F.avg("n_unmeasured").alias("n_unmeasured"))


def unmeasured_channels(led: DataFrame, by: list[str]) -> DataFrame:
    """Which signals lead where they are unmeasured: rows, share among such leaders, and how many collapse."""
    g = led.filter("unmeasured = 1").groupBy(*by, F.col("leader").alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.avg("collapsed").alias("collapse"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))  # a row a signal


def collapse_correlations(groups: DataFrame, least: int, by: list[str]) -> DataFrame:
    """Over groups with at least `least` leaders, the rank correlations of collapse with the share of unmeasured leaders, with the
    number of unmeasured signals, and of collapse among measured leaders with the share of unmeasured leaders."""
    pairs = [("leader_unmeasured", "collapse"), ("n_unmeasured", "collapse"), ("leader_unmeasured", "collapse_given_measured")]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs]))
    long = groups.filter(F.col("n") >= least).select(*by, each.alias("p")).select(*by, "p.*")
    known = long.filter("u is not null and v is not null").groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("groups"))
    return beside(known, spearman(long, [*by, "x", "y"], "u", "v", few=True), [*by, "x", "y"], few=True, how="left")


def manifest_coverage(manifest: DataFrame, plan: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """A replicate plan against the manifest, by anti-joins on the coordinates: planned, present, missing, unplanned and repeated coordinates of each group."""
    seen = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    p = plan.select(*keys).distinct()
    count = lambda df, name: df.select(*by, F.lit(name).alias("state"))
    states = count(p, "planned").unionByName(count(p.join(seen, same(p, seen), "left_semi"), "present")).unionByName(count(p.join(seen, same(p, seen), "left_anti"), "missing"))
    states = states.unionByName(count(seen.join(p, same(seen, p), "left_anti"), "unplanned")).unionByName(count(seen.filter("copies > 1"), "repeated"))
    return states.groupBy(*by).agg(*[F.count_if(F.col("state") == n).alias(n) for n in ("planned", "present", "missing", "unplanned", "repeated")])


def contrast_levels(manifest: DataFrame, families: dict[str, str]) -> DataFrame:
    """Pairs of replicates and the level of their contrast, or why they are refused.

    manifest: id, method, route, boot, seed, draw; families: routes that were made alike (a bag refitted with other seeds belongs
    to its bag's family). L1: one coordinate twice; L2: another seed; L3: another bag; L3T: another bag and seed; L3P: another
    posterior draw; L4: another method at one coordinate. Refused: methods and coordinates both differ (confounded), a draw differs with
    a bag or seed (draw_mixed), the full sample against a bag (full_sample), a fit against its own draw (centre). Pairs of different
    families, or of a route without one, are not formed. More replicates than MOST_REPLICATES raise.
    """
    n = manifest.count()
    if n > MOST_REPLICATES:
        raise ValueError(f"{n} replicates; a manifest may hold {MOST_REPLICATES}")
    family = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("route")]
    m = manifest.withColumn("family", family)
    cols = ["id", "method", "boot", "seed", "draw"]
    a, b = (m.select("family", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    j = a.join(b, "family").filter("id_a < id_b")
    dm, db, ds, dd = (~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in cols[1:])
    zero = lambda c: F.least(f"{c}_a", f"{c}_b") == 0
    refused = F.when(dm & (db | ds | dd), "confounded").when(dd & (db | ds), "draw_mixed").when(db & zero("boot"), "full_sample").when(dd & zero("draw"), "centre")
    level = F.when(refused.isNotNull(), "refused").when(dm, "L4").when(dd, "L3P").when(db & ds, "L3T").when(db, "L3").when(ds, "L2").otherwise("L1")
    return j.select("id_a", "id_b", "family", level.alias("level"), refused.alias("refused"))
