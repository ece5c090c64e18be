"""Scalar and window expressions the operators share."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities: a uniform draw exceeds as many of them as the draw's weight.
POISSON_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def r6(c: Column | str) -> Column:
    """Six places, never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def uniform(*parts: Column) -> Column:
    """Portable uniform in [0, 1) from the md5 of the parts: the same on every engine and in every run."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(*parts: Column) -> Column:
    """Bootstrap weight of a unit: Poisson(1) from its portable uniform."""
    u = uniform(*parts)
    out = F.lit(0)
    for cut in POISSON_CDF:
        out = out + F.when(u >= cut, 1).otherwise(0)
    return out.cast("long")


def mean_above(value: str, cut: str) -> Column:
    """Aggregate: whether the mean of the known values is above cut, a decimal as text.

    Sums of doubles depend on the order of rows, which would decide means that equal cut. Whole millionths and, of the values that these
    do not hold, decimals add up the same in any order. Values beyond 18 places or 10 digits before them (and NaN, infinities, sums
    over 9e12) leave it to the mean of doubles.
    """
    x = F.col(value).cast("double")
    millionths = F.when(F.abs(x) < 1e6, F.rint(x * 1e6).cast("long"))
    whole = F.coalesce(millionths / 1e6 == x, F.lit(False))
    rest = F.when(~whole, x)
    exact = rest.try_cast("decimal(28,18)")
    held = (F.count(x) > 0) & (F.count_if(exact.cast("double") == rest) == F.count(rest))
    others = F.coalesce(F.try_sum(exact), F.when(F.count(rest) == 0, F.lit(0).cast("decimal(38,18)")))
    missing = F.count(x) * F.lit(Decimal(cut)) - F.try_sum(F.when(whole, millionths).otherwise(0)) * F.lit(Decimal("0.000001"))
    return F.coalesce(F.when(held, others > missing.cast("decimal(38,18)")), F.avg(x) > F.lit(float(cut)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def band(value: Column, breaks: list[float], points: list[int]) -> Column:
    """Right-open step function: points[i] while value < breaks[i], the last beyond; null stays null."""
    out = F.lit(points[-1])
    for cut, p in reversed(list(zip(breaks, points))):
        out = F.when(value < cut, F.lit(p)).otherwise(out)
    return F.when(value.isNotNull(), out)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered substring classification: the first rule whose pattern occurs wins, null if none."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(F.contains(F.lower(text), F.lit(pattern)), F.lit(label)).otherwise(out)
    return out


def number_in(text: Column, pattern: str, group: int = 1) -> Column:
    """A number parsed out of free text; no match is null."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def plausible(value: Column, low: float, high: float) -> Column:
    """Value inside closed bounds, else null."""
    return F.when(value.between(low, high), value)


def capped_age(text: Column, cap: int = 90) -> Column:
    """'> 89' counts as the cap; other text is cast safely; nothing exceeds the cap (C4)."""
    age = F.when(F.trim(text) == "> 89", F.lit(cap)).otherwise(text.try_cast("int"))
    return F.when(age.isNotNull(), F.least(age, F.lit(cap)))


def minute_offset(minutes: Column, epoch: str = "2000-01-01 00:00:00") -> Column:
    """Minutes after a fixed epoch as a timestamp."""
    return F.timestamp_add("MINUTE", minutes, F.to_timestamp_ntz(F.lit(epoch)))


def midrank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank among ties inside each key group."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def beside(left: DataFrame, right: DataFrame, keys: list[str], few: bool = False, how: str = "inner") -> DataFrame:
    """left with the columns of right's row of the same keys, null being a key like any other; few: right is small and broadcast."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(F.broadcast(r) if few else r, same, how).drop(*[f"_r_{k}" for k in keys])


def prefix_sums(df: DataFrame, keys: list[str], order: str | list[str], cols: list[str], buckets: int = 64, few: bool = False) -> DataFrame:
    """Adds before_<col>: the sum of col over rows of the group with a smaller order value.

    df has one row per (keys, order). A group's rows are dealt into buckets by
    quantiles of its (first) order values, so no task holds a whole group; bucket
    totals give the offsets. Null keys form a group. few: the groups are few, so
    their quantiles and offsets are broadcast instead of dealing rows by group.
    """
    order = [order] if isinstance(order, str) else order
    at = [(i + 1) / buckets for i in range(buckets - 1)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order[0], at, 1000).alias("_cuts"))
    d = beside(df, cuts, keys, few)
    d = d.withColumn("_b", F.expr(f"size(filter(_cuts, c -> c < {order[0]}))")).drop("_cuts")
    totals = d.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in cols])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = beside(d.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}), offsets, [*keys, "_b"], few)
    return out.withColumns({f"before_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in cols}).drop("_b", *[f"_{k}_{c}" for k in "io" for c in cols])


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], out: str = "q", few: bool = True) -> DataFrame:
    """keys and out: exact percentiles (interpolated between neighbours) of the known values of each group, as an array.

    Rows become counts of distinct values, whose prefix sums say which value
    stands at a place, so no task holds a group. A group without a known value
    has no row; without keys there is always one. Values are read several
    times: sums of doubles, which may differ in their last bits from run to run, are to be written first.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    n = cells.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    r = beside(prefix_sums(cells, keys, "_v", ["_m"], few=few), n, keys, few)
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in at]
    here = lambda i: F.max(F.when((F.col("before__m") <= i) & (i < F.col("before__m") + F.col("_m")), F.col("_v")))
    ends = [here(F.floor(x)).alias(f"_l{i}") for i, x in enumerate(place)] + [here(F.ceil(x)).alias(f"_h{i}") for i, x in enumerate(place)]
    g = r.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    mix = lambda i, x: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (x - F.floor(x))
    return g.select(*keys, F.array(*[F.when(F.ceil(x) == F.floor(x), F.col(f"_l{i}")).otherwise(mix(i, x)) for i, x in enumerate(place)]).alias(out))


def spearman(df: DataFrame, keys: list[str], a: str, b: str, few: bool = False) -> DataFrame:
    """keys and spearman: the rank correlation of a and b within groups, over rows where both are known; null when either is constant.

    Mid-ranks come from prefix sums over distinct values and stay with the distinct (a, b) cells; their mean is (n + 1) / 2.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b_")).agg(F.count(F.lit(1)).alias("_m"))
    n = cells.groupBy(*keys).agg(((F.sum("_m") + 1) / 2.0).alias("_mid"))
    for x in ("_a", "_b_"):
        ranks = prefix_sums(cells.groupBy(*keys, x).agg(F.sum("_m").alias("_t")), keys, x, ["_t"], few=few)
        cells = beside(cells, ranks.select(*keys, x, (F.col("before__t") + (F.col("_t") + 1) / 2.0).alias(f"_r{x}")), [*keys, x])
    c = beside(cells, n, keys, few)
    s = lambda x, y: F.sum(F.col("_m") * (F.col(x) - F.col("_mid")) * (F.col(y) - F.col("_mid")))
    return c.groupBy(*keys).agg(F.try_divide(s("_r_a", "_r_b_"), F.sqrt(s("_r_a", "_r_a")) * F.sqrt(s("_r_b_", "_r_b_"))).alias("spearman"))
