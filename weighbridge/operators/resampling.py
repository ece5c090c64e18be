"""Splits, folds and resampling from portable hashes (P1-P9). No random state: a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import poisson_weight, prefix_sums, uniform


def grouped_split(df: DataFrame, group: str, y: str, fraction: float, seed: int) -> DataFrame:
    """Whole groups, within outcome strata, in hash order until `fraction` of the stratum's rows are in 'train'."""
    g = df.groupBy(group).agg(F.max(y).alias("stratum"), F.count(F.lit(1)).alias("rows"))
    g = g.withColumn("u", uniform(F.lit(seed), F.col(group)))
    total = g.groupBy(F.col("stratum").alias("_s")).agg(F.sum("rows").alias("total"))
    g = prefix_sums(g, ["stratum"], ["u", group], ["rows"], few=True).join(F.broadcast(total), F.col("stratum").eqNullSafe(F.col("_s")))
    return g.withColumn("split", F.when(F.col("before_rows") < fraction * F.col("total"), "train").otherwise("test")).select(group, "stratum", "rows", "split")


def grouped_folds(groups: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Hashed round robin within stratum, balanced to one group (instead of a sequential greedy fill)."""
    dealt = groups.withColumns({"_u": uniform(F.lit(seed), F.lit("fold"), F.col(group)), "_one": F.lit(1)})
    dealt = prefix_sums(dealt, ["stratum"], ["_u", group], ["_one"], few=True)
    return dealt.withColumn("fold", (F.col("before__one") % k + 1).cast("int")).drop("_u", "_one", "before__one")


def fold_summary(df: DataFrame, group: str, y: str) -> DataFrame:
    """Rows, groups, events and rate of every fold."""
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), F.sum(y).alias("events"), F.avg(F.col(y).cast("double")).alias("rate"))


def fold_checks(df: DataFrame, group: str, y: str, tolerance: float) -> DataFrame:
    """Groups in two folds, and folds whose rate is off the overall rate."""
    straddling = df.groupBy(group).agg(F.count_distinct("fold").alias("f")).agg(F.count_if(F.col("f") > 1).alias("straddling"))
    rates = df.groupBy("fold").agg(F.avg(F.col(y).cast("double")).alias("r")).crossJoin(df.agg(F.avg(F.col(y).cast("double")).alias("all_rate")))
    return straddling.crossJoin(rates.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.abs(F.col("r") - F.col("all_rate")) > tolerance).alias("off_rate")))


def bootstrap_units(units: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """Draw number and multiplicity of every unit drawn at all."""
    d = units.select(unit).distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return d.withColumn("w", poisson_weight(F.lit(seed), F.col("b"), F.col(unit))).filter("w > 0")


def bags(units: DataFrame, unit: str, n_bags: int, seed: int) -> DataFrame:
    """Members of each bag: a unit is in with the probability that n draws with replacement meet it."""
    d = units.select(unit).distinct().withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(n_bags))))
    return d.filter(uniform(F.lit(seed), F.lit("bag"), F.col("bag"), F.col(unit)) < 0.6321205588285577)


def halves(units: DataFrame, unit: str, seed: int) -> DataFrame:
    """Disjoint halves by hash parity."""
    return units.select(unit).distinct().withColumn("half", F.when(uniform(F.lit(seed), F.lit("half"), F.col(unit)) < 0.5, 1).otherwise(2))


#: Replicates whose pairs are formed at most.
MOST_MEMBERS = 5_000


def sampled_pairs(members: DataFrame, member: str, most: int, seed: int) -> DataFrame:
    """Pairs of replicates, all or a seeded sample. Replicates are few by design (never rows): more than MOST_MEMBERS raise."""
    if (n := members.count()) > MOST_MEMBERS:
        raise ValueError(f"{n} members; pairs are formed of {MOST_MEMBERS} at most")
    a, b = members.select(F.col(member).alias("a")), members.select(F.col(member).alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("u", uniform(F.lit(seed), F.col("a"), F.col("b")))
    return pairs.orderBy("u", "a", "b").limit(most).select("a", "b")
