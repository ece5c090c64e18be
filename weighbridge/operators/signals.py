"""Raw values to a binned lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_values(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """G1: one row per measurement that is not null."""
    return df.unpivot(ids, columns, "signal", "value").filter("value is not null")


def converted(value: Column, low: float, high: float, scale: float, shift: float) -> Column:
    """Values in the band of another unit are converted."""
    return F.when(value.between(low, high), (value - shift) * scale).otherwise(value)


def within_bounds(raw: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values inside the declared bounds of their signal (a small table)."""
    return raw.join(F.broadcast(bounds), "signal").filter(F.col("value").between(F.col("low"), F.col("high"))).drop("low", "high")


def binned(raw: DataFrame, key: str, n_bins: int) -> DataFrame:
    """Count, min, lower median and max per key, signal and bin; bins outside the window go before grouping."""
    return raw.filter(F.col("bin").between(0, n_bins - 1)).groupBy(key, "signal", "bin").agg(
        F.count("value").alias("n_raw"), F.min("value").alias("bin_min"),
        F.expr("percentile_disc(0.5) within group (order by value)").alias("bin_med"), F.max("value").alias("bin_max"),
    )


def rate_signal(volumes: DataFrame, weights: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Volume per bin (never below 0) over a plausible weight, inside bounds."""
    v = volumes.groupBy(key, "bin").agg(F.greatest(F.sum("value"), F.lit(0.0)).alias("v"))
    rate = F.try_divide(F.col("v"), F.col("weight"))
    return v.join(weights, key).withColumn("rate", rate).filter(rate.between(low, high)).select(key, "bin", "rate")


def components(df: DataFrame, ids: list[str], bounds: dict[str, tuple[int, int]], unable: str) -> DataFrame:
    """Ordinal components in long form; the one named first is dropped where flagged unassessable."""
    first = next(iter(bounds))
    df = df.withColumn(first, F.when(F.coalesce(F.col(unable), F.lit(0)) == 0, F.col(first)))
    rows = df.unpivot(ids, list(bounds), "signal", "value").filter("value is not null")
    ok = F.lit(False)
    for name, (lo, hi) in bounds.items():
        ok = ok | ((F.col("signal") == name) & F.col("value").between(lo, hi))
    return rows.filter(ok)


def unable_share(entities: DataFrame, marks: DataFrame, key: str, flag: str) -> DataFrame:
    """Assessments, how many were impossible, their share (null without any) and whether any was."""
    m = marks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) == 1).alias("unable"))
    out = entities.select(key).join(m, key, "left").fillna(0, ["n", "unable"])
    return out.withColumn("share", F.try_divide("unable", F.nullif("n", F.lit(0)))).withColumn("ever", (F.col("unable") > 0).cast("int"))


def coverage_audit(lattice: DataFrame, key: str) -> DataFrame:
    """Bins covered per key and signal as quartiles, and the range of values."""
    per = lattice.groupBy(key, "signal").agg(F.count(F.lit(1)).alias("bins"), F.min("bin_min").alias("lo"), F.max("bin_max").alias("hi"), F.sum("n_raw").alias("raw"))
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by bins)").cast("long")
    return per.groupBy("signal").agg(F.count(F.lit(1)).alias("keys"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.min("lo").alias("low"), F.max("hi").alias("high"), F.sum("raw").alias("raw"))


def rejection_audit(raw: DataFrame, bounds: DataFrame) -> DataFrame:
    """Share of values outside their bounds."""
    bad = ~F.col("value").between(F.col("low"), F.col("high"))
    return raw.join(F.broadcast(bounds), "signal").groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("rejected"), F.avg(bad.cast("double")).alias("share"))
