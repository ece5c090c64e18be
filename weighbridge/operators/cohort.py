"""Landmark cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def landmark(df: DataFrame, days: int) -> DataFrame:
    """Intime plus a fixed span."""
    return df.withColumn("landmark", F.col("intime") + F.make_dt_interval(days=F.lit(days)))


def included(df: DataFrame, criteria: list[Column]) -> DataFrame:
    """Rows that pass every criterion; an unknown criterion fails."""
    for c in criteria:
        df = df.filter(F.coalesce(c, F.lit(False)))
    return df


def ladder(df: DataFrame, criteria: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each criterion, cumulatively, in one pass: step, name, n."""
    kept, counts = F.lit(True), []
    for i, (name, c) in enumerate([("all", F.lit(True)), *criteria]):
        kept = kept & F.coalesce(c, F.lit(False))
        counts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(kept).alias("n")))
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def reconciled(steps: DataFrame, cohort: DataFrame) -> DataFrame:
    """C11: the ladder's end against the stored cohort's count."""
    end = steps.agg(F.max_by("n", "step").alias("ladder_end"))
    return end.crossJoin(cohort.agg(F.count(F.lit(1)).alias("stored"))).withColumn("agrees", (F.col("ladder_end") == F.col("stored")).cast("int"))


def survival(df: DataFrame, event_at: str, last_at: str) -> DataFrame:
    """Event flag, whole hours from the landmark to the event or the last record."""
    hours = lambda c: F.expr(f"timestampdiff(HOUR, landmark, {c})")
    return df.withColumns({
        "event": F.col(event_at).isNotNull().cast("int"),
        "follow_up_hours": F.greatest(hours(f"coalesce({event_at}, {last_at})"), F.lit(0)).cast("long"),
        "hours_to_event": hours(event_at).cast("long"),
    })


def dense_key(df: DataFrame, column: str, out: str, buckets: int = 64) -> DataFrame:
    """Dense rank of a text id over the whole table, without a global window.

    Distinct ids are dealt into ranges between a fixed number of ids drawn by
    hash, ranked inside each range and shifted by the sizes of the ranges before.
    """
    ids = df.select(column).filter(F.col(column).isNotNull()).distinct()
    cuts = [r[0] for r in ids.orderBy(F.xxhash64(column)).limit(buckets - 1).collect()]
    bucket = F.lit(0)
    for c in sorted(cuts, key=lambda x: x.encode()):
        bucket = bucket + F.when(F.col(column) > F.lit(c), 1).otherwise(0)
    dealt = ids.withColumn("_b", bucket)
    inside = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(column)))
    sizes = dealt.groupBy("_b").count()
    before = sizes.withColumn("_o", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = inside.join(F.broadcast(before), "_b").select(column, (F.col("_r") + F.col("_o")).cast("long").alias(out))
    return df.join(ranked, column, "left")


def audit(df: DataFrame, by: list[str], outcome: str, flags: list[str]) -> DataFrame:
    """Counts, outcomes, rate and flag sums, overall or by group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(outcome).cast("long")).alias("events"),
        F.avg(F.col(outcome).cast("double")).alias("rate"),
        *[F.sum(F.col(f).cast("long")).alias(f) for f in flags],
    )
