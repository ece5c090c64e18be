"""Time lattices, intervals and interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(entities: DataFrame, key: str, n_bins: int) -> DataFrame:
    """One row per entity and bin, absence explicit."""
    return entities.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))


def bin_of(at: Column, origin: Column, width_seconds: int) -> Column:
    """Bin of a point in time; no join is needed to place points."""
    return F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))) / (width_seconds * 1_000_000)).cast("int")


def carried_forward(points: DataFrame, key: list[str], at: str, cap_seconds: int) -> DataFrame:
    """I4 over I5: distinct points become intervals that end at the next point or after cap_seconds."""
    w = Window.partitionBy(*key).orderBy(at)
    cap = F.col(at) + F.make_dt_interval(secs=F.lit(cap_seconds))
    return points.withColumn("start_at", F.col(at)).withColumn("end_at", F.least(F.coalesce(F.lead(at).over(w), cap), cap))


def distinct_points(df: DataFrame, key: list[str], value: str | None = None) -> DataFrame:
    """One row per charted point, with its largest value."""
    return df.groupBy(*key).agg(F.max(value).alias(value)) if value else df.select(*key).distinct()


def covered_bins(intervals: DataFrame, origin: str, width_seconds: int, n_bins: int) -> DataFrame:
    """Bins that an interval overlaps, by exploding its own bin range instead of a theta join.

    An interval touches a bin when it starts before the bin's end and ends after
    its start; one of no length touches none. Bins outside the window are cut.
    """
    lo = F.greatest(bin_of(F.col("start_at"), F.col(origin), width_seconds), F.lit(0))
    micros = F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros(F.col(origin).cast("timestamp"))
    hi = F.least((F.ceil(micros / (width_seconds * 1_000_000)) - 1).cast("int"), F.lit(n_bins - 1))
    ok = (F.col("end_at") > F.col("start_at")) & (hi >= lo)
    return intervals.withColumn("_lo", lo).withColumn("_hi", hi).filter(ok).withColumn("bin", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def onset_to_end(events: DataFrame, key: str, bin_col: str, n_bins: int) -> DataFrame:
    """Active from the first onset to the window's end."""
    first = events.groupBy(key).agg(F.min(bin_col).alias("first_bin"))
    return first.select(key, F.explode(F.sequence("first_bin", F.lit(n_bins - 1))).alias("bin"))


def presence_with_dose(presence: DataFrame, dose: DataFrame, keys: list[str]) -> DataFrame:
    """Bins active in one source with the other source's largest dose, null where unknown."""
    return presence.select(*keys).distinct().join(dose.groupBy(*keys).agg(F.max("dose").alias("intensity")), keys, "left")


def precedence(df: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """Of the states seen in a bin the first in order."""
    flags = df.groupBy(*keys).agg(*[F.max(F.when(F.col(state) == s, 1)).alias(f"_{i}") for i, s in enumerate(order)])
    out = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(order))):
        out = F.when(F.col(f"_{i}") == 1, F.lit(s)).otherwise(out)
    return flags.select(*keys, out.alias(state)).filter(F.col(state).isNotNull())


def state_lattice(bins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest intensity of a state in each active bin."""
    return bins.groupBy(*keys).agg(F.max(value).alias("intensity")).withColumn("shape", F.lit("state")).withColumn("active", F.lit(1))


def event_lattice(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Amount of the events that start in each bin."""
    return points.groupBy(*keys).agg(F.sum(value).alias("intensity")).withColumn("shape", F.lit("event")).withColumn("active", F.lit(1))


def merged_presence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two sources of one state; a source without a dose adds presence only."""
    cols = [*keys, "intensity"]
    return a.select(*cols).unionByName(b.select(*cols)).groupBy(*keys).agg(F.max("intensity").alias("intensity"))


def fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Rows of the second source only for keys that the first lacks."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti").select(primary.columns))


def end_ladder(start: Column, candidates: list[Column], least_span: int, window: int) -> Column:
    """First known end, at least least_span after the start, inside the window."""
    return F.least(F.greatest(F.coalesce(*candidates, F.lit(window)), start + least_span), F.lit(window))


def unit_rate(rate: Column, unit: Column, wanted: str) -> Column:
    """A rate counts only in its canonical unit."""
    return F.when(F.contains(unit, F.lit(wanted)), rate)


def equivalent_dose(df: DataFrame, keys: list[str], rate: str, unit: str, factors: dict[str, float], potency: str) -> DataFrame:
    """Unit-normalised rate times potency, summed per key; unknown units add nothing."""
    factor = F.lit(None).cast("double")
    for u, f in factors.items():
        factor = F.when(F.col(unit) == u, F.lit(f)).otherwise(factor)
    return df.groupBy(*keys).agg(F.sum(F.col(rate) * factor * F.col(potency)).alias("dose"))


def modal(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The commonest value of a key, ties to the smaller."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def as_percent(fraction: Column, low: float, high: float) -> Column:
    """Fractions up to 1 become percent, then a range gate."""
    p = F.when(fraction <= 1, fraction * 100).otherwise(fraction)
    return F.when(p.between(low, high), p)


def completed(entities: DataFrame, key: str, declared: DataFrame, name: str, features: DataFrame) -> DataFrame:
    """Every entity with every declared name (a list of fixed size), features where they exist."""
    return entities.select(key).crossJoin(F.broadcast(declared)).join(features, [key, name], "left")


def rolled_up(lattice: DataFrame, key: list[str]) -> DataFrame:
    """Active bins, total, peak, first bin and presence at admission."""
    return lattice.groupBy(*key).agg(
        F.count_distinct("bin").alias("n_bins"), F.sum("intensity").alias("total"), F.max("intensity").alias("peak"),
        F.min("bin").alias("first_bin"), F.max((F.col("bin") == 0).cast("int")).alias("at_admission"),
    )


def agent_counts(agents: DataFrame, key: list[str], agent: str, reference: str) -> DataFrame:
    """Distinct agents and whether the reference agent is one of them."""
    return agents.groupBy(*key).agg(F.count_distinct(agent).alias("n_agents"), F.max((F.col(agent) == reference).cast("int")).alias("has_reference"))


def max_concurrency(agents: DataFrame, key: list[str], agent: str) -> DataFrame:
    """Most distinct agents in any one bin."""
    return agents.groupBy(*key, "bin").agg(F.count_distinct(agent).alias("k")).groupBy(*key).agg(F.max("k").alias("max_concurrent"))


def by_shape(grid: DataFrame, n_bins: int) -> DataFrame:
    """Null where a column does not apply to the shape, 0 where it applies but nothing happened."""
    state, event = F.col("shape") == "state", F.col("shape") == "event"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return grid.withColumns({
        "ever_active": F.col("n_bins").isNotNull().cast("int"),
        "exposure": F.when(state, zero("n_bins") / float(n_bins)),
        "event_bins": F.when(event, zero("n_bins")),
        "event_total": F.when(event, F.coalesce(F.col("total"), F.lit(0.0))),
        "at_admission": zero("at_admission"),
    })
