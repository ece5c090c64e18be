"""Signal features: masks and one row per entity and signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked_bins(lattice: DataFrame, active: DataFrame, spec: DataFrame, key: str) -> DataFrame:
    """Lattice bins censored from a masking intervention's onset on, or only while it is active; a set union."""
    onset = active.groupBy(key, "intervention").agg(F.min("bin").alias("first_bin"))
    cells = lattice.select(key, "signal", "bin").join(F.broadcast(spec), "signal")
    later = cells.filter("mode = 'onset'").join(onset, [key, "intervention"]).filter("bin >= first_bin").select(key, "signal", "bin")
    during = cells.filter("mode = 'concurrent'").join(active.select(key, "intervention", "bin").distinct(), [key, "intervention", "bin"]).select(key, "signal", "bin")
    return later.unionByName(during).distinct()


def surviving(lattice: DataFrame, masked: DataFrame, key: str) -> DataFrame:
    """the lattice without its masked bins."""
    return lattice.join(masked, [key, "signal", "bin"], "left_anti")


def mask_counts(masked: DataFrame, key: str) -> DataFrame:
    """F7."""
    return masked.groupBy(key, "signal").agg(F.count(F.lit(1)).alias("n_masked"))


def signal_features(entities: DataFrame, ranges: DataFrame, lattice: DataFrame, masked: DataFrame | None, key: str, n_bins: int, half: int, least_span: int) -> DataFrame:
    """The dense entity x signal grid.

    One pass of the lattice gives counts against the reference range, discrete
    tail quantiles, extremes, replicate statistics, the guarded slope (0 with a
    flag when undefined) and the coverage and timing diagnostics.
    """
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by bin_med)")
    low, high = F.col("bin_med") < F.col("ref_low"), F.col("bin_med") > F.col("ref_high")
    seen = lattice.join(F.broadcast(ranges), "signal").groupBy(key, "signal").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if(low).alias("k_low"), F.count_if(~low & ~high).alias("k_mid"), F.count_if(high).alias("k_high"),
        q(0.05).alias("q05"), q(0.95).alias("q95"), q(0.5).alias("value_median"), F.min("bin_min").alias("value_min"), F.max("bin_max").alias("value_max"),
        F.avg("bin_med").alias("within_mean"), (F.var_pop("bin_med") * F.count("bin_med")).alias("within_ss"), F.avg(F.col("bin_max") - F.col("bin_min")).alias("range_mean"), F.sum("n_raw").alias("n_raw"),
        F.covar_pop(F.col("bin").cast("double"), F.col("bin_med")).alias("_cov"), F.var_pop(F.col("bin").cast("double")).alias("_var"),
        F.count_if(F.col("bin") < half).alias("early"), F.count_if(F.col("bin") >= half).alias("late"),
        F.min(F.when(low, F.col("bin"))).alias("first_low"), F.min(F.when(high, F.col("bin"))).alias("first_high"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"),
    )
    grid = entities.select(key).crossJoin(F.broadcast(ranges)).join(seen, [key, "signal"], "left")
    grid = grid.join(mask_counts(masked, key), [key, "signal"], "left") if masked is not None else grid.withColumn("n_masked", F.lit(0))
    grid = grid.fillna(0, ["n_obs", "k_low", "k_mid", "k_high", "early", "late", "n_masked", "n_raw"])
    defined = (F.col("n_obs") >= 2) & (F.col("last_bin") - F.col("first_bin") >= least_span) & (F.col("early") >= 1) & (F.col("late") >= 1)
    defined = F.coalesce(defined, F.lit(False))
    return grid.withColumns({
        "span": F.coalesce(F.col("last_bin") - F.col("first_bin"), F.lit(0)),
        "trend": F.when(defined, F.lit(float(n_bins)) * F.try_divide("_cov", "_var")).otherwise(F.lit(0.0)),
        "trend_defined": defined.cast("int"),
        "missing": (F.col("n_obs") == 0).cast("int"),
    }).drop("_cov", "_var")


def feature_audit(features: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Mask impact, excursion rates, quantile equal to extreme, trend availability, outcome by missingness."""
    f = features.join(outcome, key)
    return f.groupBy("signal").agg(
        F.count(F.lit(1)).alias("keys"), F.avg((F.col("n_obs") > 0).cast("double")).alias("measured"), F.avg((F.col("n_masked") > 0).cast("double")).alias("masked"),
        F.avg((F.col("k_low") > 0).cast("double")).alias("any_low"), F.avg((F.col("k_high") > 0).cast("double")).alias("any_high"),
        F.avg(F.when(F.col("n_obs") > 0, (F.col("q05") == F.col("value_min")).cast("double"))).alias("q05_is_min"), F.avg(F.col("trend_defined").cast("double")).alias("trend_share"),
        F.avg(F.when(F.col("missing") == 1, F.col("y").cast("double"))).alias("rate_missing"), F.avg(F.when(F.col("missing") == 0, F.col("y").cast("double"))).alias("rate_measured"),
        F.corr(F.col("n_obs").cast("double"), F.col("k_high").cast("double")).alias("corr_n_high"),
    )


def typical_density(features: DataFrame) -> DataFrame:
    """median number of observed bins among measured rows."""
    return features.filter("n_obs > 0").groupBy("signal").agg(F.percentile("n_obs", F.lit(0.5)).alias("median_n"))
