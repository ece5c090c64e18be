"""Reports (K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import beside, percentiles, prefix_sums, uniform
from ..sources.tables import scan_once, shared_path


def percentile_against(values: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """K2: share of the reference at or below each distinct value, by prefix sums over both sides' values."""
    u = values.select(F.col(value).alias("v"), F.lit(0).cast("long").alias("m")).unionByName(reference.select(F.col(value).alias("v"), F.lit(1).cast("long").alias("m")))
    cells = u.groupBy("v").agg(F.sum("m").alias("m"))
    total = reference.agg(F.count(F.lit(1)).alias("total"))
    p = prefix_sums(cells.withColumn("all", F.lit(1)), ["all"], "v", ["m"]).crossJoin(F.broadcast(total))
    share = p.select(F.col("v").alias(value), ((F.col("before_m") + F.col("m")) / F.col("total")).alias("percentile"))
    return values.join(share, value, "left")


def profiles(cards: DataFrame, band: str, key: str, seed: int) -> DataFrame:
    """K3: one eligible key per score band, drawn by hash."""
    w = Window.partitionBy(band).orderBy(uniform(F.lit(seed), F.col(key)), key)
    return cards.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def percentile_within(values: DataFrame, reference: DataFrame, keys: list[str], columns: list[str], value: str) -> DataFrame:
    """K2: adds pct_<column>: the share of the group's reference values at or below each of the columns, all columns in one keyed job; null values have none."""
    asked = values.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")).filter("v is not null").distinct().withColumn("m", F.lit(0).cast("long"))
    cells = asked.unionByName(reference.select(*keys, F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("m"))).groupBy(*keys, "v").agg(F.sum("m").alias("m"))
    total = cells.groupBy(*keys).agg(F.sum("m").alias("total"))
    p = beside(prefix_sums(cells, keys, "v", ["m"]), total, keys, few=True).select(*keys, "v", F.try_divide((F.col("before_m") + F.col("m")).cast("double"), F.col("total").cast("double")).alias("p"))
    p = scan_once(p, shared_path(values.sparkSession, "percentiles"))
    for c in columns:
        r = p.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("v").alias("_v"), F.col("p").alias(f"pct_{c}"))
        same = [values[k].eqNullSafe(r[f"_{k}"]) for k in keys] + [values[c].cast("double") == r["_v"]]
        values = values.join(r, same, "left").drop("_v", *[f"_{k}" for k in keys])
    return values


def card_lines(replicates: DataFrame, key: str, outside: DataFrame) -> DataFrame:
    """K1: key, signal, l, se, the band over replicates (D28), the posterior band (D29, normal) and the terms outside the curves' support.

    replicates: key, signal, role, l, se (role 0 is the model itself); outside: key, signal, terms, outside (names, joined). A group holds
    one value a replicate.
    """
    band = replicates.filter("role > 0").groupBy(key, "signal").agg(F.percentile("l", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("replicates"))
    own = replicates.filter("role = 0").select(key, "signal", "l", "se")
    j = own.join(band, [key, "signal"], "left").join(outside, [key, "signal"], "left")
    return j.select(key, "signal", "l", "se", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (F.col("l") - 1.959963984540054 * F.col("se")).alias("post_low"), (F.col("l") + 1.959963984540054 * F.col("se")).alias("post_high"),
                    F.coalesce("replicates", F.lit(0)).alias("replicates"), "terms", "outside")


def outside_support(rows: DataFrame, key: str, grid: DataFrame, covariates: list[str]) -> DataFrame:
    """Key, signal, terms (covariates), outside (names of those beyond the grid, or where too few rows lie beside the point). grid: signal, covariate, grid, ok."""
    long = rows.select(key, "signal", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in covariates]).unpivot([key, "signal"], covariates, "covariate", "x")
    j = long.join(F.broadcast(grid.select("signal", "covariate", "grid", "ok")), ["signal", "covariate"])  # a grid for each signal and covariate
    at = F.size(F.filter("grid", lambda g: g < F.col("x")))
    beyond = (F.col("x") < F.col("grid")[0]) | (at >= F.size("grid")) | ~F.coalesce(F.get("ok", at), F.lit(False))
    g = j.groupBy(key, "signal").agg(F.count(F.lit(1)).alias("terms"), F.array_join(F.array_sort(F.collect_list(F.when(beyond, F.col("covariate")))), ";").alias("outside"))  # covariates of a row
    return g


def cards(lines: DataFrame, replicates: DataFrame, key: str, reference: DataFrame, n_bins: int = 20) -> DataFrame:
    """K1: one row for each key, all in one job: the sum of evidence with its replicate and posterior bands, its percentile in the
    reference and those of the band's ends, the reference stratum (of n_bins, by the reference's own quantiles) with the ends' strata, the number of
    extrapolated signals, and the lines, strongest first.

    lines: what card_lines gives, with percentiles; reference: key, score (the sums of the reference rows).
    """
    total = replicates.groupBy(key, "role").agg(F.sum("l").alias("s"))
    band = total.filter("role > 0").groupBy(key).agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # one value a replicate
    line = F.struct((-F.col("l")).alias("m"), *[c for c in lines.columns if c != key])
    own = lines.groupBy(key).agg(F.sum("l").alias("score"), F.sqrt(F.sum(F.col("se") ** 2)).alias("se"), F.count_if(F.col("outside") != "").alias("extrapolated"), F.sort_array(F.collect_list(line)).alias("lines"))  # a line a signal
    j = own.join(band, key, "left").select(key, "score", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"),
        (F.col("score") - 1.959963984540054 * F.col("se")).alias("post_low"), (F.col("score") + 1.959963984540054 * F.col("se")).alias("post_high"), "extrapolated", "lines")
    j = scan_once(j.withColumn("all", F.lit(1)), shared_path(lines.sparkSession, "cards"))
    j = percentile_within(j, reference.withColumn("all", F.lit(1)), ["all"], ["score", "low", "high"], "score").drop("all")
    cuts = percentiles(reference, [], "score", [i / n_bins for i in range(1, n_bins)], "cuts")
    bin_ = lambda c: F.when(F.col(c).isNotNull(), 1 + F.size(F.filter("cuts", lambda k: k < F.col(c))))
    return j.crossJoin(F.broadcast(cuts)).withColumns({f"bin_{c}": bin_(c) for c in ("score", "low", "high")}).drop("cuts")  # one row of cuts


def redundancy(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """K6: how often two statistics are equal, and their correlation."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("equal"), F.corr(a, b).alias("correlation"))
