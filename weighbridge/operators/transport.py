"""Frozen parameters at another site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import retained


def save_bundle(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Parameter tables as parquet with a version column."""
    for name, df in tables.items():
        df.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def load_bundle(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def apply_scores(features: DataFrame, parameters: DataFrame, key: str) -> DataFrame:
    """A frozen linear weight per signal and side: l = w_low pi_low + w_high pi_high + w_0; unmeasured adds 0."""
    j = features.join(F.broadcast(parameters), "signal", "left")
    l = F.when(F.col("n_obs") > 0, F.col("w_0") + F.col("w_low") * F.col("k_low") / F.col("n_obs") + F.col("w_high") * F.col("k_high") / F.col("n_obs")).otherwise(0.0)
    return j.select(key, "signal", F.coalesce(l, F.lit(0.0)).alias("l"))


def transport_table(site: DataFrame, train: DataFrame, arm: str) -> DataFrame:
    """T4: site and training metrics by arm: difference, ratio, share retained above chance."""
    j = site.select(arm, F.col("auroc").alias("site_auroc"), F.col("auprc").alias("site_auprc")).join(train.select(arm, F.col("auroc").alias("train_auroc"), F.col("auprc").alias("train_auprc")), arm)
    return j.withColumns({"difference": F.col("site_auroc") - F.col("train_auroc"), "ratio": F.try_divide("site_auprc", "train_auprc"), "retained": retained(F.col("site_auroc"), F.col("train_auroc"))})


def available_contrasts(pairs: DataFrame, arms: DataFrame) -> DataFrame:
    """T5: contrasts of which both arms exist."""
    return pairs.join(arms.select(F.col("arm").alias("a")), "a", "left_semi").join(arms.select(F.col("arm").alias("b")), "b", "left_semi")


def merged_bins(bins: DataFrame, per: int) -> DataFrame:
    """Fine frozen bins joined into deciles or quartiles."""
    return bins.groupBy((F.floor((F.col("bin") - 1) / per) + 1).alias("stratum")).agg(F.sum("n").alias("n"), F.sum("events").alias("events"), (F.sum("events") / F.sum("n")).alias("rate"))


def reference_stratum(scores: DataFrame, cuts: DataFrame, reference: DataFrame) -> DataFrame:
    """Each score's frozen bin and that bin's training rate with its interval (one row per bin)."""
    s = scores.crossJoin(F.broadcast(cuts)).withColumn("bin", F.expr("size(filter(cuts, c -> c < score)) + 1")).drop("cuts")
    return s.join(F.broadcast(reference.select("bin", F.col("rate").alias("reference_rate"), F.col("low").alias("reference_low"), F.col("high").alias("reference_high"))), "bin", "left")
