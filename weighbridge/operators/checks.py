"""Validation: every check is a job that gives rows (check, table, status, detail) (Q1-Q22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_check(df: DataFrame, table: str, expected: list[str]) -> DataFrame:
    """Q1: missing and unexpected columns."""
    missing, extra = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    rows = [("columns", table, "PASS" if not missing and not extra else "FAIL", f"missing: {','.join(missing)}; unexpected: {','.join(extra)}")]
    return df.sparkSession.createDataFrame(rows, "check string, table string, status string, detail string")


def value_set(df: DataFrame, column: str, declared: DataFrame) -> DataFrame:
    """Q2, Q14: values outside the declared set and declared values never seen."""
    seen = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return seen.join(F.broadcast(declared), column, "left_anti").withColumn("side", F.lit("undeclared")).unionByName(declared.join(seen, column, "left_anti").withColumn("side", F.lit("unseen")))


def dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Q3: keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).filter("n_values > 1")


def pair_grid(observed: DataFrame, declared: DataFrame, columns: list[str]) -> DataFrame:
    """Q4: combinations that are observed or declared but not both."""
    o, d = observed.select(*columns).distinct(), declared.select(*columns).distinct()
    return o.join(F.broadcast(d), columns, "left_anti").withColumn("side", F.lit("observed_only")).unionByName(d.join(o, columns, "left_anti").withColumn("side", F.lit("declared_only")))


def counted(df: DataFrame, table: str, failures: dict[str, Column]) -> DataFrame:
    """Q5, Q6, Q7, Q8, Q17: any number of row conditions in one pass; a row per check with its count of failures."""
    rows = [F.struct(F.lit(name).alias("check"), F.lit(table).alias("table"), F.count_if(bad).alias("failures")) for name, bad in failures.items()]
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def grid_check(df: DataFrame, key: str, name: str, per_key: int) -> DataFrame:
    """Q6: repeated (key, name) rows and keys without a whole grid."""
    pairs = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("c"))
    per = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("c") > 1).alias("dup"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.sum("dup").alias("repeated"), F.count_if(F.col("names") != per_key).alias("incomplete"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Q6: child keys that the parent lacks."""
    return child.select(key).distinct().join(parent.select(key).distinct(), key, "left_anti")


def signature(df: DataFrame, levels: list[str]) -> DataFrame:
    """Q10: name, type and level set of every column."""
    kinds = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, kind string")
    if not levels:
        return kinds.withColumn("levels", F.lit(""))
    sets = df.agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in levels]).unpivot([], levels, "column", "levels")
    return kinds.join(sets, "column", "left").fillna("", ["levels"])


def same_signature(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q10: both sides' signatures compared; a column of one side only is SKIP."""
    j = a.alias("a").join(b.alias("b"), "column", "full")
    one = F.col("a.kind").isNull() | F.col("b.kind").isNull()
    return j.select("column", F.when(one, "SKIP").when((F.col("a.kind") == F.col("b.kind")) & (F.col("a.levels") == F.col("b.levels")), "PASS").otherwise("FAIL").alias("status"))


def report(parts: list[DataFrame], strict: bool = False) -> DataFrame:
    """Q11: one table of all checks; strict raises when any failed."""
    out = reduce(DataFrame.unionByName, [p.select("check", "table", "status") for p in parts])
    if strict and not out.filter("status = 'FAIL'").isEmpty():
        raise ValueError("; ".join(r["check"] for r in out.filter("status = 'FAIL'").select("check").distinct().limit(50).collect()))
    return out


def captured(spark: SparkSession, checks: dict) -> DataFrame:
    """Q19: each named check runs on its own; an error becomes a row, not the end of the run."""
    rows = []
    for name, job in checks.items():
        try:
            bad = job().limit(1).count()
            rows.append((name, "site", "PASS" if not bad else "WARN"))
        except Exception as e:  # noqa: BLE001  reported, not hidden
            rows.append((name, "site", f"ERROR {type(e).__name__}"))
    return spark.createDataFrame(rows, "check string, table string, status string")


def resampling_column(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """Q12: the columns that resampling needs are complete and usable."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), F.count_distinct(stratum).alias("strata"),
        F.count_if(F.col(group).isNull()).alias("null_group"), F.count_if(F.col(stratum).isNull()).alias("null_stratum"))


def tail_occupancy(features: DataFrame, floor: int) -> DataFrame:
    """Q13: rows with any excursion on each side, and whether a side is too thin to model."""
    t = features.groupBy("signal").agg(F.count_if(F.col("k_low") > 0).alias("low_rows"), F.count_if(F.col("k_high") > 0).alias("high_rows"))
    return t.withColumn("thin_low", (F.col("low_rows") < floor).cast("int")).withColumn("thin_high", (F.col("high_rows") < floor).cast("int"))


def pool_check(counts: DataFrame, spec: DataFrame, name: str, count: str) -> DataFrame:
    """Q15: largest observed count against the declared pool."""
    return counts.groupBy(name).agg(F.max(count).alias("largest")).join(F.broadcast(spec), name).withColumn("ok", (F.col("largest") <= F.col("pool")).cast("int"))


def basis_room(features: DataFrame, group: str, covariates: list[str], basis: int) -> DataFrame:
    """Q16: distinct values of each covariate against the basis dimension."""
    long = features.select(group, *[F.col(c).cast("double") for c in covariates]).unpivot([group], covariates, "covariate", "x")
    return long.groupBy(group, "covariate").agg(F.count_distinct("x").alias("values")).withColumn("feasible", (F.col("values") >= basis).cast("int"))


def shared_invariance(a: DataFrame, key: list[str], value: str) -> DataFrame:
    """Q18: a shared covariate must be equal wherever it is used: the largest difference and how many keys differ."""
    per = a.groupBy(*key).agg((F.max(value) - F.min(value)).alias("d"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("d") > 0).alias("differ"), F.max("d").alias("largest"))


def same_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """Q22: one-sided keys and the largest absolute difference, by group."""
    j = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col(value).alias("y"), F.lit(1).alias("in_b")), keys, "full")
    return j.groupBy(by).agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"))
