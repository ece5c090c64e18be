"""Scans, load guards and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    """One table; a declared schema is never inferred again, and a missing path is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one; a cluster's machines do not share /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or "/tmp/checkpoints/weighbridge").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def load_tables(spark: SparkSession, sf_dir: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The logical tables of a site by declared schema, registered as temporary views."""
    out = {n: scan(spark, sf_dir, n, StructType.fromDDL(ddl)) for n, ddl in schemas.items()}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def outside_vocabulary(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """S8 (and S3-S5): values of a column that its closed vocabulary lacks, with their counts."""
    levels = df.sparkSession.createDataFrame([(x,) for x in allowed], f"{column} string")
    found = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(levels), column, "left_anti")


def require_vocabulary(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Df with rows that raise when a value is outside the vocabulary (checked where the row is read)."""
    ok = F.col(column).isNull() | F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(F.assert_true(ok, F.concat(F.lit(f"{column} outside vocabulary: "), F.coalesce(column, F.lit("")))).isNull(), F.col(column)))


def null_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Values outside bounds become null; the second result counts them per column in one pass."""
    bad = {c: F.col(c).isNotNull() & ~F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()}
    counts = df.agg(*[F.sum(b.cast("long")).alias(c) for c, b in bad.items()])
    return df.withColumns({c: F.when(~b, F.col(c)) for c, b in bad.items()}), counts


def stamp_site(df: DataFrame, site: str) -> DataFrame:
    """The constant site column, first."""
    return df.select(F.lit(site).alias("site"), *[c for c in df.columns if c != "site"])


def group_table(rows: DataFrame, key: str, group: str) -> DataFrame:
    """One row per key: the group when all copies agree, status 'ok', 'conflict' or 'missing'."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(group).alias("n_groups"), F.min(group).alias(group), F.count_if(F.col(group).isNull()).alias("n_null"))
    status = F.when((F.col("n_null") > 0) | (F.col("n_groups") == 0), "missing").when(F.col("n_groups") > 1, "conflict").otherwise("ok")
    return g.select(key, F.when(status == "ok", F.col(group)).alias(group), "copies", status.alias("status"))


def match_counts(keys: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Matched and unmatched keys, both ways."""
    both = keys.select(key).distinct().withColumn("l", F.lit(1)).join(groups.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    hit = lambda c: F.sum(c.cast("long"))
    return both.agg(hit(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), hit(F.col("r").isNull()).alias("without_group"), hit(F.col("l").isNull()).alias("without_key"))


def spec_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A declared specification. Its size is fixed by the source, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, ddl).coalesce(1))


def resolved_spec(spark: SparkSession, names: list[str], fields: dict[str, tuple[str, object]], overrides: dict[str, dict]) -> DataFrame:
    """One row per declared name with every field (type, default) resolved; an override that is None keeps the default."""
    rows = [(n, *[default if (own := overrides.get(n, {}).get(f)) is None else own for f, (_, default) in fields.items()]) for n in names]
    return spec_table(spark, rows, "signal string, " + ", ".join(f"{f} {kind}" for f, (kind, _) in fields.items()))


def windowed_scan(source: DataFrame, cohort: DataFrame, key: str, at: str) -> DataFrame:
    """Source rows of cohort members inside [intime, landmark). Time bounds of the cohort prune the scan first."""
    span = cohort.agg(F.min("intime").alias("lo"), F.max("landmark").alias("hi")).first()
    if span[0] is not None:
        source = source.filter((F.col(at) >= F.lit(span["lo"])) & (F.col(at) < F.lit(span["hi"])))
    return source.join(cohort.select(key, "intime", "landmark"), key).filter((F.col(at) >= F.col("intime")) & (F.col(at) < F.col("landmark")))


def write_clustered(df: DataFrame, path: str, partition: str, cluster: list[str]) -> None:
    """Partitioned by a small closed key, sorted by the cluster columns inside."""
    df.repartition(partition, *cluster[:1]).sortWithinPartitions(partition, *cluster).write.mode("overwrite").partitionBy(partition).parquet(path)


def scan_once(df: DataFrame, path: str) -> DataFrame:
    """A filtered slice that two consumers share, written once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_to_parquet(spark: SparkSession, csv: str, schema: StructType | str, out: str) -> DataFrame:
    """Declared schema, header line, empty text as null."""
    spark.read.csv(csv, header=True, schema=schema, nullValue="").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def save_result(df: DataFrame, path: str) -> None:
    """A result table as parquet and as CSV with nulls empty."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").csv(f"{path}.csv", header=True, nullValue="")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash of a table."""
    h: Column = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.min(h).alias("hash_min"), F.max(h).alias("hash_max"))
