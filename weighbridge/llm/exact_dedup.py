"""Exact dedup by skew-safe combining of salted digest groups.

Three combining stages, each grouping on the digest *and* the full normalised
text, so that two texts with one digest never merge:

1. local: Spark's map-side aggregation collapses copies inside each task;
2. salted: rows of a hot digest are dealt over ``salts`` groups, so no task
   receives more than its share of a group that holds a large part of the rows;
3. global: the salt winners of the hot digests are combined.

A digest is hot when it holds at least ``1 / hot_limit`` of all rows, hence at
most ``hot_limit`` digests are, and that list is the only thing broadcast.
Texts move over the network once; the verdict goes back to the rows by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, first_of_groups, keyed_rows, table, written

ID_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Every run of space characters becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def combine(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """(sha, text, id) rows to one row (sha, keep, size) for each distinct (sha, text)."""
    dealt = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sha", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(-1))
    )
    first = dealt.groupBy("sha", "salt", "text").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    # a cold digest is complete here, so its text is not needed any more
    first = written(first.withColumn("text", F.when(F.col("salt") >= 0, F.col("text"))), "dedup-salted")
    cold = first.filter("salt < 0").select("sha", "keep", "size")
    merged = first.filter("salt >= 0").groupBy("sha", "text").agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
    return cold.unionByName(merged.select("sha", "keep", "size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, hot_limit: int = 1000, digest_chars: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the row with the smallest
    id stays. A null text is an empty one. Rows without an id never displace
    one that has an id; in a group without any id all rows stay. Rows that repeat one id and
    text are indistinguishable and stay or go together. An empty table gives no
    rows; other columns are ignored. digest_chars shortens the grouping digest
    (tests use it to force collisions); the returned digest is always whole.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id0"), normalised(F.col(text_col)).alias("text"))
    base = base.withColumn("text_sha256", F.sha2("text", 256)).withColumn("sha", F.substring("text_sha256", 1, digest_chars))
    base = base.withColumn("id", F.coalesce("id0", F.lit(ID_LAST)))
    digests = written(base.select("id0", "id", "sha", "text_sha256") if digest_chars < 64 else base.select("id0", "id", "sha"), "dedup-digests")
    if digest_chars == 64:
        digests = digests.withColumn("text_sha256", F.col("sha"))
    per_digest = written(digests.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dedup-counts")
    total = digests.count()
    hot = per_digest.filter(F.col("n") >= max(2, -(-total // hot_limit))).select("sha")
    won = combine(base.select("sha", "text", "id"), hot, salts)
    won = won.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sha", "left")
    won = written(won.withColumn("hot", F.coalesce("hot", F.lit(False))), "dedup-won")
    clashing = won.groupBy("sha").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("sha")
    if clashing.isEmpty():
        groups = won.filter("size > 1")
        near = digests.join(F.broadcast(groups.filter("hot").drop("hot")), "sha", "left")
        done = near.filter("size is not null")
        rest = near.filter("size is null").drop("keep", "size").join(groups.filter("not hot").drop("hot"), "sha", "left")
        out = done.unionByName(rest)
    else:  # unequal texts share a digest: the verdict goes back by digest and whole text
        texts = base.select("sha", "text", "id").groupBy("sha", "text").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
        out = base.select("id0", "id", "sha", "text", "text_sha256").join(texts, ["sha", "text"]).drop("text")
    keep = F.coalesce(F.col("keep"), F.col("id"))
    keep_id = F.when(keep < ID_LAST, keep)
    return out.select(
        F.col("id0").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id") == keep).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents; exact_dedup says what nulls, repeated rows and empty tables give."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts, that of the smallest doc_id; null ids come last.

    Rows are told apart by a row key, so repeated and null ids
    neither lose another row nor keep a copy. All columns come back, whatever
    their names; a null text is an empty one; an empty table gives no rows.
    """
    keyed = keyed_rows(docs)
    groups = exact_dedup(keyed, id_col="__row").filter("group_size > 1").select(F.col("doc_id").alias("__row"), F.col("keep_id").alias("grp"))
    return first_of_groups(keyed, groups).select("__doc.*")
