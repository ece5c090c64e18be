"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store it reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session without one (tests) gets one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (where or "/tmp/checkpoints/weighbridge").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_plain_scan(df: DataFrame) -> bool:
    """df is one table's scan, with columns chosen and rows filtered at most: each of its rows is a row of a file."""
    try:
        node = df._jdf.queryExecution().analyzed()
    except (AttributeError, TypeError):  # a session that does not show its plans
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation") and not node.children().size()


def keyed_rows(docs: DataFrame) -> DataFrame:
    """__row (a number of its own for every row, the same in every run), __doc (all columns of docs), doc_id and text.

    Rows of a plain Parquet scan are numbered by file and place; those of any other frame (joined, exploded, united:
    several of its rows may stem from one row of a file) are written once.
    """
    whole = F.struct("*").alias("__doc")
    try:
        if not is_plain_scan(docs):
            raise AnalysisException("not a plain scan")
        at = docs.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"), whole)
    except AnalysisException:
        keyed = written(docs.select(F.monotonically_increasing_id().alias("__row"), whole), "keyed-rows")
    else:
        files = at.select("__path").distinct().withColumn("__file", F.row_number().over(Window.orderBy("__path")))  # one row a file
        files = written(files, "files")
        numbered = at.join(broadcast_if_small(files, files.count(), 400), "__path")
        keyed = numbered.select((F.shiftleft(F.col("__file").cast("long"), 40) + F.col("__at")).alias("__row"), "__doc")
    return keyed.select("__row", "__doc", "__doc.doc_id", "__doc.text")


def first_of_groups(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """keyed: __row, doc_id, ...; groups: __row, grp. keyed's rows less all of a group but the first: least doc_id, null last, then least row."""
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    at = written(groups.join(keyed.select("__row", "doc_id"), "__row").select("__row", "grp", last.alias("at")), "group-rows")
    first = written(at.groupBy("grp").agg(F.min("at").alias("first")), "group-firsts")
    gone = at.join(broadcast_if_small(first, first.count(), 96), "grp").filter("__row <> first.__row").select("__row")
    return keyed.join(gone, "__row", "left_anti")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def is_held_out(key: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text falls in the remainder class; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def hashed_share(key: str, seed: int, share: float) -> Column:
    """True for about that share of the rows, by a hash of the key; any positive share of a double's range counts."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 62)) < int(min(1.0, share) * (1 << 62))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Broadcast df only when its counted size is under limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields; StructType.add would change the given one."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about size bytes of a column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop
