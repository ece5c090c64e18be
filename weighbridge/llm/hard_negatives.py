"""Hard-negative mining by a secondary sort.

Every row is scored against every anchor, in blocks: rows are dealt to blocks by a
hash of their id, and the anchors travel past each block. A block sends on only what
can be among an anchor's first results: its best rows of the anchor's label, then
(with the positives known) its first rows inside each positive's window, so most
scores never enter a shuffle. What is sent carries a packed key (anchor, descending
score, positive first, id); rows are dealt by anchor and sorted by key within their
partition, and one pass over them opens a window at each positive and emits negatives
as they come by, with only the open windows in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("negative", "u1"), ("id", ">u8")])
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FLIP = np.uint64(1 << 63)
#: Rows of a block at most, about; anchors that are scored at a time.
BLOCK, TOGETHER = 32_768, 64


def packed(anchor: np.ndarray, score: np.ndarray, negative: int, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, descending score, positives first, id."""
    key = np.empty(len(ids), KEY)
    key["anchor"], key["id"] = anchor.astype(np.int64).view(np.uint64) ^ FLIP, ids.view(np.uint64) ^ FLIP
    key["score"], key["negative"] = ~(score.astype(np.int64).view(np.uint64) ^ FLIP), negative
    return pa.Array.from_buffers(pa.binary(KEY.itemsize), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())


def unpacked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    plain = lambda x: (x.astype(np.uint64) ^ FLIP).view(np.int64)
    return plain(key["anchor"]), plain(~key["score"].astype(np.uint64)), key["negative"], plain(key["id"])


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max([width, *sizes.tolist()])
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b: exact, held to 64 bits."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LOWEST, HIGHEST).astype(np.int64)


def window(score: int) -> tuple[int, int]:
    """Least and greatest score of a negative under a positive's: 0.3 to 0.9 of it, in whole numbers."""
    return -(-30 * score // 100), 90 * score // 100


class Block:
    """The rows of a block by ascending id, so that stable sorts leave ties by id."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], rows["label"].to_numpy()[order]
        self.q = matrix(rows["q"].combine_chunks())[order]

    def scores(self, q: np.ndarray) -> np.ndarray:
        width = max(q.shape[1], self.q.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        return products(wide(q), wide(self.q))


def best_of_label(block: Block, anchors: pa.RecordBatch, positives: int) -> pa.RecordBatch:
    """The block's first rows of each anchor's label."""
    ids, labels, q = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["q"])
    out = []
    for label in np.unique(labels):
        mine, rows = np.flatnonzero(labels == label), np.flatnonzero(block.labels == label)
        part = Block.__new__(Block)
        part.ids, part.q = block.ids[rows], block.q[rows]
        for anchor, score in zip(mine, part.scores(q[mine])):
            first = np.argsort(-score, kind="stable")[: positives + 1]
            first = first[part.ids[first] != ids[anchor]][:positives]
            out.append((np.full(len(first), ids[anchor]), score[first], part.ids[first]))
    cols = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "score", "id"])


def in_windows(block: Block, anchors: pa.RecordBatch, negatives: int, first_block: bool) -> pa.RecordBatch:
    """The block's first rows inside each window, as keys; the first block adds the positives themselves."""
    keys, owners = [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
    scores = block.scores(matrix(anchors["q"]))
    for anchor, label, known, score in zip(anchors["id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist(), scores):
        others = np.flatnonzero(block.labels != label)
        order = others[np.argsort(-score[others], kind="stable")]
        falling = -score[order]
        wanted = np.zeros(len(order), bool)
        for p in known:
            least, most = window(p["score"])
            at = np.searchsorted(falling, -min(most, HIGHEST), "left")
            stop = np.searchsorted(falling, -max(least, LOWEST + 1), "right")
            wanted[at : min(stop, at + negatives)] = True
        found = order[wanted]
        keys.append(packed(np.full(len(found), anchor), score[found], 1, block.ids[found]))
        owners.append(np.full(len(found), anchor))
        if first_block:
            own = [np.array([p[c] for p in known], np.int64) for c in ("score", "id")]
            keys.append(packed(np.full(len(known), anchor), own[0], 0, own[1]))
            owners.append(np.full(len(known), anchor))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.concat_arrays(keys)], ["anchor", "key"])


def past_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, each, schema: str) -> DataFrame:
    """each(block, some anchors, block number) over all blocks and anchors. The anchors travel once to each block, whose rows come before them."""
    names = [c for c in anchors.columns if c != "block"]
    kinds = dict(anchors.dtypes)
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("visits"), *(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names))
    visits = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("visits"), *names)
    met = dealt.unionByName(visits).repartitionByRange(blocks, "block").sortWithinPartitions("block", "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, block = None, [], None
        for batch in batches:
            for cut in runs(batch):
                if cut["block"][0].as_py() != number:
                    number, parts, block = cut["block"][0].as_py(), [], None
                if not cut["visits"][0].as_py():
                    parts.append(cut)
                elif parts or block:
                    block, parts = block or Block(parts), []
                    for at in range(0, cut.num_rows, TOGETHER):
                        yield each(block, cut.slice(at, TOGETHER), number)

    return met.mapInArrow(run, schema)


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of one block and one kind."""
    both = batch["block"].to_numpy().astype(np.int64) * 2 + batch["visits"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), batch.num_rows]
    for s, e in zip(cuts, cuts[1:]):
        if e > s:
            yield batch.slice(s, e - s)


def windows_of(keys: DataFrame, negatives: int) -> DataFrame:
    """The secondary sort: keys dealt by anchor and sorted within their partition; one pass opens a window
    at each positive and gives out the first negatives inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        current, open_ = None, []
        for batch in batches:
            out = []
            for anchor, score, negative, id_ in zip(*(x.tolist() for x in unpacked(batch["key"]))):
                if anchor != current:
                    current, open_ = anchor, []
                if not negative:
                    open_.append([*window(score), 0, id_, score])
                    continue
                for w in open_:
                    if w[0] <= score <= w[1] and w[2] < negatives:
                        w[2] += 1
                        out.append((anchor, w[3], w[2], id_, w[4], score))
            cols = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, cols)], names)

    dealt = keys.repartition("anchor").sortWithinPartitions("key").select("key")
    return dealt.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, label, q (floor of scale times each component) of the rows that take part, a row for each id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that
    repeat an id, the one with the least label, then the least vector, stays. Shorter vectors end in zeros.
    """
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(sound)
    kept = kept.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), q.alias("q")).alias("row"))
    return kept.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q")


def mined(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, block_rows: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id (long, distinct), label (long), q (array of whole numbers); is_anchor: a condition on them. A score is
    the inner product of q; higher come first, equal ones by id. An anchor's positives are its first other rows of
    its label; a positive's negatives are the first rows of other labels that score 0.3 to 0.9 of it. Anchors without
    a positive, and positives without a negative, give no row.
    """
    rows = written(rows.select("id", "label", "q"), "mining-rows")
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(-(-n // 1024), 2 * cores))
    anchors = rows.filter(is_anchor)
    near = past_blocks(rows, anchors, blocks, lambda block, some, _: best_of_label(block, some, positives), "anchor long, score long, id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)  # a few rows a block and anchor
    known = near.groupBy("anchor").agg(F.collect_list(F.struct("score", "id")).alias("positives"))
    ready = written(anchors.join(known.withColumnRenamed("anchor", "id"), "id"), "mining-anchors")
    keys = past_blocks(rows, ready, blocks, lambda block, some, number: in_windows(block, some, negatives, number == 0), "anchor long, key binary")
    return windows_of(keys, negatives)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 100) of embeddings, after the labels of ids divisible by 7 moved on by one.

    quantised says which rows take part and what repeated ids give, mined what ties give; an empty table gives no rows;
    other columns are ignored.
    """
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("id") % 100 == 0)


OP12_SQL = """
WITH sound AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (
  SELECT id, label, q FROM sound QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, q) = 1
), moved AS (
  SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM one
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
    CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM moved a JOIN moved b ON a.id % 100 = 0 AND a.id <> b.id
), positive AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
