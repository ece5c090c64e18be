"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target (its share by weight, capped at ``cap`` times its
size, the excess reshared). A document of the source is taken
``target / source size`` times on average: the whole part always, the fraction
as an inclusion probability. The flight phase moves the probabilities through
the null-space of two constraints (words and documents of the source) until
at most two units of a block are undecided; blocks are merged level by level
until one block of a source is left. Its last two units and a reserve of small
ones are landed together: of all their subsets that meet both totals, one is
drawn by its likelihood under the probabilities. Very long documents are decided
first; what they leave over of words and documents is spread over the
probabilities of the others, linear in size, so that both totals stay.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, table, written

WEIGHTS = (5.0, 2.0, 1.0)
EPS = 1e-9
LAND = 16  # units of a source that wait for the landing: their sizes halve from the largest unit's


def words_in_text() -> Column:
    """Words of the whole text (null: 0)."""
    return F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in_text().alias("size"))


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, documents, target, rank. Ordered by code point, null last.

    Only this table, a row for each source, is ranked in one task; documents never are.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    per = per.withColumn("rank", rank)
    per = written(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights)) + 1)), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while total:  # each pass caps more sources or ends
        above = F.col("weight") * level > F.col("source_size") * cap
        got = per.agg(F.sum(F.when(above, F.col("source_size") * cap)), F.sum(F.when(~above, F.col("weight"))), F.sum(above.cast("long"))).first()
        if got[2] == before:
            break
        before, level = got[2], (total - (got[0] or 0.0)) / got[1]
    return per.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * cap)).drop("weight")


def flight(pi: list[float], a: list[float], b: list[float], draw) -> None:
    """Moves pi in place until at most two entries are strictly between 0 and 1; sums of a*pi and b*pi stay."""
    waiting = [i for i in range(len(pi)) if EPS < pi[i] < 1 - EPS]
    waiting.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            break
        i, j, k = held
        u = (a[j] * b[k] - a[k] * b[j], a[k] * b[i] - a[i] * b[k], a[i] * b[j] - a[j] * b[i])
        if not any(u):  # one ratio of words to documents: two units already have a null direction
            u = (b[j], -b[i], 0.0)
        up = min(((1 - pi[x]) / v if v > 0 else -pi[x] / v) for x, v in zip(held, u) if v)
        down = min((pi[x] / v if v > 0 else (pi[x] - 1) / v) for x, v in zip(held, u) if v)
        step = up if draw() * (up + down) < down else -down
        for x, v in zip(held, u):
            pi[x] += step * v
            if pi[x] < EPS:
                pi[x] = 0.0
            elif pi[x] > 1 - EPS:
                pi[x] = 1.0
        held = [x for x in held if EPS < pi[x] < 1 - EPS]


def reserve(a: list[float]) -> set[int]:
    """Units that wait for the landing: of every halving of the largest unit's words (a, falling) the nearest ones left, the largest never."""
    chosen: set[int] = set()
    size, falling = a[0] / 2 if a else 0.0, np.array(a)
    order = np.arange(1, len(a))
    while len(chosen) < min(LAND, len(order)):
        near = [int(i) for i in order[np.argsort(np.abs(falling[1:] - size), kind="stable")][: 3 * LAND] if int(i) not in chosen]
        if not near:
            break
        chosen |= set(near[:2])
        size = size / 2 if size > 1 else a[0] / 3
    return set(sorted(chosen)[-LAND:])


def landing(pi: list[float], a: list[float], b: list[float], words: float, documents: float, draw=None, near: float = 1.0) -> None:
    """Decides the last few open units in place.

    Of all their subsets those are in question that bring the totals within `near` words and one document, or else nearest (in
    these units); among them draw() picks one by its likelihood under pi. Without draw the nearest is taken, words before documents.
    """
    last = [i for i, p in enumerate(pi) if EPS < p < 1 - EPS]
    open_ = set(last)
    sums = [np.array([sum(c[i] * pi[i] for i in range(len(pi)) if i not in open_) - want]) for c, want in ((a, words), (b, documents))]
    likely, subset = np.zeros(1), np.zeros(1, np.int64)
    for k, i in enumerate(last):  # every subset, by doubling
        sums = [np.concatenate([x, x + c[i]]) for x, c in zip(sums, (a, b))]
        likely = np.concatenate([likely + math.log(1 - pi[i]), likely + math.log(pi[i])])
        subset = np.concatenate([subset, subset | 1 << k])
    off = [np.abs(x) for x in sums]
    if draw is None:
        best = subset[np.lexsort((off[1], np.round(off[0], 6)))[0]]
    else:
        good = np.flatnonzero((off[0] <= near) & (off[1] <= 1))
        if not len(good):
            cost = off[0] / near + off[1]
            good = np.flatnonzero(cost <= cost.min() + 1e-9)
        weight = np.cumsum(np.exp(likely[good] - likely[good].max()))
        best = subset[good[min(int(np.searchsorted(weight, draw() * weight[-1], "right")), len(good) - 1)]]
    for k, i in enumerate(last):
        pi[i] = float(best >> k & 1)


def _fly(seed: int):
    """A block's flight, the largest units first. The only block of a source holds a reserve back and lands it with what the flight leaves
    open, to 0.005 % of source_words; off_words and off_documents are what the totals wanted exceed the probabilities by."""

    def run(key, pdf):
        import random

        pdf = pdf.assign(_words=-pdf["size"] * pdf["n"]).sort_values(["_words", "order", "doc_id", "n"], kind="stable")
        pi, a, b = pdf["pi"].tolist(), (-pdf["_words"]).astype(float).tolist(), pdf["n"].astype(float).tolist()
        rank, block, blocks = map(int, key)
        words, documents = (sum(x * p for x, p in zip(c, pi)) + float(pdf[off].iloc[0]) for c, off in ((a, "off_words"), (b, "off_documents")))
        kept_back = reserve(a) if blocks == 1 else set()
        fliers = [i for i in range(len(pi)) if i not in kept_back]
        flying = [pi[i] for i in fliers]
        draw = random.Random(f"{seed}:{rank}:{block}").random
        flight(flying, [a[i] for i in fliers], [b[i] for i in fliers], draw)
        for i, p in zip(fliers, flying):
            pi[i] = p
        if blocks == 1:
            landing(pi, a, b, words, documents, draw, max(1.0, 5e-5 * float(pdf["source_words"].iloc[0])))
        return pdf.drop(columns="_words").assign(pi=pi)

    return run


def flown(units: DataFrame, block_rows: int, seed: int) -> DataFrame:
    """Decides units (rank, pi strictly between 0 and 1): blocks of a source fly, what they leave open forms the next level's blocks, one block lands."""
    counts = written(units.groupBy("rank").agg(F.count(F.lit(1)).alias("k")), "mix-open")
    n_sources, most = counts.agg(F.count(F.lit(1)), F.max("k")).first()
    done, level = [], 0
    while most:
        blocks = counts.select("rank", F.ceil(F.col("k") / block_rows).alias("blocks")).filter("blocks > 0")
        dealt = units.join(broadcast_if_small(blocks, n_sources, 64), "rank").withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), "blocks"))
        got = written(dealt.groupBy("rank", "block", "blocks").applyInPandas(_fly(seed + level), dealt.schema).drop("block", "blocks"), "mix-flown")
        done.append(got.filter("pi in (0.0, 1.0)"))
        if most <= block_rows:
            break
        units, level = got.filter("pi not in (0.0, 1.0)"), level + 1
        counts = counts.select("rank", F.when(F.col("k") > block_rows, 2 * F.ceil(F.col("k") / block_rows)).otherwise(0).alias("k"))
        most = 2 * math.ceil(most / block_rows)
    return reduce(DataFrame.unionByName, done) if done else units


def balanced(units: DataFrame, block_rows: int = 5_000, seed: int = 7, heavy: float = 16.0) -> DataFrame:
    """units: rank (of the source), doc_id, source, size, n, whole, pi. The same with pi 0 or 1.

    Units of more than `heavy` times their source's mean words are decided first. What their decision leaves over of the
    words and documents wanted is added to the inclusion probabilities of the source's other units, linear in their size, so that
    both totals stay; what the bounds 0 and 1 cut off is left to the landing.
    """
    units = units.withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed)))
    is_open, words = F.col("pi").between(EPS, 1 - EPS), F.col("size") * F.col("n")
    done = units.filter(~is_open).withColumn("pi", F.when(F.col("pi") >= 0.5, 1.0).otherwise(0.0))
    mean = units.filter(is_open).groupBy("rank").agg((heavy * F.avg(words)).alias("most"), F.sum((F.col("whole") + F.col("pi")) * words).alias("source_words"))
    n_sources = mean.count()
    parted = units.filter(is_open).join(broadcast_if_small(mean, n_sources, 64), "rank").withColumn("heavy", words > F.col("most")).drop("most")
    parted = written(parted.withColumns({"off_words": F.lit(0.0), "off_documents": F.lit(0.0)}), "mix-parted")
    large = written(flown(parted.filter("heavy").withColumn("pi0", F.col("pi")), block_rows, seed), "mix-heavy")
    total = lambda c, n: F.sum(c).alias(n)
    left = large.groupBy("rank").agg(total((F.col("pi0") - F.col("pi")) * words, "w"), total((F.col("pi0") - F.col("pi")) * F.col("n"), "d"))
    rest = parted.filter("not heavy")
    s0, s1, s2, w, d = (F.col(c) for c in ("s0", "s1", "s2", "w", "d"))
    det = s0 * s2 - s1 * s1
    slope = F.when(det > 1e-9 * s0 * s2, (s0 * w - s1 * d) / det).otherwise(0.0)
    room = rest.groupBy("rank").agg(total(F.col("n").cast("double"), "s0"), total(words.cast("double"), "s1"), total((words * F.col("size")).cast("double"), "s2")).join(left, "rank", "left").fillna(0.0, ["w", "d"])
    room = room.withColumn("slope", slope).select("rank", "w", "d", "slope", ((d - F.col("slope") * s1) / s0).alias("shift"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pi") + F.col("shift") + F.col("slope") * F.col("size")))
    rest = written(rest.join(broadcast_if_small(room, n_sources, 64), "rank").withColumn("pi0", F.col("pi")).withColumn("pi", moved).drop("shift", "slope"), "mix-rest")
    sure = F.col("pi").between(EPS, 1 - EPS)
    settled = F.when(sure, F.col("pi")).otherwise(F.round("pi"))
    short = lambda c: F.sum((F.col("pi0") - settled) * c)
    off = rest.groupBy("rank").agg((F.first("w") + short(words)).alias("off_words"), (F.first("d") + short(F.col("n"))).alias("off_documents"))
    rest = rest.drop("w", "d", "pi0", "off_words", "off_documents").join(broadcast_if_small(off, n_sources, 64), "rank")
    small = flown(rest.filter(sure), block_rows, seed + 100)
    return reduce(DataFrame.unionByName, [done, *(x.select(done.columns) for x in (large, rest.filter(~sure).withColumn("pi", F.round("pi")), small))])


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, block_rows: int = 5_000) -> DataFrame:
    """sized: doc_id, source, size. One row per distinct (doc_id, source, size) with n (rows that share it),
    source_size, target and times (how often each of these rows is taken).

    A null source is a source of its own, last in order. Rows that repeat a
    document, source and size form one unit and are taken alike. Documents of size 0 count towards the document
    balance and take no words. The same rows give the same result, however they are dealt out.
    """
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    per = written(targets(units, weights, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.join(broadcast_if_small(per.withColumnRenamed("source", "source_"), per.count(), 96), F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "documents")
    ready = joined.withColumn("whole", F.floor(ratio)).withColumn("pi", ratio - F.floor(ratio))
    ready = written(ready, "mix-ready")
    return balanced(ready, block_rows).withColumn("times", (F.col("whole") + F.col("pi")).cast("long"))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents; one row per row. Null texts have no words; rows that repeat id, source and size are taken alike;
    equal sizes are told apart by a hash of the id; very long texts are counted whole and decided first; an empty table gives no rows;
    other columns are ignored."""
    out = mix(sizes(table(spark, sf_dir, "documents"))).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document appears as often as the mix takes it, with all its columns, whatever their names.

    Rows that repeat id, source and size are taken alike, each as a row of its own; null ids and sources match themselves.
    An empty table gives no rows.
    """
    taken = mix(sizes(docs)).filter("times > 0").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "times")])
    rows = docs.select(F.struct("*").alias("__doc"), "doc_id", "source", words_in_text().alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("n_words") == F.col("_size"))
    return rows.join(taken, same).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("__doc.*")
