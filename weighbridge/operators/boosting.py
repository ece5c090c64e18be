"""Gradient-boosted trees for many replicates at once (B5 by role, D8).

Rows carry bin numbers of their features and a weight for each replicate. Every level of
every replicate's tree is one pass: tasks add up gradient histograms for each (replicate,
node, feature, bin), the sums meet by replicate and give the splits; only histograms
and splits travel. A row's attribution is what each split on its path adds to the margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percentiles
from ..sources.tables import scan_once, shared_path
from .additive import dense


@dataclass
class Forest:
    """Trees of every replicate as heaps: feature (-1: leaf), bin (rows with a larger one go right), and the value of each node."""

    features: list[str]
    cuts: list[list[float]]
    depth: int
    base: dict[int, float]
    trees: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)

    def bins(self) -> Column:
        """Bin numbers of a row: how many cuts each feature exceeds; unknown values count as 0."""
        def exceeded(f: str, cuts: list[float]) -> Column:
            x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
            return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: x > cut))

        return F.array(*map(exceeded, self.features, self.cuts))

    def walk(self, x: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(levels):
            f, b = tree[0][node], tree[1][node]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > b
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def margin(self, x: np.ndarray, role: int) -> np.ndarray:
        return self.base[role] + sum((t[2][self.walk(x, t, self.depth)] for t in self.trees[role]), np.zeros(len(x)))

    def contributions(self, x: np.ndarray, role: int) -> np.ndarray:
        """Row x feature: what the splits on each feature add to the margin; the roots' values are left over."""
        out = np.zeros((len(x), len(self.features)))
        for t in self.trees[role]:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f, b = t[0][node], t[1][node]
                inner = f >= 0
                after = np.where(inner, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > b), node)
                np.add.at(out, (np.flatnonzero(inner), f[inner]), (t[2][after] - t[2][node])[inner])
                node = after
        return out


def histograms(table: DataFrame, forest: Forest, roles: list[int], level: int, growing: dict[int, tuple], n_bins: int) -> DataFrame:
    """Of each task and role: sums of gradient and hessian by node of the level, feature and bin."""
    first, nodes, width = 2**level - 1, 2**level, len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = {r: np.zeros((nodes, width, n_bins, 2)) for r in roles}
        for batch in batches:
            x, y, w = dense(batch["x"], width), batch["y"].to_numpy(), dense(batch["w"], len(roles))
            for k, r in enumerate(roles):
                mine = np.flatnonzero(w[:, k] > 0)
                xr, wr = x[mine], w[mine, k]
                p = 1 / (1 + np.exp(-forest.margin(xr, r)))
                node = forest.walk(xr, growing[r], level) - first
                live = node >= 0  # rows that stopped at a leaf above have no more to say
                g, h = (wr * (p - y[mine]))[live], (wr * p * (1 - p))[live]
                for f in range(width):
                    at = (node[live], np.full(live.sum(), f), xr[live, f])
                    np.add.at(sums[r], (*at, 0), g)
                    np.add.at(sums[r], (*at, 1), h)
        task = TaskContext.get().partitionId()
        for r in roles:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([task], pa.int32()), pa.array([sums[r].reshape(-1)], pa.list_(pa.float64()))], ["role", "task", "sums"])

    return table.mapInArrow(run, "role int, task int, sums array<double>")


def boost(rows: DataFrame, features: list[str], y: str, weights: dict[int, Column], rounds: int = 8, depth: int = 2, n_bins: int = 16, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Trees of every replicate (role of weights), level by level in the same passes.

    Cuts are quantiles of all rows, shared by the replicates. A node splits where the gain is largest (ties to the first
    feature and bin) and both sides keep a hessian of `least`. A replicate of one class only has trees without splits.
    """
    spark, roles, width = rows.sparkSession, list(weights), len(features)
    long = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).unpivot([], features, "feature", "x")
    found = {r["feature"]: sorted(set(r["q"])) for r in percentiles(long, ["feature"], "x", [i / n_bins for i in range(1, n_bins)]).collect()}  # a row a feature
    forest = Forest(features, [found.get(f, []) for f in features], depth, {})
    w = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in weights.values()])
    table = scan_once(rows.select(forest.bins().alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")), shared_path(spark, "boost-rows"))
    totals = table.agg(*[F.sum(F.col("w")[k]).alias(f"n{k}") for k in range(len(roles))], *[F.sum(F.col("w")[k] * F.col("y")).alias(f"e{k}") for k in range(len(roles))]).first()
    for k, r in enumerate(roles):
        share = min(max((totals[f"e{k}"] or 0.0) / (totals[f"n{k}"] or 1.0), 1e-6), 1 - 1e-6)
        forest.base[r], forest.trees[r] = float(np.log(share / (1 - share))), []

    def split(pdf):
        import pandas as pd

        role = int(pdf["role"].iloc[0])
        s = np.sum(np.stack(pdf.sort_values("task")["sums"].to_list()), axis=0).reshape(-1, width, n_bins, 2)
        out = []
        for node, hist in enumerate(s):
            total = hist[0].sum(0)
            value = lambda t: -t[..., 0] / (t[..., 1] + ridge)
            score = lambda t: t[..., 0] ** 2 / (t[..., 1] + ridge)
            left = hist.cumsum(1)[:, :-1]
            right = total - left
            gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(total), -1.0)
            best = int(np.argmax(np.round(gain, 9)))
            f, b = divmod(best, n_bins - 1)
            inner = gain.reshape(-1)[best] > 1e-9
            out.append((role, node, f if inner else -1, b, float(value(total)), float(value(left[f, b])), float(value(right[f, b]))))
        return pd.DataFrame(out, columns=["role", "node", "feature", "bin", "value", "left", "right"])

    for _ in range(rounds):
        size = 2 ** (depth + 1) - 1
        growing = {r: (np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for r in roles}
        for level in range(depth):
            got = histograms(table, forest, roles, level, growing, n_bins).groupBy("role").applyInPandas(split, "role int, node int, feature int, bin int, value double, left double, right double").collect()
            for g in got:
                f, b, v = growing[g["role"]]
                at = 2**level - 1 + g["node"]
                if level and f[(at - 1) // 2] < 0:  # its parent is a leaf
                    continue
                v[at] = rate * g["value"]
                if g["feature"] >= 0:
                    f[at], b[at], v[2 * at + 1], v[2 * at + 2] = g["feature"], g["bin"], rate * g["left"], rate * g["right"]
        for r in roles:
            forest.trees[r].append(growing[r])
    return forest


def attributions(rows: DataFrame, key: str, forest: Forest, roles: list[int]) -> DataFrame:
    """role, key, feature, a of every row and replicate."""
    kind = dict(rows.dtypes)[key]
    names = forest.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch["x"], len(names))
            for r in roles:
                a = forest.contributions(x, r)
                keys = batch["key"].take(pa.array(np.repeat(np.arange(len(x)), len(names))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, r, np.int32)), keys, pa.array(names * len(x)), pa.array(a.reshape(-1))], ["role", "key", "feature", "a"])

    return rows.select(F.col(key).alias("key"), forest.bins().alias("x")).mapInArrow(run, f"role int, key {kind}, feature string, a double").withColumnRenamed("key", key)


def held_losses(rows: DataFrame, y: str, forest: Forest, weights: dict[int, Column]) -> dict[int, list[float]]:
    """Of every replicate the log-loss of its held rows (weights) after each round, all in one pass; a replicate without held rows has none."""
    roles, width = list(weights), len(forest.features)
    w = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in weights.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: np.zeros(len(forest.trees[r]) + 1) for r in roles}
        for batch in batches:
            x, label, w = dense(batch["x"], width), batch["y"].to_numpy(), dense(batch["w"], len(roles))
            for k, r in enumerate(roles):
                mine = np.flatnonzero(w[:, k] > 0)
                margin, sign = np.full(len(mine), forest.base[r]), 1 - 2 * label[mine]
                sums[r][-1] += w[mine, k].sum()
                for i, tree in enumerate(forest.trees[r]):
                    margin = margin + tree[2][forest.walk(x[mine], tree, forest.depth)]
                    sums[r][i] += (w[mine, k] * np.logaddexp(0, sign * margin)).sum()
        for r in roles:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([sums[r]], pa.list_(pa.float64()))], ["role", "loss"])

    parts = rows.select(forest.bins().alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).mapInArrow(run, "role int, loss array<double>")
    total = parts.select("role", F.posexplode("loss").alias("i", "v")).groupBy("role", "i").agg(F.sum("v").alias("v"))
    found: dict[int, dict[int, float]] = {}
    for r in total.collect():  # rounds x replicates
        found.setdefault(r["role"], {})[r["i"]] = r["v"]
    return {r: [v[i] for i in range(len(v) - 1)] if v and v[max(v)] > 0 else [] for r, v in found.items()}


def margins(rows: DataFrame, forest: Forest, role: str, columns: list[str]) -> DataFrame:
    """The columns, and margin: that of the replicate that the role column names (rows of other roles have none and are left out)."""
    kinds, width = dict(rows.dtypes), len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = dense(batch["_x"], width), batch["_role"].to_numpy()
            out = np.zeros(len(x))
            for r in np.unique(own):
                out[own == r] = forest.margin(x[own == r], int(r))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out)], [*columns, "margin"])

    known = rows.filter(F.col(role).isin(*forest.trees)).select(*columns, F.col(role).cast("int").alias("_role"), forest.bins().alias("_x"))
    return known.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", margin double")
