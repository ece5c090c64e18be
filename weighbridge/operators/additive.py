"""Additive logistic fits by mergeable sums (A6, A8, A9, A11), keyed by job and role.

All fits take each Newton step together. A task reads its rows once a step, as arrays,
and keeps one partial Gram matrix and gradient for each (job, role): the job is given
by key columns of the row (a signal, a permutation), the role by a weight that the row
carries for it (left-out folds, bag multiplicities). Partial sums are dealt by job,
added up, and the p x p systems are solved where they meet; only coefficients travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scan_once, shared_path

#: Newton steps are cut to this, and stop when no coefficient moves by more than the second.
LONGEST, STILL = 5.0, 1e-10


def prepared(rows: DataFrame, keys: list[str], names: list[str], weights: dict[int, Column]) -> tuple[DataFrame, DataFrame]:
    """A written table of the keys, y, x (columns scaled by their root mean square within the job) and w (a weight for each role); and the scales."""
    scale = rows.groupBy(*keys).agg(F.array(*[F.sqrt(F.avg(F.col(n) ** 2)) for n in names]).alias("scale"))
    scale = scan_once(scale, shared_path(rows.sparkSession, "scales"))
    x = F.zip_with(F.array(*[F.col(n).cast("double") for n in names]), "scale", lambda a, s: F.when(s > 0, a / s).otherwise(0.0))
    w = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in weights.values()])
    same = F.broadcast(scale)  # a row for each job
    table = rows.join(same, keys).select(*keys, F.col("y").cast("double").alias("y"), x.alias("x"), w.alias("w"))
    return scan_once(table, shared_path(rows.sparkSession, "fit-rows")), scale


def dense(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def partial_sums(table: DataFrame, keys: list[str], p: int, roles: int, beta: dict[tuple, np.ndarray]) -> DataFrame:
    """Of each task and job: for every role the Gram matrix, gradient, deviance, weight and events, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            job = pa.StructArray.from_arrays([batch[k] for k in keys], keys).to_pylist()
            codes: dict[tuple, int] = {}
            code = np.array([codes.setdefault(tuple(j.values()), len(codes)) for j in job], np.int64)
            x_all, y_all, w_all = dense(batch["x"], p), batch["y"].to_numpy(), dense(batch["w"], roles)
            for job_key, c in codes.items():
                mine = code == c
                x, y, w = x_all[mine], y_all[mine][:, None], w_all[mine]
                eta = x @ beta.get(job_key, np.zeros((roles, p))).T
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                curve = w * np.maximum(mu * (1 - mu), 1e-9)
                gram = curve.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                gradient = (w * (y - mu)).T @ x
                loss = -2 * np.where(y == 1, np.log(np.maximum(mu, 1e-12)), np.log(np.maximum(1 - mu, 1e-12)))
                own = np.concatenate([gram, gradient, (w * loss).sum(0)[:, None], w.sum(0)[:, None], (w * y).sum(0)[:, None]], 1)
                sums[job_key] = sums.get(job_key, 0.0) + own
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for job_key, s in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(job_key, types)), pa.array([task], pa.int32()), pa.array([s.reshape(-1)], pa.list_(pa.float64()))], [*keys, "task", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(table.schema[k].dataType) for k in keys]
    kinds = dict(table.dtypes)
    return table.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", task int, sums array<double>")


def step(parts: DataFrame, keys: list[str], p: int, roles: int, beta: dict[tuple, np.ndarray], ridge: float) -> list:
    """Adds the tasks' sums of each job up (in the order of tasks, so that reruns agree) and solves: a row for each job and role with data."""
    kinds = dict(parts.dtypes)
    penalty = np.diag([1e-6] + [ridge] * (p - 1))

    def merged(pdf):
        import pandas as pd

        job = tuple(pdf[k].iloc[0] for k in keys)
        total = np.sum(np.stack(pdf.sort_values("task")["sums"].to_list()), axis=0).reshape(roles, -1)
        out = []
        for role, s in enumerate(total):
            gram, gradient, (deviance, n, events) = s[: p * p].reshape(p, p), s[p * p : p * p + p], s[-3:]
            if n <= 0:
                continue
            old = beta.get(job, np.zeros((roles, p)))[role]
            system = gram + penalty
            move = np.clip(np.linalg.solve(system, gradient - penalty @ old), -LONGEST, LONGEST)
            inverse = np.linalg.inv(system)
            out.append((*job, role, (old + move).tolist(), old.tolist(), float(np.abs(move).max()), float(np.trace(inverse @ gram)), inverse.reshape(-1).tolist(), deviance, n, events))
        return pd.DataFrame(out, columns=[*keys, "role", "b", "old", "moved", "edf", "covariance", "deviance", "n", "events"])

    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", role int, b array<double>, old array<double>, moved double, edf double, covariance array<double>, deviance double, n double, events double"
    return parts.groupBy(*keys).applyInPandas(merged, ddl).collect()  # a row for each job and role


def fit_jobs(rows: DataFrame, keys: list[str], names: list[str], weights: dict[int, Column], ridge: float = 1.0, iterations: int = 8) -> DataFrame:
    """Keys, role, b, covariance (p x p in one array), edf, deviance, null_deviance, n, events, prior of every fit with data.

    rows: the key columns, y (0 or 1) and the basis columns (the first is the intercept, which is all but free); weights: for each
    role what a row counts in it (0: left out). Jobs and roles are few (signals, permutations, bags); rows may be any number.
    n and events are sums of weights. Rows with a null key take no part; an empty table gives no fits.
    """
    spark, p, roles = rows.sparkSession, len(names), list(weights)
    table, scale = prepared(rows, keys, names, weights)
    beta: dict[tuple, np.ndarray] = {}
    fitted = []
    for at in range(iterations + 1):
        fitted = step(partial_sums(table, keys, p, len(roles), beta), keys, p, len(roles), beta, ridge)
        last = at == iterations or all(r["moved"] <= STILL for r in fitted)
        if last:  # sums and covariance are those of the coefficients that the step began with
            break
        for r in fitted:
            beta.setdefault(tuple(r[k] for k in keys), np.zeros((len(roles), p)))[r["role"]] = r["b"]
    out = []
    for r in fitted:
        q = min(max(r["events"] / r["n"], 1e-9), 1 - 1e-9)
        null = -2 * (r["events"] * np.log(q) + (r["n"] - r["events"]) * np.log(1 - q))
        out.append((*(r[k] for k in keys), roles[r["role"]], r["old"], r["covariance"], r["edf"], r["deviance"], float(null), r["n"], r["events"], float(np.log(q / (1 - q)))))
    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", role int, b array<double>, covariance array<double>, edf double, deviance double, null_deviance double, n double, events double, prior double"
    fits = spark.createDataFrame(out, ddl)
    inverse = F.transform("scale", lambda s: F.when(s > 0, 1 / s).otherwise(0.0))
    fits = fits.join(F.broadcast(scale), keys).withColumn("_i", inverse)
    outer = F.flatten(F.transform("_i", lambda a: F.transform("_i", lambda b: a * b)))
    return fits.withColumns({"b": F.zip_with("b", "_i", lambda c, s: c * s), "covariance": F.zip_with("covariance", outer, lambda c, s: c * s)}).drop("scale", "_i")


def leaving_out(folds: dict[int, list[int]], fold: str = "fold") -> dict[int, Column]:
    """Weights of roles that leave out the named folds."""
    return {role: (~F.col(fold).isin(*out)).cast("int") if out else F.lit(1) for role, out in folds.items()}


def linear(names: list[str], b: str | Column = "b") -> Column:
    """The linear predictor of basis columns and an array of coefficients."""
    return F.aggregate(F.zip_with(F.array(*[F.col(n) for n in names]), b, lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)
