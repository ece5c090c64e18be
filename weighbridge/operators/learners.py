"""Comparator designs and learners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percentiles, uniform
from ..sources.tables import scan_once, shared_path
from . import boosting


def wide_design(long: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One column per declared name, null when absent; the names are declared, so no pass collects them."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """B1: an indicator per column and its median where unknown; columns that are null everywhere go."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    med = dict.fromkeys(columns) | {r["name"]: r["q"][0] for r in percentiles(long, ["name"], "v", [0.5]).collect()}  # one row a declared column
    live = [c for c in columns if med[c] is not None]
    return df.drop(*[c for c in columns if c not in live]).withColumns({f"{c}_known": F.col(c).isNotNull().cast("double") for c in live}).fillna({c: float(med[c]) for c in live})


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns in the given order, null where absent."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def boosted(design: DataFrame, features: list[str], key: str, y: str, validation: str, rounds: int = 10, depth: int = 3):
    """Gradient-boosted trees with grouped early stopping; (key, y, l = logit p - logit base rate, p clipped), model."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=features, outputCol="v").transform(design.withColumn("label", F.col(y).cast("double")).withColumn("held", F.col(validation).cast("boolean")))
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=rounds, maxDepth=depth, validationIndicatorCol="held", seed=1).fit(v)
    base = design.agg(F.avg(F.col(y).cast("double"))).first()[0]
    p = F.least(F.greatest(F.element_at(vector_to_array("probability"), 2), F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = model.transform(v).withColumn("p", p)
    return scored.select(key, y, (F.log(F.col("p") / (1 - F.col("p"))) - F.log(F.lit(base) / (1 - F.lit(base)))).alias("l")), model


def raw_design(features: DataFrame, key: str, name: str, values: list[str], names: list[str]) -> DataFrame:
    """B1: one column name__value per declared name and value, null where unmeasured; columns that are null everywhere go (one aggregate)."""
    wide = features.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(v))).alias(f"{n}__{v}") for n in names for v in values])
    columns = [c for c in wide.columns if c != key]
    seen = wide.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict()
    return wide.select(key, *[F.col(f"`{c}`") for c in columns if seen[c]])


def constructed_design(covariates: DataFrame, interventions: DataFrame, key: str, names: list[str], covariate_names: list[str], intervention_names: list[str]) -> DataFrame:
    """B2: the modelled covariates of every signal (long: key, signal, covariate, x) and each intervention's exposure once (key, intervention, x; absent: 0)."""
    left = covariates.groupBy(key).agg(*[F.max(F.when((F.col("signal") == s) & (F.col("covariate") == c), F.col("x"))).alias(f"{s}__{c}") for s in names for c in covariate_names])
    right = interventions.groupBy(key).agg(*[F.max(F.when(F.col("intervention") == i, F.col("x"))).alias(f"{i}__exposure") for i in intervention_names])
    return left.join(right, key, "left").fillna(0.0, [f"{i}__exposure" for i in intervention_names])


def cross_fitted(design: DataFrame, features: list[str], key: str, y: str, fold: str, n_folds: int, rounds: int = 10, depth: int = 3, held_share: float = 0.25) -> DataFrame:
    """Every row scored by trees that never saw its fold: key, fold, y, rounds, l = logit p - logit of the training rate, p clipped.

    For each fold a hashed share of the other folds' keys chooses the number of rounds (early stopping); the trees are then
    grown again on all rows of the other folds. The trees of all folds grow in the same passes. A fold whose training rows hold one
    outcome class gives null l and 0 rounds. Unknown features count as 0.
    """
    cols = [F.col(key).alias("_key"), F.col(fold).cast("int").alias("_fold"), F.col(y).alias("_y"), (uniform(F.lit("inner"), F.col(key)) < held_share).alias("_held")]
    rows = scan_once(design.select(*cols, *[F.col(f).cast("double").alias(f) for f in features]), shared_path(design.sparkSession, "boosting-rows"))
    seen = [(r["_fold"], r["_held"], int(r["_y"])) for r in rows.select("_fold", "_held", "_y").distinct().filter("_y is not null").collect()]  # folds x 4
    classes = {f: {(held, label) for other, held, label in seen if other is not None and other != f} for f in range(1, n_folds + 1)}
    usable = [f for f, c in classes.items() if len({label for _, label in c}) == 2]
    out = rows.select(F.col("_key").alias(key), F.col("_fold").alias("fold"), F.col("_y").alias("y"))
    if not usable:
        return out.select("*", F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("l"))
    best = dict.fromkeys(usable, rounds)
    if early := [f for f in usable if len(classes[f]) == 4]:
        first = boosting.boost(rows, features, "_y", {f: (F.col("_fold") != f) & ~F.col("_held") for f in early}, rounds, depth)
        losses = boosting.held_losses(rows, "_y", first, {f: (F.col("_fold") != f) & F.col("_held") for f in early})
        best |= {f: 1 + min(range(rounds), key=lambda i, v=v: (round(v[i], 9), i)) for f, v in losses.items() if v}
    forest = boosting.boost(rows, features, "_y", {f: F.col("_fold") != f for f in usable}, max(best.values()), depth)
    for f in usable:  # fewer rounds are a prefix of more
        forest.trees[f] = forest.trees[f][: best[f]]
    scored = boosting.margins(rows, forest, "_fold", ["_key", "_fold", "_y"])
    p = F.least(F.greatest(1 / (1 + F.exp(-F.col("margin"))), F.lit(1e-6)), F.lit(1 - 1e-6))
    of_fold = F.create_map(*[F.lit(x) for f in usable for x in (f, best[f])])[F.col("_fold")]
    base = F.create_map(*[F.lit(x) for f in usable for x in (f, forest.base[f])])[F.col("_fold")]
    got = scored.select(F.col("_key").alias(key), F.col("_fold").alias("fold"), F.col("_y").alias("y"), of_fold.alias("rounds"), (F.log(p / (1 - p)) - base).alias("l"))
    rest = out.filter(F.col("fold").between(1, n_folds) & ~F.col("fold").isin(*usable)).select("*", F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("l"))
    return got.unionByName(rest)


def importances(model, features: list[str], spark) -> DataFrame:
    """Gain per feature, its group (the part before '__'), and the group's sum."""
    rows = spark.createDataFrame([(f, f.split("__")[0], float(w)) for f, w in zip(features, model.featureImportances.toArray())], "feature string, grp string, gain double")
    return rows.join(rows.groupBy("grp").agg(F.sum("gain").alias("group_gain")), "grp")
