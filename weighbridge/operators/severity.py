"""Severity inputs and band scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band, logit, spearman

# Published bands of the acute physiology score (Knaus et al., Crit Care Med 1985;13:818-829) and of the organ failure
# score (Vincent et al., Intensive Care Med 1996;22:707-710).
# variable -> (right-open breaks, points); the last points hold from the last break on.
APACHE_BANDS = {
    "temperature": ([30.0, 32.0, 34.0, 36.0, 38.5, 39.0, 41.0], [4, 3, 2, 1, 0, 1, 3, 4]),
    "map": ([50.0, 70.0, 110.0, 130.0, 160.0], [4, 2, 0, 2, 3, 4]),
    "heart_rate": ([40.0, 55.0, 70.0, 110.0, 140.0, 180.0], [4, 3, 2, 0, 2, 3, 4]),
    "resp_rate": ([6.0, 10.0, 12.0, 25.0, 35.0, 50.0], [4, 2, 1, 0, 1, 3, 4]),
    "ph": ([7.15, 7.25, 7.33, 7.5, 7.6, 7.7], [4, 3, 2, 0, 1, 3, 4]),
    "sodium": ([111.0, 120.0, 130.0, 150.0, 155.0, 160.0, 180.0], [4, 3, 2, 0, 1, 2, 3, 4]),
    "potassium": ([2.5, 3.0, 3.5, 5.5, 6.0, 7.0], [4, 2, 1, 0, 1, 3, 4]),
    "creatinine": ([0.6, 1.5, 2.0, 3.5], [2, 0, 2, 3, 4]),
    "hematocrit": ([20.0, 30.0, 46.0, 50.0, 60.0], [4, 2, 0, 1, 2, 4]),
    "wbc": ([1.0, 3.0, 15.0, 20.0, 40.0], [4, 2, 0, 1, 2, 4]),
}
BICARBONATE_BAND = ([15.0, 18.0, 22.0, 32.0, 41.0, 52.0], [4, 3, 2, 0, 1, 3, 4])
PAO2_BAND = ([55.0, 61.0, 71.0], [4, 3, 1, 0])
GRADIENT_BAND = ([200.0, 350.0, 500.0], [0, 2, 3, 4])
AGE_BAND = ([45.0, 55.0, 65.0, 75.0], [0, 2, 3, 5, 6])
SOFA_BANDS = {
    "respiration": ([100.0, 200.0, 300.0, 400.0], [4, 3, 2, 1, 0]),
    "coagulation": ([20.0, 50.0, 100.0, 150.0], [4, 3, 2, 1, 0]),
    "liver": ([1.2, 2.0, 6.0, 12.0], [0, 1, 2, 3, 4]),
    "nervous": ([6.0, 10.0, 13.0, 15.0], [4, 3, 2, 1, 0]),
    "renal": ([1.2, 2.0, 3.5, 5.0], [0, 1, 2, 3, 4]),
}
ORGANS = ["respiration", "coagulation", "liver", "cardiovascular", "nervous", "renal"]


def extremes(lattice: DataFrame, key: str, signals: list[str]) -> DataFrame:
    """V1, V4: lowest and highest value of every signal in one row per key."""
    aggs = []
    for s in signals:
        aggs += [F.min(F.when(F.col("signal") == s, F.col("bin_min"))).alias(f"{s}_min"), F.max(F.when(F.col("signal") == s, F.col("bin_max"))).alias(f"{s}_max")]
    return lattice.groupBy(key).agg(*aggs)


def row_at_lowest(df: DataFrame, key: list[str], value: str, columns: list[str]) -> DataFrame:
    """V5: the whole row at the lowest value of a key (ties: by the other columns in order)."""
    least = F.min(F.struct(F.col(value), *[F.col(c) for c in columns]))
    return df.filter(F.col(value).isNotNull()).groupBy(*key).agg(least.alias("r")).select(*key, "r.*")


def lowest_ratio(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """V6: lowest a / (b / 100) on rows with a sensible divisor."""
    return df.filter(F.col(b).between(21, 100) & (F.col(a) > 0)).groupBy(*key).agg(F.min(F.col(a) / (F.col(b) / 100.0)).alias("ratio"))


def hourly_total_low(df: DataFrame, key: str, parts: list[str], optional: str, fill: int, low: int, high: int) -> DataFrame:
    """V3: total of the components per bin (the optional one filled), then its minimum over bins, inside a gate."""
    t = df.groupBy(key, "bin").agg(*[F.min(F.when(F.col("signal") == p, F.col("bin_min"))).alias(p) for p in parts])
    total = sum((F.coalesce(F.col(p), F.lit(float(fill))) if p == optional else F.col(p) for p in parts), F.lit(0.0))
    return t.withColumn("total", total).filter(F.col("total").between(low, high)).groupBy(key).agg(F.min("total").alias("lowest_total"))


def any_flag(*flags: Column) -> Column:
    """V7: greatest of the indicators, unknown as 0."""
    return F.greatest(*[F.coalesce(f, F.lit(0)) for f in flags]) if len(flags) > 1 else F.coalesce(flags[0], F.lit(0))


def admission_class(surgical: Column, elective: Column) -> Column:
    """V8: three classes."""
    return F.when(surgical & elective, F.lit("elective_surgery")).when(surgical, F.lit("emergency_surgery")).otherwise(F.lit("medical"))


def n_present(columns: list[str]) -> Column:
    """How many of the columns are known."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def acute_score(df: DataFrame) -> DataFrame:
    """Worst of the two ends per variable, oxygenation by gradient or pressure, bicarbonate where no pH,
    creatinine doubled in acute renal failure, consciousness 15 - GCS, age and chronic points.

    Wants <variable>_min and _max, bicarbonate_min/_max, pao2, fio2 (percent), gradient, gcs, age, acute_renal, chronic, class.
    """
    worst = lambda v, b: F.greatest(band(F.col(f"{v}_min"), *b), band(F.col(f"{v}_max"), *b))
    pts = {v: worst(v, b) for v, b in APACHE_BANDS.items()}
    pts["ph"] = F.coalesce(pts["ph"], worst("bicarbonate", BICARBONATE_BAND))
    pts["creatinine"] = pts["creatinine"] * F.when(F.coalesce(F.col("acute_renal"), F.lit(0)) == 1, 2).otherwise(1)
    pts["oxygen"] = F.when(F.col("fio2") >= 50, band(F.col("gradient"), *GRADIENT_BAND)).otherwise(band(F.col("pao2"), *PAO2_BAND))
    pts["gcs"] = F.when(F.col("gcs").between(3, 15), 15 - F.col("gcs"))
    df = df.withColumns({f"pts_{v}": p.cast("long") for v, p in pts.items()})
    age = F.coalesce(band(F.col("age").cast("double"), *AGE_BAND), F.lit(0))
    chronic = F.when(F.col("chronic") == 1, F.when(F.col("class") == "elective_surgery", 2).otherwise(5)).otherwise(0)
    total = sum((F.coalesce(F.col(f"pts_{v}"), F.lit(0)) for v in pts), F.lit(0)) + age + chronic
    return df.withColumn("acute_present", n_present([f"pts_{v}" for v in pts]).cast("long")).withColumn("acute_score", total.cast("long"))


def cardiovascular(map_min: Column, inotrope: Column, vasopressor: Column, dose: Column) -> Column:
    """Pressure, inotrope, dose tiers; a vasopressor of unknown dose scores 3."""
    tier = F.when(dose.isNull(), 3).when(dose > 0.1, 4).when(dose > 0, 3).otherwise(3)
    return F.when(vasopressor == 1, tier).when(inotrope == 1, 2).when(map_min < 70, 1).when(map_min.isNotNull(), 0)


def organ_score(df: DataFrame) -> DataFrame:
    """Six organ scores, respiration at most 2 without support, total over known organs.

    Wants the SOFA_BANDS inputs by organ name plus support, map_min, inotrope, vasopressor, dose.
    """
    s = {o: band(F.col(o), *b) for o, b in SOFA_BANDS.items()}
    s["respiration"] = F.when(F.coalesce(F.col("support"), F.lit(0)) == 1, s["respiration"]).otherwise(F.when(s["respiration"].isNotNull(), F.least(s["respiration"], F.lit(2))))
    s["cardiovascular"] = cardiovascular(F.col("map_min"), F.col("inotrope"), F.col("vasopressor"), F.col("dose"))
    df = df.withColumns({f"sofa_{o}": s[o].cast("long") for o in ORGANS})
    total = sum((F.coalesce(F.col(f"sofa_{o}"), F.lit(0)) for o in ORGANS), F.lit(0))
    return df.withColumn("organs_present", n_present([f"sofa_{o}" for o in ORGANS]).cast("long")).withColumn("organ_score", total.cast("long"))


def assembled(cohort: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One-row-per-key inputs joined to the cohort on one key."""
    for p in parts:
        cohort = cohort.join(p, key, "left")
    return cohort


def points_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share present, mean points, share above zero of every points column."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "item", "points")
    return long.groupBy("item").agg(F.avg(F.col("points").isNotNull().cast("double")).alias("present"), F.avg("points").alias("mean_points"), F.avg((F.col("points") > 0).cast("double")).alias("above_zero"))


def agreement(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """N, exact, within one, mean absolute difference, Pearson and Spearman of each pair of scores."""
    long = None
    for a, b in pairs:
        part = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        long = part if long is None else long.unionByName(part)
    d = F.abs(F.col("a") - F.col("b"))
    plain = long.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((d <= 1).cast("double")).alias("within_one"), F.avg(d).alias("mad"), F.corr("a", "b").alias("pearson"))
    ranked = spearman(long, ["pair"], "a", "b", few=True)
    return plain.join(ranked, "pair").select("pair", "n", "exact", "within_one", "mad", "pearson", "spearman")


def recalibrated(df: DataFrame, score: str, y: str, fold: str, iterations: int = 8) -> DataFrame:
    """logit(y) on the score fitted without the fold and applied to it, minus the prior logit.

    Scores are few integers, so rows first become (fold, score) counts; fold
    totals are subtracted from overall ones and every Newton step is one small
    grouped aggregate over those cells. A step that has no solution (one score,
    or one outcome class in the training rows) leaves the coefficients as they
    are; without both classes the prior logit is unknown and l is null.
    """
    cells = df.groupBy(fold, score).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("d")).persist()
    folds = cells.select(F.col(fold).alias("out")).distinct()
    train = cells.crossJoin(F.broadcast(folds)).filter(F.col(fold) != F.col("out"))
    b = train.groupBy("out").agg((F.sum("d") / F.sum("n")).alias("p")).select("out", F.when(F.col("p").between(1e-12, 1 - 1e-12), logit(F.col("p"))).alias("prior"))
    b = b.select("out", F.coalesce("prior", F.lit(0.0)).alias("b0"), F.lit(0.0).alias("b1"), "prior")
    for _ in range(iterations):
        t = train.join(F.broadcast(b), "out").withColumn("p", 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col(score)))))
        w, r, x = F.col("n") * F.col("p") * (1 - F.col("p")), F.col("d") - F.col("n") * F.col("p"), F.col(score)
        s = t.groupBy("out").agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(r).alias("g0"), F.sum(r * x).alias("g1"),
            F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.first("prior").alias("prior"))
        det = F.col("s0") * F.col("s2") - F.col("s1") ** 2
        solvable = F.abs(det) > 1e-12 * F.greatest(F.abs(F.col("s0") * F.col("s2")), F.lit(1e-300))
        step = lambda x, y, u, v: F.when(solvable, (F.col(x) * F.col(y) - F.col(u) * F.col(v)) / det).otherwise(0.0)
        rows = s.select("out", (F.col("b0") + step("s2", "g0", "s1", "g1")).alias("b0"), (F.col("b1") + step("s0", "g1", "s1", "g0")).alias("b1"), "prior").collect()
        b = df.sparkSession.createDataFrame(rows, ", ".join([f"out {cells.schema[fold].dataType.simpleString()}", "b0 double", "b1 double", "prior double"]))  # two numbers per fold
    cells.unpersist()
    return df.join(F.broadcast(b), F.col(fold) == F.col("out")).withColumn("l", F.col("b0") + F.col("b1") * F.col(score) - F.col("prior")).drop("out", "b0", "b1", "prior")


def by_domain(evidence: DataFrame, domains: DataFrame, key: str) -> DataFrame:
    """Sum of evidence within each declared domain; signals without a domain form 'uncovered'."""
    return evidence.join(F.broadcast(domains), "signal", "left").groupBy(key, F.coalesce("domain", F.lit("uncovered")).alias("domain")).agg(F.sum("l").alias("l"))


def covered(df: DataFrame, least: dict[str, int]) -> DataFrame:
    """A flag per presence count (count column -> fewest known inputs), and their joint mask; unknown counts are not covered."""
    flags = {f"covers_{c}": F.coalesce(F.col(c) >= k, F.lit(False)).cast("int") for c, k in least.items()}
    return df.withColumns(flags).withColumn("covered", F.least(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(next(iter(flags))))


def severity_assembly(cohort: DataFrame, acute: DataFrame, organ: DataFrame, recorded: DataFrame, key: str, least_acute: int = 10, least_organs: int = 4) -> DataFrame:
    """Both scores beside the cohort, the joint coverage mask, and whether the recorded number of known inputs is not the one scored."""
    df = covered(assembled(cohort, [acute, organ, recorded], key), {"acute_present": least_acute, "organs_present": least_organs})
    return df.withColumn("disagrees", (~F.col("recorded").eqNullSafe(F.col("acute_present"))).cast("int"))


def comparison_arms(assembly: DataFrame, arms: dict[str, str], columns: list[str]) -> DataFrame:
    """The rows on which every arm is known and coverage holds, once per arm: columns, arm, score."""
    known = assembly.filter("covered = 1")
    for c in arms.values():
        known = known.filter(F.col(c).isNotNull())
    return known.select(*columns, F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).cast("double").alias("score")) for a, c in arms.items()])).alias("s")).select(*columns, "s.*")


def domains_against(sums: DataFrame, outcome: DataFrame, other: DataFrame, key: str, score: str) -> DataFrame:
    """For each domain of (key, domain, l): AUROC, AUPRC and lift of the sum, and its Spearman correlation with another score of the key."""
    from .metrics import discrimination

    rows = sums.join(outcome, key).join(other, key).select("domain", F.col("l").alias("score"), "y", F.col(score).cast("double").alias("other"))
    ranked = spearman(rows, ["domain"], "score", "other")
    return discrimination(rows, ["domain"]).join(ranked, "domain", "left")
