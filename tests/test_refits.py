"""Refits keyed by job and role against fits one by one, and what is made of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

NAMES = ["z_0", "z_a", "z_b"]


def plain_fit(x, y, w, ridge=1.0, steps=60):
    """Weighted ridge logistic regression on columns scaled by their root mean square over all rows."""
    scale = np.sqrt((x**2).mean(0))
    z = x / np.where(scale > 0, scale, 1)
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-z @ b))
        gram = (z.T * (w * mu * (1 - mu))) @ z
        b = b + np.linalg.solve(gram + penalty, z.T @ (w * (y - mu)) - penalty @ b)
    inverse = np.linalg.inv(gram + penalty)
    s = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
    return b * s, inverse * np.outer(s, s), np.trace(inverse @ gram)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    out = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.choice([0.0, 0.0, 1.0, 2.5])
        out.append((i, "s" if i % 3 else "t", i % 4 + 1, int(rng.random() < 1 / (1 + np.exp(1 - a + 0.5 * b))), 1.0, a, b))
    return out


@pytest.fixture(scope="module")
def rows(spark, sample):
    return spark.createDataFrame(sample, "user_id long, signal string, fold int, y int, z_0 double, z_a double, z_b double").repartition(5)


def test_roles_together_equal_fits_one_by_one(rows, sample):
    from weighbridge.operators.additive import fit_jobs, leaving_out
    from weighbridge.operators.stability import bag_weights

    weights = leaving_out({0: [], 1: [1], 34: [3, 4]}) | {100 + b: w for b, w in bag_weights(F.col("user_id"), 2, 9).items()}
    got = {(r.signal, r.role): r for r in fit_jobs(rows, ["signal"], NAMES, weights, iterations=30).collect()}
    seen = {r.user_id: [r[f"w{k}"] for k in range(len(weights))] for r in rows.select("user_id", *[w.cast("double").alias(f"w{k}") for k, w in enumerate(weights.values())]).collect()}
    assert len(got) == 2 * len(weights)
    for k, role in enumerate(weights):
        for signal in "st":
            own = [r for r in sample if r[1] == signal]
            x, y, w = np.array([r[4:] for r in own]), np.array([r[3] for r in own]), np.array([seen[r[0]][k] for r in own])
            b, v, edf = plain_fit(x, y, w)
            r = got[signal, role]
            assert np.allclose(r.b, b, atol=1e-7) and np.allclose(np.array(r.covariance).reshape(3, 3), v, atol=1e-8) and abs(r.edf - edf) < 1e-7
            assert (r.n, r.events) == (w.sum(), (w * y).sum())


def test_a_refit_alone_is_the_same(rows):
    from weighbridge.operators.additive import fit_jobs

    many = {r.role: r.b for r in fit_jobs(rows.filter("signal = 's'"), ["signal"], NAMES, {1: F.lit(1), 2: (F.col("fold") > 2).cast("int")}).collect()}
    one = fit_jobs(rows.filter("signal = 's'").withColumn("part", (F.col("fold") > 2).cast("int")), ["signal"], NAMES, {7: F.col("part")}).first()
    assert np.allclose(many[2], one.b, atol=1e-9)


def test_empty_and_constant_inputs(rows):
    from weighbridge.operators.additive import fit_jobs

    assert fit_jobs(rows.limit(0), ["signal"], NAMES, {0: F.lit(1)}).count() == 0
    flat = rows.withColumns({"y": F.lit(0), "z_b": F.lit(0.0)})
    got = fit_jobs(flat, ["signal"], NAMES, {0: F.lit(1), 1: F.lit(0)}).collect()
    assert {(r.signal, r.role) for r in got} == {("s", 0), ("t", 0)} and all(r.b[2] == 0 and np.isfinite(r.b).all() for r in got)


def test_forests_together_equal_forests_one_by_one(rows):
    from weighbridge.operators import boosting as G

    wide = rows.select("user_id", "y", F.col("z_a").alias("s__a"), F.col("z_b").alias("t__b"), "fold")
    weights = {0: F.lit(1), 5: (F.col("fold") != 1).cast("int"), 9: F.when(F.col("fold") == 2, 3).otherwise(1)}
    many = G.boost(wide, ["s__a", "t__b"], "y", weights, rounds=3)
    for role, w in weights.items():
        one = G.boost(wide, ["s__a", "t__b"], "y", {role: w}, rounds=3)
        assert one.base[role] == many.base[role]
        for a, b in zip(one.trees[role], many.trees[role]):
            assert all(np.allclose(x, y) for x, y in zip(a, b)) and a[0][0] >= 0
    x = np.array([r.x for r in wide.select(many.bins().alias("x")).collect()])
    for role in weights:
        root = sum(t[2][0] for t in many.trees[role])
        assert np.allclose(many.contributions(x, role).sum(1) + root + many.base[role], many.margin(x, role))
    got = G.attributions(wide, "user_id", many, [0, 9])
    assert got.count() == 600 * 2 * 2
    # a repeated row counts as a weight of two
    twice = G.boost(wide.unionByName(wide.filter("fold = 2")).unionByName(wide.filter("fold = 2")), ["s__a", "t__b"], "y", {9: F.lit(1)}, rounds=1)
    assert twice.base[9] == pytest.approx(many.base[9])


def test_shuffled_blocks_keep_classes_and_columns_together(spark):
    from weighbridge.operators.stability import permuted_blocks

    data = [(i, "s", i % 2, float(i), float(i * 10), float(-i)) for i in range(60)]
    df = spark.createDataFrame(data, "user_id long, signal string, y int, a double, b double, c double")
    got = permuted_blocks(df, "user_id", ["signal", "y"], ["b", "c"], 3, 1).collect()
    assert len(got) == 180 and all(r.b == -10 * r.c and r.a == r.user_id for r in got)
    for v in (1, 2, 3):
        for y in (0, 1):
            assert sorted(r.b for r in got if r.variant == v and r.y == y) == [r[4] for r in data if r[2] == y]
    assert len({tuple(r.b for r in sorted(got, key=lambda r: r.user_id) if r.variant == v) for v in (1, 2, 3)}) == 3


def test_displacement_finds_a_confounded_covariate(spark):
    from weighbridge.operators.stability import Terms, displacement_null

    rng = random.Random(2)
    data = []
    for i in range(1500):
        signal = "bound" if i % 2 else "free"
        block = rng.gauss(0, 1)
        a = (block if signal == "bound" else 0) + rng.gauss(0, 0.6)
        data.append((i, signal, int(rng.random() < 1 / (1 + np.exp(1.2 - 1.5 * block))), a, block))
    df = spark.createDataFrame(data, "user_id long, signal string, y int, a double, block double")
    got = {r.signal: r for r in displacement_null(df, "user_id", Terms(("a", "block")), ["a"], ["block"], 9, 3).collect()}
    assert set(got) == {"bound", "free"} and got["bound"].n_null == 9 and got["bound"].n_grid == 21
    assert got["bound"].above == 1 and got["bound"].p == pytest.approx(0.1) and got["bound"].excess > 0.1
    assert got["free"].shape < 0.5 * got["bound"].shape


def test_stability_of_a_term():
    from weighbridge.operators.stability import direction, extrema, stability_of

    assert extrema(np.array([0, 1, 2, 1, 1, 3.0])) == 2 and extrema(np.array([1.0, 1, 1])) == 0
    assert direction(np.array([1.0, 2, 3, 4])) == 1 and direction(np.array([4.0, 3, 2, 1])) == -1 and direction(np.array([1.0, 3, 1, 3, 2])) == 0
    fit, se, ok = np.array([-1.0, 0.0, 1.0, 5.0]), np.full(4, 0.5), np.array([True, True, True, False])
    bags = np.stack([fit + d for d in (-0.5, 0.0, 0.5)])
    got = stability_of(fit, se, bags, ok, False)
    assert got["n_supported"] == 3 and got["sd_in"] == got["sd_out"] == 0.5 and got["ratio_median"] == 1 and got["in_band"] == 1
    assert got["shape_least"] == pytest.approx(1) and got["direction"] == 1 and got["direction_agree"] == got["extrema_agree"] == got["sign_stable"] == 1 and got["level_sd"] == 0.5
    assert "direction" not in stability_of(fit, se, bags, ok, True) and "se_in" not in stability_of(fit, se, bags, ok & (fit > 0), False)
    assert stability_of(fit * 0, se, bags, ok, False)["flat"] == 1


def test_curves_and_errors_against_plain_sums(spark, sample):
    from weighbridge.operators import stability as T
    from weighbridge.operators.additive import fit_jobs
    from weighbridge.operators.evidence import knots

    df = spark.createDataFrame([(r[0], r[1], r[3], r[5], r[6]) for r in sample], "user_id long, signal string, y int, a double, b double")
    terms = T.Terms(("a", "b"), 1, (("a", "b"),))
    table = knots(df, ["a", "b"], 1)
    design, names = T.designed(df, table, terms)
    assert len(names) == 9 and [len(i) for i in terms.place().values()] == [2, 2, 4]
    fits = fit_jobs(design, ["signal"], names, {0: F.lit(1)})
    got = T.curves(fits, ["signal", "role"], df, table, names, design, terms, T.grids(df, terms, 11, 5)).collect()
    assert len(got) == 2 * (11 + 11 + 49)
    fit = {r.signal: r for r in fits.collect()}
    cuts = {r.signal: (r.knots_a[0], r.knots_b[0]) for r in table.collect()}
    for signal in "st":
        own = [r for r in sample if r[1] == signal]
        va, vb = (lambda x: np.array([x, max(x - cuts[signal][0], 0)])), (lambda x: np.array([x, max(x - cuts[signal][1], 0)]))
        b, v = np.array(fit[signal].b), np.array(fit[signal].covariance).reshape(9, 9)
        for term, idx, f in (("a", [1, 2], lambda x, y: va(x)), ("b", [3, 4], lambda x, y: vb(x)), ("a*b", [5, 6, 7, 8], lambda x, y: np.outer(va(x), vb(y)).ravel())):
            mean = np.mean([f(r[6] if term == "b" else r[5], r[6]) for r in own], axis=0)
            for r in [x for x in got if x.signal == signal and x.term == term]:
                g = f(r.x1, r.x2) - mean
                assert r.f == pytest.approx(g @ b[idx]) and r.se == pytest.approx(np.sqrt(g @ v[np.ix_(idx, idx)] @ g))


def test_bag_stability_runs_all_bags_as_roles(rows):
    from weighbridge.operators.stability import Terms, bag_stability, stability_summary

    df = rows.select("user_id", "signal", "y", F.col("z_a").alias("a"), F.col("z_b").alias("b"))
    got = bag_stability(df, "user_id", Terms(("a", "b"), 1, (("a", "b"),)), 10, 6)
    found = {(r.signal, r.term): r for r in got.collect()}
    assert set(found) == {(s, t) for s in "st" for t in ("a", "b", "a*b")} and all(r.n_bags == 10 for r in found.values())
    r = found["s", "a"]
    assert r.direction == 1 and r.direction_agree == 1 and r.shape_median > 0.9 and 0.4 < r.ratio_median < 2.5 and found["s", "a*b"].direction is None
    assert {(x.n_curves, x.n_surfaces) for x in stability_summary(got).collect()} == {(2, 1)}


@pytest.mark.parametrize("kind", ["half", "bag"])
def test_resampling_floor_over_twelve_refits(spark, rows, kind):
    from weighbridge.operators import additive, stability as T

    df = rows.withColumnRenamed("signal", "part").withColumn("signal", F.explode(F.array(*map(F.lit, ("p", "q", "r")))))
    df = df.withColumn("z_a", F.when(F.col("signal") == "p", F.col("z_a")).when(F.col("signal") == "q", F.col("z_b")).otherwise(F.col("z_a") * F.col("z_b")))
    weights = T.pair_weights(F.col("user_id"), 6, kind, 5)
    w = df.select("user_id", *[c.alias(f"w{r}") for r, c in weights.items()]).distinct().collect()
    if kind == "half":
        assert all(r[f"w{2 * i}"] + r[f"w{2 * i + 1}"] == 1 for r in w for i in range(6))
    fits = additive.fit_jobs(df, ["signal"], NAMES, weights)
    assert fits.count() == 3 * 12
    c = df.join(F.broadcast(fits.select("signal", "role", "b", "prior")), "signal").select(F.lit("evidence").alias("method"), "role", "user_id", "signal", (additive.linear(NAMES) - F.col("prior")).alias("a"))
    cells = T.replicate_cells(c, "user_id").persist()
    each, summary = T.resampling_floor(cells, "user_id", 0.05)
    pdf = cells.toPandas()
    assert len(pdf) == 6 * 3 * 600
    for r in each.collect():
        own = pdf[pdf["replicate"] == r.replicate]
        big = own[["a", "b"]].abs().max(axis=1) > 0.05
        within = own.groupby("user_id").apply(lambda g: g["a"].abs().rank().corr(g["b"].abs().rank()), include_groups=False)
        assert r.spearman == pytest.approx(own["a"].rank().corr(own["b"].rank())) and r.same_sign == pytest.approx((np.sign(own["a"]) == np.sign(own["b"]))[big].mean()) and r.within_key == pytest.approx(within.mean())
    s = summary.first()
    assert s.replicates == 6 and s.spearman_q1 <= s.spearman_median <= s.spearman_q3


def test_held_losses_and_margins_by_hand(rows):
    from weighbridge.operators import boosting as G

    wide = rows.select("user_id", "y", "fold", F.col("z_a").alias("a"), F.col("z_b").alias("b"))
    forest = G.boost(wide, ["a", "b"], "y", {f: F.col("fold") != f for f in (1, 2)}, rounds=4)
    losses = G.held_losses(wide, "y", forest, {1: F.col("fold") == 1, 2: F.lit(0)})
    got = {r.user_id: r for r in G.margins(wide, forest, "fold", ["user_id", "y"]).collect()}
    assert len(got) == wide.filter("fold in (1, 2)").count() and losses[2] == [] and len(losses[1]) == 4
    own = wide.filter("fold = 1").select("user_id", "y", forest.bins().alias("x")).collect()
    x, y = np.array([r.x for r in own]), np.array([r.y for r in own])
    margin = forest.margin(x, 1)
    assert [got[r.user_id].margin for r in own] == pytest.approx(margin.tolist())
    assert losses[1][-1] == pytest.approx(float(np.logaddexp(0, (1 - 2 * y) * margin).sum())) and losses[1][1] < losses[1][0]


def test_fewer_rounds_are_a_prefix_of_more(rows):
    from weighbridge.operators import boosting as G

    wide = rows.select("y", F.col("z_a").alias("a"), F.col("z_b").alias("b"))
    three, five = (G.boost(wide, ["a", "b"], "y", {0: F.lit(1)}, rounds=n).trees[0] for n in (3, 5))
    assert all(np.allclose(p, q) for s, t in zip(three, five[:3]) for p, q in zip(s, t))


def test_refits_read_the_events_once(spark, monkeypatch):
    from weighbridge.plans import base as B
    from weighbridge.plans import registry

    Q = registry.refit_queries
    d, events, reads = "/root/testdata/sf0.001", B.events, []
    state, intake = B.pressor_bins(spark, d), B.signup_bins(spark, d)
    want = Q._rows(spark, d).select("user_id", "signal", "fold", "y", *Q.COVARIATES)
    want = want.join(state.groupBy("user_id").agg(F.count(F.lit(1)).alias("active")), "user_id", "left").join(intake.groupBy("user_id").agg(F.round(F.sum("intensity"), 2).alias("intake")), "user_id", "left")
    want = sorted(map(tuple, want.fillna(0, ["active", "intake"]).collect()))
    monkeypatch.setattr(B, "events", lambda *a: reads.append(a) or events(*a))
    got = sorted(map(tuple, Q._covariates(spark, d).collect()))
    assert len(reads) == 1
    assert len(got) == len(want) > 0 and all(a[:4] == b[:4] and np.allclose(a[4:], b[4:]) for a, b in zip(got, want))


def test_keys_are_ranked_once_for_all_permutations(spark, monkeypatch):
    from weighbridge.operators import stability as T

    sums, groups = T.prefix_sums, []
    monkeypatch.setattr(T, "prefix_sums", lambda df, keys, *a, **k: groups.append(keys) or sums(df, keys, *a, **k))
    df = spark.createDataFrame([(i, None if i % 3 else "s", i % 2, float(i), float(-i)) for i in range(30)], "user_id long, signal string, y int, a double, b double")
    got = T.permuted_blocks(df, "user_id", ["y"], ["b"], 4, 1).collect()
    assert groups == [["y"], ["y", "variant"]]
    assert len(got) == 120 and all(sorted(r.b for r in got if r.variant == v and r.y == y) == [float(-i) for i in range(29, -1, -1) if i % 2 == y] for v in (1, 2, 3, 4) for y in (0, 1))
    assert sorted((r.user_id, r.a) for r in got if r.variant == 1) == [(i, float(i)) for i in range(30)]
