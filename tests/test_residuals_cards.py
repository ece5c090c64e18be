"""Residual checks, PIT, collapse decomposition, manifests, strata and cards against plain versions."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_normal_quantile_and_tail(spark):
    from weighbridge.operators.metrics import normal_tail
    from weighbridge.operators.residuals import normal_quantile

    law = statistics.NormalDist()
    ps = [1e-9, 0.001, 0.02425, 0.1, 0.5, 0.77, 0.97575, 0.9999, 1 - 1e-9]
    for p, z in spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(normal_quantile("p"))).collect():
        assert z == pytest.approx(law.inv_cdf(p), abs=1e-7)
    assert spark.range(1).select(F.expr(normal_quantile("CAST(0 AS DOUBLE)")).alias("z")).first().z == pytest.approx(law.inv_cdf(1e-12), abs=1e-4)
    for z, p in spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.4, 2.5)], "z double").select("z", F.expr(normal_tail("z"))).collect():
        assert p == pytest.approx(2 * (1 - law.cdf(abs(z))), abs=3e-7)


def test_distance_from_uniform(spark):
    from weighbridge.operators.residuals import uniform_distance

    rng = random.Random(1)
    values = [("a", rng.random()) for _ in range(300)] + [("b", round(rng.random() ** 2, 2)) for _ in range(200)] + [("c", 0.5)]
    got = {r.g: r for r in uniform_distance(spark.createDataFrame(values, "g string, v double"), ["g"], "v").collect()}
    for g in "abc":
        v = sorted(x for k, x in values if k == g)
        n = len(v)
        assert got[g].ks == pytest.approx(max(max((i + 1) / n - x, x - i / n) for i, x in enumerate(v)))
    assert got["a"].ks_p > 0.05 and got["b"].ks_p < 1e-4 and 0 <= got["c"].ks_p <= 1


def test_residual_table_on_good_and_bad_fits(spark):
    from weighbridge.operators.residuals import residual_table

    rng = random.Random(3)
    rows = []
    for i in range(3000):
        x = rng.gauss(0, 1)
        p = 1 / (1 + math.exp(-x))
        y = int(rng.random() < p)
        rows += [(i, "good", y, p, x), (i, "bad", y, 0.2, x)]
    rows += [(1, "good", 1, None, 0.0)]
    got = {r.signal: r for r in residual_table(spark.createDataFrame(rows, "user_id long, signal string, y int, p double, x double"), "user_id", ["x"], 5).collect()}
    good, bad = got["good"], got["bad"]
    assert good.n == 3000 and good.ks_p > 0.01 and abs(good.variance - 1) < 0.1 and good.bins == 10 and good.bins_out <= 3 and good.structure < 0.15 and good.block_z is None
    assert bad.ks_p < 1e-6 and bad.bins == 1 and bad.bins_out == 1 and bad.block == 1 and bad.block_z > 10 and bad.structure > 0.5 and bad.structure_in == "x"


def test_tied_values_share_a_bin(spark):
    from weighbridge.operators.residuals import tied_bins

    values = [0.1] * 7 + [0.2] * 2 + [0.3] + [0.4] * 10
    got = sorted((r.bin, r.n) for r in tied_bins(spark.createDataFrame([("s", v) for v in values], "signal string, v double"), ["signal"], "v", 4, {"total": F.col("v")}).collect())
    assert got == [(1, 7), (2, 3), (3, 10)]


def test_generalisation_by_hand(spark):
    from weighbridge.operators.residuals import generalisation

    rng = random.Random(8)
    rows = [("s", int(rng.random() < 0.3), rng.gauss(0, 1), rng.gauss(0, 1), 0.3, rng.choice([0.25, 0.35])) for _ in range(400)]
    r = generalisation(spark.createDataFrame(rows, "signal string, y int, l_in double, l_out double, base_in double, base_out double")).first()
    y = np.array([x[1] for x in rows])
    loss = lambda l, base: -np.mean(np.where(y == 1, np.log(p := 1 / (1 + np.exp(-(l + np.log(base / (1 - base)))))), np.log(1 - p)))
    a, b, base, fold = (np.array([x[k] for x in rows]) for k in (2, 3, 4, 5))
    assert r.explained_in == pytest.approx(1 - loss(a, base) / loss(a * 0, base)) and r.explained_out == pytest.approx(1 - loss(b, fold) / loss(b * 0, fold)) and r.optimism == pytest.approx(r.explained_in - r.explained_out)
    assert r.loss_out == pytest.approx(loss(b, fold)) and r.difference == pytest.approx(np.abs(a - b).mean()) and r.correlation == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_masses_of_the_beta_binomial(spark):
    from weighbridge.operators.residuals import mass_table

    sizes = [("s", "low", 5, 0.7, 2.2), ("s", "low", 1, 0.7, 2.2), ("t", "high", 24, 3.0, 0.4)]
    lg = math.lgamma
    got = {(r.signal, r.n, r.k): r for r in mass_table(spark.createDataFrame(sizes, "signal string, category string, n int, a double, b double")).collect()}
    assert len(got) == 6 + 2 + 25
    for s, _, n, a, b in sizes:
        below = 0.0
        for k in range(n + 1):
            mass = math.exp(lg(n + 1) - lg(k + 1) - lg(n - k + 1) + lg(k + a) + lg(n - k + b) - lg(n + a + b) + lg(a + b) - lg(a) - lg(b))
            assert got[s, n, k].mass == pytest.approx(mass) and got[s, n, k].below == pytest.approx(below, abs=1e-12)
            below += mass


def test_pit_is_uniform_under_the_prior_and_not_beside_it(spark):
    from weighbridge.operators.residuals import predictive_pit

    rng = np.random.default_rng(5)
    rows = []
    for i in range(2500):
        n = int(rng.integers(0, 25))
        low, mid, high = rng.multinomial(n, rng.dirichlet([0.8, 3.0, 1.2]))
        rows.append((i, "s", n, int(low), int(mid), int(high)))
    df = spark.createDataFrame(rows, "user_id long, signal string, n_obs int, k_low int, k_mid int, k_high int")
    prior = lambda *a: spark.createDataFrame([("s", *a)], "signal string, a_low double, a_mid double, a_high double")
    for r in predictive_pit(df, prior(0.8, 3.0, 1.2), "user_id", 2).collect():
        assert r.rows == sum(x[2] > 0 for x in rows) and r.ks_p > 0.01 and abs(r.dispersion - 1) < 0.12 and abs(r.none_seen - r.none_expected) < 0.03 and abs(r.pit_sd - 1) < 0.06
    assert {r.category: r.ks_p < 1e-6 for r in predictive_pit(df, prior(5.0, 3.0, 1.2), "user_id", 2).collect()}["low"]


def test_collapse_by_hand(spark):
    from weighbridge.operators.attribution import collapse_correlations, collapse_decomposition, collapsed_leaders, unmeasured_channels

    rng = random.Random(6)
    rows = [(f"g{i % 4}", i, s, k, rng.choice([0.0, 0.0, rng.gauss(0, 1)]), rng.gauss(0, 1), int(rng.random() < 0.6)) for i in range(200) for k, s in enumerate("abcd")]
    rows += [("g0", 900, s, k, 1.0, 0.0, 1) for k, s in enumerate("abcd")]  # no evidence in b: no leader
    rows += [("g0", 901, s, k, -1.0, -2.0, k % 2) for k, s in enumerate("abcd")]  # ties, and nothing positive in a
    led = collapsed_leaders(spark.createDataFrame(rows, "grp string, user_id long, signal string, ord int, a double, b double, measured int"), "user_id", 0.2, ("grp",)).persist()
    want = []
    for user in sorted({r[1] for r in rows} - {900}):
        own = [r for r in rows if r[1] == user]
        top = max(own, key=lambda r: (abs(r[5]), -r[3]))
        positive = sum(max(r[4], 0) for r in own)
        want.append((top[0], user, top[2], 1 - top[6], int((top[4] / positive if positive else 0) < 0.2), sum(1 - r[6] for r in own)))
    assert sorted(map(tuple, led.collect())) == sorted(want)
    mean = lambda x: sum(x) / len(x) if x else None
    groups = {r.grp: r for r in collapse_decomposition(led, ["grp"]).collect()}
    for g, r in groups.items():
        own = [w for w in want if w[0] == g]
        assert (r.n, r.collapse, r.leader_unmeasured) == (len(own), mean([w[4] for w in own]), mean([w[3] for w in own]))
        assert r.collapse_given_unmeasured == mean([w[4] for w in own if w[3]]) and r.collapse_given_measured == mean([w[4] for w in own if not w[3]]) and r.unmeasured_given_collapse == mean([w[3] for w in own if w[4]])
    channels = unmeasured_channels(led, []).collect()
    assert sum(c.n for c in channels) == sum(w[3] for w in want) and sum(c.share for c in channels) == pytest.approx(1)
    assert {c.groups for c in collapse_correlations(collapse_decomposition(led, ["grp"]), 5, []).collect()} == {4}


def test_contrasts_of_every_level(spark):
    from weighbridge.operators import attribution as A

    made = [("f", "m", "bootstrap", 0, 0, 0), ("b1", "m", "bootstrap", 1, 0, 0), ("b2", "m", "bootstrap", 2, 0, 0), ("t", "m", "seeded", 2, 5, 0), ("p1", "m", "posterior", 0, 0, 1), ("p2", "m", "posterior", 0, 0, 2), ("p0", "m", "posterior", 0, 0, 0),
            ("n1", "n", "bootstrap", 1, 0, 0), ("n2", "n", "bootstrap", 2, 7, 0), ("x", "m", "elsewhere", 1, 0, 0), ("c", "m", "seeded", 1, 0, 0)]
    m = spark.createDataFrame(made, "id string, method string, route string, boot long, seed long, draw long")
    got = {frozenset((r.id_a, r.id_b)): (r.level, r.refused) for r in A.contrast_levels(m, {"bootstrap": "refit", "seeded": "refit", "posterior": "draws"}).collect()}
    pair = lambda a, b: got.get(frozenset((a, b)))
    assert pair("b1", "b2") == ("L3", None) and pair("b1", "t") == ("L3T", None) and pair("b2", "t") == ("L2", None) and pair("p1", "p2") == ("L3P", None) and pair("b1", "n1") == ("L4", None) and pair("b1", "c") == ("L1", None)
    assert pair("f", "b1") == ("refused", "full_sample") and pair("p0", "p1") == ("refused", "centre") and pair("b1", "n2") == ("refused", "confounded")
    assert pair("b1", "p1") is None and pair("b1", "x") is None
    with pytest.MonkeyPatch.context() as mp:
        mp.setattr(A, "MOST_REPLICATES", 3)
        with pytest.raises(ValueError, match="replicates"):
            A.contrast_levels(m, {})
    plan = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1), ("n", 9)], "method string, boot long")
    seen = {r.method: (r.planned, r.present, r.missing, r.unplanned, r.repeated) for r in A.manifest_coverage(m.select("method", "boot"), plan, ["method", "boot"], ["method"]).collect()}
    assert seen == {"m": (2, 2, 0, 1, 3), "n": (2, 1, 1, 1, 0)}


def test_paired_test_inside_groups(spark):
    from weighbridge.operators.metrics import constant_columns, delong, delong_by, reported

    rng = random.Random(9)
    rows = [(g, i, y, round(rng.gauss(y, 1), 1), round(rng.gauss(y * 0.3, 1), 1)) for g in "ab" for i in range(150) for y in [int(rng.random() < 0.3)]] + [("one", i, 1, float(i), 1.0) for i in range(5)] + [("same", i, i % 2, 1.0, 1.0) for i in range(30)] + [("a", 999, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "grp string, user_id long, y int, a double, b double")
    got = {r.grp: r for r in reported(delong_by(df, ["grp"], "user_id", "a", "b"), 20, 5).collect()}
    for g in "ab":
        want = delong(df.filter((F.col("grp") == g) & F.col("a").isNotNull()), "user_id", "a", "b").first()
        assert all(getattr(got[g], c) == pytest.approx(want[c]) for c in ("auc_a", "auc_b", "difference", "se", "z")) and got[g].n == 150 and got[g].reported == 1
    assert got["one"].auc_a is None and got["one"].z is None and got["one"].reported == 0 and got["same"].difference == 0 and got["same"].p is None
    clean = {r.grp: (r.constant, r.clean) for r in constant_columns(df, ["grp"], ["a", "b"]).collect()}
    assert clean == {"a": (0, 0), "b": (0, 0), "one": (1, 0), "same": (2, 1)}


def test_cards_by_hand(spark):
    from weighbridge.operators import reports as K

    rng = random.Random(12)
    reps = [(i, s, role, round(rng.gauss(0, 1), 3), 0.5 if role == 0 else None) for i in range(40) for s in "ab" for role in range(6) if s == "a" or i % 3]
    replicates = spark.createDataFrame(reps, "user_id long, signal string, role int, l double, se double")
    outside = spark.createDataFrame([(i, "a", 2, "x" if i < 10 else "") for i in range(40)], "user_id long, signal string, terms long, outside string")
    lines = K.card_lines(replicates, "user_id", outside)
    lines = K.percentile_within(lines, lines.select("signal", "l"), ["signal"], ["l", "low"], "l").persist()
    own = {(i, s): v for i, s, role, v, _ in reps if role == 0}
    for r in lines.collect():
        drawn = [v for i, s, role, v, _ in reps if (i, s) == (r.user_id, r.signal) and role]
        ref = [v for (_, s), v in own.items() if s == r.signal]
        assert (r.l, r.replicates) == (own[r.user_id, r.signal], 5) and [r.low, r.high] == pytest.approx(np.quantile(drawn, [0.025, 0.975]).tolist())
        assert r.pct_l == pytest.approx(np.mean([v <= r.l for v in ref])) and r.pct_low == pytest.approx(np.mean([v <= r.low for v in ref])) and r.post_high == pytest.approx(r.l + 1.959963984540054 * 0.5)
    sums = lines.groupBy("user_id").agg(F.sum("l").alias("score"))
    ref = sorted(sum(v for (i, _), v in own.items() if i == u) for u in range(40))
    cuts = np.quantile(ref, [i / 4 for i in range(1, 4)])
    for r in K.cards(lines, replicates, "user_id", sums, 4).collect():
        score = sum(v for (i, _), v in own.items() if i == r.user_id)
        drawn = [sum(v for i, _, role, v, _ in reps if i == r.user_id and role == b) for b in range(1, 6)]
        assert r.score == pytest.approx(score) and [r.low, r.high] == pytest.approx(np.quantile(drawn, [0.025, 0.975]).tolist()) and r.bin_score == 1 + sum(c < score - 1e-12 for c in cuts)
        assert r.extrapolated == (r.user_id < 10) and [x.l for x in r.lines] == sorted((v for (i, _), v in own.items() if i == r.user_id), reverse=True)


def test_points_beyond_support(spark):
    from weighbridge.operators.reports import outside_support

    grid = spark.createDataFrame([("s", "x", [1.0, 2.0, 3.0], [True, False, True])], "signal string, covariate string, grid array<double>, ok array<boolean>")
    got = {r.user_id: r.outside for r in outside_support(spark.createDataFrame([(1, "s", 0.5), (2, "s", 1.0), (3, "s", 1.5), (4, "s", 2.5), (5, "s", 3.1), (6, "s", 3.0)], "user_id long, signal string, x double"), "user_id", grid, ["x"]).collect()}
    assert got == {1: "x", 2: "", 3: "x", 4: "", 5: "x", 6: ""}
