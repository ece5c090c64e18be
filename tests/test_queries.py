"""Every registered engine query against its SQL twin on the smallest tables; fitted queries against what must hold of any fit."""

import math
from collections import defaultdict

import oracle
import pytest

from weighbridge.plans import base as B
from weighbridge.plans import registry

SF = "/root/testdata/sf0.001"
FITTED = "/root/testdata/sf0.01"  # the smallest tables with events to fit
NAMES = set(B.SIGNALS)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.fixture(scope="module")
def measured():
    """signal -> rows with observations, in FITTED."""
    return dict(oracle.connect(FITTED).execute(B.sql(B.GRID, "SELECT signal, count(*) FROM grid WHERE n_obs > 0 GROUP BY 1")).fetchall())


@pytest.fixture(scope="module")
def users():
    return oracle.connect(FITTED).execute("SELECT count(DISTINCT user_id) FROM events").fetchone()[0]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) is None


def of_signal(rows, key="signal"):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def additive_fits(rows, measured, users):
    assert {(r.signal, r.role_fold) for r in rows} == {(s, f) for s in measured for f in range(B.FOLDS + 1)}
    for r in rows:
        assert 0 < r.edf <= 7 and 0 < r.deviance <= r.null_deviance and 0 < r.events < r.n and r.prior == pytest.approx(math.log(r.events / (r.n - r.events)), abs=1e-5)
        assert r.role_fold or r.n == measured[r.signal]
    for s, own in of_signal(rows).items():  # every row is left out once
        assert sum(r.n for r in own if r.role_fold) == (B.FOLDS - 1) * measured[s]


def fit_triage(rows, measured, users):
    assert all(r.n_flags == len(r.flags.split(",")) > 0 and set(r.flags.split(",")) <= {"worse_than_null", "few_events", "overfitted"} for r in rows)
    assert all(("worse_than_null" in r.flags) == (r.explained < 0) for r in rows)
    assert [r.n_flags for r in rows] == sorted((r.n_flags for r in rows), reverse=True)


def weight_of_evidence(rows, measured, users):
    assert {s: len(v) for s, v in of_signal(rows).items()} == measured and len({(r.user_id, r.signal) for r in rows}) == len(rows)
    assert all(len({r.l for r in v}) > len(v) // 4 for v in of_signal(rows).values())


def term_contributions(rows, measured, users):
    assert {s: len(v) for s, v in of_signal(rows).items()} == measured
    for own in of_signal(rows).values():  # anchored at the mean
        assert len({r.reference for r in own}) == 1
        for c in ("k_low", "k_high", "trend"):
            assert abs(sum(r[c] for r in own)) < 1e-4 * len(own)


def residual_qc(rows, measured, users):
    assert {r.signal: r.n for r in rows} == measured
    assert all(0 < r.ks < 1 and 0 <= r.ks_p <= 1 and r.variance > 0 and abs(r.in_large) < 0.2 and 1 <= r.bins <= 10 and 0 <= r.bins_out <= r.bins and r.hosmer_lemeshow >= 0 and r.structure_in in ("k_low", "k_high", "trend") for r in rows)


def generalisation(rows, measured, users):
    assert {r.signal: r.n for r in rows} == measured
    assert all(r.explained_in > r.explained_out and r.optimism == pytest.approx(r.explained_in - r.explained_out, abs=2e-6) and 0 < r.auroc < 1 and r.correlation > 0 for r in rows)


def boosted_importances(rows, measured, users):
    assert {r.feature for r in rows} == {f"{s}__l" for s in NAMES} and all(r.gain >= 0 and r.group_gain == pytest.approx(r.gain, abs=1e-6) for r in rows) and sum(r.gain for r in rows) == pytest.approx(1, abs=1e-5)


def boosted_scores(rows, measured, users):
    assert len({r.user_id for r in rows}) == len(rows) and {r.y for r in rows} <= {0, 1} and len({r.l for r in rows}) > 2


def predictive_pit(rows, measured, users):
    assert {(r.signal, r.category): r.rows for r in rows} == {(s, c): n for s, n in measured.items() for c in ("low", "mid", "high")}
    assert all(0 < r.ks < 1 and r.dispersion > 0 and abs(r.none_seen - r.none_expected) < 0.35 for r in rows)


def curve_displacement(rows, measured, users):
    assert {(r.signal, r.term) for r in rows} == {(s, c) for s in measured for c in ("k_low", "k_high", "trend")}
    assert all(r.n_null == 19 and r.n_grid == 21 and 0.05 <= r.p <= 1 and r.shape >= 0 and r.excess == pytest.approx(r.shape - r.null_mean, abs=2e-6) and r.above == (r.shape > r.null_high) for r in rows)


def curve_stability(rows, measured, users):
    assert {(r.signal, r.term) for r in rows} == {(s, c) for s in measured for c in ("k_low", "k_high", "trend", "k_low*k_high")}
    assert all(r.n_bags == 12 and (r.in_band is None or 0 <= r.in_band <= 1) and (r.direction is None or r.direction in (-1, 0, 1)) for r in rows)
    assert all(r.extrema is None for r in rows if "*" in r.term)


def curve_stability_summary(rows, measured, users):
    assert {r.signal for r in rows} == set(measured) and all((r.n_curves, r.n_surfaces, r.n_bags) == (3, 0, 12) for r in rows)


def resampling_floor(rows, measured, users):
    assert {(r.kind, r.method, r.replicates) for r in rows} == {(k, m, 5) for k in ("half", "bag") for m in ("evidence", "boosted")}
    assert all(r[f"{c}_q1"] <= r[f"{c}_median"] <= r[f"{c}_q3"] for r in rows for c in ("spearman", "same_sign", "within_key"))


def resampling_pairs(rows, measured, users):
    assert len(rows) == 20 and all(-1 <= r.spearman <= 1 and 0 <= r.same_sign <= 1 for r in rows)
    bags, halves = ([r.spearman for r in rows if r.kind == k and r.method == "evidence"] for k in ("bag", "half"))
    assert sum(bags) > sum(halves)  # bags share units, halves share none


def cards(rows, measured, users):
    assert len({r.user_id for r in rows}) == len(rows) and all(r.low <= r.high and r.post_low < r.score < r.post_high and 0 < r.pct_score <= 1 and 1 <= r.bin_low <= r.bin_high <= 20 and r.extrapolated <= r.n_lines <= 5 for r in rows)


def card_lines(rows, measured, users):
    assert {s: len(v) for s, v in of_signal(rows).items()} == measured
    assert all(r.low <= r.high and r.se > 0 and r.replicates == 10 and r.terms == 4 and 0 < r.pct_l <= 1 and set(filter(None, r.outside.split(";"))) <= {"k_low", "k_high", "trend", "active"} for r in rows)


def prior_table(rows, measured, users):
    assert {(r.signal, r.role_fold) for r in rows} == {(s, f) for s in measured for f in range(B.FOLDS + 1)}
    assert all(min(r.a_low, r.a_mid, r.a_high) > 0 and r.a_sum == pytest.approx(r.a_low + r.a_mid + r.a_high, abs=1e-5) for r in rows)


def shrunken_shares(rows, measured, users):
    assert {s: len(v) for s, v in of_signal(rows).items()} == measured and all(r.pi_low + r.pi_mid + r.pi_high == pytest.approx(1, abs=1e-5) and min(r.pi_low, r.pi_mid, r.pi_high) > 0 for r in rows)


CHECKS = [additive_fits, fit_triage, weight_of_evidence, term_contributions, residual_qc, generalisation, boosted_importances, boosted_scores, predictive_pit, curve_displacement, curve_stability,
          curve_stability_summary, resampling_floor, resampling_pairs, cards, card_lines, prior_table, shrunken_shares]
BY_NAME = {f.__name__: f for f in CHECKS}
MAY_BE_EMPTY = {"fit_triage", "column_contract", "severity_transport"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_fitted(spark, measured, users, name):
    df = registry.QUERIES[name](spark, FITTED)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    assert not any(isinstance(x, float) and not math.isfinite(x) for r in rows for x in r)
    if name in BY_NAME:
        BY_NAME[name](rows, measured, users)


def test_checks_are_registered():
    assert set(BY_NAME) <= set(registry.QUERIES) - set(registry.ORACLES)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    a, b = e.entry(spark), e.entry(spark)
    assert a.schema == b.schema and a.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
