"""Hard negatives against a plain version: ties, repeated ids, odd vectors, hot labels, blocks of any size."""

import math
import random

import oracle
import pytest

SF = "/root/testdata/sf0.001"


def plain(rows, is_anchor, positives=5, negatives=10):
    """rows: id -> (label, q)."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in filter(is_anchor, rows):
        label, q = rows[a]
        order = sorted((-score(q, r), i, lab == label) for i, (lab, r) in rows.items() if i != a)
        for p, pos, _ in [x for x in order if x[2]][:positives]:
            inside = [x for x in order if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(a, pos, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, q) for i, (lab, q) in rows.items()], "id long, label long, q array<long>")


def test_sql_twin(spark):
    from weighbridge.llm.hard_negatives import OP12_SQL, op12_hard_negatives

    got = op12_hard_negatives(spark, SF)
    assert got.count() > 50 and dict(got.dtypes)["rank"] == "int"
    assert oracle.difference(got, oracle.connect(SF), OP12_SQL) is None


@pytest.mark.parametrize("block_rows", [3, 40, 10_000])
def test_ties_and_hot_labels(spark, block_rows):
    from weighbridge.llm.hard_negatives import mined

    rng = random.Random(block_rows)
    rows = {i: (rng.choice([0, 0, 0, 1, 2, 3]), [rng.randint(-2, 4) for _ in range(3)]) for i in range(-20, 200)}
    rows |= {i: (i % 5, [3, 1, 2]) for i in range(200, 300)}  # one very common vector
    rows[400] = (9, [1, 1, 1])  # the only row of its label
    rows[10] = (0, [0, 0, 0])  # positives and negatives that all score nothing
    got = mined(frame(spark, rows), "id % 10 = 0", block_rows=block_rows).collect()
    want = plain(rows, lambda i: i % 10 == 0)
    assert any(x[0] == 10 for x in want) and sorted(map(tuple, got)) == want


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    from weighbridge.llm.hard_negatives import mined, quantised

    nan, inf = math.nan, math.inf
    odd = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, -0.001]), (2, 2, [0.5, 0.1]), (3, 2, [0.7]), (4, 2, []), (5, None, [1.0]), (6, 1, None), (7, 1, [1.0, None]), (8, 1, [nan, 1.0]),
           (9, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]), (2, 2, [0.5, 0.1]), (1, 3, [9.0, 9.0]), (10, 2, [-1.0, 0.3]), (11, 1, [0.8, 0.8])]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in odd], "vec_id long, label int, embedding array<float>, q string, block string")
    clean = quantised(df, "vec_id", "label", "embedding")
    as_float = lambda x: F.lit(x).cast("float").cast("double")
    kept = {r.id: (r.label, r.q) for r in clean.collect()}
    f = lambda x: math.floor(256 * spark.range(1).select(as_float(x)).first()[0])
    assert kept == {0: (1, [256, 128]), 1: (1, [f(0.9), f(-0.001)]), 2: (2, [128, f(0.1)]), 3: (2, [f(0.7)]), 4: (2, []), 10: (2, [-256, f(0.3)]), 11: (1, [f(0.8)] * 2)}
    padded = {i: (lab, [*q, 0, 0][:2]) for i, (lab, q) in kept.items()}
    assert sorted(map(tuple, mined(clean, "id = 0").collect())) == plain(padded, lambda i: i == 0) != []
    assert mined(clean.limit(0), "id = 0").count() == 0


def test_scores_beyond_doubles(spark):
    from weighbridge.llm.hard_negatives import mined

    big = 3_000_000_019
    rows = {0: (1, [big, 1]), 1: (1, [big // 3, 7]), 2: (2, [big // 5, 3]), 3: (2, [big // 5, 4]), 4: (2, [big // 4, 0])}
    assert sorted(map(tuple, mined(frame(spark, rows), "id = 0").collect())) == plain(rows, lambda i: i == 0) != []


def test_empty_table(spark, tmp_path):
    from weighbridge.llm.hard_negatives import op12_hard_negatives

    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op12_hard_negatives(spark, str(tmp_path)).count() == 0
