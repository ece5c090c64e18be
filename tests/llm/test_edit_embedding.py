"""Edit embedding: walks against a plain walk, edited texts, likeness, bands and near copies."""

import hashlib
import random

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def edits(text, n, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) or 1)
        what = rng.randrange(3)
        out[at : at + (what != 1)] = [] if what == 0 else [rng.choice("abcdefgh")]
    return "".join(out)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_walks_are_those_of_a_plain_walk(texts, monkeypatch):
    from weighbridge.llm import edit_embedding as e

    some = ["", "a", "ab\U0001f600", *texts[:30]]
    w = e.walks()
    whole, _ = w.of(some)
    for narrow in (1, 1000):
        monkeypatch.setattr(e, "NARROW", narrow)
        assert w.of(some)[0] == whole
    text = texts[0]
    written, at, step = [], 0, 0  # the string that the first walk writes, one step after another
    classes = w.char_class[np.array(list(map(ord, text)))]
    while at < len(text):
        written.append(classes[at])
        at += int(w.stay[int(classes[at]) * e.PERIOD + step % e.PERIOD]) == 1
        step += 1
    last, bits = whole[3].split("-")[0].split(":")
    m = int((w.steps < step).sum())
    assert int(last, 16) == step and np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8), count=m).tolist() == [w.bits[0, written[s], k] for k, s in enumerate(w.steps[:m])]


def plain_edits(rows):
    """rows: (doc_id, text) -> (doc_id, n_chars, digest of the edited text, next text)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc, text, edited, after))
    return out


@pytest.mark.parametrize("each", [7, 20_000])
def test_edited_texts_and_likeness(spark, texts, monkeypatch, each):
    from weighbridge.llm import edit_embedding as e

    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(-5, None), (1000, ""), (1001, "x"), (1002, "ab"), (1003, "\U0001f600ß中文"), (1005, "x" * 300), (1006, "x" * 300), (1 << 62, "last")]
    df = spark.createDataFrame([(*r, "clash", 1.5, "c") for r in rows], "doc_id long, text string, k1 string, near_next double, fingerprint string")
    dealt = e.dealt_in_order
    monkeypatch.setattr(e, "dealt_in_order", lambda docs: dealt(docs, each))
    got = {r.doc_id: r for r in e.edited_prints(df.repartition(5)).collect()}
    assert len(got) == len(rows)
    w = e.walks()
    ahead = 0
    for doc, text, edited, after in plain_edits(rows):
        r = got[doc]
        prints, _ = w.of([text, edited, after])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == prints[:2]
        assert (r.near_edited, r.near_next) == (w.alike(prints[0], prints[1]), w.alike(prints[0], prints[2]))
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1 if edited == text else r.near_edited < 1)
        ahead += r.near_edited > r.near_next or text == after
    assert ahead >= 0.97 * len(rows)


def test_near_copies_that_follow_each_other_are_verified(spark, texts):
    from weighbridge.llm.edit_embedding import edited_prints

    rng = random.Random(13)
    seeds = [t for t in texts if 200 < len(t) < 900][:20]
    rows = [(2 * k + c, edits(t, 3, rng) if c else t) for k, t in enumerate(seeds) for c in (0, 1)]
    got = {r.doc_id: r for r in edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = dict(rows)
    found = 0
    for doc, r in got.items():
        after = own[(doc - 1) % 40]
        d, most = levenshtein(own[doc], after), int(0.1 * max(len(own[doc]), len(after)))
        assert r.next_distance == (d if r.bands_next and d <= most else None)
        found += doc % 2 and r.next_distance is not None
        assert doc % 2 or r.next_distance is None
    assert found >= 18


def test_one_row_repeats_and_null_ids(spark):
    from weighbridge.llm.edit_embedding import edited_prints

    one = edited_prints(spark.createDataFrame([(4, "a text alone")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_edited, r.near_next) for r in one] == [(4, one[0].near_edited, 1.0)]
    rows = [(1, "b"), (1, "b"), (1, "other"), (None, "n"), (None, None), (None, "n")] * 20
    got = edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got}) == 4
    assert edited_prints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_falls_with_the_distance(spark, texts):
    from weighbridge.llm import edit_embedding as e

    rng, w = random.Random(5), e.walks()
    long = [t for t in texts if 400 < len(t) < 8000][:80]
    means = []
    for rate in (0.002, 0.01, 0.05):
        other = [edits(t, max(1, int(rate * len(t))), rng) for t in long]
        (a, keys), (b, seen) = w.of(long, True), w.of(other, True)
        means.append(np.mean([w.alike(x, y) for x, y in zip(a, b)]))
        if rate < 0.02:
            assert np.mean([bool(set(x.tolist()) & set(y.tolist())) for x, y in zip(keys, seen)]) >= 0.9
    assert means[0] > 0.9 and means[0] > means[1] > means[2] > 0.15
    unlike = [w.alike(x, y) for x, y in zip(a, a[1:])]
    assert np.mean(unlike) < means[2]
    df = spark.createDataFrame(list(zip(a, b)) + [(None, a[0])], "a string, b string")
    from pyspark.sql import functions as F

    got = [r.s for r in df.select(e.likeness(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:-1] == [w.alike(x, y) for x, y in zip(a, b)] and got[-1] is None


def test_edit_distance():
    from weighbridge.llm.edit_embedding import edit_distance

    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        b = edits(a, rng.randrange(0, 12), rng) if a and rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        d, most = levenshtein(a, b), rng.randrange(0, 40)
        assert edit_distance(a, b, most) == (d if d <= most else None)


def test_near_classes_on_planted_copies(spark, texts):
    from weighbridge.llm.edit_embedding import near_classes

    rng = random.Random(8)
    seeds = [t for t in texts if 300 < len(t) < 3000][:12]
    rows, kind = [], {}
    for k, t in enumerate(seeds):
        for c in range(40 if k == 0 else 3):
            kind[len(rows)] = k
            rows.append((len(rows), edits(t, int(0.01 * len(t) * (c % 3 > 0)), rng)))
    lone = ["".join(rng.choice("abcdefghij klmnop") for _ in range(500)) for _ in range(30)] + ["", None, "short", "brief"]
    rows += [(len(rows) + k, t) for k, t in enumerate(lone)] + [(None, "no id"), (None, "no id"), (9000, "twice"), (9000, "twice")]
    got = near_classes(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row string")).collect()
    assert len(got) == len(rows)
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    first = {k: min(i for i, x in kind.items() if x == k) for k in kind.values()}
    same = [classes[i] == first[k] for i, k in kind.items()]
    assert np.mean(same) >= 0.95
    assert all(classes[i] in [j for j, k2 in kind.items() if k2 == k] for i, k in kind.items())  # no class holds two seeds
    empty = [r[0] for r in rows if r[0] is not None and not r[1]]
    assert all(classes[i] == (min(empty) if i in empty else i) for i, t in rows if i is not None and i not in kind and i != 9000)
    assert [r.class_id for r in got if r.doc_id is None] == [None, None] and classes[9000] == 9000


def test_empty_table(spark, tmp_path):
    from weighbridge.llm.edit_embedding import near_classes, op11_edit_fingerprint

    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_edit_fingerprint(spark, str(tmp_path)).count() == 0 and near_classes(none).count() == 0
