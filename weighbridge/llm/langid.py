"""Language identification with error-correcting output codes.

Every language has a codeword. For every bit a binary naive-Bayes classifier
over hashed character n-grams predicts whether the text is in one of the
languages whose codeword has that bit set. Decoding weighs each bit's logistic
loss by how well the bit separates the language in training and picks the
nearest codeword; two nearly equal losses are flagged as ambiguous. The n-gram
counts of the training texts are summed on Spark; the model is a bits x buckets
table of fixed size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, table, with_fields

BUCKETS = 1 << 14
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte 2-grams and 3-grams of a text, in pieces that overlap by two bytes."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    for at in range(0, max(1, len(data) - 2), PIECE):
        b = data[at : at + PIECE + 2].astype(np.uint32)
        two = b[:-1] | (b[1:] << 8)
        three = two[:-1] | (b[2:] << 16)
        for code in (two[: len(three)] + np.uint32(0x5000000), three + np.uint32(0x7000000)):
            yield ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.intp)


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) sums of a partition; flushed when many languages have been met."""
    seen: dict[str, np.ndarray] = {}

    def flush():
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            into = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for codes in ngrams(text):
                into += np.bincount(codes, minlength=BUCKETS)
        if len(seen) > 256:
            yield from flush()
    yield from flush()


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code for up to 7 classes, else 16 pseudo-random bits per doubling of k."""
    if k <= 7:
        bits = list(itertools.product((1, -1), repeat=max(0, k - 1)))[1:]
        return np.array([[1, *b] for b in bits], dtype=np.int8).T.reshape(k, -1) if bits else np.ones((k, 1), np.int8)
    rng = np.random.default_rng(5)
    code = rng.choice(np.array([-1, 1], np.int8), size=(k, 16 * max(1, (k - 1).bit_length())))
    return code[:, (code == 1).any(0) & (code == -1).any(0)]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        p = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)
        self.langs, self.code = langs, codewords(len(langs))
        on = self.code == 1
        part = lambda mask: np.stack([p[m].mean(0) if m.any() else np.full(BUCKETS, 1 / BUCKETS) for m in mask.T])
        w = np.log(part(on)) - np.log(part(~on))
        if len(langs) < 2:
            w = np.ones_like(w)
        gain = np.maximum(self.code * (p @ w.T), 1e-6)  # expected margin of each bit on each language
        self.bit_weight = gain / gain.sum(1, keepdims=True)
        self.w = np.ascontiguousarray(w.T.astype(np.float32))

    def predict(self, text: str | None, close: float = 0.1) -> tuple[str, float, bool]:
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        margin = sum((self.w[codes].sum(0, dtype=np.float64) for codes in ngrams(text)), np.zeros(self.w.shape[1]))
        loss = (self.bit_weight * np.logaddexp(0, -self.code * np.clip(margin, -60, 60))).sum(1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        near = len(order) > 1 and share[order[0]] - share[order[1]] < close
        return self.langs[order[0]], float(share[order[0]]), bool(near)


def train(labelled: DataFrame, most_langs: int = 1000) -> Model:
    """labelled: text, lang. The model is fitted to all of its rows; rows with a null in either are left out.

    The model holds a row for each language, so a column of more than most_langs values is an error.
    """
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null")
    if (k := rows.select("lang").distinct().count()) > most_langs:
        raise ValueError(f"{k} languages; at most {most_langs} can be told apart")
    sums = rows.mapInArrow(count_ngrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        counts[sums["lang"].map({x: i for i, x in enumerate(langs)}), sums["bucket"]] = sums["n"]
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous in place of the text; `und` and 0 for null texts and texts without a letter.

    Columns of docs that share a name with an added one are replaced. Repeated rows are judged alike, very long texts
    whole (in pieces), and an empty table gives no rows; equal losses go to the language that comes first by code point.
    """
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch[text_col].to_pylist()]
            cols = [batch[c] for c in keep] + [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, with_fields(docs.select(*keep).schema, "lang_pred string, score double, ambiguous boolean"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicts every document's language by the model of the documents not held out; see identify for odd rows."""
    docs = table(spark, sf_dir, "documents")
    held = is_held_out(F.col("doc_id"), 4, 2)
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
