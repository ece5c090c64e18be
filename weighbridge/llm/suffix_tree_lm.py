"""LM scoring with a probabilistic suffix tree.

The symbols are the words of whole texts; a text is a start mark, its words and
an end. A context is a run of up to depth symbols that precede in the text. The
tree grows level by level: a context is counted below a kept suffix when it was
met least_count times in training, and kept when its next-symbol distribution
diverges from its suffix's by more than its parameters cost,
sum c ln(c / (t q)) > kinds / 2 ln t. Kept distributions are smoothed towards
the suffix (Witten-Bell), the empty context is the smoothed unigram model, and
every symbol is scored by its longest kept context.

The work goes by chunks of texts and buckets of contexts. A chunk holds its
texts as numbers. At each level it sends every distinct (context, next symbol)
once, with its count, to the bucket of the context; the bucket adds up the
counts, tests its contexts and answers each chunk. Contexts met more than
hot_count times are dealt over all buckets by next symbol and tested on the sums.
Spark moves and groups chunks and buckets; neither grows with the corpus.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, mixed, slices, table, written

END, START = 0, 1  # symbol numbers; words follow
KEY = np.uint64((1 << 48) - 1)  # a context travels as 48 bits of its hash, beside its bucket, which comes from the highest ones
ODD = np.uint64(0x9E3779B97F4A7C15)
HOT = np.iinfo(np.uint32).max
ASKS = "chunk long, bucket int, ctx binary, runs binary, t binary, next binary, count binary, q binary"
ANSWERS = "chunk long, level int, bucket int, a binary, b binary, kinds long, hot array<struct<ctx: long, kinds: long, gain: double, t: long>>"


def pack(a: np.ndarray) -> bytes:
    """An array's bytes plane by plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(4, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(a) else b"")


def unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[4:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in lower-cased UTF-8 and where each text's words end; nulls have none."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    as_space = np.arange(256, dtype=np.uint8)
    as_space[9:14] = 32
    as_space[65:91] += 32  # no byte of a longer UTF-8 character is below 128
    data = as_space[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    plain = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])
    lists = pc.split_pattern(plain, " ")
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), counts[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]


def crcs(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words))


def chunked(docs: DataFrame, tokens: int) -> DataFrame:
    """docs: doc_id, text, held_out. Runs of about `tokens` words as one row each: the rows, the distinct words in the order of their crc32, and the texts in these numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(parts) -> pa.RecordBatch:
        coded = pa.concat_arrays([w for _, w, _ in parts]).dictionary_encode()
        order = np.argsort(crcs(coded.dictionary), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, codes = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
        starts = np.cumsum([0, *(len(w) for _, w, _ in parts)])
        ends = np.concatenate([e + s for (_, _, e), s in zip(parts, starts)])
        train = ~np.concatenate([p["held_out"].to_numpy(zero_copy_only=False) for p, _, _ in parts])
        of_train = np.repeat(train, np.diff(ends, prepend=0))
        counts = np.bincount(codes[of_train], minlength=len(words))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        ids = pa.concat_arrays([p["doc_id"] for p, _, _ in parts])
        cells = [pa.array([x], pa.binary()) for x in (pack(train.astype(np.uint8)), pack(ends.astype(np.uint32)), pack(codes.astype(np.uint32)))]
        numbers = [pa.array([int(x)], pa.int64()) for x in (counts.sum(), train.sum(), len(codes))]
        return pa.RecordBatch.from_arrays([parts[0][0]["row"][:1], whole(ids), *cells, whole(words), whole(pa.array(counts)), *numbers], ["chunk", "doc_ids", "train", "ends", "codes", "words", "counts", "train_words", "train_texts", "n"])

    def run(batches):
        parts, n = [], 0
        for b in batches:
            for part in slices(b, "text"):
                parts.append((part, *split_words(part["text"])))
                n += len(parts[-1][1])
                if n >= tokens:
                    yield one(parts)
                    parts, n = [], 0
        if parts:
            yield one(parts)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return rows.mapInArrow(run, f"chunk long, doc_ids array<{kind}>, train binary, ends binary, codes binary, words array<binary>, counts array<long>, train_words long, train_texts long, n long")


def numbered_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Level 0 of the answers: for each chunk and bucket the numbers (a) and training counts (b) of its words, exact by content.

    Commoner words of a bucket get smaller numbers. kinds: words with a training count, on one row of the bucket.
    """

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, counts = b["words"][i].values, b["counts"][i].values.to_numpy()
                found, starts = np.unique(crcs(words) * buckets >> 32, return_index=True)  # a bucket is a range of crc32, so a run of words
                offsets = pa.array(np.append(starts, len(words)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (words, pa.array(counts))]
                yield pa.RecordBatch.from_arrays([pa.array([b["chunk"][i].as_py()] * len(found), pa.int64()), pa.array(found, pa.int32()), *lists], ["chunk", "bucket", "words", "counts"])

    def number(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("chunk").combine_chunks()
        words, ends = asked["words"].chunk(0), asked["words"].chunk(0).offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        at, count = coded.indices.to_numpy(), asked["counts"].chunk(0).flatten().to_numpy()
        total = np.bincount(at, count, len(coded.dictionary)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        bucket = asked["bucket"][0].as_py()
        ids = (2 + rank * buckets + bucket).astype(np.uint64)
        pieces = [slice(a - ends[0], z - ends[0]) for a, z in zip(ends[:-1], ends[1:])]
        kinds = np.zeros(len(pieces), np.int64)
        kinds[:1] = (total > 0).sum()
        return answered(asked, 0, [pack(ids[at[s]]) for s in pieces], [pack(total[at[s]].astype(np.uint64)) for s in pieces], kinds, [])

    return chunks.select("chunk", "words", "counts").mapInArrow(ask, "chunk long, bucket int, words array<binary>, counts array<long>").groupBy("bucket").applyInArrow(number, ANSWERS)


def answered(asked: pa.Table, level: int, a: list[bytes], b: list[bytes], kinds: np.ndarray, hot: list[dict]) -> pa.Table:
    n = len(asked)
    hot_kind = pa.list_(pa.struct([("ctx", pa.int64()), ("kinds", pa.int64()), ("gain", pa.float64()), ("t", pa.int64())]))
    return pa.table({
        "chunk": asked["chunk"], "level": pa.array([level] * n, pa.int32()), "bucket": asked["bucket"], "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()),
        "kinds": pa.array(kinds, pa.int64()), "hot": pa.array([hot, *[[]] * (n - 1)], hot_kind),
    })


@dataclass
class Setting:
    """What every chunk needs to know of the whole: training words and texts, distinct symbols, and the kept hot contexts by level."""

    words: int
    texts: int
    distinct: int
    buckets: int
    hot_count: int
    least_count: int
    hot: dict[int, dict[int, int]] = field(default_factory=dict)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.words + self.texts + 0.1 * (self.distinct + 1))


def diverges(gain, kinds, t):
    """Whether sum c ln(c / q) of a context, kinds next symbols and t in all, is worth its parameters (equal within rounding: no)."""
    return gain - (t + 0.5 * kinds) * np.log(t) > 1e-6


class Walk:
    """A chunk's places with the probability of each one's symbol by the levels answered so far."""

    def __init__(self, chunk: pa.Table, answers: pa.Table, known: Setting):
        self.known, get = known, lambda name: chunk[name][0].as_py()
        self.train, ends, codes = (unpack(get(c), k) for c, k in (("train", np.uint8), ("ends", np.uint32), ("codes", np.uint32)))
        self.answers: dict[int, list[dict]] = {}
        for r in answers.sort_by([("level", "ascending"), ("bucket", "ascending")]).to_pylist():
            self.answers.setdefault(r["level"], []).append(r)
        self.at_end = ends.astype(np.int64) + np.arange(len(ends))  # place of each text's end
        size = int(self.at_end[-1]) + 1
        words = self.answers.get(0, [])  # in the order of the chunk's words
        symbols, counts = (np.concatenate([np.zeros(0, np.uint64), *(unpack(r[c], np.uint64) for r in words)]) for c in ("a", "b"))
        is_end = np.zeros(size, bool)
        is_end[self.at_end] = True
        self.x, self.count0 = np.zeros(size, np.uint64), np.full(size, known.texts, np.int64)
        self.x[~is_end], self.count0[~is_end] = symbols[codes], counts[codes].astype(np.int64)
        self.first = np.concatenate([[0], self.at_end[:-1] + 1])
        self.of = np.repeat(np.arange(len(ends)), np.diff(self.at_end, prepend=-1))
        self.p = known.unigram(self.count0)
        self.prev = self.shifted(self.x, START)
        self.t = self.shifted(self.count0, known.texts)
        self.open, self.key = self.t >= known.least_count, mixed(self.prev)

    def shifted(self, a: np.ndarray, at_first) -> np.ndarray:
        out = np.empty_like(a)
        out[1:] = a[:-1]
        out[self.first] = at_first
        return out

    def entries(self):
        """The (context, next symbol) pairs of the open places in the order in which they are asked:
        places, each one's entry, and the first place, bucket and run of every entry.

        One sort by bucket, context and next symbol, on parts of their hashes; where parts agree by chance a pair or a run comes twice,
        which the bucket's sums do not mind.
        """
        places, half = np.flatnonzero(self.open), np.uint64(32)
        key, x, n = self.key[places], self.x[places], np.uint64(self.known.buckets)
        gram = mixed(key * ODD + mixed(x))
        spot = key >> half
        hot = np.flatnonzero(self.t[places] > self.known.hot_count)
        width = np.uint64((1 << 32) // self.known.buckets)
        spot[hot] = -(-((gram[hot] >> half) * n >> half << half).astype(np.int64) // self.known.buckets).astype(np.uint64) + spot[hot] % width
        order = np.argsort(spot << half | gram & np.uint64(0xFFFFFFFF))
        key, x, spot = key[order], x[order], spot[order]
        run, pair = np.ones(len(order), bool), np.ones(len(order), bool)
        run[1:] = (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])
        pair[1:] = run[1:] | (x[1:] != x[:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(pair) - 1
        return places, entry, places[order[pair]], (spot[pair] * n >> half).astype(np.int64), np.flatnonzero(run[pair])

    def ask(self, chunk: pa.Table) -> pa.Table:
        places, entry, first, bucket, runs = self.entries()
        count = np.bincount(entry, self.train[self.of[places]], len(first)).astype(np.uint32)
        q = np.clip(np.rint(-8 * np.log2(self.p[first])), 0, 255).astype(np.uint8)
        lengths = np.diff(np.append(runs, len(first))).astype(np.uint32)
        t = np.where(self.t[first[runs]] > self.known.hot_count, self.t[first[runs]], 0).astype(np.uint64)
        found, starts = np.unique(bucket, return_index=True)
        out = {name: [] for name in ("ctx", "runs", "t", "next", "count", "q")}
        for a, z in zip(starts, np.append(starts[1:], len(first))):
            r = slice(*np.searchsorted(runs, (a, z)))
            for name, x in zip(out, (self.key[first[runs[r]]] & KEY, lengths[r], t[r], self.x[first[a:z]], count[a:z], q[a:z])):
                out[name].append(pack(x))
        return pa.table({"chunk": pa.array([chunk["chunk"][0].as_py()] * len(found), pa.int64()), "bucket": pa.array(found, pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    def step(self, level: int) -> None:
        """Takes a level's answers: its kept contexts change p, and the next level's contexts become open."""
        places, entry, first, _, runs = self.entries()
        answers = self.answers.get(level, [])
        count = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["a"], np.uint64) for r in answers)]).astype(np.int64)
        kinds = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["b"], np.uint32) for r in answers)]).astype(np.int64)
        hot = np.flatnonzero(kinds == HOT)
        kept = self.known.hot.get(level, {})
        kinds[hot] = [kept.get(int(k), 0) for k in self.key[first[runs[hot]]] & KEY]
        kinds = np.repeat(kinds, np.diff(np.append(runs, len(first))))[entry]
        met, p, t = count[entry], self.p[places], self.t[places]
        self.p[places] = np.where(kinds > 0, (met + kinds * p) / np.maximum(t + kinds, 1), p)
        longer = np.zeros(len(self.x), np.int64)
        longer[places] = met
        self.open[:] = False
        self.open[places] = kinds > 0
        self.t = self.shifted(longer, 0)
        self.open &= self.t >= self.known.least_count
        self.prev = self.shifted(self.prev, END)
        self.key = mixed(self.key * ODD + self.prev)


    def scores(self, chunk: pa.Table) -> pa.Table:
        sums = lambda a: pa.array(np.add.reduceat(a, self.first))
        return pa.table({
            "doc_id": chunk["doc_ids"].combine_chunks().flatten(),
            "held_out": pa.array(self.train == 0),
            "n_tokens": sums(np.ones(len(self.x), np.int64)),
            "n_known": sums((self.count0 > 0).astype(np.int64)),
            "base_score": sums(np.log10(self.known.unigram(self.count0))),
            "score": sums(np.log10(self.p)),
        })


def tested(known: Setting, level: int):
    """Adds up a bucket's counts and answers its chunks: counts of the asked (context, next symbol) pairs (a), and the kinds of next
    symbols of each context (b; 0: not kept). A hot context is complete in no bucket; its sums are on the bucket's first row."""

    def run(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("chunk")
        got = {name: [unpack(x, kind) for x in asked[name].to_pylist()] for name, kind in (("ctx", np.uint64), ("runs", np.uint32), ("t", np.uint64), ("next", np.uint64), ("count", np.uint32), ("q", np.uint8))}
        ctx = np.concatenate([np.repeat(c, r) for c, r in zip(got["ctx"], got["runs"])])
        nxt, count, q = (np.concatenate(got[c]) for c in ("next", "count", "q"))
        _, first, entry = np.unique(mixed(ctx * ODD + mixed(nxt)), return_index=True, return_inverse=True)
        met = np.bincount(entry, count, len(first))
        contexts, of = np.unique(ctx[first], return_inverse=True)
        t_hot = np.zeros(len(contexts), np.int64)
        for c, t in zip(got["ctx"], got["t"]):
            t_hot[np.searchsorted(contexts, c[t > 0])] = t[t > 0]
        gains = np.where(met > 0, met * (np.log(np.maximum(met, 1)) + q[first] * (np.log(2) / 8)), 0.0)
        gain, kinds = np.bincount(of, gains), np.bincount(of, met > 0).astype(np.int64)
        t = np.maximum(np.bincount(of, met), 1)
        value = np.where(diverges(gain, kinds, t) & (t >= known.least_count), kinds, 0)
        hot = [{"ctx": int(contexts[i]), "kinds": int(kinds[i]), "gain": float(gain[i]), "t": int(t_hot[i])} for i in np.flatnonzero(t_hot)]
        value[t_hot > 0] = HOT
        a, b, at = [], [], 0
        for c, n in zip(got["ctx"], got["next"]):
            a.append(pack(met[entry[at : at + len(n)]].astype(np.uint64)))
            b.append(pack(value[np.searchsorted(contexts, c)].astype(np.uint32)))
            at += len(n)
        return answered(asked, level, a, b, np.zeros(len(asked), np.int64), hot)

    return run


def score_texts(docs: DataFrame, depth: int = 2, least_count: int = 2, chunk_words: int = 1_000_000, bucket_words: int = 2_000_000, hot_count: int = 500_000) -> DataFrame:
    """docs: doc_id, text, held_out. One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out; null texts are empty (one end).
    base_score is the smoothed unigram model over whole tokens, score the tree's.
    Repeated rows are scored alike; without any training row all counts are 0;
    an empty table gives no rows; other columns are ignored. A text of any
    length is taken whole, in one chunk. chunk_words, bucket_words and hot_count
    set how the work is dealt, not the result. At most (words / hot_count)
    contexts are hot; their verdicts are all that reaches the driver.
    """
    chunks = written(chunked(docs, chunk_words), "pst-chunks")
    words, texts, n = (x or 0 for x in chunks.agg(F.sum("train_words"), F.sum("train_texts"), F.sum("n")).first())
    buckets = max(1, -(-n // bucket_words))
    answers = written(numbered_words(chunks, buckets), "pst-words")
    kinds = (answers.agg(F.sum("kinds")).first()[0] or 0) + (texts > 0)
    known = Setting(words, texts, kinds, buckets, hot_count, least_count)
    coded = chunks.drop("words", "counts").groupBy("chunk")
    answers = answers.drop("hot", "kinds")

    def walk_to(level: int, then):
        def run(chunk: pa.Table, so_far: pa.Table) -> pa.Table:
            walk = Walk(chunk, so_far, known)
            for k in range(1, level):
                walk.step(k)
            return then(walk, chunk)

        return run

    for level in range(1, depth + 1):
        asked = coded.cogroup(answers.groupBy("chunk")).applyInArrow(walk_to(level, Walk.ask), ASKS)
        got = written(asked.groupBy("bucket").applyInArrow(tested(known, level), ANSWERS), "pst-level")
        sums = got.select(F.explode("hot").alias("h")).groupBy("h.ctx").agg(F.sum("h.kinds").alias("kinds"), F.sum("h.gain").alias("gain"), F.max("h.t").alias("t"))
        known.hot[level] = {r["ctx"]: r["kinds"] for r in sums.collect() if diverges(r["gain"], r["kinds"], r["t"])}
        answers = answers.unionByName(got.drop("hot", "kinds"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = coded.cogroup(answers.groupBy("chunk")).applyInArrow(walk_to(depth + 1, Walk.scores), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words + texts).cast("long").alias("train_tokens"), "base_score", "score")


def op8_suffix_tree_score(spark, sf_dir: str) -> DataFrame:
    """Scores every document by the words-level suffix tree learnt from the documents that are not held out; see score_texts for odd rows."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", "text", is_held_out(F.col("doc_id"), 10, 0).alias("held_out")))
