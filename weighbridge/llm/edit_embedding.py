"""Document fingerprints by randomised edit embedding.

A text is walked by shared random walks over its characters: at each step the walk
writes the character under it, and a coin that depends on step and character alone
says whether it moves on. Two texts at a small edit distance write strings at a small
Hamming distance, because walks that an edit drove apart soon meet again. A
fingerprint keeps one random bit of the written character at sampled steps, 64 of
every doubling of the length, for three independent walks; likeness compares bits,
weighs them by the steps they stand for, and takes the best walk.

Near copies are found by bands: a few sampled characters of a walk, hashed. Rows that
share a band are compared with the first of them, and the edit distance itself decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, mixed, slices, table, written

WALKS, CLASSES, PERIOD = 3, 256, 1024
#: Sampled steps of a level: all of the first 64 steps, then 64 of every doubling.
SAMPLES, LEVELS = 64, 27
#: Bands of a walk, and sampled characters of a band.
BANDS, IN_BAND = 6, 8
#: Below so many texts at once, a plain loop walks faster than arrays do.
NARROW = 24
#: Bytes of text that are walked at a time.
SLICE = 6 << 20


def random_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(mixed(np.arange(n, dtype=np.uint64) + np.uint64(1)) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


class Walks:
    """The shared tables: how long a walk stays on a character, which steps are sampled, which bit a character has there."""

    def __init__(self):
        coins = (random_numbers(WALKS * CLASSES * PERIOD, 1) >> np.uint64(63)).astype(bool).reshape(WALKS, CLASSES, PERIOD)
        coins[:, :, 0] |= ~coins.any(2)
        stay, wait = np.zeros(coins.shape, np.uint8), np.zeros(coins.shape[:2], np.int64)
        for step in range(2 * PERIOD - 1, -1, -1):  # steps until the coin says move, counted from the end; twice round
            wait = np.where(coins[:, :, step % PERIOD], 1, wait + 1)
            stay[:, :, step % PERIOD] = wait
        self.stay = stay.reshape(-1)
        self.rows = [[stay[r, c].tobytes() for c in range(CLASSES)] for r in range(WALKS)]
        self.char_class = (mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(99)) & np.uint64(CLASSES - 1)).astype(np.uint8)
        level = np.repeat(np.arange(LEVELS), SAMPLES)
        self.stride = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.int64)
        start = np.where(level == 0, 0, SAMPLES << np.maximum(level - 1, 0)).astype(np.int64)
        jitter = (random_numbers(len(level), 2) >> np.uint64(8)).astype(np.int64) % self.stride
        self.steps = start + np.tile(np.arange(SAMPLES), LEVELS) * self.stride + jitter
        self.bits = (random_numbers(WALKS * CLASSES * len(level), 3) >> np.uint64(63)).astype(np.uint8).reshape(WALKS, CLASSES, len(level))
        self.weights = np.concatenate([[0], np.cumsum(self.stride)])
        # a band of level g takes sampled steps out of the first 64 * 2**g, each stretch of them as often as it is long
        at = (random_numbers(LEVELS * WALKS * BANDS * IN_BAND, 4) >> np.uint64(8)).astype(np.int64).reshape(LEVELS, -1)
        at %= (SAMPLES << np.arange(LEVELS))[:, None]
        self.picked = (np.searchsorted(self.steps, at, "right") - 1).reshape(LEVELS, WALKS, BANDS, IN_BAND)
        self.factor = random_numbers(IN_BAND, 5) | np.uint64(1)

    def walk(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The step at which each walk leaves each character, WALKS rows."""
        whole = np.int32 if len(classes) < 1 << 23 else np.int64  # no walk stays 255 steps on a character
        left = np.empty((WALKS, len(classes)), whole)
        if not len(classes):
            return left
        order = np.argsort(-sizes, kind="stable")
        starts, falling = starts[order], sizes[order]
        counts = np.searchsorted(-falling, -np.arange(falling[0]), "left")  # texts that are longer than so many characters
        row, base = classes.astype(whole) * PERIOD, (np.arange(WALKS, dtype=whole) * CLASSES * PERIOD)[:, None]
        time, here = np.zeros((WALKS, len(starts)), whole), starts.copy()
        at = int((counts >= NARROW).sum())
        for on in counts[:at]:
            now, place = time[:, :on], here[:on]
            coin = now & (PERIOD - 1)
            coin += base
            coin += row.take(place)
            now += self.stay.take(coin)
            for r in range(WALKS):
                left[r][place] = now[r]
            place += 1
        if at == len(counts):
            return left
        for k in range(int(counts[at])):
            text = classes[starts[k] + at : starts[k] + falling[k]].tobytes()
            for r, rows in enumerate(self.rows):
                t, out = int(time[r, k]), []
                for c in text:
                    t += rows[c][t & (PERIOD - 1)]
                    out.append(t)
                left[r, starts[k] + at : starts[k] + falling[k]] = out
        return left

    def of(self, texts: list[str], bands: bool = False) -> tuple[list[str], list[np.ndarray]]:
        """A fingerprint of each text: for each walk its last step and the sampled bits, in hex. With bands also their keys."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.char_class[codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        left = self.walk(classes, starts, sizes)
        prints, keys = [], []
        column = np.arange(len(self.steps))
        for s, n in zip(starts.tolist(), sizes.tolist()):
            parts, own = [], []
            for r in range(WALKS):
                times = left[r, s : s + n]
                last = int(times[-1]) if n else 0
                m = int(np.searchsorted(self.steps, last))
                written_ = classes[s + np.searchsorted(times, self.steps[:m], "right")]
                parts.append(f"{last:x}:{np.packbits(self.bits[r, written_, column[:m]]).tobytes().hex()}")
                if bands:
                    own.append(self.keys(r, last, written_))
            prints.append("-".join(parts))
            keys.append(np.concatenate(own) if bands else None)
        return prints, keys

    def keys(self, r: int, last: int, seen: np.ndarray) -> np.ndarray:
        """Band keys of a walk: of the highest level that it passed and of the one below, so that walks of nearly equal length share one."""
        top = last // SAMPLES
        if not top:  # a short text is its own band
            return mixed(np.array([int.from_bytes(hashlib.md5(seen.tobytes()).digest()[:8], "little")], np.uint64) + np.uint64(r))
        top = top.bit_length() - 1
        out = []
        for level in {top, max(top - 1, 0)}:
            chars = seen[self.picked[level, r]].astype(np.uint64) + np.uint64(1)
            salt = np.uint64((level * WALKS + r) * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)
            out.append(mixed((mixed(chars * self.factor + np.arange(IN_BAND, dtype=np.uint64)) * self.factor).sum(1, dtype=np.uint64) + salt))
        return np.concatenate(out)

    def alike(self, a: str | None, b: str | None) -> float | None:
        """Share of steps, of the best walk, at which two fingerprints agree beyond chance; 1 for equal ones."""
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        best = 0.0
        for x, y in zip(a.split("-"), b.split("-")):
            (m, p), (n, q) = self.read(x), self.read(y)
            both, either = min(m, n), self.weights[max(m, n)]
            same = p[:both] == q[:both]
            if either:
                best = max(best, float((self.stride[:both] * np.where(same, 1, -1)).sum() / either))
        return best

    def read(self, part: str) -> tuple[int, np.ndarray]:
        last, bits = part.split(":")
        m = int(np.searchsorted(self.steps, int(last, 16)))
        return m, np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8), count=m)


@lru_cache(1)
def walks() -> Walks:
    return Walks()


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; null where one is null."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([walks().alike(p, q) for p, q in zip(x, y)], dtype="float64")

    return alike(a, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_chars (code points), fingerprint and bands (array<long>) of every row; a null text counts as empty."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = pc.fill_null(part["text"], "").to_pylist()
                prints, keys = walks().of(texts, bands=True)
                cols = [part["id"], pa.array(list(map(len, texts)), pa.int64()), pa.array(prints), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_chars", "fingerprint", "bands"])

    return docs.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string, bands array<long>").withColumnRenamed("id", id_col)


# --- the next document -----------------------------------------------------------


def dealt_in_order(docs: DataFrame, rows_each: int = 5_000) -> DataFrame:
    """part, visits, k1, k2, id, text: docs cut into stretches by descending id (null last; rows of one id by a hash of
    their text), each with the first rows of the stretch after it (visits 1); after the last comes the first.

    The cuts are taken from a sample of the keys, so they move work about and change no result.
    """
    docs = docs.withColumns({"k1": F.coalesce(F.bitwise_not(F.col("id").cast("long")), F.lit((1 << 63) - 1)), "k2": F.xxhash64("text")})
    keys = written(docs.select("k1", "k2"), "order-keys")
    rows = keys.count()
    parts = max(1, min(rows // 16, max(4 * docs.sparkSession.sparkContext.defaultParallelism, rows // rows_each)))
    share = min(1.0, 24 * parts / max(rows, 1))  # about 24 keys a part
    some = sorted((r.k1, r.k2) for r in keys.filter(F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 40)) < int(share * (1 << 40))).collect())
    cuts = [some[k * len(some) // parts] for k in range(1, parts)] if some else []
    cut1 = np.array([c[0] for c in cuts], np.int64)
    cut2 = np.array([c[1] for c in cuts], np.int64)

    def part_of(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(cut1, k1, "left"), np.searchsorted(cut1, k1, "right")
        for at, stop in {(a, b) for a, b in zip(low.tolist(), high.tolist()) if a < b}:  # ids that hold a cut
            held = (low == at) & (high == stop)
            low[held] = at + np.searchsorted(cut2[at:stop], k2[held], "right")
        return low

    @F.pandas_udf("int")
    def part(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(part_of(k1.to_numpy(), k2.to_numpy()), dtype="int32")

    heads = keys.groupBy(part("k1", "k2").alias("part")).agg(F.min(F.struct("k1", "k2")).alias("head")).select("part", "head.*").collect()  # a row a part
    heads.sort()
    before = {(h.k1, h.k2): heads[k - 1].part for k, h in enumerate(heads)}

    @F.pandas_udf("int")
    def visited(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series([before.get(k, -1) for k in zip(k1.tolist(), k2.tolist())], dtype="int32")

    placed = docs.withColumn("at", F.array(F.struct(part("k1", "k2").alias("part"), F.lit(0).alias("visits")), F.struct(visited("k1", "k2").alias("part"), F.lit(1).alias("visits"))))
    placed = placed.select(F.explode("at").alias("at"), "k1", "k2", "id", "text").filter("at.part >= 0").select("at.part", "at.visits", "k1", "k2", "id", "text")
    return placed.repartition(parts, "part").sortWithinPartitions("part", "visits", "k1", "k2", "text")


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.1) -> DataFrame:
    """The id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_next, next_distance of every row.

    bands_next: bands that the row shares with the next one; where it shares any, next_distance is their edit distance if that is within a
    tenth of the longer text, else null (a row alone is its own next). The edited text is the text with its last half replaced by as much of the next row's text (descending id); near_next
    compares with that row. Rows of one id follow each other by a hash of their text, rows without id come last; the row
    after the last is the first. Null texts count as empty.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_next", "next_distance"]

    def verified_next(a: str, b: str, shared: int) -> int | None:
        return edit_distance(a, b, int(share * max(len(a), len(b)))) if shared else None

    def results(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (part, visits, id, text, fingerprint, bands) in order; a row for each that another one of its part follows."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
        edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
        prints, _ = walks().of(edited)
        met = [len(np.intersect1d(a[5], b[5])) for a, b in pairs]
        out = [(a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), a[4], p, walks().alike(a[4], p), walks().alike(a[4], b[4]), m, verified_next(a[3], b[3], m)) for (a, b), e, p, m in zip(pairs, edited, prints, met)]
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)]
        return pa.RecordBatch.from_arrays(cols, names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next one has not come yet
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part["text"].to_pylist()
                prints, keys = walks().of(texts, bands=True)
                rows = held + list(zip(part["part"].to_pylist(), part["visits"].to_pylist(), part["id"].to_pylist(), texts, prints, keys))
                yield results(rows)
                held = rows[-1:]

    fields = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_next int, next_distance long"
    return dealt_in_order(docs).mapInArrow(run, fields).withColumnRenamed("id", id_col)


# --- near copies -------------------------------------------------------------------


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance, or None beyond most: bit-parallel columns in whole numbers of any size."""
    if abs(len(a) - len(b)) > most:
        return None
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        found = len(a) + len(b)
        return found if found <= most else None
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for k, c in enumerate(b):
        eq = where.get(c, 0)
        vertical = eq | down
        eq |= ((eq & up) + up) ^ up
        plus, minus = (down | ~(eq | up)) & full, up & eq
        score += bool(plus & last) - bool(minus & last)
        if score - (len(b) - k - 1) > most:
            return None
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
    return score if score <= most else None


def verified(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """row, lead of the pairs whose edit distance is at most share of the longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [edit_distance(a, b, int(share * max(len(a), len(b)))) is not None for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
            yield batch.filter(pa.array(close, pa.bool_())).select(["row", "lead"])

    a, b = (texts.select(F.col("__row").alias(n), F.col("text").alias(t)) for n, t in (("row", "a"), ("lead", "b")))
    return pairs.join(a, "row").join(b, "lead").select("row", "lead", "a", "b").mapInArrow(run, "row long, lead long")


def near_classes(docs: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, class_id, n_links (leaders found within reach) of every row: near copies by edit distance.

    Equal texts are one text. In every band the first open text leads, and the others within share of its length (edit
    distance over the longer text) are linked with it and leave the band; the rest go on to the next round, until no band
    holds two. class_id is the smallest doc_id that links reach. A null text counts as empty, empty texts are one class; null ids stay null and
    a class of them alone has a null class_id. A round compares each text with one leader a band: no pairs of a group's members are formed.
    """
    keyed = keyed_rows(docs).select("__row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = written(keyed.select("__row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "near-digests")
    groups = written(digests.groupBy("digest").agg(F.min("__row").alias("rep"), F.min("doc_id").alias("least")), "near-groups")
    texts = written(keyed.join(groups.select(F.col("rep").alias("__row")), "__row", "left_semi").select("__row", "text"), "near-texts")
    bands = fingerprints(texts, "__row").select(F.explode(F.array_distinct("bands")).alias("band"), F.col("__row").alias("row"))
    open_ = written(bands, "near-bands")
    links = None
    while True:
        leads = open_.groupBy("band").agg(F.min("row").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
        pairs = written(open_.join(leads, "band").filter("row <> lead"), "near-pairs")
        if pairs.isEmpty():
            break
        tried = pairs.select("row", "lead").distinct()
        found = written(verified(tried, texts, share), "near-links")
        links = found if links is None else links.unionByName(found)
        open_ = written(pairs.join(found, ["row", "lead"], "left_anti").select("band", "row"), "near-bands")
    label = written(groups.select(F.col("rep").alias("row"), F.col("rep").alias("class")), "near-labels")
    found = links.distinct() if links is not None else label.select("row", F.col("class").alias("lead")).limit(0)
    found = written(found, "near-links")
    while links is not None:  # each text takes the smallest class among itself and its neighbours, then its class's own class
        both = found.unionByName(found.select(F.col("lead").alias("row"), F.col("row").alias("lead")))
        near = both.join(label.withColumnRenamed("row", "lead"), "lead").groupBy("row").agg(F.min("class").alias("least"))
        least = label.join(near, "row", "left").select("row", "class", F.least("class", F.coalesce("least", "class")).alias("least"))
        jump = label.select(F.col("row").alias("least"), F.col("class").alias("up"))
        new = written(least.join(jump, "least").select("row", "class", F.least("least", "up").alias("new")), "near-labels")
        moved = new.filter("new <> class").isEmpty()
        label = new.select("row", F.col("new").alias("class"))
        if moved:
            break
    own = groups.join(label, groups.rep == label.row)
    ids = own.groupBy("class").agg(F.min("least").alias("class_id"))
    n_links = found.groupBy("row").agg(F.count("*").alias("n_links"))
    named = own.join(ids, "class").join(n_links, "row", "left").select("digest", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return digests.join(named, "digest").select("doc_id", "class_id", "n_links")


def op11_edit_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; edited_prints says what null, empty, repeated and tied rows give.
    An empty table gives no rows; other columns are ignored."""
    return edited_prints(table(spark, sf_dir, "documents"))
