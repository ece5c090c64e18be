"""N-gram Jaccard join of word-shingle sets, with set-relation skipping.

Exact for the threshold: an overlap of t * |x| or more forces two sets to share
one of their first |x| - ceil(t|x|) + 1 members in any common order, so only
these prefixes are indexed. Members met often in a sample of the rows come last
in that order; the order affects cost, never results.

* Equal sets are one class, which is one entry of every index list.
* Lists are sorted by set size: entries whose size cannot reach the threshold
  are skipped as a block, as are those whose positions leave too few members to
  share if this were the first shared one (a true pair passes at its first).
* Answers are derived from highly similar sets: star rounds first compare every
  set with one well-connected set of its lists. What is then in one component
  needs no pair; and where both members of a pair were compared with one and
  the same set, the triangle inequality of the Jaccard distance settles most
  of the others. Only the rest is compared, all of it.

Sets are 64-bit digests of shingles; pairs are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, first_of_groups, keyed_rows, mixed, table, written

ID_LAST = (1 << 63) - 1
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
STEP = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    values[65:91] = values[97:123]  # A-Z count as a-z
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Shingler:
    """Shingle sets of text arrays, hashed with array operations over the raw bytes."""

    def __init__(self, size: int = 5):
        self.size = size
        self.values, self.space = _tables()
        self.powers, self.inverse = _powers(STEP, BASE), _powers(STEP, pow(BASE, -1, 1 << 64))
        self.factors = mixed(np.arange(size, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of every word; no word crosses a text start."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = ~self.space[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~inside[:-1]
        cut[starts[starts < len(data)]] = True
        first = np.flatnonzero(inside & cut[:-1])
        cut[:-1] |= ~inside
        after = np.flatnonzero(inside & cut[1:]) + 1
        out = np.empty(len(first), np.uint64)
        i = 0
        while i < len(first):
            lo = first[i]
            j = max(i + 1, int(np.searchsorted(after, lo + STEP, "right")))
            hi = after[j - 1]
            long = hi - lo > STEP
            up, down = (_powers(hi - lo, BASE), None) if long else (self.powers, self.inverse)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            h = sums[after[i:j] - lo] - sums[first[i:j] - lo]
            out[i:j] = h if long else h * down[first[i:j] - lo]
            i = j
        return first, mixed(out + (after - first).astype(np.uint64) * np.uint64(BASE))

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle digests of each text; empty for null and for no word. Few texts at a time bound the memory."""
        for at in range(0, len(texts), 256):
            yield from self._sets(texts.slice(at, 256))

    def _sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        place, words = self.words(data, offsets[:-1])
        at = np.searchsorted(place, offsets)
        k = self.size
        whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            whole += words[i : len(words) - k + 1 + i] * self.factors[i] if len(whole) else 0
        whole = mixed(whole)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                short = int((words[a:b] * self.factors[: b - a]).sum(dtype=np.uint64)) + int(b - a) * BASE
                yield mixed(np.array([short & MASK], np.uint64))
            else:
                yield whole[:0]


def signature(s: np.ndarray) -> int:
    """64 bits for a set; 0 for the empty one."""
    return int(mixed(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def documents(docs: DataFrame, size: int) -> DataFrame:
    """id, text_key, n (set size) and sig (set class) of every row."""

    def run(batches):
        shingler = Shingler(size)
        for b in batches:
            sets = [(len(s), signature(s)) for s in shingler.sets(b["text"])]
            yield pa.RecordBatch.from_arrays([b["id"], b["text_key"], pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.int64())], ["id", "text_key", "n", "sig"])

    return docs.mapInArrow(run, "id long, text_key long, n long, sig long")


def frequent_members(docs: DataFrame, size: int, share: float = 0.1, least: int = 3, most: int = 300_000) -> np.ndarray:
    """Members found in `least` or more of a fixed share of the rows, commonest last; at most `most` of them (8 bytes each).

    With a fixed share, a list whose members stay undetected has a length that
    does not grow with the corpus.
    """

    def run(batches):
        shingler = Shingler(size)
        for b in batches:
            found = list(shingler.sets(b["text"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    sample = docs.filter(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    met = sample.mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(most)
    return met.select("token").toArrow()["token"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def index_rows(docs: DataFrame, size: int, percent: int, late: np.ndarray) -> DataFrame:
    """token, sig, n, pos: one row per prefix member; a set met again in its partition is indexed once."""

    def run(batches):
        shingler, seen = Shingler(size), set()
        by_value = np.argsort(late)
        known = late[by_value]
        for b in batches:
            out, held = [], 0
            for s in shingler.sets(b["text"]):
                sig = signature(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = known[at] == s
                    if common.any():
                        last = s[common][np.argsort(by_value[at[common]])]
                        s = np.concatenate([s[~common], last])
                p = prefix_length(len(s), percent)
                out.append((s[:p], sig, len(s)))
                held += p
                if held > 200_000:
                    yield _index_batch(out)
                    out, held = [], 0
            if out:
                yield _index_batch(out)

    return docs.select("text").mapInArrow(run, "token long, sig long, n int, pos int")


def _index_batch(out) -> pa.RecordBatch:
    lengths = np.array([len(p) for p, _, _ in out])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([p for p, _, _ in out]).view(np.int64)),
            pa.array(np.repeat(np.array([s for _, s, _ in out], np.int64), lengths)),
            pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), lengths)),
            pa.array((np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)),
        ],
        ["token", "sig", "n", "pos"],
    )


def _whole_lists(batches, columns: list[str]):
    """Column arrays that always hold whole lists of a token-sorted partition."""
    held = None
    for b in batches:
        now = {c: b[c].to_numpy(zero_copy_only=False) for c in columns}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in columns}
        t = held["token"]
        if not len(t) or t[0] == t[-1]:
            continue
        cut = np.searchsorted(t, t[-1])
        yield {c: v[:cut] for c, v in held.items()}
        held = {c: v[cut:] for c, v in held.items()}
    if held is not None and len(held["token"]):
        yield held


def shared_lists(rows: DataFrame) -> DataFrame:
    """The index lists with two or more classes: token, sig, n, pos, df (classes in the list)."""

    def run(batches):
        for g in _whole_lists(batches, ["token", "sig", "n", "pos"]):
            t, s = g["token"], g["sig"]
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            g = {c: v[keep] for c, v in g.items()}
            _, inverse, counts = np.unique(g["token"], return_inverse=True, return_counts=True)
            df = counts[inverse]
            g = {c: v[df > 1] for c, v in g.items()} | {"df": df[df > 1].astype(np.int64)}
            if len(g["token"]):
                yield pa.RecordBatch.from_arrays([pa.array(g[c]) for c in ("token", "sig", "n", "pos", "df")], ["token", "sig", "n", "pos", "df"])

    return rows.repartition("token").sortWithinPartitions("token", "n", "sig").mapInArrow(run, "token long, sig long, n int, pos int, df long")


def open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """lists with comp, near, far (the set it was compared with and the distance). a < b: pairs of different
    components that no filter settles: size, position, and the triangle inequality over a set both were compared with."""
    apart = 1 - percent / 100 + 1e-9

    def run(batches):
        for g in _whole_lists(batches, ["token", "sig", "n", "pos", "comp", "near", "far"]):
            t = g["token"]
            edges = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]])
            found: list[np.ndarray] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                comp = g["comp"][lo:hi]
                if hi - lo < 2 or (comp == comp[0]).all():
                    continue
                n, rest, sig, near, far = g["n"][lo:hi].astype(np.int64), (g["n"][lo:hi] - g["pos"][lo:hi]).astype(np.int64), g["sig"][lo:hi], g["near"][lo:hi], g["far"][lo:hi]
                ends = np.searchsorted(n, 100 * n // percent, "right")  # sizes beyond are skipped as a block
                able = rest * (100 + percent) >= 2 * percent * n  # its own position leaves enough for a partner of its size
                for i in np.flatnonzero((ends > np.arange(1, hi - lo + 1)) & able):
                    js = slice(i + 1, ends[i])
                    ok = (comp[js] != comp[i]) & (np.minimum(rest[i], rest[js]) * (100 + percent) >= percent * (n[i] + n[js]))
                    ok &= (near[js] != near[i]) | (np.abs(far[js] - far[i]) <= apart)
                    other = sig[js][ok]
                    if len(other):
                        found.append(np.stack([np.minimum(other, sig[i]), np.maximum(other, sig[i])]))
            if found:
                rows = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["a", "b"])

    return lists.repartition("token").sortWithinPartitions("token", "n", "sig").mapInArrow(run, "a long, b long").distinct()


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs a, b with the whole texts of both classes: a, b, overlap, united (exact set sizes)."""
    first = pairs.select("a", "b").join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        shingler = Shingler(size)
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for x, y in zip(list(shingler.sets(part["text_a"])), shingler.sets(part["text_b"])):
                    out.append(len(np.intersect1d(x, y, assume_unique=True)))
                    out.append(len(x) + len(y) - out[-1])
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(out[::2], pa.int64()), pa.array(out[1::2], pa.int64())], ["a", "b", "overlap", "united"])

    return both.mapInArrow(run, "a long, b long, overlap long, united long").dropDuplicates(["a", "b"])


def are_stars(edges: DataFrame) -> bool:
    """No node of edges u > v has two edges upwards, or edges both ways: the star steps would leave them as they are."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").count()


def components(links: DataFrame) -> DataFrame:
    """links a, b: node and the smallest node of its component (alternating large and small stars, each from a written table)."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "cc")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = written(large, "cc")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u > v").distinct(), "cc")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents link when 100 * overlap >= percent * union of their distinct shingles.

    A text shorter than a shingle is one shingle, whole; a null or wordless text
    has the empty set and links with nothing. Rows without an id take part and
    only name a component when all its rows lack one (null then). Repeated rows
    are in one component. Extra columns are ignored; an empty table gives no rows.
    """
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(ID_LAST)).alias("id"), F.col(text_col).alias("text"))
    keyed = given.withColumn("text_key", F.xxhash64("text"))
    known = written(documents(keyed, size), "jj-documents")
    late = frequent_members(given, size)
    lists = written(shared_lists(index_rows(given, size, percent, late)), "jj-lists")
    # how many others a set's indexed members meet on average; members that no other set has count as none
    indexed = F.first("n") - F.ceil(F.first("n") * percent / 100) + 1
    weight = written(lists.groupBy("sig").agg((F.sum("df") / indexed).alias("weight")), "jj-classes")
    n_classes = weight.count()
    links = None
    if n_classes:
        firsts = known.filter("n > 0").groupBy("sig").agg(F.min(F.struct("id", "text_key")).alias("r")).join(weight.select("sig"), "sig", "left_semi")
        firsts = written(firsts.select("sig", "r.id", "r.text_key"), "jj-firsts")
        texts = written(keyed.join(broadcast_if_small(firsts, n_classes, 64), ["id", "text_key"]).select("sig", "text"), "jj-texts")
        links = _links(lists, weight, n_classes, texts, percent, size, rounds)
    own = known.filter("n > 0").groupBy("sig").agg(F.min("id").alias("first_id"))
    if links is None:
        named = own.select("sig", F.col("first_id").alias("component"))
    else:
        comp = components(links).withColumnRenamed("node", "sig")
        linked = own.join(comp, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        linked = written(linked, "jj-linked")
        lowest = linked.groupBy("comp").agg(F.min("first_id").alias("component"))
        named = linked.join(lowest, "comp").select("sig", "component")
    out = known.join(named, "sig", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    null_last = lambda c: F.when(F.col(c) < ID_LAST, F.col(c))
    return out.select(null_last("id").alias("doc_id"), F.col("n").alias("n_shingles"), null_last("component").alias("component_id"))


def _links(lists, weight, n_classes, texts, percent, size, rounds) -> DataFrame:
    spark = lists.sparkSession
    seen = spark.createDataFrame([], "a long, b long, overlap long, united long")
    is_link = F.col("overlap") * 100 >= percent * F.col("united")
    comp = weight.select("sig", F.col("sig").alias("comp"))
    early = lists.filter((F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n"))  # enough to meet one's like
    for k in range(rounds):
        order = F.col("weight") if k == 0 else F.col("weight") * (1 + F.pmod(F.xxhash64("sig", F.lit(k)), F.lit(1000)) / 1000.0)
        about = comp.join(weight.select("sig", "weight"), "sig")
        at = early.select("token", "sig", "n").join(broadcast_if_small(about, n_classes, 48), "sig").withColumn("order", order)
        top = F.max(F.struct("order", "sig", "comp", "n")).over(Window.partitionBy("token"))
        met = at.withColumn("top", top).filter((F.col("top.comp") != F.col("comp")) & (F.least("n", "top.n") * 100 >= percent * F.greatest("n", "top.n")))
        met = met.groupBy("sig", F.col("top.sig").alias("pivot")).count()
        best = met.groupBy("sig").agg(F.max(F.struct("count", "pivot")).alias("m")).select("sig", F.col("m.pivot").alias("pivot"))
        pairs = best.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")
        new = written(compared(written(pairs, "jj-pairs"), texts, size), "jj-compared")
        seen = seen.unionByName(new)
        n_new = new.filter(is_link).count()
        if n_new:
            found = components(seen.filter(is_link).select("a", "b")).withColumnRenamed("node", "sig")
            comp = written(weight.select("sig").join(found, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "jj-comp")
        if n_new * 1000 < n_classes:  # another round would hardly join anything
            break
    distance = (1 - F.col("overlap") / F.col("united")).alias("d")
    to = seen.select(F.col("a").alias("sig"), F.col("b").alias("p"), distance).unionByName(seen.select(F.col("b").alias("sig"), F.col("a").alias("p"), distance))
    # each set keeps its distance to the most compared of the sets that it was compared with
    times = to.groupBy("p").agg(F.count(F.lit(1)).alias("times"))
    nearest = to.join(times, "p").groupBy("sig").agg(F.max(F.struct("times", "p", "d")).alias("m")).select("sig", F.col("m.p").alias("near"), F.col("m.d").alias("far"))
    nearest = written(nearest, "jj-nearest")
    centres = nearest.select(F.col("near").alias("sig")).distinct().withColumn("own", F.lit(True))
    about = written(comp.join(nearest, "sig", "left").join(centres, "sig", "left"), "jj-about")
    near = F.when(F.col("own"), F.col("sig")).otherwise(F.coalesce("near", "sig"))
    about = about.select("sig", "comp", near.alias("near"), F.when(F.col("own") | F.col("near").isNull(), 0.0).otherwise(F.col("far")).alias("far"))
    at = lists.drop("df").join(broadcast_if_small(about, n_classes, 48), "sig")
    pairs = open_pairs(at, percent).join(seen.select("a", "b"), ["a", "b"], "left_anti")
    return seen.unionByName(written(compared(written(pairs, "jj-pairs"), texts, size), "jj-compared")).filter(is_link).select("a", "b")


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; jaccard_components says what nulls, repeated rows and empty tables give."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
c AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, any_value(s) AS s, any_value(len(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT k, n, unnest(s) AS x FROM c),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS o, any_value(a.n) AS n_a, any_value(b.n) AS n_b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (n_a + n_b - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(k, z) AS (SELECT k, k FROM c UNION SELECT u.b, r.z FROM r JOIN u ON u.a = r.k),
m AS (SELECT k, min(z) AS z FROM r GROUP BY k),
d AS (SELECT s.doc_id, len(s.s) AS n, m.z FROM s LEFT JOIN m ON m.k = md5(array_to_string(list_sort(s.s), chr(10))) AND len(s.s) > 0)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY z) END AS component_id FROM d
"""


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group only the row with the smallest doc_id stays; null ids come last.

    Rows are told apart by a row key, so repeated and null ids
    neither lose another row nor keep a copy. Wordless and null texts all stay.
    All columns come back, whatever their names; an empty table gives no rows.
    """
    keyed = keyed_rows(docs)
    named = written(jaccard_components(keyed, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("grp")), "jj-named")
    several = named.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
    return first_of_groups(keyed, named.join(several, "grp", "left_semi")).select("__doc.*")
