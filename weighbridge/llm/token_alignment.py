"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens overlap.

Two tokenizers cut the same bytes, A and B; the byte offsets at which tokens end are
two ascending lists per text. Merging them is cut by the merge-path method: a binary
search along each diagonal finds how many ends of A and of B come before it, so that
every piece between two diagonals merges the same number of ends whatever the texts
are. All pieces of a batch then step together. Each step of a piece emits the overlap
of its current A and B token; pieces know their own group ends only, and a running
sum over the pieces stitches groups that cross a boundary.

Counting how often two ids are linked is a shuffle of numbers: no text leaves the
task that read it, and nothing is encoded twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, table, written
from .sentencepiece_codec import MODEL, Decoder, Encoder, Plan, model_bytes
from .sentencepiece_codec import Model as PieceModel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern by which byte-level BPE vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ends that a piece of the merge takes.
PIECE = 128
#: Bytes of text that are encoded and merged at a time.
SLICE = 1 << 20


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE vocabulary (the JSON of the tokenizers library): ids of texts, and the bytes of every id."""

    def __init__(self, data: bytes):
        said = json.loads(data)
        signs, special = byte_of_sign(), {x["content"] for x in said["added_tokens"] if x["special"]}
        self.ranks = {bytes(map(signs.__getitem__, s)): i for s, i in said["model"]["vocab"].items() if s not in special}
        vocabulary = said["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"])
        if any(vocabulary["".join(pair)] != 256 + k for k, pair in enumerate(pairs)):
            raise ValueError("merges are not in the order of ids")

    @cached_property
    def coder(self):
        import tiktoken

        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def pieces(self) -> pa.Array:
        out = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            out[i] = piece
        return pa.array(out, pa.binary())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's start, with the end of the last. Special strings are plain text."""
        ids = [self.coder.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64), np.cumsum([0, *map(len, ids)])


class Pieces:
    """A SentencePiece model: ids of texts as that library gives them, and the bytes of every id."""

    def __init__(self, data: bytes):
        plan = Plan.of(PieceModel(data))
        self.coder, self.pieces = Encoder(plan), Decoder(plan).pieces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists, same = self.coder.encode(texts)
        if not same.all():  # the library itself decides where the rebuilt tokenizer differs
            said = lists.to_pylist()
            for k in np.flatnonzero(~same):
                said[k] = self.coder.reference.encode(texts[k].as_py())
            lists = pa.array(said, pa.list_(pa.int32()))
        ends = lists.offsets.to_numpy().astype(np.int64)
        return lists.flatten().to_numpy().astype(np.int64), ends - ends[0]


def merge_path(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of the tokens of many texts, in order: index of the A token, of the B token, and the number of the group.

    a, b: byte offsets at which tokens end, ascending within a text; a_at, b_at: where each text's
    begin, with the end of the last. The last ends of a text's A and B tokens must be equal. Of
    equal ends A's is taken first, so the step that takes B's after it closes a group and emits nothing.
    """
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    pieces = -(-(n_a + n_b) // piece)
    text = np.repeat(np.arange(len(pieces)), pieces)
    diagonal = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
    low, high = np.maximum(0, diagonal - n_b[text]), np.minimum(diagonal, n_a[text])
    a0, b0 = a_at[:-1][text], b_at[:-1][text]
    while (open_ := low < high).any():  # how many ends of A come among the first `diagonal` ends
        mid = (low + high) >> 1
        first = a[np.minimum(a0 + mid, len(a) - 1)] <= b[np.clip(b0 + diagonal - mid - 1, 0, len(b) - 1)]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    i, j = a0 + low, b0 + diagonal - low
    a_stop, b_stop = a_at[1:][text], b_at[1:][text]
    length = np.minimum(piece, (n_a + n_b)[text] - diagonal)
    # the B token that a piece starts in may already be closed by the A end that the piece before took last
    tied = (low > 0) & (j < b_stop) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)])
    order = np.argsort(-length, kind="stable")  # short last pieces leave early
    i, j, a_stop, b_stop, tied, length = (x[order] for x in (i, j, a_stop, b_stop, tied, length))
    made_a, made_b = np.full((len(i), piece), -1, np.int64), np.full((len(i), piece), -1, np.int64)
    closed = np.zeros((len(i), piece), bool)
    top_a, top_b = max(len(a) - 1, 0), max(len(b) - 1, 0)
    for step in range(piece):
        on = int(np.searchsorted(-length, -step, "left"))
        if not on:
            break
        x, y, t = i[:on], j[:on], tied[:on]
        end_a, end_b = a[np.minimum(x, top_a)], b[np.minimum(y, top_b)]
        made_a[:on, step], made_b[:on, step] = np.where(t, -1, x), np.where(t, -1, y)
        closed[:on, step] = t
        takes_a = ~t & (x < a_stop[:on]) & (end_a <= end_b)
        tied[:on] = takes_a & (end_a == end_b)
        x += takes_a
        y += ~takes_a
    back = np.argsort(order)
    made_a, made_b, closed = made_a[back], made_b[back], closed[back]
    before = np.cumsum(closed.sum(1)) - closed.sum(1)  # groups that earlier pieces closed
    group = before[:, None] + np.cumsum(closed, 1)
    kept = made_a >= 0
    return made_a[kept], made_b[kept], group[kept]


class Aligner:
    """Texts of a task to their groups and links."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.sizes_a, self.sizes_b = (pc.binary_length(x.pieces).to_numpy().astype(np.int64) for x in (a, b))
        # every id as it is written in a group list: after a comma, a semicolon, a bar, or first
        self.signs = pa.array([f"{sign}{k}" for x in (a, b) for sign in (",", ";", "|", "") for k in range(len(x.pieces))], pa.large_string())

    def same_bytes(self, pieces: pa.Array, ids: np.ndarray, at: np.ndarray, wanted: list[bytes], sizes: np.ndarray) -> np.ndarray:
        data = pieces.take(pa.array(ids)).buffers()[2]
        joined = memoryview(data if data is not None else b"").cast("B")
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[at]
        return np.array([joined[s:e] == w for s, e, w in zip(ends, ends[1:], wanted)], bool)

    def run(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """Of each text: n_a, n_b, n_groups, n_links, groups_sha256; of all: links (text number, A id, B id)."""
        given = texts.to_pylist()
        spaced = [" " + t for t in given]
        wanted = [t.encode() for t in spaced]
        ids_a, at_a = self.a.encode(spaced)
        ids_b, at_b = self.b.encode(texts)
        whole = self.same_bytes(self.a.pieces, ids_a, at_a, wanted, self.sizes_a) & self.same_bytes(self.b.pieces, ids_b, at_b, wanted, self.sizes_b)
        whole &= np.array([bool(t) for t in given], bool)
        if not whole.all():  # texts without tokens
            ids_a, at_a = ids_a[np.repeat(whole, np.diff(at_a))], np.concatenate([[0], np.cumsum(np.diff(at_a) * whole)])
            ids_b, at_b = ids_b[np.repeat(whole, np.diff(at_b))], np.concatenate([[0], np.cumsum(np.diff(at_b) * whole)])
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        ends = []
        for ids, at, sizes, n in ((ids_a, at_a, self.sizes_a, n_a), (ids_b, at_b, self.sizes_b, n_b)):
            all_ends = np.cumsum(sizes[ids])
            ends.append(all_ends - np.repeat(np.concatenate([[0], all_ends])[at[:-1]], n))
        i, j, group = merge_path(*ends, at_a, at_b)
        text = np.searchsorted(at_a, i, "right") - 1
        n_links = np.bincount(text, minlength=len(given))
        n_groups = n_a + n_b - n_links
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": self.digests(ids_a, ids_b, at_a, at_b, i, j, group),
                "text": text, "a": ids_a[i], "b": ids_b[j]}

    def digests(self, ids_a, ids_b, at_a, at_b, i, j, group) -> list[str]:
        """The digest of each text's groups, written out; '' without tokens."""
        n = len(ids_a) + len(ids_b)
        if not n:
            return [""] * (len(at_a) - 1)
        of_a, of_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        of_a[i], of_b[j] = group, group
        groups = int(group[-1]) + 1
        count_a, count_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        # in writing order a group's A ids stand before its B ids
        place_a = np.arange(len(ids_a)) + (np.cumsum(count_b) - count_b)[of_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(count_a)[of_b]
        first_a, first_b = np.diff(of_a, prepend=-1) > 0, np.diff(of_b, prepend=-1) > 0
        opens = np.zeros(len(ids_a) + 1, bool)
        opens[at_a[:-1]] = True
        sign_a = np.where(opens[:-1], 3, np.where(first_a, 1, 0))
        size_a, size_b = len(self.a.pieces), len(self.b.pieces)
        pick = np.empty(n, np.int64)
        pick[place_a] = sign_a * size_a + ids_a
        pick[place_b] = 4 * size_a + np.where(first_b, 2, 0) * size_b + ids_b
        out = self.signs.take(pa.array(pick))
        offsets = np.frombuffer(out.buffers()[1], np.int64, n + 1)
        data = memoryview(out.buffers()[2]) if out.buffers()[2] is not None else memoryview(b"")
        cuts = offsets[at_a + at_b]
        return [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in zip(cuts.tolist(), cuts[1:].tolist())]


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each stands."""
    key = np.sort(key)
    at = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(at, append=len(key))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def aligned(docs: DataFrame, vocabulary: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table. Rows with a __row (one for each row of docs): the id, n_a, n_b, n_groups, n_links, groups_sha256, and the
    text's distinct id pairs with their number (a, b, n). Rows without: the distinct pairs of some megabytes of text (all_a, all_b, all_n).

    Null and empty texts, and those whose tokens do not spell space + text, have zeros and no pairs.
    Other columns are ignored; repeated rows give a row each.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    names = ["__row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n", "all_a", "all_b", "all_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = Aligner(ByteLevel(vocabulary), Pieces(model)), TaskContext.get().partitionId() << 40
        size_b = len(aligner.b.pieces)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                got = aligner.run(pc.fill_null(part["text"], ""))
                pair = got["a"] * size_b + got["b"]
                span = len(aligner.a.pieces) * size_b
                key, count = counted(got["text"] * span + pair)
                per_text, pairs = np.bincount(key // span, minlength=n), key % span
                own = [pa.array(np.arange(row, row + n)), part["id"], *(pa.array(got[c].astype(np.int64)) for c in names[2:6]), pa.array(got["groups_sha256"], pa.string())]
                own += [lists(x, per_text) for x in (pairs // size_b, pairs % size_b, count)]
                none = pa.nulls(n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own, none, none, none], names)
                row += n
                if len(pair):
                    pairs, count = counted(pair)
                    all_ = [lists(x, np.array([len(x)])) for x in (pairs // size_b, pairs % size_b, count)]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x.type) for x in own), *all_], names)

    fields = f"__row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return written(docs.mapInArrow(run, fields + "".join(f", {c} array<int>" for c in names[7:])), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, count (links that hold the pair), best (no A id is linked with b more often) of aligned rows."""
    pairs = rows.filter("__row is null").select(F.explode(F.arrays_zip("all_a", "all_b", "all_n")).alias("p"))
    counts = written(pairs.groupBy(F.col("p.all_a").alias("a"), F.col("p.all_b").alias("b")).agg(F.sum("p.all_n").alias("count")), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    best = broadcast_if_small(best, best.count(), 48)  # a row for each id of B at most
    return written(counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pair-best")


def alignment(docs: DataFrame, vocabulary: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; see aligned for odd texts."""
    rows = aligned(docs, vocabulary, model, id_col, text_col)
    counts = pair_counts(rows)
    links = rows.filter("__row is not null").select("__row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("__row", "p.a", "p.b", "p.n")
    found = links.join(broadcast_if_small(counts, counts.count(), 48), ["a", "b"])
    sums = found.groupBy("__row").agg(F.sum(F.col("n") * F.col("best").cast("int")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    own = rows.filter("__row is not null").select("__row", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(sums, "__row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark, sf_dir: str, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Alignment of every document under the byte-level vocabulary and the piece model. Null, empty and unspellable texts
    have zeros and ''; null and repeated ids are kept as they are, a row for each row; an empty table gives no rows."""
    return alignment(table(spark, sf_dir, "documents"), model_bytes(vocabulary), model_bytes(model))
