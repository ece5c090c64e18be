"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here and rebuilt as a tokenizers pipeline:
normaliser, metaspace marker, unigram scores or BPE merges, byte fallback.
Where no piece of the vocabulary runs across a marker (or holds a line feed), a
text's ids are those of its stretches between them; Arrow numbers the stretches,
each distinct one is encoded once (in multithreaded batches) and compared with
the sentencepiece library, and ids and decoded bytes are gathered by number.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE, LEARN, RUN = 250_000, 16_384, 128


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; numbers as ints, floats as their four bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            n = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[at : at + n]
            at += n


class Model:
    """What a SentencePiece model file holds, as far as encoding needs it."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.charsmap = 1, b""
        self.dummy_prefix = self.trim = self.escape = True
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                f = dict(fields(value))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        self.byte_fallback = any(t == BYTE for _, _, t in self.pieces)
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        #: no piece runs across a marker and no score is summed over the text, so stretches can be encoded alone
        self.separable = self.kind == 2 and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED)) and not any(t == USER_DEFINED for _, _, t in self.pieces)

    def normaliser(self):
        from tokenizers import Regex, normalizers as N

        steps = [N.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [N.Strip(), N.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(N.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(N.Replace(" ", MARK))
            if self.trim:  # a marker that the text holds at its end counts as a space
                steps.append(N.Replace(Regex(f"{MARK}+$"), ""))
        return N.Sequence(steps)

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces into a third, best score first."""
        ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for p, i in ids.items():
            found += [(-self.pieces[i][1], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import Tokenizer, decoders, models

        if self.kind == 1:
            made = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == 2:
            made = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), byte_fallback=self.byte_fallback, fuse_unk=True, unk_token=self.pieces[self.unknown][0])
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        out = Tokenizer(made)
        out.normalizer = self.normaliser()
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1 if self.dummy_prefix else 0, 0)])
        return out

    def piece_bytes(self) -> list[bytes]:
        """What each id decodes to."""
        out = []
        for p, _, t in self.pieces:
            out.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        return out


class Unigram:
    """The best segmentation with scores summed in single precision from the text's start, as the reference sums them:
    where two segmentations tie, rounding decides. The tokenizers library sums in double precision; texts on which the
    two differ are encoded again here."""

    def __init__(self, m: Model):
        usable = [(p, i, s) for i, (p, s, t) in enumerate(m.pieces) if t in (NORMAL, USER_DEFINED)]
        self.ids, self.score = {p: i for p, i, _ in usable}, {p: np.float32(s) for p, _, s in usable}
        self.longest = max((len(p) for p in self.ids), default=1)
        normal = [s for p, s, t in m.pieces if t == NORMAL]
        self.unknown, self.unknown_score = m.unknown, np.float32(min(normal, default=0.0)) - np.float32(10)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(m.pieces) if t == BYTE}

    def encode(self, text: str) -> list[int]:
        """ids of a normalised text."""
        best: list[tuple[np.float32, int] | None] = [(np.float32(0), 0), *[None] * len(text)]
        for at in range(len(text)):
            so_far = best[at][0]
            for n in range(1, min(self.longest, len(text) - at) + 1):
                score = self.score.get(text[at : at + n])
                if score is None:
                    if n > 1:
                        continue
                    score = self.unknown_score
                if best[at + n] is None or score + so_far > best[at + n][0]:
                    best[at + n] = score + so_far, at
        pieces, end = [], len(text)
        while end:
            pieces.append(text[best[end][1] : end])
            end = best[end][1]
        out: list[int] = []
        for p in reversed(pieces):
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


@dataclass(frozen=True)
class Plan:
    """What a task needs of a model: the rebuilt tokenizer, the file for the reference library, and its rules."""

    data: bytes
    tokenizer: str
    pieces: tuple[bytes, ...]
    #: which pieces start with a marker or are a line feed
    starts: tuple[bool, ...]
    mark_id: int | None
    dummy_prefix: bool
    separable: bool
    #: texts can be stretched as they are, without the normaliser
    verbatim: bool
    #: no piece holds a line feed, so a stretch may also start at one
    by_line: bool

    @classmethod
    def of(cls, m: Model) -> Plan:
        pieces = [p for p, _, t in m.pieces if t in (NORMAL, USER_DEFINED, UNUSED)]
        verbatim = not m.charsmap and not m.trim and m.dummy_prefix and m.escape
        mark = next((i for i, p in enumerate(m.pieces) if p[0] == MARK), None)
        return cls(m.data, m.tokenizer().to_str(), tuple(m.piece_bytes()), tuple(p.startswith(MARK) or t == BYTE and int(p[3:5], 16) == 10 for p, _, t in m.pieces), mark, m.dummy_prefix, m.separable and mark is not None, verbatim, m.byte_fallback and not any("\n" in p for p in pieces))


class Encoder:
    """Batches of texts to ids, with the stretches met so far remembered (a bounded number)."""

    def __init__(self, plan: Plan):
        import sentencepiece
        from tokenizers import Tokenizer, normalizers

        self.plan, self.whole = plan, Tokenizer.from_str(plan.tokenizer)
        self.plain = Tokenizer(self.whole.model)
        self.plain.normalizer = normalizers.Sequence([])
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=plan.data)
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation before: what is met again moves on, the rest is forgotten
        self.unequal: set[str] = set()
        self.starts = np.array(plan.starts, bool)
        self.unigram = None if plan.separable or (model := Model(plan.data)).kind != 1 else Unigram(model)

    def both(self, texts: list[str], lead: int) -> list[tuple[list[int], list[int]]]:
        """ids by the tokenizer and by the reference, of texts that start with a marker
        (lead 0) or, after the marker that the reference sets itself, without one (lead 1)."""
        skip = 1 if self.plan.dummy_prefix and not lead else 0
        got = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        said = self.reference.encode([t[skip:].replace(MARK, " ") for t in texts], num_threads=1)
        return [(g, r[lead:]) for g, r in zip(got, said)]

    def learn(self, new: list[str], lead: int) -> None:
        for s, (got, said) in zip(new, self.both(new, lead)):
            self.ids[s] = array("i", got).tobytes()
            if got != (said if s != MARK else [self.plan.mark_id]):  # a text cannot be the marker alone
                self.unequal.add(s)

    def learn_joined(self, new: list[str], lead: int) -> None:
        """Stretches that start with their only marker or line feed: encoded in runs,
        which the pieces with a marker or line feed part again."""
        runs = [new[k : k + RUN] for k in range(0, len(new), RUN)]
        for run, (got, said) in zip(runs, self.both(["".join(r) for r in runs], lead)):
            ids = np.array(got, np.int32)
            starts = np.flatnonzero(self.starts[ids]) * 4
            if got != said or len(starts) != len(run):
                self.learn(run, lead)
                continue
            data, at = ids.tobytes(), starts.tolist()
            self.ids.update(zip(run, map(data.__getitem__, map(slice, at, [*at[1:], len(data)]))))

    def known(self, stretches: list[str]) -> list[bytes]:
        """ids of distinct stretches."""
        if len(self.ids) > CACHE:
            self.before, self.ids = self.ids, {}
        ids, before = self.ids, self.before
        marked, by_line, odd, odd_bare = [], [], [], []
        for s in stretches:
            if s not in ids:
                if (old := before.get(s)) is not None:
                    ids[s] = old
                elif s[0] == MARK:
                    (marked if len(s) > 1 and MARK not in s[1:] and "\n" not in s else odd).append(s)
                elif s[0] == "\n" and self.plan.by_line and MARK not in s and "\n" not in s[1:]:
                    by_line.append(s)
                else:
                    (odd_bare if self.plan.dummy_prefix else odd).append(s)
        for new, learn, lead in ((marked, self.learn_joined, 0), (by_line, self.learn_joined, 1), (odd, self.learn, 0), (odd_bare, self.learn, 1)):
            for at in range(0, len(new), LEARN):
                learn(new[at : at + LEARN], lead)
        return list(map(ids.__getitem__, stretches))

    def joined(self, distinct: list[str], codes: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Texts as runs of stretch codes that stop at ends, to lists of ids and to whether all stretches agree."""
        blobs = self.known(distinct)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts, sizes = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(blobs), np.int32)[np.repeat(starts - stops[:-1], sizes) + np.arange(stops[-1])]
        lists = pa.ListArray.from_arrays(pa.array(stops[ends].astype(np.int32)), pa.array(flat))
        if not self.unequal:
            return lists, np.ones(len(ends) - 1, bool)
        bad = np.array([s in self.unequal for s in distinct], bool)[codes]
        return lists, np.diff(np.concatenate([[0], np.cumsum(bad)])[ends]) == 0

    def spaced(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts whose markers are single spaces between words: split, numbered and joined by Arrow."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if self.plan.by_line else texts, " ")
        coded = words.flatten().dictionary_encode()
        distinct = [w if self.plan.by_line and w[:1] == "\n" else MARK + w for w in coded.dictionary.to_pylist()]
        ends = words.offsets.to_numpy()
        return self.joined(distinct, coded.indices.to_numpy(), ends - ends[0])

    def stretched(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Any other texts."""
        if not self.plan.verbatim:
            parts = [STRETCH.findall(self.whole.normalizer.normalize_str(t)) for t in texts]
        else:
            parts = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        code: dict[str, int] = {}
        codes = np.array([code.setdefault(s, len(code)) for p in parts for s in p], np.int64)
        return self.joined(list(code), codes, np.cumsum([0, *map(len, parts)]))

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lists of ids of texts without nulls, and whether sentencepiece gives the same."""
        if not self.plan.separable:
            given = texts.to_pylist()
            got = [e.ids for e in self.whole.encode_batch_fast(given, add_special_tokens=False)]
            said = self.reference.encode(given, num_threads=1)
            for i, (a, b) in enumerate(zip(got, said)):
                if a != b and self.unigram:
                    got[i] = self.unigram.encode(self.whole.normalizer.normalize_str(given[i]))
            return pa.array(got, pa.list_(pa.int32())), np.array([a == b for a, b in zip(got, said)], bool)
        if not self.plan.verbatim:
            return self.stretched(texts.to_pylist())
        odd = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        for text in ("  ", MARK, *[" \n"] * self.plan.by_line):
            odd = pc.or_(odd, pc.match_substring(texts, text))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.spaced(texts)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        parts = [self.spaced(texts.filter(pa.array(~odd))), self.stretched(texts.filter(pa.array(odd)).to_pylist())]
        back = np.argsort(order)
        return pa.concat_arrays([x for x, _ in parts]).take(pa.array(back)), np.concatenate([x for _, x in parts])[back]


class Decoder:
    """Ids back to text: piece bytes joined, markers as spaces, byte pieces as their bytes."""

    def __init__(self, plan: Plan):
        self.pieces, self.prefix = pa.array(plan.pieces, pa.binary()), plan.dummy_prefix

    def data(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids."""
        found, ends = self.pieces.take(lists.flatten()), lists.offsets.to_numpy()
        _, at, data = found.buffers()
        at = np.frombuffer(at, np.int32, len(found) + 1) if len(found) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(at[ends - ends[0]])), data])

    def text(self, data: bytes) -> str:
        return (data.removeprefix(b" ") if self.prefix else data).decode("utf-8", "replace")

    def texts(self, lists: pa.Array) -> list[str]:
        return list(map(self.text, self.data(lists).to_pylist()))

    def gives(self, lists: pa.Array, texts: pa.Array) -> np.ndarray:
        """Whether each list decodes to its text: equal bytes, or else (stray bytes, other prefixes) equal text."""
        data, wanted = self.data(lists), texts.cast(pa.binary())
        if self.prefix:
            wanted = pc.binary_join_element_wise(b"", wanted, b" ")
        same = pc.equal(data, wanted).to_numpy(zero_copy_only=False).copy()
        for k in np.flatnonzero(~same):
            same[k] = self.text(data[k].as_py()) == texts[k].as_py()
        return same


def encode(docs: DataFrame, model_data: bytes, text_col: str = "text", check_decoding: bool = False) -> DataFrame:
    """Adds ids (array<int>) and parity (the sentencepiece library gives the same ids) to docs;
    with check_decoding also decodes: whether the ids decode to the text.

    A null text has null ids and null parity; an empty one has no ids. Columns of docs named
    ids, parity or decodes are replaced. Of pieces that could be merged with one score the first in the text is, and of unigram
    segmentations that tie the one that the library takes. The model is a file of bounded size; the driver rebuilds it once
    and it goes to the executors with the code.
    """
    docs = docs.drop("ids", "parity", "decodes")
    names, plan = docs.columns, Plan.of(Model(model_data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a task's own threads; more would only contend with other tasks
        coder, decoder = Encoder(plan), Decoder(plan)
        for batch in batches:
            for part in slices(batch, text_col):
                missing = pc.is_null(part[text_col])
                texts = pc.fill_null(part[text_col], "")
                ids, same = coder.encode(texts)
                added = [ids, pa.array(same)] + ([pa.array(decoder.gives(ids, texts))] if check_decoding else [])
                if missing.true_count:
                    added = [pc.if_else(missing, pa.scalar(None, x.type), x) for x in added]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *added], [*names, "ids", "parity", "decodes"][: len(names) + len(added)])

    return docs.mapInArrow(run, with_fields(docs.schema, "ids array<int>, parity boolean" + ", decodes boolean" * check_decoding))


def decode(coded: DataFrame, model_data: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of an id array; null for null ids. A column of that name is replaced."""
    coded = coded.drop(out_col)
    names, plan = coded.columns, Plan.of(Model(model_data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(plan)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part[ids_col]
                made = pc.if_else(pc.is_null(ids), None, pa.array(decoder.texts(ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), made], [*names, out_col])

    return coded.mapInArrow(run, with_fields(coded.schema, f"`{out_col}` string"))


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def coded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, parity, decodes of every row; a null text has 0 tokens and nulls."""
    out = encode(docs.select("doc_id", "text"), model_bytes(path), check_decoding=True)
    return out.select("doc_id", F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "parity", "decodes")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the supplied model. Repeated rows are encoded alike; an empty table gives no rows;
    other columns are ignored; coded says what null texts give."""
    return coded(table(spark, sf_dir, "documents"))


def sentencepiece_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document that is left (repeats of the mix included), a row for each row; see coded for null texts."""
    return coded(docs)
