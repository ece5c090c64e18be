"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template and is small. Each
text streams through it once: at every token it gives the longest run that ends
there and stands in some template (the matching statistics). Maximal runs of a
minimum length are chained, in text and template order, into covered spans; a
template that is covered far enough labels the text. Phrases are templates too
and are reported at every place where they stand whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_texts import PHRASES, TEMPLATES

#: Upper case to lower, all other ASCII characters but digits and letters to spaces; bytes of other characters stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(data: bytes) -> list[bytes]:
    return data.translate(_BYTES).split()


class Automaton:
    """Suffix automaton of several token sequences; a state knows every end of its run in each template that has it."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.texts = [tokens(text.encode()) for _, text in templates]
        self.phrases = [(tokens(text.encode()), label) for text, label in phrases]
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        sequences = [*self.texts, *(p for p, _ in self.phrases)]
        for k, seq in enumerate(sequences):
            last = 0
            for at, token in enumerate(seq):
                last = self._add(last, token)
                if k < len(self.texts):
                    self.ends[last].setdefault(k, set()).add(at)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for k, at in self.ends[state].items():
                self.ends[self.link[state]].setdefault(k, set()).update(at)
        self.closing: dict[bytes, list[int]] = {}
        for i, (p, _) in enumerate(self.phrases):
            self.closing.setdefault(p[-1], []).append(i)
        self.vocabulary = frozenset(t for seq in sequences for t in seq)

    def _state(self, length: int, step: dict, link: int, ends: dict) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.length) - 1

    def _split(self, p: int, token: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q], {})
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, token: bytes) -> int:
        q = self.step[last].get(token)
        if q is not None:  # a run that an earlier sequence has too
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0, {}), last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def scan(self, text: list[bytes], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of whole phrases (start, phrase) and maximal runs (start, length, state) of at least `least` tokens."""
        places, runs = [], []
        state = length = 0
        known, step = self.vocabulary, self.step
        previous = -1
        for i in [i for i, t in enumerate(text) if t in known]:
            if i != previous + 1 and length:
                if length >= least:
                    runs.append((previous - length + 1, length, state))
                state = length = 0
            previous, token = i, text[i]
            if token not in step[state] and length >= least:
                runs.append((i - length, length, state))
            while token not in step[state]:
                state = self.link[state]
                length = self.length[state]
            state, length = step[state][token], length + 1
            for k in self.closing.get(token, ()):
                phrase = self.phrases[k][0]
                if length >= len(phrase) and text[i - len(phrase) + 1 : i + 1] == phrase:
                    places.append((i - len(phrase) + 1, k))
        if length >= least:
            runs.append((previous - length + 1, length, state))
        return places, runs

    def spans(self, runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
        """Chains runs of one template that follow each other in text and template, at most gap tokens apart in the text:
        (template, first token, last token, template tokens covered). Of a stretch of such runs the chain that covers most; then those after it."""
        by_template: dict[int, list[tuple[int, int, set[int]]]] = {}
        for start, length, state in runs:
            for k, ends in self.ends[state].items():
                by_template.setdefault(k, []).append((start, start + length - 1, ends))
        done = []
        for k, own in by_template.items():
            starts = [start for start, _, _ in own]
            at = 0
            while at < len(own):
                stop = at + 1
                while stop < len(own) and own[stop][0] <= own[stop - 1][1] + gap:
                    stop += 1
                covered, first, last = best_chain(own[at:stop], gap)
                done.append((k, first, last, covered))
                at = max(at + 1, bisect_left(starts, last + 1, at, stop))
        return done


def best_chain(runs: list[tuple[int, int, set[int]]], gap: int) -> tuple[int, int, int]:
    """runs: (first, last token, ends in the template) by first token. Covered template tokens, first and last token of the best chain.

    A run follows an earlier one that ends before it in text and template and at most gap tokens before it starts;
    what two runs share in text or template counts once.
    """
    best: list[tuple[int, int, int]] = []
    reached: list[list[tuple[int, int, int]]] = []  # of each run: (end in the template, covered, first token)
    for i, (first, last, ends) in enumerate(runs):
        mine = []
        for end in sorted(ends):
            top = (last - first + 1, first)
            for j in range(i - 1, -1, -1):
                if runs[j][1] + gap < first:
                    break
                for end_j, covered, first_j in reached[j]:
                    if end_j < end:
                        top = max(top, (covered + min(last - first + 1, end - end_j, last - runs[j][1]), first_j), key=lambda x: (x[0], -x[1]))
            mine.append((end, *top))
            best.append((top[0], top[1], last))
        reached.append(mine)
    return max(best, key=lambda x: (x[0], -x[1], -x[2]))


def scan_licenses(docs: DataFrame, templates=None, phrases=None, least_run: int = 4, gap: int = 12, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (start, label) of phrases, spans (label, first, last, coverage) of templates covered far enough, score.

    A run counts for the templates that hold all of it, so a text that holds a longer template whole is not
    labelled by a shorter one inside that. A null or empty text has no words and no finds. Texts of any length stream
    through once; repeated rows are scanned alike; of chains that cover as much, the
    first in the text is reported; an empty table gives no rows; other columns are ignored.
    """
    machine = Automaton(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
        for b in batches:
            n, found, spans, score = [], [], [], []
            for data in b[text_col].cast(pa.binary()).to_pylist():
                text = tokens(data) if data else []
                places, runs = machine.scan(text, least_run)
                covered = [(machine.labels[k], a, z, min(1.0, c / len(machine.texts[k]))) for k, a, z, c in machine.spans(runs, gap)]
                n.append(len(text))
                found.append([{"start": s, "label": machine.phrases[k][1]} for s, k in places])
                spans.append([{"label": x[0], "first": x[1], "last": x[2], "coverage": x[3]} for x in sorted(covered, key=lambda x: x[1:3]) if x[3] >= coverage])
                score.append(1.0 if places else max((x[3] for x in covered), default=0.0))
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(n, pa.int64()), pa.array(found, place), pa.array(spans, span), pa.array(score, pa.float64())], [id_col, "n_words", "places", "spans", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_words long, places array<struct<start: long, label: string>>, spans array<struct<label: string, first: long, last: long, coverage: double>>, score double")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Scans every document for the phrases and templates of license_texts; scan_licenses says what odd rows give."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    base = F.col("places.label")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base, F.col("spans.label")).alias("labels"),
        "score",
    )
