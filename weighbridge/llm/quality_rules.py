"""Quality rules: text statistics and a learned decision list, all as column expressions.

The list comes from sequential covering: a rule for the rejected class grows
literal by literal (FOIL gain on two thirds of the labelled rows), is pruned on
the other third, and the rows it covers are removed before the next rule. Every
search step is one aggregate over the labelled statistics; the driver only sees
(feature, bin) counts. The result is an ordered list of threshold conjunctions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, hashed_share, table, written

FEATURES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "mark_ratio": "n_marks / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
}
# Words in 3-word windows found twice or more: sort the window digests with
# their places, keep places whose digest has an equal neighbour, sort those by
# the words themselves and keep what is equal again; then add up how many words
# each such window covers beyond the next one. Digests only spare comparisons.
_TWICE = "filter({0}, (x, k) -> x.h <=> get({0}, k - 1).h or x.h <=> get({0}, k + 1).h)"
_WINDOW = "array_join(slice(o.words, x.i + 1, 3), ' ')"
_COVERED = f"""
aggregate(
  transform(array(array_sort(transform({_TWICE.format('t')}, x -> x.i))),
    p -> aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)),
  0L, (a, x) -> a + x)"""
_REPEATED = f"""
transform(array(of_words), o -> transform(array(o.windows), h ->
  if(size(array_distinct(h)) = size(h), 0L,
     transform(array(sort_array(transform(h, (x, k) -> struct(x as h, k as i)))), s ->
       transform(array(sort_array(transform({_TWICE.format('s')}, x -> struct({_WINDOW} as h, x.i as i)))), t -> {_COVERED})[0])[0]))[0])[0]"""
DIGEST = "xxhash64(x, get(w, k + 1), get(w, k + 2))"
# Everything that needs the words takes them as one lambda argument, so the text
# is split once however the optimiser merges projections.
_OF_WORDS = """
transform(array(regexp_extract_all(_t, r'{word}', 0)), w -> named_struct(
  'n_words', cast(size(w) as bigint),
  'word_chars', cast(length(array_join(w, '')) as bigint),
  'n_distinct', cast(size(array_distinct(w)) as bigint),
  'words', w,
  'windows', transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, k) -> {digest})))[0]"""
_OF_LINES = f"""
transform(array(filter(split(_t, '\n'), x -> x rlike r'[^{SPACE}]')), l -> named_struct(
  'n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint)))[0]"""


def only(text: Column, kept: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", digest: str = DIGEST) -> DataFrame:
    """Adds the statistics of every whole text; a null text has none (all counts 0). digest (of window k, whose first word is x) affects cost only."""
    df = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("of_words", F.expr(_OF_WORDS.format(word=WORD, digest=digest))).withColumn("of_lines", F.expr(_OF_LINES))
    return df.select(
        *docs.columns,
        "of_words.n_words",
        "of_words.word_chars",
        only(F.col("_t"), r"#*$%&|<>").alias("n_symbols"),
        "of_lines.n_lines",
        "of_lines.n_dup_lines",
        F.expr(_REPEATED).alias("n_repeat_words"),
        only(F.col("_t"), "A-Z").alias("n_upper"),
        only(F.col("_t"), "!?").alias("n_marks"),
        "of_words.n_distinct",
    )


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def text(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut!r}"


def tightest(literals: list[Literal]) -> tuple[Literal, ...]:
    """Of literals on one side of one feature only the tightest is needed."""
    last: dict[tuple[str, bool], Literal] = {}
    for x in literals:
        old = last.get((x.feature, x.above))
        if old is None or (x.cut > old.cut) == x.above:
            last[x.feature, x.above] = x
    return tuple(last.values())


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]

    def text(self) -> str:
        return " and ".join(x.text() for x in self.literals) or "true"


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(v).cast("double") for k, v in FEATURES.items()})


def cut_points(rows: DataFrame, n_cuts: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature over all rows and over the rejected ones."""
    at = [i / n_cuts for i in range(n_cuts)]
    got = rows.agg(*[F.percentile_approx(F.when(c, F.col(f)) if c is not None else F.col(f), at, 10000).alias(f"{f}_{k}") for f in FEATURES for k, c in (("all", None), ("bad", F.col("bad") == 1))]).first()
    return {f: sorted({x for k in ("all", "bad") for x in got[f"{f}_{k}"] or ()}) for f in FEATURES}


def counts_by_bin(rows: DataFrame, cuts: dict[str, list[float]]) -> dict:
    """(feature, bin) -> [bad grown, good grown, bad pruned, good pruned]: one aggregate, whatever the rows."""
    stacked = ", ".join(f"'{f}', size(filter(array({', '.join(f'{x!r}D' for x in cs) or 'cast(null as double)'}), c -> {f} > c))" for f, cs in cuts.items())
    binned = rows.select("bad", "grow", F.expr(f"stack({len(cuts)}, {stacked}) as (feature, bin)"))
    got = binned.groupBy("feature", "bin").agg(*[F.sum(F.when((F.col("bad") == b) & (F.col("grow") == g), 1).otherwise(0)).alias(f"c{g}{b}") for g in (1, 0) for b in (1, 0)]).collect()
    return {(r["feature"], r["bin"]): [r["c11"], r["c10"], r["c01"], r["c00"]] for r in got}


def best_literal(found: dict, cuts: dict[str, list[float]]) -> tuple[float, Literal, list[int]] | None:
    """The literal of the largest FOIL gain, with the four counts that it leaves."""
    best = None
    for f, cs in cuts.items():
        bins = [found.get((f, k), [0] * 4) for k in range(len(cs) + 1)]
        total = [sum(b[j] for b in bins) for j in range(4)]
        below = [0] * 4
        for k, cut in enumerate(cs):
            below = [a + b for a, b in zip(below, bins[k])]
            for above, left in ((True, [t - b for t, b in zip(total, below)]), (False, list(below))):
                if not left[0] or not total[0]:
                    continue
                gain = left[0] * (math.log2(left[0] / (left[0] + left[1])) - math.log2(total[0] / (total[0] + total[1])))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, Literal(f, above, cut), left
    return best


def learn(rows: DataFrame, max_rules: int = 8, max_literals: int = 3, n_cuts: int = 24, least_bad: int = 5, precision: float = 0.95) -> list[Rule]:
    """rows: features, bad (0/1), grow (0/1). Rules in the order in which they apply.

    A rule is accepted on the pruning rows alone: least_bad rejected ones among those it covers, and the precision.
    """
    cuts, rules, left = cut_points(rows, n_cuts), [], rows
    while len(rules) < max_rules:
        literals, steps, covered = [], [], left
        while len(literals) < max_literals:
            best = best_literal(counts_by_bin(covered, cuts), cuts)
            if best is None:
                break
            literals.append(best[1])
            steps.append(best[2])
            covered = covered.filter(best[1].text())
            if not best[2][1]:
                break
        if not literals:
            break
        worth = [(bad - good) / (bad + good) if bad + good else -1.0 for _, _, bad, good in steps]
        keep = max(range(len(steps)), key=lambda k: (worth[k], -k)) + 1  # prune to the best prefix
        bad, good = steps[keep - 1][2:]
        if bad < least_bad or bad / (bad + good) < precision:
            break
        rules.append(Rule(tightest(literals[:keep])))
        left = left.filter(f"not ({rules[-1].text()})")
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Statistics of a bounded sample of labelled documents (by hash of the id); about sample_rows rows."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.lit(1) - F.min("quality")).alias("bad"))
    known = known.filter(hashed_share("doc_id", 11, sample_rows / max(1, known.count())))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    out = with_features(statistics(rows)).withColumn("grow", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(3)) > 0).cast("int"))
    return written(out.select("bad", "grow", *FEATURES), "quality-train")


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds statistics, base_failed, rule (the first that fits, else null) and kept to every row of docs.

    A null or empty text has no word and fails the base rule. Columns of docs
    that share a name with an added one are replaced.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "of_words", "of_lines", "_t", "base_failed", "rule", "kept", *FEATURES}
    df = with_features(statistics(docs.drop(*(added & set(docs.columns)))))
    verdict: Column = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.expr(rule.text()), F.lit(rule.text())).otherwise(verdict)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("rule", verdict).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def learned(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    return learn(labelled_statistics(docs, labels))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Judges every document by the rules learned from the labelled ones. Null and empty texts fail the base rule; repeated rows
    are judged alike; without labels there are no rules; an empty table gives no rows; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs.select("doc_id", "text"), learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go, null and empty texts with them. All columns of docs come back, whatever
    their names; repeated rows stay or go together; an empty table gives no rows."""
    rules = learned(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs.select(F.struct("*").alias("__doc"), "text"), rules).filter("kept").select("__doc.*")
