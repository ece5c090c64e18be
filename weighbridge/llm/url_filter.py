"""URL filters: host/path rules first, gradient-boosted trees on lexical features for the rest.

The trees are grown level by level with DataFrame aggregates: one job sums the
gradients and curvatures of every (leaf, feature, bin), the driver picks the
splits, and the trees become nested conditional expressions. Training rows are
a bounded sample of labelled URLs; every URL is judged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hashed_share, table, written

#: host/path prefix -> verdict; the longest fitting rule wins.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "has_fragment", "last_segment_length", "suffix_rate", "suffix_share"]
_ENTROPY = """
if(length(_u) = 0, 0D, aggregate(
  transform(array_distinct(split(_u, '')), c -> cast(length(_u) - length(replace(_u, c, '')) as double) / length(_u)),
  0D, (a, p) -> a - if(p > 0, p * log2(p), 0D)))"""


def parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path; both empty for a null url or one without '://'."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return urls.withColumn("host", ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def ruled(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds rule (the longest that fits host, subdomains and path start; else null)."""
    found: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return df.withColumn("rule", found)


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the lexical features that need no training data."""
    df = df.withColumn("_u", F.coalesce(F.col(url_col), F.lit("")))
    n = F.greatest(F.length("_u"), F.lit(1))
    after = F.expr("if(instr(_u, '?') > 0, substring(_u, instr(_u, '?') + 1), '')")
    return df.withColumns({
        "url_length": F.length("_u").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace("_u", "[^0-9]+", "")) / n,
        "hyphens": F.length(F.regexp_replace("host", "[^-]+", "")).cast("double"),
        "entropy": F.expr(_ENTROPY),
        "parameters": F.when(F.length(after) > 0, F.size(F.split(after, "&"))).otherwise(0).cast("double"),
        "query_length": F.length(after).cast("double"),
        "has_fragment": F.contains("_u", F.lit("#")).cast("double"),
        "last_segment_length": F.length(F.regexp_extract("path", "([^/]*)/?$", 1)).cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1),
    })


@dataclass
class Tree:
    """Nodes by id: (feature, cut, left, right) or a leaf value; 'x <= cut' goes left."""

    split: dict[int, tuple[str, float]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def column(self, at_leaf, left=lambda f, cut: F.col(f) <= F.lit(cut), node: int = 1) -> Column:
        """at_leaf(leaf) of the leaf that a row falls into; left(feature, cut) says whether it goes left."""
        if node not in self.split:
            return F.lit(at_leaf(node))
        return F.when(left(*self.split[node]), self.column(at_leaf, left, 2 * node)).otherwise(self.column(at_leaf, left, 2 * node + 1))

    def value_column(self, *left) -> Column:
        return self.column(lambda leaf: self.value.get(leaf, 0.0), *left)


@dataclass
class Boosted:
    prior: float
    rate: float
    trees: list[Tree]
    suffixes: DataFrame | None = None
    base_rate: float = 0.5

    def probability(self, *left) -> Column:
        score: Column = F.lit(self.prior)
        for t in self.trees:
            score = score + F.lit(self.rate) * t.value_column(*left)
        return 1 / (1 + F.exp(-score))


def with_suffix(df: DataFrame, model: Boosted) -> DataFrame:
    """Joins the suffix statistics; their table is bounded by the training sample and broadcast."""
    rate, share = F.lit(model.base_rate), F.lit(0.0)
    if model.suffixes is not None:
        df = df.join(F.broadcast(model.suffixes), "suffix", "left")
        rate, share = F.coalesce("suffix_rate", rate), F.coalesce("suffix_share", share)
    return df.withColumns({"suffix_rate": rate, "suffix_share": share})


def out_of_fold(rows: DataFrame, base: float, smooth: float, folds: int = 5) -> DataFrame:
    """Adds to the training rows their suffix's smoothed share of blocked rows and its share of all rows, both without the row's own hash fold."""
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("key", "url", F.lit(22)), F.lit(folds)))
    by_fold = rows.groupBy("suffix", "_fold").agg(F.sum("label").alias("_s"), F.count("label").alias("_k"))
    whole = by_fold.groupBy("suffix").agg(F.sum("_s").alias("_all_s"), F.sum("_k").alias("_all_k"))
    n = rows.groupBy("_fold").agg(F.count("label").alias("_n")).withColumn("_others", F.lit(rows.count()) - F.col("_n")).drop("_n")
    seen = (F.col("_all_k") - F.col("_k")).cast("double")
    rate = (F.col("_all_s") - F.col("_s") + smooth * base) / (seen + smooth)
    rest = by_fold.join(whole, "suffix").join(F.broadcast(n), "_fold").select("suffix", "_fold", rate.alias("suffix_rate"), F.coalesce(F.try_divide(seen, F.col("_others")), F.lit(0.0)).alias("suffix_share"))  # n: a row a fold
    return rows.join(rest, ["suffix", "_fold"]).drop("_fold")


def boost(rows: DataFrame, n_trees: int = 10, depth: int = 3, rate: float = 0.4, n_bins: int = 16, ridge: float = 1.0, base_rate: float = 0.5) -> tuple[float, list[Tree]]:
    """Newton boosting of the log-loss; rows: FEATURES and label (0/1)."""
    at = [(i + 1) / n_bins for i in range(n_bins - 1)]
    got = rows.agg(*[F.percentile_approx(f, at, 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(got[f] or ())) for f in FEATURES}
    used = [f for f in FEATURES if cuts[f]]
    bins = [F.expr(f"size(filter(array({', '.join(f'{x!r}D' for x in cuts[f])}), c -> {f} > c))") for f in used]
    binned = written(rows.select("label", F.array(*bins).alias("bins")), "url-bins") if used else rows
    left = lambda f, cut: F.col("bins")[used.index(f)] <= cuts[f].index(cut)
    prior = math.log(max(base_rate, 1e-6) / max(1 - base_rate, 1e-6))
    trees: list[Tree] = []
    for _ in range(n_trees if used else 0):
        p = Boosted(prior, rate, trees).probability(left)
        tree = Tree()
        for level in range(depth):
            open_nodes = range(2**level, 2 ** (level + 1))
            g, h = (F.col("label") - F.col("p")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h")
            at = binned.select("bins", "label", p.alias("p"), tree.column(int, left).alias("node")).select(g, h, "node", F.posexplode("bins").alias("feature", "bin"))
            sums = at.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by: dict = {}
            for r in sums:
                by.setdefault(r["node"], {}).setdefault(used[r["feature"]], {})[r["bin"]] = (r["g"], r["h"])
            for node in (n for n in open_nodes if n in by):
                best, whole = None, None
                for f in sorted(by[node]):
                    bins = by[node][f]
                    G, H = (math.fsum(v[j] for v in bins.values()) for j in (0, 1))
                    whole, gl, hl = (G, H), 0.0, 0.0
                    for k, cut in enumerate(cuts[f]):
                        gl, hl = gl + bins.get(k, (0, 0))[0], hl + bins.get(k, (0, 0))[1]
                        if hl < 0.5 or H - hl < 0.5:
                            continue
                        gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, cut, (gl, hl), (G - gl, H - hl)
                if best is None:
                    tree.value[node] = whole[0] / (whole[1] + ridge)
                else:
                    tree.split[node] = best[1:3]
                    tree.value[2 * node], tree.value[2 * node + 1] = (g / (h + ridge) for g, h in best[3:])
        if not tree.split:
            break
        trees.append(tree)
    return prior, trees


def train(labelled: DataFrame, sample_rows: int = 20_000, rate: float = 0.4, smooth: float = 4.0) -> Boosted:
    """labelled: host, path, lexical features, key, url, label (1: block). Fits on about sample_rows of them, by hash."""
    rows = written(labelled.filter(hashed_share("key", 21, sample_rows / max(1, labelled.count()))), "url-train")
    base, n_rows = rows.agg(F.avg("label"), F.count("label")).first()
    if base is None:
        return Boosted(0.0, rate, [])
    model = Boosted(0.0, rate, [], base_rate=base)
    model.suffixes = rows.groupBy("suffix").agg(((F.sum("label") + smooth * base) / (F.count("label") + smooth)).alias("suffix_rate"), (F.count("label") / F.lit(float(n_rows))).alias("suffix_share"))
    fit = written(out_of_fold(rows, base, smooth).select("label", *FEATURES), "url-fit")
    model.prior, model.trees = boost(fit, rate=rate, base_rate=base)
    return model


def url_filter(urls: DataFrame, rules: dict[str, str], url_col: str = "url", key_col: str = "page_id", threshold: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """key, host, path, rule, verdict and probability of every url.

    A URL that a rule fits gets that rule's verdict and is a labelled URL for
    the trees; all others are blocked at a probability of threshold or more.
    Null urls and urls without '://' have empty parts and are judged by the
    trees; repeated rows are judged alike; with no labelled URL all are allowed.
    """
    df = urls.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"))
    df = lexical(ruled(parts(df), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    df = df.withColumn("by_rule", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]))
    labelled = df.filter("rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("int"))
    model = train(labelled, sample_rows)
    scored = with_suffix(df, model).withColumn("probability", model.probability() if model.trees else F.lit(0.0))
    verdict = F.coalesce("by_rule", F.when(F.col("probability") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("key").alias(key_col), "host", "path", "rule", verdict.alias("verdict"), "probability")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judges every page's url by RULES, else by the trees fitted to the urls that a rule judges.

    Long urls are taken whole; repeated pages are judged alike; an empty table gives no rows; other columns of pages are ignored.
    """
    return url_filter(table(spark, sf_dir, "pages"), RULES)
