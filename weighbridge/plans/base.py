"""The event stream in the roles of the operators, and the same tables as SQL.

entity = user_id; intime = first event; 24 bins of one day; landmark after 24
days; signal = event_type, value = value; outcome y = an error above 100 at or
after the landmark; state intervention = purchases above 60 carried forward at
most 2 days; event intervention = signup amounts; view values are masked from a
state's onset, click values while it is active.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import r6, uniform
from ..operators import cohort, features, lattice, signals
from ..sources.tables import scan, scan_once, shared_path, spec_table

DAY, BINS, HALF, SPAN = 86_400, 24, 12, 6
SIGNALS = ["click", "error", "purchase", "signup", "view"]
RANGES = [(s, 20.0 + 2 * i, 90.0 + 5 * i) for i, s in enumerate(SIGNALS)]
BOUNDS = [(s, 0.05, 400.0) for s in SIGNALS]
MASKS = [("view", "pressor", "onset"), ("click", "pressor", "concurrent")]
DOMAINS = [("click", "browse"), ("view", "browse"), ("purchase", "trade"), ("signup", "trade")]
FOLDS = 3


def events(spark, d) -> DataFrame:
    return scan(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def people(spark, d, r=None) -> DataFrame:
    """user_id, intime, landmark, last_ts, event_at, y, fold, site. Here and below, r: raw(), if the caller has it."""
    late = (F.col("signal") == "error") & (F.col("value") > 100) & (F.col("bin") >= BINS)  # at or after the landmark
    c = (raw(spark, d) if r is None else r).groupBy("user_id").agg(F.first("intime").alias("intime"), F.max("ts").alias("last_ts"), F.min(F.when(late, F.col("ts"))).alias("event_at"))
    c = cohort.landmark(c, BINS).select("user_id", "intime", "last_ts", "landmark", "event_at")
    fold = F.floor(uniform(F.lit(5), F.col("user_id")) * FOLDS).cast("int") + 1
    return c.withColumns({"y": F.col("event_at").isNotNull().cast("int"), "fold": fold, "site": F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")})


def raw(spark, d) -> DataFrame:
    """user_id, signal, value, bin, ts of events with their bin."""
    e = events(spark, d)
    return e.join(e.groupBy("user_id").agg(F.min("ts").alias("intime")), "user_id").select("user_id", F.col("event_type").alias("signal"), "value", lattice.bin_of(F.col("ts"), F.col("intime"), DAY).alias("bin"), "ts", "intime")


def bounds(spark) -> DataFrame:
    return spec_table(spark, BOUNDS, "signal string, low double, high double")


def ranges(spark) -> DataFrame:
    return spec_table(spark, RANGES, "signal string, ref_low double, ref_high double")


def domains(spark) -> DataFrame:
    return spec_table(spark, DOMAINS, "signal string, domain string")


def binned(spark, d, r=None) -> DataFrame:
    return signals.binned(signals.within_bounds(raw(spark, d) if r is None else r, bounds(spark)), "user_id", BINS)


def pressor_bins(spark, d, r=None) -> DataFrame:
    """Bins in which the state intervention is active: user_id, bin, intensity, intervention."""
    r = (raw(spark, d) if r is None else r).filter("signal = 'purchase' and value > 60 and bin between 0 and 23")
    points = lattice.distinct_points(r, ["user_id", "intime", "ts"], "value")
    spans = lattice.carried_forward(points, ["user_id"], "ts", 2 * DAY)
    bins = lattice.covered_bins(spans, "intime", DAY, BINS)
    return lattice.state_lattice(bins, ["user_id", "bin"], "value").withColumn("intervention", F.lit("pressor"))


def signup_bins(spark, d, r=None) -> DataFrame:
    r = (raw(spark, d) if r is None else r).filter("signal = 'signup' and bin between 0 and 23")
    return lattice.event_lattice(r, ["user_id", "bin"], "value").withColumn("intervention", F.lit("intake"))


@dataclass(frozen=True)
class Stream:
    """Tables of the event stream, each written once."""

    people: DataFrame
    binned: DataFrame
    pressor: DataFrame
    signups: DataFrame
    masked: DataFrame


def stream(spark, d) -> Stream:
    """For queries that read these tables many times: one plan each instead of a single one that reads the events ten times, which costs the driver's memory."""
    once = lambda df, name: scan_once(df, out(spark, name))
    r = once(raw(spark, d), "stream-raw")
    b, a = once(binned(spark, d, r), "stream-binned"), once(pressor_bins(spark, d, r), "stream-pressor")
    return Stream(once(people(spark, d, r), "stream-people"), b, a, once(signup_bins(spark, d, r), "stream-signups"), once(_masked(spark, b, a), "stream-masked"))


def _masked(spark, lattice, active) -> DataFrame:
    return features.masked_bins(lattice, active, spec_table(spark, MASKS, "signal string, intervention string, mode string"), "user_id")


def masked(spark, d) -> DataFrame:
    return _masked(spark, binned(spark, d), pressor_bins(spark, d))


def feature_grid(spark, d, s: Stream | None = None) -> DataFrame:
    """s: the stream's tables, if they are written."""
    p, b, m = (s.people, s.binned, s.masked) if s else (people(spark, d), binned(spark, d), masked(spark, d))
    grid = features.signal_features(p, ranges(spark), features.surviving(b, m, "user_id"), m, "user_id", BINS, HALF, SPAN)
    return grid.withColumn("within_ss", F.round("within_ss", 1) + F.lit(0.0))  # large sums: fewer places are the same everywhere


def evidence(spark, d) -> DataFrame:
    """A fixed additive evidence table: user_id, signal, ord, l (rounded so that rank ties are the same everywhere)."""
    g = feature_grid(spark, d).filter("n_obs > 0")
    ordinal = F.expr("array_position(array(" + ", ".join(f"'{s}'" for s in SIGNALS) + "), signal)").cast("long")
    l = F.round((F.col("k_high") - F.col("k_low")) / F.col("n_obs") + F.col("trend") / 100.0, 4)
    return g.select("user_id", "signal", ordinal.alias("ord"), (l + F.lit(0.0)).alias("l"))


def scores(spark, d) -> DataFrame:
    """user_id, score (sum of evidence), y, fold, site."""
    s = evidence(spark, d).groupBy("user_id").agg((F.round(F.sum("l"), 4) + F.lit(0.0)).alias("score"))
    return s.join(people(spark, d).select("user_id", "y", "fold", "site"), "user_id")


def doc_scores(spark, d) -> DataFrame:
    """Labelled documents: score = n_chars, score2 = characters of the source name and language mix, y = quality, grp = source."""
    docs, labels = scan(spark, d, "documents").select("doc_id", "n_chars", "source", "lang"), scan(spark, d, "labels").select("doc_id", "quality")
    return labels.join(docs, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") % 97).cast("double").alias("score2"), F.col("quality").cast("int").alias("y"), F.col("source").alias("grp"), "lang")


def vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two attribution sets: the halves of all 64 embedding places, by vec_id."""
    e = scan(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    e = e.withColumn("a", F.round(F.col("v").cast("double"), 4) + F.lit(0.0))
    cut = lambda lo: e.filter(F.col("pos").between(lo, lo + 31)).select("vec_id", "label", F.format_string("s%02d", F.col("pos") - lo).alias("signal"), (F.col("pos") - lo).cast("long").alias("ord"), "a")
    return cut(0), cut(32)


def out(spark, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_path(spark, name)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers to bigint, so that engines agree on values and types."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((r6(c) if kind in ("double", "float") else c.cast("bigint") if kind in ("int", "smallint") or kind.startswith("decimal") else c).alias(f.name))
    return df.select(*out)


# The same tables as SQL text.
def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


UNIFORM = "(('0x' || substr(md5({}), 1, 8))::UBIGINT / 4294967296.0)"
PEOPLE = f"""
c0 AS (SELECT user_id, min(ts) AS intime, max(ts) AS last_ts, min(ts) + INTERVAL 24 DAY AS landmark FROM events GROUP BY 1),
ev AS (SELECT e.user_id, min(e.ts) AS event_at FROM events e JOIN c0 USING (user_id) WHERE event_type = 'error' AND value > 100 AND e.ts >= landmark GROUP BY 1),
people AS (SELECT c0.*, event_at, (event_at IS NOT NULL)::INT AS y, floor({UNIFORM.format("concat_ws('|', 5, user_id)")} * {FOLDS})::INT + 1 AS fold,
  CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS site FROM c0 LEFT JOIN ev USING (user_id))"""
RAW = PEOPLE + f""",
raw AS (SELECT e.user_id, event_type AS signal, value, floor(epoch_us(ts - intime) / 86400e6)::INT AS bin, ts, intime FROM events e JOIN people USING (user_id)),
bounds(signal, low, high) AS (VALUES {_values(BOUNDS)}),
ranges(signal, ref_low, ref_high) AS (VALUES {_values(RANGES)}),
domains(signal, domain) AS (VALUES {_values(DOMAINS)}),
hourly AS (SELECT user_id, signal, bin, count(value) AS n_raw, min(value) AS bin_min, quantile_disc(value, 0.5) AS bin_med, max(value) AS bin_max
  FROM raw JOIN bounds USING (signal) WHERE value BETWEEN low AND high AND bin BETWEEN 0 AND 23 GROUP BY ALL)"""
ACTIVE = RAW + """,
pts AS (SELECT user_id, intime, ts, max(value) AS value FROM raw WHERE signal = 'purchase' AND value > 60 AND bin BETWEEN 0 AND 23 GROUP BY ALL),
spans AS (SELECT *, least(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), ts + INTERVAL 2 DAY), ts + INTERVAL 2 DAY) AS end_at FROM pts),
pressor AS (SELECT s.user_id, b.bin::INT AS bin, max(value) AS intensity FROM spans s, range(24) b(bin)
  WHERE s.ts < s.intime + (b.bin + 1) * INTERVAL 1 DAY AND s.end_at > s.intime + b.bin * INTERVAL 1 DAY AND s.end_at > s.ts GROUP BY ALL),
intake AS (SELECT user_id, bin, sum(value) AS intensity FROM raw WHERE signal = 'signup' AND bin BETWEEN 0 AND 23 GROUP BY ALL)"""
MASKED = ACTIVE + """,
masked AS (SELECT user_id, signal, bin FROM hourly JOIN (SELECT user_id, min(bin) AS f FROM pressor GROUP BY 1) USING (user_id) WHERE signal = 'view' AND bin >= f
  UNION SELECT user_id, signal, bin FROM hourly JOIN pressor USING (user_id, bin) WHERE signal = 'click'),
lat AS (SELECT * FROM hourly ANTI JOIN masked USING (user_id, signal, bin))"""
GRID = MASKED + """,
seen AS (SELECT user_id, signal, count(*) AS n_obs, count_if(bin_med < ref_low) AS k_low, count_if(bin_med BETWEEN ref_low AND ref_high) AS k_mid, count_if(bin_med > ref_high) AS k_high,
  quantile_disc(bin_med, 0.05) AS q05, quantile_disc(bin_med, 0.95) AS q95, quantile_disc(bin_med, 0.5) AS value_median, min(bin_min) AS value_min, max(bin_max) AS value_max,
  avg(bin_med) AS within_mean, round(var_pop(bin_med) * count(*), 1) + 0.0 AS within_ss, avg(bin_max - bin_min) AS range_mean, sum(n_raw)::BIGINT AS n_raw,
  covar_pop(bin_med, bin) AS cov, var_pop(bin) AS va, count_if(bin < 12) AS early, count_if(bin >= 12) AS late,
  min(bin) FILTER (bin_med < ref_low) AS first_low, min(bin) FILTER (bin_med > ref_high) AS first_high, min(bin) AS first_bin, max(bin) AS last_bin
  FROM lat JOIN ranges USING (signal) GROUP BY ALL),
nm AS (SELECT user_id, signal, count(*) AS n_masked FROM masked GROUP BY ALL),
g0 AS (SELECT p.user_id, r.signal, ref_low, ref_high, coalesce(n_obs, 0) AS n_obs, coalesce(k_low, 0) AS k_low, coalesce(k_mid, 0) AS k_mid, coalesce(k_high, 0) AS k_high, q05, q95, value_median,
  value_min, value_max, within_mean, within_ss, range_mean, coalesce(n_raw, 0) AS n_raw, cov, va, coalesce(early, 0) AS early, coalesce(late, 0) AS late, first_low, first_high, first_bin, last_bin,
  coalesce(n_masked, 0) AS n_masked, coalesce(last_bin - first_bin, 0) AS span,
  coalesce(n_obs >= 2 AND last_bin - first_bin >= 6 AND early >= 1 AND late >= 1, false) AS def
  FROM people p CROSS JOIN ranges r LEFT JOIN seen USING (user_id, signal) LEFT JOIN nm USING (user_id, signal)),
grid AS (SELECT * EXCLUDE (cov, va, def), CASE WHEN def THEN 24 * cov / va ELSE 0 END AS trend, def::INT AS trend_defined, (n_obs = 0)::INT AS missing FROM g0)"""
EVIDENCE = GRID + f""",
evidence AS (SELECT user_id, signal, list_position({SIGNALS!r}, signal)::BIGINT AS ord, round((k_high - k_low) / n_obs + trend / 100, 4) + 0.0 AS l FROM grid WHERE n_obs > 0),
scores AS (SELECT user_id, score, y, fold, site FROM (SELECT user_id, round(sum(l), 4) + 0.0 AS score FROM evidence GROUP BY 1) JOIN people USING (user_id))"""
DOCS = """
ds AS (SELECT l.doc_id, n_chars::DOUBLE AS score, (n_chars % 97)::DOUBLE AS score2, quality::INT AS y, source AS grp, lang FROM labels l JOIN documents d USING (doc_id))"""
VECTORS = """
vec AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings),
va AS (SELECT vec_id, label, printf('s%02d', pos) AS signal, pos::BIGINT AS ord, round(v::DOUBLE, 4) + 0.0 AS a FROM vec WHERE pos < 32),
vb AS (SELECT vec_id, label, printf('s%02d', pos - 32) AS signal, (pos - 32)::BIGINT AS ord, round(v::DOUBLE, 4) + 0.0 AS b FROM vec WHERE pos >= 32),
cells AS (SELECT va.*, b FROM va JOIN vb USING (vec_id, signal))"""


def sql(ctes: str, final: str, doubles: str = "", places: int = 6) -> str:
    """WITH ctes, the final select, and the named double columns rounded to six places."""
    names = doubles.split()
    if names:
        final = f"SELECT * REPLACE ({', '.join(f'round({n}, {places}) + 0.0 AS {n}' for n in names)}) FROM ({final})"
    return f"WITH {ctes.strip()}\n{final}" if ctes else final
