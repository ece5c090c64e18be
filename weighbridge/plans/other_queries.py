"""Queries: expressions and aggregates in one place (X), streaming lattice."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import logistic, midrank
from ..sources import tables as S
from . import base as B
from .registry import query


@query("expressions", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in (
    ("least_greatest", "least(greatest(l_discount, l_tax), 0.05)"), ("ratio", "l_extendedprice / nullif(l_tax, 0)"), ("logs", "ln(l_quantity) + ln(1 + l_discount)"),
        ("squashed", "1 / (1 + exp(-(l_quantity - 25) / 10))"))) + ", nullif(l_returnflag, 'N') AS flag, upper(trim(l_linestatus)) || '-' || lower(l_returnflag) AS label, floor(l_extendedprice / 1000)::BIGINT AS thousands FROM lineitem")
def expressions(spark, d):
    """Conditionals, strings and mathematics."""
    c = F.col
    return B.rounded(S.scan(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least(F.greatest("l_discount", "l_tax"), F.lit(0.05)).alias("least_greatest"), F.try_divide(c("l_extendedprice"), F.nullif(c("l_tax"), F.lit(0.0))).alias("ratio"),
        (F.ln("l_quantity") + F.log1p("l_discount")).alias("logs"), logistic((c("l_quantity") - 25) / 10).alias("squashed"), F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.concat(F.upper(F.trim("l_linestatus")), F.lit("-"), F.lower("l_returnflag")).alias("label"), F.floor(c("l_extendedprice") / 1000).alias("thousands")))


@query("aggregates", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count_if(l_discount > 0.05) AS discounted, " + ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in (("mean_q", "avg(l_quantity)"), ("var_q", "var_pop(l_quantity)"), ("covariance", "covar_pop(l_quantity, l_discount)"), ("correlation", "corr(l_quantity, l_extendedprice)"), ("median_price", "quantile_disc(l_extendedprice, 0.5)"))) + " FROM lineitem GROUP BY 1")
def aggregates(spark, d):
    """X7."""
    r4 = lambda c: F.round(c, 4) + F.lit(0.0)
    return S.scan(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), r4(F.avg("l_quantity")).alias("mean_q"), r4(F.var_pop("l_quantity")).alias("var_q"),
            r4(F.covar_pop("l_quantity", "l_discount")).alias("covariance"), r4(F.corr("l_quantity", "l_extendedprice")).alias("correlation"), r4(F.expr("percentile_disc(0.5) within group (order by l_extendedprice)")).alias("median_price"))


@query("windows", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, row_number() OVER w AS rn, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS dr, round(lead(l_quantity) OVER w, 6) + 0.0 AS next_q, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2 AS mid FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag)")
def windows(spark, d):
    """Ranking, lead and mid-ranks; line numbers repeat inside an order, so rows are ordered by all that tells them apart."""
    w = Window.partitionBy("l_orderkey")
    total = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]
    l = S.scan(spark, d, "lineitem").select("l_orderkey", *total)
    l = l.withColumns({
        "rn": F.row_number().over(w.orderBy(*total)),
        "dr": F.dense_rank().over(w.orderBy("l_returnflag")),
        "next_q": F.lead("l_quantity").over(w.orderBy(*total)),
    })
    return B.rounded(midrank(l, ["l_orderkey"], "l_quantity", "mid").drop("l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"))


@query("arrays", "SELECT o_custkey, (max_by({'k': o_orderkey, 's': o_orderstatus}, o_totalprice)).k AS dearest, len(list(o_orderkey))::BIGINT AS orders, date_sub('hour', min(o_orderdate), max(o_orderdate)) AS hours FROM orders GROUP BY 1")
def arrays(spark, d):
    """Structs, arrays and elapsed time."""
    o = S.scan(spark, d, "orders")
    g = o.groupBy("o_custkey").agg(F.max_by(F.struct(F.col("o_orderkey").alias("k"), "o_orderstatus"), "o_totalprice").alias("b"), F.count("o_orderkey").alias("orders"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return B.rounded(g.select("o_custkey", F.col("b.k").alias("dearest"), "orders", F.expr("timestampdiff(HOUR, lo, hi)").alias("hours")))


@query("streamed_lattice", "SELECT event_type AS signal, epoch(date_trunc('day', ts))::BIGINT AS day_s, count(*) AS n_raw, round(min(value), 6) + 0.0 AS bin_min, round(max(value), 6) + 0.0 AS bin_max FROM events GROUP BY ALL")
def streamed_lattice(spark, d):
    """The daily lattice fed by a stream of event files: watermark, tumbling window, keyed upsert per batch."""
    from ..streaming.lattice import run_once

    return B.rounded(run_once(spark, d))
