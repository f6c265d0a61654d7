"""Queries of time and order: streams in windows, as-of and interval joins, SQL text, ranking functions, dates and decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators import sketches, temporal
from quernstone.plans.registry import Tables, query
from quernstone.streaming import windows as S


def micros(c: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def stream(t: Tables) -> DataFrame:
    return S.file_stream(t.spark, t.sf_dir, "events", t.events.schema).withColumn("ts", F.timestamp_micros(micros("ts")))


def counts(t: Tables, w) -> DataFrame:
    found = S.finished(S.windowed(stream(t), "ts", w, ["event_type"], "1 day", F.count("*").alias("n"), F.sum("value").alias("total")))
    return found.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q_stream_tumbling", "SELECT (epoch(ts)::BIGINT // 3600) * 3600 AS start, (epoch(ts)::BIGINT // 3600) * 3600 + 3600 AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    return counts(t, S.tumbling("ts", "1 hour"))


@query("q_stream_sliding", "WITH e AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS s, event_type, value FROM events), w AS (SELECT (s // 1800) * 1800 - 1800 * k AS start, * FROM e, (VALUES (0), (1)) v(k)) SELECT start, start + 3600 AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def stream_sliding(t: Tables) -> DataFrame:
    return counts(t, S.sliding("ts", "1 hour", "30 minutes"))


@query("q_stream_session", "WITH e AS (SELECT user_id, epoch_us(ts) AS u FROM events), g AS (SELECT *, CASE WHEN u - lag(u) OVER w < 43200000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY u)), s AS (SELECT user_id, u, sum(new) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(u) AS start, max(u) + 43200000000 AS end, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(t: Tables) -> DataFrame:
    """Sessions of a user that twelve quiet hours end."""
    found = S.finished(S.windowed(stream(t), "ts", S.session("ts", "12 hours"), ["user_id"], "1 day", F.count("*").alias("n")))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("q_stream_append", "WITH e AS (SELECT (epoch(date_trunc('second', ts))::BIGINT // 3600) * 3600 AS start, epoch_ms(ts) AS ms, event_type, value FROM events), h AS (SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY start, event_type) SELECT * FROM h WHERE (start + 3600) * 1000 <= (SELECT max(ms) FROM e) - 86400000")
def stream_append(t: Tables) -> DataFrame:
    """Hours that can't change any more, each once: those that ended a day before the latest event."""
    found = S.finished(S.windowed(stream(t), "ts", S.tumbling("ts", "1 hour"), ["event_type"], "1 day", F.count("*").alias("n"), F.sum("value").alias("total")), "append")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q_stream_first", "SELECT user_id, event_type, count(DISTINCT (user_id, event_type)) AS n FROM events GROUP BY ALL")
def stream_first(t: Tables) -> DataFrame:
    """Kinds of events of each user, each once."""
    found = S.finished(S.first_of_each(stream(t), "ts", ["user_id", "event_type"], "365 days"), "append")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("q_stream_join", "WITH e AS (SELECT user_id, epoch_us(ts) AS u, event_id, event_type FROM events) SELECT p.event_id, s.event_id AS signup FROM e p JOIN e s ON p.user_id = s.user_id AND s.u BETWEEN p.u - 7200000000 AND p.u WHERE p.event_type = 'purchase' AND s.event_type = 'signup'")
def stream_join(t: Tables) -> DataFrame:
    """Purchases of users who signed up in the two hours before, as two streams."""
    left, right = (stream(t).where(F.col("event_type") == k).select("user_id", "ts", "event_id") for k in ("purchase", "signup"))
    return S.finished(S.within(left, right, "user_id", "ts", "2 hours", "0 hours", "1 day"), "append").select("event_id", F.col("right_event_id").alias("signup"))


@query("q_stream_state", "WITH h AS (SELECT user_id, event_id, value, row_number() OVER w AS epoch, min(value) OVER w AS best FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, lag(best) OVER (PARTITION BY user_id ORDER BY epoch) AS before FROM h), l AS (SELECT *, max(CASE WHEN before IS NULL OR value < before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS last FROM b) SELECT user_id, event_id, epoch, best, epoch - last AS waited, epoch - last >= 3 AS stopped FROM l")
def stream_state(t: Tables) -> DataFrame:
    """Early stopping as events come: state is the best value of each user and how long ago it was."""
    found = S.finished(S.best_so_far(stream(t).select("user_id", "ts", "event_id", "value"), "user_id", "ts", "value", "event_id", 3, "1 day"), "append")
    return found.select("user_id", "event_id", "epoch", "best", "waited", "stopped")


@query("q_as_of_join", "WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS last_id, value AS last_value FROM events WHERE event_type <> 'purchase'), j AS (SELECT l.event_id, l.user_id, r.last_id, r.last_value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.last_id DESC) AS k FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts) SELECT event_id, user_id, last_id, last_value FROM j WHERE k = 1")
def as_of_join(t: Tables) -> DataFrame:
    """Each purchase with what its user did last before it."""
    e = t.events
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return temporal.as_of_join(left, right, "user_id", "ts", ["last_id", "last_value"], "last_id").select("event_id", "user_id", "last_id", "last_value")


@query("q_interval_join", "WITH s AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('second', ts))::BIGINT + 7200 AS b, event_id AS span FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS moment, event_id FROM events WHERE event_type <> 'signup') SELECT p.event_id, s.span FROM p JOIN s ON p.user_id = s.user_id AND moment >= a AND moment < b")
def interval_join(t: Tables) -> DataFrame:
    """What a user did in the two hours after a sign-up."""
    e = t.events.select("user_id", F.floor(micros("ts") / 1000000).alias("at"), "event_id", "event_type")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("at").alias("a"), (F.col("at") + 7200).alias("b"), F.col("event_id").alias("span"))
    return temporal.interval_join(e.where("event_type <> 'signup'").drop("event_type"), spans, "user_id", "at", "a", "b").select("event_id", "span")


TEXT = """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 2 * avg(o_totalprice) FROM orders))
SELECT n_name AS nation, count(*) AS n, round(sum(total), 2) AS total FROM big JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
GROUP BY n_name"""


@query("q_sql_text", TEXT)
def sql_text(t: Tables) -> DataFrame:
    """SQL over views: a common table expression, scalar and correlated subqueries, HAVING. The views live in a session of their own."""
    spark = t.spark.newSession()
    for name in ("orders", "customer", "nation", "supplier"):
        spark.read.parquet(f"{t.sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(TEXT)


@query("q_rank_functions", "SELECT p_partkey, ntile(4) OVER w AS quarter, rank() OVER v AS rank, dense_rank() OVER v AS dense, round(percent_rank() OVER v, 9) AS share, round(cume_dist() OVER v, 9) AS upto, lag(p_size) OVER w AS before, lead(p_size, 2, -1) OVER w AS later, first_value(p_name) OVER w AS first FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)")
def rank_functions(t: Tables) -> DataFrame:
    part = W.partitionBy("p_brand")
    w, v = part.orderBy("p_size", "p_partkey"), part.orderBy("p_size")
    return t.part.select(
        "p_partkey", F.ntile(4).over(w).alias("quarter"), F.rank().over(v).alias("rank"), F.dense_rank().over(v).alias("dense"), F.round(F.percent_rank().over(v), 9).alias("share"), F.round(F.cume_dist().over(v), 9).alias("upto"),
        F.lag("p_size").over(w).alias("before"), F.lead("p_size", 2, -1).over(w).alias("later"), F.first("p_name").over(w).alias("first"),
    )


@query("q_dates", "SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS month, dayofyear(o_orderdate) AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS shown, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS left_, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS due, strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M') AS tokyo FROM orders")
def dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    shown = lambda c, f="yyyy-MM-dd": F.date_format(c, f)
    return t.orders.select(
        "o_orderkey", (F.year(d) * 100 + F.month(d)).alias("month"), F.dayofyear(d).alias("day"), shown(d, "yyyy-MM-dd'T'HH:mm").alias("shown"), F.date_diff(F.lit("1998-12-31").cast("date"), d.cast("date")).alias("left_"),
        shown(F.date_trunc("quarter", d)).alias("quarter"), shown(F.add_months(d.cast("date"), 1)).alias("due"), shown(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), d.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm").alias("tokyo"),
    )


@query("q_decimals", "SELECT l_returnflag AS flag, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::VARCHAR AS net, sum(l_tax::DECIMAL(4,2))::VARCHAR AS tax, max(l_quantity::DECIMAL(8,0))::BIGINT AS most FROM lineitem GROUP BY 1")
def decimals(t: Tables) -> DataFrame:
    """Exact sums of decimals."""
    price, discount, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    one = F.lit(1).cast("decimal(4,2)")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(price * (one - discount)).cast("string").alias("net"), F.sum(tax).cast("string").alias("tax"), F.max(F.col("l_quantity").cast("decimal(8,0)")).cast("long").alias("most"))


@query("q_interval_lengths", "WITH s AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT AS a, epoch(o_orderdate)::BIGINT + CASE WHEN o_orderkey % 50 = 0 THEN 315360000 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 86400 * (o_orderkey % 90) END AS b, o_orderkey AS span FROM orders), p AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT AS moment, o_orderkey AS point FROM orders) SELECT point, span FROM p JOIN s USING (k) WHERE moment >= a AND moment < b")
def interval_lengths(t: Tables) -> DataFrame:
    """Orders inside terms of one second, of days and of ten years, that begin with other orders of the customer."""
    k, a = F.col("o_orderkey"), F.floor(micros("o_orderdate") / 1000000)
    o = t.orders.select(F.col("o_custkey").alias("k"), a.alias("a"), k.alias("span"), F.when(k % 50 == 0, 315360000).when(k % 3 == 0, 1).otherwise(86400 * (k % 90)).alias("length"))
    spans = o.select("k", "a", (F.col("a") + F.col("length")).alias("b"), "span")
    return temporal.interval_join(o.select("k", F.col("a").alias("at"), F.col("span").alias("point")), spans, "k", "at", "a", "b").select("point", "span")


def part_sketches(t: Tables) -> DataFrame:
    """Sketches of line items by flag and supplier's remainder, as parts of a table would be kept."""
    return sketches.sketched(t.lineitem.withColumn("part", F.col("l_suppkey") % 8), ["l_returnflag", "part"], F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_linestatus"))


@query("q_approximate", "WITH c AS (SELECT l_returnflag AS flag, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT flag, arg_max(s, (n, -ascii(s))) AS top, max(n) AS top_n FROM c GROUP BY flag) SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_linenumber) AS n_lines, min(l_extendedprice) AS least, max(l_extendedprice) AS most, any_value(top) AS top, any_value(top_n) AS top_n FROM lineitem JOIN t ON flag = l_returnflag GROUP BY 1")
def approximate(t: Tables) -> DataFrame:
    """What merged sketches know exactly: few different values, the ends of the quantiles, counts of few items."""
    a = sketches.answers(sketches.merged(part_sketches(t), ["l_returnflag"]), ["l_returnflag"], [0.0, 1.0], 1)
    top = F.get("top", F.lit(0))
    return a.select(F.col("l_returnflag").alias("flag"), "n", F.col("distinct").alias("n_lines"), F.get("quantiles", F.lit(0)).alias("least"), F.get("quantiles", F.lit(1)).alias("most"), top["item"].alias("top"), top["count"].alias("top_n"))


@query("q_sketch_bounds", "SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS n_parts, true AS parts_inside, true AS median_inside FROM lineitem GROUP BY 1")
def sketch_bounds(t: Tables) -> DataFrame:
    """Merged sketches of many values beside exact numbers: whether these are inside the bounds that the sketches give."""
    parts = sketches.sketched(t.lineitem.withColumn("part", F.col("l_suppkey") % 8), ["l_returnflag", "part"], F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_shipdate").cast("date").cast("string"))
    a = sketches.answers(sketches.merged(parts, ["l_returnflag"]), ["l_returnflag"], [0.5], 1).withColumn("median", F.get("quantiles", F.lit(0))).drop("n")
    exact = t.lineitem.join(F.broadcast(a), "l_returnflag").groupBy("l_returnflag").agg(  # a row for each flag
        F.count_distinct("l_partkey").alias("n_parts"), F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("upto"), *(F.first(c).alias(c) for c in ("distinct_low", "distinct_high")))
    inside = (F.col("n_parts") >= F.col("distinct_low")) & (F.col("n_parts") <= F.col("distinct_high"))
    return exact.select(F.col("l_returnflag").alias("flag"), "n_parts", inside.alias("parts_inside"), (F.abs(F.col("upto") - F.col("n") / 2) <= sketches.RANK_ERROR * F.col("n") + 1).alias("median_inside"))
