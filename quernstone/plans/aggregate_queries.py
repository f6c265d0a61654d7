"""Queries of aggregation and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import cells as C
from quernstone.operators import graph as G
from quernstone.operators.evaluate import mann_whitney
from quernstone.operators.neighbours import similar
from quernstone.operators.ranking import quantiles, top_n
from quernstone.plans.join_queries import AB, knn_sql, sides
from quernstone.plans.registry import CANDIDATES, CUST_ALL, CUST_CELLS, PAIRS, PARTS, Tables, cells_sql, query
from quernstone.plans.tables_queries import BATCHES, batches
from quernstone.sources.storage import stored

WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\pL\\pN]+'), lambda x: x <> '')[1:2048])"
TEXT = f"cells AS (SELECT doc_id AS id, 'text' AS col, text AS val FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents), toks AS (SELECT id, col, unnest({WORDS.format('val')}) AS tok FROM cells)"
FREQ = TEXT + ", freq AS (SELECT tok, count(DISTINCT id) AS df, count(*) AS n_edges FROM toks GROUP BY tok)"


def text_cells(t: Tables) -> DataFrame:
    """The graph's cells: each text and its source. The built graph takes all of a text's tokens, the statistics the first 2048."""
    return C.to_cells(t.documents.select(F.col("doc_id").alias("id"), "text", "source"))


def text_tokens(t: Tables) -> DataFrame:
    return C.tokens_of(text_cells(t))


@query("q_token_df", f"WITH {FREQ} SELECT * FROM freq")
def token_df(t: Tables) -> DataFrame:
    return G.token_frequency(text_tokens(t))


@query("q_filter_stats", f"WITH {FREQ}, n AS (SELECT count(*) AS n FROM documents), k AS (SELECT *, df > floor(0.1 * n) AS stop, df <= floor(0.1 * n) AND df < 2 AS rare FROM freq, n) SELECT count(*) AS raw_tokens, sum(n_edges)::BIGINT AS raw_edges, sum(stop::INT)::BIGINT AS stop_tokens, sum(CASE WHEN stop THEN n_edges ELSE 0 END)::BIGINT AS stop_edges, sum(rare::INT)::BIGINT AS rare_tokens, sum(CASE WHEN rare THEN n_edges ELSE 0 END)::BIGINT AS rare_edges, sum((NOT stop AND NOT rare)::INT)::BIGINT AS final_tokens, sum(CASE WHEN NOT stop AND NOT rare THEN n_edges ELSE 0 END)::BIGINT AS final_edges, max(df) AS max_df FROM k")
def filter_stats(t: Tables) -> DataFrame:
    n = t.documents.agg(F.count("*").alias("n"))
    k = G.kept_tokens(G.token_frequency(text_tokens(t)).crossJoin(F.broadcast(n)), F.col("n"), 0.1, 2)
    stop, rare = F.col("stop"), F.col("rare")
    edges = lambda c: F.sum(F.when(c, F.col("n_edges")).otherwise(0))
    return k.agg(F.count("*").alias("raw_tokens"), F.sum("n_edges").alias("raw_edges"), F.count_if(stop).alias("stop_tokens"), edges(stop).alias("stop_edges"), F.count_if(rare).alias("rare_tokens"), edges(rare).alias("rare_edges"), F.count_if(~stop & ~rare).alias("final_tokens"), edges(~stop & ~rare).alias("final_edges"), F.max("df").alias("max_df"))


@query("q_blocking_stats", f"WITH {PARTS}, g AS (SELECT coalesce(type, '?') || '|' || size AS k, count(*) AS n FROM parts GROUP BY 1) SELECT count(*) AS blocks, sum((n > 1)::INT)::BIGINT AS multi, sum(n * (n - 1) // 2)::BIGINT AS pairs, max(n) AS largest, avg(CASE WHEN n > 1 THEN n END) AS mean_multi FROM g")
def blocking_stats(t: Tables) -> DataFrame:
    k = F.concat_ws("|", F.coalesce("type", F.lit("?")), "size")
    n = F.col("n")
    g = t.parts.groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("blocks"), F.count_if(n > 1).alias("multi"), F.sum(n * (n - 1) / 2).cast("long").alias("pairs"), F.max("n").alias("largest"), F.avg(F.when(n > 1, n)).alias("mean_multi"))


@query("q_duplicate_signals", f"WITH {PARTS}, g AS (SELECT name, type, count(*) AS n FROM parts WHERE name IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS n_groups, sum((n > 1)::INT)::BIGINT AS dup_groups, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS dup_rows, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n), 6)::DOUBLE AS pct FROM g")
def duplicate_signals(t: Tables) -> DataFrame:
    g = t.parts.na.drop(subset=["name", "type"]).groupBy("name", "type").agg(F.count("*").alias("n"))
    dup = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return g.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("dup_groups"), dup.alias("dup_rows"), F.round(dup * 100.0 / F.sum("n"), 6).alias("pct"))


@query("q_group_size_hist", "WITH g AS (SELECT o_custkey, least(count(*), 20) AS size FROM orders GROUP BY 1) SELECT size, count(*) AS n FROM g GROUP BY size")
def group_size_hist(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.least(F.count("*"), F.lit(20)).alias("size"))
    return g.groupBy("size").agg(F.count("*").alias("n"))


@query("q_degree_stats", f"WITH {TEXT}, d AS (SELECT 'row' AS kind, count(*) AS d FROM toks GROUP BY id UNION ALL SELECT 'token', count(*) FROM toks GROUP BY tok) SELECT kind, min(d) AS least, max(d) AS most, avg(d) AS mean, quantile_disc(d, 0.5) AS lower_median FROM d GROUP BY kind")
def degree_stats(t: Tables) -> DataFrame:
    """The median is the lower of the two middle values."""
    tokens = text_tokens(t)
    of = lambda c, kind: tokens.groupBy(c).agg(F.count("*").alias("d")).select(F.lit(kind).alias("kind"), "d")
    d = of("id", "row").union(of("tok", "token"))
    return d.groupBy("kind").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").cast("long").alias("lower_median"))


@query("q_graph_density", f"WITH {TEXT} SELECT count(*) / (count(DISTINCT id) * count(DISTINCT tok))::DOUBLE AS density, count(*) / count(DISTINCT id)::DOUBLE AS per_row, count(*) / count(DISTINCT tok)::DOUBLE AS per_token FROM toks")
def graph_density(t: Tables) -> DataFrame:
    s = text_tokens(t).agg(F.count("*").alias("e"), F.count_distinct("id").alias("r"), F.count_distinct("tok").alias("k"))
    return s.select((F.col("e") / (F.col("r") * F.col("k"))).alias("density"), (F.col("e") / F.col("r")).alias("per_row"), (F.col("e") / F.col("k")).alias("per_token"))


@query("q_column_edge_share", f"WITH {TEXT}, c AS (SELECT col, count(*) AS n FROM toks GROUP BY col), p AS (SELECT col, n, n / (sum(n) OVER ())::DOUBLE AS share FROM c) SELECT col, n, share, 1 - sum(share * share) OVER () AS concentration FROM p")
def column_edge_share(t: Tables) -> DataFrame:
    every = W.partitionBy(F.lit(0))  # a row for each column
    c = text_tokens(t).groupBy("col").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(every))
    return c.withColumn("concentration", 1 - F.sum(F.col("share") * F.col("share")).over(every))


@query("q_df_threshold_sweep", f"WITH {FREQ}, h AS (SELECT df, count(*) AS toks, sum(n_edges) AS edges FROM freq GROUP BY df), s AS (SELECT i * 2 AS threshold FROM range(1, 51) r(i)) SELECT threshold, sum(CASE WHEN df > threshold THEN toks ELSE 0 END) * 100.0::DOUBLE / sum(toks) AS pct_tokens, sum(CASE WHEN df > threshold THEN edges ELSE 0 END) * 100.0::DOUBLE / sum(edges) AS pct_edges FROM s, h GROUP BY threshold")
def df_threshold_sweep(t: Tables) -> DataFrame:
    """All thresholds from one histogram: each frequency is counted for every threshold below it."""
    h = G.token_frequency(text_tokens(t)).groupBy("df").agg(F.count("*").alias("toks"), F.sum("n_edges").alias("edges"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 2)
    s = h.select("df", "toks", "edges", F.explode(steps).alias("threshold"))
    over = F.col("df") > F.col("threshold")
    pct = lambda c: F.sum(F.when(over, F.col(c)).otherwise(0)) * 100.0 / F.sum(c)
    return s.groupBy(F.col("threshold").cast("long").alias("threshold")).agg(pct("toks").alias("pct_tokens"), pct("edges").alias("pct_edges"))


@query("q_group_agg", "SELECT n_name AS domain, c_mktsegment AS eval_type, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def group_agg(t: Tables) -> DataFrame:
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return j.groupBy(F.col("n_name").alias("domain"), F.col("c_mktsegment").alias("eval_type")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count("*").alias("n"))


@query("q_metric_summary", f"WITH {PAIRS} SELECT label, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS least, max(score) AS most FROM pairs GROUP BY label")
def metric_summary(t: Tables) -> DataFrame:
    return t.pairs().groupBy("label").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("q_describe", "SELECT count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS std, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS most FROM lineitem")
def describe(t: Tables) -> DataFrame:
    c = "l_quantity"
    q = quantiles(t.lineitem, c, [0.25, 0.5, 0.75])
    s = t.lineitem.agg(F.count(c).alias("n"), F.round(F.avg(c), 9).alias("mean"), F.round(F.stddev_samp(c), 9).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))
    return s.select("n", "mean", "std", "least", *(F.lit(x).cast("double").alias(f"q{i + 1}") for i, x in enumerate(q)), "most")


@query("q_sim_cut_rate", f"WITH {PAIRS}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM pairs), b AS (SELECT label, greatest(1, ceil(round((score - lo) / (hi - lo) * 10, 9)))::INT AS bin FROM pairs, m) SELECT bin, count(*) AS n, avg(label) AS rate FROM b GROUP BY bin HAVING count(*) >= 5")
def sim_cut_rate(t: Tables) -> DataFrame:
    """Ten bins of equal width, closed on the right; the lowest value is in the first."""
    p = t.pairs()
    m = p.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.ceil(F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10, 9))
    return p.crossJoin(F.broadcast(m)).groupBy(F.greatest(F.lit(1), at).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("rate")).where("n >= 5")


@query("q_crosstab_margins", f"WITH {CANDIDATES} SELECT coalesce(confidence, 'All') AS confidence, coalesce(label::VARCHAR, 'All') AS label, count(*) AS n FROM cand GROUP BY CUBE (confidence, label)")
def crosstab_margins(t: Tables) -> DataFrame:
    c = t.candidates().withColumn("label", F.col("label").cast("string"))
    return c.cube("confidence", "label").agg(F.count("*").alias("n")).select(F.coalesce("confidence", F.lit("All")).alias("confidence"), F.coalesce("label", F.lit("All")).alias("label"), "n")


@query("q_crosstab_norm", f"WITH {CANDIDATES} SELECT confidence, label, count(*) / (sum(count(*)) OVER (PARTITION BY confidence))::DOUBLE AS share FROM cand GROUP BY confidence, label")
def crosstab_norm(t: Tables) -> DataFrame:
    n = t.candidates().groupBy("confidence", "label").agg(F.count("*").alias("n"))
    return n.select("confidence", "label", (F.col("n") / F.sum("n").over(W.partitionBy("confidence"))).alias("share"))


@query("q_spec_match_stats", f"WITH {CANDIDATES}, s AS (SELECT spec, count(*) AS n, sum((label = 1)::INT) AS matches, max((label = 1)::INT) AS matched FROM cand GROUP BY spec) SELECT matches::BIGINT AS matches, count(*) AS specs, sum(n)::BIGINT AS pairs FROM s GROUP BY matches")
def spec_match_stats(t: Tables) -> DataFrame:
    s = t.candidates().groupBy("spec").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("matches"))
    return s.groupBy("matches").agg(F.count("*").alias("specs"), F.sum("n").alias("pairs"))


@query("q_batch_stats", BATCHES + " SELECT batch, n, done, matches, matches / greatest(done, 1)::DOUBLE AS rate FROM b")
def batch_stats(t: Tables) -> DataFrame:
    return batches(t).select("batch", "n", "done", "matches", (F.col("matches") / F.greatest("done", F.lit(1))).alias("rate"))


ACC = f"WITH {CANDIDATES}, v AS (SELECT confidence, CASE WHEN sim > 0.1 THEN 'high_sim' ELSE 'low_sim' END AS strategy, label, CASE WHEN spec % 7 = 0 THEN 1 - label ELSE label END AS human FROM cand WHERE label <> -1)"


@query("q_label_accuracy", ACC + " SELECT coalesce(strategy, '') AS strategy, coalesce(confidence, '') AS confidence, count(*) AS n, avg((label = human)::INT) AS accuracy, sum((label = 1 AND human = 0)::INT)::BIGINT AS false_match, sum((label = 0 AND human = 1)::INT)::BIGINT AS false_no_match FROM v GROUP BY GROUPING SETS ((), (strategy), (confidence))")
def label_accuracy(t: Tables) -> DataFrame:
    """All breakdowns in one pass by grouping sets."""
    c = t.candidates().where("label <> -1").select("confidence", F.when(F.col("sim") > 0.1, "high_sim").otherwise("low_sim").alias("strategy"), "label", F.when(F.col("spec") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("human"))
    g = c.groupingSets([[], ["strategy"], ["confidence"]], "strategy", "confidence")
    label, human = F.col("label"), F.col("human")
    s = g.agg(F.count("*").alias("n"), F.avg((label == human).cast("int")).alias("accuracy"), F.count_if((label == 1) & (human == 0)).alias("false_match"), F.count_if((label == 0) & (human == 1)).alias("false_no_match"))
    return s.withColumn("strategy", F.coalesce("strategy", F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit("")))


# Category names and the endings that are stripped from them
CATEGORIES = ["Ани", "these", "There", "onti"]
ENDINGS = "ыие"


@query("q_category_consistency", f"WITH k AS (SELECT c, rtrim(lower(c), '{ENDINGS}') AS stem FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CATEGORIES)}) v(c)), d AS (SELECT doc_id, lower(text) AS s FROM documents) SELECT c AS category, stem, avg(contains(s, stem)::INT) AS rate FROM d, k GROUP BY 1, 2")
def category_consistency(t: Tables) -> DataFrame:
    """Share of texts that have a category's stem; the stems are a literal array, so documents are read once and not joined."""
    stems = F.array(*(F.struct(F.lit(c).alias("category"), F.rtrim(F.lower(F.lit(c)), F.lit(ENDINGS)).alias("stem")) for c in CATEGORIES))
    d = t.documents.select(F.lower("text").alias("s"), F.explode(stems).alias("k"))
    return d.groupBy("k.category", "k.stem").agg(F.avg(F.contains("s", F.col("k.stem")).cast("int")).alias("rate"))


@query("q_confidence_gap", f"WITH {AB}, nn AS {knn_sql(2)}, g AS (SELECT q, max(CASE WHEN rank = 1 THEN sim END) AS top, max(CASE WHEN rank = 1 THEN sim END) - max(CASE WHEN rank = 2 THEN sim END) AS gap FROM nn GROUP BY q) SELECT round(avg(gap), 6) AS mean, round(median(gap), 6) AS median, round(stddev_pop(gap), 6) AS std, avg((gap > 0.02)::INT) AS over_a, avg((gap > 0.05)::INT) AS over_b, round(avg(top), 6) AS top FROM g")
def confidence_gap(t: Tables) -> DataFrame:
    a, b = sides(t)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("sim")))
    g = stored(similar(a, b, k=2).groupBy("q").agg(at(1).alias("top"), (at(1) - at(2)).alias("gap")))
    median = F.lit(quantiles(g, "gap", [0.5])[0]).cast("double")
    share = lambda x: F.avg((F.col("gap") > x).cast("int"))
    return g.agg(F.round(F.avg("gap"), 6).alias("mean"), F.round(median, 6).alias("median"), F.round(F.stddev_pop("gap"), 6).alias("std"), share(0.02).alias("over_a"), share(0.05).alias("over_b"), F.round(F.avg("top"), 6).alias("top"))


PART_CELLS = f"{PARTS}, {cells_sql('parts', ['brand', 'type', 'size'], True)}, k AS (SELECT cells.*, parts.name AS key FROM cells JOIN parts USING (id))"


def keyed_cells(t: Tables) -> DataFrame:
    """(key, id, col, val): cells with the name of their row as key."""
    p = t.parts
    wide = p.select("id", F.col("name").alias("key"), *(F.col(c).cast("string").alias(c) for c in ("brand", "type", "size")))
    return wide.unpivot(["id", "key"], ["brand", "type", "size"], "col", "val")


@query("q_sparsity_divergence", f"WITH {PART_CELLS}, g AS (SELECT key, col, count(*) AS n, count(val) AS f FROM k GROUP BY 1, 2 HAVING count(*) > 1) SELECT col, avg((f > 0 AND f < n)::INT) AS partly FROM g GROUP BY col")
def sparsity_divergence(t: Tables) -> DataFrame:
    g = keyed_cells(t).groupBy("key", "col").agg(F.count("*").alias("n"), F.count("val").alias("f")).where("n > 1")
    return g.groupBy("col").agg(F.avg(((F.col("f") > 0) & (F.col("f") < F.col("n"))).cast("int")).alias("partly"))


@query("q_value_variation", f"WITH {PART_CELLS}, r AS (SELECT key, col, CASE WHEN id % 3 = 0 THEN upper(val) ELSE val END AS val FROM k), g AS (SELECT key, col, count(DISTINCT val) AS raw, count(DISTINCT lower(trim(val))) AS norm, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1) SELECT col, avg((raw > 1)::INT) AS raw_rate, avg((norm > 1)::INT) AS norm_rate, avg((raw > 1)::INT) - avg((norm > 1)::INT) AS format_only FROM g GROUP BY col")
def value_variation(t: Tables) -> DataFrame:
    r = keyed_cells(t).withColumn("val", F.when(F.col("id") % 3 == 0, F.upper("val")).otherwise(F.col("val")))
    g = r.groupBy("key", "col").agg(F.count_distinct("val").alias("raw"), F.count_distinct(C.normalised(F.col("val"))).alias("norm"), F.count("*").alias("n")).where("n > 1")
    rate = lambda c: F.avg((F.col(c) > 1).cast("int"))
    return g.groupBy("col").agg(rate("raw").alias("raw_rate"), rate("norm").alias("norm_rate"), (rate("raw") - rate("norm")).alias("format_only"))


@query("q_varying_columns", f"WITH {PART_CELLS}, g AS (SELECT key, col, count(*) AS n, count(DISTINCT val) + max((val IS NULL)::INT) AS u FROM k GROUP BY 1, 2 HAVING count(*) > 1) SELECT col, count(*) AS n_groups, sum((u > 1)::INT)::BIGINT AS varying FROM g GROUP BY col")
def varying_columns(t: Tables) -> DataFrame:
    """Different values of a group count null as one."""
    u = F.count_distinct("val") + F.max(F.col("val").isNull().cast("int"))
    g = keyed_cells(t).groupBy("key", "col").agg(F.count("*").alias("n"), u.alias("u")).where("n > 1")
    return g.groupBy("col").agg(F.count("*").alias("n_groups"), F.count_if(F.col("u") > 1).alias("varying"))


@query("q_vary_rate", f"WITH {PART_CELLS}, g AS (SELECT key, col, count(DISTINCT val) AS u FROM k GROUP BY 1, 2) SELECT col, avg((u > 1)::INT) AS rate FROM g GROUP BY col")
def vary_rate(t: Tables) -> DataFrame:
    g = keyed_cells(t).groupBy("key", "col").agg(F.count_distinct("val").alias("u"))
    return g.groupBy("col").agg(F.avg((F.col("u") > 1).cast("int")).alias("rate"))


@query("q_key_cardinality", "WITH a AS (SELECT p_name AS k, count(DISTINCT p_brand) AS u FROM part GROUP BY 1), b AS (SELECT p_brand AS k, count(DISTINCT p_name) AS u FROM part GROUP BY 1) SELECT 'name' AS key, avg(u) AS mean, avg((u > 1)::INT) AS many FROM a UNION ALL SELECT 'brand', avg(u), avg((u > 1)::INT) FROM b")
def key_cardinality(t: Tables) -> DataFrame:
    def of(key: str, other: str, name: str) -> DataFrame:
        u = t.part.groupBy(key).agg(F.count_distinct(other).alias("u"))
        return u.agg(F.avg("u").alias("mean"), F.avg((F.col("u") > 1).cast("int")).alias("many")).select(F.lit(name).alias("key"), "mean", "many")

    return of("p_name", "p_brand", "name").union(of("p_brand", "p_name", "brand"))


#: Columns of one table of mixed types, and the Spark type that each has.
MIXED = "mixed AS (SELECT o_orderkey AS id, o_orderkey AS order_id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS placed, o_orderpriority AS priority, o_totalprice > 100000 AS large, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS even, 'x' AS constant, 'order no. ' || o_orderkey AS label, repeat(o_orderpriority, 12) || o_orderkey % 50 AS note, 'C' || o_custkey AS code FROM orders)"
MIXED_TYPES = {"order_id": "number", "customer": "number", "status": "string", "price": "number", "placed": "timestamp", "priority": "string", "large": "boolean", "even": "string", "constant": "string", "label": "string", "note": "string", "code": "string"}
MIXED_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS col, '{k}' AS dtype, {c}::VARCHAR AS val FROM mixed" for c, k in MIXED_TYPES.items()) + ")"
CLASSIFY = f"""WITH {MIXED}, {MIXED_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY col, val IS NULL ORDER BY id) AS k FROM cells), s AS (SELECT col, any_value(dtype) AS dtype, count(*) AS n_rows, count(val) AS n_filled, count(DISTINCT val) AS n_unique, avg(CASE WHEN k <= 1000 THEN length(val) END) AS avg_len FROM r GROUP BY col)
SELECT col, round(n_filled / n_rows::DOUBLE, 9) AS fill, n_unique, CASE WHEN dtype = 'timestamp' THEN 'datetime' WHEN dtype = 'boolean' THEN 'binary' WHEN n_unique <= 1 THEN 'constant' WHEN dtype = 'number' THEN CASE WHEN n_unique = 2 THEN 'binary' ELSE 'numeric' END
WHEN regexp_matches(col, '(^|[._])(id|url|link|image|hash|guid|uuid|src|sell_id|timestamp|unixtime|date|артикул|ссылка)([._]|$)', 'i') OR n_unique / n_filled::DOUBLE > 0.95 THEN 'id_like' WHEN avg_len > 80 THEN 'text' WHEN n_unique = 2 THEN 'binary' WHEN n_unique <= 1000 THEN 'categorical' ELSE 'high_card' END AS kind FROM s"""


@query("q_classify_columns", CLASSIFY)
def classify_columns(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    mixed = t.orders.select(
        k.alias("id"), k.alias("order_id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("placed"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") > 100000).alias("large"), F.when(k % 2 == 0, "yes").otherwise("no").alias("even"), F.lit("x").alias("constant"), F.concat(F.lit("order no. "), k).alias("label"),
        F.concat(F.repeat("o_orderpriority", F.lit(12)), k % 50).alias("note"), F.concat(F.lit("C"), "o_custkey").alias("code"),
    )
    return C.classify_columns(mixed, "id").select("col", F.round("fill", 9).alias("fill"), "n_unique", "kind")


@query("q_profile", f"WITH {CUST_ALL} SELECT col, count(DISTINCT val) AS n_unique, count(*) - count(val) AS n_null, round((count(*) - count(val)) * 100.0 / count(*), 6)::DOUBLE AS null_pct FROM cells GROUP BY col")
def profile(t: Tables) -> DataFrame:
    s = C.column_stats(C.to_cells(t.cust, keep_blank=True))
    nulls = F.col("n_rows") - F.col("n_filled")
    return s.select("col", "n_unique", nulls.alias("n_null"), F.round(nulls * 100.0 / F.col("n_rows"), 6).alias("null_pct"))


@query("q_profile_groups", f"WITH {CUST_CELLS}, top AS (SELECT col FROM cells GROUP BY col ORDER BY count(*) DESC, col LIMIT 5), p AS (SELECT id, string_agg(col, ',' ORDER BY col) AS profile FROM cells WHERE col IN (SELECT col FROM top) GROUP BY id) SELECT profile, count(*) AS n, min(id) AS first_id FROM p GROUP BY profile")
def profile_groups(t: Tables) -> DataFrame:
    """Which of the fullest columns a row fills; a row has as many entries as columns."""
    cells = C.to_cells(t.cust)
    top = cells.groupBy("col").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "col").limit(5)
    p = cells.join(F.broadcast(top), "col", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("col")), ",").alias("profile"))
    return p.groupBy("profile").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("q_categorical_columns", f"WITH {CUST_CELLS} SELECT col, count(DISTINCT val) AS n_unique FROM cells GROUP BY col HAVING count(DISTINCT val) BETWEEN 2 AND 40")
def categorical_columns(t: Tables) -> DataFrame:
    return C.to_cells(t.cust).groupBy("col").agg(F.count_distinct("val").alias("n_unique")).where("n_unique between 2 and 40")


@query("q_top_values", f"WITH {CUST_CELLS}, c AS (SELECT col, val, count(*) AS n FROM cells WHERE col IN ('segment', 'nation', 'constant') GROUP BY 1, 2) SELECT col, val, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank FROM c) WHERE rank <= 10")
def top_values(t: Tables) -> DataFrame:
    c = C.to_cells(t.cust.select("id", "segment", "nation", "constant")).groupBy("col", "val").agg(F.count("*").alias("n"))
    return top_n(c, ["col"], 10, F.desc("n"), F.col("val")).select("col", "val", "n", "rank")


NAMES_SQL = "c AS (SELECT 'event.' || event_type AS col FROM events UNION SELECT p_type FROM part UNION SELECT 'shop.' || r_name FROM region)"


@query("q_namespace_prefix", f"WITH {NAMES_SQL}, p AS (SELECT string_split(col, '.')[1] || '.' AS p FROM c WHERE contains(col, '.')), m AS (SELECT p FROM p GROUP BY p HAVING count(*) / (SELECT count(*) FROM c)::DOUBLE >= 0.3 ORDER BY count(*) DESC, p LIMIT 1) SELECT col, CASE WHEN starts_with(col, (SELECT p FROM m)) THEN substr(col, length((SELECT p FROM m)) + 1) ELSE col END AS bare FROM c")
def namespace_prefix(t: Tables) -> DataFrame:
    """The commonest prefix before a dot, if it is common enough, goes. Names of columns come from the values of three tables."""
    c = t.events.select(F.concat(F.lit("event."), "event_type").alias("col")).union(t.part.select("p_type")).union(t.region.select(F.concat(F.lit("shop."), "r_name"))).distinct()
    p = c.where(F.contains("col", F.lit("."))).groupBy(F.concat(F.split_part("col", F.lit("."), F.lit(1)), F.lit(".")).alias("p")).agg(F.count("*").alias("n"))
    total = c.agg(F.count("*").alias("t"))
    best = p.crossJoin(total).where(F.col("n") / F.col("t") >= 0.3).orderBy(F.desc("n"), "p").limit(1).select("p")
    return c.join(F.broadcast(best), F.lit(True), "left").select("col", T.strip_prefix(F.col("col"), F.coalesce("p", F.lit("\0"))).alias("bare"))


@query("q_synonym_coverage", "WITH syn AS (SELECT p_type AS col, coalesce(list(DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 50 = 1 THEN p_type END) FILTER (p_partkey % 3 = 0 OR p_partkey % 50 = 1), []) AS syns FROM part GROUP BY 1) SELECT count(*) AS n_columns, sum((len(syns) > 0)::INT)::BIGINT AS covered, avg(len(syns)) AS mean_synonyms, sum(list_contains(syns, col)::INT)::BIGINT AS self_synonyms FROM syn")
def synonym_coverage(t: Tables) -> DataFrame:
    """A dictionary of types with the brands of some of their parts as synonyms."""
    k = F.col("p_partkey")
    syn = t.part.groupBy(F.col("p_type").alias("col")).agg(F.collect_set(F.when(k % 3 == 0, F.col("p_brand")).when(k % 50 == 1, F.col("p_type"))).alias("syns"))
    n = F.size("syns")
    return syn.agg(F.count("*").alias("n_columns"), F.count_if(n > 0).alias("covered"), F.avg(n).alias("mean_synonyms"), F.count_if(F.array_contains("syns", F.col("col"))).alias("self_synonyms"))


@query("q_schema_jaccard", f"WITH {CUST_CELLS}, v AS (SELECT id % 20 AS view, list(DISTINCT col) AS cols FROM cells GROUP BY 1), p AS (SELECT len(list_intersect(x.cols, y.cols)) / len(list_distinct(list_concat(x.cols, y.cols)))::DOUBLE AS j FROM v x JOIN v y ON x.view < y.view) SELECT min(j) AS least, avg(j) AS mean, max(j) AS most, count(*) AS n FROM p")
def schema_jaccard(t: Tables) -> DataFrame:
    v = C.to_cells(t.cust).groupBy((F.col("id") % 20).alias("view")).agg(F.collect_set("col").alias("cols"))
    x, y = v.toDF("x", "cx"), v.toDF("y", "cy")
    j = F.size(F.array_intersect("cx", "cy")) / F.size(F.array_union("cx", "cy"))
    return x.join(y, F.col("x") < F.col("y")).select(j.alias("j")).agg(F.min("j").alias("least"), F.avg("j").alias("mean"), F.max("j").alias("most"), F.count("*").alias("n"))


@query("q_overview", f"WITH {PAIRS} SELECT CASE a % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg, avg(label) AS ratio FROM pairs GROUP BY 1")
def overview(t: Tables) -> DataFrame:
    split = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("a") % 3 + 1).cast("int"))
    return t.pairs().groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"), F.avg("label").alias("ratio"))


@query("q_class_balance", "SELECT quality, toxic, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM labels GROUP BY 1, 2")
def class_balance(t: Tables) -> DataFrame:
    n = t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


@query("q_shared_token_stats", f"WITH {FREQ} SELECT sum((df >= 2)::INT)::BIGINT AS shared, sum(CASE WHEN df >= 2 THEN n_edges ELSE 0 END)::BIGINT AS shared_edges, max(df) AS most, avg(df) AS mean FROM freq")
def shared_token_stats(t: Tables) -> DataFrame:
    f = G.token_frequency(text_tokens(t))
    return f.agg(F.count_if(F.col("df") >= 2).alias("shared"), F.sum(F.when(F.col("df") >= 2, F.col("n_edges")).otherwise(0)).alias("shared_edges"), F.max("df").alias("most"), F.avg("df").alias("mean"))


@query("q_token_categories", f"WITH d AS (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS tok FROM documents), x AS (SELECT CASE WHEN length(tok) > 9 THEN '##' || tok ELSE tok END AS tok FROM d WHERE tok <> '') SELECT CASE WHEN starts_with(tok, '##') THEN 'suffix' WHEN regexp_full_match(tok, '[0-9]+') THEN 'digit' WHEN regexp_full_match(tok, '[^\\pL\\pN]+') THEN 'punctuation' ELSE 'word' END AS category, count(*) AS n FROM x GROUP BY 1")
def token_categories(t: Tables) -> DataFrame:
    d = t.documents.select(F.explode(F.split("text", r"[ \n]+")).alias("tok")).where("tok <> ''")
    tok = F.when(F.length("tok") > 9, F.concat(F.lit("##"), "tok")).otherwise(F.col("tok"))
    return d.groupBy(T.token_category(tok).alias("category")).agg(F.count("*").alias("n"))


@query("q_case_variants", "WITH v AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) WHEN p_partkey % 4 = 1 THEN ' ' || p_brand ELSE p_brand END AS raw FROM part) SELECT lower(trim(raw)) AS norm, array_to_string(list_sort(list(raw)), ';') AS forms FROM v GROUP BY 1 HAVING count(*) > 1")
def case_variants(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.upper("p_brand")).when(k == 1, F.concat(F.lit(" "), "p_brand")).otherwise(F.col("p_brand"))
    v = t.part.select(raw.alias("raw")).distinct().groupBy(C.normalised(F.col("raw")).alias("norm")).agg(F.array_sort(F.collect_set("raw")).alias("f"))
    return v.where(F.size("f") > 1).select("norm", F.array_join("f", ";").alias("forms"))


@query("q_mann_whitney", f"WITH {PAIRS}, c AS (SELECT score, count(*) AS n, sum(label) AS n1 FROM pairs GROUP BY score), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rank FROM c), s AS (SELECT sum(n1 * rank) AS r1, sum(n1)::DOUBLE AS n1, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n * n - n) AS ties FROM r), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s) SELECT u, round((u - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u")
def mann_whitney_query(t: Tables) -> DataFrame:
    return mann_whitney(t.pairs(), "score", "label").withColumn("z", F.round("z", 6))


@query("q_max_cluster_fraction", "WITH c AS (SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS cluster FROM embeddings), g AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1) SELECT max(CASE WHEN cluster <> -1 THEN n END) / sum(n)::DOUBLE AS fraction FROM g")
def max_cluster_fraction(t: Tables) -> DataFrame:
    g = t.embeddings.groupBy(F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")).alias("cluster")).agg(F.count("*").alias("n"))
    return g.agg((F.max(F.when(F.col("cluster") != -1, F.col("n"))) / F.sum("n")).alias("fraction"))


@query("q_domain_drop", "SELECT c_mktsegment AS domain, round(avg(CASE WHEN c_nationkey < 12 THEN c_acctbal END), 6) AS inside, round(avg(CASE WHEN c_nationkey >= 12 THEN c_acctbal END), 6) AS across, round(avg(CASE WHEN c_nationkey < 12 THEN c_acctbal END) - avg(CASE WHEN c_nationkey >= 12 THEN c_acctbal END), 6) AS dropped FROM customer GROUP BY 1")
def domain_drop(t: Tables) -> DataFrame:
    mean = lambda c: F.avg(F.when(c, F.col("c_acctbal")))
    a, b = mean(F.col("c_nationkey") < 12), mean(F.col("c_nationkey") >= 12)
    return t.customer.groupBy(F.col("c_mktsegment").alias("domain")).agg(F.round(a, 6).alias("inside"), F.round(b, 6).alias("across"), F.round(a - b, 6).alias("dropped"))


@query("q_column_samples", f"WITH {CUST_CELLS}, f AS (SELECT col, val, min(id) AS first_id FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY first_id, val) AS k FROM f) SELECT col, string_agg(val, ';' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY col")
def column_samples(t: Tables) -> DataFrame:
    """The first five different values of each column."""
    f = C.to_cells(t.cust).groupBy("col", "val").agg(F.min("id").alias("first_id"))
    r = top_n(f, ["col"], 5, F.col("first_id"), F.col("val"), name="k")
    return r.groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "val"))), lambda x: x["val"]), ";").alias("samples"))


