"""Queries of sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.hashing import order_key
from quernstone.operators import cells as C
from quernstone.operators.ranking import globally_numbered, hash_sample, numbered, running_sums, top_n
from quernstone.plans.registry import CANDIDATES, CUST, CUST_ALL, CUST_CELLS, CUST_COLUMNS, PAIRS, PARTS, SUPP, Tables, cells_sql, order_sql, query
from quernstone.sources import tables as S

LINES = "WITH l AS (SELECT '# region ' || r_name AS value FROM region UNION ALL SELECT n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation UNION ALL SELECT n_nationkey || ',' || n_name || ',1,2,3' FROM nation WHERE n_nationkey < 3)"


@query("q_scan_csv", LINES + " SELECT string_split(value, ',')[1] AS id, string_split(value, ',')[2] AS name, string_split(value, ',')[3] AS region FROM l WHERE value NOT LIKE '#%' AND len(string_split(value, ',')) <= 3")
def scan_csv(t: Tables) -> DataFrame:
    n = F.col
    lines = t.region.select(F.concat(F.lit("# region "), "r_name").alias("value")).union(t.nation.select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey"))).union(t.nation.where(n("n_nationkey") < 3).select(F.concat_ws(",", "n_nationkey", "n_name", F.lit("1,2,3"))))
    return S.parse_csv_lines(lines, ["id", "name", "region"])


@query("q_normalize_id", "SELECT r_regionkey AS id, r_name FROM region")
def normalize_id(t: Tables) -> DataFrame:
    return S.normalize_id(t.region)


@query("q_split_pairs", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY {order_sql(42, 'a', 'b')}) - 1 AS k, count(*) OVER () AS n FROM pairs) SELECT a, b, label, CASE WHEN k < greatest(1, floor(n * 0.2)) THEN 'test' WHEN k < greatest(1, floor(n * 0.2)) + greatest(1, floor(n * 0.1)) THEN 'valid' ELSE 'train' END AS split FROM r")
def split_pairs(t: Tables) -> DataFrame:
    return S.split_exact(t.pairs().select("a", "b", "label"), (0.1, 0.2), 42, F.col("a"), F.col("b"))


@query("q_scan_parquet", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def scan_parquet(t: Tables) -> DataFrame:
    return S.read_any(t.spark, f"{t.sf_dir}/nation.parquet").where("n_regionkey = 2").select("n_nationkey", "n_name")


@query("q_union_provenance", "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source_file FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, 'supplier' FROM supplier")
def union_provenance(t: Tables) -> DataFrame:
    return S.union_provenance({"customer": t.customer.selectExpr("c_name name", "c_nationkey nation", "c_mktsegment segment"), "supplier": t.supplier.selectExpr("s_name name", "s_nationkey nation")})


@query("q_union_all", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_name name", "c_nationkey nation").unionByName(t.supplier.selectExpr("s_nationkey nation", "s_name name"))


@query("q_scan_dropna_id", f"WITH {CUST} SELECT 'a_' || (row_number() OVER (ORDER BY id) - 1) AS row_id, name, segment, coalesce(balance::VARCHAR, '') AS balance FROM cust WHERE segment IS NOT NULL")
def scan_dropna_id(t: Tables) -> DataFrame:
    df = numbered(t.cust.na.drop(subset=["segment"]), "id")
    return df.select(F.concat(F.lit("a_"), "row_idx").alias("row_id"), "name", "segment", F.coalesce(F.col("balance").cast("string"), F.lit("")).alias("balance"))


@query("q_blank_filter", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS l FROM documents) SELECT doc_id, l FROM d WHERE trim(l) <> ''")
def blank_filter(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("lang")).alias("l"))
    return d.where(~T.is_blank(F.col("l")))


@query("q_labels_union", f"WITH {PAIRS} SELECT a, b, label, CASE a % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM pairs")
def labels_union(t: Tables) -> DataFrame:
    p = t.pairs().select("a", "b", "label")
    return S.union_provenance({s: p.where(F.col("a") % 3 == k) for k, s in enumerate(("train", "valid", "test"))}, "split")


@query("q_dataset_stats", f"WITH {PAIRS}, {CUST}, {SUPP} SELECT (SELECT count(*) FROM cust) AS rows_a, (SELECT count(*) FROM supp) AS rows_b, count(*) AS n_pairs, sum(label)::BIGINT AS n_pos, avg(label) AS pos_ratio FROM pairs")
def dataset_stats(t: Tables) -> DataFrame:
    one = t.pairs().agg(F.count("*").alias("n_pairs"), F.sum("label").alias("n_pos"), F.avg("label").alias("pos_ratio"))
    return t.cust.agg(F.count("*").alias("rows_a")).crossJoin(t.supp.agg(F.count("*").alias("rows_b"))).crossJoin(one)


@query("q_to_json_sink", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS info FROM nation")
def to_json_sink(t: Tables) -> DataFrame:
    return S.json_columns(t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("info")))


@query("q_resume_todo", f"WITH {CANDIDATES}, b AS (SELECT *, (row_number() OVER (ORDER BY spec, nom) - 1) // 5 AS batch FROM cand) SELECT batch, count(*) AS n, sum((label = -1)::INT)::BIGINT AS todo FROM b GROUP BY batch HAVING NOT bool_and(label <> -1)")
def resume_todo(t: Tables) -> DataFrame:
    b = numbered(t.candidates(), "spec", F.col("nom")).withColumn("batch", F.floor(F.col("row_idx") / 5))
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("label") == -1).alias("todo")).where("todo > 0")


@query("q_upsert_by_key", "WITH o AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS id, 'new' AS v FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def upsert_by_key(t: Tables) -> DataFrame:
    old = t.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey id", "c_mktsegment v")
    return S.upsert(old, t.customer.where("c_custkey % 3 = 0").selectExpr("c_custkey id", "'new' v"), ["id"])


@query("q_project_features", f"WITH {CUST} SELECT * EXCLUDE (id) REPLACE (balance::VARCHAR AS balance) FROM cust")
def project_features(t: Tables) -> DataFrame:
    return t.cust.select(*C.feature_columns(t.cust)).withColumn("balance", F.col("balance").cast("string"))


SYNONYMS = [("name", ["title", "label", "caption"]), ("segment", ["sector"]), ("nation", ["country", "state"]), ("balance", [])]
SYN_SQL = "syn(col, syns) AS (VALUES ('name', ['title', 'label', 'caption']), ('segment', ['sector']), ('nation', ['country', 'state']), ('balance', CAST([] AS VARCHAR[])))"


def synonyms(t: Tables) -> DataFrame:
    return t.rows("col string, syns array<string>", *SYNONYMS)


def renamed(cols: DataFrame, syns: DataFrame, idx: int) -> DataFrame:
    """(col, new): the synonym at min(idx, last), the column itself without synonyms."""
    new = F.when(F.size("syns") > 0, F.element_at("syns", F.least(F.lit(idx + 1), F.size("syns"))))
    return cols.join(syns, "col", "left").select("col", F.coalesce(new, F.col("col")).alias("new"))


@query("q_schema_injection", f"WITH {CUST_CELLS}, {SYN_SQL} SELECT id, coalesce(CASE WHEN len(syns) > 0 THEN syns[least(3, len(syns))] END, col) AS col, val FROM cells LEFT JOIN syn USING (col)")
def schema_injection(t: Tables) -> DataFrame:
    cells = C.to_cells(t.cust)
    names = renamed(t.rows("col string", *((c,) for c in CUST_COLUMNS)), synonyms(t), 2)
    return cells.join(names, "col").select("id", F.col("new").alias("col"), "val")


@query("q_schema_ground_truth", f"WITH {CUST_CELLS}, {SYN_SQL}, c AS (SELECT col, count(*) AS k FROM cells GROUP BY col), r AS (SELECT col, k, coalesce(CASE WHEN len(syns) > 0 THEN syns[1] END, col) AS a, coalesce(CASE WHEN len(syns) > 0 THEN syns[least(2, len(syns))] END, col) AS b FROM c LEFT JOIN syn USING (col)) SELECT a, b FROM r WHERE 20 * k >= (SELECT count(*) FROM cust)")
def schema_ground_truth(t: Tables) -> DataFrame:
    """Names of one column in two views; the second has no columns that are filled in fewer than a twentieth of the rows."""
    filled = C.to_cells(t.cust).groupBy("col").agg(F.count("*").alias("k"))
    n = t.cust.agg(F.count("*").alias("n"))
    dense = filled.crossJoin(F.broadcast(n)).where("20 * k >= n")  # one row
    a, b = renamed(filled.select("col"), synonyms(t), 0), renamed(dense.select("col"), synonyms(t), 1)
    return a.withColumnRenamed("new", "a").join(b.withColumnRenamed("new", "b"), "col").select("a", "b")


@query("q_column_dropout", f"WITH {CUST_CELLS}, c(col) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CUST_COLUMNS)}), gone AS (SELECT col FROM c ORDER BY md5('42|' || col) LIMIT 2) SELECT id, col, val FROM cells WHERE col NOT IN (SELECT col FROM gone)")
def column_dropout(t: Tables) -> DataFrame:
    return C.to_cells(t.cust.drop(*C.dropped_columns(CUST_COLUMNS, 0.4, 42)))


@query("q_drop_constant_columns", f"WITH {CUST_CELLS} SELECT col, count(DISTINCT val) AS n_unique FROM cells GROUP BY col HAVING count(DISTINCT val) > 1")
def drop_constant_columns(t: Tables) -> DataFrame:
    return C.to_cells(t.cust).groupBy("col").agg(F.count_distinct("val").alias("n_unique")).where("n_unique > 1")


@query("q_dense_columns", f"WITH {CUST_ALL} SELECT col, count(val) / count(*)::DOUBLE AS fill FROM cells GROUP BY col HAVING count(val) / count(*)::DOUBLE >= 0.05")
def dense_columns(t: Tables) -> DataFrame:
    s = C.column_stats(C.to_cells(t.cust, keep_blank=True))
    return s.select("col", (F.col("n_filled") / F.col("n_rows")).alias("fill")).where("fill >= 0.05")


@query("q_min_notnull_rows", f"WITH {CUST} SELECT row_number() OVER (ORDER BY id) - 1 AS row_idx, id, segment, balance::VARCHAR AS balance FROM cust WHERE (segment IS NOT NULL)::INT + (balance IS NOT NULL)::INT + (sparse IS NOT NULL)::INT + 3 >= 5")
def min_notnull_rows(t: Tables) -> DataFrame:
    return numbered(C.min_notnull(t.cust, 5), "id").select("row_idx", "id", "segment", F.col("balance").cast("string").alias("balance"))


@query("q_row_sample", f"SELECT c_custkey AS id FROM customer ORDER BY {order_sql(7, 'c_custkey')}, c_custkey LIMIT 50")
def row_sample(t: Tables) -> DataFrame:
    return hash_sample(t.customer.selectExpr("c_custkey id"), 50, 7, F.col("id"))


@query("q_split_pos_neg", "SELECT doc_id::VARCHAR AS id, quality = 1 AS positive, toxic FROM labels WHERE CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END IS NOT NULL")
def split_pos_neg(t: Tables) -> DataFrame:
    d = t.labels.withColumn("label", F.when(F.col("doc_id") % 4 != 0, F.col("quality"))).where(F.col("label").isNotNull())
    return d.select(F.col("doc_id").cast("string").alias("id"), (F.col("label") == 1).alias("positive"), "toxic")


@query("q_candidates", f"WITH {PAIRS} SELECT a, b, score FROM pairs WHERE score >= 0.2")
def candidates(t: Tables) -> DataFrame:
    return t.pairs().where("score >= 0.2").select("a", "b", "score")


EDGES = [(-1.0, -0.1), (-0.1, 0.0), (0.0, 0.1), (0.1, 0.2), (0.2, 1.001)]


@query("q_sim_buckets", f"WITH {PAIRS}, b(lo, hi) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in EDGES)}) SELECT lo, hi, count(a) AS n FROM b LEFT JOIN pairs ON score >= lo AND score < hi GROUP BY lo, hi")
def sim_buckets(t: Tables) -> DataFrame:
    counts = t.pairs().agg(*(F.count_if((F.col("score") >= lo) & (F.col("score") < hi)).alias(f"n{i}") for i, (lo, hi) in enumerate(EDGES)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"n{i}").alias("n")) for i, (lo, hi) in enumerate(EDGES)))).alias("r")).select("r.*")


@query("q_valid_identifier", r"WITH d AS (SELECT doc_id, string_split(text, '.')[1] AS s FROM documents) SELECT doc_id, regexp_full_match(s, '[\p{L}\p{N}_]{1,80}') AS valid FROM d")
def valid_identifier(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.valid_identifier(F.get(F.split("text", r"\."), F.lit(0))).alias("valid"))


@query("q_trusted_tiers", f"WITH {CANDIDATES} SELECT CASE WHEN spec % 10 = 0 THEN 'gold' WHEN confidence = 'high' AND NOT (label = 0 AND sim > 0.2) THEN 'trusted' ELSE 'other' END AS tier, count(*) AS n, sum(label)::BIGINT AS n_pos FROM cand WHERE label <> -1 GROUP BY 1")
def trusted_tiers(t: Tables) -> DataFrame:
    trusted = (F.col("confidence") == "high") & ~((F.col("label") == 0) & (F.col("sim") > 0.2))
    tier = F.when(F.col("spec") % 10 == 0, "gold").when(trusted, "trusted").otherwise("other")
    return t.candidates().where("label <> -1").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


VERIFY = f"""WITH {CANDIDATES},
s1 AS (SELECT spec, nom, 1 AS prio, 'match_low_sim' AS strategy FROM cand WHERE label = 1 ORDER BY sim, spec, nom LIMIT 20),
s2 AS (SELECT spec, nom, 2, 'nomatch_high_sim' FROM cand WHERE label = 0 ORDER BY sim DESC, spec, nom LIMIT 20),
s3 AS (SELECT spec, nom, 3, 'random' FROM cand WHERE label <> -1 ORDER BY {order_sql(42, 'spec', 'nom')}, spec, nom LIMIT 30),
u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
SELECT spec, nom, arg_min(strategy, prio) AS strategy FROM u GROUP BY spec, nom"""


@query("q_verification_sample", VERIFY)
def verification_sample(t: Tables) -> DataFrame:
    c = t.candidates().where("label <> -1")
    pick = lambda d, k, s: d.select("spec", "nom", F.lit(k).alias("prio"), F.lit(s).alias("strategy"))
    low = pick(c.where("label = 1").orderBy("sim", "spec", "nom").limit(20), 1, "match_low_sim")
    high = pick(c.where("label = 0").orderBy(F.desc("sim"), "spec", "nom").limit(20), 2, "nomatch_high_sim")
    some = pick(hash_sample(c, 30, 42, F.col("spec"), F.col("nom")), 3, "random")
    return low.union(high).union(some).groupBy("spec", "nom").agg(F.min_by("strategy", "prio").alias("strategy"))


@query("q_semantic_columns", f"WITH {CUST_ALL}, s AS (SELECT col, count(val) * 100.0 / count(*) AS fill, count(DISTINCT val) AS n FROM cells GROUP BY col) SELECT col, round(fill, 4)::DOUBLE AS fill, n FROM s WHERE fill >= 20 AND n BETWEEN 2 AND 40")
def semantic_columns(t: Tables) -> DataFrame:
    s = C.column_stats(C.to_cells(t.cust, keep_blank=True))
    fill = F.col("n_filled") * 100.0 / F.col("n_rows")
    return s.select("col", F.round(fill, 4).alias("fill"), F.col("n_unique").alias("n")).where("fill >= 20 and n between 2 and 40")


# Sorts, limits, sets


@query("q_nlargest", f"WITH {PAIRS} SELECT a, b, score FROM pairs ORDER BY score DESC, a, b LIMIT 25")
def nlargest(t: Tables) -> DataFrame:
    return t.pairs().select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(25)


@query("q_nsmallest", f"WITH {PAIRS} SELECT a, b, score FROM pairs ORDER BY score, a, b LIMIT 25")
def nsmallest(t: Tables) -> DataFrame:
    return t.pairs().select("a", "b", "score").orderBy("score", "a", "b").limit(25)


@query("q_best_by_metric", "SELECT p_brand AS brand, max(p_retailprice) AS best, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS part FROM part GROUP BY 1")
def best_by_metric(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_retailprice").alias("best"), F.max_by("p_partkey", F.struct(F.col("p_retailprice"), -F.col("p_partkey"))).alias("part"))


NEG = 300
NEG_SQL = f"""WITH {PAIRS}, n AS (SELECT count(*) AS n FROM embeddings),
draw AS (SELECT DISTINCT ('0x' || substr(md5('5|a|' || i), 1, 8))::UBIGINT::BIGINT % n AS a, ('0x' || substr(md5('5|b|' || i), 1, 8))::UBIGINT::BIGINT % n AS b FROM range({NEG * 4}) r(i), n)
SELECT a, b FROM draw WHERE a <> b AND (a, b) NOT IN (SELECT (a, b) FROM pairs WHERE label = 1) ORDER BY {order_sql(5, 'a', 'b')}, a, b LIMIT {NEG}"""


@query("q_sample_negatives", NEG_SQL)
def sample_negatives(t: Tables) -> DataFrame:
    """Draws with some to spare, by hash; positives and repeats go, and the first by hash stay."""
    from quernstone.functions.hashing import u32

    n = t.embeddings.agg(F.count("*").alias("n"))
    draw = t.spark.range(NEG * 4).crossJoin(F.broadcast(n)).select((u32(5, F.lit("a"), F.col("id")) % F.col("n")).alias("a"), (u32(5, F.lit("b"), F.col("id")) % F.col("n")).alias("b")).distinct()
    free = draw.where("a <> b").join(t.pairs().where("label = 1").select("a", "b"), ["a", "b"], "left_anti")
    return hash_sample(free, NEG, 5, F.col("a"), F.col("b"))


PROFILE = "CASE WHEN segment IS NULL THEN '0' ELSE '1' END || CASE WHEN balance IS NULL THEN '0' ELSE '1' END || CASE WHEN sparse IS NULL THEN '0' ELSE '1' END"


@query("q_profile_negatives", f"WITH {CUST}, r AS (SELECT id, {PROFILE} AS profile FROM cust), k AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY {order_sql(9, 'id')}, id) - 1 AS k, count(*) OVER (PARTITION BY profile) AS n FROM r) SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.profile = y.profile AND y.k = (x.k + 1) % x.n AND x.id <> y.id")
def profile_negatives(t: Tables) -> DataFrame:
    """Each row with the next one, by hash, of its null profile."""
    profile = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in ("segment", "balance", "sparse")))
    r = t.cust.select("id", profile.alias("profile"))
    k = globally_numbered(r, F.col("profile"), order_key(9, F.col("id")), F.col("id"), name="k")
    sizes = k.groupBy("profile").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    k = k.join(sizes, "profile")  # at most eight profiles
    after = F.when(F.col("k") + 1 == F.col("first") + F.col("n"), F.col("first")).otherwise(F.col("k") + 1)
    return k.select(F.col("id").alias("a"), after.alias("k")).join(k.select("k", F.col("id").alias("b")), "k").where("a <> b").select("a", "b")


@query("q_vocab_intersect", "SELECT DISTINCT lower(trim(p_brand)) AS v FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT lower(trim(p_brand)) FROM part WHERE p_partkey % 2 = 1 INTERSECT SELECT lower(trim(p_brand)) FROM part WHERE p_size > 25")
def vocab_intersect(t: Tables) -> DataFrame:
    v = lambda c: t.part.where(c).select(C.normalised(F.col("p_brand")).alias("v"))
    return v("p_partkey % 2 = 0").intersect(v("p_partkey % 2 = 1")).intersect(v("p_size > 25"))


@query("q_vocab_except", "SELECT lower(trim(p_name)) AS v FROM part WHERE p_partkey % 3 = 0 EXCEPT SELECT lower(trim(p_name)) FROM part WHERE p_size > 40")
def vocab_except(t: Tables) -> DataFrame:
    v = lambda c: t.part.where(c).select(C.normalised(F.col("p_name")).alias("v"))
    return v("p_partkey % 3 = 0").subtract(v("p_size > 40"))


@query("q_symmetric_closure", f"WITH {PAIRS} SELECT a, b FROM pairs WHERE label = 1 UNION SELECT b, a FROM pairs WHERE label = 1")
def symmetric_closure(t: Tables) -> DataFrame:
    p = t.pairs().where("label = 1")
    return p.select("a", "b").union(p.select("b", "a")).distinct()


@query("q_view_pairs", "WITH v AS (SELECT DISTINCT source AS s FROM documents) SELECT x.s AS a, y.s AS b FROM v x JOIN v y ON x.s < y.s")
def view_pairs(t: Tables) -> DataFrame:
    v = t.documents.select("source").distinct()
    return v.selectExpr("source a").join(v.selectExpr("source b"), F.col("a") < F.col("b"))


@query("q_pair_rows", f"WITH {PAIRS} SELECT a AS id FROM pairs UNION SELECT b FROM pairs")
def pair_rows(t: Tables) -> DataFrame:
    p = t.pairs()
    return p.selectExpr("a id").union(p.selectExpr("b id")).distinct()


@query("q_ordered_unique", f"WITH {PAIRS}, r AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM pairs), x AS (SELECT a AS id, 2 * k AS p FROM r UNION ALL SELECT b, 2 * k + 1 FROM r) SELECT id, min(p) AS first_pos, row_number() OVER (ORDER BY min(p)) - 1 AS idx FROM x GROUP BY id")
def ordered_unique(t: Tables) -> DataFrame:
    r = numbered(t.pairs().select("a", "b"), "a", F.col("b"), name="k")
    x = r.select(F.posexplode(F.array("a", "b")).alias("side", "id"), "k").groupBy("id").agg(F.min(2 * F.col("k") + F.col("side")).alias("first_pos"))
    return numbered(x, "first_pos", name="idx")


# Window-style operators


@query("q_dedup_first", f"WITH {PARTS} SELECT id, name, brand, size FROM (SELECT *, row_number() OVER (PARTITION BY name, brand ORDER BY id) AS r FROM parts) WHERE r = 1")
def dedup_first(t: Tables) -> DataFrame:
    from quernstone.operators.ranking import dedup_first

    return dedup_first(t.parts, ["name", "brand"], F.col("id")).select("id", "name", "brand", "size")


@query("q_topn_per_group", f"WITH {CANDIDATES} SELECT spec, nom, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY sim DESC, nom) AS rank FROM cand) WHERE rank <= 3")
def topn_per_group(t: Tables) -> DataFrame:
    return top_n(t.candidates(), ["spec"], 3, F.desc("sim"), F.col("nom")).select("spec", "nom", "sim", "rank")


@query("q_global_index", "WITH u AS (SELECT 0 AS side, c_custkey AS id FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier) SELECT side, id, row_number() OVER (ORDER BY side, id) - 1 AS row_idx FROM u")
def global_index(t: Tables) -> DataFrame:
    """Sides one after the other: numbers inside a side, plus the sizes of the sides before."""
    a, b = numbered(t.customer.selectExpr("0 side", "c_custkey id"), "id"), numbered(t.supplier.selectExpr("1 side", "s_suppkey id"), "id")
    n = t.customer.agg(F.count("*").alias("n"))
    return a.unionByName(b.crossJoin(F.broadcast(n)).withColumn("row_idx", F.col("row_idx") + F.col("n")).drop("n"))


@query("q_token_index", f"WITH {PARTS}, {cells_sql('parts', ['name', 'brand'])}, t AS (SELECT id, col, unnest(list_filter(string_split_regex(lower(val), '[^\\pL\\pN]+'), lambda x: x <> '')) AS tok, generate_subscripts(list_filter(string_split_regex(lower(val), '[^\\pL\\pN]+'), lambda x: x <> ''), 1) AS p FROM cells), f AS (SELECT tok, min(struct_pack(i := id, s := (col <> 'name')::INT, p := p)) AS first_pos FROM t GROUP BY tok) SELECT tok, row_number() OVER (ORDER BY first_pos) - 1 AS tok_idx FROM f")
def token_index(t: Tables) -> DataFrame:
    tokens = C.to_cells(t.parts.select("id", "name", "brand")).select("id", "col", F.posexplode(T.tokenize(F.col("val"))).alias("pos", "tok"))
    first = F.min(F.struct("id", (F.col("col") != "name").alias("side"), "pos"))
    return globally_numbered(tokens.groupBy("tok").agg(first.alias("first")), F.col("first"), name="tok_idx").select("tok", "tok_idx")


@query("q_cell_token_cap", f"WITH d AS (SELECT doc_id AS id, 'text' AS col, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> ''))) AS tok FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id, col ORDER BY {order_sql(42, 'id', 'col', 'tok')}, tok) AS k FROM d) SELECT id, col, tok FROM r WHERE k <= 5")
def cell_token_cap(t: Tables) -> DataFrame:
    cells = t.documents.select(F.col("doc_id").alias("id"), F.lit("text").alias("col"), F.col("text").alias("val"))
    return C.capped_cells(cells, 5, 42)


BATCHES = f"WITH {CANDIDATES}, r AS (SELECT *, (row_number() OVER (ORDER BY spec, nom) - 1) // 5 AS batch FROM cand), b AS (SELECT batch, count(*) AS n, sum((label <> -1)::INT)::BIGINT AS done, sum((label = 1)::INT)::BIGINT AS matches FROM r GROUP BY batch)"


def batches(t: Tables) -> DataFrame:
    r = numbered(t.candidates(), "spec", F.col("nom")).withColumn("batch", F.floor(F.col("row_idx") / 5))
    return r.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("label") != -1).alias("done"), F.count_if(F.col("label") == 1).alias("matches"))


@query("q_cumulative_progress", BATCHES + " SELECT batch, (sum(done) OVER w)::BIGINT AS done_so_far, (sum(matches) OVER w)::BIGINT AS matches_so_far FROM b WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)")
def cumulative_progress(t: Tables) -> DataFrame:
    return running_sums(batches(t), [], [F.col("batch")], {"done_so_far": "done", "matches_so_far": "matches"}).select("batch", "done_so_far", "matches_so_far")


@query("q_rolling_rate", BATCHES + " SELECT batch, avg(matches / greatest(done, 1)::DOUBLE) OVER (ORDER BY batch ROWS 9 PRECEDING) AS rate FROM b")
def rolling_rate(t: Tables) -> DataFrame:
    """Batches are numbered without gaps, so each rate goes to the ten batches whose window has it; no window over all of them."""
    rate = F.col("matches") / F.greatest("done", F.lit(1)).cast("double")
    spread = batches(t).select(F.explode(F.sequence(F.col("batch"), F.col("batch") + 9)).alias("of"), "batch", rate.alias("rate"))
    return spread.groupBy(F.col("of").alias("batch")).agg(F.avg("rate").alias("rate"), F.max((F.col("of") == F.col("batch")).cast("int")).alias("there")).where("there = 1").select("batch", "rate")


HW = "WITH " + "history AS (SELECT user_id AS user, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, round(value, 4) AS loss FROM events)"


@query("q_moving_average_valid", HW + ", m AS (SELECT user, epoch, avg(loss) OVER (PARTITION BY user ORDER BY epoch ROWS 4 PRECEDING) AS mean FROM history) SELECT user, epoch, mean FROM m WHERE epoch >= 5")
def moving_average_valid(t: Tables) -> DataFrame:
    w = W.partitionBy("user").orderBy("epoch").rowsBetween(-4, 0)
    return t.history.select("user", "epoch", F.avg("loss").over(w).alias("mean")).where("epoch >= 5")


@query("q_running_min", HW + " SELECT user, epoch, min(loss) OVER (PARTITION BY user ORDER BY epoch) AS best FROM history")
def running_min(t: Tables) -> DataFrame:
    return t.history.select("user", "epoch", F.min("loss").over(W.partitionBy("user").orderBy("epoch")).alias("best"))


@query("q_convergence_epoch", HW + ", s AS (SELECT *, first_value(loss) OVER (PARTITION BY user ORDER BY epoch) AS f, min(loss) OVER (PARTITION BY user) AS m FROM history) SELECT user, min(epoch) AS epoch FROM s WHERE loss <= f - 0.9 * (f - m) GROUP BY user")
def convergence_epoch(t: Tables) -> DataFrame:
    part = W.partitionBy("user")
    s = t.history.withColumn("f", F.first("loss").over(part.orderBy("epoch"))).withColumn("m", F.min("loss").over(part))
    return s.where(F.col("loss") <= F.col("f") - 0.9 * (F.col("f") - F.col("m"))).groupBy("user").agg(F.min("epoch").alias("epoch"))


@query("q_early_stopping", HW + ", s AS (SELECT *, min(loss) OVER (PARTITION BY user ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history), l AS (SELECT *, max(CASE WHEN b IS NULL OR loss < b THEN epoch END) OVER (PARTITION BY user ORDER BY epoch) AS last FROM s) SELECT user, epoch, epoch - last AS waited, epoch - last >= 3 AS stop FROM l")
def early_stopping(t: Tables) -> DataFrame:
    part = W.partitionBy("user").orderBy("epoch")
    s = t.history.withColumn("b", F.min("loss").over(part.rowsBetween(W.unboundedPreceding, -1)))
    last = F.max(F.when(F.col("b").isNull() | (F.col("loss") < F.col("b")), F.col("epoch"))).over(part)
    return s.withColumn("waited", F.col("epoch") - last).select("user", "epoch", "waited", (F.col("waited") >= 3).alias("stop"))


@query("q_shard_assign", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, least(k // greatest(n // 7, 1), 6)::INT AS shard FROM r")
def shard_assign(t: Tables) -> DataFrame:
    r = numbered(t.documents.select("doc_id"), "doc_id", name="k").crossJoin(F.broadcast(t.documents.agg(F.count("*").alias("n"))))
    return r.select("doc_id", S.shard(F.col("k"), F.col("n"), 7).alias("shard"))


@query("q_batch_assign", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 5 AS batch FROM documents")
def batch_assign(t: Tables) -> DataFrame:
    return numbered(t.documents.select("doc_id"), "doc_id", name="k").select("doc_id", F.floor(F.col("k") / 5).alias("batch"))
