"""Queries of the row-token graph, components, evaluation of matchers and clusters, losses and mining."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.hashing import order_key, u01
from quernstone.functions.providers import embed
from quernstone.operators import cells as C
from quernstone.operators import density as D
from quernstone.operators import evaluate as E
from quernstone.operators import graph as G
from quernstone.operators import losses as L
from quernstone.operators import training as T
from quernstone.operators.neighbours import best_of_other_label, log_sum_exp, pair_scores, similar
from quernstone.plans.aggregate_queries import FREQ, TEXT, text_cells, text_tokens
from quernstone.plans.join_queries import AB, SELF, knn_sql, self_neighbours, sides
from quernstone.plans.registry import HISTORY, PAIRS, Tables, order_sql, query
from quernstone.sources.storage import Scratch, stored

KEPT = FREQ.replace("[1:2048]", "") + ", n AS (SELECT count(*) AS n FROM documents), kept AS (SELECT tok FROM freq, n WHERE df <= floor(0.3 * n) AND df >= 2), edges AS (SELECT id, col, tok FROM (SELECT toks.*, row_number() OVER (PARTITION BY id, col ORDER BY " + order_sql(42, "id", "col", "tok") + ", tok) AS k FROM toks SEMI JOIN kept USING (tok)) WHERE k <= 16)"


def edges(t: Tables) -> DataFrame:
    return G.build_edges(text_cells(t), t.documents.count(), 0.3, 2)


@query("q_build_graph", f"WITH {KEPT} SELECT id, col, tok FROM edges")
def build_graph(t: Tables) -> DataFrame:
    return edges(t)


@query("q_idf_filter", f"WITH {FREQ}, n AS (SELECT count(*) AS n FROM documents) SELECT tok, df FROM freq, n WHERE df <= floor(0.05 * n)")
def idf_filter(t: Tables) -> DataFrame:
    return G.kept_tokens(G.token_frequency(text_tokens(t)), F.lit(t.documents.count()), 0.05, 1).where("not stop").select("tok", "df")


@query("q_min_degree_filter", f"WITH {FREQ} SELECT tok, df FROM freq WHERE df >= 3")
def min_degree_filter(t: Tables) -> DataFrame:
    return G.kept_tokens(G.token_frequency(text_tokens(t)), F.lit(t.documents.count()), 1.0, 3).where("not rare").select("tok", "df")


@query("q_unified_graph", f"WITH {TEXT}, s AS (SELECT doc_id AS id, lang FROM documents), g AS (SELECT lang, toks.* FROM toks JOIN s USING (id)), f AS (SELECT tok, count(DISTINCT id) AS df FROM g GROUP BY tok), k AS (SELECT tok FROM f WHERE df >= 2 AND df <= floor(0.3 * (SELECT count(*) FROM s))) SELECT lang, count(*) AS n_edges, count(DISTINCT tok) AS n_tokens, count(DISTINCT id) AS n_rows FROM g WHERE tok IN (SELECT tok FROM k) GROUP BY lang")
def unified_graph(t: Tables) -> DataFrame:
    """Several datasets (languages), one frequency threshold over all of them."""
    lists = stored(G.token_lists(text_cells(t)))
    kept = stored(G.kept_tokens(G.row_frequency(lists), F.lit(t.documents.count()), 0.3, 2).where("not stop and not rare").select("tok"))
    langs = t.documents.select(F.col("doc_id").alias("id"), "lang")
    g = G.only_kept(lists.join(langs, "id").select("id", "lang", F.inline("lists")).select("id", "lang", F.explode("toks").alias("tok")), kept)
    edges_ = g.groupBy("lang", "tok").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_tokens"))
    rows = g.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("n_rows"))
    return edges_.join(rows, edges_["lang"].eqNullSafe(rows["lang"])).select(edges_["lang"], "n_edges", "n_tokens", "n_rows")


@query("q_merge_graphs", "WITH g AS (SELECT lang, count(*) AS n_rows, sum(n_chars) AS n_tokens FROM documents GROUP BY lang) SELECT lang, coalesce(sum(n_rows) OVER w, 0)::BIGINT AS row_offset, coalesce(sum(n_tokens) OVER w, 0)::BIGINT AS token_offset FROM g WINDOW w AS (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def merge_graphs(t: Tables) -> DataFrame:
    """Where each graph's rows and tokens start when graphs are put one after the other; a row for each graph."""
    g = t.documents.groupBy("lang").agg(F.count("*").alias("r"), F.sum("n_chars").alias("k"))
    w = W.partitionBy(F.lit(0)).orderBy("lang").rowsBetween(W.unboundedPreceding, -1)
    return g.select("lang", F.coalesce(F.sum("r").over(w), F.lit(0)).alias("row_offset"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("token_offset"))


LINKS = f"WITH RECURSIVE {PAIRS}, l AS (SELECT a, b FROM pairs WHERE score >= 0.15), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l)"
CC = ", reach AS (SELECT a AS id, a AS r FROM u UNION SELECT b, b FROM u UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.r), cc AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


def linked(t: Tables) -> DataFrame:
    return G.connected_components(t.pairs().where("score >= 0.15").select("a", "b"), few=G.FEW_LINKS)


@query("q_connected_components", LINKS + CC + " SELECT id, component FROM cc")
def connected_components(t: Tables) -> DataFrame:
    return linked(t)


@query("q_component_split")
def component_split(t: Tables) -> DataFrame:
    """Whole components go to train, valid and test, so no row is in two."""
    p = t.pairs().where("score >= 0.15").select("a", "b", "label")
    return G.component_split(p, linked(t), (0.6, 0.2, 0.2), 42)


@query("q_cc_clusters", SELF.replace("WITH", "WITH RECURSIVE", 1) + ", u AS (SELECT q AS a, i AS b FROM nn WHERE sim >= 0.38 UNION SELECT i, q FROM nn WHERE sim >= 0.38), reach AS (SELECT vec_id AS id, vec_id AS r FROM e UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.r) SELECT id, min(r) AS cluster FROM reach GROUP BY id")
def cc_clusters(t: Tables) -> DataFrame:
    """Components of the links to near neighbours that reach a similarity; the others stay alone."""
    near = stored(self_neighbours(t, threshold=0.38).select(F.col("q").alias("a"), F.col("i").alias("b")))  # the components read their links twice
    ids = t.embeddings.select(F.col("vec_id").alias("id"))
    return ids.join(G.connected_components(near, few=G.FEW_LINKS), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


NS = f"WITH {PAIRS}, u AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), "


@query("q_neighbor_sample", NS + "h1 AS (SELECT 1 AS hop, a AS src, b AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY " + order_sql(42, "1", "a", "b") + ", b) AS r FROM u WHERE a IN (SELECT vec_id FROM embeddings WHERE label = 0)) WHERE r <= 4), h2 AS (SELECT 2 AS hop, a AS src, b AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY " + order_sql(42, "2", "a", "b") + ", b) AS r FROM u WHERE a IN (SELECT dst FROM h1)) WHERE r <= 4) SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def neighbor_sample(t: Tables) -> DataFrame:
    """Around the rows of a batch, here those of one label."""
    seeds = t.embeddings.where("label = 0").select(F.col("vec_id").alias("id"))
    return G.neighbour_sample(t.pairs().select("a", "b"), seeds, 2, 4, 42)


@query("q_seed_pairs", f"WITH {PAIRS} SELECT a, b, label FROM pairs WHERE a % 3 = 0 AND b % 3 = 0")
def seed_pairs(t: Tables) -> DataFrame:
    """Pairs of which both rows are in the batch."""
    seeds = t.embeddings.where("vec_id % 3 = 0").select("vec_id")
    p = t.pairs().select("a", "b", "label")
    return p.join(seeds.withColumnRenamed("vec_id", "a"), "a", "left_semi").join(seeds.withColumnRenamed("vec_id", "b"), "b", "left_semi").select("a", "b", "label")


# Evaluation

CURVE = f"WITH {PAIRS}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM pairs GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC))"


@query("q_best_threshold", CURVE + " SELECT score AS threshold, round(2.0::DOUBLE * tp / (tp + fp + pos), 9) AS f1 FROM c ORDER BY 2.0::DOUBLE * tp / (tp + fp + pos) DESC, score LIMIT 1")
def best_threshold(t: Tables) -> DataFrame:
    return E.best_threshold(t.pairs()).select("threshold", F.round("f1", 9).alias("f1"))


PRF = "sum(h * label)::BIGINT AS tp, sum(h * (1 - label))::BIGINT AS fp, sum((1 - h) * label)::BIGINT AS fn"
PRF_OF = "tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1"


@query("q_prf_at_threshold", f"WITH {PAIRS}, h AS (SELECT *, (score >= 0.1)::INT AS h FROM pairs), s AS (SELECT {PRF} FROM h) SELECT {PRF_OF} FROM s")
def prf_at_threshold(t: Tables) -> DataFrame:
    return E.prf(t.pairs(), F.col("score") >= 0.1).withColumn("f1", F.round("f1", 9))


AUC = ", d AS (SELECT *, tp - coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS dt, fp - coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS df FROM c)"


@query("q_roc_auc", CURVE + AUC + " SELECT round(sum(df * (tp - dt / 2.0::DOUBLE)) / (max(pos) * max(neg)), 9) AS roc_auc FROM d")
def roc_auc(t: Tables) -> DataFrame:
    return E.ranking(t.pairs()).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("q_average_precision", CURVE + AUC + " SELECT round(sum(dt * tp / (tp + fp)::DOUBLE) / max(pos), 9) AS average_precision FROM d")
def average_precision(t: Tables) -> DataFrame:
    return E.ranking(t.pairs()).select(F.round("average_precision", 9).alias("average_precision"))


KCURVE = f"WITH {PAIRS}, k AS (SELECT a % 4 AS dataset, score, label FROM pairs), g AS (SELECT dataset, score, sum(label) AS p, sum(1 - label) AS n FROM k GROUP BY 1, 2), c AS (SELECT dataset, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY dataset) AS pos, sum(n) OVER (PARTITION BY dataset) AS neg FROM g WINDOW w AS (PARTITION BY dataset ORDER BY score DESC)), d AS (SELECT *, tp - coalesce(lag(tp) OVER v, 0) AS dt, fp - coalesce(lag(fp) OVER v, 0) AS df FROM c WINDOW v AS (PARTITION BY dataset ORDER BY score DESC))"


@query("q_ranking_by_dataset", KCURVE + " SELECT dataset, round(sum(df * (tp - dt / 2.0::DOUBLE)) / nullif(max(pos) * max(neg), 0), 9) AS roc_auc, round(sum(dt * tp / (tp + fp)::DOUBLE) / nullif(max(pos), 0), 9) AS average_precision FROM d GROUP BY dataset")
def ranking_by_dataset(t: Tables) -> DataFrame:
    r = E.ranking(t.pairs().withColumn("dataset", F.col("a") % 4), ["dataset"])
    return r.select("dataset", F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


@query("q_per_strategy_prf", f"WITH {PAIRS}, h AS (SELECT *, (score >= 0.1)::INT AS h, 's' || b % 3 AS strategy FROM pairs), s AS (SELECT coalesce(strategy, 'all') AS strategy, {PRF} FROM h GROUP BY ROLLUP (strategy)) SELECT strategy, {PRF_OF} FROM s")
def per_strategy_prf(t: Tables) -> DataFrame:
    """Each strategy and all together, from one pass: every pair counts for its strategy and for 'all'."""
    p = t.pairs().withColumn("strategy", F.explode(F.array(F.concat(F.lit("s"), F.col("b") % 3), F.lit("all"))))
    return E.prf(p, F.col("score") >= 0.1, ["strategy"]).withColumn("f1", F.round("f1", 9))


@query("q_pr_curve", CURVE + " SELECT score, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / pos::DOUBLE, 9) AS recall FROM c")
def pr_curve(t: Tables) -> DataFrame:
    c = E.curve(t.pairs())
    return c.select("score", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.col("tp") / F.col("pos"), 9).alias("recall"))


@query("q_roc_curve", CURVE + " SELECT score, round(fp / neg::DOUBLE, 9) AS fpr, round(tp / pos::DOUBLE, 9) AS tpr FROM c")
def roc_curve(t: Tables) -> DataFrame:
    return E.curve(t.pairs()).select("score", F.round(F.col("fp") / F.col("neg"), 9).alias("fpr"), F.round(F.col("tp") / F.col("pos"), 9).alias("tpr"))


CLUSTERS = f"WITH {PAIRS}, c AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE (label + vec_id % 2) % 7 END AS cluster, label AS truth FROM e), q AS (SELECT a, b, pairs.label, (x.cluster = y.cluster AND x.cluster <> -1) AS predicted FROM pairs JOIN c x ON a = x.id JOIN c y ON b = y.id)"


def clusters(t: Tables) -> DataFrame:
    own = F.when(F.col("vec_id") % 10 == 0, -1).otherwise((F.col("label") + F.col("vec_id") % 2) % 7)
    return t.embeddings.select(F.col("vec_id").alias("id"), own.cast("int").alias("cluster"), F.col("label").alias("truth"))


@query("q_cluster_pair_preds", CLUSTERS + " SELECT a, b, predicted FROM q")
def cluster_pair_preds(t: Tables) -> DataFrame:
    return E.same_cluster(t.pairs(), clusters(t)).select("a", "b", "predicted")


@query("q_cluster_metrics", CLUSTERS + f", h AS (SELECT *, predicted::INT AS h FROM q), s AS (SELECT {PRF} FROM h) SELECT {PRF_OF}, (SELECT count(DISTINCT cluster) FROM c WHERE cluster <> -1) AS n_clusters, (SELECT count(*) FROM c WHERE cluster = -1) AS n_noise FROM s")
def cluster_metrics(t: Tables) -> DataFrame:
    c = clusters(t)
    counts = c.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") == -1).alias("n_noise"))
    return E.prf(E.same_cluster(t.pairs(), c), F.col("predicted")).withColumn("f1", F.round("f1", 9)).crossJoin(counts)


@query("q_cluster_fitness", CLUSTERS + f", h AS (SELECT *, predicted::INT AS h FROM q), s AS (SELECT {PRF} FROM h), m AS (SELECT max(n) / (SELECT count(*) FROM c)::DOUBLE AS largest FROM (SELECT count(*) AS n FROM c WHERE cluster <> -1 GROUP BY cluster)), p AS (SELECT tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM s) SELECT round(CASE WHEN p + r = 0 THEN 0 ELSE 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) END * CASE WHEN largest > 0.1 THEN 0.5 ELSE 1 END, 9)::DOUBLE AS fitness, largest FROM p, m")
def cluster_fitness(t: Tables) -> DataFrame:
    """F-beta of pairs, halved if one cluster has too many of the rows."""
    c = clusters(t)
    n = c.groupBy("cluster").agg(F.count("*").alias("n"))
    largest = n.agg((F.max(F.when(F.col("cluster") != -1, F.col("n"))) / F.sum("n")).alias("largest"))
    m = E.prf(E.same_cluster(t.pairs(), c), F.col("predicted")).crossJoin(largest)  # one row each
    fit = E.fbeta(F.col("precision"), F.col("recall"), 0.5) * F.when(F.col("largest") > 0.1, 0.5).otherwise(1.0)
    return m.select(F.round(fit, 9).alias("fitness"), "largest")


TAUS, TOPS = (0.25, 0.3, 0.35), (1, 3, 5)


@query("q_cc_grid", SELF + f", g AS (SELECT tau, top FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in TAUS)}) a(tau), (VALUES {', '.join(f'({x})' for x in TOPS)}) b(top)) SELECT tau, top, count(q) AS n_edges, count(DISTINCT q) AS n_linked FROM g LEFT JOIN nn ON sim >= tau AND rank <= top GROUP BY tau, top")
def cc_grid(t: Tables) -> DataFrame:
    """Every threshold with every number of neighbours, over neighbours that are found once."""
    grid = F.array(*(F.struct(F.lit(x).alias("tau"), F.lit(k).alias("top")) for x in TAUS for k in TOPS))
    n = self_neighbours(t).select("q", "sim", "rank", F.explode(grid).alias("g")).where((F.col("sim") >= F.col("g.tau")) & (F.col("rank") <= F.col("g.top")))
    got = n.groupBy("g.tau", "g.top").agg(F.count("*").alias("n_edges"), F.count_distinct("q").alias("n_linked"))
    every = t.spark.range(1).select(F.inline(grid))
    return every.join(got, ["tau", "top"], "left").select("tau", "top", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def near(t: Tables, k: int = 5) -> DataFrame:
    return stored(D.ranked(self_neighbours(t, k).select("q", "i", "sim")))


@query("q_ga_history")
def ga_history(t: Tables) -> DataFrame:
    """Genetic search for the parameters of density clusters; a row for each generation. The query takes ten generations, the operator 25 unless told."""
    found = D.genetic_search(near(t), t.pairs().select("a", "b", "label"), t.embeddings.count(), generations=10)
    rows = [(g, *p[:3], bool(p[3]), bool(p[4]), best, mean) for g, p, best, mean in found]
    return t.spark.createDataFrame(rows, "generation int, smallest int, samples int, epsilon double, leaf boolean, whole boolean, best double, mean double")


@query("q_hdbscan")
def hdbscan(t: Tables) -> DataFrame:
    """Clusters of the density hierarchy on each row's 15 nearest, by the least id; -1 for noise."""
    return D.hdbscan(near(t, 15), t.embeddings.select(F.col("vec_id").alias("id")), D.Params(smallest=5, samples=5))


@query("q_threshold_transfer", f"WITH {PAIRS}, v AS (SELECT * FROM pairs WHERE a % 3 = 1), g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM v GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos FROM g WINDOW w AS (ORDER BY score DESC)), b AS (SELECT score AS threshold FROM c ORDER BY 2.0::DOUBLE * tp / (tp + fp + pos) DESC, score LIMIT 1), h AS (SELECT 'd' || b % 2 AS dataset, label, (score >= threshold)::INT AS h FROM pairs p, b WHERE p.a % 3 = 2), s AS (SELECT dataset, {PRF} FROM h GROUP BY dataset) SELECT dataset, {PRF_OF} FROM s".replace("'d' || b % 2", "'d' || p.b % 2"))
def threshold_transfer(t: Tables) -> DataFrame:
    """The best threshold of the validation pairs, applied to the test pairs of each dataset."""
    p = t.pairs()
    best = E.best_threshold(p.where("a % 3 = 1")).select("threshold")
    test = p.where("a % 3 = 2").withColumn("dataset", F.concat(F.lit("d"), F.col("b") % 2)).crossJoin(F.broadcast(best))  # one row
    return E.prf(test, F.col("score") >= F.col("threshold"), ["dataset"]).withColumn("f1", F.round("f1", 9))


@query("q_metric_pivot", "SELECT o_orderpriority AS model, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS F, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS O, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS P FROM orders GROUP BY 1")
def metric_pivot(t: Tables) -> DataFrame:
    w = t.orders.groupBy(F.col("o_orderpriority").alias("model")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return w.select("model", *(F.round(c, 4).alias(c) for c in "FOP"))


@query("q_sample_matches", f"WITH {AB}, s AS (SELECT vec_id FROM b ORDER BY {order_sql(42, 'vec_id')}, vec_id LIMIT 30), nn AS {knn_sql(3, swap=True)}, base AS (SELECT b.vec_id AS q, a.vec_id AS i, row_number() OVER (PARTITION BY b.vec_id ORDER BY list_dot_product(a.v[1:8], b.v[1:8]) DESC, a.vec_id) AS rank FROM a, b QUALIFY rank <= 3) SELECT 'model' AS method, q, i, rank FROM nn WHERE q IN (SELECT vec_id FROM s) UNION ALL SELECT 'baseline', q, i, rank FROM base WHERE q IN (SELECT vec_id FROM s)")
def sample_matches(t: Tables) -> DataFrame:
    """For some queries, the best three of two methods: whole vectors, and their first dimensions."""
    a, b = sides(t)
    some = b.orderBy(order_key(42, F.col("vec_id")), "vec_id").limit(30)
    head = lambda d: d.select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("embedding"))
    model = similar(some, a, k=3).select(F.lit("model").alias("method"), "q", "i", "rank")
    return model.union(similar(head(some), head(a), k=3).select(F.lit("baseline"), "q", "i", "rank"))


@query("q_unsupervised_eval", f"WITH {AB}, x AS {knn_sql(2)}, y AS {knn_sql(1, swap=True)}, g AS (SELECT q, max(CASE WHEN rank = 1 THEN sim END) AS top, max(CASE WHEN rank = 1 THEN sim END) - max(CASE WHEN rank = 2 THEN sim END) AS gap FROM x GROUP BY q) SELECT round((SELECT avg(top) FROM g), 6) AS top, round((SELECT avg(gap) FROM g), 6) AS gap, (SELECT count(*) FROM x JOIN y ON x.q = y.i AND x.i = y.q WHERE x.rank = 1) / (SELECT count(*) FROM a)::DOUBLE AS reciprocal, (SELECT avg((p.label = o.label)::INT) FROM x JOIN a p ON x.q = p.vec_id JOIN b o ON x.i = o.vec_id WHERE rank = 1) AS consistency")
def unsupervised_eval(t: Tables) -> DataFrame:
    a, b = sides(t)
    x = similar(a, b, k=2)
    back = similar(b, a, k=1).select(F.col("i").alias("q"), F.col("q").alias("i"), F.lit(1).alias("back"))
    first = x.where("rank = 1").join(back, ["q", "i"], "left").join(a.select(F.col("vec_id").alias("q"), F.col("label").alias("lq")), "q").join(b.select(F.col("vec_id").alias("i"), F.col("label").alias("li")), "i")
    second = x.where("rank = 2").select("q", F.col("sim").alias("sim2"))
    j = first.join(second, "q", "left")
    return j.agg(F.round(F.avg("sim"), 6).alias("top"), F.round(F.avg(F.col("sim") - F.col("sim2")), 6).alias("gap"), (F.count("back") / F.count("*")).alias("reciprocal"), F.avg((F.col("lq") == F.col("li")).cast("int")).alias("consistency"))


@query("q_cluster_coverage", CLUSTERS + " SELECT sum((cluster <> -1)::INT) / count(*)::DOUBLE AS coverage, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, sum((cluster = -1)::INT) / count(*)::DOUBLE AS noise FROM c")
def cluster_coverage(t: Tables) -> DataFrame:
    inside = F.col("cluster") != -1
    return clusters(t).agg((F.count_if(inside) / F.count("*")).alias("coverage"), F.count_distinct(F.when(inside, F.col("cluster"))).alias("n_clusters"), (F.count_if(~inside) / F.count("*")).alias("noise"))


ARI = ", k AS (SELECT cluster, truth, count(*) AS n FROM c WHERE cluster <> -1 GROUP BY 1, 2), ra AS (SELECT sum(n) AS n FROM k GROUP BY cluster), rb AS (SELECT sum(n) AS n FROM k GROUP BY truth), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM k) AS xp, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM ra) AS ap, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM rb) AS bp, (SELECT sum(n * ln(n)) FROM k) AS xl, (SELECT sum(n * ln(n)) FROM ra) AS al, (SELECT sum(n * ln(n)) FROM rb) AS bl, (SELECT sum(n) FROM k)::DOUBLE AS n)"


@query("q_cluster_ari_nmi", CLUSTERS + ARI + " SELECT round((xp - ap * bp / (n * (n - 1) / 2)) / ((ap + bp) / 2 - ap * bp / (n * (n - 1) / 2)), 9) AS ari, round(2 * (ln(n) + (xl - al - bl) / n) / (2 * ln(n) - (al + bl) / n), 9) AS nmi FROM s")
def cluster_ari_nmi(t: Tables) -> DataFrame:
    return E.ari_nmi(clusters(t).where("cluster <> -1")).select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


# Models

VEC = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("q_schema_triplets", "WITH c AS (SELECT n_name AS col, n_regionkey AS r, n_nationkey AS k FROM nation), g AS (SELECT x.col AS x, y.col AS y FROM c x JOIN c y ON x.r = y.r AND x.k < y.k), s AS (SELECT x, y FROM g UNION SELECT y, x FROM g) SELECT x AS anchor, y AS positive, col AS negative FROM g, c WHERE col <> x AND col <> y AND (x, col) NOT IN (SELECT (x, y) FROM s)")
def schema_triplets(t: Tables) -> DataFrame:
    """For each pair of columns that belong together, all columns that are no partner of the first. Columns are few; nations of a region stand for them."""
    c = t.nation.select(F.col("n_name").alias("negative"))
    x, y = t.nation.select("n_regionkey", F.col("n_nationkey").alias("x"), F.col("n_name").alias("anchor")), t.nation.select("n_regionkey", F.col("n_nationkey").alias("y"), F.col("n_name").alias("positive"))
    g = x.join(y, "n_regionkey").where("x < y").select("anchor", "positive")
    closure = g.union(g.select("positive", "anchor")).distinct().toDF("anchor", "negative")
    return g.join(c, (F.col("negative") != F.col("anchor")) & (F.col("negative") != F.col("positive"))).join(closure, ["anchor", "negative"], "left_anti").select("anchor", "positive", "negative")


@query("q_message_passing", f"WITH {PAIRS}, m AS (SELECT b AS dst, unnest(range(1, 65)) AS i, v FROM pairs JOIN e ON a = vec_id), d AS (SELECT dst, i, avg(v[i]) AS x FROM m GROUP BY 1, 2) SELECT dst, round(sum(x), 6) AS total, round(max(CASE WHEN i = 1 THEN x END), 6) AS first FROM d GROUP BY dst")
def message_passing(t: Tables) -> DataFrame:
    edges_ = t.pairs().select(F.col("a").alias("src"), F.col("b").alias("dst"))
    m = L.mean_message(edges_, vectors(t), 64)
    return m.select("dst", F.round(F.aggregate("message", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("message", F.lit(0)), 6).alias("first"))


@query("q_edge_softmax", f"WITH {PAIRS}, m AS (SELECT a, b, exp(5 * score - max(5 * score) OVER (PARTITION BY b)) AS x FROM pairs) SELECT a AS src, b AS dst, round(x / sum(x) OVER (PARTITION BY b), 9) AS weight FROM m")
def edge_softmax(t: Tables) -> DataFrame:
    e = t.pairs().select(F.col("a").alias("src"), F.col("b").alias("dst"), "score")
    return L.edge_softmax(e, 5 * F.col("score")).select("src", "dst", F.round("weight", 9).alias("weight"))


TRIP = f"WITH {PAIRS}, n AS (SELECT count(*) AS n FROM e), t AS (SELECT a, b AS p, (a * 13 + b * 7 + 1) % n AS n FROM pairs, n WHERE label = 1), d AS (SELECT t.*, sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i] + 1e-6) ** 2))) AS d_ap, sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - z.v[i] + 1e-6) ** 2))) AS d_an FROM t JOIN e x ON t.a = x.vec_id JOIN e y ON t.p = y.vec_id JOIN e z ON t.n = z.vec_id)"


def triplets(t: Tables) -> DataFrame:
    n = t.embeddings.agg(F.count("*").alias("k"))
    p = t.pairs().where("label = 1").crossJoin(F.broadcast(n))  # one row
    return p.select("a", F.col("b").alias("p"), ((F.col("a") * 13 + F.col("b") * 7 + 1) % F.col("k")).alias("n"))


@query("q_triplet_loss", TRIP + " SELECT round(avg(greatest(d_ap - d_an + 0.3, 0)), 9) AS loss, count(*) AS n FROM d")
def triplet_loss(t: Tables) -> DataFrame:
    return L.triplet_loss(triplets(t), vectors(t)).withColumn("loss", F.round("loss", 9))


@query("q_semi_hard", TRIP + ", q AS (SELECT a, p, n, d_ap * d_ap AS d_ap, d_an * d_an AS d_an FROM d), s AS (SELECT *, d_an > d_ap AND d_an < d_ap + 0.1 AS sh, d_an <= d_ap AS hard FROM q), c AS (SELECT count(*) AS k, sum(sh::INT) AS m, sum(hard::INT) AS h FROM s) SELECT a, p, n FROM s, c WHERE CASE WHEN m >= greatest(1, k // 4) THEN sh WHEN m + h > 0 THEN sh OR hard ELSE TRUE END")
def semi_hard(t: Tables) -> DataFrame:
    d = L.triplet_distances(triplets(t), vectors(t))
    squared = d.select("a", "p", "n", (F.col("d_ap") * F.col("d_ap")).alias("d_ap"), (F.col("d_an") * F.col("d_an")).alias("d_an"))
    return L.semi_hard(squared, 0.1).select("a", "p", "n")


@query("q_nt_xent", f"WITH {PAIRS}, p AS (SELECT a, b FROM pairs WHERE label = 1 UNION ALL SELECT b, a FROM pairs WHERE label = 1), z AS (SELECT y.vec_id AS a, ln(sum(exp(list_dot_product(x.v, y.v) / 0.1))) AS total FROM e y JOIN e x ON x.vec_id <> y.vec_id GROUP BY 1), l AS (SELECT total - list_dot_product(x.v, y.v) / 0.1 AS l FROM p JOIN z ON z.a = p.a JOIN e x ON x.vec_id = p.a JOIN e y ON y.vec_id = p.b) SELECT round(avg(l), 6) AS loss, count(*) AS n FROM l")
def nt_xent(t: Tables) -> DataFrame:
    """-log softmax of the positive among all other rows, both ways round. Blocks give sums, so no pair leaves them."""
    p = t.pairs().where("label = 1").select("a", "b")
    both = p.union(p.select("b", "a"))
    total = log_sum_exp(t.embeddings, 0.1).withColumnRenamed("q", "a")
    own = pair_scores(both, t.embeddings).join(total, "a")
    return own.agg(F.round(F.avg(F.col("total") - F.col("score") / 0.1), 6).alias("loss"), F.count("*").alias("n"))


@query("q_hardest_negative", f"WITH {VEC}, s AS (SELECT x.id AS anchor, y.id AS negative, list_dot_product(x.v, y.v) AS sim FROM e x JOIN e y ON x.label <> y.label) SELECT anchor, arg_max(negative, (sim, -negative)) AS negative FROM s GROUP BY anchor")
def hardest_negative(t: Tables) -> DataFrame:
    """The nearest row of another label. Vectors have length one, so nearest is most similar."""
    return best_of_other_label(t.embeddings, t.embeddings).select(F.col("q").alias("anchor"), F.col("i").alias("negative"))


@query("q_lr_schedule", f"WITH {HISTORY}, h AS (SELECT user, epoch - 1 AS step, count(*) OVER (PARTITION BY user) AS total FROM history), w AS (SELECT *, greatest(1, total // 10) AS warm FROM h) SELECT user, step, round(CASE WHEN step < warm THEN 0.001::DOUBLE * step / warm ELSE 0.001::DOUBLE * 0.5 * (1 + cos(pi() * least((step - warm) / greatest(1, total - warm)::DOUBLE, 1))) END, 12) AS lr FROM w")
def lr_schedule(t: Tables) -> DataFrame:
    """The rate of each epoch of each training history: up for a tenth of its epochs, then down as a cosine."""
    h = t.history.select("user", (F.col("epoch") - 1).cast("long").alias("step"), F.count("*").over(W.partitionBy("user")).alias("total"))
    rate = L.learning_rate(F.col("step"), 0.001, F.greatest(F.lit(1), F.floor(F.col("total") / 10)), F.col("total"))
    return h.select("user", "step", F.round(rate, 12).alias("lr"))


def part_graph(t: Tables) -> tuple[T.Graph, DataFrame]:
    """Parts with their words as tokens, and pairs of parts of one type. Rows know nothing of themselves, tokens are hashed words, columns hashed names."""
    cells = C.to_cells(t.parts.select("id", "name", "brand", "type", "size"))
    edges = stored(G.build_edges(cells, t.parts.count(), 0.5).select(F.col("id").alias("dst"), F.col("tok").alias("src"), "col"))
    token = embed(edges.select("src").distinct(), "src", "src", dims=32).select("id", F.col("embedding").alias("v"))
    columns = embed(edges.select("col").distinct(), "col", "col", dims=8).select("id", F.col("embedding").alias("v"))
    rows = t.parts.select("id", F.array(*(F.lit(1.0) if i == 0 else u01(7 + i, F.col("id")) - 0.5 for i in range(4))).alias("v"))
    typed = t.parts.where("type is not null").select("id", "type", F.lead("id").over(W.partitionBy("type").orderBy("id")).alias("b"))
    return T.Graph(rows, stored(token), stored(columns), edges), typed.where("b is not null").select(F.col("id").alias("a"), "b")


@query("q_train_matcher")
def train_matcher(t: Tables) -> DataFrame:
    """A row matcher of each kind, trained through its layers on three quarters of the pairs: loss of the other quarter before and after, and average precision of theirs among as many others."""
    graph, pairs = part_graph(t)
    pairs = stored(pairs.withColumn("u", u01(3, F.col("a"), F.col("b"))))
    train, held = pairs.where("u < 0.75").select("a", "b"), stored(pairs.where("u >= 0.75").select("a", "b"))
    n = graph.rows.count()
    others = held.select("a", (F.pmod(F.xxhash64("a", "b"), F.lit(n)) + 1).alias("b"), F.lit(0).alias("label"))
    judged = stored(held.select("a", "b", F.lit(1).alias("label")).union(others))
    config = T.TrainConfig(epochs=4, batch=256, blocks=2, rate=0.01)
    scratch = Scratch(t.spark, "blocks")
    made = T.made_blocks([(graph, train)], config, [(graph, held)], scratch)

    def trained(kind: str) -> tuple:
        model = T.RowModel(graph.shape(kind=kind, hidden=16, edge=8, output=16, heads=2), 5)

        def precision() -> float:
            own = Scratch(t.spark, "embeddings")
            v = model.embeddings(graph, own)
            out = E.ranking(pair_scores(judged, v, id_col="id", vec_col="v")).first()["average_precision"] or 0.0
            own.close()
            return out

        before = precision()
        history = model.fit([(graph, train)], config, [(graph, held)], made=made)
        return kind, len(history), history[0]["valid"], min(h["valid"] for h in history), before, precision()

    kinds = ("mean", "attention")  # neither waits for the other's steps
    with ThreadPoolExecutor(len(kinds)) as pool:
        out = [f.result() for f in [pool.submit(inheritable_thread_target(t.spark)(trained), k) for k in kinds]]
    scratch.close()
    return t.spark.createDataFrame(out, "kind string, epochs int, first_loss double, best_loss double, precision_before double, precision_after double")
