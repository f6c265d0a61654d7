"""Quality classifier: a document's own evidence and its site's record, combined by hierarchical empirical Bayes.

Evidence: logistic regression on shape features of the whole text (words, symbols, capitals, repeats ...), fitted on at
most `sample` labelled rows, the first by a hash of their id. Site record: the mean probability of the other documents of the path, shrunk towards that
of the host, which is shrunk towards the corpus: (sum + kappa * prior) / (n + kappa). kappa, how many documents a prior is
worth, comes from the data by the method of moments: the more sites differ beyond sampling, the smaller it is, and a site
with few documents follows its parent. All of it is grouped aggregation of sums. The posterior log-odds are the
document's, less those of the labelled rows, plus those of the path.

Defined results: a null or empty text has all features at zero; null hosts and paths are sites of their own, named '';
labels that are null or not 0 or 1 are ignored; without labels of both kinds the evidence is neutral and every quality is
the site's; a document counts once for each row that repeats it; a null doc_id is judged and matches no label; an empty
table gives an empty result; only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, quoted, text_or_empty
from quernstone.llm.quality_rules import metric, with_part

#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE = 20_000
RIDGE, ROUNDS = 0.01, 40
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "duplicate_lines", "exclamations", "different_words")
LEAST = 1e-4
#: Sites up to which their table is broadcast; beyond, it is joined by key.
BROADCAST_SITES = 50_000


def features(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, features array<double>) of each row."""
    names = {k: k for k in ("text", "words", "lines")}
    base = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), text_or_empty(text_col).alias("text"))
    parts = with_part(base, names, ["words", "lines"])
    text, n = F.col("text"), F.greatest(metric(names, "n_words"), F.lit(1))
    chars, lines = F.greatest(F.length(text), F.lit(1)), F.greatest(metric(names, "n_lines"), F.lit(1))
    values = [
        F.log1p(metric(names, "n_words").cast("double")),
        metric(names, "word_chars") / n / 10,
        metric(names, "n_symbols") / n,
        F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        F.regexp_count(text, F.lit("[0-9]")) / chars,
        metric(names, "n_dup_lines") / lines,
        F.regexp_count(text, F.lit("!")) / n,
        F.size(F.array_distinct("words")) / n,
    ]
    return parts.select("doc_id", "host", "path", F.array(*(v.cast("double") for v in values)).alias("features"))


def fitted(rows: list[tuple[list[float], int]]) -> tuple[list[float], float]:
    """Weights (the constant first) for raw features, and the share of good rows; zeros if only one kind is there."""
    if len({y for _, y in rows}) < 2:
        return [0.0] * (len(FEATURES) + 1), 0.5
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    b = np.zeros(z.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        b += np.linalg.solve((z * w[:, None]).T @ z + RIDGE * np.eye(len(b)), z.T @ (y - p) - RIDGE * b)
    raw = b[1:] / spread
    return [float(b[0] - raw @ mean), *map(float, raw)], float(y.mean())


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(p / (1 - p))


def kappa(sites: DataFrame, prior: Column) -> float:
    """What a prior is worth in documents: the variance of probabilities inside sites over that between sites. sites: (n, s, q), documents and sums of
    their probabilities and of these squared, and what prior needs.

    Inside: sums of squares about each site's mean, by their degrees of freedom. If every site is a single document the spread of all counts as inside.
    """
    m = F.col("s") / F.col("n")
    inside = F.greatest(F.col("q") - F.col("s") * m, F.lit(0.0))
    sums = sites.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * (m - prior) ** 2).alias("v"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(inside).alias("i")).first()
    if not sums["n"]:
        return 1.0
    free = sums["n"] - sums["g"]
    within = sums["i"] / free if free else max(sums["q"] / sums["n"] - (sums["s"] / sums["n"]) ** 2, 0.0)
    between = max((sums["v"] - sums["g"] * within) / sums["n"], 1e-6)
    return min(max(within / between, 1.0), 10_000.0)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, kept) of each row: log-odds, the site's shrunk rates without the row, posterior, verdict."""
    made = checkpointed(features(docs, id_col, text_col, host, path))
    good = labels.select(quoted(label_id).cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"), F.col("y"), F.col("features")]
    taught = made.join(good, "doc_id").orderBy(*order).limit(sample).select("features", "y").collect()  # `sample` rows of eight numbers at most
    weights, rate = fitted([(r["features"], r["y"]) for r in taught])
    evidence = sum((F.lit(w) * F.get("features", F.lit(i)) for i, w in enumerate(weights[1:])), F.lit(weights[0]))
    scored = made.select("doc_id", "host", "path", F.least(F.greatest(evidence, F.lit(-12.0)), F.lit(12.0)).alias("evidence"))
    scored = checkpointed(scored.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = (total["s"] / total["n"]) if total["n"] else 0.5
    k_host = kappa(hosts, F.lit(prior))
    shrunk = (F.col("s") + k_host * prior) / (F.col("n") + k_host)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), shrunk.alias("host_shrunk"))
    few = paths.count() <= BROADCAST_SITES
    sites = paths.join(F.broadcast(hosts) if few else hosts, "host")
    k_path = kappa(sites, F.col("host_shrunk"))
    sites = sites.select("host", "path", "n", "s", "host_n", "host_s")
    joined = scored.join(F.broadcast(sites) if few else sites, ["host", "path"])
    host_rate = (F.col("host_s") - F.col("p") + k_host * prior) / (F.col("host_n") - 1 + k_host)
    path_rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    joined = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    posterior = F.col("evidence") - log_odds(F.lit(rate)) + log_odds(F.col("path_rate"))
    joined = joined.withColumn("quality", 1 / (1 + F.exp(-posterior)))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("kept"))
