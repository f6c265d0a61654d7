"""Operators on literal inputs, invariants of hashed choices, awkward values."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import providers
from quernstone.functions import text as T
from quernstone.operators import cells as C
from quernstone.operators import evaluate as E
from quernstone.operators import graph as G
from quernstone.operators import models
from quernstone.operators import neighbours as N
from quernstone.operators.neighbours import similar
from quernstone.operators.ranking import hash_ranked, numbered
from quernstone.sources import registry
from quernstone.sources import tables as S
from quernstone.streaming.incremental import label_stream


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("given,want", [("2014", "'14"), ("  2014  ", "'14"), ("1234.5", "1,234.5"), ("42", "42"), ("hello", "hello"), (" 7 ", "7"), ("99999", "99,999.0")])
def test_change_format(spark, given, want):
    assert one(spark, T.change_format(F.lit(given))) == want


def test_typos_and_lost_words(spark):
    typo = lambda s, p: one(spark, T.add_typo(F.lit(s), p, 1, F.lit(3)))
    assert typo("", 1.0) == "" and typo("a", 1.0) == "a" and typo("abcd", 0.0) == "abcd" and typo("abcd", 1.0) == "badc" and sorted(typo("abcdef", 0.5)) == list("abcdef")
    drop = lambda s, p: one(spark, T.drop_tokens(F.lit(s), p, 1, F.lit(3)))
    assert drop("word", 1.0) == "word" and drop("a b c", 1.0) == "a" and drop("a b c", 0.0) == "a b c" and set(drop("a b c d", 0.5).split()) <= set("abcd")


def test_serialize(spark):
    df = spark.createDataFrame([(1, "iPhone", None), (2, None, " ")], "id long, title string, brand string")
    assert [r.x for r in df.select(T.serialize_row(["title", "brand"]).alias("x")).collect()] == ["title: iPhone", ""]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# metadata line\nid,val\n1,a\n2,b\n3,c,too,many\n4\n", encoding="latin-1")
    got = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "val"] and sorted((r.id, r.val) for r in got.collect()) == [(1, "a"), (2, "b"), (4, None)]


def test_conventions(spark, tmp_path):
    assert [S.id_column(c) for c in (["id", "val"], ["_id", "val"], ["my_key", "val"])] == ["id", "_id", "my_key"]
    labels = spark.createDataFrame([("0", "1", 1)], ["ltable.id", "rtable.id", "gold"])
    assert S.normalize_labels(labels).columns == ["ltable_id", "rtable_id", "label"]
    with pytest.raises(ValueError):
        registry.Registry().get("none")
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    S.write_dataset(S.ERDataset(a, a, None, {s: labels.toDF("l", "r", "label") for s in ("train", "valid", "test")}), str(tmp_path / "d"))
    assert S.load_dataset(spark, str(tmp_path / "d")).splits["valid"].count() == 1


@pytest.mark.parametrize("n", [1, 2, 10, 103])
def test_exact_split(spark, n):
    got = {r.split: r.n for r in S.split_exact(spark.range(n), (0.1, 0.2), 1, F.col("id")).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == n and got["test"] == max(1, int(n * 0.2)) and got.get("valid", 0) == min(max(1, int(n * 0.1)), n - got["test"])


def test_global_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(200)], "k long, i long")
    assert [r.row_idx for r in numbered(df, "k", F.col("i")).orderBy("k", "i").collect()] == list(range(200))
    assert sorted(r.hash_rank for r in hash_ranked(df, 1, F.col("i")).collect()) == list(range(200))


def test_components_and_split(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), *((100 + i, 101 + i) for i in range(40))], "a long, b long")
    got = {r.id: r.component for r in G.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 7, **{100 + i: 100 for i in range(41)}}
    assert G.greedy_split([(1, 6), (2, 2), (3, 2)], (0.6, 0.2, 0.2), 10) == {1: 0, 2: 1, 3: 2}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for block in (7, 2048):
        got = {(r.q, r["rank"]): r.i for r in similar(df, df, k=3, other=True, block=block).collect()}
        assert got == {(q, k + 1): int(i) for q in range(50) for k, i in enumerate(np.argsort(-s[q])[:3])}


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.4, 1), (0.1, 0)], "score double, label int")
    r = E.ranking(df).first()
    assert r.roc_auc == pytest.approx(4.5 / 6) and r.average_precision == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    assert tuple(E.best_threshold(df).first()) == (0.4, pytest.approx(6 / 7))
    assert tuple(E.best_threshold(df.where("label = 1")).first()) == (0.5, 0.0)
    assert E.prf(df.where("score > 1"), F.col("score") > 0).first().f1 in (0, None)
    same = spark.createDataFrame([(0, 0), (0, 0), (1, 1)], "cluster int, truth int")
    assert tuple(E.ari_nmi(same).first()) == (1.0, pytest.approx(1.0))


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 16))
    x[3:] = x[:3] + 0.1 * rng.normal(size=(3, 16))
    triplets = np.array([(i, i + 3, (i + 1) % 3 + 3) for i in range(3)])
    m = models.SchemaProjector(16)
    before = m.loss(x, triplets)
    assert m.fit(x, triplets)[-1] <= before and np.allclose(np.linalg.norm(m(x), axis=1), 1)
    with pytest.raises(ValueError):
        m.fit(x, np.empty((0, 3), int))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    pairs = spark.createDataFrame([(i, j, int(j - i == 3)) for i in range(3) for j in range(3, 6)], "a long, b long, label int")
    scored = models.classify_pairs(models.fit_pair_classifier(pairs, v), pairs, v).collect()
    assert min(r.score for r in scored if r.label) > max(r.score for r in scored if not r.label)
    edges = spark.createDataFrame([(0, 1), (2, 1)], "src long, dst long")
    got = {r.id: r.v for r in models.graph_layer(edges, v, np.eye(16)).collect()}
    want = x[1] + (x[0] + x[2]) / 2
    assert np.allclose(got[1], want / np.linalg.norm(want)) and np.allclose(got[0], x[0] / np.linalg.norm(x[0]))


def test_providers(spark):
    df = spark.createDataFrame([(1, "red car"), (2, " "), (3, None)], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in providers.embed(df, "id", "text").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-9 and not got[2].any() and not got[3].any()
    replies = providers.ask_model(df.na.fill(""), "id", "text", lambda p: p.upper()).collect()
    assert {r.id: r.reply for r in replies} == {1: "RED CAR", 2: " ", 3: ""}


def test_labels_resume(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 2)], "spec long, nom long")
    pairs.write.parquet(src)
    for k in range(2):
        label_stream(spark, src, pairs.schema, out, str(tmp_path / f"c{k}"), lambda d: d.withColumn("label", F.lit(1))).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_python_literals_as_json(spark):
    cases = {"{'a': \"it's\", 'b': None}": {"a": "it's", "b": None}, "(1, 'True')": [1, "True"], "[1, {'x': False}]": [1, {"x": False}], '{"a": "None"}': {"a": "None"}, "word": None, "{broken": None, "__import__('os')": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.parse_flex(F.col("s")).alias("j")).collect()
    assert {r.s: r.j and json.loads(r.j) for r in rows} == cases


def test_a_long_path_is_one_component_soon(spark):
    path = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(9000, 9001), (9100, 9100)], "a long, b long"))
    began = time.time()
    got = G.connected_components(path)
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, 3001), (9000, 2), (9100, 1)]
    assert time.time() - began < 60


def test_small_components_go_by_hash(spark):
    pairs = spark.createDataFrame([(10 * c, 10 * c + k, 1) for c in range(200) for k in (1, 2)], "a long, b long, label int")
    split = G.component_split(pairs, G.connected_components(pairs), (0.6, 0.2, 0.2), 42, placed=5)
    assert split.groupBy("a").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 400 and sizes.keys() == {0, 1, 2} and 180 < sizes[0] < 300


def test_cells_find_the_neighbours(spark):
    """Recall against the exact path."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = {(r.q, r.i) for r in N.similar(v, v, k=5, other=True).collect()}
    got = {(r.q, r.i) for r in N.CellIndex(v, cells=8, probes=6).search(v, 5, other=True).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_classified_columns(spark):
    df = spark.createDataFrame([(i, f"u{i}", ["a", "b", "c"][i % 3], "word " * 30 + str(i % 4), i * 0.5, [i], i % 2 == 0, None) for i in range(40)], "id int, code string, kind string, long string, price double, tags array<int>, flag boolean, empty string")
    assert {r.col: r.kind for r in C.classify_columns(df).collect()} == {"code": "id_like", "kind": "categorical", "long": "text", "price": "numeric", "tags": "list_dict", "flag": "binary", "empty": "constant"}


def test_blocks_that_meet_once_and_exclude(spark):
    """Neighbours over many small blocks, those of an equal label left out, and sums over blocks that meet once: against the whole product."""
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (90, 4)) / 4.0  # many ties
    v[7] *= 400  # far over the others: sums by row and by column
    label = [None if i % 11 == 0 else i % 5 for i in range(90)]
    df = spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(90)], "vec_id long, embedding array<double>, label long")
    found = N.similar(df, df, k=3, block=8, unequal="label")
    got = sorted((r.q, r["rank"], r.i, r.sim) for r in found.collect())
    sims = v @ v.T
    want = []
    for q in range(90):
        free = sorted((-sims[q, i], i) for i in range(90) if label[q] is None or label[q] != label[i])[:3]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(free, 1)]
    assert got == want
    totals = {r.q: r.total for r in N.log_sum_exp(df, 0.5, block=8).collect()}
    z = sims / 0.5
    np.fill_diagonal(z, -np.inf)
    top = z.max(axis=1)
    assert np.allclose([totals[q] for q in range(90)], top + np.log(np.exp(z - top[:, None]).sum(axis=1)), rtol=1e-12)


def test_neighbours_leave_less_behind(spark):
    """A block of queries that has met others lets only products through that can still be among its best."""
    rng = np.random.default_rng(5)
    chooser, q, a = N.Chooser(5, None, False), np.arange(200), rng.normal(size=(200, 8))
    rows = [len(chooser(q, np.arange(200) + 200 * j, a @ rng.normal(size=(200, 8)).T, q, q)) for j in range(20)]
    assert rows[0] == 1000 and rows[-1] < 200


def test_quantiles_of_many_equal_values(spark):
    """Equal values are ranked as one row, so few values in a large table are few rows in the ranges."""
    from quernstone.operators import ranking

    df = spark.range(30_000).select((F.col("id") % 7).cast("double").alias("v")).union(spark.createDataFrame([(None,), (9.5,)], "v double"))
    seen, kept = [], ranking.ranged
    ranking.ranged = lambda d, *order: seen.append(d.count()) or kept(d, *order)
    try:
        got = ranking.quantiles(df, "v", [0.0, 0.25, 0.5, 0.999, 1.0])
    finally:
        ranking.ranged = kept
    assert np.allclose(got, np.quantile([i % 7 for i in range(30_000)] + [9.5], [0.0, 0.25, 0.5, 0.999, 1.0])) and seen == [8]
    assert ranking.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_numbers_by_their_binary_value(spark):
    """0.0005 is over itself in binary; a zero from below keeps its sign."""
    values = [0.0005, -0.0005, 0.0015, 0.0625, -0.0, -1e-9, 0.1235, 1.0, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", T.fixed(F.col("v"), 3).alias("s")).collect()
    assert [r.s for r in sorted(got)] == ["0.001", "-0.001", "0.002", "0.062", "-0.000", "-0.000", "0.123", "1.000", None]


def test_cells_are_cut_before_their_tokens_are_rows(spark):
    """The first tokens of a cell by hash, of repeated ids too; no more than the cap of a cell are exchanged."""
    cells = spark.createDataFrame([(i % 6, "c", " ".join(f"w{(i * 7 + j) % 40}" for j in range(30))) for i in range(9)] + [(7, "c", None), (8, "c", "")], "id long, col string, val string")
    got = C.capped_cells(cells, 4, 42)
    assert sorted(got.collect()) == sorted(C.capped(C.tokens_of(cells), 4, 42).select("id", "col", "tok").collect())
    assert cells.select(F.explode(C.first_tokens(F.array_distinct(F.split("val", " ")), 4, 42))).count() <= 4 * 10


def test_row_frequency_counts_rows(spark):
    cells = spark.createDataFrame([(1, "a", "x y x"), (1, "b", "y z"), (2, "a", "y"), (2, "a", "q y"), (3, "b", None)], "id long, col string, val string")
    assert {r.tok: r.df for r in G.row_frequency(G.token_lists(cells)).collect()} == {r.tok: r.df for r in G.token_frequency(C.tokens_of(cells)).collect()}
    kept = spark.createDataFrame([("y",)], "tok string")
    assert sorted(G.only_kept(C.tokens_of(cells).select("id", "tok"), kept, 0).collect()) == sorted(G.only_kept(C.tokens_of(cells).select("id", "tok"), kept).collect())


def test_edges_come_from_whole_texts(spark):
    words = " ".join(f"w{i}" for i in range(2048))
    cells = spark.createDataFrame([(1, "text", f"{words} late"), (2, "text", "late"), (3, "text", "other")], "id long, col string, val string")
    assert {(r.id, r.tok) for r in G.build_edges(cells, 3, 0.9, 2).collect()} == {(1, "late"), (2, "late")}


def test_the_cap_of_a_cell_is_over_its_whole_text(spark):
    words = [f"w{i}" for i in range(2100)]
    cells = spark.createDataFrame([(1, "text", " ".join(words))], "id long, col string, val string")
    assert {r.tok for r in C.capped_cells(cells, 2100, 42).collect()} == set(words)


def test_a_task_gives_the_best_of_its_blocks_once(spark):
    """k rows of a query from all blocks that its task has, by double products though floats come first: near ties under a float's digits, equal vectors, very long ones, a threshold."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 16))
    v[300:400] = v[100] + 1e-9 * rng.normal(size=(100, 16))
    v[500:520] = v[7]
    for scale, kind in ((1.0, "double"), (1e25, "double"), (1.0, "float")):
        x = (v * scale).astype(np.float32).astype(float) if kind == "float" else v * scale
        sims = np.zeros((700, 700))
        for d in range(16):
            sims += np.outer(x[:, d], x[:, d])
        np.fill_diagonal(sims, -np.inf)
        df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], f"vec_id long, embedding array<{kind}>")
        least = float(np.sort(sims, axis=1)[:, -3].mean())
        for threshold in (None, least):
            got = {(r.q, r["rank"]): r.i for r in similar(df, df, k=5, threshold=threshold, other=True, block=64).collect()}
            assert got == {(q, k + 1): int(i) for q in range(700) for k, i in enumerate(np.lexsort((np.arange(700), -sims[q]))[:5]) if threshold is None or sims[q, i] >= threshold}
    one = df.coalesce(1)
    best = N.Best(np.arange(200), v[:200], np.zeros(200, np.int64), 5, None, True, False)
    for at in range(0, 700, 100):
        best.meet(np.arange(at, at + 100), v[at : at + 100], np.zeros(100, np.int64))
    assert best.out().num_rows == 1000 and N.best_of_blocks(one, one, 5, None, True, "vec_id", "embedding", None, 10_000).count() == 3500


def test_links_of_clusters_are_made_once(spark, monkeypatch):
    """Components read their links more than once, so they get a stored table, not the search."""
    from quernstone.plans import graph_queries as Q
    from quernstone.plans.registry import Tables

    seen, real = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda edges, **more: seen.append(edges) or real(edges, **more))
    Q.cc_clusters(Tables(spark, "/root/testdata/sf0.001"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "MapIn" not in plan
