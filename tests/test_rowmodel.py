"""Layers against numpy, training, density clusters against a plain version."""

import numpy as np
import pytest

from quernstone.operators import density as D
from quernstone.operators import neighbours as N
from quernstone.operators import rowmodel as R

GRAPH = [(0, 10, "a"), (0, 11, "b"), (1, 11, "a"), (1, 12, "b"), (1, 10, "b")]


def vectors(spark, ids, dims, seed, kind="long"):
    x = np.random.default_rng(seed).normal(size=(len(ids), dims))
    return dict(zip(ids, x, strict=True)), spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], f"id {kind}, v array<double>")


def unit(x):
    return x / np.linalg.norm(x)


def test_layers(spark):
    edges = spark.createDataFrame(GRAPH, "dst long, src long, col string")
    (r, rows), (t, tokens), (c, cols) = vectors(spark, [0, 1, 2], 4, 1), vectors(spark, [10, 11, 12], 4, 2), vectors(spark, ["a", "b"], 3, 3, "string")
    got = {x.id: np.array(x.v) for x in R.mean_layer(edges, rows, tokens, 4).collect()}
    for i in (0, 1):
        np.testing.assert_allclose(got[i], unit(r[i] + np.mean([t[s] for d, s, _ in GRAPH if d == i], axis=0)))
    np.testing.assert_allclose(got[2], unit(r[2]))
    heads = [R.AttentionWeights.drawn(4, 3, 2, np.random.default_rng(k)) for k in (5, 6)]
    got = {x.id: np.array(x.v) for x in R.attention_layer(edges, rows, tokens, cols, heads).collect()}
    for i in (0, 1):
        out = []
        for h in heads:
            mine = [(s, k) for d, s, k in GRAPH if d == i]
            z = np.array([h.source.T @ t[s] + h.target.T @ r[i] + h.edge.T @ c[k] for s, k in mine])
            e = np.where(z >= 0, z, h.slope * z) @ h.score
            w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            out.append(sum(x * (h.source.T @ t[s]) for x, (s, _) in zip(w, mine, strict=True)))
        np.testing.assert_allclose(got[i], unit(r[i] + np.concatenate(out)))
    config = R.RowModelConfig(kind="attention", layers=2, heads=2)
    assert all(abs(np.linalg.norm(x.v) - 1) < 1e-9 for x in R.features(edges, rows, tokens, cols, config).collect())


def test_gradients():
    rng, config = np.random.default_rng(0), R.RowModelConfig()
    x, w = [rng.normal(size=(5, 4)) for _ in range(3)], rng.normal(size=(4, 3))
    y = np.array([0, 1, 1, 0, 1.0])
    for f in (lambda w: R.triplet_gradient(x, w, config), lambda w: R.pair_gradient(x[:2], w, config, y)):
        _, grad = f(w)
        for i, j in ((0, 0), (3, 2)):
            step = np.zeros_like(w)
            step[i, j] = 1e-6
            assert grad[i, j] == pytest.approx((f(w + step)[0] - f(w - step)[0]) / 2e-6, rel=1e-3, abs=1e-6)


def data(spark, seed):
    """Rows of which the first half of the dimensions tells what they are, the rest is noise."""
    rng = np.random.default_rng(seed)
    kinds = np.arange(40) % 4
    x = np.c_[np.eye(4)[kinds] + rng.normal(size=(40, 4)) * 0.1, rng.normal(size=(40, 4)) * 2]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    triplets = spark.createDataFrame([(i, (i + 4) % 40, (i + 1 + k) % 40) for i in range(40) for k in (0, 1)], "a long, p long, n long")
    pairs = spark.createDataFrame([(i, (i + d) % 40, int(d == 4)) for i in range(40) for d in (4, 1)], "a long, b long, label int")
    return rows, triplets, pairs


def test_training(spark):
    rows, triplets, pairs = data(spark, 1)
    others, more, _ = data(spark, 2)
    config = R.RowModelConfig(output_dim=4, rate=0.5, epochs=6)
    for examples in (triplets, pairs):
        history = R.RowMatcher(8, config).fit([(examples, rows)])
        assert len(history) == 6 and history[-1]["train"] < history[0]["train"]
    m, seen = R.RowMatcher(8, config), []
    m.fit([(triplets, rows), (more, others)], [(more, others)], on_epoch=lambda k, now: seen.append(now) or k == 2)
    assert len(seen) == 3 and all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in m.embeddings(rows).collect())
    with pytest.raises(ValueError, match="nothing to train"):
        m.fit([(triplets.limit(0), rows)])
    still = R.RowMatcher(8, R.RowModelConfig(output_dim=4, rate=0.0, weight_decay=0.0, epochs=9, patience=1)).fit([(triplets, rows)])
    assert len(still) == 3 and still[-1]["rate"] == 0.0


def test_search_and_config():
    best, tried = R.search(R.RowModelConfig(), {"rate": [0.1, 0.2, 0.3], "layers": [1, 2]}, lambda c: c.rate * c.layers, 10)
    assert len(tried) == 6 and (best.rate, best.layers) == (0.3, 2)
    assert R.load_config('{"margin": 0.1, "kind": "attention"}').margin == 0.1 and R.Config().rows == R.RowModelConfig()
    with pytest.raises(TypeError):
        R.load_config('{"nothing": 1}')


def test_principal_components(spark):
    x, v = vectors(spark, list(range(30)), 5, 4)
    m = np.array(list(x.values()))
    m = m - m.mean(0)
    axes = np.linalg.svd(m)[2][:2].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    got = {r.id: r.pc for r in R.principal_components(v).collect()}
    np.testing.assert_allclose([got[i] for i in range(30)], m @ axes, atol=1e-8)


def blobs(spark, far=1.0):
    rng = np.random.default_rng(3)
    angle = np.r_[rng.normal(0.2, 0.03, 20), rng.normal(0.2 + far, 0.03, 20), [3.0]]
    v = np.c_[np.cos(angle), np.sin(angle)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    return v, df, D.ranked(N.similar(df, df, k=40, other=True).select("q", "i", "sim"))


def test_spanning_forest(spark):
    v, df, near = blobs(spark)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    core = np.sort(d, axis=1)[:, 3]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, cost = {0}, 0.0
    while len(inside) < len(v):
        x, j = min((w[i, j], j) for i in inside for j in range(len(v)) if j not in inside)
        inside.add(j)
        cost += x
    got = D.spanning_forest(D.reachability(near, 3)).collect()
    assert len(got) == len(v) - 1 and sum(r.w for r in got) == pytest.approx(cost)


def plain_hdbscan(w, params):
    """Labels from the full matrix of mutual reachability, by the definition: the tree is split at its longest edge, again and again."""
    n = len(w)
    inside, tree = {0}, []
    while len(inside) < n:
        x, i, j = min((w[i, j], min(i, j), max(i, j)) for i in inside for j in range(n) if j not in inside)
        tree.append((x, i, j))
        inside |= {i, j}

    def parts(rows, edges):
        """The two parts of rows without the longest edge, and its length."""
        cut = max(edges)
        rest = [e for e in edges if e != cut]
        side, todo = {cut[1]}, [cut[1]]
        while todo:
            v = todo.pop()
            for _, i, j in rest:
                for u in ((j,) if i == v else (i,) if j == v else ()):
                    if u not in side:
                        side.add(u)
                        todo.append(u)
        own = [e for e in rest if e[1] in side]
        return cut[0], [(side, own), (rows - side, [e for e in rest if e[1] not in side])]

    clusters = []  # (rows, parent, birth, stability)

    def grow(rows, edges, parent, birth):
        me = len(clusters)
        clusters.append([rows, parent, birth, 0.0])
        while edges:
            x, two = parts(rows, edges)
            lam = 1 / max(x, 1e-12)
            large = [p for p in two if len(p[0]) >= params.smallest]
            if len(large) == 2:
                clusters[me][3] += len(rows) * (lam - birth)
                for p in large:
                    grow(*p, me, lam)
                return
            clusters[me][3] += (len(rows) - sum(len(p[0]) for p in large)) * (lam - birth)
            if not large:
                return
            rows, edges = large[0]

    if n >= params.smallest:
        grow(set(range(n)), tree, -1, 0.0)
    below = [[c for c, x in enumerate(clusters) if x[1] == k] for k in range(len(clusters))]

    def best(k):
        """(stability, chosen) of the part of the tree below k."""
        inner = [best(c) for c in below[k]]
        total = sum(s for s, _ in inner)
        may = params.whole or clusters[k][1] >= 0
        if not below[k] or not params.leaf and clusters[k][3] >= total and may:
            return clusters[k][3], [k] if may else []
        return total, [c for _, found in inner for c in found]

    chosen = best(0)[1] if clusters else []
    if params.epsilon:
        ups = set()
        for k in chosen:
            while clusters[k][1] >= 0 and (params.whole or clusters[clusters[k][1]][1] >= 0) and clusters[k][2] > 1 / params.epsilon:
                k = clusters[k][1]
            ups.add(k)
        chosen = [k for k in ups if not any(clusters[k][0] < clusters[o][0] for o in ups)]
    label = [-1] * n
    for k in chosen:
        for r in clusters[k][0]:
            label[r] = min(clusters[k][0])
    return label


CHOICES = [(5, 3, 0.0, False, False), (3, 2, 0.0, False, False), (2, 1, 0.0, True, False), (5, 2, 0.0, True, False), (4, 3, 0.4, False, False), (4, 3, 0.15, True, False), (8, 3, 0.0, False, True), (30, 3, 0.0, False, True), (60, 3, 0.0, False, True), (3, 2, 0.3, False, True)]


def test_density_clusters_by_definition(spark):
    """Blobs of different density, a line, repeated points and noise, on the full graph; several choices at once, judged in a task and in rounds."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.05, (14, 2)), rng.normal(1, 0.2, (14, 2)), np.c_[np.linspace(2, 3, 10), np.zeros(10)], rng.uniform(-2, 4, (8, 2)), np.full((4, 2), 0.5)]
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 9)
    near = spark.createDataFrame([(i, int(j), float(d[i, j]), r + 1) for i in range(len(x)) for r, j in enumerate(j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i)], "q long, i long, d double, rank int")
    params = [D.Params(*c) for c in CHOICES]
    trees = {s: D.tree_of(near, s) for s in {p.samples for p in params}}
    for most, picked in ((D.MOST_CLUSTERS, range(len(params))), (0, (0, 3, 4, 9))):
        several, of = {k: params[k] for k in picked}, {k: params[k].samples for k in picked}
        got = {(r.choice, r.id): r.cluster for r in D.cut(D.together(trees), several, of, most).collect()}
        for k, p in several.items():
            core = np.sort(d, axis=1)[:, p.samples]
            w = np.maximum(d, np.maximum(core[:, None], core[None]))
            assert [got.get((k, i), -1) for i in range(len(x))] == plain_hdbscan(w, p), (most, p)


def test_density_clusters(spark):
    _, df, near = blobs(spark)
    ids = df.selectExpr("vec_id id")
    wide = {r.id: r.cluster for r in D.hdbscan(near, ids, D.Params(smallest=5, samples=3, epsilon=0.5)).collect()}
    assert len({c for c in wide.values() if c >= 0}) == 2 and {wide[i] for i in range(20)} == {0} and {wide[i] for i in range(20, 40)} == {20} and wide[40] == -1
    assert {r.cluster for r in D.hdbscan(near, ids, D.Params(smallest=30, samples=3)).collect()} == {-1}
    assert {r.cluster for r in D.hdbscan(near.limit(0), ids).collect()} == {-1}


def test_genetic_search(spark):
    _, df, near = blobs(spark)
    pairs = spark.createDataFrame([(i, (i + d) % 40, int(i // 20 == (i + d) % 40 // 20)) for i in range(40) for d in (1, 20)], "a long, b long, label int")
    found = D.genetic_search(near, pairs, 41, size=5, generations=2)
    assert [x[0] for x in found] == [0, 1] and found[-1][2] >= found[0][2] > 0
    g, best, fitness, _ = found[-1]
    labels = {r.id: r.cluster for r in D.hdbscan(near, df.selectExpr("vec_id id"), D.Params(*best[:3], bool(best[3]), bool(best[4]))).collect()}
    same = [r.label for r in pairs.collect() if labels[r.a] == labels[r.b] >= 0]
    precision, recall = sum(same) / len(same), sum(same) / pairs.where("label = 1").count()
    largest = max(list(labels.values()).count(c) for c in set(labels.values()) - {-1})
    assert fitness == pytest.approx(2 * precision * recall / (precision + recall) * (0.5 if largest > 0.5 * 41 else 1))


def test_growing_tables_of_the_clusters_are_merged(spark):
    from pyspark.sql import functions as F

    from quernstone.operators.ranking import running_sums
    from quernstone.sources.storage import stored

    near = stored(blobs(spark)[2])
    for made in (lambda: D.reachability(near, 3), lambda: running_sums(near, ["q"], [F.col("rank")], {"n": "rank"}, many=True)):
        plan = made()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_whole_trees_give_the_clusters_of_tables(spark):
    """The plain definition and the arrays of a task, with a second tree apart, repeated lengths and pairs of rows that are in no edge."""
    import io

    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.05, (14, 2)), rng.normal(1, 0.2, (14, 2)), np.c_[np.linspace(2, 3, 10), np.zeros(10)], rng.uniform(-2, 4, (8, 2)), np.full((4, 2), 0.5)]
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 9)
    rows = [(i, int(j), float(d[i, j]), r + 1) for i in range(len(x)) for r, j in enumerate(j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i)]
    near = spark.createDataFrame(rows + [(100, 101, 0.1, 1), (101, 100, 0.1, 1)], "q long, i long, d double, rank int")
    pairs = spark.createDataFrame([(i, j, int(j - i == 1)) for i in range(0, 60) for j in (i + 1, i + 2)] + [(100, 101, None)], "a long, b long, label int")
    params = [D.Params(*c) for c in CHOICES]
    trees = D.packed_trees(near, pairs, sorted({p.samples for p in params}))
    data = {r.tree: dict(np.load(io.BytesIO(r.data))) for r in trees.collect()}
    got = D.hits_whole(trees, dict(enumerate(params)), {k: p.samples for k, p in enumerate(params)})
    for k, p in enumerate(params):
        core = np.sort(d, axis=1)[:, p.samples]
        own, tree = D.cut_whole(data[p.samples], p), data[p.samples]
        name = {c: min(tree["ids"][own == c]) for c in set(own) - {-1}}
        label = {int(i): int(name.get(c, -1)) for i, c in zip(tree["ids"], own, strict=True)}
        assert [label[i] for i in range(len(x))] == plain_hdbscan(np.maximum(d, np.maximum(core[:, None], core[None])), p), p
        same = [r.label or 0 for r in pairs.collect() if label.get(r.a, -1) == label.get(r.b, -1) >= 0]
        assert got[k] == (sum(same), len(same), max((list(label.values()).count(c) for c in name.values()), default=0)), p


def test_a_generation_is_judged_in_a_few_jobs(spark):
    """The same search over tables and in tasks, which took some hundred jobs for each generation before."""
    _, df, near = blobs(spark)
    pairs = spark.createDataFrame([(i, (i + d) % 40, int(i // 20 == (i + d) % 40 // 20)) for i in range(40) for d in (1, 20)], "a long, b long, label int")
    spark.sparkContext.setJobGroup("whole", "search")
    found = D.genetic_search(near, pairs, 41, size=4, generations=2)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole"))
    spark.sparkContext.setJobGroup("tables", "search")
    assert jobs <= 60 and found == D.genetic_search(near, pairs, 41, size=4, generations=2, most=0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert D.genetic_search(near.limit(0), pairs, 41, size=3, generations=1)[0][2] == 0
