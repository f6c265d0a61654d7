"""Row models trained through their layers: finite differences, tables against numpy, blocks against the full pass, training, search."""

import uuid

import numpy as np
import pytest

from quernstone.operators import layers as L
from quernstone.operators import training as T

EDGES = [(0, 10, 0), (0, 11, 1), (1, 11, 0), (1, 12, 1), (1, 10, 1), (2, 12, 0), (3, 10, 0), (3, 13, 1), (4, 13, 0)]  # row 5 has none
KINDS = ("mean", "attention")


def shape_of(kind):
    return L.ModelShape(5, 4, 3, kind=kind, hidden=4, edge=3, output=3, layers=2, heads=2)


def small(seed=0):
    rng = np.random.default_rng(seed)
    rows, tokens, columns = rng.normal(size=(6, 5)), rng.normal(size=(4, 4)), rng.normal(size=(2, 3))
    e = np.array(EDGES)
    return L.Subgraph(rows, tokens, columns, e[:, 0], e[:, 1] - 10, e[:, 2])


def graph(spark, g):
    table = lambda x, start: spark.createDataFrame([(i + start, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    return T.Graph(table(g.rows, 0), table(g.tokens, 10), table(g.columns, 0), spark.createDataFrame(EDGES, "dst long, src long, col long"))


TRIPLETS = [(0, 1, 2), (1, 0, 5), (3, 4, 0), (5, 2, 4)]
PAIRS = [(0, 1, 1.0), (2, 5, 0.0), (3, 4, 1.0), (1, 4, 0.0)]


def loss_of(w, shape, g, kind):
    """(loss, gradients) over the whole subgraph."""
    y, steps = L.forward(w, shape, g)
    more = {}
    if kind == "triplet":
        at = [np.array(c) for c in zip(*TRIPLETS, strict=True)]
        loss, parts = L.triplet_loss([y[i] for i in at], 0.3)
    elif kind == "pairs":
        at = [np.array(c) for c in list(zip(*PAIRS, strict=True))[:2]]
        loss, parts, more = L.pair_loss(w, [y[i] for i in at], np.array([p[2] for p in PAIRS]))
    else:
        loss, dy = L.contrast_loss(y, np.array([0, 3]), np.array([1, 4]), 0.5)
        return loss, L.backward(w, shape, g, steps, dy)
    dy = sum(L.group_sum(p, i, len(y)) for p, i in zip(parts, at, strict=True))
    return loss, L.added(L.backward(w, shape, g, steps, dy), more)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("loss", ["triplet", "pairs", "contrast"])
def test_finite_differences_of_every_weight(kind, loss):
    g, shape = small(), shape_of(kind)
    w = {k: v + 0.1 * np.random.default_rng(7).normal(size=v.shape) for k, v in L.drawn(shape, 1).items()}
    _, found = loss_of(w, shape, g, loss)
    changed = 0
    for name, x in w.items():
        if name.startswith("pair") and loss != "pairs":
            continue
        for i in np.ndindex(x.shape):
            old, step = x[i], 1e-6
            x[i] = old + step
            up = loss_of(w, shape, g, loss)[0]
            x[i] = old - step
            down = loss_of(w, shape, g, loss)[0]
            x[i] = old
            assert found[name][i] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-6), (name, i)
        changed += bool(np.abs(found[name]).max() > 1e-9)
    assert changed > 10  # gradients reach the projections, each layer and the head


@pytest.mark.parametrize("kind,loss", [("mean", "triplet"), ("attention", "pairs")])
def test_tables_give_the_gradients_of_numpy(spark, kind, loss):
    g, shape = small(), shape_of(kind)
    w = L.drawn(shape, 3)
    whole = T.FullPass(graph(spark, g), shape)
    df = spark.createDataFrame(TRIPLETS, "a long, p long, n long") if loss == "triplet" else spark.createDataFrame(PAIRS, "a long, b long, label double")
    config = T.TrainConfig(loss=loss)
    total, n, found = whole.gradient(w, df, config)
    want, gradients = loss_of(w, shape, g, loss)
    assert n == 4 and total == pytest.approx(want)
    for k, v in gradients.items():
        np.testing.assert_allclose(found[k], v, atol=1e-9, err_msg=k)
    # blocks of one example each, all edges: the same sums, however the examples are dealt
    stored = T.blocks(graph(spark, g), df, T.TrainConfig(loss=loss, batch=1, blocks=2, fan_out=None), T.Scratch(spark, "test"))
    assert stored.count() > 1 and stored.select("step").distinct().count() == 2
    loss_, n, flat = T.block_gradient(stored, w, shape, config)
    assert n == 4 and loss_ == pytest.approx(want)
    np.testing.assert_allclose(flat, L.flat({k: gradients.get(k, np.zeros_like(v)) for k, v in w.items()}), atol=1e-9)
    vectors = {r.id: r.v for r in T.RowModel(shape, 3).embeddings(graph(spark, g)).collect()}
    np.testing.assert_allclose([vectors[i] for i in range(6)], L.forward(w, shape, g)[0], atol=1e-9)
    with pytest.raises(ValueError, match="blocks"):
        whole.gradient(w, df, T.TrainConfig())


def test_fan_out_is_a_bound(spark):
    g = small()
    stored = T.blocks(graph(spark, g), spark.createDataFrame(TRIPLETS, "a long, p long, n long"), T.TrainConfig(loss="triplet", fan_out=1), T.Scratch(spark, "test"))
    import io

    for r in stored.collect():
        d = np.load(io.BytesIO(r.data))
        assert (np.bincount(d["dst"], minlength=1) <= 1).all() and len(d["tokens"]) == len(set(d["src"].tolist()))


def entities(spark, seed, n=40):
    """Two rows of each of n entities; their tokens tell which, their own vectors are noise. (graph, positive pairs)."""
    rng = np.random.default_rng(seed)
    token = np.random.default_rng(99).normal(size=(12, 6))
    kinds = [rng.choice(12, 3, replace=False) for _ in range(n)]
    rows = [(2 * e + s, (rng.normal(size=4) * 2).tolist()) for e in range(n) for s in (0, 1)]
    edges = [(2 * e + s, int(t), f"c{j}") for e in range(n) for s in (0, 1) for j, t in enumerate(kinds[e])]
    edges += [(2 * e + s, int(rng.integers(12)), "noise") for e in range(n) for s in (0, 1) for _ in range(2)]
    columns = [(c, np.eye(4)[i].tolist()) for i, c in enumerate(("c0", "c1", "c2", "noise"))]
    g = T.Graph(spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(token)], "id long, v array<double>"), spark.createDataFrame(columns, "id string, v array<double>"), spark.createDataFrame(edges, "dst long, src long, col string"))
    return g, spark.createDataFrame([(2 * e, 2 * e + 1) for e in range(n)], "a long, b long")


@pytest.mark.parametrize("kind", KINDS)
def test_training_through_layers(spark, kind):
    """Held-out loss falls further than with the layers fixed, and every part of the model has moved."""
    g, pairs = entities(spark, 1)
    held, others = entities(spark, 2)
    shape = g.shape(kind=kind, hidden=8, edge=4, output=8, heads=2)
    config = T.TrainConfig(epochs=12, batch=20, blocks=1, rate=0.02, fan_out=None)
    model, before = T.RowModel(shape, 1), L.drawn(shape, 1)
    seen = []
    history = model.fit([(g, pairs)], config, [(held, others)], on_epoch=lambda k, now: seen.append(now))
    assert len(history) == len(seen) == 12 and history[-1]["train"] < history[0]["train"]
    assert all(np.abs(model.weights[k] - before[k]).max() > 1e-4 for k in before if not k.startswith("pair"))
    fixed = T.RowModel(shape, 1)
    stored = T.blocks(g, pairs, config, T.Scratch(spark, "test"))
    check = T.blocks(held, others, config, T.Scratch(spark, "test"))
    x, moves = L.flat(fixed.weights), T.AdamW(L.flat(fixed.weights).size, config.weight_decay)
    only = L.flat({k: np.full_like(v, k.startswith("out")) for k, v in fixed.weights.items()})
    best = np.inf
    for epoch in range(1, 13):
        for s in sorted(r.step for r in stored.select("step").distinct().collect()):
            _, n, d = T.block_gradient(stored.where(f"step = {s}"), L.shaped(x, fixed.weights), shape, config)
            x = np.where(only, moves.moved(x, T.clipped(d / n, 1.0), T.rate_at(epoch, config)), x)
        loss, n, _ = T.block_gradient(check, L.shaped(x, fixed.weights), shape, config, back=False)
        best = min(best, loss / n)
    assert min(h["valid"] for h in history) < best


def jobs_of(spark, f):
    """(f(), the Spark jobs it took)."""
    name = f"counted-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = f()
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(k, None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("kind,length", [("mean", 512), ("attention", 5)])
def test_steps_of_few_blocks_share_jobs(spark, monkeypatch, kind, length):
    """As many small steps as there are pairs cost no job each, and move the weights as a job for each step does; also over several runs."""
    monkeypatch.setattr(T, "RUN_BLOCKS", 2 * length)
    g, pairs = entities(spark, 1, 20)
    shape = g.shape(kind=kind, hidden=8, edge=4, output=8, heads=2)
    config = T.TrainConfig(epochs=2, batch=1, blocks=2, rate=0.02, loss="pairs")
    stored = T.blocks(g, pairs, config, T.Scratch(spark, "test"))
    steps = sorted(r.step for r in stored.select("step").distinct().collect())
    assert len(steps) > 7 and stored.select("run").distinct().count() == (1 if length == 512 else 2)
    model = T.RowModel(shape, 1)
    history, jobs = jobs_of(spark, lambda: model.fit([(g, pairs)], config, made=([stored], [])))
    assert len(history) == 2 and 0 < jobs < 2 * len(steps)
    alone = T.RowModel(shape, 1)
    x, moves = L.flat(alone.weights), T.AdamW(L.flat(alone.weights).size, config.weight_decay)
    for epoch in (1, 2):
        loss, n = 0.0, 0
        for s in steps:
            more, k, d = T.block_gradient(stored.where(f"step = {s}"), L.shaped(x, alone.weights), shape, config)
            x, loss, n = moves.moved(x, T.clipped(d / k, config.clip), T.rate_at(epoch, config)), loss + more, n + k
        assert n == 20 and history[epoch - 1]["train"] == pytest.approx(loss / n, rel=1e-9)
    np.testing.assert_allclose(L.flat(model.weights), x, atol=1e-8)
    many = T.RowModel(shape, 1)  # steps of more blocks: a job each, in as many tasks
    monkeypatch.setattr(T, "FEW_BLOCKS", 1)
    _, jobs = jobs_of(spark, lambda: many.fit([(g, pairs)], config))
    assert jobs >= 2 * len(steps)
    np.testing.assert_allclose(L.flat(many.weights), x, atol=1e-8)


def test_full_training_and_several_sets(spark, tmp_path):
    g, pairs = entities(spark, 1, 12)
    triplets = pairs.selectExpr("a", "b p", "(a + 2) % 24 n")
    model = T.RowModel(g.shape(hidden=4, edge=2, output=4, layers=1), 1)
    losses = model.fit_full(g, triplets, T.TrainConfig(loss="triplet", rate=0.005), 3)
    assert losses[-1] < losses[0]
    history = model.fit([(g, triplets), (g, triplets)], T.TrainConfig(loss="triplet", epochs=3, batch=6), on_epoch=lambda k, now: k == 2)
    assert [h["epoch"] for h in history] == [1, 2]
    model.save(spark, str(tmp_path / "model"))
    again = T.RowModel.load(spark, str(tmp_path / "model"))
    assert again.shape == model.shape and all((again.weights[k] == v).all() for k, v in model.weights.items())
    with pytest.raises(ValueError, match="nothing to train"):
        model.fit([(g, pairs.limit(0))])


def test_rate_and_clipping():
    config = T.TrainConfig(rate=1.0, epochs=20, warm_up=0.2, least_rate=0.0)
    rates = [T.rate_at(k, config) for k in range(1, 21)]
    assert rates[:4] == [0.25, 0.5, 0.75, 1.0] and rates == sorted(rates[:4]) + sorted(rates[4:], reverse=True) and rates[-1] == pytest.approx(0)
    assert np.linalg.norm(T.clipped(np.full(4, 3.0), 1.0)) == pytest.approx(1) and (T.clipped(np.full(4, 0.1), 1.0) == 0.1).all()
    x = T.AdamW(2, 0.1).moved(np.array([1.0, 1.0]), np.array([1e-3, -5.0]), 0.01)
    np.testing.assert_allclose(x, [1 - 0.001 - 0.01, 1 - 0.001 + 0.01], rtol=1e-4)  # the first step has the rate's length, decay apart
    assert T.with_config(config, '{"rate": 0.5}').rate == 0.5


def test_halving_resumes(spark, tmp_path):
    asked = []

    def train(model, choice, epochs):
        asked.append((choice["rate"], choice["layers"], epochs))
        if len(asked) == 5:
            raise OSError("lost")
        return abs(choice["rate"] - 0.3) + 1 / epochs

    grid = {"rate": [0.1, 0.2, 0.3, 0.4], "layers": [1, 2, 3]}
    run = lambda: T.halving(lambda c: None, train, grid, 9, str(tmp_path / "trials"), spark)
    with pytest.raises(OSError):
        run()
    best, table = run()
    assert best["rate"] == 0.3 and table.count() == 9 + 3 + 1 and len(asked) == 9 + 3 + 1 + 1  # the one that was lost is asked again, no other
    assert sorted(r.epochs for r in table.collect()) == [1] * 9 + [3] * 3 + [9]
    done = len(asked)
    assert run()[0] == best and len(asked) == done
