"""Agent labelling with a failing server; the schema projector against finite differences; the layout in the plane."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import agent as A
from quernstone.operators import layers as L
from quernstone.operators import layout as P
from quernstone.operators import schema_model as M


@pytest.fixture
def server():
    """Fails each pair's first request, uses a tool, then labels; the pair in `broken` always fails."""
    state = {"seen": Counter(), "going": 0, "most": 0, "broken": {5}, "lock": threading.Lock()}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            told = body["messages"]
            row = json.loads(told[1]["content"])
            with state["lock"]:
                state["seen"][row["k"]] += 1
                first = state["seen"][row["k"]] == 1
                state["going"] += 1
                state["most"] = max(state["most"], state["going"])
            if first or row["k"] in state["broken"]:
                self.send_response(503)
                self.end_headers()
            else:
                if len(told) == 2:
                    reply = "<think>hm</think> " + json.dumps({"tool": "shared_words", "args": {}})
                elif row["k"] == 3 and len(told) == 4:
                    reply = "I am not sure"
                else:
                    share = json.loads(told[3]["content"])["share"]
                    reply = json.dumps({"label": int(share > 0.5), "confidence": "high"})
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"message": {"content": reply}}).encode())
            with state["lock"]:
                state["going"] -= 1

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", state
    http.shutdown()


def test_no_pair_is_lost_or_asked_twice(spark, server, tmp_path):
    host, state = server
    pairs = spark.createDataFrame([(k, "red box 12", "red box 12" if k % 2 else "blue") for k in range(9)] + [(0, "red box 12", "blue")], "k long, text_a string, text_b string")
    run = lambda: A.label_all(pairs, ["k"], str(tmp_path / "labels"), A.ChatModel(host), slices=2, tries=3, first_pause=0.01, at_once=2)
    got = {r.k: r for r in run().collect()}
    assert set(got) == set(range(9)) - {5} and all(r.label == r.k % 2 and r.confidence == "high" for r in got.values())
    assert got[0].turns == 2 and got[3].turns == 3 and [t.role for t in got[0].trace] == ["system", "user", "error", "assistant", "tool", "assistant"]
    assert all(n == (4 if k == 3 else 3) for k, n in state["seen"].items()) and state["most"] <= 16
    opened = spark.read.parquet(str(tmp_path / "labels-open")).collect()
    assert [r.k for r in opened] == [5] and sum(t.role == "error" for t in opened[0].trace) == 3
    state["broken"].clear()
    before = Counter(state["seen"])
    assert run().count() == 9 and {k: n - before[k] for k, n in state["seen"].items() if n > before[k]} == {5: 2}


def test_replies_of_a_broken_run_are_sorted_in(spark, server, tmp_path):
    host, state = server
    pairs = spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "k long, text_a string, text_b string")
    A.asked(pairs.where("k = 1"), ["k"], A.ChatModel(host), first_pause=0.01).write.parquet(str(tmp_path / "labels-now"))
    got = A.label_all(pairs, ["k"], str(tmp_path / "labels"), A.ChatModel(host), slices=1, first_pause=0.01)
    assert {(r.k, r.label) for r in got.collect()} == {(1, 1), (2, 0)} and state["seen"][1] == 3


def test_pauses_and_turns():
    waits = [A.pause("x", k, 0.5) for k in range(4)]
    assert all(0.5 * 2**k <= w <= 0.75 * 2**k for k, w in enumerate(waits)) and A.pause("x", 1, 0.5) != A.pause("y", 1, 0.5)
    label, sure, turns, trace = A.conversation({"text_a": "x"}, lambda told: '{"tool": "fails"}', {"fails": lambda row, args: 1 / 0}, 3, 1, 0)
    assert label is None and turns == 3 and json.loads(trace[-1][2]) == {"error": "division by zero"}
    assert A.conversation({}, lambda told: '{"label": 1, "confidence": "very"}', {}, 3, 1, 0)[:3] == (1, "low", 1)
    assert A.numbers({"text_a": "3 x 4,5", "text_b": None}, {}) == {"text_a": ["3", "4,5"], "text_b": []}


# Schema projector

COLUMNS = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(10, 5)))]
TRIPLETS = [(0, 1, 2), (3, 4, 5), (6, 7, 1), (8, 9, 0)]


def plain_loss(w, config, step):
    """Loss of the whole batch, in numpy; dropout's factors are the operator's."""
    x = np.array([v for _, v in COLUMNS])
    z = x @ w["in.w"] + w["in.b"]
    c = (z - z.mean(0)) / np.sqrt(z.var(0) + L.EPS)
    key = np.array(plain_loss.keys)
    y = L.headed(w, L.gelu(c * w["gain"] + w["shift"]) * M.kept_units(key, step, z.shape[1], config))
    a, p, n = (y[[t[i] for t in TRIPLETS]] for i in range(3))
    return L.triplet_loss([a, p, n], config.margin)[0]


def test_projector_by_finite_differences(spark):
    columns, triplets = spark.createDataFrame(COLUMNS, "id long, v array<double>"), spark.createDataFrame(TRIPLETS, "a long, p long, n long")
    config = M.ProjectorConfig(hidden=4, output=3, dropout=0.3, margin=1.0)
    plain_loss.keys = [int(r.key[0]) for r in M.keyed(columns).orderBy("id").collect()]
    model = M.Projector(5, config)
    loss, n, found, (mean, spread) = model.gradient(columns, triplets, 2)
    w = model.weights
    assert n == 4 and loss == pytest.approx(plain_loss(w, config, 2)) and 0 < (M.kept_units(np.array(plain_loss.keys), 2, 4, config) == 0).mean() < 0.6
    for name, x in w.items():
        for i in np.ndindex(x.shape):
            old, step = x[i], 1e-6
            x[i] = old + step
            up = plain_loss(w, config, 2)
            x[i] = old - step
            down = plain_loss(w, config, 2)
            x[i] = old
            assert found[name][i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), (name, i)


def test_projector_learns(spark):
    columns, triplets = spark.createDataFrame(COLUMNS, "id long, v array<double>"), spark.createDataFrame(TRIPLETS, "a long, p long, n long")
    model = M.Projector(5, M.ProjectorConfig(hidden=8, output=4, dropout=0.0, rate=0.02, epochs=5))
    history = model.fit(columns, triplets, triplets)
    assert history[-1]["train"] < history[0]["train"] and set(history[0]) == {"train", "valid"}
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in model.project(columns).collect())
    with pytest.raises(ValueError, match="no triplets"):
        model.fit(columns, triplets.limit(0))


# Layout


def test_layout_keeps_neighbours(spark):
    """Three blobs in ten dimensions: of a row's five nearest in the plane, 0.8 at least are of its blob; without rounds, about a third."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c * 4, 1, (30, 10)) for c in range(3)])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = [(i, int(j)) for i in range(90) for j in np.argsort(d[i])[1:7]]
    ids, edges = spark.range(91).select("id"), spark.createDataFrame(near, "q long, i long")

    def kept(rounds):
        got = {r.id: (r.x, r.y) for r in P.plane(edges, ids, rounds=rounds).collect()}
        assert set(got) == set(range(91)) and np.isfinite(list(got.values())).all()
        y = np.array([got[i] for i in range(90)])
        e = np.linalg.norm(y[:, None] - y[None], axis=2)
        return np.mean([[j // 30 == i // 30 for j in np.argsort(e[i])[1:6]] for i in range(90)])

    assert kept(0) < 0.6 and kept(16) > 0.8
    assert P.plane(edges, ids.limit(0), rounds=1).count() == 0 and P.plane(edges.limit(0), ids.limit(1), rounds=1).count() == 1
