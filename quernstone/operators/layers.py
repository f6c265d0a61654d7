"""The arithmetic of the row models, forward and back, on batches of vectors: what a task does with its rows or its sampled subgraph.

A model is a dict of arrays. Rows, tokens and columns are projected to the hidden width (linear, normalised, GELU; columns without the
norm). A layer adds to each row what its edges say and normalises: the mean of a linear map of (token, column), or
attention: score = a . leaky(W_s token + W_t row + W_e column) for each head, softmax over the row's edges, weighted sum of W_s token. The head
maps rows to vectors of length one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Weights = dict[str, np.ndarray]
SLOPE, EPS, LEAST = 0.2, 1e-5, 1e-12
CURVE = np.sqrt(2 / np.pi)


@dataclass(frozen=True)
class ModelShape:
    """kind: "mean" or "attention"; hidden must be a multiple of heads."""

    row_dim: int
    token_dim: int
    column_dim: int
    kind: str = "mean"
    hidden: int = 32
    edge: int = 16
    output: int = 32
    layers: int = 2
    heads: int = 4


def drawn(shape: ModelShape, seed: int = 42) -> Weights:
    """Weights to begin with."""
    rng = np.random.default_rng(seed)
    matrix = lambda n, m: rng.normal(size=(n, m)) / np.sqrt(n)
    w: Weights = {}
    for name, n, m in (("row", shape.row_dim, shape.hidden), ("token", shape.token_dim, shape.hidden), ("column", shape.column_dim, shape.edge)):
        w |= {f"{name}.w": matrix(n, m), f"{name}.b": np.zeros(m)}
        if name != "column":
            w |= {f"{name}.gain": np.ones(m), f"{name}.shift": np.zeros(m)}
    for k in range(shape.layers):
        if shape.kind == "mean":
            w[f"{k}.w"] = matrix(shape.hidden + shape.edge, shape.hidden)
        else:
            w |= {f"{k}.source": matrix(shape.hidden, shape.hidden), f"{k}.target": matrix(shape.hidden, shape.hidden), f"{k}.edge": matrix(shape.edge, shape.hidden)}
            w[f"{k}.score"] = rng.normal(size=shape.hidden) / np.sqrt(shape.hidden // shape.heads)
        w |= {f"{k}.b": np.zeros(shape.hidden), f"{k}.gain": np.ones(shape.hidden), f"{k}.shift": np.zeros(shape.hidden)}
    return w | {"out.w": matrix(shape.hidden, shape.output), "out.b": np.zeros(shape.output), "pair.w": matrix(shape.output, shape.output), "pair.b": np.zeros(shape.output), "pair.v": matrix(shape.output, 1)[:, 0], "pair.c": np.zeros(1)}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(vector: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def added(total: Weights, more: Weights) -> Weights:
    for k, g in more.items():
        total[k] = total[k] + g if k in total else g
    return total


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(CURVE * (x + 0.044715 * x * x * x)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    t = np.tanh(CURVE * (x + 0.044715 * x * x * x))
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * CURVE * (1 + 3 * 0.044715 * x * x)


def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = np.sqrt(x.var(1, keepdims=True) + EPS)
    return (x - x.mean(1, keepdims=True)) / spread, spread


def centred_back(x: np.ndarray, spread: np.ndarray, g: np.ndarray) -> np.ndarray:
    return (g - g.mean(1, keepdims=True) - x * (g * x).mean(1, keepdims=True)) / spread


def projected(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    z = x @ w[f"{name}.w"] + w[f"{name}.b"]
    return gelu(centred(z)[0] * w[f"{name}.gain"] + w[f"{name}.shift"] if f"{name}.gain" in w else z)


def projected_back(w: Weights, name: str, x: np.ndarray, g: np.ndarray) -> Weights:
    """Gradients of the projection's weights, from that of its results."""
    z, found = x @ w[f"{name}.w"] + w[f"{name}.b"], {}
    if f"{name}.gain" in w:
        c, spread = centred(z)
        g = g * gelu_slope(c * w[f"{name}.gain"] + w[f"{name}.shift"])
        found = {f"{name}.gain": (g * c).sum(0), f"{name}.shift": g.sum(0)}
        g = centred_back(c, spread, g * w[f"{name}.gain"])
    else:
        g = g * gelu_slope(z)
    return found | {f"{name}.w": x.T @ g, f"{name}.b": g.sum(0)}


def message(w: Weights, k: int, gathered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What layer k adds to rows: gathered is their mean (token, column) or their weighted sum; n their edges."""
    m = gathered @ w[f"{k}.w"] if f"{k}.w" in w else gathered
    return (m + w[f"{k}.b"]) * (n > 0)[:, None]


def row_layer(w: Weights, k: int, r: np.ndarray, gathered: np.ndarray, n: np.ndarray) -> np.ndarray:
    return centred(r + message(w, k, gathered, n))[0] * w[f"{k}.gain"] + w[f"{k}.shift"]


def row_layer_back(w: Weights, k: int, r: np.ndarray, gathered: np.ndarray, n: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, Weights]:
    """Gradients of r, of gathered, and of the layer's weights."""
    c, spread = centred(r + message(w, k, gathered, n))
    found = {f"{k}.gain": (g * c).sum(0), f"{k}.shift": g.sum(0)}
    g = centred_back(c, spread, g * w[f"{k}.gain"])
    m = g * (n > 0)[:, None]
    found[f"{k}.b"] = m.sum(0)
    if f"{k}.w" in w:
        return g, m @ w[f"{k}.w"].T, found | {f"{k}.w": gathered.T @ m}
    return g, m, found


def edge_scores(w: Weights, k: int, z: np.ndarray, heads: int) -> np.ndarray:
    """A score for each edge and head; z is the sum of what source, target and column give."""
    cut = np.maximum(z, SLOPE * z).reshape(len(z), heads, -1)
    return np.einsum("nhd,hd->nh", cut, w[f"{k}.score"].reshape(heads, -1))


def edge_back(w: Weights, k: int, z: np.ndarray, p: np.ndarray, alpha: np.ndarray, g: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, Weights]:
    """Gradients of the sources' part p, of z, and of the scoring vector; g and m: gradient and value of each edge's target's weighted sum.

    The softmax's correction, the sum of alpha * (g . p) over a target's edges, is g . m, so no edge need see another.
    """
    n, heads = alpha.shape
    cut = lambda x: x.reshape(n, heads, -1)
    s = alpha * np.einsum("nhd,nhd->nh", cut(g), cut(p - m))
    wide = np.repeat(s, z.shape[1] // heads, axis=1)
    slope = np.where(z >= 0, 1, SLOPE)
    dz = wide * w[f"{k}.score"] * slope
    return np.repeat(alpha, z.shape[1] // heads, axis=1) * g + dz, dz, {f"{k}.score": np.einsum("nd,nd,nd->d", wide, z, slope)}


def headed(w: Weights, r: np.ndarray) -> np.ndarray:
    y = r @ w["out.w"] + w["out.b"]
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), LEAST)


def headed_back(w: Weights, r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, Weights]:
    z = r @ w["out.w"] + w["out.b"]
    norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), LEAST)
    y = z / norm
    g = (g - y * (g * y).sum(1, keepdims=True)) / norm
    return g @ w["out.w"].T, {"out.w": r.T @ g, "out.b": g.sum(0)}


# Losses: the sum over examples, how many there are, gradients of the vectors of each example's rows, and of weights.


def triplet_loss(y: list[np.ndarray], margin: float) -> tuple[float, list[np.ndarray]]:
    """max(0, |a - p| - |a - n| + margin)."""
    a, p, n = y
    ap, an = a - p, a - n
    d_ap, d_an = (np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9) for d in (ap, an))
    loss = np.maximum(d_ap - d_an + margin, 0)
    on = (loss > 0).astype(float)
    return float(loss.sum()), [on * (ap / d_ap - an / d_an), on * -ap / d_ap, on * an / d_an]


def pair_loss(w: Weights, y: list[np.ndarray], label: np.ndarray) -> tuple[float, list[np.ndarray], Weights]:
    """Cross entropy of a small classifier of |a - b|: linear, rectified, linear."""
    d = y[0] - y[1]
    x = np.abs(d)
    h = x @ w["pair.w"] + w["pair.b"]
    z = np.maximum(h, 0) @ w["pair.v"] + w["pair.c"][0]
    loss = np.logaddexp(0, z) - label * z
    g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
    gh = np.outer(g, w["pair.v"]) * (h > 0)
    gx = (gh @ w["pair.w"].T) * np.sign(d)
    return float(loss.sum()), [gx, -gx], {"pair.w": x.T @ gh, "pair.b": gh.sum(0), "pair.v": np.maximum(h, 0).T @ g, "pair.c": np.array([g.sum()])}


def contrast_loss(y: np.ndarray, a: np.ndarray, b: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """-log softmax of the partner among all other rows of y, both ways round, halved; and its gradient. Work and memory: pairs x rows."""
    total, g = 0.0, np.zeros_like(y)
    for u, v in ((a, b), (b, a)):
        s = (y[u] / temperature) @ y.T
        s[np.arange(len(u)), u] = -np.inf
        top, own = s.max(1, keepdims=True), s[np.arange(len(u)), v].sum()
        s -= top
        q = np.exp(s, out=s)
        z = q.sum(1, keepdims=True)
        total += float((np.log(z) + top)[:, 0].sum() - own)
        q /= z
        q[np.arange(len(u)), v] -= 1
        g += group_sum(q @ y / temperature, u, len(y))
        g += q.T @ y[u] / temperature
    return total / 2, g / 2


# A whole subgraph in memory: the rows of a block with their sampled edges and the tokens and columns at these.


@dataclass
class Subgraph:
    """Vectors of rows, tokens and columns; edges as places in them."""

    rows: np.ndarray
    tokens: np.ndarray
    columns: np.ndarray
    dst: np.ndarray
    src: np.ndarray
    col: np.ndarray


def grouped(f: np.ufunc, values: np.ndarray, at: np.ndarray, n: int, empty: float) -> np.ndarray:
    """f over the rows of values with the same place; `empty` at places without any."""
    out = np.full((n, values.shape[1]), empty)
    if len(at):
        order = np.argsort(at, kind="stable")
        places = at[order]
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        out[places[first]] = f.reduceat(values[order], first, axis=0)
    return out


def group_sum(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return grouped(np.add, values, at, n, 0.0)


def forward(w: Weights, shape: ModelShape, g: Subgraph) -> tuple[np.ndarray, list[tuple]]:
    """The rows' vectors, and for each layer (rows before it, what they gathered, edges' values)."""
    r, h, e = projected(w, "row", g.rows), projected(w, "token", g.tokens), projected(w, "column", g.columns)
    n = np.bincount(g.dst, minlength=len(r))
    steps = []
    mean = group_sum(np.c_[h[g.src], e[g.col]], g.dst, len(r)) / np.maximum(n, 1)[:, None] if shape.kind == "mean" else None
    for k in range(shape.layers):
        edges = None
        if shape.kind == "mean":
            gathered = mean
        else:
            p = (h @ w[f"{k}.source"])[g.src]
            z = p + (r @ w[f"{k}.target"])[g.dst] + (e @ w[f"{k}.edge"])[g.col]
            s = edge_scores(w, k, z, shape.heads)
            top = grouped(np.maximum, s, g.dst, len(r), -np.inf)
            x = np.exp(s - top[g.dst])
            alpha = x / group_sum(x, g.dst, len(r))[g.dst]
            gathered, edges = group_sum(np.repeat(alpha, shape.hidden // shape.heads, axis=1) * p, g.dst, len(r)), (p, z, alpha)
        steps.append((r, gathered, edges))
        r = row_layer(w, k, r, gathered, n)
    steps.append((r, None, None))
    return headed(w, r), steps


def backward(w: Weights, shape: ModelShape, g: Subgraph, steps: list[tuple], dy: np.ndarray) -> Weights:
    """Gradients of all weights from that of the rows' vectors."""
    h, e = projected(w, "token", g.tokens), projected(w, "column", g.columns)
    n = np.bincount(g.dst, minlength=len(g.rows))
    dr, found = headed_back(w, steps[-1][0], dy)
    dh, de = np.zeros_like(h), np.zeros_like(e)
    d_mean = np.zeros((len(g.rows), h.shape[1] + e.shape[1]))
    for k in reversed(range(shape.layers)):
        r, gathered, edges = steps[k]
        dr, dm, more = row_layer_back(w, k, r, gathered, n, dr)
        found |= more
        if shape.kind == "mean":
            d_mean += dm
            continue
        dp, dz, more = edge_back(w, k, edges[1], edges[0], edges[2], dm[g.dst], gathered[g.dst])
        dq, dp, dk = group_sum(dz, g.dst, len(r)), group_sum(dp, g.src, len(h)), group_sum(dz, g.col, len(e))
        found |= more | {f"{k}.target": r.T @ dq, f"{k}.source": h.T @ dp, f"{k}.edge": e.T @ dk}
        dr, dh, de = dr + dq @ w[f"{k}.target"].T, dh + dp @ w[f"{k}.source"].T, de + dk @ w[f"{k}.edge"].T
    if shape.kind == "mean":
        share = (d_mean / np.maximum(n, 1)[:, None])[g.dst]
        dh, de = group_sum(share[:, : h.shape[1]], g.src, len(h)), group_sum(share[:, h.shape[1] :], g.col, len(e))
    return found | projected_back(w, "row", g.rows, dr) | projected_back(w, "token", g.tokens, dh) | projected_back(w, "column", g.columns, de)
