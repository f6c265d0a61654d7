"""Clustering, filter audit and Jaccard join: plain versions and awkward inputs."""

import hashlib
import random
from itertools import permutations

import numpy as np
from helpers import AWKWARD, SF, awkward, linked, rows_of
from pyspark.sql import functions as F

from quernstone.llm import delta_lloyd, filter_audit, ngram_jaccard

VECTORS = "vec_id long, embedding array<float>, cluster string, v int"

# Clustering


def lloyd(vectors, k, rounds):
    """(vec_id, cluster, distance, centroid) of (vec_id, components) by full rounds."""
    x = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in vectors]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(x, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owner = [near(v)[1] for _, v in x]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(x, owner, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0], centroids[near(v)[1]]) for i, v in x]


def drawn(n, dims, seed, step=0.25):
    """On a coarse grid, so that distances tie."""
    rng = random.Random(seed)
    return [(i, [rng.randint(-3, 3) * step for _ in range(dims)]) for i in range(n)]


def test_delta_rounds_equal_full_rounds(spark):
    for k, rounds, seed in ((4, 5, 1), (7, 2, 2), (60, 3, 3)):
        rows = drawn(50, 3, seed) + [(None, [0.5, 0.5, 0.5]), (3, [0.1, 0.2, -0.3]), (3, [0.1, 0.2, -0.3])]
        df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
        got = delta_lloyd.cluster(df, k=k, rounds=rounds, dims=3).collect()
        want = lloyd(rows, k, rounds)
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.centroid_sha256) for r in got) == sorted((str(i), c, d, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for i, c, d, v in want)
        inertia = {c: sum(d for _, o, d, _ in want if o == c) for _, c, _, _ in want}
        assert all((r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values())) for r in got)


def test_only_what_moved_is_compared():
    """A vector whose owner stayed never sees the other centroids that stayed, even if they were nearer; and ties go to the smaller number."""
    x = np.array([[0, 0], [10, 0], [20, 0]])
    c = np.array([[0, 1], [9, 0], [10, 0], [10, 0]])
    owner, d = delta_lloyd.reassigned(x, np.array([0, 1, 3]), np.array([1, 1, 100]), c, np.array([False, False, True, True]))
    assert owner.tolist() == [0, 2, 2] and d.tolist() == [1, 0, 100]
    owner, _ = delta_lloyd.reassigned(x, np.array([3, 1, 1]), np.array([500, 1, 121]), c, np.array([False, False, False, False]))
    assert owner.tolist() == [3, 1, 1]


def test_clustering_awkward(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [3e38, 1.0]), (8, [-0.001, 0.999]), (9, [500000.0, -500000.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    got = rows_of(delta_lloyd.cluster(df, dims=2))
    assert [r[:4] for r in got] == [(8, 0, 0, 0), (9, 1, 0, 0)] or [r[:4] for r in got] == [(8, 1, 0, 0), (9, 0, 0, 0)]
    assert {r[5] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in ("-1,255", "128000000,-128000000")}
    assert delta_lloyd.cluster(df.where("vec_id < 8"), dims=2).count() == 0
    assert delta_lloyd.cluster(df.limit(0), dims=2).columns == delta_lloyd.cluster(df, dims=2).columns


# Filter audit


def audited(docs, labels):
    """Rows of the audit, each document led through each order."""
    seen, fails = {}, []
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""] = min(seen.get(t or "", i), i)
    for i, t, part in docs:
        t = t or ""
        w = t.encode().split()
        mask = {f for f, c in zip("ABCDE", (len(w) < 200, 2 * len(set(w)) < len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and seen[t] < i), strict=True) if c}
        fails.append((part or "", mask, any(q == 1 for d, q, _ in labels if d == i and d is not None), any(x == 1 for d, _, x in labels if d == i and d is not None)))
    out = []
    for part in {f[0] for f in fails}:
        mine, removals, rows = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removals[f] += len(gone)
                rows.append((f, part, "".join(order), k + 1, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*r[1:], removals[r[0]]) for r in rows]
    return sorted(out, key=lambda r: tuple(map(str, r)))


def test_audit_against_every_order(spark):
    rng = random.Random(4)
    long = " ".join(f"w{k}" for k in range(300))
    texts = [None, "", "short text", "SHOUT # now", long, long + " #", long.upper(), "a " * 250, "a " * 250 + "%", "á É " + long]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b", "ü"])) for _ in range(150)]
    docs += [(41, long, "a")] * 3 + [(i, t, "awkward") for i, t in AWKWARD]
    labels = [(rng.choice([None, *range(45)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, part string, bits int")
    flags = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert rows_of(filter_audit.audit(df, flags)) == audited(docs, labels)


def test_audit_awkward(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(awkward(spark).withColumn("source", F.lit(None)).limit(0), labels).count() == 0
    got = filter_audit.audit(awkward(spark).withColumn("source", F.lit(None)), labels)
    assert got.count() == 600 and {r.part for r in got.collect()} == {""} and got.agg(F.sum("good_lost")).first()[0] == 0
    per = got.groupBy(F.substring("filter_order", F.col("step"), F.lit(1)).alias("f")).agg(F.sum("removed").alias("n"), F.min("shapley").alias("a"), F.max("shapley").alias("b")).collect()
    assert all(r.n == r.a == r.b for r in per)


# Jaccard join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)


def joined(rows):
    """(doc_id, n_shingles, component_id) of each row by all pairs."""
    sets = [shingles(t) for _, t in rows]
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    root = linked({k: sets[k] for k in named}, alike)
    least = {r: min(rows[k][0] for k in named if root[k] == r) for r in set(root.values())}
    return sorted(((i, len(sets[k]), least[root[k]] if k in root else None) for k, (i, _) in enumerate(rows)), key=lambda r: tuple(map(str, r)))


def copies(rng, n, groups, common=()):
    """Texts in groups of near copies; some hold a common passage."""
    vocabulary, out = [f"w{k}" for k in range(500)], []
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 120))] for _ in range(groups)]
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w + (list(common) if rng.random() < 0.3 else [])))
    return out


def test_jaccard_against_all_pairs(spark):
    for seed, cold, block in ((1, 64, 1024), (2, 3, 4)):
        rng = random.Random(seed)
        texts = copies(rng, 110, 25) + copies(rng, 60, 60, [f"p{k}" for k in range(30)])
        rows = [(i * 3 % 170, t) for i, t in enumerate(texts)] + AWKWARD + [(7, texts[0]), (7, texts[0])]
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int")
        assert rows_of(ngram_jaccard.similar_components(df, cold=cold, block=block)) == joined(rows)


def test_jaccard_of_one_large_group(spark):
    """Chains of small edits: far ends are not alike, but connected; what differs from all of them is not."""
    rng = random.Random(5)
    w = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(w)))
        w[rng.randrange(60)] = f"x{i}"
    rows += [(1000 + i, " ".join([f"w{k}" for k in range(30)] + [f"y{i}_{k}" for k in range(30)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_jaccard.similar_components(df, cold=5, block=16)) == joined(rows)


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(ngram_jaccard.similar_components(docs)) == joined(rows)


def test_jaccard_awkward(spark):
    assert rows_of(ngram_jaccard.similar_components(awkward(spark))) == joined(AWKWARD)
    assert ngram_jaccard.similar_components(awkward(spark).limit(0)).count() == 0


def test_order_and_bounds():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    last = ngram_jaccard.Last(np.empty(0, np.uint64)).before(s[[3, 1]]).before(s[[7]])
    full = last.prefix(s, len(s)).tolist()
    assert full == [x for k, x in enumerate(s.tolist()) if k not in (1, 3, 7)] + s[[7, 3, 1]].tolist() and last.prefix(s, 4).tolist() == full[:4]
    for n in (1, 4, 5, 9, 10, 100):  # two sets with the similarity have an overlap of 0.8 n at least
        assert ngram_jaccard.prefix_size(n, 80) == n - int(np.ceil(0.8 * n - 1e-9)) + 1
    for _ in range(50):
        x, y = (set(rng.integers(0, 300, 200).tolist()) for _ in range(2))
        b = [ngram_jaccard.bitmap(np.unique(np.array([v * 0x9E3779B97F4A7C15 % (1 << 64) for v in t], dtype=np.uint64))).view(np.uint64) for t in (x, y)]
        assert np.bitwise_count(b[0] ^ b[1]).sum() <= len(x ^ y)
