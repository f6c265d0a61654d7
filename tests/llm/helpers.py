"""Brute-force versions and awkward inputs that the tests of this folder share."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb

SF = "/root/testdata/sf0.001"

#: Nulls, empties, blanks, ties, repeated rows and one very long text.
AWKWARD = [
    (1, "The cat sat on the mat. " * 3),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, "no id but some words here"),
    (5, "The cat sat on the mat. " * 3),
    (5, "The cat sat on the mat. " * 3),
    (6, "one"),
    (7, "é" * 10 + "\n\n" + "línea repetida dos veces aquí\n" * 2),
    (8, "long " * 20000),
]


def awkward(spark):
    """With extra columns whose names operators might use themselves."""
    rows = [(i, t, "x", 1) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


def duck(sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def simhash(data: bytes, width: int) -> int:
    import xxhash

    w = data.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(items: dict, near) -> dict:
    """id -> smallest id reachable over near(x, y)."""
    ids = sorted(items)
    best = {i: i for i in ids}
    todo = True
    while todo:
        todo = False
        for i in ids:
            for j in ids:
                if near(items[i], items[j]) and best[j] < best[i]:
                    best[i], todo = best[j], True
    return best


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeats(docs, n=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row."""
    rank = lambda d: 1 << 62 if d is None else d
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], 1 << 63), rank(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < rank(d):
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def kneser_ney(docs, n, discounts):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, by the textbook formulas."""
    out_ = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    start, end = ("start",), ("end",)
    texts = [(d, [start] * (n - 1) + [(w,) for w in (t or "").encode().lower().split()] + [end]) for d, t in docs]
    raw = [Counter() for _ in range(n + 1)]
    for d, s in texts:
        for i in range(n - 1, len(s)) if not out_(d) else ():
            for m in range(1, n + 1):
                raw[m][tuple(s[i - m + 1 : i + 1])] += 1
    counts = [None] * n + [dict(raw[n])]
    for m in range(n - 1, 0, -1):
        c = Counter(g[1:] for g in counts[m + 1] if g[1] != start)
        c.update({g: k for g, k in raw[m].items() if g[0] == start})
        counts[m] = dict(c)
    cut = [None] + [discounts(*(sum(1 for c in counts[m].values() if c == k) for k in (1, 2, 3, 4))) for m in range(1, n + 1)]
    words, tokens = len(raw[1]), sum(raw[1].values())
    after = [defaultdict(lambda: [0, 0, 0, 0]) for _ in range(n + 1)]
    for m in range(1, n + 1):
        for g, c in counts[m].items():
            x = after[m][g[:-1]]
            x[0] += c
            x[min(c, 3)] += 1

    def p(m, g):
        if not m:
            return 1 / (words + 1)
        x, lower = after[m].get(g[:-1]), p(m - 1, g[1:])
        if not x or not x[0]:
            return lower
        c = counts[m].get(g, 0)
        return max(c - cut[m][min(c, 3)], 0) / x[0] + sum(cut[m][k] * x[k] for k in (1, 2, 3)) / x[0] * lower

    result = []
    for d, s in texts:
        at = range(n - 1, len(s))
        known = [raw[1].get((s[i],), 0) for i in at]
        base = sum(math.log10((c + 1) / (tokens + words + 1)) for c in known)
        result.append((d, out_(d), len(at), sum(c > 0 for c in known), tokens, base, sum(math.log10(p(n, tuple(s[i - n + 1 : i + 1]))) for i in at)))
    return result
