"""The ten operators: brute force or SQL on small tables, and awkward inputs."""

import hashlib
import random

import pytest
from helpers import AWKWARD, SF, awkward, duck, edit_distance, kneser_ney, linked, repeats, rows_of, simhash
from pyspark.sql import functions as F

from quernstone.llm import byte_bpe, line_dedup, mixing, ngram_lm, oracle, order_minhash, quality_classifier, quality_rules, queries, sharding, suffix_dedup
from quernstone.llm import simhash as S
from quernstone.operators.graph import connected_components

EMPTY = "doc_id long, text string"


def same(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck().sql(oracle.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a = sorted(tuple(r[c] for c in order) for r in got.collect())
    b = sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
    assert a == b
    assert a


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_sql_twins(spark, name):
    same(spark, name)


# Mixing


def test_shortages_go_to_siblings_first(spark):
    """Domain a lacks one language: the other one of a gets its share, not domain b."""
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "domain string, lang string, tokens long")
    plan = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, ["domain", "lang"], [{"a": 0.5, "b": 0.5}, {}], 0.2, 1).collect()}
    assert plan == {("a", "x"): 10, ("a", "y"): 191, ("b", "x"): 201}


def test_ancestors_get_what_a_whole_subtree_lacks(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 10), ("b", "x", 980)], "domain string, lang string, tokens long")
    plan = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, ["domain", "lang"], [{}, {}], 0.5, 1).collect()}
    assert plan == {("a", "x"): 10, ("a", "y"): 10, ("b", "x"): 480}


def test_weights_of_zero(spark):
    """A source of weight 0 gets nothing and its siblings its share; what is below such a domain is not counted as able to fill anything."""
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 1000), ("b", "x", 1000), ("c", "x", 1000), ("d", "y", 1000)], "domain string, lang string, tokens long")
    plan = lambda *w: {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, ["domain", "lang"], list(w), 0.1, 1).collect()}
    assert plan({"c": 0.0}, {"x": 0.0}) == {("a", "x"): 0, ("a", "y"): 205, ("b", "x"): 0, ("c", "x"): 0, ("d", "y"): 205}
    assert plan({"c": 0.0}, {}) == {("a", "x"): 68, ("a", "y"): 68, ("b", "x"): 136, ("c", "x"): 0, ("d", "y"): 136}
    assert set(plan(dict.fromkeys("abcd", 0.0), {}).values()) == {0} and set(plan({}, {"x": 0, "y": 0}).values()) == {0}
    for wrong in (-0.1, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weights"):
            plan({"a": wrong}, {})
    docs = spark.createDataFrame([(i, "w w w", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    out = mixing.mix(docs, {"lang": F.col("lang")}, [{"a": 0.0}], F.lit(3), share=0.3).collect()
    assert len(out) == 6 and {r.lang for r in out} == {"b"}
    assert mixing.mix(docs, {"lang": F.col("lang")}, [{"a": 0.0, "b": 0.0}], F.lit(3)).count() == 0


def test_mix_awkward(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("epoch", F.lit("own"))
    out = mixing.mix(docs, {"lang": F.col("lang")}, [{}], F.size(F.split(F.coalesce("text", F.lit("")), " ")), share=2.0, max_epochs=2)
    assert out.count() == 2 * len(AWKWARD) and out.columns[:6] == docs.columns and "_epoch" in out.columns
    assert mixing.mix(docs.limit(0), {"lang": F.col("lang")}, [{}], F.lit(1)).count() == 0


# Quality classifier


def test_classifier_on_labels(spark):
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert sum(got[r.doc_id].kept == (r.quality == 1) for r in labels) >= 0.97 * len(labels)
    assert all(0 <= r.quality <= 1 and 0 < r.path_rate < 1 for r in got.values())


def test_sparse_sites_follow_their_parents(spark):
    docs = spark.createDataFrame([(i, "w " * 60, "big" if i else "small") for i in range(200)], "doc_id long, text string, host string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels, F.col("host"), F.col("host")).collect()}
    assert abs(got[0].path_rate - got[1].path_rate) < 0.05 and {round(r.evidence, 6) for r in got.values()} == {0.0}


def test_kappa_sees_what_is_inside_sites(spark):
    """Documents that agree inside their sites: the site is trusted. Sites that differ by chance alone: the prior is."""
    import numpy as np

    rng = np.random.default_rng(1)

    def worth(values):
        rows = [(len(v), float(np.sum(v)), float(np.sum(np.square(v)))) for v in values]
        return quality_classifier.kappa(spark.createDataFrame(rows, "n long, s double, q double"), F.lit(float(np.mean(np.concatenate(values)))))

    assert worth([np.full(50, 0.45 + 0.1 * (k % 2)) for k in range(100)]) == 1.0
    assert worth([rng.uniform(0, 1, 50) for _ in range(100)]) > 100
    mixed = [0.5 + (0.1 if k % 2 else -0.1) + rng.normal(0, 0.3, 40) for k in range(400)]
    assert abs(worth(mixed) - 0.09 / 0.01) < 2.5  # 0.3 squared over 0.1 squared
    assert worth([np.array([x]) for x in rng.uniform(0, 1, 50)]) >= 1 and quality_classifier.kappa(spark.createDataFrame([], "n long, s double, q double"), F.lit(0.5)) == 1.0


def test_classifier_on_held_out_labels(spark):
    """Fitted without a third of the labels, which it then gets right."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.where("pmod(xxhash64(doc_id), 3) = 0").collect()}
    got = quality_classifier.classify(docs, labels.where("pmod(xxhash64(doc_id), 3) <> 0"), F.col("source"), F.concat_ws("/", "source", "lang"))
    right = [r.kept == (held[r.doc_id] == 1) for r in got.collect() if r.doc_id in held]
    assert len(right) == len(held) > 15 and sum(right) >= 0.9 * len(right)


def test_classifier_against_a_plain_version(spark):
    """Features, Newton steps, shrinkage and posterior, written out in plain Python and numpy."""
    import math

    import numpy as np

    r = random.Random(4)
    docs = [(i, "\n".join(" ".join(r.choice(["Aa", "bb", "c1!", "#", "dddd"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 4))), r.choice(["x", "y", "z"]), r.choice("pq")) for i in range(90)] + [(90, None, None, None), (91, "", "x", "rare")]
    labels = [(i, int("!" in (docs[i][1] or "") or i % 7 == 0)) for i in range(0, 60)]

    def shape(text):
        text = text or ""
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n, chars = max(len(words), 1), max(len(text), 1)
        return [math.log1p(len(words)), sum(map(len, words)) / n / 10, sum(c in "#*$%&|<>" for c in text) / n, sum(c.isupper() for c in text) / chars, sum(c.isdigit() for c in text) / chars, (len(lines) - len(set(lines))) / max(len(lines), 1), text.count("!") / n, len(set(words)) / n]

    x = np.array([shape(t) for _, t, _, _ in docs])
    taught, y = x[[i for i, _ in labels]], np.array([q for _, q in labels], float)
    mean, spread = taught.mean(0), taught.std(0) + 1e-9
    z, b = np.c_[np.ones(len(y)), (taught - mean) / spread], np.zeros(9)
    for _ in range(quality_classifier.ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        b = b + np.linalg.solve((z * w[:, None]).T @ z + quality_classifier.RIDGE * np.eye(9), z.T @ (y - p) - quality_classifier.RIDGE * b)
    evidence = np.clip(np.c_[np.ones(len(x)), (x - mean) / spread] @ b, -12, 12)
    p = 1 / (1 + np.exp(-evidence))
    host = [h or "" for _, _, h, _ in docs]
    path = [(h or "", q or "") for _, _, h, q in docs]
    prior = p.mean()

    def moments(groups, priors):
        """Pooled variance inside groups over the variance of their true means, by a one-way analysis of variance."""
        within = sum(np.var(p[g], ddof=1) * (len(g) - 1) for g in groups if len(g) > 1) / (len(p) - len(groups))
        spread = np.mean([(p[g].mean() - prior) ** 2 for g, prior in zip(groups, np.broadcast_to(priors, len(groups)), strict=True) for _ in g])
        return float(np.clip(within / max(spread - within * len(groups) / len(p), 1e-6), 1, 10_000))

    at = lambda names: {k: [i for i, v in enumerate(names) if v == k] for k in set(names)}
    hosts, paths = at(host), at(path)
    k_host = moments(list(hosts.values()), prior)
    shrunk = {h: (p[g].sum() + k_host * prior) / (len(g) + k_host) for h, g in hosts.items()}
    k_path = moments(list(paths.values()), np.array([shrunk[q[0]] for q in paths]))
    odds = lambda v: math.log(min(max(v, 1e-4), 1 - 1e-4) / (1 - min(max(v, 1e-4), 1 - 1e-4)))
    table = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    got = {g.doc_id: g for g in quality_classifier.classify(table, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    for i in range(len(docs)):
        g, q = hosts[host[i]], paths[path[i]]
        host_rate = (p[g].sum() - p[i] + k_host * prior) / (len(g) - 1 + k_host)
        path_rate = (p[q].sum() - p[i] + k_path * host_rate) / (len(q) - 1 + k_path)
        quality = 1 / (1 + math.exp(-(evidence[i] - odds(y.mean()) + odds(path_rate))))
        assert (got[i].evidence, got[i].host_rate, got[i].path_rate, got[i].quality) == pytest.approx((evidence[i], host_rate, path_rate, quality), rel=1e-6)
        assert got[i].kept == (got[i].quality >= 0.5)


def test_the_sample_of_labels_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"word {i}") for i in range(50)] + [(2, "other text!")], EMPTY)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels, F.lit("h"), F.lit("p"), sample=5).count() == 51


def test_classifier_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (3, None), (None, 1)], "doc_id long, quality int")
    docs = awkward(spark)
    got = quality_classifier.classify(docs, labels, F.lit(None), F.lit(None)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.quality <= 1 for r in got)
    assert quality_classifier.classify(docs.limit(0), labels, F.col("kept"), F.col("kept")).count() == 0


# Order MinHash


def test_edits_of_the_next_document(spark):
    docs = [(9, "a" * 30), (4, "b" * 7), (20, "hello world " * 5), (1, ""), (None, "z" * 9), (3, None)]
    got = {r.doc_id: r for r in order_minhash.with_edits(spark.createDataFrame(docs, EMPTY)).collect()}
    order = [20, 9, 4, 3, 1, None]
    texts = {d: t or "" for d, t in docs}
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes.fromhex(got[d].edited_fingerprint) == bytes.fromhex(order_minhash.written(order_minhash.signature(edited.encode())))
        assert got[d].near_next == float((order_minhash.signature(t.encode()) == order_minhash.signature(after.encode())).mean())


def plain_signature(data, k, picks, functions):
    """Order MinHash as its definition has it, one k-mer after the other, on Python's integers."""
    whole, half = (1 << 64) - 1, (1 << 32) - 1
    step, mix_a, mix_b, occurrence, pair = (int(x) for x in order_minhash.odd_factors(5, 64, 1))

    def mix(x):
        x = (x ^ x >> 29) * mix_a & whole
        x = (x ^ x >> 32) * mix_b & whole
        return x ^ x >> 31

    if not data:
        return [0] * functions
    padded = data if len(data) >= k else data + bytes(k - len(data))
    kmers = [mix(sum((c + 1) * pow(step, k - 1 - i, 1 << 64) for i, c in enumerate(padded[at : at + k])) & whole) for at in range(len(padded) - k + 1)]
    seen, items = {}, []
    for x in kmers:
        items.append(mix(x + seen.get(x, 0) * occurrence & whole) >> 32)
        seen[x] = seen.get(x, 0) + 1
    out = []
    for factor in order_minhash.odd_factors(functions, 32, 2):
        picked = sorted(sorted(range(len(items)), key=lambda i: (items[i] * int(factor) & half, i))[:picks])
        h = 0
        for n, i in enumerate(picked):
            h = mix(h * pair + kmers[i] + n + 1 & whole)
        out.append(h >> 48)
    return out


@pytest.mark.parametrize(("k", "picks", "functions"), [(12, 2, 32), (3, 4, 5), (7, 1, 8)])
def test_signatures_against_the_definition(k, picks, functions):
    r = random.Random(k)
    texts = [b"", b"a", b"short", b"ab" * 40, "é".encode() * 9, *(bytes(r.choice(b"abcd ") for _ in range(r.randrange(1, 400))) for _ in range(25)), bytes(r.choice(b"xyz") for _ in range(9000))]
    for t in texts:
        assert order_minhash.signature(t, k, picks, functions).tolist() == plain_signature(t, k, picks, functions)


def test_order_matters_and_small_edits_do_not():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text, moved = " ".join(words), " ".join(words[150:] + words[:150])
    like = lambda a, b: (order_minhash.signature(a.encode()) == order_minhash.signature(b.encode())).mean()
    assert like(text, text) == 1
    assert like(text, text[:900] + "#" + text[901:]) > 0.8
    assert like(text, moved) < 0.8 < like(text, text[:-20])
    assert like(text, " ".join(reversed(words))) < 0.3


def test_occurrences_are_counted():
    import numpy as np

    x = order_minhash.mixed(np.array([1, 2, 1, 1, 3, 2] * 50, dtype=np.uint64))
    seen, want = {}, []
    for v in x.tolist():
        want.append(seen.get(v, 0))
        seen[v] = want[-1] + 1
    assert order_minhash.occurrences(x).tolist() == want


def test_fingerprints_awkward(spark):
    got = order_minhash.with_edits(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    twins = {r.fingerprint for r in got if r.doc_id in (1, 5)}
    assert len(twins) == 1 and {r.fingerprint for r in got if r.doc_id in (2, 3)} == {"0000" * order_minhash.FUNCTIONS}
    assert order_minhash.with_edits(spark.createDataFrame([], EMPTY)).count() == 0
    a, b = order_minhash.fingerprints(awkward(spark)).where("doc_id in (1, 6)").select("fingerprint").collect()
    one = spark.createDataFrame([(a[0], b[0])], "a string, b string")
    assert 0 <= one.select(order_minhash.likeness(F.col("a"), F.col("b"))).first()[0] < 1


# Line dedup


def edited(r, s):
    i, kind = r.randrange(len(s)), r.choice("ids")
    return s[:i] + {"i": r.choice("abcdé") + s[i], "d": "", "s": r.choice("abcdé")}[kind] + s[i + 1 :]


@pytest.mark.parametrize(("hot", "edits", "per_edit"), [(64, 1, 10), (2, 1, 10), (64, 1, 1), (64, 2, 10), (64, 0, 1)])
def test_lines_within_edits(spark, hot, edits, per_edit):
    r = random.Random(5)
    pool = ["".join(r.choice("abcd é") for _ in range(n)).strip() + "xy" for n in (1, 7, 9, 11, 18, 20, 25, 90)]
    for _ in range(120):
        pool.append(edited(r, r.choice(pool)))
    docs = [(i, "\n".join(r.choice([*pool, "", " "]) for _ in range(r.randrange(1, 7)))) for i in range(60)] + [(None, pool[3]), (7, None)]
    first, copies = {}, {}
    for d, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip():
                first[x] = min(first.get(x, (1 << 62, 0)), (-1 if d is None else d, p))
                copies[x] = copies.get(x, 0) + 1
    want = set()
    for x in first:
        near = [y for y in first if y != x and edit_distance(x, y) <= min(edits, min(len(x), len(y)) // per_edit)]
        want.add((*first[x], len(x), copies[x], len(near), not any(first[y] < first[x] for y in near)))
    got = {(-1 if x.d is None else x.d, x.p, x.n_chars, x.n_copies, x.n_links, x.kept) for x in line_dedup.join_lines(spark.createDataFrame(docs, EMPTY), edits=edits, per_edit=per_edit, hot=hot).collect()}
    assert got == want


def test_a_hot_segment_at_two_edits(spark):
    """All lines share their first half, so its key is hot; the links are those of their ends."""
    r = random.Random(8)
    lines = sorted({"the same start " + "".join(r.choice("abc") for _ in range(9)) for _ in range(220)})
    want = {x: sum(edit_distance(x[15:], y[15:]) <= 2 for y in lines) - 1 for x in lines}
    docs = spark.createDataFrame(list(enumerate(lines)), EMPTY)
    got = {lines[x.d]: x.n_links for x in line_dedup.join_lines(docs, edits=2, hot=8).collect()}
    assert got == want


def test_members_and_pairs_of_lines(spark):
    a, b, other = "a line of more than twenty letters", "a line of more than twenty lettersX", "another text that stands alone here"
    docs = [(3, f"{a}\n{other}"), (7, a), (8, f"\n{b}\n{a}"), (None, other)]
    got = [tuple(x) for x in line_dedup.members_and_pairs(spark.createDataFrame(docs, EMPTY)).collect()]
    assert sorted(x[1:5] + x[6:] for x in got if x[0] == "member" and x[1] is not None) == [
        (3, 0, 3, 0, 3, 1, True), (3, 1, None, 0, 2, 0, False), (7, 0, 3, 0, 3, 1, False), (8, 1, 8, 1, 1, 1, False), (8, 2, 3, 0, 3, 1, False)]
    assert [x[1:5] + x[8:] for x in got if x[0] == "member" and x[1] is None] == [(None, 0, None, 0, True)]
    assert [x[1:] for x in got if x[0] == "pair"] == [(8, 1, 3, 0, None, None, None, None)]


def test_dedup_lines_awkward(spark):
    docs = awkward(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[2] == [None] and by[3] == [""] and by[4] == [" \t\n "]
    assert by[7] == ["é" * 10 + "\n\nlínea repetida dos veces aquí\n"]
    assert 5 not in by and len(by[1]) == 1 and by[8] == ["long " * 20000]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# Quality rules


def test_cascade_order_changes_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = rows_of(quality_rules.quality_rules(docs).select("doc_id", "kept"))
    b = rows_of(quality_rules.quality_rules(docs, rules=quality_rules.RULES[::-1]).select("doc_id", "kept"))
    assert a == b and {k for _, k in a} == {True, False}


def test_rules_awkward(spark):
    docs = awkward(spark)
    got = quality_rules.quality_rules(docs)
    assert got.columns[:4] == docs.columns and "_n_words" in got.columns and "_kept" in got.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[8]["_n_words"] == 20000 and by[8].n_repeat_words == 20000 and by[2].base_failed and by[7].n_dup_lines == 1
    assert quality_rules.keep_good(docs.limit(0)).count() == 0 and quality_rules.keep_good(docs).columns == docs.columns


# Sharding


def test_lookup_table():
    table = sharding.lookup_table([f"s{i}" for i in range(16)])
    sizes = [table.count(i) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1 and len(table) == sharding.SLOTS
    less = sharding.lookup_table([f"s{i}" for i in range(15)])
    assert sum(a != b for a, b in zip(table, less, strict=True) if a != 15) < 0.15 * len(table)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_sharding_awkward(spark, tmp_path):
    docs = awkward(spark).withColumn("shard", F.lit("own"))
    got = sharding.assign_shards(docs)
    assert got.columns == [*docs.columns, "slot", "_shard"] and got.count() == len(AWKWARD)
    assert got.where("doc_id = 5").select("slot").distinct().count() == 1 and got.where("doc_id is null").count() == 1
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    sharding.write_shards(awkward(spark), str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(AWKWARD)


# Byte-level BPE


def test_bpe_equals_the_reference_tokenizer(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = queries.vocabulary()
    codec = byte_bpe.Codec(path, pattern)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    r = random.Random(3)
    odd = [chr(i) for i in (*range(256), 0x85, 0x1680, 0x180E, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x1D7D8, 0x4E00, 0x430, 0x1F600, 0x301, 0x660)]
    texts = ["".join(r.choice(odd if r.random() < 0.5 else "abc th \n\t  ing's1290.!") for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(3000)]
    texts += ["", "a" * 20000, " " * 20000, "ab" * 9999, "<|endoftext|>"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_awkward(spark):
    path, pattern = queries.vocabulary()
    got = byte_bpe.round_trip(awkward(spark), path, pattern).collect()
    assert len(got) == len(AWKWARD)
    texts = {d: (t or "").encode() for d, t in AWKWARD}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest() for r in got)
    ids = byte_bpe.encode(awkward(spark), path, pattern)
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(ids, path, pattern).collect()} == texts
    assert byte_bpe.round_trip(spark.createDataFrame([], EMPTY), path, pattern).count() == 0


# SimHash


def test_simhash_components(spark):
    r = random.Random(4)
    base = " ".join(r.choice(["of", "the", "cat", "dog", "tree", "stone", "river", "hill"]) for _ in range(300))
    docs = [(i, base if i % 3 else " ".join(w if r.random() > 0.004 else "new" for w in base.split())) for i in range(40)]
    docs += [(100 + i, " ".join(r.choice("abcdefghij") for _ in range(40))) for i in range(20)] + [(200, None), (201, ""), (202, "one two")]
    items = {i: simhash((t or "").encode(), 3) for i, t in docs}
    best = linked(items, lambda a, b: (a ^ b).bit_count() <= 2)
    for hot in (24, 1):
        got = {(x.doc_id, x.fingerprint, x.component_id) for x in S.near_duplicates(spark.createDataFrame(docs, EMPTY), hot=hot).collect()}
        assert got == {(i, f"{items[i]:016x}", best[i]) for i in items}


@pytest.mark.parametrize("distance,blocks", [(2, 5), (4, 7)])
def test_links_connect_what_is_near(spark, distance, blocks):
    r = random.Random(distance)
    fps = {0}
    while len(fps) < 150:
        f = r.choice(sorted(fps)) if r.random() < 0.8 else r.getrandbits(63)
        for _ in range(r.randrange(1, 5)):
            f ^= 1 << r.randrange(63)
        fps.add(f)
    items = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f, i) for i, f in items.items()], "fp long, id long")
    best = linked(items, lambda a, b: (a ^ b).bit_count() <= distance)
    for hot in (24, 1):
        found = {x.id: x.component for x in connected_components(S.links(nodes, distance, blocks, hot)).collect()}
        assert {i: found.get(i, i) for i in items} == best


def test_simhash_awkward(spark):
    got = S.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[5].component_id == 1 and {by[i].component_id for i in (2, 3, 4)} == {2}
    kept = S.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "7", "8", "None"]
    assert S.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def shingles(t, width=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def test_keep_one_links_what_brute_force_links(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    docs = [(1000 + i, " ".join(word() for _ in range(r.choice([4, 8, 30, 60, 200])))) for i in range(60)]
    for i in range(250):  # a few changed words, or a sentence more
        w = r.choice(docs)[1].split()
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = word()
        docs.append((r.randrange(10**6, 10**7), " ".join(w + [word() for _ in range(r.choice([0, 0, 5]))])))
    base = [word() for _ in range(120)]
    docs += [(50 + i, " ".join(base[:j] + [word()] + base[j + 1 :])) for i, j in enumerate(r.choices(range(120), k=60))] + [(5, " ".join(base)), (6, None), (7, "")]
    items = {i: shingles(t) for i, t in docs}
    pairs = [(a, b) for a in items for b in items if a < b and alike(items[a], items[b])]
    assert len(pairs) > 300
    up = {i: i for i in items}
    for _ in items:
        before = dict(up)
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    want = sorted(i for i in up if up[i] == i)
    for hot in (24, 2):
        assert sorted(x.doc_id for x in S.keep_one(spark.createDataFrame(docs, EMPTY), hot=hot).collect()) == want


# N-gram model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(spark, order):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["the", "of", "A", "a", "cat", "dog", f"x{r.randrange(30)}"]) for _ in range(r.randrange(30)))) for i in range(150)]
    docs += [(None, "the cat"), (3, "the cat"), (4, None), (5, "")]
    key = lambda x: (str(x[0]), x[2], round(x[6], 6))
    got = sorted((tuple(x) for x in ngram_lm.perplexity_scores(spark.createDataFrame(docs, EMPTY), order=order).collect()), key=key)
    want = sorted(kneser_ney(docs, order, ngram_lm.discounts), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


@pytest.mark.parametrize("order", [1, 3])
def test_a_stored_model_scores_alike(spark, tmp_path, order):
    docs = spark.createDataFrame([(i, " ".join("abcdefg"[i * k % 7] for k in range(i % 11))) for i in range(60)] + [(None, None)], EMPTY)
    ngram_lm.store_model(docs, str(tmp_path), order=order)
    rounded = lambda df: sorted((str(r.doc_id), *r[1:5], round(r.base_score, 9), round(r.score, 9)) for r in df.collect())
    assert rounded(ngram_lm.model_scores(docs, str(tmp_path))) == rounded(ngram_lm.perplexity_scores(docs, order=order))
    other = spark.createDataFrame([(1, "a z unknown a b"), (2, "")], EMPTY)
    got = {r.doc_id: r for r in ngram_lm.model_scores(other, str(tmp_path)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[2].n_tokens) == (6, 4, 1) and got[1].score < got[2].score < 0


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.op9_ngram_lm(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_the_query_sees_two_words_of_context(spark, tmp_path):
    docs = [(i, "a b c d e" if i % 2 else "x b y d z") for i in range(40)] + [(100, "a b c"), (101, "x b c")]
    spark.createDataFrame(docs, EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, round(r.score, 6)) for r in queries.op9_ngram_lm(spark, str(tmp_path)).collect())
    assert got == sorted((x[0], round(x[6], 6)) for x in kneser_ney(docs, 3, ngram_lm.discounts))


def test_scores_awkward(spark):
    got = ngram_lm.perplexity_scores(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) and all(r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert ngram_lm.perplexity_scores(spark.createDataFrame([], EMPTY)).count() == 0


# Suffix-array dedup


@pytest.mark.parametrize("hot", [64, 2, 1])
def test_repeats_of_fifty_bytes(spark, hot):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh é") for _ in range(400)) for _ in range(6)]
    docs = []
    for _ in range(80):
        t = ""
        for _ in range(r.randrange(6)):
            b, s = r.choice(base), r.randrange(350)
            t += b[s : s + r.choice([20, 49, 50, 51, 60, 100])] + r.choice(["", "x", "yy"])
        docs.append((r.randrange(100), t))
    docs += [(None, base[0]), (500, "a" * 300), (501, "a" * 70 + "b" * 60), (502, None), (503, ""), (504, base[1]), (3, base[1]), (504, base[1])]
    core = "".join(r.choice("xyz") for _ in range(25))
    for i in range(40):
        docs.append((600 + i, "".join(r.choice("ab") for _ in range(12)) + core + "".join(r.choice("ab") for _ in range(14)) + core + "ab" * 20))
    assert rows_of(suffix_dedup.repeat_digests(spark.createDataFrame(docs, EMPTY), hot=hot)) == sorted(repeats(docs), key=lambda x: tuple(map(str, x)))


def test_loser_tree_merges_by_known_prefixes():
    r = random.Random(6)
    runs, every = [], []
    for g in range(5):
        texts = sorted("".join(r.choice("ab") for _ in range(r.randrange(1, 30))).encode() for _ in range(r.randrange(1, 40)))
        every += texts
        shared, rests, body = suffix_dedup.front_coded(texts)
        import numpy as np

        n = len(texts)
        head = np.stack([shared, rests, np.zeros(n, np.uint8)]).tobytes() + body
        numbers = np.r_[np.ones(n), np.zeros(3 * n)].astype(np.int64)
        runs.append(suffix_dedup.Run(g, n, suffix_dedup.pack(np.frombuffer(head, np.uint8)), suffix_dedup.pack(numbers.view(np.uint8).reshape(-1, 8).T)))
    got, before = [], b""
    for run, shared in suffix_dedup.merged(runs):
        assert not got or shared == suffix_dedup.common(before, run.now, 0)
        got.append(run.now)
        before = run.now
    assert got == sorted(every)


def test_ranges_as_arrays_give_the_spans_of_the_loser_tree():
    import numpy as np
    import pyarrow as pa

    r, length, k = random.Random(8), 12, 4
    base = [bytes(r.choice(b"ab\0") for _ in range(60)) for _ in range(4)]
    cut = lambda b: (lambda i: b[i : i + r.randrange(30)])(r.randrange(50))
    tables, asked = {}, []
    for g in range(5):
        rows = [(None if r.random() < 0.05 else r.randrange(60), b"".join(cut(r.choice(base)) for _ in range(r.randrange(6)))) for _ in range(25)]
        ids, texts = zip(*rows, strict=True)
        tables[g] = pa.table({"grp": pa.array([g] * 25, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "data": pa.array(texts, pa.binary())})
        asked.append(suffix_dedup.ask(tables[g], 2, length, k))
    of = lambda t, c, v: t.filter(pa.array(t.column(c).to_numpy() == v))
    asked = pa.concat_tables(asked)
    for hot in (4, 1, 64):
        answered = pa.concat_tables([suffix_dedup.answer(of(asked, "shard", s), hot) for s in range(2)])
        runs = pa.concat_tables([suffix_dedup.send(t, of(answered, "grp", g), 2, length, k) for g, t in tables.items()])
        for s in range(2):
            found = []
            for most in (1 << 30, 0):
                spans = suffix_dedup.compare(of(runs, "shard", s), length, k, most).to_pylist()
                found.append({x["grp"]: sorted(map(tuple, suffix_dedup.unpack(x["data"], np.int32).reshape(-1, 3).tolist())) for x in spans})
            assert found[0] == found[1] and any(found[0].values())


def test_repeats_awkward(spark):
    got = suffix_dedup.remove_repeats(awkward(spark)).collect()
    want = {(d, n, k, s) for d, n, k, s, _ in repeats(AWKWARD)}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got} == want and len(got) == len(AWKWARD)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
