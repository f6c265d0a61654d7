"""The pipeline stage by stage against plain versions, and as a whole."""

import hashlib
import random
import re

import pytest
import tiktoken
from helpers import SF, awkward, edit_distance
from pyspark.sql import functions as F

import corpus_pipeline as P
from quernstone.llm import byte_bpe, line_dedup, queries

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def good(text):
    """The quality rules in plain Python."""
    import regex

    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if x.strip(BLANK)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    repeated = {i + j for i, x in enumerate(windows) if x in many for j in range(3)}
    chars = sum(map(len, w))
    fails = [
        len(w) < 50, 100 * len(repeated) > 50 * len(w), sum(c in "#*$%&|<>" for c in text) * 10 > len(w), chars < len(w) * 2 or chars > len(w) * 14,
        (len(lines) - len(set(lines))) * 10 > len(lines) * 3, sum(not regex.search(r"\p{L}", x) for x in w) * 5 > len(w), len(regex.findall(r"\p{Lu}", text)) * 2 > chars,
        sum(bool(re.match(r"[ \t\n\x0b\f\r]*[-*•]", x)) for x in lines) * 10 > len(lines) * 9, sum(bool(re.search(r"(\.\.\.|…)[ \t\n\x0b\f\r]*$", x)) for x in lines) * 10 > len(lines) * 3,
    ]
    return not any(fails)


def deduped(rows):
    """(doc_id, text, ...) without lines that stand earlier or near an earlier one."""
    first = {}
    for d, t in sorted(rows):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(BLANK):
                first.setdefault(x, (d, p))
    gone = set()
    lines = list(first)
    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if abs(len(x) - len(y)) <= line_dedup.EDITS and edit_distance(x, y) <= min(line_dedup.EDITS, min(len(x), len(y)) // line_dedup.PER_EDIT):
                gone.add(max((x, y), key=first.__getitem__))
    out = {}
    for d, t in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if not x.strip(BLANK) or first[x] == (d, p) and x not in gone]
        if not any(x.strip(BLANK) for x in (t or "").split("\n")) or any(x.strip(BLANK) for x in kept):
            out[d] = "\n".join(kept)
    return out


def apart(rows):
    """doc_ids that stay: the least of each group at five-word Jaccard of 0.8."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := words((t or "").lower())) else set() for d, t in rows.items()}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or x and y and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {d for d in ids if root(d) == d}


def planted(spark):
    """Good texts, junk, copies, near copies, texts that share lines."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeou") for _ in range(r.randrange(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    base = ["\n".join(line(12) for _ in range(8)) for _ in range(12)]
    shared = line(10)
    texts = base + [base[0], base[1] + "\n" + shared, "junk # $ %", "", None, "same words here " * 40, "\n".join(["- item of list"] * 30)]
    texts += ["\n".join(x[:-2] + "q." if i == 2 else x for i, x in enumerate(base[2].split("\n"))) + "\n" + line(60)]
    # one line of words each: line dedup leaves them, five-word Jaccard is above and below 0.8
    long = [word() for _ in range(300)]
    texts += [" ".join(long), " ".join(long[:150] + ["changed", "here"] + long[152:]), " ".join(w if i % 9 else word() for i, w in enumerate(long))]
    rows = [(i, t, ["en", "de"][i % 2], ["web", "books", "code"][i % 3], len(t or ""), i * 2) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")


def test_first_stages_against_plain_versions(spark):
    rows, docs = planted(spark)
    want = {d: t for d, t, *_ in rows if good(t)}
    kept = P.good(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == want and 8 < len(want) < len(rows)
    after = P.lines(spark, kept.persist(), SF).persist()
    lines = deduped(list(want.items()))
    assert {r.doc_id: r.text for r in after.collect()} == lines and len(lines) < len(want)
    assert all(r.n_chars == len(r.text) and r["a.b"] == 2 * r.doc_id for r in after.collect())
    stay = P.near(spark, after, SF)
    assert {r.doc_id for r in stay.collect()} == apart(lines) and len(apart(lines)) < len(lines)
    mixed = P.mix(spark, stay.persist(), SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= apart(lines)


def test_last_stage_against_the_library(spark):
    path, pattern = queries.vocabulary()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    _, docs = planted(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in P.encode(spark, docs, SF).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        sizes.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] == sizes[4] > 0
    whole = P.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("n", [0, 1 << 30])
def test_awkward(spark, n):
    """Nulls, empty and very long texts, repeated rows and clashing columns: the rules leave what the plain version leaves; a row for each in the last stage."""
    docs = awkward(spark).selectExpr("*", "'en' lang", "cast(null as string) source", "1L n_chars").withColumn("a.b", F.lit(1)).limit(n).persist()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in P.good(spark, docs, SF).collect()), key=key) == sorted((x for x in rows if good(x[1])), key=key)
    for stage in (P.lines, P.near, P.mix):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() <= len(rows) and {r.doc_id for r in got.collect()} <= {d for d, _ in rows}
    assert P.encode(spark, docs, SF).count() == len(rows)


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_near_takes_pairs_from_fingerprints(spark):
    """The near-duplicate stage proposes what SimHash links: fingerprints within two bits, and equal ones of different sets."""
    from quernstone.llm import simhash

    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(4000))
    docs = [(1, text), (2, text + " more"), (3, " ".join(f"v{rng.randrange(900)}" for _ in range(4000))), (4, None)]
    rows = simhash.sketches(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 5).collect()
    assert {r.doc_id: r.mark for r in rows} == {d: simhash.fingerprint_of((t or "").encode(), 3) for d, t in docs}
    base = rows[0].mark
    marks = {10: base, 11: base, 12: base ^ 3, 13: base ^ 7, 14: ~base}
    got = {(r.a, r.b) for r in simhash.simhash_pairs(spark.createDataFrame(list(marks.items()), "fp long, mark long")).collect()}
    assert got == {(10, 11), (10, 12), (12, 13)}


def test_only_prefixes_become_rows_and_they_meet_all_alike(spark):
    from quernstone.llm import simhash

    r = random.Random(9)
    passage, sets = list(range(-400, 0)), {}  # what all sets have comes first in the order by number
    for i in range(90):
        own = [r.randrange(1, 1 << 40) for _ in range(r.randrange(5, 300))]
        sets[2 * i] = sorted({*passage, *own})
        sets[2 * i + 1] = sorted({*passage[r.randrange(90) :], *own[r.randrange(len(own)) :]})
    df = spark.createDataFrame(list(sets.items()), "fp long, shingles array<long>").repartition(8)
    keys = simhash.prefix_keys(df, 80)
    assert "shingles" not in keys._jdf.queryExecution().toString()  # sets aren't listed again for the result
    rows = keys.collect()
    assert all(n <= len(sets[fp]) - -(-len(sets[fp]) * 4 // 5) + 1 for fp, n in keys.groupBy("fp").agg(F.count("*")).collect())
    held = {}
    for x in rows:
        held.setdefault(x.key, {})[x.fp] = x.at
    met = {(a, b) for fps in held.values() for a in fps for b in fps if a < b}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert alike and alike <= met and len(met) < len(sets) * (len(sets) - 1) // 2
    assert {x.key for x in simhash.frequent_shingles(df, 64).collect()} == set(passage)
