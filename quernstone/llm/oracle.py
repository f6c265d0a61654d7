"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quernstone.llm.mixing import DOMAINS, LANGUAGES, MAX_EPOCHS, SEED, SHARE  # noqa: F401
from quernstone.llm.sharding import SHARDS, SLOTS

BLANKS = r"[\x20\x09-\x0D]+"


def quality(table: str = "documents") -> str:
    """doc_id, the base metrics, base_failed and kept."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM {table}),
p AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '{BLANKS}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM p WHERE len(w) > 2),
t3 AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM t3) WHERE c > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY k),
m AS (SELECT p.k, doc_id, w, l, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN c USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_dup_lines > 3 * len(l)
             OR 5 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\pL'))) > n_words
             OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > word_chars
             OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\r\f\x0B]*[-*•]'))) > 9 * len(l)
             OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r\f\x0B]*$'))) > 3 * len(l) AS other_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT other_failed AS kept FROM f"""


def sharding() -> str:
    """The shards' turns as a recursion: each claims the first free slot of its order."""
    digest = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    return f"""
WITH RECURSIVE
prefs AS (SELECT list({digest.format("'offset|shard-' || s")} % {SLOTS} ORDER BY s) AS o,
                 list({digest.format("'skip|shard-' || s")} % ({SLOTS} - 1) + 1 ORDER BY s) AS k FROM range({SHARDS}) r(s)),
turns AS (
  SELECT 0::BIGINT AS turn, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner, -1::BIGINT AS slot FROM range(1)
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, i: CASE WHEN i - 1 = pick THEN turn % {SHARDS} ELSE x END), pick FROM (
    SELECT turn, owner, list_filter(list_transform(range({SLOTS}), lambda j: (o[turn % {SHARDS} + 1] + j * k[turn % {SHARDS} + 1]) % {SLOTS}),
                                    lambda s: owner[s + 1] = -1)[1] AS pick
    FROM turns, prefs WHERE turn < {SLOTS})),
claims AS (SELECT slot, ((turn - 1) % {SHARDS})::INTEGER AS shard FROM turns WHERE turn > 0),
d AS (SELECT doc_id, ({digest.format("coalesce(doc_id::VARCHAR, 'null')")} % {SLOTS})::BIGINT AS slot FROM documents)
SELECT doc_id, slot, shard FROM d JOIN claims USING (slot)"""


def weight(values: dict[str, float], name: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items())
    return f"CASE {name} {cases} ELSE 1::DOUBLE END" if values else "1::DOUBLE"


def filled(name: str, nodes: str, parents: list[str], child: str, budget: str) -> str:
    """CTEs that split budget among the children of each parent."""
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"{by} ORDER BY capacity / weight, {child}"
    return f"""
{name}_a AS (SELECT *, greatest({budget} - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
                       / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM {nodes}),
{name}_b AS (SELECT *, max(CASE WHEN lv * weight < capacity THEN lv END) OVER ({by}) AS level FROM {name}_a),
{name} AS (SELECT * EXCLUDE (lv, level), least(capacity, coalesce(level * weight, capacity)) AS budget FROM {name}_b)"""


def mixing(table: str = "documents", columns: str = "doc_id, domain, language, origin, epoch, n_tokens") -> str:
    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    tokens = f"len(list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> ''))::BIGINT"
    levels = ["domain", "language", "origin"]
    parts = []
    for i, (name, values) in enumerate(zip(levels, (DOMAINS, LANGUAGES, {}), strict=True)):
        own = ", ".join(levels[: i + 1])
        above = f"JOIN (SELECT {', '.join(levels[:i])}, budget AS above FROM f{i - 1}) USING ({', '.join(levels[:i])})" if i else f"CROSS JOIN (SELECT floor(sum(tokens) * {SHARE}::DOUBLE) AS above FROM leaves)"
        parts.append(f"n{i} AS (SELECT * FROM (SELECT {own}, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS capacity, sum(tokens)::BIGINT AS tokens, {weight(values, name)} AS weight FROM leaves GROUP BY {own}) {above}),")
        parts.append(filled(f"f{i}", f"n{i}", levels[:i], name, "above") + ",")
    h = f"md5(concat_ws('|', '{SEED}', whole, coalesce(doc_id::VARCHAR, 'null')))"
    return f"""
WITH d AS (SELECT *, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
                  coalesce([{domains}][(coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1)::INT], '') AS domain, {tokens} AS n_tokens FROM {table}),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{"".join(parts)}
plan AS (SELECT domain, language, origin, w AS whole, b - w * tokens AS more FROM (
  SELECT *, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS w FROM (SELECT *, floor(round(budget, 3))::BIGINT AS b FROM f2))),
ranked AS (SELECT d.*, whole, more, {h} AS h FROM d JOIN plan USING (domain, language, origin)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked),
taken AS (SELECT * EXCLUDE (h, upto), unnest(range((whole + CASE WHEN more > 0 AND upto <= more THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS epoch FROM upto)
SELECT {columns} FROM taken"""


def clustering(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds in full, one after the other."""
    square = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, vec_id, v, (b).k AS k, (b).d AS d FROM (SELECT i, vec_id, any_value(e.v) AS v, min({{'d': {square}, 'k': k}}) AS b FROM e, c{r} c GROUP BY i, vec_id))")
        if r < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, list({mean} ORDER BY j) AS v FROM (SELECT k, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims} + 1) g(j) GROUP BY k, j) GROUP BY k) m ON c.k = m.k)")
    return f"""
WITH raw AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS MATERIALIZED (SELECT i, vec_id, list_transform(x, lambda y: floor(256 * y)::BIGINT) AS v FROM raw
  WHERE len(x) = {dims} AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e ORDER BY h, v LIMIT {k})),
{", ".join(parts)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


def audit() -> str:
    """Each document goes through each order."""
    from itertools import permutations

    orders = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_concat(
  CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN ['C'] ELSE [] END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END,
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN ['E'] ELSE [] END) AS failed FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS earlier FROM (VALUES {orders}) v(filter_order), range(1, 6) r(step)),
x AS (SELECT part, filter_order, step::INTEGER AS step, own, list_contains(failed, own) AS fails, list_has_any(failed, earlier) AS gone, len(failed) AS c, good, toxic, n FROM m, o)
, s AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND c = 1), 0)::BIGINT AS unique_fails,
       coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s"""


ORACLES = {"op1_mixing": mixing(), "op5_quality_rules": quality(), "op6_sharding": sharding(), "op11_centroid_clustering": clustering(), "op12_filter_audit": audit()}
