"""Queries of scalar functions: text, formats, corruption, views, JSON, replies, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.hashing import u01
from quernstone.functions.vectors import l2_normalize, mrl_truncate, norm
from quernstone.operators import cells as C
from quernstone.operators.evaluate import fbeta
from quernstone.operators.ranking import numbered
from quernstone.plans.registry import CANDIDATES, CUST, CUST_CELLS, PARTS, Tables, cells_sql, query, u01_sql, u32_sql
from quernstone.plans.tables_queries import SYN_SQL, synonyms

WORDS = "list_filter(string_split_regex(lower({}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def serialized(columns: list[str]) -> str:
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} IS NOT NULL AND trim({c}::VARCHAR) <> '' THEN '{c}: ' || {c}::VARCHAR END" for c in columns) + ")"


@query("q_serialize_row", f"WITH {CUST} SELECT id, {serialized(['name', 'segment', 'nation', 'balance', 'sparse'])} AS text FROM cust")
def serialize_row(t: Tables) -> DataFrame:
    return t.cust.select("id", T.serialize_row(["name", "segment", "nation", "balance", "sparse"]).alias("text"))


@query("q_compose_text", f"WITH {PARTS} SELECT id, concat_ws(' | ', name, CASE WHEN type IS NOT NULL AND trim(type) <> '' THEN 'Артикул: ' || type END, CASE WHEN f <> name AND trim(f) <> '' THEN f END) AS text FROM (SELECT *, CASE WHEN id % 3 = 0 THEN name ELSE name || ' ' || brand END AS f FROM parts)")
def compose_text(t: Tables) -> DataFrame:
    full = F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.concat_ws(" ", "name", "brand"))
    return t.parts.select("id", T.compose_text(F.col("name"), "Артикул", F.col("type"), full).alias("text"))


@query("q_tokenize", f"SELECT doc_id, len({WORDS.format('text')}[1:2048]) AS n, md5(array_to_string(list_distinct({WORDS.format('text')}[1:2048]).list_sort(), ' ')) AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    """Number of a text's tokens, 2048 at most, and a digest of the different ones."""
    tok = T.tokenize(F.col("text"))
    return t.documents.select("doc_id", F.size(tok).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.array_distinct(tok)), " ").cast("binary")).alias("tokens"))


@query("q_flip_bool", "WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'true' WHEN 3 THEN 'false' ELSE lang END AS v FROM documents) SELECT doc_id, CASE v WHEN 'True' THEN 'False' WHEN 'False' THEN 'True' WHEN 'true' THEN 'false' WHEN 'false' THEN 'true' ELSE v END AS v FROM d")
def flip_bool(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    v = F.when(k == 0, "True").when(k == 1, "False").when(k == 2, "true").when(k == 3, "false").otherwise(F.col("lang"))
    return t.documents.select("doc_id", T.flip_bool(v).alias("v"))


CHANGE = "CASE WHEN regexp_full_match(trim(v), '\\d{4}') THEN '''' || substr(trim(v), 3, 2) WHEN regexp_full_match(trim(v), '(\\d+\\.?\\d*|\\.\\d+)') THEN CASE WHEN trim(v)::DOUBLE > 100 THEN format('{:,.1f}', trim(v)::DOUBLE) ELSE trim(v) END ELSE v END"
VALUES = "CASE o_orderkey % 6 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN (o_orderkey % 90)::VARCHAR WHEN 2 THEN ' ' || (o_orderkey * 7)::VARCHAR || '.25 ' WHEN 3 THEN o_orderpriority WHEN 4 THEN '.5' ELSE (o_orderkey * 1234)::VARCHAR END"


@query("q_change_format", f"WITH d AS (SELECT o_orderkey, {VALUES} AS v FROM orders) SELECT o_orderkey, {CHANGE} AS v FROM d")
def change_format(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 6 == 0, F.year("o_orderdate").cast("string")).when(k % 6 == 1, (k % 90).cast("string")).when(k % 6 == 2, F.concat(F.lit(" "), (k * 7).cast("string"), F.lit(".25 "))).when(k % 6 == 3, F.col("o_orderpriority")).when(k % 6 == 4, ".5").otherwise((k * 1234).cast("string"))
    return t.orders.select("o_orderkey", T.change_format(v).alias("v"))


def typo_sql(text: str, p: float, seed: int, *keys: str) -> str:
    """The walk over a text's places as a fold: [out, next place]."""
    return (
        f"list_reduce(list_transform(range(length({text})), lambda i: {{'o': '', 'i': i}}), lambda s, e: CASE WHEN e.i < s.i THEN s "
        f"WHEN e.i + 1 < length({text}) AND {u01_sql(seed, *keys, 'e.i')} < {p} THEN {{'o': s.o || substr({text}, e.i::INT + 2, 1) || substr({text}, e.i::INT + 1, 1), 'i': e.i + 2}} "
        f"ELSE {{'o': s.o || substr({text}, e.i::INT + 1, 1), 'i': e.i + 1}} END, {{'o': '', 'i': 0::BIGINT}}).o"
    )


@query("q_add_typo", f"SELECT p_partkey, CASE WHEN length(p_name) > 1 THEN {typo_sql('p_name', 0.2, 42, 'p_partkey')} ELSE p_name END AS name FROM part")
def add_typo(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.add_typo(F.col("p_name"), 0.2, 42, F.col("p_partkey")).alias("name"))


def drop_sql(text: str, p: float, seed: int, *keys: str) -> str:
    words = f"list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '')"
    return f"CASE WHEN len({words}) <= 1 THEN {text} ELSE coalesce(nullif(array_to_string(list_filter({words}, lambda x, i: {u01_sql(seed, *keys, 'i - 1')} >= {p}), ' '), ''), {words}[1]) END"


@query("q_drop_tokens", f"SELECT doc_id, {drop_sql('text', 0.3, 42, 'doc_id')} AS text FROM documents")
def drop_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.drop_tokens(F.col("text"), 0.3, 42, F.col("doc_id")).alias("text"))


def corrupt_sql(v: str, seed: int, *keys: str) -> str:
    u = u01_sql(seed, "'strategy'", *keys)
    return (
        f"CASE WHEN {v} IN ('True', 'False', 'true', 'false') THEN CASE {v} WHEN 'True' THEN 'False' WHEN 'False' THEN 'True' WHEN 'true' THEN 'false' ELSE 'true' END "
        f"WHEN {u} < 0.3 THEN CASE WHEN length({v}) > 1 THEN {typo_sql(v, 0.1, seed + 1, *keys)} ELSE {v} END WHEN {u} < 0.5 THEN {CHANGE.replace('trim(v)', f'trim({v})').replace('ELSE v END', f'ELSE {v} END')} WHEN {u} < 0.7 THEN {drop_sql(v, 0.3, seed + 2, *keys)} ELSE {v} END"
    )


@query("q_corrupt_value", f"WITH d AS (SELECT o_orderkey, {VALUES} AS v FROM orders) SELECT o_orderkey, {corrupt_sql('v', 42, 'o_orderkey')} AS v FROM d")
def corrupt_value(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 6 == 0, F.year("o_orderdate").cast("string")).when(k % 6 == 1, (k % 90).cast("string")).when(k % 6 == 2, F.concat(F.lit(" "), (k * 7).cast("string"), F.lit(".25 "))).when(k % 6 == 3, F.col("o_orderpriority")).when(k % 6 == 4, ".5").otherwise((k * 1234).cast("string"))
    return t.orders.select("o_orderkey", T.corrupt_value(v, 42, k).alias("v"))


CORRUPTED = f"CASE WHEN {u01_sql(11, chr(39) + 'row' + chr(39), 'id')} < 0.5 AND {u01_sql(11, chr(39) + 'cell' + chr(39), 'id', 'col')} < 0.4 THEN {corrupt_sql('val', 11, 'id', 'col')} ELSE val END"


@query("q_corrupt_table", f"WITH {CUST_CELLS} SELECT id, col, {CORRUPTED} AS val FROM cells")
def corrupt_table(t: Tables) -> DataFrame:
    return C.corrupt_cells(C.to_cells(t.cust), 11)


VSYN = [("segment", "BUILDING", ["construction", "works"]), ("segment", "MACHINERY", ["machines"]), ("nation", "3", ["three", "iii"])]
VSYN_SQL = "vsyn(col, val, vsyns) AS (VALUES ('segment', 'BUILDING', ['construction', 'works']), ('segment', 'MACHINERY', ['machines']), ('nation', '3', ['three', 'iii']))"


def applied_sql(cells: str, seed: int) -> str:
    pick = lambda a, *k: f"CASE WHEN len({a}) > 0 THEN {a}[{u32_sql(seed + 1, *k)} % len({a}) + 1] END"
    return (
        f"SELECT id, coalesce(CASE WHEN {u01_sql(seed, chr(39) + 'c' + chr(39), 'col')} < 0.75 THEN {pick('syns', 'col')} END, col) AS col, "
        f"coalesce(CASE WHEN {u01_sql(seed, chr(39) + 'v' + chr(39), 'id', 'col')} < 0.6 THEN {pick('vsyns', 'id', 'col')} END, val) AS val FROM {cells} LEFT JOIN syn USING (col) LEFT JOIN vsyn USING (col, val)"
    )


def value_synonyms(t: Tables) -> DataFrame:
    return t.rows("col string, val string, vsyns array<string>", *VSYN)


@query("q_apply_synonyms", f"WITH {CUST_CELLS}, {SYN_SQL}, {VSYN_SQL} {applied_sql('cells', 21)}")
def apply_synonyms(t: Tables) -> DataFrame:
    return C.apply_synonyms(C.to_cells(t.cust), synonyms(t), value_synonyms(t), 21)


@query("q_make_view", f"WITH {CUST_CELLS}, {SYN_SQL}, {VSYN_SQL}, dense AS (SELECT col FROM cells GROUP BY col HAVING count(*) >= 0.05 * (SELECT count(*) FROM cust)), d AS (SELECT * FROM cells WHERE col IN (SELECT col FROM dense) AND col <> 'constant'), view AS ({applied_sql('d', 11)}) SELECT id, col, {CORRUPTED} AS val FROM view")
def make_view(t: Tables) -> DataFrame:
    return C.make_view(C.to_cells(t.cust), t.customer.count(), synonyms(t), value_synonyms(t), 11, drop=["constant"])


@query("q_supplier_view", f"WITH {PARTS}, {cells_sql('parts', ['name', 'brand', 'type'])}, u AS (SELECT *, {u01_sql(3, 'id', 'col')} AS u FROM cells) SELECT id, col, CASE WHEN u < 0.3 THEN lower(val) WHEN u < 0.6 THEN upper(val) WHEN u < 0.8 THEN trim(val) ELSE val END AS val FROM u")
def supplier_view(t: Tables) -> DataFrame:
    cells, u, v = C.to_cells(t.parts.select("id", "name", "brand", "type")), u01(3, F.col("id"), F.col("col")), F.col("val")
    return cells.select("id", "col", F.when(u < 0.3, F.lower(v)).when(u < 0.6, F.upper(v)).when(u < 0.8, T.strip(v)).otherwise(v).alias("val"))


FLEX = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{''a'': None, ''b'': \"it''s\", ''k'': ' || json_extract_string(props, '$.k') || '}' WHEN 2 THEN '[1, ''x'', False]' WHEN 3 THEN '(1, ' || event_id || ')' ELSE event_type END"


@query("q_parse_flex", f"WITH d AS (SELECT event_id, props, {FLEX} AS raw FROM events) SELECT event_id, CASE WHEN starts_with(raw, '{{') THEN 'object' WHEN starts_with(raw, '[') OR starts_with(raw, '(') THEN 'array' ELSE 'none' END AS kind, CASE WHEN starts_with(raw, '{{') THEN json_extract_string(props, '$.k') END AS k, CASE WHEN contains(raw, 'it') AND starts_with(raw, '{{') THEN 'it''s' END AS b FROM d")
def parse_flex(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    literal = F.concat(F.lit("{'a': None, 'b': \"it's\", 'k': "), F.get_json_object("props", "$.k"), F.lit("}"))
    raw = F.when(k == 0, F.col("props")).when(k == 1, literal).when(k == 2, "[1, 'x', False]").when(k == 3, F.concat(F.lit("(1, "), F.col("event_id").cast("string"), F.lit(")"))).otherwise(F.col("event_type"))
    e = t.events.select("event_id", T.parse_flex(raw).alias("j"))
    kind = F.when(F.col("j").isNull(), "none").when(F.col("j").startswith("["), "array").otherwise("object")
    return e.select("event_id", kind.alias("kind"), F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.b").alias("b"))


@query("q_flatten_json", "SELECT event_id, 'props.' || unnest(json_keys(props)) AS col, json_extract_string(props, '$.' || unnest(json_keys(props))) AS val FROM events")
def flatten_json(t: Tables) -> DataFrame:
    """An object's keys as columns in the long form, prefixed."""
    m = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "val"))
    return m.select("event_id", F.concat(F.lit("props."), "key").alias("col"), "val")


@query("q_multi_hot", "WITH o AS (SELECT user_id, event_type FROM events), p AS (SELECT event_type FROM o GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3) SELECT o.user_id, p.event_type AS opt, bool_or(o.event_type = p.event_type) AS has FROM o, p GROUP BY 1, 2")
def multi_hot(t: Tables) -> DataFrame:
    """Which of the commonest options each user has; options beside each other in the long form, so any number works."""
    o = t.events.select("user_id", "event_type")
    top = o.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3).agg(F.collect_list("event_type").alias("options"))
    own = o.groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    hot = own.crossJoin(F.broadcast(top)).select("user_id", F.explode("options").alias("opt"), "own")
    return hot.select("user_id", "opt", F.array_contains("own", F.col("opt")).alias("has"))


@query("q_json_key_freq", "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k GROUP BY key")
def json_key_freq(t: Tables) -> DataFrame:
    return t.events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("q_array_len_stats", "WITH d AS (SELECT len(string_split(text, chr(10))) AS n FROM documents) SELECT avg(n) AS mean, min(n) AS least, max(n) AS most FROM d")
def array_len_stats(t: Tables) -> DataFrame:
    n = F.size(F.from_json(F.to_json(F.split("text", "\n")), "array<string>"))
    return t.documents.select(n.cast("long").alias("n")).agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("q_looks_structured", "WITH d AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN ' ' || props ELSE event_type END AS s FROM events UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT page_id, html FROM pages) SELECT CASE WHEN ltrim(s) LIKE '{%' OR ltrim(s) LIKE '[%' THEN 'json' WHEN ltrim(s) LIKE 'http://%' OR ltrim(s) LIKE 'https://%' THEN 'url' WHEN ltrim(s) LIKE '<%' THEN 'html' ELSE 'text' END AS kind, count(*) AS n FROM d GROUP BY 1")
def looks_structured(t: Tables) -> DataFrame:
    d = t.events.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "props")).otherwise(F.col("event_type")).alias("s")).union(t.pages.select("url")).union(t.pages.select("html"))
    return d.groupBy(T.looks_structured(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


@query("q_numeric_bucket", "WITH d AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS p FROM orders) SELECT (floor(coalesce(p, -1) / 10000) * 10000)::BIGINT AS bucket, count(*) AS n FROM d GROUP BY 1")
def numeric_bucket(t: Tables) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    return t.orders.groupBy(T.numeric_bucket(p, 10000).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("q_blocking_key", f"WITH {PARTS} SELECT lower(trim(coalesce(brand, '?'))) || '|' || lower(trim(coalesce(type, '?'))) AS k, count(*) AS n FROM parts GROUP BY 1")
def blocking_key(t: Tables) -> DataFrame:
    return t.parts.groupBy(T.blocking_key(F.col("brand"), F.col("type")).alias("k")).agg(F.count("*").alias("n"))


THOUGHTS = "CASE p_partkey % 5 WHEN 0 THEN '<think>x</think>' ELSE '<think>' || p_type || chr(10) || 'well</think>' || chr(10) || p_type || chr(10) || p_name || chr(13) || chr(10) || replace(p_brand, '#', '_') || chr(10) || 'Название' || p_partkey || chr(10) || 'x' END"
REPLIES_SQL = f"r AS (SELECT p_partkey AS id, {THOUGHTS} AS reply FROM part)"


def replies(t: Tables) -> DataFrame:
    """Replies of a model, made from parts: thoughts, names that are valid, names that aren't."""
    k = F.col("p_partkey")
    named = F.concat(F.lit("<think>"), "p_type", F.lit("\nwell</think>\n"), "p_type", F.lit("\n"), "p_name", F.lit("\r\n"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("\nНазвание"), k.cast("string"), F.lit("\nx"))
    return t.part.select(k.alias("id"), F.when(k % 5 == 0, "<think>x</think>").otherwise(named).alias("reply"))


@query("q_strip_think", f"WITH {REPLIES_SQL} SELECT id, regexp_replace(reply, '<think>.*?</think>', '', 'gs') AS text FROM r")
def strip_think(t: Tables) -> DataFrame:
    return replies(t).select("id", T.strip_think(F.col("reply")).alias("text"))


@query("q_parse_synonyms", f"WITH {REPLIES_SQL}, l AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(reply, '<think>.*?</think>', '', 'gs'), '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[\\pL\\pN_]{{1,80}}'))[1:3] AS n FROM r) SELECT id, CASE WHEN len(n) > 0 THEN array_to_string(n, ',') ELSE 'original' END AS names FROM l")
def parse_synonyms(t: Tables) -> DataFrame:
    return replies(t).select("id", F.array_join(T.parse_synonyms(F.col("reply"), F.lit("original"), 3), ",").alias("names"))


@query("q_extract_json", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def extract_json(t: Tables) -> DataFrame:
    """Objects alone, in a fence and inside text; replies without one, and with a broken one."""
    k = F.col("event_id") % 5
    reply = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("text "), "props", F.lit(" more"))).when(k == 3, "nothing").otherwise("{broken")
    return t.events.select("event_id", F.get_json_object(T.extract_json(reply), "$.k").alias("k"))


@query("q_parse_llm_array", "SELECT o_orderkey AS batch, o_custkey::INT AS pair, (o_orderstatus = 'F')::INT AS label, 'high' AS confidence FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, (o_custkey + 1)::INT, 0, NULL FROM orders WHERE o_orderkey % 3 = 1")
def parse_llm_array(t: Tables) -> DataFrame:
    """One pair or two in a reply, or none; a pair can lack its confidence."""
    k = F.col("o_orderkey") % 3
    first = F.concat(F.lit('Here: [{"pair": '), F.col("o_custkey").cast("string"), F.lit(', "match": '), (F.col("o_orderstatus") == "F").cast("string"), F.lit(', "confidence": "high"}'))
    second = F.concat(F.lit(', {"pair": '), (F.col("o_custkey") + 1).cast("string"), F.lit(', "match": false}'))
    r = t.orders.select(F.col("o_orderkey").alias("batch"), F.when(k == 0, "no array").when(k == 1, F.concat(first, second, F.lit("] ok"))).otherwise(F.concat(first, F.lit("]"))).alias("reply"))
    x = r.select("batch", F.inline(T.parse_array(F.col("reply"), "array<struct<pair:int,match:boolean,confidence:string>>")))
    return x.select("batch", "pair", F.col("match").cast("int").alias("label"), "confidence")


@query("q_format_prompt", f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (ORDER BY spec, nom) - 1 AS k FROM cand), l AS (SELECT k // 5 AS batch, k, (k % 5 + 1) || '. s' || spec || ' <-> n' || nom || ' (cos ' || format('{{:.3f}}', sim) || ')' AS line FROM r) SELECT batch, string_agg(line, chr(10) ORDER BY k) AS prompt FROM l GROUP BY batch")
def format_prompt(t: Tables) -> DataFrame:
    r = numbered(t.candidates(), "spec", F.col("nom"), name="k")
    line = F.format_string("%d. s%d <-> n%d (cos %s)", F.col("k") % 5 + 1, "spec", "nom", T.fixed(F.col("sim"), 3))
    l = r.select(F.floor(F.col("k") / 5).alias("batch"), "k", line.alias("line"))  # noqa: E741
    return l.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


@query("q_detect_lang", "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'товар ' || lang WHEN 1 THEN 'товар' WHEN 2 THEN '123' ELSE lang END AS s FROM documents), c AS (SELECT doc_id, length(regexp_replace(s, '[^а-яёА-ЯЁ]', '', 'g')) AS k, length(regexp_replace(s, '[^a-zA-Z]', '', 'g')) AS l FROM d) SELECT doc_id, CASE WHEN k > 0 AND l > 0 THEN 'mixed' WHEN k > 0 THEN 'cyrillic' WHEN l > 0 THEN 'latin' ELSE 'other' END AS script FROM c")
def detect_lang(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    s = F.when(k == 0, F.concat(F.lit("товар "), "lang")).when(k == 1, "товар").when(k == 2, "123").otherwise(F.col("lang"))
    return t.documents.select("doc_id", T.detect_lang(s).alias("script"))


@query("q_notation", "WITH d AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN lower(p_type) WHEN 3 THEN p_type ELSE lower(p_type) || 'Name' END AS name FROM part) SELECT p_partkey, name, CASE WHEN regexp_matches(name, '\\s') THEN 'words' WHEN contains(name, '_') THEN 'snake' WHEN regexp_matches(name, '[a-z][A-Z]') THEN 'camel' WHEN name = lower(name) THEN 'lower' ELSE 'other' END AS notation FROM d")
def notation(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k == 2, F.lower("p_type")).when(k == 3, F.col("p_type")).otherwise(F.concat(F.lower("p_type"), F.lit("Name")))
    return t.part.select("p_partkey", name.alias("name")).withColumn("notation", T.notation(F.col("name")))


V = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query("q_mrl_truncate", f"WITH {V}, h AS (SELECT vec_id, v[1:16] AS h FROM e), s AS (SELECT vec_id, list_transform(h, lambda x: x / (sqrt(list_sum(list_transform(h, lambda y: y * y))) + 1e-12)) AS s FROM h) SELECT vec_id, len(s) AS dims, round(s[1], 6) AS first, round(list_sum(s), 6) AS total FROM s")
def mrl(t: Tables) -> DataFrame:
    s = t.embeddings.select("vec_id", mrl_truncate(F.col("embedding").cast("array<double>"), 16).alias("s"))
    return s.select("vec_id", F.size("s").cast("long").alias("dims"), F.round(F.get("s", F.lit(0)), 6).alias("first"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("q_l2_normalize", f"WITH {V}, d AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE list_transform(v, lambda x: x * 3) END AS v FROM e), n AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12) AS n FROM d) SELECT vec_id, round(v[1] / n, 6) AS first, round(sqrt(list_sum(list_transform(v, lambda y: y / n * y / n))), 6) AS norm FROM n")
def l2(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    d = t.embeddings.select("vec_id", l2_normalize(F.when(F.col("vec_id") % 50 == 0, F.transform(v, lambda x: x * 0)).otherwise(F.transform(v, lambda x: x * 3))).alias("v"))
    return d.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(norm(F.col("v")), 6).alias("norm"))


@query("q_norm_stats", f"WITH {V}, n AS (SELECT sqrt(list_sum(list_transform(v, lambda y: y * y * (1 + vec_id % 7)))) AS n FROM e) SELECT round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS std FROM n")
def norm_stats(t: Tables) -> DataFrame:
    n = t.embeddings.select((norm(F.col("embedding").cast("array<double>")) * F.sqrt(1 + F.col("vec_id") % 7)).alias("n"))
    return n.agg(F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev_pop("n"), 9).alias("std"))


@query("q_fbeta", "WITH d AS (SELECT l_linenumber AS k, avg((l_returnflag = 'R')::INT) AS p, avg((l_linestatus = 'O')::INT) AS r FROM lineitem GROUP BY 1 UNION ALL SELECT 0, 0, 0) SELECT k, CASE WHEN p + r = 0 THEN 0 ELSE 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) END AS f FROM d")
def fbeta_query(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("p"), F.avg((F.col("l_linestatus") == "O").cast("int")).alias("r"))
    d = d.union(t.rows("k int, p double, r double", (0, 0.0, 0.0)))
    return d.select("k", fbeta(F.col("p"), F.col("r"), 0.5).alias("f"))


@query("q_synonym_cleanup", "WITH known AS (SELECT DISTINCT p_type AS col FROM part WHERE p_size = 50 AND p_partkey % 4 = 0), r AS (SELECT p_type AS col, list_sort(list(DISTINCT CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END)) AS syns FROM part GROUP BY 1 UNION ALL SELECT p_brand, list_sort(list(DISTINCT p_brand)) FROM part GROUP BY 1) SELECT col, array_to_string(list_filter(syns, lambda s: s <> col)[1:2], ',') AS syns FROM r WHERE col NOT IN (SELECT col FROM known)")
def synonym_cleanup(t: Tables) -> DataFrame:
    """New columns only; a column is no synonym of its own; two at most. Types with their parts' brands stand for columns."""
    known = t.part.where("p_size = 50 and p_partkey % 4 = 0").select(F.col("p_type").alias("col")).distinct()
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    r = t.part.groupBy(F.col("p_type").alias("col")).agg(F.array_sort(F.collect_set(name)).alias("syns")).union(t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_brand"))))
    new = r.join(known, "col", "left_anti")
    return new.select("col", F.array_join(F.slice(F.filter("syns", lambda s: s != F.col("col")), 1, 2), ",").alias("syns"))


@query("q_trace_stats", "SELECT conv_id AS pair, count(*) AS n_steps, sum((role = 'assistant')::INT)::BIGINT AS n_answers, max(turn) AS last_step FROM conversations GROUP BY 1")
def trace_stats(t: Tables) -> DataFrame:
    """Steps of a trace, from its rows; counts alone are gathered, never the steps."""
    return t.conversations.groupBy(F.col("conv_id").alias("pair")).agg(F.count("*").alias("n_steps"), F.count_if(F.col("role") == "assistant").alias("n_answers"), F.max("turn").alias("last_step"))
