"""Text functions on columns: cells, serialisation, tokens, formats, corruption, model replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.hashing import u01, u32

#: Tokens kept of a text unless told.
MAX_TOKENS = 2048


def strip(c: Column) -> Column:
    """Without white space at both ends, all kinds of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def serialize_row(columns: list[str]) -> Column:
    """'column: value' joined by ' | ', without nulls and blanks; '' if there is nothing."""
    return F.concat_ws(" | ", *(F.when(~is_blank(F.col(c)), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def compose_text(name: Column, label: str, article: Column, full: Column) -> Column:
    """name | label: article | full name where it differs."""
    return F.concat_ws(" | ", name, F.when(~is_blank(article), F.concat(F.lit(f"{label}: "), article)), F.when(~is_blank(full) & (full != name), full))


def tokenize(c: Column, most: int | None = MAX_TOKENS) -> Column:
    """Lower-case runs of letters and digits, in order; all of them if `most` is None."""
    tokens = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return tokens if most is None else F.slice(tokens, 1, most)


def flip_bool(c: Column) -> Column:
    pairs = {"True": "False", "False": "True", "true": "false", "false": "true"}
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.element_at(table, c), c)


def change_format(c: Column) -> Column:
    """Four digits become 'YY; numbers over 100 get separators and one decimal; other numbers are stripped; text stays."""
    s = strip(c)
    number = s.rlike(r"^(\d+\.?\d*|\.\d+)$")
    return F.when(s.rlike(r"^\d{4}$"), F.concat(F.lit("'"), F.substring(s, 3, 2))).when(number & (s.cast("double") > 100), F.format_number(s.cast("double"), 1)).when(number, s).otherwise(c)


def add_typo(c: Column, p: float, seed: int, *keys: Column) -> Column:
    """Swaps of neighbours from left to right, each with probability p; after a swap the next place is skipped."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))

    def step(s: Column, i: Column) -> Column:
        here, after = F.get(chars, i), F.get(chars, i + 1)
        swap = (i + 1 < n) & (u01(seed, *keys, i) < p)
        moved = F.when(i < s["i"], s["out"]).when(swap, F.concat(s["out"], F.array(after, here))).otherwise(F.concat(s["out"], F.array(here)))
        return F.struct(moved.alias("out"), F.when(i < s["i"], s["i"]).when(swap, i + 2).otherwise(i + 1).alias("i"))

    walked = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.array_join(s["out"], ""))
    return F.when(n > 1, walked).otherwise(c)


def drop_tokens(c: Column, p: float, seed: int, *keys: Column) -> Column:
    """Words go with probability p; one word stays, and the first if all would go."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    kept = F.filter(words, lambda x, i: u01(seed, *keys, i) >= p)
    return F.when(F.size(words) <= 1, c).otherwise(F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.get(words, F.lit(0))))


def corrupt_value(c: Column, seed: int, *keys: Column, typo: float = 0.3, fmt: float = 0.2, drop: float = 0.2, typo_p: float = 0.1, drop_p: float = 0.3) -> Column:
    """Booleans flip; else one of typo, other format and lost words by one draw, or none. Null stays null."""
    u = u01(seed, F.lit("strategy"), *keys)
    return (
        F.when(c.isin("True", "False", "true", "false"), flip_bool(c))
        .when(u < typo, add_typo(c, typo_p, seed + 1, *keys))
        .when(u < typo + fmt, change_format(c))
        .when(u < typo + fmt + drop, drop_tokens(c, drop_p, seed + 2, *keys))
        .otherwise(c)
    )


def pick(values: Column, seed: int, *keys: Column) -> Column:
    """One of the values of an array by hash; null for an empty or null array."""
    return F.when(F.size(values) > 0, F.element_at(values, (u32(seed, *keys) % F.size(values) + 1).cast("int")))


def valid_identifier(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}_]{1,80}$")


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def extract_json(c: Column) -> Column:
    """The object in a reply, as text: the reply itself, a fenced block, or from the first { to the last }."""
    whole, fenced, inner = strip(c), F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(c, r"(?s)\{.*\}", 0)

    def ok(x: Column) -> Column:
        return F.when(x.rlike(r"(?s)^\{.*\}$") & F.json_object_keys(x).isNotNull(), x)

    return F.coalesce(ok(whole), ok(fenced), ok(inner))


def parse_array(c: Column, ddl: str) -> Column:
    """From the first [ to the last ], parsed."""
    return F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), ddl)


def parse_synonyms(reply: Column, original: Column, most: int) -> Column:
    """Valid names on the reply's lines, the first `most`; the original alone if there are none."""
    lines = F.transform(F.split(strip_think(reply), r"\r\n|\n|\r"), strip)
    names = F.slice(F.filter(lines, valid_identifier), 1, most)
    return F.when(F.size(names) > 0, names).otherwise(F.array(original))


def looks_structured(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?U)^\s+", "")
    return F.when(s.startswith("{") | s.startswith("["), "json").when(s.startswith("http://") | s.startswith("https://"), "url").when(s.startswith("<"), "html").otherwise("text")


def literal_as_json(text: str | None) -> str | None:
    """A Python literal as JSON: tuples and sets as arrays; null for anything else than a dict, list, tuple or set."""
    import ast
    import json

    try:
        value = ast.literal_eval(text.strip()) if text else None
        return json.dumps(sorted(value, key=repr) if isinstance(value, set) else value, ensure_ascii=False) if isinstance(value, (dict, list, tuple, set)) else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def parse_flex(c: Column) -> Column:
    """JSON as it is, a Python literal as JSON, null if it is neither. Only what is not JSON and looks like a literal goes to Python, in Arrow batches."""
    @F.pandas_udf("string")
    def literals(texts: pd.Series) -> pd.Series:
        return texts.map(literal_as_json)

    is_json = c.rlike(r"(?s)^\s*\{.*\}\s*$") & F.json_object_keys(c).isNotNull() | c.rlike(r"(?s)^\s*\[.*\]\s*$") & F.json_array_length(c).isNotNull()
    whole = F.when(is_json, c)
    return F.coalesce(whole, literals(F.when(whole.isNull() & c.rlike(r"^\s*[\[({]"), c)))


def detect_lang(c: Column) -> Column:
    """cyrillic, latin, mixed or other by letters."""
    cyrillic = F.length(F.regexp_replace(c, "[^а-яёА-ЯЁ]", ""))
    latin = F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))
    return F.when((cyrillic > 0) & (latin > 0), "mixed").when(cyrillic > 0, "cyrillic").when(latin > 0, "latin").otherwise("other")


def notation(c: Column) -> Column:
    return F.when(c.rlike(r"\s"), "words").when(c.contains("_"), "snake").when(c.rlike("[a-z][A-Z]"), "camel").when(c == F.lower(c), "lower").otherwise("other")


def token_category(c: Column) -> Column:
    return F.when(c.startswith("##"), "suffix").when(c.rlike(r"^[0-9]+$"), "digit").when(c.rlike(r"^[^\p{L}\p{N}]+$"), "punctuation").otherwise("word")


def blocking_key(*columns: Column) -> Column:
    return F.concat_ws("|", *(F.lower(strip(F.coalesce(c.cast("string"), F.lit("?")))) for c in columns))


def numeric_bucket(c: Column, width: int) -> Column:
    """Floor to multiples of width; null counts as -1."""
    return F.floor(F.coalesce(c, F.lit(-1)) / width) * width


def strip_prefix(c: Column, prefix: Column) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.length(prefix) + 1, F.length(c))).otherwise(c)


def fixed(c: Column, digits: int) -> Column:
    """A double with so many digits after the point, rounded by its exact binary value, with the sign of a negative zero.

    The built-in functions round the shortest decimal that names the double: 0.0005, which is over it by 1e-20, to 0.000.
    """

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format(v, f".{digits}f"), na_action="ignore").astype(object)

    return shown(c)
