"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is an expression that is true for a text to reject. Rules share parts: the array of words, that of lines, the hashes of three-word
windows. On a sample, each rule's selectivity (share rejected) and its own cost are measured, over parts that are there already and
less what an empty job takes, and the cost of making each part. The next rule is always the one that rejects most per second, its
missing parts included. keep_good tries the rules in that order: each part is made once, in a generator that predicates are not
pushed through, after the rules that come before it, so a text that a cheap, sharp rule rejects never reaches the dear ones. The
order changes the running time and the name of the first rule that fired, never whether a text is kept.

Defined results: a null text counts as empty and an empty text is rejected by the base rules; a null doc_id is kept as
null; repeated rows are judged one by one; an empty table gives an empty result; other columns pass through whatever
their names, and the columns that are added get underscores in front where they clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import BLANKS, checkpointed, fresh, quoted, text_or_empty, words

#: Rows of the sample on which cost and selectivity are measured (expected number; a uniform sample).
SAMPLE_ROWS = 2000
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
NON_BLANK = r"[^\x20\x09-\x0D]"

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """name; fires(m): expression over metrics m(name)."""

    name: str
    fires: object


#: Parts and what they are made of.
PARTS = {"words": ("text",), "lines": ("text",), "windows": ("words",)}


def part(c: dict[str, Column], name: str) -> Column:
    """The expression that makes a part. c: the columns of the text and of the parts it needs."""
    if name == "words":
        return words(c["text"])
    if name == "lines":
        return F.filter(F.split(c["text"], "\n"), lambda x: x.rlike(NON_BLANK))
    w = c["words"]
    return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))


def with_part(docs: DataFrame, names: dict[str, str], made: list[str]) -> DataFrame:
    """docs with parts under the given names, each computed once: nothing is pushed through a generator of one row."""
    c = {k: quoted(v) for k, v in names.items()}
    return docs.select("*", F.inline(F.array(F.struct(*(part(c, k).alias(names[k]) for k in made))))) if made else docs


def repeated_words(w: Column, windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in their text, each word once.

    Texts whose windows have different hashes, most of them, end there; the others sort (window, position) and mark equal neighbours.
    """
    texts = F.transform(windows, lambda _, i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))

    def marked(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1)["t"], F.get(s, i + 1)["t"]
            return F.coalesce(before == x["t"], F.lit(False)) | F.coalesce(after == x["t"], F.lit(False))

        covered = F.transform(F.filter(s, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(covered)))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.get(F.transform(F.array(F.sort_array(texts)), marked), F.lit(0)))


#: A word without a letter, as a whole word of a text.
PLAIN_WORD = BLANKS[1:-2].join((r"(?<![^", r"])[^", r"\p{L}]++(?![^", "])"))

#: What each metric is computed from, and how.
NEEDS = {"n_words": ("words",), "word_chars": ("words",), "n_symbols": (), "n_dup_lines": ("lines",), "n_repeat_words": ("words", "windows"), "n_lines": ("lines",), "n_plain": (), "n_upper": (), "n_bullets": ("lines",), "n_ellipses": ("lines",)}


def metric(names: dict[str, str], name: str) -> Column:
    n = {k: quoted(v) for k, v in names.items()}
    return {
        "n_words": lambda: F.size(n["words"]),
        "word_chars": lambda: F.length(F.array_join(n["words"], "")),
        "n_symbols": lambda: F.regexp_count(n["text"], F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": lambda: F.size(n["lines"]) - F.size(F.array_distinct(n["lines"])),
        "n_repeat_words": lambda: repeated_words(n["words"], n["windows"]),
        "n_lines": lambda: F.size(n["lines"]),
        "n_plain": lambda: F.regexp_count(n["text"], F.lit(PLAIN_WORD)),
        "n_upper": lambda: F.regexp_count(n["text"], F.lit(r"\p{Lu}")),
        "n_bullets": lambda: F.size(F.filter(n["lines"], lambda x: x.rlike(r"^\s*[-*•]"))),
        "n_ellipses": lambda: F.size(F.filter(n["lines"], lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }[name]().cast("long")


#: The production rules, beyond the base rules. m: name of a metric -> its column.
RULES = (
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 14)),
    Rule("duplicate_lines", lambda m: m("n_dup_lines") * 10 > m("n_lines") * 3),
    Rule("without_letters", lambda m: m("n_plain") * 5 > m("n_words")),
    Rule("upper_case", lambda m: m("n_upper") * 2 > m("word_chars")),
    Rule("bullets", lambda m: m("n_bullets") * 10 > m("n_lines") * 9),
    Rule("ellipses", lambda m: m("n_ellipses") * 10 > m("n_lines") * 3),
)


#: The base rules, as rules of the cascade.
BASE_RULES = (
    Rule("base_short", lambda m: m("n_words") < MIN_WORDS),
    Rule("base_repeats", lambda m: m("n_repeat_words") * 100 > m("n_words") * MAX_REPEATED_PERCENT),
)


def base_failed(m) -> Column:
    return reduce(lambda a, b: a | b, (r.fires(m) for r in BASE_RULES))


def needed(rule: Rule) -> list[str]:
    """The parts that a rule's metrics are computed from, in the order in which they can be made."""
    used: set[str] = set()
    rule.fires(lambda k: used.update(NEEDS[k]) or F.lit(0))
    return [p for p in PARTS if p in used]


def missing(rule: Rule, there: list[str]) -> list[str]:
    return [p for p in needed(rule) if p not in there]


def ordered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejection per cost on a uniform sample of about sample_rows rows, each part's cost counted for the first that needs it."""
    if len(rules) < 2:
        return tuple(rules)
    total = docs.count()
    if not total:
        return tuple(rules)
    names = {"text": "text", **{p: f"{p}_" for p in PARTS}}
    sample = docs.select(text_or_empty(text_col).alias("text")).sample(min(1.0, sample_rows / total), seed=7).coalesce(4)
    for p in PARTS:
        sample = with_part(sample, names, [p])
    sample = checkpointed(sample)
    c = {k: quoted(v) for k, v in names.items()}

    def timed(value: Column) -> tuple[float, float]:
        """The mean of a number over the sample, and seconds."""
        job, mean, seconds = sample.agg(F.avg(value.cast("double"))), 0.0, float("inf")
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            mean = job.first()[0] or 0.0
            seconds = min(seconds, time.perf_counter() - began)
        return mean, seconds

    idle = timed(F.length("text"))[1]
    cost = lambda seconds: max(seconds - idle, 0.001)
    making = {p: cost(timed(F.size(part(c, p)))[1]) for p in PARTS}
    judged = {r.name: timed(r.fires(lambda k: metric(names, k))) for r in rules}
    out, there, rest = [], [], list(rules)
    while rest:
        price = {r.name: cost(judged[r.name][1]) + sum(making[p] for p in missing(r, there)) for r in rest}
        best = min(rest, key=lambda r: (-judged[r.name][0] / price[r.name], price[r.name], r.name))
        rest.remove(best)
        out.append(best)
        there += missing(best, there)
    return tuple(out)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base metrics (long), base_failed, rejected_by (the first rule of the cascade that fired, or null) and kept.

    All metrics are returned, so all parts are made for every row; a caller that wants the kept rows alone takes keep_good.
    """
    by = ordered(docs, text_col, rules, sample_rows)
    own = docs.columns
    out = dict(zip((*METRICS, "base_failed", "rejected_by", "kept"), fresh(docs, *METRICS, "base_failed", "rejected_by", "kept"), strict=True))
    taken = docs.select(*(quoted(c) for c in own), *(F.lit(None).alias(v) for v in out.values()))
    names = dict(zip(("text", *PARTS), fresh(taken, "text", *PARTS), strict=True))
    parts = docs.withColumn(names["text"], text_or_empty(text_col))
    parts = with_part(with_part(parts, names, ["words", "lines"]), names, ["windows"])
    parts = parts.withColumns({out[k]: metric(names, k) for k in METRICS})

    def m(k: str) -> Column:
        return quoted(out[k]) if k in out else metric(names, k)

    parts = parts.withColumn(out["base_failed"], base_failed(m))
    cascade = reduce(lambda chain, r: chain.when(r.fires(m), F.lit(r.name)), by, F.when(quoted(out["base_failed"]), F.lit("base")))
    parts = parts.withColumn(out["rejected_by"], cascade)
    return parts.select(*(quoted(c) for c in own), *(quoted(out[k]) for k in METRICS), quoted(out["base_failed"]), quoted(out["rejected_by"]), quoted(out["rejected_by"]).isNull().alias(out["kept"]))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the base rules and the others keep, with the columns of docs: one filter after the other, parts as they are needed."""
    names = dict(zip(("text", *PARTS), fresh(docs, "text", *PARTS), strict=True))
    left, there = docs.withColumn(names["text"], text_or_empty(text_col)), []
    for rule in ordered(docs, text_col, (*BASE_RULES, *rules), sample_rows):
        for p in missing(rule, there):
            left = with_part(left, names, [p])
            there.append(p)
        left = left.where(~F.coalesce(rule.fires(lambda k: metric(names, k)), F.lit(False)))
    return left.select(*(quoted(c) for c in docs.columns))
