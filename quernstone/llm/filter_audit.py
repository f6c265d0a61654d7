"""How filters overlap: every order's removals, from Walsh-Hadamard sums of the failure masks.

A document's mask has a bit for each filter that it fails. For each part and label class, and each of the 32 sets of filters, one
signed sum is taken over the documents: +1 for a document that fails an even number of the set's filters, -1 for an odd number. These 32 sums are linear,
so they are summed in each partition and exchanged as one row for each part and class; transforming them once more and dividing by 32 gives back
the exact number of documents of each mask. Everything else follows from these cells: in any order, a step removes the masks that hold its
filter and none of the filters before; and a filter's removals over all 120 orders are 120 / n of each document that fails n filters, itself among them, as each of the n
comes first equally often.

The filter for repeated texts needs the whole table: texts are told apart by SHA-256. Rows are counted by (id, part, text) before they meet their
labels by id and their copies by digest, and by (digest, part, class) before a text's smallest id is sought, so an id or a text that
a third of all rows share is a few rows for each task. Only digests, never texts, are exchanged.

Defined results: a null text is empty; it fails A, and E beside an earlier empty text. A null or empty part is the empty string. A null id
is neither smaller nor larger than another and has no labels, so such a row never fails E. Rows that repeat an id and its text count
each, and don't fail E for each other. Of several labels of an id one with quality or toxic 1 is enough. An empty table gives an empty
result. Only the id, text and part columns are read, so other columns can't clash.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.llm.common import quoted, text_or_empty, words

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Of the repeated texts' filter, the last one.
REPEATED = MASKS >> 1
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(text: Column, tokens: Column) -> Column:
    """The mask of the filters that look at one text alone: A to D."""
    n = F.size(tokens)
    conditions = [
        n < 200,
        100 * F.size(F.array_distinct(tokens)) < 50 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def parities(masks: DataFrame) -> DataFrame:
    """(part, good, toxic, w): the 32 signed sums. masks: (part, good, toxic, bits, passing, repeated), the last two numbers of documents with and without E."""
    found = []
    for s in range(MASKS):
        n = F.col("passing") - F.col("repeated") if s & REPEATED else F.col("passing") + F.col("repeated")
        odd = F.bit_count(F.col("bits").bitwiseAND(s & ~REPEATED)) % 2 == 1
        found.append(F.sum(F.when(odd, -n).otherwise(n)))
    return masks.groupBy("part", "good", "toxic").agg(F.array(*found).alias("w"))


def inverted(w: Column) -> Column:
    """The cells of the 32 sums: the same transform again, over 32."""
    sign = lambda m, s: F.when(F.bit_count(m.bitwiseAND(s)) % 2 == 1, -1).otherwise(1)
    at = F.sequence(F.lit(0), F.lit(MASKS - 1))
    total = lambda m: F.aggregate(F.zip_with(w, at, lambda x, s: x * sign(m, s)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(at, lambda m: F.shiftright(total(m), len(FILTERS)))


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, good, toxic, bits, passing, repeated): a row for each part, class and text."""
    text = text_or_empty(text_col)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"), words(text).alias("w"))
    rows = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), failing(F.col("t"), F.col("w")).alias("bits"))
    rows = rows.groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.join(flags, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))  # an id is there once
    texts = rows.groupBy("digest", "part", "good", "toxic", "bits").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first.alias("first"))
    least = F.min("first.id").over(W.partitionBy("digest"))
    texts = texts.withColumn("least", least)
    passing = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    return texts.select("part", "good", "toxic", "bits", passing.alias("passing"), (F.col("n") - passing).alias("repeated"))


def steps() -> Column:
    """All orders with their steps: the filter's bit and the bits before it; 600 entries."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            found.append({"o": "".join(FILTERS[i] for i in order), "k": k + 1, "before": before, "bit": 1 << f})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(found)), "array<struct<o string, k int, before int, bit int>>")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, counts): a row for each part, order and step, zeros included."""
    cells = parities(document_masks(docs, labels, id_col, text_col, part_col)).withColumn("cells", inverted(F.col("w")))
    each = lambda when: F.array(*(F.sum(F.when(when, F.get("cells", F.lit(m))).otherwise(0)) for m in range(MASKS)))
    parts = cells.groupBy("part").agg(each(F.lit(True)).alias("all"), each(F.col("good")).alias("good"), each(F.col("toxic")).alias("toxic"))
    at = F.sequence(F.lit(0), F.lit(MASKS - 1))
    total = lambda name, when: F.aggregate(F.filter(at, when), F.lit(0).cast("long"), lambda a, m: a + F.get(F.col(name), m))
    bit, before = F.col("s.bit"), F.col("s.before")
    fails, early = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    share = F.array(*(F.lit(0 if m == 0 else 120 // m.bit_count()) for m in range(MASKS)))  # 120 is divisible by all of 1 to 5
    shapley = F.aggregate(F.filter(at, fails), F.lit(0).cast("long"), lambda a, m: a + F.get("all", m) * F.get(share, m))
    found = {
        "kept": total("all", lambda m: ~fails(m) & ~early(m)), "removed": total("all", lambda m: fails(m) & ~early(m)), "redundant": total("all", lambda m: fails(m) & early(m)),
        "unique_fails": F.get("all", bit), "good_lost": total("good", lambda m: fails(m) & ~early(m)), "toxic_lost": total("toxic", lambda m: fails(m) & ~early(m)), "shapley": shapley,
    }
    return parts.select("*", F.explode(steps()).alias("s")).select("part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), *(found[c].alias(c) for c in COUNTS))
