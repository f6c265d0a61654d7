r"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Different lines are joined if at most k edits (insertion, deletion or substitution of a code point) turn one into the other. k is
`edits`, or less for short lines: one edit for every `per_edit` code points of the shorter line, so lines below that match exactly only. A
line is split into threshold plus one segments; k edits leave one of them whole. Each line is listed in an index under its
length and each segment, and probes the index of its own length and of the lengths up to k less with the substrings that stand
where those lengths can have their segments. What meets there is verified by banded edit distance.

A key that more than `hot` lines share would make all pairs of them. Such lines are listed again in finer pieces: cut into m
pieces, k edits leave all but k pieces whole, so the key is the line without k of its pieces, with the shifts that edits in those can
make. m grows eightfold for one edit and twofold for more, until no key is hot or a piece is one code point, when lines of one key
differ in k places alone and are true links. For two edits and more a line has as many keys as there are choices of k pieces, so a key
counts as hot only where its pairs are more than the keys that would take their place. Copies of a line are one row throughout.

Of keys that meet, and of lines that are in them, a bitmap of bounded size is broadcast before rows are exchanged; it lets false ones
through, which the joins then drop, and never holds back a true one.

Lines end at \n. A line without a word is neither a duplicate nor removed. A line is kept where it stands first, in order of
doc_id and place, unless an earlier line is linked with it.

Defined results: a null or empty text has no lines; a null doc_id stands before all others; rows that repeat a doc_id and
its text keep the same lines as each other; an empty table gives an empty result; other columns pass through
dedup_lines, whatever their names. Very long lines cost time in proportion to their length.
"""

from __future__ import annotations

import json
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, fresh, quoted, text_or_empty

#: Production: edits, code points of the shorter line that one edit takes, and lines that share a key without being listed again.
EDITS, PER_EDIT, HOT = 1, 10, 64
#: Bits of a bitmap: so many for each entry, from least to most (a broadcast of at most 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
WORD = r"[^\x20\x09-\x0D]"
ID = ["d", "p", "h"]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, p, line): lines with a word, by the id of their document, the hash of its text and their place in it."""
    parts = docs.select(quoted(id_col).cast("long").alias("d"), F.xxhash64(text_or_empty(text_col)).alias("t"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("p", "line"))
    return parts.where(F.col("line").rlike(WORD))


def choices(pieces: int, edits: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(delta, number, runs): how a line can probe the index of lines that are delta shorter. number: which pieces are left out.

    runs: (first piece, piece after the last, shift) of what is left. Pieces that are left out in a row, b of them, can shift what
    follows by b at most; what stands before all of them is not shifted, what stands after all by delta.
    """
    out = []
    for number, gone in enumerate(combinations(range(pieces), min(edits, pieces))):
        blocks: list[list[int]] = []
        for g in gone:
            if blocks and blocks[-1][-1] == g - 1:
                blocks[-1].append(g)
            else:
                blocks.append([g])
        for shifts in product(*(range(-len(b), len(b) + 1) for b in blocks)):
            if 0 <= sum(shifts) <= edits:
                runs, start, at = [], 0, 0
                for b, s in zip(blocks, shifts, strict=True):
                    if b[0] > start:
                        runs.append((start, b[0], at))
                    start, at = b[-1] + 1, at + s
                if start < pieces:
                    runs.append((start, pieces, at))
                out.append((sum(shifts), number, runs))
    seen = set()
    return [x for x in out if (k := (x[0], x[1], tuple(x[2]))) not in seen and not seen.add(k)]


def keys(line: Column, length: Column, pieces: int, edits: int, least: Column | int, most: Column | None = None) -> Column:
    """Array of (key, probe): the index keys of a line, and those by which it probes its own length and up to `edits` less.

    Index and probe of one choice are the same where nothing is shifted. The lengths in the index are from least to most.
    """
    none = F.array().cast("array<struct<key:bigint,probe:int>>")

    def within(size: Column) -> Column:
        return (size >= least) if most is None else (size >= least) & (size <= most)

    def listed(delta: int) -> Column:
        size = length - delta
        mine = [c for c in choices(pieces, edits) if c[0] == delta]
        edge = lambda j: F.expr("0") if j == 0 else size if j == pieces else F.floor(size * j / pieces).cast("int")

        def one(number: int, runs: list[tuple[int, int, int]]) -> Column:
            texts = [F.substring(line, edge(a) + (1 + s), edge(b) - edge(a)) for a, b, s in runs]
            return F.struct(F.xxhash64(size, F.lit(number), *texts).alias("key"), F.lit(0 if delta == 0 and not any(s for _, _, s in runs) else 1).alias("probe"))

        return F.when(within(size), F.array(*(one(n, r) for _, n, r in mine))).otherwise(none)

    def folded(delta: int) -> Column:
        """The same for many pieces at one edit: what is left of the line without its j-th piece, by a fold over j."""
        size = length - delta

        def one(j: Column) -> Column:
            start, end = F.floor(j * size / pieces).cast("int"), F.floor((j + 1) * size / pieces).cast("int")
            return F.struct(F.xxhash64(size, j, F.substring(line, F.lit(1), start), F.substring(line, end + (1 + delta), size - end)).alias("key"), F.lit(int(delta > 0)).alias("probe"))

        return F.when(within(size), F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), one)).otherwise(none)

    def tabled(delta: int) -> Column:
        """The same for many choices, which are a literal table then and not an expression each."""
        size = length - delta
        mine = [c for c in choices(pieces, edits) if c[0] == delta]
        table = json.dumps([{"id": n, "index": int(delta > 0 or any(s for _, _, s in runs)), "runs": [list(x) for x in runs] + [[0, 0, 0]] * (edits + 1 - len(runs))} for _, n, runs in mine])

        def one(c: Column) -> Column:
            texts = []
            for i in range(edits + 1):
                run = F.get(c["runs"], F.lit(i))
                a, b, s = (F.get(run, F.lit(j)) for j in range(3))
                start, end = F.floor(size * a / pieces).cast("int"), F.floor(size * b / pieces).cast("int")
                texts.append(F.when(b > a, F.substring(line, start + s + F.lit(1), end - start)).otherwise(F.lit("")))
            return F.struct(F.xxhash64(size, c["id"], *texts).alias("key"), c["index"].alias("probe"))

        return F.when(within(size), F.transform(F.from_json(F.lit(table), "array<struct<id:int,index:int,runs:array<array<int>>>>"), one)).otherwise(none)

    part = folded if edits == 1 and pieces > 4 else tabled if edits > 1 and pieces > edits + 1 else listed
    return F.concat(*(part(delta) for delta in range(edits + 1)))


def all_keys(line: Column, length: Column, edits: int, per_edit: int, finer: int = 0) -> Column:
    """Keys for each threshold that lengths have; finer: times that the pieces have been cut again."""
    out = []
    for k in range(1, edits + 1):
        pieces = (k + 1) * (8 if k == 1 else 2) ** finer
        most = None if k == edits else F.lit((k + 1) * per_edit - 1)
        out.append(keys(line, length, pieces, k, k * per_edit, most))
    return F.concat(*out) if out else F.array().cast("array<struct<key:bigint,probe:int>>")


def bitmap(values: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(bucket, bits) of the hashes in the one column of values, n of them, and the number of bits; bounded."""
    size = LEAST_BITS
    while size < min(n * BITS_EACH, MOST_BITS):
        size *= 2
    at = F.pmod(F.col(values.columns[0]), F.lit(size))
    return values.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), size


def perhaps_in(rows: DataFrame, hash_: Column, bits: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose hash is in the bitmap, and a few others."""
    table, size = bits
    at = F.pmod(hash_, F.lit(size))
    joined = rows.withColumn("bucket of", F.bitmap_bucket_number(at)).join(F.broadcast(table), F.col("bucket of") == F.col("bucket"))  # MOST_BITS / 8 bytes at most
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.where(F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (place % 8 + 1).cast("int"))) != 0).drop("bucket of", "bucket", "bits")


def met(listed: DataFrame) -> DataFrame:
    """listed (key, probe, d, p, h) with n, the lines of the key, where an index entry and another line meet."""
    sizes = listed.groupBy("key").agg(F.count("*").alias("n"), F.min("probe").alias("least")).where("n > 1 and least = 0").drop("least")
    sizes = checkpointed(sizes)
    return perhaps_in(listed, F.col("key"), bitmap(sizes.select("key"), sizes.count())).join(sizes, "key")


def pairs(cold: DataFrame) -> DataFrame:
    """Candidates (da, pa, ha, db, pb, hb): an index entry with another one or with a probe of its key."""
    a = cold.where("probe = 0").select("key", *(F.col(c).alias(f"{c}a") for c in ID))
    b = cold.select("key", "probe", *(F.col(c).alias(f"{c}b") for c in ID))
    order = F.struct("da", "pa", "ha") < F.struct("db", "pb", "hb")
    other = ~F.struct("da", "pa", "ha").eqNullSafe(F.struct("db", "pb", "hb"))  # a line can meet its own shifted segment
    return a.join(b, "key").where(((F.col("probe") == 1) & other) | order).select("da", "pa", "ha", "db", "pb", "hb")


def linked_lines(docs: DataFrame, id_col: str, text_col: str, edits: int, per_edit: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The occurrences of lines (d, p, digest), the different lines (digest, d, p, h, n_chars, n_copies) and their links (da, pa, ha, db, pb, hb)."""
    if edits < 0 or per_edit < 1:
        raise ValueError("edits must be 0 or more and per_edit 1 or more")
    lines = lines_of(docs, id_col, text_col)
    # Copies meet by their 128-bit digest; what else is needed of a line is taken before the exchange, so no text moves.
    slim = lines.withColumn("n_chars", F.length("line"))
    slim = slim.select("d", "t", "p", F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest"), F.xxhash64("line").alias("h"), "n_chars", all_keys(F.col("line"), F.col("n_chars"), edits, per_edit).alias("keys"))
    same_line = [F.first(c).alias(c) for c in ("h", "n_chars", "keys")]
    different = slim.groupBy("digest").agg(F.min(F.struct("d", "p", "t")).alias("at"), F.count("*").alias("n_copies"), *same_line)
    different = checkpointed(different.select("digest", "at.d", "at.p", "at.t", "h", "n_chars", "n_copies", "keys"))
    listed = checkpointed(met(different.select(*ID, F.inline("keys"))))
    ids = checkpointed(listed.select(*ID).distinct())
    same = [F.col("l.d").eqNullSafe(F.col("i.d")), F.col("l.p") == F.col("i.p"), F.col("l.h") == F.col("i.h")]
    some = perhaps_in(lines.withColumn("h", F.xxhash64("line")), F.col("h"), bitmap(ids.select("h"), ids.count()))
    texts = some.alias("l").join(ids.alias("i"), same, "left_semi").dropDuplicates(ID)
    texts = checkpointed(texts.withColumn("n_chars", F.length("line")))
    found, finer, pieces = None, 0, edits + 1
    longest = texts.agg(F.max("n_chars")).first()[0] or 0
    while True:
        last = pieces >= longest
        again = (edits + 1) * 2 ** (finer + 1)
        many = hot if edits < 2 or last else max(hot, 2 * len(choices(again, edits)))
        cold = listed if last else listed.where(F.col("n") <= many)
        found = pairs(cold) if found is None else found.union(pairs(cold))
        crowd = None if last else listed.where(F.col("n") > many).select(*ID).distinct()
        if crowd is None or crowd.isEmpty():
            break
        finer += 1
        pieces = (edits + 1) * (8 if edits == 1 else 2) ** finer
        again = texts.alias("l").join(crowd.alias("i"), same, "left_semi")
        listed = checkpointed(met(again.select(*ID, F.inline(all_keys(F.col("line"), F.col("n_chars"), edits, per_edit, finer)))))

    def text(side: str) -> DataFrame:
        return texts.select(*(F.col(c).alias(f"{side}{c}_") for c in ID), F.col("line").alias(f"line_{side}"), F.col("n_chars").alias(f"n_{side}"))

    def on(side: str) -> list[Column]:
        return [F.col(f"d{side}").eqNullSafe(F.col(f"{side}d_")), F.col(f"p{side}") == F.col(f"{side}p_"), F.col(f"h{side}") == F.col(f"{side}h_")]

    apart = F.levenshtein("line_a", "line_b", edits)
    near = found.distinct().join(text("a"), on("a")).join(text("b"), on("b")).where((apart >= 0) & (apart * per_edit <= F.least("n_a", "n_b")))
    # A pair that meets both ways round is one link.
    a, b = (F.struct(*(F.col(c + side).alias(c) for c in ID)) for side in "ab")
    near = near.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    near = near.select(*(F.col("x")[c].alias(f"{c}a") for c in ID), *(F.col("y")[c].alias(f"{c}b") for c in ID))
    return slim.select("d", "p", "digest"), different.drop("keys"), checkpointed(near)


def judged(different: DataFrame, links: DataFrame) -> DataFrame:
    """different with n_links and kept."""
    earlier = F.struct("db", "pb", "hb") < F.struct("da", "pa", "ha")
    ends = links.select("da", "pa", "ha", earlier.alias("earlier")).union(links.select("db", "pb", "hb", ~earlier)).groupBy("da", "pa", "ha").agg(F.count("*").alias("n_links"), F.max("earlier").alias("earlier"))
    counted = different.join(ends, [F.col("d").eqNullSafe(F.col("da")), F.col("p") == F.col("pa"), F.col("h") == F.col("ha")], "left")
    return counted.select("digest", *ID, "t", F.col("n_chars").cast("long"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), (~F.coalesce("earlier", F.lit(False))).alias("kept"))


def join_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT, hot: int = HOT) -> DataFrame:
    """A row for each different line: d, p (where it stands first), h (its hash), n_chars, n_copies, n_links and kept."""
    _, different, links = linked_lines(docs, id_col, text_col, edits, per_edit, hot)
    return judged(different, links).drop("digest", "t")


def members_and_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT, hot: int = HOT) -> DataFrame:
    """A row of kind member for each occurrence of a line and one of kind pair for each link of two different lines.

    member: doc_id and line_no of the occurrence; first_doc_id and first_line_no, where the line stands first; n_chars,
    n_copies and n_links of the line; kept, whether this occurrence stays. pair: where the later of two lines stands first, and
    as first_ the earlier; the rest is null.
    """
    occurrences, different, links = linked_lines(docs, id_col, text_col, edits, per_edit, hot)
    lines = judged(different, links).select("digest", F.col("d").alias("first_doc_id"), F.col("p").alias("first_line_no"), "n_chars", "n_copies", "n_links", F.col("kept").alias("stays"))
    # A line can have a third of all occurrences; the adaptive plan splits such a partition of them.
    joined = occurrences.join(lines.hint("merge"), "digest")
    first = F.col("d").eqNullSafe(F.col("first_doc_id")) & (F.col("p") == F.col("first_line_no"))
    numbers = ["n_chars", "n_copies", "n_links"]
    members = joined.select(F.lit("member").alias("kind"), F.col("d").alias("doc_id"), F.col("p").alias("line_no"), "first_doc_id", "first_line_no", *numbers, (F.col("stays") & first).alias("kept"))
    a, b = (F.struct(*(F.col(c + side).alias(c) for c in ID)) for side in "ab")
    ends = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    later, earlier = [F.col("x")[c] for c in ("d", "p")], [F.col("y")[c] for c in ("d", "p")]
    return members.union(ends.select(F.lit("pair"), *later, *earlier, *(F.lit(None).cast("long") for _ in numbers), F.lit(None).cast("boolean")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per_edit: int = PER_EDIT, hot: int = HOT, length_col: str | None = None) -> DataFrame:
    """docs without the lines that are not kept; a row that had lines with a word and has none left goes.

    length_col: a column that gets the code points of what is left.
    """
    own = docs.columns
    _, different, links = linked_lines(docs, id_col, text_col, edits, per_edit, hot)
    # By id and text: rows without an id, or with one that others have too, don't gather each other's lines.
    kept = judged(different, links).where("kept").groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("p", "h"))).alias("k"))
    row, d, t, lines, keep = fresh(docs, "row_", "d_", "t_", "lines_", "keep_")
    packed = docs.select(F.struct(*(quoted(c) for c in own)).alias(row), quoted(id_col).cast("long").alias(d), F.xxhash64(text_or_empty(text_col)).alias(t), F.split(text_or_empty(text_col), "\n").alias(lines))
    joined = packed.join(kept.select(F.col("d").alias("kept d"), F.col("t").alias("kept t"), F.col("k").alias(keep)), [quoted(d).eqNullSafe(F.col("`kept d`")), quoted(t) == F.col("`kept t`")], "left")
    at = quoted(lines)
    mine = F.filter(F.coalesce(quoted(keep), F.array().cast("array<struct<p:int,h:bigint>>")), lambda k: F.xxhash64(F.get(at, k["p"])) == k["h"])
    blank = F.filter(F.transform(at, lambda x, i: F.when(~x.rlike(WORD), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.array_union(F.transform(mine, lambda k: k["p"]), blank))
    joined = joined.where((F.size(mine) > 0) | (F.size(blank) == F.size(at)))
    text = F.array_join(F.transform(places, lambda i: F.get(at, i)), "\n")
    text = F.when(quoted(row)[text_col].isNotNull(), text)
    shown = [text.alias(c) if c == text_col else F.length(text).cast("long").alias(c) if c == length_col else quoted(row)[c].alias(c) for c in own]
    return joined.select(*shown)
