"""Scoring by an interpolated modified Kneser-Ney n-gram model that is counted, kept and used in shards.

Texts are read once: chunks of a partition become groups, token numbers with a sorted table of word hashes. A word is known by its 64-bit hash, an n-gram by the hash of its context's hash and its last word, cut to as
many bits as the input needs for less than one false match in 16,384 n-grams. Each group sends its different n-grams as one sorted hash array,
cut into shards by equal ranges of the hash, with its counts. A shard adds up what the groups sent and answers each group in the
order of the hashes it asked about, so hashes never travel back; it also says which one group owns an n-gram. Of the n-grams
that it owns, and of which it now knows the count in the whole corpus, a group tells the next lower order two things: one more
word goes before this suffix (the continuation count), and one more word, seen once, twice or more often, follows this
context. Order by order, that gives all that the model is made of, and nobody ever holds all of it: the answers are each
group's slice of the model. A worker writes its slice as sorted hash arrays with their values, maps the file into memory and
scores its texts from there.

store_model keeps the shards themselves, in a folder that executors share, and model_scores scores any documents by them: each
group's n-grams go to their shards, whose sorted arrays a worker maps into memory to find them.

A group has about `GROUP_BYTES` of text whatever the size of the input, and a shard adds up counts that each group has added up before, so
a word or word pair that a third of all texts have is one entry of each group.

The model: p_m(w | c) = max(a - D(a), 0) / total(c) + (D1 n1(c) + D2 n2(c) + D3 n3(c)) / total(c) * p_{m-1}(w | c'), with
counts a at the highest order, continuation counts below it (counts for n-grams that start at the start of a text), and
the three discounts of each order from its counts of counts. The lowest order goes on to a uniform share of words that
were never seen. A context that was never seen leaves p_{m-1}.

Defined results: a null or empty text is one token, its end; a null doc_id counts as the empty text when documents are
held out; repeated rows are counted and scored each; without any training text all probabilities are the uniform share;
an empty table gives an empty result; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import partitions, quoted
from quernstone.llm.order_minhash import mixed, odd_factors
from quernstone.llm.packing import every_shard, pack, pack_sorted, table_of, unpack, unpack_sorted
from quernstone.sources.storage import stored

ORDER = 3
#: Bytes of text of a group, and bits of an n-gram's hash beyond those that number the n-grams of the input (four bytes each at least).
GROUP_BYTES, SPARE_BITS = 10 << 20, 14
HELD_OUT, FOLDS = 2, 7
START, END = b"\n start", b"\n end"  # no words: they hold white space
FACTOR = odd_factors(1, 64, 9)[0]

GROUP = pa.schema([("grp", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("place", pa.binary()), ("tokens", pa.binary())])
GROUP_DDL = "grp long, docs binary, lengths binary, words binary, place binary, tokens binary"
MESSAGE = pa.schema([("shard", pa.int32()), ("grp", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
MESSAGE_DDL = "shard int, grp long, hashes binary, counts binary"
ANSWER = pa.schema([("grp", pa.int64()), ("level", pa.int32()), ("shard", pa.int32()), ("data", pa.binary()), ("tally", pa.binary())])
ANSWER_DDL = "grp long, level int, shard int, data binary, tally binary"
MODEL = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("tally", pa.binary())])
MODEL_DDL = "level int, shard int, hashes binary, counts binary, tally binary"
QUESTION = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("grp", pa.int64()), ("hashes", pa.binary())])
QUESTION_DDL = "level int, shard int, grp long, hashes binary"
TALLIES = ("n1", "n2", "n3", "n4", "n3up", "total", "tokens", "words")
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def pack_counts(columns: list[np.ndarray]) -> bytes:
    """Integers as bytes of one weight together, where zeros cost nothing; before them the number of columns."""
    whole = np.stack([c.astype(np.uint64) for c in columns])
    return bytes([len(columns)]) + pack(whole.view(np.uint8).reshape(-1, 8).T)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = np.ascontiguousarray(unpack(data[1:], np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return raw.reshape(data[0], -1).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """uint32 values, bytes of one weight together."""
    return pack(values.view(np.uint8).reshape(-1, 4).T)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def tokenised(batches, group_bytes: int, bits: int):
    """A row for each chunk of a partition's texts: document ids, tokens of each, word hashes in order, and tokens as numbers of words."""
    import xxhash
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids, vocabulary, numbers, size, made = [], {END: 0}, [], 0, 0

    def row() -> pa.RecordBatch:
        nonlocal ids, vocabulary, numbers, size, made
        words = np.array([xxhash.xxh64_intdigest(w, 42) for w in vocabulary], dtype=np.uint64) & np.uint64((1 << 64) - (1 << (64 - bits)))
        order = np.argsort(words)
        tokens = np.concatenate(numbers)
        # Common words get small numbers, which pack better; place is where a number's hash is in the sorted table.
        common = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        number, place = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
        number[common] = np.arange(len(words), dtype=np.uint32)
        place[number[order]] = np.arange(len(words), dtype=np.uint32)
        tokens = number[tokens]
        lengths = np.array([len(n) for n in numbers], dtype=np.uint64)
        docs = np.array([[d is None, d or 0] for d in ids], dtype=np.int64).T
        out = (part << 32 | made, pack(docs), pack(lengths), pack_sorted(words[order], 64 - bits), planes(place), planes(tokens))
        ids, vocabulary, numbers, size, made = [], {END: 0}, [], 0, made + 1
        return table_of(GROUP, [out]).to_batches()[0]

    for b in batches:
        for d, t in zip(b.column(0), b.column(1), strict=True):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in data.lower().split()]
            found.append(0)
            ids.append(d.as_py())
            numbers.append(np.array(found, dtype=np.uint32))
            size += len(data) + 16
            if size >= group_bytes:
                yield row()
    if ids:
        yield row()


def different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in order, a place of each, and for each place which one it is. Any place will do: equal n-grams have equal contexts."""
    by = np.argsort(hashes)
    ordered = hashes[by]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    at = np.empty(len(by), np.int32)
    at[by] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], by[new].astype(np.int32), at


class Grams:
    """The n-grams of a group's texts: for each of the levels, the different hashes, where they stand, and by token which one it is."""

    def __init__(self, table: pa.Table, bits: list[int], *levels: int):
        import xxhash

        self.grp, docs, lengths, words, place, tokens = (table.column(c)[0].as_py() for c in GROUP.names)
        none, ids = unpack(docs, np.int64).reshape(2, -1)
        self.docs = [None if n else d for n, d in zip(none.tolist(), ids.tolist(), strict=True)]
        self.lengths = unpack(lengths, np.uint64).astype(np.int64)
        word = unpack_sorted(words, 64 - bits[1])
        self.tokens = word[from_planes(place)][from_planes(tokens)]
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.offset = (np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)).astype(np.int32)
        self.out = np.array([held_out(d) for d in self.docs])
        self.train = np.repeat(~self.out, self.lengths)
        self.start, self.bits = np.uint64(xxhash.xxh64_intdigest(START, 42)), bits
        self.reached, self.gram, self.none = 0, np.zeros(len(self.tokens), np.uint64), np.uint64(0)  # of the order reached so far: hashes by token, and that of as many starts
        self.values, self.at, self.first, self.context = {}, {}, {}, {}
        for m in levels:
            self.reach(m)

    def reach(self, m: int) -> None:
        """Makes the arrays of a level; levels come in ascending order."""
        with np.errstate(over="ignore"):
            while self.reached < m:
                self.gram = mixed(self.before() * FACTOR + self.tokens)
                self.none = mixed(np.array([self.none * FACTOR + self.start], dtype=np.uint64))[0]
                self.reached += 1
        # The context at the start of a text is n-gram too: it stands behind the last token here.
        whole = np.r_[self.gram, self.none] & np.uint64((1 << 64) - (1 << (64 - self.bits[m])))
        self.values[m], self.first[m], self.at[m] = different(whole)
        context = np.r_[len(whole) - 1, np.arange(len(whole) - 2)] if len(whole) > 1 else np.empty(0, np.int64)
        context[self.starts] = len(whole) - 1
        self.context[m] = self.at[m][context]  # by token: the number of the m-gram before it

    def drop(self, m: int) -> None:
        for arrays in (self.values, self.at, self.first, self.context):
            arrays.pop(m, None)

    def before(self) -> np.ndarray:
        """The hash of the tokens before each token, as many as have been reached."""
        shifted = np.r_[self.none, self.gram[:-1]] if len(self.tokens) else self.gram
        shifted[self.starts] = self.none
        return shifted

    def counts(self, m: int, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.at[m][:-1][which], minlength=len(self.values[m]))


def answers_of(table: pa.Table, level: int, shards: int) -> np.ndarray:
    """The columns that the shards have answered at a level, in the order of the group's hashes."""
    levels, numbers, data = (table.column(c).to_pylist() for c in ("level", "shard", "data"))
    by = {s: d for k, s, d in zip(levels, numbers, data, strict=True) if k == level}
    return np.concatenate([unpack_counts(by[s]) for s in range(shards)], axis=1)


def message(grp: int, values: np.ndarray, columns: list[np.ndarray], shards: int, bits: int) -> pa.Table:
    """A row for every shard, also where it is empty: whoever asks is told the counts of counts."""
    return table_of(MESSAGE, [(s, grp, pack_sorted(values[at], 64 - bits), pack_counts([c[at] for c in columns])) for s, at in every_shard(values, shards)])


def ask(table: pa.Table, answered: pa.Table | None, level: int, order: int, shards: int, bits: list[int]) -> pa.Table:
    """What a group tells of its n-grams of a level: counts, then as contexts n1, n2, n3 and what the total has beyond, and at level 1 the tokens."""
    if not table.num_rows:
        return table_of(MESSAGE, [])
    if level == order:
        g = Grams(table, bits, order)
        count = g.counts(order, g.train)
        return message(g.grp, g.values[order], [count, *([count] if order == 1 else [])], shards, bits[order])
    g = Grams(table, bits, level, level + 1)
    above = answers_of(answered, level + 1, shards)
    count, owned = above[0], above[1].astype(bool) & (g.first[level + 1] < len(g.tokens))
    place = g.first[level + 1][owned]
    n, a = len(g.values[level]), count[owned]
    inside = g.offset[place] >= level - 1
    own = np.bincount(g.at[level][place[inside]], minlength=n) + g.counts(level, g.train & (g.offset < level - 1))
    context = g.context[level][place]
    seen = [np.bincount(context[w], minlength=n) for w in (a == 1, a == 2, a > 2)]
    beyond = np.bincount(context, weights=np.maximum(a - 3, 0), minlength=n).astype(np.int64)
    raw = [g.counts(1, g.train)] if level == 1 else []
    return message(g.grp, g.values[level], [own, *seen, beyond, *raw], shards, bits[level])


class Summed:
    """A shard's messages, in order of their groups, and what they add up to: values, sums, and for each hash sent its place in values."""

    def __init__(self, table: pa.Table, bits: int):
        order = np.argsort(table.column("grp").to_numpy(), kind="stable").tolist()
        self.shard, self.groups = table.column("shard")[0].as_py(), table.column("grp").to_numpy()[order].tolist()
        hashes, counts = (table.column(c) for c in ("hashes", "counts"))
        sent = [unpack_sorted(hashes[i].as_py(), 64 - bits) for i in order]
        self.edges = np.r_[0, np.cumsum([len(v) for v in sent])]
        self.values, self.of = np.unique(np.concatenate(sent), return_inverse=True)
        del sent
        parts = [unpack_counts(counts[i].as_py()) for i in order]
        self.sums = [np.bincount(self.of, weights=np.concatenate([x[k] for x in parts]), minlength=len(self.values)).astype(np.int64) for k in range(len(parts[0]))]
        self.own = np.flatnonzero(np.concatenate([x[0] for x in parts]) > 0)  # places of those that a group has in training
        count, raw = self.sums[0], self.sums[-1]
        self.tally = np.array([*((count == k).sum() for k in (1, 2, 3, 4)), (count > 2).sum(), count.sum(), raw.sum(), (raw > 0).sum()], np.int64).tobytes()


def answer(table: pa.Table, level: int, bits: int, owners: bool) -> pa.Table:
    """For each hash that a group sent: the count and whether the group owns it, or the count and the other sums; with each answer the shard's counts of counts."""
    s = Summed(table, bits)
    owner = np.full(len(s.values), len(s.of), np.int64)
    owner[s.of[s.own[::-1]]] = s.own[::-1]  # of those that have it in training, the first
    out = []
    for grp, a, b in zip(s.groups, s.edges[:-1].tolist(), s.edges[1:].tolist(), strict=True):
        mine = s.of[a:b]
        out.append((grp, level, s.shard, pack_counts([s.sums[0][mine], owner[mine] == np.arange(a, b)] if owners else [c[mine] for c in s.sums]), s.tally))
    return table_of(ANSWER, out)


def model_shard(table: pa.Table, level: int, bits: int) -> pa.Table:
    """A shard of the model: its sorted hashes that training has, with their sums."""
    s = Summed(table, bits)
    there = np.flatnonzero(np.any(np.stack(s.sums) > 0, axis=0))
    return table_of(MODEL, [(level, s.shard, pack_sorted(s.values[there], 64 - bits), pack_counts([c[there] for c in s.sums]), s.tally)])


def ask_model(table: pa.Table, order: int, shards: int, bits: list[int]) -> pa.Table:
    """The different n-grams of a group, of all orders, by shard."""
    g, out = Grams(table, bits), []
    for m in range(1, order + 1):
        g.reach(m)
        out += [(m, s, g.grp, pack_sorted(g.values[m][at], 64 - bits[m])) for s, at in every_shard(g.values[m], shards)]
        g.drop(m)
    return table_of(QUESTION, out)


def look_up(questions: pa.Table, model: pa.Table, order: int, bits: list[int]) -> pa.Table:
    """What a stored shard has for the hashes that groups ask about. Its arrays are mapped from a file, and found by binary search."""
    if not questions.num_rows:
        return table_of(ANSWER, [])
    level, shard = questions.column("level")[0].as_py(), questions.column("shard")[0].as_py()
    width = (1 if level == order else 5) + (level == 1)
    if model.num_rows:
        hashes, columns, tally = unpack_sorted(model.column("hashes")[0].as_py(), 64 - bits[level]), unpack_counts(model.column("counts")[0].as_py()), model.column("tally")[0].as_py()
    else:
        hashes, columns, tally = np.empty(0, np.uint64), np.empty((width, 0), np.int64), np.zeros(len(TALLIES), np.int64).tobytes()
    mapped = Mapped(hashes, columns)
    known, out = mapped.column(-len(columns) - 1), []
    for grp, asked in zip(questions.column("grp").to_pylist(), questions.column("hashes").to_pylist(), strict=True):
        values = unpack_sorted(asked, 64 - bits[level])
        at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        hit = known[at] == values if len(known) else np.zeros(len(values), bool)
        out.append((grp, level, shard, pack_counts([np.where(hit, mapped.column(i)[at] if len(known) else 0, 0) for i in range(len(columns))]), tally))
    return table_of(ANSWER, out)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more; where the counts of counts give none, half, one and one and a half."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.05 * k), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))])


class Mapped:
    """A slice of the model: sorted hashes and columns of values, each in the narrowest type, in a file that is mapped and has no name any more."""

    def __init__(self, hashes: np.ndarray, columns: np.ndarray):
        parts, self.places, end = [hashes, *(c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns)], [], 0
        with tempfile.NamedTemporaryFile(prefix="ngrams-", delete=False) as f:
            for x in parts:
                self.places.append((end, x.dtype, len(x)))
                f.write(np.ascontiguousarray(x).tobytes())
                end += x.nbytes
        self.data = np.memmap(f.name, dtype=np.uint8, mode="r") if end else np.empty(0, np.uint8)
        os.unlink(f.name)

    def column(self, i: int) -> np.ndarray:
        """The i-th column of values; -1 is the last."""
        at, kind, n = self.places[i + 1 if i >= 0 else i]
        return self.data[at : at + n * kind.itemsize].view(kind)


def score(table: pa.Table, answered: pa.Table, order: int, shards: int, bits: list[int]) -> pa.Table:
    if not table.num_rows:
        return table_of(SCORES, [])
    g = Grams(table, bits)
    of, tallies = answered.column("level").to_numpy(), np.array([np.frombuffer(t, np.int64) for t in answered.column("tally").to_pylist()])
    stats = {m: dict(zip(TALLIES, tallies[of == m].sum(axis=0).tolist(), strict=True)) for m in range(1, order + 1)}
    low = stats[1]
    unseen = 1.0 / (low["words"] + 1)
    below = None
    for m in range(1, order + 1):
        g.reach(m)
        model = Mapped(g.values[m], answers_of(answered, m, shards))
        s, at = stats[m], g.at[m][:-1]
        cut = discounts(*(s[k] for k in ("n1", "n2", "n3", "n4")))
        a = model.column(0)[at].astype(np.int64)
        gain = np.maximum(a - cut[np.minimum(a, 3)], 0)
        if m == 1:
            total = s["total"]
            p = gain / total + (cut[1] * s["n1"] + cut[2] * s["n2"] + cut[3] * s["n3up"]) / total * unseen if total else np.full(len(at), unseen)
            count = model.column(-1)[at].astype(np.int64)
        else:
            context = g.context[m - 1]
            n1, n2, n3, beyond = (below.column(i)[context].astype(np.int64) for i in range(1, 5))
            total = n1 + 2 * n2 + 3 * n3 + beyond
            safe = np.maximum(total, 1)
            p = np.where(total > 0, gain / safe + (cut[1] * n1 + cut[2] * n2 + cut[3] * n3) / safe * p, p)
        g.drop(m - 1)
        below = model
    base = np.log10((count + 1) / (low["tokens"] + low["words"] + 1))
    add = lambda x: np.add.reduceat(x, g.starts)
    known, base, total = add((count > 0).astype(np.int64)), add(base), add(np.log10(p))
    rows = zip(g.docs, g.out.tolist(), g.lengths.tolist(), known.tolist(), base.tolist(), total.tolist(), strict=True)
    return table_of(SCORES, [(d, o, n, k, low["tokens"], b, t) for d, o, n, k, b, t in rows])


class Training:
    """Documents in groups, and for each order the messages about its n-grams that shards add up."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, order: int, group_bytes: int, repeatable: bool, like: dict | None = None):
        if order < 1:
            raise ValueError("the order must be 1 or more")
        texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
        texts = texts if repeatable else stored(texts)
        if like:
            bits, self.shards = like["bits"], like["shards"]
        else:
            size = texts.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1))).first()[0] or 1
            # Words are few: their hashes have twice the bits that number them, and some.
            bits = [64, min(64, 2 * (size // 64).bit_length() + 8 + SPARE_BITS // 2)] + [min(64, (size // 4).bit_length() + SPARE_BITS)] * (order - 1)
            self.shards = partitions(docs.sparkSession)
        self.order, self.bits = order, bits
        self.groups = texts.mapInArrow(lambda batches: tokenised(batches, group_bytes, bits[1]), GROUP_DDL)

    def messages(self):
        """(level, messages by shard), from the highest order; each level asks the one above which group owns an n-gram."""
        owned = None
        for level in range(self.order, 0, -1):
            if owned is None:
                first = self.asking(level)
                sent = self.groups.groupBy("grp").applyInArrow(lambda t: first(t, None), MESSAGE_DDL)
            else:
                sent = self.groups.groupBy("grp").cogroup(owned.groupBy("grp")).applyInArrow(self.asking(level), MESSAGE_DDL)
            by_shard = sent.groupBy("shard")
            yield level, by_shard
            owned = by_shard.applyInArrow(self.of_level(answer, level, True), ANSWER_DDL)

    def asking(self, level: int):
        order, shards, bits = self.order, self.shards, self.bits
        return lambda t, a: ask(t, a, level, order, shards, bits)

    def of_level(self, f, level: int, *more):
        bits = self.bits[level]
        return lambda t: f(t, level, bits, *more)

    def scored(self, answers: DataFrame) -> DataFrame:
        order, shards, bits = self.order, self.shards, self.bits
        return self.groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda t, a: score(t, a, order, shards, bits), SCORES_DDL)


def perplexity_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, group_bytes: int = GROUP_BYTES, repeatable: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are sums of log10.

    The perplexity of a text is 10 ** (-score / n_tokens). repeatable: a partition of docs that is computed again has the same rows in
    the same order, as in a scan of files; otherwise docs are stored first, so that groups stay what they were if executors are lost.
    """
    t = Training(docs, id_col, text_col, order, group_bytes, repeatable)
    answers = [sent.applyInArrow(t.of_level(answer, level, False), ANSWER_DDL) for level, sent in t.messages()]
    return t.scored(reduce(DataFrame.union, answers))


def store_model(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, group_bytes: int = GROUP_BYTES, repeatable: bool = False) -> None:
    """The model of the documents that are not held out, in a folder that executors share: sorted hash arrays with their counts, a row for each order and shard."""
    t = Training(docs, id_col, text_col, order, group_bytes, repeatable)
    shards = [sent.applyInArrow(t.of_level(model_shard, level), MODEL_DDL) for level, sent in t.messages()]
    reduce(DataFrame.union, shards).write.mode("overwrite").parquet(f"{path}/shards")
    about = [(order, t.shards, t.bits)]
    docs.sparkSession.createDataFrame(about, "model_order int, shards int, bits array<int>").write.mode("overwrite").json(f"{path}/about")


def model_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, repeatable: bool = False) -> DataFrame:
    """As perplexity_scores, by a stored model: any documents, each of whose n-grams is looked up in its shard."""
    about = docs.sparkSession.read.schema("model_order int, shards int, bits array<int>").json(f"{path}/about").first()
    order, shards, bits = about["model_order"], about["shards"], list(about["bits"])
    t = Training(docs, id_col, text_col, order, group_bytes, repeatable, {"bits": bits, "shards": shards})
    asked = t.groups.groupBy("grp").applyInArrow(lambda g: ask_model(g, order, shards, bits), QUESTION_DDL)
    model = docs.sparkSession.read.schema(MODEL_DDL).parquet(f"{path}/shards")
    return t.scored(asked.groupBy("level", "shard").cogroup(model.groupBy("level", "shard")).applyInArrow(lambda q, m: look_up(q, m, order, bits), ANSWER_DDL))
