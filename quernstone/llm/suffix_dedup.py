"""Suffix-array dedup of passages by a distributed merge sort that knows common prefixes.

A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. Which suffixes could
show that is found first: in every window of that length the k-mer with the least hash is its anchor, so equal windows
have equal anchors at equal places, and a suffix at an anchor whose k-mer stands in one document alone has no partner.
Hashes of anchors are exchanged as packed sorted arrays, and a bit for each comes back: shared or not.

The suffixes at shared anchors are then sorted. Each task sorts its own into a run and sends it, cut by ranges of the
order, front-coded: how many bytes a suffix has in common with the one before, and the rest. Each range merges its runs, as rows of
bytes by a sort that finds what is in order already; a range of more than `MOST` suffixes merges them with a loser tree whose nodes keep the
common prefix with the last winner, so bytes known to be equal are not compared again. The order of the first k bytes is
that of their hash: equal cuts of it are even ranges, whatever the data, with no sample. In the merged order the suffixes of
an anchor stand together; with the bytes to the left that travel along, how far two of them agree to both sides is exact, and
where that makes `length` bytes or more, the bytes are marked.

Suffixes of one run that are equal to both sides travel once. Anchors with many different surroundings are not compared in
pairs but by the windows around them, in time linear in their number. An anchor that more than `hot` groups have would bring all
that stands around it to one task: its windows are suffixes of their own instead, each with the hash of the whole window in front,
so they fall into all ranges, and a group sends each different one once.

Groups have about `GROUP_BYTES` of text whatever the size of the input.

Defined results: a null or empty text has nothing to remove; texts shorter than the length are kept whole; a null doc_id
counts as larger than any other; rows that repeat a doc_id don't shorten each other, whether their texts are equal or not;
an empty table gives an empty result; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import partitions, text_or_empty
from quernstone.llm.order_minhash import kmer_hashes, mixed
from quernstone.llm.packing import by_shard, grouped_documents, pack, pack_sorted, rows_of, table_of, unpack, unpack_sorted

LENGTH, K = 50, 20
SLAB = 1 << 16
#: Different surroundings of an anchor up to which they are compared in pairs; pairs that are compared at once, by occurrences.
PAIRS, CHUNK = 32, 1 << 18
#: Suffixes of a range that are merged as arrays, some 300 bytes each.
MOST = 4_000_000
#: Groups that may have an anchor before its windows are dealt out, and bytes of text of a group.
HOT, GROUP_BYTES = 1024, 4 << 20
LAST = (1 << 63) - 1

MESSAGE = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
MESSAGE_DDL = "shard int, grp int, data binary, more binary"
RUN = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), ("suffixes", pa.binary()), ("places", pa.binary())])
RUN_DDL = "shard int, grp int, n int, suffixes binary, places binary"
SPANS = pa.schema([("grp", pa.int32()), ("data", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each width values in a row."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(buffer: bytes, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and k-mer hashes of the anchors in texts that stand in a row in buffer and end at ends."""
    width, places, hashes = length - k + 1, [], []
    margin = 2 * length
    for start in range(0, max(len(buffer) - k + 1, 0), SLAB):
        low = max(0, start - margin)
        part = buffer[low : start + SLAB + margin]
        if len(part) < length:
            continue
        h = kmer_hashes(part, k)
        # k-mers over the end of a text never are the least
        for e in ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, low + len(part), "left")]:
            h[max(0, e - low - k + 1) : e - low] = np.uint64(2**64 - 1)
        least = sliding(h, width, np.minimum)
        most = sliding(np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)], width, np.maximum)
        at = np.flatnonzero((most == h) & (h != np.uint64(2**64 - 1)))
        at = at[(at + low >= start) & (at + low < start + SLAB)]
        places.append(at + low)
        hashes.append(mixed(h[at]))  # the least hashes of windows are low; mixed anew they fill all ranges alike
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


class Group:
    """The texts of a group that are long enough, in a row, with their anchors."""

    def __init__(self, table: pa.Table, length: int, k: int):
        self.rows = rows_of(table)
        self.long = [i for i, (_, data) in enumerate(self.rows) if len(data) >= length]
        texts = [self.rows[i][1] for i in self.long]
        self.buffer = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.empty(0, np.int64)
        self.places, self.hashes = anchors(self.buffer, self.ends, length, k)
        self.text = np.searchsorted(self.ends, self.places, "right")
        ids = [LAST if self.rows[i][0] is None else self.rows[i][0] for i in self.long]
        self.ids_by_text = np.array(ids, dtype=np.int64)
        self.ids = self.ids_by_text[self.text]
        self.values, self.of = np.unique(self.hashes, return_inverse=True)


def ask(table: pa.Table, shards: int, length: int, k: int) -> pa.Table:
    """The anchors' different hashes, by shard, and whether each stands in two documents of the group."""
    g = Group(table, length, k)
    low, high = np.full(len(g.values), LAST), np.full(len(g.values), -LAST - 1)
    np.minimum.at(low, g.of, g.ids)
    np.maximum.at(high, g.of, g.ids)
    twice = low < high
    grp = table.column("grp")[0].as_py()
    return table_of(MESSAGE, [(s, grp, pack_sorted(g.values[at]), pack(np.packbits(twice[at]))) for s, at in by_shard(g.values, shards)])


def answer(table: pa.Table, hot: int) -> pa.Table:
    """Two bits for each hash that a group has sent: stands in two documents or not, and in more than `hot` groups or not."""
    sent = [unpack_sorted(d) for d in table.column("data").to_pylist()]
    if not sent:
        return table_of(MESSAGE, [])
    twice = [np.unpackbits(unpack(m, np.uint8))[: len(v)] for m, v in zip(table.column("more").to_pylist(), sent, strict=True)]
    values, of, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[of[np.concatenate(twice).astype(bool)]] = True
    bits, crowded, at, out = shared[of], (counts > hot)[of], 0, []
    for shard, grp, v in zip(table.column("shard").to_pylist(), table.column("grp").to_pylist(), sent, strict=True):
        out.append((shard, grp, pack(np.packbits(bits[at : at + len(v)])), pack(np.packbits(crowded[at : at + len(v)]))))
        at += len(v)
    return table_of(MESSAGE, out)


def windows_around(g: Group, anchors_: np.ndarray, starts: np.ndarray, length: int, left: int) -> np.ndarray:
    """Where a window of whole length starts that has one of the anchors, each place once."""
    places, text = g.places[anchors_], g.text[anchors_]
    low, high = np.maximum(starts[text], places - left), np.minimum(places, g.ends[text] - length)
    if not len(anchors_):
        return np.empty(0, np.int64)
    depth = np.zeros(len(g.buffer) + 2, np.int32)
    fits = low <= high
    np.add.at(depth, low[fits], 1)
    np.add.at(depth, high[fits] + 1, -1)
    return np.flatnonzero(np.cumsum(depth) > 0)


def surroundings(buffer: bytes, places: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, heads: np.ndarray, length: int, left: int) -> np.ndarray:
    """A row of bytes for each place, in whose order they are sorted: head, bytes to the right, their number, bytes to the left from the place on, their number; zeros fill up."""
    padded = np.frombuffer(bytes(left) + buffer + bytes(length), np.uint8)
    rows = np.zeros((len(places), 8 + length + 1 + left + 1), np.uint8)
    rows[:, :8] = np.ascontiguousarray(heads.astype(">u8")).view(np.uint8).reshape(-1, 8)
    rows[:, 8 : 8 + length] = sliding_window_view(padded, length)[places + left] * (np.arange(length) < n_right[:, None])
    rows[:, 8 + length] = n_right
    rows[:, 9 + length : -1] = sliding_window_view(padded, left)[places][:, ::-1] * (np.arange(left) < n_left[:, None])
    rows[:, -1] = n_left
    return rows


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, equal ones as they come, and which of them in that order differ from the one before. Sorted runs are merged, not sorted anew."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ordered = rows[order]
    return order, np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)][: len(rows)]


def agreement(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two matrices, at most that many bytes."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def coded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Front coding of sorted strings, which are rows of a matrix of that many bytes each: common bytes with the one before, lengths of the rests, and the rests."""
    shared = np.r_[0, agreement(rows[1:], rows[:-1], np.minimum(sizes[1:], sizes[:-1]))][: len(rows)]
    at = np.arange(rows.shape[1])
    rests = rows[(at >= shared[:, None]) & (at < sizes[:, None])].tobytes()
    return shared.astype(np.uint8), (sizes - shared).astype(np.uint8), rests


def decoded(shared: np.ndarray, rest_n: np.ndarray, rests: np.ndarray, wide: int) -> np.ndarray:
    """The strings of coded() as a matrix of zeros else. A byte that is not in a row's rest stands in the last rest above it that has its column."""
    size, at, own = shared.astype(np.int64) + rest_n, np.arange(wide), np.zeros((len(shared), wide), np.uint8)
    own[(at >= shared[:, None]) & (at < size[:, None])] = rests
    numbers = np.arange(len(shared))
    for j, column in enumerate(np.ascontiguousarray(own.T)):
        last = np.maximum.accumulate(np.where(shared <= j, numbers, 0))
        own[:, j] = np.where(size > j, column[last], 0)
    return own


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """coded() of strings."""
    wide = max(map(len, suffixes), default=0)
    rows = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in suffixes), np.uint8).reshape(len(suffixes), wide)
    return coded(rows, np.array([len(s) for s in suffixes], np.int64))


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of which that many bytes are known to be equal."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most  # a and b agree up to low and not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def send(table: pa.Table, marks: pa.Table, shards: int, length: int, k: int) -> pa.Table:
    """The group's sorted run of suffixes at shared anchors, by range."""
    if not table.num_rows:
        return table_of(RUN, [])
    g = Group(table, length, k)
    shared, crowded = np.zeros(len(g.values), bool), np.zeros(len(g.values), bool)
    masks = {r["shard"]: (r["data"], r["more"]) for r in marks.select(["shard", "data", "more"]).to_pylist()}
    for s, at in by_shard(g.values, shards):
        for mask, data in zip((shared, crowded), masks[s], strict=True):
            mask[at] = np.unpackbits(unpack(data, np.uint8))[: at.stop - at.start].astype(bool)
    left, ends = length - k, g.ends
    starts = np.r_[0, ends]
    chosen = np.flatnonzero((shared & ~crowded)[g.of])
    chosen = chosen[np.argsort(g.of[chosen], kind="stable")]
    places, text = g.places[chosen], g.text[chosen]
    low, high = np.maximum(starts[text], places - left), np.minimum(places + length, ends[text])
    rows = surroundings(g.buffer, places, places - low, high - places, g.hashes[chosen], length, left)
    windows = windows_around(g, np.flatnonzero(crowded[g.of]), starts, length, left)
    if len(windows):
        heads = [xxhash.xxh64_intdigest(g.buffer[p : p + length], 42) for p in windows.tolist()]
        whole = np.full(len(windows), length)
        rows = np.concatenate([rows, surroundings(g.buffer, windows, whole * 0, whole, np.array(heads, np.uint64), length, left)])
        places = np.r_[places, windows]
        text = np.searchsorted(ends, places, "right")
    grp, out = table.column("grp")[0].as_py(), []
    if not len(rows):
        return table_of(RUN, [])
    order, new = sorted_rows(rows)
    keys = rows[order[new]]
    at_key = np.r_[np.flatnonzero(new), len(rows)]
    docs, text, local = (x[order] for x in (g.ids_by_text[text], text, places - starts[text]))
    wide = 8 + length
    sizes, lefts = 8 + keys[:, wide].astype(np.int64), keys[:, -1]
    first = np.ascontiguousarray(keys[:, :8]).view(">u8").ravel().astype(np.uint64)
    for s, at in by_shard(first, shards):
        shared_n, rest_n, rests = coded(keys[at, :wide], sizes[at])
        around = keys[at, wide + 1 : -1]
        head = np.stack([shared_n, rest_n, lefts[at]])
        body = head.tobytes() + rests + around[np.arange(left) < lefts[at, None]].tobytes()
        flat = slice(at_key[at.start], at_key[at.stop])
        numbers = np.concatenate([np.diff(at_key[at.start : at.stop + 1]), docs[flat], text[flat], local[flat]]).astype(np.int64)
        out.append((s, grp, at.stop - at.start, pack(np.frombuffer(body, np.uint8)), pack(numbers.view(np.uint8).reshape(-1, 8).T)))
    return table_of(RUN, out)


class Run:
    """A front-coded run, read one suffix at a time: now, shared (bytes in common with the one before), and what belongs to it."""

    def __init__(self, grp: int, n: int, suffixes: bytes, places: bytes):
        body = unpack(suffixes, np.uint8).tobytes()
        self.grp, self.n, self.at, self.now = grp, n, -1, b""
        self.shares, rest_n, left_n = body[:n], body[n : 2 * n], body[2 * n : 3 * n]
        self.rest_at = np.r_[0, np.cumsum(np.frombuffer(rest_n, np.uint8), dtype=np.int64)] + 3 * n
        self.left_at = (np.r_[0, np.cumsum(np.frombuffer(left_n, np.uint8), dtype=np.int64)] + self.rest_at[-1]).tolist()
        self.rest_at = self.rest_at.tolist()
        self.body = body
        numbers = np.ascontiguousarray(unpack(places, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
        self.place_at = np.r_[0, np.cumsum(numbers[:n])].tolist()
        total = self.place_at[-1]
        self.docs, self.text, self.local = (numbers[n + i * total : n + (i + 1) * total].tolist() for i in range(3))

    def step(self) -> int:
        """To the next suffix; the bytes in common with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= self.n:
            return -1
        n = self.shares[self.at]
        self.now = self.now[:n] + self.body[self.rest_at[self.at] : self.rest_at[self.at + 1]]
        return n

    def left(self) -> bytes:
        return self.body[self.left_at[self.at] : self.left_at[self.at + 1]]

    def occurrences(self) -> range:
        return range(self.place_at[self.at], self.place_at[self.at + 1])


def merged(runs: list[Run]):
    """(run, common) in sorted order; common: bytes that the run's suffix has in common with the one given out before it.

    A loser tree. Each node keeps the run that lost there and the common prefix of its suffix with the winner it lost to.
    The winner's next suffix knows its common prefix with the winner itself; on the way up the longer of the two prefixes
    is the smaller suffix, and only if they are equally long are bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    live = [r.step() >= 0 for r in runs] + [False] * (size - len(runs))
    loser, known = [0] * size, [0] * size

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        (a, _), (b, _) = build(2 * node), build(2 * node + 1)
        if not live[b]:
            win, lose, n = a, b, -1
        elif not live[a]:
            win, lose, n = b, a, -1
        else:
            n = common(runs[a].now, runs[b].now, 0)
            win, lose = (a, b) if runs[a].now <= runs[b].now else (b, a)
        loser[node], known[node] = lose, n
        return win, n

    winner = build(1)[0] if size > 1 else 0
    shared = 0
    while live[winner]:
        run = runs[winner]
        yield run, shared
        mine = run.step()
        if mine < 0:
            live[winner] = False
        node = (winner + size) >> 1
        while node:
            theirs = known[node]
            if theirs > mine:
                loser[node], known[node], winner, mine = winner, mine, loser[node], theirs
            elif theirs == mine and mine >= 0:
                other = loser[node]
                a, b = runs[winner].now, runs[other].now
                n = common(a, b, mine)
                if n == len(b) and n < len(a) or n < len(a) and n < len(b) and b[n] < a[n]:
                    loser[node], known[node], winner = winner, n, other
                else:
                    known[node] = n
            node >>= 1
        shared = mine


def agreeing(a: tuple, b: tuple) -> tuple[int, int]:
    return len(a[1]) if a[1] == b[1] else common(a[1], b[1], 0), len(a[0]) if a[0] == b[0] else common(a[0], b[0], 0)


def marked(members: list[tuple[bytes, bytes, int, list]], length: int, left: int):
    """(occurrence, from, to) around an anchor; members: (right, left reversed, least id, occurrences (id, ...)), all different."""
    if len(members) <= PAIRS:
        by_id = sorted(members, key=itemgetter(2)) if len(members) > 1 else members
        least = by_id[0][2]
        for a in members:
            own = a[3]
            last, limits, reach = own[0][0] if len(own) == 1 else max(o[0] for o in own), [], [(0, 0)]
            if last <= least:
                continue
            for b in by_id:
                if b[2] >= last:
                    break
                n_l, n_r = (len(a[1]), len(a[0])) if b is a else agreeing(a, b)
                best_l, best_r = reach[-1]
                if n_l + n_r >= length and (n_l > best_l or n_r > best_r):
                    limits.append(b[2])
                    reach.append((max(best_l, n_l), max(best_r, n_r)))
            if limits:
                for o in a[3]:
                    before = bisect_left(limits, o[0])  # of the ids that have the string, how many are smaller
                    if before:
                        yield o, *reach[before]
        return
    lowest: dict[bytes, int] = {}  # the least id of each window around the anchor
    around = []
    for right, before, d, _ in members:
        n, text = len(before), before[::-1] + right
        first = max(0, length - len(right))
        windows = [text[i : i + length] for i in range(n - first, n - min(left, n) - 1, -1)]
        around.append((first, windows))
        for w in windows:
            known = lowest.get(w)
            if known is None or d < known:
                lowest[w] = d
    for (first, windows), (_, _, _, places) in zip(around, members, strict=True):
        ids = [lowest[w] for w in windows]
        for o in places:
            fits = [n for n, d in enumerate(ids, first) if d < o[0]]
            if fits:
                yield o, fits[-1], length - fits[0]


def streamed(table: pa.Table, length: int, k: int) -> pa.Table:
    """compare() of a range that is too large for arrays: its runs go through the loser tree, an anchor at a time."""
    order = sorted(range(table.num_rows), key=table.column("grp").to_pylist().__getitem__)
    columns = [table.column(c).to_pylist() for c in ("grp", "n", "suffixes", "places")]
    runs = [Run(*(c[i] for c in columns)) for i in order]
    spans: dict[int, list[tuple[int, int, int]]] = {r.grp: [] for r in runs}
    around: dict[tuple[bytes, bytes], list] = {}

    def close() -> None:
        members = [(right, before, places[0][0] if len(places) == 1 else min(o[0] for o in places), places) for (right, before), places in around.items()]
        if len(members) > 1 or members and members[0][2] < max(o[0] for o in members[0][3]):
            for (_, grp, text, local), n_l, n_r in marked(members, length, length - k):
                spans[grp].append((text, local - n_l, local + n_r))
        around.clear()

    for run, shared in merged(runs):
        if shared < 8 + k and around:
            close()
        key = (run.now[8:], run.left())
        places = around.get(key)
        if places is None:
            places = around[key] = []
        for i in run.occurrences():
            places.append((run.docs[i], run.grp, run.text[i], run.local[i]))
    close()
    return table_of(SPANS, [(grp, pack(np.array(s, np.int32))) for grp, s in spans.items() if s])


def expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ..., n of them for each, and which one each belongs to."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (first - np.cumsum(n) + n)[of], of


def compare(table: pa.Table, length: int, k: int, most: int = MOST) -> pa.Table:
    """Merges the runs of a range and gives, for each group, the spans that go: text, from, to."""
    if not table.num_rows:
        return table_of(SPANS, [])
    grps, ns, suffixes, places = (table.column(c).to_pylist() for c in ("grp", "n", "suffixes", "places"))
    if sum(ns) > most:
        return streamed(table, length, k)
    left, wide = length - k, 8 + length
    parts, numbers, counts = [], [], []
    for n, body, own in zip(ns, suffixes, places, strict=True):
        body = unpack(body, np.uint8)
        ends = 3 * n + int(body[n : 2 * n].sum(dtype=np.int64))
        parts.append((*body[: 3 * n].reshape(3, n), body[3 * n : ends], body[ends:]))
        own = np.ascontiguousarray(unpack(own, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
        counts.append(own[:n])
        numbers.append(own[n:].reshape(3, -1))
    shared, rest_n, left_n, rests, lefts = (np.concatenate(p) for p in zip(*parts, strict=True))
    rows = np.zeros((len(shared), wide + 1 + left + 1), np.uint8)
    rows[:, :wide] = decoded(shared, rest_n, rests, wide)
    rows[:, wide] = shared + rest_n - 8
    around = np.zeros((len(shared), left), np.uint8)
    around[np.arange(left) < left_n[:, None]] = lefts
    rows[:, wide + 1 : -1], rows[:, -1] = around, left_n
    del parts, around, rests, lefts
    order, new = sorted_rows(rows)
    member = np.empty(len(rows), np.int64)
    member[order] = np.cumsum(new) - 1
    rows = rows[order[new]]
    # Occurrences, by member.
    grp = np.repeat(grps, [x.shape[1] for x in numbers])
    docs, text, local = np.concatenate(numbers, axis=1)
    of = np.repeat(member, np.concatenate(counts))
    by_member = np.argsort(of, kind="stable")
    grp, docs, text, local, of = (x[by_member] for x in (grp, docs, text, local, of))
    edges = np.searchsorted(of, np.arange(len(rows) + 1))
    least, last = np.minimum.reduceat(docs, edges[:-1]), np.maximum.reduceat(docs, edges[:-1])
    # Anchors: members in a row that agree in head and k bytes.
    starts = np.flatnonzero(np.r_[True, (rows[1:, : 8 + k] != rows[:-1, : 8 + k]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(rows)])
    alive = np.minimum.reduceat(least, starts) < np.maximum.reduceat(last, starts)
    to_left, to_right = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    n_right, n_left = rows[:, wide].astype(np.int64), rows[:, -1].astype(np.int64)
    few = np.flatnonzero(alive & (sizes <= PAIRS))
    members, at = expanded(starts[few], sizes[few])
    first, n = starts[few][at], sizes[few][at]
    work = np.cumsum(n * (edges[members + 1] - edges[members]))
    cuts = np.unique(np.r_[0, np.searchsorted(work, np.arange(CHUNK, work[-1] if len(work) else 0, CHUNK)), len(members)])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        b, at = expanded(first[low:high], n[low:high])
        a = members[low:high][at]
        a, b = (x[least[b] < last[a]] for x in (a, b))
        r = agreement(rows[a, 8:wide], rows[b, 8:wide], np.minimum(n_right[a], n_right[b]))
        l_ = agreement(rows[a, wide + 1 : -1], rows[b, wide + 1 : -1], np.minimum(n_left[a], n_left[b]))
        whole = r + l_ >= length
        a, b, r, l_ = a[whole], b[whole], r[whole], l_[whole]
        o, at = expanded(edges[a], edges[a + 1] - edges[a])
        later = least[b][at] < docs[o]
        o, at = o[later], at[later]
        np.maximum.at(to_left, o, l_[at])
        np.maximum.at(to_right, o, r[at])
    for g in np.flatnonzero(alive & (sizes > PAIRS)).tolist():
        crowd = []
        for m in range(starts[g], starts[g] + sizes[g]):
            own = rows[m].tobytes()
            its = range(edges[m], edges[m + 1])
            crowd.append((own[8 : 8 + n_right[m]], own[wide + 1 : wide + 1 + n_left[m]], int(least[m]), list(zip(docs[its.start : its.stop].tolist(), its, strict=True))))
        for (_, o), n_l, n_r in marked(crowd, length, left):
            to_left[o], to_right[o] = n_l, n_r
    found = np.flatnonzero(to_left + to_right > 0)
    if not len(found):
        return table_of(SPANS, [])
    found = found[np.argsort(grp[found], kind="stable")]
    spans = np.stack([text[found], local[found] - to_left[found], local[found] + to_right[found]], axis=1).astype(np.int32)
    values, at = np.unique(grp[found], return_index=True)
    return table_of(SPANS, [(int(g), pack(x)) for g, x in zip(values, np.split(spans, at[1:]), strict=True)])


def cut(table: pa.Table, spans: pa.Table, length: int, finish) -> list[tuple]:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of each text, passed through finish."""
    rows = rows_of(table)
    long = [i for i, (_, data) in enumerate(rows) if len(data) >= length]
    found = [unpack(d, np.int32).reshape(-1, 3) for d in spans.column("data").to_pylist()]
    found = np.concatenate(found) if found else np.empty((0, 3), np.int32)
    found = found[np.argsort(found[:, 0], kind="stable")]
    edges = np.searchsorted(found[:, 0], np.arange(len(long) + 1))
    by_row = {i: found[edges[n] : edges[n + 1], 1:] for n, i in enumerate(long)}
    out = []
    for i, (doc_id, data) in enumerate(rows):
        mine = by_row.get(i)
        if mine is None or not len(mine):
            out.append(finish(doc_id, data, len(data), 0, 0))
            continue
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, mine[:, 0], 1)
        np.add.at(depth, mine[:, 1], -1)
        gone = np.cumsum(depth[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append(finish(doc_id, kept, len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
    return out


def removal(docs: DataFrame, id_col: str, text_col: str, length: int, k: int, hot: int, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    if not 0 < k < length <= 200:
        raise ValueError("k must be less than length, and length at most 200")
    shards = 2 * partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    texts = grouped_documents(docs, id_col, text_col, max(partitions(docs.sparkSession), -(-size // GROUP_BYTES)))
    asked = texts.groupBy("grp").applyInArrow(lambda t: ask(t, shards, length, k), MESSAGE_DDL)
    answered = asked.groupBy("shard").applyInArrow(lambda t: answer(t, hot), MESSAGE_DDL)
    runs = texts.groupBy("grp").cogroup(answered.groupBy("grp")).applyInArrow(lambda t, m: send(t, m, shards, length, k), RUN_DDL)
    spans = runs.groupBy("shard").applyInArrow(lambda t: compare(t, length, k), "grp int, data binary")
    return texts.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(lambda t, s: table_of(schema, cut(t, s, length, finish)), ddl)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of each row; kept: the bytes that stay."""
    return removal(docs, id_col, text_col, length, k, hot, lambda *row: row, RESULT, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """As remove_repeats, with kept_sha256 in place of the bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return removal(docs, id_col, text_col, length, k, hot, lambda d, kept, *n: (d, *n, hashlib.sha256(kept).hexdigest()), schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
