"""Byte-level BPE encoding and decoding in linear time.

The vocabulary's tokens are byte strings; mapped to Latin-1 they are text that an Aho-Corasick automaton takes. A piece of
text is encoded from left to right: take the longest token that starts here; keep it if the pair with the token before it
is one that merging by rank would leave alone; else try the next shorter token at this place, and if none is left, step
back over the token before. A place that has once been stepped back from is never tried again, so the work is linear in
the piece. Whether a pair is compatible is found by undoing its merges and memoised. The result is the one that merging
the lowest rank first gives.

Each match of the pattern is encoded by itself, as the reference library does without special tokens. Pieces that were
seen before come from a bounded memo in each worker.

Defined results: a null or empty text has no tokens; any other text, however long or strange, decodes to its own bytes;
repeated rows are encoded each; a null doc_id stays null; an empty table gives an empty result; only the id and text
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm.common import quoted

#: Pieces in a worker's memo; when it is full it starts anew.
MEMO_PIECES = 400_000
#: Pieces longer than this are encoded each time.
MEMO_LENGTH = 64
#: Pairs in the memo of adjacent-token compatibility.
MEMO_PAIRS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """encode(bytes) -> list of ids, for one piece; exact for any vocabulary that merging by rank can build and that has all bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must have every byte")
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        # Only tokens that merging gives back as themselves can be part of an encoding.
        made = [rank for token, rank in ranks.items() if self._halves(token) is not False]
        self.automaton = ahocorasick.Automaton()
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        for rank in made:
            if len(self.tokens[rank]) > 1:
                self.automaton.add_word(self.tokens[rank].decode("latin-1"), (rank, len(self.tokens[rank]) - 1))
        usable = set(made)
        self.shorter = {rank: self._prefix(self.tokens[rank], usable) for rank in made}
        self.size = {rank: len(self.tokens[rank]) for rank in made}
        self.automaton.make_automaton()

    def _halves(self, token: bytes) -> tuple[int, int] | None | bool:
        """The pair whose merge makes the token (None: a single byte; False: merging never makes it)."""
        rank = self.ranks[token]
        if len(token) == 1:
            self.split[rank] = None
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if at[0] >= rank:
                return False
            i = at[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.split[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.split[rank]

    def _prefix(self, token: bytes, usable: set[int]) -> int | None:
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None and r in usable), None)

    def _compatible(self, left: int, right: int) -> bool:
        """True if merging left + right by rank keeps the border between them."""
        ranks, tokens, split, limit, a, b = self.ranks, self.tokens, self.split, 1 << 60, left, right
        while True:
            # a and b end and start at the border; merges of a rank below limit come before those that were undone
            merged = ranks.get(tokens[a] + tokens[b], 1 << 60)
            if merged < limit and split.get(merged) == (a, b):
                found = False
                break
            # Undo the later of the two merges that made a and b: the higher rank, or the right one, as equal merges go from left to right.
            own, other = (split[a], split[b]) if a > b else (split[b], split[a])
            if own is None and other is None:
                found = True
                break
            if (a > b) == (own is not None):
                limit, a = a, split[a][1]
            else:
                limit, b = b + 1, split[b][0]  # of equal merges the one across the border, on the left, comes first
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = found
        return found

    def longest(self, piece: bytes) -> list[int]:
        """For each place the longest token that starts there: matches come by where they end, so the longest for a start comes last."""
        found = list(map(self.bytes.__getitem__, piece))
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            found[end - back] = rank
        return found

    def encode(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        if known is not None and known in self.split:
            return [known]
        size, pairs, longest, n = self.size, self.pairs, self.longest(piece), len(piece)
        dead: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        while at < n:
            token = longest[at]
            while True:
                end = at + size[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self._compatible(last, token)
                    if fits:
                        break
                token = self.shorter[token]
                while token is None:
                    dead.add(at)
                    token = out.pop()
                    last = out[-1] if out else -1
                    at -= size[token]
                    token = self.shorter[token]
            out.append(token)
            last, at = token, end
        return out


class Memo(dict):
    """piece -> ids; encodes what it does not have and keeps it, within its bounds."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode(piece.encode("utf-8")))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> tuple[Encoder, object, Memo]:
    import regex

    encoder = Encoder(load_ranks(path))
    return encoder, regex.compile(pattern), Memo(encoder)


class Codec:
    """encode(text) -> ids and decode(ids) -> bytes, with the worker's memo of pieces."""

    def __init__(self, path: str, pattern: str):
        self.encoder, compiled, self.memo = encoder_of(path, pattern)
        self.pieces = compiled.findall

    def forget(self) -> None:
        self.memo.clear()
        self.encoder.pairs.clear()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, ids))


def mapped(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    """rows(codec, text) -> the values after doc_id, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for b in batches:
            made = [rows(codec, t.as_py() or "") for t in b.column(1)]
            columns = [b.column(0), *(pa.array([m[i] for m in made], schema.field(i + 1).type) for i in range(len(schema) - 1))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        codec.forget()  # a worker lives on for other tasks

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of the whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return mapped(docs, id_col, text_col, path, pattern, lambda codec, text: (codec.encode(text),), schema, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids of (doc_id, ids) stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for b in batches:
            data = [codec.decode(ids.as_py() or []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to, in one pass."""

    def rows(codec: Codec, text: str) -> tuple:
        ids = codec.encode(text)
        written = ",".join(map(decimal(codec.encoder).__getitem__, ids))
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    def decimal(encoder: Encoder) -> dict[int, str]:
        if not hasattr(encoder, "decimal"):
            encoder.decimal = {rank: str(rank) for rank in encoder.tokens}
        return encoder.decimal

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return mapped(docs, id_col, text_col, path, pattern, rows, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
