"""Byte-level BPE encoding by a lazily determinised transducer; streaming decoding by a UTF-8 state machine.

Merges by rank have a local property: a token sequence is what the merges give for a text if and only if each
two neighbours are what the merges give for those two alone. So the last token of every prefix is unique, and the
encoding of the whole is found from the left. The transducer's state is (last emitted token, bytes read since);
reading a byte gives the last token of the longer prefix. A token goes out as soon as every position from which
a later token could still start agrees on it, which takes a lookahead of at most the longest token. States and
transitions are made when first needed and kept, up to a bound.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, in_slices

#: States kept by a transducer; beyond, it starts afresh. Pieces of text whose output is kept: up to twice so many. A worker
#: holds some 350 MB at these bounds.
MAX_STATES, MAX_PIECES = 1 << 18, 1 << 19

_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class _State:
    __slots__ = ("last", "left", "live", "next", "pending")

    def __init__(self, left: bytes | None, pending: bytes, last: tuple[int, ...], live: tuple[int, ...]):
        #: last[i]: length of the last token of what has been read up to pending[:i].
        #: live: where a token that isn't read to its end yet may have begun.
        self.left, self.pending, self.last, self.live, self.next = left, pending, last, live, {}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.packed = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        #: Of each token, the two that its last merge joins; None for a byte. Tokens that never arise by merging aren't here.
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        for t in ranks:
            if len(t) == 1:
                self.parts[t] = None
            elif len(two := self.merged(t, ranks[t])) == 2 and ranks.get(two[0] + two[1]) == ranks[t]:
                self.parts[t] = two[0], two[1]
        self.tokens = self.parts
        #: Whether tokens come after those they are made of, as trained ones do.
        self.in_order = all(p is None or max(ranks[p[0]], ranks[p[1]]) < ranks[t] for t, p in self.parts.items())
        self.starts = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self._fits: dict[int, bool] = {}  #: by both ranks
        self._states: dict[tuple[bytes | None, bytes], _State] = {}
        self.start = _State(None, b"", (0,), (0,))

    def merged(self, data: bytes, limit: int = 1 << 60) -> list[bytes]:
        """The merges themselves, on a few bytes: the lowest rank first, the leftmost of equals; those below the limit."""
        rank, never = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while found:
            low = min(found)
            if low >= limit:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = rank(parts[i] + parts[i + 1], never)
            if i:
                found[i - 1] = rank(parts[i - 1] + parts[i], never)
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a."""
        both = self.ranks[a] << 32 | self.ranks[b]
        known = self._fits.get(both)
        if known is None:
            if len(self._fits) > self.max_states * 4:
                self._fits.clear()
            known = self._fits[both] = self._apart(a, b) if self.in_order else self.merged(a + b) == [a, b]
        return known

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether no merge ever crosses from a to b. The merges that made both are undone, the last first; at each time
        the two tokens that meet there would have been joined if that merge came before the one that took either away (of
        equal ranks the one further to the left comes first)."""
        ranks, parts = self.ranks, self.parts
        gone_a = gone_b = 1 << 60
        while True:
            both = ranks.get(a + b)
            if both is not None and both < gone_a and both <= gone_b:
                return False
            made_a, made_b = parts[a], parts[b]
            if made_a and (not made_b or ranks[a] > ranks[b]):
                gone_a, a = ranks[a], made_a[1]
            elif made_b:
                gone_b, b = ranks[b], made_b[0]
            else:
                return True

    def _step(self, state: _State, byte: int) -> tuple[_State, bytes]:
        """Determinise one transition: the next state and the ids that go out, as little-endian 32-bit integers."""
        left, last, tokens, starts = state.left, state.last, self.tokens, self.starts
        pending = state.pending + bytes((byte,))
        end, live, length = len(pending), (), 0
        for j in state.live:
            tail = pending[j:]
            if not length and tail in tokens:
                before = pending[j - last[j] : j] if j else left
                if before is None or self.fits(before, tail):
                    length = end - j
            if tail in starts:
                live += (j,)
        if not length:
            raise ValueError("the vocabulary lacks a single byte")
        last, out = (*last, length), b""
        live += (end,)
        while live[0]:
            n = self._first(last, live[0])
            if any(self._first(last, j) != n for j in live[1:]):
                break
            left, pending = pending[:n], pending[n:]
            out += self.packed[left]
            last, live = (0, *last[n + 1 :]), tuple(j - n for j in live)
        found = self._states.get((left, pending))
        if found is None:
            found = self._states[left, pending] = _State(left, pending, last, live)
        return found, out

    @staticmethod
    def _first(last: tuple[int, ...], j: int) -> int:
        """Length of the first token on the way from pending[:j] back to its start; 0 at the start itself."""
        while j > last[j] > 0:
            j -= last[j]
        return j

    def encode(self, piece: bytes) -> bytes:
        """The ids of one piece of text, packed."""
        if piece in self.packed:
            return self.packed[piece]
        if len(self._states) > self.max_states:
            for old in (self.start, *self._states.values()):  # states lead to each other: cycles, which are rarely collected
                old.next.clear()
            self._states.clear()
            self.start = _State(None, b"", (0,), (0,))
        state, out = self.start, []
        for byte in piece:
            try:
                state, ids = state.next[byte]
            except KeyError:
                move = state.next[byte] = self._step(state, byte)
                state, ids = move
            if ids:
                out.append(ids)
        rest, j, pending = [], len(state.pending), state.pending
        while j:
            rest.append(self.packed[pending[j - state.last[j] : j]])
            j -= state.last[j]
        return b"".join(out + rest[::-1])


class _Pieces(dict):
    """Output for each piece of text, made by the transducer when first met. When there are too many, those not asked for
    since the last time go."""

    def __init__(self, transducer: MergeTransducer, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.most, self.older = transducer, most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece) or self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = self.copy()
                self.clear()
            self[piece] = out
        return out


class Utf8Stream:
    """Incremental decoding: feed bytes cut anywhere, get the text that is complete.

    The state is the unfinished character at the end: how many bytes it needs and those it has. What cannot become
    UTF-8 gives U+FFFD, as decoding the whole at once would."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end are a character's beginning, without its end."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:  # a lead byte
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                if back >= need:
                    return 0
                if back > 1:  # ranges of the second byte that some lead bytes narrow
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                    if not low <= data[1 - back] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        keep = self._unfinished(data)
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoding and decoding by one rank file and one splitting pattern; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(MergeTransducer(ranks, min(MAX_STATES, max_pieces // 2)), max_pieces)
        self.bytes_of = [b""] * (1 + max(ranks.values(), default=-1))
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text for ids as they come."""
        stream, token = Utf8Stream(), self.bytes_of.__getitem__
        for part in batched(ids, chunk):
            yield stream.feed(b"".join(map(token, part)))
        yield stream.end()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str, max_pieces: int = MAX_PIECES) -> Codec:
    """One for each Python worker."""
    return Codec(read_ranks(ranks_path), pattern, max_pieces)


@contextmanager
def _rarely_collected() -> Iterator[None]:
    """While a codec works. Its tables are long-lived and nearly free of cycles, and looking at them often took a quarter of
    the time."""
    was = gc.get_threshold()
    gc.set_threshold(1_000_000, 50, 100)
    try:
        yield
    finally:
        gc.set_threshold(*was)


def encode(
    documents: DataFrame, ranks_path: str, pattern: str, ids_name: str = "ids", decoded_name: str = "decoded", max_pieces: int = MAX_PIECES
) -> DataFrame:
    """Token ids of every whole text: the columns of documents and ``ids`` (array of int), ``decoded`` (string).

    documents(doc_id, text, ...). A null text counts as empty: no ids, and an empty string; texts of any length are
    encoded whole, and an empty table gives no rows. ``decoded`` is what streaming decoding of the ids gives. Columns of
    these names (in any case) among the given ones are replaced. ``ranks_path`` must be readable on every executor, as an
    installed file is. ``max_pieces`` bounds what workers hold; fewer take less memory and more time, ids are the same.
    """
    kept = [c for c in documents.columns if c.lower() not in (ids_name.lower(), decoded_name.lower())]
    source = documents.select(*kept)
    at = kept.index("text")

    def run(batches):
        with _rarely_collected():
            yield from encoded(codec(ranks_path, pattern, max_pieces), batches)

    def encoded(c: Codec, batches):
        for batch in batches:
            ids = [np.frombuffer(c.encode(t.decode("utf-8", "replace")), "<u4") for t in binaries(batch.column(at))]
            texts = ["".join(c.decode_stream(x.tolist())) for x in ids]
            arrays = [pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*kept, ids_name, decoded_name])

    schema = source.withColumns({ids_name: F.lit(None).cast("array<int>"), decoded_name: F.lit(None).cast("string")}).schema
    return source.mapInArrow(in_slices(run, at), schema)


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of documents, in one pass.

    documents(doc_id, text); further columns are ignored. Null texts are empty: no tokens. Texts of any length are encoded
    whole; rows alike in text have equal figures; an empty table gives no rows."""

    def run(batches):
        with _rarely_collected():
            yield from told(codec(ranks_path, pattern), batches)

    def told(c: Codec, batches):
        for batch in batches:
            n, a, b = [], [], []
            for text in binaries(batch.column(1)):
                ids = c.encode(text.decode("utf-8", "replace"))
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                whole = hashlib.sha256()
                for part in c.decode_stream(np.frombuffer(ids, "<u4").tolist()):
                    whole.update(part.encode())
                b.append(whole.hexdigest())
            arrays = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(b, pa.string())], names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(in_slices(run, 1), _SCHEMA)
