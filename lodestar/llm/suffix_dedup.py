"""Suffix-array deduplication: repeats of 200 and more bytes, anywhere.

Anchors bring together the places where a repeat may be (see ``repeats``). The contexts of an anchor are first cut down
to what they share with another to both sides of it; what is left, each different piece once, goes into one suffix
array, made by linear grouping. Suffixes that begin with one 200-byte string are neighbours there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, fresh, in_slices, row_keys, sha_hex
from lodestar.llm.gsaca import suffix_array
from lodestar.llm.repeats import NO_ID, ROW, Kind, common_start, keyed, kept, repeats, spans_of

BYTES = 200
SEED = 64


def _shared(parts: list[bytes]) -> list[int]:
    """How many bytes each string begins with like some other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for a, b in zip(order, order[1:], strict=False):
        n = common_start(parts[a], parts[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


@dataclass
class _Piece:
    """A string that a suffix array is made of: ``lead`` bytes, the anchor, and what follows; it is there ``number`` times.
    ``within``: parts of it (begin and end, as seen from the anchor) that are there more often, and how many times more."""

    lead: int
    data: bytes
    number: int
    within: list[tuple[int, int, int]]

    def holds(self, lead: int, data: bytes) -> bool:
        """Whether it has another piece at the same place of the anchor."""
        at = self.lead - lead
        return at >= 0 and self.data[at : at + len(data)] == data

    def times(self, begin: int) -> int:
        """How often the 200-byte string is there that begins at this place, as seen from the anchor."""
        return self.number + sum(n for a, b, n in self.within if a <= begin and begin + BYTES <= b)


def _repeated_in(pieces: list[_Piece]) -> list[list[int]]:
    """Starts, as seen from the anchor, of the 200-byte strings of each piece that are there twice.

    Strings only count as two if they lie alike to their anchors: pieces of one document may overlap, and hold one string
    at one place of the document."""
    symbols: list[int] = []
    starts = []
    for piece in pieces:
        starts.append(len(symbols))
        symbols += piece.data
        symbols.append(-1)  # ends a piece
    found: list[list[int]] = [[] for _ in pieces]
    run: list[tuple[int, int]] = []
    string = None

    def close() -> None:
        alike: dict[int, int] = {}
        for k, begin in run:
            alike[begin] = alike.get(begin, 0) + pieces[k].times(begin)
        for k, begin in run:
            if alike[begin] > 1:
                found[k].append(begin)

    whole = bytearray(len(symbols))  # where a string of the full length begins
    for start, piece in zip(starts, pieces, strict=True):
        n = max(0, len(piece.data) - BYTES + 1)
        whole[start : start + n] = b"\1" * n
    for p in suffix_array(symbols):
        if not whole[p]:
            continue
        k = bisect_right(starts, p) - 1
        piece = pieces[k]
        at = p - starts[k]
        here = piece.data[at : at + BYTES]
        if here != string:
            close()
            run, string = [], here
        run.append((k, at - piece.lead))
    close()
    return found


def settle(contexts: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """Flag the 200-byte strings of each context that another context of the anchor has too.

    Contexts differ in how far they happen to agree with some other. Of the pieces that gives, those that lie within a
    larger one are repeats, and are counted there; the suffix array is made of the others."""
    after = _shared([data[lead:] for _, _, lead, data in contexts])
    before = _shared([data[:lead][::-1] for _, _, lead, data in contexts])
    wanted = [
        (b, data[lead - b : lead + a]) if a + b >= BYTES else None
        for (_, _, lead, data), a, b in zip(contexts, after, before, strict=True)
    ]
    numbers = Counter(w for w in wanted if w)
    pieces: list[_Piece] = []
    found: dict[tuple[int, bytes], list[int]] = {}
    for (lead, data), number in sorted(numbers.items(), key=lambda x: (-len(x[0][1]), x[0])):
        larger = next((p for p in pieces if p.holds(lead, data)), None)
        if larger:
            larger.within.append((-lead, len(data) - lead, number))
            found[lead, data] = list(range(-lead, len(data) - lead - BYTES + 1))
        else:
            pieces.append(_Piece(lead, data, number, []))
    for piece, begins in zip(pieces, _repeated_in(pieces), strict=True):
        found[piece.lead, piece.data] = sorted(begins)
    out = []
    for (_, _, lead, _), w in zip(contexts, wanted, strict=True):
        spans: list[tuple[int, int]] = []
        for begin in found.get(w, ()):
            start = lead + begin
            if spans and spans[-1][1] >= start:
                spans[-1] = spans[-1][0], start + BYTES
            else:
                spans.append((start, start + BYTES))
        out.append(spans)
    return out


KIND = Kind(
    BYTES, SEED, lambda text: np.frombuffer(text, np.uint8), lambda units, a, b: units[a:b].tobytes(), False, settle
)


def suffix_dedup(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove every byte that lies in a 200-byte string which also starts anywhere else, the same document included.

    documents(doc_id, text); further columns are ignored. A row for each row given: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 (of the remaining bytes), and with ``with_text`` what remains as ``text``, without
    the bytes of characters that a removed run cuts through. Strings are judged on the input; overlaps count. Null and
    empty texts have no bytes; texts of any length are treated whole. Rows alike in doc_id and text are repeats of each
    other, and a null doc_id is no key: rows are told apart by 128 bits of doc_id and text. An empty table gives no rows.

    Places whose contexts are equal, by hash of anchor and context (128 bits together), are removed without comparing
    bytes; the suffix arrays decide between contexts of an anchor that differ.
    """

    def run(batches):
        for batch in batches:
            n, removed, runs, digest, texts = [], [], [], [], []
            for text, (begin, finish) in zip(binaries(batch.column(1)), spans_of(batch.column(2)), strict=True):
                keep = kept(len(text), begin, finish)
                rest = np.frombuffer(text, np.uint8)[keep].tobytes() if len(begin) else text
                n.append(len(text))
                removed.append(len(text) - len(rest))
                runs.append(int((np.diff(np.concatenate([[1], keep.astype(np.int8)])) == -1).sum()))
                digest.append(sha_hex(rest))
                texts.append(rest.decode("utf-8", "ignore") if with_text else None)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    joined = keyed(documents, "doc_id").join(repeats(documents, KIND), [*ROW], "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(in_slices(run, 1), schema)


def without_repeats(documents: DataFrame) -> DataFrame:
    """The rows of documents with what remains of their texts, other columns as they came, whatever their names; ``n_chars``,
    if there is such a column, is counted anew. A row stays, with an empty text, if nothing remains. Null texts stay null;
    the rest is as for ``suffix_dedup``."""
    others = [c for c in documents.columns if c != "text"]
    k1, k2, spans_ = (fresh(documents, name) for name in ("repeat_k1", "repeat_k2", "repeat_spans"))
    found = repeats(documents, KIND).toDF(k1, k2, spans_)
    text, doc = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    own = row_keys(doc, F.coalesce(text, F.lit("")))
    marked = documents.join(found, (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left").select(text.alias("text"), *others, spans_)
    at = len(others) + 1

    def run(batches):
        for batch in batches:
            texts = []
            for text, (begin, finish) in zip(batch.column(0).cast(pa.binary()).to_pylist(), spans_of(batch.column(at)), strict=True):
                if text is not None and len(begin):
                    text = np.frombuffer(text, np.uint8)[kept(len(text), begin, finish)].tobytes()
                texts.append(None if text is None else text.decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()), *batch.columns[1:at]]
            yield pa.RecordBatch.from_arrays(columns, ["text", *others])

    out = marked.mapInArrow(in_slices(run, 0), documents.select(F.col("text").cast("string").alias("text"), *others).schema)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
