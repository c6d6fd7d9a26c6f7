"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

The symbols of the search are words: an alphabet this large makes block shifts long. For test strings of
m words and blocks of b words, a text word block that no test string holds lets the search skip
m - b + 1 words at once; a block that ends some test string leads to the bucket of those with that suffix,
and the words themselves are compared there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import binaries, fresh, in_slices, lists, row_keys, sha_hex, written

WINDOW = 10
BLOCK = 3
#: Bytes of benchmark text in one search machine, which takes some 150 times as much memory in a task. More text makes more
#: machines, each with its own pass over the documents.
MACHINE_BYTES = 2 << 20

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, a-z and anything beyond ASCII."""
    return text.translate(_FOLD).split()


class WuManber:
    """Search for test strings (word lists) of at least ``m`` words each; see the module for the idea."""

    def __init__(self, strings: list[list[bytes]], block: int = BLOCK):
        self.strings = strings
        self.m = m = min(map(len, strings))
        self.block = b = min(block, m)
        self.longest_shift = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, s in enumerate(strings):
            for end in range(b, m + 1):
                at = tuple(s[end - b : end])
                self.shift[at] = min(self.shift.get(at, self.longest_shift), m - end)
            self.buckets[tuple(s[m - b : m])][tuple(s[:b])].append(k)
        self.buckets = {suffix: dict(by_prefix) for suffix, by_prefix in self.buckets.items()}

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, test string) of every occurrence."""
        m, b, far, shift, strings = self.m, self.block, self.longest_shift, self.shift.get, self.strings
        end, n = m, len(text)
        while end <= n:
            suffix = tuple(text[end - b : end])
            step = shift(suffix, far)
            if step:
                end += step
                continue
            start = end - m
            for k in self.buckets[suffix].get(tuple(text[start : start + b]), ()):
                s = strings[k]
                if text[start : start + len(s)] == s:
                    yield start, k
            end += 1


class Machines:
    """The windows of a set of items, in one machine for each window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        owners: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            w = words(text)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                owners[tuple(w[i : i + size])].add(item)
        by_length: dict[int, list[tuple]] = defaultdict(list)
        for s in owners:
            by_length[len(s)].append(s)
        self.parts = [
            (WuManber([list(s) for s in strings]), [owners[s] for s in strings])
            for _, strings in sorted(by_length.items())
        ]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words that occurrences cover, and the items that have them."""
        spans, items = [], set()
        for machine, owners in self.parts:
            for start, k in machine.find(text):
                spans.append((start, start + len(machine.strings[k])))
                items |= owners[k]
        return spans, items


def _blocks(benchmark: DataFrame, machine_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``machine_bytes`` (an item isn't split), each fetched when it is asked for, so the driver
    holds one block at a time. The number of blocks comes from the measured size."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"), F.encode("text", "utf-8").alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + size // machine_bytes
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    for k in range(n):
        yield [(r[0], bytes(r[1])) for r in items.where(part == k).collect()]


_built: dict[tuple, Machines] = {}


def _machines(block, window: int) -> Machines:
    """Built once in each Python worker; only the last is kept."""
    key = (block.id if hasattr(block, "id") else id(block), getattr(block, "_path", None), window)
    if key not in _built:
        _built.clear()
        _built[key] = Machines(block.value, window)
    return _built[key]


def _figures(rows: list[tuple[int, np.ndarray, set[str]]]) -> list[pa.Array]:
    """What is told of documents: number of words, which of them are hit, items."""
    n = [r[0] for r in rows]
    hit = [int(r[1].sum()) for r in rows]
    digest = [sha_hex(",".join(sorted(r[2])).encode()) for r in rows]
    numbers = [pa.array(x, pa.int64()) for x in (n, hit, [len(r[2]) for r in rows])]
    return [*numbers, pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())]


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _hits(documents: DataFrame, block, window: int) -> DataFrame:
    """k1, k2, begins, ends, items of the documents in which a block's windows occur."""

    def run(batches):
        machine = _machines(block, window)
        for batch in batches:
            k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
            rows = []
            for a, b, text in zip(k1, k2, binaries(batch.column(2)), strict=True):
                spans, items = machine.search(words(text))
                if spans:
                    rows.append((a, b, [x[0] for x in spans], [x[1] for x in spans], sorted(items)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "begins", "ends", "items"])

    schema = "k1 long, k2 long, begins array<int>, ends array<int>, items array<string>"
    return documents.select("k1", "k2", "text").mapInArrow(in_slices(run, 2), schema)


def _keyed(documents: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(*row_keys(F.lit(0), text), text.alias("text"), *more)


def _all_hits(documents: DataFrame, blocks: Iterator, window: int) -> DataFrame:
    """The hits of all blocks, a pass over the documents for each, by text (equal texts are alike)."""
    docs, found = _keyed(documents), None
    for block in blocks:
        sent = documents.sparkSession.sparkContext.broadcast(block)
        part = written(_hits(docs, sent, window).dropDuplicates(["k1", "k2"]), "hits")
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    flat = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")}
    return found.groupBy("k1", "k2").agg(flat["begins"], flat["ends"], F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, machine_bytes: int = MACHINE_BYTES
) -> DataFrame:
    """Mark the words of documents that lie in a window of ``window`` benchmark words (shorter items: whole).

    documents(doc_id, text), benchmark(item_id, text); further columns are ignored, whatever their names.
    One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    Null or wordless texts have no words and are clean; texts of any length are searched whole, and equal ones have equal
    figures. Items whose id or text is null, or without words, have no windows; rows with one item_id count as one
    item. An empty benchmark leaves every document clean; empty documents give no rows.
    A benchmark of up to ``machine_bytes`` is sent to the tasks as one machine, and documents are read once and not shuffled.
    A larger one goes in blocks, a machine and a pass over the documents for each; what they hit is put together by
    text. Neither the driver nor a task holds more than one block.
    """
    blocks = _blocks(benchmark, machine_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        return _in_passes(documents, _all_hits(documents, _chain(first, second, blocks), window))
    block = documents.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        machine = _machines(block, window)
        for batch in batches:
            rows = []
            for text in binaries(batch.column(1)):
                w = words(text)
                hit = np.zeros(len(w), bool)
                spans, items = machine.search(w)
                for start, end in spans:
                    hit[start:end] = True
                rows.append((len(w), hit, items))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_figures(rows)], _NAMES)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(in_slices(run, 1), _SCHEMA)


def _chain(first, second, rest) -> Iterator:
    yield first
    del first
    yield second
    del second
    yield from rest


def _in_passes(documents: DataFrame, found: DataFrame) -> DataFrame:
    joined = _keyed(documents, F.col("doc_id").cast("long").alias("doc_id")).join(found, ["k1", "k2"], "left")

    def run(batches):
        for batch in batches:
            rows = []
            spans = [lists(batch.column(i)) for i in (2, 3, 4)]
            begins, ends, items = (x[1].to_numpy(zero_copy_only=False) for x in spans)
            at = spans[0][0]
            of_item = spans[2][0]
            for k, text in enumerate(binaries(batch.column(1))):
                w = words(text)
                change = np.zeros(len(w) + 1, np.int32)
                np.add.at(change, begins[at[k] : at[k + 1]], 1)
                np.add.at(change, ends[at[k] : at[k + 1]], -1)
                hit = np.cumsum(change[:-1]) > 0
                rows.append((len(w), hit, set(items[of_item[k] : of_item[k + 1]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_figures(rows)], _NAMES)

    return joined.select("doc_id", "text", "begins", "ends", "items").mapInArrow(in_slices(run, 1), _SCHEMA)


def clean_documents(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, machine_bytes: int = MACHINE_BYTES
) -> DataFrame:
    """The rows of documents without any benchmark window, columns as they came. Each row is judged by its own text. One
    pass without a shuffle, if the benchmark fits one machine."""
    blocks = _blocks(benchmark, machine_bytes)
    first, second = next(blocks), next(blocks, None)
    text = F.col("text").cast("string")
    if second is not None:
        k1, k2 = (fresh(documents, name) for name in ("hit_k1", "hit_k2"))
        hit = _all_hits(documents, _chain(first, second, blocks), window).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
        own = row_keys(F.lit(0), F.coalesce(text, F.lit("")))
        return documents.join(hit, (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left_anti")
    block, at = documents.sparkSession.sparkContext.broadcast(first), len(documents.columns)

    def run(batches):
        machine = _machines(block, window)
        for batch in batches:
            clean = [not machine.search(words(t))[0] for t in binaries(batch.column(at))]
            yield pa.RecordBatch.from_arrays(batch.columns[:at], batch.schema.names[:at]).filter(pa.array(clean, pa.bool_()))

    return documents.select("*", text.alias(fresh(documents, "searched_text"))).mapInArrow(in_slices(run, at), documents.schema)
