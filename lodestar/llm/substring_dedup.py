"""Substring deduplication by seed and extend: repeats of 50 and more words.

Documents meet on winnowed anchors of words (the seeds). From its anchor, each context is extended word by word to both
sides, along a tree of the words that contexts of that anchor go on with; a window is then a node to the left and a
node to the right, and the smallest document that has come through both is where the window was first. Windows that
were in a smaller document join into maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Powers, binaries, in_slices, sha_hex
from lodestar.llm.repeats import NO_ID, ROW, Kind, keyed, kept, repeats, spans_of

WORDS = 50
SEED = 25

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = Powers(0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of anything but space and the controls 9 to 13."""
    data = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
    return _BASE.spans(_BASE.prefix(data), edge[::2], edge[1::2])


def extend(contexts: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """Flag the windows of each context that a context of a smaller document has too."""
    right: dict[tuple[int, int], int] = {}
    left: dict[tuple[int, int], int] = {}
    first: dict[tuple[int, int], int] = {}
    seen = []
    for _, doc, lead, data in contexts:
        words = np.frombuffer(data, np.uint64).tolist()
        node, after = 0, [0]
        for word in words[lead:]:
            node = right.setdefault((node, word), len(right) + 1)
            after.append(node)
        node, before = 0, [0]
        for word in reversed(words[:lead]):
            node = left.setdefault((node, word), len(left) + 1)
            before.append(node)
        windows = [
            (lead - k, (before[k], after[WORDS - k]))
            for k in range(max(0, WORDS - len(after) + 1), min(lead, WORDS - SEED) + 1)
        ]
        for _, at in windows:
            if first.get(at, NO_ID + 1) > doc:
                first[at] = doc
        seen.append((doc, windows))
    out = []
    for doc, windows in seen:
        spans: list[tuple[int, int]] = []
        for start, at in sorted(windows):
            if first[at] < doc:
                if spans and spans[-1][1] >= start:
                    spans[-1] = spans[-1][0], start + WORDS
                else:
                    spans.append((start, start + WORDS))
        out.append(spans)
    return out


KIND = Kind(WORDS, SEED, word_hashes, lambda units, a, b: units[a:b].tobytes(), True, extend)


def _marked(documents: DataFrame, run, schema: str) -> DataFrame:
    found = repeats(documents, KIND)
    joined = keyed(documents, "doc_id").join(found, [*ROW], "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(in_slices(run, 1), schema)


def substring_dedup(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove the words of every 50-word window whose words also start in a document with a smaller doc_id.

    documents(doc_id, text); further columns are ignored. A row for each row given: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), and with ``with_text`` those kept words as ``text``. Windows are
    judged on the input. Null and empty texts have no words; texts of any length are treated whole. A null doc_id is
    larger than all others, and rows with one doc_id, or alike in all, are not smaller than each other. An empty table
    gives no rows. Words are compared by 64-bit hashes, equal contexts of an anchor by 128 bits.
    """

    def run(batches):
        for batch in batches:
            n, removed, digest, texts = [], [], [], []
            for text, (begin, finish) in zip(binaries(batch.column(1)), spans_of(batch.column(2)), strict=True):
                words = text.split()
                if len(begin):
                    rest = b" ".join([words[i] for i in np.flatnonzero(kept(len(words), begin, finish))])
                    removed.append(len(words) - len(rest.split()))
                else:
                    rest = b" ".join(words)
                    removed.append(0)
                n.append(len(words))
                digest.append(sha_hex(rest))
                texts.append(rest.decode("utf-8", "replace") if with_text else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return _marked(documents, run, schema)
