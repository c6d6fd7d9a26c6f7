"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from lodestar.llm import gbt
from lodestar.llm.scoring import chosen_labels, fold, labelled, passing, scored

#: Labelled rows that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
#: Documents below this score are rejected.
LEAST = 0.3
FOLDS, HELD_OUT = 5, 0

_KINDS = np.full(256, 5)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n")):
    _KINDS[list(_bytes)] = _k
_KINDS[128:] = 4
_SIGNS = [ord(c) for c in "!%&$#*|.,?"]


def statistics(text: bytes) -> list[float]:
    """Figures of a whole text; an empty one has a row too."""
    n = max(1, len(text))
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, of, 6) / n
    words = text.split()
    k = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    spread = of[of > 0] / n
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / k,
        *kinds,
        *(of[_SIGNS] / k),
        distinct / k,
        distinct / np.sqrt(k),
        sum(map(eq, words, words[1:])) / k,
        len(set(zip(words, words[1:], strict=False))) / k,
        np.log1p(len(lines)),
        len(words) / m,
        len(set(lines)) / m,
        max(map(len, words), default=0),
        len(zlib.compress(text, 1)) / (n + 20),
        float(-(spread * np.log2(spread)).sum()),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
    ]


WIDTH = len(statistics(b""))


def classifier(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Trees fitted on at most ``train_rows`` labelled rows outside the held-out fold. Of gains that are equal, the first
    feature's lowest cut counts."""
    chosen = chosen_labels(labels, "quality", fold(FOLDS) != HELD_OUT, train_rows)
    return gbt.fit(*labelled(documents, statistics, WIDTH, chosen, train_rows))


def quality(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least: float = LEAST) -> DataFrame:
    """Score the quality of every whole text as ``labels.quality`` (0 or 1) marks it.

    documents(doc_id, text), labels(doc_id, quality); further columns are ignored. A row for each row of documents:
    doc_id, held_out (crc32 of doc_id as text mod 5 is 0; those labels aren't learnt), score in 0 to 1, predicted
    (1 if score >= ``least``). Null texts are scored as empty ones; equal texts score equally. Texts of any length are
    scored whole, one after another. Labels other than 0 and 1 are left out; of several for one doc_id the largest counts,
    and a label without a document, or a null doc_id, teaches nothing. Without labels every score is 0.5, with one class
    only near that class. Empty documents give no rows. The trees are fitted on at most ``train_rows`` labelled rows; all
    else covers all rows.
    """
    forest = classifier(documents, labels, train_rows)
    return scored(documents, statistics, WIDTH, forest.probability, FOLDS, HELD_OUT, least)


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, columns as they came. Each row is judged by its own text,
    whatever other rows have its doc_id."""
    return passing(documents, statistics, WIDTH, classifier(documents, labels).probability, LEAST)
