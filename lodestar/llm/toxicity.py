"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, its nearness to words of the second person, capitals, punctuation and
obfuscation. The lexicon (words and beginnings of words, with the share of toxic documents among those that have
them) is learnt from one part of the labelled rows, the trees from a second, the calibration from a third.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import gbt
from lodestar.llm.common import binaries, in_slices, written
from lodestar.llm.scoring import chosen_labels, fold, labelled, scored

#: Labelled rows for the lexicon, the trees and the calibration, at most.
LEXICON_ROWS, TRAIN_ROWS, CALIBRATION_ROWS = 20_000, 20_000, 10_000
#: Entries of the lexicon, at most: those of the strongest evidence.
LEXICON_ENTRIES = 5_000
LEAST = 0.7
FOLDS, HELD_OUT = 3, 1
#: Lengths of the beginnings of words.
STEMS = (3, 4, 5, 6)
#: Words this near to one of the second person count as addressed to somebody.
NEAR = 5

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][@$!|*.\-_0-9]+[^\W\d_]\w*")
_UNMASK = str.maketrans({"@": "a", "$": "s", "!": "i", "|": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "*": "", ".": "", "-": "", "_": ""})
_YOU = frozenset("you your yours u ur yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def stems(word: str) -> list[str]:
    """A word itself, and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def lexicon(documents: DataFrame, labels: DataFrame, entries: int = LEXICON_ENTRIES) -> dict[str, float]:
    """The share of toxic ones among the documents with a stem, for the stems of the strongest evidence.

    labels(doc_id, y): bounded by the caller. Stems are counted in the tasks; only the entries reach the driver."""

    def run(batches):
        for batch in batches:
            toxic, rest = Counter(), Counter()
            for text, y in zip(binaries(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(_text(text).lower()))
                (toxic if y else rest).update({s for w in words for s in stems(w)})
            keys = list(toxic | rest)
            arrays = [pa.array(keys, pa.string())]
            arrays += [pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, rest)]
            yield pa.RecordBatch.from_arrays(arrays, ["stem", "toxic", "rest"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = (
        found.join(F.broadcast(labels), "doc_id")
        .select("text", "y")
        .mapInArrow(in_slices(run, 0), "stem string, toxic long, rest long")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))
        .where("toxic >= 4")
    )
    n = labels.agg(F.sum("y"), F.count("*")).first()
    base = (n[0] or 0) / max(1, n[1])
    #: How far the toxic count lies above what the base rate gives, in standard deviations.
    evidence = (F.col("toxic") - (F.col("toxic") + F.col("rest")) * base) / F.sqrt(
        (F.col("toxic") + F.col("rest")) * (base * (1 - base) + 1e-9)
    )
    rows = counts.withColumn("evidence", evidence).where("evidence >= 5").orderBy(F.desc("evidence"), "stem")
    return {r[0]: (r[1] + base) / (r[1] + r[2] + 1) for r in rows.limit(entries).collect()}


class Extractor:
    """Features of a text by a lexicon."""

    WIDTH = 17

    def __init__(self, shares: dict[str, float]):
        self.shares, self.known = shares, {}

    def share(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = max((self.shares.get(s, 0.0) for s in stems(word)), default=0.0)
        return found

    def __call__(self, data: bytes) -> list[float]:
        text = _text(data)
        words = _WORD.findall(text.lower())
        k, n = max(1, len(words)), max(1, len(text))
        share = np.fromiter(map(self.share, words), np.float64, len(words))
        strong, some, weak = ((share >= x) for x in (0.9, 0.6, 0.3))
        you = np.flatnonzero(np.fromiter(map(_YOU.__contains__, words), bool, len(words)))
        near = 0
        if len(you) and some.any():
            hits = np.flatnonzero(some)
            right = np.searchsorted(you, hits)
            gap = np.minimum(
                np.abs(hits - you[np.maximum(right - 1, 0)]), np.abs(hits - you[np.minimum(right, len(you) - 1)])
            )
            near = int((gap <= NEAR).sum())
        masked = _MASKED.findall(text)
        unmasked = sum(self.share(x.translate(_UNMASK).lower()) >= 0.6 for x in masked)
        top = np.sort(share)[::-1][:3]
        capitals = sum(map(str.isupper, text.split()))
        return [
            np.log1p(len(words)),
            *(float(x.sum()) for x in (strong, some, weak)),
            *(float(x.sum()) / k for x in (strong, some, weak)),
            *(float(top[i]) if len(top) > i else 0.0 for i in range(3)),
            len(set(np.flatnonzero(some) // 50)) / k,
            near / k,
            capitals / k,
            text.count("!") / k,
            sum(map(text.count, "%&$#*")) / n,
            len(masked) / k,
            float(unmasked),
        ]


def toxicity(documents: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """Score the toxicity of every whole text as ``labels.toxic`` (0 or 1) marks it.

    documents(doc_id, text), labels(doc_id, toxic); further columns are ignored. A row for each row of documents:
    doc_id, held_out (crc32 of doc_id as text mod 3 is 1; those labels aren't learnt), score in 0 to 1, predicted (1
    if score >= ``least``). Null texts are scored as empty ones; equal texts score equally. Texts of any length are scored
    whole, one after another. Labels other than 0 and 1 are left out; of several for one doc_id the largest counts, and a
    null doc_id teaches nothing. Without labels every score is 0.5; empty documents give no rows. The labelled rows are
    split in three by a hash of doc_id (see the module) and bounded by LEXICON_ROWS, TRAIN_ROWS and CALIBRATION_ROWS; all
    else covers all. Of gains that are equal, the first feature's lowest cut counts.
    """
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(5))
    learnt = fold(FOLDS) != HELD_OUT
    y = written(chosen_labels(labels, "toxic", learnt & (part < 2), LEXICON_ROWS), "lexicon-labels")
    extract = Extractor(lexicon(documents, y))

    def rows(where, n: int) -> tuple:
        return labelled(documents, extract, Extractor.WIDTH, chosen_labels(labels, "toxic", learnt & where, n), n)

    forest = gbt.fit(*rows(part.isin(2, 3), TRAIN_ROWS), trees=40)
    x, truth = rows(part == 4, CALIBRATION_ROWS)
    step = gbt.isotonic(forest.probability(x) if len(truth) else np.zeros(0), truth)
    return scored(documents, extract, Extractor.WIDTH, lambda x: step(forest.probability(x)), FOLDS, HELD_OUT, least)
