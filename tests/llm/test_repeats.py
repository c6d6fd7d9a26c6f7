"""Substring and suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, repeats, substring_dedup, suffix_dedup
from lodestar.llm.gsaca import suffix_array


def brute_words(rows):
    words = [(1 << 63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), 1 << 64), i)
    out = []
    for (i, w), (own, _) in zip(words, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if times[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def check(documents, rows):
    df = documents(rows)
    mine = got(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert mine == brute_words(rows)
    mine = got(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert mine == brute_bytes(rows)


def passages(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    shared = [" ".join(word() for _ in range(r.choice([45, 60, 120]))) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(shared) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 80))))
            if r.random() < 0.3:  # an edit within a passage
                w = parts[-1].split()
                w[r.randrange(len(w))] = word()
                parts[-1] = " ".join(w)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(documents, seed):
    check(documents, passages(seed, 25))


def test_odd_texts(documents):
    long = " ".join(str(i * i) for i in range(6000))
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "one two"), (None, "w " * 70), (5, "w " * 60), (6, "a" * 700), (7, "a" * 199),
        (8, "ab cd ef " * 50), (8, "ab cd ef " * 50), (9, "ab cd ef " * 90 + "end"), (10, long), (11, "x " + long[1000:9000] + " y"),
        (12, "é" * 150), (13, "xé" + "é" * 120), (14, "\x00" * 450), (-3, "ab cd ef " * 40),
    ]
    check(documents, rows)


def test_empty_table(documents):
    check(documents, [])


def test_hot_anchors_are_dealt_further(documents):
    rows = passages(7, 30)
    df = documents(rows)
    for kind in (substring_dedup.KIND, suffix_dedup.KIND):
        covered = []
        for hot in (0, 10_000):
            found = repeats.repeats(df, kind, hot).collect()
            spans = {(r["k1"], r["k2"], i) for r in found for s in r["spans"] for i in range(s["begin"], s["finish"])}
            covered.append(spans)
        assert covered[0] == covered[1] != set()


def test_rows_without_ids_whose_texts_collide_in_32_bits(spark, documents):
    numbers = spark.range(200_000).selectExpr("id", "concat(id, repeat(concat(' ', id % 89), 99)) AS text")
    pair = numbers.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").first()
    one, two = pair["texts"][:2]
    check(documents, [(None, one), (None, two), (None, "x " + one[:400]), (None, "other")])


def test_hot_texts_and_long_ones(documents):
    rows = passages(9, 6)
    text = " ".join(str(i % 977) for i in range(30_000))
    check(documents, rows + [(100 + i, rows[3][1] or "w") for i in range(40)] + [(200, text), (201, text[: len(text) // 2])])


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(["x"] * 2400 + [None] * 98 + ["y" * (3 << 20)] * 2)], ["a", "b"])
    sizes = [x.num_rows for x in common.slices(batch, 1)]
    assert sizes == [1000, 1000, 498, 1, 1] and list(common.slices(batch.slice(0, 0), 1)) == []
    sliced = [x.column(0)[0].as_py() for x in common.slices(batch.slice(7), 1)]
    assert sliced == [7, 1007, 2007, 2498, 2499]


def test_remaining_text(spark, documents):
    a = " ".join(str(i) for i in range(100, 400))
    df = documents([(1, a + " one"), (2, "two " + a), (3, "three"), (4, None)]).selectExpr("*", "length(text) AS n_chars")
    out = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    assert out[1]["text"] == " one" and out[1]["n_chars"] == 4
    assert out[2]["text"] == "two " and out[3]["text"] == "three" and out[4]["text"] is None
    assert suffix_dedup.without_repeats(df).columns == df.columns
    words = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(df, with_text=True).collect()}
    assert words[1] == a + " one" and words[2] == "two" and words[4] == ""


def test_suffix_array():
    r = random.Random(0)
    for t in range(1500):
        s = [r.randint(0, r.choice([1, 2, 25])) for _ in range(r.randint(0, 40))]
        s = s * 3 if t % 5 == 0 else s
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
