"""The pipeline against the same decisions made one after another in plain Python."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from test_minhash import brute as classes
from test_text import brute as hits
from test_text import reference

from lodestar.llm import quality

SF = "/root/testdata/sf0.001"


def without_repeats(rows):
    """(doc_id, text) with the bytes of all 200-byte strings gone that are there twice."""
    data = [None if t is None else t.encode() for _, t in rows]
    times = Counter(t[k : k + 200] for t in data if t for k in range(len(t) - 199))
    out = []
    for (i, _), t in zip(rows, data, strict=True):
        if t is not None:
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - 199):
                if times[t[k : k + 200]] > 1:
                    gone[k : k + 200] = True
            t = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((i, t))
    return out


def one_of_each(rows):
    """Of each class the rows of the least doc_id, and of rows alike one if they have words."""
    left = classes(rows)
    out, seen = [], set()
    for i, t in rows:
        if (i, i) in left and not ((i, t) in seen and (t or "").split()):
            of = [c for (d, c), n in left.items() if d == i]
            if i in of:
                out.append((i, t))
                seen.add((i, t))
    return out


def plain(spark, docs, labels, bench):
    """What is left: a Counter of (doc_id, text)."""
    scores = quality.quality(docs.select("doc_id", "text").distinct(), labels).collect()
    good = Counter((r["doc_id"], r["score"]) for r in scores if r["predicted"])
    kept = {(r["doc_id"], r["text"]) for r in quality.good_documents(docs, labels).collect()}
    assert Counter(i for i, _ in kept) == Counter(i for (i, _), n in good.items() for _ in range(n))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if (r["doc_id"], r["text"]) in kept]
    rows = without_repeats(one_of_each(rows))
    clean = [not any(h[5] for h in hits([row], bench)) for row in rows]
    return Counter(r for r, c in zip(rows, clean, strict=True) if c)


def check(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [c for c in docs.columns if c not in ("ids", "n_tokens")] + ["ids", "n_tokens"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == plain(spark, docs, labels, bench)
    other = reference()
    for r in got:
        assert list(r["ids"]) == other.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    return got


def test_stages_follow_each_other(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["keep_good", "drop_near_duplicates", "remove_repeats", "decontaminate_docs", "tokenize"]
    assert len(check(spark, SF)) > 100


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, tested = text(60), text(20)
    rows = [(i, text(40)) for i in range(30)] + [(None, text(50)), (None, "x " + shared + " a"), (None, None), (40, None), (41, "")]
    rows += [(50 + i, text(30) + " " + shared + " " + text(30)) for i in range(3)] + [(60, "y " + tested + " z"), (None, tested)]
    rows += [(70, "same words again and again here"), (70, "same words again and again here"), (71, "same words again and again here")]
    columns = "doc_id long, text string, n_chars int, ids string, n_tokens int, decoded string, k1 string, k2 string, h int, uid long"
    wide = [(i, t, None if t is None else len(t), "i", 3, "d", "k", "k", 1, 2) for i, t in rows]
    spark.createDataFrame(wide, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", tested), ("c", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = check(spark, str(tmp_path))
    assert any(x["doc_id"] is None for x in got) and all(x["decoded"] == "d" and x["uid"] == 2 for x in got)
    assert not any(tested in (x["text"] or "") for x in got)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
