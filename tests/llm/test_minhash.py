import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import minhash
from lodestar.llm.components import components


def bag(text):
    w = text.split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    bags = [bag(t or "") for _, t in rows]
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if both and both >= 0.8 * (sum(a.values()) + sum(bags[j].values()) - both):
                own[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 63), 1 << 63 if doc is None else doc)
    return Counter((doc, None if least[find(i)] == 1 << 63 else least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = Counter({int(x): int(w) for x, w in zip(rng.integers(0, 1 << 62, 60), rng.integers(1, 40, 60), strict=True)})
    b = Counter({x: max(1, w + int(rng.integers(-6, 7))) for x, w in list(a.items())[:50]})
    true = sum((a & b).values()) / sum((a | b).values())
    bags = [tuple(np.array(z) for z in zip(*sorted(c.items()), strict=True)) for c in (a, b)]
    bags = [(x.astype(np.uint64), w) for x, w in bags]
    names = minhash.signatures(bags, 4000)
    assert abs((names[0] == names[1]).mean() - true) < 0.03
    assert not minhash.signatures([(np.zeros(0, np.uint64), np.zeros(0, np.int64))]).any()
    assert minhash.signatures([]).shape == (0, minhash.REGISTERS)
    assert minhash.similarity_at_least(*bags, true) and not minhash.similarity_at_least(*bags, true + 0.01)


def some_bag(rng, n, most):
    ids = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    return ids, rng.integers(1, most + 1, len(ids))


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    bags = [some_bag(rng, int(n), int(w)) for n, w in zip(rng.integers(1, 600, 150), rng.choice([1, 2, 3, 50, 5000], 150), strict=True)]
    together = minhash.signatures(bags)
    assert together.all()
    order = rng.permutation(150)
    assert (minhash.signatures([bags[i] for i in order]) == together[order]).all()
    for i in range(0, 150, 7):
        assert (minhash.signatures([bags[i]])[0] == together[i]).all()


def test_points_of_a_hierarchy_are_evenly_spread():
    one = np.array([77], np.uint64)
    rows = minhash.signatures([(one, np.array([w])) for w in (1, 3, 6, 1000, 1024, 1300)], 6000)
    for i, j, true in ((0, 1, 1 / 3), (1, 2, 1 / 2), (3, 4, 1000 / 1024), (3, 5, 1000 / 1300), (2, 5, 6 / 1300)):
        assert abs((rows[i] == rows[j]).mean() - true) < 0.03


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_links_of_short_texts_among_longer_ones(spark, documents, partitions):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(200):  # similarity 6 / 7
        w = [word() for _ in range(10)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, word()]))]
    rows += [(1000 + i, " ".join(word() for _ in range(r.randint(100, 300)))) for i in range(600)]
    r.shuffle(rows)
    found = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(documents(rows).repartition(partitions)).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(200)) >= 199 and len(set(found.values())) >= 800


@pytest.mark.parametrize("chunk", [512, 3])  # 3: every star and field is cut into many
def test_against_brute_force(documents, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    r = random.Random(5)
    base = [[r.choice("abcdefghij") * r.randint(1, 5) for _ in range(r.choice([6, 40, 150]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "  "), (203, ""), (204, "hi"), (205, "hi"), (None, "hi"), (206, "hi there"), (None, "solo words")]
    rows += [(207, "w " * 5000), (208, "w " * 4900), (209, "w " * 100), (210, "w " * 5000)]
    found = minhash.near_duplicates(documents(rows)).collect()
    assert Counter((x["doc_id"], x["class_id"]) for x in found) == brute(rows)
    assert all(x["is_kept"] == (x["doc_id"] == x["class_id"]) for x in found)


def test_one_of_each(documents):
    df = documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q"), (4, None), (5, "")])
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (102, 100), (7, 7)]
    out = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert out == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}
