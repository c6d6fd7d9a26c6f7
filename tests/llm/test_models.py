"""Classifiers, URL rules, media."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import gbt, media, quality, toxicity, url_filter

SF = "/root/testdata/sf0.1"


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = gbt.fit(x[:3000], y[:3000], trees=30)
    assert auc(y[3000:], forest.raw(x[3000:])) > 0.98

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
        return forest.value[node]

    slow = [forest.base + sum(walk(r, t) for t in forest.roots) for r in x[:20]]
    assert np.allclose(slow, forest.raw(x[:20]))
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert gbt.fit(np.ones((9, 3)), np.ones(9)).probability(np.ones((1, 3)))[0] > 0.9


def test_splits_against_all_cuts():
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = np.round(rng.standard_normal((300, 4)), 1).astype(np.float32)
        y = (x[:, 2] + 0.5 * rng.standard_normal(300) > 0.2).astype(float)
        forest = gbt.fit(x, y, trees=1, depth=1, rate=1.0, bins=64, least=20, ridge=1.0)
        p = (y.sum() + 0.5) / 301
        slope, curve = p - y, np.full(300, p * (1 - p))
        best = (-1.0, None, None, None)
        for f in range(4):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))
            for cut in cuts:
                low = x[:, f] <= cut
                if low.sum() >= 20 and (~low).sum() >= 20:
                    gain = sum(slope[m].sum() ** 2 / (curve[m].sum() + 1) for m in (low, ~low))
                    if gain > best[0] + 1e-9:
                        best = gain, f, cut, [-slope[m].sum() / (curve[m].sum() + 1) for m in (low, ~low)]
        root = forest.roots[0]
        assert forest.feature[root] == best[1] and forest.threshold[root] == pytest.approx(best[2])
        assert forest.value[forest.left[root] : forest.left[root] + 2] == pytest.approx(best[3])


def test_isotonic_against_the_formula():
    rng = np.random.default_rng(4)
    score = np.sort(rng.random(60))
    y = (rng.random(60) < score).astype(float)
    step = gbt.isotonic(score, y, tilt=0)
    want = [max(min(y[j : k + 1].mean() for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    assert step(score) == pytest.approx(want)


def test_isotonic():
    step = gbt.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1.0]), tilt=0)
    assert step(np.array([0.1, 0.2, 0.3, 0.4, 0.9])).tolist() == [0, 0.5, 0.5, 1, 1]
    assert gbt.isotonic(np.zeros(0), np.zeros(0))(np.array([0.4])).tolist() == [0.4]


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out(spark, name):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = (quality.quality if name == "quality" else toxicity.toxicity)(docs, labels)
    got = out.join(labels.select("doc_id", name), "doc_id").toPandas()
    folds, at = (5, 0) if name == "quality" else (3, 1)
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds == at)
    assert (held == got.held_out).all() and got.score.between(0, 1).all()
    part = got[got.held_out]
    y = part[name].to_numpy()
    assert auc(y, part.score.to_numpy()) > (0.97 if name == "quality" else 0.9)
    assert (part.predicted == y).mean() > 0.95


def test_classifiers_on_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (None, "x y"), (2, "\x00\ud7ff 😀"), (3, "word " * 20000)]
    labels = spark.createDataFrame([(1, 1, None, 2), (1, 0, 1, 2), (9, None, 7, 2)], "doc_id long, quality int, toxic int, score int")
    for run in (quality.quality, toxicity.toxicity):
        for given in (labels, labels.limit(0)):
            out = run(documents(rows), given).collect()
            assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
            assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
        assert run(documents([]), labels).collect() == []
    kept = quality.good_documents(documents(rows), labels.limit(0))
    assert kept.count() == 5 and kept.columns == documents(rows).columns


URLS = [
    ("http://WWW.Example.com/en/7?x=/q", "www.example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://a.b.com/en/x", "a.b.com", "/en/x", "com/en/", "block"),
    ("//com/en/", "", "", None, "allow"),
    ("x://com/EN/", "com", "/EN/", None, "allow"),
    ("ftp://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("http://net#/de/", "net", "", None, "allow"),
    ("http://example.net/de/8/9#z", "example.net", "/de/8/9", "example.net/de/8", "block"),
    ("http://example.net/de/7", "example.net", "/de/7", "net/de/", "allow"),
    ("http://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b.org/es/://c", "b.org", "/es/://c", "org/es/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "q") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, labels).collect()}
    assert out == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0), labels).collect() == []


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'cheap-bets' if i % 3 == 0 else 'news'}.site{i % 7}.info/p/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    bad = url_filter.label_pages(pages, labels)
    assert bad.count() == 150
    rules = url_filter.mine(bad)
    sets = [r for rs in rules.index.values() for r in rs]
    assert sets and all(any(t in ("part=cheap", "part=bets", "host=cheap-bets") for t in r) for r in sets)
    out = url_filter.judge(pages, labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) and r["rule"] is None for r in out)
    index = url_filter.MinedRules([("a", "b"), ("c",)], {"z": "c"})
    assert index(["a", "b", "x"]) and index(["c"]) and index(["z"]) and not index(["a", "x"]) and not index([])


@pytest.mark.parametrize("seed", [0, 1])
def test_mined_rules_against_all_token_sets(spark, seed):
    r = random.Random(seed)
    hosts = ["a-b.x.com", "a-c.x.com", "d.y.org", "d-b.z.net", "e.x.com"]
    urls = [f"http://{r.choice(hosts)}/{r.choice('pqr')}/{r.choice('st')}.{r.choice(['htm', 'php'])}?{r.choice('uv')}=1" for _ in range(200)]
    bad = [("a-" in u and "/p/" in u and r.random() < 0.9) or r.random() < 0.15 for u in urls]
    urls += ["http://" + "long." * 3000 + "com/p/", "", "no"]
    bad += [True, False, True]
    mined = url_filter.mine(spark.createDataFrame(list(zip(urls, bad, strict=True)), "url string, bad boolean"), 0.03, 5, 0.6)
    baskets = [frozenset(url_filter.tokens(u)) for u in urls]
    counts = Counter()
    for basket, b in zip(baskets, bad, strict=True):
        for k in (1, 2, 3):
            for part in itertools.combinations(sorted(basket), k):
                counts[part] += 1
                counts[part, "bad"] += b
    least = max(5, 0.03 * len(urls))
    sure = {p: counts[p, "bad"] / n for p, n in counts.items() if p[-1] != "bad" and counts[p, "bad"] >= least and counts[p, "bad"] >= 0.6 * n}
    rules = [set(p) for p in sure if not any(sure.get(q, -1) >= sure[p] for k in range(1, len(p)) for q in itertools.combinations(p, k))]
    assert rules
    for basket in baskets:
        assert mined(sorted(basket)) == any(rule <= basket for rule in rules)


def turned(image, degrees):
    n = image.shape[0]
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    co, si = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return media.sampled(image, (n - 1) / 2 + co * y + si * x, (n - 1) / 2 - si * y + co * x)


def pgm_rows(images):
    return [(i, bytearray(media.encode_pgm(x))) for i, x in images]


def links(found):
    return {(r["query_id"], r["image_id"]) for r in found if r["query_id"] is not None}


def test_media_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    images = [(i, np.round(media.draw(rng.standard_normal(64)))) for i in range(50)]
    copies = [(i, media.edited(x, 900 + i)) for i, x in images[:30]]
    schema = "image_id long, media binary"
    found = links(media.find_copies(spark.createDataFrame(pgm_rows(copies), schema), spark.createDataFrame(pgm_rows(images), schema)).collect())

    def described(x):
        places, bits = media.describe(media.decode(media.encode_pgm(x)))
        return media._rounded(places).astype(float), np.packbits(bits, axis=1).view(np.uint64).reshape(-1, 4)

    index = [described(x) for _, x in images]
    brute = set()
    for i, x in copies:
        one = described(x)
        for j, two in enumerate(index):
            near = np.bitwise_count(one[1][:, None] ^ two[1][None]).sum(2) <= media.DISTANCE
            if media.agreed(media.matched(one[0], two[0], np.argwhere(near))):
                brute.add((i, j))
    assert len(found & brute) >= 0.9 * len(brute) and found <= {(i, i) for i in range(30)}
    assert len(found) >= 27


def test_links_in_lists(spark):
    rows = [(1, i, i, 9) for i in range(25)] + [(2, 7, 7, 10), (None, 7, 7, None), (None, 8, 7, None)]
    found = spark.createDataFrame(rows, "query_id long, image_id long, class_id long, agreeing long")
    out = media.by_query(found, 10).collect()
    one = [r for r in out if r["query_id"] == 1]
    assert sorted(i for r in one for i in r["image_ids"]) == list(range(25)) and len(one) <= 3 and {r["n_links"] for r in one} == {25}
    assert [(r["part"], r["image_ids"], r["n_links"]) for r in out if r["query_id"] == 2] == [(0, [7], 1)]
    assert sorted((r["image_ids"], r["class_id"]) for r in out if r["query_id"] is None) == [([7], 7), ([8], 7)]
    assert media.by_query(found.limit(0)).collect() == []


def test_units_turned_alike():
    rng = np.random.default_rng(3)
    unit = np.sort(rng.integers(0, 60, 900))
    turn = rng.uniform(-7, 7, 900)
    turn[unit == 5] = 6.2 + rng.uniform(0, 0.3, (unit == 5).sum())
    some = media.enough_turned_alike(unit, turn, 7)
    for u in np.unique(unit):
        t = turn[unit == u]
        apart = np.abs((t[:, None] - t + np.pi) % (2 * np.pi) - np.pi)
        assert some[unit == u].all() == some[unit == u].any() == ((apart <= media.TURN).sum(1).max() >= 7)
    assert some[unit == 5].all() and not some.all()
    assert not media.enough_turned_alike(unit[:0], turn[:0], 7).any()


def test_hamming_tables_by_blocks(spark):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, (3000, 4), np.uint64)
    words[1500:] = words[:1500]
    flips = rng.integers(0, 64, (1500, 5))
    for k in range(5):
        words[1500:, k % 4] ^= np.uint64(1) << flips[:, k].astype(np.uint64)
    tables = media.Tables(words[:1500])
    found = tables.near(words[1500:], 8)
    assert len(found) >= 1490 and (found[:, 0] == found[:, 1]).all() and len(np.unique(found, axis=0)) == len(found)
    monkey, media._MEETINGS = media._MEETINGS, 7
    assert (tables.near(words[1500:], 8) == found).all()
    media._MEETINGS = monkey
    hub = media.Tables(np.repeat(words[:1], 400, 0)).near(words[:3], 0)
    assert sorted(map(tuple, hub)) == [(i, 0) for i in range(400)]
    images = [(i, np.round(media.draw(rng.standard_normal(64)))) for i in range(12)]
    rows = media.descriptors(spark.createDataFrame(pgm_rows(images), "image_id long, media binary"))
    one = media.links_between(rows, rows, media.DISTANCE, media.AGREE)
    many = media.links_between(rows, rows, media.DISTANCE, media.AGREE, 300)
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == 12


@pytest.mark.parametrize("degrees", [90, 180, 37, -120])
def test_media_turned(spark, degrees):
    rng = np.random.default_rng(8)
    images = [(i, np.round(media.draw(rng.standard_normal(64)))) for i in range(15)]
    turns = [(i, turned(x, degrees) * 0.9 + 20) for i, x in images]
    schema = "image_id long, media binary, k1 string"
    given = (spark.createDataFrame([(*r, "x") for r in pgm_rows(rows)], schema) for rows in (turns, images))
    found = links(media.find_copies(*given).collect())
    assert len(found & {(i, i) for i in range(15)}) >= 14 and len(found) <= 15


def test_media(spark):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(30)], "vec_id long, embedding array<float>")
    queries = media.pictures(vectors.where("vec_id < 12"), copies=True)
    odd = spark.createDataFrame(
        [(100, None), (None, bytearray(b"P5 2 2 255\n1234")), (101, bytearray(b"P5 2 2 255\n1234")), (102, bytearray(b"GIF89a")),
         (103, bytearray(b"P5 9")), (104, bytearray(b"P6 40 40 255\n" + b"\x07" * 4800)), (105, bytearray(b"P5 " + b"9" * 9000 + b" 1 255\n1"))],
        "image_id long, media binary")
    images = media.pictures(vectors).unionByName(odd)
    twin = media.pictures(vectors.where("vec_id in (3, 5)")).selectExpr("image_id + 200 AS image_id", "media")
    found = media.find_copies(queries.unionByName(odd), images.unionByName(twin).unionByName(twin)).collect()
    members = {(r["image_id"], r["class_id"]) for r in found if r["query_id"] is None}
    assert members == {(3, 3), (203, 3), (5, 5), (205, 5)}
    assert len(links(found) & {(i, i) for i in range(12)}) >= 11 and len(links(found)) <= 12
    assert media.find_copies(queries.limit(0), images).collect() == []
    assert links(media.find_copies(queries, images.limit(0)).collect()) == set()
    image = media.draw(np.arange(64.0))
    assert (media.decode(media.encode_pgm(image)) == np.round(image)).all()
    assert media.decode(b"P5 # c\n2 1 255\n\x01\x02").tolist() == [[1, 2]]


def test_media_half_crops_of_large_uneven_images(spark):
    size, images, crops = 192, [], []
    y, x = np.mgrid[:size, :size] / size
    for i in range(8):
        rng = np.random.default_rng(i)
        texture = sum(media.resized(rng.standard_normal((size // s, size // s)), size, size) for s in (4, 8, 16))
        strong = np.exp(-((x - rng.uniform(0.1, 0.9)) ** 2 + (y - rng.uniform(0.1, 0.9)) ** 2) / 0.02)
        image = np.clip(128 + texture / texture.std() * (6 + 50 * strong), 0, 255)
        top, left = rng.integers(0, size // 2, 2)
        crop = image[top : top + size // 2, left : left + size // 2]
        images.append((i, bytearray(media.encode_pgm(image))))
        crops.append((i, bytearray(media.encode_pgm(crop + rng.normal(0, 2, crop.shape)))))
    schema = "image_id long, media binary"
    found = media.find_copies(spark.createDataFrame(crops, schema), spark.createDataFrame(images, schema)).collect()
    assert {(r["query_id"], r["image_id"]) for r in found} == {(i, i) for i in range(8)}
