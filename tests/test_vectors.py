"""Operators of the vector engine on small and odd inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import codebook, linalg
from lodestar.operators import baselines, codebook_fit, evaluate, index, ivf, kmeans, search
from lodestar.operators.encode import encode, encoded
from lodestar.operators.index import Index, IndexConfig, build_index
from lodestar.operators.model import Model
from lodestar.sources import vectors as sources
from lodestar.streaming.encode import append_stream, encoded_stream

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], sources.VECTORS)


@pytest.fixture(scope="module")
def data(spark):
    return sources.read_vectors(spark, f"{SF}/embeddings.parquet", 64)


@pytest.fixture(scope="module")
def asked(data):
    return sources.as_queries(data.where("vec_id < 20"))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_codebook_edges():
    book = codebook.centroids(64, 3)
    cuts = codebook.boundaries(book)
    m = Model(64, 4)
    assert m.codes(np.array(cuts)).tolist() == list(range(7))  # on a boundary: the lower bucket
    assert m.codes(np.array([-9.0, 9.0])).tolist() == [0, 7]
    assert book == sorted(book) and len(codebook.centroids(64, 1)) == 2
    for bits in (1, 3, 8):
        with pytest.raises(ValueError):
            codebook.sq_bits(bits)
    with pytest.raises(ValueError):
        Model(60)


@pytest.mark.parametrize("sb", [1, 3])
def test_pack_roundtrip(sb):
    codes = np.random.default_rng(0).integers(0, 1 << sb, (50, 64)).astype(np.uint8)
    packed = codebook.pack(codes, sb)
    assert packed.shape[1] == 64 // codebook.per_byte(sb)
    assert (codebook.unpack(packed, sb, 64) == codes).all()


def test_rotation_is_orthogonal():
    r = linalg.rotation(64)
    assert np.abs(r @ r.T - np.eye(64)).max() < 1e-12
    assert (r == linalg.rotation(64)).all() and (r != linalg.rotation(64, 1)).any()


def test_columns_and_arrow_agree(spark, data):
    m = Model(64, 4)
    a = {r["vec_id"]: r for r in encode(data, m).collect()}
    for r in encoded(data.where("vec_id < 50"), m).collect():
        got = a[r["vec_id"]]
        assert codebook.unpack(np.frombuffer(got["sq_codes"], np.uint8)[None], 3, 64)[0].tolist() == r["codes"]
        assert got["norm"] == pytest.approx(r["norm"]) and got["res_norm"] == pytest.approx(r["res_norm"])


def test_score_follows_the_norm(spark, data):
    m = Model(64, 4)
    q = sources.as_queries(data.where("vec_id < 3"))
    twice = data.withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    one = search.code_topk(encode(data, m), q, m, 5).collect()
    two = search.code_topk(encode(twice, m), q, m, 5).collect()
    assert [r["vec_id"] for r in one] == [r["vec_id"] for r in two]
    assert [r["score"] * 2 for r in one] == pytest.approx([r["score"] for r in two], rel=1e-6)


def test_odd_vectors(spark):
    df = frame(spark, [[0] * 8, [1] + [0] * 7, None, [0, 3] + [0] * 6])
    m = Model(8, 4)
    codes = {r["vec_id"]: r for r in encode(df, m).collect()}
    assert set(codes) == {0, 1, 3} and codes[0]["norm"] == 0 and codes[3]["norm"] == 3
    q = sources.as_queries(df.where("vec_id = 3"))
    found = search.exact_topk(df, q, 10).collect()
    assert [(r["vec_id"], r["rk"]) for r in found] == [(3, 1), (0, 2), (1, 3)]  # fewer than k; ties by id
    assert search.exact_topk(df, q.limit(0), 10).collect() == []
    assert search.exact_topk(df, q, 2, "cosine").first()["score"] == pytest.approx(1)
    empty = df.limit(0)
    assert encode(empty, m).collect() == [] and search.exact_topk(empty, q, 3).collect() == []
    with pytest.raises(ValueError):
        search.exact_topk(df, q, 0)


def test_wrong_length_is_an_error(spark, tmp_path):
    frame(spark, [[1] * 8, [1] * 7]).write.parquet(str(tmp_path / "v"))
    with pytest.raises(Exception, match="expected 8 coordinates"):
        sources.read_vectors(spark, str(tmp_path / "v"), 8).collect()


def test_blocks_of_queries_change_nothing(data, asked):
    assert rows_of(search.exact_topk(data, asked, 5)) == rows_of(search.exact_topk(data, asked, 5, block=7))


def test_all_probes_equal_the_flat_search(data, asked):
    m = Model(64, 4)
    centroids = kmeans.start(data, 8)
    flat = search.code_topk(encode(data, m), asked, m, 10)
    lists = ivf.search(ivf.encode_lists(data, centroids, m), asked, centroids, m, 10, 8)
    assert [r[:3] for r in rows_of(flat)] == [r[:3] for r in rows_of(lists)]
    more = ivf.search(ivf.encode_lists(data, centroids, m), asked, centroids, m, 10, 99)
    assert [r[:3] for r in rows_of(flat)] == [r[:3] for r in rows_of(more)]


def test_kmeans(spark):
    df = frame(spark, [[0, 0], [0, 1], [10, 10], [10, 11]])
    out = kmeans.update(df, np.array([[0.0, 0.5], [9.0, 9.0], [500.0, 500.0]]))
    assert out.tolist() == [[0, 0.5], [10, 10.5], [500, 500]]  # no rows: it stays
    assert len(kmeans.train(df, 9)) == 4  # fewer rows than centroids
    assert kmeans.train(df.limit(0), 3).size == 0
    sizes = ivf.sizes(ivf.assign(df, out), 3)
    assert rows_of(ivf.offsets(sizes)) == [(0, 2, 0, 2), (1, 2, 2, 4), (2, 0, 4, 4)]


@pytest.mark.parametrize("nlist", [None, 8])
def test_index_roundtrip(spark, data, asked, tmp_path, nlist):
    built = build_index(data, IndexConfig(64, 4, nlist, 8))
    built.save(str(tmp_path / "i"))
    loaded = Index.load(spark, str(tmp_path / "i"))
    assert loaded.config == built.config
    a, b = (rows_of(i.search(asked, 5)) for i in (built, loaded))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    data.where("vec_id < 30").select("vec_id", "embedding").withColumn("vec_id", F.col("vec_id") + 1000).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sources.VECTORS).parquet(str(tmp_path / "in"))
    assert encoded_stream(stream, loaded).isStreaming
    append_stream(stream, loaded, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    assert Index.load(spark, str(tmp_path / "i")).codes.count() == 530
    assert index.append(built, data).codes.count() == 1000


def test_probed_lists_are_the_only_ones_read(spark, data, asked, tmp_path):
    built = build_index(data, IndexConfig(64, 4, 8, 2))
    built.save(str(tmp_path / "i"))
    one = Index.load(spark, str(tmp_path / "i")).search(asked.limit(1), 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    probed = ivf.probe(asked.limit(1), built.centroids, 2).collect()
    assert len(filters) == 1 and sorted(map(int, re.findall(r"\d+(?=[,)])", filters[0].split("IN")[1]))) == sorted(r["list_id"] for r in probed)
    near = built.codes.where(F.col("list_id").isin([r["list_id"] for r in probed])).count()
    assert 0 < near < 500


def test_best_of_many_batches():
    rng = np.random.default_rng(0)
    scores, ids = rng.integers(0, 40, (500, 7)).astype(float), rng.permutation(500)
    best = search.Best(np.arange(7) * 10, 5)
    for at in range(0, 500, 90):
        best.add(ids[at : at + 90], scores[at : at + 90])
        best.held += search.SCORES * (at == 180)  # cut on the way
    got = best.batch().to_pydict()
    want = []
    for q in range(7):
        want += [(q * 10, ids[r], scores[r, q]) for r in np.lexsort((ids, -scores[:, q]))[:5]]
    assert list(zip(got["query_id"], got["vec_id"], got["score"], strict=True)) == want
    assert search.Best(np.arange(3), 2).batch().num_rows == 0


def test_training_in_the_driver_or_in_tasks(data, monkeypatch):
    here = kmeans.train(data, 6, 4), baselines.pq_train(data, 8, 64, 16, 3)
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 0)
    there = kmeans.train(data, 6, 4), baselines.pq_train(data, 8, 64, 16, 3)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(here, there, strict=True))


def test_rescored(data, asked):
    built = build_index(data, IndexConfig(64, 2, 8, 8))
    exact = rows_of(search.exact_topk(data, asked, 10))
    plain, twice = built.search(asked, 10), built.search(asked, 10, vectors=data, wider=10)
    hits = lambda found: len({r[::2] for r in ((a, b, c) for a, b, c, _ in found)} & {(a, c) for a, _, c, _ in exact})
    assert hits(rows_of(plain)) < hits(rows_of(twice)) and hits(rows_of(twice)) > 190


def test_stored_codes(data, asked):
    low, high = baselines.value_range(data).first()
    for bits in (2, 4, 8):
        table = baselines.sq_table(data, bits, low, high)
        assert baselines.sq_scan(table, asked, bits).count() == 500 * 20
        assert baselines.sq_topk(table, asked, bits, low, high, 3).count() == 60
    books = baselines.pq_train(data, 8, 64, 32, 2)
    table = baselines.pq_table(data, books)
    decoded = baselines.pq_decode(baselines.pq_encode(data, books), books)
    a, b = rows_of(baselines.pq_topk(table, asked, books, 5)), rows_of(search.exact_topk(decoded, asked, 5))
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b])
    with pytest.raises(ValueError):
        baselines.pq_table(data, np.zeros((8, 300, 8)))


def test_fitted_codebook(data):
    m = Model(64, 4)
    book = codebook_fit.fit(data, m, 20)
    assert len(book) == 8 and book == sorted(book)
    assert np.abs(np.array(book) - np.array(m.book)).max() < 0.05  # unit vectors: near the analytic one
    assert codebook_fit.fit(data.limit(0), m) == m.book


def test_recall(data, spark):
    rng = np.random.default_rng(1)
    x = np.array([r[0] for r in data.orderBy("vec_id").select("embedding").collect()])
    q = x[rng.choice(len(x), 50, replace=False)] + 0.05 * rng.standard_normal((50, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    queries = frame(spark, q).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    truth = search.exact_topk(data, queries, 64)
    found = {}
    for bits in (2, 4):
        m = Model(64, bits)
        found[bits] = search.code_topk(encode(data, m), queries, m, 64)
    assert evaluate.report(evaluate.summary({"4": found[4]}, truth, (1,))).startswith("| method | k | top1_in_k | set_recall |\n")
    got = {(r["method"], r["k"]): r for r in evaluate.summary({str(b): f for b, f in found.items()}, truth).collect()}
    assert got["4", 8]["set_recall"] > 80 > got["2", 8]["set_recall"] > 50
    assert got["2", 1]["top1_in_k"] > 90 and got["4", 64]["top1_in_k"] == 100


def test_product_codes(data, asked):
    books = baselines.pq_train(data, 8, 64, 16, 3)
    codes = baselines.pq_encode(data, books)
    error = lambda b: np.mean([
        np.sum((np.array(r["a"]) - np.array(r["b"])) ** 2)
        for r in data.select("vec_id", F.col("embedding").alias("a")).join(
            baselines.pq_decode(baselines.pq_encode(data, b), b).select("vec_id", F.col("embedding").alias("b")), "vec_id").collect()
    ])
    assert error(books) < error(baselines.pq_train(data, 8, 64, 16, 0))
    assert codes.count() == 500
    with pytest.raises(ValueError):
        baselines.pq_split(data, 7, 64)


def test_global_codes(spark):
    df = frame(spark, [[0, 1, 2, 3], [3, 2, 1, 0]])
    codes = baselines.sq_encode(df, 2).select("codes")
    assert [r[0] for r in codes.collect()] == [[0, 1, 2, 3], [3, 2, 1, 0]]
    flat = baselines.sq_encode(frame(spark, [[1, 1]]), 4).first()["codes"]
    assert flat == [0, 0]  # one value only


def test_sources(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((25, 8)).astype(np.float32)
    np.save(tmp_path / "a.npy", x[:10])
    np.save(tmp_path / "b.npy", x[10:])
    got = sources.read_npy(spark, str(tmp_path), rows=4).orderBy("vec_id").collect()
    assert sources.read_npy(spark, str(tmp_path), rows=4).rdd.getNumPartitions() == 7
    assert rows_of(sources.read_npy(spark, str(tmp_path / "a.npy"))) == [tuple(r) for r in got[:10]]
    assert [r["vec_id"] for r in got] == list(range(25)) and np.array([r["embedding"] for r in got]).tolist() == x.tolist()
    g = sources.gaussian(spark, 2000, 8, 3)
    again = sources.gaussian(spark, 2000, 8, 3, 7)
    assert rows_of(g) == rows_of(again) and g.count() == 2000
    assert sources.first_rows(g, 5).count() == 5
