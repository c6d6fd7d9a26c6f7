"""The registered queries of the vector engine, each with the SQL that it is held against.

Searches ask with every row whose vec_id is divisible by 20, against all rows. Small parameters (16 lists, 8 parts) are those
of the features shown. Scores and other sums are rounded to six digits, as two engines add in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import codebook, linalg
from lodestar.operators import baselines, codebook_fit, encode, evaluate, ivf, kmeans, search
from lodestar.operators.index import Index, IndexConfig, build_index
from lodestar.operators.model import Model
from lodestar.sources.scratch import fresh_path, written
from lodestar.sources.vectors import as_queries, in_ranges, read_vectors
from lodestar.streaming.encode import append_stream

#: Of 16 lists, 11 hold 0.9 of the true ten best (see the README).
DIM, K, NLIST, NPROBE, PARTS, ENTRIES = 64, 10, 16, 11, 8, 16
#: What a search asks with.
ASKED = "vec_id % 20 = 0"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Query) -> Query:
        _queries[name], _sql[name] = f, sql
        return f

    return keep


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vectors(spark, f"{sf_dir}/embeddings.parquet", DIM)


def some_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_queries(vectors(spark, sf_dir).where(ASKED))


@lru_cache(maxsize=4)
def model(bits: int) -> Model:
    return Model(DIM, bits)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def exploded(df: DataFrame, key: str, values: Column, digits: bool = True) -> DataFrame:
    """key, pos, value."""
    rows = df.select(F.col(key), F.posexplode(values).alias("pos", "value"))
    value = r6(F.col("value").cast("double")) if digits else F.col("value").cast("long")
    return rows.select(F.col(key).cast("long").alias(key), F.col("pos").cast("long").alias("pos"), value.alias("value"))


# --- pieces of SQL

V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"
U = f"{V}, u AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v)"


@lru_cache(maxsize=1)
def rotation_sql() -> str:
    rows = model(4).rotation.T.tolist()
    return "r AS (SELECT [" + ", ".join("[" + ", ".join(map(repr, x)) + "]" for x in rows) + "]::DOUBLE[][] AS m)"


def y_sql() -> str:
    return f"""{U}, {rotation_sql()},
y AS (SELECT vec_id, label, e, norm, [list_inner_product(unit, q) for q in m] AS y
      FROM (SELECT *, [x / greatest(norm, 1e-12) for x in e] AS unit FROM u), r)"""


def codes_sql(bits: int) -> str:
    m = model(bits)
    code = " + ".join(f"(x > {b!r})::INT" for b in codebook.boundaries(m.book))
    return f"""{y_sql()},
c0 AS (SELECT *, [{code} for x in y] AS codes FROM y),
c1 AS (SELECT *, [{m.book!r}[c + 1] for c in codes] AS about FROM c0),
c2 AS (SELECT *, [y[i] - about[i] for i in range(1, {DIM + 1})] AS rest FROM c1),
c AS (SELECT *, sqrt(list_inner_product(rest, rest)) AS res_norm,
      [CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END for x in rest]::DOUBLE[] AS sign FROM c2)"""


def packed_sql(codes: str, sb: int) -> str:
    n = codebook.per_byte(sb)
    return "[" + " + ".join(f"{codes}[{n} * b + {i + 1}] * {1 << (i * sb)}" for i in range(n)) + f" for b in range(0, {DIM // n})]"


def scores_sql(bits: int) -> str:
    return f"""{codes_sql(bits)},
q AS (SELECT vec_id AS query_id, [list_inner_product(e, x) for x in m] AS q FROM v, r WHERE {ASKED}),
s AS (SELECT query_id, vec_id, (list_inner_product(q, about)
      + {model(bits).scale!r} * res_norm * list_inner_product(q, sign)) * norm AS score FROM q, c)"""


EXACT = f"{V}, s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q, v WHERE q.{ASKED})"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk"


def top_sql(ctes: str, k: int = K) -> str:
    return f"""WITH {ctes} SELECT query_id, rk, vec_id, round(score, 6) AS score
FROM (SELECT *, {RANK} FROM s) WHERE rk <= {k}"""


def exploded_sql(ctes: str, source: str, values: str, key: str = "vec_id", digits: bool = True) -> str:
    value = "round(value, 6)" if digits else "value::BIGINT"
    return f"""WITH {ctes} SELECT {key}::BIGINT AS {key}, pos, {value} AS value FROM (
SELECT {key}, unnest({values}) AS value, generate_subscripts({values}, 1) - 1 AS pos FROM {source})"""


def with_scores(found: DataFrame) -> DataFrame:
    return found.withColumn("score", r6(F.col("score")))


# --- exact scores and basic vector functions


@query("exact_inner_product", f"WITH {EXACT} SELECT query_id, vec_id, round(score, 6) AS score FROM s")
def _(spark, d):
    return with_scores(search.scan(search.dense(vectors(spark, d)), some_queries(spark, d), search.inner_product))


@query("exact_topk", top_sql(EXACT))
def _(spark, d):
    return with_scores(search.exact_topk(vectors(spark, d), some_queries(spark, d), K))


@query("filtered_topk", f"WITH {EXACT} SELECT query_id, rk, vec_id, round(score, 6) AS score FROM (SELECT *, {RANK} FROM s SEMI JOIN (SELECT vec_id FROM v WHERE label = 3) f USING (vec_id)) WHERE rk <= {K}")
def _(spark, d):
    return with_scores(search.exact_topk(vectors(spark, d).where("label = 3"), some_queries(spark, d), K))


@query("l2_norm", f"WITH {U} SELECT vec_id, round(norm, 6) AS norm FROM u")
def _(spark, d):
    return vectors(spark, d).select("vec_id", r6(linalg.norm(F.col("embedding"))).alias("norm"))


@query("l2_normalize", exploded_sql(U, "u", "[x / greatest(norm, 1e-12) for x in e]"))
def _(spark, d):
    return exploded(vectors(spark, d), "vec_id", linalg.normalized(F.col("embedding")))


@query("l2_distance", f"WITH {V} SELECT q.vec_id AS query_id, v.vec_id, round(list_sum([(q.e[i] - v.e[i]) ** 2 for i in range(1, {DIM + 1})]), 6) AS distance FROM v q, v WHERE q.{ASKED}")
def _(spark, d):
    found = search.scan(search.dense(vectors(spark, d)), some_queries(spark, d), search.squared_l2)
    return found.select("query_id", "vec_id", r6(F.col("score")).alias("distance"))


@query("rotate", exploded_sql(y_sql(), "y", "y"))
def _(spark, d):
    return exploded(encode.rotated(vectors(spark, d), model(4)), "vec_id", F.col("y"))


@query("rotate_roundtrip", exploded_sql(U, "u", "[x / greatest(norm, 1e-12) for x in e]"))
def _(spark, d):
    there = encode.rotated(vectors(spark, d), model(4))
    return exploded(encode.times_matrix(there, "vec_id", "y", model(4).rotation.T, "x"), "vec_id", F.col("x"))


def _book_rows(spark: SparkSession, of: Callable[[int], list[float]], name: str) -> DataFrame:
    rows = [(bits, i, round(x, 9)) for bits in (2, 4) for i, x in enumerate(of(bits))]
    return spark.createDataFrame(rows, f"bits long, pos long, {name} double")


_UNIT = {2: [0.79788456], 4: [0.245, 0.756, 1.344, 2.152]}
_BOOK = " UNION ALL ".join(
    f"SELECT {bits}::BIGINT AS bits, list_sort(list_concat([x / sqrt({DIM}) for x in {h!r}], [-x / sqrt({DIM}) for x in {h!r}])) AS b"
    for bits, h in _UNIT.items()
)


@query("codebook", f"SELECT bits, pos, round(centroid, 9) AS centroid FROM (SELECT bits, unnest(b) AS centroid, generate_subscripts(b, 1) - 1 AS pos FROM ({_BOOK}))")
def _(spark, d):
    return _book_rows(spark, lambda bits: model(bits).book, "centroid")


@query("codebook_boundaries", f"SELECT bits, pos, round(boundary, 9) AS boundary FROM (SELECT bits, unnest(m) AS boundary, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT bits, [(b[i] + b[i + 1]) / 2 for i in range(1, len(b))] AS m FROM ({_BOOK})))")
def _(spark, d):
    return _book_rows(spark, lambda bits: codebook.boundaries(model(bits).book), "boundary")


# --- encoding


def _register_encoding(bits: int) -> None:
    m, sb = model(bits), model(bits).sb

    def steps(spark, d):
        return encode.encoded(vectors(spark, d), m)

    @query(f"sq_encode_{sb}bit", exploded_sql(codes_sql(bits), "c", "codes", digits=False))
    def _(spark, d):
        return exploded(steps(spark, d), "vec_id", F.col("codes"), False)

    @query(f"pack_sq_{sb}bit", exploded_sql(codes_sql(bits) + f", p AS (SELECT vec_id, {packed_sql('codes', sb)} AS bytes FROM c)", "p", "bytes", digits=False))
    def _(spark, d):
        return exploded(steps(spark, d), "vec_id", codebook.packed(F.col("codes"), sb, DIM), False)

    @query(f"tq_encode_{bits}bit", f"""WITH {codes_sql(bits)} SELECT vec_id, round(norm, 6) AS norm, round(res_norm, 6) AS res_norm,
array_to_string({packed_sql('codes', sb)}, ',') AS sq_codes,
array_to_string({packed_sql('[(x > 0)::INT for x in rest]', 1)}, ',') AS qjl_signs FROM c""")  # fmt: skip
    def _(spark, d):
        def bytes_of(c: str, n: int) -> Column:
            each = [F.conv(F.hex(F.substring(c, i + 1, 1)), 16, 10) for i in range(n)]
            return F.concat_ws(",", *each)

        codes = encode.encode(vectors(spark, d), m)
        return codes.select(
            "vec_id",
            r6(F.col("norm")).alias("norm"),
            r6(F.col("res_norm")).alias("res_norm"),
            bytes_of("sq_codes", DIM // codebook.per_byte(sb)).alias("sq_codes"),
            bytes_of("qjl_signs", DIM // 8).alias("qjl_signs"),
        )

    @query(f"tq_scan_{bits}bit", f"WITH {scores_sql(bits)} SELECT query_id, vec_id, round(score, 6) AS score FROM s")
    def _(spark, d):
        codes = encode.encode(vectors(spark, d), m).select(*search.CODE_COLUMNS)
        return with_scores(search.scan(codes, some_queries(spark, d), search.code_kernel(m), m.rotate))

    @query(f"tq_topk_{bits}bit", top_sql(scores_sql(bits)))
    def _(spark, d):
        codes = encode.encode(vectors(spark, d), m)
        return with_scores(search.code_topk(codes, some_queries(spark, d), m, K))


for _bits in (2, 4):
    _register_encoding(_bits)


@query("unpack_roundtrip", f"WITH {V} SELECT vec_id, 0::BIGINT AS mismatches FROM v")
def _(spark, d):
    df = encode.encoded(vectors(spark, d), model(4))
    again = codebook.unpacked(codebook.packed(F.col("codes"), 3, DIM), 3, DIM)
    wrong = F.size(F.filter(F.zip_with("codes", again, lambda a, b: a != b), lambda x: x))
    return df.select("vec_id", wrong.cast("long").alias("mismatches"))


@query("sq_reconstruct", exploded_sql(codes_sql(4), "c", "about"))
def _(spark, d):
    return exploded(encode.encoded(vectors(spark, d), model(4)), "vec_id", F.col("about"))


@query("residual", exploded_sql(codes_sql(4), "c", "rest"))
def _(spark, d):
    return exploded(encode.encoded(vectors(spark, d), model(4)), "vec_id", F.col("rest"))


@query("qjl_signs", exploded_sql(codes_sql(4) + f", p AS (SELECT vec_id, {packed_sql('[(x > 0)::INT for x in rest]', 1)} AS bytes FROM c)", "p", "bytes", digits=False))
def _(spark, d):
    df = encode.encoded(vectors(spark, d), model(4))
    return exploded(df, "vec_id", codebook.packed(codebook.signs(F.col("rest")), 1, DIM), False)


# --- k-means


@query("kmeans_sample", "SELECT vec_id, ((vec_id::HUGEINT * 2654435761) % 4294967296)::BIGINT AS sample_key FROM embeddings ORDER BY sample_key, vec_id LIMIT 100")
def _(spark, d):
    return kmeans.sample(vectors(spark, d), 100).select("vec_id", "sample_key")


TRAINING, LAST = [(0, 50), (350, 360), (10_000, 10_100), (13_000, 13_050)], 46


@query("training_rows", "SELECT vec_id FROM embeddings WHERE " + " OR ".join(f"(vec_id >= {a} AND vec_id < {b})" for a, b in TRAINING) + f" OR vec_id >= (SELECT count(*) FROM embeddings) - {LAST}")
def _(spark, d):
    return in_ranges(vectors(spark, d), TRAINING, LAST).select("vec_id")


def kmeans_sql(k: int, rounds: int, trained: bool = False, of: str = "v") -> str:
    """CTEs up to k<rounds> and centers (list_id, c). ``trained``: as kmeans.train starts, on the sample ``w``."""
    key = "((vec_id::HUGEINT + {}) * 2654435761) % 4294967296, vec_id"
    if trained:
        out = f"{V}, w AS MATERIALIZED (SELECT * FROM {of} ORDER BY {key.format(0)} LIMIT {kmeans.SAMPLE_ROWS})"
        first = f"SELECT row_number() OVER (ORDER BY {key.format(42)}) - 1 AS list_id, e AS c FROM w QUALIFY list_id < {k}"
    else:
        out, first = f"{V}, w AS (SELECT * FROM v)", f"SELECT vec_id AS list_id, e AS c FROM v WHERE vec_id < {k}"
    out += f", k0 AS MATERIALIZED ({first})"
    for i in range(rounds):
        out += f""", a{i} AS ({assign_sql(f"k{i}", "w")}),
k{i + 1} AS MATERIALIZED (SELECT list_id, coalesce(n.c, o.c) AS c FROM k{i} o LEFT JOIN (
  SELECT list_id, list(x ORDER BY pos) AS c FROM (SELECT list_id, pos, avg(x) AS x FROM (
    SELECT list_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i} JOIN w USING (vec_id)) GROUP BY ALL)
  GROUP BY list_id) n USING (list_id))"""
    return out + f", centers AS (SELECT * FROM k{rounds})"


def assign_sql(centroids: str, of: str = "v") -> str:
    return f"""SELECT vec_id, arg_min(list_id, (d, list_id)) AS list_id FROM (
SELECT vec_id, list_id, list_inner_product(c, c) - 2 * list_inner_product(e, c) AS d FROM {of}, {centroids}) GROUP BY vec_id"""


def lloyd(spark, d, k: int, rounds: int) -> np.ndarray:
    """Rounds over all rows, from the k rows of the least ids."""
    centroids = kmeans.start(vectors(spark, d), k)
    for _ in range(rounds):
        centroids = kmeans.update(vectors(spark, d), centroids)
    return centroids


def centroid_rows(spark, centroids: np.ndarray) -> DataFrame:
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    return exploded(spark.createDataFrame(rows, "list_id long, c array<double>"), "list_id", F.col("c"))


@query("kmeans_update", exploded_sql(kmeans_sql(8, 1), "k1", "c", "list_id"))
def _(spark, d):
    return centroid_rows(spark, lloyd(spark, d, 8, 1))


@query("kmeans_3iter", f"WITH {kmeans_sql(8, 3)} {assign_sql('k3')}")
def _(spark, d):
    return ivf.assign(vectors(spark, d), lloyd(spark, d, 8, 3))


def trained(spark, d) -> np.ndarray:
    """The centroids of the inverted lists."""
    return kmeans.train(vectors(spark, d), NLIST)


TRAINED = kmeans_sql(NLIST, kmeans.ITERATIONS, trained=True)


@query("kmeans_train", exploded_sql(TRAINED, "centers", "c", "list_id"))
def _(spark, d):
    return centroid_rows(spark, trained(spark, d))


# --- inverted lists

LISTS = f"{TRAINED}, a AS ({assign_sql('centers')})"
SIZES = f"{LISTS}, z AS (SELECT centers.list_id, count(a.vec_id) AS size FROM centers LEFT JOIN a USING (list_id) GROUP BY ALL)"
PROBES = f"""p AS (SELECT query_id, rk, list_id FROM (SELECT q.vec_id AS query_id, list_id,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(c, c) - 2 * list_inner_product(q.e, c), list_id) AS rk
FROM v q, centers WHERE q.{ASKED}) WHERE rk <= {NPROBE})"""


@query("ivf_assign", f"WITH {LISTS} SELECT * FROM a")
def _(spark, d):
    return ivf.assign(vectors(spark, d), trained(spark, d))


def _sizes(spark, d):
    return ivf.sizes(ivf.assign(vectors(spark, d), trained(spark, d)), NLIST)


@query("ivf_list_sizes", f"WITH {SIZES} SELECT list_id, size FROM z")
def _(spark, d):
    return _sizes(spark, d)


@query("ivf_list_offsets", f"WITH {SIZES} SELECT list_id, size, (finish - size)::BIGINT AS \"begin\", finish::BIGINT AS finish FROM (SELECT *, sum(size) OVER (ORDER BY list_id) AS finish FROM z)")
def _(spark, d):
    return ivf.offsets(_sizes(spark, d))


@query("ivf_max_list", f"WITH {SIZES} SELECT max(size) AS size FROM z")
def _(spark, d):
    return _sizes(spark, d).agg(F.max("size").alias("size"))


@query("ivf_probe", f"WITH {LISTS}, {PROBES} SELECT * FROM p")
def _(spark, d):
    return ivf.probe(some_queries(spark, d), trained(spark, d), NPROBE)


def listed_sql(bits: int, lists: str = LISTS) -> str:
    """CTEs up to s: scores of the rows in probed lists."""
    ctes = scores_sql(bits).replace("s AS (", "s0 AS (") + f", {lists[len(V) + 2:]}, {PROBES}"
    return ctes + ", s AS (SELECT s0.* FROM s0 JOIN a USING (vec_id) JOIN p ON p.query_id = s0.query_id AND p.list_id = a.list_id)"


def stored(spark, index: Index) -> Index:
    """The index, saved and loaded again."""
    path = fresh_path(spark, "index")
    index.save(path)
    return Index.load(spark, path)


def _register_lists(bits: int) -> None:
    @query(f"ivf_topk_{bits}bit", top_sql(listed_sql(bits)))
    def _(spark, d):
        index = stored(spark, build_index(vectors(spark, d), IndexConfig(DIM, bits, NLIST, NPROBE)))
        return with_scores(index.search(some_queries(spark, d), K))


for _bits in (2, 4):
    _register_lists(_bits)


@query("ivf_topk_rescored", f"""WITH {listed_sql(4)}, near AS (SELECT query_id, vec_id FROM (SELECT *, {RANK} FROM s) WHERE rk <= {4 * K}),
x AS (SELECT query_id, n.vec_id, list_inner_product(q.e, v.e) AS score FROM near n JOIN v USING (vec_id) JOIN v q ON q.vec_id = query_id)
SELECT query_id, rk, vec_id, round(score, 6) AS score FROM (SELECT *, {RANK} FROM x) WHERE rk <= {K}""")  # fmt: skip
def _(spark, d):
    index = stored(spark, build_index(vectors(spark, d), IndexConfig(DIM, 4, NLIST, NPROBE)))
    return with_scores(index.search(some_queries(spark, d), K, vectors=vectors(spark, d)))


@query("index_save_load_topk", top_sql(scores_sql(4)))
def _(spark, d):
    index = stored(spark, build_index(vectors(spark, d), IndexConfig(DIM, 4)))
    return with_scores(index.search(some_queries(spark, d), K))


EVEN = kmeans_sql(NLIST, kmeans.ITERATIONS, trained=True, of="(SELECT * FROM v WHERE vec_id % 2 = 0)")


@query("stream_append_topk", top_sql(listed_sql(4, f"{EVEN}, a AS ({assign_sql('centers')})")))
def _(spark, d):
    """Lists trained on the even rows and saved; the odd rows arrive as a stream."""
    even = vectors(spark, d).where("vec_id % 2 = 0")
    path = fresh_path(spark, "index")
    index = build_index(even, IndexConfig(DIM, 4, NLIST, NPROBE))
    index.save(path)
    source = f"{d}/embeddings.parque[t]"  # a pattern: a plain path would have to be a folder
    rows = spark.readStream.schema(spark.read.parquet(f"{d}/embeddings.parquet").schema).parquet(source)
    odd = rows.where("vec_id % 2 = 1 AND embedding IS NOT NULL").select("vec_id", "embedding")
    append_stream(odd, index, path, fresh_path(spark, "stream")).awaitTermination()
    return with_scores(Index.load(spark, path).search(some_queries(spark, d), K))


@query("ivf_build_codes", f"WITH {codes_sql(4)}, {LISTS[len(V) + 2:]} SELECT vec_id, list_id, round(norm, 6) AS norm, round(res_norm, 6) AS res_norm, array_to_string({packed_sql('codes', 3)}, ',') AS sq_codes FROM c JOIN a USING (vec_id)")
def _(spark, d):
    codes = ivf.encode_lists(vectors(spark, d), trained(spark, d), model(4))
    each = [F.conv(F.hex(F.substring("sq_codes", i + 1, 1)), 16, 10) for i in range(DIM // 2)]
    return codes.select(
        "vec_id", "list_id", r6(F.col("norm")).alias("norm"), r6(F.col("res_norm")).alias("res_norm"), F.concat_ws(",", *each).alias("sq_codes")
    )


# --- baselines

RANGE = f"{U}, g AS (SELECT min(list_min(e)) AS low, max(list_max(e)) AS high FROM v)"


def sq_sql(bits: int) -> str:
    top = (1 << bits) - 1
    return f"""{RANGE}, h AS (SELECT u.*, low, high, [least(greatest(floor((x - low) / ((high - low) / {top})), 0), {top}) for x in e] AS codes FROM u, g)"""


def sq_scores_sql(bits: int) -> str:
    about = f"[low + c * (high - low) / {(1 << bits) - 1} for c in codes]"
    return f"""{sq_sql(bits)}, s AS (SELECT q.vec_id AS query_id, h.vec_id, list_inner_product(q.e, h.about) AS score
FROM v q, (SELECT vec_id, {about} AS about FROM h) h WHERE q.{ASKED})"""


def sq_stored(spark, d, bits: int) -> tuple[DataFrame, float, float]:
    """A stored table of scalar codes, and the range."""
    rows = vectors(spark, d)
    low, high = baselines.value_range(rows).first()
    return written(baselines.sq_table(rows, bits, low, high), "sq"), low, high


@query("sq_global_range", f"WITH {RANGE} SELECT low, high FROM g")
def _(spark, d):
    return baselines.value_range(vectors(spark, d))


def _register_sq(bits: int) -> None:
    top, n = (1 << bits) - 1, 8 // bits

    @query(f"sq_global_{bits}bit", exploded_sql(sq_sql(bits), "h", "codes", digits=False))
    def _(spark, d):
        return exploded(baselines.sq_encode(vectors(spark, d), bits), "vec_id", F.col("codes"), False)

    @query(f"sq_decode_{bits}bit", exploded_sql(sq_sql(bits), "h", f"[low + c * (high - low) / {top} for c in codes]"))
    def _(spark, d):
        df = baselines.sq_encode(vectors(spark, d), bits)
        return exploded(df, "vec_id", baselines.sq_decode(F.col("codes"), F.col("low"), F.col("high"), bits))

    @query(f"sq_pack_{bits}bit", exploded_sql(sq_sql(bits), "h", "[" + " + ".join(f"codes[{n} * b + {i + 1}] * {1 << ((n - 1 - i) * bits)}" for i in range(n)) + f" for b in range(0, {DIM // n})]", digits=False))
    def _(spark, d):
        df = baselines.sq_encode(vectors(spark, d), bits)
        return exploded(df, "vec_id", baselines.pack_high_first(F.col("codes"), bits, DIM), False)

    @query(f"sq_scan_{bits}bit", f"WITH {sq_sql(bits)} SELECT q.vec_id AS query_id, h.vec_id, round(list_inner_product(q.e, h.codes::DOUBLE[]) * h.norm, 6) AS score FROM v q, h WHERE q.{ASKED}")
    def _(spark, d):
        table, _, _ = sq_stored(spark, d, bits)
        return with_scores(baselines.sq_scan(table, some_queries(spark, d), bits))

    @query(f"sq_topk_{bits}bit", top_sql(sq_scores_sql(bits)))
    def _(spark, d):
        table, low, high = sq_stored(spark, d, bits)
        return with_scores(baselines.sq_topk(table, some_queries(spark, d), bits, low, high, K))


for _bits in (2, 4, 8):
    _register_sq(_bits)


def group_queries(spark, d) -> DataFrame:
    """A query for each label: its row of the least id."""
    return vectors(spark, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))


GROUP_QUERIES = "gq AS (SELECT label, arg_min(e, vec_id) AS q FROM v GROUP BY label)"


@query("sq8_scan_grouped", f"WITH {sq_sql(8)}, {GROUP_QUERIES} SELECT label::BIGINT AS group_id, vec_id, round(list_inner_product(q, codes::DOUBLE[]) * norm, 6) AS score FROM h JOIN gq USING (label)")
def _(spark, d):
    rows = vectors(spark, d)
    ranged = rows.crossJoin(F.broadcast(baselines.value_range(rows)))
    keys = ranged.select(
        "vec_id",
        "label",
        baselines.sq_codes(F.col("embedding"), F.col("low"), F.col("high"), 8).alias("codes"),
        linalg.norm(F.col("embedding")).alias("norm"),
    )
    s = baselines.sq_score(F.col("q"), F.col("codes"), F.col("norm"))
    return keys.join(group_queries(spark, d), "label").select(F.col("label").cast("long").alias("group_id"), "vec_id", r6(s).alias("score"))


WIDTH = DIM // PARTS
SPLIT = f"{V}, t AS (SELECT vec_id, m, e[m * {WIDTH} + 1 : m * {WIDTH} + {WIDTH}] AS sub FROM v, range({PARTS}) x(m)), k AS (SELECT vec_id AS code, m, sub AS c FROM t WHERE vec_id < {ENTRIES})"
CODES = f"{SPLIT}, pc AS (SELECT vec_id, m, arg_min(code, (d, code)) AS code FROM (SELECT vec_id, t.m, code, list_inner_product(c, c) - 2 * list_inner_product(sub, c) AS d FROM t JOIN k USING (m)) GROUP BY ALL)"


def books(spark, d, rounds: int = 0) -> np.ndarray:
    return baselines.pq_train(vectors(spark, d), PARTS, DIM, ENTRIES, rounds, sample_rows=None)


@query("pq_split", exploded_sql(f"{SPLIT}, x AS (SELECT vec_id * {PARTS} + m AS sub_id, sub FROM t)", "x", "sub", "sub_id"))
def _(spark, d):
    df = baselines.pq_split(vectors(spark, d), PARTS, DIM)
    return exploded(df.withColumn("sub_id", F.col("vec_id") * PARTS + F.col("m")), "sub_id", F.col("sub"))


@query("pq_train", f"""WITH {CODES} SELECT m, code, pos - 1 AS pos, round(avg(x), 6) AS value FROM (
SELECT m, code, unnest(sub) AS x, generate_subscripts(sub, 1) AS pos FROM pc JOIN t USING (vec_id, m)) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    b = books(spark, d, 1)
    rows = [(m, c, p, float(x)) for (m, c, p), x in np.ndenumerate(b)]
    return spark.createDataFrame(rows, "m long, code long, pos long, value double").withColumn("value", r6(F.col("value")))


@query("pq_encode", f"WITH {CODES} SELECT vec_id, m, code FROM pc")
def _(spark, d):
    codes = baselines.pq_encode(vectors(spark, d), books(spark, d))
    rows = codes.select("vec_id", F.posexplode("codes").alias("m", "code"))
    return rows.select("vec_id", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


@query("pq_reconstruct", f"WITH {CODES} SELECT vec_id, m * {WIDTH} + p AS pos, round(x, 6) AS value FROM (SELECT vec_id, m, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS p FROM pc JOIN k USING (m, code))")
def _(spark, d):
    b = books(spark, d)
    return exploded(baselines.pq_decode(baselines.pq_encode(vectors(spark, d), b), b), "vec_id", F.col("embedding"))


@query("pq_adc_scan", f"WITH {CODES}, l AS (SELECT t.vec_id AS query_id, m, code, list_inner_product(sub, c) AS x FROM t JOIN k USING (m) WHERE t.{ASKED}) SELECT query_id, vec_id, round(sum(x), 6) AS score FROM pc JOIN l USING (m, code) GROUP BY ALL")
def _(spark, d):
    b = books(spark, d)
    table = written(baselines.pq_table(vectors(spark, d), b), "pq")
    return with_scores(baselines.pq_scan(table, some_queries(spark, d), b))


def pq_sql(parts: int) -> str:
    """CTEs up to s: 256 entries for each part, trained for 20 rounds, and scores by them."""
    width = DIM // parts
    out = f"""{V}, sub AS MATERIALIZED (SELECT vec_id, m, e[m * {width} + 1 : m * {width} + {width}] AS sub FROM v, range({parts}) x(m)),
b0 AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS code, m, sub AS c FROM sub QUALIFY code < 256)"""
    near = "SELECT vec_id, m, arg_min(code, (d, code)) AS code FROM (SELECT vec_id, sub.m, code, list_inner_product(c, c) - 2 * list_inner_product(sub, c) AS d FROM sub JOIN {} USING (m)) GROUP BY ALL"
    for r in range(20):
        out += f""", n{r} AS ({near.format(f"b{r}")}), b{r + 1} AS MATERIALIZED (SELECT code, m, coalesce(n.c, o.c) AS c FROM b{r} o LEFT JOIN (
SELECT m, code, list(x ORDER BY pos) AS c FROM (SELECT m, code, pos, avg(x) AS x FROM (
  SELECT m, code, unnest(sub) AS x, generate_subscripts(sub, 1) AS pos FROM n{r} JOIN sub USING (vec_id, m)) GROUP BY ALL) GROUP BY ALL) n USING (m, code))"""
    return out + f""", pc AS MATERIALIZED ({near.format("b20")}),
l AS (SELECT vec_id AS query_id, m, code, list_inner_product(sub, c) AS x FROM sub JOIN b20 USING (m) WHERE {ASKED}),
s AS (SELECT query_id, vec_id, sum(x) AS score FROM pc JOIN l USING (m, code) GROUP BY ALL)"""


def pq_stored(spark, d, parts: int) -> tuple[DataFrame, np.ndarray]:
    """A stored table of product codes, and the books."""
    b = baselines.pq_train(vectors(spark, d), parts, DIM, sample_rows=None)
    return written(baselines.pq_table(vectors(spark, d), b), "pq"), b


def _register_pq(parts: int) -> None:
    @query(f"pq_topk_{parts}x256", top_sql(pq_sql(parts)))
    def _(spark, d):
        table, b = pq_stored(spark, d, parts)
        return with_scores(baselines.pq_topk(table, some_queries(spark, d), b, K))


for _parts in (8, 16):
    _register_pq(_parts)


@query("pq_train_256", f"WITH {pq_sql(PARTS)} SELECT m, code, pos, round(value, 6) AS value FROM (SELECT m, code, unnest(c) AS value, generate_subscripts(c, 1) - 1 AS pos FROM b20)")
def _(spark, d):
    b = baselines.pq_train(vectors(spark, d), PARTS, DIM, sample_rows=None)
    rows = [(m, c, p, float(x)) for (m, c, p), x in np.ndenumerate(b)]
    return spark.createDataFrame(rows, "m long, code long, pos long, value double").withColumn("value", r6(F.col("value")))


@query("pq_scan_grouped", f"WITH {CODES}, {GROUP_QUERIES}, l AS (SELECT label, m, code, list_inner_product(q[m * {WIDTH} + 1 : m * {WIDTH} + {WIDTH}], c) AS x FROM gq, k) SELECT label::BIGINT AS group_id, vec_id, round(sum(x), 6) AS score FROM pc JOIN v USING (vec_id) JOIN l USING (label, m, code) GROUP BY ALL")
def _(spark, d):
    b = books(spark, d)
    lut = baselines.pq_tables(group_queries(spark, d).select(F.col("label").alias("query_id"), "q"), b)
    codes = baselines.pq_encode(vectors(spark, d), b, "label")
    s = baselines.pq_score(F.col("codes"), F.col("lut"))
    return codes.join(lut, F.col("label") == F.col("query_id")).select(F.col("label").cast("long").alias("group_id"), "vec_id", r6(s).alias("score"))


# --- fitted codebook

SAMPLED = codebook_fit.SAMPLE_VALUES // DIM
VALUES = f"w AS (SELECT unnest(y) AS x FROM (SELECT y FROM y ORDER BY (vec_id::HUGEINT * 2654435761) % 4294967296, vec_id LIMIT {SAMPLED}))"


@query("codebook_init_quantiles", f"WITH {y_sql()}, {VALUES}, b AS (SELECT quantile_cont(x, {[(i + 0.5) / 8 for i in range(8)]}) AS b FROM w) SELECT unnest(range(8)) AS pos, round(unnest(b), 6) AS value FROM b")
def _(spark, d):
    found = codebook_fit.start(codebook_fit.coordinates(vectors(spark, d), model(4)), 8)
    rows = [(i, round(x, 6)) for i, x in enumerate(found)]
    return spark.createDataFrame(rows, "pos long, value double")


def _fit_sql(k: int, rounds: int) -> str:
    out = f"{y_sql()}, {VALUES}, f0 AS (SELECT [" + ", ".join(f"quantile_cont(x, {(i + 0.5) / k})" for i in range(k)) + "] AS b FROM w)"
    for r in range(rounds):
        code = " + ".join(f"(x > (b[{i}] + b[{i + 1}]) / 2)::INT" for i in range(1, k))
        out += f""", g{r} AS (SELECT code, avg(x) AS m FROM (SELECT x, {code} AS code FROM w, f{r}) GROUP BY code),
f{r + 1} AS (SELECT list(coalesce(m, b[i + 1]) ORDER BY i) AS b FROM range({k}) x(i) CROSS JOIN f{r} LEFT JOIN g{r} ON code = i)"""
    return out


@query("codebook_fit", f"WITH {_fit_sql(8, 3)} SELECT pos, round(value, 6) AS value FROM (SELECT unnest(b) AS value, generate_subscripts(b, 1) - 1 AS pos FROM f3)")
def _(spark, d):
    found = codebook_fit.coordinates(vectors(spark, d), model(4))
    book = codebook_fit.start(found, 8)
    for _ in range(3):
        book = codebook_fit.update(found, book)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(book)], "pos long, value double")


def fitted_sql(rounds: int) -> str:
    """CTEs up to s: scores by a fitted codebook of 8 centroids."""
    code = " + ".join(f"(x > (b[{i}] + b[{i + 1}]) / 2)::INT" for i in range(1, 8))
    return f"""{_fit_sql(8, rounds)}, c0 AS (SELECT y.*, b, [{code} for x in y] AS codes FROM y, f{rounds}),
c1 AS (SELECT *, [b[c + 1] for c in codes] AS about FROM c0), c2 AS (SELECT *, [y[i] - about[i] for i in range(1, {DIM + 1})] AS rest FROM c1),
c AS (SELECT *, sqrt(list_inner_product(rest, rest)) AS res_norm, [CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END for x in rest]::DOUBLE[] AS sign FROM c2),
q AS (SELECT vec_id AS query_id, [list_inner_product(e, x) for x in m] AS q FROM v, r WHERE {ASKED}),
s AS (SELECT query_id, vec_id, (list_inner_product(q, about) + {model(4).scale!r} * res_norm * list_inner_product(q, sign)) * norm AS score FROM q, c)"""


@query("fitted_index_topk", top_sql(fitted_sql(5)))
def _(spark, d):
    index = stored(spark, build_index(vectors(spark, d), IndexConfig(DIM, 4), fit_codebook=True, rounds=5))
    return with_scores(index.search(some_queries(spark, d), K))


# --- evaluation

KS = evaluate.KS
TRUTH = f"{EXACT}, truth AS (SELECT * FROM (SELECT *, {RANK} FROM s) WHERE rk <= {KS[-1]})"


def eval_sql(found: str) -> str:
    """CTEs truth, found, rec and top from CTEs up to s."""
    found = re.sub(r"\bs AS \(", "fs AS (", found)
    truth = TRUTH[len(V) + 2 :]
    ks = ", ".join(f"({k}::BIGINT)" for k in KS)
    return f"""{found}, {truth}, found AS (SELECT * FROM (SELECT *, {RANK} FROM fs) WHERE rk <= {KS[-1]}), ks(k) AS (VALUES {ks}),
rec AS (SELECT k, avg(r) * 100 AS recall FROM (SELECT k, t.query_id, count(f.vec_id) / k AS r FROM ks JOIN truth t ON t.rk <= k
LEFT JOIN found f ON f.query_id = t.query_id AND f.vec_id = t.vec_id AND f.rk <= k GROUP BY k, t.query_id) GROUP BY k),
top AS (SELECT k, avg(h) * 100 AS top1_in_k FROM (SELECT k, f.query_id, max((f.vec_id = t.vec_id)::INT) AS h FROM ks JOIN found f
ON f.rk <= k JOIN truth t ON t.query_id = f.query_id AND t.rk = 1 GROUP BY k, f.query_id) GROUP BY k)"""


def _found(spark, d, bits: int) -> DataFrame:
    codes = encode.encode(vectors(spark, d), model(bits))
    return search.code_topk(codes, some_queries(spark, d), model(bits), KS[-1])


def _sq_found(spark, d, bits: int) -> DataFrame:
    table, low, high = sq_stored(spark, d, bits)
    return baselines.sq_topk(table, some_queries(spark, d), bits, low, high, KS[-1])


def _pq_found(spark, d, parts: int) -> DataFrame:
    table, b = pq_stored(spark, d, parts)
    return baselines.pq_topk(table, some_queries(spark, d), b, KS[-1])


def _ivf_found(spark, d, centroids: np.ndarray, bits: int) -> DataFrame:
    codes = ivf.encode_lists(vectors(spark, d), centroids, model(bits))
    return ivf.search(codes, some_queries(spark, d), centroids, model(bits), KS[-1], NPROBE)


def _truth(spark, d) -> DataFrame:
    return search.exact_topk(vectors(spark, d), some_queries(spark, d), KS[-1])


@query("recall_at_k", f"WITH {eval_sql(scores_sql(4))} SELECT k, round(recall, 6) AS recall FROM rec")
def _(spark, d):
    return evaluate.set_recall(_found(spark, d, 4), _truth(spark, d)).withColumn("recall", r6(F.col("recall")))


@query("top1_in_k", f"WITH {eval_sql(scores_sql(4))} SELECT k, round(top1_in_k, 6) AS top1_in_k FROM top")
def _(spark, d):
    return evaluate.top1(_found(spark, d, 4), _truth(spark, d)).withColumn("top1_in_k", r6(F.col("top1_in_k")))


@query("topk_intersect", f"WITH {eval_sql(scores_sql(4))} SELECT query_id, vec_id FROM truth WHERE rk <= {K} INTERSECT SELECT query_id, vec_id FROM found WHERE rk <= {K}")
def _(spark, d):
    a = _found(spark, d, 4).where(F.col("rk") <= K).select("query_id", "vec_id")
    return a.intersect(_truth(spark, d).where(F.col("rk") <= K).select("query_id", "vec_id"))


METHODS = {f"sq{b}": sq_scores_sql(b) for b in (2, 4)} | {f"pq{8 * p // DIM}": pq_sql(p) for p in (8, 16)}
METHODS |= {f"tq{b}": scores_sql(b) for b in (2, 4)} | {f"ivf{b}": listed_sql(b) for b in (2, 4)}


@query("recall_summary", " UNION ALL ".join(f"SELECT * FROM (WITH {eval_sql(sql)} SELECT '{name}' AS method, k, round(top1_in_k, 6) AS top1_in_k, round(recall, 6) AS set_recall FROM top JOIN rec USING (k))" for name, sql in METHODS.items()))
def _(spark, d):
    """Scalar codes of 2 and 4 bits, product codes of 1 and 2 bits a dimension, the library's codes of 2 and 4 bits, flat and
    in lists."""
    centroids = trained(spark, d)
    found = {f"sq{b}": _sq_found(spark, d, b) for b in (2, 4)} | {f"pq{8 * p // DIM}": _pq_found(spark, d, p) for p in (8, 16)}
    found |= {f"tq{b}": _found(spark, d, b) for b in (2, 4)} | {f"ivf{b}": _ivf_found(spark, d, centroids, b) for b in (2, 4)}
    found = evaluate.summary(found, written(_truth(spark, d), "truth"))
    return found.withColumns({c: r6(F.col(c)) for c in ("top1_in_k", "set_recall")})


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
