"""The index as a value: build, search, save, load."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import codebook_fit, ivf, kmeans
from lodestar.operators.encode import encode
from lodestar.operators.model import Model
from lodestar.operators.search import code_topk, rescored


@dataclass(frozen=True)
class IndexConfig:
    dim: int
    bits: int = 4
    nlist: int | None = None  #: None: a flat index
    nprobe: int = 32
    seed: int = 42


@dataclass
class Index:
    config: IndexConfig
    model: Model
    codes: DataFrame
    centroids: np.ndarray | None = None

    def search(
        self, queries: DataFrame, k: int = 10, nprobe: int | None = None, vectors: DataFrame | None = None, wider: int = 4
    ) -> DataFrame:
        """query_id, rk, vec_id, score of the k best rows for each query(query_id, q).

        With ``vectors``(vec_id, embedding) the ``wider`` times k best by code are scored again exactly."""
        n = k if vectors is None else k * wider
        if self.centroids is None:
            found = code_topk(self.codes, queries, self.model, n)
        else:
            found = ivf.search(self.codes, queries, self.centroids, self.model, n, nprobe or self.config.nprobe)
        return found if vectors is None else rescored(found, vectors, queries, k)

    def save(self, path: str) -> None:
        """Three tables: codes (by list_id, if there are lists), centroids, codebook."""
        spark = self.codes.sparkSession
        if self.centroids is None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        else:
            by_list = self.codes.hint("rebalance", "list_id")  # a large list is cut into several files
            by_list.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/codes")
        lists = [] if self.centroids is None else [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        rows = spark.createDataFrame(lists, "list_id long, c array<double>")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        c = self.config
        row = (c.dim, c.bits, self.model.sb, float(self.model.scale), list(map(float, self.model.book)), c.nlist, c.nprobe, c.seed)
        schema = "dim int, bits int, sq_bits int, qjl_scale double, centroids array<double>, nlist int, nprobe int, seed int"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        row = spark.read.parquet(f"{path}/codebook").select("*").first()
        nprobe = 32 if row["nprobe"] is None else row["nprobe"]
        config = IndexConfig(row["dim"], row["bits"], row["nlist"], nprobe, row["seed"])
        model = Model(row["dim"], row["bits"], row["seed"], row["centroids"], row["qjl_scale"])
        centroids = None
        if row["nlist"] is not None:
            lists = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
            centroids = np.array([r["c"] for r in lists], np.float64)
        return cls(config, model, spark.read.parquet(f"{path}/codes"), centroids)


def build_index(vectors: DataFrame, config: IndexConfig, fit_codebook: bool = False, rounds: int = codebook_fit.ITERATIONS) -> Index:
    """An index of vectors(vec_id, embedding). The codebook, if fitted, is fitted once and for all lists."""
    model = Model(config.dim, config.bits, config.seed)
    if fit_codebook:
        model = Model(config.dim, config.bits, config.seed, codebook_fit.fit(vectors, model, rounds))
    if config.nlist is None:
        return Index(config, model, encode(vectors, model))
    centroids = kmeans.train(vectors, config.nlist, seed=config.seed)
    return Index(config, model, ivf.encode_lists(vectors, centroids, model), centroids)


def append(index: Index, vectors: DataFrame) -> Index:
    """An index with further rows; codebook and centroids stay."""
    if index.centroids is None:
        more = encode(vectors, index.model)
    else:
        more = ivf.encode_lists(vectors, index.centroids, index.model).withColumn("list_id", F.col("list_id"))
    return Index(index.config, index.model, index.codes.unionByName(more), index.centroids)
