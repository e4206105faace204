"""Exact vector retrieval: the k nearest rows of each query vector, scored as one less the distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import DISTANCES

DEFAULT_TOP_K = 4
#: Bytes of query vectors that go to every task at once; the rest takes further passes.
MAX_BROADCAST_BYTES = 64 << 20
BLOCK = 512  # queries compared at a time


def retrieve(df: DataFrame, query: list[float], k: int = DEFAULT_TOP_K, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", content_col: str | None = "content") -> DataFrame:
    """(id, [content,] score): the k rows nearest to one query vector; null distances come last, ties go by id.

    Plans as one scan and a top-k per task, merged: nothing is shuffled but k rows a task.
    """
    vec = F.array(*[F.lit(float(x)) for x in query])
    names = [F.col(id_col).alias("id")] + ([F.col(content_col).alias("content")] if content_col else [])
    near = df.select(*names, DISTANCES[metric](F.col(vec_col), vec).alias("distance"))
    return near.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k).select(*[c for c in near.columns if c != "distance"], (1.0 - F.col("distance")).alias("score"))


def _exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the rows of q, one by one, summed in order: equal vectors have equal distances. A cosine with
    a zero vector is not a number."""
    dot = lambda a, b: np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))
    if metric == "l2":
        d = x - q
        return np.sqrt(dot(d, d))
    if metric == "inner_product":
        return -dot(x, q)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - dot(x, q) / (np.sqrt(dot(x, x)) * np.sqrt(dot(q, q)))


def _rough(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same for all pairs, fast, within rounding."""
    dot = q @ x.T
    if metric == "inner_product":
        return -dot
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    if metric == "l2":
        return np.sqrt(np.maximum(qq[:, None] + xx[None, :] - 2 * dot, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - dot / np.sqrt(qq[:, None] * xx[None, :])


def _nearest(asked, metric: str, most: int):
    """For each batch of rows and each query the ``most`` nearest rows of the batch, and of those without a distance the first by id."""

    def run(batches):
        queries = asked.value  # length of vector -> (places, matrix); None -> places without a vector
        for batch in batches:
            vectors = batch.column(1)
            length = np.array([-1 if n is None else n for n in pa.compute.list_value_length(vectors).to_pylist()])
            length[[v is not None and None in v for v in vectors.to_pylist()]] = -1
            ids = batch.column(0)
            by_id = np.argsort(pa.compute.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy(), kind="stable") if len(ids) else np.empty(0, np.int64)
            place, row, far = [], [], []

            def add(p: int, rows: np.ndarray, distances: np.ndarray) -> None:
                place.append(np.full(len(rows), p))
                row.append(rows)
                far.append(distances)

            for dim, (places, q) in queries.items():
                near = np.flatnonzero(length == dim) if dim is not None else np.empty(0, np.int64)
                rest = by_id[~np.isin(by_id, near)][:most]
                x = np.array([vectors[int(i)].as_py() for i in near], np.float64).reshape(len(near), dim or 0)
                for at in range(0, len(places), BLOCK):
                    some = q[at : at + BLOCK] if dim is not None else None
                    rough = _rough(metric, x, some) if len(near) else None
                    for j, p in enumerate(places[at : at + BLOCK]):
                        add(p, rest, np.full(len(rest), np.nan))
                        if not len(near):
                            continue
                        # All that could be among the nearest, whatever the rounding; then their distances one by one.
                        d = np.where(np.isnan(rough[j]), np.inf, rough[j])
                        edge = np.partition(d, most - 1)[most - 1] if most < len(d) else np.inf
                        close = np.flatnonzero(d <= edge + 1e-6 * (1 + abs(edge))) if np.isfinite(edge) else np.arange(len(d))
                        exact = _exact(metric, x[close], np.repeat(some[j : j + 1], len(close), axis=0))
                        order = np.lexsort((by_id.argsort()[near[close]], np.where(np.isnan(exact), np.inf, exact)))[: 2 * most]
                        add(p, near[close[order]], exact[order])
            place, row, far = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (place, row, far))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), ids.take(pa.array(row, pa.int64())), pa.array(far, pa.float64(), mask=np.isnan(far.astype(float)))], names=["place", "id", "distance"])

    return run


def retrieve_many(df: DataFrame, queries: DataFrame, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", default_k: int = DEFAULT_TOP_K) -> DataFrame:
    """(query_id, id, score, rank): for each row of ``queries`` (query_id, query_vec, top_k) its nearest rows of ``df``.

    A null top_k is the default. Null distances come last, ties go by id. The queries are a stated set: their vectors go to every
    task in blocks of at most ``MAX_BROADCAST_BYTES``, and one scan compares batches of rows with each block. What leaves a task is
    the nearest few of each batch and query. Empty tables give an empty result.
    """
    spark = df.sparkSession
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("v"), F.coalesce(F.col("top_k"), F.lit(default_k)).cast("int").alias("k"))
    size = asked.agg(F.count("*").alias("n"), F.max("k").alias("most"), F.sum(F.greatest(F.size("v"), F.lit(1)) * 8 + 64).alias("bytes")).first()
    kinds = {"query": dict(asked.dtypes)["query_id"], "id": dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]}
    schema = f"query_id {kinds['query']}, id {kinds['id']}, score double, rank int"
    if not size.n or size.most < 1:
        return spark.createDataFrame([], schema)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    passes = max(1, -(-size.bytes // MAX_BROADCAST_BYTES))
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    out = None
    for b in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b)
        held = part.collect()
        groups: dict = {}
        for at, r in enumerate(held):
            fit = r.v is not None and None not in r.v
            groups.setdefault(len(r.v) if fit else None, []).append(at)
        matrices = {dim: (np.array(at), None if dim is None else np.array([held[i].v for i in at], np.float64).reshape(len(at), dim)) for dim, at in groups.items()}
        names = spark.createDataFrame([(i, r.query_id, r.k) for i, r in enumerate(held)], f"place bigint, query_id {kinds['query']}, k int")
        found = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(matrices), metric, int(size.most)), f"place bigint, id {kinds['id']}, distance double")
        named = found.join(F.broadcast(names), "place")  # as few rows as there are queries in a pass
        top = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(size.most)).where(F.col("rank") <= F.col("k"))
        top = top.select("query_id", "id", (1.0 - F.col("distance")).alias("score"), "rank")
        out = top if out is None else out.unionByName(top)
    return out
