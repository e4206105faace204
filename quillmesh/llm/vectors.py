"""Most similar vectors for every vector, by a permutation index.

Every distinct vector is described by the order of its nearest pivots. It is posted, with that
order, in the inverted lists of its first few pivots. Within a list, the vectors are ranked by the
Spearman footrule between their truncated orders, the nearest are reranked by exact cosine, and the
lists' answers are merged for each vector.

Scale. The pivots are a bounded sample of the distinct vectors, so dense regions get more of them and
lists stay near ``lists * sqrt(n) / pivots_per_sqrt`` entries wherever the data lie. Exact copies are
collapsed to one vector before they are posted, so a group of copies can't make a list hot. The one
wide shuffle is that of the postings; everything after it moves ids and similarities only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import salt_hot, task_count

MAX_PIVOTS = 16384  # times 64 floats: 4 MB to every task
COPIES_A_PART = 20_000
MOST_WEIGHTS = 1 << 26  # bytes of a list's table of weights
PIVOTS_A_TASK = 8


def usable_vector(vec, dim: int):
    """True for vectors of ``dim`` finite numbers that are not all zero; false, never null, else."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def pivot_count(n: int, per_sqrt: float) -> int:
    return int(max(8, min(MAX_PIVOTS, round(per_sqrt * math.sqrt(max(n, 1))))))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each row the indexes of its nearest pivots, nearest first."""
    length = min(length, len(pivots))
    out = np.empty((len(x), length), np.int32)
    unit = _unit(x).astype(np.float32)
    for at in range(0, len(x), 1024):
        near = unit[at : at + 1024] @ pivots.T
        top = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(length), (len(near), 1))
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[at : at + 1024] = np.take_along_axis(top, order, 1)
    return out


def _poster(pivots, dim: int, length: int, lists: int):
    def post(batches):
        own = pivots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            perm = nearest_pivots(_matrix(batch.column(1), dim), own, length)
            posted = min(lists, perm.shape[1])
            packed = pa.array([r.tobytes() for r in perm.astype(np.int16)], pa.binary())
            rows = pa.array(np.repeat(np.arange(batch.num_rows), posted))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(perm[:, :posted].ravel(), pa.int32()),
                    pa.array(np.tile(np.arange(posted, dtype=np.int32), batch.num_rows)),
                    batch.column(0).take(rows),
                    packed.take(rows),
                    batch.column(1).take(rows),
                ],
                names=["pivot", "place", "members", "perm", "vec"],
            )

    return post


_ANSWER = pa.schema([("node", pa.string()), ("similarity", pa.float64()), ("members", pa.list_(pa.string()))])


def _searcher(dim: int, k: int, candidates: int, least: float | None):
    def search(posted: pa.Table) -> pa.Table:
        n = posted.num_rows
        raw = _matrix(posted.column("vec"), dim)
        exact = _unit(raw)
        unit = exact.astype(np.float32)
        perm = np.frombuffer(b"".join(posted.column("perm").to_pylist()), np.int16).reshape(n, -1)
        length = perm.shape[1]
        members = posted.column("members").combine_chunks()
        first = np.array([m[0] for m in members.to_pylist()], object)
        place = posted.column("place").to_numpy()
        by_id = np.empty(n, np.int64)
        by_id[np.argsort(first, kind="stable")] = np.arange(n)
        local, at = np.unique(perm, return_inverse=True)
        at = at.reshape(n, length).astype(np.int32)

        def weights(wanted: np.ndarray) -> np.ndarray:
            """A row for each wanted pivot: how near it is to every vector, 0 where it is none of its nearest."""
            row_of = np.full(len(local), -1, np.int32)
            row_of[wanted] = np.arange(len(wanted))
            out = np.zeros((len(wanted), n), np.int8)
            for i in range(length):
                row = row_of[at[:, i]]
                has = np.flatnonzero(row >= 0)
                out[row[has], has] = length - i
            return out

        # All pivots at once if that is little; of a long list only those of a block of its vectors.
        whole = len(local) * n <= MOST_WEIGHTS
        weight, place_of = (weights(np.arange(len(local))), np.arange(len(local))) if whole else (None, np.empty(len(local), np.int64))
        asks, gets, sims = [], [], []
        step = max(16, min(512, 4_000_000 // max(n, 1)))
        for lo in range(0, n if n > 1 else 0, step):
            hi = min(n, lo + step)
            # Shared weight; the footrule is a constant less twice this, so most shared is nearest.
            if not whole:
                wanted = np.unique(at[lo:hi])
                weight = weights(wanted)
                place_of[wanted] = np.arange(len(wanted))
            shared = np.zeros((hi - lo, n), np.int16 if length > 15 else np.int8)
            for i in range(length):
                shared += np.minimum(weight[place_of[at[lo:hi, i]]], np.int8(length - i))
            own = np.arange(lo, hi)
            shared[own - lo, own] = -1
            keep = shared >= 0
            if n - 1 > candidates:
                keep &= shared >= np.partition(shared, n - candidates, axis=1)[:, n - candidates][:, None]
            near = unit[lo:hi] @ unit.T
            near[~keep] = -2
            floor = np.partition(near, n - k, axis=1)[:, n - k] - 4e-6 if n - 1 > k else np.full(hi - lo, -1.5, np.float32)
            if least is not None:
                floor = np.maximum(floor, least - 1e-5)
            q, c = np.nonzero(near >= floor[:, None])
            asks.append(q + lo)
            gets.append(c)
            sims.append(np.round(np.einsum("ij,ij->i", exact[q + lo], exact[c]), 6))
        ask, get, sim = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((asks, np.int64), (gets, np.int64), (sims, np.float64)))
        order = np.lexsort((by_id[get], -sim, ask))
        ask, get, sim = ask[order], get[order], sim[order]
        start = np.r_[0, np.flatnonzero(np.diff(ask)) + 1] if len(ask) else np.empty(0, np.int64)
        rank = np.arange(len(ask)) - np.repeat(start, np.diff(np.r_[start, len(ask)])) if len(ask) else ask
        good = rank < k
        if least is not None:
            good &= sim >= least
        # A group of copies answers itself, once: in the list of its nearest pivot.
        alone = np.flatnonzero((place == 0) & (pa.compute.list_value_length(members).to_numpy(zero_copy_only=False) > 1))
        ask, get, sim = np.r_[ask[good], alone], np.r_[get[good], alone], np.r_[sim[good], np.ones(len(alone))]
        return pa.Table.from_arrays([pa.array(first[ask], pa.string()), pa.array(sim, pa.float64()), members.take(pa.array(get))], schema=_ANSWER)

    return search


def similar_vectors(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    *,
    k: int = 5,
    dim: int = 64,
    min_similarity: float | None = None,
    pivots_per_sqrt: float = 1.0,
    lists: int = 4,
    perm_length: int = 12,
    candidates: int = 96,
) -> DataFrame:
    """(id, neighbour, similarity): for every id its ``k`` most similar other ids.

    Similarity is the cosine rounded to six decimals; ties go to the smaller id. With
    ``min_similarity`` only neighbours at least that similar come out.

    Index sample: at most ``min(MAX_PIVOTS, pivots_per_sqrt * sqrt(rows))`` distinct vectors, taken by
    hash, serve as pivots; all vectors are indexed. ``candidates`` is how many vectors of one list are
    reranked for each query of that list (ties of the footrule beyond it included).

    Rows whose id is null or whose vector is null, of another length, all zero or not finite take no
    part. Repeated rows of an id count once. An empty table gives an empty result. Other columns of
    ``df``, whatever their names, are ignored.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    base = base.where(F.col("id").isNotNull() & usable_vector(F.col("vec"), dim))
    base = base.select(F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"), "id", "vec")

    wanted = pivot_count(n := df.count(), pivots_per_sqrt)
    rate, pivots = min(1.0, 4 * wanted / max(n, 1)), []
    while True:
        sample = base.where(F.pmod(F.xxhash64("h1", F.lit(11)), F.lit(1_000_000)) < int(rate * 1_000_000) + 1)
        chosen = sample.groupBy("h1", "h2").agg(F.first("vec").alias("vec")).orderBy(F.xxhash64("h1", F.lit(13)), "h2").limit(wanted)
        pivots = [r.vec for r in chosen.select("vec").collect()]
        if len(pivots) == wanted or rate == 1.0:
            break
        rate = min(1.0, 8 * rate)  # most rows are copies: few distinct vectors were in the sample
    if not pivots:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    shared = spark.sparkContext.broadcast(_unit(np.array(pivots, np.float32)).astype(np.float32))

    # The k + 1 smallest ids of each group of equal vectors; ranks are cut before the shuffle.
    by_id = Window.partitionBy("h1", "h2").orderBy("id")
    least_ids = base.withColumn("rk", F.dense_rank().over(by_id)).where(F.col("rk") <= k + 1)
    groups = least_ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("members"), F.first("vec").alias("vec"))

    posted = groups.select("members", "vec").mapInArrow(
        _poster(shared, dim, perm_length, lists), "pivot int, place int, members array<string>, perm binary, vec array<float>"
    )
    # Lists differ in length: few of them a task, so that no task has much more than its share.
    listed = posted.repartition(max(task_count(spark), len(pivots) // PIVOTS_A_TASK), "pivot")
    answers = listed.groupBy("pivot").applyInArrow(_searcher(dim, k, candidates, min_similarity), "node string, similarity double, members array<string>")
    best = (
        answers.groupBy("node")
        .agg(F.collect_set(F.struct((-F.col("similarity")).alias("far"), "members")).alias("near"))
        .select(
            "node",
            F.slice(
                F.array_distinct(F.array_sort(F.flatten(F.transform("near", lambda s: F.transform(s.members, lambda m: F.struct(s.far.alias("far"), m.alias("id"))))))),
                1,
                k + 1,
            ).alias("near"),
        )
    )
    # All ids of groups of copies, light columns only. A large group is split before it is joined: each part of it meets its node,
    # and then the answer of that node.
    light = base.select("h1", "h2", "id")
    copies = light.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.max("id").alias("last"), F.count("*").alias("n")).where(F.col("node") < F.col("last"))
    placed, by_part = salt_hot(light, copies.select("h1", "h2", "node", "n"), ["h1", "h2"], "id", per_part=COPIES_A_PART, total=n)
    every = placed.join(by_part.hint("merge"), ["h1", "h2", "part"]).select("node", "part", F.col("id").alias("copy")).distinct()
    asked = best.join(by_part.select("node", "part").hint("merge"), "node", "left")
    return (
        asked.join(every.hint("merge"), ["node", "part"], "left")
        .withColumn("id", F.coalesce("copy", "node"))
        .select("id", F.explode(F.slice(F.filter("near", lambda s: s.id != F.col("id")), 1, k)).alias("s"))
        .select("id", F.col("s.id").alias("neighbour"), (-F.col("s.far")).alias("similarity"))
    )


def similar_pairs(df: DataFrame, min_similarity: float = 0.85, **options) -> DataFrame:
    """(id_a, id_b): unordered pairs of which one is among the most similar of the other."""
    near = similar_vectors(df, min_similarity=min_similarity, **options)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
