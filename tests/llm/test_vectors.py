import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import vectors as V

SCHEMA = "id string, embedding array<float>, neighbour string, members int"


def brute(rows, k):
    ids = sorted({i for i, v, *_ in rows})
    by = {i: v for i, v, *_ in rows}
    x = np.array([by[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for a in range(len(ids)):
        near = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out |= {(ids[a], b, -d) for d, b in near}
    return out


def clustered(n, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, dim))
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim)) * 0.25
    return [(f"d{i:05d}", [float(np.float32(y)) for y in v], "x", 1) for i, v in enumerate(x)]


def test_small_tables_are_exact(spark):
    rows = clustered(40)
    rows += [("e1", rows[0][1], "", 0), ("e0", rows[0][1], "", 0), ("e0", rows[0][1], "", 0)]  # copies and a repeated row
    rows += [("half", [x * 0.5 for x in rows[0][1]], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.neighbour, r.similarity) for r in V.similar_vectors(df, lists=64, candidates=1000).collect()}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in brute(rows, 5)}


def test_unusable_rows_take_no_part(spark):
    bad = [("a", None), ("b", []), ("c", [0.0] * 64), ("d", [1.0] * 63), ("e", [float("nan")] * 64), ("f", [1.0] * 63 + [None]), (None, [1.0] * 64)]
    df = spark.createDataFrame(bad, "id string, embedding array<float>")
    assert V.similar_vectors(df).count() == 0
    assert V.similar_vectors(df.limit(0)).count() == 0
    one = df.unionByName(spark.createDataFrame([("g", [1.0] * 64)], "id string, embedding array<float>"))
    assert V.similar_vectors(one).count() == 0
    two = one.unionByName(spark.createDataFrame([("h", [2.0] * 64)], "id string, embedding array<float>"))
    assert {(r.id, r.neighbour, r.similarity) for r in V.similar_vectors(two).collect()} == {("g", "h", 1.0), ("h", "g", 1.0)}


def test_a_large_group_of_copies_stays_linear(spark):
    v, w = [1.0] * 64, [1.0] * 63 + [0.9]
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("id"), F.array(*[F.lit(float(x)) for x in v]).cast("array<float>").alias("embedding"))
    df = df.unionByName(spark.createDataFrame([("a", w)], "id string, embedding array<float>"))
    got = V.similar_vectors(df).groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect()
    near = {r.id: r.n for r in got}
    assert len(near) == 3001
    assert near["c00007"] == [f"c{i:05d}" for i in range(5)] and near["c00002"] == [f"c{i:05d}" for i in (0, 1, 3, 4, 5)]
    assert near["a"] == [f"c{i:05d}" for i in range(5)]


def test_recall_against_brute_force(spark):
    rows = clustered(6000)
    got = {(r.id, r.neighbour) for r in V.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(a, b) for a, b, s in brute(rows, 5) if s >= 0.8}
    assert len(want & got) / len(want) >= 0.97


def test_pairs_have_the_smaller_first(spark):
    rows = clustered(500)
    got = V.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(r.id_a < r.id_b for r in got) and len({(r.id_a, r.id_b) for r in got}) == len(got)


def test_split_copies_and_blocks_of_weights_change_nothing(spark, monkeypatch):
    rows = clustered(600) + [(f"z{i:04d}", [1.0] * 64, "", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in V.similar_vectors(df).collect()}
    monkeypatch.setattr(V, "COPIES_A_PART", 50)
    monkeypatch.setattr(V, "MOST_WEIGHTS", 1)
    assert {tuple(r) for r in V.similar_vectors(df).collect()} == want and sum(r[0].startswith("z") for r in want) == 5 * 400
