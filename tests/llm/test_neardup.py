import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quillmesh.llm import neardup as N

SMALL = {"threshold": 0.5, "words": 3, "bands": 80, "rows": 4}


def brute(docs, words, threshold):
    sets = {}
    for i, t in docs:
        s = set(N.shingle_set(t, words).tolist()) if t else set()
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def edited(n=120, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((f"d{i:03d}", " ".join(w)))
        else:
            docs.append((f"d{i:03d}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 120)))))
    return docs


@pytest.mark.parametrize("options", [SMALL, {}])
def test_pairs_equal_brute_force(spark, options):
    docs = edited()
    df = spark.createDataFrame([(i, t, "rep", "sig") for i, t in docs], "doc_id string, content string, rep string, doc string")
    got = set(rows_of(N.near_duplicate_pairs(df, **options), "doc_a", "doc_b"))
    want = brute(docs, options.get("words", 5), options.get("threshold", 0.8))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_odd_texts(spark):
    docs = [("a", None), ("b", ""), ("c", " \n"), ("d", "..."), ("e", "word"), ("f", "Word!"), ("g", "two words"), (None, "two words"), ("h", "x " * 60_000), ("i", "x " * 60_000), ("e", "word")]
    df = spark.createDataFrame(docs, "doc_id string, content string")
    assert rows_of(N.near_duplicate_pairs(df, **SMALL), "doc_a", "doc_b") == [("e", "f"), ("h", "i")]
    assert N.near_duplicate_pairs(df.limit(0), **SMALL).count() == 0
    assert rows_of(N.duplicate_groups(df, **SMALL), "doc_id", "class_id", "n_links") == [("e", "e", 0), ("f", "e", 0), ("g", "g", 0), ("h", "h", 0), ("i", "h", 0)]


@pytest.mark.parametrize("n", [64, 65, 600])
def test_one_form_whatever_the_size_of_a_class(spark, monkeypatch, n):
    """All pairs of copies and all links of each copy, also when a class is expanded in several parts."""
    monkeypatch.setattr(N, "EXPAND_PART", 100)
    text = " ".join(f"w{i}" for i in range(50))
    same = spark.range(n).select(F.format_string("c%04d", "id").alias("doc_id"), F.lit(text).alias("content"))
    near = spark.createDataFrame([("z", text + " more")], "doc_id string, content string")
    both = same.unionByName(near)
    got = rows_of(N.near_duplicate_pairs(both, **SMALL), "doc_a", "doc_b")
    assert len(got) == len(set(got)) == n * (n - 1) // 2 + n and all(a < b for a, b in got)
    assert rows_of(N.duplicate_groups(both, **SMALL), "doc_id", "class_id", "n_links") == [*((f"c{i:04d}", "c0000", 1) for i in range(n)), ("z", "z", 1)]
    membership, links = N.near_duplicates(both, **SMALL)
    assert rows_of(links, "rep_a", "rep_b") == [("c0000", "z")] and membership.where("rep = 'c0000'").count() == n


@pytest.mark.parametrize("local", [N.LOCAL_HOT, 10_000])
def test_a_hot_band_is_tiled(spark, monkeypatch, local):
    """More classes in one band than a tile holds, seen as hot by the task or only in the bucket: every link is still found."""
    monkeypatch.setattr(N, "TILE", 100)
    monkeypatch.setattr(N, "LOCAL_HOT", local)
    n = 160
    base = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:04d}", " ".join([*base, f"tail{i}"])) for i in range(n)]
    got = N.near_duplicate_pairs(spark.createDataFrame(docs, "doc_id string, content string"), **SMALL).count()
    assert got == n * (n - 1) // 2


def test_mates_of_marked_and_frequent_values():
    """A value marked as hot by one task gives its classes of all tasks, none is paired twice or lost."""
    count, ids = 20, np.arange(300, dtype=np.int64)
    low = np.tile(np.arange(count, dtype=np.uint8), (300, 1))
    low[:, 4:] = np.random.default_rng(1).integers(0, 256, (300, count - 4))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in low]), pa.array([r.tobytes() for r in low])], names=["cid", "low", "high"])
    packed = pa.Table.from_batches([*N._packer(5, 4, 3)([batch]), *N._packer(5, 4, 3)([batch.slice(0, 10)])])
    hot = []
    for b, p in {(r["bucket"], r["part"]) for r in packed.to_pylist()}:
        group = packed.filter(pa.compute.and_(pa.compute.equal(packed["bucket"], b), pa.compute.equal(packed["part"], p)))
        hot += [r["a"] for r in N._mates((pa.scalar(b), pa.scalar(p)), group).to_pylist() if r["hot"] is not None]
    assert sorted(set(hot)) == list(range(300))


def test_posterior_bounds_prune_and_keep():
    least = N.posterior_table(0.5, 0.001, 32, 128)
    assert least == sorted(least) and 0 < least[0] < 16 and least[-1] < 64


def test_a_pair_with_just_the_agreements_needed_lives_on():
    least = [20, 40]
    a = np.zeros(64, np.uint8)
    b = a.copy()
    b[20:32] = b[52:64] = 1
    pair = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([0]), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b", "agree", "sig_a", "sig_b"])
    assert [t.to_pydict() for t in N._pruner(least, 32)([pair])] == [{"a": [1], "b": [2], "agree": [40]}]
    tile = pa.table({"hot": [0, 0], "i": [0, 0], "j": [0, 0], "a": [2, 1], "tile": [0, 0], "sig": [a.tobytes(), b.tobytes()]})
    assert N._tile_pruner(least, 32)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), tile).to_pydict() == {"a": [1], "b": [2], "agree": [40]}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.5, 0.8):
        both = rng.integers(-(2**63), 2**63, 2000)
        cut = int(2000 * (1 - share) / 2)
        a, b = np.sort(both[cut:]), np.sort(both[: 2000 - cut])
        got = np.mean(N.signature(a, 2000) == N.signature(b, 2000))
        assert abs(got - share) < 0.05
