"""Near-duplicate records: banded minwise signatures, verified sequentially (BayesLSH), then exactly.

Texts become sets of word shingles. Equal sets form one class. Classes that share a signature band are
candidates. A candidate's signatures are compared in batches; after each batch it is dropped as soon as
the posterior probability that its similarity reaches the threshold falls below the miss probability.
Survivors are verified on the sets.

Scale. Texts are read where they lie for the signatures, and shuffled once more for the sets of survivors.
Bands travel as 12 bytes a band and class, packed into one binary for each task and bucket; a batch of tasks
posts a class once, so a group of copies makes no band hot. A band shared by many classes is cut into
tiles, each pair of which is a group of its own. Signatures travel to the candidates in two parts: a short first one,
and the rest to the few that survive it. No side of a join that grows is broadcast.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut_lineage, salt_hot, spread, task_count

WORD = re.compile(r"[^\W_]+")
HOT = 64  # from so many classes on, a band value is worked on in tiles
LOCAL_HOT = 64  # from so many classes of one chunk on, a band value is kept out of its bucket
TILE = 2048  # classes in a tile
CHUNK = 16_384  # classes that a task packs at a time
BUCKET = 1_000_000  # postings in a bucket, as long as there are at most MOST_BUCKETS
MOST_BUCKETS = 65_536
HOT_MARK = -(2**63)  # in a bucket: this band value is hot elsewhere
EXPAND_PART = 2_000  # copies of one class that a task pairs with others


class _Hashes(dict):
    """64-bit hashes of words, kept as long as there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASH_OF = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: list[str], n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, in order."""
    m = len(words) - n + 1
    if m < 1:
        return np.empty(0, np.int64)
    h = np.fromiter(map(HASH_OF.__getitem__, words), np.uint64, len(words))
    x = _mixed(h[:m] + np.uint64(n))
    for j in range(1, n):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j])
    return x.view(np.int64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle of all its words."""
    found = WORD.findall(text.lower())
    return np.unique(window_hashes(found, min(words, len(found)))) if found else np.empty(0, np.int64)


@functools.lru_cache(maxsize=4)
def _mixers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**32, (count, 1), np.uint32) | np.uint32(1), rng.integers(0, 2**32, (count, 1), np.uint32)


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` minwise hashes, of each 16 bits that are even."""
    mul, add = _mixers(count)
    x = shingles.view(np.uint64)
    x = ((x >> np.uint64(32)) ^ x).astype(np.uint32)
    best = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (mul * x[None, at : at + 2048] + add).min(axis=1))
    return (best ^ (best >> np.uint32(16))).astype(np.uint16)


def posterior_table(threshold: float, miss: float, batch: int, total: int) -> list[int]:
    """For each batch end the fewest agreements with which a pair lives on.

    A pair with m of n agreements lives while P(similarity >= threshold | m, n) >= miss, under a
    uniform prior, hence a Beta(m + 1, n - m + 1) posterior.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    least = []
    for n in range(batch, total + 1, batch):
        need = n + 1
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() / density.sum() >= miss:
                need = m
                break
        least.append(need)
    return least


# ---------------------------------------------------------------- sketches

_SKETCH = "doc string, cid bigint, class binary, low binary, high binary"


def class_of(shingles: np.ndarray) -> tuple[int, bytes]:
    """A 64-bit id for candidates and 128 bits that stand for the set."""
    digest = xxhash.xxh128_digest(shingles.tobytes())
    cid = int.from_bytes(digest[:8], "big", signed=True)
    return (cid if cid != HOT_MARK else cid + 1), digest


def _sketch(words: int, count: int):
    """Ids with class and signature, the latter as a plane of low bytes and one of high bytes; in a batch only the
    first of a class has them."""

    def run(batches):
        for batch in batches:
            rows, seen = [], set()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, words)
                if not len(s):
                    continue
                cid, digest = class_of(s)
                if digest in seen:
                    rows.append((doc, cid, digest, None, None))
                else:
                    seen.add(digest)
                    sig = signature(s, count)
                    rows.append((doc, cid, digest, sig.astype(np.uint8).tobytes(), (sig >> 8).astype(np.uint8).tobytes()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["doc", "cid", "class", "low", "high"])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return docs.where(F.col("doc").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))


def sketches(df: DataFrame, id_col: str, text_col: str, *, words: int, count: int) -> DataFrame:
    """A row for each row with words: id, class of equal shingle sets, signature. Checkpointed; holds no text."""
    return cut_lineage(spread(_texts(df, id_col, text_col)).mapInArrow(_sketch(words, count), _SKETCH))


# ---------------------------------------------------------------- bands


def band_keys(low: np.ndarray, high: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the bands, one row a signature."""
    low, high = (x[:, : bands * rows].reshape(len(x), bands, rows) for x in (low, high))
    key = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64)), low.shape[:2])
    for r in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + (low[:, :, r].astype(np.uint64) | high[:, :, r].astype(np.uint64) << np.uint64(8)))
    return key


_PACKED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])


def _packer(bands: int, rows: int, buckets: int):
    def pack(ids: np.ndarray, low: np.ndarray, high: np.ndarray):
        key = band_keys(low, high, bands, rows)
        key = (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)
        owner = np.repeat(ids, bands)
        key = key.ravel()
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        out = []
        # A value that is frequent here leaves a mark in its bucket; its classes go there in groups of their own.
        keep = np.ones(len(key), bool)
        for s, m in zip(start[n >= LOCAL_HOT], n[n >= LOCAL_HOT]):
            keep[s + 1 : s + m] = False
            out.append((int(key[s] >> np.uint64(32)), 1 + int(owner[s]) % 1_000_003, (key[s : s + m] & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner[s : s + m].copy()))
            owner[s] = HOT_MARK
        key, owner = key[keep], owner[keep]
        bucket = (key >> np.uint64(32)).astype(np.int64)
        low32 = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else [0]
        out += [(int(bucket[a]), 0, low32[a:b], owner[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        columns = zip(*((b, p, k.tobytes(), o.tobytes()) for b, p, k, o in out))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK:
                yield pack(*_planes(held))
                held, n = [], 0
        if n:
            yield pack(*_planes(held))

    return run


def _planes(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    ids, at = np.unique(table.column(0).to_numpy(), return_index=True)  # a class once
    return ids, *(np.frombuffer(b"".join(table.column(i).to_pylist()), np.uint8).reshape(table.num_rows, -1)[at] for i in (1, 2))


_MATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.int64())])


def _mates(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of classes with equal band values; of a hot value the classes one by one."""
    bucket, part = key[0].as_py(), key[1].as_py()
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    whole = (np.int64(bucket) << 32) | keys.astype(np.int64)
    if part:
        return pa.Table.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(whole)], schema=_MATES)
    order = np.lexsort((ids, keys))
    keys, ids, whole = keys[order], ids[order], whole[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])] if len(keys) else np.empty(0, bool)
    keys, ids, whole = keys[fresh], ids[fresh], whole[fresh]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.r_[start, len(keys)])
    marked = ids[start] == HOT_MARK
    hot = marked | (n > HOT)
    a, b = [], []
    for m in np.unique(n[~hot & (n > 1)]):
        group = ids[start[~hot & (n == m)][:, None] + np.arange(m)[None, :]]
        i, j = np.triu_indices(m, 1)
        a.append(group[:, i].ravel())  # ids ascend within a value
        b.append(group[:, j].ravel())
    member = np.repeat(hot, n) & (ids != HOT_MARK)
    lone = ids[member]
    a, b = np.concatenate([*a, lone]), np.concatenate([*b, np.zeros(len(lone), np.int64)])
    is_lone = np.arange(len(a)) >= len(a) - len(lone)
    values = np.r_[np.zeros(len(a) - len(lone), np.int64), whole[member]]
    return pa.Table.from_arrays([pa.array(a), pa.array(b, mask=is_lone), pa.array(values, mask=~is_lone)], schema=_MATES)


# ---------------------------------------------------------------- sequential verification


def _agreements(one: pa.Array, two: pa.Array, agree: np.ndarray, least: list[int], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """(places that live, their agreements) after the batches of these parts of the signatures.

    Bytes also agree by chance once in 256, which only raises the number: no pair above the bound is lost.
    """
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(agree), -1) for c in (one, two))
    alive = np.arange(len(agree))
    for i, need in enumerate(least):
        at = slice(i * batch, (i + 1) * batch)
        agree = agree + (x[alive, at] == y[alive, at]).sum(axis=1)
        live = agree >= need
        alive, agree = alive[live], agree[live]
    return alive, agree


def _pruner(least: list[int], batch: int):
    """(a, b, agree, sig_a, sig_b) -> (a, b, agree) of the pairs that live."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                alive, agree = _agreements(t.column(3), t.column(4), t.column(2).to_numpy().astype(np.int64), least, batch)
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(alive)), t.column(1).take(pa.array(alive)), pa.array(agree, pa.int32())], names=["a", "b", "agree"])

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32())])


def _tile_pruner(least: list[int], batch: int):
    """All pairs of two tiles by the first parts of their signatures, row by row of the first tile."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        tile, ids = t.column("tile").to_numpy(), t.column("a").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        one, two = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        left, right, found = [], [], []
        for k, at in enumerate(one):
            rest = one[k + 1 :] if i == j else two
            agree = np.zeros(len(rest), np.int64)
            for b, need in enumerate(least):
                span = slice(b * batch, (b + 1) * batch)
                agree = agree + (sig[rest, span] == sig[at, span]).sum(axis=1)
                live = agree >= need
                rest, agree = rest[live], agree[live]
            left.append(np.full(len(rest), ids[at]))
            right.append(ids[rest])
            found.append(agree)
        a, b, agree = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, found))
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree, pa.int32())], schema=_PAIR)

    return run


def _hot_pairs(members: DataFrame, first: DataFrame, least: list[int], batch: int) -> DataFrame:
    """Pairs within hot band values that live after the first part of the signatures, tile by tile."""
    members = members.select("hot", "a").distinct()
    sized = cut_lineage(members.groupBy("hot").agg(F.count("*").alias("n")))
    salted, repeated = salt_hot(members, sized, ["hot"], "a")
    tiled = salted.join(repeated.hint("merge"), ["hot", "part"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    placed = tiled.join(first.toDF("a", "sig").hint("merge"), "a").select("hot", "a", "tile", "sig", F.explode(mates).alias("at"))
    placed = placed.select("hot", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "a", "tile", "sig")
    return placed.groupBy("hot", "i", "j").applyInArrow(_tile_pruner(least, batch), "a bigint, b bigint, agree int")


def _surviving(made: DataFrame, threshold: float, bands: int, rows: int, miss: float, batch: int) -> DataFrame:
    """(a, b): ids of classes whose signatures leave the threshold possible; checkpointed."""
    posts = made.where("low is not null").select("cid", "low", "high")
    buckets = max(task_count(made.sparkSession) // 2, min(MOST_BUCKETS, made.count() * bands // BUCKET))
    packed = posts.mapInArrow(_packer(bands, rows, buckets), "bucket int, part int, keys binary, ids binary")
    mates = cut_lineage(packed.groupBy("bucket", "part").applyInArrow(_mates, "a bigint, b bigint, hot bigint"))
    least = posterior_table(threshold, miss, batch, bands * rows)
    early = max(1, min(len(least) - 1, 64 // batch))
    by_class = posts.groupBy("cid").agg(F.min("low").alias("low"))
    head = by_class.select("cid", F.substring("low", 1, early * batch).alias("sig"))
    tail = by_class.select("cid", F.substring("low", early * batch + 1, bands * rows).alias("sig"))

    def compared(pairs: DataFrame, part: DataFrame, bounds: list[int]) -> DataFrame:
        sided = pairs.join(part.toDF("a", "sig_a").hint("merge"), "a").join(part.toDF("b", "sig_b").hint("merge"), "b")
        return sided.select("a", "b", "agree", "sig_a", "sig_b").mapInArrow(_pruner(bounds, batch), "a bigint, b bigint, agree int")

    few = mates.where("hot is null").select("a", "b").repartition("a").distinct().withColumn("agree", F.lit(0))
    started = compared(few, head, least[:early])
    hot = mates.where("hot is not null")
    if not hot.isEmpty():
        started = started.unionByName(_hot_pairs(hot, head, least[:early], batch))
    started = cut_lineage(started.dropDuplicates(["a", "b"]))
    return cut_lineage(compared(started, tail, least[early:]).select("a", "b")) if early < len(least) else started.select("a", "b")


def _sets(words: int):
    """Sets of texts whose class is the one wanted."""

    def run(batches):
        for batch in batches:
            rows = []
            for cid, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle_set(text, words)
                if len(s) and class_of(s)[1] == digest:
                    rows.append((cid, digest, s))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64()))], names=["cid", "class", "shingles"])

    return run


def class_links(df: DataFrame, id_col: str, text_col: str, *, threshold: float, words: int, bands: int, rows: int, miss: float, batch: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc, class) for every id, and (class_a, class_b, similarity) of different classes."""
    made = sketches(df, id_col, text_col, words=words, count=bands * rows)
    members = made.groupBy("doc").agg(F.min("class").alias("class"))
    alive = _surviving(made, threshold, bands, rows, miss, batch)
    # A text of each class that takes part in a surviving pair, by its smallest id.
    needed = alive.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    holders = made.join(needed.hint("merge"), "cid", "left_semi").groupBy("cid", "class").agg(F.min("doc").alias("doc"))
    # Repeated rows are merged before they are shuffled: an id given very often would meet in one task.
    texts = holders.hint("merge").join(_texts(df, id_col, text_col).distinct(), "doc")
    sets = texts.select("cid", "class", "text").mapInArrow(_sets(words), "cid bigint, class binary, shingles array<bigint>")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = (
        alive.join(sets.toDF("a", "class_a", "set_a").hint("merge"), "a")
        .join(sets.toDF("b", "class_b", "set_b").hint("merge"), "b")
        .withColumn("shared", shared)
        .select("class_a", "class_b", (F.col("shared") / (F.size("set_a") + F.size("set_b") - F.col("shared"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .dropDuplicates(["class_a", "class_b"])
    )
    return members, links


# ---------------------------------------------------------------- results

OPTIONS = {"threshold": 0.8, "words": 5, "bands": 32, "rows": 5, "miss": 0.001, "batch": 32}


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", **options) -> tuple[DataFrame, DataFrame]:
    """(membership, links). membership: (doc, rep), rep being the smallest id with the same shingle set.

    links: (rep_a, rep_b, similarity) of different classes with Jaccard similarity of at least
    ``threshold``, rep_a smaller. A link is lost if no band agrees, (1 - s^rows)^bands at
    similarity s, or if its posterior falls below ``miss`` on the way.

    Options: threshold, words, bands, rows, miss, batch, as in ``OPTIONS``. Words are runs of letters or
    digits in lower case. Rows with a null id, a null text or a text without words take no part; of several texts under
    one id the one whose set has the smallest hash counts. Empty tables give empty results; other columns are ignored.
    """
    members, links = class_links(df, id_col, text_col, **{**OPTIONS, **options})
    members = cut_lineage(members)
    sized = cut_lineage(members.groupBy("class").agg(F.min("doc").alias("rep"), F.count("*").alias("n")))
    salted, repeated = salt_hot(members, sized, ["class"], "doc")
    membership = salted.join(repeated.hint("merge"), ["class", "part"]).select("doc", "rep")
    named = sized.select("class", "rep").hint("merge")
    ends = links.join(named.toDF("class_a", "x").hint("merge"), "class_a").join(named.toDF("class_b", "y").hint("merge"), "class_b")
    return membership, ends.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "similarity")


def near_duplicate_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", **options) -> DataFrame:
    """(doc_a, doc_b): all pairs of linked documents, copies included, the smaller id first.

    The exact expansion of ``class_links``, whatever the size of a class: members of a class in parts, each pair
    of parts joined by itself, so no class is gathered in one task. The result is as large as the pairs are many; ``near_duplicates``
    and ``duplicate_groups`` give the same links in linear size.
    """
    members, links = class_links(df, id_col, text_col, **{**OPTIONS, **options})
    members = cut_lineage(members)
    sized = cut_lineage(members.groupBy("class").agg(F.count("*").alias("n")))
    placed, repeated = salt_hot(members, sized, ["class"], "doc", per_part=EXPAND_PART)
    parts = repeated.select("class", "part").hint("merge")
    own = sized.where("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    joint = links.select("class_a", "class_b").unionByName(own)
    joint = joint.join(parts.toDF("class_a", "part_a").hint("merge"), "class_a").join(parts.toDF("class_b", "part_b").hint("merge"), "class_b")
    joint = joint.where((F.col("class_a") != F.col("class_b")) | (F.col("part_a") <= F.col("part_b")))
    side = placed.select("class", "part", "doc")
    met = joint.join(side.toDF("class_a", "part_a", "x").hint("merge"), ["class_a", "part_a"]).join(side.toDF("class_b", "part_b", "y").hint("merge"), ["class_b", "part_b"])
    # Within a part each pair of copies meets twice, once in each order.
    met = met.where((F.col("class_a") != F.col("class_b")) | (F.col("part_a") != F.col("part_b")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", **options) -> DataFrame:
    """(doc_id, class_id, n_links): every document with words, its class of equal texts and the number of other classes linked.

    class_id is the smallest id of the class."""
    members, links = class_links(df, id_col, text_col, **{**OPTIONS, **options})
    members = cut_lineage(members)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    sized = members.groupBy("class").agg(F.min("doc").alias("class_id"), F.count("*").alias("n")).join(ends.hint("merge"), "class", "left")
    salted, repeated = salt_hot(members, cut_lineage(sized), ["class"], "doc")
    return salted.join(repeated.hint("merge"), ["class", "part"]).select(F.col("doc").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
