import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quillmesh.llm import leakage as L
from quillmesh.llm import mixing as M
from quillmesh.llm import reading as R

ITEM = "The Wexholm ledger opens Monday with 450 cartons and closes with 89 fewer, none of them lost by Tessaly before lunch."


def brute_run(item, doc):
    a, b = L.plain_words(item), L.plain_words(doc)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def brute_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = [[f"w{x}" for x in rng.integers(0, 6, n)] for n in rng.integers(1, 25, 2)]
        score, run = L.align(a, b)
        assert score == brute_score(a, b)
        assert run == max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(50) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 50)]), default=0)


@pytest.mark.parametrize(
    "text",
    [ITEM.upper(), ITEM.replace(" ", " \n> "), "**" + ITEM.replace("450", "**450**"), f"<em>{ITEM[:30]}</em>{ITEM[30:]}", ITEM.replace(" ", " "), '{"prompt": "' + ITEM.replace(" closes", "\\ncloses") + '"}', ITEM.replace("opens", "open&#115;"), ITEM.replace("lunch", "lu­nch")],
)
def test_disguises(text):
    assert L.plain_words(ITEM) == [w for w in L.plain_words(text) if w != "prompt"]


def test_leaks(spark):
    w = ITEM.split()
    docs = [(1, "before " + ITEM + " after"), (2, " ".join(w[3:15])), (3, " ".join(w[3:14])), (4, None), (5, ""), (6, "nothing"), (7, " ".join([*w[:9], "changed", *w[10:]])), (8, "filler words here. " * 20_000 + ITEM)]
    items = [(10, ITEM), (10, ITEM), (11, "too short"), (12, None), (13, ITEM.split(",")[0] + " and more things are said about it here")]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id bigint, text string, item_id int, gram string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = L.leaked_items(d, e)
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    want = {(i, j) for i, t in docs for j, s in {x for x in items if x[1]} if t and len(L.plain_words(s)) >= 12 and len(t) < 1000 and brute_run(s, t) >= 12}
    assert {k for k, r in found.items() if r.longest_run >= 12 and k[0] != 8} == want
    assert (8, 10) in found and (7, 10) in found and found[(7, 10)].longest_run < 12 and found[(7, 10)].share > 0.8
    assert L.leaked_items(d.limit(0), e).count() == 0 and L.leaked_items(d, e.limit(0)).count() == 0


def test_many_items_are_joined_by_shuffle(spark, monkeypatch):
    d = spark.createDataFrame([(1, "x " + ITEM), (2, "none of it")], "doc_id bigint, text string")
    e = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    want = rows_of(L.leaked_items(d, e), "doc_id", "item_id", "score", "longest_run")
    monkeypatch.setattr(L, "MAX_SHARED_GRAMS", 1)
    assert rows_of(L.leaked_items(d, e), "doc_id", "item_id", "score", "longest_run") == want == [(1, 10, 2 * len(L.plain_words(ITEM)), len(L.plain_words(ITEM)))]


def test_no_pair_above_a_threshold_is_passed_over():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in rng.integers(6, 40, 2)]
        score, run = L.align(a, b)
        want = [(1, 2, score, score / (2.0 * len(a)), run)]
        if run >= 5 or score / (2.0 * len(a)) >= 0.5:
            assert L._score(1, b, set(b), 2, a, 5, 0.5) == want
        assert min(L.most_score(np.isin(b, a)), L.most_score(np.isin(a, b))) >= score


@pytest.mark.parametrize("bound", [L.MAX_SHARED_GRAMS, 1])
def test_an_edited_copy_without_a_verbatim_one_is_aligned(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "MAX_SHARED_GRAMS", bound)
    w = ITEM.split()
    edited = [*w]
    edited[6] = edited[13] = "changed"
    d = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join([*w[:5], *["other"] * 30]))], "doc_id bigint, text string")
    e = spark.createDataFrame([(10, ITEM)], "item_id bigint, text string")
    got = L.leaked_items(d, e).collect()
    assert [(r.doc_id, r.item_id, r.longest_run) for r in got] == [(1, 10, 7)] and got[0].share == (2 * 19 - 2) / 42


def test_only_stretches_that_can_score_are_aligned(monkeypatch):
    """Long documents with several copies: the same as aligning the whole, over far fewer words."""
    seen = []
    plain = L.align
    monkeypatch.setattr(L, "align", lambda a, b: seen.append(len(b)) or plain(a, b))
    item = L.plain_words(ITEM)
    filler = [f"f{i}" for i in range(5000)]
    doc = filler + item[:9] + ["x"] + item[10:] + filler + item[:13] + filler
    (row,) = L._score(1, doc, set(doc), 2, item, 12, 0.5)
    assert row[2:] == (plain(item, doc)[0], plain(item, doc)[0] / (2.0 * len(item)), plain(item, doc)[1]) and sum(seen) < 200


def _corpus(spark):
    rows = [(i, "Big Source" if i < 600 else "small_source" if i < 640 else "untargeted", f"some words of document {i} " * (1 + i % 7)) for i in range(700)]
    rows += [(1000, "big-source", None), (1001, None, "text"), (1002, "big source", "")]
    return spark.createDataFrame([(*r, 0.0, 9) for r in rows], "doc_id bigint, source string, text string, w double, tokens int")


def _targets(spark):
    return spark.createDataFrame([("big_source", 1.2, 1), ("small_source", 0.4, 3), ("absent", 0.4, 2), ("Big_Source", None, None), (None, None, None)], "source string, target_weight double, max_repeats int")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_A_BUCKET", 50)
    docs, targets = _corpus(spark), _targets(spark)
    mixed = M.mix_sources(docs, targets).collect()
    shares = {r.source: r for r in M.mix_shares(docs, targets).collect()}
    assert {r.source for r in mixed} == {"big_source", "small_source"} and len({r.doc_id for r in mixed}) == len(mixed)
    assert shares["big_source"].target_share == pytest.approx(0.6) and shares["absent"].used_tokens == 0
    assert shares["big_source"].actual_share == pytest.approx(0.75, abs=0.02) and shares["small_source"].actual_share == pytest.approx(0.25, abs=0.02)
    small = [r for r in mixed if r.source == "small_source"]
    assert max(r.repeats for r in small) <= 3 and sum(r.tokens * r.repeats for r in small) <= shares["small_source"].budget_tokens
    # Complete epochs first: no document is more than one use ahead of another.
    used = {r.repeats for r in small} | ({0} if len(small) < 40 else set())
    assert max(used) - min(used) <= 1
    again = M.mix_sources(docs, targets).collect()
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, again))
    assert sum(r.tokens * r.repeats for r in M.mix_sources(docs, targets, total_tokens=400).collect()) <= 400
    assert M.mix_sources(docs.limit(0), targets).count() == 0 and M.mix_sources(docs, targets.limit(0)).count() == 0


def test_selection_equals_plain_prefix_sums(spark, monkeypatch):
    """Buckets don't matter: the same documents come out as of one sort by key."""
    docs, targets = _corpus(spark), _targets(spark)
    want = sorted(map(tuple, M.mix_sources(docs, targets, total_tokens=3000).collect()))
    monkeypatch.setattr(M, "ROWS_A_BUCKET", 7)
    assert sorted(map(tuple, M.mix_sources(docs, targets, total_tokens=3000).collect())) == want


def test_a_column_of_weights_and_documents_given_twice(spark):
    docs = spark.createDataFrame([(i, "s", "five words of plain text", 1.0 if i % 2 else 0.05) for i in range(1000)] + [(0, "a", "x", 1.0), (0, "s", "five words of plain text", None)], "doc_id bigint, source string, text string, quality double")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_weight double, max_repeats int")
    got = M.mix_sources(docs, t, total_tokens=1000, quality_col="quality").collect()
    assert 150 < len(got) and sum(r.doc_id % 2 for r in got) > 0.85 * len(got) and 0 not in {r.doc_id for r in got}
    assert [(r.source, r.tokens) for r in M.size_documents(docs, quality_col="quality").where("doc_id = 0").collect()] == [("a", 1)]


def test_weights_count(spark):
    docs = spark.range(2000).select("id", F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, F.lit("plain readable words of good length " * 8)).otherwise(F.lit("#!$ 12 " * 40)).alias("text")).withColumnRenamed("id", "doc_id")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_weight double, max_repeats int")
    got = M.mix_sources(docs, t, total_tokens=20_000).collect()
    assert sum(r.doc_id % 2 == 0 for r in got) > 0.7 * len(got)


PLAIN = "The cat sees the door. The dog runs to the box. We put the key in the box. It is red and big. Now go to the shop. "
WORK = "Before you update the service account, make sure that the release branch contains the right entries. The default value works for the rate limit, although some teams prefer a larger one. "
HARD = "Notwithstanding the epistemological ramifications of institutional accountability, contemporary operationalisations problematise the intermediation infrastructure, whereby methodological considerations transcend ostensibly disinterested instrumentation. "


def test_running_text():
    text = "# Heading here\n\nA sentence of prose.\n```\ncode here\n```\n| a | b |\n2024-01-01 10:00:00 INFO started\n- item text\n> quoted text\nx = 1;"
    got = R.running_text(text).split()
    assert "code" not in got and "INFO" not in got and "Heading" not in got and "b" not in got
    assert "prose." in got and "item" in got and "quoted" in got
    assert R.running_text(None) == "" and R.running_text("") == ""


def test_measures_of_a_batch_equal_those_of_each_sentence():
    rarity = np.linspace(1, 9, R.BUCKETS).astype(np.float32)
    texts = [PLAIN, WORK * 3, HARD + PLAIN, "One. Two words. Although it rains, three more words; then nothing."]
    parsed = [R.parse(R.running_text(t)) for t in texts]
    got = R.measures([m.tobytes() for m, *_ in parsed], [x[1] for x in parsed], [x[2] for x in parsed], np.array([x[3] for x in parsed]), rarity)
    assert got.shape == (4, R.FEATURES)
    for row, t in zip(got, texts):
        sents = [R._WORD.findall(s.lower()) for s in R._SENT.split(R.running_text(t)) if s]
        sents = [s for s in sents if s]
        w = np.array([len(s) for s in sents], float)
        for place, of in ((0, lambda s: np.log(len(s))), (1, lambda s: np.mean([len(x) for x in s])), (4, lambda s: np.mean([rarity[R.bucket(x)] for x in s]))):
            x = np.array([of(s) for s in sents])
            order = np.argsort(x, kind="stable")
            at = np.cumsum(w[order]) / w.sum()
            want = [x[order][min(np.searchsorted(at, q - 1e-12), len(x) - 1)] for q in (0.25, 0.5, 0.75)]
            assert np.allclose(row[3 * place : 3 * place + 3], want)
        assert row[22] == np.log(w.sum()) and np.isclose(row[18], np.average([np.mean([x in R._CONNECTIVES for x in s]) for s in sents], weights=w))


def test_moments_of_few_documents_are_drawn_to_those_of_all():
    at = lambda n: R.shrunken({"all": 1000, "a": n}, {"all": np.zeros(1), "a": np.ones(1)}, {"all": np.ones(1), "a": np.full(1, 2.0)})["a"][0][0]
    assert 0 < at(1) < at(29) < at(30) < at(31) < at(3000) < 1 and at(31) - at(29) < 0.02


def test_levels(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(150):
        level = 1 + i % 3
        part = (PLAIN, WORK, HARD)[level - 1].split(". ")
        body = ". ".join(part[j % len(part)].strip(". ") for j in rng.permutation(len(part) * 8)) + "."
        docs.append((i, body + (" " + HARD if level == 1 and i % 4 == 0 else "")))
        if i < 90:
            labels.append((i, "g", int(rng.integers(1, 4)) if rng.random() < 0.05 else level))
    docs += [(900, None), (901, ""), (902, "too short"), (903, "```\n" + "code " * 100 + "\n```"), (904, PLAIN * 400)]
    labels += [(901, "g", None), (0, "h", 7)]
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id bigint, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, grader string, reading_level int")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(d, lab).collect()}
    assert set(got) == set(range(150)) | {904}
    held = [i for i in range(90, 150)]
    assert np.mean([got[i] == 1 + i % 3 for i in held]) >= 0.95 and got[904] == 1
    assert R.reading_levels(d, lab.limit(0)).count() == 0 and R.reading_levels(d.limit(0), lab).count() == 0
