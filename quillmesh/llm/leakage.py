"""Evaluation texts inside a corpus: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of an item is looked for in every document, and each one found is a seed, however rare or
frequent: an edit destroys some n-grams of a copy, and which ones are left can't be told from the corpus.
Each document and item that share a seed are aligned word by word, which scores edited and paraphrased
copies and yields the longest verbatim run. Only pairs whose common words are too few or too far
apart to reach a threshold in any order are passed over. No pair that shares an n-gram is lost, hence no run of ``min_run`` words.

Scale. The items and their n-grams go to every task as long as the n-grams number at most
``MAX_SHARED_GRAMS`` (counted first), and documents are aligned as they are read; more are joined by
shuffle. The work grows with the pairs that share an n-gram, so with boilerplate common to both tables.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.neardup import window_hashes
from quillmesh.session import cut_lineage, spread

MAX_SHARED_GRAMS = 4_000_000  # 8 bytes each

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\((?:[^()\s]|\([^()]*\))*\)")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_HIDDEN = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t>*#|]*(?=[^\W\d_])")
_MARK = re.compile(r"[*~`]+")
_WORD = re.compile(r"[^\W_]+")
_BEYOND_ASCII = re.compile("[^\x00-\x7f]")


def plain_words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, markup, escapes and hidden characters."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
        text = text.replace("\\n", "\n").replace("\\r", " ").replace("\\t", " ")
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = _BROKEN.sub("", _HIDDEN.sub("", text))
    text = _MARK.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _BEYOND_ASCII.sub(lambda m: "" if unicodedata.combining(m[0]) else m[0], unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


def align(item: list[str], doc: list[str], match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int]:
    """(best local alignment score, longest verbatim run), by rows over the item's words."""
    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    d = np.fromiter((code.get(w, -1) for w in doc), np.int32, len(doc))
    n = len(d)
    step = -gap * np.arange(n + 1, dtype=np.int32)
    same = {w: (d == c).astype(np.int32) for w, c in code.items()}
    gain = {w: s * (match - miss) + miss for w, s in same.items()}
    now, score, ahead, best = (np.zeros(n + 1, np.int32) for _ in range(4))
    run, longest, longer = (np.zeros(n + 1, np.int32) for _ in range(3))
    for w in item:
        # From the diagonal or from above, never below nothing; then along the row, a gap a word.
        np.add(score[:-1], gain[w], out=now[1:])
        np.add(score, gap, out=ahead)
        np.maximum(now[1:], ahead[1:], out=now[1:])
        np.maximum(now, 0, out=now)
        now[0] = 0
        np.add(now, step, out=ahead)
        np.maximum.accumulate(ahead, out=ahead)
        np.subtract(ahead, step, out=ahead)
        np.maximum(now, ahead, out=score)
        np.maximum(best, score, out=best)
        np.add(run[:-1], 1, out=longer[1:])
        np.multiply(longer[1:], same[w], out=longer[1:])
        run, longer = longer, run
        np.maximum(longest, run, out=longest)
    return int(best.max(initial=0)), int(longest.max(initial=0))


def _item_grams(n: int, min_run: int):
    def run(batches):
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["item_text"]):
                words = plain_words(text)
                if len(words) >= min_run:
                    out += [(item, g) for g in np.unique(window_hashes(words, n)).tolist()]
            yield pd.DataFrame(out, columns=["item_id", "gram"])

    return run


def _shared(texts: pd.DataFrame, grams: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list[str]]:
    """(sorted n-grams, bounds of each one's owners, owners, item ids, item texts); an owner is a place in the last two."""
    at = pd.Index(texts["item_id"]).get_indexer(grams["item_id"])
    gram = grams["gram"].to_numpy(np.int64)
    order = np.argsort(gram, kind="stable")
    table, first = np.unique(gram[order], return_index=True)
    return table, np.append(first, len(gram)), at[order].astype(np.int32), texts["item_id"].tolist(), texts["item_text"].tolist()


def _bounds(known: np.ndarray) -> np.ndarray:
    """At each place the most that an alignment ending there can score, given which words the other side has: 2 for each of those, -1 for
    each other."""
    total = np.zeros(len(known) + 1, np.int64)
    np.cumsum(3 * known.astype(np.int64) - 1, out=total[1:])
    return total[1:] - np.minimum.accumulate(total[:-1])


def most_score(known: np.ndarray) -> int:
    """No alignment scores more, given which words of one side the other side has."""
    return max(0, int(_bounds(known).max(initial=0)))


def _score(doc_id, words: list[str], present: set[str], item_id, item: list[str], min_run: int, min_share: float):
    """The row of a pair, or nothing if the words that the two have in common are too few, or too far apart.

    Every beginning of a best alignment scores more than nothing, so it lies within a stretch of the document whose bound stays above
    nothing: only those stretches are aligned, and of them only what could beat the best so far or holds a long run.
    """
    own, whole = set(item), 2.0 * len(item)
    of_item = np.fromiter(map(present.__contains__, item), bool, len(item))
    if not _has_run(of_item, min_run) and most_score(of_item) / whole < min_share:
        return []
    known = np.fromiter(map(own.__contains__, words), bool, len(words))
    bound = _bounds(known)
    if bound.max(initial=0) / whole < min_share and not _has_run(known, min_run):
        return []
    edge = np.flatnonzero(np.diff(np.r_[0, bound > 0, 0]))
    spans = sorted(zip(edge[::2].tolist(), edge[1::2].tolist()), key=lambda x: -bound[x[0] : x[1]].max())
    score = run = 0
    for a, b in spans:
        if bound[a:b].max() > score or _has_run(known[a:b], max(min_run, run + 1)):
            s, r = align(item, words[a:b])
            score, run = max(score, s), max(run, r)
    return [(doc_id, item_id, score, score / whole, run)]


def _has_run(known: np.ndarray, length: int) -> bool:
    return b"\x01" * length in known.tobytes()


_SCORED = ["doc_id", "item_id", "score", "share", "longest_run"]


def _screen(shared, n: int, min_run: int, min_share: float):
    def run(batches):
        table, bounds, owners, ids, texts = shared.value
        words_of = lru_cache(4096)(lambda i: plain_words(texts[i]))
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = plain_words(text)
                found = np.unique(window_hashes(words, n))
                if not len(found) or not len(table):
                    continue
                at = np.minimum(np.searchsorted(table, found), len(table) - 1)
                at = at[table[at] == found]
                if len(at):
                    present = set(words)
                    for i in np.unique(np.concatenate([owners[bounds[k] : bounds[k + 1]] for k in at])):
                        out += _score(doc, words, present, ids[i], words_of(int(i)), min_run, min_share)
            yield pd.DataFrame(out, columns=_SCORED)

    return run


def _doc_grams(n: int):
    def run(batches):
        for pdf in batches:
            out = [(doc, np.unique(window_hashes(plain_words(text), n))) for doc, text in zip(pdf["doc_id"], pdf["text"])]
            yield pd.DataFrame(out, columns=["doc_id", "grams"])

    return run


def _aligner(min_run: int, min_share: float):
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                words = plain_words(r.text)
                out += _score(r.doc_id, words, set(words), r.item_id, plain_words(r.item_text), min_run, min_share)
            yield pd.DataFrame(out, columns=_SCORED)

    return run


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 5,
    min_run: int = 12,
    min_share: float = 0.5,
) -> DataFrame:
    """(doc_id, item_id, score, share, longest_run): documents with a verbatim run of ``min_run`` words of an
    item or with an alignment that scores at least ``min_share`` of the item's own score, of all that share
    ``n`` consecutive words with it.

    Rows with a null id or text take no part, nor do items of fewer than ``min_run`` words. An item or
    document given twice counts once; of several texts of an item the smallest counts. Empty tables give an empty result; other columns are ignored.
    """
    if not 1 <= n <= min_run:
        raise ValueError("n must be between 1 and min_run")
    spark = docs.sparkSession
    corpus = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null"))
    held = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where("item_id is not null and item_text is not null")
    held = held.groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    kind = dict(held.dtypes)["item_id"]
    grams = cut_lineage(held.mapInPandas(_item_grams(n, min_run), f"item_id {kind}, gram bigint"))
    doc_kind = dict(corpus.dtypes)["doc_id"]
    schema = f"doc_id {doc_kind}, item_id {kind}, score int, share double, longest_run int"
    if grams.count() <= MAX_SHARED_GRAMS:
        texts = held.join(grams.select("item_id").distinct(), "item_id", "left_semi")
        shared = _shared(texts.toArrow().to_pandas(), grams.toArrow().to_pandas())
        scored = corpus.mapInPandas(_screen(spark.sparkContext.broadcast(shared), n, min_run, min_share), schema)
    else:
        found = corpus.mapInPandas(_doc_grams(n), f"doc_id {doc_kind}, grams array<bigint>").select("doc_id", F.explode("grams").alias("gram"))
        candidates = found.join(grams.hint("merge"), "gram").select("doc_id", "item_id").distinct()
        work = candidates.hint("merge").join(corpus, "doc_id").join(held.hint("merge"), "item_id")
        scored = work.mapInPandas(_aligner(min_run, min_share), schema)
    return scored.where((F.col("longest_run") >= min_run) | (F.col("share") >= min_share)).distinct()
