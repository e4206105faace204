"""Texts cut off before the writer's end: hidden length limits, then endings.

Lengths. Each text's length is computed as characters, UTF-8 bytes and UTF-16 units, and the same again
after entity escaping, JSON escaping and newline conversion. Grouped by source, measure and length, a
storage limit shows as a length that is far more frequent than its neighbours. One limit shows in
several measures, and a source can have several limits: the length with most texts is a limit
and explains its texts, then the length with most of the others, as long as one is far more frequent.

Endings. What was appended after a cut (ellipses, closing tags, broken entities, replacement characters)
is taken off. An open code fence, an open bracket or separator, or a half list mark is a cut. An end
without punctuation is a cut if it lies on a limit of its source. Else it is judged by the corpus: a last list item is
whole if its end is that of list items which other lines follow; a last line of prose is whole if it is a closing phrase,
one that recurs at the end of unrelated texts and is the beginning of no other sentence; a lone line of few words is whole
unless other sentences begin with it inside their last word only.

Scale. Two passes over the texts. The first reads lengths and endings. The second teaches: of the beginnings of all
sentences only those leave a task that a filter of the open ends lets through, a bitmap of at most 16 MB. Lengths are
counted by the vector of all measures, of which there are far fewer than texts. No texts are shuffled for it, nor gathered
by source, and joins on lengths and closing phrases are salted.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.neardup import HASH_OF
from quillmesh.session import cut_lineage, salt_hot, spread

MOST_FILTER_BITS = 1 << 27
SHORT = 5  # words of a lone line that may be a short answer

_APPENDED = re.compile(
    r"(?:\s|[​‌‍⁠﻿]|</?[a-zA-Z][^<>]{0,40}>?|…|\.\.\.+|[\[(]\s*(?:…|\.{3}|truncated|cut off|cut|continued|more|snip|cont\.?|truncado|cortado|contin[uú]a|continua)\s*[\])]|�+|&(?:#?\w{0,8});?)+$",
    re.I,
)
_MARKER = re.compile(r"</?[a-zA-Z]|…|\.\.\.|[\[(]\s*(?:…|\.{3}|trunc|cut|cont|more|snip|cortad)|�|&(?:#?\w{0,8});?", re.I)
_FENCE = re.compile(r"^[ \t>]*(```|~~~)", re.M)
_ITEM = re.compile(r"^[ \t>]*(?:[-*+•–]|\d{1,3}[.)]|[a-zA-Z][.)])[ \t]+(.*)$")
_ITEM_MARK = re.compile(r"^[ \t>]*(?:[-*+•–]|\d{1,3}[.)])[ \t]*$")
_CLOSED = re.compile(r"[.!?。‽][\"'”’»)\]*_~`]*$")
_EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿⭐️☺]$")
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|\n+")
_OPEN_END = re.compile(r"[,;:(\[{<“«\-–—/&=+]$")
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")

_HALF, _PHRASE, _CHAIN, _FULL, _ITEM_END, _ITEM_FORM, _CLOSING = (xxhash.xxh64_intdigest(k) for k in ("half", "phrase", "chain", "full", "item end", "item form", "closing"))
_MASK = 2**64 - 1


def _next(chain: int, word: str) -> int:
    return (chain * 0x9E3779B97F4A7C15 + HASH_OF[word]) & _MASK


def _key(kind: int, chain: int) -> int:
    x = (chain ^ kind) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 29)) - 2**63


def _chain(words: list[str]) -> int:
    c = 0
    for w in words:
        c = _next(c, w)
    return c


def _words(s: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", s.lower()))


def _half_key(words: list[str]) -> int:
    """What a sentence that goes on would show of itself: all words but the last, and four letters of that."""
    return _key(_HALF, _next(_chain(words[:-1]), words[-1][:4]))


def _item_keys(words: list[str]) -> list[int]:
    return [_key(_ITEM_END, _chain(words[-2:] if len(words) > 2 else words[-1:])), _key(_ITEM_FORM, _next(min(len(words), 12), words[0]))]


def _core(text: str) -> tuple[str, bool]:
    """(text without what was appended after a cut, whether that tells of a cut)."""
    tail = _APPENDED.search(text)
    return (text[: tail.start()], bool(_MARKER.search(tail.group()))) if tail else (text, False)


def read_ending(text: str | None) -> tuple[str, list[int], int | None, list[int]]:
    """(state, keys of an open end, key of an end without punctuation, keys of the beginnings of that end).

    States: blank, whole, cut, item (open list item), prose (open line of prose), short (a lone line of few words).
    """
    if text is None or not text.strip():
        return "blank", [], None, []
    core, marked = _core(text)
    if not core.strip():
        return "whole", [], None, []
    if len(_FENCE.findall(core)) % 2:
        return "cut", [], None, []
    last = core.rsplit("\n", 1)[-1]
    if _FENCE.match(last) and last.strip(" \t>`~") == "":
        return "whole", [], None, []
    if _ITEM_MARK.match(last):
        return "cut", [], None, []
    if _CLOSED.search(core) or _EMOJI.search(core):
        return "whole", [], None, []
    if _OPEN_END.search(core) or marked:
        return "cut", [], None, []
    if m := _ITEM.match(last):
        w = _words(m[1])
        return ("item", _item_keys(w), None, []) if w else ("cut", [], None, [])
    parts = [p for p in _SPLIT.split(core) if p and p.strip()]
    w = _words(parts[-1])
    if not w:
        return "whole", [], None, []
    closing = _key(_CLOSING, _chain(w))
    chains = [_key(_CHAIN, _chain(w[:i])) for i in range(1, len(w))]
    if len(parts) == 1 and len(w) <= SHORT:
        return "short", [_half_key(w), _key(_FULL, _chain(w))], closing, chains
    return "prose", [_half_key(w), _key(_PHRASE, _chain(w))], closing, chains


def taught(text: str | None, asked) -> set[int]:
    """Keys that a text teaches, of those that ``asked`` lets through: ends and forms of list items that go on, beginnings of sentences."""
    if text is None or not text.strip():
        return set()
    core, _ = _core(text)
    out: set[int] = set()
    if not core.strip() or len(_FENCE.findall(core)) % 2:
        return out
    lines = core.split("\n")
    fenced = False
    for n, line in enumerate(lines):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line.strip():
            continue
        final = n == len(lines) - 1
        if m := _ITEM.match(line):
            if not final and (w := _words(m[1])):
                out.update(k for k in [*_item_keys(w), _key(_ITEM_END, _chain(w[-1:]))] if asked(k))
            continue
        parts = [p for p in _SPLIT.split(line) if p and p.strip()]
        for i, p in enumerate(parts):
            w = _words(p)
            open_end = final and i == len(parts) - 1 and not _CLOSED.search(p.rstrip())
            chain = 0
            for at, word in enumerate(w):
                if not open_end:
                    for k in range(1, 1 + min(4, len(word))):
                        if asked(key := _key(_HALF, _next(chain, word[:k]))):
                            out.add(key)
                elif at and asked(key := _key(_PHRASE, chain)):
                    out.add(key)
                chain = _next(chain, word)
                if not open_end and asked(key := _key(_FULL, chain)):
                    out.add(key)
                # No open end begins like this: nothing is to be taught by what follows.
                if not asked(_key(_CHAIN, chain)) and not (open_end and asked(_key(_PHRASE, chain))):
                    break
    return out


ENDING = "state string, open array<bigint>, closing bigint, chains array<bigint>"


def ending_columns(texts) -> dict:
    """The columns of ``ENDING`` for a series of texts."""
    out = [read_ending(t) for t in texts]
    return {"state": [x[0] for x in out], "open": [x[1] for x in out], "closing": pd.array([x[2] for x in out], "Int64"), "chains": [x[3] for x in out]}


def _parse(batches):
    for pdf in batches:
        yield pd.DataFrame({"rid": pdf["rid"], "source": pdf["source"], "context": pdf["context"], "lengths": pdf["lengths"], "text_key": pdf["text_key"], **ending_columns(pdf["text"])})


def _teach(bits: bytes, size: int):
    def run(batches):
        own = bits.value
        mask = size - 1

        def asked(key: int) -> bool:
            at = key & mask
            return bool(own[at >> 3] >> (at & 7) & 1)

        for pdf in batches:
            keys: set[int] = set()
            for t in pdf["text"]:
                keys |= taught(t, asked)
            yield pd.DataFrame({"key": list(keys)}, dtype="int64")

    return run


def asked_filter(keys: DataFrame) -> tuple[bytes, int]:
    """A bitmap over the column ``key``, and its size in bits: 16 to 32 bits a key, at most ``MOST_FILTER_BITS`` (16 MB). Fuller
    filters let more through, which changes no result."""
    n = keys.count()
    size = 1 << 15
    while size < min(16 * n, MOST_FILTER_BITS):
        size *= 2
    at = keys.select((F.pmod("key", F.lit(size)) + 1).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in blocks:
        out[(r.block - 1) * 4096 : r.block * 4096] = r.bits
    return bytes(out), size


MEASURES = ("chars", "utf8_bytes", "utf16_units", "entity_chars", "entity_bytes", "entity_quote_chars", "json_chars", "json_bytes", "json_ascii", "crlf_chars", "crlf_bytes")


def length_measures(text):
    """Array of lengths of a text column, in the order of ``MEASURES``."""
    count = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))
    chars, byte, units = F.length(text), F.octet_length(text), (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    amp, angle, quote, apostrophe, slash, newline = count("&"), count("<") + count(">"), count('"'), count("'"), count("\\"), count("\n")
    control = newline + count("\r") + count("\t")
    entity = 4 * amp + 3 * angle
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    of = {
        "chars": chars,
        "utf8_bytes": byte,
        "utf16_units": units,
        "entity_chars": chars + entity + 5 * quote,
        "entity_bytes": byte + entity,
        "entity_quote_chars": chars + entity + 5 * quote + 5 * apostrophe,
        "json_chars": chars + quote + slash + control,
        "json_bytes": byte + quote + slash + control,
        "json_ascii": chars + quote + slash + control + 5 * wide + 6 * (units - chars),
        "crlf_chars": chars + newline,
        "crlf_bytes": byte + newline,
    }
    return F.array(*[of[k].cast("int") for k in MEASURES])


def _limits(least: int, times: float):
    """Of one source: the frequent lengths that explain most texts not explained yet, one after another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        on: dict[tuple, list[int]] = {}
        about: dict[tuple, tuple[int, float]] = {}
        for i, lengths in enumerate(pdf["lengths"]):
            for x in lengths:
                key = (x["measure"], int(x["length"]))
                on.setdefault(key, []).append(i)
                about[key] = (int(x["n"]), float(x["expected"]))
        left = pdf["texts"].to_numpy(copy=True)
        rows: list[tuple] = []
        while on:
            now = {k: int(left[i].sum()) for k, i in on.items()}
            on = {k: i for k, i in on.items() if now[k] >= max(least, times * about[k][1])}
            if on:
                key = min(on, key=lambda k: (-now[k], *k))
                left[on.pop(key)] = 0
                rows.append((pdf["source"].iloc[0], *key, *about[key]))
        return pd.DataFrame(rows, columns=["source", "measure", "length_limit", "n_texts", "expected"])

    return run


def _each(vectors: DataFrame) -> DataFrame:
    """(source, lengths, n, measure, length): a row for each measure of each vector of lengths."""
    named = F.array(*[F.lit(m) for m in MEASURES])
    return vectors.select("source", "lengths", "n", F.posexplode("lengths").alias("at", "length")).withColumn("measure", F.get(named, F.col("at"))).drop("at")


def _found_limits(vectors: DataFrame, least: int, times: float, around: int) -> DataFrame:
    each = _each(vectors)
    counts = each.groupBy("source", "measure", "length").agg(F.sum("n").alias("n"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-around, around)
    spikes = counts.withColumn("expected", (F.sum("n").over(near) - F.col("n")) / (2.0 * around)).where((F.col("n") >= least) & (F.col("n") >= times * F.col("expected")) & (F.col("length") > around))
    on = each.withColumnRenamed("n", "texts").join(spikes.hint("merge"), ["source", "measure", "length"])
    lying = on.groupBy("source", "lengths").agg(F.array_sort(F.collect_set(F.struct("measure", "length", "n", "expected"))).alias("spiked"), F.max("texts").alias("texts"))
    alike = lying.groupBy("source", F.col("spiked").alias("lengths")).agg(F.sum("texts").alias("texts"))
    kind = dict(alike.dtypes)["source"]
    return alike.groupBy("source").applyInPandas(_limits(least, times), f"source {kind}, measure string, length_limit int, n_texts bigint, expected double")


def length_limits(df: DataFrame, source_col: str, text_col: str, *, least: int = 5, times: float = 6.0, around: int = 25) -> DataFrame:
    """(source, measure, length_limit, n_texts, expected): lengths on which at least ``least`` texts of a source lie, and at
    least ``times`` as many as on a mean length within ``around``, not counting those that another limit of the source
    with more texts explains. Null and empty texts count for nothing; a null source is a source."""
    texts = df.where(F.length(text_col) > 0).select(F.col(source_col).alias("source"), length_measures(F.col(text_col)).alias("lengths"))
    return _found_limits(texts.groupBy("source", "lengths").agg(F.count("*").alias("n")), least, times, around)


def judge_endings(parsed: DataFrame, texts: DataFrame, *, recur: int = 2, least: int = 5, times: float = 6.0, around: int = 25) -> DataFrame:
    """(rid, source, state, measure, length_limit, evidence, is_cut) for rows (rid, source, context, lengths, and ``ENDING``).

    ``parsed`` should be checkpointed; ``texts`` has the column ``text`` of the same texts, to be learnt from. evidence says what
    decided: limit (an end without punctuation on a limit of its source), ending (what the end looks like),
    corpus (what other texts show), or nothing for texts that aren't cut.
    """
    opened = parsed.where(F.col("state").isin("item", "prose", "short"))
    filter_keys = opened.select(F.explode(F.concat("open", "chains")).alias("key"))
    bits, size = asked_filter(filter_keys)
    known = spread(texts).mapInPandas(_teach(parsed.sparkSession.sparkContext.broadcast(bits), size), "key bigint").distinct()
    asked = opened.select("rid", F.explode("open").alias("key"))
    total = parsed.count()
    taught_keys = asked.groupBy("key").agg(F.count("*").alias("n")).join(known.hint("merge"), "key", "left_semi")
    split, keys_by_part = salt_hot(asked, taught_keys, ["key"], "rid", total=2 * total)
    hit = split.join(keys_by_part.drop("n").hint("merge"), ["key", "part"]).groupBy("rid").agg(F.count("*").alias("hits"))
    closings = opened.where("closing is not null").groupBy("closing").agg(F.count_distinct(F.xxhash64("context")).alias("contexts"), F.count("*").alias("n"))
    vectors = cut_lineage(parsed.where("lengths is not null").groupBy("source", "lengths").agg(F.count("*").alias("n")))
    limits = _found_limits(vectors, least, times, around)
    on = _each(vectors).join(limits.select("source", "measure", F.col("length_limit").alias("length"), "n_texts").hint("merge"), ["source", "measure", "length"])
    best = on.groupBy("source", "lengths").agg(F.min(F.struct((-F.col("n_texts")).alias("far"), "measure", "length")).alias("limit"), F.first("n").alias("n"))
    limited = best.select(F.xxhash64("source", "lengths").alias("vector"), F.col("limit.measure").alias("measure"), F.col("limit.length").alias("length_limit"), "n")

    rows = opened.select("rid", "source", "state", "closing", F.xxhash64("source", "lengths").alias("vector"))
    placed, limits_by_part = salt_hot(rows, limited, ["vector"], "rid", total=total)
    placed = placed.join(limits_by_part.drop("n").hint("merge"), ["vector", "part"], "left").drop("part", "vector")
    ended, closings_by_part = salt_hot(placed, closings.where(F.col("contexts") >= recur), ["closing"], "rid", total=total)
    judged = ended.join(closings_by_part.drop("n").hint("merge"), ["closing", "part"], "left").join(hit.hint("merge"), "rid", "left")
    hits, at_limit, recurs = F.coalesce("hits", F.lit(0)), F.col("length_limit").isNotNull(), F.col("contexts").isNotNull()
    corpus = F.when(F.col("state") == "item", hits < 2).when(F.col("state") == "prose", ~recurs | (hits > 0)).otherwise(hits == 1)
    evidence = F.when(at_limit, F.lit("limit")).when(corpus, F.lit("corpus"))
    told = judged.select("rid", "source", "state", "measure", "length_limit", evidence.alias("evidence"))
    none = F.lit(None)
    settled = parsed.where(~F.col("state").isin("item", "prose", "short")).select("rid", "source", "state", none.cast("string").alias("measure"), none.cast("int").alias("length_limit"), F.when(F.col("state") == "cut", F.lit("ending")).alias("evidence"))
    return told.unionByName(settled).withColumn("is_cut", F.col("evidence").isNotNull())


def cut_texts(df: DataFrame, id_col: str, source_col: str, text_col: str, context_col: str, *, recur: int = 2) -> DataFrame:
    """(id, source, state, measure, length_limit, evidence, is_cut) for every id, as ``judge_endings`` has them.

    ``context_col`` tells unrelated texts apart: a closing phrase must end texts of at least ``recur``
    different contexts. Null and blank texts are not cut. Of several texts under one id the one with the smallest hash
    counts; rows with a null id take no part; a null source is a source of its own. Empty tables give an empty result.
    """
    texts = df.select(F.col(id_col).alias("rid"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(context_col).cast("string")).alias("context")).where("rid is not null")
    kind = dict(texts.dtypes)["rid"]
    measured = texts.withColumn("lengths", F.when(F.length("text") > 0, length_measures(F.col("text")))).withColumn("text_key", F.xxhash64("text", "source", "context"))
    parsed = spread(measured).mapInPandas(_parse, f"rid {kind}, source string, context bigint, lengths array<int>, text_key bigint, {ENDING}")
    first = Window.partitionBy("rid").orderBy("text_key")
    parsed = cut_lineage(parsed.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at", "text_key"))
    return judge_endings(parsed, texts.select("text"), recur=recur).withColumnRenamed("rid", "id")
