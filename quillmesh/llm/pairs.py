"""Defects of prompt and response pairs.

Openings of all responses, with the words of their prompts masked, are clustered by verified minwise
hashing. Clusters whose wording recurs over unrelated prompts are templates: those of at least ``RECUR_WORDS`` words that
aren't the prompt's, which with courtesy, or with a body that itself recurs, are all that nearly all members say, to
``RECUR_TOPICS`` unrelated prompts at least. Their members that say no more than the template are refusals unless they have
another defect. Known ways to decline are a prior: they settle clusters that recur too seldom, and tell declining openings from
answers that merely apologise. Copies, foreign languages, empty responses and cut ones are told by checks of their own.

Scale. One pass in Python over the joined pairs gives features without text, checkpointed once; everything after it moves
hashes. Prompts and responses are shuffled once, by request. Clusters are formed of distinct openings.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.langid import FUNCTION_WORDS, language, prompt_language
from quillmesh.llm.neardup import class_of, class_links, shingle_set
from quillmesh.llm.truncation import ENDING, ending_columns, judge_endings, length_measures
from quillmesh.session import cut_lineage, salt_hot, spread

RECUR_TOPICS = 3
OPENING_WORDS = 16
RECUR_WORDS = 5  # words that aren't the prompt's; shorter answers recur as facts do: "Yes", "About 10 seconds"

_INVISIBLE = re.compile("[\\s­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ\x00-\x1f\x7f]+")
# What stands for no value.
_STAND_INS = frozenset(
    "null none nil nan n/a na n.a. undefined void empty blank nothing missing unknown tbd {} [] () \"\" '' - -- --- – — . .. ... … _ * # ? (no content) (none) (null) (empty) (blank) [empty] [null] [none] [no content] [blank] <empty> <null> <none> <blank> "
    "<nocontent> (vacío) (vazio) [vacío] [vazio] vacío vazio sin-contenido ninguno nenhum nulo".split(" ")
) | {"no content", "no answer", "no response", "no value", "(no content)", "[no content]", "(no response)", "[no response]", "<no content>", "not available", "sin contenido", "sem conteúdo", "(sin contenido)", "(sem conteúdo)", "sin respuesta", "sem resposta"}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n+")

# Ways to decline, by language.
_DECLINE = re.compile(
    r"""
    \b(?:i|we)\b[^.!?]{0,20}\b(?:can(?:no|')t|can\s?not|won't|will\s+not|am\s+unable|are\s+unable|'m\s+unable|am\s+not\s+able|'m\s+not\s+able|are\s+not\s+able|don't|do\s+not)\s+(?:be\s+able|help|assist|answer|comply|provide|discuss|respond|give|share|do|go|talk|support|offer|engage|fulfil|fulfill|continue|complete|to)
  | \b(?:unable|not\s+able)\s+to\s+(?:comply|help|assist|answer|provide|discuss|respond|give|share|fulfil)
  | \b(?:must|have\s+to|need\s+to|will|would\s+rather)\s+(?:\w+\s+)?(?:refuse|decline|pass)\b
  | \bi\s+(?:refuse|decline)\b | \boff[\s-]limits\b | \boutside\s+(?:my|what|our|of\s+my|the\s+scope)\b | \bbeyond\s+(?:my|what\s+i)\b
  | \bnothing\s+(?:that\s+)?i\s+can\s+(?:say|do|share)\b | \b(?:instructed|told|asked|trained)\s+not\s+to\b | \bnot\s+(?:permitted|allowed)\s+to\b
  | \b(?:rather|prefer)\s+not\b | \bprefiro\s+n[ãa]o\b | \bprefiero\s+no\b | \bpr[ée]f[èe]re\s+ne\s+pas\b | \bno\s+answer\s+can\s+be\b | \b(?:policy|guidelines|rules)\s+(?:\w+\s+){0,2}(?:not|forbid|forbids|prohibit|prohibits|prevent|prevents)\b | \bnot\s+be\s+appropriate\b | \bagainst\s+(?:my|our)\s+(?:policy|guidelines|rules)\b
  | \bn[ãa]o\s+(?:posso|consigo|podemos|vou|estou\s+autorizad\w+|tenho\s+permiss\w+|me\s+[ée]\s+permitid\w+|seria\s+(?:apropriado|adequado)|h[áa]\s+nada\s+que)\b | \b(?:preciso|devo|tenho\s+(?:de|que)|sou\s+obrigad\w+\s+a)\s+(?:recusar|declinar|negar)\b | \brecuso\b
  | \bfora\s+do\s+(?:que|meu|escopo|alcance)\b | \binstru[íi]d[oa]\s+a\s+n[ãa]o\b | \bn[ãa]o\s+permite\b | \bn[ãa]o\s+me\s+(?:permitem|deixam)\b | \borienta\w+\s+a\s+n[ãa]o\b | \bnenhuma\s+resposta\s+pode\b
  | \bno\s+(?:puedo|podemos|podr[ée]|me\s+es\s+posible|estoy\s+autorizad\w+|tengo\s+permi\w+|ser[íi]a\s+(?:apropiado|adecuado)|hay\s+nada\s+que)\b | \b(?:debo|tengo\s+que|necesito)\s+(?:rechazar|declinar|negar\w*)\b | \brechazo\b
  | \bfuera\s+de\s+(?:lo\s+que|mi|mis|alcance)\b | \bindicado\s+que\s+no\b | \binstrucciones\s+de\s+no\b | \bno\s+permite[n]?\b | \bno\s+me\s+(?:permiten|dejan)\b | \bninguna\s+respuesta\s+puede\b
  | \bje\s+ne\s+(?:peux|suis\s+pas)\b | \bje\s+dois\s+(?:refuser|d[ée]cliner)\b | \bich\s+(?:kann|darf)\s+(?:\w+\s+){0,4}nicht\b | \bich\s+muss\s+(?:\w+\s+){0,3}ablehnen\b
    """,
    re.I | re.X,
)
# Of these words, folded, every way to decline holds one.
_DECLINE_WORDS = frozenset(
    "t not cannot unable refuse decline pass off outside beyond nothing rather prefer prefiro prefiero prefere no forbid forbids prohibit prohibits prevent prevents against "
    "nao recusar declinar negar negarme negarnos negarle negarlo negarla recuso fora nenhuma rechazar rechazo fuera ninguna ne refuser decliner nicht ablehnen".split()
)
# Courtesy that answers nothing.
_COURTESY = re.compile(
    r"""^\W*(?:sorry|apolog|unfortunately|thank|thanks|i\s+understand|please\s+(?:consult|contact|ask|reach|see|talk)|perhaps\s+your|maybe\s+your|if\s+you\s+have\s+(?:another|other|any)|is\s+there\s+anything|let\s+me\s+know|good\s+(?:question|point)|i(?:'m|\s+am)\s+(?:sorry|happy)|can\s+i\s+help|how\s+else|feel\s+free|ok\b|sure\W*$|certainly\W*$|i\s+appreciate|as\s+an\s+(?:ai|assistant)
    |desculp|lament|infelizmente|obrigad|agrade|procure\s+o|consulte?\b|posso\s+ajudar|pergunte|fale\s+com|entendo|se\s+(?:tiver|quiser|precisar)\s+(?:outra|mais)|boa\s+pergunta|como\s+assistente
    |disculp|lo\s+siento|perd[óo]n|gracias|consulta\s+con|¿?\s*puedo\s+ayudar|habla\s+con|contacta|entiendo|si\s+(?:tienes|tiene|quieres)\s+(?:otra|m[áa]s)|buena\s+pregunta|como\s+asistente|quiz[áa]s?\s+tu
    |d[ée]sol|merci|malheureusement|entschuldig|leider|danke|tut\s+mir\s+leid)""",
    re.I | re.X,
)
# Names of languages, as asked for in a prompt.
_NAMES = {"en": "english|ingl[êe]s|ingl[ée]s|anglais|englisch", "pt": "portuguese|portugu[êe]s|portugu[ée]s|portugais|portugiesisch", "es": "spanish|espanhol|espa[ñn]ol|castellano|castelhano|espagnol|spanisch", "fr": "french|franc[êe]s|franc[ée]s|fran[çc]ais|franz[öo]sisch", "de": "german|alem[ãa]o|alem[áa]n|allemand|deutsch"}
_ASKED = {k: re.compile(rf"\b(?:in|into|to|em|para|para\s+o|ao|en|al|a|auf|ins)\s+(?:{v})\b", re.I) for k, v in _NAMES.items()}
_GLUE = frozenset("i to the of a in is can you me it this that for and not do my on be with no we as an se de que la el o os em por para com un una puedo posso me mi esta este isso eso sobre about on at so but mas pero não no lo las los do da um uma te tu seu sua help ajudar ayudar".split())


_BEYOND_ASCII = re.compile("[^\x00-\x7f]")


def fold(text: str) -> list[str]:
    """The words of a text without case and accents."""
    text = text.casefold()
    if not text.isascii():
        text = _BEYOND_ASCII.sub(lambda m: "" if unicodedata.combining(m[0]) else m[0], unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


def is_empty(content: str | None) -> bool:
    """Null, blank, only invisible characters, or a stand-in for no value."""
    if content is None:
        return True
    seen = _INVISIBLE.sub(" ", content).strip()
    return not seen or seen.casefold() in _STAND_INS or not re.search(r"[^\W_]", seen) and len(seen) <= 4 and not re.search("[\U0001f300-\U0001faff☀-➿]", seen)


def longest_runs(p: list[str], c: list[str], least: int) -> list[tuple[int, int, int]]:
    """(start in c, start in p, length): from left to right the longest run of p, of at least ``least`` words, at each place of c.

    Over a suffix automaton of p, so repeated runs cost nothing and none is left out.
    """
    follow: list[dict[str, int]] = [{}]
    link, length, end = [-1], [0], [0]
    last = 0
    for at, w in enumerate(p):
        cur = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        end.append(at + 1)
        link.append(0)
        q = last
        while q != -1 and w not in follow[q]:
            follow[q][w] = cur
            q = link[q]
        if q != -1:
            r = follow[q][w]
            if length[q] + 1 == length[r]:
                link[cur] = r
            else:
                copy = len(follow)
                follow.append(dict(follow[r]))
                length.append(length[q] + 1)
                end.append(end[r])
                link.append(link[r])
                while q != -1 and follow[q].get(w) == r:
                    follow[q][w] = copy
                    q = link[q]
                link[r] = link[cur] = copy
        last = cur
    out, i = [], 0
    while i + least <= len(c):
        state = n = 0
        while i + n < len(c) and (to := follow[state].get(c[i + n])) is not None:
            state, n = to, n + 1
        if n >= least:
            out.append((i, end[state] - n, n))
            i += n
        else:
            i += 1
    return out


def is_copy(prompt: str | None, content: str, run: int = 4) -> bool:
    """Nearly all words of the content lie in runs of the prompt, which is given back for the most part."""
    p, c = fold(prompt or ""), fold(content)
    if not p or len(c) < 3:
        return False
    own = set(p)
    if sum(w not in own for w in c) > max(3, 0.08 * len(c)):
        return False
    run = min(run, len(p), len(c))
    grams = {tuple(p[i : i + run]) for i in range(len(p) - run + 1)}
    # Each run covered holds at least ``run`` words, so a content of which few runs are the prompt's is none.
    if sum(tuple(c[i : i + run]) in grams for i in range(len(c) - run + 1)) * run < len(c) - max(3, 0.08 * len(c)):
        return False
    used = [False] * len(p)
    covered = 0
    for _, at, n in longest_runs(p, c, run):
        covered += n
        used[at : at + n] = [True] * n
    return len(c) - covered <= max(3, 0.08 * len(c)) and sum(used) >= min(len(p), max(4, 0.45 * len(p)))


def is_other_language(prompt: str | None, content: str) -> bool:
    asked = {k for k, v in _ASKED.items() if v.search(prompt or "")}
    own = prompt_language(prompt)
    given = language(content, 1.5)
    return bool(own and given and own != given and given not in asked)


_ALL_FUNCTION_WORDS = frozenset(w for words in FUNCTION_WORDS.values() for w in fold(words))


def topic(prompt: str | None) -> int | None:
    """A minwise hash over the words of a prompt that tell what it is about: prompts worded alike share it more often than not."""
    words = set(fold(prompt or ""))
    words = words - _ALL_FUNCTION_WORDS - _GLUE or words
    return min(xxhash.xxh64_intdigest(w) for w in words) - 2**63 if words else None


def _few(n: int, of: int) -> bool:
    """So few words besides, or so small a share, that they answer nothing."""
    return n <= max(6, 0.2 * of)


def decline_parts(prompt: str | None, content: str) -> tuple[bool, bool, str, bool, int]:
    """(a sentence declines, nothing but declining and courtesy, opening with the prompt's words masked, nothing but
    the opening and courtesy, hash of the masked rest). The opening is the sentence that declines first, else the first that isn't courtesy."""
    text = content.replace("’", "'").replace("‘", "'")
    sentences = [s for s in _SENTENCE.split(text) if s and _WORD.search(s)]
    declines = other = words = 0
    may = not _DECLINE_WORDS.isdisjoint(fold(text)) or "negar" in text.lower()
    opening = next((s for s in sentences if not _COURTESY.search(s)), sentences[0] if sentences else "")
    rest = []
    for s in sentences:
        n = len(_WORD.findall(s))
        words += n
        if may and _DECLINE.search(s):
            if not declines:
                opening = s
            declines += 1
        elif not _COURTESY.search(s):
            other += n
            rest.append(s)
    mask = set(fold(prompt or "")) - _GLUE
    hide = lambda found: ["x" if w in mask or w.isdigit() else w for w in found]
    body = xxhash.xxh64_intdigest(" ".join(hide(fold(" ".join(s for s in rest if s is not opening))))) - 2**63
    beside = other - (0 if declines or _COURTESY.search(opening) else len(_WORD.findall(opening)))
    # A lead-in of few words up to a comma or dash says little of the template.
    opening = re.sub(r"^\W*(?:[^\s,;:—–!]+\s+){0,4}[^\s,;:—–!]+\s*[,;:—–!]\s*(?:but|mas|pero|however)?\s*", "", opening) if len(_WORD.findall(opening)) > 6 else opening
    masked = hide(fold(opening))[:OPENING_WORDS]
    bare = _few(other, words) if declines else _few(beside, words)
    return declines > 0, bare, " ".join(masked), _few(beside, words), body


_FEATURES = f"rid string, source string, context bigint, lengths array<int>, own string, declines boolean, bare boolean, opens boolean, opening string, class binary, alone boolean, own_words int, body bigint, topic bigint, {ENDING}"


def _features(templates: bool):
    """``templates``: with what clusters of openings need; else those columns are empty."""
    nothing = (None, None, False, 0, None, None)

    def told(prompt, content, finish):
        if is_empty(content):
            return (None if (finish or "").strip().upper() == "TOOL_CALLS" else "empty", False, False, False, *nothing)
        if is_copy(prompt, content):
            return ("copy", False, False, False, *nothing)
        declines, bare, opening, alone, body = decline_parts(prompt, content)
        own = "other_language" if is_other_language(prompt, content) else None
        if not templates:
            return (own, declines, bare, bool(opening), *nothing)
        words = opening.split()
        # Words leave the task as hashes: the checkpoint holds no text.
        hidden = " ".join(w if w == "x" else f"{xxhash.xxh64_intdigest(w):x}" for w in words)
        shingles = shingle_set(hidden, TEMPLATE["words"])
        return (own, declines, bare, bool(opening), hidden or None, class_of(shingles)[1] if len(shingles) else None, alone, sum(w != "x" for w in words), body, topic(prompt))

    def run(batches):
        for pdf in batches:
            rows = [told(*x) for x in zip(pdf["prompt"], pdf["content"], pdf["finish"])]
            out = pd.DataFrame(rows, columns=["own", "declines", "bare", "opens", "opening", "class", "alone", "own_words", "body", "topic"])
            out = out.astype({"body": "Int64", "topic": "Int64"})
            yield pd.concat([pdf[["rid", "source", "context", "lengths"]].reset_index(drop=True), out, pd.DataFrame(ending_columns(pdf["content"]))], axis=1)

    return run


def pair_features(responses: DataFrame, requests: DataFrame, templates: bool = True) -> DataFrame:
    """One row a response, checkpointed: what its own words show, its opening (with ``templates``), its ending and lengths; no text."""
    ask = requests.select("request_id", F.col("user_input").alias("prompt")).where("request_id is not null").groupBy("request_id").agg(F.min("prompt").alias("prompt"))
    told = responses.where("response_id is not null").select(
        F.col("response_id").cast("string").alias("rid"), "request_id", F.coalesce(F.col("provider_id").cast("string"), F.lit("")).alias("source"), F.col("content").cast("string").alias("content"), F.col("finish_reason").alias("finish")
    )
    # Responses without a request have keys of their own, so that they don't meet in one task.
    told = told.withColumn("key", F.coalesce("request_id", F.concat(F.lit("\u0000"), "rid")))
    # One request may have very many responses: they are split before they meet it.
    sized = told.groupBy("key").agg(F.count("*").alias("n")).join(ask.withColumnRenamed("request_id", "key").hint("merge"), "key", "left")
    placed, by_part = salt_hot(told, sized, ["key"], "rid", total=responses.count())
    joined = placed.join(by_part.drop("n").hint("merge"), ["key", "part"])
    context = F.xxhash64(F.coalesce("prompt", "key"))
    lengths = F.when(F.length("content") > 0, length_measures(F.col("content")))
    rows = joined.dropDuplicates(["key", "part", "rid", "content"]).select("rid", "source", "prompt", "content", "finish", context.alias("context"), lengths.alias("lengths"))
    made = spread(rows).mapInPandas(_features(templates), _FEATURES)
    first = Window.partitionBy("rid").orderBy("own", "closing", "class", "context")
    return cut_lineage(made.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at"))


def _cut(features: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows of ``judge_endings`` of responses that are cut and have no other defect of their own words."""
    texts = responses.where("response_id is not null").select(F.col("content").cast("string").alias("text"))
    plain = features.where("own is null and opens and not (declines and bare)").select("rid")
    return judge_endings(features.select("rid", "source", "context", "lengths", "state", "open", "closing", "chains"), texts).where("is_cut").join(plain.hint("merge"), "rid", "left_semi")


def cut_responses(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """(response_id, provider_id, evidence, measure, length_limit): responses cut before their end, with what shows it and the
    limit they lie on, if any. A missing provider_id is an empty text. Rows as for ``pair_defects``."""
    cut = _cut(pair_features(responses, requests, templates=False), responses)
    return cut.select(F.col("rid").alias("response_id"), F.col("source").alias("provider_id"), "evidence", "measure", "length_limit")


TEMPLATE = {"threshold": 0.8, "words": 5, "bands": 24, "rows": 5, "miss": 0.001, "batch": 32}


def _templates(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses that say no more than their opening, classes of openings that are refusal templates): the former by rid, the latter
    (class, n, known, recurring), by known ways to decline or by recurrence alone."""
    told = features.where("class is not null")
    total = features.count()
    # A body of more than few words counts as saying nothing if it recurs over unrelated prompts as well.
    bodies = told.where("not alone").groupBy("body").agg(F.count_distinct("topic").alias("topics"), F.count("*").alias("n")).where(F.col("topics") >= RECUR_TOPICS).select("body", "n")
    placed, by_part = salt_hot(told.where("not alone").select("rid", "class", "topic", "own_words", "body"), bodies, ["body"], "rid", total=total)
    stock = placed.join(by_part.select("body", "part").hint("merge"), ["body", "part"], "left_semi").select("rid", "class", "topic", "own_words")
    alone = cut_lineage(told.where("alone").select("rid", "class", "topic", "own_words").unionByName(stock).where(F.col("own_words") >= RECUR_WORDS))
    _, links = class_links(told.select("opening").distinct(), "opening", "opening", **TEMPLATE)
    sides = cut_lineage(links.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).unionAll(links.select("class_b", "class_a")))
    counts = told.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.col("declines").cast("int")).alias("d"))
    counts = cut_lineage(counts.join(alone.groupBy("class").agg(F.count("*").alias("alone")).hint("merge"), "class", "left"))
    around = sides.join(counts.withColumnRenamed("class", "other").hint("merge"), "other").groupBy("class").agg(F.sum("n").alias("n2"), F.sum("d").alias("d2"))
    zero = F.lit(0)
    known = (F.col("d") + F.coalesce("d2", zero)) * 2 >= F.col("n") + F.coalesce("n2", zero)
    # No more topics of a class are needed than make a template, whether its own or those of linked classes.
    few = Window.partitionBy("class").orderBy("topic")
    lone = counts.where(F.col("alone") >= 0.9 * F.col("n")).select("class")
    asked = alone.where("topic is not null").select("class", "topic").distinct().withColumn("rk", F.row_number().over(few)).where(F.col("rk") <= RECUR_TOPICS).select("class", "topic")
    asked = asked.join(lone.hint("merge"), "class", "left_semi")
    linked = sides.join(asked.withColumnRenamed("class", "other").hint("merge"), "other").select("class", "topic")
    recurring = asked.unionByName(linked).join(lone.hint("merge"), "class", "left_semi").groupBy("class").agg(F.count_distinct("topic").alias("topics")).where(F.col("topics") >= RECUR_TOPICS)
    both = counts.join(around.hint("merge"), "class", "left").join(recurring.hint("merge"), "class", "left")
    return alone.select("rid").distinct(), both.select("class", "n", known.alias("known"), F.col("topics").isNotNull().alias("recurring")).where("known or recurring")


def pair_defects(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """(response_id, defect) for the responses with a defect; each has one at most.

    Order of precedence: empty, copy, refusal in words that are known to decline, other_language, truncated, refusal by
    the template alone. Responses without a request have no prompt: they can be empty, refusals or truncated. Repeated rows
    of an id count once, and of rows that differ one by a fixed order; rows
    with a null id take no part; missing requests, null prompts and empty tables are allowed; other columns are ignored.
    """
    features = pair_features(responses, requests)
    cut = _cut(features, responses).select("rid").withColumn("cut", F.lit(True))
    alone, templates = _templates(features)
    placed, by_part = salt_hot(features.where("class is not null").select("rid", "class", "bare"), cut_lineage(templates), ["class"], "rid", total=features.count())
    named = placed.join(by_part.drop("n").hint("merge"), ["class", "part"]).join(alone.withColumn("says_no_more", F.lit(True)).hint("merge"), "rid", "left")
    by_template = named.where("(known and bare) or (recurring and says_no_more)").select("rid", F.lit(True).alias("template"), (F.col("known") & F.col("bare")).alias("known"))
    own = F.col("own")
    defect = (
        F.when(own.isin("empty", "copy"), own)
        .when((F.col("declines") & F.col("bare")) | F.col("known"), F.lit("refusal"))
        .when(own.isNotNull(), own)
        .when(F.col("cut"), F.lit("truncated"))
        .when(F.col("template"), F.lit("refusal"))
    )
    rows = features.select("rid", "own", "declines", "bare")
    return rows.join(by_template.hint("merge"), "rid", "left").join(cut.hint("merge"), "rid", "left").select(F.col("rid").alias("response_id"), defect.alias("defect")).where("defect is not null")
