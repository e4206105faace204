"""Language of a text: by script, and among languages in Latin letters by function words and letters.

A text whose letters are mostly of one script that few languages use is of the language most written in it; Latin letters are
told apart among English, Portuguese, Spanish, French, German, Italian and Dutch.
"""

from __future__ import annotations

import re

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be at this have from or by not but what all were we when your can there use each which she do how their if will up other about out then these so some would into has more no could than who now only its between every before after while without because both where why should you an please write list explain help me my here there just may must whether until during",
    "pt": "o os a as um uma uns umas de do da dos das em no na nos nas por pelo pela para com sem que e é são não se mais mas como quando onde porque ou ao aos à às este esta isso seu sua foi ser ter está estão você depois antes entre sobre até também já só num numa qual quais duas dois fica nenhum nosso nossa há muito esse essa ele ela isto meu minha pode explique escreva liste traduza responda faço favor me te",
    "es": "el los la las un una unos unas de del en por para con sin que y es son no se más pero como cuando donde porque al este esta eso su fue ser tener está están usted después antes entre sobre hasta también ya solo cada qué cuál cómo dos hay queda ningún nuestro nuestra mientras lo le muy ese él ella mi puede desde siempre quien según explica escribe enumera traduce responde favor quién ayudas a me te nos",
    "fr": "le les la un une des de du en dans par pour avec sans que qui et est sont ne pas se plus mais comme quand où parce ou au aux ce cette son sa fut être avoir vous nous il elle après avant entre sur jusqu aussi déjà seulement chaque quel quelle deux puis votre notre ces leur très a me te on",
    "de": "der die das den dem des ein eine einen einem einer von zu im in mit ohne für auf ist sind nicht und oder aber wie wenn wo weil dass als am an aus bei nach vor zwischen über bis auch schon nur jede jeder welche zwei es er sie wir ihr sich wird werden kann haben hat danach damit keine sobald bevor um öffnen wählen um zur zum durch",
    "it": "il lo gli della delle dei degli del dello nel nella nelle negli sono non che di è per con una un più anche ma questo questa quello quella come quando dove perché ha hanno essere stato viene dopo prima tra fra fino ogni quale quali due suo sua loro nostro vostro alla alle agli ai dal dalla dalle sul sulla può devono deve molto già ancora solo a mi ti ci",
    "nl": "het een van en niet is dat op te voor met zijn aan door er ook maar om als naar uit bij nog kan worden wordt deze dit die wat waar hoe moet geen wel over heeft hebben werd na tot ze hij wij u uw ons onze elke tussen zodra voordat omdat wanneer",
}
# Ranges of letters of scripts, with the language that a text mostly of them is taken for. Kana come before
# Chinese characters, which Japanese uses as well.
SCRIPTS = (("ja", "\u3040-\u30ff"), ("ko", "\u1100-\u11ff\uac00-\ud7af"), ("zh", "\u4e00-\u9fff\u3400-\u4dbf"), ("ru", "\u0400-\u04ff"), ("el", "\u0370-\u03ff"), ("he", "\u0590-\u05ff"), ("ar", "\u0600-\u06ff"), ("hi", "\u0900-\u097f"), ("th", "\u0e00-\u0e7f"), ("ka", "\u10a0-\u10ff"), ("hy", "\u0530-\u058f"))
# Letters that tell languages apart, with their weight.
LETTERS = {"en": (), "pt": ("ã", "õ", "ç", "ê", "ô", "â", "à"), "es": ("ñ", "¿", "¡", "ción", "ll"), "fr": ("è", "ê", "ç", "œ", "û", "î", "ù", "à", "eux"), "de": ("ä", "ö", "ü", "ß", "sch", "ung"), "it": ("zione", "gli", "cch", "à", "ù", "ò"), "nl": ("ij", "aa", "oo", "ee")}

_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
# The languages of each function word and of each sign.
_KNOWN = {w: tuple(lang for lang, s in _SETS.items() if w in s) for s in _SETS.values() for w in s}
_TELLS = {sign: tuple(lang for lang, s in LETTERS.items() if sign in s) for s in LETTERS.values() for sign in s}
_SIGNS = re.compile("|".join(sorted(_TELLS, key=len, reverse=True)))
_WORD = re.compile(r"(?<![\w@./-])[^\W\d_]+(?![\w@])")
_ELISION = re.compile(r"(?<!\w)(?:[cdjlmnst]|qu)['’](?=[aeéèêhiouyâîô])")
_FIRST = re.compile(r"\n|(?<=[.!?])\s")
_WORD_LENGTH = 6


def language_scores(text: str, half: int | None = None) -> tuple[dict[str, float], int]:
    """Evidence by language and the number of words. A word of k languages gives 1/k to each.

    With ``half`` words count the less the later they come: the word at that place a quarter as much as the first."""
    lower = text.lower()
    words = _WORD.findall(lower)
    score = dict.fromkeys(_SETS, 0.0)
    for at, w in enumerate(words):
        if of := _KNOWN.get(w):
            weight = 1.0 / len(of) if half is None else (half / (half + at)) ** 2 / len(of)
            for lang in of:
                score[lang] += weight
    score["fr"] += 0.5 * len(_ELISION.findall(lower))
    for m in _SIGNS.finditer(lower):
        weight = 0.3 if half is None else 0.3 * (half / (half + m.start() / _WORD_LENGTH)) ** 2
        for lang in _TELLS[m[0]]:
            score[lang] += weight
    return score, len(words)


_SCRIPT = [(lang, re.compile(f"[{span}]")) for lang, span in SCRIPTS]
_BEYOND = re.compile("[\u0370-\U0010ffff]")


def script_language(text: str) -> str | None:
    """The language of a script that most letters of the text are of; null for Latin letters and mixtures."""
    if not _BEYOND.search(text):
        return None
    letters = sum(c.isalpha() for c in text)
    count = {lang: len(p.findall(text)) for lang, p in _SCRIPT}
    if 5 * count["ja"] >= count["zh"] > 0:
        count["ja"] += count.pop("zh")
    best = max(count, key=count.get)
    # A Chinese character says as much as some Latin letters do.
    return best if count[best] * (2 if best in ("ja", "zh", "ko") else 1) > 0.5 * letters and count[best] > 0 else None


def _clear(score: dict[str, float], least: float) -> str | None:
    first, second = sorted(score, key=score.get, reverse=True)[:2]
    return first if score[first] >= least and score[first] > 1.15 * score[second] else None


def language(text: str | None, least: float = 1.0) -> str | None:
    """The language with most evidence; null if there is too little or no clear winner."""
    if not text:
        return None
    return script_language(text) or _clear(language_scores(text)[0], least)


def prompt_language(text: str | None, least: float = 0.6) -> str | None:
    """The language of a request: that of its first sentence, which asks; if that isn't clear, of the whole. The whole sentence counts,
    its beginning most, since what follows a question may be pasted."""
    if not text or not text.strip():
        return None
    asks = _FIRST.split(text.strip(), maxsplit=1)[0]
    return script_language(asks) or _clear(language_scores(asks, half=8)[0], 1.0) or language(text, least)
