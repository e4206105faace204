"""Personal information inside free text: found under disguises, replaced by typed placeholders.

Transducers rewrite a text step by step while they keep, for every character of the rewritten text, the
span of source characters it came from: compatibility forms and look-alike letters are folded, hidden
characters dropped, spelled digits read as digits, and written-out at and dot signs as signs. Detectors
run on the rewritten text; their spans are mapped back, so the placeholders replace exactly the source
characters, and the rest of the text stays as it was.

Names. A cue (a phrase before it, a mail address after it) shows a name by itself. The words of names found so, and words used
in lower case, are counted over all texts. A name inside a sentence is found by that evidence: its given name follows
cues elsewhere, and no part of it is a common word. A line of its own that could be a name is none if the texts use its words in lower case.

Scale. Two passes row by row, no shuffle but the distinct over (table, id, kind). The counts are a sketch of fixed size
(``ROWS`` times ``BUCKETS`` for each of three kinds, 3 MB), which every task gets.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.langid import FUNCTION_WORDS
from quillmesh.session import spread

KINDS = ("email", "phone", "national_id", "address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁɡһԛԝАВЕКМНОРСТУХІЈЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdghqwABEKMHOPCTYXIJSabeikvoptuxABEZHIKMNOPTYX",
        strict=True,
    )
)
_HIDDEN = re.compile("[­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")
# Characters that are folded: beyond Latin letters all but common signs, and those whose compatibility form is another.
_ODD = re.compile("[^\x00-\u017f’‘“”–—€]|[\xa0\xa8\xaa\xad\xaf\xb2-\xb5\xb8\xb9\xbc-\xbe\u0132\u0133\u013f\u0140\u0149\u017f]")
_JSON_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|.)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\n", "b": " ", "f": "\n"}
# Spelled digits of three languages.
_DIGIT = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "um": "1", "uma": "1", "dois": "2", "duas": "2", "três": "3", "tres": "3", "quatro": "4", "cinco": "5", "seis": "6", "meia": "6", "sete": "7", "oito": "8", "nove": "9",
    "cero": "0", "uno": "1", "una": "1", "dos": "2", "cuatro": "4", "siete": "7", "ocho": "8", "nueve": "9",
}
_TIMES = {"double": 2, "triple": 3, "doble": 2, "dobro": 2, "duplo": 2}
_D = "|".join(sorted(_DIGIT, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:(?:{'|'.join(_TIMES)})\s+)?(?:{_D}|\d)\b(?:[\s,.\-–]{{1,3}}(?:(?:{'|'.join(_TIMES)})\s+)?(?:{_D}|\d)\b){{3,}}", re.I)
_DOT_WORD = r"(?:\s*[\[({<]\s*(?:dot|ponto|punto|\.)\s*[\])}>]\s*|\s+(?:dot|ponto|punto)\s+|\s+\.\s+)"
_DOMAIN_PART = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[\w%+'-]|\.(?=\w))*"
_SIGN_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*|\s*(?:&#64;|&commat;|%40)\s*|\s+@\s*|@\s+)"
_WORD_AT = r"\s+(?:at|arroba)\s+"
_BEFORE = rf"(?<![\w.+-])(?P<local>{_LOCAL}(?:{_DOT_WORD}{_LOCAL})*?)"
_DISGUISED = [
    # A sign, bracketed or encoded, before any domain; a word, or a plain sign, before a domain with a spelled dot.
    re.compile(rf"{_BEFORE}{_SIGN_AT}(?P<domain>{_DOMAIN_PART}(?:(?:{_DOT_WORD}|\.){_DOMAIN_PART}){{1,4}})(?![\w@-])", re.I),
    re.compile(rf"{_BEFORE}(?:{_WORD_AT}|@)(?P<domain>(?:{_DOMAIN_PART}\.){{0,3}}{_DOMAIN_PART}{_DOT_WORD}{_DOMAIN_PART}(?:(?:{_DOT_WORD}|\.){_DOMAIN_PART}){{0,3}})(?![\w@-])", re.I),
    re.compile(rf"(?<![\w.+-])(?P<local>{_LOCAL}(?:{_DOT_WORD}{_LOCAL})+)@(?P<domain>{_DOMAIN_PART}(?:\.{_DOMAIN_PART}){{1,4}})(?![\w@-])", re.I),
]
_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9](?:[\w%+'-]|\.(?=\w))*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z-]*[A-Za-z](?![\w@-])")

_PHONE_CUE = r"(?:tel|t[ée]l[ée]?fono?|telefone|phone|mobile|m[óo]vil|celular|cell|whatsapp|zap|fax|call|ring|dial|text\s+me\s+on|msisdn|reach\s+me\s+on|ligue\s+(?:para)?|llama(?:me)?\s+al?|n[úu]mero|number\s+is)"
_NOT_IN = r"(?<![\w./#@:=-])(?<!\d[ ,])"
_END = r"(?![\w/@=-]|[.,:]\d)"
_PHONES = [
    re.compile(r"(?<![\w+(])\(?\+\(?\d{1,3}\)?(?:[ .\-/\u00a0]?\(?\d{1,5}\)?){2,6}" + _END),
    re.compile(r"(?<![\w(./-])\(0?\d{2,4}\)[ .\-]?\d{3,5}[ .\-]?\d{3,4}" + _END),
    re.compile(_NOT_IN + r"(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}" + _END),
    re.compile(_NOT_IN + r"0\d{4}[ -]\d{6}" + _END),
    re.compile(_NOT_IN + r"0?\d{2}[ .\-]9?\d{4}[ .\-]\d{4}" + _END),
    re.compile(_NOT_IN + r"[5-9]\d{2}([ .\-])\d{3}\1\d{3}" + _END + r"(?!\1\d)"),
    re.compile(_NOT_IN + r"[5-9]\d{2}([ .\-])\d{2}\1\d{2}\1\d{2}" + _END),
    re.compile(rf"(?<=\b)(?P<cue>{_PHONE_CUE})\b\W{{0,5}}(?:\w{{1,4}}\W{{1,2}}){{0,2}}?(?P<n>\(?\d[\d .()\-]{{5,16}}\d)" + _END, re.I),
    re.compile(r"(?:^|(?<=\n)|(?<=\"))\d{9,11}(?=$|\n|\")"),
]
_ID_CUE = r"(?:ssn|social\s+security(?:\s+(?:number|no\.?|n[ºo°.]*))?|soc(?:ial)?\.?\s*sec(?:urity)?\.?(?:\s*(?:no\.?|number))?|my\s+social(?:\s+is)?|social\s+is|cpf|dni|nif|nie|documento(?:\s+nacional)?(?:\s+de\s+identid\w+)?|identity\s+(?:card|number)|national\s+id(?:entity)?|id\s+(?:card|number)|tax[\s_]id|passport|pasaporte|passaporte|rg|cnh|curp|nino)"
_IDS = [
    re.compile(rf"\b{_ID_CUE}\b(?:[\s:#.\-]|\(\w{{2,5}}\)|n[ºo°.]|no\.|number|n[úu]mero|is|es|[ée]){{0,6}}(?P<n>[A-Z]?-?\d(?:[\d]|[ .\-](?=\d)){{5,14}}(?:[ .\-]?[A-Z])?)" + r"(?![\w@])", re.I),
    re.compile(_NOT_IN + r"(?!000)\d{3}-\d{2}-\d{4}" + _END),
    re.compile(_NOT_IN + r"\d{3}\.\d{3}\.\d{3}[- ]\d{2}" + _END),
    re.compile(_NOT_IN + r"\d{3} \d{3} \d{3}[- ]\d{2}" + _END),
    re.compile(_NOT_IN + r"\d{9}-\d{2}" + _END),
    re.compile(_NOT_IN + r"\d{2}\.\d{3}\.\d{3}[- ]?[A-Z](?![\w-])"),
    re.compile(_NOT_IN + r"(?:[XYZ][- ]?\d{7}|\d{8})[- ]?[A-HJ-NP-TV-Z](?![\w-])"),
    re.compile(_NOT_IN + r"[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"),
]
_EN_TYPE = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Crescent|Cres\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Ct\.?|Close|Terrace|Place|Pl\.|Square|Sq\.?|Way|Row|Parkway|Highway|Hwy\.?|Alley|Mews|Grove)"
_CAP = r"[A-ZÀ-Þ][\wÀ-ÿ'’-]*"
_TAIL = r"(?:,?[ \t]*(?:Apt\.?|Apartment|Flat|Unit|Suite|Ste\.?|ap\.|apto\.?|bloco|bl\.|piso|-[ \t]*fundos|bajo(?:[ \t]+izq\.?)?|izq\.?|dcha\.?|\d{1,2}º(?:[ \t]?[A-Z])?)[ \t]*(?:\d{1,4}[A-Z]?)?)*(?:,?[ \t]*\d{5})?(?:,[ \t]*[A-ZÀ-Þ][\w'’-]*(?:[ \t]+(?:d[aeo]s?[ \t]+)?[A-ZÀ-Þ][\w'’-]*){0,2}(?:[ \t]+\d{5})?)?"
_ES_PT_TYPE = r"(?:Rua|R\.|Avenida|Avda?\.|Av\.|Travessa|Trav\.|Alameda|Al\.|Pra[çc]a|P[çc]a\.|Largo|Estrada|Rodovia|Calle|C/|C\.|Plaza|Pza\.|Pl\.|Paseo|P[ºo]\.?|Camino|Carretera|Ctra\.|Ronda|Pasaje|Callej[óo]n|Glorieta|Costanilla|Cuesta)"
_HOUSE_WORD = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[ -](?:one|two|three|four|five|six|seven|eight|nine))?)"
_ADDRESSES = [
    re.compile(rf"(?<![\w./-])(?:\d{{1,5}}[A-Za-z]?|{_HOUSE_WORD.replace('one|', 'One|one|', 1)})\s+(?:{_CAP}\s+){{1,4}}{_EN_TYPE}(?![\w/])" + _TAIL),
    re.compile(r"(?<![\w./-])\d{1,5}[a-z]?\s+(?:[a-z'’-]{3,}\s+){1,3}(?:street|avenue|road|lane|crescent|boulevard|st\.|ave\.|rd\.)(?![\w/])"),
    re.compile(rf"(?<![\w./-])\d{{1,5}}[A-Z]?\s+(?:[A-Z'’-]{{3,}}\s+){{1,4}}(?:STREET|ST\.?|AVENUE|AVE\.?|ROAD|RD\.?|LANE|CRESCENT|BOULEVARD|DRIVE|COURT|CLOSE)(?![\w/])"),
    re.compile(rf"(?<![\w./-]){_ES_PT_TYPE}\s*(?:(?:d[aeo]s?|del?|la|las|los|el|e|y)\s+)*{_CAP}(?:\s+(?:(?:d[aeo]s?|del?|la|las|los|el|e|y)\s+)*{_CAP}){{0,5}}\s*,?\s*(?:n[ºo°.]*\s*|n[úu]mero\s+|#\s*)?\d{{1,5}}[A-Za-z]?(?!\w)" + _TAIL),
    re.compile(rf"(?<![\w./-])(?i:{_ES_PT_TYPE})\s*(?:[a-zà-ÿ'’-]+\s+){{0,5}}?[a-zà-ÿ'’-]+\s*,\s*(?:n[ºo°.]*\s*)?\d{{1,5}}(?!\w)"),
    re.compile(rf"(?<![\w./-]){_ES_PT_TYPE.upper()}\s*(?:[A-ZÀ-Þ'’-]+\s+){{0,5}}?[A-ZÀ-Þ'’-]+\s*,?\s*(?:N[ºO°.]*\s*)?\d{{1,5}}(?!\w)"),
]

_NAME_TOKEN = r"(?:[A-ZÀ-Þ][a-zß-ÿ]+(?:['’-][A-ZÀ-Þ]?[a-zß-ÿ]+)*|(?:D|O)['’][A-ZÀ-Þ][a-zß-ÿ]+)"
_INITIAL = r"[A-ZÀ-Þ]\."
_PART = r"(?:d[aeo]s?|del|de\s+la|van|von|di|e|y)"
_MIXED = rf"(?:(?:{_NAME_TOKEN}|{_INITIAL})(?:\s+{_INITIAL})?(?:[ \t]+(?:{_PART}[ \t]+)?{_NAME_TOKEN}){{1,3}}|{_NAME_TOKEN}(?:[ \t]+{_NAME_TOKEN})?,[ \t]+(?:{_NAME_TOKEN}(?:[ \t]+{_NAME_TOKEN})?|{_INITIAL}(?:[ \t]?{_INITIAL})?))"
_UPPER_TOKEN = r"[A-ZÀ-Þ][A-ZÀ-Þ'’]+(?:-[A-ZÀ-Þ]+)?"
_UPPER = rf"(?:(?:{_UPPER_TOKEN}|{_INITIAL})(?:[ \t]+{_UPPER_TOKEN}){{1,2}}|{_UPPER_TOKEN},[ \t]+(?:{_UPPER_TOKEN}|{_INITIAL}))"
_LOWER_TOKEN = r"[a-zß-ÿ][a-zß-ÿ'’]+(?:-[a-zß-ÿ]+)?"
_LOWER = rf"(?:(?:{_LOWER_TOKEN}|[a-z]\.)(?:[ \t]+{_LOWER_TOKEN}){{1,2}}|{_LOWER_TOKEN},[ \t]+(?:{_LOWER_TOKEN}|[a-z]\.))"
# Phrases that a person's name follows.
_STRONG = r"(?:my\s+(?:full\s+)?name\s+is|meu\s+nome\s+(?:completo\s+)?[ée]|mi\s+nombre\s+(?:completo\s+)?es|(?:eu\s+)?me\s+chamo|chamo-me|me\s+llamo|(?:i\s+)?spoke\s+(?:with|to)|speak\s+(?:with|to)|talked\s+(?:with|to)|talk\s+to|signed(?:\s+by)?\s*:|assinad[oa](?:\s+por)?\s*:|firmad[oa](?:\s+por)?\s*:|reviewer\s+on\s+duty\s+(?:was|is)|on\s+duty\s+(?:was|is)|quem\s+(?:me\s+)?atendeu\s+foi|me\s+atendi[óo]|fale\s+com|falei\s+com|habla\s+con|habl[ée]\s+con|full[_ ]name\"?\s*:|\"(?:name|nome|nombre|owner|agent|contact|contact_name|customer|assignee|author|user|person|requester|signed_by)\"\s*:|this\s+is\s+(?=[A-Z]))"
_WEAK = r"(?:\bask|\b[Pp]lease\s+ask|thanks\s*,|thank\s+you\s*,|regards\s*,|best\s*,|cheers\s*,|sincerely\s*,|obrigad[oa]\s*,|gracias\s*,|saludos\s*,|atentamente\s*,|atenciosamente\s*,|abra[çc]os?\s*,|dear|hi|hello|ol[áa]|hola|mr\.?|mrs\.?|ms\.?|dr\.?|sr\.?|sra\.?|dra\.?)"
_STRONG_NAME = re.compile(rf"(?i:(?<![\w]){_STRONG})[\s\"“:]*(?P<n>{_MIXED}|{_UPPER}|{_LOWER})")
_WEAK_NAME = re.compile(rf"(?i:(?<![\w]){_WEAK.replace(chr(92) + 'b', '')})[ \t\n]+(?P<n>{_MIXED}|{_UPPER})")
_THANKS_LOWER = re.compile(rf"(?i:(?<!\w)(?:(?:please\s+)?ask|thanks\s*,|thank\s+you\s*,|regards\s*,|obrigad[oa]\s*,|gracias\s*,|saludos\s*,))[ \t]+(?P<n>{_LOWER_TOKEN}[ \t]+{_LOWER_TOKEN})(?=[ \t]+(?:to|para)\b|\s*(?:$|\n|[.\"!])|[ \t]+[A-ZÀ-Þ¿(+\d]|[ \t]+\w+:)")
_MAIL_NAME = re.compile(rf"(?<![\w])(?P<n>{_MIXED}|{_UPPER}|{_LOWER})[ \t]*<(?:mailto:)?[^<>\s]*@")
_ALONE_NAME = re.compile(rf"(?:(?<=^)|(?<=\n)|(?<=\")|(?<=\\n)|(?<=[.!?][ \t]))[ \t]*(?P<n>{_MIXED}|{_UPPER})[ \t]*(?=$|\n|\"|\\n)")
# A line, sentence or quoted value of two or three lower-case words, none of them a common word.
_ALONE_LOWER = re.compile(r"(?:(?<=^)|(?<=\n)|(?<=[.!?] )|(?<=\"))(?P<n>[a-zß-ÿ]{3,}(?:-[a-zß-ÿ]+)?(?: [a-zß-ÿ]{3,}(?:-[a-zß-ÿ]+)?){1,2})(?=$|\n|\")")
_RUN_ON = re.compile(rf"(?:(?<=^)|(?<=\n)|(?<=\")|(?<=\\n)|(?<=[.!?][ \t]))(?P<n>{_NAME_TOKEN}(?:[ \t]+{_NAME_TOKEN}){{1,2}}|{_NAME_TOKEN},[ \t]+{_NAME_TOKEN}|{_INITIAL}[ \t]+{_NAME_TOKEN})(?=[ \t]+[A-ZÀ-Þ¿\"\d(+])")
# Words that are no part of a person's name though they stand where one could: the function words of three languages, and
# fixed values: words of teams, products, dates and of how sentences begin.
_NO_NAME = frozenset(w for lang in ("en", "pt", "es") for w in FUNCTION_WORDS[lang].split()) | frozenset(
    "admin administrator agent agente assistant atendimento bot center centre cloud console customer customers department dept desk engine equipe equipo "
    "gateway group helpdesk lab labs lane loop manager office operator platform portal product project projeto proyecto server service services servicio "
    "serviço soporte store street suite suporte support system team ticket user usuario usuário "
    "january february april june july august september october november december monday tuesday wednesday thursday friday saturday sunday march "
    "english french german portuguese spanish address build call contact field limit name names number order phone port ref route run security social value version "
    "any did does had happy her his hope let most never nobody none note null false true our remember restart since start sure thanks they those time wait whoever yes "
    "check compare good open reach regards save batch claro existem movemos movimos nadie ninguém tanto conviene convém recuerda lembre "
    "abra abre compara confira espera espere guarda reinicia reinicie revisa salve he nach sobald wenn".split()
)


# A name inside a sentence: two or three capitalised words, initials and particles among them.
_INNER_NAME = re.compile(rf"(?<![\w.@/'’-])(?P<n>{_NAME_TOKEN}(?:[ \t]+{_INITIAL})?(?:[ \t]+(?:{_PART}[ \t]+)?{_NAME_TOKEN}){{1,2}})(?![\w@/])(?![ \t]+{_NAME_TOKEN})")
_LOWER_WORD = re.compile(r"(?<![\w.@/-])[a-zß-ÿ]{3,}(?![\w@])")
GIVEN, SURNAME, COMMON = range(3)
ROWS, BUCKETS = 2, 1 << 17


def _places(word: str) -> list[int]:
    return [r * BUCKETS + xxhash.xxh32_intdigest(word, r) % BUCKETS for r in range(ROWS)]


class Evidence:
    """In how many records, at most, a word is a given name or a surname after a cue, or a word in lower case (a count-min sketch)."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(3, ROWS * BUCKETS)
        # A bucket holds that many by chance; only what stands out of it counts.
        self.floor = 2 + 3 * self.counts.mean(axis=1)

    def shows(self, kind: int, word: str) -> bool:
        word = word.lower()
        return min(self.counts[kind, at] for at in _places(word)) >= self.floor[kind]

    def is_person(self, name: str) -> bool:
        """The given name is known from cues, and no word but a known one is common in lower case. A known surname alone isn't enough: in some
        languages every noun is capitalised."""
        words = [w for w in _name_words(name)]
        if len(words) < 2:
            return False
        known = [self.shows(GIVEN, words[0]), *(False for _ in words[2:]), self.shows(SURNAME, words[-1])]
        return known[0] and not any(self.shows(COMMON, w) for w, k in zip(words, known) if not k)

    def is_common(self, name: str) -> bool:
        """Every word is used in lower case elsewhere, and neither end is known from cues."""
        words = _name_words(name)
        return bool(words) and all(self.shows(COMMON, w) for w in words) and not self.shows(GIVEN, words[0]) and not self.shows(SURNAME, words[-1])


def _name_words(name: str) -> list[str]:
    """The words of a name in the order given name to surname, without initials and particles."""
    if "," in name:
        last, _, first = name.partition(",")
        name = f"{first} {last}"
    return [w for w in re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", name) if len(w) > 1 and not re.fullmatch(_PART, w)]


class Tracked:
    """A text with, for each of its characters, the source span it came from."""

    __slots__ = ("spelled", "starts", "stops", "text")

    def __init__(self, text: str):
        self.text, self.starts, self.stops, self.spelled = text, None, None, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint spans, given in order; each new character stands for its whole span."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.stops = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, stops, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            stops += self.stops[at:a]
            text.append(new)
            starts += [self.starts[a]] * len(new)
            stops += [self.stops[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.starts, self.stops = starts + self.starts[at:], stops + self.stops[at:]
        self.text = "".join(text)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.stops[b - 1])


def _fold(t: Tracked) -> None:
    edits = []
    for m in _ODD.finditer(t.text):
        c = m[0]
        new = "" if _HIDDEN.match(c) else _LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if new and new.isspace() and c != "\n":
            new = " "
        if new != c:
            edits.append((m.start(), m.end(), new))
    t.rewrite(edits)


def _read_digits(words: str) -> str:
    out, times = [], 1
    for w in re.findall(r"[^\W_]+", words.lower()):
        if w in _TIMES:
            times = _TIMES[w]
        else:
            out.append(_DIGIT.get(w, w) * times)
            times = 1
    return "".join(out)


def _unescape_json(t: Tracked) -> None:
    """Escapes of JSON text as the characters they stand for."""
    if "\\" in t.text and t.text.lstrip()[:1] in ("{", "["):
        t.rewrite([(m.start(), m.end(), chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[0][1], m[0][1])) for m in _JSON_ESCAPE.finditer(t.text)])


# What a text must hold for a detector to find anything in it.
_AT = re.compile(r"@|&#64;|&commat;|%40|\b(?:at|arroba)\b", re.I)
_DOT = re.compile(r"\b(?:dot|ponto|punto)\b|[\[({<]\s*\.|\s\.\s", re.I)
_SIGNED = re.compile(r"@|&#64;|&commat;|%40|[\[({<]\s*(?:at|arroba)\s*[\])}>]", re.I)
_SEVEN_DIGITS = re.compile(r"(?:\d\D*){7}")
_STREET = re.compile(r"\b(?:street|st|avenue|ave|road|rd|lane|ln|crescent|cres|boulevard|blvd|drive|dr|court|ct|close|terrace|place|pl|square|sq|way|row|parkway|highway|hwy|alley|mews|grove|rua|r|avenida|avda|av|travessa|trav|alameda|al|pra[çc]a|p[çc]a|largo|estrada|rodovia|calle|c|plaza|pza|paseo|p[ºo]|camino|carretera|ctra|ronda|pasaje|callej[óo]n|glorieta|costanilla|cuesta)\b", re.I)


def normalise(text: str) -> Tracked:
    t = Tracked(text)
    _unescape_json(t)
    _fold(t)
    if re.search(r"[A-Za-z]", t.text):
        edits = [(m.start(), m.end(), _read_digits(m.group())) for m in _SPELLED.finditer(t.text) if re.search(r"[A-Za-z]", m.group()) and len(_read_digits(m.group())) >= 6]
        t.spelled = [t.source(a, b) for a, b, digits in edits if 7 <= len(digits) <= 15]
        t.rewrite(edits)
    if not _AT.search(t.text):
        return t
    dotted = bool(_DOT.search(t.text))
    for p, may in zip(_DISGUISED, (bool(_SIGNED.search(t.text)), dotted, dotted and "@" in t.text)):
        if not may:
            continue
        edits = []
        for m in p.finditer(t.text):
            clean = re.sub(_DOT_WORD, ".", m["local"], flags=re.I) + "@" + re.sub(_DOT_WORD, ".", m["domain"], flags=re.I)
            if re.search(r"\.[A-Za-z][A-Za-z-]+$", clean):
                edits.append((m.start(), m.end(), clean))
        t.rewrite(edits)
    return t


def _is_name(s: str) -> bool:
    words = [w for w in re.findall(r"[^\W\d_]+\.?", s) if not re.fullmatch(_PART, w)]
    full = [w for w in words if len(w) > 1 and not w.endswith(".") or len(w) > 2]
    return bool(full) and len(words) >= 2 and not any(w.lower().rstrip(".") in _NO_NAME for w in full)


def _trim_name(s: str) -> str:
    """Leave off what follows the name when a sentence starts right after it."""
    for m in list(re.finditer(r"\S+", s))[1:]:
        if m.group().strip(",.").lower() in _NO_NAME and not re.fullmatch(rf"{_PART}|[A-Z]\.", m.group()):
            return s[: m.start()].rstrip()
    return s


def cued_names(s: str) -> list[str]:
    """Names that a phrase before them or a mail address after them shows."""
    found = [_trim_name(m["n"]) for p in (_STRONG_NAME, *((_MAIL_NAME,) if "<" in s and "@" in s else ()), _WEAK_NAME) for m in p.finditer(s)]
    return [n for n in found if _is_name(n)]


def find(text: str | None, evidence: Evidence | None = None) -> list[tuple[int, int, str]]:
    """Disjoint (start, stop, kind) in source characters, in order. A null text has none. Without evidence from other texts
    names inside sentences aren't looked for, and lines of their own aren't doubted."""
    if not text:
        return []
    t = normalise(text)
    s = t.text
    taken: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not any(x < b and a < y for x, y, _ in taken):
            taken.append((a, b, kind))

    if "@" in s:
        for m in _EMAIL.finditer(s):
            add(*m.span(), "email")
    if re.search(r"\d", s):
        for p in _ADDRESSES if _STREET.search(s) else ():
            for m in p.finditer(s):
                add(*m.span(), "address")
    if _SEVEN_DIGITS.search(s):
        for p in _IDS:
            for m in p.finditer(s):
                a, b = m.span("n") if "n" in p.groupindex else m.span()
                if 7 <= sum(c.isdigit() for c in s[a:b]) <= 14:
                    add(a, b, "national_id")
        for p in _PHONES:
            for m in p.finditer(s):
                a, b = m.span("n") if "n" in p.groupindex else m.span()
                if 7 <= sum(c.isdigit() for c in s[a:b]) <= 15 and not re.fullmatch(r"\d{4}-\d\d-\d\d.*", s[a:b]):
                    add(a, b, "phone")
    mailed = (_MAIL_NAME,) if "<" in s and "@" in s else ()
    for p in (_STRONG_NAME, *mailed, _WEAK_NAME, _THANKS_LOWER, _ALONE_NAME, _ALONE_LOWER, _RUN_ON):
        doubted = evidence is not None and p in (_ALONE_NAME, _ALONE_LOWER, _RUN_ON)
        for m in p.finditer(s):
            name = _trim_name(m["n"])
            if _is_name(name) and not (doubted and evidence.is_common(name)):
                add(m.start("n"), m.start("n") + len(name), "person_name")
    if evidence is not None:
        for m in _INNER_NAME.finditer(s):
            if _is_name(m["n"]) and evidence.is_person(m["n"]):
                add(*m.span("n"), "person_name")
    out = []
    found = [(*t.source(a, b), kind) for a, b, kind in taken]
    # Nobody spells digits one by one but for a number to be dialled, if it is no identity number.
    found += [(a, b, "phone") for a, b in t.spelled if not any(x < b and a < y for x, y, _ in found)]
    for x, y, kind in sorted(found):
        if not out or x >= out[-1][1]:
            out.append((x, y, kind))
    return out


def redact(text: str | None, evidence: Evidence | None = None) -> str | None:
    """The text with a typed placeholder for each finding; null stays null."""
    return None if text is None else _replaced(text, find(text, evidence))


def _replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*parts, text[at:]])


def _count(batches):
    """Sketch counts of the words of cued names and of words in lower case, each once a record."""
    for pdf in batches:
        seen = [Counter(), Counter(), Counter()]
        for text in pdf["text"]:
            if text is None:
                continue
            t = Tracked(text)
            _unescape_json(t)
            _fold(t)
            common = set(_LOWER_WORD.findall(t.text))
            for p in (_ALONE_LOWER, _THANKS_LOWER):
                for m in p.finditer(t.text):
                    # What may be a name itself shows nothing of its words, unless they are used elsewhere in the text.
                    rest = t.text[: m.start("n")] + "\n" + t.text[m.end("n") :]
                    common &= set(_LOWER_WORD.findall(rest))
            for name in cued_names(t.text):
                words = [w.lower() for w in _name_words(name)]
                common.difference_update(words)
                if len(words) > 1:
                    seen[GIVEN][words[0]] += 1
                    seen[SURNAME][words[-1]] += 1
            seen[COMMON].update(common)
        total = np.zeros((3, ROWS * BUCKETS), np.int64)
        for kind, counter in enumerate(seen):
            for word, n in counter.items():
                for at in _places(word):
                    total[kind, at] += n
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"at": at, "n": flat[at]})


def name_evidence(texts: DataFrame) -> Evidence:
    """Evidence from the column ``text``: all rows, of which no more than the sketch reaches the driver."""
    counts = spread(texts.select("text").where("text is not null")).mapInPandas(_count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(3 * ROWS * BUCKETS, np.int64)
    total[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return Evidence(np.minimum(total, 2**31 - 1).astype(np.int32))


def _scan(evidence):
    def run(batches):
        own = evidence.value
        for pdf in batches:
            kinds, clean = [], []
            for text in pdf["text"]:
                found = find(text, own)
                kinds.append(sorted({k for _, _, k in found}))
                clean.append(_replaced(text, found) if found else text)
            yield pd.DataFrame({"record_id": pdf["record_id"], "kinds": kinds, "redacted": clean})

    return run


def _kinds(evidence):
    def run(batches):
        own = evidence.value
        for pdf in batches:
            found = [sorted({k for _, _, k in find(text, own)}) for text in pdf["text"]]
            yield pd.DataFrame({"record_id": pdf["record_id"], "kinds": found})

    return run


def redact_column(df: DataFrame, id_col: str, text_col: str, evidence: Evidence | None = None) -> DataFrame:
    """(record_id, kinds, redacted): each distinct id and text with the kinds it holds and the text with placeholders.

    Without ``evidence`` the column's own texts give it. Null texts hold nothing and stay null; rows with a null id are kept, under a
    null record_id. Repeated rows come out once. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(name_evidence(rows) if evidence is None else evidence)
    schema = T.StructType([T.StructField("record_id", rows.schema["record_id"].dataType), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("redacted", T.StringType())])
    return spread(rows).mapInPandas(_scan(shared), schema).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _tables(tables: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    return {name: df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).cast("string").alias("text")) for name, (df, id_col, text_col) in tables.items()}


def redact_tables(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(source_table, record_id, kinds, redacted) over several tables, given as name -> (rows, id column, text column), with
    evidence from all of them. Rows as for ``redact_column``."""
    rows = _tables(tables)
    evidence = name_evidence(_union([r.select("text") for r in rows.values()]))
    return _union([redact_column(r, "record_id", "text", evidence).select(F.lit(name).alias("source_table"), "record_id", "kinds", "redacted") for name, r in rows.items()])


def personal_information(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(source_table, record_id, kind) over several tables, given as name -> (rows, id column, text column), with evidence
    from all of them. Rows with a null id or text hold nothing; repeated rows count once; empty tables give nothing."""
    rows = {name: r.where("record_id is not null and text is not null") for name, r in _tables(tables).items()}
    evidence = name_evidence(_union([r.select("text") for r in rows.values()]))
    shared = next(iter(rows.values())).sparkSession.sparkContext.broadcast(evidence)
    parts = [spread(r).mapInPandas(_kinds(shared), "record_id string, kinds array<string>").select(F.lit(name).alias("source_table"), "record_id", F.explode("kinds").alias("kind")) for name, r in rows.items()]
    return _union(parts).distinct()
