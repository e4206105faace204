"""Fixed values of the guards: patterns, placeholders and look-alike letters, in Java regex syntax."""

from __future__ import annotations

# Personal data patterns with their placeholders, in the order in which they are applied.
PII = {
    "EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL_REDACTED]"),
    "PHONE": (r"\+?\d{1,3}?[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}", "[PHONE_REDACTED]"),
    "API_KEY": (r"sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}", "[API_KEY_REDACTED]"),
    "IPV4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    "CREDIT_CARD": (r"\b(?:\d[ -]?){13,19}\b", "[CREDIT_CARD_REDACTED]"),
}

# Prompt-injection heuristics by name. Case folding is ASCII only.
INJECTION = {
    "IGNORE_INSTRUCTIONS_PT": r"(?i)ignor[ae]\s+(todas\s+)?(as\s+|suas\s+)?instru[cç][õo]es\s+(anterior(es)?|acima|pr[ée]via)",
    "IGNORE_INSTRUCTIONS_EN": r"(?i)ignore\s+(all\s+|your\s+|any\s+)?(previous|prior|above|earlier)\s+instructions",
    "DISREGARD_INSTRUCTIONS_PT": r"(?i)desconsidere\s+(as\s+)?instru[cç][õo]es\s+(anterior(es)?|acima)",
    "DISREGARD_INSTRUCTIONS_EN": r"(?i)disregard\s+(all\s+|your\s+)?(previous|prior|above)\s+(instructions|rules|prompt)",
    "FORGET_RULES_PT": r"(?i)esque[cç]a\s+(todas\s+)?(as\s+)?(suas\s+)?regras",
    "FORGET_RULES_EN": r"(?i)forget\s+(all\s+|your\s+)?(previous\s+)?(rules|instructions|guidelines)",
    "REVEAL_SYSTEM_PROMPT_PT": r"(?i)revele?\s+(o\s+|seu\s+)?system\s*prompt",
    "REVEAL_SYSTEM_PROMPT_EN": r"(?i)reveal\s+(your|the)\s+system\s*prompt",
    "SHOW_SYSTEM_INSTRUCTIONS_PT": r"(?i)(mostre|exiba|imprima|repita)\s+(suas\s+|as\s+)?instru[cç][õo]es\s+(de\s+sistema|iniciais)",
    "SHOW_SYSTEM_INSTRUCTIONS_EN": r"(?i)(show|print|repeat)\s+(me\s+)?your\s+(system\s+)?(prompt|instructions)",
    "ASK_ORIGINAL_INSTRUCTIONS_EN": r"(?i)what\s+(are|were)\s+your\s+(original\s+)?instructions",
    "ASK_ORIGINAL_INSTRUCTIONS_PT": r"(?i)quais\s+s[aã]o\s+suas\s+instru[cç][õo]es\s+(originais|iniciais|de\s+sistema)",
    "ROLE_OVERRIDE_PT": r"(?i)voc[eê]\s+agora\s+[ée]\s+",
    "ROLE_OVERRIDE_EN": r"(?i)you\s+are\s+now\s+",
    "FROM_NOW_ON_EN": r"(?i)from\s+now\s+on\s*,?\s+you\s+(are|will|must)",
    "FROM_NOW_ON_PT": r"(?i)a\s+partir\s+de\s+agora\s*,?\s+voc[eê]\s+(é|deve|vai)",
    "PRETEND_NO_RULES_PT": r"(?i)finja\s+(que\s+)?(voc[eê]\s+)?(n[aã]o\s+tem|[ée])",
    "PRETEND_NO_RULES_EN": r"(?i)pretend\s+(that\s+)?you\s+(are|have\s+no)",
    "DEVELOPER_MODE_PT": r"(?i)modo\s+desenvolvedor",
    "DEVELOPER_MODE_EN": r"(?i)developer\s+mode",
    "DAN_JAILBREAK": r"(?i)\bDAN\b",
    "JAILBREAK_EN": r"(?i)jailbreak",
    "UNRESTRICTED_MODE_PT": r"(?i)modo\s+sem\s+restri[cç][õo]es",
    "UNRESTRICTED_MODE_EN": r"(?i)unrestricted\s+mode",
    "NO_SAFETY_FILTERS_PT": r"(?i)sem\s+filtros?\s+(de\s+seguran[cç]a|[ée]ticos)",
}

# Cyrillic and Greek letters and the Latin ones they look like.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԍ": "g", "һ": "h", "ӏ": "l", "ο": "o", "α": "a", "ε": "e", "ν": "v", "κ": "k"}

# The Morse alphabet.
MORSE = dict(
    zip(
        ".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.".split(),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        strict=True,
    )
)

# Digits and signs read as letters.
LEET = ("01!34@5$7", "oiieaasst")
ROT13 = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")
