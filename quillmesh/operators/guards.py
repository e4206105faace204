"""Guards as columns, and chains of guards as an ordered fold over the rows.

A guard maps a text column to a verdict struct. A chain keeps four columns: the text as far as it was
modified, and the guard, reason and message of the first block. Blocked rows keep their verdict, and
later guards are not evaluated for them (CASE is lazy for native expressions; guards backed by Python
are run on the rows that are not blocked only).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.patterns import INJECTION, PII
from quillmesh.functions.text import utf16_length

VERDICT = "struct<action:string,reason_code:string,message:string,text:string>"
INPUT, OUTPUT = "input", "output"


def verdict(action: str, reason: Column | None = None, message: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(action).alias("action"),
        (none if reason is None else reason).alias("reason_code"),
        (none if message is None else message).alias("message"),
        (none if text is None else text).alias("text"),
    )


def passed() -> Column:
    return verdict("pass")


def blocked(reason: str, message: str | Column) -> Column:
    return verdict("block", F.lit(reason), F.lit(message) if isinstance(message, str) else message)


def modified(text: Column, reason: str) -> Column:
    return verdict("modify", F.lit(reason), None, text)


@dataclass(frozen=True)
class Guard:
    """A named guard. ``check(text, direction)`` gives a verdict column; null text passes.

    ``rows``, if set, is used instead: (DataFrame, name of the text column, direction) -> the same with ``__verdict`` added.
    """

    guard_id: str
    check: Callable[[Column, str], Column] | None = None
    rows: Callable[[DataFrame, str, str], DataFrame] | None = field(default=None, compare=False)

    def verdict_of(self, text: Column, direction: str = INPUT) -> Column:
        return F.when(text.isNull(), passed()).otherwise(self.check(text, direction))


def max_length(max_input: int | None = None, max_output: int | None = None) -> Guard:
    """Blocks texts longer than the limit of their direction, counted in UTF-16 units; null passes."""

    def check(text: Column, direction: str) -> Column:
        limit = max_input if direction == INPUT else max_output
        if limit is None:
            return passed()
        long = utf16_length(text)
        said = F.concat(F.lit(f"{direction.capitalize()} length "), long.cast("string"), F.lit(f" exceeds the maximum of {limit}"))
        return F.when(long > limit, blocked(f"{direction}-too-long", said)).otherwise(passed())

    return Guard("max-length", check)


def redact_cards(text: Column) -> Column:
    """Digit runs that look like card numbers, of 13 to 19 digits with a valid check digit, become a placeholder."""
    pattern, placeholder = PII["CREDIT_CARD"]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(card: Column) -> Column:
        digits = F.regexp_replace(card, "[ -]", "")
        return F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(placeholder)).otherwise(card)

    between = F.split(text, pattern, -1)
    whole = F.zip_with(between, F.transform(found, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(whole, "")).otherwise(text)


def redact_pattern(text: Column, name: str) -> Column:
    if name == "CREDIT_CARD":
        return redact_cards(text)
    pattern, placeholder = PII[name]
    return F.regexp_replace(text, pattern, placeholder)


def redact_pii(text: Column, names: Iterable[str] | None = None) -> Column:
    """All named patterns, always in the order of ``PII`` whatever order they are given in."""
    wanted = set(PII if names is None else names)
    if unknown := wanted - set(PII):
        raise ValueError(f"unknown patterns: {sorted(unknown)}")
    return functools.reduce(redact_pattern, [n for n in PII if n in wanted], text)


def pii(names: Iterable[str] | None = None) -> Guard:
    names = None if names is None else tuple(names)

    def check(text: Column, direction: str) -> Column:
        clean = redact_pii(text, names)
        return F.when(clean != text, modified(clean, "pii-redacted")).otherwise(passed())

    return Guard("regex-pii", check)


def injection_patterns(categories: Iterable[str] | None = None, extra: Iterable[str] = ()) -> list[str]:
    return [INJECTION[c] for c in (INJECTION if categories is None else categories)] + list(extra)


def matches_injection(text: Column, patterns: list[str]) -> Column:
    """True if any pattern is found; one alternation, so the text is scanned once. False for no patterns."""
    if not patterns:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def injection_categories(text: Column) -> Column:
    """The names of all matching categories, in their order; empty for null."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in INJECTION.items()]))


def prompt_injection(categories: Iterable[str] | None = None, extra: Iterable[str] = ()) -> Guard:
    patterns = injection_patterns(categories, extra)

    def check(text: Column, direction: str) -> Column:
        if direction != INPUT or not patterns:
            return passed()
        return F.when(matches_injection(text, patterns), blocked("prompt-injection-suspected", "The input reads like an attempt to inject a prompt")).otherwise(passed())

    return Guard("prompt-injection", check)


_STATE = "struct<guarded_text:string,action:string,guard_id:string,reason_code:string,message:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), 0)


def _state(text: Column, action: Column, guard_id: Column, reason: Column, message: Column) -> Column:
    return F.struct(text.alias("guarded_text"), action.alias("action"), guard_id.alias("guard_id"), reason.alias("reason_code"), message.alias("message"))


def _after(state: Column, found: Column, guard_id: str) -> Column:
    """The state after a guard's verdict: a block keeps the text and a modification takes the guard's."""
    gid, none = F.lit(guard_id), F.lit(None).cast("string")
    text = lambda v: F.when(v["action"] == "modify", v["text"]).otherwise(state["guarded_text"])
    return let(found, lambda v: F.when(v["action"].isin("block", "modify"), _state(text(v), v["action"], gid, v["reason_code"], F.coalesce(v["message"], none))).otherwise(state))


class GuardChain:
    """An ordered chain. ``run`` adds guarded_text, action, guard_id, reason_code and message.

    The chain is one expression: each verdict is bound once, so the plan holds each pattern once, however
    long the chain is. Only guards that run in Python split it.
    """

    def __init__(self, guards: Iterable[Guard]):
        self.guards = list(guards)

    def run(self, df: DataFrame, text_col: str, direction: str = INPUT, prefix: str = "") -> DataFrame:
        """Null texts pass. Names of added columns start with ``prefix``; columns of those names are replaced."""
        none = F.lit(None).cast("string")
        state = _state(F.col(f"`{text_col}`").cast("string"), F.lit("pass"), none, none, none)
        for guard in self.guards:
            if guard.rows is not None:
                df = df.withColumn("__state", state.cast(_STATE))
                # Blocked rows are not shown to the guard: it gets null for them.
                df = df.withColumn("__text", F.when(F.col("__state.action") != "block", F.col("__state.guarded_text")))
                df = guard.rows(df, "__text", direction)
                state = _after(F.col("__state"), F.col("__verdict"), guard.guard_id)
                df = df.withColumn("__state", state).drop("__text", "__verdict")
                state = F.col("__state")
            else:
                check = functools.partial(lambda g, s: F.when(s["action"] == "block", s).otherwise(_after(s, g.verdict_of(s["guarded_text"], direction), g.guard_id)), guard)
                state = let(state, check)
        df = df.withColumn("__state", state.cast(_STATE))
        return df.withColumns({f"{prefix}{c}": F.col("__state")[c] for c in ("guarded_text", "action", "guard_id", "reason_code", "message")}).drop("__state")


def block_message(guard_id: Column, reason: Column, message: Column) -> Column:
    """The text of the error that a block raises."""
    return F.concat(F.lit("Guard '"), guard_id, F.lit("' blocked the request ["), reason, F.lit("]: "), message)


def filter_untrusted(df: DataFrame, content_col: str, chain: GuardChain) -> DataFrame:
    """Rows whose content no guard blocks, with the content as modified; order and other columns stay."""
    if not chain.guards:
        return df
    names = df.columns
    ran = chain.run(df, content_col, INPUT, prefix="__").where(F.col("__action") != "block")
    return ran.withColumn(content_col, F.col("__guarded_text")).select(*[F.col(f"`{c}`") for c in names])


WITHHELD = "Tool result withheld by security policy"


def guard_tool_result(df: DataFrame, content_col: str, chain: GuardChain) -> DataFrame:
    """Content of tool results that a guard blocks becomes a fixed text; null content becomes empty."""
    names = df.columns
    ran = chain.run(df, content_col, INPUT, prefix="__")
    text = F.when(F.col("__action") == "block", F.lit(WITHHELD)).otherwise(F.coalesce("__guarded_text", F.lit("")))
    return ran.withColumn(content_col, text).select(*[F.col(f"`{c}`") for c in names])


def injection_guards(mode: str) -> list[Guard]:
    """The guards of a mode: none for off, plain and encoded for on, strict decoding for strict."""
    from quillmesh.operators.encoded import encoded_injection

    return [] if mode == "off" else [prompt_injection(), encoded_injection(strict=mode == "strict")]


def server_chain(max_input_chars: int = 4000, mode: str = "on") -> GuardChain:
    """The default input chain: length, personal data, then the injection guards of the mode."""
    return GuardChain([max_length(max_input=max_input_chars), pii(), *injection_guards(mode)])


def parse_mode(raw: str | None) -> str:
    """on (also true, 1, blank, none), strict, or off (also false, 0), case and blanks aside; else an error."""
    value = (raw or "").strip().lower()
    for mode, names in {"on": ("", "on", "true", "1"), "strict": ("strict",), "off": ("off", "false", "0")}.items():
        if value in names:
            return mode
    raise ValueError(f"unknown injection guard mode: {raw!r}")
