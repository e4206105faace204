"""Guards of outputs: JSON shape, grounding verdicts of a judge, and replies of an external validator."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import is_blank
from quillmesh.operators.guards import INPUT, OUTPUT, Guard, blocked, modified, passed

# ---------------------------------------------------------------- JSON shape

_NAMES = {"string": "string", "integer": "integer", "number": "number", "boolean": "boolean", "object": "object", "array": "array", "null": "null"}


def _json_kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, boolean, null, integer or number."""
    of = F.schema_of_variant(v)
    return (
        F.when(of.startswith("OBJECT"), F.lit("object"))
        .when(of.startswith("ARRAY"), F.lit("array"))
        .when(of == "STRING", F.lit("string"))
        .when(of == "BOOLEAN", F.lit("boolean"))
        .when(of == "VOID", F.lit("null"))
        .when(of == "BIGINT", F.lit("integer"))
        .when(F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")), F.lit("integer"))
        .otherwise(F.lit("number"))
    )


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


_KEYWORDS = frozenset(
    "$schema $id $ref $defs definitions title description default examples type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern "
    "properties required additionalProperties minProperties maxProperties items minItems maxItems uniqueItems allOf anyOf oneOf not".split()
)


def _equals(node: Column, value) -> Column:
    """Whether a variant is a JSON value: numbers by value, the rest by kind and content."""
    kind = _json_kind(node)
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(node, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(node, "$", "double") == float(value))
    if value is None:
        return kind == "null"
    if isinstance(value, str):
        return (kind == "string") & (F.try_variant_get(node, "$", "string") == value)
    return F.to_json(node) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _resolve(root: dict, ref: str):
    if not ref.startswith("#"):
        raise ValueError(f"only references within the schema are supported: {ref}")
    at = root
    for step in ref[1:].split("/")[1:]:
        at = at[step.replace("~1", "/").replace("~0", "~")]
    return at


def schema_errors(v: Column, schema: dict | bool, path: str = "$", root: dict | None = None, depth: int = 0) -> list[Column]:
    """Columns that hold error messages of a variant or null, for the keywords in ``_KEYWORDS``; any other is refused.

    A reference that leads into itself is refused too: the schema is unrolled into columns."""
    root = schema if root is None else root
    if depth > 32:
        raise ValueError("the schema is nested too deep, or refers to itself")
    there = v.isNotNull()
    errors: list[Column] = []

    def check(bad: Column, said: str) -> None:
        errors.append(F.when(there & F.coalesce(bad, F.lit(False)), F.lit(f"{path}: {said}")))

    if isinstance(schema, bool):
        if not schema:
            check(F.lit(True), "is not allowed")
        return errors
    if unknown := set(schema) - _KEYWORDS:
        raise ValueError(f"unsupported schema keywords: {sorted(unknown)}")
    inner = lambda x, s, at=path: schema_errors(x, s, at, root, depth + 1)
    fits = lambda x, s: ~F.exists(F.array(*(inner(x, s) or [F.lit(None)])).cast("array<string>"), lambda e: e.isNotNull())
    kind = _json_kind(v)
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    is_number, is_text, is_object, is_array = kind.isin("integer", "number"), kind == "string", kind == "object", kind == "array"
    if "$ref" in schema:
        errors += inner(v, _resolve(root, schema["$ref"]))
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        allowed = {_NAMES[w] for w in wanted} | ({"integer"} if "number" in wanted else set())
        check(~kind.isin(*sorted(allowed)), f"expected {' or '.join(wanted)}")
    for key, bad in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x), ("multipleOf", lambda x: F.abs(number / x - F.round(number / x)) > 1e-9)):
        if key in schema:
            check(is_number & bad(F.lit(float(schema[key]))), f"must respect {key} {schema[key]}")
    for key, bad in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x)):
        if key in schema:
            check(is_text & bad(schema[key]), f"must respect {key} {schema[key]}")
    if "pattern" in schema:
        check(is_text & ~text.rlike(schema["pattern"]), f"must match {schema['pattern']}")
    for key in ("enum", "const"):
        if key in schema:
            values = schema["enum"] if key == "enum" else [schema["const"]]
            one_of = functools.reduce(lambda x, y: x | y, [F.coalesce(_equals(v, x), F.lit(False)) for x in values], F.lit(False))
            check(~one_of, f"must be one of {json.dumps(values, ensure_ascii=False)}")
    keys = F.json_object_keys(F.to_json(v))
    for name in schema.get("required", ()):
        check(is_object & ~F.coalesce(F.array_contains(keys, name), F.lit(False)), f"required property '{name}' is missing")
    for key, bad in (("minProperties", lambda x: F.size(keys) < x), ("maxProperties", lambda x: F.size(keys) > x)):
        if key in schema:
            check(is_object & bad(schema[key]), f"must respect {key} {schema[key]}")
    more = schema.get("additionalProperties", True)
    if more is not True:
        if more is not False:
            raise ValueError("additionalProperties is supported as true or false only")
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
        check(is_object & (F.size(extra) > 0), "has properties that are not allowed")
    for name, of in schema.get("properties", {}).items():
        quoted = name.replace("'", "\\'")
        step = f"['{quoted}']" if not name.isidentifier() else f".{name}"
        errors += inner(F.when(is_object, _at(v, "$" + step)), of, path + step)
    parts = F.when(is_array, F.try_variant_get(v, "$", "array<variant>"))
    for key, bad in (("minItems", lambda x: F.size(parts) < x), ("maxItems", lambda x: F.size(parts) > x)):
        if key in schema:
            check(is_array & bad(schema[key]), f"must respect {key} {schema[key]}")
    if schema.get("uniqueItems"):
        check(is_array & (F.size(F.array_distinct(F.transform(parts, lambda x: F.to_json(x)))) < F.size(parts)), "items must differ")
    if "items" in schema:
        said = F.flatten(F.transform(parts, lambda x: F.array_compact(F.array(*(inner(x, schema["items"], path + "[*]") or [F.lit(None)])).cast("array<string>"))))
        errors.append(F.when(there & is_array & (F.size(said) > 0), F.array_join(F.array_distinct(said), "; ")))
    for of in schema.get("allOf", ()):
        errors += inner(v, of)
    if "anyOf" in schema:
        check(~functools.reduce(lambda x, y: x | y, [fits(v, of) for of in schema["anyOf"]]), "must fit one of the alternatives")
    if "oneOf" in schema:
        count = functools.reduce(lambda x, y: x + y, [fits(v, of).cast("int") for of in schema["oneOf"]])
        check(count != 1, "must fit exactly one of the alternatives")
    if "not" in schema:
        check(fits(v, schema["not"]), "must not fit what is ruled out")
    return errors


def json_schema(schema: dict) -> Guard:
    """Output guard: null, blank or malformed text is output-not-json; violations are output-schema-mismatch."""

    def check(text: Column, direction: str) -> Column:
        if direction != OUTPUT:
            return passed()
        v = F.try_parse_json(text)
        errors = F.array_compact(F.array(*schema_errors(v, schema)).cast("array<string>"))
        return (
            F.when(is_blank(text) | v.isNull(), blocked("output-not-json", "Output is not valid JSON"))
            .when(F.size(errors) > 0, blocked("output-schema-mismatch", F.array_join(errors, "; ")))
            .otherwise(passed())
        )

    class _NullToo(Guard):
        def verdict_of(self, text: Column, direction: str = INPUT) -> Column:
            return self.check(text, direction)

    return _NullToo("json-schema", check)


# ---------------------------------------------------------------- grounding

NO_REASON = "the judge gave none"
# The labels of a judge's reply.
_CONFIDENCE = r"(?i)CONFIDENCE\s*:\s*([0-9]*\.?[0-9]+)"
_REASON = r"(?i)REASON\s*:\s*(.+)"


def judge_prompt(context: Column, response: Column) -> Column:
    """What a judge is asked: to compare a response with its context and to answer in three labelled lines."""
    return F.concat(
        F.lit("Check the answer below against the context below.\nReply with these three lines and nothing else:\nVERDICT: GROUNDED or UNGROUNDED\nCONFIDENCE: a number between 0 and 1\nREASON: one short sentence\n\nContext:\n"),
        context,
        F.lit("\n\nAnswer:\n"),
        F.coalesce(response, F.lit("")),
    )


def judge_context(chunks: Column) -> Column:
    """Contents of the chunks in order, a rule between them; null contents are empty."""
    return F.array_join(F.transform(chunks, lambda c: F.coalesce(c["content"], F.lit(""))), "\n---\n")


def parse_grounding(judge: Column) -> Column:
    """struct(grounded, confidence, reason) of a judge's reply; what can't be read counts as grounded.

    The confidence is the first number after its label, within 0 and 1, or 0.0; the reason is the rest of
    its line, trimmed, or empty.
    """
    upper = F.upper(judge)
    ungrounded, said = F.contains(upper, F.lit("UNGROUNDED")), F.contains(upper, F.lit("GROUNDED"))
    number = F.regexp_extract(judge, _CONFIDENCE, 1).try_cast("double")
    readable = F.coalesce(~is_blank(judge) & said, F.lit(False))
    return F.struct(
        F.coalesce(~(readable & ungrounded), F.lit(True)).alias("grounded"),
        F.when(readable, F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(readable, F.trim(F.regexp_extract(judge, _REASON, 1))).otherwise(F.lit("")).alias("reason"),
    )


def grounding_verdict(text: Column, has_chunks: Column, judge: Column, *, strict: bool = False, min_confidence: float = 0.5, note: str = "parts of this answer may not follow from the sources") -> Column:
    """Pass without chunks, when grounded or when the judge isn't sure; else block (strict) or a note after the text."""
    v = parse_grounding(judge)
    reason = F.when(is_blank(v["reason"]), F.lit(NO_REASON)).otherwise(v["reason"])
    if strict:
        said = F.concat(F.lit("The answer does not follow from the sources (confidence "), v["confidence"].cast("string"), F.lit("): "), reason)
        flagged = blocked("ungrounded-response", said)
    else:
        flagged = modified(F.concat(F.coalesce(text, F.lit("")), F.lit(f"\n\n[{note} - "), reason, F.lit("]")), "ungrounded-response")
    return F.when(~has_chunks | v["grounded"] | (v["confidence"] < min_confidence), passed()).otherwise(flagged)


# ---------------------------------------------------------------- external validator


def external_verdict(text: Column, status: Column, body: Column, *, fail_open: bool = False, direction: str = INPUT, applies_to: str = "both") -> Column:
    """Verdict of a validator's HTTP reply. A null status stands for a call that failed.

    A refusal is a block even when failing open; anything unreadable is a failure, which blocks unless
    failing open; a text that the validator changed is a modification.
    """
    if applies_to not in ("both", direction):
        return passed()
    v = F.try_parse_json(body)
    detail = F.try_variant_get(v, "$.detail", "string")
    error = _at(v, "$.error")
    error_text = F.try_variant_get(v, "$.error", "string")
    has_error = error.isNotNull() & ~F.coalesce(_json_kind(error) == "null", F.lit(False)) & ~F.coalesce((_json_kind(error) == "string") & is_blank(error_text), F.lit(False))
    flag = _at(v, "$.validationPassed")
    flag_ok = F.coalesce(_json_kind(flag) == "boolean", F.lit(False))
    good = F.try_variant_get(v, "$.validationPassed", "boolean")
    out = _at(v, "$.validatedOutput")
    fixed = F.when(F.coalesce(_json_kind(out) == "string", F.lit(False)), F.try_variant_get(v, "$.validatedOutput", "string"))
    failure = passed() if fail_open else blocked("guardrails-ai-unavailable", "The validator could not be consulted")
    refused = blocked("guardrails-ai-validation-failed", "The validator refused the text")
    return (
        F.when(text.isNull(), passed())
        .when((status == 400) & F.coalesce(detail.startswith("Validation failed"), F.lit(False)), refused)
        .when(status.isNull() | ~status.between(200, 299), failure)
        .when(v.isNull() | ~F.coalesce(_json_kind(v) == "object", F.lit(False)), failure)
        .when(has_error, failure)
        .when(~flag_ok, failure)
        .when(~good, refused)
        .when(fixed.isNotNull() & (fixed != text), modified(fixed, "guardrails-ai-fixed"))
        .otherwise(passed())
    )


Caller = Callable[[DataFrame, str], DataFrame]


def grounding_guard(judge: Caller, chunks_col: str = "chunks", **options) -> Guard:
    """Output guard for rows with an array of chunks: asks the judge about texts that have some, and decides by ``grounding_verdict``.

    ``judge(df, prompt_col)`` adds ``judge_reply``; a null prompt isn't to be asked, and a null reply, as of a judge that failed, passes.
    Blocked rows, null texts, null or empty chunks and inputs aren't judged.
    """

    def rows(df: DataFrame, text_col: str, direction: str) -> DataFrame:
        if direction != OUTPUT:
            return df.withColumn("__verdict", passed())
        text = F.col(text_col)
        has = F.coalesce(F.size(F.col(chunks_col)) > 0, F.lit(False)) & text.isNotNull()
        asked = df.withColumn("__prompt", F.when(has, judge_prompt(judge_context(F.col(chunks_col)), text)))
        told = judge(asked, "__prompt")
        return told.withColumn("__verdict", grounding_verdict(text, has, F.col("judge_reply"), **options)).drop("__prompt", "judge_reply")

    return Guard("grounding", rows=rows)


def validator_guard(call: Caller, *, fail_open: bool = False, applies_to: str = "both") -> Guard:
    """Guard backed by an external validator. ``call(df, text_col)`` adds ``http_status`` and ``http_body``, as ``sources.http.validate`` does
    with its server and key bound. Null texts and blocked rows aren't sent, nor is anything in a direction it doesn't apply to."""

    def rows(df: DataFrame, text_col: str, direction: str) -> DataFrame:
        if applies_to not in ("both", direction):
            return df.withColumn("__verdict", passed())
        told = call(df, text_col)
        verdict = external_verdict(F.col(text_col), F.col("http_status"), F.col("http_body"), fail_open=fail_open, direction=direction, applies_to=applies_to)
        return told.withColumn("__verdict", verdict).drop("http_status", "http_body")

    return Guard("external-validator", rows=rows)
