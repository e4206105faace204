"""Calls over HTTP from executors, for models and validators: opt in, a request for each row, answers as columns.

Requests and replies are the columns of ``operators.codecs`` and ``operators.output_guards``; this module only
moves bodies. Nothing here is used by a query. A call that fails (refused, timed out, cut off) has a null
status. Spark may run a task again after a loss, so endpoints must bear a repeated call.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators import codecs


def fetch(url: str, body: str | None, headers: dict[str, str], timeout: float) -> tuple[int | None, str | None]:
    """(status, body) of a POST, or of a GET if there is no body; (null, null) if there was no answer."""
    request = urllib.request.Request(url, None if body is None else body.encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except (OSError, ValueError):
        return None, None


def call(df: DataFrame, url: str, body_col: str, *, headers: dict[str, str] | None = None, timeout: float = 60.0) -> DataFrame:
    """Adds http_status and http_body: each row's body posted to the url. A null body is not sent and has no answer."""
    sent = dict(headers or {})
    schema = T.StructType([*df.schema.fields, T.StructField("http_status", T.IntegerType()), T.StructField("http_body", T.StringType())])

    def run(batches):
        for pdf in batches:
            got = [(None, None) if b is None else fetch(url, b, sent, timeout) for b in pdf[body_col]]
            yield pdf.assign(http_status=pd.array([s for s, _ in got], "Int32"), http_body=[b for _, b in got])

    return df.mapInPandas(run, schema)


def _headers(kind: str, key: str | None) -> dict[str, str]:
    if kind == "anthropic":
        return {"x-api-key": key or "", "anthropic-version": "2023-06-01"}
    return {"Authorization": f"Bearer {key}"} if key and key.strip() else {}


_PATHS = {"openai": "/chat/completions", "anthropic": "/v1/messages", "ollama": "/api/chat"}


def provider(kind: str, base_url: str, key: str | None = None, timeout: float = 60.0, tools: tuple = ()) -> Callable[[DataFrame], DataFrame]:
    """A provider for ``pipeline.chat``: encodes messages, calls, decodes. A failed call leaves content null and sets provider_error.

    ``tools``, (name, description, parameters as JSON text) each, are sent to providers that take them, and their calls come back
    in tool_calls, to be run by the pipeline."""

    def complete(df: DataFrame) -> DataFrame:
        none = {"temperature": "double", "max_tokens": "int"}
        opt = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in none.items()}
        sent = {f.name for f in df.schema["messages"].dataType.elementType.fields}
        given = lambda m, c, t: m[c] if c in sent else F.lit(None).cast(t)
        messages = F.transform(
            "messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), given(m, "tool_calls", f"array<{codecs.CALL}>").alias("tool_calls"), given(m, "tool_call_id", "string").alias("tool_call_id"))
        )
        known = {"tools": F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("name", "description", "parameters"), t)]) for t in tools])} if tools and kind == "openai" else {}
        body = codecs.REQUESTS[kind](F.coalesce("route_model", "model"), messages, opt["temperature"], opt["max_tokens"], **known)
        asked = call(df.withColumn("__body", body), base_url.rstrip("/") + _PATHS[kind], "__body", headers=_headers(kind, key), timeout=timeout)
        text = F.when(F.col("http_status") == 200, F.col("http_body"))
        read = {"openai": codecs.openai_response, "anthropic": codecs.anthropic_response, "ollama": lambda b: codecs.ollama_response(b, F.col("request_id"))}[kind](text)
        failed = F.when(F.col("http_status").isNull(), F.lit("timeout")).otherwise(codecs.provider_error(F.col("http_status")))
        out = asked.withColumn("__r", F.when(text.isNotNull(), read))
        fields = {"content": F.col("__r.content"), "finish_reason": F.col("__r.finish_reason"), "tool_calls": F.col("__r.tool_calls"), "provider_error": failed}
        fields |= {c: F.col(f"__r.usage.{c}") for c in ("prompt_tokens", "completion_tokens", "total_tokens")}
        return out.withColumns(fields).drop("__r", "__body", "http_status", "http_body")

    return complete


def validator_url(base_url: str, guard: str) -> str:
    return f"{base_url.rstrip('/')}/guards/{urllib.parse.quote(guard, safe='')}/validate"


def validate(df: DataFrame, text_col: str, base_url: str, guard: str, timeout: float = 5.0, key: str | None = None) -> DataFrame:
    """With a key as bearer, if there is one. Adds http_status and http_body of a validator's reply to each text; interpret them with ``external_verdict``."""
    body = F.when(F.col(text_col).isNotNull(), F.to_json(F.struct(F.col(text_col).alias("llmOutput"))))
    return call(df.withColumn("__sent", body), validator_url(base_url, guard), "__sent", headers=_headers("openai", key), timeout=timeout).drop("__sent")


def models_listed(kind: str, body: str) -> list[dict]:
    """Models of a listing: id and display name. The listing of a provider without one is configuration."""
    doc = json.loads(body)
    names = [m["id"] for m in doc.get("data", [])] if kind == "openai" else [m["name"] for m in doc.get("models", [])]
    return [{"id": n, "display_name": n, "context_window": None} for n in names]


def list_models(kind: str, base_url: str, key: str | None = None, timeout: float = 60.0) -> list[dict]:
    status, body = fetch(base_url.rstrip("/") + {"openai": "/models", "ollama": "/api/tags"}[kind], None, _headers(kind, key), timeout)
    if status != 200:
        raise RuntimeError(f"listing failed: {status}")
    return models_listed(kind, body)
