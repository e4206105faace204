"""Requests to and replies from model providers, as JSON columns: encode, decode, stream lines, finish reasons, errors.

Requests are rows with model, messages (array of role, content, tool_calls, tool_call_id), temperature,
max_tokens and tools. Fields that are null are left out of the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import is_blank

DEFAULT_MAX_TOKENS = 4096

CALL = "struct<id:string,name:string,arguments_json:string>"
USAGE = "struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"

# ---------------------------------------------------------------- finish reasons

# Finish reasons on the wire and their names here; any other, and none, is STOP.
FINISH = {
    "openai": {"length": "LENGTH", "tool_calls": "TOOL_CALLS", "content_filter": "CONTENT_FILTER"},
    "anthropic": {"max_tokens": "LENGTH", "tool_use": "TOOL_CALLS"},
    "ollama": {"length": "LENGTH"},
}


def finish_reason(raw: Column, provider: str) -> Column:
    out = F.lit("STOP")
    for wire, name in FINISH[provider].items():
        out = F.when(raw == wire, F.lit(name)).otherwise(out)
    return out


# ---------------------------------------------------------------- requests


def _role(m: Column) -> Column:
    return F.lower(m["role"])


def openai_request(model: Column, messages: Column, temperature: Column, max_tokens: Column, tools: Column | None = None, stream: bool = False) -> Column:
    """JSON body; tool calls and tools only if there are any. tools: array of (name, description, parameters as JSON text)."""
    calls = lambda m: F.when(
        F.coalesce(F.size(m["tool_calls"]) > 0, F.lit(False)),
        F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments_json"].alias("arguments")).alias("function"))),
    )
    sent = F.transform(messages, lambda m: F.struct(_role(m).alias("role"), m["content"].alias("content"), calls(m).alias("tool_calls"), m["tool_call_id"].alias("tool_call_id")))
    fields = [model.alias("model"), sent.alias("messages"), F.lit(stream).alias("stream"), temperature.alias("temperature"), max_tokens.alias("max_tokens")]
    if tools is not None:
        known = F.when(
            F.coalesce(F.size(tools) > 0, F.lit(False)),
            F.transform(tools, lambda t: F.struct(F.lit("function").alias("type"), F.struct(t["name"].alias("name"), t["description"].alias("description"), F.try_parse_json(t["parameters"]).alias("parameters")).alias("function"))),
        )
        fields.append(known.alias("tools"))
    return F.to_json(F.struct(*fields))


def anthropic_request(model: Column, messages: Column, temperature: Column, max_tokens: Column, stream: bool = False) -> Column:
    """System messages go to the top, joined by a blank line, or are left out; null content is sent as empty text."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: _role(m) == "system"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    others = F.transform(F.filter(messages, lambda m: _role(m) != "system"), lambda m: F.struct(_role(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    return F.to_json(
        F.struct(
            model.alias("model"),
            F.coalesce(max_tokens, F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
            others.alias("messages"),
            F.when(system != "", system).alias("system"),
            temperature.alias("temperature"),
            F.lit(stream).alias("stream"),
        )
    )


def ollama_request(model: Column, messages: Column, temperature: Column, max_tokens: Column, stream: bool = False) -> Column:
    """Options only if one of them is given."""
    options = F.when(temperature.isNotNull() | max_tokens.isNotNull(), F.struct(temperature.alias("temperature"), max_tokens.alias("num_predict")))
    sent = F.transform(messages, lambda m: F.struct(_role(m).alias("role"), m["content"].alias("content")))
    return F.to_json(F.struct(model.alias("model"), sent.alias("messages"), F.lit(stream).alias("stream"), options.alias("options")))


REQUESTS = {"openai": openai_request, "anthropic": anthropic_request, "ollama": ollama_request}

# ---------------------------------------------------------------- replies

_OPENAI = "id string, model string, choices array<struct<index:int,message:struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>, usage " + USAGE
_ANTHROPIC = "id string, model string, content array<struct<type:string,text:string>>, stop_reason string, usage struct<input_tokens:int,output_tokens:int>"
_OLLAMA = "model string, message struct<role:string,content:string>, done boolean, done_reason string, prompt_eval_count int, eval_count int"


def _usage(p: Column, c: Column, t: Column) -> Column:
    return F.struct(F.coalesce(p, F.lit(0)).alias("prompt_tokens"), F.coalesce(c, F.lit(0)).alias("completion_tokens"), F.coalesce(t, F.lit(0)).alias("total_tokens"))


def _response(i: Column, model: Column, content: Column, finish: Column, usage: Column, calls: Column) -> Column:
    return F.struct(i.alias("id"), model.alias("model"), content.alias("content"), finish.alias("finish_reason"), usage.alias("usage"), calls.alias("tool_calls"))


def openai_response(body: Column) -> Column:
    """First choice; content may be null; missing usage is zeros; null tool calls and those without function are dropped."""
    j = F.from_json(body, _OPENAI)
    choice = F.get(j["choices"], 0)
    calls = F.transform(
        F.filter(choice["message"]["tool_calls"], lambda c: c.isNotNull() & c["function"].isNotNull()),
        lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments_json")),
    )
    usage = _usage(j["usage"]["prompt_tokens"], j["usage"]["completion_tokens"], j["usage"]["total_tokens"])
    return _response(j["id"], j["model"], choice["message"]["content"], finish_reason(choice["finish_reason"], "openai"), usage, F.coalesce(calls, F.array().cast(f"array<{CALL}>")))


def anthropic_response(body: Column, requested_model: Column | None = None) -> Column:
    """Texts of the text blocks joined; total is input plus output; missing usage is zeros."""
    j = F.from_json(body, _ANTHROPIC)
    text = F.array_join(F.transform(F.filter(j["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    i, o = F.coalesce(j["usage"]["input_tokens"], F.lit(0)), F.coalesce(j["usage"]["output_tokens"], F.lit(0))
    model = j["model"] if requested_model is None else F.coalesce(j["model"], requested_model)
    return _response(F.coalesce(j["id"], F.lit("")), model, F.coalesce(text, F.lit("")), finish_reason(j["stop_reason"], "anthropic"), _usage(i, o, i + o), F.array().cast(f"array<{CALL}>"))


def ollama_response(body: Column, response_id: Column) -> Column:
    """No message is empty content; usage is zeros unless both counts are there; the reason is STOP. The id is given."""
    j = F.from_json(body, _OLLAMA)
    both = j["prompt_eval_count"].isNotNull() & j["eval_count"].isNotNull()
    p, c = F.when(both, j["prompt_eval_count"]), F.when(both, j["eval_count"])
    content = F.when(j["message"].isNull(), F.lit("")).otherwise(j["message"]["content"])
    return _response(F.concat(F.lit("ollama-"), response_id), j["model"], content, F.lit("STOP"), _usage(p, c, p + c), F.array().cast(f"array<{CALL}>"))


# ---------------------------------------------------------------- stream lines


def sse_payload(line: Column) -> Column:
    """What follows data: on a line, trimmed; null for other lines and empty payloads."""
    body = F.regexp_replace(F.substring(line, 6, 2147483647), r"^\s+|\s+$", "")
    return F.when(line.startswith("data:") & (body != ""), body)


def decode_lines(lines: DataFrame, provider: str, *, stream_col: str = "stream_id", seq_col: str = "seq", line_col: str = "line") -> DataFrame:
    """(stream_id, seq, delta, done, finish_reason): chunks of each stream in order.

    The reason on the terminal chunk is the last one seen before it in its stream; null if there was none. Lines
    that carry no chunk are dropped. A stream is one conversation's answer, so its window is small.
    """
    rows = lines.select(F.col(stream_col).alias("stream_id"), F.col(seq_col).alias("seq"), F.col(line_col).alias("line"))
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if provider == "ollama":
        j = F.from_json("line", _OLLAMA)
        out = rows.where(~is_blank(F.col("line"))).withColumn("j", j)
        done = F.coalesce(F.col("j.done"), F.lit(False))
        text = F.when(F.col("j.message").isNull(), F.lit("")).otherwise(F.col("j.message.content"))
        return out.select("stream_id", "seq", F.when(~done, text).alias("delta"), done.alias("done"), F.when(done, finish_reason(F.col("j.done_reason"), "ollama")).alias("finish_reason"))
    data = rows.withColumn("data", sse_payload(F.col("line"))).where("data is not null")
    if provider == "openai":
        j = F.from_json("data", "choices array<struct<delta:struct<role:string,content:string>,finish_reason:string>>")
        data = data.withColumn("done", F.col("data") == "[DONE]").withColumn("c", F.when(~F.col("done"), F.get(j["choices"], 0)))
        data = data.withColumn("said", F.when(F.col("c.finish_reason").isNotNull(), finish_reason(F.col("c.finish_reason"), "openai")))
        delta, keep = F.when(~F.col("done"), F.coalesce("c.delta.content", F.lit(""))), F.lit(True)
    elif provider == "anthropic":
        j = F.from_json("data", "type string, delta struct<text:string,stop_reason:string>")
        data = data.withColumn("j", j).withColumn("done", F.coalesce(F.col("j.type") == "message_stop", F.lit(False)))
        data = data.withColumn("said", F.when((F.col("j.type") == "message_delta") & F.col("j.delta.stop_reason").isNotNull(), finish_reason(F.col("j.delta.stop_reason"), "anthropic")))
        delta, keep = F.when(F.col("j.type") == "content_block_delta", F.coalesce("j.delta.text", F.lit(""))), F.col("j.type").isin("content_block_delta", "message_stop")
    else:
        raise ValueError(f"unknown provider: {provider}")
    # The line is read before the rows meet by stream, so only what it says travels.
    read = data.select("stream_id", "seq", delta.alias("delta"), "done", "said", keep.alias("keep"))
    told = read.withColumn("reason", F.last("said", ignorenulls=True).over(before))
    return told.where("keep").select("stream_id", "seq", "delta", "done", F.when(F.col("done"), F.col("reason")).alias("finish_reason"))


def join_deltas(chunks: DataFrame) -> DataFrame:
    """(stream_id, content): deltas in order, one text a stream."""
    return chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("d")))), lambda x: x["d"]), "").alias("content"))


# ---------------------------------------------------------------- the service's own answers


def chat_response(response_id: Column, model: Column, content: Column, finish: Column, usage: Column, created: Column) -> Column:
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"), F.lower(finish).alias("finish_reason"))
    return F.to_json(F.struct(response_id.alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices"), usage.alias("usage")))


def chat_chunk(request_id: Column, model: Column, delta: Column, done: Column, finish: Column, first: Column, created: Column) -> Column:
    """The role on the first chunk only; no content on the last; the reason on the last only, stop if there was none."""
    d = F.struct(F.when(first, F.lit("assistant")).alias("role"), F.when(~done, delta).alias("content"))
    choice = F.struct(F.lit(0).alias("index"), d.alias("delta"), F.when(done, F.lower(F.coalesce(finish, F.lit("STOP")))).alias("finish_reason"))
    return F.to_json(F.struct(F.concat(F.lit("chatcmpl-"), request_id).alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices")))


def error_body(code: Column, message: Column) -> Column:
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error")))


def sse_event(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


SSE_DONE = "data: [DONE]\n\n"


def encode_stream(chunks: DataFrame, model: Column, created: Column) -> DataFrame:
    """(stream_id, sse): the event stream of each answer, always ended by the terminal event, also after an error.

    chunks: stream_id, seq, delta, done, finish_reason, and optionally error_code and error_message, which
    make an error event.
    """
    if "error_code" not in chunks.columns:
        chunks = chunks.withColumns({"error_code": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
    first = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) == 1
    rows = chunks.withColumn("first", first)
    body = F.when(F.col("error_code").isNotNull(), error_body(F.col("error_code"), F.col("error_message"))).otherwise(
        chat_chunk(F.col("stream_id").cast("string"), model, F.col("delta"), F.col("done"), F.col("finish_reason"), F.col("first"), created)
    )
    events = rows.select("stream_id", "seq", sse_event(body).alias("event"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda e: e["event"]), "")
    return events.groupBy("stream_id").agg(F.concat(text, F.lit(SSE_DONE)).alias("sse"))


# ---------------------------------------------------------------- errors


# The codes and statuses of errors, as clients of the service know them.
def provider_error(status: Column) -> Column:
    """auth for 401 and 403, rate_limit for 429, error for the rest; null for 200."""
    return F.when(status == 200, F.lit(None).cast("string")).when(status.isin(401, 403), F.lit("auth")).when(status == 429, F.lit("rate_limit")).otherwise(F.lit("error"))


def api_error(kind: Column, reason: Column, status: Column) -> Column:
    """struct(http_status, code) of an error kind: guard, unknown_provider, routing, tool_limit, auth, rate_limit, timeout, provider; else internal."""
    given = F.when(status > 0, status)

    def pair(http: Column | int, code: Column | str) -> Column:
        return F.struct((F.lit(http) if isinstance(http, int) else http).cast("int").alias("http_status"), (F.lit(code) if isinstance(code, str) else code).alias("code"))

    return (
        F.when(kind == "guard", pair(400, reason))
        .when(kind == "unknown_provider", pair(400, "unknown_provider"))
        .when(kind == "routing", pair(500, "routing_error"))
        .when(kind == "tool_limit", pair(500, "tool_call_limit_exceeded"))
        .when(kind == "auth", pair(F.coalesce(given, F.lit(401)), "provider_auth_error"))
        .when(kind == "rate_limit", pair(F.coalesce(given, F.lit(429)), "provider_rate_limited"))
        .when(kind == "timeout", pair(504, "provider_timeout"))
        .when(kind == "provider", pair(F.coalesce(given, F.lit(502)), "provider_error"))
        .otherwise(pair(500, "internal_error"))
    )
