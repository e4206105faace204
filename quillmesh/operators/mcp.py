"""JSON-RPC envelopes and the results of tool servers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTOCOL = "2024-11-05"


def jsonrpc_request(call_id: Column, method: Column, params_json: Column) -> Column:
    """A request with an id, a notification if the id is null; null params are an empty object."""
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), call_id.alias("id"), method.alias("method"), F.parse_json(F.coalesce(params_json, F.lit("{}"))).alias("params")))


def initialize_params(client: str, version: str) -> Column:
    return F.lit(f'{{"protocolVersion":"{PROTOCOL}","capabilities":{{}},"clientInfo":{{"name":"{client}","version":"{version}"}}}}')


def call_params(name: Column, arguments_json: Column) -> Column:
    return F.to_json(F.struct(name.alias("name"), F.parse_json(F.coalesce(arguments_json, F.lit("{}"))).alias("arguments")))


def query_arguments(query: Column, top_k: Column) -> Column:
    """Default arguments of a retrieval tool."""
    return F.to_json(F.struct(query.alias("query"), top_k.alias("top_k")))


def jsonrpc_reply(line: Column) -> Column:
    """struct(is_response, id, result, error_code, error_message); malformed lines are no response.

    A response has an id and a result or an error. An error without code has code 0, without message
    "MCP error". ``result`` is JSON text.
    """
    v = F.try_parse_json(line)
    part = lambda p: F.try_variant_get(v, p, "variant")
    keys = F.json_object_keys(line)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    error = part("$.error")
    failed = error.isNotNull() & (F.schema_of_variant(error) != "VOID")
    return F.struct(
        (has("id") & (has("result") | has("error"))).alias("is_response"),
        F.try_variant_get(v, "$.id", "bigint").alias("id"),
        F.when(~F.coalesce(failed, F.lit(False)), F.to_json(part("$.result"))).alias("result"),
        F.when(failed, F.coalesce(F.try_variant_get(v, "$.error.code", "int"), F.lit(0))).alias("error_code"),
        F.when(failed, F.coalesce(F.try_variant_get(v, "$.error.message", "string"), F.lit("MCP error"))).alias("error_message"),
    )


def correlate(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Each request (id, method) with its reply (line); a request without reply is a timeout, other lines are dropped.

    Of several replies to one id the first by arrival counts.
    """
    read = replies.withColumn("r", jsonrpc_reply(F.col("line"))).where("r.is_response")
    first = read.groupBy(F.col("r.id").alias("id")).agg(F.min_by("r", "arrival").alias("r"))
    out = requests.select("id", "method").join(first, "id", "left")
    status = F.when(F.col("r").isNull(), F.lit("timeout")).when(F.col("r.error_code").isNotNull(), F.lit("error")).otherwise(F.lit("ok"))
    return out.select("id", "method", status.alias("status"), F.col("r.result").alias("result"), F.col("r.error_code").alias("error_code"), F.col("r.error_message").alias("error_message"))


_CONTENT = "content array<struct<type:string,text:string,resource:struct<uri:string,mimeType:string,text:string>>>, isError boolean"


def tool_result(result_json: Column) -> Column:
    """struct(blocks, is_error): blocks of kind text or resource, missing texts empty; is_error is false if absent."""
    j = F.from_json(result_json, _CONTENT)

    def block(b: Column) -> Column:
        res = b["type"] == "resource"
        return F.struct(
            F.when(F.coalesce(res, F.lit(False)), F.lit("resource")).otherwise(F.lit("text")).alias("kind"),
            F.when(res, F.coalesce(b["resource"]["uri"], F.lit(""))).alias("uri"),
            F.when(res, b["resource"]["mimeType"]).alias("mime_type"),
            F.when(res, F.coalesce(b["resource"]["text"], F.lit(""))).otherwise(F.coalesce(b["text"], F.lit(""))).alias("text"),
        )

    return F.struct(F.transform(j["content"], block).alias("blocks"), F.coalesce(j["isError"], F.lit(False)).alias("is_error"))


def chunks_of_result(result_json: Column, tool_name: Column) -> Column:
    """Chunks (content, source_id, score, metadata) of a retrieval tool's result: the source is the tool or the resource's uri."""
    none = F.create_map().cast("map<string,string>")
    return F.transform(
        tool_result(result_json)["blocks"],
        lambda b: F.struct(
            b["text"].alias("content"),
            F.coalesce(b["uri"], tool_name).alias("source_id"),
            F.lit(1.0).alias("score"),
            F.when(b["mime_type"].isNotNull(), F.create_map(F.lit("mimeType"), b["mime_type"])).otherwise(none).alias("metadata"),
        ),
    )


def tools_listed(result_json: Column) -> Column:
    """Array of (name, description, input_schema as JSON text)."""
    v = F.variant_get(F.parse_json(result_json), "$.tools", "array<variant>")
    get = lambda t, p: F.try_variant_get(t, p, "string")
    return F.transform(v, lambda t: F.struct(F.coalesce(get(t, "$.name"), F.lit("")).alias("name"), F.coalesce(get(t, "$.description"), F.lit("")).alias("description"), F.coalesce(F.to_json(F.try_variant_get(t, "$.inputSchema", "variant")), F.lit("{}")).alias("input_schema")))


def resources_listed(result_json: Column) -> Column:
    j = F.from_json(result_json, "resources array<struct<uri:string,name:string,description:string,mimeType:string>>")
    empty = F.lit("")
    return F.transform(j["resources"], lambda r: F.struct(F.coalesce(r["uri"], empty).alias("uri"), F.coalesce(r["name"], empty).alias("name"), F.coalesce(r["description"], empty).alias("description"), r["mimeType"].alias("mime_type")))


def resource_read(result_json: Column, uri: Column) -> Column:
    """struct(uri, mime_type, text) of the first content."""
    first = F.get(F.from_json(result_json, "contents array<struct<uri:string,mimeType:string,text:string>>")["contents"], 0)
    return F.struct(F.coalesce(first["uri"], uri).alias("uri"), first["mimeType"].alias("mime_type"), F.coalesce(first["text"], F.lit("")).alias("text"))


def server_info(result_json: Column) -> Column:
    """struct(name, version, tools, resources, prompts): a capability is there if its key is."""
    keys = F.json_object_keys(F.get_json_object(result_json, "$.capabilities"))
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False)).alias(k)
    get = lambda p: F.coalesce(F.get_json_object(result_json, p), F.lit(""))
    return F.struct(get("$.serverInfo.name").alias("name"), get("$.serverInfo.version").alias("version"), has("tools"), has("resources"), has("prompts"))


def tool_call_pairs(messages: DataFrame) -> DataFrame:
    """(message_id, tool_call_id, tool): each message that answers a tool call, with the name of the tool called in the same request.

    messages: message_id, request_id, tool_calls (array of id, name, ...), tool_call_id. Answers to calls nobody made have a null tool; repeated
    rows count once.
    """
    results = messages.where("tool_call_id is not null").select("message_id", "request_id", "tool_call_id").distinct()
    calls = messages.select("request_id", F.explode("tool_calls").alias("t")).select("request_id", F.col("t.id").alias("tool_call_id"), F.col("t.name").alias("tool")).distinct()
    return results.join(calls, ["request_id", "tool_call_id"], "left").groupBy("message_id", "tool_call_id").agg(F.min("tool").alias("tool"))
