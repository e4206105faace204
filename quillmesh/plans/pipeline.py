"""The chat pipeline over a table of requests: guards, retrieval, routing, assembly, provider, tools, output guards, usage.

What it calls are DataFrame-to-DataFrame functions:

* provider: rows with ``messages`` -> the same with content, finish_reason, prompt_tokens, completion_tokens, total_tokens, and
  optionally tool_calls (array of id, name, arguments_json);
* retriever: (request_id, query, top_k) -> chunks (request_id, rank, content, source_id, score);
* tool executor: (request_id, call_id, name, arguments_json) -> the same with result and error_class, one of them null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import contains_any
from quillmesh.operators.codecs import CALL
from quillmesh.operators.guards import INPUT, OUTPUT, filter_untrusted, guard_tool_result
from quillmesh.operators.prompt import assemble, system_prompt
from quillmesh.operators.retrieval import retrieve_many
from quillmesh.operators.routing import load_rules, rules_as_case
from quillmesh.session import cut_lineage
from quillmesh.sources.config import EngineConfig

CHUNK = "struct<content:string,source_id:string,score:double>"
TURN = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string>"
COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")


# ---------------------------------------------------------------- stand-ins for tests


def fake_provider(prefix: str = "echo: ", calls: Callable[[Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Answers with the last message after a prefix; tokens are characters. ``calls`` gives the tool calls of an answer from its messages."""

    def complete(df: DataFrame) -> DataFrame:
        said = F.concat(F.lit(prefix), F.coalesce(F.element_at("messages", -1)["content"], F.lit("")))
        sent = F.aggregate("messages", F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
        asked = calls(F.col("messages")) if calls else F.lit(None).cast(f"array<{CALL}>")
        return df.withColumns({"content": said, "finish_reason": F.lit("STOP"), "prompt_tokens": sent.cast("int"), "completion_tokens": F.length(said).cast("int"), "tool_calls": asked}).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))

    return complete


def fake_retriever(chunks: list[tuple[str, str, float]]) -> Callable[[DataFrame], DataFrame]:
    """Gives every request the first top_k of a few fixed chunks (content, source_id, score)."""

    def retrieve(asked: DataFrame) -> DataFrame:
        held = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("content"), F.lit(s).alias("source_id"), F.lit(float(x)).alias("score")) for i, (c, s, x) in enumerate(chunks, 1)])
        return asked.select("request_id", "top_k", F.explode(held).alias("c")).where("c.rank <= top_k").select("request_id", "c.*")

    return retrieve


# ---------------------------------------------------------------- retrieval


def vector_retriever(chunks: DataFrame, embed: Callable[[Column], Column], metric: str = "cosine") -> Callable[[DataFrame], DataFrame]:
    """Retrieval from chunks (id, content, embedding) by the embedded query, as ``retrieve_many`` does it."""

    def retrieve(asked: DataFrame) -> DataFrame:
        near = retrieve_many(chunks, asked.select(F.col("request_id").alias("query_id"), embed(F.col("query")).alias("query_vec"), "top_k"), metric=metric)
        found = near.hint("merge").join(chunks.select("id", "content").dropDuplicates(["id"]), "id")
        return found.select(F.col("query_id").alias("request_id"), "rank", "content", F.col("id").alias("source_id"), "score")

    return retrieve


def guard_chunks(chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Retrieved chunks (request_id, rank, content, source_id, score) that the untrusted-content chain lets through."""
    return filter_untrusted(chunks, "content", cfg.untrusted_chain)


def _with_chunks(df: DataFrame, chunks: DataFrame | None, cfg: EngineConfig) -> DataFrame:
    if chunks is None and cfg.retriever is not None:
        top_k = F.coalesce("top_k", F.lit(cfg.default_top_k)) if "top_k" in df.columns else F.lit(cfg.default_top_k)
        chunks = cfg.retriever(df.where("action <> 'block'").select("request_id", F.col("guarded_text").alias("query"), top_k.alias("top_k")))
    if chunks is None:
        return df.withColumn("chunks", F.array().cast(f"array<{CHUNK}>"))
    kept = guard_chunks(chunks.select("request_id", "rank", "content", "source_id", F.col("score").cast("double").alias("score")), cfg)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "content", "source_id", "score")))
    found = kept.groupBy("request_id").agg(F.transform(ranked, lambda c: F.struct(c["content"].alias("content"), c["source_id"].alias("source_id"), c["score"].alias("score"))).alias("chunks"))
    return df.join(found, "request_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(f"array<{CHUNK}>")))


# ---------------------------------------------------------------- up to the provider


def run_pipeline(requests: DataFrame, cfg: EngineConfig, *, rules: DataFrame | None = None, skills: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Everything up to the provider call: adds guarded_text, action, reason_code, chunks, route_provider, route_model, error, messages.

    requests: request_id (unique), provider_id, model, user_input, history, and optionally top_k; chunks: request_id, rank, content,
    source_id, score. Without ``chunks`` the configured retriever is asked, for requests that aren't blocked. Blocked requests have
    the guard's reason as error and no messages.
    """
    df = _with_chunks(cfg.input_chain.run(requests, "user_input", INPUT), chunks, cfg)
    hit = rules_as_case(F.col("guarded_text"), load_rules(rules) if rules is not None else [], cfg.default_route)
    asked = F.col("provider_id").isNull() | F.col("model").isNull()
    df = df.withColumn("__route", F.when(asked, hit))
    known = load_rules(skills.select("name", "description", "triggers", "body").orderBy("name")) if skills is not None else []
    catalogue = F.array(*[F.struct(F.lit(s["name"]).alias("name"), F.lit(s["description"]).alias("description")) for s in known]).cast("array<struct<name:string,description:string>>")
    active = F.array_compact(
        F.array(*[F.when(contains_any(F.col("guarded_text"), F.array(*[F.lit(t) for t in s["triggers"] or []]).cast("array<string>")), F.struct(F.lit(s["name"]).alias("name"), F.lit(s["body"]).alias("body"))) for s in known]).cast("array<struct<name:string,body:string>>")
    )
    system = system_prompt(F.lit(cfg.prefix()).cast("string"), catalogue if cfg.include_catalog else F.lit(None).cast("array<struct<name:string,description:string>>"))
    blocked = F.col("action") == "block"
    routed = {"route_provider": F.coalesce("provider_id", "__route.provider"), "route_model": F.coalesce("model", "__route.model")}
    error = F.when(blocked, F.col("reason_code")).when(asked & F.col("__route").isNull(), F.lit("routing_error"))
    df = df.withColumns(routed | {"error": error}).drop("__route")
    return df.withColumn("messages", F.when(F.col("error").isNull(), assemble(system, active, F.col("chunks"), F.col("history"), F.col("guarded_text"))))


# ---------------------------------------------------------------- provider and tools


def _turn(role: str, content: Column, calls: Column | None = None, call_id: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (none if calls is None else calls).alias("tool_calls"), (none if call_id is None else call_id).alias("tool_call_id")).cast(TURN)


def tool_failure(name: Column, error_class: Column) -> Column:
    """What a model is told of a failed tool: its name and the kind of error, never the message."""
    return F.concat(F.lit('Tool "'), name, F.lit('" failed ('), error_class, F.lit(")"))


def run_tools(asked: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(request_id, turns): what the tools answered to the calls of each row of (request_id, tool_calls), guarded, in the order of the calls."""
    calls = asked.select("request_id", F.posexplode("tool_calls").alias("place", "c")).select("request_id", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments_json").alias("arguments_json"))
    done = cfg.tool_executor(calls)
    told = done.withColumn("content", F.when(F.col("error_class").isNotNull(), tool_failure(F.col("name"), F.col("error_class"))).otherwise(F.col("result")))
    safe = guard_tool_result(told, "content", cfg.untrusted_chain)
    turns = F.array_sort(F.collect_list(F.struct("place", _turn("TOOL", F.col("content"), None, F.col("call_id")).alias("turn"))))
    return safe.groupBy("request_id").agg(F.transform(turns, lambda t: t["turn"]).alias("turns"))


def _answered(ready: DataFrame, cfg: EngineConfig, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The provider's last answer to each row, after as many rounds of tools as it wants and ``max_tool_calls`` allows; n_calls and
    token counts add up over the rounds."""
    rows = ready.withColumn("messages", F.transform("messages", lambda m: _turn_of(m))).withColumns({"n_calls": F.lit(0), **{f"__{c}": F.lit(0) for c in COUNTS}})

    def ask(df: DataFrame) -> DataFrame:
        said = provider(df)
        if "tool_calls" not in said.columns:
            said = said.withColumn("tool_calls", F.lit(None).cast(f"array<{CALL}>"))
        sums = {f"__{c}": F.col(f"__{c}") + F.coalesce(F.col(c), F.lit(0)) for c in COUNTS}
        return said.withColumns({"n_calls": F.col("n_calls") + 1, **sums})

    if not cfg.tools:
        return _totals(ask(rows))
    out, asked = [], list(ready.columns) + ["n_calls", *[f"__{c}" for c in COUNTS]]
    wants = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    for at in range(1, cfg.max_tool_calls + 1):
        # Calls of a provider aren't repeated: each round is written before the next one reads it.
        said = cut_lineage(ask(rows))
        out.append(said.where(~wants))
        more = said.where(wants)
        if at == cfg.max_tool_calls:
            out.append(more.withColumn("error", F.lit("tool_call_limit_exceeded")))
        elif more.isEmpty():
            break
        else:
            turns = run_tools(more.select("request_id", "tool_calls"), cfg)
            own = F.array(_turn("ASSISTANT", F.col("content"), F.col("tool_calls")))
            rows = more.join(turns.hint("merge"), "request_id").withColumn("messages", F.concat("messages", own, "turns")).select(*[f"`{c}`" for c in asked])
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return _totals(whole)


def _turn_of(m: Column) -> Column:
    return F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))


def _totals(said: DataFrame) -> DataFrame:
    return said.withColumns({c: F.col(f"__{c}").cast("int") for c in COUNTS}).drop(*[f"__{c}" for c in COUNTS])


def chat(requests: DataFrame, cfg: EngineConfig, provider: Callable[[DataFrame], DataFrame], **tables) -> DataFrame:
    """run_pipeline, the provider with its rounds of tools on the rows without error, and the output chain on its content (null content is empty).

    Adds content, finish_reason, tool_calls, n_calls and token counts over all rounds. Tools that still want a call after
    ``max_tool_calls`` answers are an error, and so is a blocked output; both have no content. Tool results go through the
    untrusted-content chain. With tools, each round is checkpointed, so that no provider is called again for a later one.
    """
    ready = run_pipeline(requests, cfg, **tables)
    said = _answered(ready.where("error is null"), cfg, provider).withColumn("content", F.when(F.col("error").isNull(), F.coalesce("content", F.lit(""))))
    checked = cfg.output_chain.run(said, "content", OUTPUT, prefix="out_")
    good = F.col("out_action") != "block"
    done = checked.withColumns({"error": F.coalesce("error", F.when(~good, F.col("out_reason_code"))), "content": F.when(good, F.col("out_guarded_text"))}).drop(*[f"out_{c}" for c in ("guarded_text", "action", "guard_id", "reason_code", "message")])
    rest = ready.where("error is not null").withColumn("messages", F.lit(None).cast(f"array<{TURN}>"))
    return done.unionByName(rest, allowMissingColumns=True)


def chat_usage(chats: DataFrame) -> DataFrame:
    """Rows of a usage log (request_id, provider_id, model and token counts) of the chats that called a provider, whatever came of it."""
    return chats.where("n_calls > 0").select("request_id", F.col("route_provider").alias("provider_id"), F.col("route_model").alias("model"), *COUNTS)


def tool_loop(rounds: DataFrame, max_calls: int = 5) -> DataFrame:
    """Outcome of scripted tool rounds: (request_id, n_calls, content, error, prompt_tokens, completion_tokens, total_tokens).

    rounds: request_id, round (from 1), content, tool_calls, token counts; a row for each reply a provider would
    give. Replies after the first without tool calls are not asked for. When the ``max_calls``-th reply still
    has tool calls the limit is an error; usage sums over the replies asked for, null counts being 0.
    """
    if max_calls < 1:
        raise ValueError("max_calls must be at least 1")
    calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    last = rounds.groupBy("request_id").agg(F.min(F.when(~calls, F.col("round"))).alias("final"))
    asked = rounds.join(last, "request_id").where((F.col("round") <= F.coalesce("final", F.lit(max_calls))) & (F.col("round") <= max_calls))
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("int").alias(c) for c in COUNTS]
    out = asked.groupBy("request_id").agg(F.count("*").alias("n_calls"), F.max_by("content", "round").alias("content"), F.max_by(calls, "round").alias("open"), F.max("round").alias("at"), *sums)
    error = F.when(F.col("open") & (F.col("at") >= max_calls), F.lit("tool_call_limit_exceeded"))
    return out.withColumn("error", error).withColumn("content", F.when(error.isNull(), F.col("content"))).drop("open", "at")


def chat_stream(stream: DataFrame, cfg: EngineConfig, **tables) -> DataFrame:
    """Input guards, routing and assembly on a stream of requests; no retrieval, tools, output guards or usage."""
    if "chunks" in tables or cfg.retriever is not None:
        raise ValueError("retrieved chunks are not supported on a stream")
    return run_pipeline(stream, cfg, **tables)
