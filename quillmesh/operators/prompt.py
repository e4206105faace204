"""Assembly of the messages sent to a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import is_blank, strip_trailing

MESSAGE = "struct<role:string,content:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def context_block(chunks: Column) -> Column:
    """A block with one line a chunk (source_id, content), trailing white space off; null for no chunks."""
    lines = F.transform(chunks, lambda c: F.concat(F.lit("- ["), F.coalesce(c["source_id"], F.lit("null")), F.lit("] "), F.coalesce(c["content"], F.lit("null")), F.lit("\n")))
    return F.when(F.size(chunks) > 0, strip_trailing(F.concat(F.lit("Context:\n"), F.array_join(lines, ""))))


def system_prompt(persona_prefix: Column, skills: Column) -> Column:
    """Persona prefix, blank line, catalogue of skills (name, description); trailing white space off; may be empty."""
    head = F.when(is_blank(persona_prefix), F.lit("")).otherwise(F.concat(persona_prefix, F.lit("\n\n")))
    lines = F.transform(skills, lambda s: F.concat(F.lit("- "), s["name"], F.lit(": "), F.coalesce(s["description"], F.lit("")), F.lit("\n")))
    catalogue = F.when(F.coalesce(F.size(skills) > 0, F.lit(False)), F.concat(F.lit("Available skills:\n"), F.array_join(lines, ""))).otherwise(F.lit(""))
    return strip_trailing(F.concat(head, catalogue))


def assemble(system: Column, activated: Column, chunks: Column, history: Column, user_input: Column) -> Column:
    """Array of messages: system if not blank, a message for each activated skill (name, body), the context if there are
    chunks, the history, the user's turn. Null arrays count as empty."""
    empty = F.array().cast(f"array<{MESSAGE}>")
    skills = F.transform(activated, lambda s: message("SYSTEM", F.concat(F.lit("[Skill: "), s["name"], F.lit("]\n"), F.coalesce(s["body"], F.lit("")))))
    context = context_block(chunks)
    return F.concat(
        F.when(~is_blank(system), F.array(message("SYSTEM", system))).otherwise(empty),
        F.coalesce(skills, empty),
        F.when(context.isNotNull(), F.array(message("SYSTEM", context))).otherwise(empty),
        F.coalesce(F.transform(history, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), empty),
        F.array(message("USER", user_input)),
    )


def split_history(messages: Column) -> Column:
    """struct(user_input, history, error): the last message is the input, the others the history; none is an error."""
    n = F.size(messages)
    some = F.coalesce(n > 0, F.lit(False))
    return F.struct(
        F.when(some, F.element_at(messages, -1)["content"]).alias("user_input"),
        F.when(some, F.transform(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))), lambda m: F.struct(F.upper(m["role"]).alias("role"), m["content"].alias("content")))).alias("history"),
        F.when(~some, F.lit("invalid_request")).alias("error"),
    )
