"""Routing rules, explicit overrides, and skills matched by keyword."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import contains_any

MAX_RULES = 10_000
CASE_RULES = 64  # up to so many rules are branches of one CASE; more are looked up in blocks
RULES_A_BLOCK = 1_000
TARGET = "struct<provider:string,model:string>"


def rule_matches(text: Column, kind: Column, keywords: Column, regex: Column) -> Column:
    """A keyword rule matches by substring, a regex rule by search; null text or pattern matches nothing."""
    by_word = contains_any(text, keywords)
    by_regex = F.coalesce(F.regexp_like(text, regex), F.lit(False))
    return F.when(F.lower(kind) == "keyword", by_word).when(F.lower(kind) == "regex", by_regex).otherwise(F.lit(False))


def _first_of_block(text: Column, rules: list[dict]) -> Column:
    """Target of the first matching rule of a block, which is one literal of the plan; null for none."""
    told = [{k: r.get(k) for k in ("kind", "keywords", "regex", "provider", "model")} for r in rules]
    block = F.from_json(F.lit(json.dumps(told)), "array<struct<kind:string,keywords:array<string>,regex:string,provider:string,model:string>>")
    hit = F.get(F.filter(block, lambda r: rule_matches(text, r["kind"], r["keywords"], r["regex"])), 0)
    return F.when(hit.isNotNull(), F.struct(hit["provider"].alias("provider"), hit["model"].alias("model")))


def rules_as_case(text: Column, rules: list[dict], default: tuple[str, str] | None) -> Column:
    """struct(provider, model) of the first matching rule by rule_ord, else the default, else null.

    Few rules are one flat CASE, so each pattern is compiled once; more are blocks of literals, searched in order. Both give the same.
    """

    def target(p: str | None, m: str | None) -> Column:
        return F.struct(F.lit(p).cast("string").alias("provider"), F.lit(m).cast("string").alias("model"))

    last = target(*default) if default else F.lit(None).cast(TARGET)
    kind = lambda r: (r["kind"] or "").lower()
    known = [r for r in sorted(rules, key=lambda r: r["rule_ord"]) if kind(r) in ("keyword", "regex")]
    if not known:
        return last
    if len(known) > CASE_RULES:
        return F.coalesce(*[_first_of_block(text, known[at : at + RULES_A_BLOCK]) for at in range(0, len(known), RULES_A_BLOCK)], last)
    out = None
    for r in known:
        words = F.array(*[F.lit(k) for k in (r.get("keywords") or [])]).cast("array<string>")
        hit = contains_any(text, words) if kind(r) == "keyword" else (F.coalesce(text.rlike(r["regex"]), F.lit(False)) if r.get("regex") else F.lit(False))
        out = F.when(hit, target(r["provider"], r["model"])) if out is None else out.when(hit, target(r["provider"], r["model"]))
    return out.otherwise(last)


def load_rules(rules: DataFrame) -> list[dict]:
    """The rules as a list; their number is bounded by ``MAX_RULES``, checked here."""
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [r.asDict(recursive=True) for r in rows]


def route(requests: DataFrame, rules: DataFrame, default: tuple[str, str] | None, *, input_col: str = "user_input") -> DataFrame:
    """Adds route_provider, route_model and route_error.

    Explicit provider_id and model of a request win, each by itself; the router is asked only if one of them
    is null. Without a rule and without default the error is routing_error.
    """
    hit = rules_as_case(F.col(input_col), load_rules(rules), default)
    open_fields = F.col("provider_id").isNull() | F.col("model").isNull()
    with_route = requests.withColumn("__route", F.when(open_fields, hit))
    return with_route.withColumns(
        {
            "route_provider": F.coalesce("provider_id", "__route.provider"),
            "route_model": F.coalesce("model", "__route.model"),
            "route_error": F.when(open_fields & F.col("__route").isNull(), F.lit("routing_error")),
        }
    ).drop("__route")


def match_skills(inputs: DataFrame, skills: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, skill): every skill of which a trigger is in the text, case aside. The skills are a bounded list, checked."""
    rows = load_rules(skills.select("name", "triggers"))
    hits = F.array_compact(F.array(*[F.when(contains_any(F.col(text_col), F.array(*[F.lit(t) for t in (r["triggers"] or [])]).cast("array<string>")), F.lit(r["name"])) for r in rows]).cast("array<string>"))
    return inputs.select(F.col(id_col).alias("id"), F.explode(hits).alias("skill"))


def latest_skills(skills: DataFrame) -> DataFrame:
    """One row a name, the last registered (largest reg_ord)."""
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in skills.columns]), "reg_ord")
    return skills.groupBy("name").agg(last.alias("s")).select("s.*")


def lookup(names: DataFrame, registry: DataFrame, key: str, error: str) -> DataFrame:
    """Left join by key; names without an entry get the error in column lookup_error."""
    known = registry.withColumn("__known", F.lit(True))
    joined = names.join(known, key, "left")
    return joined.withColumn("lookup_error", F.when(F.col("__known").isNull(), F.lit(error))).drop("__known")
