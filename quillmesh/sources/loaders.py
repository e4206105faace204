"""Documents, skills and routing rules from files, and chat requests from JSON."""

from __future__ import annotations

import re
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
RULES = "rule_ord int, kind string, keywords array<string>, regex string, provider string, model string"
SKILLS = "name string, description string, triggers array<string>, body string, reg_ord int"
#: Files of one directory listing of skills or rules: small configuration, read on the driver.
MAX_CONFIG_FILES = 10_000


def load_documents(spark: SparkSession, directory: str, suffix: str = "txt") -> DataFrame:
    """(id, content, metadata) of the files with the suffix, case aside, directly in the directory; the id is the file name.

    Unreadable files are skipped; a missing directory is an error. Rows have no order; sort by id if one is needed.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    rows = spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").option("wholetext", "true").format("text").load(directory)
    return rows.select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("content"), F.create_map(F.lit("path"), F.col("_metadata.file_path")).alias("metadata"))


def load_text_documents(spark: SparkSession, directory: str) -> DataFrame:
    return load_documents(spark, directory, "txt")


def load_markdown_documents(spark: SparkSession, directory: str) -> DataFrame:
    return load_documents(spark, directory, "md")


@dataclass(frozen=True)
class FileLoader:
    """A loader of ``plans.ingestion`` over the files of a directory."""

    directory: str
    suffix: str = "txt"

    def load(self, spark: SparkSession) -> DataFrame:
        return load_documents(spark, self.directory, self.suffix)


def parse_skill(text: str) -> dict:
    """Front matter between two lines of three hyphens, then the body, trimmed. Missing or unclosed front matter is an error."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)(.*)", text, re.S)
    if not m:
        raise ValueError("a skill file must start with front matter between --- lines")
    head = yaml.safe_load(m[1]) or {}
    if not isinstance(head, dict):
        raise ValueError("front matter must be a mapping")
    return {"name": head.get("name"), "description": head.get("description"), "triggers": list(head.get("triggers") or []), "body": m[2].strip()}


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> list[tuple[str, str]]:
    """(path, content) of small configuration files on any file system Spark knows, sorted by path; bounded and checked."""
    reader = spark.read.option("wholetext", "true").format("text")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.col("_metadata.file_path").alias("path"), "value").limit(MAX_CONFIG_FILES + 1).collect()
    if len(rows) > MAX_CONFIG_FILES:
        raise ValueError(f"more than {MAX_CONFIG_FILES} files")
    return sorted((r.path, r.value) for r in rows)


def load_skills(spark: SparkSession, directory: str) -> DataFrame:
    """(name, description, triggers, body, reg_ord) of the .md files directly in the directory, in the order of their paths."""
    read = [parse_skill(text) for _, text in read_files(spark, directory, "*.md")]
    return spark.createDataFrame([(s["name"], s["description"], s["triggers"], s["body"], i) for i, s in enumerate(read)], SKILLS)


def parse_rules(text: str) -> tuple[list[tuple], tuple[str, str]]:
    """(rules, default target). Each rule has exactly one of keyword and regex; the default is required; other keys are ignored."""
    doc = yaml.safe_load(text) or {}
    rules = []
    for i, r in enumerate(doc.get("rules") or []):
        match = r.get("match")
        if not match:
            raise ValueError(f"rule {i} has no match")
        words, regex = match.get("keyword"), match.get("regex")
        if (words is None) == (regex is None):
            raise ValueError(f"rule {i} must have either keyword or regex")
        if words is not None and not isinstance(words, list):
            words = [words]
        rules.append((i, "keyword" if words is not None else "regex", words, regex, r.get("provider"), r.get("model")))
    default = doc.get("default")
    if not default:
        raise ValueError("a default target is required")
    return rules, (default.get("provider"), default.get("model"))


def load_rules_file(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, str]]:
    rules, default = parse_rules(read_files(spark, path)[0][1])
    return spark.createDataFrame(rules, RULES), default


def chat_requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """(model, messages, stream, error) of chat request bodies: malformed JSON and no messages are invalid_request."""
    j = F.from_json(F.col(body_col), f"model string, messages {MESSAGES}, stream boolean, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = bodies.withColumn("__j", j)
    bad = F.col("__j").isNull() | F.col("__j._corrupt").isNotNull() | F.coalesce(F.size("__j.messages") < 1, F.lit(True))
    return rows.withColumns({"model": F.col("__j.model"), "messages": F.col("__j.messages"), "stream": F.coalesce("__j.stream", F.lit(False)), "error": F.when(bad, F.lit("invalid_request"))}).drop("__j")
