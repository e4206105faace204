"""Mixing sources to target weights by weighted sampling without replacement, epoch by epoch.

Efraimidis-Spirakis: document d of quality weight w gets the key E / w with E exponential, drawn by hash, so
that the documents of a source in the order of their keys are a weighted sample. A source's token
budget is filled first by complete epochs, then by the documents of smallest keys whose prefix sum of
tokens stays within what is left.

Scale. No source is sorted in one task: keys fall into monotone buckets, whose sums are added up in a small
table, and prefix sums within a bucket start from there. Buckets grow in number with the rows.
"""

from __future__ import annotations

import functools
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.session import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ROWS_A_BUCKET = 20_000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def ship_tokenizer(spark: SparkSession, path: str) -> str:
    """Sends the tokenizer's file, which only the driver need have, with the job; the name by which executors find it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _counter(name: str):
    def run(batches):
        t = _tokenizer(SparkFiles.get(name))
        for pdf in batches:
            n = [len(e) for at in range(0, len(pdf), 64) for e in t.encode_batch(pdf["text"].iloc[at : at + 64].to_list(), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "weight": pdf["weight"], "tokens": n})

    return run


def source_key(source):
    """One spelling for a source: trimmed, lower case, runs of blanks, hyphens and underscores as one underscore."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")
    return F.when(key != "", key)


def quality_weight(text):
    """Between 0.05 and 1, where no column of weights is given: the share of letters and blanks, times the share of lines that differ,
    less for texts under 200 characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    return F.greatest(F.lit(0.05), letters * fresh * F.least(F.lit(1.0), F.length(text) / F.lit(200.0)))


def _sources(targets: DataFrame) -> DataFrame:
    given = targets.select(source_key(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
    good = given.where("source is not null and w > 0 and not isnan(w)")
    return good.groupBy("source").agg(F.sum("w").alias("w"), F.greatest(F.coalesce(F.max("r"), F.lit(1)), F.lit(0)).alias("max_repeats"))


def plan_budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, n_docs, budget): one row for each source with a target.

    Shares are the weights scaled to sum to 1. Without ``total_tokens`` the total is the largest with which
    every source that has documents can supply its share within its repeats. The share of sources
    without documents is spread over the others in proportion.
    """
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("n_docs"))
    rows = _sources(targets).join(sizes, "source", "left").fillna(0, ["available_tokens", "n_docs"])
    all_rows = Window.partitionBy(F.lit(0))  # one row a source
    usable = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0)
    rows = rows.withColumn("target_share", F.col("w") / F.sum("w").over(all_rows)).withColumn("p", F.when(usable, F.col("w")) / F.sum(F.when(usable, F.col("w"))).over(all_rows))
    most = F.col("available_tokens") * F.col("max_repeats")
    total = F.lit(int(total_tokens)).cast("double") if total_tokens is not None else F.min(F.when(usable, most / F.col("p"))).over(all_rows)
    return rows.withColumn("budget", F.coalesce(F.least(most, F.floor(F.col("p") * total + 1e-6)), F.lit(0)).cast("bigint")).select("source", "target_share", "max_repeats", "available_tokens", "n_docs", "budget")


def size_documents(docs: DataFrame, tokenizer: str = TOKENIZER, quality_col: str | None = None) -> DataFrame:
    """(doc_id, source, weight, tokens) of documents with a source and a text of at least one token, checkpointed.

    ``quality_col`` has the documents' quality weights; null and non-positive ones count as 0.05. A document given under several sources or texts
    counts once, under the first source and with the fewest tokens.
    """
    quality = F.greatest(F.lit(0.05), F.coalesce(F.col(quality_col).cast("double"), F.lit(0.05))) if quality_col else quality_weight(F.col("text"))
    rows = docs.where("doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), F.col("text").alias("text"), quality.alias("weight")).where("source is not null and text is not null and text <> ''")
    kind = dict(docs.dtypes)["doc_id"]
    sized = spread(rows).mapInPandas(_counter(ship_tokenizer(docs.sparkSession, tokenizer)), f"doc_id {kind}, source string, weight double, tokens bigint").where("tokens > 0")
    return cut_lineage(sized.groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "weight")).alias("s")).select("doc_id", "s.source", "s.weight", "s.tokens"))


def mix_sources(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, tokenizer: str = TOKENIZER, quality_col: str | None = None, seed: int = 1, sized: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each chosen document is used.

    docs: doc_id, source, text; targets: source, target_weight, max_repeats. Sources match whatever their
    case and separators. Documents without source, target or tokens are not used; targets without weight
    count for nothing, and a missing max_repeats is 1. Ties of keys go by doc_id. Empty tables give an
    empty result; other columns are ignored.
    """
    sized = size_documents(docs, tokenizer, quality_col) if sized is None else sized
    budgets = plan_budgets(sized, targets, total_tokens)
    buckets = max(1, min(1_000_000, -(-sized.count() // ROWS_A_BUCKET)))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    keyed = sized.withColumn("key", -F.log(uniform) / F.col("weight"))
    # Monotone in the key, and about even within a source: keys are near exponential with its mean weight as rate.
    rates = sized.groupBy("source").agg(F.avg("weight").alias("rate"))
    keyed = keyed.join(rates, "source").withColumn("bucket", F.least(F.floor(buckets * (1 - F.exp(-F.col("rate") * F.col("key")))), F.lit(buckets - 1)).cast("int")).drop("rate")
    # Partial sums by source and bucket: at most sources times buckets rows.
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("start", F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).drop("t")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.join(before.hint("merge"), ["source", "bucket"]).withColumn("prefix", F.col("start") + F.sum("tokens").over(within))
    epochs = F.least(F.floor(F.col("budget") / F.col("available_tokens")), F.col("max_repeats"))
    left = F.col("budget") - epochs * F.col("available_tokens")
    extra = ((F.col("prefix") <= left) & (epochs < F.col("max_repeats"))).cast("int")
    chosen = run.join(budgets, "source").withColumn("repeats", (epochs + extra).cast("int"))
    return chosen.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def mix_shares(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, tokenizer: str = TOKENIZER, quality_col: str | None = None, seed: int = 1) -> DataFrame:
    """(source, target_share, actual_share, budget_tokens, used_tokens, n_docs_used, most_repeats, max_repeats) for each source with a target."""
    sized = size_documents(docs, tokenizer, quality_col)
    mixed = mix_sources(docs, targets, total_tokens=total_tokens, tokenizer=tokenizer, seed=seed, sized=sized)
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_docs_used"), F.max("repeats").alias("most_repeats"))
    rows = plan_budgets(sized, targets, total_tokens).join(used, "source", "left").fillna(0, ["used_tokens", "n_docs_used", "most_repeats"])
    actual = F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select("source", "target_share", F.coalesce(actual, F.lit(0.0)).alias("actual_share"), F.col("budget").alias("budget_tokens"), "used_tokens", "n_docs_used", "most_repeats", "max_repeats")
