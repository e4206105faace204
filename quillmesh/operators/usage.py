"""Token usage: totals, cost, saturated snapshots, sums over rounds, and spans of phase events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def usage_totals(log: DataFrame, keys: tuple[str, ...] = ("provider_id", "model")) -> DataFrame:
    """Sums of prompt, completion and total tokens as long, and calls, for each key; null counts are 0."""
    sums = [F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return log.groupBy(*keys).agg(*sums, F.count("*").alias("calls"))


def with_cost(totals: DataFrame, price: DataFrame) -> DataFrame:
    """Adds estimated_cost: prices per thousand tokens by model; without price, or with part of it missing, 0.0."""
    rates = price.groupBy("model").agg(F.max_by(F.struct("prompt_per_1k", "completion_per_1k"), F.struct("prompt_per_1k", "completion_per_1k")).alias("r"))
    cost = (F.col("prompt_tokens") / 1000.0) * F.col("r.prompt_per_1k") + (F.col("completion_tokens") / 1000.0) * F.col("r.completion_per_1k")
    return totals.join(rates, "model", "left").withColumn("estimated_cost", F.coalesce(cost, F.lit(0.0))).drop("r")


def saturate(column):
    return F.least(F.greatest(column, F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int")


def snapshot(totals: DataFrame) -> DataFrame:
    """The sums clamped to the range of int."""
    return totals.withColumns({c: saturate(F.col(c)) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "calls")})


def usage_lookup(keys: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of the given (provider_id, model); keys never seen have zeros."""
    out = keys.join(totals, ["provider_id", "model"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "calls")})


def spans(events: DataFrame) -> DataFrame:
    """One span a request from its phase events (request_id, seq, phase, attributes map, error).

    The last value of an attribute wins, every event is listed in order, and a failed phase makes the
    status ERROR; a completed one OK; neither leaves it null.
    """
    pairs = events.select("request_id", "seq", F.explode_outer("attributes").alias("key", "value"))
    last = pairs.where("key is not null").groupBy("request_id", "key").agg(F.max_by("value", "seq").alias("value"))
    attrs = last.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    listed = events.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "phase"))), lambda e: e["phase"]).alias("events"),
        F.max_by(F.when(F.col("phase") == "chat.failed", F.lit("ERROR")).otherwise(F.lit("OK")), F.when(F.col("phase").isin("chat.failed", "chat.complete"), F.col("seq"))).alias("status"),
        F.max("error").alias("error"),
    )
    return listed.join(attrs, "request_id", "left")
