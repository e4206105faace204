"""Streaming forms of the operators: guards on a stream, token streams with carried state, correlation, running totals."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.operators.codecs import decode_lines
from quillmesh.operators.guards import INPUT, GuardChain
from quillmesh.operators.mcp import jsonrpc_reply
from quillmesh.operators.usage import usage_totals

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHUNKS = "stream_id string, seq bigint, delta string, done boolean, finish_reason string, first boolean"


def guard_stream(stream: DataFrame, text_col: str, chain: GuardChain) -> DataFrame:
    """The chain on a stream; the same columns as on a batch."""
    return chain.run(stream, text_col, INPUT)


class CarryReason(StatefulProcessor):
    """Keeps the last finish reason of each stream and whether its first chunk went out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carried", StructType([StructField("reason", StringType()), StructField("started", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        # The reason told last before each row, of this batch or carried from one before it.
        told = batch["said"].astype(object).where(batch["said"].notna(), None)
        before = pd.concat([pd.Series([held[0]], dtype=object), told], ignore_index=True).ffill()
        done, kept = batch["done"].astype(bool), batch["keep"].astype(bool)
        out = pd.DataFrame({"stream_id": key[0], "seq": batch["seq"], "delta": batch["delta"].astype(object).where(~done, None), "done": done, "finish_reason": before.iloc[:-1].astype(object).where(done, None)})[kept]
        out = out.astype({"finish_reason": object}).assign(first=(pd.RangeIndex(len(out)) == 0) & (held[1] is None))
        out["finish_reason"] = out["finish_reason"].where(out["finish_reason"].notna(), None)
        last = before.iloc[-1]
        self.state.update((last if isinstance(last, str) else None, held[1] or ("y" if len(out) else None)))
        yield out

    def close(self) -> None:
        pass


def stream_lines(lines: DataFrame, provider: str) -> DataFrame:
    """Columns stream_id, seq, delta, done, said, keep of event-stream lines, without state."""
    from quillmesh.operators.codecs import finish_reason, sse_payload

    data = lines.withColumn("data", sse_payload(F.col("line"))).where("data is not null")
    if provider == "openai":
        c = F.get(F.from_json("data", "choices array<struct<delta:struct<content:string>,finish_reason:string>>")["choices"], 0)
        done = F.col("data") == "[DONE]"
        said, delta, keep = F.when(~done & c["finish_reason"].isNotNull(), finish_reason(c["finish_reason"], "openai")), F.coalesce(c["delta"]["content"], F.lit("")), F.lit(True)
    else:
        j = F.from_json("data", "type string, delta struct<text:string,stop_reason:string>")
        done = F.coalesce(j["type"] == "message_stop", F.lit(False))
        said = F.when((j["type"] == "message_delta") & j["delta"]["stop_reason"].isNotNull(), finish_reason(j["delta"]["stop_reason"], "anthropic"))
        delta, keep = F.coalesce(j["delta"]["text"], F.lit("")), F.coalesce(j["type"].isin("content_block_delta", "message_stop"), F.lit(False))
    return data.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("bigint").alias("seq"), delta.alias("delta"), done.alias("done"), said.alias("said"), keep.alias("keep"))


def decode_stream(lines: DataFrame, provider: str) -> DataFrame:
    """Chunks of a stream of lines (stream_id, seq, line), the finish reason carried over micro-batches.

    Needs the RocksDB state store (``ROCKSDB``). On a batch use ``codecs.decode_lines``; both give the same rows.
    """
    if provider == "ollama":
        return decode_lines(lines, provider)
    return stream_lines(lines, provider).groupBy("stream_id").transformWithStateInPandas(CarryReason(), outputStructType=CHUNKS, outputMode="Append", timeMode="None")


def correlate_streams(requests: DataFrame, replies: DataFrame, timeout: str = "30 seconds") -> DataFrame:
    """Requests (id, method, sent_at) with replies (line, arrived_at): left outer by id within the timeout; no reply is a timeout."""
    read = replies.withColumn("r", jsonrpc_reply(F.col("line"))).where("r.is_response").select(F.col("r.id").alias("reply_id"), F.col("r.result").alias("result"), F.col("r.error_code").alias("error_code"), "arrived_at")
    left = requests.withWatermark("sent_at", timeout)
    right = read.withWatermark("arrived_at", timeout)
    near = F.expr(f"id = reply_id AND arrived_at BETWEEN sent_at AND sent_at + INTERVAL {timeout}")
    joined = left.join(right, near, "left_outer")
    status = F.when(F.col("reply_id").isNull(), F.lit("timeout")).when(F.col("error_code").isNotNull(), F.lit("error")).otherwise(F.lit("ok"))
    return joined.select("id", "method", status.alias("status"), "result")


def running_usage(log: DataFrame) -> DataFrame:
    """Totals by provider and model over a stream, in update or complete mode."""
    return usage_totals(log)


def isolated(write):
    """A foreachBatch function that logs what ``write(batch, epoch)`` raises and goes on, for audit sinks that must not stop a query."""

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch, epoch)
        except Exception:
            logging.getLogger(__name__).exception("audit sink failed in epoch %s", epoch)

    return run
