"""Tool servers from executors: JSON-RPC lines to a child process or over HTTP, and retrieval through their tools. Opt in, as ``sources.http``.

Rows are requests (``id``, ``line``, and whatever else they carry); each gets ``reply``, the line of the response with its id, or null
for a timeout or a server that is gone. A session lives as long as a task: one child process, or a connection for each request.
Spark may run a task again after a loss, so tools must bear a repeated call.
"""

from __future__ import annotations

import json
import logging
import subprocess
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.operators import mcp

HELLO = json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {"protocolVersion": mcp.PROTOCOL, "capabilities": {}, "clientInfo": {"name": "quillmesh", "version": "1"}}})
READY = json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized", "params": {}})


def response_id(line: str):
    """The id of a response; null for any other line, malformed ones included."""
    try:
        told = json.loads(line)
    except ValueError:
        return None
    return told.get("id") if isinstance(told, dict) and ("result" in told or "error" in told) else None


class ProcessSession:
    """A child process that reads requests and writes responses, a line each, in any order."""

    def __init__(self, command: list[str], timeout: float = 30.0):
        self.timeout = timeout
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", bufsize=1)  # noqa: S603
        self.came, self.replies, self.open = threading.Condition(), {}, True
        threading.Thread(target=self._listen, daemon=True).start()
        threading.Thread(target=self._log, daemon=True).start()

    def _listen(self) -> None:
        for line in self.process.stdout:
            key = response_id(line)
            if key is not None:
                with self.came:
                    self.replies[key] = line.rstrip("\r\n")
                    self.came.notify_all()
        with self.came:
            self.open = False
            self.came.notify_all()

    def _log(self) -> None:
        for line in self.process.stderr:
            logging.getLogger(__name__).debug("tool server: %s", line.rstrip())

    def send(self, line: str) -> bool:
        try:
            self.process.stdin.write(line.rstrip("\r\n") + "\n")
            self.process.stdin.flush()
        except (OSError, ValueError):
            return False
        return True

    def receive(self, key, until: float) -> str | None:
        with self.came:
            self.came.wait_for(lambda: key in self.replies or not self.open, max(0.0, until - time.monotonic()))
            return self.replies.pop(key, None)

    def ask(self, lines: list[tuple[int, str]]) -> list[str | None]:
        """All lines are sent before the first response is waited for; each has the whole timeout."""
        until = time.monotonic() + self.timeout
        sent = [self.send(line) for _, line in lines]
        return [self.receive(key, until) if ok else None for (key, _), ok in zip(lines, sent)]

    def close(self) -> None:
        self.process.kill()
        self.process.wait()


def _answered(df: DataFrame, run: Callable) -> DataFrame:
    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())]))


def call_process(df: DataFrame, command: list[str], *, timeout: float = 30.0, greet: bool = True) -> DataFrame:
    """Adds ``reply`` from a process that each task starts, greets (initialize) and ends. Rows with a null id or line aren't sent."""

    def run(batches):
        session = None
        try:
            for pdf in batches:
                if session is None and len(pdf):
                    session = ProcessSession(command, timeout)
                    if greet:
                        session.ask([(0, HELLO)])
                        session.send(READY)
                good = pdf["id"].notna() & pdf["line"].notna()
                asked = [(int(i), line) for i, line in zip(pdf["id"][good], pdf["line"][good])]
                replies = pd.Series(None, index=pdf.index, dtype=object)
                if asked:
                    replies[good] = session.ask(asked)
                yield pdf.assign(reply=replies)
        finally:
            if session is not None:
                session.close()

    return _answered(df, run)


def matching_frame(body: str, content_type: str | None, key) -> str | None:
    """The response with the id in an HTTP reply, which is JSON or an event stream of which other frames are passed over."""
    if "text/event-stream" not in (content_type or ""):
        return body if response_id(body) == key else None
    frame: list[str] = []
    for line in [*body.splitlines(), ""]:
        if line.startswith("data:"):
            frame.append(line[5:].removeprefix(" "))
        elif not line and frame:
            whole, frame = "\n".join(frame), []
            if response_id(whole) == key:
                return whole
    return None


def call_http(df: DataFrame, url: str, *, headers: dict[str, str] | None = None, timeout: float = 30.0) -> DataFrame:
    """Adds ``reply`` of a server that takes a request a POST. Rows with a null id or line aren't sent."""
    sent = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream", **(headers or {})}

    def one(key: int, line: str) -> str | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, line.encode(), sent), timeout=timeout) as reply:  # noqa: S310
                return matching_frame(reply.read().decode("utf-8", "replace"), reply.headers.get("Content-Type"), key)
        except (OSError, ValueError):
            return None

    def run(batches):
        for pdf in batches:
            yield pdf.assign(reply=pd.Series([None if pd.isna(i) or line is None else one(int(i), line) for i, line in zip(pdf["id"], pdf["line"])], index=pdf.index, dtype=object))

    return _answered(df, run)


def tool_retriever(call: Callable[[DataFrame], DataFrame], tool: str) -> Callable[[DataFrame], DataFrame]:
    """A retriever for the pipeline that asks a tool: each block of its result is a chunk, in order. Failed calls give no chunks."""

    def retrieve(asked: DataFrame) -> DataFrame:
        key = F.xxhash64("request_id").bitwiseAND(F.lit(2**52 - 1)) + 1
        line = mcp.jsonrpc_request(key, F.lit("tools/call"), mcp.call_params(F.lit(tool), mcp.query_arguments(F.col("query"), F.col("top_k"))))
        told = call(asked.select("request_id", key.alias("id"), line.alias("line")))
        chunks = mcp.chunks_of_result(mcp.jsonrpc_reply(F.col("reply"))["result"], F.lit(tool))
        found = told.where("reply is not null").select("request_id", F.posexplode(chunks).alias("at", "c"))
        return found.select("request_id", (F.col("at") + 1).alias("rank"), "c.content", "c.source_id", F.col("c.score").cast("double").alias("score"))

    return retrieve
