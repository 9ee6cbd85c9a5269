"""Responses of a paid service: every request is sent once, whatever is started again.

A request is known by its fingerprint. Its state goes from nothing to pending (a task is known), to complete or to
submission_unknown (it may have been sent, nobody knows): the latter is left alone until somebody looks at it. The states are
an append-only table in shared storage, which is the only truth; a streaming checkpoint may be lost. Before a request is
sent it is claimed, which succeeds once: a second writer, a task that is tried again and a speculative one leave it alone.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plenaria import schema
from plenaria.runtime import mounted

COMPLETE, PENDING, UNKNOWN = "complete", "pending", "submission_unknown"
ROWS = f"{schema.STATE_DDL}, step bigint, writer string, at_utc timestamp"
Send = Callable[[str, str], dict]
#: Rounds of asking for pending responses.
ROUNDS = 120


class FileClaims:
    """Claims as files that can be made once, in a folder that all workers share. Other storage needs claims of its own with
    the same two methods (a conditional put, say)."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def take(self, fingerprint: str) -> bool:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(f"{self.folder}/{fingerprint}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True

    def drop(self, fingerprints: list[str]) -> None:
        for x in fingerprints:
            Path(self.folder, x).unlink(missing_ok=True)


class ResponseStates:
    """The table of states at a path."""

    def __init__(self, spark: SparkSession, path: str, claims: FileClaims | None = None) -> None:
        self.spark, self.path = spark, path
        self.claims = claims or FileClaims(f"{mounted(path).rstrip('/')}-claims")

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROWS).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], ROWS)

    def latest(self) -> DataFrame:
        """The last state of every fingerprint; combined on the map side. In one step of several writers the further state counts."""
        rest = [c.split()[0] for c in schema.STATE_DDL.split(", ")][1:]
        rank = F.when(F.col("status") == COMPLETE, 3).when(F.col("status") == PENDING, 2).when(F.col("status") == UNKNOWN, 1).otherwise(0)
        return self.history().groupBy("fingerprint").agg(F.max(F.struct("step", rank.alias("rank"), *rest)).alias("s")).select("fingerprint", *[F.col(f"s.{c}").alias(c) for c in rest], F.col("s.step").alias("step"))

    def errors(self) -> DataFrame:
        """The log of errors: at_utc, fingerprint, error_type, message."""
        found = self.history().where("error IS NOT NULL")
        return found.select("at_utc", "fingerprint", F.substring_index("error", ": ", 1).alias("error_type"), F.expr("substring(error, instr(error, ': ') + 2)").alias("message"))

    def _append(self, rows: DataFrame) -> str:
        """Append rows as one step of a writer of their own, whose name is returned."""
        step, writer = (self.history().agg(F.max("step")).first()[0] or 0) + 1, uuid.uuid4().hex
        made = rows.withColumns({"step": F.lit(step).cast("bigint"), "writer": F.lit(writer), "at_utc": F.current_timestamp()})
        made.select([c.split()[0] for c in ROWS.split(", ")]).write.mode("append").parquet(self.path)
        return writer

    def submit(self, requests: DataFrame, send: Send, strict: bool = False) -> None:
        """Send the requests (fingerprint, text) that have no state yet, each fingerprint once.

        They are written as submission_unknown before anything is sent; a crash in between leaves that, and no request is
        ever sent twice. send(fingerprint, text) returns {task_id} or {response}; an error is noted and the state stays. strict:
        an error that was noted is raised in the end.
        """
        fresh = requests.groupBy("fingerprint").agg(F.min("text").alias("text")).join(self.latest().where("status IS NOT NULL").select("fingerprint"), "fingerprint", "left_anti")
        # written down: what is sent next is what the table says, not a new look at the requests
        marked = fresh.select("fingerprint", F.lit(UNKNOWN).alias("status"), F.lit(None).cast("string").alias("task_id"), F.lit(None).cast("string").alias("error"), F.col("text").alias("response"))
        claimed = self._append(marked)
        own = self.history().where(F.col("writer") == claimed)
        done = self._append(self._call(own.select("fingerprint", F.col("response").alias("text")), send, self.claims))
        if strict and (wrong := self.history().where((F.col("writer") == done) & F.col("error").isNotNull()).select("fingerprint", "error").first()):
            raise RuntimeError(f"{wrong.fingerprint}: {wrong.error}")

    def poll(self, send: Send, rounds: int = 1, sleep: Callable[[float], None] = time.sleep) -> int:
        """Ask for the pending ones: send(fingerprint, task_id) returns {response} or {} if it isn't ready. It is asked again, ever
        later, for the given number of rounds at most; returns how many are pending still."""
        left = 0
        for k in range(min(rounds, ROUNDS)):
            waiting = self.latest().where(F.col("status") == PENDING)
            asked = self._call(waiting.select("fingerprint", F.col("task_id").alias("text")), send, None)
            self._append(asked.where(F.col("status") == COMPLETE))
            left = self.latest().where(F.col("status") == PENDING).count()
            if not left or k + 1 == rounds:
                break
            sleep(min(2.0**k, 60.0))
        return left

    def reset(self, fingerprints: list[str]) -> None:
        """Let unknown submissions be sent again after somebody has looked at them: a row without status says so."""
        known = self.latest().where((F.col("status") == UNKNOWN) & F.col("fingerprint").isin(fingerprints))
        again = [r.fingerprint for r in known.select("fingerprint").collect()]
        self._append(known.withColumns({c: F.lit(None).cast("string") for c in ("status", "task_id", "error", "response")}))
        self.claims.drop(again)

    @staticmethod
    def _call(rows: DataFrame, send: Send, claims: FileClaims | None) -> DataFrame:
        def run(batches):
            for pdf in batches:
                out = []
                for key, text in zip(pdf["fingerprint"], pdf["text"], strict=True):
                    if claims is not None and not claims.take(key):
                        continue
                    try:
                        got = send(key, text)
                        status = COMPLETE if got.get("response") is not None else PENDING if got.get("task_id") else UNKNOWN
                        out.append((key, status, got.get("task_id"), None, got.get("response")))
                    except Exception as problem:  # noqa: BLE001 - whatever it was, the request may have been sent
                        out.append((key, UNKNOWN, None, f"{type(problem).__name__}: {problem}", None))
                yield pd.DataFrame(out, columns=["fingerprint", "status", "task_id", "error", "response"])

        return rows.mapInPandas(run, schema.STATE_DDL)

    def responses(self, requests: DataFrame) -> DataFrame:
        """requests (fingerprint and other columns) with the responses of the complete ones."""
        done = self.latest().where(F.col("status") == COMPLETE).select("fingerprint", "response")
        return requests.join(done, "fingerprint")

    def follow(self, stream: DataFrame, send: Send, checkpoint: str):
        """A streaming query that submits what a stream of requests (fingerprint, text) brings."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.submit(batch, send)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
