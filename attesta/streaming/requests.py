"""Verification requests as a stream: pacing, write-through of live finds, the log, failures, and camera frames.

Each step is a function of a streaming DataFrame. `run_available` drives one over what has arrived and ends, which is also how
a scheduled job runs it; checkpoints and sinks lie in folders that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.operators.registry import ATTRIBUTES, backfill, merge_batch
from attesta.operators.symbol import decode_images
from attesta.sources.durable import children

MIN_GAP_MS, COOLDOWN_MS = 3000, 60_000


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """What has arrived, batch by batch through `each`, then stop. A batch that is repeated after a failure has the same number."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def paced(requests: DataFrame, min_gap_ms: int = MIN_GAP_MS) -> DataFrame:
    """(source, req_id, arrival_ms, scheduled_ms): calls to one live source one after another, `min_gap_ms` apart.

    requests: (source, req_id, arrival_ms), a batch or a stream. The state is one number a source. Within a batch calls go in
    the order of (arrival_ms, req_id).
    """

    def run(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(frames).sort_values(["arrival_ms", "req_id"], kind="stable")
        times = []
        for arrival in pdf["arrival_ms"].tolist():
            last = arrival if last is None else max(arrival, last + min_gap_ms)
            times.append(last)
        state.update((last,))
        yield pdf.assign(scheduled_ms=times)[["source", "req_id", "arrival_ms", "scheduled_ms"]]

    return requests.groupBy("source").applyInPandasWithState(run, "source string, req_id bigint, arrival_ms bigint, scheduled_ms bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def paced_batch(requests: DataFrame, min_gap_ms: int = MIN_GAP_MS) -> DataFrame:
    """T1 over a closed set without state: with n calls before it, a call can't start earlier than any earlier arrival plus the gaps since.

    scheduled(i) = gap * i + max over j <= i of (arrival(j) - gap * j), a running maximum.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("arrival_ms", "req_id")
    i = F.row_number().over(w).cast("bigint") * F.lit(min_gap_ms)  # 32 bits end at 36,000 calls a minute apart
    r = requests.withColumn("_i", i).withColumn("_m", F.col("arrival_ms") - F.col("_i"))
    top = F.max("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return r.withColumn("scheduled_ms", (top + F.col("_i")).cast("bigint")).select("source", "req_id", "arrival_ms", "scheduled_ms")


def cooled(attempts: DataFrame, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """T4: (engine, at_ms, req_id, outcome): after a failed start, attempts within the cool-down fail at once, without a start.

    attempts: (engine, at_ms, req_id, ok). outcome: 'started', 'failed' or 'cooling'. The state is the last failure.
    """

    def run(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed = state.get[0] if state.exists else None
        pdf = pd.concat(frames).sort_values(["at_ms", "req_id"], kind="stable")
        out = []
        for at, ok in zip(pdf["at_ms"].tolist(), pdf["ok"].tolist()):
            if failed is not None and at - failed < cooldown_ms:
                out.append("cooling")
            else:
                failed = None if ok else at
                out.append("started" if ok else "failed")
        state.update((failed,))
        yield pdf.assign(outcome=out)[["engine", "at_ms", "req_id", "outcome"]]

    return attempts.groupBy("engine").applyInPandasWithState(run, "engine string, at_ms bigint, req_id bigint, outcome string", "failed bigint", "append", GroupStateTimeout.NoTimeout)


class RegistryStream:
    """Requests verified batch by batch against a registry that lives in files.

    `folder` holds documents/base=N, the whole registry after batch N, found/batch=N, what batch N found live, and
    log/batch=N, the log rows of its requests. A batch sees the newest base before it and what the batches since then found,
    and writes only its own folders: repeated after a failure it sees and writes the same. A new stream on a folder goes on
    with what is there. Every COMPACT batches a new base is written.
    """

    COMPACT = 50

    def __init__(self, documents: DataFrame, live: DataFrame, folder: str) -> None:
        self.live, self.folder, self.spark = live, folder, documents.sparkSession
        if not self._numbers("documents", "base"):
            documents.write.mode("overwrite").parquet(f"{folder}/documents/base=-1")

    def _numbers(self, table: str, name: str) -> list[int]:
        """The numbers of the finished folders table/name=N."""
        root = f"{self.folder}/{table}"
        return sorted(int(x.removeprefix(f"{name}=")) for x in children(self.spark, root) if x.startswith(f"{name}=") and "_SUCCESS" in children(self.spark, f"{root}/{x}"))

    def documents(self, before: int | None = None) -> DataFrame:
        """The registry as batch `before` sees it; without a number as it is."""
        seen = lambda n: before is None or n < before
        base = max(n for n in self._numbers("documents", "base") if seen(n))
        rows = self.spark.read.parquet(f"{self.folder}/documents/base={base}")
        later = [f"{self.folder}/found/batch={n}" for n in self._numbers("found", "batch") if n > base and seen(n)]
        return merge_batch(rows, self.spark.read.parquet(*later), [F.col("at")], live=True) if later else rows

    def __call__(self, batch: DataFrame, number: int) -> None:
        log = f"{self.folder}/log/batch={number}"
        backfill(batch, self.documents(number), self.live).write.mode("overwrite").parquet(log)
        found = self.spark.read.parquet(log).filter("outcome = 'iis_hit'").select(F.col("resolved_iis_no").alias("iis_no"), F.col("ts").alias("at")).groupBy("iis_no").agg(F.min("at").alias("at"))
        rows = found.join(self.live.dropDuplicates(["iis_no"]), "iis_no").select("iis_no", "at", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ATTRIBUTES])
        rows.write.mode("overwrite").parquet(f"{self.folder}/found/batch={number}")
        if number - max(n for n in self._numbers("documents", "base") if n < number) >= self.COMPACT:
            self.documents(number + 1).write.mode("overwrite").parquet(f"{self.folder}/documents/base={number}")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log")


def frame_payloads(frames: DataFrame) -> DataFrame:
    """Frames (image_id, width, height, gray) of a camera as a stream of the payloads that they show."""
    return decode_images(frames, deal=False).filter("payload IS NOT NULL")
