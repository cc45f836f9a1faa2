"""The same operators over streams (ST1-ST4)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daftar.operators import guard as G
from daftar.operators.quality import SCORES, accept
from daftar.sources.ledger import Ledger


def incremental_ingest(documents: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str, order: str, table: str = "points", **options):
    """ST1: a started stream that transforms each batch of documents and merges it into a table of the Ledger at `path`. A batch
    that runs again is passed over; after a lost checkpoint all come again as another source's and are merged anew. Either way a reader sees
    whole batches, and files without a key of the batch are not read."""
    ledger = Ledger(documents.sparkSession, path, **options)
    source = ledger.source_of(checkpoint)

    def merge(batch: DataFrame, number: int) -> None:
        ledger.upsert({table: (transform(batch), key, order)}, source, number)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_audit(attempts: DataFrame, context: DataFrame, path: str, checkpoint: str):
    """ST2: a started stream that verifies each batch of answers against the table of retrieved articles. Verdicts go to the table
    `verdicts` of the Ledger at `path`, one row an attempt, so neither a replay nor a lost checkpoint doubles any."""
    ledger = Ledger(attempts.sparkSession, path)
    source = ledger.source_of(checkpoint)

    def audit(batch: DataFrame, number: int) -> None:
        verdicts = G.verify(G.parsed(batch), context).drop("citations").withColumn("attempt_id", F.concat_ws("/", *G.ANSWER_KEY))
        ledger.upsert({"verdicts": (verdicts, "attempt_id", "attempt")}, source, number)

    return attempts.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RateLimit(StatefulProcessor):
    """ST3's state: the times of a key's last accepted attempts, at most `limit`. A timer clears them once the last one has left every
    window, so a key that stays away holds nothing."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        table = table.assign(_t=table["ts"].astype("datetime64[us]").astype("int64")).sort_values(["_t", "id"])
        held = deque(r[0] for r in self.held.get())
        accepted = accept(table["_t"].tolist(), held, self.limit, self.width)
        self.held.put([(t,) for t in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = (held[-1] if held else 0) + self.width
        self.handle.registerTimer(max(due // 1_000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield table.assign(accepted=accepted)[["key", "id", "ts", "accepted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_flags(requests: DataFrame, limit: int = 5, seconds: int = 600, delay: str = "10 minutes") -> DataFrame:
    """ST3: key, id, ts, accepted, by list state and event-time timers.

    Rows later than the watermark are dropped (our rule). Within a batch a key's rows are taken in time order, so a batch should hold
    what a task can sort of one key (maxFilesPerTrigger). The session needs the RocksDB state store, which is set here.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    watched = requests.withWatermark("ts", delay)
    schema = f"key string, id {dict(requests.dtypes)['id']}, ts timestamp, accepted boolean"
    return watched.groupBy("key").transformWithStateInPandas(RateLimit(limit, seconds), schema, "append", "EventTime")


def score_rates(scores: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """ST4: scores (ts, name, value) to rows of window start, name, n, rate by tumbling windows."""
    known = scores.where(F.col("name").isin(*SCORES)).withWatermark("ts", delay)
    grouped = known.groupBy(F.window("ts", window), "name").agg(F.count("*").alias("n"), F.avg("value").alias("rate"))
    return grouped.select(F.col("window.start").alias("start"), "name", "n", "rate")
