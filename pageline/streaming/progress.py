"""Live progress as keyed state: the last event of each run and page, kept in RocksDB, written exactly once into a keyed log.

Each page's state holds its last event; a batch's events change it only if they are later, and only changes are sent on. A page that is in
progress and hears nothing for a while is told as stalled by a timer. State of pages goes after a time without events (TTL): the table has
it, and an older event that comes later still loses against what stands there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from pageline.sources.log import KeyedLog

PROGRESS = "run_id bigint, page_num bigint, id bigint, stage string, stalled boolean"
_STATE = "id bigint, stage string, timer bigint"
#: Stages after which a page hears no more.
LAST = ("purchase", "error")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches between snapshots.
COMPACT = 8


class PageState(StatefulProcessor):
    """The last event of a page; ``stall_ms`` without one makes an unfinished page stalled, ``ttl_ms`` without one forgets it (0: never)."""

    def __init__(self, last: tuple[str, ...] = LAST, stall_ms: int = 0, ttl_ms: int = 0):
        self.last, self.stall_ms, self.ttl_ms = last, stall_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("last", _STATE, self.ttl_ms or None)

    def _told(self, key, event_id: int, stage: str, stalled: bool) -> Row:
        return Row(run_id=key[0], page_num=key[1], id=event_id, stage=stage, stalled=stalled)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(((r["id"], r["stage"] or "") for r in rows))
        held = self.held.get() if self.held.exists() else None
        if held is not None and (held[0], held[1]) >= best:
            return
        if held is not None and held[2]:
            self.handle.deleteTimer(held[2])
        timer = 0
        if self.stall_ms and best[1] not in self.last:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.stall_ms
            self.handle.registerTimer(timer)
        self.held.update((*best, timer))
        yield self._told(key, *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            event_id, stage, _ = self.held.get()
            self.held.update((event_id, stage, 0))
            yield self._told(key, event_id, stage, True)

    def close(self) -> None:
        pass


def changes(events: DataFrame, processor: PageState | None = None) -> DataFrame:
    """What changes in the state of pages; ``events`` is a stream of run_id, page_num, id, stage. Events without a run or page are left out."""
    processor = processor or PageState()
    known = events.select("run_id", "page_num", "id", "stage").filter("run_id is not null and page_num is not null and id is not null")
    return known.groupBy("run_id", "page_num").transformWithState(processor, PROGRESS, "Update", "ProcessingTime" if processor.stall_ms else "None")


def progress_log(spark: SparkSession, path: str) -> KeyedLog:
    # of equal ids the stalled one is the later word
    return KeyedLog(spark, path, PROGRESS, ("run_id", "page_num"), "id")


def follow(events: DataFrame, path: str, checkpoint: str, processor: PageState | None = None, batches: int | None = None):
    """Starts the query that keeps the table at ``path``. It ends when there are no more events, or after ``batches`` of them; one that
    waits for stalled pages runs until it is stopped."""
    spark = events.sparkSession
    trigger = {"processingTime": "1 second"} if processor is not None and processor.stall_ms else {"availableNow": True}
    log, seen = progress_log(spark, path), []

    def keep(rows: DataFrame, batch: int) -> None:
        log.write(rows, batch)
        if batch % COMPACT == COMPACT - 1:
            log.compact()
        seen.append(batch)
        if batches is not None and len(seen) > batches:
            raise InterruptedError("stopped between batches")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        return changes(events, processor).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
