"""Feeds polled again and again, with what the last answer said about its version."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedweave.sources.fetch import MOST_AGENT, RESPONSE, Transport, fetch, over_network


class Polling(StatefulProcessor):
    """Keeps an address's validators, and a timer for its next poll.

    An answer with an etag or a date replaces them; an unchanged document (304)
    and a failure leave them as they are.
    """

    def __init__(self, transport: Transport, agent: str, timeout: float, most: int, every: float):
        self.transport, self.agent, self.timeout, self.most, self.every = transport, agent, timeout, most, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("validators", "etag string, modified string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for _ in rows:
            pass
        yield self.polled(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self.polled(key[0], timerValues)

    def polled(self, url: str, times) -> Row:
        etag, modified = self.known.get() if self.known.exists() else (None, None)
        row = fetch(url, etag, modified, self.transport, self.agent, self.timeout, self.most, {})
        if row["fetch_error"] is None and (row["etag"] or row["modified"]):
            self.known.update((row["etag"], row["modified"]))
        now = time.time() * 1000
        if self.every:
            now = times.getCurrentProcessingTimeInMs()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + int(1000 * self.every))
        headers = None if row["headers"] is None else dict(row["headers"])
        return Row(url=url, polled=datetime.fromtimestamp(now / 1000, timezone.utc), **{**row, "headers": headers})

    def close(self) -> None:
        pass


def poll(urls: DataFrame, url: str = "url", transport: Transport = over_network, every: float = 3600.0, agent: str = "feedweave/0.1", timeout: float = 30.0, most: int = 100 << 20) -> DataFrame:
    """The answers to polls of a stream's addresses: ``url``, ``polled`` and :data:`RESPONSE`.

    An address is polled when it arrives, and ``every`` so many seconds (0: only then; a stream with
    timers goes on without new rows, so it has no end), each time under the condition that it changed. Several rows of an address in a batch make one poll. A batch
    that fails is polled anew. The state needs the RocksDB store, see :func:`use_rocksdb`.
    """
    processor = Polling(transport, agent[:MOST_AGENT], min(timeout, 3600.0), most, every)
    rows = urls.select(urls[url].alias("url")).where("url is not null")
    return rows.groupBy("url").transformWithState(statefulProcessor=processor, outputStructType=f"url string, polled timestamp, {RESPONSE}", outputMode="Append", timeMode="ProcessingTime" if every else "None")


def use_rocksdb(spark) -> None:
    """State on disk, which timers and states of several values need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
