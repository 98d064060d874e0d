"""Drift as a stream: snapshots arrive as files, and each key keeps its own state.

Sightings wait for the watermark in an aggregation by key and time: late ones
find their place, repeated ones are one, and each is given once, when the
watermark has passed it.  A key's state is its last sighting, so a batch touches
the keys that it gives sightings of and those whose time has come, never the
history, and a batch that is run again starts from the state before it.  A key
that was not seen for ``keep`` is removed, and so is its state.

Every use of a state is a message to another process and back: a key costs four
of them a batch at most, however many sightings of it the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SNAPSHOT = "repo string, section string, key string, payload string, at timestamp"
CHANGES = "repo string, section string, key string, at timestamp, status string, payload string"
#: a row for each key and batch is cheaper than one for each change
_FOUND = "repo string, section string, key string, found array<struct<ms: bigint, status: string, payload: string>>"
_KEY = ["repo", "section", "key"]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyDrift(StatefulProcessor):
    """The state of one key, and the changes that it gives.  Times are
    milliseconds; rows of a batch are newer than those of batches before it, and
    have a time of their own."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = round(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: the last sighting
        self.last = handle.getValueState("last", "at long, payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = last = self.last.get()
        found = []
        for now, payload in sorted(((row["ms"], row["payload"]) for row in rows), key=lambda x: x[0]):
            if last is not None and last[0] + self.keep < now:
                found.append((last[0] + self.keep, "removed", last[1]))
                last = None
            if last is None:
                found.append((now, "added", payload))
            elif last[1] != payload:
                found.append((now, "changed", payload))
            last = (now, payload)
        if before is not None:
            self.handle.deleteTimer(self._end(before))
        if self._end(last) <= timerValues.getCurrentWatermarkInMs():
            # the end has passed already
            found.append((last[0] + self.keep, "removed", last[1]))
            if before is not None:
                self.last.clear()
        else:
            self.last.update(last)
            self.handle.registerTimer(self._end(last))
        if found:
            yield self._given(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()
        if last is not None and self._end(last) == expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield self._given(key, [(last[0] + self.keep, "removed", last[1])])

    def close(self) -> None:
        pass

    def _end(self, last: tuple) -> int:
        # one past it, as a sighting at the very end still counts as seen
        return last[0] + self.keep + 1

    @staticmethod
    def _given(key: tuple, found: list[tuple[int, str, str | None]]) -> Row:
        return Row(repo=key[0], section=key[1], key=key[2], found=found)


def changes(snapshots: DataFrame, keep: timedelta, late: str = "0 seconds") -> DataFrame:
    """``CHANGES`` of a stream of ``SNAPSHOT`` rows, as
    ``operators.drift.key_changes`` gives them for a table.  Sightings that are up
    to ``late`` behind the newest are put in order; later ones are dropped.
    Times are kept to the millisecond.  Rows without a time or a key are none.
    The sightings of one key that a batch gives are put in order in memory."""
    at = F.timestamp_millis(F.rint(F.unix_micros("at") / 1000).cast("long"))
    rows = snapshots.where("at IS NOT NULL AND key IS NOT NULL").withColumn("at", at).withWatermark("at", late)
    once = rows.groupBy(*_KEY, "at").agg(F.max("payload").alias("payload"))
    # numbers are cheaper than times for Python
    given = once.select(*_KEY, F.unix_millis("at").alias("ms"), "payload")
    out = given.groupBy(*_KEY).transformWithState(KeyDrift(keep), _FOUND, "Append", "EventTime")
    return out.select(*_KEY, F.inline("found")).select(*_KEY, F.timestamp_millis("ms").alias("at"), "status", "payload")


def follow(spark: SparkSession, arrivals: str, out: str, checkpoint: str, keep: timedelta, late: str = "0 seconds") -> StreamingQuery:
    """Write the changes of arriving snapshots to ``out``.  Takes all that is
    there, then ends (``availableNow``); started again it goes on from its state.
    The file sink commits by batch, so no change is written twice."""
    if spark.conf.get(_STORE, None) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)  # the state of keys needs column families
    stream = spark.readStream.schema(SNAPSHOT).parquet(arrivals)
    return changes(stream, keep, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
