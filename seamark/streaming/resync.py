"""Periodic re-sync: a clock stream whose micro-batches each ask for one sync.

A stream of files would remember paths and so miss edited and deleted files; a sync itself compares times and sizes
with the last snapshot, and costs little where nothing changed.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class SingleFlight:
    """Runs one call at a time: a periodic call is skipped while another runs, an explicit one waits."""

    def __init__(self, work: Callable[[], object]) -> None:
        self._work, self._gate = work, threading.Lock()

    def run(self, wait: bool = False):
        if not self._gate.acquire(blocking=wait):
            return None
        try:
            return self._work()
        finally:
            self._gate.release()


def resync_on_change(spark: SparkSession, flight: SingleFlight, checkpoint: str, every: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """Run ``flight`` at once and then ``every`` so often; a turn is skipped while another sync of the same gate runs."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return clock.writeStream.foreachBatch(lambda _, __: flight.run()).option("checkpointLocation", checkpoint).trigger(**trigger).start()
