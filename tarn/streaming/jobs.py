"""Jobs around a stream: retries of what fails in passing, and a reconciliation that comes round."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarn.operators.reconcile import orphans, stale_notes


@dataclass
class Retry:
    """So many tries with waits that double, for errors that ``transient`` takes; others, and the last one, come through."""

    tries: int = 5
    wait: float = 1.0
    most_wait: float = 60.0
    transient: Callable[[Exception], bool] = lambda e: isinstance(e, ConnectionError | TimeoutError | OSError)

    def __call__(self, job: Callable, *args, sleep: Callable[[float], None] = time.sleep):
        for n in range(self.tries):
            try:
                return job(*args)
            except Exception as e:
                if n + 1 == self.tries or not self.transient(e):
                    raise
                sleep(min(self.most_wait, self.wait * 2**n))


def retried_batches(apply: Callable[[DataFrame, int], None], retry: Retry) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch is tried again as a whole, so ``apply`` must be safe to repeat."""
    return lambda batch, n: retry(apply, batch, n)


def reconcile_every(spark: SparkSession, checkpoint: str, seconds: int, notes: Callable[[], DataFrame], documents: Callable[[], DataFrame], keys: list[str], text: str, act: Callable[[DataFrame, DataFrame], None], limit: int | None = 200):
    """A stream whose clock calls ``act(stale notes, orphaned documents)`` every so many seconds, with the tables as they are then; the caller stops it."""

    def tick(_: DataFrame, n: int) -> None:
        act(stale_notes(notes(), documents(), keys, limit), orphans(documents(), notes(), keys, text))

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
