"""Data sources beyond files: a sink that pushes log entries, a scrape that comes round, and a queue that is acknowledged.

``register(spark)`` makes them known as ``log_push``, ``metrics_scrape`` and ``task_queue``.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage


def register(spark: SparkSession) -> None:
    for source in (LogPush, MetricsScrape, TaskQueue):
        spark.dataSource.register(source)


def _send(url: str, body: bytes | None, seconds: float) -> bytes:
    headers = {"Content-Type": "application/json"} if body is not None else {}
    with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="GET" if body is None else "POST"), timeout=seconds) as answer:
        return answer.read()


def _tried(url: str, body: bytes | None, seconds: float, tries: int, wait: float) -> bytes:
    """The answer, after so many tries with waits that double; the last error comes through."""
    for n in range(tries):
        try:
            return _send(url, body, seconds)
        except OSError:  # refused, timed out, or an error status
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("tries must be at least 1")


# -- push --------------------------------------------------------------------------------------------------------


@dataclass
class Pushed(WriterCommitMessage):
    """Entries that a task sent, those for which the queue had no room, and those of requests that failed."""

    sent: int = 0
    dropped: int = 0
    failed: int = 0
    requests: int = 0

    def __add__(self, other: Pushed) -> Pushed:
        return Pushed(self.sent + other.sent, self.dropped + other.dropped, self.failed + other.failed, self.requests + other.requests)


class Pusher:
    """A bounded queue of entries and a thread that empties it in requests of at most ``most`` entries of one set of labels.

    ``put`` waits ``patience`` seconds for room and then counts the entry as dropped, so a slow server never holds more
    than ``room`` entries here, nor its sender for good.
    """

    def __init__(self, url: str, labels: list[str], most: int = 200, room: int = 10_000, patience: float = 30.0, tries: int = 3, wait: float = 0.5, seconds: float = 5.0):
        self.url, self.labels, self.most, self.patience, self.tries, self.wait, self.seconds = url, labels, most, patience, tries, wait, seconds
        self.room: queue.Queue = queue.Queue(room)
        self.counts = Pushed()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def put(self, key: tuple, nanos: str, line: str) -> None:
        try:
            self.room.put((key, nanos, line), block=self.patience > 0, timeout=self.patience or None)
        except queue.Full:
            self.counts.dropped += 1

    def close(self) -> Pushed:
        self.room.put(None)
        self.thread.join()
        return self.counts

    def _run(self) -> None:
        held: dict[tuple, list] = {}
        done = False
        while not done:
            try:
                item = self.room.get(timeout=2.0)
            except queue.Empty:
                item = ()
            done = item is None
            if item:
                held.setdefault(item[0], []).append([item[1], item[2]])
                if len(held[item[0]]) >= self.most:
                    self._post(item[0], held.pop(item[0]))
            if not item:  # the end, or nothing for a while
                for key in list(held):
                    self._post(key, held.pop(key))

    def _post(self, key: tuple, values: list) -> None:
        body = json.dumps({"streams": [{"stream": dict(zip(self.labels, key, strict=True)), "values": values}]}, ensure_ascii=False).encode("utf-8", "replace")
        try:
            _tried(self.url, body, self.seconds, self.tries, self.wait)
            self.counts.sent += len(values)
            self.counts.requests += 1
        except OSError:
            self.counts.failed += len(values)


class LogPushWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pushed:
        o = self.options
        labels = [x.strip() for x in o.get("labels", "service").split(",") if x.strip()]
        pusher = Pusher(o["url"], labels, int(o.get("most", "200")), int(o.get("room", "10000")), float(o.get("patience", "30")), int(o.get("tries", "3")), float(o.get("wait", "0.5")))
        at = [self.names.index(c) for c in ("nanos", "body", *labels)]
        for batch in iterator:
            for nanos, body, *key in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                pusher.put(tuple("" if k is None else str(k) for k in key), str(nanos if nanos is not None else time.time_ns()), body or "")
        return pusher.close()

    def commit(self, messages: list[Pushed | None], batchId: int) -> None:
        """The batch's counts as ``<report>/<batch>.json``, if a folder is named; a batch that is replayed writes the same file."""
        total = sum((m for m in messages if m is not None), Pushed())
        if self.options.get("report"):
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.options["report"])
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{batchId}.json") as f:
                f.write(json.dumps({"batch": batchId, "sent": total.sent, "dropped": total.dropped, "failed": total.failed, "requests": total.requests}).encode())

    def abort(self, messages: list[Pushed | None], batchId: int) -> None:
        pass


class LogPush(DataSource):
    """A streaming sink of entries (``nanos``, ``body`` and the labels' columns) to a log server's push endpoint.

    Options: ``url``; ``labels`` (names of columns, by commas); ``most`` entries a request (200); ``room`` in a task's queue
    (10,000) and the ``patience`` in seconds that an entry waits for it; ``tries`` and first ``wait`` of a request; ``report``,
    a folder for the counts of each batch. A task that is run again sends again: an entry comes at least once or is counted.
    """

    @classmethod
    def name(cls) -> str:
        return "log_push"

    def streamWriter(self, schema, overwrite: bool) -> LogPushWriter:
        return LogPushWriter(dict(self.options), schema.fieldNames())


# -- scrape ------------------------------------------------------------------------------------------------------


@dataclass
class Target(InputPartition):
    url: str
    tick: int


class ScrapeReader(DataSourceStreamReader):
    """An offset is a number of intervals since the epoch. A batch reads each target once, as of its last interval."""

    def __init__(self, options: dict[str, str]):
        self.urls = [u.strip() for u in options["urls"].split(",") if u.strip()]
        self.every, self.seconds = float(options.get("every", "15")), float(options.get("timeout", "10"))

    def initialOffset(self) -> dict:
        return {"tick": int(time.time() // self.every) - 1}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[Target]:
        return [Target(u, end["tick"]) for u in self.urls] if end["tick"] > start["tick"] else []

    def read(self, partition: Target) -> Iterator[tuple]:
        began, scraped = time.time(), int(partition.tick * self.every)
        try:
            lines, up = _send(partition.url, None, self.seconds).decode("utf-8", "replace").splitlines(), 1
        except OSError:
            lines, up = [], 0
        for line in (*lines, f"up {up}", f"scrape_duration_seconds {time.time() - began:.6f}"):
            yield partition.url, scraped, line

    def commit(self, end: dict) -> None:
        pass


class MetricsScrape(DataSource):
    """Lines of the metrics pages of targets as a stream: (target, scraped, value), for ``sources.logs.metrics``.

    Options: ``urls`` (by commas), ``every`` seconds (15), ``timeout``. Each target is a partition. ``up`` and the scrape's
    duration are added; a target that does not answer has these alone. Intervals that no batch covered have no samples, as
    a page only tells of the present; a batch that is replayed reads the page again.
    """

    @classmethod
    def name(cls) -> str:
        return "metrics_scrape"

    def schema(self) -> str:
        return "target string, scraped long, value string"

    def streamReader(self, schema) -> ScrapeReader:
        return ScrapeReader(dict(self.options))


# -- queue -------------------------------------------------------------------------------------------------------


@dataclass
class Span(InputPartition):
    first: int
    last: int


@dataclass
class QueueReader(DataSourceStreamReader):
    """Items have ascending ids. Offsets are the last id that is taken; what is committed is acknowledged, and only that may go."""

    options: dict[str, str] = field(default_factory=dict)

    def _ask(self, path: str, body: dict | None = None, **query) -> dict:
        o = self.options
        url = f"{o['url'].rstrip('/')}/{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        return json.loads(_tried(url, None if body is None else json.dumps(body).encode(), float(o.get("timeout", "10")), int(o.get("tries", "3")), float(o.get("wait", "0.5"))) or b"{}")

    def initialOffset(self) -> dict:
        return {"id": int(self._ask("state")["acknowledged"])}

    def latestOffset(self) -> dict:
        return {"id": int(self._ask("state")["last"])}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        size = int(self.options.get("items", "1000"))
        return [Span(a, min(a + size - 1, end["id"])) for a in range(start["id"] + 1, end["id"] + 1, size)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for item in self._ask("items", first=partition.first, last=partition.last)["items"]:
            yield int(item["id"]), json.dumps(item["payload"], ensure_ascii=False)

    def commit(self, end: dict) -> None:
        """Safe to repeat: the server keeps the highest id that it was told."""
        self._ask("acknowledge", {"id": end["id"], "by": uuid.uuid4().hex})


class TaskQueue(DataSource):
    """Items of a queue server as a stream: (id, payload as JSON).

    The server answers ``GET state`` with ``acknowledged`` and ``last`` ids and ``GET items?first=&last=`` with ``items`` (id,
    payload), and takes ``POST acknowledge`` with an ``id``: items up to it are done. It must keep all others, so that a
    query that starts again from its checkpoint, or anew, finds what was not committed. Options: ``url``, ``items`` a
    partition (1,000), ``timeout``, ``tries``, ``wait``.
    """

    @classmethod
    def name(cls) -> str:
        return "task_queue"

    def schema(self) -> str:
        return "id long, payload string"

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(dict(self.options))
