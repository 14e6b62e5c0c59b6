"""Pushes, scrapes and queues against local servers."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tarn.sources import logs, remote


class Server:
    """A log server, a metrics page and a queue. ``fail`` requests are answered with an error first; a slow one takes ``delay``."""

    def __init__(self):
        self.pushed, self.fail, self.delay, self.page = [], 0, 0.0, "hits 3\n"
        self.items, self.acknowledged, self.lock = {}, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def answer(self, body=b"", code=200):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                at = urllib.parse.urlparse(self.path)
                asked = dict(urllib.parse.parse_qsl(at.query))
                if at.path == "/metrics":
                    return self.answer(outer.page.encode())
                if at.path == "/q/state":
                    return self.answer(json.dumps({"acknowledged": outer.acknowledged, "last": max(outer.items, default=outer.acknowledged)}).encode())
                if at.path == "/q/items":
                    found = [{"id": i, "payload": p} for i, p in sorted(outer.items.items()) if int(asked["first"]) <= i <= int(asked["last"])]
                    return self.answer(json.dumps({"items": found}).encode())
                return self.answer(code=404)

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    if self.path == "/q/acknowledge":
                        outer.acknowledged = max(outer.acknowledged, body["id"])
                        outer.items = {i: p for i, p in outer.items.items() if i > outer.acknowledged}
                        return self.answer()
                    if outer.fail:
                        outer.fail -= 1
                        return self.answer(code=503)
                    outer.pushed.append(body)
                time.sleep(outer.delay)
                return self.answer()

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture()
def server(spark):
    remote.register(spark)
    s = Server()
    yield s
    s.http.shutdown()


def test_entries_come_once_in_bounded_requests(spark, tmp_path, server):
    server.fail = 2
    schema = "nanos long, body string, service string"
    rows = [(i, f"line {i}", "a" if i % 3 else "b") for i in range(1000)] + [(None, None, None)]
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    options = {"url": f"{server.url}/push", "labels": "service", "wait": "0.01", "report": f"file://{tmp_path}/report", "checkpointLocation": str(tmp_path / "ck")}
    for _ in range(2):  # the second run has nothing new
        stream.writeStream.format("log_push").options(**options).trigger(availableNow=True).start().awaitTermination()
    got = [(s["stream"]["service"], n, b) for p in server.pushed for s in p["streams"] for n, b in s["values"]]
    assert sorted((b, s) for s, _, b in got) == sorted((b or "", s or "") for _, b, s in rows)
    assert all(len(s["values"]) <= 200 for p in server.pushed for s in p["streams"]) and len({n for _, n, b in got if b}) == 1000
    counts = json.loads((tmp_path / "report" / "0.json").read_text())
    assert (counts["sent"], counts["dropped"], counts["failed"]) == (1001, 0, 0) and counts["requests"] == len(server.pushed)


def test_a_full_queue_and_a_dead_server_are_counted(server):
    server.delay = 0.3
    pusher = remote.Pusher(f"{server.url}/push", ["service"], most=5, room=10, patience=0)
    for i in range(200):
        pusher.put(("a",), str(i), "x")
    done = pusher.close()
    assert done.dropped > 0 and done.sent + done.dropped == 200 and done.sent == sum(len(s["values"]) for p in server.pushed for s in p["streams"])
    server.fail = 1000
    pusher = remote.Pusher(f"{server.url}/push", ["service"], tries=2, wait=0.01)
    pusher.put(("a",), "1", "x")
    assert pusher.close() == remote.Pushed(0, 0, 1, 0)


def test_scrapes_come_round(spark, tmp_path, server):
    stream = spark.readStream.format("metrics_scrape").option("urls", f"{server.url}/metrics, http://127.0.0.1:9/none").option("every", "1").option("timeout", "2").load()
    rows = logs.metrics(stream, "value").select(F.col("name"), F.col("value"))
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    end = time.time() + 60
    seen = []
    while time.time() < end and seen.count("hits") < 3:
        time.sleep(1)
        server.page = "hits 4\n"
        seen = [r["name"] for r in spark.read.schema("name string, value double").parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []
    query.stop()
    got = [(r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {("up", 1.0), ("up", 0.0), ("hits", 4.0)} <= set(got)
    assert sum(n == "up" for n, _ in got) == sum(n == "scrape_duration_seconds" for n, _ in got) >= 6


def test_a_queue_loses_nothing_over_restarts(spark, tmp_path, server):
    server.items = {i: {"note": i} for i in range(1, 26)}
    read = lambda: spark.readStream.format("task_queue").option("url", f"{server.url}/q").option("items", "10").option("wait", "0.01").load()
    taken = []

    def run(apply):
        read().writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination()

    def breaks(batch, n):
        raise RuntimeError("worker lost")

    with pytest.raises(Exception, match="worker lost"):
        run(breaks)
    assert server.acknowledged == 0 and len(server.items) == 25  # nothing was done, so nothing is acknowledged
    run(lambda b, n: taken.extend((r["id"], json.loads(r["payload"])["note"]) for r in b.collect()))
    server.items |= {i: {"note": i} for i in range(26, 31)}
    run(lambda b, n: taken.extend((r["id"], json.loads(r["payload"])["note"]) for r in b.collect()))
    run(lambda b, n: taken.extend((r["id"], json.loads(r["payload"])["note"]) for r in b.collect()))
    assert sorted(taken) == [(i, i) for i in range(1, 31)]
    assert server.acknowledged >= 25  # the last batch is acknowledged when the next one is planned
