"""Container logs and metric text as sources, and a label-partitioned log sink."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import service_of

LINE = "log string, stream string, time string"


def parsed(lines: DataFrame, column: str = "value", tag: str | None = None) -> DataFrame:
    """Container log lines (JSON with log, stream, time): ts, nanoseconds, stream, service, the inner JSON's level and event, and the raw body. Broken lines keep their body."""
    outer = lines.withColumn("_o", F.from_json(F.col(column), LINE))
    body = F.coalesce(F.col("_o.log"), F.col(column))
    ts = F.to_timestamp(F.col("_o.time"))
    return outer.select(
        ts.alias("ts"),
        (F.unix_micros(ts) * 1000).alias("nanos"),
        F.col("_o.stream").alias("stream"),
        (service_of(F.col(tag)) if tag else F.lit("other")).alias("service"),
        F.get_json_object(body, "$.level").alias("level"),
        F.get_json_object(body, "$.event").alias("event"),
        F.get_json_object(body, "$.trace_id").alias("trace_id"),
        body.alias("body"),
    )


def tail(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the files below ``path`` as a stream; the query's checkpoint holds the offsets. The file's path is the tag."""
    return spark.readStream.text(path).select("value", F.input_file_name().alias("tag"))


def push(stream: DataFrame, path: str, checkpoint: str):
    """Appends to ``path`` by service, what is available now; the sink's log makes a repeated batch count once."""
    return stream.writeStream.partitionBy("service").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_payloads(entries: DataFrame, labels: list[str], most: int = 200) -> DataFrame:
    """(payload, entries): the bodies of requests to a log server, each with at most ``most`` entries of one set of labels.

    ``entries`` has nanos, body and the labels. A task packs its own rows as they come, holding ``most`` of each set of
    labels; nothing is shuffled.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def request(key: tuple) -> dict:
            values = held.pop(key)
            return {"payload": json.dumps({"streams": [{"stream": dict(zip(labels, key, strict=True)), "values": values}]}, ensure_ascii=False), "entries": len(values)}

        for b in batches:
            full = []
            for nanos, body, *key in zip(b["nanos"], b["body"], *(b[c] for c in labels), strict=True):
                values = held.setdefault(tuple(key), [])
                values.append([str(nanos), body])
                if len(values) == most:
                    full.append(request(tuple(key)))
            if full:
                yield pd.DataFrame(full)
        if held:
            yield pd.DataFrame([request(key) for key in list(held)])

    return entries.select("nanos", "body", *labels).mapInPandas(pack, "payload string, entries long")


def metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """Samples of a metrics page: name, labels and value; comments and broken lines are left out."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+([-+0-9.eE]+|NaN|[-+]?Inf)"
    pairs = F.regexp_extract_all(F.regexp_extract(column, pattern, 2), F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="([^"]*)"'), 0)
    split = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, '"(.*)"', 1).alias("v")))
    rows = lines.where(F.rlike(column, F.lit(pattern)))
    return rows.select(F.regexp_extract(column, pattern, 1).alias("name"), F.map_from_entries(split).alias("labels"), F.regexp_extract(column, pattern, 3).try_cast("double").alias("value"))


def sse(event: str, data: str) -> Column:
    """A server-sent event frame of an event column and a JSON text column."""
    return F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.col(data), F.lit("\n\n"))
