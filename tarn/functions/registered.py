"""Stages under names that SQL can call: scalar functions, and a table function that cuts a text into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarn.functions import python_tier as P
from tarn.functions.chunk_rules import type_of


class Chunks:
    """``SELECT d.doc_id, c.* FROM docs d, LATERAL text_chunks(d.text, 200) c``: place, kind and text of each window of whole sentences."""

    def eval(self, text: str, size: int):
        for place, part in enumerate(P._windows(size, 0)(text)):
            yield place, type_of(part), part


def batched(f: Callable, kind: str):
    """A function for SQL over Arrow batches; nulls come as None."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([f(None if pd.isna(x) else x) for x in s], dtype=object)

    return F.pandas_udf(run, kind)


def register(spark: SparkSession) -> list[str]:
    """Registers the stages for SQL and tells their names."""
    spark.udtf.register("text_chunks", udtf(Chunks, returnType="place int, chunk_type string, text string"))
    named = {"chunk_type": (type_of, "string"), "table_lines": (P._table_lines, "string"), "tool_payload": (P._tool_payload, "string"), "editor_text": (P._tree_text, "string"), "nfkc": (P._nfkc, "string"), "actionability": (P._actionability, "double")}
    for name, (f, kind) in named.items():
        spark.udf.register(name, batched(f, kind))
    return ["text_chunks", *named]
