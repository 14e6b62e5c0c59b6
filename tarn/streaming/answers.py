"""Streams of an answer: deltas, usage and ends of messages, in any order, joined to one row a message.

The items of a message are numbered from 0 (``seq``). Its kinds are ``start`` (with the prompt's estimated tokens),
``delta`` (text), ``usage`` (reported token numbers), ``error`` and ``end``. What comes behind an error or end is not
looked at. A message is complete or failed when everything up to its end or error is there; when it falls silent before
that it is closed as partial with what has come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
#: Columns of an item, and of an answer.
ITEM = "message_id string, seq int, kind string, content string, prompt_tokens long, completion_tokens long, total_tokens long, at timestamp"
ANSWER = "message_id string, text string, status string, error string, deltas int, first_token_ms long, latency_ms long, prompt_tokens long, completion_tokens long, total_tokens long"
_KEPT = [x.split()[0] for x in ITEM.split(", ")][1:]

Counter = Callable[[str], int]


def words(text: str) -> int:
    return len(text.split())


def answer_of(message: str, items: pd.DataFrame, count: Counter, silent: bool) -> tuple | None:
    """The answer of a message's items, or None while it is open; ``silent`` closes it as it is."""
    rows = items.drop_duplicates("seq").sort_values("seq")
    ends = rows[rows["kind"].isin(("end", "error"))]
    last = None if ends.empty else ends.iloc[0]
    if last is not None:
        rows = rows[rows["seq"] <= last["seq"]]
    whole = last is not None and len(rows) == int(last["seq"]) + 1
    if not whole and not silent:
        return None
    deltas = rows[(rows["kind"] == "delta") & rows["content"].notna() & (rows["content"] != "")]
    text = "".join(deltas["content"])
    began = rows["at"].min()
    ms = lambda t: (t.floor("ms") - began.floor("ms")) // pd.Timedelta(1, "ms")
    told = {u: _latest(rows[rows["kind"].isin(("start", "usage"))], u) for u in USAGE}
    reported = bool((rows["kind"] == "usage").any())
    prompt = told["prompt_tokens"] or 0
    completion = told["completion_tokens"] or (count(text) if text else 0)
    total = told["total_tokens"] if reported and told["total_tokens"] else prompt + completion
    status = "partial" if not whole else "failed" if last["kind"] == "error" else "complete"
    error = None if status != "failed" else _text(last["content"]) or "unknown error"
    return (message, text, status, error, len(deltas), ms(deltas["at"].min()) if len(deltas) else None, ms(rows["at"].max()), prompt, completion, total)


def _plain(value):
    """A cell as the state takes it: numbers beside nulls come as fractions."""
    return None if pd.isna(value) else int(value) if isinstance(value, float) else value


def _text(value) -> str | None:
    return None if pd.isna(value) else value


def _latest(rows: pd.DataFrame, column: str) -> int | None:
    told = rows[column].dropna()
    return None if told.empty else int(told.iloc[-1])


class Answers(StatefulProcessor):
    """Per message its items (a list that only grows), whether it is closed, and a timer that ends its silence.

    A closed message's mark stays for as long again, so that items that come late or twice open no second answer.
    """

    def __init__(self, silence_ms: int, count: Counter = words):
        self.silence_ms, self.count = silence_ms, count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", ", ".join(x for x in ITEM.split(", ")[1:]))
        self.mark = handle.getValueState("mark", "closed boolean, timer long")

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_KEPT)

    def _wait(self, until: int, closed: bool) -> None:
        if self.mark.exists():
            self.handle.deleteTimer(self.mark.get()[1])
        self.handle.registerTimer(until)
        self.mark.update((closed, until))

    def _out(self, answer: tuple) -> pd.DataFrame:
        return pd.DataFrame([answer], columns=[x.split()[0] for x in ANSWER.split(", ")]).astype({"first_token_ms": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[_KEPT]
        latest = int(new["at"].max().timestamp() * 1000)
        if self.mark.exists() and self.mark.get()[0]:
            return
        self.items.appendList([tuple(map(_plain, r)) for r in new.astype(object).itertuples(index=False)])
        every = self._frame(list(self.items.get()))
        answer = answer_of(key[0], every, self.count, silent=False)
        if answer is not None:
            self.items.clear()
            self._wait(latest + self.silence_ms, True)
            yield self._out(answer)
        else:
            before = self.mark.get()[1] if self.mark.exists() else 0
            self._wait(max(before, latest + self.silence_ms), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_ = self.mark.exists() and not self.mark.get()[0]
        every = self._frame(list(self.items.get())) if open_ else None
        self.items.clear()
        if open_ and len(every):
            until = expiredTimerInfo.getExpiryTimeInMs() + self.silence_ms
            self.mark.clear()
            self._wait(until, True)
            yield self._out(answer_of(key[0], every, self.count, silent=True))
        else:
            self.mark.clear()

    def close(self) -> None:
        pass


def answer_stream(items: DataFrame, silence_seconds: int = 30, count: Counter = words) -> DataFrame:
    """Answers of a stream of items (columns of ``ITEM``), in append mode, each once: at its end, or when it has been silent for so long in event time.

    The session's state store must be RocksDB (``rocksdb_state``). Items that are later than the silence are dropped by the
    watermark. State is that of open messages, and a mark of closed ones for as long again.
    """
    timed = items.select(*[x.split()[0] for x in ITEM.split(", ")]).withWatermark("at", f"{silence_seconds} seconds")
    return timed.groupBy("message_id").transformWithStateInPandas(Answers(silence_seconds * 1000, count), ANSWER, "append", "eventTime")


def answers(items: DataFrame, count: Column | None = None) -> DataFrame:
    """The same of a table of items, when nothing more will come, in built-in expressions.

    ``count`` counts the tokens of the column ``text``; by default words. One message's items are gathered in a row.
    """
    rows = items.groupBy("message_id", "seq").agg(F.min(F.struct("at", "kind", "content", *USAGE)).alias("x")).select("message_id", "seq", "x.*")
    gathered = rows.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "content", *USAGE, "at"))).alias("all"))
    last = F.get(F.filter("all", lambda x: x["kind"].isin("end", "error")), F.lit(0))
    cut = gathered.withColumn("last", last).withColumn("rows", F.when(F.col("last").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: x["seq"] <= F.col("last.seq"))))
    whole = F.coalesce(F.size("rows") == F.col("last.seq") + 1, F.lit(False))
    deltas = F.filter("rows", lambda x: (x["kind"] == "delta") & (F.coalesce(x["content"], F.lit("")) != ""))

    def told(u: str) -> Column:
        numbers = F.filter(F.transform(F.filter("rows", lambda x: x["kind"].isin("start", "usage")), lambda x: x[u]), lambda n: n.isNotNull())
        return F.get(F.reverse(numbers), F.lit(0))

    parts = cut.select("message_id", "rows", "last", whole.alias("whole"), deltas.alias("deltas"), *[told(u).alias(u) for u in USAGE], F.array_min(F.transform("rows", lambda x: x["at"])).alias("began"), F.array_max(F.transform("rows", lambda x: x["at"])).alias("ended"))
    text = F.array_join(F.transform("deltas", lambda x: x["content"]), "")
    worded = parts.withColumn("text", text).withColumn("first_at", F.array_min(F.transform("deltas", lambda x: x["at"])))
    counted = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long") if count is None else count
    status = F.when(~F.col("whole"), "partial").when(F.col("last.kind") == "error", "failed").otherwise("complete")
    ms = lambda c: (F.unix_millis(c) - F.unix_millis("began")).cast("long")
    prompt = F.coalesce("prompt_tokens", F.lit(0).cast("long"))
    completion = F.when(F.coalesce("completion_tokens", F.lit(0)) > 0, F.col("completion_tokens")).when(F.col("text") != "", counted).otherwise(F.lit(0).cast("long"))
    reported = F.exists("rows", lambda x: x["kind"] == "usage") & (F.coalesce("total_tokens", F.lit(0)) > 0)
    return worded.select(
        "message_id", "text", status.alias("status"),
        F.when(status == "failed", F.when(F.coalesce("last.content", F.lit("")) == "", "unknown error").otherwise(F.col("last.content"))).alias("error"),
        F.size("deltas").alias("deltas"), F.when(F.col("first_at").isNotNull(), ms("first_at")).alias("first_token_ms"), ms("ended").alias("latency_ms"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.when(reported, F.col("total_tokens")).otherwise(prompt + completion).alias("total_tokens"),
    )
