"""Fill-in-middle transformation by block rotation in place.

A text's bytes stand in a bytearray. Its lines are scanned for the two cuts, sentinels go in before the prefix, the
middle and the suffix, and one rotation (three reversals) exchanges neighbouring segments. The inverse finds the
sentinels, rotates back and takes them out, which gives the text again byte for byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tarn.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_LINE_END = re.compile(rb"\n")


@dataclass(frozen=True)
class Plan:
    """Where a text is cut and how its segments stand: percentages of texts that are transformed, and of those that take the suffix first."""

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four unsigned 32-bit numbers that follow from the id alone; a null id counts as an empty one."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def line_starts(text: bytes) -> list[int]:
    """The starts of all lines, then the text's length: a line ends with its line end, the last one perhaps without."""
    ends = [m.end() for m in _LINE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [0, *ends] if text else [0]


def characters(text: bytes | bytearray | memoryview) -> int:
    """Code points of UTF-8 bytes: those that begin one."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges buffer[start:cut] with buffer[cut:end]: each is reversed, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        view[a:b] = view[a:b][::-1]


def transformed(text: bytes, doc_id: int | None, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, prefix characters, middle characters, output)."""
    starts = line_starts(text)
    n = len(starts) - 1
    h1, h2, h3, h4 = plan.draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plan.rate:
        return n, PLAIN, None, None, text
    first, second = sorted((starts[h1 % (n + 1)], starts[h2 % (n + 1)]))
    sizes = characters(text[:first]), characters(text[first:second])
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    form = SPM if h4 % 100 < plan.spm_rate else PSM
    rotate(buffer, 0 if form == SPM else middle, suffix, len(buffer))
    return n, form, *sizes, bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text from its output and form. A text that holds a sentinel is always plain, so each is found once.

    An output that does not have the sentinels of its form, in their order, is an error.
    """
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    prefix, suffix, middle = (buffer.find(s) for s in (PREFIX, SUFFIX, MIDDLE))
    in_order = 0 == suffix < prefix < middle if form == SPM else 0 == prefix < suffix < middle
    if form not in (SPM, PSM) or not in_order:
        raise ValueError(f"no output of form {form}")
    if form == SPM:  # suffix | prefix, middle
        rotate(buffer, 0, prefix, len(buffer))
        middle, suffix = middle - prefix, len(buffer) - prefix
    else:  # prefix, suffix | middle
        rotate(buffer, suffix, middle, len(buffer))
        middle, suffix = suffix, suffix + len(buffer) - middle
    del buffer[suffix : suffix + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the key, n (lines), form, prefix_chars, middle_chars (null if plain) and output.

    Whole texts of any length, row by row without a shuffle; null counts as empty, and empty texts and texts that hold
    a sentinel stay plain. Cuts follow from the key, so rows that repeat one with equal texts come out alike; a null key
    is cut like an empty one. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transformed(t.as_py(), k.as_py(), plan) for k, t in zip(batch.column(0), batch.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                ["k", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(docs[f"`{key}`"].alias("k"), F.coalesce(docs[f"`{text}`"], F.lit("")).cast("binary").alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("k", key)


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with the column ``restored``: each text rebuilt from its output and form alone. A null output is null."""
    bounded_batches(outputs.sparkSession)
    as_bytes = outputs.withColumn(output, F.col(f"`{output}`").cast("binary"))
    names = outputs.columns
    at = names.index(output), names.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if o is None else restored(o, f) for o, f in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*names, "restored"])

    out = as_bytes.mapInArrow(run, StructType([*as_bytes.schema.fields, StructField("restored", BinaryType())]))
    return out.withColumns({c: F.col(f"`{c}`").cast("string") for c in (output, "restored")})
