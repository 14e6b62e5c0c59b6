"""Ingestion: texts to typed chunks, to index chunks with links, skip reasons, embedding texts and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.chunk_rules import heading_prefix, type_of
from tarn.functions.python_tier import mapped_list, merge_sections, opening_headings, prose_runs, table_lines
from tarn.functions.semantic import Splitter
from tarn.functions.text import described_table, repair_hyphenation, squeeze, uuid5
from tarn.functions.typed_split import Chunk, typed_split, with_paths
from tarn.llm.common import bounded_batches
from tarn.providers import Offline, Provider

#: Chunks of fewer tokens are not indexed.
LEAST_TOKENS = 10
#: Words that a chunk holds at most; a sixteenth of it is the length from which prose is split.
CHUNK_WORDS = 1600
#: Texts of at most so many characters are split once if they come again, and so many of them are kept.
SHORT_TEXT = 400
KEPT_TEXTS = 20_000
BARE_TYPES = ("faq", "glossary", "contact", "address", "code", "json")


def document_id(user: Column, note: Column) -> Column:
    """user-note; a missing part is an error."""
    need = lambda c, name: F.when(c.isNotNull(), c.cast("string")).otherwise(F.raise_error(F.lit(f"{name} is missing")))
    return F.concat_ws("-", need(user, "user_id"), need(note, "note_id"))


CHUNKS = "array<struct<chunk_type:string,text:string,path:string>>"
COUNTED_CHUNKS = "array<struct<chunk_type:string,text:string,path:string,tokens:long>>"


def listed(chunks: DataFrame, doc: str, more: Sequence[str] = ()) -> DataFrame:
    """One row a chunk, from one row a document with its ``chunks``."""
    return chunks.select(doc, F.size("chunks").cast("long").alias("total"), F.posexplode("chunks").alias("chunk_index", "c")).select(doc, "chunk_index", "total", "c.chunk_type", "c.text", "c.path", *(f"c.{x}" for x in more))


def chunk_lists(split: Callable[[list[str]], list[list[Chunk]]], text: Column, count: Callable[[str], int] | None = None) -> Column:
    """The chunks that ``split`` makes of each text, with their ``tokens`` where there is a ``count``. Null counts as empty.

    They go back as flat Arrow arrays. Batches are of a bounded number of texts, so that a worker's memory does not grow with the table.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            lists = split(b.to_pylist())
            flat = [c for chunks in lists for c in chunks]
            columns = {"chunk_type": pa.array([c.kind for c in flat], pa.string()), "text": pa.array([c.text for c in flat], pa.string()), "path": pa.array([c.path for c in flat], pa.string())}
            if count is not None:
                columns["tokens"] = pa.array([count(c.text) for c in flat], pa.int64())
            ends = pa.array(accumulate(map(len, lists), initial=0), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    # As a deterministic function it would be run twice: for the rows, and for a filter that the optimizer puts before them, of lists that are not empty.
    return F.arrow_udf(run, CHUNKS if count is None else COUNTED_CHUNKS).asNondeterministic()(F.coalesce(text, F.lit("")))


def each(split: Callable[[str], list[Chunk]]) -> Callable[[list[str]], list[list[Chunk]]]:
    """``split`` over texts; what it makes of short ones is kept, as far as the bounded memory goes, for those that come again."""
    known: dict[str, list[Chunk]] = {}

    def run(texts: list[str]) -> list[list[Chunk]]:
        out = []
        for t in texts:
            found = known.get(t)
            if found is None:
                found = split(t)
                if len(t) <= SHORT_TEXT:
                    if len(known) >= KEPT_TEXTS:
                        known.clear()
                    known[t] = found
            out.append(found)
        return out

    return run


def typed_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk_index, total, chunk_type, text, path), in one pass over the documents without a shuffle.

    A text that is of one piece by its type is one chunk. Else its blocks are folded in order: headings go with what they
    head, those without are heading_only, and neighbouring prose is joined up to a heading or divider; then turns of a
    dialogue and lists are gathered. Null and blank texts, and those of dividers alone, have no chunk; repeated rows and
    null ids are documents like others.
    """
    bounded_batches(docs.sparkSession)
    return listed(docs.select(doc, chunk_lists(each(typed_split), F.col(text)).alias("chunks")), doc)


def _row(c: Chunk) -> dict:
    return {"chunk_type": c.kind, "text": c.text, "path": c.path}


def split_documents(texts: list[str], splitter: Splitter) -> list[list[Chunk]]:
    """Of each text the typed chunks, long prose among them split by ``splitter`` and typed anew, and neighbours of one section and a like type joined within its budget.

    The prose of all texts goes to the splitter together. The headings that open a chunk stay with its first part.
    """
    typed = [typed_split(t) for t in texts]
    prose = [(i, j, *opening_headings(c.text)) for i, chunks in enumerate(typed) for j, c in enumerate(chunks) if c.kind == "content"]
    parts = {(i, j): (head, p) for (i, j, head, _), p in zip(prose, splitter.prose([body for *_, body in prose]), strict=True)}
    out = []
    for i, chunks in enumerate(typed):
        expanded: list[Chunk] = []
        for j, c in enumerate(chunks):
            head, several = parts.get((i, j), ("", []))
            if not several:
                expanded.append(Chunk(c.text, c.kind))
                continue
            first = f"{head}\n\n{several[0]}" if head else several[0]
            expanded += [Chunk(p, type_of(p)) for p in (first, *several[1:])]
        joined = merge_sections(splitter.most, splitter.tokenizer.count)([_row(c) for c in with_paths(expanded)])
        out.append([Chunk(c["text"], c["chunk_type"], c["path"]) for c in joined])
    return out


def document_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", splitter: Splitter | None = None, counted: bool = False) -> DataFrame:
    """(doc, chunk_index, total, chunk_type, text, path) of the final chunks, from texts with their hyphenation repaired, in one pass without a shuffle.

    Null and blank texts have no chunk. An embedder of the splitter is asked by each worker for the prose of a batch of
    documents together; where it fails, that batch and those of a while after it are split by runs of sentences.
    ``counted`` adds the ``tokens`` of each chunk, by the splitter's tokenizer.
    """
    chosen = splitter or Splitter()
    bounded_batches(docs.sparkSession)
    whole = repair_hyphenation(F.coalesce(F.col(text), F.lit("")))
    split = chunk_lists(lambda texts: split_documents(texts, chosen), whole, chosen.tokenizer.count if counted else None)
    return listed(docs.select(doc, split.alias("chunks")), doc, ("tokens",) if counted else ())


def refined(most: int) -> Callable[[list[Chunk]], list[Chunk]]:
    """Of a document's typed chunks in order: long prose is split into runs of sentences, each typed anew, and neighbours of one section and a like type are joined.

    The headings that open a chunk stay with its first part.
    """
    parts, merge = prose_runs(max(1, most // 16), max(6, most // 120), most), merge_sections(most)

    def run(chunks: list[Chunk]) -> list[Chunk]:
        expanded: list[Chunk] = []
        for c in chunks:
            headings, body = heading_prefix(c.text) if c.kind == "content" else ("", "")
            several = parts(body)
            if len(several) < 2:
                expanded.append(c)
                continue
            first = f"{headings}\n\n{several[0]}" if headings else several[0]
            expanded += [Chunk(p, type_of(p), c.path) for p in (first, *several[1:])]
        return [Chunk(c["text"], c["chunk_type"], c["path"]) for c in merge([_row(c) for c in expanded])]

    return run


def refined_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = CHUNK_WORDS) -> DataFrame:
    """``refined`` of the typed chunks of each text, in one pass without a shuffle; repeated and null ids are documents like others."""
    bounded_batches(docs.sparkSession)
    refine = refined(most)
    return listed(docs.select(doc, chunk_lists(each(lambda t: refine(typed_split(t))), F.col(text)).alias("chunks")), doc)


def refined_chunks(chunks: DataFrame, doc: str = "doc_id", most: int = CHUNK_WORDS) -> DataFrame:
    """``refined`` of rows of ``typed_chunks``: what is gathered in one row are the chunks of one id."""
    bounded_batches(chunks.sparkSession)
    refine = refined(most)
    ordered = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_index").cast("int").alias("chunk_index"), "text", "path", "chunk_type"))).alias("chunks"))
    run = mapped_list(lambda rows: [_row(c) for c in refine([Chunk(r["text"], r["chunk_type"], r["path"]) for r in rows])], CHUNKS)
    return listed(ordered.select(doc, run(F.col("chunks")).alias("chunks")), doc)


def skip_reason(kind: Column, tokens: Column, embed_text: Column, quality: Column, least: int = LEAST_TOKENS, index_code: bool = False, index_json: bool = False) -> Column:
    structural = [*(() if index_code else ("code",)), *(() if index_json else ("json",)), "heading_only"]
    return (
        F.when(F.trim(embed_text) == "", "empty_embed_text")
        .when(kind.isin(*structural), F.concat(F.lit("structural:"), kind))
        .when(F.contains(F.lower(quality), F.lit("ocr")), F.concat(F.lit("quality:"), F.lower(quality)))
        .when(tokens < least, F.lit(f"quality:min_tokens<{least}"))
        .otherwise(F.lit(""))
    )


def embed_text(kind: Column, text: Column, path: Column) -> Column:
    """A table as sentences; bare types and texts that begin with a heading as they are; else the heading path before the text."""
    told = described_table(text, path)
    bare = kind.isin(*BARE_TYPES) | F.rlike(text, F.lit(r"^\s*#")) | (path == "")
    headed = F.concat(path, F.lit("\n\n"), F.regexp_replace(text, r"^\s+", ""))
    return squeeze(F.when((kind == "table") & (told != ""), told).when(kind == "table", table_lines(F.when(kind == "table", text))).when(bare, text).otherwise(headed))


def index_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", provider: Provider | None = None) -> DataFrame:
    """Index chunks with ids, links, token counts, embedding texts and skip reasons, without a shuffle; links are within a document, whatever its id."""
    provider = provider or Offline()
    splitter = provider.splitter()
    counted = splitter.tokenizer is getattr(provider, "tokenizer", None)
    out = document_chunks(docs, doc, text, splitter, counted)
    at, tokens = F.col("chunk_index"), F.col("tokens") if counted else provider.count_tokens(F.col("text"))
    links = {"chunk_id": at, "prev_id": F.when(at > 0, at - 1), "next_id": F.when(at + 1 < F.col("total"), at + 1)}
    out = out.select(doc, "chunk_index", "total", "chunk_type", "text", "path", *(c.cast("string").alias(name) for name, c in links.items()), tokens.alias("tokens"))
    out = out.withColumn("embed_text", embed_text(F.col("chunk_type"), F.col("text"), F.col("path")))
    quality = F.when(F.rlike("text", F.lit(r"(?:\b\w\s){8,}")), F.lit("ocr_noise")).otherwise(F.lit(""))
    out = out.withColumn("skip_reason", skip_reason(F.col("chunk_type"), F.col("tokens"), F.col("embed_text"), quality))
    return out.withColumn("point_id", uuid5(F.concat_ws("-", F.col(doc).cast("string"), "chunk_id")))


def summaries(docs: DataFrame, doc: str = "doc_id", text: str = "text", provider: Provider | None = None) -> DataFrame:
    """Summary artifacts: (doc, id, content)."""
    provider = provider or Offline()
    out = docs.select(doc, provider.summarise(F.col(text)).alias("content")).where("content <> ''")
    return out.withColumn("id", F.sha2(F.concat_ws(":", F.lit("summary"), F.col(doc).cast("string"), "content"), 256))
