"""Enrichment of chunks: batched keywords, entities, summaries by size, questions, dates, and the checks before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.dates import dates_of
from tarn.functions.python_tier import keyword_rows
from tarn.functions.text import HEADING, allowed_terms, full_lines, is_table_line, lines, question_list, strip, table_cells, table_headers, tokens
from tarn.operators.assist import dates_in
from tarn.operators.context import packed
from tarn.operators.terms import MOST_TERMS
from tarn.providers import Offline

#: Chunks and tokens that one keyword request takes, and tokens that one summary request takes.
BATCH_CHUNKS, BATCH_TOKENS, SUMMARY_TOKENS = 8, 1200, 3000
#: Tokens of a summary's answer and of its prompt.
SUMMARY_OUTPUT, SUMMARY_PROMPT = 300, 200
LEAST_SUMMARY_TOKENS = 10
STRUCTURAL = ("code", "json", "heading_only")


def keyword_skip_reason(kind: Column, text: Column, quality: Column) -> Column:
    """Why a chunk gets no keywords: bad quality, a structural type, or no letter; empty if it does."""
    return F.when(quality != "", F.concat(F.lit("quality:"), quality)).when(kind.isin(*STRUCTURAL), F.concat(F.lit("structural:"), kind)).when(~F.rlike(text, F.lit(r"\p{L}")), "non_lexical").otherwise("")


def in_summary(kind: Column, tokens_: Column, quality: Column, least: int = LEAST_SUMMARY_TOKENS) -> Column:
    return ~kind.isin(*STRUCTURAL) & (tokens_ >= least) & ~F.contains(quality, F.lit("ocr"))


def wants_entities(kind: Column, text: Column) -> Column:
    return ~kind.isin(*STRUCTURAL) & F.rlike(text, F.lit(r"\p{L}"))


def verdict(text: Column) -> Column:
    """discard for blank text and texts of signs only, merge for lone headings, bullets, table rows and fragments of up to two words, else valid."""
    own = full_lines(F.coalesce(text, F.lit("")))
    lone = F.size(own) == 1
    first = F.get(own, F.lit(0))
    return (
        F.when((F.size(own) == 0) | F.forall(own, lambda x: ~F.rlike(x, F.lit(r"[\p{L}\p{N}]"))), "discard")
        .when(lone & (F.rlike(first, F.lit(HEADING)) | F.rlike(first, F.lit(r"^(?:[-*+]|\d+[.)])\s")) | is_table_line(first) | (F.size(F.split(first, r"\s+")) <= 2)), "merge")
        .otherwise("valid")
    )


def batches(chunks: DataFrame, doc: str, most: int = BATCH_CHUNKS, budget: int = BATCH_TOKENS) -> DataFrame:
    """Chunks with the number of the request that they go into: a request closes at its count or tokens."""
    arrays = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("tokens").alias("n")))).alias("items"))
    numbered = arrays.select(doc, F.inline(F.arrays_zip(F.transform("items", lambda x: x["chunk_index"]).alias("chunk_index"), packed(F.col("items"), most, budget).alias("batch"))))
    return chunks.join(numbered.toDF(doc, "chunk_index", "batch"), [doc, "chunk_index"])


def keywords(chunks: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The stand-in's keywords: a chunk's longer words by how often they come, then by the alphabet."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: F.length(w) > 3)
    counted = F.transform(F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), w.alias("w")))
    return chunks.withColumn("keywords", F.slice(F.transform(F.array_sort(counted), lambda x: x["w"]), 1, most))


def asked_keywords(chunks: DataFrame, doc: str, path: str, ask: Callable[[Column], Column], most: int = BATCH_CHUNKS, budget: int = BATCH_TOKENS, keep: int = MOST_TERMS) -> DataFrame:
    """(doc, chunk_id, keywords, calls) of chunks (chunk_id, chunk_index, chunk_type, tokens, text): what a model replies to batched requests.

    ``ask`` maps a request, a JSON list of the batch's chunks, to a reply or null where it fails. From a reply come at most
    ``keep`` keywords for each chunk of the batch, however broken it is elsewhere. A reply that has none for any chunk is
    asked for once more; then once for the chunks that are still missing, which else have none. ``calls`` are those of the
    chunk's batch. Each round's replies are a table in ``path``, as asking twice may not give the same.
    """
    spark = chunks.sparkSession
    wanted = batches(chunks, doc, most, budget).select(doc, "batch", "chunk_index", F.col("chunk_id").cast("string").alias("chunk_id"), "chunk_type", "text")
    wanted.write.mode("overwrite").parquet(f"{path}/batches")
    wanted = spark.read.parquet(f"{path}/batches")
    found, calls, state = None, None, wanted.select(doc, "batch").distinct().withColumn("heard", F.lit(False))
    for round_ in (1, 2, 3):
        open_ = wanted.join(state, [doc, "batch"]) if found is None else wanted.join(state, [doc, "batch"]).join(found.select(doc, "batch", "chunk_id"), [doc, "batch", "chunk_id"], "left_anti")
        items = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.col("chunk_type").alias("type"), "text"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["type"].alias("type"), x["text"].alias("text")))
        requests = open_.groupBy(doc, "batch", "heard").agg(F.to_json(items).alias("request"))
        requests.withColumn("reply", ask(F.col("request"))).select(doc, "batch", "heard", "reply").write.mode("overwrite").parquet(f"{path}/replies{round_}")
        replies = spark.read.parquet(f"{path}/replies{round_}")
        told = replies.select(doc, "batch", F.explode(keyword_rows(F.col("reply"))).alias("k")).select(doc, "batch", "k.chunk_id", F.slice(F.transform("k.keywords", lambda w: F.regexp_replace(w, r"\s+", " ")), 1, keep).alias("keywords"))
        new = told.join(open_.select(doc, "batch", "chunk_id"), [doc, "batch", "chunk_id"], "left_semi")
        found = new if found is None else found.unionByName(new)
        asked = replies.groupBy(doc, "batch").agg(F.count("*").alias("calls"))
        calls = asked if calls is None else calls.unionByName(asked)
        heard = new.select(doc, "batch").distinct().withColumn("now", F.lit(True))
        # Heard for the first time: one more request for what is missing. Not heard at all in the first round: the whole batch again.
        again = replies.join(heard, [doc, "batch"], "left").where(~F.col("heard") & (F.coalesce("now", F.lit(False)) | F.lit(round_ == 1)))
        state = again.select(doc, "batch", F.coalesce("now", F.lit(False)).alias("heard"))
    total = calls.groupBy(doc, "batch").agg(F.sum("calls").cast("int").alias("calls"))
    return wanted.select(doc, "batch", "chunk_id").join(found, [doc, "batch", "chunk_id"], "left").join(total, [doc, "batch"]).select(doc, "chunk_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "calls")


def summaries(chunks: DataFrame, doc: str, provider: Offline | None = None, budget: int = SUMMARY_TOKENS, least: int = LEAST_SUMMARY_TOKENS) -> DataFrame:
    """(doc, summary, groups): a document within the budget is summarised at once; a longer one in groups whose summaries are summarised. Chunks of fewer than ``least`` tokens are left out."""
    provider = provider or Offline()
    own = chunks.where(in_summary(F.col("chunk_type"), F.col("tokens"), F.lit(""), least))
    grouped = batches(own, doc, 1 << 30, budget).groupBy(doc, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    parts = grouped.withColumn("part", provider.summarise(F.col("text")))
    joined = parts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "part"))), lambda x: x["part"]), "\n").alias("parts"), F.count("*").alias("groups"))
    return joined.select(doc, F.when(F.col("groups") == 1, F.col("parts")).otherwise(provider.summarise(F.col("parts"))).alias("summary"), "groups")


def group_limit(window: int, output: int, prompt: int) -> int:
    """Tokens of text that a request takes beside its prompt and its answer; a window without room for any is an error."""
    left = window - output - prompt
    if left <= 0:
        raise ValueError(f"a window of {window} tokens leaves no room beside {prompt} of the prompt and {output} of the answer")
    return left


def hierarchical_summaries(
    chunks: DataFrame, doc: str, path: str, provider: Offline | None = None, window: int = SUMMARY_TOKENS, output: int = SUMMARY_OUTPUT, prompt: int = SUMMARY_PROMPT, least: int = LEAST_SUMMARY_TOKENS, summarise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(doc, summary, levels, calls, error) of chunks (chunk_index, chunk_type, tokens, text), for documents of any length.

    Texts are packed in order into groups that a request takes, a group is summarised by one call, and the summaries are
    packed and summarised again until a document is one group. A text that is too large for a request by itself is an
    error of its document, which then has no summary; so is a level whose summaries are no fewer than their texts.
    Empty summaries are left out, and chunks of fewer than ``least`` tokens. Each level is a table in ``path``, a folder
    that all executors reach; one row a document with the sizes of its texts is what a task holds.
    """
    provider = provider or Offline()
    summarise = summarise or provider.summarise
    limit = group_limit(window, output, prompt)
    spark, level, done = chunks.sparkSession, 0, []
    rows = chunks.where(in_summary(F.col("chunk_type"), F.col("tokens"), F.lit(""), least)).select(doc, F.col("chunk_index").cast("int").alias("place"), F.col("text"), F.lit(0).alias("calls"))
    while True:
        level += 1
        sized = rows.withColumn("n", provider.count_tokens(F.col("text")).cast("long"))
        arrays = sized.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("items"), F.max("n").alias("largest"), F.count("*").alias("texts"), F.sum("calls").alias("calls"))
        planned = arrays.withColumn("batches", packed(F.col("items"), 1 << 30, limit)).withColumn("groups", F.array_max("batches") + 1)
        planned = planned.withColumn("error", F.when(F.col("largest") > limit, F.concat(F.lit("a text of "), F.col("largest").cast("string"), F.lit(" tokens exceeds the request"))).when(F.lit(level > 1) & (F.col("groups") > 1) & (F.col("groups") >= F.col("texts")), F.lit("summaries do not get fewer")))
        spread = planned.where("error IS NULL").select(doc, "groups", "calls", F.inline(F.arrays_zip(F.transform("items", lambda x: x["place"]).alias("place"), F.col("batches").alias("batch")))).toDF(doc, "groups", "earlier", "place", "batch")
        grouped = rows.select(doc, "place", "text").join(spread, [doc, "place"]).groupBy(doc, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.first("groups").alias("groups"), F.first("earlier").alias("earlier"))
        made = grouped.withColumn("summary", F.trim(summarise(F.col("text")))).drop("text")
        failed = planned.where("error IS NOT NULL").select(doc, F.lit(None).cast("int").alias("batch"), F.lit(None).cast("int").alias("groups"), F.col("calls").alias("earlier"), F.lit("").alias("summary"), "error")
        made.withColumn("error", F.lit(None).cast("string")).unionByName(failed.select(doc, "batch", "groups", "earlier", "summary", "error")).withColumn("level", F.lit(level)).write.mode("overwrite").parquet(f"{path}/level{level}")
        table = spark.read.parquet(f"{path}/level{level}")
        done.append(table.where("groups = 1 OR error IS NOT NULL").select(doc, "summary", F.col("level").alias("levels"), (F.col("earlier") + F.when(F.col("error").isNull(), 1).otherwise(0)).cast("int").alias("calls"), "error"))
        more = table.where("groups > 1")
        if more.isEmpty():
            break
        # A document's calls so far are kept in its first row, so that their sum is theirs.
        calls = F.when(F.col("batch") == F.min("batch").over(Window.partitionBy(doc)), F.col("earlier") + F.col("groups")).otherwise(F.lit(0))
        kept = more.withColumn("calls", calls.cast("int")).withColumn("filled", F.count_if(F.col("summary") != "").over(Window.partitionBy(doc)))
        done.append(kept.where("filled = 0 AND batch = 0").select(doc, F.lit("").alias("summary"), F.col("level").alias("levels"), "calls", F.lit("no usable summary").alias("error")))
        rows = kept.where("filled > 0 AND (summary <> '' OR calls > 0)").select(doc, F.col("batch").alias("place"), F.col("summary").alias("text"), "calls")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def questions(summaries_: DataFrame, reply: str) -> DataFrame:
    """Question artifacts of a model's replies: (…, place, question), at most five a row."""
    return summaries_.select("*", F.posexplode(question_list(F.col(reply))).alias("place", "question"))


def chunk_dates(chunks: DataFrame, doc: str) -> DataFrame:
    """(doc, chunk_id, date_text, date_value), each once."""
    found = chunks.select(doc, "chunk_id", F.explode(dates_in(F.col("text"))).alias("d"))
    return found.select(doc, "chunk_id", F.col("d.text").alias("date_text"), F.col("d.date").alias("date_value")).distinct()


def phrase_dates(chunks: DataFrame, doc: str, base: Column, zone: Column | str = "UTC") -> DataFrame:
    """(doc, chunk_id, date_text, date_value, date_precision, date_type) of every date phrase, each once; ``base`` is when a chunk's text was written."""
    found = chunks.select(doc, "chunk_id", F.explode(dates_of(F.col("text"), base, zone)).alias("d"))
    kind = F.when(F.col("d.relative"), "relative").otherwise("absolute")
    return found.select(doc, "chunk_id", F.col("d.text").alias("date_text"), F.col("d.value").alias("date_value"), F.col("d.precision").alias("date_precision"), kind.alias("date_type")).distinct()


def table_terms(text: Column, terms: Column, kind: Column) -> Column:
    """Of a table's terms those that are none of its headers; other texts keep all."""
    headers = F.transform(table_headers(text), lambda h: F.lower(h))
    return F.when(kind == "table", F.filter(terms, lambda t: ~F.array_contains(headers, F.lower(t)))).otherwise(terms)


def table_mentions(text: Column, mentions: Column, kind: Column) -> Column:
    """Of a table's mentions those that are a cell or share no word with its headers; other texts keep all."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    cells, of_headers = F.transform(table_cells(text), lambda c: F.lower(c)), words(F.array_join(table_headers(text), " "))
    return F.when(kind == "table", F.filter(mentions, lambda m: F.array_contains(cells, F.lower(m)) | ~F.arrays_overlap(words(m), of_headers))).otherwise(mentions)


def selected_terms(ranked: Column, reply: Column, most: int = MOST_TERMS) -> Column:
    """What a model's reply chose of the ranked terms; without a reply (null: the request failed) the first of them."""
    return F.when(reply.isNull(), F.slice(ranked, 1, most)).otherwise(allowed_terms(reply, ranked, most))


def overlapping(terms: Column, against: Column) -> Column:
    """Terms that share a word with ``against``."""
    known = tokens(F.array_join(against, " "))
    return F.filter(terms, lambda t: F.arrays_overlap(tokens(t), known))


def is_boilerplate(text: Column) -> Column:
    """Only page numbers and rules."""
    own = lines(strip(text))
    return F.forall(own, lambda x: F.rlike(strip(x), F.lit(r"(?i)^(?:page\s+)?\d*(?:\s*(?:of|/)\s*\d+)?$|^[-_=*]{3,}$")))
