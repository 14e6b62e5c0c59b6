"""Chat formatting: each assistant turn becomes an example whose context is every turn before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Texts cannot hold them: their brackets are escaped.
OPEN, MIDDLE, CLOSE, START, END = "[INST]", "[TEXT]", "[/INST]", "<s>", "</s>"


def escape(text: Column) -> Column:
    """No ``[``, ``<`` or bare backslash is left, so no control string can occur; ``unescape`` inverts it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("["), F.lit("\\o"))
    return F.replace(out, F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Each backslash of an escaped text begins one of three codes, so the order of these steps is safe."""
    out = F.replace(text, F.lit("\\o"), F.lit("["))
    out = F.replace(out, F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), target_turn, formatted, loss_start (0-based), loss_chars.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn (null first),
    then role and text, so ties are stable and repeated rows stay. Null role or text counts as empty. An
    assistant turn ends an example and only its (escaped) text lies under the loss mask; turns behind the last
    assistant turn, and conversations without one, make a last example without a mask, so that nothing is lost.
    All rows of null conv_id are one conversation.
    """
    sorted_turns = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text"))).alias("turns"))
    )
    marked = sorted_turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.when(t["has"], t["turn"]).alias("turn"),
                (t["role"] == "assistant").alias("reply"),
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    ends = F.filter(F.transform("turns", lambda t, i: F.when(t["reply"] | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull())
    each = marked.select("conv_id", "turns", F.posexplode(ends).alias("example", "last"))
    target = F.element_at("turns", F.col("last") + 1)
    before = F.array_join(F.transform(F.slice("turns", 1, F.col("last")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    lead = F.concat(F.lit(START), before, target["head"])
    return each.select(
        "conv_id",
        "example",
        F.when(target["reply"], target["turn"]).alias("target_turn"),
        lead.alias("lead"),
        F.concat(lead, target["body"], F.lit(CLOSE + END)).alias("formatted"),
        target["reply"].alias("reply"),
        F.length(target["body"]).cast("long").alias("body_chars"),
    ).select(
        "conv_id",
        "example",
        "target_turn",
        "formatted",
        F.when(F.col("reply"), F.length("lead")).cast("long").alias("loss_start"),
        F.when(F.col("reply"), F.col("body_chars")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as an array of (role, text), read from its text alone."""
    inner = F.substring(formatted, len(START) + 1, 2**31 - 1)
    pieces = F.filter(F.split(F.replace(inner, F.lit(CLOSE + END), F.lit(CLOSE)), r"\Q" + CLOSE + r"\E"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    return F.when(chars > 0, unescape(F.substring(formatted, start + 1, chars))).otherwise("")


def read_back(examples: DataFrame) -> DataFrame:
    """A row per conversation from its examples only; the last example holds all turns. The examples are already dealt by conv_id."""
    loss = F.struct("example", loss_text(F.col("formatted"), F.col("loss_start").cast("int"), F.col("loss_chars").cast("int")).alias("text"))
    joined = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    read = joined.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), "formatted_chars", "n_examples")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
