"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is under
the loss mask. A conversation that does not end with an assistant turn gets one further example without a target,
so that the examples of a conversation always hold all of it.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts each run of bars that follows a
``<`` gets one bar more, so no text can hold a control string, and taking one bar away restores it. A line break
inside a role is written ``<|n|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|n|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(BREAK))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(BREAK), F.lit("\n")))


def prefix_examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: ``conv_id, example, text, loss_start, loss_end`` (code points of ``text``).

    ``example`` counts from 0 in the order of turns; ``loss_start = loss_end`` where there is no target. Null roles
    and texts are empty. Turns are ordered by number (nulls first), then role and text; repeated rows are turns of
    their own. A row without a conversation is one by itself, with a null id, so that any number of them is spread over
    all tasks. Other columns are not read, and an empty table gives no examples.
    """
    said = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = F.struct("turn", "role", "text")
    nobody = F.lit(None).cast(said.schema["conv_id"].dataType).alias("conv_id")  # a literal lets Spark leave the other half out where only one is read
    whole = said.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns")).unionByName(
        said.where("conv_id is null").select(nobody, F.array(one).alias("turns")))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(
            F.lit(START), _escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))).alias("written"),
        F.transform("turns", lambda t: F.when(t["role"] == target, F.length(escaped(t["text"])))).alias("targets"),
    ).withColumn("ends", F.filter(
        F.sequence(F.lit(1), F.size("written")),
        lambda i: F.get("targets", i - 1).isNotNull() | (i == F.size("written"))))
    each = written.select("conv_id", "written", "targets", F.posexplode("ends").alias("example", "upto"))
    size = F.get("targets", F.col("upto") - 1)
    stop = F.length("text") - len(END)
    return each.select(
        "conv_id", "example", F.array_join(F.slice("written", F.lit(1), F.col("upto")), "").alias("text"),
        size.alias("size"),
    ).select(
        "conv_id", "example", "text",
        F.when(F.col("size").isNull(), 0).otherwise(stop - F.col("size")).alias("loss_start"),
        F.when(F.col("size").isNull(), 0).otherwise(stop).alias("loss_end"))


def target_text(text: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, as it was before formatting."""
    return unescaped(F.substring(text, start + 1, end - start))


def turns_of(text: Column) -> Column:
    """The roles and texts that a formatted example holds, read back from it."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda part, i: i > 0)

    def back(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(_unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, back)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: number and digest of its turns, and of its trainable text.

    An example without a conversation is all of its own one.
    """
    read = examples.select(
        "conv_id", "example", "text", F.length("text").alias("chars"),
        target_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("target"))
    own = F.struct("example", "target")
    one = read.where("conv_id is not null").groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(own)).alias("targets")).unionByName(read.where("conv_id is null").select(
            "conv_id", F.col("text").alias("last"), F.col("chars").cast("long").alias("formatted_chars"), F.array(own).alias("targets")))
    told = one.select(
        "conv_id", "formatted_chars", turns_of(F.col("last")).alias("turns"),
        F.array_join(F.transform("targets", lambda t: t["target"]), "").alias("loss"))
    spoken = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"))
