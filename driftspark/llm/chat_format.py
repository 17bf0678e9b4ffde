"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes one example: all preceding turns are its context and only that reply is trainable.
A turn is written ``<s>role\\ntext</s>``. Control strings inside texts and roles get a backslash after their ``<``
(``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), which ``unescape`` takes away again, so any text survives.

Defined results: a null text or role is empty; turns sort by (turn, role, text) with null turns first; repeated rows
are repeated turns; a null conv_id is a conversation of its own; a conversation whose last turn is no reply also gets
a closing example without a trainable part, so that every turn can be read back; an empty table gives no rows; further
columns are ignored. A conversation is one row while it is formatted, as its text is one training example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, REPLY = "<s>", "</s>", "assistant"


def escape(text: Column) -> Column:
    """One more backslash inside anything that is, or looks like, an escaped control string."""
    return F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # "\\" and "\n" are read from left to right: a placeholder that no escaped role holds keeps them apart.
    mark = F.lit("\n")
    plain = F.replace(unescape(role), F.lit("\\\\"), mark)
    pieces = F.split(plain, "\n", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, is_closing, text, loss_start, loss_end: code points [loss_start, loss_end) are trainable."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.withColumn(
        "parts",
        F.transform(
            "t",
            lambda x: F.concat(F.lit(OPEN), _escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(CLOSE)),
        ),
    )
    n = F.size("t")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("t", i)["role"] == REPLY)
    closing = F.when(F.element_at("t", -1)["role"] == REPLY, F.array().cast("array<int>")).otherwise(F.array(n + 1))
    rows = whole.select("conv_id", "t", "parts", F.posexplode(F.concat(replies, closing)).alias("example", "at"))
    rows = rows.select(
        "conv_id",
        "example",
        (F.col("at") > F.size("t")).alias("is_closing"),
        F.array_join(F.slice("parts", F.lit(1), F.col("at") - 1), "").alias("context"),
        F.get("parts", F.col("at") - 1).alias("target"),
    )
    head, start = len(f"{OPEN}{REPLY}\n"), F.length("context")
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        "is_closing",
        F.concat("context", F.coalesce("target", F.lit(""))).alias("text"),
        F.when(F.col("is_closing"), start).otherwise(start + head).cast("long").alias("loss_start"),
        F.when(F.col("is_closing"), start)
        .otherwise(start + F.length("target") - len(CLOSE))
        .cast("long")
        .alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and losses (array of trainable texts), parsed from formatted text alone.

    The last example of a conversation holds every turn before it and its own, so it is the one that is split."""
    loss = unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    kept = examples.withColumn("loss", F.when(~F.col("is_closing"), loss)).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.sort_array(F.collect_list(F.when(~F.col("is_closing"), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    pieces = F.split("text", CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        at = F.locate("\n", body)
        return F.struct(
            _unescape_role(F.substr(body, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(body, at + 1)).alias("text"),
        )

    return kept.select(
        "conv_id",
        F.transform(pieces, turn).alias("turns"),
        F.transform("losses", lambda x: x["loss"]).alias("losses"),
        "formatted_chars",
    )
