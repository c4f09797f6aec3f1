"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply carries
loss. A conversation that does not end with an assistant turn gets one more example that trains nothing, so
no turn is lost. Native column expressions only.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside texts and roles ``&`` is written ``&amp;``
and ``<|`` is written ``&lt;|`` (in roles a line feed is ``&#10;``), so no control string can come from a text,
and the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_examples(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text, more): conv_id, example, formatted, loss_start, loss_end, is_last.

    ``formatted`` ends with the trained reply; its code points loss_start .. loss_end (end exclusive, from 0)
    are the escaped reply. Both are equal where nothing is trained. Null roles and texts are empty; turns are
    ordered by turn, then role and text (nulls first), so repeated and tied rows are all kept; a null conv_id
    is a conversation; no rows give no rows; further columns are not read. A conversation's text is one value,
    as its examples are; the expansion itself holds one example at a time.
    """
    role = _escape_role(F.coalesce(F.col("role").cast("string"), F.lit("")))
    body = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = turns.select(
        "conv_id", "turn",
        (F.coalesce("role", F.lit("")) == ASSISTANT).alias("trained"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    tail = F.length(F.lit(END + "\n"))
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn(
        "stop", F.sum(F.length("head") + F.length("body") + tail).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "no", "trained", "stop", F.length("body").alias("size"),
            F.concat("head", "body", F.lit(END + "\n")).alias("formatted"),
        ))).alias("t")
    )
    whole = whole.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x.formatted), "").alias("all"),
        F.filter(
            F.transform("t", lambda x: F.struct(x.no.alias("no"), x.trained.alias("trained"), x.stop.alias("stop"), x["size"].alias("size"))),
            lambda x: x.trained | (x.no == F.size("t")),
        ).alias("t"),
    )
    loss_end = F.when(F.col("x.trained"), F.col("x.stop") - tail).otherwise(F.col("x.stop"))
    return whole.select("conv_id", "all", F.posexplode("t").alias("example", "x")).select(
        "conv_id", "example",
        F.when(F.col("x.stop") >= F.length("all"), F.col("all")).otherwise(F.substring("all", F.lit(1), F.col("x.stop").cast("int"))).alias("formatted"),
        F.when(F.col("x.trained"), loss_end - F.col("x.size")).otherwise(loss_end).alias("loss_start"),
        loss_end.alias("loss_end"), (F.col("x.stop") >= F.length("all")).alias("is_last"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    cut = len(END) + 1
    return F.transform(parts, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(
            p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - F.lit(cut)
        )).alias("text"),
    ))


def trained_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape(F.substring(formatted, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, their digest, trained text and its digest, characters.

    The turns come from the last example, which holds them all; the trained text from every example in order.
    """
    per = examples.select(
        "conv_id", "example", F.when(F.col("is_last"), F.col("formatted")).alias("formatted"), F.length("formatted").alias("chars"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("trained"),
    ).groupBy("conv_id").agg(
        F.max("formatted").alias("formatted"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "trained"))), lambda x: x.trained), "").alias("loss"),
    )
    turns = per.select("conv_id", "formatted_chars", "loss", parse_turns(F.col("formatted")).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
