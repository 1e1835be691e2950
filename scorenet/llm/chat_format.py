"""Chat formatting in DataFrame operations.

A message's content is a list of typed parts. A visitor turns each part into text: text parts are
escaped, image, audio and document parts become placeholders, whose references and expanded token
counts are kept in order. Turns are marked, joined, and the assistant's texts recorded as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the template.
TURN, END, TRAINED = "<turn>", "</turn>\n", "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"))

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escaped(text: Column) -> Column:
    """Text without the sign that starts every control string. Each backslash of the result is
    followed by the letter of its code, so that ``unescaped`` restores any text."""
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def expanded_tokens(part: Column) -> Column:
    """How many tokens stand for an attachment: image patches, audio frames or document pages."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    size = F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).otherwise(part["pages"] * PAGE_TOKENS)
    return F.coalesce(size.cast("long"), F.lit(0).cast("long"))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def visited(part: Column) -> Column:
    """The text that stands for a part: a placeholder, or its escaped text, null counting as empty."""
    return F.when(is_attachment(part), F.concat(F.lit("<"), part["type"], F.lit(">"))).otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def text_part(text: Column) -> Column:
    """Content of one text part, as ``format_chats`` takes it."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row for each conversation: (conv_id, formatted, loss, attachments).

    ``loss``: the spans (start, end), in code points of ``formatted``, of the assistant's contents.
    ``attachments``: (turn, type, ref, tokens) of each placeholder in order. Turns are ordered by
    turn, ties by role and content, a null turn first; repeated rows are repeated turns. Null role,
    content or text counts as empty; parts of another type count as text. Rows with null conv_id
    form one conversation. A conversation is one row of the result and so is put together in one
    task; only its own turns meet there. An empty table gives an empty result; other columns are not
    read."""
    content = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    role = F.replace(escaped(F.coalesce(F.col(role_col).cast("string"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    rows = messages.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"),
        F.array_join(F.transform(content, visited), "").alias("_body"),
        F.transform(F.filter(content, is_attachment), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))).alias("_held"),
    )
    head = F.concat(F.lit(TURN), F.col("_role"), F.lit("\n"))
    rows = rows.select("*", F.length(head).alias("_head"), F.length("_body").alias("_size"), F.concat(head, "_body", F.lit(END)).alias("_piece"))
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_body")
    before = F.coalesce(F.sum(F.col("_head") + F.col("_size") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", F.row_number().over(order).alias("_n"), (before + F.col("_head")).alias("_start"))
    turn = F.struct("_n", "_piece", "_start", (F.col("_start") + F.col("_size")).alias("_end"), (F.col("_role") == TRAINED).alias("_loss"), "_held")
    turns = F.array_sort(F.collect_list(turn))
    out = rows.groupBy("_conv").agg(turns.alias("_turns"))
    span = F.transform(F.filter("_turns", lambda t: t["_loss"]), lambda t: F.struct(t["_start"].alias("start"), t["_end"].alias("end")))
    held = F.flatten(F.transform("_turns", lambda t: F.transform(t["_held"], lambda a: F.struct(t["_n"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return out.select(F.col("_conv").alias("conv_id"), F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"), span.alias("loss"), held.alias("attachments"))


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from formatted text; placeholders stay as they are."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def back(t: Column) -> Column:
        head = F.substring_index(t, "\n", 1)
        role = unescaped(F.replace(F.substring(head, F.lit(len(TURN) + 1), F.length(head)), F.lit("\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substring(t, F.length(head) + 2, F.length(t))).alias("text"))

    return F.transform(pieces, back)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


ADDED_CONV, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(2).select(F.lit(ADDED_CONV).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    chats = format_chats(rows.unionByName(added).withColumn("parts", text_part(F.col("text"))))
    chats = chats.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.encode("trained", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = {
    "op4_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(role) + 2 * length(text) - length(replace(replace(text, '\', ''), '<', ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
}
