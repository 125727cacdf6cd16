"""Operator 8, chat formatting with typed content parts; DataFrame functions only.

A turn has a list of parts (type, text, uri, units). A visitor flattens them in order: text is
escaped, every other part becomes a numbered placeholder such as ``<|image:0|>``, its uri goes to
the attachments of the conversation, and its units count as ``TOKENS`` tokens each. A table without
a ``parts`` column has one text part a turn.

Escaping replaces ``&`` by ``&amp;`` and ``<`` by ``&lt;``, so no control string can stand inside a
text, and undoing it gives the text back whatever it holds. Turns read
``<|turn|>role<|text|>content<|end|>`` and a line feed. The loss mask names, by turn, the code
points of an assistant's content.

Defined results: rows of a conversation are ordered by turn (nulls first), role and text; repeated
rows are turns of their own; null roles and texts count as empty; rows without conv_id form one
conversation; a conversation is one string and so is put together by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TOKENS = {"image": 256, "audio": 32, "document": 512}
PARTS = "array<struct<type:string,text:string,uri:string,units:int>>"
EXTRA = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_kind(kind: Column) -> Column:
    """A part's type inside a placeholder: its bars and colons must not end it."""
    return F.replace(F.replace(escape(kind), F.lit("|"), F.lit("&bar;")), F.lit(":"), F.lit("&colon;"))


def unescape_kind(kind: Column) -> Column:
    return unescape(F.replace(F.replace(kind, F.lit("&colon;"), F.lit(":")), F.lit("&bar;"), F.lit("|")))


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """Content with placeholders, attachments (type, uri), and tokens that attachments expand to. A null type is text."""
    parts = F.transform(parts, lambda p: F.struct(F.coalesce(p["type"], F.lit("text")).alias("type"), p["text"].alias("text"), p["uri"].alias("uri"), p["units"].alias("units")))
    other = F.filter(parts, lambda p: p["type"] != "text")
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda p: p["type"] != "text"))
    mark = lambda p, i: F.concat(F.lit("<|"), escape_kind(p["type"]), F.lit(":"), number(i).cast("string"), F.lit("|>"))
    content = F.transform(
        parts, lambda p, i: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark(p, i))
    )
    each = F.create_map(*[F.lit(x) for kind in TOKENS.items() for x in kind])
    tokens = F.aggregate(
        other, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.try_element_at(each, p["type"]), F.lit(1)) * F.coalesce(p["units"], F.lit(1))
    )
    return F.array_join(content, ""), F.transform(other, lambda p: F.struct(p["type"], p["uri"].alias("uri"))), tokens


#: A placeholder; escaped text holds no ``<``, so nothing else looks like one.
PLACEHOLDER = r"<\|[^|<]*:[0-9]+\|>"


def parts_of(content: Column) -> Column:
    """The parts (type, text, number) that a content stands for: texts unescaped, attachments by their numbers."""
    marks = F.transform(F.regexp_extract_all(content, F.lit(PLACEHOLDER), F.lit(0)), lambda m: F.substring(m, 3, F.length(m) - 4))
    none = F.lit(None).cast("string")
    texts = F.transform(F.split(content, PLACEHOLDER, -1), lambda t: F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), F.lit(None).cast("int").alias("number")))
    other = F.transform(
        marks, lambda m: F.struct(unescape_kind(F.regexp_replace(m, ":[0-9]+$", "")).alias("type"), none.alias("text"), F.element_at(F.split(m, ":"), -1).cast("int").alias("number"))
    )
    pairs = F.transform(texts, lambda t, i: F.array(t, F.get(other, i)))  # one text more than placeholders
    return F.filter(F.flatten(pairs), lambda p: p["type"].isNotNull() & ((p["type"] != "text") | (p["text"] != "")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask (turn, start, end), attachments, attachment_tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if "parts" in rows.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("uri"), F.lit(1).alias("units"))).cast(PARTS)
    content, attachments, tokens = visit(parts)
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), content.alias("content"),
            attachments.alias("attachments"), tokens.alias("tokens"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("ts"))
    line = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), t["content"], F.lit(END))
    start = lambda t: F.length(escape(t["role"])) + len(TEXT)
    spans = F.transform(
        "ts",
        lambda t, i: F.struct(
            i.alias("turn"), start(t).alias("start"), (start(t) + F.length(t["content"])).alias("end"), (t["role"] == "assistant").alias("on")
        ),
    )
    return whole.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", line), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["turn"], s["start"], s["end"])).alias("loss_mask"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("attachment_tokens"),
    )


def _by_turn(a: Column, b: Column) -> Column:
    """Turn (nulls first), role, text, then the parts by what they become."""
    key = lambda x: F.struct(x["turn"], x["role"], x["text"], x["content"], x["attachments"], x["tokens"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text, parts) and the text under the loss mask, from the strings and masks alone.

    ``parts`` tells a placeholder from a text that looks like one; ``text`` shows both alike.
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.size(F.split("formatted", r"<\|turn\|>", -1)))
    turns = F.transform(
        "_pieces",
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p)), END, 1)).alias("text"),
            parts_of(F.substring_index(F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p)), END, 1)).alias("parts"),
        ),
    )
    masked = F.transform(
        "loss_mask", lambda s: unescape(F.substring(F.get(F.col("_pieces"), s["turn"]), s["start"] + 1, s["end"] - s["start"]))
    )
    return formatted.withColumn("_pieces", pieces).withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, "")).drop("_pieces")


def digest(rows: DataFrame) -> DataFrame:
    """The figures of every conversation, read back from the output."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_conversations(rows)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_parts(conversations: DataFrame) -> DataFrame:
    """The table with an image after every user's text, two pages of a document before every assistant's, and a text that
    looks like a placeholder."""
    part = lambda kind, text, uri, units: F.struct(kind.alias("type"), text.alias("text"), uri.alias("uri"), units.cast("int").alias("units"))
    none, key = F.lit(None).cast("string"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    text = part(F.lit("text"), F.coalesce(F.col("text"), F.lit("")), none, F.lit(None))
    image = part(F.lit("image"), none, F.concat(F.lit("i:"), key), F.lit(None))
    pages = part(F.lit("document"), none, F.concat(F.lit("d:"), key), F.lit(2))
    sham = part(F.lit("text"), F.lit("<|image:0|>"), none, F.lit(None))
    parts = F.when(F.col("role") == "user", F.array(text, image)).when(F.col("role") == "assistant", F.array(pages, text, sham)).otherwise(F.array(text))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text", parts.cast(PARTS).alias("parts"))


def parts_digest(rows: DataFrame) -> DataFrame:
    """Of every conversation, read back from the output: its text parts, its attachments in order, the tokens that they take."""
    back = read_back(format_conversations(rows))
    each = F.flatten(F.transform("turns", lambda t: t["parts"]))
    texts = F.transform(F.filter(each, lambda p: p["type"] == "text"), lambda p: p["text"])
    other = F.filter(each, lambda p: p["type"] != "text")
    return back.select(
        "conv_id", F.size(other).cast("long").alias("n_attachments"), F.sha2(F.array_join(texts, ""), 256).alias("texts_sha256"),
        F.sha2(F.array_join(F.transform(F.zip_with(other, "attachments", lambda p, a: F.concat(p["type"], F.lit(" "), a["uri"])), lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("attachments_sha256"),
        "attachment_tokens",
    )


def parts_sql() -> str:
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(CAST(conv_id AS VARCHAR) || '/' || turn, '') AS key FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n_attachments,
  sha256(string_agg(CASE role WHEN 'assistant' THEN text || '<|image:0|>' ELSE text END, '' ORDER BY turn NULLS FIRST, role, text)) AS texts_sha256,
  sha256(coalesce(string_agg(CASE role WHEN 'user' THEN 'image i:' || key WHEN 'assistant' THEN 'document d:' || key END || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS attachments_sha256,
  CAST(sum(CASE role WHEN 'user' THEN {TOKENS["image"]} WHEN 'assistant' THEN {2 * TOKENS["document"]} ELSE 0 END) AS BIGINT) AS attachment_tokens
FROM t GROUP BY conv_id"""


def with_extra(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts look like control strings."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"),
    )
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), F.col("role"), F.col("text"))
    return own.unionByName(extra)


def oracle_sql() -> str:
    """The same figures in DuckDB SQL, without the way through the format."""
    esc = "length({0}) + 4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * (length({0}) - length(replace({0}, '<', '')))"
    fixed = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + {esc.format("role")} + {esc.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
