"""Chat formatting with Spark expressions only.

One output string for each conversation.  A run of turns of one role becomes one block

    ``<turn>ROLE\\nTEXT<sep/>TEXT...</turn>\\n``

Inside roles and texts a backslash is written ``\\b`` and ``<`` is written ``\\l`` (in roles also a
newline as ``\\n``), so that no control string can occur in them and reading back is exact.  The loss
mask covers the texts of blocks whose role is in ``loss_roles``; ``mask`` holds it as runs
(chars, loss, bytes of UTF-8) over the formatted string.  What is read back as text under loss is cut out by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, CLOSE, BETWEEN = "<turn>", "</turn>\n", "<sep/>"
LOSS_ROLES = ("assistant",)


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(_escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return _unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles=LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, mask) of all conversations.

    Turns are sorted by (turn, role, text), null turns first; repeated rows are kept as turns of
    their own.  A null role or text is empty; a null conversation id is one conversation.  Other
    columns are ignored.  An empty table gives an empty one.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = sorted_.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    blocks = starts.select(
        "conv_id",
        F.transform(
            "at",
            lambda s, k: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(F.slice("turns", s + 1, F.coalesce(F.get("at", k + 1), F.size("turns")) - s), lambda t: _escape(t["text"])).alias("texts"),
            ),
        ).alias("blocks"),
    )
    loss = lambda b: b["role"].isin(*loss_roles)
    run = lambda c, on: F.struct(F.length(c).cast("long").alias("chars"), on.alias("loss"), F.octet_length(c).cast("long").alias("bytes"))
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(OPEN), _escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], BETWEEN), F.lit(CLOSE))), "").alias("formatted"),
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(run(F.concat(F.lit(OPEN), _escape_role(b["role"]), F.lit("\n")), F.lit(False))),
                    F.flatten(F.transform(b["texts"], lambda t, i: F.array(run(F.when(i == 0, "").otherwise(BETWEEN), F.lit(False)), run(t, loss(b))))),
                    F.array(run(F.lit(CLOSE), F.lit(False))),
                ),
            )
        ).alias("mask"),
    )


def _under_loss(formatted: Column, mask: Column) -> Column:
    """What the mask puts under loss, as it stands in the formatted string; cut by bytes, which need no search for a place."""
    data = formatted.cast("binary")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<binary>").alias("cut"))
    step = lambda s, r: F.struct(
        (s["at"] + r["bytes"]).alias("at"),
        F.when(r["loss"], F.concat(s["cut"], F.array(F.substr(data, (s["at"] + 1).cast("int"), r["bytes"].cast("int"))))).otherwise(s["cut"]).alias("cut"),
    )
    return F.aggregate(mask, start, step, lambda s: F.array_join(F.transform(s["cut"], lambda c: c.cast("string")), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_text, formatted_chars), parsed from the formatted string.

    loss_text is the text under the mask, unescaped.
    """
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    parsed = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.transform(
            parts,
            lambda p: F.struct(
                _unescape_role(F.substr(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1))).alias("role"),
                F.transform(F.split(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2), BETWEEN, -1), _unescape).alias("texts"),
            ),
        ).alias("blocks"),
        _unescape(_under_loss(F.col("formatted"), F.col("mask"))).alias("loss_text"),
    )
    return parsed.select(
        "conv_id",
        "formatted_chars",
        F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text"))))).alias("turns"),
        "loss_text",
    )


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
