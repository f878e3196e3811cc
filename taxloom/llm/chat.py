"""Chat formatting: turns of a conversation become one text with marked turns. Spark expressions only.

Per conversation the turn structs are collected and sorted; adjacent turns of one role are merged into a message; messages are
concatenated as ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Merged turns keep their seam, ``<|im_sep|>``, so the turns can be read
back. Inside texts ``<|``, and ``<\\|`` with any number of backslashes, gain one backslash, so no text can hold a control string and the
step can be undone exactly. A role's backslashes, line feeds and bars are written ``\\\\``, ``\\n``, ``\\p``.

The loss mask is the list of ``pieces``: their texts concatenate to ``formatted``, and ``loss`` marks assistant text.

Null texts and roles count as empty; a null turn number comes after all others; equal numbers are ordered by role, then text; repeated
rows are turns of their own. A null ``conv_id`` is a conversation too. An empty table gives no rows. Other columns are not read. A
conversation is one row of the result, so it must fit in one (as its formatted text must).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, SEAM = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))), "\\")


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` to one row per conversation: ``conv_id, formatted, pieces``."""
    one = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    # Where a message begins: at the first turn and wherever the role differs from the turn before.
    roles = F.transform("turns", lambda t: t["role"])
    df = df.withColumn("roles", roles).withColumn(
        "starts", F.array_compact(F.concat(F.array(F.lit(0)), F.zip_with(
            F.slice("roles", F.lit(2), F.size("roles") - 1),
            F.zip_with("roles", F.sequence(F.lit(0), F.size("roles") - 1), lambda r, i: F.struct(r.alias("r"), i.alias("i"))),
            lambda here, before: F.when(~here.eqNullSafe(before["r"]) & here.isNotNull(), before["i"] + 1)))))
    spans = F.zip_with(F.col("starts"), F.concat(F.slice("starts", F.lit(2), F.size("starts") - 1), F.array(F.size("turns"))),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = df.withColumn("messages", F.transform(spans, lambda s: F.slice("turns", s["a"] + 1, s["b"] - s["a"])))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)

    def marked(turns: Column) -> Column:
        role = F.get(turns, F.lit(0))["role"]
        body = F.transform(turns, lambda t: F.array(piece(F.lit(SEAM), off), piece(escape(t["text"]), role == TRAINED)))
        flat = F.flatten(body)
        return F.concat(F.array(piece(F.concat(F.lit(START), escape_role(role), F.lit("\n")), off)),
                        F.slice(flat, F.lit(2), F.size(turns) * 2 - 1), F.array(piece(F.lit(END + "\n"), off)))

    df = df.withColumn("pieces", F.flatten(F.transform("messages", marked)))
    return df.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``formatted`` and ``pieces`` alone: adds ``turns`` (role, text) as they were, and ``loss_text``."""
    body = F.split("formatted", r"<\|im_start\|>")
    messages = F.transform(F.slice(body, F.lit(2), F.size(body) - 1), lambda m: F.substring(m, F.lit(1), F.length(m) - len(END) - 1))

    def turns(message: Column) -> Column:
        at = F.instr(message, F.lit("\n"))
        role = unescape_role(F.substring(message, F.lit(1), at - 1))
        texts = F.split(F.substring(message, at + 1, F.length(message)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    learnt = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"]))
    return formatted.withColumns({"turns": F.flatten(F.transform(messages, turns)), "loss_text": F.array_join(learnt, "")})
