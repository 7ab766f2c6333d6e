"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "<s>" role "[INST]" text "[/INST]" "</s>"

``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are control strings. Inside roles and texts every
control string gets one backslash after its first character, and one more where it already has some
(``<\\s>`` becomes ``<\\\\s>``), so escaped content holds no control string and unescaping takes exactly
one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_TURN = r"\G<s>((?s:.*?))\[INST\]((?s:.*?))\[/INST\]</s>"
#: A conversation of these two turns always comes along; they quote control strings.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])", r"$1$4$2$5\\$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])", r"$1$4$2$5$3$6")


def _armour(text: Column) -> Column:
    """Content without any ``<``, ``[`` or backslash, for what the light escape would not return."""
    for char, code in (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("\\", "%5C")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _unarmour(text: Column) -> Column:
    for char, code in (("\\", "%5C"), ("[", "%5B"), ("<", "%3C"), ("%", "%25")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation by the grammar."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(_content(r).alias("role"), _content(t).alias("text")))


def _content(raw: Column) -> Column:
    return F.when(raw.startswith("\u0001"), _unarmour(F.substr(raw, F.lit(2)))).otherwise(unescape(raw))


def _render(content: Column) -> Column:
    """Escape until parsing gives the content back: light escape first, else the armoured form."""
    light = escape(content)
    same = (unescape(light) == content) & ~light.rlike(r"</?s>|\[/?INST\]") & ~light.startswith("\u0001")
    return F.when(same, light).otherwise(F.concat(F.lit("\u0001"), _armour(content)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(said: Column, write) -> Column:
    """array<struct<role,head,body>> of the turns, their contents written by ``write``."""
    return F.transform(said, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), write(t["role"]), F.lit(TEXT)).alias("head"), write(t["text"]).alias("body")))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END + CLOSE))), "")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, mask): one row per conversation, turns in order.

    The rendered conversation is parsed again and its turns compared with the source: first with the
    light escape, then with armour for the contents that do not come back, then with armour
    for all, until both are identical. turns: array<struct<role,text>> as read back from ``formatted`` by
    :func:`parse`; mask: spans of ``formatted`` (code points, end exclusive) whose tokens carry loss, the
    assistant texts. Null texts and roles are empty; a null turn comes first; rows that repeat a turn are
    all kept, by role, then text; rows of a null conversation form one. Other columns are ignored. The
    turns of one conversation meet in one row, because its formatted text is one value.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    piece = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "role", "text")
    grouped = rows.select("conv_id", piece.alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    said = grouped.select("conv_id", F.transform("ps", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))).alias("said"))
    writers = (escape, _render, lambda c: F.concat(F.lit("\u0001"), _armour(c)))

    def written(writer: int) -> Column:
        """The conversation by the first of the remaining writers whose output is read back as it was."""

        def joined(pieces: Column) -> Column:
            return _let(_joined(pieces), lambda f: F.struct(pieces.alias("pieces"), f.alias("formatted"), parse(f).alias("turns")))

        def checked(w: Column) -> Column:
            return w if writer + 1 == len(writers) else F.when(w["turns"].eqNullSafe(F.col("said")), w).otherwise(written(writer + 1))

        return _let(_let(_pieces(F.col("said"), writers[writer]), joined), checked)

    chosen = said.select("conv_id", written(0).alias("w")).select("conv_id", "w.pieces", "w.formatted", "w.turns")
    grow = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def mark(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END + CLOSE)).alias("at"), F.when(p["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return chosen.select("conv_id", "formatted", "turns", F.aggregate("pieces", grow, mark, lambda acc: acc["out"]).alias("mask"))


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns of ``conversations`` and those of conversation -1, which quote control strings."""
    spark = turns.sparkSession
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return own.union(probe)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = lambda m: F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
    loss = F.array_join(F.transform("mask", lambda m: _content(masked(m))), "")
    read = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
