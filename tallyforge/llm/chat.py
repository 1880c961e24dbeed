"""Chat formatting with a grammar round trip.

A turn is ``<|role|>`` text ``<|end|>`` newline. Texts that hold a control string, of this template or of the
other ones listed, are escaped (marked ``<|role|esc|>``), so no text forges a turn. The rendered text is parsed again
by a deterministic parser and compared with the source; where the two differ all turns are escaped. Built-in functions only.

Null roles and texts count as empty. Turns are ordered by turn, role and text, so ties and repeated rows
have one order. Rows with a null conversation id form one conversation. No rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import let

END = "<|end|>\n"
# How control strings begin, here and in common chat templates.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>")
END_PATTERN = r"<\|end\|>\n"
TURN_PATTERN = r"(?s)\A<\|([^|]*)\|(esc\|)?>(.*)\z"


def escape(text: Column) -> Column:
    """Backslashes are doubled and every control string is broken by one behind its first character."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def controlled(text: Column) -> Column:
    out = F.lit(False)
    for c in CONTROL:
        out = out | text.contains(c)
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    for raw, safe in (("%", "%25"), ("|", "%7C"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(safe))
    return role


def _unrole(role: Column) -> Column:
    for raw, safe in (("<", "%3C"), ("|", "%7C"), ("%", "%25")):
        role = F.replace(role, F.lit(safe), F.lit(raw))
    return role


def render(turns: Column, escaped) -> Column:
    """The text of an array of (role, text) turns; ``escaped(turn)`` says which are escaped."""

    def one(t: Column) -> Column:
        plain = F.concat(F.lit("<|"), _role(t["role"]), F.lit("|>"), t["text"], F.lit(END))
        safe = F.concat(F.lit("<|"), _role(t["role"]), F.lit("|esc|>"), escape(t["text"]), F.lit(END))
        return F.when(escaped(t), safe).otherwise(plain)

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """The (role, text) turns of a rendered conversation."""

    def one(block: Column) -> Column:
        text = F.regexp_extract(block, TURN_PATTERN, 3)
        return F.struct(
            _unrole(F.regexp_extract(block, TURN_PATTERN, 1)).alias("role"),
            F.when(F.regexp_extract(block, TURN_PATTERN, 2) != "", unescape(text)).otherwise(text).alias("text"),
        )

    return let(F.split(rendered, END_PATTERN, -1), lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), one))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as parsed from it), identical (the round trip holds), level (1: texts with control strings are escaped; 2: all are)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    convs = convs.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = convs.withColumn("_one", render(F.col("source"), lambda t: controlled(t["text"])))
    tried = tried.withColumn("_same", parse(F.col("_one")) == F.col("source"))
    tried = tried.withColumn("formatted", F.when(F.col("_same"), F.col("_one")).otherwise(render(F.col("source"), lambda t: F.lit(True))))
    tried = tried.withColumn("turns", parse(F.col("formatted")))
    return tried.select("conv_id", "formatted", (F.col("turns") == F.col("source")).alias("identical"), F.when(F.col("_same"), 1).otherwise(2).alias("level"), "turns")


def digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and digests of what the formatted text holds; the loss covers the texts of ``loss_role``."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    return formatted.withColumn("_loss", under).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
