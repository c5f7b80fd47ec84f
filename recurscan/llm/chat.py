"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log has events (conversation, turn, seq, kind, role, text). Within a conversation they are folded in the order of seq:

* ``message`` and ``edit`` set the turn's text, ``delta`` appends to it, ``regenerate`` empties the turn (or sets it to its text, if
  it has one) and drops all later turns' events so far.

A turn's final text is that of its last setting event and all later deltas. Windows over one partitioning by conversation
find these rows; a conversation is gathered only once, as the string that it becomes.

Template: ``### role:``, a line break, the text, a line break, ``</turn>``, a line break. In texts and roles a backslash
becomes two, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l`` (in roles also a line break ``\\n``), so that neither control string
can occur in them, and reading back is exact. The loss mask lists the spans (start from 0, length, in code points) of the
texts of the trained role.

A null text counts as empty, a null role as an empty one, a null kind as ``message``; an event without a turn comes before turn
numbers, a null conversation is one of its own; of events with one seq the order is that of kind and text. An empty log gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
LOWEST = -(1 << 62)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    """Pairs of backslashes part the string; between them each backslash begins one of the other escapes."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))), "\\")


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\n"), F.lit("\n"))), "\\")


def reconstruct(events: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final turns: conv, turn, role, text."""
    rows = events.select(
        F.col(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(LOWEST)).alias("t"), F.coalesce(F.col(seq).cast("long"), F.lit(LOWEST)).alias("s"),
        F.coalesce(F.col(kind), F.lit("message")).alias("k"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"),
    ).repartition("c")
    own = Window.partitionBy("c", "t")
    earlier = Window.partitionBy("c").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    ordered = own.orderBy("s", "k", "x")
    rows = rows.withColumn("n", F.row_number().over(ordered))
    rows = rows.withColumn("cut", F.max(F.when(F.col("k") == "regenerate", F.col("s"))).over(earlier)).where("cut is null or s > cut")
    rows = rows.withColumn("base", F.max(F.when(F.col("k") != "delta", F.col("n"))).over(own)).where("base is null or n >= base")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda e: e["x"]), "")
    return rows.groupBy("c", "t").agg(F.coalesce(F.min_by("r", F.when(F.col("r").isNotNull(), F.col("n"))), F.lit("")).alias("r"), said.alias("x")).select(F.col("c").alias(conv), F.col("t").alias(turn), F.col("r").alias(role), F.col("x").alias(text))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss (array of start and length)."""
    head = F.concat(F.lit(OPEN), _escape_role(F.col(role)), F.lit(":\n"))
    pieces = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), (F.col(role) == trained).alias("l"), head.alias("h"), escape(F.col(text)).alias("x"))
    pieces = pieces.withColumn("size", F.length("h") + F.length("x") + len(CLOSE))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("c").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("at", before.cast("int") + F.length("h"))
    each = F.array_sort(F.collect_list(F.struct("t", "l", "at", F.length("x").alias("n"), F.concat("h", "x", F.lit(CLOSE)).alias("s"))))
    grouped = pieces.groupBy("c").agg(each.alias("e"))
    spans = F.transform(F.filter("e", lambda e: e["l"]), lambda e: F.struct(e["at"].alias("start"), e["n"].alias("length")))
    return grouped.select(F.col("c").alias(conv), F.array_join(F.transform("e", lambda e: e["s"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From formatted and loss alone: conv, turns (array of role and text), loss_text."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    turns = F.transform(blocks, lambda b: F.struct(
        _unescape_role(F.substr(b, F.lit(len(OPEN) + 1), F.instr(b, F.lit("\n")) - len(OPEN) - 2)).alias("role"),
        unescape(F.substr(b, F.instr(b, F.lit("\n")) + 1)).alias("text")))
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select(conv, turns.alias("turns"), lost.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
