"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation the whole dialogue is rendered with that participant as the assistant, the others
as users under their names, and system turns as they are. Only the assistant's own words and the mark that ends its turn are trained on. The result
has one row for each turn of each view, with its place in the rendered dialogue, so that a dialogue is the
concatenation of its rows and no task ever holds one whole. Places are sums within runs of `CHUNK` turns, and sums of runs' totals;
a conversation with a third of all rows is spread over its runs.

Nulls: a null text is empty, a null role is the participant "unknown", a null turn comes first, and rows without a
conversation id form one conversation. Turns with equal numbers are ordered by role and text; repeated rows stay. A conversation
of system turns alone has no participants, hence no rows. "<|" inside a text becomes "< |"; in the rendered name, "|>" also becomes "| >" and
a line's end a space, so that neither can forge a turn. This can't be undone from the rendered text; `speaker` and `name` are as given.
Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def _safe_name(name: Column) -> Column:
    plain = F.replace(F.replace(name, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.translate(plain, "\r\n", "  ")


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, position, turn, speaker, role, name, rendered, start, length, mask_start, mask_end)."""
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"),
    )
    # one row a speaker and conversation, combined before the shuffle
    views = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("view_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    rows = (
        said.join(views, F.col("conv_id").eqNullSafe(F.col("view_conv")))
        .withColumn("role", role)
        .withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
        .withColumn("head", F.concat(F.lit("<|"), "role", F.coalesce(F.concat(F.lit(" name="), _safe_name(F.col("name"))), F.lit("")), F.lit("|>\n")))
        .withColumn("rendered", F.concat("head", "content", F.lit(END)))
        .withColumn("length", F.char_length("rendered").cast("long"))
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**55))))
    )
    run = ["conv_id", "perspective", "chunk"]
    inside = Window.partitionBy(*run).orderBy("turn", "speaker", "content")
    rows = rows.withColumn("at", F.row_number().over(inside).cast("long") - 1).withColumn("before", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    totals = rows.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("all_before")
    )
    rows = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("chunk") == F.col("k")))
    start = F.col("all_before") + F.col("before")
    trained = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        "perspective",
        (F.col("n_before") + F.col("at")).alias("position"),
        "turn",
        "speaker",
        "role",
        "name",
        "rendered",
        start.alias("start"),
        "length",
        F.when(trained, start + F.char_length("head")).alias("mask_start"),
        F.when(trained, start + F.col("length") - 1).alias("mask_end"),
    )
