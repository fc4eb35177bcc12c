"""The compaction of conversations: the system prompt and the last messages stay, repeats become pointers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of
from ..operators.dedup import LENGTH_SHARE, near_duplicate
from ..options import Options
from ..sources.scratch import staged
from .pipeline import compact, reference_of

#: Messages up to this length are never collapsed. A fixed value.
REPEAT_LENGTH = 200
PARTS = "array<struct<type:string,text:string>>"


def parts_text(parts: Column) -> Column:
    """The text parts of a message, joined by line ends."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: F.coalesce(p.text, F.lit(""))), "\n")


def all_parts_text(parts: Column) -> Column:
    """Every part's text, joined by line ends, as services count it."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), "\n")


def replace_parts_text(parts: Column, new: Column) -> Column:
    """The first text part gets the new text, the others stay."""
    at = F.array_position(F.transform(parts, lambda p: F.coalesce(p.type, F.lit(""))), "text") - 1
    return F.transform(parts, lambda p, i: F.when(i == at, F.struct(p.type.alias("type"), new.alias("text"))).otherwise(p))


def positions(turns: DataFrame, keep_last: int = 4) -> DataFrame:
    """turns with pos (from 0) and protected: system prompts, the last messages and empty ones."""
    w = Window.partitionBy("conv_id")
    rows = turns.withColumn("pos", F.row_number().over(w.orderBy("turn")) - 1).withColumn("_n", F.count("*").over(w))
    protected = F.coalesce(F.col("role") == "system", F.lit(False)) | (F.col("pos") >= F.col("_n") - keep_last) | (F.length(text_of(F.col("text"))) == 0)
    return rows.withColumn("protected", protected).drop("_n")


def repeats(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, dup): the earliest eligible message before a long one that it nearly repeats.

    Equal texts need no comparison: of those only the earliest is compared with others, and only with texts of like length:
    candidates meet on the conversation and a bucket of the length's logarithm, or the next one.
    """
    open_ = rows.where("not protected").select("conv_id", "pos", text_of(F.col("text")).alias("text"))
    firsts = open_.groupBy("conv_id", "text").agg(F.min("pos").alias("pos"))
    bucket = F.floor(F.log(F.length("text")) / F.lit(math.log(1 / LENGTH_SHARE)))
    firsts = firsts.withColumn("bucket", bucket)
    late = firsts.where(F.length("text") > REPEAT_LENGTH).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    # an equal text's later occurrences find what its first one finds, or the first one itself, which is before all that follows it
    same_place = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.bucket") == F.col("b.bucket"))
    pairs = late.alias("a").join(firsts.alias("b"), same_place).where(F.col("b.pos") < F.col("a.pos"))
    a, b = F.col("a.text"), F.col("b.text")
    pairs = pairs.where(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)) >= LENGTH_SHARE)
    like = pairs.where(near_duplicate(a, b)).select(F.col("a.conv_id").alias("conv_id"), a.alias("text"), F.col("b.pos").alias("like_pos"))
    same = firsts.where(F.length("text") > REPEAT_LENGTH).select("conv_id", "text", F.col("pos").alias("like_pos"))
    candidates = like.union(same)
    found = open_.join(candidates, ["conv_id", "text"]).where("like_pos < pos")
    return found.groupBy("conv_id", "pos").agg(F.min("like_pos").alias("dup"))


def compact_conversations(turns: DataFrame, keep_last: int = 4, options: Options | None = None) -> DataFrame:
    """Per message: conv_id, turn, pos, role, text, action (kept, pointer, compacted), dup, ref, tokens before and after.

    Text columns hold the message's text; use parts_text() and replace_parts_text() around this for messages of parts.
    """
    o = options or Options()
    rows = positions(turns, keep_last)
    if not o.enabled:
        rows = rows.withColumn("protected", F.lit(True))
    # staged: it decides what is compacted and is joined to what comes of that
    dups = staged(repeats(rows)) if o.dedup else rows.limit(0).select("conv_id", "pos", F.col("pos").alias("dup"))
    rows = rows.join(dups, ["conv_id", "pos"], "left").withColumn("key", F.concat_ws(":", "conv_id", "pos"))
    ref = reference_of(F.col("text"))
    tail = F.concat(F.lit(" — retrieve "), ref, F.lit("]")) if o.reversible else F.lit("]")
    pointer = F.concat(F.lit("[identical to message #"), F.col("dup").cast("string"), F.lit("; elided"), tail)
    done = compact(rows.where("not protected and dup is null").select("key", "text"), "key", "text", o)
    done = done.where("compressed_tokens < original_tokens").select("key", F.col("text").alias("short"), F.col("ref").alias("short_ref"), "saved_tokens")
    rows = rows.join(done, "key", "left")
    text = F.when(F.col("dup").isNotNull(), pointer).otherwise(F.coalesce("short", "text"))
    action = F.when(F.col("dup").isNotNull(), "pointer").when(F.col("short").isNotNull(), "compacted").otherwise("kept")
    kept_ref = F.when(F.col("dup").isNotNull(), ref if o.reversible else F.lit(None)).otherwise(F.col("short_ref"))
    return rows.select("conv_id", "turn", "pos", "role", text.alias("text"), action.alias("action"), "dup", kept_ref.alias("ref"), F.col("text").alias("original"))
