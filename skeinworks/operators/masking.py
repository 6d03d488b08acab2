"""Masking of stale tool output in transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinworks.functions.text import half_up, line_count, placeholder

#: Turns that stay whole, lines of a tool output that do, and lines of other text that do.
TURNS, OUTPUT_LINES, TEXT_LINES = 10, 5, 500


def calls_tool(parts: Column) -> Column:
    return F.exists(parts, lambda p: F.coalesce((p["type"] == "tool_use") | p["call"].isNotNull(), F.lit(False)))


def turns(messages: DataFrame, session: str, pos: str, closes: Column) -> DataFrame:
    """messages with turn_id: how many turns earlier messages of the session have closed."""
    before = Window.partitionBy(session).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("turn_id", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)).cast("long"))


def model_turns(messages: DataFrame, role: str = "model") -> DataFrame:
    """A model message without a tool call closes a turn. messages(session, pos, role, parts)."""
    return turns(messages, "session", "pos", F.coalesce((F.col("role") == role) & ~calls_tool(F.col("parts")), F.lit(False)))


def outside_window(segmented: DataFrame, session: str, keep: int = TURNS) -> DataFrame:
    """segmented with `stale`: the turn is not among its session's last ones. Turns are not
    numbered across a gap: the last is the session's greatest."""
    last = F.max("turn_id").over(Window.partitionBy(session))
    return segmented.withColumn("stale", last - F.col("turn_id") >= keep)


def masked_text(c: Column, limit: int = OUTPUT_LINES) -> Column:
    """Text of more lines than the limit as a placeholder. A placeholder has five lines, so
    masking twice changes nothing."""
    return F.when(line_count(c) > limit, placeholder(c)).otherwise(c)


def masked_parts(parts: Column, output_lines: int = OUTPUT_LINES, text_lines: int = TEXT_LINES) -> Column:
    """Parts with tool results, tool responses and very long texts as placeholders."""

    def one(p: Column) -> Column:
        content = F.transform(p["content"], lambda x: F.when((x["type"] == "text") & (line_count(x["text"]) > output_lines), x.withField("text", placeholder(x["text"]))).otherwise(x))
        response = F.when(line_count(p["response"]) > output_lines, F.to_json(F.struct(placeholder(p["response"]).alias("output")))).otherwise(p["response"])
        long = (p["type"] == "text") & (line_count(p["text"]) > text_lines)
        return (
            F.when(p["response"].isNotNull(), p.withField("response", response))
            .when(p["type"] == "tool_result", p.withField("content", content))
            .when(long, p.withField("text", placeholder(p["text"])))
            .otherwise(p)
        )

    return F.transform(parts, one)


def mask(messages: DataFrame, keep: int = TURNS, role: str = "model") -> DataFrame:
    """messages(session, pos, role, parts) with parts outside of the last turns masked."""
    marked = outside_window(model_turns(messages, role), "session", keep)
    return marked.withColumn("parts", F.when(F.col("stale"), masked_parts(F.col("parts"))).otherwise(F.col("parts"))).drop("stale", "turn_id")


def savings(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """masked (rows that shrank), chars before and saved, tokens saved, percent saved; of two
    columns of lengths, or of JSON text."""
    b, a = F.sum(before), F.sum(after)
    return pairs.agg(
        F.count_if(F.col(after) < F.col(before)).alias("masked"), F.coalesce(b, F.lit(0)).alias("chars_before"), F.coalesce(b - a, F.lit(0)).alias("chars_saved"),
        F.coalesce(half_up((b - a) / 4.0), F.lit(0)).alias("tokens_saved"), F.when(b > 0, half_up((b - a) * 100.0 / b)).otherwise(F.lit(0)).cast("long").alias("reduction_pct"),
    )
