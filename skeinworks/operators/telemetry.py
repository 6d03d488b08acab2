"""Tool-call telemetry: aggregates, efficiency, sequences and reports. Every function takes a
batch or a streaming DataFrame of tool_calls unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinworks.functions.text import half_up, padded, percent_text

#: Engines that parse by syntax tree, and those that stand in for one.
TREE, STAND_IN = ("tree-sitter",), ("regex-fallback", "token-stream-fallback")


def per_tool(calls: DataFrame) -> DataFrame:
    """tool, calls, tokens_in, tokens_out, total_ms, avg_ms, errors."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.sum("ms").alias("total_ms"),
        half_up(F.sum("ms") / F.count("*")).alias("avg_ms"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def totals(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens, errors, distinct tools, parse engine hits and stand-ins."""
    return calls.agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_distinct("tool").alias("tools"),
        F.count_if(F.col("engine").isin(*TREE)).alias("tree_calls"), F.count_if(F.col("engine").isin(*STAND_IN)).alias("stand_in_calls"),
    )


def efficiency(calls: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """tokens_per_call, tree_rate, and with graph(total_files, parsed_files, frontier_files)
    parsed_pct and frontier_pct; `n/a` where there is nothing to divide by."""
    t = totals(calls)
    tree = F.col("tree_calls") + F.col("stand_in_calls")
    out = t.select(F.when(F.col("tokens_out") > 0, half_up(F.col("tokens_out") / F.col("calls"))).otherwise(0).cast("long").alias("tokens_per_call"), percent_text(F.col("tree_calls"), tree).alias("tree_rate"))
    if graph is None:
        return out.withColumns({"parsed_pct": F.lit("n/a"), "frontier_pct": F.lit("n/a")})
    share = graph.select(percent_text(F.col("parsed_files"), F.col("total_files")).alias("parsed_pct"), percent_text(F.col("frontier_files"), F.col("total_files")).alias("frontier_pct"))
    return out.crossJoin(share)  # one row each


def call_sequence(calls: DataFrame) -> DataFrame:
    """seq, line: one formatted line a call."""
    extra = F.concat(F.when(F.col("engine").isNotNull(), F.concat(F.lit(", "), "engine")).otherwise(""), F.when(F.col("error").isNotNull(), ", ERR").otherwise(""))
    return calls.select("seq", F.concat(F.col("seq").cast("string"), F.lit(". "), "tool", F.lit(" ("), F.col("ms").cast("string"), F.lit("ms, ~"), F.col("output_tokens").cast("string"), F.lit("t out"), extra, F.lit(")")).alias("line"))


def graph_stats(files: DataFrame, parsed: DataFrame, symbols: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """One row of six counts."""
    one = lambda df, c, name: df.agg(c.alias(name))
    counts = [
        one(files, F.count_distinct("path"), "total_files"), one(parsed, F.count_distinct("path"), "parsed_files"), one(symbols, F.count_distinct("node_id"), "symbols"),
        one(edges, F.count_distinct("src", "dst"), "edges"), one(methods, F.count_distinct("name"), "methods"),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out.withColumn("frontier_files", F.col("total_files") - F.col("parsed_files"))


def index_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """The eager index's four counts: files, distinct symbol names, edges with repeats, methods."""
    out = files.agg(F.count_distinct("path").alias("files"))
    for df, c, name in ((symbols, F.count_distinct("name"), "symbols"), (edges, F.count("*"), "edges"), (methods, F.count_distinct("name"), "methods")):
        out = out.crossJoin(df.agg(c.alias(name)))  # one row each
    return out


def report(calls: DataFrame) -> DataFrame:
    """One row: totals, efficiency and the tools by tokens out, as structs. Batch only."""
    tools = per_tool(calls).agg(F.array_sort(F.collect_list(F.struct((-F.col("tokens_out")).alias("__o"), "tool", "calls", "tokens_in", "tokens_out", "avg_ms", "errors"))).alias("__t"))
    tools = tools.select(F.transform("__t", lambda x: x.dropFields("__o")).alias("per_tool"))
    s, e = totals(calls), efficiency(calls)
    return s.select(F.struct(*s.columns).alias("summary")).crossJoin(e.select(F.struct(*e.columns).alias("efficiency"))).crossJoin(tools)  # one row each


def report_text(calls: DataFrame) -> DataFrame:
    """text: the tools' table in fixed columns, one row. Batch only."""
    row = F.concat(padded(F.col("tool"), 26), *(padded(F.col(c).cast("string"), 10, left=True) for c in ("calls", "tokens_in", "tokens_out", "avg_ms", "errors")))
    head = "tool".ljust(26) + "".join(c.rjust(10) for c in ("calls", "in", "out", "avg ms", "errors"))
    lines = per_tool(calls).select((-F.col("tokens_out")).alias("o"), row.alias("line")).agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("l"))
    return lines.select(F.concat_ws("\n", F.lit(head), F.transform("l", lambda x: x["line"])).alias("text"))
