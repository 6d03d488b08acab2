"""Agent transcripts: JSON payloads, message tables, playbooks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinworks.functions.text import lines

#: One part of a message; what is open in the payload stays JSON text.
PART = "struct<type string, text string, content array<struct<type string, text string>>, call string, response string>"
#: The playbook's section of lessons.
SECTION = "## Learned Strategies"


def payloads(raw: DataFrame, text: str = "value") -> DataFrame:
    """raw with `messages` (array of role and parts) and `broken`. Empty text is an empty
    payload; text that is no JSON, or has no messages, has null messages and passes through."""
    doc = F.try_parse_json(F.when(F.length(F.trim(text)) > 0, F.col(text)).otherwise("{}"))
    items = F.expr("try_variant_get(__doc, '$.llm_request.messages', 'array<variant>')")
    one = "CASE WHEN schema_of_variant(c) LIKE 'ARRAY%' THEN variant_get(c, '$', 'array<variant>') WHEN c IS NULL THEN array() ELSE array(c) END"
    part = (
        "named_struct('type', try_variant_get(p, '$.type', 'string'), 'text', try_variant_get(p, '$.text', 'string'),"
        " 'content', transform(try_variant_get(p, '$.content', 'array<variant>'), x -> named_struct('type', try_variant_get(x, '$.type', 'string'), 'text', try_variant_get(x, '$.text', 'string'))),"
        " 'call', to_json(try_variant_get(p, '$.functionCall', 'variant')), 'response', to_json(try_variant_get(p, '$.functionResponse.response', 'variant')))"
    )
    message = f"named_struct('role', try_variant_get(m, '$.role', 'string'), 'parts', transform(transform(array(try_variant_get(m, '$.content', 'variant')), c -> {one})[0], p -> {part}))"
    return raw.withColumn("__doc", doc).withColumn("__m", items).withColumn("broken", F.col("__doc").isNull()).withColumn("messages", F.expr(f"transform(__m, m -> {message})")).drop("__doc", "__m")


def message_rows(payload: DataFrame, session: str) -> DataFrame:
    """session, pos, role, parts: one row a message."""
    return payload.select(F.col(session).alias("session"), F.posexplode("messages").alias("pos", "m")).select("session", F.col("pos").cast("long").alias("pos"), "m.role", "m.parts")


def session_transcript(raw: DataFrame, text: str = "value") -> DataFrame:
    """raw with `transcript`: the payload's session_transcript, else its transcript, as text."""
    doc = F.try_parse_json(F.col(text))
    pick = lambda name: f"coalesce(try_variant_get(__doc, '$.{name}', 'string'), to_json(try_variant_get(__doc, '$.{name}', 'variant')))"
    return raw.withColumn("__doc", doc).withColumn("transcript", F.expr(f"coalesce({pick('session_transcript')}, {pick('transcript')})")).drop("__doc")


def playbook_lessons(playbooks: DataFrame, text: str = "text", section: str = SECTION) -> DataFrame:
    """playbooks' other columns, pos, type, lesson: lines `- [type] text` after the section's
    header, to the end of the file. Types may hold a dash."""
    others = [c for c in playbooks.columns if c != text]
    start = F.instr(F.col(text), section)
    rest = F.when(start > 0, F.expr(f"substring(`{text}`, instr(`{text}`, '{section}') + {len(section)})"))
    line = r"^- \[([\w-]+)\] (.+)$"
    return (
        playbooks.select(*others, F.posexplode(lines(rest)).alias("pos", "__l")).where(F.col("__l").rlike(line))
        .select(*others, "pos", F.regexp_extract("__l", line, 1).alias("type"), F.regexp_extract("__l", line, 2).alias("lesson"))
    )


def playbook_text(existing: str, lessons: list[tuple[str | None, str]], updated: str, section: str = SECTION) -> str:
    """The playbook with its section of lessons replaced, or put at the end. lessons are the
    few that a playbook keeps (see operators.lessons.KEPT)."""
    block = "\n".join([section, "", f"> Last updated: {updated}", "> Learned from agent sessions on this repository.", "", *(f"- [{kind or 'general'}] {text}" for kind, text in lessons), ""])
    before, found, after = existing.partition(section)
    if not found:
        return existing.rstrip() + "\n\n" + block
    cut = after.find("\n## ")
    return before + block + (after[cut:] if cut >= 0 else "")


def load_playbook(spark: SparkSession, path: str, default: str = "# Playbook\n") -> DataFrame:
    """path, text: the file, or the default text where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    except AnalysisException:
        return spark.createDataFrame([(path, default)], "path string, text string")


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, path: str, text: str = "text") -> None:
    """A column of texts, one to a line or more, into a folder of text files, in any store that
    Spark reaches."""
    rows.select(text).write.mode("overwrite").text(path)


def write_playbook(spark: SparkSession, path: str, text: str) -> None:
    """The playbook's text as one file of any store that Spark reaches; it holds KEPT lessons
    at most."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
