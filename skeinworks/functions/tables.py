"""Table functions for SQL over sources: `SELECT ... FROM files f, LATERAL code_calls(f.path, f.content) c`.

Each takes a file's path and content and gives its rows; a file's rows depend on that file
alone, so a query over files is one pass in their partitions. The functions share the scanner
with operators.parse. Files that it cannot close give what it has found, and code_statements
gives their `unclosed` row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from skeinworks.operators import lexer, parse
from skeinworks.session import reach_workers


def _rows(path: str | None, content: str | None) -> list[tuple]:
    """The statements of a file."""
    return parse.scan(content, not str(path).lower().endswith(parse.PLAIN)) if content else []


def _events(path: str | None, content: str | None) -> list[tuple]:
    """what, name, place and line of a file's declarations and calls."""
    markup = not str(path).lower().endswith(parse.PLAIN)
    return list(lexer.events(content, lexer.blanked(content, markup)[1])) if content else []


def _checked(path: AnalyzeArgument, content: AnalyzeArgument, schema: str) -> AnalyzeResult:
    for name, argument in (("path", path), ("content", content)):
        if not isinstance(argument.dataType, StringType):
            raise ValueError(f"the {name} of a file is a string")
    # Analysis runs in a worker, which has no session that could read the text of a schema.
    found = StructType()
    for column in schema.split(", "):
        column_name, kind = column.split()
        found.add(column_name, {"string": StringType(), "int": IntegerType(), "boolean": BooleanType()}[kind])
    return AnalyzeResult(schema=found)


class CodeStatements:
    """The statements of a file; with a constant array of sections, of these alone."""

    def __init__(self, analyzed: AnalyzeResult | None = None) -> None:
        pass

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, sections: AnalyzeArgument | None = None) -> AnalyzeResult:
        if sections is not None and not (sections.isConstantExpression and isinstance(sections.dataType, ArrayType)):
            raise ValueError("the sections are a constant array of strings")
        return _checked(path, content, parse.STATEMENT)

    def eval(self, path: str, content: str, sections: list[str] | None = None) -> Iterator[tuple]:
        for r in _rows(path, content):
            if sections is None or r[0] in sections:
                yield r


class CodeSymbols:
    """The names that a file declares, each once, where it does first."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(path, content, "name string, kind string, line int, exported boolean")

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        met = set()
        for section, kind, name, exported, _, _, line, _, _ in _rows(path, content):
            if name is not None and kind in parse.SYMBOLS and name not in met:
                met.add(name)
                yield name, kind, line, exported


class CodeCalls:
    """The calls of a file with their top-level and innermost callers."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(path, content, "caller string, nested_caller string, callee_raw string, line int")

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        events = [(at, parse.EVENTS.index(what), name, line) for what, name, at, line in _events(path, content)]
        around = []
        for _, what, name, line in sorted(events, key=lambda e: e[:2]):
            if parse.EVENTS[what] == "open":
                around.append(name)
            elif parse.EVENTS[what] == "close":
                around.pop()
            else:
                yield (around[0], around[-1], name, line) if around else ("<module>", "<module>", name, line)


class CodeImports:
    """What a file imports, in order."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(path, content, "pos int, spec string")

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        for pos, m in enumerate(re.finditer(parse.IMPORTED, content or "")):
            yield pos, m[1]


class CodeSkeleton:
    """The skeleton of a file, one row."""

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(path, content, "skeleton string, original_lines int, skeleton_lines int")

    def eval(self, path: str, content: str) -> Iterator[tuple]:
        rows, blocks = _rows(path, content), []
        for section in parse.SECTIONS:
            shown = [r[4] for r in rows if r[0] == section]
            blocks += ([] if section == "imports" or not shown else ["", parse.header(section)]) + shown
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(blocks)).strip()
        yield text, len((content or "").split("\n")), sum(line != "" for line in text.split("\n"))


#: The functions by their names in SQL.
FUNCTIONS = {"code_statements": CodeStatements, "code_symbols": CodeSymbols, "code_calls": CodeCalls, "code_imports": CodeImports, "code_skeleton": CodeSkeleton}


def register(spark: SparkSession) -> None:
    """Make all of FUNCTIONS known to the session's SQL."""
    reach_workers(spark)
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
