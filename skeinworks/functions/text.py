"""Text and number functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the line that stands for what a placeholder leaves out.
OMITTED = "[...%d lines of tool output omitted — within observation masking window...]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 code units: characters beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("long")


def tokens(c: Column | str) -> Column:
    """Estimated tokens: one for every four UTF-16 units, rounded up."""
    return F.ceil(utf16_length(c) / 4).cast("long")


def grouped(c: Column | str) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(col(c), 0)


def half_up(c: Column) -> Column:
    """Rounding of halves toward positive infinity, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("long")


def percent_text(part: Column, whole: Column) -> Column:
    """`12.3%`, or `n/a` for an empty whole."""
    return F.when(whole > 0, F.format_string("%.1f%%", part * 100.0 / whole)).otherwise("n/a")


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def line_count(c: Column | str) -> Column:
    return F.size(lines(c))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def padded(c: Column, width: int, left: bool = False) -> Column:
    """Blanks up to a width; longer text stays whole."""
    return F.when(F.length(c) >= width, c).otherwise((F.lpad if left else F.rpad)(c, width, " "))


def without_lines(c: Column | str, prefix: str) -> Column:
    """Text without the lines that start, after blanks, with prefix."""
    return F.array_join(F.filter(lines(c), lambda x: ~F.startswith(F.ltrim(x), F.lit(prefix))), "\n")


def placeholder(c: Column | str, head: int = 3) -> Column:
    """The first lines, a note on how many are left out, and the last line."""
    parts = lines(c)
    return F.concat_ws("\n", F.slice(parts, 1, head), F.format_string(OMITTED, F.size(parts) - (head + 1)), F.element_at(parts, -1))


def path_prefix(c: Column | str, depth: int = 3) -> Column:
    """The first segments of a path; a shallow path whole."""
    return F.array_join(F.slice(F.split(col(c), "/"), 1, depth), "/")


def folder_of(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise("")


def folded_path(c: Column) -> Column:
    """A relative path without empty, `.` and `..` segments."""
    return F.array_join(
        F.aggregate(
            F.split(c, "/"),
            F.array().cast("array<string>"),
            lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
        ),
        "/",
    )


def relative_to(c: Column | str, root: str) -> Column:
    """An absolute path under root as a relative one; others unchanged."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(col(c), F.lit(root)), F.substring(col(c), len(root) + 1, 1 << 30)).otherwise(col(c))


def contains_any_case(c: Column | str, needle: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))


#: Language by file suffix.
LANGUAGE = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}


def language_of(c: Column | str) -> Column:
    """The language of a path by its suffix, any case; null for others."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE.items() for x in pair))
    return table[F.lower(F.regexp_extract(col(c), r"\.([A-Za-z]+)$", 1))]


def is_source(c: Column | str) -> Column:
    return col(c).rlike(r"\.(ts|tsx|js|jsx)$")
