"""Parsing of TypeScript and JavaScript sources.

A scanner, run by Spark over partitions of files, cuts a file into its top-level statements and
labels them, and gives the bounds of all declarations and all calls as events; everything else
is column expressions over its rows: skeletons, symbols, callers, imports, RPC methods. What a
regex can find in whole texts never enters Python. Files that it cannot close, and files of
other languages, are read line by line instead, by column expressions alone.

Fidelity: brackets, strings, templates and markup with code inside, regular expressions and
comments are honoured (see operators.lexer); types are not parsed. Bare types are kept, methods
are listed, enums are symbols, and so is every name that a pattern binds. Time grows in
proportion to a file's size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinworks.functions.text import half_up, language_of, line_count, lines
from skeinworks.operators import lexer
from skeinworks.session import reach_workers, spread, stored

#: Sections of a skeleton, in order; imports have no header.
SECTIONS = ("imports", "Types", "Exports", "Registrations", "Module-level")
STATEMENT = "section string, kind string, name string, exported boolean, text string, source string, line_start int, line_end int, pos int"

_NAME = lexer.NAME
_DECLARED = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const\s+enum|const|let|var)\b\s*\*?\s*(?!extends\b|implements\b)({_NAME})?")
_REGISTERED = re.compile(rf"({_NAME}(?:\.{_NAME})+)\s*\(\s*(?:(['\"`])([^'\"`]+)\2\s*[,)]|\{{)")
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|abstract|readonly|async|override|get|set)\s+)*[\w$#]+\??\s*[(:=;<!]")
_KEY = re.compile(rf"(async\s+)?(?:['\"]([^'\"]+)['\"]|({_NAME}))\s*(?=[(:,])")
#: Keys of a registration that are no parameters, and how many to list.
_NOT_PARAMS, _PARAMS = {"description", "title", "shape", "type", "default", "examples", "inputSchema", "argsSchema", "outputSchema", "schema"}, 10
#: Levels of nested objects whose keys are parameters, characters of a description.
_LEVELS, _DESCRIPTION = 4, 150


def code_only(text: str, markup: bool = True) -> str:
    """text with the insides of comments, strings, regular expressions, templates and markup
    (code in these too) blanked, lengths kept."""
    return lexer.blanked(text, markup)[0]


_OUTER, _DEEP = re.compile(r"[(\[{]|[)\]}]|;|\n"), re.compile(r"[(\[{]|[)\]}]")
_START, _BREAK_START = re.compile(r"[^\s;)\]}]"), re.compile(r"\s*(?:[.?:=,)&|+*{]|from\b|extends\b|implements\b)")
_GOES_ON = re.compile(r"(?:[=,({\[.&|+:?]|=>|\bfrom|\bexport|\bdefault|\bimport)\s*$")
_NEW_START = re.compile(r"\s*(?:(?:export|import|function|class|const|let|var|interface|type|enum|async|abstract)\b|\Z)")


def statements(code: str) -> Iterator[tuple[int, int, bool]]:
    """Bounds of the top-level statements of blanked code, and whether each is closed: up to
    a semicolon, a line's end or a block's end outside of all brackets, unless what follows
    goes on with it."""
    at = 0
    while m := _START.search(code, at):
        start, at, depth, end = m.start(), m.start(), 0, None
        while end is None:
            m = (_DEEP if depth else _OUTER).search(code, at)
            if not m:
                break
            c, at = m[0], m.end()
            if c == "\n":
                if not _BREAK_START.match(code, m.start()) and not _GOES_ON.search(code, max(start, m.start() - 40), m.start()):
                    end = m.start()
                continue
            depth = max(0, depth + (c in "([{") - (c in ")]}"))
            if depth == 0 and (c == ";" or c == "}" and _NEW_START.match(code, at)):
                end = at
        if end is None:
            at = len(code)
            yield start, len(code.rstrip()), depth == 0
        else:
            yield start, end, True


_SOLID = re.compile(r"\S|\n")


def _inner(code: str, opened: int) -> Iterator[tuple[int, int]]:
    """Bounds of what stands between the brace at `opened` and its partner, cut at depth one
    by semicolons, commas, line ends and closed bodies."""
    depth, start = 0, None
    for m in _SOLID.finditer(code, opened):
        c, at = m[0], m.start()
        if depth == 1 and start is not None and (c in ";\n," or c == "}"):
            yield start, at
            start = None
        if c in "([{":
            depth += 1
            if depth == 1:
                continue
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return
            if depth == 1 and c == "}" and start is not None:
                yield start, at + 1
                start = None
                continue
        if depth >= 1 and start is None and c not in ";\n,}":
            start = at


def _body(code: str) -> int:
    """Where a declaration's body starts: its first brace outside of brackets; -1 without."""
    depth = 0
    for m in re.finditer(r"[(<\[]|[)>\]]|\{", code):
        if m[0] == "{" and depth <= 0:
            return m.start()
        if not (m[0] == ">" and code[m.start() - 1] in "=-"):
            depth += (m[0] in "(<[") - (m[0] in ")>]")
    return -1


def _signature(text: str, code: str) -> str:
    """text up to its body; its first line without one."""
    at = _body(code)
    return text[:at].rstrip() + " { ... }" if at >= 0 else text.split("\n")[0].rstrip()


def _class(text: str, code: str) -> str:
    opened = _body(code)
    if opened < 0:
        return text
    members = []
    for a, z in _inner(code, opened):
        piece, bare = text[a:z], code[a:z]
        if _MEMBER.match(bare):
            head = _signature(piece, bare)
            members.append("  " + (head.removesuffix(" { ... }") if head.endswith("{ ... }") else head).rstrip(";") + ";")
    return "\n".join([text[: opened + 1].rstrip(), *members, "}"])


def _variable(text: str, code: str) -> str:
    at = code.find("=>")
    if at >= 0 and code[:at].count("=") <= 1 + code[:at].count("=>"):
        return text[: at + 2].split("\n")[0].rstrip() + " { ... }"
    m = re.match(rf"(?:export\s+)?(?:const|let|var)\s+(?:{_NAME}|[\[{{])[^=]*=\s*(new\s+[\w$.]+|{_NAME}(?:\.{_NAME})*)\s*\(", code)
    return text[: m.end(1)].rstrip() + "(...)" if m else text.split("\n")[0].rstrip()[:80]


def _variables(code: str) -> list[str]:
    """All names that a variable statement declares, those of patterns included."""
    to, _ = lexer.partners(code)
    at, end, names = re.search(r"\b(?:const|let|var)\b", code).end(), len(code), []
    while True:
        found, at = lexer.bound_names(code, at, to)
        names += found
        depth = 0
        while at < end and not (code[at] == "," and not depth):  # its type and its value
            if at in to:
                at = to[at]
            elif code[at] in "<>" and code[at - 1] not in "=-":
                # Only a type argument's bracket is closed before the statement ends.
                depth = max(0, depth + (1 if code[at] == "<" and re.match(r"<[\w\s,.<>\[\]|&]*>", code[at:]) else -1 if code[at] == ">" else 0))
            at += 1
        if at >= end or not found and not names:
            return names
        at += 1


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()[:_DESCRIPTION]


def _config(text: str, code: str, opened: int, level: int = 0) -> tuple[str, list[str]]:
    """The description and the parameter names of a configuration object and its nested ones."""
    said, names = "", []
    for a, z in _inner(code, opened):
        m = _KEY.match(text[a:z] + ",")
        if not m:
            continue
        key, rest = m[2] or m[3], code[a + m.end() : z].lstrip(": \n\t")
        at = z - len(rest)
        if key == "description" and rest:
            value = text[at:z]
            said = _squeezed(" ".join(re.findall(r"['\"`]([^'\"`\n]+)['\"`]", value)) if value.startswith("[") else value.strip().strip("'\"`"))
        elif rest.startswith("{"):
            if level < _LEVELS:
                inner_said, inner = _config(text, code, at, level + 1)
                said, names = inner_said or said, names + inner
        elif key not in _NOT_PARAMS and re.fullmatch(r"\w{1,40}", key):
            names.append(key)
    return said, names


def _parameters(text: str, code: str) -> str:
    """The first list in round brackets of a member, `()` without one."""
    at = code.find("(")
    depth = 0
    for m in re.finditer(r"[()]", code[at:]) if at >= 0 else ():
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return text[at : at + m.end()]
    return "()"


def _registration(text: str, code: str, m: re.Match, line: int) -> tuple[str, list[str]]:
    """The placeholder of a registration (empty for other calls) and the methods it names."""
    if m[3] is None:
        keys = []
        for a, z in _inner(code, code.find("{")):
            if k := _KEY.match(text[a:z] + ","):
                keys.append((k[2] or k[3], bool(k[1]) or bool(re.match(r"\s*:\s*async\b", code[a + k.end() : z])), _parameters(text[a:z], code[a:z])))
        body = [f"  {'async ' if a else ''}{k}{p} {{ ... }}," for k, a, p in keys]
        return ("\n".join([f"{m[1]}({{", *body, f"}}); // L{line}"]) if keys else ""), [k for k, _, _ in keys]
    if not re.search(r"=>|\bfunction\b", code):
        return "", []
    said, names = "", []
    if config := re.compile(r"\s*\{").match(code, m.end()):
        said, names = _config(text, code, config.end() - 1)
    if names:
        listed = "{ " + ", ".join(names[:_PARAMS]) + " }"
    else:  # the handler's own parameters
        own = re.search(r"(?:function\b[^(]*|,\s*(?:async\s*)?)(\()", code[m.end() - 1 :])
        listed = _parameters(text[m.end() - 1 + own.start(1) :], code[m.end() - 1 + own.start(1) :])[1:-1].strip() if own else ""
    return f"{m[1]}('{m[3]}',{f' /* {said} */' if said else ''} async ({listed}) => {{ ... }}); // L{line}", []


def scan(content: str, markup: bool = True) -> list[tuple]:
    """Rows of STATEMENT for all statements. Rows of other sections than SECTIONS show in no
    skeleton: `method` for the keys of registered objects, `declared` for further names of a
    statement, `registered` for names given to calls without a function, `unclosed` for a
    statement whose brackets, template or markup the file does not close."""
    return _statements(content, *lexer.blanked(content, markup)[::2])


def read(content: str, markup: bool = True) -> list[tuple]:
    """The rows of `scan`, and one for each event: its section says what (EVENTS), its name
    whose, its pos where."""
    bare, full, whole = lexer.blanked(content, markup)
    return _statements(content, bare, whole) + [(what, None, name, False, None, None, line, line, at) for what, name, at, line in lexer.events(content, full)]


def _statements(content: str, code: str, whole: bool) -> list[tuple]:
    rows = []
    ends = [m.start() for m in re.finditer("\n", content)]
    for start, stop, closed in statements(code):
        text, bare = content[start:stop], code[start:stop]
        first, last = bisect_right(ends, start - 1) + 1, bisect_right(ends, stop - 1) + 1

        def put(section, kind, name, exported, shown, text=text, first=first, last=last):
            rows.append((section, kind, name, exported, shown, text, first, last, len(rows)))

        if not closed:
            put("unclosed", None, None, False, text.split("\n")[0])
        declared = _DECLARED.match(bare)
        exported = bare.startswith("export")
        if re.match(r"import\b(?!\s*\()", bare):
            put("imports", "import", None, False, text)
        elif declared:
            kind, name = declared[1].split()[-1], declared[2]
            names = _variables(bare) if kind in ("const", "let", "var") else []
            name = names[0] if names else name
            if kind == "class":
                shown = _class(text, bare)
            elif kind in ("const", "let", "var"):
                shown = _variable(text, bare)
            elif kind in ("type", "interface", "enum") and not exported:
                shown = text
            elif kind == "type":
                shown = text.rstrip(";") + ";" if text.endswith(";") else text
            else:
                shown = _signature(text, bare)
            variable = kind in ("const", "let", "var")
            put("Exports" if exported else "Types" if kind in ("interface", "type", "enum") else "Module-level", "variable" if variable else kind, name, exported, shown)
            for more in names[1:]:
                put("declared", "variable", more, exported, shown)
        elif exported:
            put("Exports", "reexport", None, True, _signature(text, bare) if bare.startswith("export default") else text.split("\n")[0])
        elif m := _REGISTERED.match(text):
            shown, keys = _registration(text, bare, m, first)
            if shown:
                put("Registrations", "registration", m[3] or m[1], False, shown)
            elif m[3]:
                put("registered", "registration", m[3], False, shown)
            for key in keys:
                put("method", m[1], key, False, key)
    if not whole and not any(r[0] == "unclosed" for r in rows):
        rows.append(("unclosed", None, None, False, None, None, len(ends) + 1, len(ends) + 1, len(rows)))
    return rows


#: Sections of events, in the order in which those of one place come.
EVENTS = ("close", "open", "call")
#: Suffixes whose files hold no markup: there `<T>` before a value is a type.
PLAIN = (".ts", ".mts", ".cts")


def scanned(sources: DataFrame, path: str = "path", content: str = "content", events: bool = True) -> DataFrame:
    """path and the rows of `read`: statements and, unless not asked for, events. Null content:
    none. The sources are spread over tasks, as reading one costs far more than moving it."""
    reach_workers(sources.sparkSession)
    rows_of = read if events else scan

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATEMENT.split(", ")]
        for pdf in batches:
            rows = [(p, *r) for p, text in zip(pdf[path], pdf[content]) if text for r in rows_of(text, not str(p).lower().endswith(PLAIN))]
            yield pd.DataFrame(rows, columns=[path, *names])

    return spread(sources.select(path, content), path).mapInPandas(run, f"{path} string, {STATEMENT}")


def _own(path: str) -> Column:
    """path as a value of its own. Spark 4.1 zips the sides of a union that are dealt alike by
    a column, and fails where it has coalesced one side's partitions otherwise."""
    return F.concat(path, F.lit("")).alias(path)


def is_event() -> Column:
    return F.col("section").isin(*EVENTS)


def parse(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path and STATEMENT's columns, one row for each labelled statement."""
    return scanned(sources, path, content, events=False)


def with_lines(sources: DataFrame, parsed: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """parsed with `engine`: files that the scanner could not close, and those of other
    languages, have the statements that lines show (and their `unclosed` row), no others.
    parsed is read three times: it should be stored."""
    marks = parsed.where("section = 'unclosed'")
    by_lines = sources.select(path).where(language_of(path).isNull()).unionByName(marks.select(path)).distinct().hint("merge")
    rest = sources.join(by_lines, path, "left_semi")
    shown = parse_lines(rest, path, content).unionByName(marks).withColumn("engine", F.lit("lines"))
    return parsed.join(by_lines, path, "left_anti").withColumn("engine", F.lit("scanner")).unionByName(shown)


def header(section: str) -> str:
    return f"// ── {section} " + "─" * max(0, 38 - len(section))


def skeletons(sources: DataFrame, parsed: DataFrame, path: str = "path", content: str = "content", methods_of: str | None = None) -> DataFrame:
    """path, skeleton, methods, original_lines, skeleton_lines, reduction_pct (of lines),
    reduction_chars_pct. Sections meet in their order, each under its header."""
    method = F.col("section") == "method"
    if methods_of:
        method &= F.col("kind") == methods_of
    # One pass over parsed gives both.
    listed = parsed.where(F.col("section").isin(*SECTIONS) | method).groupBy(path).agg(
        *(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("pos", "text")))).alias(s) for s in SECTIONS),
        F.transform(F.array_sort(F.collect_list(F.when(method, F.struct("pos", "name")))), lambda x: x["name"]).alias("methods"),
    )
    blocks = []
    for s in SECTIONS:
        items = F.transform(s, lambda x: x["text"])
        head = F.array() if s == "imports" else F.when(F.size(s) > 0, F.array(F.lit(""), F.lit(header(s)))).otherwise(F.array().cast("array<string>"))
        blocks.append(F.concat(head.cast("array<string>"), items))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.concat(*blocks), "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    # Of the sources only sizes meet the rows; their texts stay where they are.
    sizes = sources.select(path, line_count(content).alias("original_lines"), F.length(content).alias("__chars"))
    out = sizes.join(listed.select(path, text.alias("skeleton"), "methods").hint("merge"), path, "left")
    kept = F.size(F.filter(lines("skeleton"), lambda x: x != ""))
    return out.select(
        path, F.coalesce("skeleton", F.lit("")).alias("skeleton"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
        "original_lines", F.coalesce(kept, F.lit(0)).alias("skeleton_lines"),
        half_up((1 - F.coalesce(kept, F.lit(0)) / F.col("original_lines")) * 100).alias("reduction_pct"),
        half_up((1 - F.coalesce(F.length("skeleton"), F.lit(0)) / F.greatest("__chars", F.lit(1))) * 100).alias("reduction_chars_pct"),
    )


# --- line by line -----------------------------------------------------------------------

#: Fixed values, as the rules by lines have them: strings of a line, which hide their braces;
#: lines that begin a declaration or a registration; a declared name; a key of an object.
_LINE_STRING = r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?"
_LINE_MODULE = r"^(?:(?:async\s+)?(function)\b|(?:abstract\s+)?(class)\s|(const|let|var)\s)"
_LINE_CALL = r"^([\w$]+\.[\w$]+)\s*\(\s*"
_LINE_NAMED = _LINE_CALL + r"['\"`]([^'\"`\s]+)['\"`]\s*,"
_LINE_NAME = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+(?!extends\b|implements\b)([\w$]+)"
_LINE_KEY = r"^\s+(async\s+)?([\w$]+)\s*[:(]"


def _braces(line: Column) -> tuple[Column, Column]:
    """How many braces a line opens and closes outside of its strings."""
    bare = F.regexp_replace(line, _LINE_STRING, "")
    return F.length(F.regexp_replace(bare, r"[^{]", "")), F.length(F.regexp_replace(bare, r"[^}]", ""))


def parse_lines(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path and STATEMENT's columns by lines alone: a line outside of all braces that imports,
    exports, registers or declares starts a block, which lasts until its braces close. Bare
    types are left out, exports and declarations show their first line, keys of a registered
    object are its lines one brace deep. The depth is a running sum over a file's lines."""
    order = Window.partitionBy(path).orderBy("at")
    opens, closes = _braces(F.col("line"))
    rows = sources.select(path, F.posexplode(lines(content)).alias("at", "line"))
    rows = rows.withColumns({"__d": F.sum(opens - closes).over(order) - (opens - closes), "t": F.ltrim("line")})
    call, named = F.col("t").rlike(_LINE_CALL + r"\{"), F.col("t").rlike(_LINE_NAMED)
    kind = F.when(F.col("t").rlike(r"^import\s"), "imports").when(F.col("t").rlike(r"^export\s"), "Exports").when(named, "named").when(call, "object").when(F.col("t").rlike(_LINE_MODULE), "Module-level")
    rows = rows.withColumn("kind", F.when(F.col("__d") <= 0, kind))
    rows = rows.withColumn("block", F.sum(F.col("kind").isNotNull().cast("int")).over(order)).where("block > 0 AND (kind IS NOT NULL OR __d > 0)")
    blocks = rows.groupBy(path, "block").agg(
        F.min(F.when(F.col("kind").isNotNull(), F.struct("at", "kind", "line", "t"))).alias("h"), F.max("at").alias("end"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "line", "__d"))), lambda x: F.struct(x["line"].alias("line"), x["__d"].alias("d"))).alias("rows"),
    ).where("h IS NOT NULL")
    source = F.array_join(F.transform("rows", lambda x: x["line"]), "\n")
    blocks = blocks.select(path, "block", "h.*", "end", source.alias("source"), F.filter("rows", lambda x: x["d"] == 1)["line"].alias("inner"))
    first = F.when(F.contains("line", F.lit("{")), F.concat(F.rtrim(F.substring_index("line", "{", 1)), F.lit(" { ... }"))).otherwise(F.rtrim("line"))
    number = F.concat(F.lit("// L"), (F.col("at") + 1).cast("string"))
    has_function = F.col("source").rlike(HANDLER)
    said, names = description_of("source"), parameters_of("source")
    listed = F.when(F.size(names) > 0, F.concat(F.lit("{ "), F.array_join(names, ", "), F.lit(" }"))).otherwise("")
    shape_a = F.concat(F.regexp_extract("t", _LINE_NAMED, 1), F.lit("('"), F.regexp_extract("t", _LINE_NAMED, 2), F.lit("',"), F.when(said != "", F.concat(F.lit(" /* "), said, F.lit(" */"))).otherwise(""), F.lit(" async ("), listed, F.lit(") => { ... }); "), number)
    key = _LINE_KEY
    keys = F.transform(F.filter("inner", lambda x: x.rlike(key) & ~F.regexp_extract(x, key, 2).isin(*_NOT_KEYS)), lambda x: F.struct(F.regexp_extract(x, key, 1).alias("a"), F.regexp_extract(x, key, 2).alias("k")))
    blocks = blocks.withColumn("keys", F.when(F.col("kind") == "object", keys).otherwise(F.array().cast("array<struct<a:string,k:string>>")))
    body = F.array_join(F.transform("keys", lambda x: F.concat(F.lit("  "), F.when(x["a"] != "", "async ").otherwise(""), x["k"], F.lit("(...) { ... },"))), "\n")
    shape_b = F.concat(F.regexp_extract("t", _LINE_CALL, 1), F.lit("({\n"), body, F.lit("\n}); "), number)
    of_call = F.col("kind").isin("named", "object")
    text = F.when(F.col("kind") == "imports", F.col("source")).when(F.col("kind") == "named", shape_a).when(F.col("kind") == "object", shape_b).otherwise(first)
    shown = (F.col("kind") == "named") & has_function | (F.col("kind") == "object") & (F.size("keys") > 0) | ~of_call
    section = F.when(of_call, "Registrations").otherwise(F.col("kind"))
    name = F.when(F.col("kind") == "named", F.regexp_extract("t", _LINE_NAMED, 2)).when(F.col("kind") == "object", F.regexp_extract("t", _LINE_CALL, 1)).otherwise(F.regexp_extract("t", _LINE_NAME, 1))
    word = F.regexp_extract("t", r"\b(function|class|interface|type|enum|const|let|var)\b", 1)
    what = F.when(of_call, "registration").when(F.col("kind") == "imports", "import").when(word.isin("const", "let", "var"), "variable").when(word != "", word).otherwise("reexport")
    places = [(F.col("at") + 1).alias("line_start"), (F.col("end") + 1).alias("line_end")]
    top = blocks.where(shown).select(path, section.alias("section"), what.alias("kind"), F.nullif(F.when(F.col("kind") != "imports", name), F.lit("")).alias("name"), (F.col("kind") == "Exports").alias("exported"), text.alias("text"), "source", *places, F.col("at").alias("pos"))
    methods = blocks.select(path, F.lit("method").alias("section"), F.regexp_extract("t", _LINE_CALL, 1).alias("kind"), F.explode("keys.k").alias("name"), F.lit(False).alias("exported"), F.lit(None).cast("string").alias("text"), "source", *places, F.col("at").alias("pos"))
    return top.unionByName(methods.withColumn("text", F.col("name")))


#: What makes a call's block a handler, a description in it, its strings where it
#: is an array, and the lines that name parameters.
HANDLER = r"=>\s*\{|function\s*[({]|async\s*[(]"
DESCRIBED = r"description\s*:\s*(?:\[([^\]]*)\]|['\"`]([^'\"`]{3,}?)['\"`])"
DESCRIBED_PART = r"['\"`]([^'\"`\n]+)['\"`]"
PARAMETER = r"(?m)^[ \t]{6,}(\w+)\s*:"
#: Words before a colon or bracket that are no keys.
_NOT_KEYS = ("async", "function", "return", "if", "for", "const", "let", "var")


def description_of(c: str) -> Column:
    """The text of a `description` key, an array's strings joined; empty without one."""
    strings = F.transform(F.regexp_extract_all(F.regexp_extract(c, DESCRIBED, 1), F.lit(DESCRIBED_PART), F.lit(1)), F.trim)
    said = F.when(F.size(strings) > 0, F.array_join(strings, " ")).otherwise(F.regexp_extract(c, DESCRIBED, 2))
    return F.substring(F.trim(F.regexp_replace(said, r"\s+", " ")), 1, _DESCRIPTION)


def parameters_of(c: str) -> Column:
    """Names before a colon on lines with six blanks or more, the first ten parameters."""
    names = F.regexp_extract_all(F.col(c), F.lit(PARAMETER), F.lit(1))
    return F.slice(F.filter(names, lambda x: ~x.isin(*sorted(_NOT_PARAMS - {"examples", "outputSchema"})) & (F.length(x) <= 40)), 1, _PARAMS)


def read_skeletons(wanted: DataFrame, sources: DataFrame, parsed: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """For every wanted path its skeleton and sizes, with `engine` (scanner, or lines for
    other languages and for files that the scanner cannot close) and `error` (a path without
    a source). By lines, reduction_pct is of characters and methods are not listed."""
    unclosed = parsed.where("section = 'unclosed'").select(path).distinct().withColumn("__open", F.lit(True))
    kinds = sources.select(path).join(unclosed, path, "left").select(path, F.when(language_of(path).isNotNull() & F.col("__open").isNull(), "scanner").otherwise("lines").alias("engine"))
    here = sources.join(wanted.select(path).distinct(), path, "left_semi")
    by_lines = here.join(kinds.where("engine = 'lines'").select(path), path, "left_semi")
    plain = skeletons(by_lines, parse_lines(by_lines, path, content), path, content).withColumns({path: _own(path), "methods": F.array().cast("array<string>"), "reduction_pct": F.col("reduction_chars_pct"), "engine": F.lit("lines")})
    scanned = here.join(kinds.where("engine = 'scanner'").select(path), path, "left_semi")
    both = skeletons(scanned, parsed, path, content).withColumn("engine", F.lit("scanner")).unionByName(plain)
    found = both.withColumn("__found", F.lit(True))
    missing = F.when(F.col("__found").isNull(), F.concat(F.lit("File not found: "), path))
    return wanted.select(path).join(found, path, "left").withColumn("error", missing).drop("__found")


#: Kinds of statements that declare symbols.
SYMBOLS = ("function", "class", "interface", "type", "enum", "variable")


def symbols(parsed: DataFrame, path: str = "path") -> DataFrame:
    """node_id, name, kind, file, line, exported, pos: declared names, each once a file."""
    named = parsed.where(F.col("name").isNotNull() & F.col("kind").isin(*SYMBOLS))
    first = named.groupBy(path, "name").agg(F.min(F.struct("pos", "kind", "line_start", "exported")).alias("m"))
    return first.select(F.concat_ws("::", path, "name").alias("node_id"), "name", "m.kind", F.col(path).alias("file"), F.col("m.line_start").alias("line"), "m.exported", "m.pos")


#: What a line of a skeleton declares, first match first.
LINE_KINDS = (
    ("function", r"^(export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("class", r"^(export\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"^(export\s+)?interface\s+(\w+)"),
    ("type", r"^(export\s+)?type\s+(\w+)\s*="),
    ("variable", r"^(export\s+)?(?:const|let|var)\s+(\w+)"),
)


def symbols_of_lines(texts: DataFrame, key: str, text: str, exported_variables: bool = False) -> DataFrame:
    """key, pos (line, from 0), name, kind, exported from lines of text, by the first kind that
    fits. With exported_variables, the rule of the older index: only exported ones count."""
    rows = texts.select(F.col(key), F.posexplode(lines(text)).alias("pos", "__l")).withColumn("__l", F.trim("__l"))
    name, kind, exported = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for k, pattern in reversed(LINE_KINDS):
        hit = F.col("__l").rlike(pattern)
        name, kind = F.when(hit, F.regexp_extract("__l", pattern, 2)).otherwise(name), F.when(hit, k).otherwise(kind)
        exported = F.when(hit, F.regexp_extract("__l", pattern, 1) != "").otherwise(exported)
    found = rows.select(key, "pos", name.alias("name"), kind.alias("kind"), exported.alias("exported")).where("name IS NOT NULL")
    return found.where("kind <> 'variable' OR exported") if exported_variables else found


#: Words before a bracket that are no calls.
NOT_CALLED = ("function", "if", "for", "while", "switch", "catch", "class")


def calls_of_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), pos, callee: every dotted name before an opening bracket."""
    rows = texts.select(F.col(key), F.posexplode(lines(text)).alias("line", "__l"))
    return rows.select(key, (F.col("line") + 1).alias("line"), F.posexplode(F.regexp_extract_all("__l", F.lit(r"([A-Za-z0-9_$]+(?:\.[A-Za-z0-9_$]+)*)\s*\("), F.lit(1))).alias("pos", "callee")).where(~F.col("callee").isin(*NOT_CALLED))


def callers(events: DataFrame, path: str = "path", closed: bool = False) -> DataFrame:
    """file, caller, nested_caller, callee_raw, line, pos of the calls among the events of
    `scanned`: the top-level and the innermost declaration around each, <module> without one.
    Declarations nest, so a running count of those that are open is a call's depth, and the
    last that opened at that depth is the innermost around it: two windows over a file's
    events, which are shuffled once. With closed, files with an `unclosed` row have no calls."""
    order = [F.col("pos"), F.array_position(F.array(*map(F.lit, EVENTS)), F.col("section"))]
    swept = Window.partitionBy("file").orderBy(*order)
    mark = F.col("section") == "unclosed"
    rows = events.where(is_event() | mark if closed else is_event()).select(F.col(path).alias("file"), "section", "name", F.col("line_start").alias("line"), "pos")
    if closed:
        rows = rows.withColumn("__open", F.max(mark).over(Window.partitionBy("file"))).where("NOT __open").drop("__open")
    step = F.when(F.col("section") == "open", 1).when(F.col("section") == "close", -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(step).over(swept))
    opened = F.when(F.col("section") == "open", F.col("name"))
    top = F.last(F.when(F.col("depth") == 1, opened), True).over(swept)
    inner = F.last(opened, True).over(Window.partitionBy("file", "depth").orderBy(*order))
    named = lambda c: F.when(F.col("depth") > 0, c).otherwise("<module>")
    found = rows.withColumns({"caller": named(top), "nested_caller": named(inner)}).where("section = 'call'")
    return found.select("file", "caller", "nested_caller", F.col("name").alias("callee_raw"), "line", "pos")


#: Fixed value: calls by longer expressions are left out.
LONGEST_CALLEE = 120


def call_sites(sources: DataFrame, events: DataFrame, path: str = "path", content: str = "content", nested: bool = False) -> DataFrame:
    """file, caller, callee_raw, line from sources and what `scanned` gives of them: the caller
    is the top-level declaration around the call, or with nested the innermost one (a variable,
    where the call makes its value), else <module>. Files without a scanner's rows are read by
    lines, and all their calls are the module's."""
    by_lines = sources.select(path).where(language_of(path).isNull()).unionByName(events.where("section = 'unclosed'").select(path)).distinct().hint("merge")
    found = callers(events.where(language_of(path).isNotNull()), path, closed=True)
    shown = calls_of_lines(sources.join(by_lines, path, "left_semi"), path, content)
    rest = shown.select(_own(path).alias("file"), F.lit("<module>").alias("caller"), F.col("callee").alias("callee_raw"), "line")
    sites = found.select("file", F.col("nested_caller" if nested else "caller").alias("caller"), "callee_raw", "line")
    return sites.unionByName(rest).where(F.length("callee_raw") < LONGEST_CALLEE)


IMPORTED = r"(?s)(?:import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?(?:\{[^}]*\}|\*\s+as\s+[\w$]+|[\w$]+)\s+from\s+|import\s+|export\s+(?:\*|\{[^}]*\})\s+from\s+|(?:require|import)\s*\(\s*)['\"]([^'\"]+)['\"]"
#: Fixed value: single-line imports and require() only.
IMPORTED_LINE = r"(?:import\s+.*?\s+from\s+|require\s*\(\s*)['\"]([^'\"]+)['\"]"


def import_specs(sources: DataFrame, path: str = "path", content: str = "content", single_line: bool = False) -> DataFrame:
    """file, pos, spec of every import, in order."""
    return sources.select(F.col(path).alias("file"), F.posexplode(F.regexp_extract_all(F.col(content), F.lit(IMPORTED_LINE if single_line else IMPORTED), F.lit(1))).alias("pos", "spec"))


def import_names(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """file, local_name, orig_name, spec of relative named and default imports."""
    whole = r"import\s+(\{[^}]+\}|[\w$]+)\s+from\s+['\"](\.[^'\"]*)['\"]"
    found = sources.select(F.col(path).alias("file"), F.explode(F.regexp_extract_all(F.col(content), F.lit(whole), F.lit(0))).alias("m"))
    what, spec = F.regexp_extract("m", whole, 1), F.regexp_extract("m", whole, 2)
    each = found.select("file", spec.alias("spec"), F.explode(F.split(F.regexp_replace(what, r"[{}]", ""), ",")).alias("n"), F.startswith(what, F.lit("{")).alias("named")).withColumn("n", F.regexp_replace("n", r"^\s+|\s+$", "")).where("n <> ''")
    parts = F.split("n", r"\s+as\s+")
    return each.select("file", F.element_at(parts, -1).alias("local_name"), F.when(F.col("named"), parts[0]).otherwise("default").alias("orig_name"), "spec")


#: Calls that register methods by an object's keys, and publications by name.
METHODS, PUBLICATION = "Meteor.methods", "Meteor.publish"


def rpc_methods(parsed: DataFrame, path: str = "path") -> DataFrame:
    """name, file of methods that registered objects name, and `publish:` names, in one pass
    over parsed, which may be a scan."""
    method = (F.col("section") == "method") & (F.col("kind") == METHODS)
    published = (F.col("section") == "Registrations") & F.startswith(F.col("text"), F.lit(f"{PUBLICATION}('"))
    return parsed.where(method | published).select(F.when(method, F.col("name")).otherwise(F.concat(F.lit("publish:"), "name")).alias("name"), F.col(path).alias("file"))


#: Strings, brackets, and keys before a colon or a bracket, in text that is no clean source.
_TOKENS = _LINE_STRING + r"|[{}()\[\]]|(?:async\s+)?[\w./-]+(?=\s*[(:])|,"


def rpc_methods_by_pattern(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """name, file by pattern alone, for text that is no clean source: keys of objects given to
    METHODS, and `publish:` names. The tokens after a call are folded with the number of
    brackets that are open: a key is the first token of the object or after a comma with one
    open, whatever stands deeper. What a token is gets worked out once, before the fold, and a
    text is read once for both kinds of names."""
    call = METHODS.replace(".", r"\.")
    blocks = F.slice(F.split(F.col(content), rf"{call}\s*\(\s*(?=\{{)"), 2, 1 << 30)
    start = F.struct(F.lit(0).alias("open"), F.lit(False).alias("next"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("keys"))

    def token(t):
        return F.struct(
            F.when(t.isin("{", "(", "["), 1).when(t.isin("}", ")", "]"), -1).otherwise(0).alias("opens"), t.isin("{", ",").alias("next"),
            F.regexp_replace(F.regexp_replace(t, r"^async\s+", ""), r"^['\"`]|['\"`]$", "").alias("key"),
        )

    def step(s, t):
        opened, key = s["open"] + t["opens"], t["key"]
        takes = s["next"] & (s["open"] == 1) & key.rlike(r"^[\w./:-]+$") & (key != "async")
        now = F.struct(
            opened.alias("open"), ((opened == 1) & (t["next"] | s["next"] & (key == "async"))).alias("next"), (opened == 0).alias("done"),
            F.when(takes, F.array_append(s["keys"], key)).otherwise(s["keys"]).alias("keys"),
        )
        return F.when(s["done"], s).otherwise(now)

    def keys(b):
        return F.aggregate(F.transform(F.regexp_extract_all(b, F.lit(f"({_TOKENS})"), F.lit(1)), token), start, step, lambda s: s["keys"])

    published = F.regexp_extract_all(F.col(content), F.lit(PUBLICATION.replace(".", r"\.") + r"\s*\(\s*['\"]([^'\"]+)['\"]"), F.lit(1))
    names = F.concat(F.flatten(F.transform(blocks, keys)), F.transform(published, lambda n: F.concat(F.lit("publish:"), n)))
    return sources.select(F.explode(names).alias("name"), F.col(path).alias("file"))


#: The lines that declare a NAME.
LINE_FORMS = (
    r"^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+NAME\s*[(<]",
    r"^(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+NAME\s*[{<(]",
    r"^(?:export\s+)?interface\s+NAME\s*[{<]",
    r"^(?:export\s+)?type\s+NAME\s*=",
    r"^(?:export\s+)?(?:const|let|var)\s+NAME\s*[=:]",
    r"^\s{2,6}(?:async\s+)?NAME\s*\(",
    r"^\s*['\"`]NAME['\"`]\s*:",
)


def symbol_source_by_lines(sources: DataFrame, name: str, path: str = "path", content: str = "content") -> DataFrame:
    """path, source, line_start, line_end of the first line that declares the name: a function,
    class, interface, type, variable, a method indented by two to six blanks, or a quoted key.
    It lasts until its braces close; without any, until a later line that ends in `;` or `,`."""
    declares = "|".join(form.replace("NAME", re.escape(name)) for form in LINE_FORMS)
    rows = sources.select(path, F.posexplode(lines(content)).alias("at", "line"))
    file, until = Window.partitionBy(path), Window.partitionBy(path).orderBy("at")
    rows = rows.withColumn("first", F.min(F.when(F.col("line").rlike(declares), F.col("at"))).over(file)).where("at >= first")
    opens, closes = _braces(F.col("line"))
    rows = rows.withColumns({"__o": F.sum(opens).over(until), "__c": F.sum(closes).over(until)})
    ended = (F.col("__o") > 0) & (F.col("__o") == F.col("__c")) | (F.col("__o") == 0) & (F.col("at") > F.col("first")) & F.rtrim("line").rlike("[;,]$")
    rows = rows.withColumn("end", F.min(F.when(ended, F.col("at"))).over(file)).where("end IS NULL OR at <= end")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(path).agg(whole.alias("source"), (F.min("at") + 1).alias("line_start"), (F.max("at") + 1).alias("line_end"))


def symbol_source(sources: DataFrame, name: str, path: str = "path", content: str = "content", parsed: DataFrame | None = None) -> DataFrame:
    """path, source, line_start, line_end, error: a top-level declaration of the name, else a
    registration of it, else the member of a registered object, else what lines show; else
    an error."""
    parsed = with_lines(sources, stored(parse(sources, path, content), "parsed"), path, content) if parsed is None else parsed
    rank = F.when(F.col("section").isin("Types", "Exports", "Module-level", "declared"), 1).when(F.col("section").isin("Registrations", "registered"), 2).otherwise(3)
    best = parsed.where((F.col("name") == name) & ~is_event()).groupBy(path).agg(F.min(F.struct(rank.alias("r"), "pos", "source", "line_start", "line_end")).alias("m"))
    best = stored(best.select(path, "m.source", "m.line_start", "m.line_end"), "best")
    rest = symbol_source_by_lines(sources.join(best.select(path).hint("merge"), path, "left_anti"), name, path, content)
    return sources.select(path).join(best.unionByName(rest).hint("merge"), path, "left").withColumn("error", F.when(F.col("source").isNull(), F.lit(f"Symbol '{name}' not found")))
