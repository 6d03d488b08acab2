"""Text of one source file without what hides brackets, its declarations and its calls.

A stack of states (code, template, tag of markup, children of markup) reads a file once. Code
inside templates and markup is code again, to any depth; a slash begins a regular expression
where an operand has to come, also after the condition of `if`, `while`, `for` and `with`.
From the brackets that are left come the bounds of declarations at any depth and every call
with the whole expression that is called. Spark does the rest (see operators.parse).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

NAME = r"[A-Za-z_$][\w$]*"
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRING = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_CODE = re.compile(rf"{_COMMENT}|{_STRING}|[`(){{}}/<]", re.S)
_TEMPLATE = re.compile(r"(?:\\(?:.|\Z)|\$(?!\{)|[^`\\$]++)*+(`|\$\{|\Z)", re.S)
_TAG = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|/\*.*?(?:\*/|\Z)|=>|/>|[{>]|\Z", re.S)
_CHILDREN = re.compile(r"[{<]|\Z")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: What stands before a slash that begins a regular expression, or before markup.
_BEFORE_OPERAND = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|instanceof|do|else|await|yield|default))\s*$")
_CONDITION = re.compile(r"(?<![\w$.])(?:if|while|for|with|for\s+await)\s*$")
_OPENS_TAG = re.compile(rf"<(?:>|{NAME}(?:[.:-][\w$]+)*(?=[\s/>])(?!\s+extends\b))")


_VISIBLE = re.compile(r"[^\n]")


def _blank(text: str) -> str:
    return _VISIBLE.sub(" ", text) if "\n" in text else " " * len(text)


class _Frame:
    __slots__ = ("kind", "depth", "conditions")

    def __init__(self, kind: str) -> None:
        self.kind, self.depth, self.conditions = kind, 0, []


def blanked(text: str, markup: bool = True) -> tuple[str, str, bool]:
    """text with the insides of comments, strings, regular expressions, templates and markup
    blanked, lengths kept: first with the code in templates and markup blanked too, then with it
    kept; and whether every template and element is closed. An element of markup shows as a
    template."""
    bare, full, before, at = [], [], "", 0
    frames = [_Frame("code")]

    def put(plain: str, shown: str | None = None) -> None:
        if plain:
            shown = plain if shown is None else shown
            full.append(shown)
            bare.append(shown if len(frames) == 1 else _blank(plain))

    def leave() -> None:
        nonlocal before
        frames.pop()
        before = "`"

    while True:
        frame = frames[-1]
        if frame.kind == "code":
            m = _CODE.search(text, at)
            if not m:
                put(text[at:])
                break
            plain, found = text[at : m.start()], m[0]
            put(plain)
            before = (before + plain)[-40:]
            at, shown, mark = m.end(), found, found[-1]
            if found[0] == "/" and found != "/":
                put(found, _blank(found))
                continue  # a comment does not part what stands around it
            if found == "`":
                put(found)
                frames.append(_Frame("template"))
                continue
            if found == "(":
                # Only the last letters of the words that may stand here are worth a look.
                frame.conditions.append(before.rstrip()[-1:] in tuple("frhet") and bool(_CONDITION.search(before)))
            elif found == ")":
                mark = ";" if frame.conditions and frame.conditions.pop() else ")"
            elif found == "{":
                frame.depth += 1
            elif found == "}":
                if not frame.depth and len(frames) > 1:
                    put(found)
                    leave()
                    continue
                frame.depth = max(0, frame.depth - 1)
            elif found == "/":
                r = _REGEX.match(text, m.start()) if _BEFORE_OPERAND.search(before) else None
                if r:
                    found, at = r[0], r.end()
                    shown = "/" + _blank(found[1:-1]) + "/"
            elif found == "<":
                t = _OPENS_TAG.match(text, m.start()) if markup and _BEFORE_OPERAND.search(before) else None
                if t:
                    put(t[0], "`" + _blank(t[0][1:]))
                    frames.append(_Frame("children" if t[0] == "<>" else "tag"))
                    at = t.end()
                    continue
            else:
                closed = len(found) > 1 and found[-1] == found[0]
                shown = found[0] + _blank(found[1:-1]) + found[-1] if closed else found[0] + _blank(found[1:])
            put(found, shown)
            before = (before + mark)[-40:]
            continue
        m = {"template": _TEMPLATE.match, "tag": _TAG.search, "children": _CHILDREN.search}[frame.kind](text, at)
        stop, start = (m[1], m.start(1)) if frame.kind == "template" else (m[0], m.start())
        put(text[at:start], _blank(text[at:start]))
        at = m.end()
        if stop in ("${", "{"):
            put(stop, " {"[-len(stop) :])
            frames.append(_Frame("code"))
            before = "{"
        elif not stop:
            break  # the end of the file
        elif frame.kind == "template":
            leave()
            put(stop)
        elif frame.kind == "tag":
            if stop == ">":
                frame.kind = "children"
                put(stop, " ")
            elif stop == "/>":
                leave()
                put(stop, " `" if frames[-1].kind == "code" else "  ")
            else:
                put(stop, _blank(stop))
        elif text.startswith("</", start):
            end = text.find(">", start) + 1 or len(text)
            leave()
            shut = "`" if frames[-1].kind == "code" and text[end - 1] == ">" else _blank(text[end - 1])
            put(text[start:end], _blank(text[start : end - 1]) + shut)
            at = end
        elif t := _OPENS_TAG.match(text, start):
            put(t[0], _blank(t[0]))
            frames.append(_Frame("children" if t[0] == "<>" else "tag"))
            at = t.end()
        else:
            put(stop, " ")
    return "".join(bare), "".join(full), len(frames) == 1


_BRACKET = re.compile(r"[()\[\]{}]")
_OPENER = {")": "(", "]": "[", "}": "{"}


def partners(code: str) -> tuple[dict[int, int], dict[int, int]]:
    """Where each bracket is closed, and where each closing one was opened. One that fits none
    that is open closes nothing."""
    to, back, stack = {}, {}, []
    for m in _BRACKET.finditer(code):
        c, at = m[0], m.start()
        if c in "([{":
            stack.append((c, at))
        elif stack and stack[-1][0] == _OPENER[c]:
            _, opened = stack.pop()
            to[opened], back[at] = at, opened
    return to, back


# --- declarations -------------------------------------------------------------------------

_DECLARES = re.compile(rf"(?<![\w$.#])(?:(function)\b\s*\*?\s*(?={NAME})|(class|interface)\s+(?!extends\b|implements\b)(?={NAME})|(const|let|var)\s*(?:(?<=\s)(?!enum\b)(?={NAME})|(?=[{{\[])))")
_WORD = re.compile(NAME)
_MODIFIERS = re.compile(r"(?:\b(?:export|default|declare|abstract|async)\s*)*\Z")
_LAST_WORD = re.compile(r"[\w$]+\Z")
_OPERAND_NEXT = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "await", "yield", "extends"}
_HEAD = re.compile(r"[(\[{<>;]")
_ENDS = re.compile(r"[(\[{)\]};\n]")
_LINE_GOES_ON, _NEXT_LINE_GOES_ON = re.compile(r"(?:[=,({\[.&|+\-*/%<:?!]|=>)\s*\Z"), re.compile(r"\s*(?:[.?:=,)&|+*/%<>\-\[(`{]|in\b|of\b|instanceof\b|as\b|satisfies\b)")


def bound_names(code: str, at: int, to: dict[int, int]) -> tuple[list[str], int]:
    """The names that the identifier or pattern at `at` binds, and where it ends."""
    while at < len(code) and code[at].isspace():
        at += 1
    if at >= len(code) or code[at] not in "{[" or at not in to:
        m = _WORD.match(code, at)
        return ([m[0]], m.end()) if m else ([], at)
    end, keyed, names = to[at], code[at] == "{", []
    at += 1
    while at < end:
        if code[at] in " \t\r\n,.":
            at += 1
            continue
        if keyed and (k := re.compile(rf"(?:{NAME}|[\"'][^\"']*[\"']|[\d.]+)\s*:|\[").match(code, at)):
            at = code.find(":", to.get(at, at)) + 1 if k[0] == "[" else k.end()
            if not at:
                break
        found, after = bound_names(code, at, to)
        names += found
        at = max(after, at + 1)
        while at < end and code[at] != ",":  # a default
            at = to.get(at, at) + 1
    return names, end + 1


def _statement_position(code: str, at: int) -> str:
    """The character before a word and its modifiers; `=` where an operand has to come."""
    head = code[max(0, at - 80) : at].rstrip()
    head = head[: _MODIFIERS.search(head).start()].rstrip()
    word = _LAST_WORD.search(head)
    return "=" if word and word[0] in _OPERAND_NEXT else head[-1:]


def _body_at(code: str, at: int, to: dict[int, int]) -> int:
    """The brace that opens the body of what is declared at `at`; -1 for one without."""
    angle = 0
    while m := _HEAD.search(code, at):
        c, p = m[0], m.start()
        if c == ";" and not angle:
            return -1
        if c == "{" and not angle and code[:p].rstrip()[-1:] not in (":", "|", "&", ","):
            return p
        if c in "<>":
            angle = max(0, angle + (c == "<") - (c == ">" and code[p - 1] not in "=-"))
        at = to.get(p, p) + 1
    return -1


def variable_end(code: str, at: int, to: dict[int, int]) -> int:
    """Where the statement of a variable ends."""
    start = at
    while m := _ENDS.search(code, at):
        c, p = m[0], m.start()
        if c == ";":
            return p + 1
        if c in ")]}":
            return p
        if c == "\n" and not _NEXT_LINE_GOES_ON.match(code, p) and not _LINE_GOES_ON.search(code[max(start, p - 40) : p]):
            return p
        at = to.get(p, p) + 1
    return len(code)


def declarations(code: str, to: dict[int, int]) -> Iterator[tuple[int, int, str, str]]:
    """start, end, kind and name of functions, classes, interfaces and variables, wherever they
    are declared; they nest, and none cuts another. A pattern has the name that it binds first."""
    for m in _DECLARES.finditer(code):
        kind, where = m[m.lastindex], _statement_position(code, m.start())
        if m[3]:
            end = variable_end(code, m.end(), to)
            if where == "(" and code[end - 1 : end] != ";":
                continue  # for (const x of rows)
            names, _ = bound_names(code, m.end(), to)
            if names:
                yield m.start(), end, "variable", names[0]
        elif not where or where not in "=([,:?&|!+-*/<>%^~":
            name = _WORD.match(code, m.end())
            body = _body_at(code, name.end(), to)
            if body >= 0 and body in to:
                yield m.start(), to[body] + 1, kind, name[0]


# --- calls --------------------------------------------------------------------------------

_CALLED = re.compile(r"(?<=[\w$)\]>!.])\s*\(|(?<=[\w$)\]])`")
_NO_CALLEE = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "yield", "void", "delete", "in", "of", "instanceof", "case", "do", "else", "throw", "new", "function", "constructor"}
_MEMBER_MODIFIERS = re.compile(r"(?:\b(?:public|private|protected|static|abstract|override|readonly|async|get|set|declare)\s+|\*\s*|#)*\Z")
_AFTER = re.compile(r"\s*(=>|.|\Z)", re.S)


def _skip_back(code: str, at: int) -> int:
    while at >= 0 and code[at].isspace():
        at -= 1
    return at


def _callee_start(code: str, at: int, back: dict[int, int]) -> int:
    """Where the expression starts whose last character is at `at`; at + 1 for none."""
    start = at + 1
    while at >= 0:
        c = code[at]
        if c in ")]" and at in back:
            group, start = True, back[at]
        elif c.isalnum() or c in "_$#":
            group = False
            while at >= 0 and (code[at].isalnum() or code[at] in "_$#"):
                at -= 1
            start = at + 1
        elif c in "\"'`/":  # a literal, its inside blank
            group, start = False, max(0, code.rfind(c, 0, at))
        elif c == "!" and at and (code[at - 1].isalnum() or code[at - 1] in "_$)]"):
            at -= 1
            continue
        else:
            return start
        k = _skip_back(code, start - 1)
        if k > 0 and code[k] == "." and code[k - 1] != ".":
            at = _skip_back(code, k - 2 if code[k - 1] == "?" else k - 1)
        elif group and k >= 0 and (code[k].isalnum() or code[k] in "_$)]"):
            word = _LAST_WORD.search(code[max(0, k - 20) : k + 1])
            if word and word[0] in _NO_CALLEE:
                return start
            at = k
        else:
            return start
    return start


def _angle(code: str, at: int) -> int:
    """Where the list of types opens that `>` at `at` closes; -1 if it is none."""
    depth = 0
    for k in range(at, max(-1, at - 400), -1):
        c = code[k]
        if c == ">" and code[k - 1] not in "=-":
            depth += 1
        elif c == "<":
            depth -= 1
            if not depth:
                return k if k and (code[k - 1].isalnum() or code[k - 1] in "_$") else -1
        elif c in ";+*/%^~":
            return -1
    return -1


def calls(code: str, to: dict[int, int], back: dict[int, int]) -> Iterator[tuple[int, int]]:
    """start and end of every expression that is called: names, members, results of calls, tags
    of templates; no declarations, no constructors after `new`, no words of the language."""
    for m in _CALLED.finditer(code):
        at = m.end() - 1
        last = m.start() - 1
        if code[last] == ".":
            if code[last - 1 : last] != "?":
                continue
            last -= 2  # f?.(x)
        if code[at] == "(" and at not in to:
            continue
        if code[last] == ">":  # f<T>(x)
            opened = _angle(code, last) if code[last - 1] not in "=-" else -1
            if opened < 0:
                continue
            last = opened - 1
        start = _callee_start(code, last, back)
        if start > last:
            continue
        head = code[max(0, start - 80) : start].rstrip()
        word = _LAST_WORD.search(head)
        word = word[0] if word and head[-len(word[0]) - 1 : -len(word[0])] not in (".", "#") else ""
        callee = code[start : last + 1]
        if word == "function" or head.endswith("function*") or callee in _NO_CALLEE:
            continue
        if word == "new":
            if "(" not in callee:
                continue
            start = code.rfind("new", 0, start)
        if callee[0] in "([" and not callee[1:].strip("()[] \n") or callee[0].isdigit():
            continue
        if code[at] == "(" and word != "extends":
            after = _AFTER.match(code, to[at] + 1)[1]
            if callee == "async" and after in ("=>", ":"):
                continue
            if re.fullmatch(rf"#?{NAME}|\[.*\]|[\"'].*[\"']|{NAME}<.*>", callee, re.S):
                if after == "{" and not head.endswith("@"):
                    continue  # a method with its body
                if after == ":":
                    before = head[: _MEMBER_MODIFIERS.search(head + " ").start()].rstrip()
                    new_line = "\n" in code[start - (start - len(code[:start].rstrip())) : start]
                    if before[-1:] in ("{", "}", ";", ",") or not before or new_line and before[-1:] not in tuple("?:=([&|+-*/<>%!"):
                        continue  # a method with the type of its result
        yield start, last + 1


def events(text: str, code: str) -> Iterator[tuple[str, str, int, int]]:
    """what (open, close, call), name, place and line (from 1): bounds of declarations, and
    calls by the text that is called. Interfaces hold no calls."""
    to, back = partners(code)
    ends = [m.start() for m in re.finditer("\n", text)]
    types: list[tuple[int, int]] = []
    for start, end, kind, name in declarations(code, to):
        line = bisect_right(ends, start - 1) + 1
        yield "open", name, start, line
        yield "close", name, end, line
        if kind == "interface":
            types.append((start, end))
    types += [(m.start(), to[m.end() - 1]) for m in re.finditer(rf"(?<![\w$.])type\s+{NAME}[^={{;]*=\s*\{{", code) if m.end() - 1 in to]
    types.sort()
    firsts = [a for a, _ in types]
    for start, end in calls(code, to, back):
        k = bisect_right(firsts, start) - 1
        if k >= 0 and start < types[k][1]:
            continue
        yield "call", text[start:end].strip(), start, bisect_right(ends, start - 1) + 1
