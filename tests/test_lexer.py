"""Blanking, declarations and calls of single sources."""

import random

import pytest

from skeinworks.operators import lexer, parse


def found(text, markup=True):
    """(top-level caller, innermost caller, callee) of every call."""
    _, code, _ = lexer.blanked(text, markup)
    around, out = [], []
    for what, name, _, _ in sorted(lexer.events(text, code), key=lambda e: (e[2], parse.EVENTS.index(e[0]))):
        if what == "open":
            around.append(name)
        elif what == "close":
            around.pop()
        else:
            out.append((around[0] if around else None, around[-1] if around else None, name))
    return out


def names(text, markup=True):
    return [r[2] for r in parse.scan(text, markup) if r[0] in ("Exports", "Module-level", "Types", "declared")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("const A = () => <p>it`s</p>;\nclass Z {}", ["A", "Z"]),
        ("const a = <b c='x`' d={`}`}>{`${'}'}`} \"</b>\nclass Z {}", ["a", "Z"]),
        ("const a = <><i/>{/* it's */}<b>don't</b></>;\nlet z", ["a", "z"]),
        ("const f = <T,>(x: T) => x;\nconst g = <T extends X>(x: T) => x;\nlet k = a < b, c = d > e;", ["f", "g", "k", "c"]),
        ("if (ok) /[\"{]/.test(s);\nfunction f() {}\nclass K {}", ["f", "K"]),
        ("while (f(1)) /[{]/.exec(x);\nconst z = (a) / b / c", ["z"]),
        ("export default class extends X {}\nexport default class {}\nexport class Y extends X {}", [None, None, "Y"]),
        ("export const { a, b: [c, { d }], 'e-f': g = h(1), [k]: l, ...rest } = make(), m: Map<string, number> = n, o;", ["a", "c", "d", "g", "l", "rest", "m", "o"]),
        ("const [x, , [y] = f()] = g();\nlet q", ["x", "y", "q"]),
        ("enum E { A = 1 }\ndeclare const v: { a: string };\ntype T = A | B", ["E", "v", "T"]),
    ],
)
def test_names(text, want):
    assert names(text) == want and not [r for r in parse.scan(text) if r[0] == "unclosed"]


@pytest.mark.parametrize("text", ["const a = `x\nclass Z {}", "const a = <p>x\nclass Z {}", "function f() {\n", "const a = `${b`"])
def test_unclosed(text):
    assert [r for r in parse.scan(text) if r[0] == "unclosed"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("// see helper(1)\nconst s = \"helper(2) off\"; /* z(3) */", []),
        ("function f() { const x = g(h(1)); return k(x); }", [("f", "x", "g"), ("f", "x", "h"), ("f", "f", "k")]),
        ("function f() { function g() { return a\n .b(1)\n ?.c(2); } }", [("f", "g", "a\n .b"), ("f", "g", "a\n .b(1)\n ?.c")]),
        ("new Foo(bar(1)).baz(); new A(); super(x); import('y')", [(None, None, "new Foo(bar(1)).baz"), (None, None, "bar"), (None, None, "super"), (None, None, "import")]),
        ("gen<Map<string, A[]>>(1); f!(2); a?.(3); t`x`; a < b(4)", [(None, None, c) for c in ("gen", "f!", "a", "t", "b")]),
        ("class A extends mixin(B) { async m<T>(a: T): Promise<{ b: c }> { await this.n(a); } get x() { return y(); }\n o(a: string): void;\n p = q(1); }", [("A", "A", c) for c in ("mixin", "this.n", "y", "q")]),
        ("const o = { m(a) { r(a); }, f: function () { t(); }, async g() { u(); }, h: b ? v(1) : w(2) };", [("o", "o", c) for c in "rtuvw"]),
        ("interface I { m(a): void; n(b: { c(): void }): x }\ntype T = { z(a): b };\nfunction ov(a): { b: c };\nfunction ov(a) { d(); }", [("ov", "ov", "d")]),
        ("for (const x of rows()) step(x); for (let i = a(); i < 3; i++) {} switch (k(1)) { case m(2): n(3) }", [(None, None, "rows"), (None, None, "step"), (None, "i", "a"), (None, None, "k"), (None, None, "m"), (None, None, "n")]),
        ("const a = async (x) => x, b = async function () { c(); }, d = async(e);", [("a", "a", "c"), ("a", "a", "async")]),
        ("const s = `${sub(1)} x(2) ${ { k: f(`${g()}`) }.k }`", [("s", "s", c) for c in ("sub", "f", "g")]),
        ("const V = () => <a b={c(1)} d='e(2)'>f(3) {g(4)} <H i={() => j(5)}/></a>;", [("V", "V", c) for c in "cgj"]),
        ("@Input() class A { @Out(b()) c; d() {} }", [(None, None, "Input"), ("A", "A", "Out"), ("A", "A", "b")]),
        ("call(b)(c); (function () { i(); })(); [1, 2].map(f); 'a'.at(1); /x/.test(y);", [(None, None, c) for c in ("call", "call(b)", "(function () { i(); })", "i", "[1, 2].map", "'a'.at", "/x/.test")]),
    ],
)
def test_calls(text, want):
    got = [(t if t else None, i if i else None, c) for t, i, c in found(text)]
    assert sorted(got, key=str) == sorted([(i if t is None and i else t, i, c) for t, i, c in want], key=str)


def test_any_text_keeps_lengths_and_nests():
    rnd = random.Random(2)
    bits = ["`", "${", "}", "{", "/", "'", '"', "\\", "\n", "a", " ", "//", "/*", "*/", "=", "(", ")", "<", ">", "</", "/>", "<b>", "</b>", "function f", "const x", "class A ", "[", "]", ";", ",", ".", "?.", "if (", "new ", "=>", ": "]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        bare, code, _ = lexer.blanked(text)
        lines = [i for i, c in enumerate(text) if c == "\n"]
        assert len(bare) == len(code) == len(text)
        assert [i for i, c in enumerate(bare) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"] == lines
        parse.read(text)
        around = []
        for start, end, _, _ in sorted(lexer.declarations(code, lexer.partners(code)[0])):
            around = [e for e in around if e > start]
            assert start < end and (not around or end <= around[-1])
            around.append(end)
