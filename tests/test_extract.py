"""Scanners against hand-written expectations, and against the ast of valid Python."""

from __future__ import annotations

import ast
import glob
import os

import pytest

from sparkindex.extract import extract

CASES = [
    ("python", "class A:\n  def f(self): pass\n  x: int\ny += 1\na, b = 1, 2\nc = d = 3\n", [("A", "class", 1, 3), ("A.f", "method", 2, 2), ("A.x", "const", 3, 3), ("c", "const", 6, 6)], []),
    ("python", "def f():\n    import os\n    x = 1\n    def g(): return h()\n", [("f", "function", 1, 4), ("f.g", "function", 4, 4)], [("h", 4)]),
    ("python", "@a.b\n@c(1)\nclass X(B, m.C, metaclass=M, Generic[T]): z = 1\n", [("X", "class", 3, 3), ("X.z", "const", 3, 3)], [("b", 1), ("c", 2), ("B", 3), ("C", 3)]),
    ("python", "from __future__ import annotations\nfrom .a import (b,\n  c as d)\nimport x.y as z, w\nfrom q import *\n", [("b", "import", 2, 3), ("d", "import", 2, 3), ("w", "import", 4, 4), ("z", "import", 4, 4)], []),
    ("python", "if a: x = 1\nelse: x = 2\ntry:\n  y = f'{g(1)} {{h(2)}}'\nfinally:\n  pass\n", [("x", "const", 1, 1), ("y", "const", 4, 4)], [("g", 4)]),
    ("python", "def broken(\n  a, b\ndef fine():\n  return 1\n", [("fine", "function", 3, 4)], []),
    ("python", "x = lambda a: b(a)\nfoo()()\nbar[0]()\nq.w.e()\nprint (1)\nif (x): pass\n", [("x", "const", 1, 1)], [("b", 1), ("foo", 2), ("e", 4), ("print", 5)]),
    ("python", "", [], []),
    ("javascript", "const o = { m(a) { return n(a); }, async k() {} };\nfunction f() { const x = 1; let g = () => h(); }\n", [("o", "const", 1, 1), ("m", "method", 1, 1), ("k", "method", 1, 1), ("f", "function", 2, 2), ("f.g", "function", 2, 2)], [("n", 1), ("h", 2)]),
    ("typescript", "abstract class A { abstract f(): void; g(): void { this.h(); } #p = 1; ['x']() {} }\n", [("g", "method", 1, 1)], [("h", 1)]),
    ("typescript", "let a = 1, b = function named() { return c(); }, d: string;\nfor (const e of f()) {}\n", [("a", "const", 1, 1), ("b", "function", 1, 1), ("d", "const", 1, 1)], [("c", 1), ("f", 2)]),
    ("typescript", "import a, * as b from './m'\nimport type { C } from \"n\";\nimport './side';\nexport * from './o';\nexport default async (x) => y(x);\n", [("a", "import", 1, 1), ("b", "import", 1, 1), ("C", "import", 2, 2), ("default", "function", 5, 5)], [("y", 5)]),
    ("typescript", "const r = /[/]\"'/g.test(s) / 2;\nconst t = `a ${b(`${c()}`)} d`;\ntag`x`;\nnew ns.Klass<T>(z());\nobj?.call?.();\n", [("r", "const", 1, 1), ("t", "const", 2, 2)], [("test", 1), ("b", 2), ("c", 2), ("tag", 3), ("Klass", 4), ("z", 4), ("call", 5)]),
    ("tsx", "const V = () => <A b={c()}>it's {d()} <E.F/> <div>g()</div></A>;\n", [("V", "function", 1, 1)], [("A", 1), ("F", 1), ("c", 1), ("d", 1)]),
    ("javascript", "class {", [], []),
]


@pytest.mark.parametrize("language,source,symbols,references", CASES)
def test_cases(language, source, symbols, references):
    found, refs = extract(source.encode(), language)
    assert [(s[1], s[2], s[3], s[4]) for s in found] == sorted(symbols, key=lambda s: (s[2], s[0]))
    assert refs == sorted(references, key=lambda r: (r[1], r[0]))


def test_unknown_language():
    with pytest.raises(ValueError):
        extract(b"", "cobol")


def test_never_fails():
    junk = [b"\xff\xfe(((", b"def f(:\n\t x ='", b"class \x00 {`${", b"<A <B {(", "é".encode("utf-16"), b"(" * 5000, b"`${" * 3000, b"<a>" * 3000, b"{" * 20000]
    for source in junk:
        for language in ("python", "javascript", "typescript", "tsx"):
            extract(source, language)


class Reference(ast.NodeVisitor):
    """Definitions and calls as the standard parser sees them."""

    def __init__(self):
        self.scope, self.defs, self.calls = [], set(), set()

    def definition(self, node):
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if self.scope and self.scope[-1][0] == "class" else "function"
        self.defs.add((".".join([*(n for _, n in self.scope), node.name]), kind, node.lineno, node.end_lineno))
        self.scope.append(("class" if kind == "class" else "function", node.name))
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = definition

    def visit_Call(self, node):
        if isinstance(node.func, ast.Name):
            self.calls.add((node.func.id, node.func.lineno))
        elif isinstance(node.func, ast.Attribute):
            self.calls.add((node.func.attr, node.func.end_lineno))
        self.generic_visit(node)


@pytest.mark.parametrize("path", sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:60])
def test_agrees_with_the_standard_parser(path):
    with open(path, "rb") as file:
        source = file.read()
    seen = Reference()
    seen.visit(ast.parse(source))
    symbols, refs = extract(source, "python")
    assert {(s[1], s[2], s[3], s[4]) for s in symbols if s[2] in ("function", "class", "method")} == seen.defs
    assert seen.calls <= set(refs)
