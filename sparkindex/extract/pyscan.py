"""Python sources: a lexer, logical lines, and a stack of indented definitions.

Known gaps against a full grammar: how text is read after a syntax error, quotes of the
same kind nested inside an f-string, and comments that end a block are not counted to it.
"""

from __future__ import annotations

import keyword
import re
from typing import NamedTuple

from sparkindex.extract import Found, one_line

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\f\v﻿]+|\\(?:\r\n|\r|\n))
    |(?P<comment>\#[^\r\n]*)
    |(?P<newline>\r\n|\r|\n)
    |(?P<string>(?i:[rbuft]{0,2})(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*+(?:\"\"\"|\Z)|'''(?:[^\\']|\\.|'(?!''))*+(?:'''|\Z)
        |"(?:[^\\"\r\n]|\\(?:\r\n|.))*+"?|'(?:[^\\'\r\n]|\\(?:\r\n|.))*+'?))
    |(?P<number>\.?\d(?:[eE][+-]|[\w.])*)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>:=|->|\.\.\.|\*\*=?|//=?|<<=?|>>=?|[-+*/%@&|^=!<>]=|[^\s\w])""",
    re.X | re.S,
)
_WORDS = frozenset(keyword.kwlist)
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_RESTART = re.compile(r"[ \t]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*[(\[]|class[ \t]+\w+[ \t]*[(:\[]|@\w|import[ \t]+\w|from[ \t]+[.\w]+[ \t]+import\b)")
_HEADS = frozenset("if elif else for while with try except finally match case async".split())


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int
    last: int  # the line on which it ends


def tokens(text: str, line: int = 1) -> list[list[Token]]:
    """Logical lines. A line that clearly starts anew ends brackets left open."""
    lines: list[list[Token]] = []
    current: list[Token] = []
    depth, at = 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        kind, piece = m.lastgroup or "op", m[0]
        first, at = line, m.end()
        if kind != "name" and kind != "op":
            line += piece.count("\n") + piece.count("\r") - piece.count("\r\n")
        if kind == "newline":
            if depth and not _RESTART.match(text, at):
                continue
            depth = 0
            if current:
                lines.append(current)
                current = []
        elif kind not in ("blank", "comment"):
            if kind == "op":
                depth = depth + 1 if piece in _OPEN else max(0, depth - 1) if piece in _CLOSE else depth
            current.append(Token(kind, piece, first, m.start(), at, line))
    if current:
        lines.append(current)
    return lines


def _fields(token: Token):
    """The expressions inside an f-string, as (text, line)."""
    quote = min(k for k in (token.text.find('"'), token.text.find("'")) if k >= 0)
    if not {"f", "t"} & set(token.text[:quote].lower()):
        return
    body, at = token.text[quote:], 0
    while (at := body.find("{", at)) >= 0:
        if body[at + 1 : at + 2] == "{":
            at += 2
            continue
        depth, end = 1, at + 1
        while end < len(body) and depth:
            depth += {"{": 1, "}": -1}.get(body[end], 0)
            end += 1
        yield body[at + 1 : end - 1], token.line + body.count("\n", 0, at)
        at = end


def _calls(line: list[Token], found: Found) -> None:
    """Names that are called, wherever in the line."""
    for k, t in enumerate(line):
        if t.kind == "string":
            for text, at in _fields(t):
                for inner in tokens("(" + text + ")", at):
                    _calls(inner, found)
        if t.kind != "name" or k + 1 >= len(line) or line[k + 1].text != "(":
            continue
        before = line[k - 1].text if k else ""
        if before in ("def", "class") or (t.text in _WORDS and before != "."):
            continue
        if before == "." and k > 1 and line[k - 2].kind == "op" and line[k - 2].text not in (")", "]", "}", "..."):
            continue
        found.references.add((t.text, t.line))


def _name_of(part: list[Token]) -> Token | None:
    """The last name, if the tokens are a name or a chain of attributes."""
    if not part or part[-1].kind != "name" or part[-1].text in _WORDS:
        return None
    if len(part) == 1:
        return part[0]
    return part[-1] if part[-2].text == "." and len(part) > 2 and "=" not in [t.text for t in part] and all(t.text not in (",", ":=", "*", "**") or d for t, d in zip(part, _depths(part), strict=True)) else None


def _depths(part: list[Token]) -> list[int]:
    depth, out = 0, []
    for t in part:
        depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "op" else 0
        out.append(depth)
    return out


def _split(part: list[Token], by: str) -> list[list[Token]]:
    """The parts between separators outside all brackets."""
    out: list[list[Token]] = [[]]
    for t, depth in zip(part, _depths(part), strict=True):
        if not depth and t.kind == "op" and t.text == by:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _colon(line: list[Token]) -> int | None:
    """Where a compound statement's header ends."""
    lambdas = 0
    for k, (t, depth) in enumerate(zip(line, _depths(line), strict=True)):
        if depth:
            continue
        if t.text == "lambda" and t.kind == "name":
            lambdas += 1
        elif t.text == ":" and t.kind == "op":
            if not lambdas:
                return k
            lambdas -= 1
    return None


class _Frame:
    """An open definition: its indentation, and what is known of its symbol."""

    def __init__(self, indent: int, is_class: bool, name: str, header: list[Token], at: int):
        self.indent, self.is_class, self.name, self.header, self.at = indent, is_class, name, header, at
        self.body: int | None = None
        self.last = header[-1].last


class _Scanner:
    def __init__(self, text: str):
        self.text, self.found, self.frames = text, Found(), []

    def scope(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.frames)

    def in_function(self) -> bool:
        return any(not f.is_class for f in self.frames)

    def column(self, token: Token) -> int:
        start = max(self.text.rfind("\n", 0, token.start), self.text.rfind("\r", 0, token.start)) + 1
        return len(self.text[start : token.start].expandtabs(8))

    def close(self) -> None:
        frame = self.frames.pop()
        first = frame.header[0]
        end = frame.body if frame.body is not None else frame.header[-1].end
        signature = one_line(self.text[first.start : end]).rstrip(":") or None
        kind = "class" if frame.is_class else "method" if self.frames and self.frames[-1].is_class else "function"
        scope = self.scope()
        self.found.symbols[frame.at] = (frame.name, ".".join((*scope, frame.name)), kind, first.line, frame.last, signature, ".".join(scope) or None)

    def run(self) -> Found:
        for line in tokens(self.text):
            indent = self.column(line[0])
            while self.frames and indent <= self.frames[-1].indent:
                self.close()
            self.statement(line, indent)
        while self.frames:
            self.close()
        self.found.symbols = [s for s in self.found.symbols if s is not None]
        return self.found

    def statement(self, line: list[Token], indent: int) -> None:
        _calls(line, self.found)
        for frame in self.frames:
            frame.last = max(frame.last, line[-1].last)
            if frame.body is None:
                frame.body = line[0].start
        self.simple_or_compound(line, indent)

    def simple_or_compound(self, line: list[Token], indent: int) -> None:
        head = line[0].text if line[0].kind == "name" else ""
        nth = 1 if head == "async" and len(line) > 1 else 0
        if head in ("def", "class") or (nth and line[1].text == "def"):
            self.definition(line, indent, nth)
        elif line[0].text == "@" and line[0].kind == "op":
            name = _name_of(line[1:])
            if name is not None:
                self.found.references.add((name.text, name.line))
        elif head in _HEADS and (at := _colon(line)) is not None and (head not in ("match", "case") or at > 1):
            if line[at + 1 :]:
                self.simple_or_compound(line[at + 1 :], indent)
        else:
            for part in _split(line, ";"):
                if part:
                    self.simple(part)

    def definition(self, line: list[Token], indent: int, nth: int) -> None:
        at = _colon(line)
        if at is None or len(line) < nth + 2 or line[nth + 1].kind != "name":
            return
        header, rest = line[: at + 1], line[at + 1 :]
        is_class = line[nth].text == "class"
        if is_class:
            for k, t in enumerate(header):
                if t.text == "(" and t.kind == "op":
                    for part in _split(header[k + 1 : -2], ","):
                        base = _name_of(part)
                        if base is not None:
                            self.found.references.add((base.text, base.line))
                    break
                if t.text == "[":
                    depths = _depths(header[k:])
                    if 0 in depths and header[k + depths.index(0) + 1].text == "(":
                        for part in _split(header[k + depths.index(0) + 2 : -2], ","):
                            base = _name_of(part)
                            if base is not None:
                                self.found.references.add((base.text, base.line))
                    break
        frame = _Frame(indent, is_class, line[nth + 1].text, header, len(self.found.symbols))
        self.found.symbols.append(None)
        self.frames.append(frame)
        if rest:
            frame.body, frame.last = rest[0].start, max(frame.last, rest[-1].last)
            for part in _split(rest, ";"):
                if part:
                    self.simple(part)
            self.close()

    def simple(self, part: list[Token]) -> None:
        first = part[0]
        if self.in_function() or first.kind != "name":
            return
        if first.text == "import":
            self.imports(part)
        elif first.text == "from":
            self.imports_from(part)
        elif first.text not in _WORDS and len(part) > 1 and part[1].kind == "op" and part[1].text in ("=", ":"):
            if part[1].text == ":" and len(part) < 3:
                return
            self.found.add(first.text, self.scope(), "const", first.line, part[-1].last, None)

    def imports(self, part: list[Token]) -> None:
        for item in _split(part[1:], ","):
            words = [t.text for t in item]
            if not words or item[0].kind != "name":
                continue
            target, _, alias = "".join(f" {w} " if w == "as" else w for w in words).partition(" as ")
            self.found.add(alias or target, self.scope(), "import", part[0].line, part[-1].last, target)

    def imports_from(self, part: list[Token]) -> None:
        at = next((k for k, t in enumerate(part) if t.text == "import" and t.kind == "name"), None)
        if at is None:
            return
        module = "".join(t.text for t in part[1:at])
        if module == "__future__":
            return
        rest = part[at + 1 :]
        if rest and rest[0].text == "(":
            rest = rest[1:-1] if rest[-1].text == ")" else rest[1:]
        for item in _split(rest, ","):
            if not item or item[0].kind != "name":
                continue
            name = item[0].text
            alias = item[2].text if len(item) > 2 and item[1].text == "as" else name
            target = module + name if not module or module.endswith(".") else f"{module}.{name}"
            self.found.add(alias, self.scope(), "import", part[0].line, part[-1].last, target)


def scan(source: bytes) -> tuple[list[tuple], list[tuple[str, int]]]:
    """Symbols and references of a Python file; a const keeps its first binding only."""
    found = _Scanner(source.decode("utf-8", errors="replace")).run()
    symbols, references = found.ordered()
    bound: set[str] = set()
    kept = []
    for symbol in symbols:
        if symbol[2] == "const":
            if symbol[1] in bound:
                continue
            bound.add(symbol[1])
        kept.append(symbol)
    return kept, references
