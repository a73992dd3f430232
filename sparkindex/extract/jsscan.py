"""JavaScript, TypeScript and TSX sources: a lexer and a walk over bracketed tokens.

Known gaps against a full grammar: how text is read after a syntax error, calls inside
object types of annotations, and line ends that only a full parser can tell apart.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from sparkindex.extract import Found, one_line

_SPACE = re.compile(r"(?:[ \t\f\v\r\n﻿\xa0  ]+|//[^\r\n]*|/\*.*?(?:\*/|\Z)|\A#![^\r\n]*)+", re.S)
_NAME = re.compile(r"[#@]?[^\W\d][\w$]*|\$[\w$]*|[$_][\w$]*")
_IDENTIFIER = re.compile(r"(?:[^\W\d]|\$)[\w$]*")
_NUMBER = re.compile(r"\.?\d(?:[eE][+-]\d|[\w.])*")
_STRING = re.compile(r'"(?:[^"\\\r\n]|\\(?:\r\n|.))*+"?|\'(?:[^\'\\\r\n]|\\(?:\r\n|.))*+\'?', re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*")
_PUNCTUATION = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|===|!==|==|!=|<=|>>>=|>>=|<<=|\+\+|--|[-+*/%&|^]=|[^\s\w]")
_JSX_OPEN = re.compile(r"<(?:>|[A-Za-z_$])")
_JSX_NAME = re.compile(r"[\w$.:-]+")

_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof "
    "new null return super switch this throw true try typeof var void while with yield await".split()
)
_BEFORE_VALUE = frozenset("return typeof void delete in of instanceof case throw new yield await else do extends default".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())
_CONTINUES = frozenset(". ?. ( [ ` , ; : ? => = == === != !== + - * / % ** & | ^ && || ?? < > <= >= << ) ] } += -= *= /= in instanceof as satisfies".split())
_VALUE_STARTERS = frozenset("= ( , [ => ? && || ?? ! ~ + - * / % & | ^ < > : return typeof void new delete in of instanceof await yield case throw == === != !== += -= ... ${".split())


class Token(NamedTuple):
    kind: str  # name, private, number, string, regex, op, tag, text
    text: str
    line: int
    start: int
    end: int
    fresh: bool  # first on its line


class _Lexer:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx, self.out = text, jsx, []
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def put(self, kind: str, start: int, end: int, text: str | None = None) -> None:
        line = self.line(start)
        fresh = not self.out or self.line(self.out[-1].end - 1) < line
        self.out.append(Token(kind, self.text[start:end] if text is None else text, line, start, end, fresh))

    def ends_value(self) -> bool:
        if not self.out:
            return False
        t = self.out[-1]
        if t.kind == "name":
            return t.text not in _BEFORE_VALUE or (len(self.out) > 1 and self.out[-2].text in (".", "?."))
        return t.kind in ("private", "number", "string", "regex", "text") or t.text in (")", "]", "`")

    def code(self, at: int, closing: bool = False) -> int:
        """Tokens from here on; if closing, up to the brace that ends this piece."""
        text, depth = self.text, 0
        while at < len(text):
            m = _SPACE.match(text, at)
            if m:
                at = m.end()
                continue
            c = text[at]
            if c in "\"'":
                m = _STRING.match(text, at)
                self.put("string", at, m.end())
                at = m.end()
            elif c == "`":
                at = self.template(at)
            elif c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
                m = _NUMBER.match(text, at)
                self.put("number", at, m.end())
                at = m.end()
            elif c == "#" and (m := _IDENTIFIER.match(text, at + 1)):
                self.put("private", at, m.end())
                at = m.end()
            elif m := _IDENTIFIER.match(text, at):
                self.put("name", at, m.end())
                at = m.end()
            elif c == "/" and not self.ends_value() and (m := _REGEX.match(text, at)):
                self.put("regex", at, m.end())
                at = m.end()
            elif c == "<" and self.jsx and not self.ends_value() and _JSX_OPEN.match(text, at):
                at = self.element(at)
            else:
                m = _PUNCTUATION.match(text, at)
                if m is None:
                    at += 1
                    continue
                if closing and c == "}" and not depth:
                    return at
                depth += (c == "{") - (c == "}")
                self.put("op", at, m.end())
                at = m.end()
        return at

    def template(self, at: int) -> int:
        start, text = at, self.text
        self.put("op", at, at + 1)
        at += 1
        while at < len(text) and text[at] != "`":
            if text[at] == "\\":
                at += 2
            elif text.startswith("${", at):
                self.put("op", at, at + 2)
                at = self.code(at + 2, closing=True)
                if at < len(text):
                    self.put("op", at, at + 1)
                at += 1
            else:
                at += 1
        at = min(at + 1, len(text))
        self.out.append(Token("text", "`", self.line(start), start, at, False))
        return at

    def element(self, at: int) -> int:
        """A JSX element: component names become tags, braces hold code."""
        text, begin = self.text, at
        at += 1
        m = _JSX_NAME.match(text, at)
        if m:
            name = m[0].rsplit(".", 1)[-1]
            if re.match("[A-Z]", name) and ":" not in name and "-" not in name:
                self.put("tag", m.end() - len(name), m.end())
            at = m.end()
        open_ = True
        while at < len(text) and open_:  # attributes
            c = text[at]
            if c in "\"'":
                end = text.find(c, at + 1)
                at = len(text) if end < 0 else end + 1
            elif c == "{":
                at = self.braces(at)
            elif c == "/" and text.startswith("/>", at):
                self.out.append(Token("text", "/>", self.line(begin), begin, at + 2, False))
                return at + 2
            elif c == ">":
                open_ = False
                at += 1
            else:
                at += 1
        while at < len(text):  # children
            c = text[at]
            if c == "{":
                at = self.braces(at)
            elif c == "<":
                if text.startswith("</", at):
                    end = text.find(">", at)
                    at = len(text) if end < 0 else end + 1
                    break
                at = self.element(at) if _JSX_OPEN.match(text, at) else at + 1
            else:
                at += 1
        self.out.append(Token("text", "/>", self.line(begin), begin, at, False))
        return at

    def braces(self, at: int) -> int:
        self.put("op", at, at + 1)
        at = self.code(at + 1, closing=True)
        if at < len(self.text):
            self.put("op", at, at + 1)
        return at + 1


class _Walker:
    def __init__(self, text: str, language: str):
        self.text, self.typed, self.found = text, language != "javascript", Found()
        lexer = _Lexer(text, language in ("javascript", "tsx"))
        lexer.code(0)
        self.toks = lexer.out
        self.match = self.brackets()

    def brackets(self) -> list[int]:
        """For each opening bracket where its partner is; an unclosed one ends with the text."""
        n = len(self.toks)
        match, stack = [n] * n, []
        for k, t in enumerate(self.toks):
            if t.kind != "op":
                continue
            if t.text in ("(", "[", "{", "${"):
                stack.append(k)
            elif t.text in _PAIRS:
                want = _PAIRS[t.text]
                for back in range(len(stack) - 1, -1, -1):
                    opened = self.toks[stack[back]].text
                    if opened == want or (opened == "${" and t.text == "}"):
                        match[stack[back]] = k
                        del stack[back:]
                        break
        return match

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.toks) and self.toks[k].kind in ("op", "name") and self.toks[k].text in texts

    def name(self, k: int) -> bool:
        return k < len(self.toks) and self.toks[k].kind == "name" and self.toks[k].text not in _WORDS

    def last_line(self, k: int) -> int:
        """The line on which token k ends."""
        t = self.toks[min(k, len(self.toks) - 1)]
        return t.line + self.text.count("\n", t.start, t.end) if t.kind in ("text", "string") else t.line

    def piece(self, a: int, b: int) -> str | None:
        """The source from token a up to token b, on one line."""
        end = self.toks[b].start if b < len(self.toks) else len(self.text)
        return one_line(self.text[self.toks[a].start : end]) or None

    def ref(self, k: int) -> None:
        self.found.references.add((self.toks[k].text, self.toks[k].line))

    def angle(self, k: int) -> int | None:
        """After the type parameters or arguments that open at k, if they are such."""
        depth, n = 0, len(self.toks)
        while k < n:
            t = self.toks[k]
            if t.kind == "op":
                if t.text == "<":
                    depth += 1
                elif t.text in (">", ">>", ">>>"):
                    depth -= len(t.text)
                    if depth <= 0:
                        return k + 1
                elif t.text in ("(", "[", "{"):
                    k = self.match[k]
                elif t.text not in (".", ",", "|", "&", "?", ":", "=", "=>", "-", "..."):
                    return None
            k += 1
        return None

    def type_end(self, k: int, end: int, body: bool = False) -> int:
        """Where the type that starts at k ends; if body, a brace after it is a body."""
        start = True
        while k < end:
            t = self.toks[k]
            if t.kind == "op":
                if t.text in (";", ",", ")", "]", "}", "="):
                    return k
                if t.text == "{":
                    if not start:
                        return k
                    k = self.match[k]
                    start = False
                elif t.text in ("(", "["):
                    k = self.match[k]
                    start = False
                elif t.text == "<":
                    k = (self.angle(k) or k + 1) - 1
                    start = False
                elif t.text == "=>" and body and not start and self.toks[k - 1].text != ")":
                    return k
                else:
                    start = t.text in ("|", "&", "=>", "?", ":")
            else:
                if t.fresh and not start and not body and t.text not in ("extends", "is", "keyof"):
                    return k
                start = t.text in ("extends", "is", "keyof", "typeof", "readonly", "infer", "asserts", "unique")
            k += 1
        return k

    def value_end(self, k: int, end: int) -> int:
        """Where the expression that starts at k ends."""
        first = k
        while k < end:
            t = self.toks[k]
            if t.kind == "op" and t.text in (",", ";", ")", "]", "}"):
                return k
            if t.fresh and k > first and t.kind != "text":
                before = self.toks[k - 1]
                ends = before.kind in ("number", "string", "regex", "text", "private") or before.text in (")", "]", "}", "`", "++", "--") or (before.kind == "name" and before.text not in _BEFORE_VALUE)
                if ends and not (t.kind in ("op", "name") and t.text in _CONTINUES):
                    return k
            if t.kind == "op" and t.text in ("(", "[", "{", "${"):
                k = self.match[k]
            k += 1
        return min(k, end)

    def arrow(self, k: int, end: int) -> int | None:
        """Where the arrow is, if an arrow function starts at k."""
        if self.is_(k, "async") and k + 1 < end and not self.toks[k + 1].fresh and not self.is_(k + 1, "=>"):
            k += 1
        if self.name(k) and self.is_(k + 1, "=>"):
            return k + 1
        if self.is_(k, "<") and self.typed:
            after = self.angle(k)
            if after is None:
                return None
            k = after
        if not self.is_(k, "("):
            return None
        k = self.match[k] + 1
        if self.is_(k, ":"):
            k = self.type_end(k + 1, end, body=True)
        return k if self.is_(k, "=>") else None

    def function_at(self, k: int) -> int | None:
        """Where the keyword is, if a function expression starts at k."""
        if self.is_(k, "function"):
            return k
        return k + 1 if self.is_(k, "async") and self.is_(k + 1, "function") and not self.toks[k + 1].fresh else None

    def arrow_body(self, at: int, end: int, scope: tuple, binding: str | None) -> tuple[int, int]:
        """Walk the body of the arrow at `at`; where it starts and what follows it."""
        inner = (*scope, binding) if binding else scope
        body = at + 1
        after = min(self.match[body] + 1, end) if self.is_(body, "{") else self.value_end(body, end)
        self.walk(body, after, inner, True)
        return body, after

    def function(self, at: int, end: int, scope: tuple, start: int, mode: str, binding: str | None = None) -> tuple[int, int]:
        """The function whose keyword is at `at`; mode is declaration, expression or
        default. Returns where its body starts and what follows it."""
        k = at + 1
        if self.is_(k, "*"):
            k += 1
        own = None
        if k < end and self.toks[k].kind == "name" and not self.is_(k, "(") and self.toks[k].text not in ("extends",):
            own = self.toks[k].text
            k += 1
        if self.is_(k, "<"):
            k = self.angle(k) or k + 1
        if not self.is_(k, "("):
            return k, k
        close = self.match[k]
        self.walk(k + 1, min(close, end), scope, True)
        k = close + 1
        if self.is_(k, ":"):
            k = self.type_end(k + 1, end, body=True)
        if not self.is_(k, "{") or self.match[k] >= len(self.toks):
            return k, k  # a signature only, or broken
        after = self.match[k] + 1
        if mode == "declaration" and own is not None:
            self.found.add(own, scope, "function", self.toks[start].line, self.last_line(after - 1), self.piece(start, k))
        elif mode == "default":
            self.found.add(own or "default", (), "function", self.toks[start].line, self.last_line(after - 1), self.piece(start, k))
        named = own or (binding if mode != "declaration" else None)
        self.walk(k + 1, after - 1, (*scope, named) if named else scope, True)
        return k, after

    def klass(self, at: int, end: int, scope: tuple, in_function: bool, mode: str, binding: str | None = None, hidden: bool = False) -> int:
        """The class whose keyword is at `at`; what follows it. A hidden class makes no
        symbol and no scope."""
        k, own = at + 1, None
        if self.name(k) and not self.is_(k, "implements"):
            own = self.toks[k].text
            k += 1
        if self.is_(k, "<"):
            k = self.angle(k) or k + 1
        while k < end and not self.is_(k, "{"):
            if self.is_(k, "extends"):
                k += 1
                first = k
                while k + 2 < end and self.is_(k + 1, ".") and self.toks[k + 2].kind == "name":
                    k += 2
                if self.name(k) or (k > first and self.toks[k].kind == "name"):
                    if not self.is_(k + 1, "("):
                        self.ref(k)
                else:
                    k -= 1
                k += 1
                if self.is_(k, "<"):
                    k = self.angle(k) or k + 1
                elif self.is_(k, "("):
                    stop = k
                    while stop < end and self.is_(stop, "(", "."):
                        stop = self.match[stop] + 1 if self.is_(stop, "(") else stop + 2
                    self.walk(first, min(stop, end), scope, in_function)
                    k = stop
            elif self.is_(k, "implements"):
                k += 1
                while k < end and not self.is_(k, "{"):
                    if self.name(k) and not self.is_(k + 1, "<", ".") and not self.is_(k - 1, "."):
                        self.ref(k)
                    k = (self.angle(k) or k + 1) if self.is_(k, "<") else k + 1
            else:
                k += 1
        if k >= end or self.match[k] >= len(self.toks):
            return k + 1
        after = self.match[k] + 1
        if not hidden:
            if mode == "declaration" and own is not None:
                self.found.add(own, scope, "class", self.toks[at].line, self.last_line(after - 1), self.piece(at, k))
            elif mode == "default":
                self.found.add(own or "default", (), "class", self.toks[at].line, self.last_line(after - 1), self.piece(at, k))
            scope = (*scope, own or binding or "default")
        self.members(k + 1, after - 1, scope, in_function)
        return after

    def members(self, k: int, end: int, scope: tuple, in_function: bool) -> None:
        while k < end:
            if self.is_(k, ";", ","):
                k += 1
                continue
            if self.is_(k, "@"):
                k = self.decorator(k, end, scope, in_function)
                continue
            start = k
            while k + 1 < end and (self.is_(k, "*") or (self.is_(k, *_MODIFIERS) and not self.is_(k + 1, "(", "=", ";", ":", "?", "!", "}", "<", ","))) and (self.is_(k, "*") or not self.toks[k + 1].fresh or self.is_(k, "async", "static")):
                k += 1
            if self.is_(k, "{"):  # a static block
                self.walk(k + 1, min(self.match[k], end), scope, in_function)
                k = self.match[k] + 1
                continue
            own = self.toks[k].text if self.toks[k].kind == "name" else None
            if self.is_(k, "["):
                self.walk(k + 1, min(self.match[k], end), scope, in_function)
                k = self.match[k]
            k += 1
            if self.is_(k, "?", "!"):
                k += 1
            if self.is_(k, "<"):
                k = self.angle(k) or k + 1
            if self.is_(k, "("):
                close = self.match[k]
                self.walk(k + 1, min(close, end), scope, True)
                k = close + 1
                if self.is_(k, ":"):
                    k = self.type_end(k + 1, end, body=True)
                if self.is_(k, "{") and self.match[k] <= end:
                    after = self.match[k] + 1
                    if own is not None:
                        self.found.add(own, scope, "method", self.toks[start].line, self.last_line(after - 1), self.piece(start, k))
                    self.walk(k + 1, after - 1, (*scope, own) if own else scope, True)
                    k = after
                continue
            if self.is_(k, ":"):
                k = self.type_end(k + 1, end)
            if self.is_(k, "="):
                k = self.bound(k + 1, end, scope, in_function, own, start, "field")
            elif own is not None and k > start:
                self.found.add(own, scope, "const", self.toks[start].line, self.last_line(k - 1), None)

    def bound(self, k: int, end: int, scope: tuple, in_function: bool, own: str | None, start: int, what: str) -> int:
        """A value bound to a name (own is None for a pattern), from k on."""
        arrow, function = self.arrow(k, end), self.function_at(k)
        at = len(self.found.symbols)
        if arrow is not None and own is not None:
            body, after = self.arrow_body(arrow, end, scope, own)
            self.walk(k, arrow, scope, True)
        elif function is not None and own is not None:
            body, after = self.function(function, end, scope, k, "expression", own)
            after = max(after, self.value_end(k, end)) if self.is_(after, "(", ".") else after
        else:
            after = self.value_end(k, end)
            broken = any(self.match[x] >= len(self.toks) for x in range(k, after) if self.is_(x, "(", "[", "{", "${"))
            if own is not None and (what == "field" or not in_function) and not broken:
                self.found.add(own, scope, "const", self.toks[start].line, self.last_line(after - 1), None)
            if self.is_(k, "class"):
                self.walk(self.klass(k, after, scope, in_function, "expression", own), after, scope, in_function)
            else:
                self.walk(k, after, scope, in_function)
            return after
        if body >= len(self.toks) or (self.is_(body, "{") and self.match[body] >= len(self.toks)):
            return after
        if self.is_(after, "(", ".") and what != "field":  # called at once: no function is bound
            after = self.value_end(after, end)
        kind = "method" if what == "field" else "function"
        begin = start if what == "field" else self.declared
        self.found.symbols.insert(at, (own, ".".join((*scope, own)), kind, self.toks[begin].line, self.last_line(after - 1), self.piece(begin, body), ".".join(scope) or None))
        return after

    def variables(self, at: int, end: int, scope: tuple, in_function: bool) -> int:
        """The declaration whose const, let or var is at `at`."""
        k = at + 1
        while k < end:
            own, start = None, k
            if self.is_(k, "{", "["):
                self.walk(k + 1, min(self.match[k], end), scope, in_function)
                k = self.match[k] + 1
            elif self.toks[k].kind == "name" and self.toks[k].text not in _WORDS:
                own = self.toks[k].text
                k += 1
            else:
                return k
            if self.is_(k, "!"):
                k += 1
            if self.is_(k, ":") and self.typed:
                k = self.type_end(k + 1, end)
            if self.is_(k, "of", "in"):
                return k
            if self.is_(k, "="):
                outer, self.declared = self.declared, at
                k = self.bound(k + 1, end, scope, in_function, own, start, "variable")
                self.declared = outer
            elif own is not None and not in_function:
                self.found.add(own, scope, "const", self.toks[start].line, self.last_line(k - 1), None)
            if not self.is_(k, ","):
                return k
            k += 1
        return k

    declared = 0

    def decorator(self, k: int, end: int, scope: tuple, in_function: bool) -> int:
        k += 1
        if k < end and self.toks[k].kind == "name":
            while k + 2 < end and self.is_(k + 1, ".") and self.toks[k + 2].kind == "name":
                k += 2
            self.ref(k)
            k += 1
        if self.is_(k, "("):
            self.walk(k + 1, min(self.match[k], end), scope, in_function)
            k = self.match[k] + 1
        return k

    def module(self, k: int, end: int) -> tuple[str | None, int]:
        """The string after `from` at k, and what follows."""
        if self.is_(k, "from") and k + 1 < end and self.toks[k + 1].kind == "string":
            return self.toks[k + 1].text.strip("\"'"), k + 2
        return None, k

    def specifiers(self, k: int) -> list[tuple[int, str, str]]:
        """(token, exported, local) of each name in the braces at k."""
        out, at, close = [], k + 1, self.match[k]
        while at < min(close, len(self.toks)):
            if self.is_(at, "type") and at + 1 < close and self.toks[at + 1].kind in ("name", "string") and not self.is_(at + 1, "as"):
                at += 1
            if self.toks[at].kind in ("name", "string"):
                own = self.toks[at].text.strip("\"'")
                if self.is_(at + 1, "as") and at + 2 < close:
                    out.append((at, own, self.toks[at + 2].text.strip("\"'")))
                    at += 2
                else:
                    out.append((at, own, own))
            at += 1
        return out

    def imports(self, at: int, end: int, in_function: bool) -> int:
        k, names = at + 1, []
        if k < end and self.toks[k].kind == "string":
            return k + 1
        if self.is_(k, "type") and not self.is_(k + 1, "from", ",", "="):
            k += 1
        while k < end and not (self.is_(k, "from") and k + 1 < end and self.toks[k + 1].kind == "string"):
            if self.is_(k, "{"):
                names += [(local, exported) for _, exported, local in self.specifiers(k)]
                k = self.match[k]
            elif self.is_(k, "*") and self.is_(k + 1, "as") and k + 2 < end:
                names.append((self.toks[k + 2].text, "*"))
                k += 2
            elif self.name(k):
                names.append((self.toks[k].text, "default"))
            elif not self.is_(k, ","):
                return k + 1
            k += 1
        module, k = self.module(k, end)
        if self.is_(k, "with", "assert") and self.is_(k + 1, "{"):
            k = self.match[k + 1] + 1
        if module is not None and not in_function:
            last = self.last_line(k if self.is_(k, ";") else k - 1)
            for local, exported in names:
                self.found.add(local, (), "import", self.toks[at].line, last, f"{module}:{exported}")
        return k

    def exports(self, at: int, end: int, scope: tuple, in_function: bool) -> int:
        k = at + 1
        if self.is_(k, "type") and self.is_(k + 1, "{", "*"):
            k += 1
        if self.is_(k, "*"):
            k += 1
            if self.is_(k, "as"):
                k += 2
            return self.module(k, end)[1]
        if self.is_(k, "{"):
            names = self.specifiers(k)
            module, after = self.module(self.match[k] + 1, end)
            last = self.last_line(after if self.is_(after, ";") else after - 1)
            for token, exported, local in names if not in_function else []:
                if module is not None:
                    self.found.add(local, (), "import", self.toks[at].line, last, f"{module}:{exported}")
                elif self.toks[token].kind == "name":
                    self.ref(token)
            return after
        if not self.is_(k, "default"):
            return k
        k += 1
        function, arrow = self.function_at(k), self.arrow(k, end)
        if self.is_(k, "@"):
            while self.is_(k, "@"):
                k = self.decorator(k, end, scope, in_function)
        if function is not None:
            named = function + 1 + self.is_(function + 1, "*")
            mode = "declaration" if self.name(named) else "expression" if in_function else "default"
            return max(self.function(function, end, scope, k, mode)[1], function + 1)
        if self.is_(k, "class"):
            mode = "declaration" if self.name(k + 1) and not self.is_(k + 1, "implements") else "expression" if in_function else "default"
            return self.klass(k, end, scope, in_function, mode)
        if arrow is not None:
            self.walk(k, arrow, scope, True)
            body, after = self.arrow_body(arrow, end, scope, None)
            if not in_function:
                self.found.add("default", (), "function", self.toks[k].line, self.last_line(after - 1), self.piece(k, body))
            return after
        if self.name(k) and self.value_end(k, end) == k + 1 and not in_function:
            self.ref(k)
            return k + 1
        return k

    def starts_statement(self, k: int) -> bool:
        before = self.toks[k - 1] if k else None
        return before is None or self.toks[k].fresh or before.text in (";", "{", "}", ")", "export", "declare", "default")

    def walk(self, k: int, end: int, scope: tuple, in_function: bool) -> None:
        """Everything between two tokens; functions and classes inside walk their bodies."""
        end = min(end, len(self.toks))
        while k < end:
            t = self.toks[k]
            dotted = k > 0 and self.is_(k - 1, ".", "?.")
            if t.kind == "tag":
                self.ref(k)
            elif t.kind == "name" and not dotted:
                word, begin = t.text, k
                if word == "import" and not self.is_(k + 1, "(", "."):
                    k = max(self.imports(k, end, in_function), begin + 1)
                    continue
                if word == "export":
                    k = max(self.exports(k, end, scope, in_function), begin + 1)
                    continue
                if word == "function" and not self.is_(k + 1, ":", ",", "="):
                    start = k - 1 if self.is_(k - 1, "async") and not t.fresh else k
                    before = self.toks[start - 1] if start else None
                    value = before is not None and before.kind in ("op", "name") and before.text in _VALUE_STARTERS
                    k = max(self.function(k, end, scope, start, "expression" if value else "declaration")[1], begin + 1)
                    continue
                if word == "class" and not self.is_(k + 1, ":", ",", "=", ")"):
                    before = self.toks[k - 1] if k else None
                    value = before is not None and before.kind in ("op", "name") and before.text in _VALUE_STARTERS
                    hidden = self.typed and self.is_(k - 1, "abstract")
                    k = max(self.klass(k, end, scope, in_function, "expression" if value else "declaration", hidden=hidden), begin + 1)
                    continue
                if word in ("const", "let", "var") and not self.is_(k + 1, "enum", ":", ",", "=", ")", ".") and k + 1 < end:
                    k = max(self.variables(k, end, scope, in_function), begin + 1)
                    continue
                if self.typed and word == "interface" and self.name(k + 1) and self.starts_statement(k):
                    while k < end and not self.is_(k, "{"):
                        k = (self.angle(k) or k + 1) if self.is_(k, "<") else k + 1
                    k = self.match[k] + 1 if k < end else k
                    continue
                if self.typed and word == "type" and self.name(k + 1) and self.is_(k + 2, "=", "<") and self.starts_statement(k):
                    k += 2
                    if self.is_(k, "<"):
                        k = self.angle(k) or k + 1
                    k = max(self.type_end(k + 1, end), begin + 1)
                    continue
                if word == "new":
                    last = k + 1
                    while last + 2 < end and self.is_(last + 1, ".") and self.toks[last + 2].kind == "name":
                        last += 2
                    if self.name(last) or (last > k + 1 and self.toks[last].kind == "name"):
                        self.ref(last)
                        k = last + 1
                        if self.typed and self.is_(k, "<") and (after := self.angle(k)) is not None:
                            k = after
                        continue
                elif self.name(k):
                    after = self.callee(k, end)
                    if after is not None and self.is_(after, "(") and self.is_(k - 1, "{", ",", "async", "get", "set", "*") and not (self.toks[after].fresh):
                        close = self.match[after]
                        body = close + 1
                        if self.typed and self.is_(body, ":"):
                            body = self.type_end(body + 1, end, body=True)
                        if self.is_(body, "{") and not self.toks[body].fresh and self.match[body] < len(self.toks):
                            start = k
                            while self.is_(start - 1, "async", "get", "set", "*"):
                                start -= 1
                            stop = self.match[body] + 1
                            self.found.add(word, scope, "method", self.toks[start].line, self.last_line(stop - 1), self.piece(start, body))
                            self.walk(after + 1, close, scope, True)
                            self.walk(body + 1, stop - 1, (*scope, word), True)
                            k = stop
                            continue
                    if after is not None and not (word == "async" and self.arrow(k, len(self.toks)) is not None):
                        self.ref(k)
            elif t.kind == "name" and self.callee(k, end) is not None:
                self.ref(k)
            elif t.kind == "op" and t.text == "@" and k + 1 < end and self.toks[k + 1].kind == "name":
                k = self.decorator(k, end, scope, in_function)
                continue
            elif t.kind == "op" and t.text == "=>":
                k = max(self.arrow_body(k, end, scope, None)[1], k + 1)
                continue
            k += 1

    def callee(self, k: int, end: int) -> int | None:
        """Where the arguments are, if the name at k is called."""
        after = k + 1
        if self.is_(after, "?.") and self.is_(after + 1, "("):
            after += 1
        if self.typed and self.is_(after, "<"):
            closed = self.angle(after)
            if closed is None or not self.is_(closed, "("):
                return None
            after = closed
        return after if after < end and self.is_(after, "(", "`") else None


def scan(source: bytes, language: str) -> tuple[list[tuple], list[tuple[str, int]]]:
    """Symbols and references of a JavaScript, TypeScript or TSX file."""
    walker = None
    try:
        walker = _Walker(source.decode("utf-8", errors="replace"), language)
        walker.walk(0, len(walker.toks), (), False)
    except RecursionError:  # nested beyond reason: keep what was found
        pass
    return walker.found.ordered() if walker is not None else ([], [])
