"""Parser of the text language: a precedence climber over a token list, giving nested tuples.

Nodes: (kind, ...). A lambda is ("lambda", names, body); ``.x > 1`` is a lambda of one hidden argument.
"""

from __future__ import annotations

import re
from typing import Any

#: Operators from weakest to strongest. Fixed values.
LEVELS = (("??",), ("||",), ("&&",), ("==", "!="), (">", "<", ">=", "<="), ("isa",), ("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%"), ("**",))
STRENGTH = {op: k for k, ops in enumerate(LEVELS) for op in ops}
THIS = "$this"

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)
    |(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?)
    |(?P<heredoc><<[+-]?([A-Z]+)[ ]*\n(.*?)\n[ \t]*\4(?![A-Za-z]))
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)
    |(?P<single>'(?:\\.|[^'\\])*')
    |(?P<double>")
    |(?P<op>\?\?|\?\.|\|\||&&|==|!=|>=|<=|=>|\*\*|\.\.\.|[-+*/%<>!~&|^.,:;?@()\[\]{}=])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v"}


class ParseError(ValueError):
    pass


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x.strip("u{}"), 16)) if x[0] == "u" and len(x) > 1 else _ESCAPES.get(x, x)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|.)", one, s, flags=re.S)


def tokens(text: str) -> list[tuple[str, Any, int, bool]]:
    """(kind, value, place, begins a line)"""
    out, at, fresh = [], 0, True
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        kind, start, at = m.lastgroup, at, m.end()
        if m["space"] is not None:
            fresh = fresh or "\n" in m["space"]
            continue
        if m["heredoc"] is not None:
            kind, value = "string", _dedented(m[5])
        elif kind == "number":
            value = _number(m[0])
        elif kind == "single":
            kind, value = "string", _unescape(m[0][1:-1])
        elif kind == "double":
            kind, value, at = _template(text, at)
        else:
            value = m[0]
        out.append((kind, value, start, fresh))
        fresh = False
    return [*out, ("end", None, at, True)]


def _dedented(s: str) -> str:
    lines = s.split("\n")
    depth = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[depth:] for x in lines)


def _number(s: str) -> int | float:
    s = s.replace("_", "")
    if s[:2].lower() in ("0x", "0b", "0o"):
        return int(s, 0)
    return float(s) if re.search(r"[.eE]", s) else int(s)


def _template(text: str, at: int) -> tuple[str, Any, int]:
    """A double-quoted string; ``#{...}`` parts are parsed as expressions."""
    parts, held = [], ""
    while at < len(text):
        c = text[at]
        if c == '"':
            if held or not parts:
                parts.append(_unescape(held))
            return ("string", parts[0], at + 1) if len(parts) == 1 and isinstance(parts[0], str) else ("template", parts, at + 1)
        if c == "\\":
            held, at = held + text[at : at + 2], at + 2
        elif text.startswith("#{", at):
            depth, end = 1, at + 2
            while end < len(text) and depth:
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            if held:
                parts.append(_unescape(held))
            parts.append(parse(text[at + 2 : end - 1]))
            held, at = "", end
        else:
            held, at = held + c, at + 1
    raise ParseError("a string does not end")


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    @property
    def now(self):
        return self.tokens[self.at]

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def sees(self, *values: str) -> bool:
        return self.now[0] in ("op", "name") and self.now[1] in values

    def accept(self, value: str) -> bool:
        if self.sees(value):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise ParseError(f"expected {value!r} at {self.now[2]}, got {self.now[1]!r}")

    def name(self) -> str:
        kind, value, place, _ = self.take()
        if kind != "name":
            raise ParseError(f"expected a name at {place}")
        return value

    def query(self):
        body = self.block("end")
        if self.now[0] != "end":
            raise ParseError(f"unexpected {self.now[1]!r} at {self.now[2]}")
        return body

    def block(self, closing: str):
        """Statements; the value is that of the last, which must be an expression."""
        out = []
        while not (self.now[0] == "end" if closing == "end" else self.sees(closing)):
            if self.sees("let"):
                self.take()
                n = self.name()
                if self.accept(":"):
                    while not self.sees("="):
                        self.take()
                self.expect("=")
                out.append(("let", n, self.expression()))
            else:
                out.append(("do", self.expression()))
            while self.accept(";"):
                pass
        if not out or out[-1][0] != "do":
            raise ParseError("a block must end with an expression")
        return out[0][1] if len(out) == 1 else ("block", out)

    def is_lambda(self) -> bool:
        """After ``(``: names, ``)`` and ``=>``."""
        k, depth = self.at, 0
        while self.tokens[k][0] != "end":
            v = self.tokens[k][1] if self.tokens[k][0] == "op" else None
            depth += (v == "(") - (v == ")")
            k += 1
            if depth == 0:
                return self.tokens[k][:2] == ("op", "=>")
        return False

    def expression(self, least: int = 0):
        if self.now[0] == "name" and self.tokens[self.at + 1][:2] == ("op", "=>"):
            names = [self.name()]
            self.take()
            return ("lambda", names, self.expression())
        if self.sees("(") and self.is_lambda():
            self.take()
            names = []
            while not self.accept(")"):
                self.accept("...")
                names.append(self.name())
                self.accept(",")
            self.expect("=>")
            return ("lambda", names, self.expression())
        short = self.sees(".") and least == 0
        out = self.climb(self.unary(), least)
        return ("lambda", [THIS], out) if short else out

    def climb(self, left, least: int):
        while self.now[0] in ("op", "name") and (level := STRENGTH.get(self.now[1], -1)) >= least:
            if self.now[1] == "-" and self.now[3]:  # a minus on a new line begins a statement
                break
            op = self.take()[1]
            if op == "isa":
                left = ("isa", left, self.name())
                continue
            right = self.climb(self.unary(), level + (op != "**"))
            left = ("op", op, left, right)
        return left

    def unary(self):
        for op in ("!", "-", "~"):
            if self.accept(op):
                return ("unary", op, self.unary())
        return self.chain(self.atom())

    def arguments(self, closing: str) -> list:
        out = []
        while not self.accept(closing):
            out.append(self.expression())
            if not self.sees(closing):
                self.expect(",")
        return out

    def chain(self, left):
        while True:
            fresh = self.now[3]
            if self.accept("?."):
                if self.accept("["):
                    left = ("at", left, self.arguments("]")[0], True)
                elif self.accept("("):
                    left = ("call", left, self.arguments(")"))
                else:
                    left = ("get", left, self.name(), True)
            elif self.accept("."):
                left = ("get", left, self.name(), False)
            elif not fresh and self.accept("("):
                left = ("call", left, self.arguments(")"))
            elif not fresh and self.accept("["):
                left = ("at", left, self.arguments("]")[0], False)
            elif not fresh and self.sees("!") and self.tokens[self.at + 1][1] != "=":
                self.take()
                left = ("bang", left)
            elif not fresh and self.sees("{"):
                self.take()
                left = ("project", left, self.fields())
            else:
                return left

    def fields(self) -> list:
        """Of a projection: name, name: expression, or name { fields }."""
        out = []
        while not self.accept("}"):
            if self.accept("*"):
                out.append(("*", None))
            else:
                n = self.now[1] if self.now[0] == "string" else None
                n = self.take()[1] if n is not None else self.name()
                if self.accept(":"):
                    out.append((n, self.expression()))
                elif self.sees("{"):
                    self.take()
                    out.append((n, ("lambda", [THIS], ("project", ("get", ("var", THIS), n, True), self.fields()))))
                else:
                    out.append((n, ("lambda", [THIS], ("get", ("var", THIS), n, True))))
            self.accept(",")
        return out

    def atom(self):
        kind, value, place, _ = self.take()
        if kind in ("number", "string"):
            return ("lit", value)
        if kind == "template":
            return ("template", value)
        if kind == "name":
            if value in ("null", "true", "false"):
                return ("lit", {"null": None, "true": True, "false": False}[value])
            if value == "if":
                self.expect("(")
                test = self.expression()
                self.expect(")")
                yes = self.expression()
                no = self.expression() if self.accept("else") else ("lit", None)
                return ("if", test, yes, no)
            if value == "at" and self.sees("("):
                self.take()
                when = self.expression()
                self.expect(")")
                return ("as_of", when, self.expression())
            return ("var", value)
        if value == ".":
            if self.accept("["):
                return ("at", ("var", THIS), self.arguments("]")[0], False)
            return ("get", ("var", THIS), self.name(), False)
        if value == "(":
            items = self.arguments(")")
            return items[0] if len(items) == 1 else ("array", items)
        if value == "[":
            return ("array", self.arguments("]"))
        if value == "{":
            return self.braces()
        raise ParseError(f"unexpected {value!r} at {place}")

    def braces(self):
        """An object if it begins with a key and a colon (or is empty), else a block."""
        if self.accept("}"):
            return ("object", [])
        if self.now[0] in ("name", "string") and self.tokens[self.at + 1][:2] == ("op", ":"):
            out = []
            while not self.accept("}"):
                key = self.take()[1]
                self.expect(":")
                out.append((key, self.expression()))
                self.accept(",")
            if len({k for k, _ in out}) < len(out):
                raise ParseError("an object has a key twice")
            return ("object", out)
        body = self.block("}")
        self.expect("}")
        return body


def parse(text: str):
    return Parser(text).query()
