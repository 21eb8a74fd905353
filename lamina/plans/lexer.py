"""Tokens of a statement, with their places in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lamina.errors import ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^'\\]|\\.|'')*')
    |(?P<quoted>`(?:[^`]|``)*`|"(?:[^"\\]|\\.|"")*")
    |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d]\w*)
    |(?P<mark><=|>=|<>|!=|==|\|\||::|->|.)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words


def tokenize(sql: str) -> list[Token]:
    """All tokens but white space and comments."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m.lastgroup == "mark" and m.group() in "'\"`":
            raise ParseError(f"a quote opened at {at} is not closed")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at, m.end()))
        at = m.end()
    return out


def unquote(token: Token) -> str:
    """The value of a string or quoted name: doubled quotes and backslash escapes are undone."""
    quote, body = token.text[0], token.text[1:-1]
    body = body.replace(quote * 2, quote)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.DOTALL)
