"""Tokens of the dialect. Unquoted names fold to small letters, quoted ones keep theirs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.exprs import DialectError

PATTERN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<num>(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)|(?P<str>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||::|->|<>|!=|<=|>=|[-+*/%=<>(),.;\[\]])""", re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = PATTERN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character at {at}: {sql[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind not in ("space", "num", "str", "quoted", "name", "op"):
            kind = "num"
        if kind == "str":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            kind, text = "ident", text[1:-1].replace('""', '"')
        elif kind == "name":
            text = text.lower()
        elif text == "!=":
            text = "<>"
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", at)]
