"""JavaScript cut into tokens, so that rules can tell code from comments, strings, templates and patterns (JX1-JX5).

A pushdown lexer: a stack holds the open brackets and the template literals whose
`${...}` is being read, so a template within a template ends where it ends.  A slash
begins a pattern where no operand stands before it: at the start, behind an operator
or a keyword such as `return`, behind the `)` of an `if`, and behind the `}` of a
block, but not behind that of an object literal.

It runs in an Arrow map, once per file, and only for files with a word that some rule
needs.  Its results keep the text's length and lines:

- `bare`: comments and the inside of strings, templates and patterns are blank; code
  within `${...}` stays.
- `called`: the same, but a string that is the first argument of `RegExp` or `require` stays.
- `templates`: per template literal its first line and the texts between its `${...}`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, content string, called string, bare string, templates array<struct<line: int, pieces: array<string>>>"
BATCH_BYTES = 8_000_000

TOKEN = re.compile(r"""
    (?P<space>[\s﻿]+)
  | (?P<comment>//[^\n]*+ | /\*[\s\S]*?(?:\*/|\Z))
  | (?P<string>"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?+ | '[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?+)
  | (?P<word>(?:[^\W\d]|\$)[\w$]*+)
  | (?P<number>\.?\d[\w.]*+)
  | (?P<step>\+\+|--)
  | (?P<arrow>=>)
  | (?P<other>[\s\S])""", re.VERBOSE)
PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\\\]\n]|\\[^\n])*+\])++/\w*+")
TEXT = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+\\?+")
# Keywords that end no operand: a slash behind them begins a pattern.
AHEAD = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
HEADS = frozenset("if while for with".split())
ARGUMENT_OF = frozenset(("RegExp", "require"))
NOT_NEWLINE = re.compile(r"[^\n]")


def blank(text: str) -> str:
    return NOT_NEWLINE.sub(" ", text)


def lex(text: str) -> tuple[str, str, list[tuple[int, list[str]]]]:
    """(called, bare, templates) of a file."""
    called: list[str] = []
    bare: list[str] = []
    templates: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, object]] = []  # ("(", behind a head), ("{", object literal), ("[", None), ("`", the template)
    at, line, counted = 0, 1, 0
    operand, before, ahead = False, "", ""  # does an operand end here; the last two tokens

    def both(piece: str) -> None:
        called.append(piece)
        bare.append(piece)

    def template(begin: int, pieces: list[str]) -> int:
        """Read a template's text up to its end or its next `${`; its place behind that."""
        end = TEXT.match(text, begin).end()
        pieces.append(text[begin:end])
        both(blank(text[begin:end]))
        if text.startswith("${", end):
            stack.append(("`", pieces))
            both("${")
            return end + 2
        both(text[end:end + 1])
        return end + 1

    while at < len(text):
        found = TOKEN.match(text, at)
        kind, token = found.lastgroup, found[0]
        if kind == "space":
            both(token)
            at = found.end()
            continue
        if kind == "comment":
            both(blank(token))
            at = found.end()
            continue
        if token == "/" and not operand and (pattern := PATTERN.match(text, at)):
            token, kind = pattern[0], "pattern"
            both("/" + blank(token[1:-1]) + token[-1])
            operand, at = True, pattern.end()
        elif token == "`" or (token == "}" and stack and stack[-1][0] == "`"):
            if token == "`":
                line, counted = line + text.count("\n", counted, at), at
                pieces: list[str] = []
                templates.append((line, pieces))
            else:
                pieces = stack.pop()[1]
            both(token)
            at = template(at + 1, pieces)
            operand = not text.startswith("${", at - 2) or not (stack and stack[-1] == ("`", pieces))
        else:
            at = found.end()
            if kind == "string":
                hidden = token[0] + blank(token[1:-1]) + token[-1] if len(token) > 1 else token
                bare.append(hidden)
                called.append(token if before == "(" and ahead in ARGUMENT_OF else hidden)
                operand = True
            else:
                both(token)
                if kind == "word":
                    operand = before == "." or token not in AHEAD
                elif kind == "number":
                    operand = True
                elif token in "([{" and kind == "other":
                    # A brace begins an object where an operand is due, but not at the start of a statement.
                    literal = not operand and before not in ("", ";", "{", "}", ")", "=>", "else", "do")
                    stack.append((token, before in HEADS and ahead != "." if token == "(" else literal))
                    operand = False
                elif token in ")]}" and kind == "other":
                    opened = stack.pop() if stack and stack[-1][0] != "`" else (token, False)
                    operand = token == "]" or (not opened[1] if token == ")" else bool(opened[1]))
                elif kind != "step":  # x++ ends an operand as x does; ++ begins none
                    operand = False
        before, ahead = token, before
    return "".join(called), "".join(bare), templates


def with_js_code(files: DataFrame, *gate: str) -> DataFrame:
    """SCHEMA for the files that hold one of the `gate` words."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "content", "called", "bare", "templates"]
        kind = pa.list_(pa.struct([("line", pa.int32()), ("pieces", pa.list_(pa.string()))]))
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                called, bare, templates = zip(*map(lex, part.column(1).to_pylist()), strict=True)
                listed = [[{"line": line, "pieces": pieces} for line, pieces in found] for found in templates]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(called, pa.string()), pa.array(bare, pa.string()), pa.array(listed, kind)], names)

    held = reduce(or_, [F.contains("content", F.lit(word)) for word in gate])
    return files.where(held).select("path", "content").mapInArrow(each, SCHEMA)
