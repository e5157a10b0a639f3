"""The facts table of Python files (S1-S9, input of P1-P10).

The standard `ast` module runs per file in an Arrow-fed map; files stay where
the scan put them and everything after the facts is DataFrame work.  Callers
name the fact kinds they need, so no others are made.
"""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, visit_seq bigint, kind string, name string, qual string, parent string, "
    "args array<string>, value string, line int, flags array<string>, snippet string"
)
ARROW_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}

RULE_KINDS = ("call", "import", "import_from", "attribute", "binop_add", "assign")
STRUCTURE_KINDS = ("imported", "function", "function_call", "class", "method", "assignment", "string", "comment", "control")
# Rows of facts are handed on when either is reached.
ROWS_AT_ONCE, CHARS_AT_ONCE = 2_000, 1 << 22


class _File:
    """One parsed file and the text helpers its facts need."""

    def __init__(self, source: str):
        self.tree = ast.parse(source)
        self.source = source
        self.lines = source.splitlines()
        self.encoded = [line.encode() for line in self.lines]
        self.texts: dict[ast.AST, str] = {}

    def snippet(self, node: ast.AST) -> str:
        return self.lines[node.lineno - 1].strip()

    def unparse(self, node: ast.AST) -> str:
        if node not in self.texts:
            try:
                self.texts[node] = ast.unparse(node)
            except RecursionError:  # nested too deeply to be written out
                self.texts[node] = type(node).__name__
        return self.texts[node]

    def segment(self, node: ast.AST) -> str:
        """The node's source text; columns count UTF-8 bytes."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if last >= len(self.encoded):
            return ""
        cut = self.encoded[first:last + 1]
        cut[-1] = cut[-1][:node.end_col_offset]
        cut[0] = cut[0][node.col_offset:]
        return b"\n".join(cut).decode(errors="replace")


def _constant(node: ast.AST) -> str:
    """Static text of a string or an f-string, else nothing."""
    if isinstance(node, ast.JoinedStr):
        return "".join(_constant(part) for part in node.values)
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""


def _sql_source(f: _File, node: ast.AST, kinds: tuple) -> tuple[str, str]:
    """(form, text) of an expression that may hold SQL: constants lower-cased, built text as written."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return "const", node.value.lower()
    return ("built", f.segment(node)) if isinstance(node, kinds) else ("other", "")


def _preorder(tree: ast.AST) -> Iterator[tuple[ast.AST, bool]]:
    """Nodes depth first in field order, each with whether it lies inside a call."""
    stack = [(tree, False)]
    while stack:
        node, inside = stack.pop()
        yield node, inside
        below = inside or isinstance(node, ast.Call)
        stack.extend((child, below) for child in reversed(list(ast.iter_child_nodes(node))))


def _call_fact(f: _File, node: ast.Call, inside: bool) -> dict:
    func, flags = node.func, []
    fact = {"kind": "call", "line": node.lineno, "snippet": f.snippet(node), "flags": flags}
    if isinstance(func, ast.Name):
        fact["name"] = func.id
        flags.append("bare")
    elif isinstance(func, ast.Attribute):
        fact["name"] = func.attr
        fact["qual"] = func.value.id if isinstance(func.value, ast.Name) else ""
    else:
        return {}
    keywords = {k.arg: k.value for k in node.keywords}
    if getattr(keywords.get("shell"), "value", False) is True:
        flags.append("shell")
    if len(node.args) > 1 or "params" in keywords:
        flags.append("params")
    if inside:
        flags.append("inside_call")
    if node.args:
        first = node.args[0]
        if isinstance(first, ast.Name):
            flags.append("arg_name")
            fact["value"] = first.id
        elif isinstance(first, ast.Constant) and isinstance(first.value, str):
            flags.append("arg_const")
            fact["value"] = first.value
        elif isinstance(first, ast.BinOp) and fact["name"] in ("execute", "executemany"):
            flags.append("arg_built")
            fact["value"] = f.segment(first)
    return fact


def _rule_facts(f: _File, kinds: frozenset) -> Iterator[dict]:
    """What the P rules read, in visiting order. Assignments only matter where something is executed."""
    runs_sql = ".execute" in f.source
    for node, inside in _preorder(f.tree):
        if isinstance(node, ast.Call) and "call" in kinds:
            yield _call_fact(f, node, inside)
        elif isinstance(node, ast.Import) and "import" in kinds:
            for alias in node.names:
                yield {"kind": "import", "name": alias.name, "line": node.lineno, "snippet": f.snippet(node)}
        elif isinstance(node, ast.ImportFrom) and "import_from" in kinds and node.module:
            yield {"kind": "import_from", "name": node.module, "line": node.lineno, "snippet": f.snippet(node)}
        elif isinstance(node, ast.Attribute) and "attribute" in kinds and isinstance(node.value, ast.Name):
            yield {"kind": "attribute", "name": node.attr, "qual": node.value.id, "line": node.lineno, "snippet": f.snippet(node)}
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add) and "binop_add" in kinds:
            text = (_constant(node.left) + " " + _constant(node.right)).lower()
            if text != " ":
                mod = any(isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mod) for n in ast.walk(node))
                flags = ["mod"] * mod + ["inside_call"] * inside
                yield {"kind": "binop_add", "value": text, "flags": flags, "line": node.lineno, "snippet": f.snippet(node)}
        elif isinstance(node, ast.Assign) and "assign" in kinds and runs_sql:
            if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                form, text = _sql_source(f, node.value, (ast.BinOp, ast.JoinedStr, ast.Call))
                yield {"kind": "assign", "name": node.targets[0].id, "value": text, "flags": [form], "line": node.lineno}  # a statement: never inside a call


def _callee(f: _File, func: ast.AST) -> str:
    """S3: the called name; of a method, the last name before the dot, a dot, and the method (no name: nothing before the dot)."""
    match func:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Name(id=owner) | ast.Attribute(attr=owner), attr=method):
            return f"{owner}.{method}"
        case ast.Attribute(attr=method):
            return f".{method}"
    return f.unparse(func)


def _function_facts(f: _File, kinds: frozenset) -> Iterator[dict]:
    """Functions, classes and methods in visiting order; calls once per enclosing function."""
    for node, _ in _preorder(f.tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if "function" in kinds:
                called = [_callee(f, c.func) for c in ast.walk(node) if isinstance(c, ast.Call)]
                yield {"kind": "function", "name": node.name, "args": [a.arg for a in node.args.args], "flags": called, "value": ast.get_docstring(node), "line": node.lineno}
            if "function_call" in kinds:
                for call in ast.walk(node):
                    if isinstance(call, ast.Call):
                        yield {"kind": "function_call", "parent": node.name, "name": _callee(f, call.func),
                               "args": [f.unparse(a) for a in call.args], "line": call.lineno}
        elif isinstance(node, ast.ClassDef) and "class" in kinds:
            yield {"kind": "class", "name": node.name, "value": ast.get_docstring(node), "line": node.lineno}
            for part in node.body:
                if isinstance(part, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield {"kind": "method", "parent": node.name, "name": part.name, "qual": str(node.lineno),
                           "args": [a.arg for a in part.args.args], "value": ast.get_docstring(part), "line": part.lineno}


def _flat_facts(f: _File, kinds: frozenset) -> Iterator[dict]:
    """Imports, assignments, strings and control flow, breadth first."""
    for node in ast.walk(f.tree):
        line = getattr(node, "lineno", None)
        if isinstance(node, (ast.Import, ast.ImportFrom)) and "imported" in kinds:
            # What a `from` takes is named with its module; dots alone are no module.
            prefix = [node.module] if isinstance(node, ast.ImportFrom) and node.module else []
            yield from ({"kind": "imported", "name": ".".join([*prefix, taken.name]), "line": line} for taken in node.names)
        elif isinstance(node, ast.Assign) and "assignment" in kinds:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    yield {"kind": "assignment", "name": target.id, "value": f.unparse(node.value), "line": line}
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and "string" in kinds:
            yield {"kind": "string", "value": node.value, "line": line}
        elif "control" in kinds:
            if isinstance(node, (ast.If, ast.While)):
                yield {"kind": "control", "name": type(node).__name__.lower(), "value": f.unparse(node.test), "line": line}
            elif isinstance(node, ast.For):
                yield {"kind": "control", "name": "for", "value": f.unparse(node.target), "line": line}
            elif isinstance(node, ast.Try):
                yield {"kind": "control", "name": "try", "line": line}


def _comment_facts(f: _File) -> Iterator[dict]:
    try:
        for token in tokenize.tokenize(io.BytesIO(f.source.encode()).readline):
            if token.type == tokenize.COMMENT:
                yield {"kind": "comment", "value": token.string, "line": token.start[0]}
    except (tokenize.TokenError, SyntaxError):  # what was read so far counts
        return


def facts_of(source: str, kinds: frozenset) -> Iterator[dict]:
    """All wanted facts of one text; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # about odd escapes in foreign code
            f = _File(source)
    except Exception:  # it does not parse, for whatever reason
        return
    if kinds & set(RULE_KINDS):
        yield from filter(None, _rule_facts(f, kinds))
    if kinds & {"function", "function_call", "class"}:
        yield from _function_facts(f, kinds)
    if kinds & {"imported", "assignment", "string", "control"}:
        yield from _flat_facts(f, kinds)
    if "comment" in kinds:
        yield from _comment_facts(f)


def code_facts(files: DataFrame, kinds: tuple[str, ...] = RULE_KINDS + STRUCTURE_KINDS) -> DataFrame:
    """(path, content) of Python files -> facts; `visit_seq` orders the facts of a file."""
    wanted = frozenset(kinds)

    schema = pa.schema([(c, ARROW_TYPES[t]) for c, t in (field.split() for field in SCHEMA.split(", "))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            # Texts leave Arrow's buffer one at a time: a worker holds a batch once, and one file as Python objects.
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, content = path.as_py(), content.as_py()
                for seq, fact in enumerate(facts_of(content, wanted)):
                    rows.append(fact | {"path": path, "visit_seq": seq})
                    size += len(fact.get("value") or "") + len(fact.get("snippet") or "")
                    if len(rows) >= ROWS_AT_ONCE or size >= CHARS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(extract, SCHEMA)
