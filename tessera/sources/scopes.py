"""Shapes of types, and lexical scopes with their definitions and references, from source text."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.extract import _block_end, language_of

TYPES = "path STRING, name STRING, kind STRING, start_line INT, end_line INT, fields INT, interface_width INT, nesting_depth INT"
_BRACED = {
    "go": [("struct_type_definition", re.compile(r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+struct\s*\{")), ("interface_type_definition", re.compile(r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+interface\s*\{"))],
    "java": [("class_definition", re.compile(r"^\s*(?:\w+\s+)*class\s+(\w+)")), ("interface_type_definition", re.compile(r"^\s*(?:\w+\s+)*interface\s+(\w+)"))],
    "rust": [("struct_type_definition", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)[^;]*\{")), ("interface_type_definition", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"))],
}
_FIELD = {"go": re.compile(r"^\s*\*?\w+[\w\s,.*\[\]]*(?:`.*`)?$"), "java": re.compile(r"^\s*(?:[\w<>\[\],.]+\s+)+\w+\s*(?:=.*)?;$"), "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?\w+\s*:\s*[^,]+,?$")}
_METHOD = {"go": re.compile(r"^\s*[A-Za-z_]\w*\(.*\)"), "java": re.compile(r"^\s*(?:[\w<>\[\],.]+\s+)+\w+\s*\(.*\)\s*;$"), "rust": re.compile(r"^\s*(?:async\s+|unsafe\s+)*fn\s+\w+")}


def _python_types(text: str) -> list[tuple]:
    out = []

    def visit(node: ast.AST, depth: int) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef):
                names = {t.id for s in c.body for t in ([s.target] if isinstance(s, ast.AnnAssign) else s.targets if isinstance(s, ast.Assign) else []) if isinstance(t, ast.Name)}
                for f in ast.walk(c):
                    if isinstance(f, ast.Attribute) and isinstance(f.ctx, ast.Store) and isinstance(f.value, ast.Name) and f.value.id == "self":
                        names.add(f.attr)
                bases = {b.id if isinstance(b, ast.Name) else getattr(b, "attr", "") for b in c.bases}
                width = sum(isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) for s in c.body) if bases & {"Protocol", "ABC"} else 0
                out.append((c.name, "interface_type_definition" if width else "class_definition", c.lineno, c.end_lineno, len(names), width, depth))
                visit(c, depth + 1)
            else:
                visit(c, depth)

    visit(ast.parse(text), 0)
    return out


def types_in(path: str, text: str) -> list[tuple]:
    """(name, kind, start line, end line, fields, interface width, nesting depth) of the types of a file."""
    lang = language_of(path)
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return _python_types(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
    if lang not in _BRACED:
        return []
    lines = text.split("\n")
    found = []
    for n, line in enumerate(lines):
        for kind, pattern in _BRACED[lang]:
            m = pattern.match(line)
            if m:
                end = _block_end(lines, n)
                depth = 0
                fields = width = 0
                for inner in lines[n + 1 : end]:
                    code = inner.split("//")[0].rstrip()
                    if code.strip() and depth == 0:
                        method = bool(_METHOD[lang].match(code))
                        width += method
                        fields += not method and bool(_FIELD[lang].match(code))
                    depth += code.count("{") - code.count("}")
                interface = kind.startswith("interface")
                found.append((m[1], kind, n + 1, end + 1, 0 if interface else fields, width if interface else 0, sum(s <= n < e for _, _, s, e, *_ in found)))
                break
    return found


def type_shapes(sources: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *t) for p, c in zip(b["path"], b["content"]) if c for t in types_in(p, c)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line", "fields", "interface_width", "nesting_depth"])

    return sources.where("path IS NOT NULL").select("path", "content").mapInPandas(run, TYPES)


class _Scopes(ast.NodeVisitor):
    """Scopes, definitions and name references of a Python module, numbered within the file."""

    def __init__(self) -> None:
        self.scopes: list[tuple] = [(0, None, "file", 1, 0)]
        self.defs: list[tuple] = []
        self.refs: list[tuple] = []
        self.at = 0

    def _define(self, name: str, kind: str, line: int) -> None:
        self.defs.append((self.at, name, kind, line, len(self.defs)))

    def _inside(self, node: ast.AST, kind: str, body) -> None:
        number, before = len(self.scopes), self.at
        self.scopes.append((number, before, kind, node.lineno, node.end_lineno))
        self.at = number
        body()
        self.at = before

    def _function(self, node) -> None:
        if not isinstance(node, ast.Lambda):
            self._define(node.name, "function", node.lineno)
            for d in node.decorator_list:
                self.visit(d)
        a = node.args
        for default in [*a.defaults, *[d for d in a.kw_defaults if d]]:
            self.visit(default)

        def body() -> None:
            for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs, *[x for x in (a.vararg, a.kwarg) if x]]:
                self._define(arg.arg, "param", arg.lineno)
            for s in node.body if isinstance(node.body, list) else [node.body]:
                self.visit(s)

        self._inside(node, "function", body)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_Lambda = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node.name, "class", node.lineno)
        for b in [*node.bases, *node.decorator_list]:
            self.visit(b)
        self._inside(node, "class", lambda: [self.visit(s) for s in node.body])

    def visit_Import(self, node) -> None:
        for a in node.names:
            self._define((a.asname or a.name).split(".")[0], "import", node.lineno)

    visit_ImportFrom = visit_Import

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Store):
            self._define(node.id, "local" if self.at else "variable", node.lineno)
        else:
            self.refs.append((self.at, node.id, node.lineno, node.col_offset + 1))


SCOPES = """path STRING, scopes ARRAY<STRUCT<scope: INT, parent: INT, kind: STRING, start_line: INT, end_line: INT>>,
  defs ARRAY<STRUCT<scope: INT, name: STRING, kind: STRING, line: INT, ord: INT>>, refs ARRAY<STRUCT<scope: INT, name: STRING, line: INT, col: INT>>"""


def scope_tables(sources: DataFrame) -> dict[str, DataFrame]:
    """scopes (path, scope_id, parent_id, kind, lines), defs (def_id, scope_id, name, kind, line, ord), refs of Python files.

    Ids are `path:number`. Files that don't parse have none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                v = _Scopes()
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        v.visit(ast.parse(c or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                v.scopes[0] = (0, None, "file", 1, (c or "").count("\n") + 1)
                rows.append((p, v.scopes, v.defs, v.refs))
            yield pd.DataFrame(rows, columns=["path", "scopes", "defs", "refs"])

    found = sources.where("path LIKE '%.py'").select("path", "content").mapInPandas(run, SCOPES)
    ident = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", "path", F.col(c).cast("string")))
    s = found.select("path", F.explode("scopes").alias("s")).select("path", "s.*")
    d = found.select("path", F.explode("defs").alias("d")).select("path", "d.*")
    r = found.select("path", F.explode("refs").alias("r")).select("path", "r.*")
    return {
        "scopes": s.select("path", ident("scope").alias("scope_id"), ident("parent").alias("parent_id"), "kind", "start_line", "end_line"),
        "defs": d.select("path", F.concat_ws("#", "path", F.col("ord").cast("string")).alias("def_id"), ident("scope").alias("scope_id"), "name", "kind", "line", "ord"),
        "refs": r.select("path", F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string")).alias("ref_id"), ident("scope").alias("scope_id"), "name", "line"),
    }
