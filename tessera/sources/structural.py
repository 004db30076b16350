"""Searching source text by shape: token patterns with metavariables, and queries over Python's syntax tree."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"\s+|//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[A-Za-z_]\w*|\d[\w.]*|:=|->|=>|[=!<>+*/%&|^-]=|&&|\|\||\+\+|--|<<|>>|::|\.\.\.|[\s\S]")
_HOLE = re.compile(r"\$\$\$(\w*)|\$(\w+)")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _tokens(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isspace() or t.startswith(("//", "/*")) or (t.startswith("#") and len(t) > 1):
            continue
        out.append((t, m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Pattern:
    """Literal tokens, ("one", name) for `$NAME`, ("many", name) for `$$$NAME`."""

    parts: tuple

    @classmethod
    def parse(cls, text: str) -> Pattern:
        parts: list = []
        at = 0
        for m in _HOLE.finditer(text):
            parts += [t for t, _, _ in _tokens(text[at : m.start()])]
            parts.append(("many", m[1]) if m[1] is not None and m[0].startswith("$$$") else ("one", m[2]))
            at = m.end()
        parts += [t for t, _, _ in _tokens(text[at:])]
        if not parts or isinstance(parts[0], tuple) and parts[0][0] == "many":
            raise ValueError("a pattern begins with a token or one metavariable")
        return cls(tuple(parts))

    def match(self, tokens: list[tuple[str, int, int]], at: int) -> tuple[int, dict[str, tuple[int, int]]] | None:
        """End (a token number) and the captured token ranges of a match that begins at token `at`.

        `$X` takes one token or one bracketed group, the same text wherever it recurs; `$$$X` the shortest run of
        balanced tokens that lets the rest match.
        """
        def group(i: int) -> int:
            if tokens[i][0] not in _OPEN:
                return i + 1
            depth = 0
            for j in range(i, len(tokens)):
                depth += (tokens[j][0] in _OPEN) - (tokens[j][0] in _CLOSE)
                if not depth:
                    return j + 1
            return -1

        # states: (part, token, captures); depth first, the shortest run of $$$ first
        todo: list[tuple[int, int, dict]] = [(0, at, {})]
        while todo:
            k, i, seen = todo.pop()
            if k == len(self.parts):
                return i, seen
            part = self.parts[k]
            if isinstance(part, str):
                if i < len(tokens) and tokens[i][0] == part:
                    todo.append((k + 1, i + 1, seen))
                continue
            kind, name = part
            if kind == "many":
                if i < len(tokens) and tokens[i][0] not in _CLOSE and (j := group(i)) > 0:
                    start = seen.get(f"*{k}", i)
                    todo.append((k, j, seen | {f"*{k}": start, name: (start, j)}))
                todo.append((k + 1, i, seen if f"*{k}" in seen else seen | {name: (i, i)}))
                continue
            if i >= len(tokens) or tokens[i][0] in _CLOSE or (j := group(i)) < 0:
                continue
            if name in seen and [t[0] for t in tokens[seen[name][0] : seen[name][1]]] != [t[0] for t in tokens[i:j]]:
                continue
            todo.append((k + 1, j, {name: (i, j)} | seen))
        return None


def find(text: str, pattern: Pattern, where: dict[str, str] | None = None, rewrite: str | None = None) -> list[tuple]:
    """(start, end, line, captures, replacement) of matches that don't overlap, in order."""
    tokens = _tokens(text)
    out, at = [], 0
    first = pattern.parts[0]
    while at < len(tokens):
        if isinstance(first, str) and tokens[at][0] != first or not (m := pattern.match(tokens, at)) or m[0] == at:
            at += 1
            continue
        end, seen = m
        caught = {n: text[tokens[i][1] : tokens[j - 1][2]] if j > i else "" for n, (i, j) in ((n, r) for n, r in seen.items() if not n.startswith("*"))}
        if all(re.search(p, caught.get(n, "")) for n, p in (where or {}).items()):
            new = _HOLE.sub(lambda h: caught.get(h[1] or h[2] or "", ""), rewrite) if rewrite is not None else None
            start = tokens[at][1]
            out.append((start, tokens[end - 1][2], text.count("\n", 0, start) + 1, caught, new))
            at = end
        else:
            at += 1
    return out


def structural_grep(sources: DataFrame, pattern: str, where: dict[str, str] | None = None, rewrite: str | None = None) -> DataFrame:
    """path, line, start, end, captures, replacement: matches of a token pattern. Nothing is written."""
    parsed = Pattern.parse(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, line, s, e, caught, new) for p, t in zip(b["path"], b["content"]) if t for s, e, line, caught, new in find(t, parsed, where, rewrite)]
            yield pd.DataFrame(rows, columns=["path", "line", "start", "end", "captures", "replacement"])

    return sources.where("path IS NOT NULL").select("path", "content").mapInPandas(run, "path STRING, line INT, start INT, end INT, captures MAP<STRING, STRING>, replacement STRING")


# --- syntax-tree queries ---

_SEXP = re.compile(r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<field>\w+):|@(?P<capture>[\w.]+)|(?P<eq>#eq|#match)|\"(?P<text>(?:[^\"\\]|\\.)*)\"|(?P<name>[\w*]+))")


def parse_query(text: str) -> tuple:
    """`(FunctionDef name: "x" body: (Return) @r) @f`: node, fields, captures. `_` is any node, `(_)` any child."""
    toks, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _SEXP.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"query text at {text[at:at + 20]!r}")
        toks.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def node() -> dict:
        nonlocal pos
        kind, value = toks[pos]
        pos += 1
        if kind == "text":
            out = {"text": value}
        elif kind == "open":
            out = {"type": toks[pos][1], "fields": [], "children": []}
            pos += 1
            while toks[pos][0] != "close":
                if toks[pos][0] == "field":
                    name = toks[pos][1]
                    pos += 1
                    out["fields"].append((name, node()))
                else:
                    out["children"].append(node())
            pos += 1
        else:
            raise ValueError(f"query: {value!r} stands where a node should")
        if pos < len(toks) and toks[pos][0] == "capture":
            out["capture"] = toks[pos][1]
            pos += 1
        return out

    try:
        found = node()
    except IndexError:
        raise ValueError("the query isn't closed") from None
    if pos != len(toks):
        raise ValueError("more than one query")
    return found


def _matches(q: dict, n, caught: list) -> bool:
    if "text" in q:
        ok = isinstance(n, (str, int, float)) and str(n) == q["text"] or isinstance(n, ast.Name) and n.id == q["text"] or isinstance(n, ast.Constant) and str(n.value) == q["text"]
        if ok and "capture" in q:
            caught.append((q["capture"], n))
        return ok
    if q["type"] != "_" and type(n).__name__ != q["type"]:
        return False
    mine: list = []
    for name, sub in q["fields"]:
        value = getattr(n, name, None)
        for v in value if isinstance(value, list) else [value]:
            if v is not None and _matches(sub, v, mine):
                break
        else:
            return False
    for sub in q["children"]:
        if not isinstance(n, ast.AST) or not any(_matches(sub, c, mine) for c in ast.iter_child_nodes(n)):
            return False
    if "capture" in q:
        caught.append((q["capture"], n))
    caught += mine
    return True


def query_captures(text: str, q: dict) -> list[tuple]:
    """(match, capture, node type, text, start line, end line); a text that doesn't parse has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows, number = [], 0
    for n in ast.walk(tree):
        caught: list = []
        if _matches(q, n, caught):
            for name, c in caught or [("match", n)]:
                at = c if isinstance(c, ast.AST) and hasattr(c, "lineno") else n
                rows.append((number, name, type(c).__name__, str(c) if not isinstance(c, ast.AST) else (ast.get_source_segment(text, c) or ""), getattr(at, "lineno", 0), getattr(at, "end_lineno", 0)))
            number += 1
    return rows


def tree_query(sources: DataFrame, query: str) -> DataFrame:
    """path, match, capture, node_type, text, start_line, end_line over the Python files of a table."""
    q = parse_query(query)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b["path"], b["content"]) if t for r in query_captures(t, q)]
            yield pd.DataFrame(rows, columns=["path", "match", "capture", "node_type", "text", "start_line", "end_line"])

    return sources.where("path LIKE '%.py'").select("path", "content").mapInPandas(run, "path STRING, match INT, capture STRING, node_type STRING, text STRING, start_line INT, end_line INT")


def query_violations(sources: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """path, line, rule, severity of (rule, severity, query): where @violation is captured, else the first capture."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    out = None
    for rule, severity, query in rules:
        w = Window.partitionBy("path", "match").orderBy((F.col("capture") != "violation").cast("int"), "start_line", "capture")
        hit = tree_query(sources, query).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("path", F.col("start_line").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
        out = hit if out is None else out.unionByName(hit)
    return out
