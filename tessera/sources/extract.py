"""Symbols, references and imports from source text.

Python is read by its own parser; other languages by patterns over lines, which is what large generated files get in any
language. One file yields one row of arrays, so a partition of texts is one pass, and the tables are exploded from it.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import clean_path

# Language of an extension.
EXTENSIONS = {"go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rs": "rust", "c": "c", "h": "c", "ll": "llvm", "s": "assembly", "asm": "assembly"}

# Line patterns of definitions, by language: (kind, pattern with the groups name and perhaps receiver).
_W = r"[A-Za-z_$][\w$]*"
DEFINITIONS = {
    "go": [
        ("method_definition", rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<receiver>\w+)[^)]*\)\s*(?P<name>{_W})\s*[\[(]"),
        ("function_definition", rf"^func\s+(?P<name>{_W})\s*[\[(]"),
        ("struct_definition", rf"^\s*(?:type\s+)?(?P<name>{_W})(?:\[[^\]]*\])?\s+struct\b"),
        ("interface_definition", rf"^\s*(?:type\s+)?(?P<name>{_W})(?:\[[^\]]*\])?\s+interface\b"),
        ("type_definition", rf"^type\s+(?P<name>{_W})\b"),
    ],
    "java": [
        ("class_definition", rf"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*class\s+(?P<name>{_W})"),
        ("interface_definition", rf"^\s*(?:(?:public|protected|private|abstract|static|sealed)\s+)*@?interface\s+(?P<name>{_W})"),
        ("enum_definition", rf"^\s*(?:(?:public|protected|private|static)\s+)*enum\s+(?P<name>{_W})"),
        ("method_definition", rf"^\s*(?:(?:public|protected|private|abstract|final|static|synchronized|native|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\].,? ]+\s+(?P<name>{_W})\s*\([^;]*$"),
    ],
    "rust": [
        ("function_definition", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>{_W})"),
        ("struct_definition", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>{_W})"),
        ("enum_definition", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_W})"),
        ("interface_definition", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>{_W})"),
        ("module_definition", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>{_W})"),
    ],
    "javascript": [
        ("function_definition", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_W})"),
        ("class_definition", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+(?P<name>{_W})"),
        ("function_definition", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_W})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{_W}\s*=>)"),
    ],
    "c": [
        ("struct_definition", rf"^\s*(?:typedef\s+)?struct\s+(?P<name>{_W})\s*\{{"),
        ("function_definition", rf"^[A-Za-z_][\w\s*]*?\b(?P<name>{_W})\s*\([^;]*$"),
    ],
}
DEFINITIONS["llvm"] = [("function_definition", r"^define\b[^@]*@\"?(?P<name>[\w.$-]+)\"?\s*\("), ("variable_definition", r"^@\"?(?P<name>[\w.$-]+)\"?\s*=")]
DEFINITIONS["assembly"] = [("function_definition", r"^(?P<name>[A-Za-z_.$][\w.$]*):(?!\S)")]
DEFINITIONS["python"] = [("class_definition", rf"^class\s+(?P<name>{_W})"), ("function_definition", rf"^(?:async\s+)?def\s+(?P<name>{_W})\s*\(")]
DEFINITIONS["typescript"] = [*DEFINITIONS["javascript"], ("interface_definition", rf"^\s*(?:export\s+)?interface\s+(?P<name>{_W})"), ("type_definition", rf"^\s*(?:export\s+)?type\s+(?P<name>{_W})\s*="), ("enum_definition", rf"^\s*(?:export\s+)?enum\s+(?P<name>{_W})")]
IMPORTS = {
    "go": re.compile(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+)"\s*$'),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "rust": re.compile(r"^\s*(?:pub\s+)?(?:use|extern\s+crate)\s+([^;{]+?)(?:::\{.*)?\s*;?\s*$"),
    "javascript": re.compile(r"""^\s*(?:import\b.*?|export\b.*?\bfrom\s*|.*?\brequire\s*\(\s*)["']([^"']+)["']"""),
    "c": re.compile(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'),
}
IMPORTS["typescript"] = IMPORTS["javascript"]
IMPORTS["llvm"] = re.compile(r"^declare\b[^@]*@\"?([\w.$-]+)")
IMPORTS["assembly"] = re.compile(r"^\s*\.extern\s+([\w.$]+)")
_COMPILED = {lang: [(k, re.compile(p)) for k, p in rules] for lang, rules in DEFINITIONS.items()}
_CALL = re.compile(rf"(?<![\w$])({_W})\s*\(")
#: Calls of languages that don't put an opening parenthesis behind the name.
_CALLS = {"llvm": re.compile(r"\bcall\b[^@]*@\"?([\w.$-]+)"), "assembly": re.compile(r"^\s+(?:call|callq|bl|jal)\s+([A-Za-z_.$][\w.$]*)")}
_NOT_CALLS = {"if", "for", "while", "switch", "return", "func", "function", "catch", "match", "fn", "new", "sizeof", "super", "this", "elif", "and", "or", "not", "in", "def", "class", "import"}
_BRANCH = re.compile(r"(?<![\w$])(?:if|for|while|case|catch|loop|select)(?![\w$])|&&|\|\||\?(?!\?)")

SCHEMA = """path STRING, language STRING, error STRING,
  symbols ARRAY<STRUCT<kind: STRING, name: STRING, signature: STRING, receiver: STRING, start_line: INT, end_line: INT, cyclomatic: INT, cognitive: INT, max_nesting: INT, returns: INT>>,
  refs ARRAY<STRUCT<kind: STRING, name: STRING, line: INT, col: INT>>, imports ARRAY<STRING>"""


def language_of(path: str) -> str | None:
    name = path.rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None


def signature_of(line: str) -> str:
    head = line.strip()
    if "{" in head[1:]:
        head = head[: head.index("{", 1)]
    return " ".join(head.rstrip(";").split())


class _PythonReader(ast.NodeVisitor):
    """Walks a module once and keeps definitions, calls and imports."""

    _BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.With, ast.AsyncWith)

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.symbols, self.refs, self.imports, self.owners = lines, [], [], set(), []

    def _shape(self, node: ast.AST) -> tuple[int, int, int, int]:
        cyclomatic, cognitive, deepest, returns = 1, 0, 0, 0
        todo = [(c, 0) for c in ast.iter_child_nodes(node)]
        while todo:
            n, depth = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            inner = depth
            if isinstance(n, self._BRANCHES):
                cyclomatic += 1
                cognitive += 1 + depth
                inner = depth + 1
                deepest = max(deepest, inner)
            elif isinstance(n, ast.BoolOp):
                cyclomatic += 1
                cognitive += 1
            elif isinstance(n, ast.Return):
                returns += 1
            todo += [(c, inner) for c in ast.iter_child_nodes(n)]
        return cyclomatic, cognitive, deepest, returns

    def _keep(self, kind: str, node, receiver: str = "") -> None:
        shape = self._shape(node) if kind != "class_definition" else (0, 0, 0, 0)
        self.symbols.append((kind, node.name, signature_of(self.lines[node.lineno - 1]).rstrip(":"), receiver, node.lineno, node.end_lineno, *shape))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._keep("class_definition", node)
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    def visit_FunctionDef(self, node) -> None:
        owner = self.owners[-1] if self.owners else None
        self._keep("method_definition" if owner else "function_definition", node, owner or "")
        self.owners.append(None)
        self.generic_visit(node)
        self.owners.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.refs.append(("reference.call", name, f.end_lineno, f.end_col_offset - len(name) + 1))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.imports.update(a.name for a in node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.imports.add("." * node.level + (node.module or ""))


def _block_end(lines: list[str], at: int) -> int:
    """Last line of the brace block that begins at or after line `at` (from 0); the line itself without a block."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*$", "", lines[i])
        depth += line.count("{") - line.count("}")
        opened = opened or "{" in line
        if opened and depth <= 0:
            return i
        if not opened and (line.rstrip().endswith(";") or i > at + 8):
            return at
    return len(lines) - 1


def top_level(lang: str, text: str) -> list[tuple]:
    """Symbols of a large generated file, by patterns at line starts: one per name, no spans, no references."""
    found: dict[str, tuple] = {}
    for n, line in enumerate(text.split("\n"), 1):
        for kind, pattern in _COMPILED[lang] if line[:1].strip() else ():
            m = pattern.match(line)
            if m and m["name"] not in found:
                found[m["name"]] = (kind, m["name"], signature_of(line), m.groupdict().get("receiver") or "", n, n, 1, 0, 0, 0)
                break
    return list(found.values())


def extract(path: str, text: str, fast: bool = False) -> tuple:
    """(language, error, symbols, refs, imports) of a file. Unsupported languages give nothing, errors a message.

    fast: only what stands at the top level, by patterns in any language, as is enough for large generated files.
    """
    lang = language_of(path)
    if lang is None:
        return None, None, [], [], []
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    if fast:
        return lang, None, top_level(lang, text), [], []
    lines = text.split("\n")
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                reader = _PythonReader(lines)
                reader.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError) as e:
            return lang, f"{type(e).__name__}: {e}", [], [], []
        return lang, None, list(dict.fromkeys(reader.symbols)), list(dict.fromkeys(reader.refs)), sorted(reader.imports)
    symbols, refs, imports, seen = [], [], set(), set()
    importing, calling = IMPORTS[lang], _CALLS.get(lang, _CALL)
    for n, line in enumerate(lines):
        defined = None
        for kind, pattern in _COMPILED[lang]:
            m = pattern.match(line)
            if m and m["name"] not in _NOT_CALLS:
                end = _block_end(lines, n) if lang != "assembly" else n
                inner = "\n".join(lines[n : end + 1])
                receiver = m.groupdict().get("receiver") or ""
                key = (kind, m["name"], n)
                if key not in seen:
                    seen.add(key)
                    symbols.append((kind, m["name"], signature_of(line), receiver, n + 1, end + 1, 1 + len(_BRANCH.findall(inner)), 0, 0, len(re.findall(r"\breturn\b", inner))))
                defined = m["name"]
                break
        for m in calling.finditer(line):
            if m[1] not in _NOT_CALLS and m[1] != defined:
                refs.append(("reference.call", m[1], n + 1, m.start(1) + 1))
        m = importing.match(line)
        if m:
            imports.add(m[1])
    return lang, None, symbols, list(dict.fromkeys(refs)), sorted(imports)


def extracted(sources: DataFrame) -> DataFrame:
    """One row per path with the columns of SCHEMA; files are spread evenly before the pass, for their sizes differ."""
    once = sources.where("path IS NOT NULL AND content IS NOT NULL").groupBy(clean_path("path").alias("path")).agg(F.max("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *extract(p, t)) for p, t in zip(b["path"], b["content"])], columns=["path", "language", "error", "symbols", "refs", "imports"])

    return once.mapInPandas(run, SCHEMA)


def index_tables(found: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, refs, imports and errors of an extraction."""
    package = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    sym = found.select(F.col("path").alias("file"), F.posexplode("symbols").alias("ord", "s")).select("file", "ord", "s.*")
    ref = found.select(F.col("path").alias("file"), F.explode("refs").alias("r")).select("file", "r.*")
    return {
        "files": found.where("language IS NOT NULL AND error IS NULL").select("path", package.alias("package"), "language"),
        "symbols": sym,
        "refs": ref,
        "imports": found.select(F.col("path").alias("file"), F.explode("imports").alias("import")),
        "errors": found.where("error IS NOT NULL").select("path", "error"),
    }
