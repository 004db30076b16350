"""Generated, minified, vendored and data files, told apart from hand-written source.

Each file is lexed tolerantly and re-emitted in a canonical layout: one statement or brace a line, one blank between
tokens. The original layout is compared with it:
- extreme expansion (many canonical lines to an original one) marks minified and bundled files,
- literals that make up most of the code mark data blobs,
- perfect uniformity, all lines laid out alike over a long file of very few line shapes, marks generated files.
Comments, which the lexer separates from strings, hold statements of the file about itself: that a tool wrote it, or
that it is another project's. Only a statement at the head of a comment counts, not one that is quoted or spoken about.
Directories and file names say the same by public conventions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.syntax import language_of
from tessera.sources.tables import clean_path

#: Canonical lines to an original line from which a file counts as minified, and the length its lines must have.
EXPANSION, LINE = 4.0, 80
#: Share of literals in the characters of code from which a file is data, and the least number of such characters.
LITERALS, LEAST = 0.72, 200
#: A uniform file: this many lines of code, each laid out as its equals, of few different shapes a line.
UNIFORM_LINES, SHAPES = 300, 0.03

# Public conventions for directories of other projects' code.
VENDOR_DIRS = {"vendor", "vendored", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "external", "extern", "deps", "imported", "godeps", "site-packages", "pods", "carthage", "web_modules"}
VENDOR_PARTS = re.compile(r"(?:^|/)(?:static/lib|static/vendor|assets/vendor|public/lib)/", re.I)
# Public conventions for names of files that tools write. Endings that other names have by chance
# (_gen.go, _pb.js) are left to the statement their tools put into the file.
GENERATED_NAME = re.compile(
    r"(?:\.pb(?:\.gw|\.micro|\.validate)?\.go|_pb2(?:_grpc)?\.pyi?|_grpc_pb\.js|\.pb\.(?:cc|h|rs)|_enumer\.go|_easyjson\.go|_ffjson\.go|_generated\.(?:go|rs|py|java|js)"
    r"|\.generated\.\w+|\.gen\.\w+|\.g\.(?:rs|cs|dart|java|go|py|js)|\.designer\.\w+|zz_generated\.\w+\.go|(?:^|/)(?:Dagger[A-Z]\w*|\w+_Factory|\w+_MembersInjector|AutoValue_\w+|R|BuildConfig)\.java|wire_gen\.go|bindata\.go)$"
)
MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|pack(?:ed)?|chunk)\.(?:js|mjs|cjs|css)$", re.I)
# How tools announce themselves, in the languages such announcements are met in.
_TOOL = [
    r"(?:this (?:file|code|class|module) (?:is|was|has been) )?(?:code |file |source )?(?:is |was )?(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|using|file|code)\b",
    r"auto(?:matically)?[- ]?generated\b", r"@generated\b", r"<auto-?generated", r"this (?:file|code) (?:is|was) (?:auto(?:matically)?[- ]?)?generated\b",
    r"machine[- ](?:written|generated|made)\b", r"(?:built|made|produced|created|written|rendered|compiled|emitted) (?:from \S+ )?(?:automatically )?by [\w.-]+(?: [\d.]+)?(?:;| from| out of|,)",
    r"(?:do not|don't) (?:edit|modify|change)\b", r"diese datei wurde (?:automatisch )?(?:von|mit) .*(?:erzeugt|generiert|erstellt)", r"automatisch (?:erzeugt|generiert)",
    r"(?:ce )?fichier (?:est )?(?:produit|g[eé]n[eé]r[eé]|cr[eé][eé]) (?:automatiquement )?(?:par|avec)\b", r"source: \S+\.(?:proto|thrift|idl|graphql|fbs|avsc)$",
]
_FOREIGN = [
    r"imported from [\w.@/-]+ (?:release|version|v?\d)", r"(?:local|vendored|unmodified|verbatim|bundled) copy of [\w.@/-]+", r"(?:vendored|copied|taken|pulled|adapted) (?:over )?(?:unchanged |verbatim )?from (?:the )?[\w.@/-]+ (?:project|release|version|repository|v?\d)",
    r"this file is part of [\w.@/-]+ ?\(?v?\d[^,]*\)?, (?:bundled|shipped|distributed|included) with", r"[\w.@/-]+ v?\d+(?:\.\d+)+\S* *\| *\(c\)", r"!? ?[\w.@/-]+ v\d+(?:\.\d+)+\S*(?: \(c\).*| \|.*)?$",
]
TOOL = re.compile("|".join(_TOOL), re.I)
FOREIGN = re.compile("|".join(_FOREIGN), re.I)
#: Comments that speak of markers or deny them.
DENIED = re.compile(r"maintained by hand|hand[- ]?written|written from scratch|not generated|edited by hand", re.I)
_QUOTED = re.compile(r"'[^'\n]{3,}'|\"[^\"\n]{3,}\"|`[^`\n]{3,}`")

_WORD = r"(?P<word>[^\W\d]\w*)|(?P<number>\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<line>\n)|(?P<ws>[^\S\n]+)|(?P<other>[\s\S])"
_C_COMMENT = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_PY = re.compile(r"(?P<comment>\#[^\n]*)|(?P<string>(?i:[rbuf]{0,2})(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))|" + _WORD)
_C = re.compile(_C_COMMENT + r"|(?P<string>(?:b|c)?r(?P<hash>\#*)\"[\s\S]*?\"(?P=hash)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'|`[^`]*`)|" + _WORD)
_JS = re.compile(_C_COMMENT + r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)|" + _WORD)


@dataclass
class Layout:
    """What the lexer saw: comments, canonical lines against original ones, literals against all characters of code."""

    comments: list[str]
    expansion: float
    mean_line: float
    literals: float
    code_chars: int
    lines: int
    uniform: bool
    shapes: int


def layout_of(text: str, language: str | None) -> Layout:
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    pattern = _PY if language == "python" else _JS if language == "javascript" else _C
    comments: list[str] = []
    code = literal = canonical = lines = chars_on_lines = depth = 0
    open_ = False  # the canonical line has tokens
    shape: list[str] = []
    shapes: dict[str, str] = {}
    uniform = True
    on_line = 0
    begins = 0  # of the original line
    statement = True  # a string here is a docstring
    for m in pattern.finditer(text):
        kind = m.lastgroup if m.lastgroup != "hash" else "string"
        token = m[0]
        if kind == "ws":
            continue
        if kind == "line":
            if on_line:
                lines += 1
                chars_on_lines += on_line
                key, plain = " ".join(shape), text[begins : m.start()].rstrip()
                spaces = re.sub(r"\w+|\"[^\"]*\"|'[^']*'", "x", plain.strip())
                uniform = uniform and shapes.setdefault(key, spaces) == spaces and plain == text[begins : m.start()]
                if open_ and (language == "python" or not depth):
                    canonical += 1
                    open_ = False
            on_line, shape, begins = 0, [], m.end()
            statement = not depth
            continue
        if kind == "comment":
            comments.append(token)
            continue
        n = len(token) if kind != "string" else len("".join(token.split()))
        if kind == "string" and language == "python" and statement and not open_ and token.lstrip("rRbBuUfF")[:3] in ('"""', "'''"):
            continue
        code += n
        on_line += len(token)
        statement = False
        if kind in ("string", "number"):
            literal += n
            shape.append("0")
            open_ = True
            continue
        shape.append("a" if kind == "word" else token)
        if token in "([":
            depth += 1
        elif token in ")]":
            depth = max(0, depth - 1)
        if language != "python" and token in "{}" or token == ";":
            canonical += 1 + (open_ and token == "}")
            open_ = False
        else:
            open_ = True
    if on_line:
        lines += 1
        chars_on_lines += on_line
    canonical += open_
    # literals may run over lines that hold nothing else; those are original lines too
    return Layout(comments, canonical / max(1, lines), chars_on_lines / max(1, lines), literal / max(1, code), code, lines, uniform, len(shapes))


def _heads(comments: list[str]) -> Iterator[str]:
    for c in comments:
        for line in c.split("\n"):
            yield re.sub(r"^[\s/*#!;-]+|[\s*/#-]+$", "", line)


def reasons(path: str, text: str) -> list[str]:
    """Why the file isn't hand-written source of its repository; empty if it seems to be."""
    at = path.partition(":")[2] or path
    name, folders = at.rpartition("/")[2], at.lower().split("/")[:-1]
    seen = layout_of(text, language_of(path))
    out = set()
    if any(f in VENDOR_DIRS for f in folders) or VENDOR_PARTS.search(at):
        out.add("vendored")
    if GENERATED_NAME.search(at):
        out.add("generated")
    for head in _heads(seen.comments):
        if DENIED.search(head) or len(head) < 8:
            continue
        bare = _QUOTED.sub(" ", head)
        if TOOL.match(bare) or (TOOL.search(bare) and re.search(r"(?:do not|don't) (?:edit|modify)|changes will be lost|hand edits", bare, re.I)):
            out.add("generated")
        if FOREIGN.match(bare):
            out.add("vendored")
    if seen.code_chars >= LEAST and seen.literals >= LITERALS:
        out.add("data")
    elif seen.expansion >= EXPANSION and seen.mean_line >= LINE:
        out.add("minified")
    if MINIFIED_NAME.search(name):
        out.add("minified")
    if seen.uniform and seen.lines >= UNIFORM_LINES and seen.shapes <= SHAPES * seen.lines:
        out.add("generated")
    return sorted(out)


def classified(sources: DataFrame) -> DataFrame:
    """path, language, reasons (empty for hand-written): one row per path. NULL paths are left out.

    A NULL content leaves the path's own evidence; with several contents a path has the reasons of all.
    """
    rows = sources.where("path IS NOT NULL").select(clean_path("path").alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    once = rows.groupBy("path", F.sha2("content", 256).alias("h")).agg(F.first("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "language": [language_of(p) for p in b["path"]], "reasons": [reasons(p, t) for p, t in zip(b["path"], b["content"])]})

    found = once.mapInPandas(run, "path STRING, language STRING, reasons ARRAY<STRING>")
    return found.groupBy("path").agg(F.min("language").alias("language"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))


def against_detector(found: DataFrame, files: DataFrame) -> DataFrame:
    """language, reason, files, detected: how many files of each reason the project's own detector had marked."""
    marked = files.where("path IS NOT NULL AND gen_reason IS NOT NULL").select(clean_path("path").alias("path")).distinct().withColumn("_m", F.lit(1))
    named = found.select("path", F.coalesce("language", F.lit("")).alias("language"), F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("hand-written")))).alias("reason"))
    return named.join(marked, "path", "left").groupBy("language", "reason").agg(F.count("*").alias("files"), F.count("_m").alias("detected"))
