"""Path patterns as regular expressions: ignore lists, package globs, owners."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import SKIPPED_DIRS

def glob_regex(glob: str) -> str:
    """One glob as a Java regular expression: * and ? stay in a segment, ** crosses segments, [..] is a class."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


@dataclass
class IgnoreRule:
    regex: str
    negated: bool


def parse_ignore(text: str) -> list[IgnoreRule]:
    """Ordered rules; blank lines and # comments dropped, ! negates, a trailing / names a directory.

    A pattern without a slash matches any component of a path, one with a slash from the root.
    """
    rules = []
    for line in text.splitlines():
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        directory = p.endswith("/")
        p = p.rstrip("/")
        rooted = "/" in p
        p = p.lstrip("/")
        head = "^" if rooted else "(?:^|/)"
        rules.append(IgnoreRule(f"{head}{glob_regex(p)}" + ("/" if directory else "(?:/|$)"), negated))
    return rules


def ignored(path: Column | str, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that matches ignores the path."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for r in rules:
        out = F.when(p.rlike(r.regex), F.lit(not r.negated)).otherwise(out)
    return out


def indexable(path: Column | str) -> Column:
    """No segment is hidden, and no directory is one of SKIPPED_DIRS."""
    p = F.col(path) if isinstance(path, str) else path
    return ~p.rlike(r"(^|/)\.[^/]") & ~p.rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/")


def package_matches(package: Column | str, glob: str) -> Column:
    """`*` is everything, `prefix/*` and `prefix/**` all below the prefix and itself, else equality."""
    p = F.col(package) if isinstance(package, str) else package
    if glob in ("*", "**"):
        return F.lit(True)
    for tail in ("/**", "/*"):
        if glob.endswith(tail):
            prefix = glob[: -len(tail)]
            return (p == prefix) | p.startswith(prefix + "/")
    return p == glob


def owner(path: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Owner by the last rule (pattern, owner) that matches; `(unowned)` by none."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit("(unowned)")
    for pattern, who in rules:
        head = "^" if "/" in pattern.strip("/") or pattern.startswith("/") else "(?:^|/)"
        out = F.when(p.rlike(head + glob_regex(pattern.strip("/")) + "(?:/|$)"), F.lit(who)).otherwise(out)
    return out
