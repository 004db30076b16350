"""The selector language: `kind[name=/re/,signature=/re/,receiver=/re/,file=/re/,start>=n,end<=n,line=n]` as a predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT = {"name": "name", "signature": "signature", "receiver": "receiver", "file": "file"}


def java_pattern(pattern: str) -> str:
    """Named groups in the form Java takes; the pattern is checked before it reaches an executor."""
    re.compile(pattern)
    return pattern.replace("(?P<", "(?<")


def split_filters(text: str) -> list[str]:
    """Split at commas outside of /.../; a backslash escapes the next character."""
    out, part, inside, escaped = [], "", False, False
    for ch in text:
        if escaped:
            part, escaped = part + ch, False
        elif ch == "\\":
            part, escaped = part + ch, True
        elif ch == "/":
            part, inside = part + ch, not inside
        elif ch == "," and not inside:
            out.append(part)
            part = ""
        else:
            part += ch
    if inside:
        raise ValueError("a regular expression isn't closed")
    return [x.strip() for x in [*out, part] if x.strip()]


def parse(raw: str) -> Column:
    """Predicate over kind, name, signature, receiver, file, start_line and end_line. `*` stands for any kind."""
    m = re.fullmatch(r"\s*([\w*]+)\s*(?:\[(.*)\])?\s*", raw, re.S)
    if not m:
        raise ValueError(f"not a selector: {raw!r}")
    out = F.lit(True) if m[1] == "*" else F.col("kind") == m[1]
    least: dict[str, int] = {}
    most: dict[str, int] = {}
    for item in split_filters(m[2] or ""):
        f = re.fullmatch(r"(\w+)\s*(<=|>=|=)\s*(.*)", item, re.S)
        if not f:
            raise ValueError(f"not a filter: {item!r}")
        key, op, value = f[1], f[2], f[3].strip()
        if key in _TEXT:
            if op != "=" or len(value) < 2 or value[0] != "/" or value[-1] != "/":
                raise ValueError(f"{key} takes =/regular expression/")
            out = out & F.coalesce(F.col(_TEXT[key]), F.lit("")).rlike(java_pattern(value[1:-1].replace("\\/", "/")))
        elif key in ("start", "end", "line"):
            if not re.fullmatch(r"[1-9]\d*", value):
                raise ValueError(f"{key} takes a positive number")
            if key == "line" and op != "=":
                raise ValueError("line takes = only")
            n = int(value)
            if key == "line":
                out = out & (F.col("start_line") <= n) & (F.col("end_line") >= n)
                continue
            c = F.col(f"{key}_line")
            if op in (">=", "="):
                least[key] = max(least.get(key, 0), n)
                out = out & (c >= n)
            if op in ("<=", "="):
                most[key] = min(most.get(key, n), n)
                out = out & (c <= n)
        else:
            raise ValueError(f"no such filter: {key}")
    for key in least:
        if key in most and least[key] > most[key]:
            raise ValueError(f"{key} has an empty range")
    return out


def grep_mode(text: str) -> str:
    """Whether a search is a selector or a structural pattern."""
    t = text.strip()
    if t == "*" or re.fullmatch(r"\w+\[.*\]", t, re.S) or re.fullmatch(r"\w+_definition", t):
        return "selector"
    return "structural"
