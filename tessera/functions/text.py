"""Column functions over paths, signatures and source text; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirname(path: Column | str) -> Column:
    """Directory of a path, `.` for a path without one."""
    at = F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)
    return F.when(at == "", F.lit(".")).otherwise(at)


def component(package: Column | str) -> Column:
    """First segment of a directory, two below cmd, internal and pkg; `root` for the root."""
    p = col(package)
    two = F.regexp_extract(p, r"^((?:cmd|internal|pkg)/[^/]+)", 1)
    return F.when((p == ".") | (p == ""), F.lit("root")).when(two != "", two).otherwise(F.regexp_extract(p, r"^([^/]+)", 1))


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def token_estimate(text: Column | str) -> Column:
    """A quarter of the trimmed text's bytes, rounded up; 0 for blank text."""
    return F.ceil(F.octet_length(trimmed(text)) / 4).cast("bigint")


def body(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start .. end (from 1) of a text, joined by line feeds; '' for an empty span."""
    lines = F.slice(F.split(col(content), "\n", -1), F.greatest(col(start), F.lit(1)), F.greatest(col(end) - F.greatest(col(start), F.lit(1)) + 1, F.lit(0)))
    return F.array_join(lines, "\n")


def code_lines(text: Column | str) -> Column:
    """Lines with anything but blanks, tabs and carriage returns."""
    return F.size(F.filter(F.split(col(text), "\n", -1), lambda x: x.rlike("[^ \\t\\r]")))


def parameter_count(signature: Column | str) -> Column:
    """Commas between the first and the last parenthesis plus one; 0 where nothing stands between them."""
    inner = F.regexp_extract(col(signature), r"(?s)\((.*)\)", 1)
    return F.when(trimmed(inner) == "", 0).otherwise(F.length(inner) - F.length(F.regexp_replace(inner, ",", "")) + 1).cast("int")


def parameter_list(signature: Column | str) -> Column:
    """The text between the outer parentheses with white space runs as one blank; '' without parameters."""
    return trimmed(F.regexp_replace(F.regexp_extract(col(signature), r"(?s)\((.*)\)", 1), r"\s+", " "))


def signature_summary(text: Column | str) -> Column:
    """First line, cut at an opening brace, without a closing semicolon, blanks collapsed."""
    first = F.regexp_extract(col(text), r"^\s*([^\n]*)", 1)
    return trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(first, r"(?<=.)\{.*$", ""), r";\s*$", ""), r"\s+", " "))


def exported(name: Column | str) -> Column:
    return col(name).rlike(r"^\p{Lu}")


def shortened(text: Column | str, most: int = 160) -> Column:
    flat = trimmed(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def is_test_file(path: Column | str, language: Column | str | None = None) -> Column:
    """Whether the name is one of a test file in its language; without a known language by what is usual in any."""
    low = F.lower(col(path))
    out = low.rlike(fixed.TEST_FILES["any"])
    if language is None:
        return out
    named = F.lower(F.trim(col(language)))
    for lang, pattern in fixed.TEST_FILES.items():
        if lang != "any":
            same = [lang, *(k for k, v in fixed.TEST_ALIASES.items() if v == lang)]
            out = F.when(named.isin(*same), low.rlike(pattern)).otherwise(out)
    return out


def quoted_parts(text: Column | str) -> Column:
    """Contents of the quoted strings in a text, escapes kept."""
    return F.regexp_extract_all(col(text), F.lit(r"""["'`]((?:[^"'`\\]|\\.)*)["'`]"""), F.lit(1))
