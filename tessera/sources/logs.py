"""Line-oriented tool output as tables: change logs, unified diffs, blame, compiler messages. Headers are carried
forward by a window over the line numbers of one text, which is one key's rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_n", "_l"))


def churn_of_log(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, commits, authors from `author`, blank line, `added<tab>removed<tab>file` rows, blank line blocks.

    A line that begins with a digit or `-` is a file row. A commit is a run of file rows after an author line.
    """
    w = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(texts, key, text)
    row = F.col("_l").rlike(r"^[\d-]")
    marked = rows.withColumn("_row", row).withColumn("_head", F.when(~row & (F.trim("_l") != ""), F.trim("_l")))
    carried = marked.withColumn("author", F.last("_head", True).over(w)).withColumn("commit", F.sum(F.col("_head").isNotNull().cast("int")).over(w))
    files = carried.where("_row").select(key, "author", "commit", F.regexp_extract("_l", r"^[\d-]+\t[\d-]+\t(.*)$", 1).alias("file")).where("file <> ''")
    return files.groupBy(key, "file").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"))


def since_phrase(text: str) -> str:
    """`90d`, `6m`, `1y`, `2w` in words; an empty text is six months; anything else stays."""
    if not text.strip():
        return "6 months ago"
    m = re.fullmatch(r"(\d+)([dwmy])", text.strip())
    return f"{m[1]} {dict(d='days', w='weeks', m='months', y='years')[m[2]]} ago" if m else text


def diff_hunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, start_line, end_line of the new side of each hunk; an empty hunk counts as one line."""
    w = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(texts, key, text).withColumn("file", F.last(F.nullif(F.regexp_extract("_l", r"^\+\+\+ b/(.*)$", 1), F.lit("")), True).over(w))
    h = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    hunks = rows.where(F.col("_l").rlike(h) & F.col("file").isNotNull())
    start = F.regexp_extract("_l", h, 1).cast("int")
    n = F.greatest(F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(_l, r'{h}', 2), '') AS INT)"), F.lit(1)), F.lit(1))
    return hunks.select(key, "file", start.alias("start_line"), (start + n - 1).alias("end_line"))


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name of callables whose span meets a hunk of their file."""
    s = symbols.where(F.col("kind").isin("function_definition", "method_definition")).select("file", "name", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    return hunks.select("file", "start_line", "end_line").distinct().join(s, "file").where("_s <= end_line AND start_line <= _e").select("file", "name").distinct()


def blame_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, commit, author, time from porcelain blame; a commit's header fields hold for all its lines."""
    w = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(texts, key, text)
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    r = rows.withColumn("commit", F.last(F.nullif(F.regexp_extract("_l", head, 1), F.lit("")), True).over(w)).withColumn("line", F.last(F.nullif(F.regexp_extract("_l", head, 2), F.lit("")), True).over(w).cast("int"))
    by_commit = r.groupBy(key, "commit").agg(F.max(F.nullif(F.regexp_extract("_l", r"^author (.*)$", 1), F.lit(""))).alias("author"), F.max(F.nullif(F.regexp_extract("_l", r"^author-time (\d+)$", 1), F.lit(""))).cast("bigint").alias("time"))
    return r.where(F.col("_l").startswith("\t")).select(key, "line", "commit").join(by_commit, [key, "commit"])


def diagnostics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, line, col, message of compiler lines `file:line:col: message` or `file(line,col): message`."""
    a, b = r"^([^\s:][^:]*):(\d+):(\d+): (.*)$", r"^([^\s(][^(]*)\((\d+),(\d+)\): (.*)$"
    rows = _lines(texts, key, text)
    part = lambda p: rows.where(F.col("_l").rlike(p)).select(key, F.regexp_extract("_l", p, 1).alias("file"), F.regexp_extract("_l", p, 2).cast("int").alias("line"), F.regexp_extract("_l", p, 3).cast("int").alias("col"), F.regexp_extract("_l", p, 4).alias("message"))
    return part(a).unionByName(part(b))
