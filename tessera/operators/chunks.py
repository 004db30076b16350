"""Cutting texts into chunks of a token budget, and snippets around a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import token_estimate


def line_chunks(texts: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """key, chunk (from 0), start_line, end_line, tokens: runs of whole lines within the budget.

    Greedy, like a reader: a chunk takes lines while their estimated tokens fit, a line above the budget stands alone.
    The lines of one text are folded by an aggregate expression in the JVM, so no text is exploded or moved.
    """
    cost = F.transform(F.split(text, "\n", -1), lambda line: token_estimate(line).cast("int"))
    zero = F.expr("named_struct('done', cast(array() as array<struct<s:int,e:int,t:int>>), 's', 1, 'i', 0, 't', 0)")

    def take(acc, c):
        i = acc["i"] + 1
        full = (acc["t"] + c > budget) & (acc["i"] >= acc["s"])
        closed = F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["i"].alias("e"), acc["t"].alias("t"))))
        return F.struct(F.when(full, closed).otherwise(acc["done"]).alias("done"), F.when(full, i).otherwise(acc["s"]).alias("s"), i.alias("i"), F.when(full, c).otherwise(acc["t"] + c).alias("t"))

    end = F.aggregate(F.col("_c"), zero, take, lambda a: F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["i"].alias("e"), a["t"].alias("t")))))
    rows = texts.where(F.col(text).isNotNull()).select(key, cost.alias("_c")).select(key, F.posexplode(end).alias("chunk", "_x"))
    return rows.select(key, "chunk", F.col("_x.s").alias("start_line"), F.col("_x.e").alias("end_line"), F.col("_x.t").alias("tokens"))


def snippet_lines(start: int | None, end: int | None, line: int, total: int, around: int = 8) -> tuple[int, int]:
    """Lines to show for a cursor: the span that holds it, else `around` lines on both sides, within the text."""
    if start is not None and end is not None and start <= line <= end:
        return max(1, start), min(total, end)
    return max(1, line - around), min(total, line + around)


def symbol_chunks(texts: DataFrame, symbols: DataFrame, budget: int) -> DataFrame:
    """path, kind, name, start_line, end_line, tokens, body: one chunk per symbol, the header before the first one, and
    the whole file where it has none.

    A chunk above the budget loses trailing lines until it fits, at least one line stays, and a line that is too long
    alone is cut to four characters a token (on characters, so no letter is split). Blank headers are left out.
    """
    spans = symbols.select(F.col("file").alias("path"), "kind", "name", "start_line", "end_line")
    first = spans.groupBy("path").agg(F.min("start_line").alias("_first"))
    rest = texts.where("content IS NOT NULL").select("path", "content").join(first, "path", "left").withColumn("_n", F.size(F.split("content", "\n", -1)))
    head = rest.where("_first > 1").select("path", F.lit("file_header").alias("kind"), F.lit("").alias("name"), F.lit(1).alias("start_line"), (F.col("_first") - 1).alias("end_line"), "content")
    whole = rest.where("_first IS NULL").select("path", F.lit("file").alias("kind"), F.lit("").alias("name"), F.lit(1).alias("start_line"), F.col("_n").alias("end_line"), "content")
    own = spans.join(texts.where("content IS NOT NULL").select("path", "content"), "path").select("path", "kind", "name", "start_line", "end_line", "content")
    rows = own.unionByName(head).unionByName(whole).withColumn("_l", F.slice(F.split("content", "\n", -1), F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))))
    # bytes of each prefix of whole lines; trailing white space doesn't count, so prefixes are measured by their text
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_l"), F.lit(1))), lambda k: token_estimate(F.array_join(F.slice("_l", F.lit(1), k), "\n")) <= budget)
    quick = token_estimate(F.array_join("_l", "\n")) <= budget
    kept = rows.withColumn("_k", F.when(quick, F.size("_l")).otherwise(F.greatest(F.coalesce(F.array_max(fits), F.lit(1)), F.lit(1))))
    body = F.array_join(F.slice("_l", F.lit(1), F.col("_k")), "\n")
    cut = kept.withColumn("_b", body).withColumn("body", F.when(token_estimate("_b") > budget, F.substring("_b", 1, budget * 4)).otherwise(F.col("_b")))
    out = cut.select("path", "kind", "name", "start_line", (F.col("start_line") + F.col("_k") - 1).alias("end_line"), token_estimate("body").alias("tokens"), "body")
    return out.where("kind <> 'file_header' OR tokens > 0")


def related(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """id, dist, score of what roots call, near and often called first: edge counts plus closeness, summed per node."""
    from tessera.operators.graph import distances

    near = distances(edges, roots, depth)
    met = edges.join(near.select(F.col("id").alias("src"), F.col("dist").alias("_d")), "src").where(F.col("_d") < depth)
    score = met.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("count") + depth - F.col("_d") - 1).alias("score"))
    return near.where("dist > 0").join(score, "id").select("id", "dist", "score")
