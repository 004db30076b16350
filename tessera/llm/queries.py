"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import components, layout, leakage, mixing, near_duplicates, percentiles, reading, shared_spans, syntax
from tessera.session import materialise
from tessera.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(table(spark, d, "pairs")).select(F.col("v").alias("function_id"), "group_id")


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components.group_sizes(components.components(table(spark, d, "pairs")))


#: Threshold and shingle size of the match score of function bodies, as the data's description states them.
BODY_SCORE, BODY_SHINGLE = 0.7, 3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    member, links = near_duplicates.near_duplicate_classes(table(spark, d, "prints"), "print_id", "body", BODY_SCORE, BODY_SHINGLE)
    return near_duplicates.all_pairs(member, links, "print_id").select("print_id_a", "print_id_b")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Matches with their method: each copy and its class's first body (exact), and pairs of classes (ngram)."""
    member, links = near_duplicates.near_duplicate_classes(table(spark, d, "prints"), "print_id", "body", BODY_SCORE, BODY_SHINGLE)
    return near_duplicates.matches(member, links, "print_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per function body: its class of equal bodies, its group over all links, and its class's number of links."""
    member, links = near_duplicates.near_duplicate_classes(table(spark, d, "prints"), "print_id", "body", BODY_SCORE, BODY_SHINGLE)
    links = materialise(links, "links")
    group = components.components(links).withColumnRenamed("v", "cls")
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    rows = member.join(group, "cls", "left").join(ends, "cls", "left")
    return rows.select("print_id", "cls", F.coalesce("group_id", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["package", "metric"]
    values = materialise(percentiles.measured(table(spark, d, "function_metrics")).drop("day"), "measured")
    sketches = percentiles.merge(percentiles.build(values, keys), keys)
    said = table(spark, d, "package_risk").select("package", F.expr("stack(2, 'p90_cyclomatic', cast(p90_cyclomatic as double), 'p90_risk', p90_risk) AS (metric, published)"))
    shares = materialise(percentiles.shares_at(sketches.join(said.where("published IS NOT NULL").distinct(), keys), keys, "published"), "shares")
    return percentiles.suspicious(shares, values, keys, "published").distinct()


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and others per package and metric, combined from one sketch per measuring day."""
    keys = ["package", "metric"]
    daily = percentiles.merge(percentiles.build(percentiles.measured(table(spark, d, "function_metrics")), [*keys, "day"]), [*keys, "day"])
    return percentiles.quantiles(percentiles.merge(daily, keys), keys, [0.5, 0.9, 0.99])


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    pages = materialise(reading.page_words(table(spark, d, "documents")), "page-words")
    items = materialise(leakage.item_words(table(spark, d, "eval_items")), "item-words")
    return leakage.leaks(pages, items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked test item: the pages that hold a passage of it, and the longest passage."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("pages"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialise(mixing.token_counts(table(spark, d, "documents")), "token-counts")
    planned = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return planned, mixing.replicate(sizes, planned)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    planned, copies = _mix(spark, d)
    return mixing.short_of_target(copies, planned)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    planned, copies = _mix(spark, d)
    return mixing.shares(copies, planned)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_mix(spark, d)[1])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    member, spans = shared_spans.shared_spans(table(spark, d, "documents"))
    return shared_spans.pairs(member, spans)


def p10_amount(spark: SparkSession, d: str) -> DataFrame:
    """Per page: its length and how many of its characters stand in a long stretch of another page."""
    member, texts = shared_spans.distinct_texts(table(spark, d, "documents"))
    return shared_spans.shared_amount(member, shared_spans.shared_windows(texts, shared_spans.repeated_edges(texts)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parsed(table(spark, d, "sources")).where("NOT ok").select("path")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(materialise(syntax.parsed(table(spark, d, "sources")), "parsed"), table(spark, d, "errors"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return layout.classified(table(spark, d, "sources")).where(F.size("reasons") > 0).select("path")


def p6_detector(spark: SparkSession, d: str) -> DataFrame:
    """Files by language and reason, and how many of them the project's own detector had marked."""
    return layout.against_detector(materialise(layout.classified(table(spark, d, "sources")), "classified"), table(spark, d, "files"))


QUERIES = {"p6_found": p6_found, "p6_detector": p6_detector, "p3_found": p3_found, "p3_rates": p3_rates, "p10_found": p10_found, "p10_amount": p10_amount, "p9_found": p9_found, "p9_shares": p9_shares, "p9_mix": p9_mix, "p8_found": p8_found, "p8_items": p8_items, "p2_found": p2_found, "p2_links": p2_links, "p2_groups": p2_groups, "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p7_found": p7_found, "p7_sizes": p7_sizes}

_GROUPS = """RECURSIVE e AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
    r AS (SELECT a AS v, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.v AND r.g < e.b),
    groups_ AS (SELECT v AS function_id, min(g) AS group_id FROM r GROUP BY v)"""

_MEASURED = """once AS (SELECT max(struct_pack(l := loaded_at, p := package, c := cyclomatic, k := risk)) AS r FROM function_metrics GROUP BY function_id, measured_at),
    v AS (SELECT r.p AS package, 'p90_cyclomatic' AS metric, CAST(r.c AS DOUBLE) AS value FROM once WHERE r.c <> -1
          UNION ALL SELECT r.p, 'p90_risk', r.k FROM once WHERE r.k IS NOT NULL)"""

_BODIES = r"""once AS (SELECT print_id, min(body) AS body FROM prints WHERE body IS NOT NULL GROUP BY 1),
    hexed AS (SELECT print_id, regexp_replace(body, '0x[0-9a-fA-F]+', 'ADDR', 'g') AS t FROM once),
    found AS (SELECT print_id, t, regexp_extract_all(t, '(?:var|local)_[0-9]+') AS ms, string_split_regex(t, '(?:var|local)_[0-9]+') AS ps FROM hexed),
    named AS (SELECT print_id, ps, list_transform(ms, lambda m: 'v' || (list_position(list_filter(ms, lambda x, i: list_position(ms, x) = i), m) - 1)) AS ns FROM found),
    norm AS (SELECT print_id, trim(regexp_replace(array_to_string(list_transform(ps, lambda p, i: p || coalesce(ns[i], '')), ''), '\s+', ' ', 'g')) AS n FROM named),
    words AS (SELECT print_id, n, string_split(n, ' ') AS w FROM norm),
    grams AS (SELECT DISTINCT print_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT print_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
    sizes AS (SELECT print_id, count(*) AS k FROM grams GROUP BY 1),
    both_ AS (SELECT x.print_id AS a, y.print_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.print_id < y.print_id GROUP BY 1, 2)"""

ORACLE = {
    "p2_found": f"""WITH {_BODIES} SELECT a AS print_id_a, b AS print_id_b FROM both_ JOIN sizes p ON p.print_id = a JOIN sizes q ON q.print_id = b WHERE c >= 0.7 * (p.k + q.k - c)
        UNION SELECT x.print_id, y.print_id FROM norm x JOIN norm y ON x.n = y.n AND x.print_id < y.print_id""",
    "p4_found": f"""WITH {_MEASURED}, s AS (SELECT package, 'p90_cyclomatic' AS metric, CAST(p90_cyclomatic AS DOUBLE) AS x FROM package_risk
        UNION SELECT package, 'p90_risk', p90_risk FROM package_risk)
        SELECT package, metric FROM v JOIN s USING (package, metric) WHERE x IS NOT NULL GROUP BY package, metric
        HAVING 100 * count(*) FILTER (WHERE value < x) > 95 * count(*) OR 100 * count(*) FILTER (WHERE value <= x) < 85 * count(*)""",
    "p7_found": f"WITH {_GROUPS} SELECT function_id, group_id FROM groups_",
    "p7_sizes": f"WITH {_GROUPS}, n AS (SELECT group_id, count(*) AS members FROM groups_ GROUP BY 1) SELECT members, count(*) AS groups FROM n GROUP BY 1",
}
