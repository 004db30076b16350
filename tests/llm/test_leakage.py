import random

import numpy as np

from tessera.llm import leakage as L
from tessera.llm import reading as R

STEMS = "anchor ballot candle drought engine farmer garden harbour inquest journey kettle lantern market orchard parish quarry river school tailor uniform valley weaver".split()


def words(rnd, n):
    return [rnd.choice(STEMS) + rnd.choice(["", "man", "less", "ward", "ful"]) for _ in range(n)]


def page(spark_rows, spark):
    return spark.createDataFrame(spark_rows, "doc_id BIGINT, text STRING, line_boxes ARRAY<STRUCT<x: INT, y: INT, w: INT, h: INT, conf: DOUBLE>>, words STRING")


def set_in_columns(text_words, columns=2, per_line=5, hyphen="-"):
    """Lines and boxes of a page set in columns; some words are broken at line ends."""
    lines, k = [], 0
    rest = ""
    while k < len(text_words):
        part = ([rest] if rest else []) + text_words[k : k + per_line]
        k += per_line
        rest = ""
        if len(part[-1]) > 6 and k < len(text_words):
            rest, part[-1] = part[-1][4:], part[-1][:4] + hyphen
        lines.append(" ".join(part))
    if rest:
        lines.append(rest)
    each = -(-len(lines) // columns)
    boxes = [(60 + (i // each) * (2340 // columns), 200 + 38 * (i % each), 15 * len(t), 31, 0.9) for i, t in enumerate(lines)]
    return lines, boxes, each


def test_reading_order_of_columns_read_across_and_mended_words():
    rnd = random.Random(2)
    w = words(rnd, 90)
    for hyphen in ("-", "¬", "="):
        lines, boxes, each = set_in_columns(w, hyphen=hyphen)
        order = sorted(range(len(lines)), key=lambda i: (boxes[i][1], boxes[i][0]))  # read across, boxes kept
        x, y, wd, h = (np.array([boxes[i][k] for i in order], float) for k in range(4))
        got, _ = R.join_lines(R.order_lines([lines[i] for i in order], x, y, wd, h))
        assert got == w
    # run together: one line for both columns
    both = [lines[i] + ("    " + lines[i + each] if i + each < len(lines) else "") for i in range(each)]
    x, y, wd, h = np.full(each, 60.0), np.arange(each) * 38.0, np.full(each, 2200.0), np.full(each, 31.0)
    got, _ = R.join_lines(R.order_lines(both, x, y, wd, h))
    assert got == w


def test_tiles_against_a_plain_greedy_search():
    rnd = random.Random(4)
    for _ in range(40):
        a, b = [rnd.randint(1, 6) for _ in range(25)], [rnd.randint(1, 6) for _ in range(40)]
        got = L.tiles(a, b)
        assert all(a[i : i + k] == b[p : p + k] for k, i, p in got)
        for side in (1, 2):
            taken = [x for t in got for x in range(t[side], t[side] + t[0])]
            assert len(taken) == len(set(taken))
        left_a, left_b = [v for v in range(25) if not any(i <= v < i + k for k, i, _ in got)], [v for v in range(40) if not any(p <= v < p + k for k, _, p in got)]
        assert not any(x + 1 in left_a and y + 1 in left_b and a[x : x + 2] == b[y : y + 2] for x in left_a for y in left_b)


def test_cases_and_no_cases(spark):
    rnd = random.Random(9)
    items = {1: words(rnd, 40), 2: words(rnd, 30), 3: words(rnd, 25)}
    misread = list(items[1][5:25])
    for k in (2, 7, 12, 17):
        misread[k] = misread[k].replace("a", "o", 1).replace("r", "x", 1) if "r" in misread[k] or "a" in misread[k] else misread[k] + "."
    too_many = [w.replace("e", "c").replace("a", "o") + "q" if k % 2 else w for k, w in enumerate(items[1][5:25])]
    moved = items[2][:]
    rnd.shuffle(moved)
    fill = lambda n=30: words(rnd, n)
    split = fill() + items[3][:9] + fill(4) + ["x"] * 20 + items[3][9:]
    texts = {
        10: fill() + misread + fill(),
        11: fill() + items[2][:9] + fill(),  # too short
        12: fill() + moved + fill(),  # other order
        13: items[3] + fill(),
        14: fill() + too_many + fill(),
        15: fill() + items[2][3:18] + fill(),  # just long enough
        16: split,
    }
    rows = []
    for k, w in texts.items():
        lines, boxes, _ = set_in_columns(w, columns=1 + k % 3)
        rows.append((k, "\n".join(lines).upper() if k == 13 else " , ".join("\n".join(lines).split(" ")), boxes, "clash"))
    rows += [(20, None, None, None), (21, "", [], None), (None, "x", None, None), (22, " ".join(items[3]), None, None), (23, "long " * 50_000 + " ".join(items[3]), None, None)]
    pages = R.page_words(page(rows, spark))
    its = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(4, " ".join(items[3])), (5, None), (6, "")], "item_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(pages, L.item_words(its)).collect()}
    assert got == {(10, 1), (13, 3), (13, 4), (15, 2), (16, 3), (16, 4), (22, 3), (22, 4), (23, 3), (23, 4)}
    assert L.leaks(pages.limit(0), L.item_words(its)).count() == 0


def test_misread_words_resemble():
    for a, b in [("methodless", "rnetbodless"), ("for", "f0x"), ("candleless", "candlelest"), ("measureward", "mcasurewarc1"), ("journeykeeper", "jourueykeeper"), ("clerk", "elerk"), ("droughtlike", "drouqhtlike")]:
        assert L.resembles(a, b)
    for a, b in [("harbour", "kettle"), ("the", "of"), ("market", "parish")]:
        assert not L.resembles(a, b)


def test_misread_words_at_either_end_count():
    item = words(random.Random(11), 15)
    wrong = lambda w: w[:-1] + "~"
    for at in [(0,), (14,), (0, 14), (0, 7, 14), (0, 1, 14)]:
        page = ["zzzz"] * 5 + [wrong(w) if k in at else w for k, w in enumerate(item)] + ["zzzz"] * 5
        numbers = {w: k for k, w in enumerate(dict.fromkeys(item + page), 1)}
        found = L.tiles([numbers[w] for w in item], [numbers[w] for w in page])
        assert L.longest_passage(item, page, found) == 15
    assert L._window([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1], L.MISREAD) < 15


def test_cut_and_glued_words_between_misread_ones_keep_a_pair(spark):
    item = words(random.Random(12), 15)
    wrong = {k: item[k][:-1] + "~" for k in (3, 7, 11)}
    cut = lambda at: [p for k, w in enumerate(item) for p in ([wrong[k]] if k in wrong else [w[:3], w[3:]] if k in at else [w])]
    glued = [p for k, w in enumerate(item) for p in ([] if k in (1, 5, 9, 13) else [wrong[k]] if k in wrong else [w + item[k + 1]] if k in (0, 4, 8, 12) else [w])]
    rows = [(1, cut((1, 5, 9, 13))), (2, cut((1, 5, 9))), (3, cut(range(15))), (4, glued), (5, cut(())), (6, item[:14])]
    pages = spark.createDataFrame(rows, "doc_id BIGINT, words ARRAY<STRING>")
    items = spark.createDataFrame([(1, item)], "item_id BIGINT, item_words ARRAY<STRING>")
    assert {r["doc_id"]: r["longest"] for r in L.leaks(pages, items).collect()} == {k: 15 for k in (1, 2, 3, 4, 5)}
