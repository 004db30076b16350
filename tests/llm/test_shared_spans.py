import random

import numpy as np

from tessera.llm import shared_spans as S


def common(a, b):
    """Greatest common substring length, by a table."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def run(spark, rows, length, few=16):
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "'clash' AS id", "1 AS path", "doc_id AS a")
    member, spans = S.shared_spans(df, length=length, few=few)
    found = {(r["doc_id_a"], r["doc_id_b"]) for r in S.pairs(member, spans, length).collect()}
    member, texts = S.distinct_texts(df, length=length)
    return found, {r["doc_id"]: r["shared_chars"] for r in S.shared_amount(member, S.shared_windows(texts, S.repeated_edges(texts, length), length), length).collect()}


def brute(rows, length):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    return {(a, b) for a in texts for b in texts if a < b and common(texts[a], texts[b]) >= length}


def brute_amount(texts, length):
    out = {}
    for i, t in texts.items():
        hit = np.zeros(len(t), bool)
        for j, u in texts.items():
            if i != j:
                for k in range(len(t) - length + 1):
                    if t[k : k + length] in u:
                        hit[k : k + length] = True
        out[i] = int(hit.sum())
    return out


def test_spans_around_the_limit_at_every_offset(spark):
    rnd = random.Random(3)
    letters = "abcdefgh \n\u00e9\U0001f600"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    length, rows = 40, []
    for k in range(24):
        core = make(rnd.choice([38, 39, 40, 41, 60]))
        rows += [(10 * k, make(rnd.randint(0, 50)) + "1" + core + "2" + make(rnd.randint(0, 50))), (10 * k + 1, make(rnd.randint(0, 50)) + "3" + core + "4" + make(rnd.randint(0, 50)))]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, ""), (None, rows[2][1]), (1004, "x" * 90), (1005, "x" * 45 + "y"), (1006, "ab" * 60), (1007, "ba" * 20), (1008, "x" * 39)]
    rows += [(1100 + i, "a common opening of some forty-five characters " + make(20)) for i in range(8)] + [(rows[4][0], rows[4][1])]
    found, amount = run(spark, rows, length)
    want = brute(rows, length)
    assert found == want
    for few in (0, 3):  # all edges, or the more frequent ones, by way of their windows
        assert run(spark, rows, length, few)[0] == want
    assert amount == brute_amount({i: t for i, t in rows if i is not None and t is not None}, length)


def test_stretches_of_the_standard_length(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["anchor", "ballot", "candle", "drought", "of", "the", "to"])
    make = lambda n: " ".join(word() for _ in range(n))
    core = make(80)
    rows = [(1, make(60) + core[:200] + "#" + make(30)), (2, core[:200] + "+" + make(90)), (3, make(20) + "-" + core[1:200]), (4, core * 3000)]
    found, _ = run(spark, rows, 200)
    assert found == {(1, 2), (1, 4), (2, 4)}


def test_a_passage_below_the_limit_in_many_texts_costs_no_pairs(spark):
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    hot = make(150)
    rows = [(i, make(60) + hot + make(60)) for i in range(60)] + [(100, rows_ := make(80) + hot + make(80)), (101, "#" + rows_[10:] + "#")]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    edges = S.repeated_edges(df, 200)
    assert {r["id"] for r in S.shared_windows(df, edges, 200).select("id").distinct().collect()} == {100, 101}
    assert [(r["a"], r["b"], r["n"]) for r in S.shared(df, edges, 200).collect()] == [(100, 101, len(rows_) - 10)]


def test_empty(spark):
    assert run(spark, [], 200) == (set(), {})


def test_an_edge_is_the_text_behind_it():
    t = np.frombuffer(("abc" * 30 + "the quick brown fox jumps over the lazy dog " * 4).encode("utf-32-le"), np.uint32)
    cuts, edges = S.edges_at_cuts(t, 4, 10, 21)
    seen = {}
    for c, e in zip(cuts, edges):
        assert seen.setdefault(e, bytes(t[c : c + 21])) == bytes(t[c : c + 21])
    assert len(set(seen.values())) == len(seen)
