import random

from tessera.llm import near_duplicates as N


def grams(norm, k):
    w = norm.split(" ")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, t, k):
    norm = {}
    for i, x in rows:
        if i is not None and x is not None:
            norm[i] = min(norm.get(i, N.normalise_body(x)), N.normalise_body(x))
    out = {}
    for a in norm:
        for b in norm:
            if a < b:
                x, y = grams(norm[a], k), grams(norm[b], k)
                s = 1.0 if norm[a] == norm[b] else len(x & y) / len(x | y) if x | y else 0
                if s >= t:
                    out[a, b] = round(s, 9)
    return out


def run(spark, rows, t=0.7, k=3):
    df = spark.createDataFrame(rows, "id BIGINT, body STRING")
    member, links = N.near_duplicate_classes(df, "id", "body", t, k)
    return {(r["id_a"], r["id_b"]): round(r["score"], 9) for r in N.all_pairs(member, links, "id").collect()}


def test_normalise():
    assert N.normalise_body("  local_0 = local_1 +\tvar_3\n local_0 = local_1 [0x4f]") == "v0 = v1 + v2 v0 = v1 [ADDR]"


def test_against_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(40):
        base = rnd.choices(words, k=rnd.randint(8, 40))
        rows.append((10 * i, " ".join(base)))
        for j in range(1, 4):
            edit = list(base)
            for _ in range(j - 1):
                at = rnd.randrange(len(edit))
                rnd.choice([lambda: edit.insert(at, "new"), lambda: edit.pop(at), lambda: edit.__setitem__(at, "x")])()
            rows.append((10 * i + j, "  ".join(edit)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a\tb"), (None, "a b"), (0, rows[0][1]), (7, "a b c")]
    want = brute(rows, 0.7, 3)
    assert run(spark, rows) == want and len(want) > 60
    assert run(spark, rows, 0.8, 5) == brute(rows, 0.8, 5)


def test_hot_class_and_empty_table(spark):
    rows = [(i, "p q r s t u v") for i in range(60)] + [(100 + i, f"p q r s t u v {i}") for i in range(5)]
    assert run(spark, rows) == brute(rows, 0.7, 3)
    assert run(spark, []) == {}


def test_matches_name_their_method(spark):
    rows = [(i, "p q r s t u v w x y") for i in (4, 2, 9)] + [(7, "p q r s t u v w x y z")]
    df = spark.createDataFrame(rows, "id BIGINT, body STRING")
    member, links = N.near_duplicate_classes(df, "id", "body", 0.7, 3)
    assert {(r["a"], r["b"], r["method"]) for r in N.matches(member, links, "id").collect()} == {(2, 4, "exact"), (2, 9, "exact"), (2, 7, "ngram")}
