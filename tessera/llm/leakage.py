"""Evaluation texts that leak into training text, by greedy string tiling.

Runs of three successive words are the seeds, in each form that line ends, specks and lost blanks give them: a seed join
of pages and test items gives the candidate pairs. A pair's
word sequences are tiled: the longest common runs are found by a running Karp-Rabin hash and marked, longest first and
without overlap, until no run of two unmarked words is left. Tiles that follow each other in both texts form passages;
between and around tiles the words are aligned one to one, and a word that resembles its counterpart counts as misread.
An item has leaked if a passage covers enough successive words of it; items whose tiles lie in another order form no
passage, but their coverage is reported (`coverage`), which catches reordered copies where those are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.reading import words_of
from tessera.session import materialise

SEED = 3
#: Successive words of the item that make a case, and the share of them that may be misread.
LEAST, MISREAD = 15, 0.2
#: Seeds up to which the items' side of the seed join is broadcast (about 40 bytes each); beyond it is shuffled.
BROADCAST_SEEDS = 1_000_000
#: Words that may lie between two tiles of one passage on either side.
_BRIDGE = 6
_TILE = 2
_BASE, _MOD = 1_000_003, (1 << 61) - 1
#: What a recogniser confuses, as replacements that bring both readings to one form; applied in this order.
CONFUSED = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("c1", "d"), ("ii", "u"), ("0", "o"), ("1", "l"), ("i", "l"), ("j", "l"), ("c", "e"), ("o", "e"), ("a", "e"), ("h", "b"), ("x", "r"), ("k", "r"), ("n", "u"), ("q", "g"), ("f", "s"), ("t", "s"), ("l", "s")]


def folded(word: str) -> str:
    for a, b in CONFUSED:
        word = word.replace(a, b)
    return word


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] if row[-1] <= most else most + 1


def resembles(a: str, b: str) -> bool:
    """b may be a misreading of a: a third of the letters at most differ, as they stand or with confusions resolved."""
    for x, y in ((a, b), (folded(a), folded(b))):
        most = max(len(x), len(y)) // 3
        if x == y or most and _distance(x, y, most) <= most:
            return True
    return False


def _runs(item: list[int], page: list[int], used_i: bytearray, used_p: bytearray, size: int) -> list[tuple[int, int, int]]:
    """Common runs of at least `size` unmarked words that can't be extended: (length, place in item, place in page)."""
    power = pow(_BASE, size, _MOD)

    def windows(words: list[int], used: bytearray) -> Iterator[tuple[int, int]]:
        value = free = 0
        for k, w in enumerate(words):
            value, free = (value * _BASE + w) % _MOD, 0 if used[k] else free + 1
            if k >= size:
                value = (value - words[k - size] * power) % _MOD
            if free >= size:
                yield k - size + 1, value

    table: dict[int, list[int]] = {}
    for at, value in windows(item, used_i):
        table.setdefault(value, []).append(at)
    found = []
    for p, value in windows(page, used_p):
        for i in table.get(value, ()):
            if i and p and not used_i[i - 1] and not used_p[p - 1] and item[i - 1] == page[p - 1]:
                continue  # part of a run that began earlier
            k = 0
            while i + k < len(item) and p + k < len(page) and not used_i[i + k] and not used_p[p + k] and item[i + k] == page[p + k]:
                k += 1
            if k >= size:
                found.append((k, i, p))
    return found


def tiles(item: list[int], page: list[int], least: int = _TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word numbers (1 and up): (length, place in item, place in page)."""
    used_i, used_p = bytearray(len(item)), bytearray(len(page))
    out = []
    size = max(least, min(len(item), len(page), 8))
    while True:
        for k, i, p in sorted(_runs(item, page, used_i, used_p, size), key=lambda t: (-t[0], t[1], t[2])):
            if any(used_i[i : i + k]) or any(used_p[p : p + k]):
                continue  # the rest of it is found in the next turn
            used_i[i : i + k] = used_p[p : p + k] = b"\x01" * k
            out.append((k, i, p))
        if size == least and not any(True for _ in _runs(item, page, used_i, used_p, size)):
            return out
        size = max(least, size // 2)


def _mend(item: list[str], words: list[str]) -> list[str]:
    """The page's words as the item has them: those cut by line ends or specks joined, those run together taken apart.

    Only where the page's form is no word of the item and the other form is.
    """
    known, glued = set(item), {}
    for x, y in zip(item, item[1:]):
        glued.setdefault(x + y, (x, y))
    out: list[str] = []
    for w in words:
        if out and out[-1] + w in known and not (out[-1] in known and w in known):
            out[-1] += w
        elif w in glued and w not in known:
            out += glued[w]
        else:
            out.append(w)
    return out


def _fill(item: list[str], page: list[str]) -> list[int]:
    """Status of each item word in a gap between tiles: 0 exact, 1 misread, 2 absent. Few words on both sides."""
    n, m = len(item), len(page)
    if not n:
        return []
    inf = 10**6
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    step: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
    cost[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c >= inf:
                continue
            def go(di: int, dj: int, price: int, status: list[int], c=c, i=i, j=j) -> None:
                if i + di <= n and j + dj <= m and c + price < cost[i + di][j + dj]:
                    cost[i + di][j + dj] = c + price
                    step[i + di, j + dj] = (i, j, status)
            if i < n and j < m:
                if item[i] == page[j]:
                    go(1, 1, 0, [0])
                elif resembles(item[i], page[j]):
                    go(1, 1, 10, [1])
                if i + 1 < n:
                    both = item[i] + item[i + 1]
                    if both == page[j]:
                        go(2, 1, 1, [0, 0])
                    elif resembles(both, page[j]):
                        go(2, 1, 20, [1, 1])
                if j + 1 < m:
                    joined = page[j] + page[j + 1]
                    if item[i] == joined:
                        go(1, 2, 1, [0])
                    elif resembles(item[i], joined):
                        go(1, 2, 12, [1])
            if i < n:
                go(1, 0, 30, [2])
            go(0, 1, 8, [])
    out: list[int] = []
    at = (n, m)
    while at != (0, 0):
        i, j, status = step[at]
        out = status + out
        at = (i, j)
    return out


def _end(item: list[str], page: list[str]) -> list[int]:
    """Status of the item words after the last tile (or, both reversed, before the first), word by word."""
    out: list[int] = []
    i = j = 0
    while i < len(item) and j < len(page):
        if item[i] == page[j]:
            out.append(0)
            i, j = i + 1, j + 1
        elif i + 1 < len(item) and item[i] + item[i + 1] == page[j]:
            out += [0, 0]
            i, j = i + 2, j + 1
        elif j + 1 < len(page) and item[i] == page[j] + page[j + 1]:
            out.append(0)
            i, j = i + 1, j + 2
        elif resembles(item[i], page[j]):
            out.append(1)
            i, j = i + 1, j + 1
        else:
            break
    return out


def longest_passage(item: list[str], page: list[str], found: list[tuple[int, int, int]], misread: float = MISREAD) -> int:
    """Most successive item words that stand in the page in order, at most a share of them misread."""
    order = sorted(found, key=lambda t: t[1])
    best = 0
    chains: list[list[tuple[int, int, int]]] = []
    for t in order:
        home = None
        for c in chains:
            k, i, p = c[-1]
            gap_i, gap_p = t[1] - i - k, t[2] - p - k
            if 0 <= gap_i <= _BRIDGE and 0 <= gap_p <= _BRIDGE and abs(gap_i - gap_p) <= 3:
                home = c
                break
        if home is None:
            chains.append([t])
        else:
            home.append(t)
    for c in chains:
        first, last = c[0], c[-1]
        before_i, before_p = item[: first[1]][::-1], page[: first[2]][::-1]
        # the joined forms compare reversed words, so glued words at the front are left to the forward direction
        status = _end(before_i, before_p)[::-1]
        for a, b in zip(c, c[1:]):
            status += [0] * a[0] + _fill(item[a[1] + a[0] : b[1]], page[a[2] + a[0] : b[2]])
        status += [0] * last[0] + _end(item[last[1] + last[0] :], page[last[2] + last[0] :])
        best = max(best, _window(status, misread))
    return best


def _window(status: list[int], misread: float) -> int:
    """Longest window without absent words of which few enough are misread, wherever in it they stand."""
    best = 0
    for s in range(len(status)):
        wrong = 0
        for e in range(s, len(status)):
            if status[e] == 2:
                break
            wrong += status[e]
            if wrong <= misread * (e - s + 1):
                best = max(best, e - s + 1)
    return best


def _possible(item: list[str], page: list[str], least: int, misread: float) -> bool:
    """Whether a passage of `least` words can come out, by the item words that the page has anywhere, cut or run together too."""
    there = set(page)
    there.update(map(str.__add__, page, page[1:]))
    status = [int(w not in there) for w in item]
    for k, (a, b) in enumerate(zip(item, item[1:])):
        if a + b in there:
            status[k] = status[k + 1] = 0
    return status.count(0) >= (1 - misread) * least - 1e-9 and _window(status, misread) >= least


def _judge(least: int, misread: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, item_id, words, item in zip(b["doc_id"], b["item_id"], b["words"], b["item_words"]):
            item = list(item)
            page = _mend(item, list(words))
            if not _possible(item, page, least, misread):
                continue
            numbers: dict[str, int] = {}
            coded_i = [numbers.setdefault(w, len(numbers) + 1) for w in item]
            coded_p = [numbers.setdefault(w, len(numbers) + 1) for w in page]
            found = tiles(coded_i, coded_p)
            covered = sum(k for k, _, _ in found)
            longest = longest_passage(item, page, found, misread)
            rows.append((doc, item_id, longest, covered / max(1, len(item))))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest", "coverage"])


def _seeds(words: Column) -> Column:
    """Runs of two and of three successive words."""
    def runs(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.element_at(words, (i + k + 1).cast("int")) for k in range(n))))
        return F.when(F.size(words) >= n, at).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(runs(SEED), runs(SEED - 1)))


def item_runs(item: list[str]) -> set[tuple[str, ...]]:
    """The runs with which a page can begin three successive words of the item, if it has them right.

    Each word may stand whole or cut in two by a line end or a speck, and two words may be run together. The first three
    words of the page are a run; where only two stand there, one of them is two words of the item.
    """
    cut = lambda w: [(w[:k], w[k:]) for k in range(1, len(w))]
    out: set[tuple[str, ...]] = set()
    for a, b, c in zip(item, item[1:], item[2:]):
        forms = [[(w,), *cut(w)] for w in (a, b, c)]
        out.update((x + y + z)[:SEED] for x in forms[0] for y in forms[1] for z in (forms[2] if len(x + y) < SEED else [()]))
        out |= {(a + b, c), (a, b + c)} | {(a + b, *z) for z in cut(c)} | {(*x, b + c) for x in cut(a)}
    return out


def _item_seeds(items: DataFrame) -> DataFrame:
    """item_id, seed: the runs of each item as a page may have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, words in enumerate(b.column("item_words").to_pylist()):
                found = [list(r) for r in item_runs(words)]
                ids = b.column("item_id").take(pa.array([k] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.string()))], ["item_id", "run"])

    runs = items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, run ARRAY<STRING>")
    part = [F.element_at("run", k + 1) for k in range(SEED - 1)]
    seed = F.when(F.size("run") < SEED, F.xxhash64(*part)).otherwise(F.xxhash64(*part, F.try_element_at("run", F.lit(SEED))))
    return runs.select("item_id", seed.alias("seed")).distinct()


def item_words(items: DataFrame) -> DataFrame:
    """item_id, item_words: one row per item; NULL texts and ids dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "item_words": [words_of(t) for t in b["text"]]})

    once = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    return once.mapInPandas(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, item_words ARRAY<STRING>")


def candidates(pages: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: pairs with a seed in common."""
    theirs = materialise(_item_seeds(items), "item-seeds")
    if theirs.count() <= BROADCAST_SEEDS:
        theirs = F.broadcast(theirs)
    ours = pages.select("doc_id", F.explode(_seeds(F.col("words"))).alias("seed"))
    return ours.join(theirs, "seed").select("doc_id", "item_id").distinct()


def leaks(pages: DataFrame, items: DataFrame, least: int = LEAST, misread: float = MISREAD) -> DataFrame:
    """doc_id, item_id, longest, coverage of pairs whose longest passage has at least `least` words.

    pages: doc_id, words; items: item_id, item_words. Of 15 words with three misread, three right ones follow each other
    somewhere; `item_runs` has every form in which a page may hold these, so one seed is asked for.
    """
    pairs = materialise(candidates(pages, items), "leak-candidates")
    # the words of pages travel for this join, so only those of candidates
    met = materialise(pairs.select("doc_id").distinct(), "candidate-pages")
    full = pairs.join(pages.join(met, "doc_id", "left_semi"), "doc_id").join(items, "item_id").select("doc_id", "item_id", "words", "item_words")
    types = ", ".join(f"{k} {full.schema[k].dataType.simpleString()}" for k in ("doc_id", "item_id"))
    judged = full.mapInPandas(lambda b: _judge(least, misread, b), f"{types}, longest INT, coverage DOUBLE")
    return judged.where(F.col("longest") >= least)
