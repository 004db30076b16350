"""Words of a scanned page in reading order: down each column by the boxes, broken words mended."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Blanks in a line from which on its parts belong to several columns.
_GAP = re.compile(r" {3,}|\t+")
#: A hyphen of any of the usual forms at the end of a line, perhaps followed by specks.
_BROKEN = re.compile(r"[-¬=‐­][^\w\s]*\s*$")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
#: Lines of this many times the usual height are mastheads and lie across the columns.
_MASTHEAD = 1.9


def words_of(text: str) -> list[str]:
    """Lower-case words of letters and digits; apostrophes inside a word are dropped, all else separates."""
    return [w.replace("'", "") for w in _WORD.findall(text.lower().replace("’", "'"))]


def _columns(x: np.ndarray, w: np.ndarray) -> list[float]:
    """Left edges of the columns: clusters of line starts, more than a tenth of the page apart."""
    starts = np.sort(x)
    gap = max(1.0, 0.1 * float((x + w).max() - starts[0]))
    at = [float(starts[0])]
    last = starts[0]
    for s in starts[1:]:
        if s - last > gap:
            at.append(float(s))
        last = s
    return at


def order_lines(lines: list[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> list[str]:
    """The lines, those that run across columns cut into their parts, in the order of reading."""
    usual = float(np.median(h))
    parts = [_GAP.split(line.strip()) if _GAP.search(line.strip()) else [line] for line in lines]
    head = h >= _MASTHEAD * usual
    body = ~head
    if not body.any():
        return [lines[i] for i in np.lexsort((x, y))]
    x0, x1 = float(x[body].min()), float((x + w)[body].max())
    single = np.array([len(p) == 1 for p in parts]) & body
    starts = _columns(x[single], w[single]) if single.any() else [x0]
    most = max(len(p) for p, b in zip(parts, body) if b)
    if most > len(starts):
        starts = [x0 + (x1 - x0) * k / most for k in range(most)]
    edges = np.array(starts)
    placed = []
    for i, p in enumerate(parts):
        if head[i]:
            placed.append((-1, float(y[i]), 0, " ".join(p)))
            continue
        first = int(np.argmin(np.abs(edges - x[i])))
        if len(p) == 1:
            placed.append((first, float(y[i]), 0, p[0]))
            continue
        last = max(int(np.searchsorted(edges, x[i] + w[i] - 0.02 * (x1 - x0), "right")) - 1, first)
        span = last - first + 1
        for k, text in enumerate(p):
            # as many parts as columns below the box: one each; fewer: from the left
            placed.append((min(first + k, len(edges) - 1) if len(p) <= span else first + k * span // len(p), float(y[i]), k, text))
    placed.sort(key=lambda t: t[:3])
    return [t[3] for t in placed]


def join_lines(lines: list[str]) -> tuple[list[str], list[int]]:
    """Words over line ends, and the places of words that follow a line end without hyphen."""
    words: list[str] = []
    opens: list[int] = []
    tail = ""
    for line in lines:
        broken = _BROKEN.search(line)
        found = words_of(line)
        if not found:
            continue
        if tail:
            found[0] = tail + found[0]
            tail = ""
        elif words:
            opens.append(len(words))
        if broken and line[: broken.start()][-1:].isalnum():
            tail = found.pop()
        words += found
    if tail:
        words.append(tail)
    return words, opens


def page_words(documents: DataFrame) -> DataFrame:
    """doc_id, words, opens. Without boxes, or with another number of boxes than lines, the lines stay as they come.

    NULL and empty texts give no words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = b.column("line_boxes")
            offsets = boxes.offsets.to_numpy()
            flat = boxes.values
            x, y, w, h = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xywh")
            null = boxes.is_null().to_pylist() if boxes.null_count else None
            words, opens = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                lines = (text or "").split("\n")
                s, e = offsets[i], offsets[i + 1]
                if e - s == len(lines) and not (null and null[i]) and not np.isnan(x[s:e]).any() and not np.isnan(y[s:e]).any() and not np.isnan(w[s:e]).any() and not np.isnan(h[s:e]).any():
                    lines = order_lines(lines, x[s:e], y[s:e], w[s:e], h[s:e])
                a, o = join_lines(lines)
                words.append(a)
                opens.append(o)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.list_(pa.string())), pa.array(opens, pa.list_(pa.int32()))], ["doc_id", "words", "opens"])

    kept = documents.where("doc_id IS NOT NULL").selectExpr("doc_id", "text", "transform(line_boxes, b -> struct(b.x AS x, b.y AS y, b.w AS w, b.h AS h)) AS line_boxes")
    return kept.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, words ARRAY<STRING>, opens ARRAY<INT>")
