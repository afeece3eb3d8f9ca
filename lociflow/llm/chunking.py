"""Splitting of oversized texts: dynamic programming over boundary positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.bpe import PIECE, RANKS, Encoder, Vocabulary, encoder_of, slices
from lociflow.runtime import ship

#: Boundary kinds, the best first, with the penalty of a cut there; the imbalance of a piece costs up to 1.
KINDS = ("heading", "paragraph", "line", "sentence", "word", "forced")
PENALTY = np.array([0.0, 0.1, 0.3, 0.6, 1.5, 6.0])
IMBALANCE = 1.0

_HEADING = re.compile(r"\s*(#{1,6}\s|=+[^=\n]+=+\s*$|\\(?:part|chapter|(?:sub)*section|paragraph)\b|<h[1-6]\b|<head\b|[^\n]+\n(?:={3,}|-{3,})\s*$)", re.I | re.M)
_ENDS = frozenset(".!?…。！？\"'”’»)]")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def units(enc: Encoder, text: str) -> tuple[list[str], list[int], list[int]]:
    """The text cut into pieces of whole pre-tokens with their token counts; a pre-token of many characters or tokens is
    cut further, so that no unit has more than 192 tokens. Last, the numbers of the units that are parts of such a one, of which the counts are estimates."""
    names, sizes, parts = [], [], []
    memo, words = enc.memo, enc.words
    for p in PIECE.findall(text):
        if len(p) <= 48:
            names.append(p)
            sizes.append(len(memo[p]))
            continue
        for t in enc.pretokens(p):
            if len(t) <= 256 and len(words[t]) <= 128:
                names.append(t)
                sizes.append(len(words[t]))
            else:
                for at in range(0, len(t), 32):  # of 128 tokens at most: a token is a byte or more, a character four at most
                    parts.append(len(names))
                    names.append(t[at : at + 32])
                    sizes.append(len(enc.word_ids(t[at : at + 32])))
    return names, sizes, parts


def boundaries(names: list[str], text: str, parts: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """For each unit: its kind as an index of KINDS if a piece may end after it (before white space or inside an unspaced
    run), else -1; and the offset where it ends.

    Cuts stand before white space, which then opens the next piece: so the tokens stay what they are in the whole text.
    Only a run of white space so long that it came in parts may be cut inside.
    """
    cut = set(parts)
    ends = np.cumsum([len(x) for x in names])
    kind = [-1] * len(names)
    for i, (this, nxt) in enumerate(zip(names, names[1:])):
        last, c = this[-1], nxt[0]
        if last <= " " or last.isspace():
            if i in cut and i + 1 in cut and nxt[0].isspace():
                kind[i] = 5
            continue
        if c > " " and not c.isspace():
            kind[i] = 5
        elif c == " " and not nxt.isspace():
            kind[i] = 3 if last in _ENDS and _SENTENCE_END.search(this) else 4
        else:
            gap = nxt if i + 2 >= len(names) or not names[i + 2].isspace() else nxt + names[i + 2]
            if breaks := gap.count("\n"):
                kind[i] = 0 if _HEADING.match(text, int(ends[i])) else 1 if breaks > 1 else 2
            else:
                kind[i] = 3 if last in _ENDS and _SENTENCE_END.search(this) else 4
    return np.array(kind, np.int8), ends


def plan(sizes: list[int], kind: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (first unit, unit after the last, unit where the new text starts).

    f[c], the least cost of pieces that end at cut c, is min over earlier cuts p of f[p] + penalty(c) + imbalance,
    where the piece from the overlap before p up to c is within the limit. Cuts at words and inside words
    take part only where no better one stands within an eighth of the limit.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    all_cuts = np.flatnonzero(kind >= 0) + 1  # a cut before unit c
    kinds = kind[all_cuts - 1]
    keep = np.zeros(len(all_cuts), bool)
    step = max(1, limit // 8)
    for worst in (2, 3, 4, 5):
        # where the cuts kept so far leave a gap wider than a step, the next worse kind fills in
        had = np.concatenate([[0], total[all_cuts[keep]], [total[n]]])
        at = np.searchsorted(had, total[all_cuts], side="right")
        wide = had[np.minimum(at, len(had) - 1)] - had[at - 1] > step
        keep |= (kinds <= worst) & (wide | (worst == 2))
    cuts = np.concatenate([[0], all_cuts[keep], [n]])
    pen = np.concatenate([[0.0], PENALTY[kinds[keep]], [0.0]])
    at = total[cuts]
    # where a piece after the cut starts: the last boundary that leaves the overlap, or the nearest before it
    starts_all = np.concatenate([[0], all_cuts])
    back = np.searchsorted(total[starts_all], at - overlap, side="right") - 1
    begin = np.where(cuts == 0, 0, starts_all[np.maximum(back, 0)])
    # no boundary near: the overlap opens inside a sentence or a run, at the last unit that leaves it
    far = at - total[begin] > 2 * overlap
    begin = np.where(far, np.maximum(begin, np.searchsorted(total, at - overlap, side="right") - 1), begin)
    m = len(cuts)
    f, prev = np.full(m, np.inf), np.zeros(m, np.int64)
    f[0] = 0
    pieces = max(1, -(-(int(total[n]) - overlap) // max(1, limit - overlap)))
    ideal = total[n] / pieces
    low = 0
    open_from = total[begin]
    for c in range(1, m):
        while low < c - 1 and at[c] - open_from[low] > limit:
            low += 1
        lo, hi = low, c
        size = at[c] - at[lo:hi]
        cost = f[lo:hi] + IMBALANCE * ((size - ideal) / ideal) ** 2
        cost = np.where(at[c] - open_from[lo:hi] <= limit, cost, np.inf)
        k = int(np.argmin(cost))
        f[c], prev[c] = cost[k] + pen[c], lo + k
    out, c = [], m - 1
    while c > 0:
        p = int(prev[c])
        out.append((int(begin[p]), int(cuts[c]), int(cuts[p])))
        c = p
    return out[::-1]


def split_text(enc: Encoder, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Pieces of a text as (start, end, first new offset, tokens, kind of the boundary at the end).

    Every piece, encoded on its own, has at most `limit` tokens; the new parts join to the whole text.
    """
    names, sizes, parts = units(enc, text)
    kind, ends = boundaries(names, text, parts)
    offset, total, part = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(sizes)]), np.array(parts, np.int64)

    def made(spans: list[tuple[int, int, int]]) -> tuple[list, int]:
        out, most = [], 0
        for first, last, new in spans:
            a, b = int(offset[first]), int(offset[last])
            n = int(total[last] - total[first])
            # the counts of parts needn't add up, nor those of a piece that opens or ends inside a run
            if np.searchsorted(part, last) > np.searchsorted(part, first) or (first and first not in safe):
                n = enc.count(text[a:b])
            most = max(most, n)
            out.append((a, b, int(offset[new]), n, KINDS[kind[last - 1]] if last < len(names) else "end"))
        return out, most

    safe = {0, *(np.flatnonzero(kind >= 0) + 1).tolist()}
    within = limit
    while within >= max(128, 2 * overlap + 1):
        out, most = made(plan(sizes, kind, within, overlap))
        if most <= limit:
            return out
        within -= most - limit + 16
    return made(by_counting(enc, text, offset, limit, overlap))[0]


def by_counting(enc: Encoder, text: str, offset: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as in plan(), by counting the tokens of each: the most units that fit, the overlap in units that fit too.
    For texts of which the counts of units say too little about the counts of pieces."""
    spans, new, n = [], 0, len(offset) - 1
    count = lambda a, b: enc.count(text[int(offset[a]) : int(offset[b])])
    while new < n:
        first = new
        while spans and first > spans[-1][0] + 1 and count(first, new) < overlap and count(first - 1, new + 1) <= limit:
            first -= 1
        low, step = new + 1, 1
        while low < n and count(first, min(n, low + step)) <= limit:
            low, step = min(n, low + step), 2 * step
        high = min(n, low + step)
        while low < high:
            mid = (low + high + 1) // 2
            if count(first, mid) <= limit:
                low = mid
            else:
                high = mid - 1
        while low > new + 1 and count(first, low) > limit:
            low -= 1
        spans.append((first, low, new))
        new = low
    return spans


def split_oversized(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, overlap: int = 128, path: str = RANKS
) -> DataFrame:
    """Rows (id, piece, start, end, new_from, n_tokens, boundary, text) of the texts of more than `limit` tokens.

    `piece` counts from 0; `start` and `end` are offsets in characters, and the text from `new_from` on is new, what
    stands before it repeats the end of the piece before (about `overlap` tokens, from a boundary on, or inside a sentence
    where none is near). `boundary` is what
    the piece ends at: heading, paragraph, line, sentence, word, forced (inside a run without blanks) or end. A text
    within the limit, an empty and a null text give no row. Each text is handled whole, in its own row: no shuffle.
    A row given twice comes out twice.
    """
    if not 0 <= overlap < limit // 2 or limit < 256:
        raise ValueError("limit must be 256 or more, the overlap less than half of it")
    ship(df.sparkSession)
    vocabulary = Vocabulary(df.sparkSession, path)
    # a token is a byte at least, so shorter texts needn't go to Python
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.octet_length("__text") > limit)
    id_type = source.schema["__id"].dataType.simpleString()
    fields = pa.schema([("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("new_from", pa.int32()), ("n_tokens", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(vocabulary)
        for batch in batches:
            for b in slices(batch, 64):
                at, rows = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    if enc.count(text) > limit:
                        for k, (start, end, new, n, kind) in enumerate(split_text(enc, text, limit, overlap)):
                            at.append(i)
                            rows.append((k, start, end, new, n, kind, text[start:end]))
                cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], [id_col, *fields.names])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start int, end int, new_from int, n_tokens int, boundary string, text string")


def oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, overlap: int = 128, path: str = RANKS) -> DataFrame:
    """Rows (id): the texts that split_oversized() divides, each id once."""
    pieces = split_oversized(df, id_col, text_col, limit, overlap, path)
    return pieces.where(F.col("piece") == 1).select(id_col).distinct()
