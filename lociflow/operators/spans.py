"""Strict word spans of raw transcription lines, and the places of a record's letters and units in its raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators.views import VISUAL
from lociflow.runtime import ship

# The constructs of a raw line, each with the reason for which it excludes the word it touches; fixed values.
_CONSTRUCTS = [
    ("letters", r"[a-z]+", None),
    ("blank", r"\s+", None),
    ("stop", r"\.", None),
    ("comma", r",", "uncertain_space"),
    ("marker", r"<[-~]>", "diagram_marker"),
    ("control", r"<[^>]*>", "inline_control"),
    ("choice", r"\[[^\]]*\]", "uncertain_reading"),
    ("ligature", r"\{[^}]*\}", "ligature"),
    ("code", r"@[^;]*;", "high_ascii"),
    ("unclosed", r"[<\[{].*", "incomplete_span"),
    ("doubt", r"\?", "uncertain_reading"),
    ("apostrophe", r"'", "apostrophe"),
    ("foreign", r"[^\x00-\x7f]", "non_ascii"),
    ("capital", r"[A-Z]", "uppercase"),
    ("other", r".", "other_construct"),
]
_SCAN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in _CONSTRUCTS), re.S)
_REASON = {name: reason for name, _, reason in _CONSTRUCTS}


def word_spans(text: str) -> list[tuple[int, int, int, str, str | None]]:
    """Word candidates (number, start, end, surface, reason) of a raw line; the first reason that applies excludes one.

    A stop parts words; a comma parts them and excludes both. Blanks at the ends of a candidate don't count, inside they
    exclude it. A marker or control between words excludes the next one, unless a stop comes before it.
    """
    out: list[tuple[int, int, int, str, str | None]] = []
    start, reason, ahead = -1, None, None

    def close(end: int) -> None:
        nonlocal start, reason
        if start >= 0:
            surface = text[start:end].rstrip()
            blank = any(map(str.isspace, surface))
            out.append((len(out), start, start + len(surface), surface, reason or ("interior_whitespace" if blank else None)))
        start, reason = -1, None

    for m in _SCAN.finditer(text):
        what, at = m.lastgroup, m.start()
        if what == "stop":
            close(at)
            ahead = None
        elif what == "comma":
            reason = reason or _REASON[what]
            close(at)
            ahead = ahead or _REASON[what]
        elif what == "blank":
            pass
        elif what in ("marker", "control") and start < 0:
            ahead = ahead or _REASON[what]
        else:
            if start < 0:
                start, reason, ahead = at, ahead, None
            reason = reason or _REASON[what]
    close(len(text))
    return out


def strict_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, word, start, end, surface, reason): the word candidates of each raw line; `reason` is null for a clean one.

    Null and empty lines have none. Row by row, no shuffle; a row given twice comes out twice.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *s) for i, t in zip(f["id"], f["text"]) if t for s in word_spans(t)]
            yield pd.DataFrame(rows, columns=[id_col, "word", "start", "end", "surface", "reason"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"`{id_col}` {kind}, word int, start int, `end` int, surface string, reason string")


_SKIPPED = re.compile(r"<[-~]>|<[^>]*>|[.,]|\s+|[{}]|[A-Za-z]", re.S)


def source_letters(text: str) -> list[tuple[str, list[int]]] | None:
    """The words of a clean raw line with the place of each letter in it; null where a mark of doubt stands in it."""
    words: list[tuple[str, list[int]]] = [("", [])]
    end = 0
    for m in _SKIPPED.finditer(text):
        if m.start() != end:
            return None
        end, s = m.end(), m.group()
        if s.isalpha():
            word, at = words[-1]
            words[-1] = (word + s.lower(), [*at, m.start()])
        elif s in (".", ",", "<->", "<~>"):
            words.append(("", []))
    return [w for w in words if w[0]] if end == len(text) else None


def project_source(df: DataFrame, id_col: str, text_col: str, words_col: str) -> DataFrame:
    """Rows (id, word, unit_no, unit, places) of the units of each record's words with the places of their letters in the
    raw text. A record whose raw text doesn't give its words back, or is in doubt, has one row with null units."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    cut = re.compile(VISUAL)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text, words in zip(f["id"], f["text"], f["words"]):
                found = source_letters(text or "")
                if found is None or [w for w, _ in found] != list(words if words is not None else ()):
                    rows.append((i, None, None, None, None))
                    continue
                for k, (word, at) in enumerate(found):
                    for n, m in enumerate(cut.finditer(word)):
                        rows.append((i, k, n, m.group(), at[m.start() : m.end()]))
            out = pd.DataFrame(rows, columns=[id_col, "word", "unit_no", "unit", "places"])
            yield out.astype({"word": "Int32", "unit_no": "Int32"})

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(words_col).alias("words"))
    return source.mapInPandas(run, f"`{id_col}` {kind}, word int, unit_no int, unit string, places array<int>")
