"""Strict projection of TEI texts to paragraphs, in two ways that must agree, with counts of what was kept and dropped."""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.runtime import ship

_NS = "{http://www.tei-c.org/ns/1.0}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
SCHEMA = "file string, book_id string, chapter_id string, chapter_key string, local_paragraph_ordinal int, text string"
# Elements of a body, and those of them whose text is dropped.
BODY = frozenset("body choice corr del div figure foreign head hi milestone note p pb sic".split())
DROPPED = frozenset("del figure foreign head note".split())
XML_BLANKS = " \t\r\n"
_BLANKS = re.compile("[ \t\r\n]+")
#: Stands where text was dropped, a noncharacter that XML forbids.
_GAP = "￾"
_GLUED = re.compile(f"[^\\W\\d_]{_GAP}+[^\\W\\d_]")


def _tag(node) -> str:
    if not isinstance(node.tag, str) or not node.tag.startswith(_NS):
        raise ValueError("an element is not of the TEI namespace")
    return node.tag.removeprefix(_NS)


def _said(node) -> str:
    """All text of an element, that of a choice being its correction."""
    if _tag(node) == "choice":
        return "".join(_said(c) for c in node if _tag(c) == "corr")
    return (node.text or "") + "".join(_said(c) + (c.tail or "") for c in node)


def _text(node, counts: Counter, where: str) -> str:
    """Text of an element inside a paragraph; of a choice the correction stays."""
    out = [node.text or ""]
    for child in node:
        tag = _tag(child)
        if tag not in BODY or tag in ("body", "div", "p"):
            raise ValueError(f"{where}: <{tag}> is not expected in a paragraph")
        if tag in ("sic", "corr") and _tag(node) != "choice":
            raise ValueError(f"{where}: <{tag}> outside of a choice")
        if tag == "foreign" and child.get(f"{_XML}lang") != "grc":
            raise ValueError(f"{where}: <foreign> of another language")
        if tag in DROPPED or tag == "sic":
            for x in child.iter():
                counts["dropped", _tag(x)] += 1
            # a reading whose correction says something is replaced, not dropped
            replaced = tag == "sic" and any(_tag(c) == "corr" and _said(c).strip(XML_BLANKS) for c in node)
            out.append(_GAP if _said(child).strip(XML_BLANKS) and not replaced else "")
        else:
            if tag == "choice" and ([_tag(c) for c in child] != ["sic", "corr"] or (child.text or "").strip(XML_BLANKS)):
                raise ValueError(f"{where}: a choice is not a reading and its correction")
            counts["kept", tag] += 1
            out.append(_text(child, counts, where))
        out.append(child.tail or "")
    return "".join(out)


def _finished(text: str, where: str) -> str:
    """Blanks made one, gaps closed; a gap between two letters is an error."""
    if _GLUED.search(text):
        raise ValueError(f"{where}: dropping text joins two letters")
    return _BLANKS.sub(" ", text.replace(_GAP, "")).strip(" ")


def _checked(p, where: str) -> None:
    if any(_tag(x) == "p" for x in p.iter() if x is not p):
        raise ValueError(f"{where}: a paragraph is misplaced")


def project(xml: str | bytes, file: str = "", empty_policy: str = "drop", counts: Counter | None = None) -> Iterator[tuple]:
    """Paragraphs (file, book, chapter, key, ordinal, text): text/body/div(book)/div(chapter)/p, one text and one body, the
    books perhaps in one div of the edition. Anything else in a body, a paragraph elsewhere, and a book or chapter without
    a number or with one that occurred before, is an error. `counts` takes elements kept and dropped."""
    if empty_policy not in ("drop", "include"):
        raise ValueError("empty_policy is 'drop' or 'include'")
    counts = Counter() if counts is None else counts
    root = ElementTree.fromstring(xml)
    texts, bodies = list(root.iter(f"{_NS}text")), root.findall(f".//{_NS}text/{_NS}body")
    if _tag(root) != "TEI" or len(texts) != 1 or len(bodies) != 1:
        raise ValueError(f"{file}: there must be one text with one body")
    seen: set[str] = set()

    def parts(node, what: str | None, inside: str) -> Iterator[tuple[str, ElementTree.Element]]:
        """The divisions `what` of a node (paragraphs for None); other elements of the body may stand beside them."""
        for child in node:
            tag = _tag(child)
            if tag == "div" and what == "book" and child.get("type") == "edition" and child.get("subtype") is None and child.get("n") is None and node is bodies[0]:
                if "edition" in seen:
                    raise ValueError(f"{file}: two editions")
                seen.add("edition")
                yield from parts(child, what, inside)
            elif tag == "div" and what is not None and child.get("subtype") == what:
                n = child.get("n")
                key = f"{inside}{n}"
                if not n or key in seen:
                    raise ValueError(f"{file}: a {what} has no number or one that is taken: {key}")
                seen.add(key)
                yield n, child
            elif tag == "p" and what is None:
                yield "", child
            elif tag in DROPPED or tag in ("milestone", "pb"):
                _checked(child, file)
            else:
                raise ValueError(f"{file}: <{tag}> is misplaced in {inside or 'the body'}")

    for b, book in parts(bodies[0], "book", ""):
        for c, chapter in parts(book, "chapter", f"{b}:"):
            number = 0
            for _, p in parts(chapter, None, f"{b}:{c}"):
                where = f"{file} {b}:{c}"
                counts["kept", "p"] += 1
                text = _finished(_text(p, counts, where), where)
                if text or empty_policy == "include":
                    number += 1
                    yield (file, b, c, f"{b}:{c}", number, text)


def project_by_events(xml: str | bytes, file: str = "", empty_policy: str = "drop") -> Iterator[tuple]:
    """The same paragraphs from the parser's events without a tree, to check project() against."""
    data = xml.encode() if isinstance(xml, str) else xml
    path: list[str] = []
    ids: list[str | None] = []
    open_ = False  # inside a paragraph
    silent = 0  # depth of the dropped element
    number = 0
    for event, node in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
        tag = node.tag.removeprefix(_NS)
        if event == "start":
            path.append(tag)
            if tag == "div" and node.get("subtype"):
                ids.append(node.get("n"))
                number = 0 if len(ids) == 2 else number
            if tag == "p" and not silent:
                open_ = True
            elif open_ and not silent and (tag in DROPPED or tag == "sic"):
                silent = len(path)
            continue
        depth = len(path)
        path.pop()
        if silent == depth:
            silent = 0
        if tag == "div" and node.get("subtype"):
            ids.pop()
        if open_ and tag == "p" and not silent:
            text = _BLANKS.sub(" ", "".join(_pieces(node))).strip(" ")
            open_ = False
            if text or empty_policy == "include":
                number += 1
                yield (file, ids[0], ids[1], f"{ids[0]}:{ids[1]}", number, text)
            node.clear()


def _pieces(node) -> Iterator[str]:
    """Text of a finished element in document order, dropped elements left out, without recursion."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
            continue
        todo += [y for child in reversed(list(x)) for y in ((child.tail or ""), *(() if child.tag.removeprefix(_NS) in DROPPED | {"sic"} else (child,)))]
        todo.append(x.text or "")


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_tei(spark: SparkSession, path: str, empty_policy: str = "drop") -> DataFrame:
    """Paragraphs of the TEI files at `path`; ordinals count from 1 in each chapter without a gap."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, value in zip(frame["file"], frame["content"]):
                yield pd.DataFrame(list(project(value, file, empty_policy)), columns=names)

    return _files(spark, path).mapInPandas(run, SCHEMA)


def projection_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, fate, tag, n): elements of paragraphs that were kept or dropped; and whether the second projection gives
    the same paragraphs (fate `agrees`, n 1 or 0)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, value in zip(frame["file"], frame["content"]):
                counts: Counter = Counter()
                same = list(project(value, file, "drop", counts)) == list(project_by_events(value, file))
                rows = [(file, fate, tag, n) for (fate, tag), n in sorted(counts.items())] + [(file, "agrees", "", int(same))]
                yield pd.DataFrame(rows, columns=["file", "fate", "tag", "n"])

    return _files(spark, path).mapInPandas(run, "file string, fate string, tag string, n long")


def review_sample(paragraphs: DataFrame, step: int = 36) -> DataFrame:
    """A sample to look at by eye, the same each time: first and last paragraph of each book, every `step`-th of all, the last."""
    from pyspark.sql import Window

    book = Window.partitionBy("book_id")
    order = [F.col("book_id"), F.col("chapter_id"), F.col("local_paragraph_ordinal")]
    whole = Window.orderBy(*order)  # paragraphs of one text
    n = paragraphs.withColumn("k", F.row_number().over(whole)).withColumn("first", F.row_number().over(book.orderBy(*order))).withColumn("of_book", F.count("*").over(book)).withColumn("all", F.count("*").over(Window.partitionBy()))
    return n.where((F.col("first") == 1) | (F.col("first") == F.col("of_book")) | (F.col("k") % step == 0) | (F.col("k") == F.col("all"))).drop("k", "first", "of_book", "all")


def audit_tags(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, title, language, tag, n, ids, inside_words): what the header says, how often each element occurs, how many
    xml:id values of the file occur twice, and how many of the elements stand between two letters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, value in zip(frame["file"], frame["content"]):
                root = ElementTree.fromstring(value)
                tags, ids, glued = Counter(), Counter(), Counter()
                for node in root.iter():
                    tags[_tag(node)] += 1
                    ids[node.get(f"{_XML}id")] += 1
                    before = node.text or ""
                    for child in node:
                        after = child.tail or ""
                        glued[_tag(child)] += before[-1:].isalpha() and after[:1].isalpha()
                        before = after or before
                twice = sum(n > 1 for k, n in ids.items() if k)
                title = root.find(f"./{_NS}teiHeader//{_NS}title")
                head = (file, None if title is None else "".join(title.itertext()).strip(), root.get(f"{_XML}lang"))
                yield pd.DataFrame([(*head, t, n, twice, glued[t]) for t, n in tags.items()], columns=["file", "title", "language", "tag", "n", "ids", "inside_words"])

    return _files(spark, path).mapInPandas(run, "file string, title string, language string, tag string, n long, ids long, inside_words long")
