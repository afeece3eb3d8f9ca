"""Treebank files in ten columns: sentences with document, id, reference and surface words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.text import plain_word
from lociflow.runtime import ship

SCHEMA = (
    "file string, sentence long, document string, sent_id string, reference string, words array<string>, surface array<string>, excluded int, "
    "empty_nodes int, components int, multiword int, punct int"
)


def sentences(text: str, name: str = "") -> Iterator[tuple]:
    """Sentences of a file. A multiword form replaces its components, empty nodes (8.1) are skipped. `words` are the forms in
    letters a-z, see normalize_word(); `excluded` counts those that have none, `surface` keeps all as they stand."""
    document = sent_id = reference = None
    rows: list[list[str]] = []
    number = 0
    for line_no, line in enumerate([*text.split("\n"), ""], 1):
        line = line.rstrip("\r")
        if line.startswith("#"):
            key, given, value = line[1:].partition("=")
            match key.strip():
                case "newdoc" | "newdoc id":
                    document = value.strip() if given else f"document-line-{line_no}"
                case "sent_id":
                    sent_id = value.strip()
                case "reference":
                    reference = value.strip()
        elif line.strip():
            rows.append(line.split("\t"))
            if len(rows[-1]) != 10:
                raise ValueError(f"{name}:{line_no}: {len(rows[-1])} columns")
        elif rows:
            words, until, empty, covered, multi, punct = [], 0, 0, 0, 0, 0
            for r in rows:
                if "." in r[0]:
                    empty += 1
                elif "-" in r[0]:
                    low, high = map(int, r[0].split("-"))
                    if low <= until or high <= low:
                        raise ValueError(f"{name}:{line_no}: a multiword range overlaps or is empty")
                    until, multi = high, multi + 1
                    words.append(r[1])
                elif int(r[0]) <= until:
                    covered += 1
                else:
                    words.append(r[1])
                    punct += r[3] == "PUNCT"
            plain = [w for w in map(plain_word, words) if w is not None]
            yield (name, number, document, sent_id, reference, plain, words, len(words) - len(plain), empty, covered, multi, punct)
            rows, sent_id, reference, number = [], None, None, number + 1


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of the files at `path`; a task reads whole files, one after the other."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, value in zip(frame["file"], frame["value"]):
                yield pd.DataFrame(list(sentences(value, file)), columns=names)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(run, SCHEMA)


#: Where the document of a sentence stands, by corpus: column and pattern; fixed values.
DOCUMENT_RULES = {"latin_llct": ("reference", "document_id='([^']+)'"), "italian_old": ("sent_id", "^OldItalian_Dante_(Inferno|Purgatorio|Paradiso)-[0-9]+$")}


def reference_document(corpus_id: str) -> Column:
    """The document of a sentence by the rule of its corpus; an error where the sentence names none."""
    if corpus_id not in DOCUMENT_RULES:
        raise ValueError(f"no document rule for {corpus_id}")
    column, pattern = DOCUMENT_RULES[corpus_id]
    found = F.regexp_extract(F.coalesce(column, F.lit("")), pattern, 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit(f"{corpus_id}: no document in sentence "), F.col("sentence").cast("string")))).otherwise(found)


def load_partitions(spark: SparkSession, files: dict[str, tuple[str, str]]) -> DataFrame:
    """Sentences of pinned files, {path: (split, sha256)}, with their split.

    A wrong hash is an error, and so is a document in two splits. A sentence of a later split (train, validation, test)
    that an earlier one has too is dropped, whether or not that one stays; repeats within a split stay.
    """
    parts = None
    for path, (split, digest) in files.items():
        seen = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()  # one file
        if [r[0] for r in seen] != [digest]:
            raise ValueError(f"{path}: hash differs")
        part = read_conllu(spark, path).withColumn("split", F.lit(split))
        parts = part if parts is None else parts.unionByName(part)
    torn = parts.where("document is not null").groupBy("document").agg(F.count_distinct("split").alias("n")).where("n > 1").limit(1).collect()
    if torn:
        raise ValueError(f"document {torn[0]['document']} is in two splits")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    ranked = parts.where(F.size("words") > 0).withColumn("rank", rank)
    first = ranked.groupBy("words").agg(F.min("rank").alias("first"))
    return ranked.join(first, "words").where("rank = first").drop("rank", "first")


def extract_text(sents: DataFrame, to: str) -> dict[str, int]:
    """One sentence per line as plain text; an existing folder is refused. Returns the numbers of sentences, surface words
    and punctuation left out."""
    sents.select(F.array_join("words", " ").alias("value")).write.mode("errorifexists").text(to)
    n = sents.agg(F.count("*").alias("sentences"), F.coalesce(F.sum(F.size("surface")), F.lit(0)).alias("surface"), F.coalesce(F.sum("excluded"), F.lit(0)).alias("excluded"), F.coalesce(F.sum("punct"), F.lit(0)).alias("punct"))
    return n.first().asDict()
