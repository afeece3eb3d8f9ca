"""A verbose table cipher: a book of codes, encryption of texts, and all readings of a token by joins."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.runtime import ship

# States, tables with their cards in decks of 78 and 52, letters, letters of other alphabets.
STATES = ("unigram", "prefix", "suffix")
TABLES = ("alpha", "beta1", "beta2", "beta3", "gamma1", "gamma2")
DECK_78 = {"alpha": 28, "beta1": 14, "beta2": 11, "beta3": 11, "gamma1": 7, "gamma2": 7}
DECK = {"alpha": 20, "beta1": 8, "beta2": 8, "beta3": 8, "gamma1": 4, "gamma2": 4}
LETTERS = "abcdefghilmnopqrstuvxyz"
_OTHER = {"æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ł": "l", "ß": "ss", "ø": "o"}
BOOK_SCHEMA = "state string, tbl string, letter string, glyphs string"


def plain_letters(text: str) -> str:
    """Letters only, without diacritics, lower-cased; w is uu, j is i, k is c."""
    kept = (c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    low = "".join(_OTHER.get(c.lower(), c.lower()) for c in kept)
    return "".join({"w": "uu", "j": "i", "k": "c"}.get(c, c) for c in low if c.isalpha())


def respaced(text: str, rng: random.Random, one: float = 17 / 36) -> list[str]:
    """The text in units of one letter (with the chance `one`) or two; the last letter may be left alone."""
    ends = [0]
    while ends[-1] < len(text):
        ends.append(min(len(text), ends[-1] + (1 if ends[-1] == len(text) - 1 or rng.random() < one else 2)))
    return [text[a:b] for a, b in pairwise(ends)]


def rule_book(spark: SparkSession) -> DataFrame:
    """A book by rule, for tests and demonstrations: initial of the state, numbers of state and table, letter."""
    rows = [(s, t, x, f"{s[0]}{i}{j}{x}") for i, s in enumerate(STATES) for j, t in enumerate(TABLES) for x in LETTERS]
    return spark.createDataFrame(rows, BOOK_SCHEMA)


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """A book from CSV files of code (state_table_letter) and glyphs; it must name each of the 414 codes once."""
    raw = spark.read.schema("code string, glyphs string").option("header", True).option("mode", "FAILFAST").csv(path)
    parts = F.split("code", "_")
    book = raw.select(parts[0].alias("state"), parts[1].alias("tbl"), parts[2].alias("letter"), "glyphs")
    want = rule_book(spark).drop("glyphs")
    bad = book.groupBy("state", "tbl", "letter").agg(F.count("*").alias("n"), F.count("glyphs").alias("g")).join(want.withColumn("known", F.lit(True)), ["state", "tbl", "letter"], "full_outer")
    wrong = bad.where("n is null or n <> 1 or g <> 1 or known is null").limit(5).collect()
    if wrong:
        raise ValueError(f"codes missing, unknown or repeated, e.g. {wrong[0]}")
    return book


def readings(tokens: DataFrame, book: DataFrame) -> DataFrame:
    """Rows (w, kind, plain, table_a, table_b): every reading of each distinct token (w), as one unigram code or as a
    prefix and a suffix code. The book has 414 rows and is broadcast; tokens are cut at every place and met with it
    by hash joins."""
    t = tokens.select("w").distinct()
    side = lambda s, x: F.broadcast(book.where(F.col("state") == s).select(F.col("glyphs").alias(f"g{x}"), F.col("letter").alias(f"l{x}"), F.col("tbl").alias(f"table_{x}")))
    one = t.join(side("unigram", "a"), F.col("w") == F.col("ga")).select("w", F.lit("unigram").alias("kind"), F.col("la").alias("plain"), "table_a", F.lit(None).cast("string").alias("table_b"))
    cut = t.where(F.length("w") > 1).select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("at"))
    cut = cut.select("w", F.expr("substr(w, 1, at)").alias("pre"), F.expr("substr(w, at + 1)").alias("suf"))
    two = cut.join(side("prefix", "a"), F.col("pre") == F.col("ga")).join(side("suffix", "b"), F.col("suf") == F.col("gb"))
    return one.unionByName(two.select("w", F.lit("pair").alias("kind"), F.concat("la", "lb").alias("plain"), "table_a", "table_b"))


def ambiguity(reads: DataFrame) -> DataFrame:
    """Rows (w, n_readings, n_plain, plain_ambiguous, table_ambiguous)."""
    g = reads.groupBy("w").agg(F.count("*").alias("n_readings"), F.count_distinct("plain").alias("n_plain"))
    return g.select("w", "n_readings", "n_plain", (F.col("n_plain") > 1).alias("plain_ambiguous"), (F.col("n_readings") > F.col("n_plain")).alias("table_ambiguous"))


def refused(codes: dict[tuple[str, str, str], str], policy: str) -> set[str]:
    """Tokens of two letters that a policy refuses: 'unigram' those that are also a code of one letter, 'full' also those that
    more than one pair of codes spells, 'none' none."""
    if policy == "none":
        return set()
    out = {g for (s, _, _), g in codes.items() if s == "unigram"}
    if policy == "full":
        parts = [[g for (s, _, _), g in codes.items() if s == state] for state in ("prefix", "suffix")]
        out |= {token for token, n in Counter(a + b for a in parts[0] for b in parts[1]).items() if n > 1}
    return out


def encrypt_text(text: str, codes: dict[tuple[str, str, str], str], rng: random.Random, deck: dict[str, int] = DECK, not_these: set[str] = frozenset(), retries: int = 10_000) -> list[tuple[str, str, str]]:
    """Tokens (token, plain, tables) of a text: units of one or two letters, tables dealt from a shuffled deck without
    replacement, a new one when it is used up. A token of two letters that is among `not_these` is dealt again."""
    hand: list[str] = []

    def deal() -> str:
        if not hand:
            hand.extend(t for t, n in deck.items() for _ in range(n))
            rng.shuffle(hand)
        return hand.pop()

    out = []
    for unit in respaced(text, rng):
        if len(unit) == 1:
            t = deal()
            out.append((codes["unigram", t, unit], unit, t))
            continue
        for _ in range(retries):
            a, b = deal(), deal()
            token = codes["prefix", a, unit[0]] + codes["suffix", b, unit[1]]
            if token not in not_these:
                out.append((token, unit, f"{a} {b}"))
                break
        else:
            raise ValueError(f"no allowed token for {unit!r} in {retries} deals")
    return out


def encrypt(df: DataFrame, id_col: str, text_col: str, book: DataFrame, seed: int = 408, deck: dict[str, int] = DECK, policy: str = "none", retries: int = 10_000) -> DataFrame:
    """Rows (id, place, token, plain, tables): each text by encrypt_text() with a deck of its own. The stream of chances
    depends on the seed and the id alone. Null and empty texts give none; letters that the book lacks are left out."""
    if policy not in ("none", "unigram", "full"):
        raise ValueError("policy is 'none', 'unigram' or 'full'")
    if set(deck) != set(TABLES) or min(deck.values()) < 1:
        raise ValueError("a deck has cards of every table")
    ship(df.sparkSession)
    codes = {(r.state, r.tbl, r.letter): r.glyphs for r in book.collect()}  # 414 rows
    bad = refused(codes, policy)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for id_, text in zip(frame["id"], frame["text"]):
                letters = "".join(c for c in plain_letters(text or "") if c in LETTERS)
                made = encrypt_text(letters, codes, random.Random(f"{seed}:{id_}"), deck, bad, retries)
                rows += [(id_, place, *token) for place, token in enumerate(made)]
            yield pd.DataFrame(rows, columns=[id_col, "place", "token", "plain", "tables"])

    return source.mapInPandas(run, f"`{id_col}` {kind}, place int, token string, plain string, tables string")
