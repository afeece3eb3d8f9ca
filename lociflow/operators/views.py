"""Base relations over locus records: records, words, characters, units and words joined with physical groups.

Everything is declared on columns; the only shuffle is the one that makes a re-delivered locus one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.text import word_pattern

#: Salt of the hash split, and names of its ten buckets: 0-1 test, 2 validation, 3-9 train.
SALT = "lociflow-v1"
#: Marks of doubt in a raw line: alternatives, unread signs, codes, apostrophes, a note of a rare sign; fixed values.
DOUBT = r"\[[^\]]*:[^\]]*\]|\?|@[0-9]{3};|'|(?i:<!\s*[^>]*\brare\b)"
#: Grouped units, the longest first; fixed values of the transcription alphabet.
GROUPED = "(cth|ckh|cph|cfh|iin|ch|sh|in|.)"
VISUAL = "(cth|ckh|cph|cfh|ch|sh|.)"
#: A sign for each visual unit of more than one letter, so that units can be counted as signs; no two of them overlap.
SIGNS = {"cth": "1", "ckh": "2", "cph": "3", "cfh": "4", "ch": "5", "sh": "6"}


def accepted(tokens: Column) -> Column:
    """Tokens, trimmed and lower-cased, of letters a-z only; others are excluded."""
    return F.filter(F.transform(tokens, lambda t: F.lower(F.trim(t))), lambda t: t.rlike("^[a-z]+$"))


def bucket(key: Column, salt: str = SALT) -> Column:
    """The first eight bytes of sha256(salt, key), read big-endian, modulo 10."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 16), 16, 10)
    return (head.cast("decimal(20,0)") % 10).cast("int")


def split_of(b: Column) -> Column:
    return F.when(b <= 1, "test").when(b == 2, "validation").when(b >= 3, "train")


def folio_number(folio: Column) -> Column:
    """Digits of a folio name without leading zeros; the rosettes folio is 85; null where there are none."""
    name = F.lower(F.trim(folio))
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(name == "fros", F.lit(85)).when(digits != "", digits.cast("int"))


def records(loci: DataFrame) -> DataFrame:
    """One row for each locus: normalised folio, index, labels, accepted words, number of excluded tokens, group and split.

    `kind` may have its locator in front or not, and `locus` its kind behind; both forms are read.

    Loci without an id are no records. `excluded` counts tokens that are neither null, blank nor accepted; readers that
    count what they leave out mark their records by a column `excluded_exact`, and then excluded_tokens counts. A locus
    without a folio number has a null group and no split.
    """
    once = loci.where(F.col("locus_id").isNotNull()).dropDuplicates(["locus_id"])
    words = accepted(F.coalesce("tokens", F.array().cast("array<string>")))
    exact = F.col("excluded_exact") if "excluded_exact" in loci.columns else F.lit(False)
    shown = F.filter("tokens", lambda t: F.length(F.trim(t)) > 0)
    out_of = F.when(exact, F.coalesce("excluded_tokens", F.lit(0))).otherwise(F.coalesce(F.size(shown), F.lit(0)) - F.size(words)).cast("bigint")
    out = once.select(
        "locus_id",
        "source_order",
        "volume_id",
        F.lower(F.trim("folio")).alias("folio"),
        F.regexp_extract("locus", r"\.(\d+)(?:,|$)", 1).try_cast("bigint").alias("idx"),
        "kind",
        F.col("kind").rlike("^[@+*=&~/!]?P").alias("paragraph"),
        "transcriber",
        F.lower(F.trim("scribe")).alias("scribe"),
        F.col("metadata")["I"].alias("il"),
        F.col("metadata")["L"].alias("ll"),
        F.col("metadata")["Q"].alias("ql"),
        "text_raw",
        (F.col("text_raw").contains("<->") | F.col("text_raw").contains("<~>")).alias("interrupted"),
        (F.coalesce(F.col("text_raw").rlike(DOUBT), F.lit(False)) | (out_of > 0)).alias("doubt"),
        words.alias("words"),
        F.size(words).cast("bigint").alias("nw"),
        out_of.alias("excluded"),
        folio_number(F.col("folio")).alias("folio_no"),
    )
    out = out.withColumn("grp", F.concat_ws(":", F.col("volume_id"), F.col("folio_no")))
    out = out.withColumn("grp", F.when(F.col("folio_no").isNotNull() & F.col("volume_id").isNotNull(), F.col("grp")))
    return out.withColumn("split", split_of(bucket(F.col("grp"))))


def words(recs: DataFrame) -> DataFrame:
    """One row for each accepted word with its place `wp` in the line, from 0."""
    keep = ["locus_id", "source_order", "grp", "split", "il", "ll", "paragraph", "excluded", "interrupted", "nw"]
    return recs.select(*keep, F.posexplode("words").alias("wp", "w")).withColumn("wp", F.col("wp").cast("bigint"))


def characters(tok: DataFrame) -> DataFrame:
    """One row for each letter of a word."""
    return tok.select("locus_id", "grp", "split", "ll", "wp", "w", F.posexplode(F.split("w", "")).alias("cp", "ch")).where("ch <> ''").withColumn("cp", F.col("cp").cast("bigint"))


def units(tok: DataFrame, pattern: str = GROUPED) -> DataFrame:
    """One row for each unit of a word, cut greedily by `pattern`."""
    cut = F.regexp_extract_all("w", F.lit(pattern), F.lit(1))
    return tok.select("locus_id", "grp", "split", "ll", "wp", "w", F.posexplode(cut).alias("up", "u")).withColumn("up", F.col("up").cast("bigint"))


def line_vectors(recs: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Lines that have words, and for each unit how often it stands in the line: the visual units, ' ' for the spaces between
    words and '|' for the line itself. Counted where the line lies, by what is left without the unit."""
    text = F.array_join("words", " ")
    for unit, sign in SIGNS.items():
        text = F.replace(text, F.lit(unit), F.lit(sign))
    count = lambda u: (F.length("signs") - F.length(F.replace("signs", F.lit(SIGNS.get(u, u)), F.lit("")))).cast("bigint")
    named = columns or [*(chr(k) for k in range(ord("a"), ord("z") + 1)), *SIGNS, " ", "|"]
    return recs.where("nw > 0").withColumn("signs", text), {u: F.lit(1).cast("bigint") if u == "|" else count(u) for u in named}


def types(tok: DataFrame) -> DataFrame:
    """One row for each split and distinct word: how often it stands there, its length and its pattern (abba: 0.1.1.0)."""
    each = F.split("w", "")
    return (
        tok.groupBy("split", "w")
        .agg(F.count("*").alias("n"))
        .select("split", "w", "n", F.length("w").cast("bigint").alias("len"), word_pattern(F.filter(each, lambda c: c != "")).alias("pattern"))
    )


def letters(types_: DataFrame) -> DataFrame:
    """One row for each letter of a distinct word."""
    return types_.select("w").distinct().select("w", F.posexplode(F.regexp_extract_all("w", F.lit("(.)"), F.lit(1))).alias("cp", "ch")).withColumn("cp", F.col("cp").cast("bigint"))


def type_units(types_: DataFrame, pattern: str, place: str = "up", unit: str = "u") -> DataFrame:
    """One row for each unit of a distinct word of a split, with the word's count."""
    cut = F.regexp_extract_all("w", F.lit(pattern), F.lit(1))
    return types_.select("split", "w", "n", F.posexplode(cut).alias(place, unit)).withColumn(place, F.col(place).cast("bigint"))
