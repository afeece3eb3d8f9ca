"""Transcription files: page headers, locus lines and the lexer, as column expressions over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
_FOLIO, _NUMBER, _LOCATOR, _KIND, _HAND = "[A-Za-z][A-Za-z0-9]*", "[0-9]+", "[@+*=&~/!]", "[PLCR][a-z0-9]", "[A-Za-z0-9]"
_PAGE = f"^<({_FOLIO})>(?:\\s*<!\\s*([^>]*)>)?\\s*$"
_LOCUS = f"^<({_FOLIO})[.]({_NUMBER}),({_LOCATOR})({_KIND})(?:;({_HAND}))?>\\s*(.*)$"
_HEADER = r"^#=(?:IVTFF|VDBTF)\s+(?:Eva-|EvaT)\s"
_CODE = r"@(?:12[89]|1[3-9][0-9]|2[0-4][0-9]|25[0-5]);"
_CLEAR = r"(?U)<[%$]>|<![^>]*>|<@[A-Z]=[A-Za-z0-9@]>|\s+"
_FRAGMENT = r"(?:[A-Za-z'?]|\{(?:[A-Za-z'?]|" + _CODE + r")+\}|" + _CODE + ")*"  # what may stand in a choice, ligatures closed
_DOUBT = r"\[" + _FRAGMENT + "(?::" + _FRAGMENT + r")+\]|\?+|'|" + _CODE
_LEFT_OVER = r"""[<>\[\]{}:;|()"`#/=+*&!%$@]"""
KNOWN_SOURCES = "ZL|IT|TT|GC|CD|FG|RF"


def lexed(raw: Column, uncertain_spaces: str = "split") -> tuple[Column, Column, Column]:
    """Columns (tokens, excluded, malformed) of a raw line, all in the JVM.

    Blanks and `<%> <$> <!...> <@X=y>` vanish; `.`, `<->`, `<~>` and, with 'split', `,` end a word; with 'join' the
    comma vanishes. A ligature in braces gives its letters. A word with an alternative in brackets, `?`, `'`, a code
    `@ddd;` (128 to 255), a digit or a letter beyond a-z is excluded and counted; other words are lower-cased.
    `malformed` tells that marks were left which the format doesn't know.
    """
    if uncertain_spaces not in ("split", "join"):
        raise ValueError("uncertain_spaces is 'split' or 'join'")
    x = F.regexp_replace(raw, _CLEAR, "")
    x = F.regexp_replace(x, "<[-~]>", ".")
    x = F.regexp_replace(x, ",", "." if uncertain_spaces == "split" else "")
    x = F.regexp_replace(x, _DOUBT, "0")
    x = F.regexp_replace(x, r"\{([A-Za-z0]+)\}", "$1")
    parts = F.filter(F.split(x, r"\."), lambda w: w != "")
    tokens = F.filter(F.transform(parts, F.lower), lambda w: w.rlike("^[a-z]+$"))
    return tokens, (F.size(parts) - F.size(tokens)).cast("int"), x.rlike(_LEFT_OVER)


def paragraph_flags(raw: Column) -> tuple[Column, Column]:
    """Whether `<%>` opens and `<$>` closes a paragraph, not counting what stands in comments."""
    bare = F.regexp_replace(raw, "<![^>]*>", "")
    return bare.contains("<%>"), bare.contains("<$>")


def _pairs(text: Column, pattern: str, at: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.map_from_entries(F.transform(found, lambda m: F.struct(F.substring(m, at, 1).alias("k"), F.substring(m, at + 2, 1).alias("v"))))


def read_ivtff(spark: SparkSession, path: str, uncertain_spaces: str = "split", volume_id: int = 1) -> DataFrame:
    """Locus records of the files at `path` in file order, with the columns of the `loci` table, so that the queries read
    them as they are: `kind` is the type of the locus, its locator stands apart, the scribe is the page's variable H, and
    all files are transcriptions of one volume. `locus_id` is made of the file's name and the number of the line.

    Page variables start anew on each page; inline tags override them and hold for the later loci of the page. A line
    that ends in '/' goes on in the next, which begins with '/'. Anything that is not of the format is an error that
    names file and line; so is a second value of one variable or tag in a line.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"/[ \t]*\r?\n/", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    where = F.concat(F.col("file"), F.lit(":"), (F.col("line") + 1).cast("string"))
    kind = (
        F.when(F.col("line") == 0, F.when(F.col("text").rlike(_HEADER), "skip").otherwise("header"))
        .when((F.trim("text") == "") | F.col("text").startswith("#"), "skip")
        .when(F.col("text").rlike(_PAGE), "page")
        .when(F.col("text").rlike(_LOCUS), "locus")
        .otherwise("bad")
    )
    lines = lines.withColumn("what", kind).where("what <> 'skip'")
    lines = lines.withColumn("what", F.when(F.col("what").isin("bad", "header"), F.raise_error(F.concat(where, F.lit(": unexpected line")))).otherwise(F.col("what")))
    order = Window.partitionBy("file").orderBy("line")
    page = lines.withColumn("page_no", F.sum(F.when(F.col("what") == "page", 1).otherwise(0)).over(order))
    of_page = Window.partitionBy("file", "page_no").orderBy("line")
    head = F.first(F.when(F.col("what") == "page", F.struct(F.regexp_extract("text", _PAGE, 1).alias("folio"), F.regexp_extract("text", _PAGE, 2).alias("vars")))).over(of_page)
    part = lambda k: F.regexp_extract("text", _LOCUS, k)
    loci = page.withColumn("head", head).withColumn("body", part(6)).withColumn("tags", _pairs(F.col("body"), "<@[A-Z]=[A-Za-z0-9@]>", 3))
    held = F.collect_list("tags").over(of_page)
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    empty = F.create_map().cast("map<string,string>")
    loci = loci.withColumn("held", F.aggregate(held, empty, over)).where("what = 'locus'")
    variables = F.when(F.col("head").isNotNull(), _pairs(F.col("head.vars"), r"\$[A-Z]=[A-Za-z0-9@]", 2)).otherwise(empty)
    tokens, excluded, malformed = lexed(F.col("body"), uncertain_spaces)
    start, end = paragraph_flags(F.col("body"))
    source = F.regexp_extract("file", f"^({KNOWN_SOURCES})", 1)
    stray = malformed | (F.col("head").isNotNull() & (part(1) != F.col("head.folio")))
    number = F.shiftleft(F.xxhash64("file").bitwiseAND((1 << 31) - 1), 32).bitwiseOR(F.col("line").cast("bigint"))
    metadata = over(variables, F.col("held"))
    return loci.select(
        number.alias("locus_id"),
        "file",
        F.col("line").cast("bigint").alias("source_order"),
        F.lit(volume_id).cast("bigint").alias("volume_id"),
        F.lit(None).cast("string").alias("line_group"),
        F.when(stray, F.raise_error(F.concat(where, F.lit(": unexpected markup or page")))).otherwise(part(1)).alias("folio"),
        F.concat(part(1), F.lit("."), part(2), F.lit(","), part(3), part(4)).alias("locus"),
        part(4).alias("kind"),
        part(3).alias("locator"),
        F.coalesce(F.nullif(part(5), F.lit("")), F.nullif(source, F.lit(""))).alias("transcriber"),
        F.try_element_at(metadata, F.lit("H")).alias("scribe"),
        F.col("body").alias("text_raw"),
        tokens.alias("tokens"),
        metadata.alias("metadata"),
        excluded.alias("excluded_tokens"),
        F.lit(True).alias("excluded_exact"),
        start.alias("paragraph_start"),
        end.alias("paragraph_end"),
        F.lit(None).cast("timestamp_ntz").alias("received_at"),
    )


def union_sources(spark: SparkSession, paths: list[str], uncertain_spaces: str = "split", volume_id: int = 1) -> DataFrame:
    """Records of several transcriptions of one volume, by name."""
    out = None
    for path in paths:
        part = read_ivtff(spark, path, uncertain_spaces, volume_id)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no paths")
    return out


def filter_transcriber(records: DataFrame, transcriber: str | None = None) -> DataFrame:
    """Records of one transcriber; an error if none or more than one is left."""
    kept = records if transcriber is None else records.where(F.col("transcriber") == transcriber)
    left = kept.select("transcriber").distinct().limit(2).count()
    if left != 1:
        raise ValueError("no records" if left == 0 else "more than one transcriber")
    return kept
