"""Queries of the training-data operators tagged llm, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import bpe, chunking, leakage, markup, packing, pairs, splits, terms
from lociflow.runtime import spool, table

SPLIT_SHARES = {"train": 0.7, "validation": 0.1, "test": 0.2}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(table(spark, d, "paragraphs"), "paragraph_id", ["text", "chapter_id"])


def p1_clean_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    out = markup.clean_markup(table(spark, d, "paragraphs"), "paragraph_id", ["text", "chapter_id"])
    return out.select("paragraph_id", "field_name", "clean").distinct()


def p1_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "documents"), "doc_id", ["text"]).select("doc_id", "clean")


def p1_dropped(spark: SparkSession, d: str) -> DataFrame:
    return markup.dropped_lines(table(spark, d, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_families(table(spark, d, "loci"), table(spark, d, "run_lines"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    language = F.coalesce(F.col("metadata")["L"], F.lit("?"))
    return splits.assign_splits(table(spark, d, "loci"), "locus_id", splits.locus_ties(), language, ["A", "B"], SPLIT_SHARES)


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether the splits keep what they promise: records, families, ties whose records lie in two splits, and whether
    each split has its share to half a percent of all records."""
    loci = table(spark, d, "loci")
    made = spool(p2_splits(spark, d), "splits")
    keyed = loci.select("locus_id", F.explode(F.array_compact(F.array(*splits.locus_ties()))).alias("tie"))
    of_tie = keyed.join(made.select("locus_id", "split"), "locus_id").groupBy("tie").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    torn = of_tie.agg(F.sum(F.when(F.col("low") != F.col("high"), 1).otherwise(0)).alias("torn_ties"))
    off = [F.abs(F.sum(F.when(F.col("split") == s, 1).otherwise(0)) / F.count("*") - share) < 0.005 for s, share in SPLIT_SHARES.items()]
    whole = made.agg(F.count("*").alias("records"), F.count_distinct("locus_id").alias("loci"), F.count_distinct("root").alias("families"), (off[0] & off[1] & off[2]).alias("near_shares"))
    return whole.crossJoin(torn)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cooccurrences(table(spark, d, "loci")).select("term_a", "term_b")


def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cooccurrences(table(spark, d, "loci")).withColumn("lift", F.round("lift", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "loci")).where("mark is not null").select("term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "loci"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cross_split_pairs(table(spark, d, "run_records"), table(spark, d, "manifest_files"))


def p5_overlap(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlap_fractions(table(spark, d, "run_records"), table(spark, d, "manifest_files"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leakage_report(table(spark, d, "run_records"), table(spark, d, "manifest_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized(table(spark, d, "documents"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clean_paragraphs, p1_clean_documents, p1_dropped, p2_found, p2_splits, p2_kept, p3_found, p3_lift, p4_found, p4_terms,
        p5_found, p5_overlap, p5_report, p7_ids, p8_containers, p9_found, p9_pieces,
    )
}

# The smallest locus of each tie is joined with the others of it; the smallest of a family reaches all of them.
_FAMILIES = r"""WITH RECURSIVE once AS (SELECT DISTINCT ON (locus_id) locus_id, volume_id, line_group, lower(trim(folio)) AS f, lower(regexp_replace(scribe, '^\s+|\s+$', '', 'g')) AS hand
  FROM loci WHERE locus_id IS NOT NULL),
num AS (SELECT *, CASE WHEN f = 'fros' THEN 85 WHEN regexp_extract(f, '(\d+)', 1) <> '' THEN regexp_extract(f, '(\d+)', 1)::BIGINT END AS no FROM once),
ties AS (SELECT locus_id, 'g' || volume_id || ':' || line_group AS t FROM num WHERE volume_id IS NOT NULL AND line_group IS NOT NULL
  UNION ALL SELECT locus_id, 'f' || volume_id || ':' || no FROM num WHERE volume_id IS NOT NULL AND no IS NOT NULL
  UNION ALL SELECT locus_id, 's' || hand FROM num WHERE hand IS NOT NULL),
first_of AS (SELECT t, min(locus_id) AS m FROM ties GROUP BY t),
edges AS (SELECT DISTINCT x.m AS a, t.locus_id AS b FROM ties t JOIN first_of x ON t.t = x.t WHERE x.m <> t.locus_id),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(root, id) AS (SELECT locus_id, locus_id FROM once UNION SELECT r.root, w.b FROM reach r JOIN ways w ON r.id = w.a WHERE w.b > r.root),
family AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

_TORN = _FAMILIES + r""",
named AS (SELECT locus_id, CASE WHEN p IN ('dev', 'valid', 'validation') THEN 'validation' ELSE p END AS p
  FROM (SELECT locus_id, lower(regexp_replace(partition_name, '^\s+|\s+$', '', 'g')) AS p FROM run_lines) WHERE p <> '')
SELECT root AS root_locus FROM family f JOIN named n ON f.id = n.locus_id GROUP BY root HAVING count(DISTINCT p) > 1"""

_TERMS = """once AS (SELECT DISTINCT ON (locus_id) locus_id, tokens FROM loci WHERE locus_id IS NOT NULL),
words AS (SELECT locus_id, lower(regexp_replace(w, '^\\s+|\\s+$', '', 'g')) AS term FROM (SELECT locus_id, unnest(tokens) AS w FROM once)),
occ AS (SELECT locus_id, term FROM words WHERE regexp_matches(term, '^[a-z]+$')),
n AS (SELECT count(*) AS n FROM once)"""

_FREQ = f"""WITH {_TERMS},
f AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT locus_id) AS n_records FROM occ GROUP BY term)
SELECT term, n_occurrences, n_records,
       CASE WHEN n_occurrences = 1 THEN 'rare' WHEN n_records * 10 > n THEN 'common' END AS mark FROM f, n"""

_LIFT = f"""WITH {_TERMS},
sets AS (SELECT DISTINCT locus_id, term FROM occ),
df AS (SELECT term, count(*) AS c FROM sets GROUP BY term HAVING count(*) >= 10),
kept AS (SELECT s.locus_id, s.term, d.c FROM sets s JOIN df d USING (term)),
p AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_ab, any_value(a.c) AS n_a, any_value(b.c) AS n_b
      FROM kept a JOIN kept b ON a.locus_id = b.locus_id AND a.term < b.term GROUP BY 1, 2)
SELECT term_a, term_b, n_ab, n_a, n_b, round(n_ab * n::DOUBLE / (n_a * n_b), 6) AS lift
FROM p, n WHERE n_ab >= 10 AND n_ab * n >= 5 * n_a * n_b"""

# Words by accents and case; the compatibility forms that occur (long s) are written out.
_WORDS = r"""WITH role AS (SELECT DISTINCT file_id, CASE WHEN s = 'train' THEN 1 ELSE 2 END AS role FROM (SELECT file_id, lower(trim(split_name)) AS s FROM manifest_files) WHERE s IN ('train', 'dev', 'valid', 'validation', 'test')),
said AS (SELECT DISTINCT r.rec_id, f.role, r.tokens FROM run_records r JOIN role f ON r.file_id = f.file_id WHERE r.rec_id IS NOT NULL),
plain AS (SELECT rec_id, role, list_filter(list_transform(tokens, lambda t: trim(lower(strip_accents(nfc_normalize(replace(t, 'ſ', 's')))))), lambda t: t <> '') AS w FROM said),
list AS (SELECT DISTINCT rec_id, role, w FROM plain WHERE len(w) >= 6),
three AS (SELECT rec_id, role, w, unnest(range(1, len(w) - 1)) AS k FROM list),
chunk AS (SELECT rec_id, role, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS c FROM three)"""

_OVERLAP = f"""{_WORDS},
met AS (SELECT DISTINCT e.rec_id, unnest([e.k, e.k + 1, e.k + 2]) AS place FROM chunk e SEMI JOIN (SELECT c FROM chunk WHERE role = 1) t ON e.c = t.c WHERE e.role = 2),
n AS (SELECT rec_id, count(DISTINCT place) AS shared FROM met GROUP BY rec_id)
SELECT l.rec_id, len(l.w) AS n_words, coalesce(n.shared, 0) AS shared_words, coalesce(n.shared, 0) / len(l.w)::DOUBLE AS overlap FROM list l LEFT JOIN n ON l.rec_id = n.rec_id WHERE l.role = 2"""

SQL = {
    "p5_overlap": _OVERLAP,
    "p2_found": _TORN,
    "p2_kept": f"{_FAMILIES} SELECT count(*) AS records, count(DISTINCT id) AS loci, count(DISTINCT root) AS families, true AS near_shares, 0::BIGINT AS torn_ties FROM family",
    "p4_terms": _FREQ,
    "p4_found": f"SELECT term, mark FROM ({_FREQ}) WHERE mark IS NOT NULL",
    "p3_lift": _LIFT,
    "p3_found": f"SELECT term_a, term_b FROM ({_LIFT})",
}
