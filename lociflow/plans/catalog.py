"""All queries of the core: the operators' names, their callables and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import graphs, shred, tablecipher, views
from lociflow.plans import composites, joins, models, searches, shared, statistics, studies
from lociflow.plans.shared import oracle, query
from lociflow.runtime import spool, table
from lociflow.sources import ivtff
from lociflow.streaming import counts


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.object_links(table(spark, d, "receipts"), "receipt_id", "payload")


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred.adjacency(table(spark, d, "receipts"), "receipt_id", "payload").distinct()


#: The entities of receipts by their place, positions left out. Checks, tracks and regions also stand as values of
#: an object whose keys are their names: checks and tracks at the top, regions anywhere.
ENTITIES = {
    "cases": "(^|/)cases$",
    "checks": "(^|/)checks$|^checks/[^/]+$",
    "sources": "(^|/)sources$",
    "tracks": "(^|/)tracks$|^tracks/[^/]+$",
    "regions": "(^|/)regions(/[^/]+)?$",
    "batches": "(^|/)batches$",
}


def _entity(name: str, *first: str):
    """The query that pivots the objects of an entity."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        adj = shred.adjacency(table(spark, d, "receipts"), "receipt_id", "payload")
        return shred.entity_pivot(adj, "receipt_id", F.col("entity").rlike(ENTITIES[name]), first)

    run.__name__ = f"p6_{name}"
    return run


p6_cases, p6_sources, p6_tracks, p6_regions, p6_batches = map(_entity, ("cases", "sources", "tracks", "regions", "batches"))
p6_checks = _entity("checks", "name", "expected", "observed", "passed")


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    """All objects that none of the entities takes, whatever the layout."""
    adj = shred.adjacency(table(spark, d, "receipts"), "receipt_id", "payload")
    return shred.entity_pivot(adj, "receipt_id", ~F.col("entity").rlike("|".join(ENTITIES.values())))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return shred.values(shred.adjacency(table(spark, d, "receipts"), "receipt_id", "payload"), "receipt_id")


def p6_list_values(spark: SparkSession, d: str) -> DataFrame:
    return shred.list_values(shred.adjacency(table(spark, d, "receipts"), "receipt_id", "payload"), "receipt_id")


def ivtff_lexer(spark: SparkSession, d: str) -> DataFrame:
    loci = table(spark, d, "loci").dropDuplicates(["locus_id"])
    tokens, excluded, malformed = ivtff.lexed(F.col("text_raw"))
    start, end = ivtff.paragraph_flags(F.col("text_raw"))
    return loci.select("locus_id", F.array_join(tokens, " ").alias("tokens"), excluded.cast("long").alias("excluded"), malformed.alias("malformed"), start.alias("opens"), end.alias("closes"))


def line_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Integer lattices of the lines of the train split, by language and illustration class: counts of the visual units,
    spaces between words, and one for the line."""
    lines, counts = views.line_vectors(studies.relation(spark, d, "recs").where("split = 'train'"), [*statistics.COMMON_UNITS, " ", "|"])
    track = F.concat(F.coalesce("il", F.lit("?")), F.coalesce("ll", F.lit("?")))
    return graphs.lattice_rows(lines.select(track.alias("track"), F.array(*counts.values()).alias("row")).distinct(), "track", len(counts))


def word_lattice(spark: SparkSession, d: str) -> DataFrame:
    """The same for words instead of lines: counts of letters by place modulo 3, by language."""
    body = "SELECT coalesce(split, '?') AS track, w AS line, cast(cp % 3 AS STRING) || ch AS unit, count(*) AS n FROM {tchars} WHERE ch IN ('o', 'a', 'e', 'y', 'd', 'l', 'k', 'r') GROUP BY coalesce(split, '?'), w, cast(cp % 3 AS STRING) || ch"
    return graphs.lattice_tracks(query(body)(spark, d), "track", [f"{k}{c}" for k in range(3) for c in "oaeydlkr"])


def table_readings(spark: SparkSession, d: str) -> DataFrame:
    """Round trip of the table cipher over paragraphs: tokens with the number of readings and whether the plain text is among them."""
    book = tablecipher.rule_book(spark)
    paras = table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"])
    cipher = tablecipher.encrypt(paras, "paragraph_id", "text", book).groupBy(F.col("token").alias("w"), "plain").agg(F.count("*").alias("n"))
    cipher = spool(cipher, "cipher")
    reads = tablecipher.readings(cipher, book)
    return cipher.join(reads.select("w", F.col("plain").alias("read")), "w", "left").groupBy("w", "plain", "n").agg(F.count("read").alias("readings"), F.max(F.col("plain") == F.col("read")).alias("recovered"))


def stream_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Letter pairs kept by a stream over the locus files, after all of them."""
    return counts.run_to_table(counts.bigrams(counts.read_loci_stream(spark, f"{d}/loci.parquet")), f"bigrams_{uuid.uuid4().hex}")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Terms by day of receipt, by a stream over the locus files."""
    out = counts.run_to_sums(counts.windowed_terms(counts.read_loci_stream(spark, f"{d}/loci.parquet")), f"windows_{uuid.uuid4().hex}")
    return out.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("terms"), F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        p6_found, p6_nodes, p6_cases, p6_checks, p6_sources, p6_tracks, p6_regions, p6_batches, p6_children, p6_values, p6_list_values, ivtff_lexer, line_lattice, word_lattice, table_readings,
        stream_bigrams, stream_windows,
    )
}
# Nodes by recursion from the whole payload; a string that is JSON text of an object or a list takes its place.
_IN_PLACE = "CASE WHEN json_type({v}) = 'VARCHAR' AND ltrim({v} ->> '$', chr(9) || chr(10) || chr(13) || ' ')[1] IN (chr(123), '[') AND json_valid({v} ->> '$') THEN ({v} ->> '$')::JSON ELSE {v} END"
_TREE = f"""WITH RECURSIVE n(receipt_id, path, owner, v, top) AS (
  SELECT receipt_id, '', '', {_IN_PLACE.replace('{v}', 'p')}, true FROM (SELECT DISTINCT receipt_id, payload::JSON AS p FROM receipts WHERE json_valid(payload))
  UNION ALL SELECT receipt_id, path, owner, {_IN_PLACE.replace('{v}', 'w')}, false FROM (
    SELECT n.receipt_id, CASE WHEN n.path = '' THEN e.key ELSE n.path || '/' || e.key END AS path, CASE WHEN json_type(n.v) = 'OBJECT' THEN n.path ELSE n.owner END AS owner, e.value::JSON AS w
    FROM n, LATERAL json_each(n.v) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')))"""
SQL: dict[str, str] = {
    "p6_found": f"{_TREE} SELECT DISTINCT receipt_id, owner AS parent_path, path AS node_path FROM n WHERE json_type(v) = 'OBJECT' AND NOT top",
    "p6_values": f"""{_TREE} SELECT DISTINCT receipt_id, path AS node_path, CASE json_type(v) WHEN 'VARCHAR' THEN 's' WHEN 'BOOLEAN' THEN 'b' WHEN 'NULL' THEN 'z' ELSE 'n' END AS kind,
  CASE WHEN json_type(v) <> 'NULL' THEN v ->> '$' END AS scalar FROM n WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
    "ivtff_lexer": r"""
WITH once AS (SELECT DISTINCT ON (locus_id) locus_id, text_raw FROM loci),
a AS (SELECT *, regexp_replace(text_raw, '<[%$]>|<![^>]*>|<@[A-Z]=[A-Za-z0-9@]>|\\s+', '', 'g') AS x FROM once),
b AS (SELECT *, replace(regexp_replace(x, '<[-~]>', '.', 'g'), ',', '.') AS y FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(y, '\\[(?:[A-Za-z?]|\\{[A-Za-z?]+\\})*(?::(?:[A-Za-z?]|\\{[A-Za-z?]+\\})*)+\\]|\\?+|''|@(?:12[89]|1[3-9][0-9]|2[0-4][0-9]|25[0-5]);', '0', 'g'), '\\{([A-Za-z0]+)\\}', '\\1', 'g') AS z FROM b),
d AS (SELECT *, list_filter(string_split(z, '.'), lambda w: w <> '') AS p FROM c),
e AS (SELECT *, list_filter(list_transform(p, lambda w: lower(w)), lambda w: regexp_matches(w, '^[a-z]+$')) AS t FROM d)
SELECT locus_id, array_to_string(t, ' ') AS tokens, (len(p) - len(t))::BIGINT AS excluded, regexp_matches(z, '[<>\\[\\]{}:;|()"`#/=+*&!%$@]') AS malformed,
       contains(regexp_replace(text_raw, '<![^>]*>', '', 'g'), '<%>') AS opens, contains(regexp_replace(text_raw, '<![^>]*>', '', 'g'), '<$>') AS closes FROM e""".replace("\\\\", "\\"),
    "stream_windows": """WITH once AS (SELECT locus_id, min(received_at) AS seen, any_value(tokens) AS tokens FROM loci WHERE locus_id IS NOT NULL GROUP BY locus_id),
w AS (SELECT strftime(seen, '%Y-%m-%d') AS day, unnest(list_filter(list_transform(coalesce(tokens, []::VARCHAR[]), lambda t: lower(trim(t))), lambda t: regexp_matches(t, '^[a-z]+$'))) AS term FROM once)
SELECT day, count(DISTINCT term) AS terms, count(*) AS n FROM w GROUP BY day""",
    "stream_bigrams": oracle("SELECT prev, ch, count(*) AS n FROM (SELECT substr('^' || w || '$', i_ + 1, 1) AS prev, substr('^' || w || '$', i_ + 2, 1) AS ch FROM (SELECT w, unnest(range(length(w) + 1)) AS i_ FROM {tok})) GROUP BY prev, ch"),
}
shared.DERIVED |= models.DERIVED | joins.DERIVED
for _module in (statistics, joins, models):
    QUERIES |= {name: query(body) for name, body in _module.BODIES.items()}
    SQL |= {name: oracle(body) for name, body in _module.BODIES.items()}
QUERIES |= studies.QUERIES | searches.QUERIES | composites.QUERIES
SQL |= studies.SQL | composites.SQL
