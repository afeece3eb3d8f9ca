"""One SQL text for two engines: Spark runs it over DataFrame views, DuckDB over common table expressions.

Bodies name the base relations in braces, {recs}, {tok}, {types}, {letters}, {units}, {paras} and others; both engines
know the functions used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociflow.operators import views
from lociflow.runtime import spool, table

_DUCK = {
    "once": "SELECT DISTINCT ON (locus_id) * FROM loci WHERE locus_id IS NOT NULL",
    "clean": """SELECT *, list_filter(list_transform(coalesce(tokens, []::VARCHAR[]), lambda t: lower(trim(t))), lambda t: regexp_matches(t, '^[a-z]+$')) AS words,
  coalesce(len(list_filter(tokens, lambda t: length(trim(t)) > 0)), 0) AS shown,
  CASE WHEN lower(trim(folio)) = 'fros' THEN 85 WHEN regexp_extract(lower(trim(folio)), '(\\d+)', 1) <> '' THEN regexp_extract(lower(trim(folio)), '(\\d+)', 1)::INT END AS folio_no FROM once""",
    "grouped": "SELECT *, CASE WHEN folio_no IS NOT NULL AND volume_id IS NOT NULL THEN volume_id || ':' || folio_no END AS grp FROM clean",
    "recs": f"""SELECT locus_id, source_order, volume_id, lower(trim(folio)) AS folio, try_cast(regexp_extract(locus, '\\.(\\d+)(?:,|$)', 1) AS BIGINT) AS idx, kind,
  regexp_matches(kind, '^[@+*=&~/!]?P') AS paragraph, transcriber, lower(trim(scribe)) AS scribe, metadata['I'] AS il, metadata['L'] AS ll, metadata['Q'] AS ql, text_raw,
  (text_raw LIKE '%<->%' OR text_raw LIKE '%<~>%') AS interrupted,
  coalesce(regexp_matches(text_raw, '\\[[^\\]]*:[^\\]]*\\]|\\?|@[0-9][0-9][0-9];|''|<!\\s*[^>]*\\b[rR][aA][rR][eE]\\b'), false) OR (shown - len(words)) > 0 AS doubt, words, len(words)::BIGINT AS nw, (shown - len(words))::BIGINT AS excluded, folio_no, grp,
  CASE WHEN grp IS NULL THEN NULL WHEN b <= 1 THEN 'test' WHEN b = 2 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, (('0x' || substr(sha256('{views.SALT}' || grp), 1, 16))::UBIGINT % 10)::INT AS b FROM grouped)""",
    "tok": "SELECT locus_id, source_order, grp, split, il, ll, paragraph, excluded, interrupted, nw, unnest(range(len(words))) AS wp, unnest(words) AS w FROM recs",
    "chars": "SELECT locus_id, grp, split, ll, wp, w, unnest(range(length(w))) AS cp, unnest(string_split(w, '')) AS ch FROM tok",
    "units": f"SELECT locus_id, grp, split, ll, wp, w, unnest(range(len(x))) AS up, unnest(x) AS u FROM (SELECT *, regexp_extract_all(w, '{views.GROUPED}', 1) AS x FROM tok)",
    "visual": f"SELECT locus_id, grp, split, ll, wp, w, unnest(range(len(x))) AS up, unnest(x) AS u FROM (SELECT *, regexp_extract_all(w, '{views.VISUAL}', 1) AS x FROM tok)",
    "types": """SELECT split, w, n, length(w)::BIGINT AS len, array_to_string(list_transform(string_split(w, ''), lambda c: len(list_filter(list_distinct(string_split(substr(w, 1, instr(w, c) - 1), '')), lambda x: x <> ''))), '.') AS pattern
FROM (SELECT split, w, count(*) AS n FROM tok GROUP BY split, w)""",
    "letters": "SELECT w, unnest(range(length(w))) AS cp, unnest(string_split(w, '')) AS ch FROM (SELECT DISTINCT w FROM types)",
    "tchars": "SELECT split, w, n, unnest(range(length(w))) AS cp, unnest(string_split(w, '')) AS ch FROM types",
    "tunits": f"SELECT split, w, n, unnest(range(len(x))) AS up, unnest(x) AS u FROM (SELECT *, regexp_extract_all(w, '{views.GROUPED}', 1) AS x FROM types)",
    "tvisual": f"SELECT split, w, n, unnest(range(len(x))) AS up, unnest(x) AS u FROM (SELECT *, regexp_extract_all(w, '{views.VISUAL}', 1) AS x FROM types)",
    "paras": "SELECT DISTINCT ON (paragraph_id) * FROM paragraphs WHERE paragraph_id IS NOT NULL",
}


#: Relations written out once in a query, by their bodies over the base relations.
DERIVED: dict[str, str] = {}
#: Base relations that come from loci; those of distinct words with their counts come from `types`.
_OF_RECS = ("recs", "tok", "chars", "units", "visual", "types")
_OF_TYPES = ("letters", "tchars", "tunits", "tvisual")


class Relations:
    """The base relations of one run of a query, each built once.

    Where more than one relation comes from the records these are written out first, so that re-delivered loci are made
    one once; so are `types` and the derived relations.
    """

    def __init__(self, spark: SparkSession, d: str, text: str) -> None:
        self.spark, self.d, self.built = spark, d, {}
        self.once = sum(len(re.findall(r"\{%s\}" % n, x)) for x in self._texts(text) for n in _OF_RECS) + (self._needs_types(text) > 0) > 1

    def _texts(self, text: str) -> list[str]:
        found, todo = [], [text]
        while todo:
            t = todo.pop()
            found.append(t)
            todo += [DERIVED[n] for n in names_in(t) if n in DERIVED and DERIVED[n] not in found]
        return found

    def _needs_types(self, text: str) -> int:
        return sum(n in _OF_TYPES for t in self._texts(text) for n in names_in(t))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self._build(name)
        return self.built[name]

    def _build(self, name: str) -> DataFrame:
        if name in DERIVED:
            return spool(run_body(DERIVED[name], self), name)
        match name:
            case "paras":
                return table(self.spark, self.d, "paragraphs").where("paragraph_id is not null").dropDuplicates(["paragraph_id"])
            case "recs":
                recs = views.records(table(self.spark, self.d, "loci"))
                return spool(recs, "recs") if self.once else recs
            case "tok":
                return views.words(self["recs"])
            case "chars":
                return views.characters(self["tok"])
            case "units":
                return views.units(self["tok"])
            case "visual":
                return views.units(self["tok"], views.VISUAL)
            case "types":
                return spool(views.types(self["tok"]), "types")
            case "letters":
                return views.letters(self["types"])
            case "tchars":
                return views.type_units(self["types"], "(.)", "cp", "ch")
            case "tunits":
                return views.type_units(self["types"], views.GROUPED)
            case "tvisual":
                return views.type_units(self["types"], views.VISUAL)
        raise KeyError(name)


def names_in(body: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", body)))


def _spark_text(body: str) -> str:
    text = re.sub(r"conv_\((.*?)\)\)", r"conv(\1), 16, 10)", body)
    text = re.sub(r"regexp_replace_all_\((\w+)\)", r"regexp_replace(\1, '[^A-Za-z]+', ' ')", text)
    text = re.sub(r"explode_\((.*?)\) AS i FROM", r"explode(sequence(1, cast(\1 AS INT))) AS i FROM", text)
    text = re.sub(r"spell_\((.*?) BY (.*?)\)_", r"listagg(\1, '') WITHIN GROUP (ORDER BY \2)", text)
    return re.sub(r"array_to_string_\(([^)]*)\)", r"array_join(\1, ' ')", text)


def run_body(body: str, relations: Relations) -> DataFrame:
    text = _spark_text(body)
    return relations.spark.sql(text, **{n: relations[n] for n in names_in(text)})


def query(body: str) -> Callable[[SparkSession, str], DataFrame]:
    """The Spark query of a body."""
    return lambda spark, d: run_body(body, Relations(spark, d, body))


def _plain(body: str) -> str:
    body = re.sub(r"conv_\((.*?)\)\)", r"('0x' || \1))::UBIGINT", body).replace("::UBIGINT AS BIGINT", "::UBIGINT AS BIGINT")
    body = re.sub(r"regexp_replace_all_\((\w+)\)", r"regexp_replace(\1, '[^A-Za-z]+', ' ', 'g')", body)
    body = re.sub(r"spell_\((.*?) BY (.*?)\)_", r"string_agg(\1, '' ORDER BY \2)", body)
    body = re.sub(r"explode_\((.*?)\) AS i FROM", r"unnest(range(1, \1 + 1)) AS i FROM", body)
    return re.sub(r"array_to_string_\(([^)]*)\)", r"array_to_string(\1, ' ')", re.sub(r"\{(\w+)\}", r"\1", body)).strip()


def oracle(body: str) -> str:
    """The same for DuckDB, with the base relations as common table expressions in front."""
    needed = dict(_DUCK)

    def add(text: str) -> None:
        for n in names_in(text):
            if n in DERIVED and n not in needed:
                add(DERIVED[n])
                needed[n] = _plain(DERIVED[n])

    add(body)
    ctes = ", ".join(f"{k} AS ({v})" for k, v in needed.items())
    body = _plain(body)
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {ctes}, {body[14:].lstrip()}"
    return f"WITH {ctes}, {body[4:].lstrip()}" if re.match(r"WITH\b", body) else f"WITH {ctes} {body}"
