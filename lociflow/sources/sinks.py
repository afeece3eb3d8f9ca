"""Sinks and provenance: write-once runs, hashes, manifests, and export by a list of allowed columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from lociflow.runtime import Files


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no non-finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def write_once(spark: SparkSession, path: str, value) -> str:
    """Write a value as canonical JSON into a file that must not exist yet, on any file system; returns its sha256."""
    data = (canonical_json(value) + "\n").encode()
    Files(spark, path).write_new(path, data)
    return hashlib.sha256(data).hexdigest()


def assert_schema(df: DataFrame, schema: StructType | str) -> DataFrame:
    """`df` if it has exactly the fields of `schema`, in any order; an error otherwise. Nothing is coerced."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    if have != {f.name: f.dataType for f in want}:
        raise ValueError(f"schema differs: {df.schema.simpleString()} is not {want.simpleString()}")
    return df.select(*[f.name for f in want])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def verify_hashes(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """Rows (file, expected, actual, matches) of the named files below `path`; a missing file has a null hash."""
    manifest = spark.createDataFrame(sorted(expected.items()), "file string, expected string")
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("actual"))
    return manifest.join(files, "file", "left").withColumn("matches", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def write_run(records: DataFrame, analysis: dict, report: str, path: str) -> None:
    """A run's folder: records, analysis.json, REPORT.md and SHA256SUMS, staged beside `path` and renamed at the end.

    An existing `path` is refused. The records are written by the executors; the driver writes and hashes its own
    two files. What a failed run left staged is removed first.
    """
    spark = records.sparkSession
    files = Files(spark, path)
    if files.exists(path):
        raise FileExistsError(path)
    stage = f"{path}.staged"
    files.delete(stage)
    records.write.mode("errorifexists").json(f"{stage}/records")
    sums = {"analysis.json": write_once(spark, f"{stage}/analysis.json", analysis)}
    files.write_new(f"{stage}/REPORT.md", report.encode())
    sums["REPORT.md"] = hashlib.sha256(report.encode()).hexdigest()
    files.write_new(f"{stage}/SHA256SUMS", "".join(f"{v}  {k}\n" for k, v in sorted(sums.items())).encode())
    files.rename(stage, path)


#: Columns that never leave: raw text, models, vocabularies and paths.
PRIVATE = ("text", "text_raw", "tokens", "words", "vocabulary", "model", "path")


def _public(kind: DataType, c: Column) -> Column | None:
    """A column without what is private at any depth: named fields go, floats that are not finite and absolute paths
    become null; None if nothing is left."""
    if isinstance(kind, StructType):
        kept = [(f.name, _public(f.dataType, c[f.name])) for f in kind if f.name not in PRIVATE]
        kept = [x.alias(n) for n, x in kept if x is not None]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType):
        probe = _public(kind.elementType, F.lit(None).cast(kind.elementType))
        return None if probe is None else F.transform(c, lambda x: _public(kind.elementType, x))
    if isinstance(kind, MapType):
        return F.map_filter(c, lambda k, _: ~k.isin(*PRIVATE)) if isinstance(kind.keyType, StringType) else c
    if isinstance(kind, (FloatType, DoubleType)):
        return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
    if isinstance(kind, StringType):
        return F.when(~c.rlike("^(/|[A-Za-z]:[/\\\\]|[a-z]+://)"), c)
    return c


def export_public(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, of which none may be private. Inside structs, lists and maps private fields go as well;
    floats that are not finite and texts that are absolute paths become null."""
    if bad := sorted(set(allowed) & set(PRIVATE)):
        raise ValueError(f"private columns: {', '.join(bad)}")
    out = [(f.name, _public(f.dataType, F.col(f"`{f.name}`"))) for f in df.select(*allowed).schema]
    return df.select(*[c.alias(n) for n, c in out if c is not None])


def export_runs(spark: SparkSession, runs: dict[str, DataFrame], allowed: dict[str, list[str]], path: str, replace: bool = False) -> dict[str, str]:
    """The public columns of several results, each as one folder of JSON lines below `path`, staged and renamed; an existing
    `path` is refused unless `replace`. Returns a digest of each result's rows, whatever their order."""
    files = Files(spark, path)
    if files.exists(path) and not replace:
        raise FileExistsError(path)
    stage, digests = f"{path}.staged", {}
    files.delete(stage)
    for name, df in sorted(runs.items()):
        public = export_public(df, allowed[name])
        public.write.mode("errorifexists").json(f"{stage}/{name}")
        row = F.sha2(F.to_json(F.struct(*public.columns)), 256)
        digests[name] = public.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")), 256)).first()[0]
    files.write_new(f"{stage}/DIGESTS.json", (canonical_json(digests) + "\n").encode())
    if files.exists(path):
        files.delete(path)
    files.rename(stage, path)
    return digests


def render_table(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of an aggregate's rows; it shows `limit` rows and says how many there are."""
    rows, n = df.limit(limit).collect(), df.count()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    body = "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
    return head + body + (f"\n{n - limit} more rows\n" if n > limit else "")


def render_report(title: str, sections: dict[str, DataFrame | str], limit: int = 200) -> str:
    """A Markdown report: a heading for each section, with a table of its aggregate or its text."""
    body = [f"## {name}\n\n{part if isinstance(part, str) else render_table(part, limit)}" for name, part in sections.items()]
    return f"# {title}\n\n" + "\n\n".join(x.rstrip("\n") for x in body) + "\n"
