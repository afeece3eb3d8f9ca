"""Frozen plans: hashes of inputs and settings checked before a run, keys written before test data is read, time limits."""

from __future__ import annotations

import ast
import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.runtime import Files, shared_dir
from lociflow.sources.sinks import canonical_json


def file_hashes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """sha256 of each file, by the executors."""
    out = {}
    for path in paths:
        rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()  # one file
        if len(rows) != 1:
            raise ValueError(f"{path} is not one file")
        out[path] = rows[0][0]
    return out


def freeze(spark: SparkSession, paths: list[str], settings: dict) -> dict:
    """A manifest of files and settings (limits, seeds, names of queries) with a digest of its own."""
    body = {"files": file_hashes(spark, sorted(paths)), "settings": settings}
    return {**body, "digest": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def verify_freeze(spark: SparkSession, manifest: dict, settings: dict) -> None:
    """An error unless files, settings and digest are those of the manifest; nothing else has run by then."""
    if set(manifest) != {"files", "settings", "digest"}:
        raise ValueError("a manifest has files, settings and a digest")
    body = {k: manifest[k] for k in ("files", "settings")}
    if hashlib.sha256(canonical_json(body).encode()).hexdigest() != manifest["digest"]:
        raise ValueError("the manifest was changed")
    if canonical_json(settings) != canonical_json(manifest["settings"]):
        raise ValueError("other settings than those frozen")
    now = file_hashes(spark, sorted(manifest["files"]))
    if changed := sorted(p for p, h in manifest["files"].items() if now[p] != h):
        raise ValueError(f"changed files: {', '.join(changed)}")


def fit_before_test(fitted: DataFrame, score: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """score(keys) of keys that were written, and read back, before it is called: what is scored can't see the test data.

    An existing `path` is refused; without one the keys go to the shared folder.
    """
    spark = fitted.sparkSession
    to = path or f"{shared_dir(spark)}/frozen/{uuid.uuid4().hex}"
    fitted.write.mode("errorifexists").parquet(to)
    if not Files(spark, to).exists(f"{to}/_SUCCESS"):
        raise OSError(f"{to} was not written whole")
    return score(spark.read.schema(fitted.schema).parquet(to))


def supervise(spark: SparkSession, work: Callable[[], object], seconds: float) -> tuple[str, object]:
    """(status, result) of `work`, whose jobs are cancelled after so many seconds: finished, timed_out, or failed with the error."""
    group = f"supervised-{uuid.uuid4().hex}"
    context, late = spark.sparkContext, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, group, True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return "finished", work()
    except Exception as error:  # the status says which
        return ("timed_out", None) if late.is_set() else ("failed", error)
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def read_literals(source: str, name: str) -> dict:
    """The one literal map that Python text assigns to `name`; the text is parsed, never run."""
    found = []
    for node in ast.walk(ast.parse(source)):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        if any(isinstance(t, ast.Name) and t.id == name for t in targets):
            found.append(node.value)
    if len(found) != 1:
        raise ValueError(f"{name} is assigned {len(found)} times")
    value = ast.literal_eval(found[0])
    if not isinstance(value, dict) or not value:
        raise ValueError(f"{name} is no map with entries")
    return value


def literal_rows(spark: SparkSession, source: str, name: str) -> DataFrame:
    """Rows (key, tag, value) of a literal map of maps; other values stand with a null tag."""
    rows = []
    for key, tags in read_literals(source, name).items():
        rows += [(str(key), str(t), str(v)) for t, v in tags.items()] if isinstance(tags, dict) else [(str(key), None, str(tags))]
    return spark.createDataFrame(rows, "key string, tag string, value string")
