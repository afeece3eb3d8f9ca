"""Structured Streaming over growing corpora: term counts by event time and incremental n-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lociflow.operators import views
from lociflow.runtime import shared_dir


def read_loci_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Locus records as a stream of the Parquet files that arrive at `path`."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a path may name a single file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def once(stream: DataFrame, lateness: str = "31 days") -> DataFrame:
    """Re-delivered records once: by id within the watermark, whose width bounds the state."""
    stream = stream.withColumn("received_at", F.col("received_at").cast("timestamp"))
    return stream.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["locus_id"])


def windowed_terms(stream: DataFrame, width: str = "1 day", lateness: str = "31 days") -> DataFrame:
    """Rows (start, term), one for each word of a record with an id, by tumbling windows of the time of receipt, for run_to_sums()."""
    records = once(stream.select("locus_id", "received_at", "tokens").where("locus_id is not null"), lateness)
    return records.select(F.window("received_at", width)["start"].alias("start"), F.explode(views.accepted(F.col("tokens"))).alias("term"))


def bigrams(stream: DataFrame) -> DataFrame:
    """Rows (prev, ch, n): letter pairs inside words, kept up to date as records arrive (complete or update mode)."""
    words = once(stream).select(F.explode(views.accepted(F.col("tokens"))).alias("w"))
    marked = words.select(F.concat(F.lit("^"), "w", F.lit("$")).alias("w"))
    pair = marked.select(F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("at"), "w").select(F.expr("substr(w, at, 1)").alias("prev"), F.expr("substr(w, at + 1, 1)").alias("ch"))
    return pair.groupBy("prev", "ch").agg(F.count("*").alias("n"))


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; each trigger replaces the result, a Parquet folder in the shared folder, so
    neither the result nor the state passes through the driver. Returns the result after the last trigger."""
    base = f"{shared_dir(df.sparkSession)}/streams/{name}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{number % 2}")
        batch.sparkSession.createDataFrame([(number,)], "n long").write.mode("append").parquet(f"{base}/done")

    query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = df.sparkSession
    last = spark.read.parquet(f"{base}/done").agg(F.max("n")).first()[0]
    return spark.read.parquet(f"{base}/{last % 2}")


def run_to_sums(rows: DataFrame, name: str) -> DataFrame:
    """Counts (columns of `rows`, n) of a stream over what is there. Each trigger writes the counts of its own rows once, by its
    number, so it costs what arrived and not what is known; the result, at any time, is their sum. No count is kept as state."""
    spark = rows.sparkSession
    base, cores = f"{shared_dir(spark)}/streams/{name}", spark.sparkContext.defaultParallelism

    def put(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(*batch.columns).agg(F.count("*").alias("n"))
        counted.coalesce(cores).write.mode("overwrite").parquet(f"{base}/parts/trigger={number}")

    query = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema(StructType([*rows.schema, StructField("n", LongType())])).parquet(f"{base}/parts")
    return parts.groupBy(*rows.columns).agg(F.sum("n").alias("n"))
