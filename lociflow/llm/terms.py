"""Frequency of every distinct term: range-partitioned external sort of (term, record) pairs, then a run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import ship


def term_of(token: Column) -> Column:
    """A token trimmed of blanks and lower-cased."""
    return F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))


def postings(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """Rows (term, id), one for each occurrence of a term (letters a-z only, trimmed and lower-cased) in the first delivery of
    its id.

    Null tokens, null lists and rows without an id give none. Each task first reduces an id to its first delivery, so an
    id with many deliveries leaves a row for each task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"), F.monotonically_increasing_id().alias("delivery"))
    return (
        rows.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min_by("tokens", "delivery").alias("tokens"))
        .select(F.explode("tokens").alias("token"), "id")
        .select(term_of(F.col("token")).alias("term"), "id")
        .where(F.col("term").rlike("^[a-z]+$"))
    )


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of batches sorted by (term, id): rows (term, occurrences, records). A run may cross batches."""
    term = last_id = None  # of the open run
    occ = records = 0

    def out(terms, o, r) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())], ["term", "occurrences", "records"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        t, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        new_term = np.ones(n, bool)
        new_term[1:] = pc.not_equal(t.slice(1), t.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_rec = new_term.copy()
        new_rec[1:] |= ids[1:] != ids[:-1]
        at = np.flatnonzero(new_term)
        o = np.diff(np.append(at, n))
        r = np.add.reduceat(new_rec.astype(np.int64), at)
        if term is not None and t[0].as_py() == term:
            o[0] += occ
            r[0] += records - (ids[0] == last_id)
        elif term is not None:
            yield out([term], [occ], [records])
        names = t.take(pa.array(at))
        if len(at) > 1:
            yield out(names[:-1], o[:-1], r[:-1])
        term, occ, records, last_id = names[-1].as_py(), int(o[-1]), int(r[-1]), ids[-1]
    if term is not None:
        yield out([term], [occ], [records])


def term_frequencies(df: DataFrame, id_col: str = "locus_id", tokens_col: str = "tokens") -> DataFrame:
    """Rows (term, n_occurrences, n_records, mark) of every distinct term.

    mark: `rare` for a term that occurs once in all, `common` for one in more than a tenth of the distinct ids
    (those without terms too), else null. A re-delivered row (the same id again) counts once, by its first
    delivery; a row without an id counts as no record. An empty table gives no row.

    Plan: ids are reduced to their first deliveries. (term, id) is then range-partitioned by both, so a hot term spreads
    over as many partitions as it fills while the rows of one (term, id), being of one record, stay together; sorting
    spills to disk. The scan leaves a row for each term and partition, which one small sum joins.
    """
    ship(df.sparkSession)
    n = df.agg(F.count_distinct(F.col(id_col))).first()[0]
    runs = (
        postings(df, id_col, tokens_col)
        .repartitionByRange("term", "id")
        .sortWithinPartitions("term", "id")
        .mapInArrow(scan_runs, "term string, occurrences long, records long")
    )
    total = runs.groupBy("term").agg(F.sum("occurrences").alias("n_occurrences"), F.sum("records").alias("n_records"))
    mark = F.when(F.col("n_occurrences") == 1, "rare").when(F.col("n_records") * 10 > F.lit(n), "common")
    return total.withColumn("mark", mark)
