"""Terms that stand together: heavy-light decomposition of pair counting, with lift.

Frequent terms are counted against each other by popcounts of a dense bit matrix, rare ones by counting pair
keys, mixed pairs by probing each rare term's list of records for their frequent terms; the three are disjoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.terms import term_of
from lociflow.runtime import BROADCAST_ROWS, broadcast_if_small, spool

#: A term is heavy if it is in at least one record of so many ...
HEAVY_SHARE = 256
#: ... and among the so many most frequent ones: the bit matrix has that many lines at most.
HEAVY_MAX = 1024
#: Records in one bit matrix, and postings held for it: whichever comes first ends a block.
BLOCK, POSTINGS = 1 << 16, 1 << 22
#: Pair keys kept before they are counted and handed on.
KEYS = 1 << 21


def term_sets(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """Rows (id, terms): each id once, with the distinct terms of its row; ids without terms too."""
    terms = F.array_distinct(F.filter(F.transform(F.col(tokens_col), term_of), lambda t: t.rlike("^[a-z]+$")))
    return df.select(F.col(id_col).alias("id"), terms.alias("terms")).where(F.col("id").isNotNull()).dropDuplicates(["id"])


class _Counts:
    """Collects pair keys a << 32 | b and hands them on counted."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), KEYS):  # one long record may hold more pairs than fit
            x, y = a[at : at + KEYS], b[at : at + KEYS]
            self.parts.append(np.minimum(x, y) << 32 | np.maximum(x, y))
            self.n += len(x)
            if self.n >= KEYS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            keys, n = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.n = [], 0
            yield from _rows(keys, n)


def _rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)], pa.int64()), pa.array(n[at : at + (1 << 17)], pa.int64())], ["pair", "n"])


def count_block(row: np.ndarray, item: np.ndarray, rows: int, heavy: int, counts: _Counts) -> Iterator[pa.RecordBatch]:
    """Pairs of one block of records. row, item: postings by row; items below `heavy` are the frequent ones."""
    is_heavy = item < heavy
    hr, hi, lr, li = row[is_heavy], item[is_heavy], row[~is_heavy], item[~is_heavy]
    if len(hi):
        # heavy with heavy: a line of bits for each item present, popcount of the AND of two lines
        present, line = np.unique(hi, return_inverse=True)
        bits = np.zeros((len(present), (rows + 63) // 64 * 64), bool)
        bits[line, hr] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        del bits
        for i in range(len(present) - 1):
            n = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
            some = np.flatnonzero(n)
            yield from _rows(present[i].astype(np.int64) << 32 | present[i + 1 :][some], n[some])
        # heavy with light: each posting of a light item probes the heavy items of its record
        per_row = np.bincount(hr, minlength=rows)
        start = np.concatenate([[0], np.cumsum(per_row)])
        for at in range(0, len(lr), KEYS // 8):
            r, x = lr[at : at + KEYS // 8], li[at : at + KEYS // 8]
            k = per_row[r]
            skip = np.repeat(np.cumsum(k) - k, k)
            probe = np.repeat(start[r], k) + (np.arange(len(skip)) - skip)
            yield from counts.add(hi[probe], np.repeat(x, k))
    # light with light: posting i with posting i + step while they are of one record
    step, base = 1, np.arange(len(lr))
    while len(base := base[base + step < len(lr)]):
        base = base[lr[base] == lr[base + step]]
        if not len(base):
            break
        yield from counts.add(li[base], li[base + step])
        step += 1


def _counter(heavy: int, vocabulary=None):
    """Worker: batches of one column, the terms (strings, by `vocabulary`) or items (ints) of a record, to counted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else pa.array(vocabulary.value, pa.string())
        counts, rows, items, total, held = _Counts(), [], [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                col = b.column(0).slice(at, 1024)
                lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                row, flat = np.repeat(np.arange(len(col)), lengths), col.flatten()
                item = pc.index_in(flat, value_set=known) if known is not None else flat
                ok = pc.is_valid(item).to_numpy(zero_copy_only=False)
                item = item.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                rows.append(row[ok] + total)
                items.append(item)
                total, held = total + len(col), held + len(item)
                if total >= BLOCK or held >= POSTINGS:
                    yield from count_block(*_sorted(rows, items), total, heavy, counts)
                    rows, items, total, held = [], [], 0, 0
        if total:
            yield from count_block(*_sorted(rows, items), total, heavy, counts)
        yield from counts.flush()

    return run


def _sorted(rows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row, item = np.concatenate(rows), np.concatenate(items)
    order = np.lexsort((item, row))
    return row[order], item[order]


def cooccurrences(
    df: DataFrame, id_col: str = "locus_id", tokens_col: str = "tokens", min_count: int = 10, min_lift: float = 5, dictionary_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows (term_a, term_b, n_ab, n_a, n_b, lift), term_a < term_b: pairs in at least `min_count` records and
    `min_lift` times as often as by chance, n_ab * N >= min_lift * n_a * n_b; N is the number of distinct ids.

    Terms are tokens trimmed, lower-cased and of letters a-z only; a record holds a term or not, however often.
    A re-delivered row counts once; null lists and null tokens hold nothing; rows without an id count as none.

    Nothing is sampled or capped. Two bounds that follow from the result's own condition come first: n_ab cannot
    exceed n_a, so a term in fewer than min_count records, or in more than N / min_lift of them, is in no
    pair of the result. What is left is numbered by falling frequency. Up to `dictionary_rows` of these terms (counted
    first) the numbering is sent to the workers; beyond, terms meet their numbers in a shuffled join, in which only heavy
    terms, of which there are HEAVY_MAX at most, are broadcast. Each task counts its blocks of records; a sum joins them.
    """
    spark = df.sparkSession
    base = spool(term_sets(df, id_col, tokens_col), "sets")
    n = base.count()
    by_term = base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = spool(by_term.where((F.col("n") >= min_count) & (F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n)))), "kept")
    size = kept.count()
    floor = max(min_count, n // HEAVY_SHARE)
    top = kept.where(F.col("n") >= floor).orderBy(F.desc("n"), "term").limit(HEAVY_MAX)
    schema = "pair long, n long"
    if size <= dictionary_rows:
        rows = kept.collect()  # at most dictionary_rows of them
        rows.sort(key=lambda r: (-r.n, r.term))
        heavy = min(HEAVY_MAX, sum(r.n >= floor for r in rows))
        vocabulary = spark.sparkContext.broadcast([r.term for r in rows])
        numbers = spark.createDataFrame(pa.table({"item": pa.array(range(size), pa.int64()), "term": pa.array([r.term for r in rows], pa.string()), "n": pa.array([r.n for r in rows], pa.int64())}))
        parts = base.select("terms").mapInArrow(_counter(heavy, vocabulary), schema)
    else:
        names = [r.term for r in top.collect()]  # at most HEAVY_MAX
        heavy = len(names)
        first = spark.createDataFrame(pa.table({"item": pa.array(range(heavy), pa.int64()), "term": pa.array(names, pa.string())}))
        rest = kept.join(F.broadcast(first), "term", "left_anti").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33))
        rest = spool(rest, "rest")
        offset, at = [], heavy
        for r in sorted(rest.groupBy("part").count().collect()):  # a row for each partition
            offset.append((r["part"], at))
            at += r["count"]
        if at >= 1 << 31:
            raise ValueError("more than 2^31 terms qualify")
        shift = spark.createDataFrame(offset, "part int, shift long")
        light = spool(rest.join(F.broadcast(shift), "part").select((F.col("at") + F.col("shift")).alias("item"), "term", "n"), "light")
        first = first.join(kept, "term").select("item", "term", "n")
        numbers = spool(light.unionByName(first), "numbers")
        flat = base.select("id", F.explode("terms").alias("term"))
        hot = flat.join(F.broadcast(first.select("term", "item")), "term", "left")
        cold = hot.where(F.col("item").isNull()).select("id", "term").join(light.select("term", "item"), "term").select("id", "item")
        both = hot.where(F.col("item").isNotNull()).select("id", "item").unionByName(cold)
        parts = both.groupBy("id").agg(F.collect_list("item").alias("items")).select("items").mapInArrow(_counter(heavy), schema)
    total = parts.groupBy("pair").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    side = lambda x: broadcast_if_small(numbers.select(F.col("item").alias(f"i{x}"), F.col("term").alias(f"t{x}"), F.col("n").alias(f"n{x}")), size)
    joined = (
        total.select(F.shiftright("pair", 32).alias("i1"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("i2"), "n_ab")
        .join(side(1), "i1")
        .join(side(2), "i2")
        .where(F.col("n_ab") * F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("n1") * F.col("n2"))
    )
    swap = F.col("t1") > F.col("t2")
    return joined.select(
        F.least("t1", "t2").alias("term_a"),
        F.greatest("t1", "t2").alias("term_b"),
        "n_ab",
        F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n_a"),
        F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("n_b"),
        (F.col("n_ab") * F.lit(float(n)) / (F.col("n1") * F.col("n2"))).alias("lift"),
    )
