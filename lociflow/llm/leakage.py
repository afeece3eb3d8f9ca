"""Same or near-same records across splits: content-defined chunks joined by digest, then an exact word distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import broadcast_if_small, ship, spool

#: A pair qualifies with one word edit in so many words of the longer list, and from so many words in each on.
EDIT_SHARE, LEAST = 8, 6
TRAIN, EVAL = 1, 2
#: Words of a chunk; also the words in a row that a train record must have too for them to count as overlap.
SHARED = 3
#: Chunks that a task counts at once, those it names frequent, and how many of the most frequent all tasks are told of.
#: What is called frequent sets the order in which chunks are chosen, never whether a pair is found.
COUNTED, OFTEN, HOT = 1 << 20, 4, 1 << 17


def most_edits(n: int) -> int:
    """Word edits that a list of n words and a partner of any length may be apart: one in EDIT_SHARE words of the longer,
    which is no longer than n * EDIT_SHARE / (EDIT_SHARE - 1)."""
    return n // (EDIT_SHARE - 1)


def prefix(n: int) -> int:
    """Chunks, the rarest first, of which any two lists within the allowed edits have one in common at matching places.

    An edit changes at most SHARED of a list's chunks, so with d edits all but SHARED * d stand in both lists, at places
    that the edits explain. Of those the first by the common order has at most SHARED * d others before it in either
    list, and so is among the first SHARED * d + 1 of both.
    """
    return SHARED * most_edits(n) + 1


def chunk_hashes(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rolling hash over every SHARED words of many lists laid end to end: (list number, place in it, digest)."""
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    n = max(0, len(words) - SHARED + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHARED):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
            h ^= h >> np.uint64(29)
    at = np.arange(n)
    inside = at + SHARED <= ends[row[:n]] if n else np.empty(0, bool)
    row, at = row[:n][inside], at[inside]
    return row, at - (ends - lengths)[row], h[inside]


def chosen(row: np.ndarray, digest: np.ndarray, lengths: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which chunks of the lists are cut out: those of which less than prefix() others of the list come before them by the
    common order, which goes by the digest for all but the frequent ones; these, the ascending digests `hot[0]` with their
    ranks `hot[1]`, come last, the most frequent at the end."""
    order = digest >> np.uint64(1)
    if len(hot[0]):
        k = np.minimum(np.searchsorted(hot[0], digest), len(hot[0]) - 1)
        order = np.where(hot[0][k] == digest, np.uint64(1 << 63) + hot[1][k], order)
    by = np.lexsort((order, row))
    r, o = row[by], order[by]
    first = np.ones(len(by), bool)  # of its list; of its equals
    first[1:] = r[1:] != r[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    first[1:] |= o[1:] != o[:-1]
    before = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0)) - start
    limit = SHARED * (lengths // (EDIT_SHARE - 1)) + 1
    out = np.zeros(len(by), bool)
    out[by] = before < limit[r]
    return out


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the lengths of its lists; null lists are empty."""
    return col.flatten(), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Words(dict):
    """64-bit hashes of normalised words by the word as it stands; 0 for words that are dropped."""

    def __missing__(self, word: str) -> int:
        s = unicodedata.normalize("NFKD", word).casefold()
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip()
        h = (xxhash.xxh3_64_intdigest(s) or 1) if s else 0
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            b = batch.slice(at, 8192)
            tokens, lengths = _lists(b.column(2))
            coded = tokens.dictionary_encode()
            hashes = np.array([0, *[0 if w is None else known[w] for w in coded.dictionary.to_pylist()]], np.uint64)
            words = hashes[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False) + 1]
            row = np.repeat(np.arange(b.num_rows), lengths)[words != 0]
            words = words[words != 0]
            n = np.bincount(row, minlength=b.num_rows)
            words = words[n[row] >= LEAST]
            take = np.flatnonzero(n >= LEAST)
            offsets = np.concatenate([[0], np.cumsum(n[take])]).astype(np.int32)
            raw = words.tobytes()
            digests = [xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(digests, pa.binary()), lists], ["rec", "role", "class", "words"])


def role_of(split_name: Column) -> Column:
    """TRAIN or EVAL from the spellings of a split; null for others."""
    name = F.lower(F.regexp_replace(split_name, r"^\s+|\s+$", ""))
    return F.when(name == "train", TRAIN).when(name.isin("dev", "valid", "validation", "test"), EVAL)


def normalised_records(records: DataFrame, files: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """Rows (rec, role, class, words): records of files with a split and of LEAST words or more, normalised.

    Words are compared after NFKD, case folding and removal of combining marks and outer blanks; words then null or
    empty are dropped. `words` are 64-bit hashes of them, `class` a 128-bit digest of the list.
    """
    ship(records.sparkSession)
    roles = files.select("file_id", role_of(F.col("split_name")).cast("int").alias("role")).where("role is not null").distinct()
    own = records.where(F.col(id_col).isNotNull()).select("file_id", F.col(id_col).alias("rec"), F.col(tokens_col).alias("tokens"))
    source = own.join(broadcast_if_small(roles, roles.count()), "file_id").select("rec", "role", "tokens")
    id_type = source.schema["rec"].dataType.simpleString()
    return source.mapInArrow(_normalised, f"rec {id_type}, role int, class binary, words array<long>")


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests that come up OFTEN or more in COUNTED chunks, with their counts."""
    held, total = [], 0

    def out() -> pa.RecordBatch:
        digest, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(digest[often].view(np.int64)), pa.array(n[often])], ["digest", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            words, lengths = _lists(batch.column(0).slice(at, 8192))
            held.append(chunk_hashes(words.to_numpy().view(np.uint64), lengths)[2])
            total += len(held[-1])
            if total >= COUNTED:
                yield out()
                held, total = [], 0
    if total:
        yield out()


def frequent_chunks(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The HOT most frequent chunks at most, as ascending digests and their ranks by count."""
    counted = classes.select("words").mapInArrow(_frequent, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in counted.orderBy(F.desc("n"), "digest").limit(HOT).select("n", "digest").collect())
    digest = np.array([d for _, d in rows], np.int64).view(np.uint64)
    by = np.argsort(digest)
    return digest[by], by.astype(np.uint64)


def _cutter(hot):
    """Worker: (key, roles, words) to the chosen chunks, each once for a list; a chunk that a list repeats has no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                b = batch.slice(start, 8192)
                words, lengths = _lists(b.column(2))
                row, at, digest = chunk_hashes(words.to_numpy().view(np.uint64), lengths)
                keep = chosen(row, digest, lengths, hot.value)
                row, at, digest = row[keep], at[keep], digest[keep]
                by = np.lexsort((digest, row))
                row, at, digest = row[by], at[by], digest[by]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
                once = new & np.append(new[1:], True)
                place = np.where(once, at, -1)[new].astype(np.int32)
                own = pa.array(row[new])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(own), b.column(1).take(own), pa.array(digest[new].view(np.int64)), pa.array(place), pa.array(lengths[row[new]].astype(np.int32))], ["key", "roles", "digest", "at", "n"]
                )

    return run


def word_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance of two lists, bit-parallel over the first; anything above `most` may come out as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    peq: dict[int, int] = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | 1 << i
    m = len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, y in enumerate(b):
        eq = peq.get(y, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(d0 | up))
        left = up & d0
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return most + 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up = left | (full & ~(d0 | right))
        down = right & d0
    return score


def shared_words(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of lists (words laid end to end, lengths): how many chunks of the first list the second has too, and how many
    words of the first lie in those, the lengths of overlapping chunks being summed without counting a word twice."""
    (ra, at, ha), (rb, _, hb) = chunk_hashes(*a), chunk_hashes(*b)
    mix = lambda row, h: h ^ ((row + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    with np.errstate(over="ignore"):
        met = np.isin(mix(ra, ha), mix(rb, hb))
    rows = len(a[1])
    chunks = np.bincount(ra[met], minlength=rows)
    start = np.cumsum(a[1]) - a[1]
    covered = np.zeros(len(a[0]) + SHARED, bool)
    for k in range(SHARED):
        covered[start[ra[met]] + at[met] + k] = True
    return chunks, np.add.reduceat(np.append(covered[: len(a[0])], False), start).astype(np.int64) * (a[1] > 0) if rows else chunks


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the allowed edits: by their shared chunks first, of which d edits leave all but SHARED * d of the longer
    list's, then by the distance itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            b = batch.slice(start, 4096)
            (x, nx), (y, ny) = ((v.to_numpy().view(np.uint64), n) for v, n in map(_lists, (b.column(2), b.column(3))))
            longer = np.maximum(nx, ny)
            most = longer // EDIT_SHARE
            of_x, of_y = shared_words((x, nx), (y, ny))[0], shared_words((y, ny), (x, nx))[0]
            common = np.where(nx >= ny, of_x, of_y)
            likely = (most > 0) & (common >= longer - SHARED + 1 - SHARED * most)
            keep = np.zeros(b.num_rows, bool)
            at_x, at_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny
            for i in np.flatnonzero(likely):
                one, other = x[at_x[i] : at_x[i] + nx[i]].tolist(), y[at_y[i] : at_y[i] + ny[i]].tolist()
                keep[i] = word_distance(one, other, int(most[i])) <= most[i]
            yield b.select([0, 1]).filter(pa.array(keep))


def _classes(records: DataFrame) -> DataFrame:
    """One row for each distinct word list; `key` is a short name of the class, which two classes may share by chance."""
    return records.groupBy("class").agg(F.bit_or("role").alias("roles"), F.first("words").alias("words")).withColumn("key", F.xxhash64("class"))


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Rows (t, e), each once: keys of classes of train and of evaluation records that share a chosen chunk at places and
    with lengths that the allowed edits can explain."""
    hot = classes.sparkSession.sparkContext.broadcast(frequent_chunks(classes))
    chunks = spool(classes.select("key", "roles", "words").mapInArrow(_cutter(hot), "key long, roles int, digest long, at int, n int"), "chunks")
    side = lambda role, x: chunks.where(F.col("roles").bitwiseAND(role) != 0).select("digest", F.col("key").alias(x), F.col("at").alias(f"at_{x}"), F.col("n").alias(f"n_{x}"))
    most = F.floor(F.greatest("n_t", "n_e") / EDIT_SHARE)
    longer, later = F.col("n_t") - F.col("n_e"), F.col("at_t") - F.col("at_e")
    unplaced = (F.col("at_t") < 0) | (F.col("at_e") < 0)
    near = (F.abs(longer) <= most) & (unplaced | (F.abs(later) + F.abs(longer - later) <= most))
    return side(TRAIN, "t").join(side(EVAL, "e"), "digest").where((F.col("t") != F.col("e")) & near).select("t", "e").distinct()


def cross_split_pairs(records: DataFrame, files: DataFrame, id_col: str = "rec_id", tokens_col: str = "tokens") -> DataFrame:
    """Rows (rec_a, rec_b), rec_a < rec_b: one record of a train file and one of an evaluation file (dev, validation,
    test) whose word lists, of six words or more each, are at most one word edit in eight words of the longer apart.

    All such pairs come out: copies by their class, near copies because the chunks chosen leave no pair out (see
    prefix()). Files without a split take no part; a record given twice counts once; null token lists and records
    without id or file give nothing. Equal lists are one class throughout, so a group of copies costs as one record
    until the last join, in which its pairs, being the result, are written out. A phrase that many records have is
    among the last chunks chosen, so records that share nothing else do not meet.
    """
    all_records = spool(normalised_records(records, files, id_col, tokens_col), "records")
    classes = spool(_classes(all_records), "classes")
    pairs = candidate_pairs(classes.where(F.size("words") >= EDIT_SHARE - 1))
    words = lambda x: classes.select(F.col("key").alias(x), F.col("class").alias(f"c_{x}"), F.col("words").alias(f"w_{x}"))
    near = pairs.join(words("t"), "t").join(words("e"), "e").select(F.col("c_t").alias("t"), F.col("c_e").alias("e"), "w_t", "w_e").mapInArrow(_verified, "t binary, e binary")
    members = all_records.select("rec", "role", "class").distinct()
    of = lambda role, x: members.where(F.col("role") == role).select(F.col("class").alias(x), F.col("rec").alias(f"r_{x}"))
    both = classes.where(F.col("roles") == TRAIN + EVAL).select(F.col("class").alias("t"), F.col("class").alias("e"))
    out = near.unionByName(both).join(of(TRAIN, "t"), "t").join(of(EVAL, "e"), "e")
    a, b = F.least("r_t", "r_e"), F.greatest("r_t", "r_e")
    return out.select(a.alias("rec_a"), b.alias("rec_b")).where("rec_a < rec_b").distinct()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 8192):
            b = batch.slice(start, 8192)
            words, lengths = _lists(b.column(1))
            row, at, digest = chunk_hashes(words.to_numpy().view(np.uint64), lengths)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(digest.view(np.int64))], ["class", "at", "digest"])


def overlap_fractions(records: DataFrame, files: DataFrame, id_col: str = "rec_id", tokens_col: str = "tokens") -> DataFrame:
    """Rows (id, n_words, shared_words, overlap): of each evaluation record, the words that lie in a run of SHARED words or
    more which some train record has too, as a share of its words; 1 for a record that stands whole in a train record.
    Records of less than six words and of files without a split have no row.

    Both sides are cut at every chunk of SHARED words, whatever their lengths: any longer shared passage consists of such
    chunks, and none is lost at an edge.
    """
    all_records = spool(normalised_records(records, files, id_col, tokens_col), "records")
    classes = spool(_classes(all_records), "classes")
    of = lambda role: classes.where(F.col("roles").bitwiseAND(role) != 0)
    windows = lambda df: df.select("class", "words").mapInArrow(_windows, "class binary, at int, digest long")
    # what a train record repeats whole needs no windows
    mine = windows(of(EVAL).where(F.col("roles") != TRAIN + EVAL)).join(windows(of(TRAIN)).select("digest").distinct(), "digest", "left_semi")
    words = F.array_distinct(F.flatten(F.transform(F.collect_list("at"), lambda at: F.sequence(at, at + (SHARED - 1)))))
    covered = mine.groupBy("class").agg(F.size(words).cast("long").alias("count"))
    of_class = (
        of(EVAL)
        .select("class", F.size("words").cast("long").alias("n_words"), (F.col("roles") == TRAIN + EVAL).alias("same"))
        .join(covered, "class", "left")
        .select("class", "n_words", F.when(F.col("same"), F.col("n_words")).otherwise(F.coalesce("count", F.lit(0))).alias("shared_words"))
    )
    out = all_records.where(F.col("role") == EVAL).select(F.col("rec").alias(id_col), "class").distinct().join(of_class, "class")
    return out.select(id_col, "n_words", "shared_words", (F.col("shared_words") / F.col("n_words")).alias("overlap")).distinct()


def leakage_report(records: DataFrame, files: DataFrame, id_col: str = "rec_id", tokens_col: str = "tokens") -> DataFrame:
    """Rows (split, corpus_id, n_pairs, n_records): overlaps by split and corpus of the evaluation record."""
    pairs = cross_split_pairs(records, files, id_col, tokens_col)
    one = lambda x, y: pairs.select(F.col(x).alias("id"), F.col(y).alias("other"))
    home = files.select("file_id", "corpus_id", "split_name", role_of(F.col("split_name")).alias("role")).dropDuplicates(["file_id"])
    name = F.lower(F.regexp_replace("split_name", r"^\s+|\s+$", ""))
    home = home.where(F.col("role") == EVAL).select("file_id", "corpus_id", F.when(name == "test", "test").otherwise("validation").alias("split"))
    of = records.select(F.col(id_col).alias("id"), "file_id").distinct().join(broadcast_if_small(home, home.count()), "file_id")
    return one("rec_a", "rec_b").unionByName(one("rec_b", "rec_a")).join(of, "id").groupBy("split", "corpus_id").agg(F.count("*").alias("n_pairs"), F.count_distinct("id").alias("n_records"))
