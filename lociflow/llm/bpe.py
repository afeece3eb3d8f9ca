"""Byte-level BPE by a public vocabulary: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The vocabulary is a rank file (base64 of the bytes, rank), of which the path is a parameter; nothing is trained.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import ship

#: Where the rank file lies by default; on a cluster the driver alone needs it.
RANKS = os.environ.get("LOCIFLOW_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# The published pre-token pattern of the vocabulary and Unicode's White_Space characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A coarser cut, of which every piece is a whole number of pre-tokens: letters, numbers and signs stay together.
PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Bits of an id in the key of a pair; a vocabulary with more entries is refused.
ID_BITS = 20
#: Entries of the per-worker memo; about 150 bytes each.
MEMO = 300_000
#: Rows handed to Python at once by the operators here; texts may be long.
ROWS = 256


def _place(h: int, d: int, n: int) -> int:
    """Slot of hash h under displacement d: one multiply-shift of the two mixed."""
    return ((((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) >> 31) & 0xFFFFFFFF) % n


class PerfectHash:
    """Hash-and-displace over n byte strings: slot() maps them to 0..n-1 without a gap.

    Keys fall into buckets of two on average; a bucket of several keys stores a displacement that sends
    all of them to free slots, a bucket of one stores its slot outright, so the last slots fill without search.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.nb = max(1, n // 2)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            buckets.setdefault(h % self.nb, []).append((h, i))
        self.shift = [0] * self.nb
        self.at = [-1] * n
        taken = bytearray(n)
        order = sorted(buckets.items(), key=lambda x: -len(x[1]))
        free = None
        for b, members in order:
            if len(members) == 1:
                if free is None:
                    free = iter([s for s in range(n) if not taken[s]])
                s = next(free)
                self.shift[b], self.at[s], taken[s] = -s - 1, members[0][1], 1
                continue
            d = 0
            while True:
                slots = {_place(h, d, n) for h, _ in members}
                if len(slots) == len(members) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, i in members:
                s = _place(h, d, n)
                self.at[s], taken[s] = i, 1

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.nb]
        return -d - 1 if d < 0 else _place(h, d, self.n)


class Encoder:
    """Ids of texts by one vocabulary."""

    def __init__(self, keys: list[bytes], hashed: PerfectHash | None = None) -> None:
        if len(keys) > 1 << ID_BITS:
            raise ValueError(f"more than {1 << ID_BITS} entries")
        self.keys = keys
        self.hash = hashed or PerfectHash(keys)
        self._pre = regex.compile(PATTERN)
        self.memo, self.words = _Memo(self.piece_ids), _Memo(self.word_ids)
        ids = dict(zip(keys, range(len(keys))))  # for the two tables below only
        find = ids.get
        self._byte = [ids[bytes([b])] for b in range(256)]
        # every way to put an entry together from two entries: left << ID_BITS | right -> entry, which is also its rank
        self._pairs: dict[int, int] = {}
        for i, k in enumerate(keys):
            for at in range(1, len(k)):
                if (a := find(k[:at])) is not None and (b := find(k[at:])) is not None:
                    self._pairs[a << ID_BITS | b] = i

    def find(self, piece: bytes) -> int:
        """The id of a byte string in the vocabulary, or -1."""
        i = self.hash.at[self.hash.slot(piece)]
        return i if self.keys[i] == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: merge the pair of lowest rank, the leftmost first, until none is left.

        The bytes are a linked list. The heap holds ranks, each with the positions where a pair of that rank
        came up; a position is void where its pair has another rank by now. A rank below the present one,
        which a merge may bring up, goes first.
        """
        get, n, bits = self._pairs.get, len(piece), ID_BITS
        ids = [self._byte[b] for b in piece]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        at: dict[int, list[int]] = {}
        for i, r in enumerate(map(get, [a << bits | b for a, b in zip(ids, ids[1:])])):
            if r is not None:
                if r in at:
                    at[r].append(i)
                else:
                    at[r] = [i]
        heap = list(at)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            todo = sorted(at.pop(r))
            for done, i in enumerate(todo):
                j = right[i]
                if j >= n or (a := ids[i]) < 0 or get(a << bits | ids[j]) != r:
                    continue
                ids[i], ids[j] = r, -1
                right[i] = k = right[j]
                low = r
                if k < n:
                    left[k] = i
                    if (x := get(r << bits | ids[k])) is not None:
                        if x in at:
                            at[x].append(i)
                        else:
                            at[x] = [i]
                            heapq.heappush(heap, x)
                            low = x
                if (h := left[i]) >= 0 and (x := get(ids[h] << bits | r)) is not None:
                    if x in at:
                        at[x].append(h)
                    else:
                        at[x] = [h]
                        heapq.heappush(heap, x)
                        low = min(low, x)
                if low < r:
                    at[r] = todo[done + 1 :]
                    heapq.heappush(heap, r)
                    break
        return [x for x in ids if x >= 0]

    def pretokens(self, piece: str) -> list[str]:
        return self._pre.findall(piece)

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token: by the hash if it is an entry as a whole, else by merging."""
        b = word.encode()
        return (i,) if (i := self.find(b)) >= 0 else tuple(self.merged(b))

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, self._pre.findall(piece))))

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, PIECE.findall(text))), np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.memo.__getitem__, PIECE.findall(text)))) if text else 0


class _Memo(dict):
    """What `of` gives, by its argument; emptied when full, and long keys are not kept."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.of(key)
        if len(key) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[key] = ids
        return ids


def read_ranks(path: str = RANKS) -> list[bytes]:
    """The entries of a rank file in order of rank; ranks are 0..n-1 without a gap."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    keys: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        keys[int(rank)] = base64.b64decode(token)
    if not all(keys):
        raise ValueError(f"{path}: ranks have gaps")
    return keys


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocabulary) -> Encoder:
    """The encoder of a broadcast vocabulary (a fixed 50,257 entries, under 1 MB), built once in each Python worker."""
    if vocabulary.id not in _ENCODERS:
        _ENCODERS[vocabulary.id] = Encoder(*vocabulary.value)
    return _ENCODERS[vocabulary.id]


class Vocabulary:
    """Serialisable handle: travels with the task and builds its encoder once per worker."""

    def __init__(self, spark, path: str) -> None:
        self.id = path
        keys = read_ranks(path)
        self._b = spark.sparkContext.broadcast((keys, PerfectHash(keys)))

    @property
    def value(self) -> tuple[list[bytes], PerfectHash]:
        return self._b.value


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """Rows (id, ids array<int>), one for each row of `df`, by the vocabulary at `path`, without special tokens.

    A null text and an empty text have the empty list. Texts are encoded whole, whatever their length; strings
    that look like special tokens are ordinary text. Other columns are not read. A row given twice comes out twice.
    No shuffle: each partition of the scan is encoded where it is read.
    """
    ship(df.sparkSession)
    vocabulary = Vocabulary(df.sparkSession, path)
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(vocabulary)
        for batch in batches:
            for b in slices(batch):
                found = [enc.ids(t) for t in b.column(1).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """Rows (id, n_tokens int) for each row of `df`; null and empty texts have 0 tokens."""
    ship(df.sparkSession)
    vocabulary = Vocabulary(df.sparkSession, path)
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(vocabulary)
        for batch in batches:
            for b in slices(batch):
                n = [enc.count(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], [id_col, "n_tokens"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens int")
