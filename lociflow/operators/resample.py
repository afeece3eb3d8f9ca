"""Resampling within lines and cells: every replicate of a row is computed where the row lies, only sums are shuffled.

Orders come from integer keys of (seed, replicate, row, place) that any engine can compute, so a null model is the same on
every partitioning. Rows of equal length are handled together as arrays.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import ship

#: Keys are squares and sums modulo this prime.
PRIME = 2_147_483_647
#: Numbers of an array that a worker holds at once.
HELD = 1 << 22


def modulo(x: np.ndarray) -> np.ndarray:
    """x % PRIME of numbers from 0 to 2^62: PRIME is 2^31 - 1, so the bits above are added to those below."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    x[x >= PRIME] -= PRIME
    return x


def keys(seed: int, replicates: np.ndarray, row: np.ndarray, places: int) -> np.ndarray:
    """Keys (rows, replicates, places) to order by; ties go by place."""
    h = modulo(seed * 1_000_003 + replicates[None, :, None] * 8191 + (row % PRIME)[:, None, None] * 131 + np.arange(places)[None, None, :])
    x = modulo(h * h + 12345)
    y = modulo(x * x + h)
    return modulo(y * y + x)


def sql_key(seed: int, r: str, row: str, place: str) -> str:
    """The same as an SQL expression; `row` and `place` are not negative."""
    h = f"(({seed} * 1000003 + {r} * 8191 + ({row} % {PRIME}) * 131 + {place}) % {PRIME})"
    x = f"(({h} * {h} + 12345) % {PRIME})"
    y = f"(({x} * {x} + {h}) % {PRIME})"
    return f"(({y} * {y} + {x}) % {PRIME})"


def orders(k: np.ndarray, fixed_first: bool = False, groups: np.ndarray | None = None) -> np.ndarray:
    """For keys (rows, replicates, places): which place's item comes to each place. `fixed_first` leaves the first where
    it is; `groups` (rows, places) lets items change places within their group only."""
    if fixed_first:
        k = k.copy()
        k[:, :, 0] = -1
    if groups is None:
        return np.argsort(k, axis=2, kind="stable")
    g = groups.astype(np.int64)
    slots = np.argsort(g, axis=1, kind="stable")
    moved = np.argsort(g[:, None, :] * (PRIME + 1) + k, axis=2, kind="stable")
    out = np.empty_like(moved)
    np.put_along_axis(out, np.broadcast_to(slots[:, None, :], moved.shape), moved, axis=2)
    return out


def add_replicates(total: np.ndarray, rows: list[tuple[int, list]], replicates: int, measure: Callable, seed: int, held: int = HELD) -> None:
    """Adds what `measure` gives for rows (number, list) to total (names, 1 + replicates), lists of one length together."""
    by_length: dict[int, list[tuple[int, list]]] = {}
    for number, items in rows:
        by_length.setdefault(len(items), []).append((number, items))
    for n, group in by_length.items():
        step = max(1, held // max(1, n * n + n * min(replicates, 512)))
        for at in range(0, len(group), step):
            part = group[at : at + step]
            order, sums = measure([items for _, items in part])
            row = np.array([number for number, _ in part], np.int64)
            total[:, 0] += sums(np.broadcast_to(np.arange(n), (len(part), 1, n)))[:, 0]
            width = max(1, held // max(1, n * len(part)))
            for r in range(0, replicates, width):
                rs = np.arange(r, min(replicates, r + width))
                total[:, 1 + rs] += sums(order(keys(seed, rs, row, n)))


def replicate_sums(rows: DataFrame, replicates: int, names: list[str], measure: Callable, seed: int) -> DataFrame:
    """Rows (r, *names): sums over all rows of what `measure` gives for the recorded order (r = -1) and each replicate.

    `rows` has a 64-bit number, by which the keys differ, and a list. measure(lists) takes lists of one length n and
    returns (order, sums): order(keys) gives the places (rows, replicates, n), sums(order) the values, an array
    (len(names), replicates). A worker leaves one row for each replicate; lists of any length are taken whole.
    """
    ship(rows.sparkSession)
    schema = "r long, " + ", ".join(f"`{n}` double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), replicates + 1))
        some = False
        for batch in batches:
            held = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            some = some or bool(held)
            add_replicates(total, held, replicates, measure, seed)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, replicates)), *[pa.array(t) for t in total]], ["r", *names])

    parts = rows.mapInArrow(run, schema)
    return parts.groupBy("r").agg(*[F.sum(n).alias(n) for n in names])


def _gather(matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """matrix (rows, n, n) at (a, b), both (rows, replicates, m)."""
    n = matrix.shape[1]
    flat = np.take_along_axis(matrix.reshape(len(matrix), n * n), (a * n + b).reshape(len(a), -1), axis=1)
    return flat.reshape(a.shape)


def within_one(a: str, b: str) -> bool:
    """Whether two words are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def word_order(lines: list[list[str]]) -> tuple[Callable, Callable]:
    """Statistics of the order of words in lines: pairs, equal and near neighbours, lines that open with a tall sign, and
    the length of the first word less the mean of the others."""
    n = len(lines[0])
    near, equal = np.zeros((len(lines), n, n)), np.zeros((len(lines), n, n))
    for k, words in enumerate(lines):
        for i in range(n):
            for j in range(i):
                equal[k, i, j] = equal[k, j, i] = words[i] == words[j]
                near[k, i, j] = near[k, j, i] = within_one(words[i], words[j])
    tall = np.array([[w[0] in "tkpf" for w in words] for words in lines], float)
    length = np.array([[len(w) for w in words] for words in lines], float)
    rest = length.sum(axis=1)

    def sums(p: np.ndarray) -> np.ndarray:
        a, b = p[:, :, :-1], p[:, :, 1:]
        first = np.take_along_axis(length, p[:, :, 0], axis=1)
        diff = first - (rest[:, None] - first) / (n - 1)
        pairs = np.full(p.shape[1], float(len(lines) * (n - 1)))
        return np.stack([pairs, _gather(equal, a, b).sum(axis=(0, 2)), _gather(near, a, b).sum(axis=(0, 2)), np.take_along_axis(tall, p[:, :, 0], axis=1).sum(axis=0), diff.sum(axis=0)])

    return orders, sums


#: Places of a word in its line, by which boundary models differ.
ROLES = ("second", "interior", "last")


def boundary_gain(table: np.ndarray, same_length: bool = False) -> Callable:
    """Measure of lines of words: gain in bits of each word's first letter given the last one of the word before it, by
    table[role, last, first]; the first word of a line stays, the others change places, among words of equal length if
    `same_length`. Sums: targets, gain, lines that differ from the recorded one."""

    def measure(lines: list[list[str]]) -> tuple[Callable, Callable]:
        n = len(lines[0])
        first = np.array([[ord(w[0]) - 97 for w in words] for words in lines])
        last = np.array([[ord(w[-1]) - 97 for w in words] for words in lines])
        names = np.array([[hash(w) for w in words] for words in lines])
        groups = None
        if same_length:
            groups = np.array([[len(w) for w in words] for words in lines])
            groups[:, 0] = 0  # the first word is a group of its own
        role = np.array([0 if t == 1 else 2 if t == n - 1 else 1 for t in range(1, n)])

        def sums(p: np.ndarray) -> np.ndarray:
            f = np.take_along_axis(last[:, None, :], p[:, :, :-1], axis=2)
            i = np.take_along_axis(first[:, None, :], p[:, :, 1:], axis=2)
            moved = (np.take_along_axis(names[:, None, :], p, axis=2) != names[:, None, :]).any(axis=2).sum(axis=0)
            return np.stack([np.full(p.shape[1], float(len(lines) * (n - 1))), table[role, f, i].sum(axis=(0, 2)), moved.astype(float)])

        return (lambda k: orders(k, True, groups)), sums

    return measure


def cell_gain(table: np.ndarray) -> Callable:
    """Measure of cells, lists of texts role, last and first (`1ed`): the last letters change places within the cell."""

    def measure(cells: list[list[str]]) -> tuple[Callable, Callable]:
        role = np.array([[int(x[0]) for x in c] for c in cells])
        last = np.array([[ord(x[1]) - 97 for x in c] for c in cells])
        first = np.array([[ord(x[2]) - 97 for x in c] for c in cells])

        def sums(p: np.ndarray) -> np.ndarray:
            f = np.take_along_axis(last[:, None, :], p, axis=2)
            return np.stack([np.full(p.shape[1], float(role.size)), table[role[:, None, :], f, first[:, None, :]].sum(axis=(0, 2))])

        return orders, sums

    return measure


def distance(a: str, b: str) -> int:
    """Levenshtein distance of two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def column_excess(above: list[str], words: list[str]) -> tuple[float, int]:
    """Sum over the words of a line of the similarity to the word above less its mean over words as long as that one in
    the line above, and how many words have such a control."""
    ends, total = [], 0
    for w in above:
        total += len(w) + 1
        ends.append(total)
    out, n, column = 0.0, 0, 0
    for t, x in enumerate(words):
        k = next((i for i, e in enumerate(ends) if e >= column), min(len(above) - 1, t))
        column += len(x) + 1
        like = lambda y: 1 - distance(x, y) / max(len(x), len(y))  # noqa: E731, B023
        controls = [like(y) for i, y in enumerate(above) if i != k and len(y) == len(above[k])]
        if controls:
            out += like(above[k]) - sum(controls) / len(controls)
            n += 1
    return out, n


def distances(words: list[str]) -> np.ndarray:
    """Levenshtein distances of all pairs of words of letters a-z, the longest first: a bit for each letter of one word, the
    columns of its table told by the letters of the other, for many pairs at once."""
    size = np.array([len(w) for w in words])
    out = np.zeros((len(words), len(words)), np.min_scalar_type(int(size[0])))
    long = int((size > 64).sum())  # more letters than bits
    for i in range(long):
        for j in range(i):
            out[i, j] = out[j, i] = distance(words[i], words[j])
    bits = np.uint32 if size[min(long, len(words) - 1)] <= 32 else np.uint64
    letters = np.zeros((int(size[0]), len(words)), np.uint8)
    at = np.zeros((26, len(words)), bits)
    for k, w in enumerate(words):
        code = np.frombuffer(w.encode(), np.uint8) - 97
        letters[: len(w), k] = code
        if k >= long:
            np.bitwise_or.at(at[:, k], code, bits(1) << np.arange(len(w)).astype(bits))
    reach = [int((size > p).sum()) for p in range(int(size[0]))]
    step = max(1, (1 << 16) // len(words))
    for low in range(long, len(words), step):
        part = slice(low, min(len(words), low + step))
        n, of = part.stop - low, np.ascontiguousarray(at[:, part])
        top = (size[part] - 1).astype(bits)
        up, down = np.full((len(words), n), ~bits(0)), np.zeros((len(words), n), bits)
        score = np.repeat(size[None, part].astype(np.int32), len(words), axis=0)
        for p, k in enumerate(reach):
            same, pv, mv = of[letters[p, :k]], up[:k], down[:k]
            xv = same | mv
            xh = (((same & pv) + pv) ^ pv) | same
            ph, mh = mv | ~(xh | pv), pv & xh
            score[:k] += ((ph >> top) & bits(1)).astype(np.int32)
            score[:k] -= ((mh >> top) & bits(1)).astype(np.int32)
            ph = (ph << bits(1)) | bits(1)
            up[:k] = (mh << bits(1)) | ~(xv | ph)
            down[:k] = ph & xv
        out[:, part] = score
    out[long:, :long] = out[:long, long:].T
    return out


class Columns:
    """Lines of a page (words joined by blanks) as numbers: for a line above, column_excess() of many lines below it at once."""

    def __init__(self, lines: list[str]) -> None:
        page = [line.split(" ") for line in lines]
        names = sorted({w for words in page for w in words}, key=lambda w: (-len(w), w))
        of = {w: k for k, w in enumerate(names)}
        self.length, self.distance = np.array([len(w) for w in names]), distances(names)
        self.sizes = np.array([len(words) for words in page])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.array([of[w] for words in page for w in words])
        upto = np.cumsum(self.length[self.word] + 1)
        begin = upto - self.length[self.word] - 1
        column, place = begin - np.repeat(begin[self.starts], self.sizes), np.arange(len(self.word)) - np.repeat(self.starts, self.sizes)
        known, self.at = np.unique(column * (int(self.sizes.max()) + 1) + place, return_inverse=True)
        self.column, self.place = np.divmod(known, int(self.sizes.max()) + 1)

    def below(self, i: int, lines: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Excess and targets of `lines`, or of all lines of the page, below line i."""
        own = self.word[self.starts[i] : self.starts[i] + self.sizes[i]]
        length, n = self.length[own], len(own)
        alike = (length[:, None] == length[None, :]) & ~np.eye(n, dtype=bool)
        controls = alike.sum(axis=1)
        some = controls > 0
        weight = np.where(some[:, None], np.eye(n) - alike / np.maximum(controls, 1)[:, None], 0.0)
        gain = (weight @ (1 - self.distance[own] / np.maximum(length[:, None], self.length))).ravel()
        k = np.searchsorted(np.cumsum(length + 1), self.column)
        k = np.where(k < n, k, np.minimum(n - 1, self.place))
        at, word, starts = self.at, self.word, self.starts
        if lines is not None:
            sizes = self.sizes[lines]
            starts = np.cumsum(sizes) - sizes
            each = np.repeat(self.starts[lines] - starts, sizes) + np.arange(int(sizes.sum()))
            at, word = at[each], word[each]
        return np.add.reduceat(gain[(k * len(self.length))[at] + word], starts), np.add.reduceat(some[k].astype(np.int64)[at], starts)


def sorted_places(k: np.ndarray) -> np.ndarray:
    """orders() of keys below 2^31 as places, sorted with the keys in one number."""
    return np.sort((k << 32) | np.arange(k.shape[-1]), axis=-1) & 0xFFFFFFFF


def column_order(pages: list[list[str]]) -> tuple[Callable, Callable]:
    """Measure of pages, lists of lines (words joined by blanks): column_excess() of neighbouring lines. Sums: excess, targets."""
    n = len(pages[0])
    excess, targets = np.zeros((len(pages), n, n)), np.zeros((len(pages), n, n))
    for k, page in enumerate(pages):
        columns = Columns(page)
        for i in range(n):
            excess[k, i], targets[k, i] = columns.below(i)

    def sums(p: np.ndarray) -> np.ndarray:
        a, b = p[:, :, :-1], p[:, :, 1:]
        return np.stack([_gather(excess, a, b).sum(axis=(0, 2)), _gather(targets, a, b).sum(axis=(0, 2))])

    return sorted_places, sums


def long_page(lines: list[str], number: int, replicates: np.ndarray, seed: int) -> np.ndarray:
    """The sums of column_order() for some replicates (-1: as recorded) of one page, without a table of all its pairs of lines:
    line by line, those that follow it in these replicates."""
    n, row = len(lines), np.array([number], np.int64)
    follows = np.full((n, len(replicates)), n, np.min_scalar_type(n))
    width = max(1, (HELD >> 6) // n)
    for at in range(0, len(replicates), width):
        rs = replicates[at : at + width]
        p = sorted_places(keys(seed, rs, row, n)[0])
        p[rs < 0] = np.arange(n)
        follows[p[:, :-1], np.arange(at, at + len(rs))[:, None]] = p[:, 1:]
    columns, out = Columns(lines), np.zeros((2, len(replicates)))
    for i in range(n):
        some = np.flatnonzero(follows[i] < n)
        if not len(some):
            continue
        below = follows[i][some].astype(np.int64)
        if len(below) < n:
            excess, targets = columns.below(i, below)
        else:
            excess, targets = (x[below] for x in columns.below(i))
        out[0, some] += excess
        out[1, some] += targets
    return out


#: Lines of a page up to which its pairs of lines are a table; bytes of what follows what in the replicates of a longer page.
TABLE_LINES, FOLLOWS_BYTES = 1024, 3 << 26


def column_sums(pages: DataFrame, replicates: int, seed: int, table_lines: int = TABLE_LINES, follows_bytes: int = FOLLOWS_BYTES) -> DataFrame:
    """replicate_sums() of column_order(). A long page is cut into ranges of replicates; pages and ranges are spread over the
    cores, for their cost is not in their bytes."""
    ship(pages.sparkSession)
    number, lines = pages.columns
    n = F.size(lines)
    each = F.when(n <= table_lines, replicates + 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(follows_bytes) / (n * F.when(n < 1 << 16, 2).otherwise(4))))).cast("int")
    parts = pages.select(number, lines, each.alias("each")).select(number, lines, F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1), F.col("each"))).alias("low"), "each")
    parts = parts.repartition(4 * pages.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((2, replicates + 1)), False
        for batch in batches:
            short: list[tuple[int, list]] = []
            for page, items, low, width in zip(*(batch.column(k).to_pylist() for k in range(4))):
                some = True
                if len(items) <= table_lines:
                    short.append((page, items))
                else:
                    rs = np.arange(low, min(replicates, low + width))
                    total[:, 1 + rs] += long_page(items, page, rs, seed)
            add_replicates(total, short, replicates, column_order, seed, HELD >> 4)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, replicates)), *[pa.array(t) for t in total]], ["r", "excess", "targets"])

    return parts.mapInArrow(run, "r long, excess double, targets double").groupBy("r").agg(F.sum("excess").alias("excess"), F.sum("targets").alias("targets"))


def rotation_scores(predicted: list[bool], observed: list[bool | None]) -> list[int]:
    """For each rotation of a cyclic prediction: at how many known positions it agrees with what was observed."""
    n = len(predicted)
    p = np.array(predicted, float)
    known = np.array([x is not None for x in observed], float)
    seen = np.array([bool(x) for x in observed], float) * known
    turn = lambda a, b: np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), n)
    agree = turn(p, seen) + turn(1 - p, known - seen)
    return [int(round(x)) for x in agree]


def rotations(panels: DataFrame) -> DataFrame:
    """Rows (study, panels, observed, mean, p_upper) for panels (study, panel, predicted, observed), two lists: the exact
    distribution of the summed agreement when each panel is rotated by itself, every rotation being equally likely.

    Each panel leaves the histogram of its scores, by correlation, not by enumeration; the histograms of a study are
    convolved. p_upper is the share of the combinations that agree at least as often as the recorded one.
    """

    ship(panels.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            studies, observed, low, shares = b.column(0), [], [], []
            for p, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = rotation_scores(p, o)
                observed.append(s[0])
                low.append(min(s))
                shares.append((np.bincount(np.array(s) - min(s)) / len(s)).tolist())
            yield pa.RecordBatch.from_arrays([studies, pa.array(observed, pa.int64()), pa.array(low, pa.int64()), pa.array(shares, pa.list_(pa.float64()))], ["study", "observed", "low", "shares"])

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole, low = np.ones(1), int(pdf["low"].sum())
        for s in sorted(pdf["shares"].tolist(), key=len):
            whole = np.convolve(whole, s)
        seen = int(pdf["observed"].sum())
        mean = low + float((whole * np.arange(len(whole))).sum())
        return pd.DataFrame([(key[0], len(pdf), seen, mean, float(whole[seen - low :].sum()))], columns=["study", "panels", "observed", "mean", "p_upper"])

    kind = panels.schema["study"].dataType.simpleString()
    scored = panels.select("study", "predicted", "observed").mapInArrow(score, f"study {kind}, observed long, low long, shares array<double>")
    return scored.groupBy("study").applyInPandas(fold, f"study {kind}, panels long, observed long, mean double, p_upper double")


def arrangement_log(moved: Counter, fixed: Counter, chance: Callable[[str, str], float]) -> float:
    """log2 of the sum, over all distinct arrangements of `moved` letters on `fixed` ones, of the product of their chances.

    The states are how many of each letter are used, the most frequent one left out, since the number of steps tells it:
    an array with a side for each letter, which a step moves along each side by one. Every state is kept.
    """
    most = max(moved, key=lambda x: (moved[x], x))
    rest = sorted(set(moved) - {most})
    shape = [moved[x] + 1 for x in rest]
    size = math.prod(shape)
    old, new, scale = np.zeros(size), np.empty(size), 0.0
    old[0] = 1.0
    for y, times in sorted(fixed.items()):
        for _ in range(times):
            np.multiply(old, chance(most, y), out=new)
            post = size
            for x, sides in zip(rest, shape):
                post //= sides
                new.reshape(-1, sides, post)[:, 1:] += chance(x, y) * old.reshape(-1, sides, post)[:, :-1]
            top = new.max()
            new /= top
            scale += math.log2(top)
            old, new = new, old
    return scale + math.log2(old[-1])


def cell_log_ratio(last: list[str], first: list[str], chance: Callable[[str, str], float], limit: int | None = None) -> float | None:
    """log2 of how likely the recorded arrangement of `last` on the fixed `first` is under `chance`, against all distinct
    arrangements being alike. The mean over arrangements is the same whichever side moves, so the side of fewer states
    does. All states are summed, however many; a caller that wants null beyond a number of them sets `limit`."""
    left, right = Counter(last), Counter(first)
    states = lambda c: math.prod(n + 1 for n in c.values()) // (max(c.values()) + 1)
    if limit is not None and min(states(left), states(right)) > limit:
        return None
    moved, fixed, way = (left, right, chance) if states(left) <= states(right) else (right, left, lambda x, y: chance(y, x))
    arrangements = math.factorial(len(last)) // math.prod(math.factorial(n) for n in moved.values())
    return math.fsum(math.log2(chance(x, y)) for x, y in zip(last, first)) - arrangement_log(moved, fixed, way) + math.log2(arrangements)


def memory_loss(width: int, lam: float, same_length: bool = False) -> Callable:
    """Measure of lines, each word as `word <tab> known <tab> p0 <tab> norm <tab>`: bits of the words after the first under
    the edit kernel of the `width` words before, mixed with p0 by `lam`. Sums: targets, bits, lines that changed."""

    def measure(lines: list[list[str]]) -> tuple[Callable, Callable]:
        n = len(lines[0])
        parts = [[x.split("\t") for x in line] for line in lines]
        p0 = np.array([[float(x[2]) for x in line] for line in parts])
        kernel = np.empty((len(lines), n, n))  # of context i for target j
        for k, line in enumerate(parts):
            for i, c in enumerate(line):
                for j, t in enumerate(line):
                    if not c[3]:
                        kernel[k, i, j] = p0[k, j]
                    else:
                        near = t[1] == "1" and t[0] != c[0] and within_one(t[0], c[0])
                        kernel[k, i, j] = p0[k, j] / float(c[3]) if near else 0.0
        names = np.array([[hash(x[0]) for x in line] for line in parts])
        groups = None
        if same_length:
            groups = np.array([[len(x[0]) for x in line] for line in parts])
            groups[:, 0] = 0

        def sums(p: np.ndarray) -> np.ndarray:
            bits = np.zeros(p.shape[1])
            for t in range(1, n):
                low = max(0, t - width)
                mean = sum(_gather(kernel, p[:, :, i : i + 1], p[:, :, t : t + 1])[:, :, 0] for i in range(low, t)) / (t - low)
                own = np.take_along_axis(p0, p[:, :, t], axis=1)
                bits -= np.log2((1 - lam) * own + lam * mean).sum(axis=0)
            moved = (np.take_along_axis(names[:, None, :], p, axis=2) != names[:, None, :]).any(axis=2).sum(axis=0)
            return np.stack([np.full(p.shape[1], float(len(lines) * (n - 1))), bits, moved.astype(float)])

        return (lambda k: orders(k, True, groups)), sums

    return measure
