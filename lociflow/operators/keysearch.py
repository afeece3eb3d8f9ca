"""Key search by likelihood: annealing over events of four symbols under a table of costs, one restart for each row.

A stream's windows, or the symbols of words with their three predecessors, are events with counts; a key turns units into
letters, and the cost of a key is the sum of counts times table costs. So the size of a problem is that of its distinct
events, which the alphabets bound, not that of the corpus.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.runtime import ship

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Letters of the tables: the alphabet, the beginning of a word and its end.
BOS, EOS, SYMBOLS = 26, 27, 28
#: Restarts and proposals of a search, and its first temperature as a share of the events.
RESTARTS, PROPOSALS, HEAT = 8, 2000, 0.02
#: Distinct events that one problem may have.
MOST_EVENTS = 2_000_000


def letter_number(c: str) -> int:
    return BOS if c == "^" else EOS if c == "$" else ord(c) - 97 if len(c) == 1 and "a" <= c <= "z" else -1


def order_costs(counts: np.ndarray, order: int = 3, alpha: float = 0.1) -> np.ndarray:
    """cost[h3, h2, h1, s] in bits of add-alpha estimates from counts of the same shape, by the last `order` symbols; every
    context gives each letter and the end a chance, and one more stands for the unknown."""
    c = counts.sum(axis=tuple(range(3 - order)), keepdims=True) if order < 3 else counts
    total = c.sum(axis=3, keepdims=True)
    return np.broadcast_to(-np.log2((c + alpha) / (total + alpha * SYMBOLS)), counts.shape)


def window_costs(counts: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """cost[a, b, c, d] in bits of windows of four letters: contexts of none to three letters weigh .1, .2, .3 and .4."""
    c = counts[:26, :26, :26, :26].astype(float)
    p = np.zeros_like(c)
    for k, weight in enumerate((0.1, 0.2, 0.3, 0.4)):
        x = c.sum(axis=tuple(range(3 - k)), keepdims=True) if k < 3 else c
        p = p + weight * (x + alpha) / (x.sum(axis=3, keepdims=True) + 26 * alpha)
    out = np.zeros((SYMBOLS,) * 4)
    out[:26, :26, :26, :26] = -np.log2(p)
    return out


class Problem:
    """Events (rows of four unit numbers; BOS and EOS stand for themselves behind the units), their counts, and a table."""

    def __init__(self, units: list[str], events: np.ndarray, counts: np.ndarray, table: np.ndarray, capacity: int = 1) -> None:
        if len(events) > MOST_EVENTS:
            raise ValueError(f"{len(events)} events are more than one search takes")
        if len(units) > capacity * 26:
            raise ValueError("more units than the letters have room for")
        self.units, self.events, self.counts, self.table, self.capacity = units, events, counts.astype(float), table, capacity
        n = len(units)
        self.of_unit = [np.flatnonzero((events == u).any(axis=1)) for u in range(n)]
        weight = np.zeros(n + 2)
        np.add.at(weight, events[:, 3], counts)
        self.by_count = sorted(range(n), key=lambda u: (-weight[u], units[u]))

    def full(self, key: np.ndarray) -> np.ndarray:
        return np.concatenate([key, [BOS, EOS]])

    def cost(self, key: np.ndarray, rows: np.ndarray | slice = slice(None)) -> float:
        e = self.full(key)[self.events[rows]]
        return float((self.counts[rows] * self.table[e[:, 0], e[:, 1], e[:, 2], e[:, 3]]).sum())

    def frequency_start(self, letters: list[int]) -> np.ndarray:
        """Units by frequency on `letters` by frequency, each letter as often as the capacity allows."""
        key = np.empty(len(self.units), np.int64)
        for k, u in enumerate(self.by_count):
            key[u] = letters[k // self.capacity]
        return key

    def random_start(self, rng: random.Random) -> np.ndarray:
        pool = [v for v in range(26) for _ in range(self.capacity)]
        rng.shuffle(pool)
        return np.array(pool[: len(self.units)], np.int64)

    def swap_letters(self, key: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The key after letters a and b change places, and the events that this touches."""
        new = key.copy()
        new[key == a], new[key == b] = b, a
        changed = np.flatnonzero(new != key)
        rows = np.unique(np.concatenate([self.of_unit[u] for u in changed])) if len(changed) else np.empty(0, np.int64)
        return new, rows


def search(problem: Problem, start: np.ndarray, proposals: int, rng: random.Random, reassign: float) -> tuple[float, np.ndarray]:
    """(cost, key): the best key of a walk with linear cooling. With the chance `reassign` a unit takes a letter that has
    room, else two units change their letters; ties go to the smaller key. The cost is kept by differences and
    must agree with a recount at the end."""
    key, n = start.copy(), len(problem.units)
    cost = problem.cost(key)
    best, kept = cost, key.copy()
    heat = HEAT * problem.counts.sum()
    room = np.full(26, problem.capacity) - np.bincount(key, minlength=26)
    for step in range(proposals if n > 1 else 0):
        u = rng.randrange(n)
        free = np.flatnonzero(room > 0) if rng.random() < reassign else ()
        new = key.copy()
        if len(free):
            new[u] = free[rng.randrange(len(free))]
            rows = problem.of_unit[u]
        else:
            w = rng.randrange(n)
            if key[u] == key[w]:
                continue
            new[u], new[w] = key[w], key[u]
            rows = np.union1d(problem.of_unit[u], problem.of_unit[w])
        change = problem.cost(new, rows) - problem.cost(key, rows)
        t = heat * (1 - step / proposals)
        if change <= 0 or (t > 0 and rng.random() < math.exp(-change / t)):
            room += np.bincount(key, minlength=26) - np.bincount(new, minlength=26)
            key, cost = new, cost + change
            if cost < best - 1e-9 or (abs(cost - best) <= 1e-9 and key.tolist() < kept.tolist()):
                best, kept = cost, key.copy()
    again = problem.cost(kept)
    if abs(again - best) > 1e-8 * max(1.0, abs(again)):
        raise AssertionError(f"the kept cost {best} drifted from {again}")
    return again, kept


def table_of(counts: DataFrame, columns: list[str], window: bool, order: int = 3) -> np.ndarray:
    """A cost table from rows of four symbols and a count n; there are at most 28^4 of them."""
    out = np.zeros((SYMBOLS,) * 4)
    for r in counts.select(*columns, "n").collect():
        at = tuple(letter_number(c) for c in r[:4])
        if min(at) >= 0:
            out[at] += r[4]
    return window_costs(out) if window else order_costs(out, order)


def problem_of(events: DataFrame, columns: list[str], table: np.ndarray, capacity: int = 1, known: str | None = None) -> tuple[Problem, int]:
    """A problem from rows of four units and a count n, and how many events hold a unit that is not `known` (all are, if it
    is null); these take no part in the search. The distinct events are counted before they are gathered."""
    if events.count() > MOST_EVENTS:
        raise ValueError("more events than one search takes")
    rows = events.select(*columns, "n").collect()
    unknown, kept, n = 0, [], []
    for r in rows:
        if known is not None and any(u not in known for u in r[:4]):
            unknown += r[4]
        else:
            kept.append(r[:4])
            n.append(r[4])
    units = sorted({u for r in kept for u in r} - {"^", "$"})
    number = {u: k for k, u in enumerate(units)} | {"^": len(units), "$": len(units) + 1}
    made = np.array([[number[u] for u in r] for r in kept], np.int64).reshape(-1, 4)
    return Problem(units, made, np.array(n, np.int64), table, capacity), unknown


class _Shared:
    def __init__(self, spark: SparkSession, value: object) -> None:
        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


def restarts(spark: SparkSession, problem: Problem, letters: list[int], n: int = RESTARTS, proposals: int = PROPOSALS, seed: int = 408, reassign: float = 0.25) -> DataFrame:
    """Rows (restart, cost, events, bits, key) of `n` searches, each a task: the first from frequencies, others at random."""
    shared = _Shared(spark, (problem, letters))
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, order = shared.value
        for f in frames:
            rows = []
            for k in f["id"]:
                rng = random.Random(f"{seed}:{k}")
                start = p.random_start(rng) if k else p.frequency_start(order)
                cost, key = search(p, start, proposals, rng, reassign)
                total = int(p.counts.sum())
                rows.append((k, cost, total, cost / max(1, total), " ".join(f"{u}={ALPHABET[v]}" for u, v in zip(p.units, key))))
            yield pd.DataFrame(rows, columns=["restart", "cost", "events", "bits", "key"])

    return spark.range(0, n, 1, n).mapInPandas(run, "restart long, cost double, events long, bits double, `key` string")


def planted(spark: SparkSession, problem: Problem, letters: list[int], seeds: list[int], n: int = RESTARTS, proposals: int = PROPOSALS) -> DataFrame:
    """Rows (seed, restart, bits, known_bits, correct_units, correct_events): for each seed a key is planted, the problem is
    written in cipher by it, and every restart looks for it. What is found can be held against what is known."""
    shared = _Shared(spark, (problem, letters))
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, order = shared.value
        for f in frames:
            rows = []
            for seed, k in zip(f["seed"], f["restart"]):
                hidden = list(range(len(p.units)))
                random.Random(f"plant:{seed}").shuffle(hidden)
                # unit u of the plain problem is written as cipher unit hidden[u]
                at = np.array([*hidden, len(p.units), len(p.units) + 1])
                cipher = Problem([f"c{i:02d}" for i in range(len(p.units))], at[p.events], p.counts, p.table, p.capacity)
                truth = np.empty(len(p.units), np.int64)
                truth[hidden] = [letter_number(u) for u in p.units]
                rng = random.Random(f"{seed}:{k}")
                cost, key = search(cipher, cipher.random_start(rng) if k else cipher.frequency_start(order), proposals, rng, 0.25)
                good = key == truth
                weight = np.zeros(len(p.units) + 2)
                np.add.at(weight, cipher.events[:, 3], cipher.counts)
                total = float(p.counts.sum())
                rows.append((seed, k, cost / total, cipher.cost(truth) / total, int(good.sum()), float(weight[: len(good)][good].sum() / max(1.0, weight[: len(good)].sum()))))
            yield pd.DataFrame(rows, columns=["seed", "restart", "bits", "known_bits", "correct_units", "correct_events"])

    jobs = spark.createDataFrame([(s, k) for s in seeds for k in range(n)], "seed long, restart long").repartition(min(len(seeds) * n, 4 * spark.sparkContext.defaultParallelism))
    return jobs.mapInPandas(run, "seed long, restart long, bits double, known_bits double, correct_units long, correct_events double")


def rescored(found: DataFrame, events: DataFrame, columns: list[str], costs: DataFrame) -> DataFrame:
    """Rows (restart, rescored): the bits of each key, by joins of the events, the key and the cost rows (a, b, c, d, cost)
    instead of the worker's arrays. `costs` has a row for every event that a key can make."""
    key = found.select("restart", F.explode(F.str_to_map("key", F.lit(" "), F.lit("="))).alias("u", "x"))
    ends = found.select("restart").crossJoin(found.sparkSession.createDataFrame([("^", "^"), ("$", "$")], "u string, x string"))
    key = F.broadcast(key.unionByName(ends))  # a row for each restart and unit
    out = events
    for k, c in enumerate(columns):
        side = key.select("restart", F.col("u").alias(c), F.col("x").alias(f"x{k}"))
        out = out.join(side, [c] if not k else ["restart", c])
    cost = costs.toDF("x0", "x1", "x2", "x3", "cost")
    out = out.join(cost, ["x0", "x1", "x2", "x3"])
    return out.groupBy("restart").agg((F.sum(F.col("n") * F.col("cost")) / F.sum("n")).alias("rescored"))


def cost_rows(spark: SparkSession, table: np.ndarray) -> DataFrame:
    """A cost table as rows (a, b, c, d, cost)."""
    names = [*ALPHABET, "^", "$"]
    at = np.indices(table.shape).reshape(4, -1)
    pdf = pd.DataFrame({k: [names[i] for i in at[j]] for j, k in enumerate("abcd")})
    pdf["cost"] = np.ascontiguousarray(table).ravel()
    return spark.createDataFrame(pdf)
