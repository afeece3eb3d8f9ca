"""Matchings of compatibility graphs, forced edges and the quotient they prove; exact integer lattices."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators.views import VISUAL
from lociflow.runtime import ship, spool


def perfect_matchings(edges: list[tuple[str, str]], budget: int = 100_000, most: int = 2, units: set[str] = frozenset()) -> tuple[str, list[list[tuple[str, str]]], int]:
    """(status, up to `most` matchings, nodes): depth-first on the vertex with the fewest partners left; `units` are
    vertices that need a partner though they may have no edge.

    status: unique, multiple, none, unknown_budget or empty_scope.
    """
    near: dict[str, set[str]] = {u: set() for u in units}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    if not near:
        return "empty_scope", [], 0
    found: list[list[tuple[str, str]]] = []
    stack: list[tuple[frozenset, tuple]] = [(frozenset(near), ())]
    nodes = 0
    while stack and len(found) < most:
        if nodes >= budget:
            return "unknown_budget", found, nodes
        left, picked = stack.pop()
        nodes += 1
        if not left:
            found.append(sorted(picked))
            continue
        pivot = min(left, key=lambda v: (len(near[v] & left), v))
        for other in sorted(near[pivot] & left, reverse=True):
            stack.append((left - {pivot, other}, (*picked, (min(pivot, other), max(pivot, other)))))
    return ("none", "unique", "multiple")[min(len(found), 2)], found, nodes


def forced_edges(edges: list[tuple[str, str]], budget: int = 100_000, queries: int = 32) -> Iterator[tuple[str, str, str]]:
    """For each edge of a first matching (a, b, verdict): forced if no matching does without it, else free or unknown."""
    status, found, _ = perfect_matchings(edges, budget, 1)
    for a, b in found[0][:queries] if found else []:
        s, other, _ = perfect_matchings([e for e in edges if set(e) != {a, b}], budget, 1, {a, b})
        yield a, b, "unknown" if s == "unknown_budget" else "free" if other else "forced"


def quotient(edges: list[tuple[str, str]], budget: int = 100_000) -> list[tuple[str, str]]:
    """Rows (unit, class): units whose edge is in every matching share a class, named by the smaller; others stay alone."""
    units = sorted({u for e in edges for u in e})
    of = {u: u for u in units}
    for a, b, verdict in forced_edges(edges, budget, len(units)):
        if verdict == "forced":
            of[a] = of[b] = min(a, b)
    return sorted(of.items())


#: The visual units, single letters and compounds; fixed values.
UNITS = [*"abcdefghijklmnopqrstuvwxyz", "cth", "ckh", "cph", "cfh", "ch", "sh"]


def unit_turns(df: DataFrame, part_col: str, words_col: str) -> DataFrame:
    """Rows (a, b, parts, turns, a_first, b_first) for pairs of units a < b: in how many parts either stands, in how many
    they take turns with counts that differ by one at most, and which of the two comes first.

    The rows of a part must lie together and in order; a part's state is a few numbers for each unit and pair, however
    many rows it has, and a task leaves a row for each pair. A unit that occurs nowhere has no pair.
    """
    ship(df.sparkSession)
    number, cut, n = {u: k for k, u in enumerate(UNITS)}, re.compile(VISUAL), len(UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, n, n), np.int64)
        memo: dict[str, list[int]] = {}
        part, at, open_ = None, 0, False

        def close() -> None:
            nonlocal open_
            if open_:
                seen = count > 0
                either = seen[:, None] | seen[None, :]
                total[0] += either
                total[1] += either & ~(twice | twice.T) & (np.abs(count[:, None] - count[None, :]) <= 1)
                total[2] += either & (first[:, None] < first[None, :])
                total[3] += either & (first[:, None] > first[None, :])
            open_ = False

        for b in batches:
            for key, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not open_ or key != part:
                    close()
                    part, at, open_ = key, 0, True
                    count, last, first = np.zeros(n, np.int64), np.full(n, -1), np.full(n, 1 << 60)
                    twice = np.zeros((n, n), bool)
                for w in words or ():
                    if w not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[w] = [number[u] for u in cut.findall(w)]
                    for u in memo[w]:
                        if count[u]:
                            twice[u] |= last < last[u]
                        else:
                            first[u] = at
                        last[u] = at
                        count[u] += 1
                        at += 1
        close()
        i, j = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array([UNITS[k] for k in i]), pa.array([UNITS[k] for k in j]), *[pa.array(t[i, j]) for t in total]], ["a", "b", "parts", "turns", "a_first", "b_first"])

    rows = df.select(part_col, words_col).mapInArrow(run, "a string, b string, parts long, turns long, a_first long, b_first long")
    whole = rows.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("parts", "turns", "a_first", "b_first")])
    alone = whole.where("a = b").select(F.col("a").alias("u"))  # the units that occur
    return whole.where("a < b").join(F.broadcast(alone.toDF("a")), "a").join(F.broadcast(alone.toDF("b")), "b")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the smallest unit of their connected part as `grp`. Units are those of an alphabet, so the graph is
    small whatever the corpus; its edges are gathered once counted."""
    if edges.count() > 1 << 20:
        raise ValueError("a graph of units has no more than a million edges")
    rows = sorted({(min(r.a, r.b), max(r.a, r.b)) for r in edges.collect()})
    root: dict[str, str] = {}

    def find(u: str) -> str:
        while root.setdefault(u, u) != u:
            root[u] = root[root[u]]
            u = root[u]
        return u

    for a, b in rows:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return edges.sparkSession.createDataFrame([(find(a), a, b) for a, b in rows], "grp string, a string, b string")


def matchings_by(df: DataFrame, group_col: str, budget: int = 100_000) -> DataFrame:
    """Rows (group, status, a, b, verdict) for edges (group, a, b): a component of at most 64 units is solved in one task,
    all groups in parallel."""

    ship(df.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = sorted({(min(a, b), max(a, b)) for a, b in zip(pdf["a"], pdf["b"])})
        if len({u for e in edges for u in e}) > 64:
            rows = [(key[0], "not_closed", None, None, None)]
        else:
            status, _, _ = perfect_matchings(edges, budget)
            rows = [(key[0], status, *r) for r in forced_edges(edges, budget)] or [(key[0], status, None, None, None)]
        return pd.DataFrame(rows, columns=[group_col, "status", "a", "b", "verdict"])

    kind = df.schema[group_col].dataType.simpleString()
    return df.groupBy(group_col).applyInPandas(run, f"`{group_col}` {kind}, status string, a string, b string, verdict string")


class Lattice:
    """The lattice that integer rows span, folded in one row at a time: for each column that has one, a row that starts there.

    A row meets these by Euclid's steps; what is left of it starts further right or is nothing. Each kept row remembers
    of which given rows it is made, so rows that change nothing are forgotten. Numbers beyond `bits` end it.
    """

    def __init__(self, columns: int, bits: int = 4096) -> None:
        self.n, self.bits, self.reason = columns, bits, None
        self.rows: dict[int, tuple[list[int], dict[int, int]]] = {}

    @staticmethod
    def _less(x: tuple[list[int], dict[int, int]], q: int, y: tuple[list[int], dict[int, int]]) -> tuple[list[int], dict[int, int]]:
        made = dict(x[1])
        for k, v in y[1].items():
            if w := made.get(k, 0) - q * v:
                made[k] = w
            else:
                made.pop(k, None)
        return [a - q * b for a, b in zip(x[0], y[0])], made

    def add(self, row: list[int], number: int) -> None:
        if self.reason or self.whole():
            return
        x = (list(row), {number: 1})
        for c in range(self.n):
            if not x[0][c]:
                continue
            if c not in self.rows:
                self.rows[c] = x if x[0][c] > 0 else self._less(([0] * self.n, {}), 1, x)
                return
            while x[0][c]:
                top = self.rows[c]
                if abs(x[0][c]) >= abs(top[0][c]):
                    x = self._less(x, x[0][c] // top[0][c], top)
                else:
                    self.rows[c], x = x, top
            top = self.rows[c]
            if top[0][c] < 0:
                self.rows[c] = self._less(([0] * self.n, {}), 1, top)
            if max(map(abs, (*self.rows[c][0], *x[0], *self.rows[c][1].values(), *x[1].values()))).bit_length() > self.bits:
                self.reason = "bit_limit"
                return

    def _outside(self, rows: np.ndarray) -> np.ndarray:
        """Which of the rows may lie outside of the lattice: those that its rows don't reduce to nothing."""
        small: dict[int, list[int]] = {}  # rows of the same lattice whose numbers are small: each less those that start further right
        for c in sorted(self.rows, reverse=True):
            top = self.rows[c][0]
            for k in sorted(small):
                if q := top[k] // small[k][k]:
                    top = [a - q * b for a, b in zip(top, small[k])]
            small[c] = top
        x = rows.copy()
        for c in sorted(small):
            if max(map(abs, small[c])) >= 1 << 31 or np.abs(x).max(initial=0) >= 1 << 31:
                return np.ones(len(rows), bool)  # beyond 64 bits; they are folded one by one
            x -= (x[:, c] // small[c][c])[:, None] * np.array(small[c])
        return x.any(axis=1)

    def add_all(self, rows: list[list[int]]) -> None:
        """add() of each row in its order. A row of the lattice changes nothing, so these are left out many at once."""
        if max((abs(v) for row in rows for v in row), default=0) >= 1 << 62:
            for k, row in enumerate(rows):
                self.add(row, k)
            return
        matrix, at, step = np.array(rows, np.int64).reshape(len(rows), self.n), 0, 64
        while at < len(rows) and not self.reason and not self.whole():
            left = np.arange(at, min(at + step, len(rows)))
            at, step = at + step, step * 2
            while len(left := left[self._outside(matrix[left])]):
                self.add(rows[left[0]], int(left[0]))
                left = left[1:]
                if self.reason or self.whole():
                    return

    def whole(self) -> bool:
        return len(self.rows) == self.n and all(self.rows[c][0][c] == 1 for c in range(self.n))

    def support(self) -> list[int]:
        return sorted({k for _, made in self.rows.values() for k in made})

    def inverse(self) -> list[dict[int, int]]:
        """For each column the combination of given rows that is its unit row; for a whole lattice."""
        done: dict[int, tuple[list[int], dict[int, int]]] = {}
        for c in reversed(range(self.n)):
            x = self.rows[c]
            for k in range(c + 1, self.n):
                if x[0][k]:
                    x = self._less(x, x[0][k], done[k])
            done[c] = x
        return [done[c][1] for c in range(self.n)]


def lattice_certificate(rows: list[list[int]], bits: int = 4096) -> dict:
    """Whether integer rows span the whole lattice of their columns: {status, reason, rank, pivots, support, inverse}.

    certified: every column has a pivot of 1; then `inverse` times the support rows is the identity, which verify_lattice()
    checks without any elimination.
    """
    if not rows or not rows[0]:
        return {"status": "not_certified", "reason": "empty", "rank": 0, "pivots": [], "support": [], "inverse": []}
    lattice = Lattice(len(rows[0]), bits)
    lattice.add_all(rows)
    pivots = [lattice.rows[c][0][c] for c in sorted(lattice.rows)]
    out = {"rank": len(pivots), "pivots": pivots}
    if lattice.reason or not lattice.whole():
        return {"status": "not_certified", "reason": lattice.reason or ("rank" if len(pivots) < lattice.n else "pivot"), **out, "support": [], "inverse": []}
    used = lattice.support()
    return {"status": "certified", "reason": None, **out, "support": used, "inverse": [[line.get(k, 0) for k in used] for line in lattice.inverse()]}


def verify_lattice(rows: list[list[int]], certificate: dict) -> bool:
    """Whether inverse times support is the identity."""
    n, used = len(rows[0]), [rows[k] for k in certificate["support"]]
    return all(sum(a * r[j] for a, r in zip(line, used)) == int(i == j) for i, line in enumerate(certificate["inverse"]) for j in range(n)) and len(certificate["inverse"]) == n


#: Distinct rows of a track that one task folds at first.
FOLDED = 20_000


def lattice_tracks(counts: DataFrame, track_col: str, columns: list[str]) -> DataFrame:
    """Rows (track, columns, rows, status, reason, rank, rank modulo 3, gcd, support, verified) for count vectors (track, line,
    unit, n), one certificate for each track.

    Distinct rows are folded in buckets first; a bucket leaves the rows of which its lattice is made, and those of which its
    space modulo 3 is, a few for each column. A track's task folds what its buckets left, whose lattice is the same.
    """
    wide = counts.groupBy(track_col, "line").pivot("unit", columns).sum("n").na.fill(0).drop("line").distinct()
    return lattice_rows(wide.select(track_col, F.array(*[F.col(f"`{c}`").cast("long") for c in columns]).alias("row")), track_col, len(columns))


def lattice_rows(rows: DataFrame, track_col: str, n_columns: int) -> DataFrame:
    """The same for distinct rows (track, row) that are arrays already."""
    ship(rows.sparkSession)
    wide = spool(rows, "rows")
    most = wide.groupBy(track_col).count().agg(F.max("count")).first()[0] or 1
    buckets = max(1, -(-most // FOLDED))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(list(map(int, r)) for r in pdf["row"])
        lattice, kept = Lattice(n_columns), []
        lattice.add_all(rows)
        # a lattice that grew beyond the limit is passed on whole, for its track to say so
        kept = rows if lattice.reason else [rows[k] for k in lattice.support()]
        out = [(key[0], r, len(rows) if not k else 0) for k, r in enumerate(kept)] or [(key[0], rows[0], len(rows))]
        out += [(key[0], r, 0) for r in independent_rows(rows, 3)]
        return pd.DataFrame(out, columns=[track_col, "row", "n"])

    def certify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted({tuple(map(int, r)) for r in pdf["row"]})
        rows = [list(r) for r in rows]
        r = lattice_certificate(rows)
        good = r["status"] == "certified" and verify_lattice(rows, r)
        out = (key[0], n_columns, int(pdf["n"].sum()), r["status"], r["reason"], r["rank"], rank_mod(rows), math.gcd(*r["pivots"]) if r["pivots"] else 0, len(r["support"]), good)
        return pd.DataFrame([out], columns=[track_col, "n_columns", "n_rows", "status", "reason", "rank", "rank_mod3", "gcd", "support", "verified"])

    part = wide.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).groupBy(track_col, "bucket").applyInPandas(fold, f"`{track_col}` string, row array<long>, n long")
    return part.groupBy(track_col).applyInPandas(certify, f"`{track_col}` string, n_columns int, n_rows long, status string, reason string, rank int, rank_mod3 int, gcd long, support int, verified boolean")


def independent_rows(rows: list[list[int]], p: int) -> list[list[int]]:
    """Rows of which the space modulo a prime is made, the first that are independent."""
    basis: list[tuple[int, np.ndarray]] = []
    out, at, step = [], 0, 64
    while at < len(rows) and len(out) < len(rows[0]):
        x = np.array([[v % p for v in row] for row in rows[at : at + step]], np.int64)
        for c, b in basis:
            x = (x - x[:, c : c + 1] * b) % p
        while (left := x.any(axis=1)).any():
            k = int(left.argmax())
            c = int((x[k] != 0).argmax())
            b = x[k] * pow(int(x[k, c]), -1, p) % p
            basis.append((c, b))
            out.append(rows[at + k])
            x = (x - x[:, c : c + 1] * b) % p
        at, step = at + step, step * 2
    return out


def rank_mod(rows: list[list[int]], p: int = 3) -> int:
    """Rank of integer rows modulo a prime."""
    return len(independent_rows(rows, p))
