"""Key search and certification: annealing, local search, branch and bound, threshold queries, equal optima.

One problem, restart or query is one row; workers solve rows independently (mapInPandas), so a study of many
restarts or queries spreads over the cluster while each search stays in one task. Every returned score is
the exact integer objective of the returned key, which score_keys() recomputes relationally.
"""

from __future__ import annotations

import heapq
import math
import random
import uuid
from collections.abc import Iterator
from fractions import Fraction
from functools import cmp_to_key
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.keysearch import PROPOSALS, RESTARTS
from lociflow.runtime import BROADCAST_ROWS, ship

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


#: Up to so many types branch and bound takes the sharper pivot bound at each node, beyond the bound of single types.
PIVOT_TYPES = 60
#: Bytes that the masks of one problem may take in a worker.
MASK_BYTES = 1 << 30


class Lexicon:
    """Cipher types with integer weights, and plain words: a key scores the weights of the types it turns into words.

    capacity is how many units may stand for one letter; 1 makes keys injective, None sets no bound.
    """

    def __init__(self, types: dict[str, int], words: set[str], capacity: int | None = 1) -> None:
        self.types, self.words, self.capacity = types, words, capacity
        # an injective key keeps the pattern of repeats; other keys keep the length
        self._shape = word_shape if capacity == 1 else len
        self.by_shape: dict[object, list[str]] = {}
        for w in sorted(words):
            self.by_shape.setdefault(self._shape(w), []).append(w)
        self._candidates: dict[str, list[dict[str, str]]] = {}
        self._live: dict[tuple[int, ...], bool] = {}
        self._firsts: dict[int, list[str]] | None = None
        self._scorer: VectorScore | None = None
        total: dict[str, int] = {}
        self.of_unit: dict[str, list[str]] = {}
        for t, weight in types.items():
            for u in set(t):
                total[u] = total.get(u, 0) + weight
                self.of_unit.setdefault(u, []).append(t)
        #: Units by falling weight of the types that hold them: the order of branching.
        self.order = sorted(total, key=lambda u: (-total[u], u))
        self._bits: BitsetBound | None = None

    def candidates_of(self, t: str) -> list[dict[str, str]]:
        """What each word that a type may become asks of the key."""
        if t not in self._candidates:
            self._candidates[t] = [m for w in self.by_shape.get(self._shape(t), ()) if (m := self._mapping(t, w)) is not None]
        return self._candidates[t]

    @property
    def candidates(self) -> dict[str, list[dict[str, str]]]:
        """All of them, pairs of types and words of one shape: for small problems."""
        return {t: self.candidates_of(t) for t in self.types}

    def live(self, t: str) -> bool:
        """Whether a type has a candidate: told by its pattern and one word of each pattern."""
        shape = word_shape(t)
        if shape not in self._live:
            if self.capacity == 1:
                self._live[shape] = shape in self.by_shape
            else:
                if self._firsts is None:
                    first: dict[tuple[int, ...], str] = {}
                    for w in self.words:
                        first.setdefault(word_shape(w), w)
                    self._firsts = {}
                    for w in first.values():
                        self._firsts.setdefault(len(w), []).append(w)
                self._live[shape] = any(self._mapping(t, w) is not None for w in self._firsts.get(len(t), ()))
        return self._live[shape]

    @property
    def scorer(self) -> VectorScore:
        if self._scorer is None:
            self._scorer = VectorScore(self)
        return self._scorer

    @property
    def bits(self) -> BitsetBound:
        if self._bits is None:
            self._bits = BitsetBound(self)
        return self._bits

    def _mapping(self, cipher: str, word: str) -> dict[str, str] | None:
        key: dict[str, str] = {}
        for u, v in zip(cipher, word):
            if key.setdefault(u, v) != v:
                return None
        return key if self.allowed(key) else None

    def allowed(self, key: dict[str, str]) -> bool:
        if self.capacity is None:
            return True
        used: dict[str, int] = {}
        for v in key.values():
            used[v] = used.get(v, 0) + 1
        return all(n <= self.capacity for n in used.values())

    def fits(self, mapping: dict[str, str], key: dict[str, str], used: dict[str, int]) -> bool:
        """Whether a candidate can still come true under a partial key."""
        new: dict[str, int] = {}
        for u, v in mapping.items():
            if u in key:
                if key[u] != v:
                    return False
            else:
                new[v] = new.get(v, 0) + 1
        return self.capacity is None or all(used.get(v, 0) + n <= self.capacity for v, n in new.items())

    def bound(self, key: dict[str, str]) -> int:
        """Weights of the types that have a candidate left: no completion of the key scores more."""
        if not key:
            return sum(w for t, w in self.types.items() if self.live(t))
        used: dict[str, int] = {}
        for v in key.values():
            used[v] = used.get(v, 0) + 1
        return sum(w for t, w in self.types.items() if any(self.fits(m, key, used) for m in self.candidates_of(t)))

    def pivot_bound(self, key: dict[str, str]) -> int:
        """A bound no larger than bound(): types are grouped by their smallest open unit, which has one value only."""
        used: dict[str, int] = {}
        for v in key.values():
            used[v] = used.get(v, 0) + 1
        done, groups = 0, {}
        if not key and self.capacity == 1:
            at: dict[tuple, set[str]] = {}
            for t, w in self.types.items():
                if t and self.live(t):
                    p = min(t)
                    place = (word_shape(t), t.index(p))
                    if place not in at:
                        at[place] = {x[place[1]] for x in self.by_shape[place[0]]}
                    sums = groups.setdefault(p, {})
                    for v in at[place]:
                        sums[v] = sums.get(v, 0) + w
            return sum(max(s.values()) for s in groups.values()) + (self.types.get("", 0) if "" in self.words else 0)
        for t, w in self.types.items():
            open_units = [u for u in t if u not in key]
            live = [m for m in self.candidates_of(t) if self.fits(m, key, used)]
            if not live:
                continue
            if not open_units:
                done += w
                continue
            p = min(open_units)
            sums = groups.setdefault(p, {})
            for v in {m[p] for m in live}:
                sums[v] = sums.get(v, 0) + w
        return done + sum(max(s.values()) for s in groups.values())

    def decoded(self, t: str, key: dict[str, str]) -> str | None:
        out = [key.get(u) for u in t]
        return None if None in out else "".join(out)

    def score(self, key: dict[str, str], types: list[str] | None = None) -> int:
        """The weights of the types (all, or some) that the key turns into words."""
        return sum(self.types[t] for t in (self.types if types is None else types) if self.decoded(t, key) in self.words)

    def gain(self, key: dict[str, str], new: dict[str, str], changed: tuple[str, ...]) -> int:
        """score(new) - score(key) for keys that differ in the units `changed` only."""
        if len(key) == len(new) == len(self.order) and self.scorer.exact:
            return self.scorer.gain(key, new)
        touched = {t for u in changed for t in self.of_unit.get(u, ())}
        return self.score(new, touched) - self.score(key, touched)

    def values(self, key: dict[str, str]) -> list[str]:
        used: dict[str, int] = {}
        for v in key.values():
            used[v] = used.get(v, 0) + 1
        return [v for v in ALPHABET if self.capacity is None or used.get(v, 0) < self.capacity]


def word_shape(w: str) -> tuple[int, ...]:
    """The pattern of repeats of a word."""
    seen: dict[str, int] = {}
    return tuple(seen.setdefault(c, len(seen)) for c in w)


class VectorScore:
    """Scores of complete keys by arrays: a type's word under the key is a number of digits to the base 27, to which each unit
    adds its letter times what its places are worth. Of more than 13 letters that number is taken modulo 2^64, and the
    types whose numbers are words' are decoded."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex
        self.exact = sum(lex.types.values()) < 1 << 62 and all(set(w) <= set(ALPHABET) for w in lex.words)
        if not self.exact:
            return
        self.types = [t for t in sorted(lex.types, key=len) if lex.live(t)]
        self.short = sum(len(t) <= 13 for t in self.types)
        self.weights = np.array([lex.types[t] for t in self.types], np.int64)
        worth: dict[str, dict[int, int]] = {u: {} for u in lex.order}
        for k, t in enumerate(self.types):
            for j, u in enumerate(t):
                worth[u][k] = worth[u].get(k, 0) + 27**j
        array = lambda x: np.array([v & ((1 << 64) - 1) for v in x], np.uint64)
        self.worth = {u: (np.fromiter(x.keys(), np.int64, len(x)), array(x.values())) for u, x in worth.items()}
        number = lambda w: sum((ord(c) - 96) * 27**j for j, c in enumerate(w))
        self.known = [np.unique(array(number(w) for w in lex.words if (len(w) > 13) == many)) for many in (False, True)]
        self.filter = np.zeros(1 << 22, bool)
        for codes in self.known:
            self.filter[self._place(codes)] = True
        self.at: tuple = (None,)
        self.asked: tuple = (None,)

    @staticmethod
    def _place(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x5851F42D4C957F2D) >> np.uint64(42)).astype(np.int64)

    def _score(self, codes: np.ndarray, key: dict[str, str]) -> int:
        maybe = np.flatnonzero(self.filter[self._place(codes)])  # few of them are no words, and these are told below
        cut, good = np.searchsorted(maybe, self.short), []
        for rows, known in ((maybe[:cut], self.known[0]), (maybe[cut:], self.known[1])):
            at = np.minimum(np.searchsorted(known, codes[rows]), len(known) - 1)
            good.append(rows[known[at] == codes[rows]] if len(known) else rows[:0])
        return int(self.weights[good[0]].sum()) + self.lex.score(key, [self.types[k] for k in good[1]])

    def gain(self, key: dict[str, str], new: dict[str, str]) -> int:
        if key != self.at[0]:
            if key == self.asked[0]:
                self.at = self.asked
            else:
                codes = np.zeros(len(self.weights), np.uint64)
                for u, v in key.items():
                    if u in self.worth:
                        rows, worth = self.worth[u]
                        codes[rows] += worth * np.uint64(ord(v) - 96)
                self.at = (dict(key), codes, self._score(codes, key))
        codes = self.at[1].copy()
        for u, v in new.items():
            if v != key[u] and u in self.worth:
                rows, worth = self.worth[u]
                codes[rows] += worth * np.uint64((ord(v) - ord(key[u])) % (1 << 64))
        self.asked = (dict(new), codes, self._score(codes, new))
        return self.asked[2] - self.at[2]


class ShapeMasks:
    """Masks of the words of each pattern, by place and letter, for bounds at the root of a problem of injective keys: all
    types of a pattern have the same candidates, so one mask does for them."""

    def __init__(self, lex: Lexicon) -> None:
        if lex.capacity != 1:
            raise ValueError("capacity 1")
        self.lex, self.full, self.at = lex, {}, {}
        for shape in {word_shape(t) for t in lex.types}:
            words = lex.by_shape.get(shape, [])
            self.full[shape] = (1 << len(words)) - 1
            for j in {shape.index(k) for k in shape}:
                places: dict[str, bytearray] = {}
                for k, w in enumerate(words):
                    places.setdefault(w[j], bytearray(len(words) // 8 + 1))[k >> 3] |= 1 << (k & 7)
                self.at[shape, j] = {v: int.from_bytes(b, "little") for v, b in places.items()}

    def bound(self) -> int:
        return sum(w for t, w in self.lex.types.items() if self.full[word_shape(t)])

    def pivot(self) -> int:
        sums: dict[str, dict[str, int]] = {}
        for t, w in self.lex.types.items():
            shape = word_shape(t)
            if t and (full := self.full[shape]):
                p = min(t)
                for v, mask in self.at[shape, t.index(p)].items():
                    if full & mask:
                        sums.setdefault(p, {})[v] = sums.get(p, {}).get(v, 0) + w
        return sum(max(s.values()) for s in sums.values()) + (self.lex.types.get("", 0) if self.full.get(()) else 0)


class ShapeBound:
    """The bound of Lexicon.bound() of all children of a node at once, and their scores, for injective keys.

    Under a key each type shows the letters of its decided places, and each word the letters that the key uses; a type has a
    candidate left if and only if a word of its pattern shows the same. So types and words fall into classes, counted by
    sorting, and no pair of them is ever written down.
    """

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex
        number = {u: k for k, u in enumerate(lex.order)}
        shapes: dict[tuple[int, ...], int] = {}
        types = [t for t in lex.types if lex.live(t)]
        for t in types:
            shapes.setdefault(word_shape(t), len(shapes))
        words = [(s, w) for s in shapes for w in lex.by_shape[s]]
        width = max((max(s, default=-1) + 1 for s in shapes), default=0)
        self.width, n = width, len(lex.order)
        self.units = np.full((len(types), width), n, np.int64)
        self.letters = np.full((len(words), width), 26, np.int64)
        for k, t in enumerate(types):
            x = list(dict.fromkeys(t))
            self.units[k, : len(x)] = [number[u] for u in x]
        for k, (_, w) in enumerate(words):
            x = list(dict.fromkeys(w))
            self.letters[k, : len(x)] = [ord(c) - 97 for c in x]
        self.number, self.weights = number, np.array([lex.types[t] for t in types], np.int64)
        self.shape = np.array([shapes[word_shape(t)] for t in types] + [shapes[s] for s, _ in words], np.int64)

    @staticmethod
    def possible(lex: Lexicon) -> bool:
        return lex.capacity == 1 and sum(lex.types.values()) < 1 << 62 and all(set(w) <= set(ALPHABET) for w in lex.words)

    def children(self, key: dict[str, str], unit: str) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, scores) of key + unit = v for each of the 26 letters; what it says of letters in use is to be left out."""
        told, used = np.full(len(self.number) + 1, 27, np.int64), np.full(27, 27, np.int64)
        told[-1] = used[26] = 26
        for u, v in key.items():
            used[ord(v) - 97] = ord(v) - 97
            if u in self.number:
                told[self.number[u]] = ord(v) - 97
        types, words = told[self.units], used[self.letters]
        code, high = self.shape, int(self.shape.max(initial=0)) + 1
        for j in range(self.width):
            if high * 28 >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                high = int(code.max(initial=0)) + 1
            code, high = code * 28 + np.concatenate([types[:, j], words[:, j]]), high * 28
        classes, code = np.unique(code, return_inverse=True)
        c_type, c_word, n = code[: len(types)], code[len(types) :], len(classes)
        have = np.bincount(c_word, minlength=n)
        with_letter = np.zeros(n * 26, np.int64)
        holds = np.zeros(len(types), bool)
        opens = (types == 27).sum(axis=1)
        bounds, scores = np.zeros(26, np.int64), np.zeros(26, np.int64)

        def add(rows: np.ndarray, left: np.ndarray, can: np.ndarray) -> None:
            for out, pick in ((bounds, rows), (scores, rows[left])):
                # weights by class, in whole numbers
                sums = np.zeros(n, np.int64)
                np.add.at(sums, c_type[pick], self.weights[pick])
                some = np.flatnonzero(sums)
                out += (sums[some, None] * can[some]).sum(axis=0)

        for j in range(self.width):
            free = np.flatnonzero(words[:, j] == 27)
            at = np.bincount(c_word[free] * 26 + self.letters[free, j], minlength=n * 26)
            with_letter += at
            rows = np.flatnonzero(self.units[:, j] == self.number[unit])
            holds[rows] = True
            add(rows, opens[rows] == 1, (at > 0).reshape(n, 26))
        rows = np.flatnonzero(~holds)
        add(rows, opens[rows] == 0, have[:, None] > with_letter.reshape(n, 26))
        return bounds, scores


class BitsetBound:
    """The bound of Lexicon.bound() by masks: every candidate of every type is a bit, the candidates of a type lie side by
    side in a lane, and above each lane is a guard bit. Adding a full lane to what is left of it carries into the guard if
    and only if a candidate is left; guards are weighed by the bits of the weights.

    An assignment leaves the candidates that agree with it, so the mask of a child is its parent's and two more masks.
    Capacities of 1, 2 and none are kept by masks; a mask beyond MASK_BYTES in all is refused.
    """

    def __init__(self, lex: Lexicon) -> None:
        if lex.capacity not in (1, 2, None):
            raise ValueError("capacity 1, 2 or None")
        self.lex, at, shape = lex, 0, lex._shape
        # counted first, so that a problem too large is refused before anything is built; pairs are not kept
        fits = lambda t: (m for w in lex.by_shape.get(shape(t), ()) if (m := lex._mapping(t, w)) is not None)
        room = {t: len(lex.by_shape[shape(t)]) if lex.capacity == 1 else sum(1 for _ in fits(t)) for t in lex.types if lex.live(t)}
        n = sum(room.values()) + len(lex.types)
        if n // 8 * max(1, len(lex.order)) * (len(ALPHABET) + 1) > MASK_BYTES:
            raise ValueError(f"{n} candidates of {len(lex.order)} units are too many for the masks")
        self.size = sum(room.values()) + len(room)
        blank = lambda: bytearray(self.size // 8 + 1)
        holds: dict[str, bytearray] = {u: blank() for u in lex.order}
        gives: dict[tuple[str, str], bytearray] = {}
        twice: dict[str, bytearray] = {}
        self.guard_of: dict[str, int] = {}
        self.full = 0
        lanes, guards = [], []
        for t, c in room.items():
            for k, m in enumerate(fits(t), at):
                byte, bit = k >> 3, 1 << (k & 7)
                values: dict[str, int] = {}
                for u, v in m.items():
                    holds[u][byte] |= bit
                    if (u, v) not in gives:
                        gives[u, v] = blank()
                    gives[u, v][byte] |= bit
                    values[v] = values.get(v, 0) + 1
                for v, many in values.items():
                    if many > 1:
                        if v not in twice:
                            twice[v] = blank()
                        twice[v][byte] |= bit
            lanes.append((at, c))
            at += c
            self.guard_of[t] = at
            guards.append(at)
            at += 1
        self.full = sum(((1 << c) - 1) << o for o, c in lanes)
        self.guards = self._mask(guards)
        number = lambda d: {k: int.from_bytes(d.pop(k), "little") for k in list(d)}
        self.holds, self.gives, self.twice = number(holds), number(gives), number(twice)
        high = max((w.bit_length() for w in lex.types.values()), default=0)
        self.weight = [self._mask([g for t, g in self.guard_of.items() if lex.types[t] >> b & 1]) for b in range(high)]

    def _mask(self, places: list[int]) -> int:
        bits = bytearray(self.size // 8 + 1)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(bits, "little")

    def child(self, mask: int, key: dict[str, str], unit: str, value: str) -> int:
        """The mask after unit = value is added to `key`, of which `mask` is the mask."""
        mask &= ~self.holds[unit] | self.gives.get((unit, value), 0)
        if self.lex.capacity is not None:
            same = [u for u, v in key.items() if v == value] + [unit]
            if len(same) >= self.lex.capacity:  # the letter is full: no other unit may give it
                for u in self.lex.order:
                    if u not in same and u not in key:
                        mask &= ~self.gives.get((u, value), 0)
            elif self.lex.capacity == 2:  # one more unit may: not two that are both new
                mask &= ~(self.twice.get(value, 0) & ~self.holds[unit])
        return mask

    def mask(self, key: dict[str, str]) -> int:
        mask, done = self.full, {}
        for u, v in key.items():
            if u in self.holds:
                mask = self.child(mask, done, u, v)
            done[u] = v
        return mask

    def value(self, mask: int, among: int | None = None) -> int:
        """The weights of the types with a candidate left, of all or those whose guards are `among`."""
        live = (mask + self.full) & (self.guards if among is None else among)
        return sum((live & w).bit_count() << b for b, w in enumerate(self.weight))

    def bound(self, key: dict[str, str]) -> int:
        return self.value(self.mask(key))

    def pivot(self, mask: int, key: dict[str, str]) -> int:
        """Lexicon.pivot_bound() by masks: for each smallest open unit the best of its values."""
        groups: dict[str | None, list[int]] = {}
        for t, g in self.guard_of.items():
            groups.setdefault(min((u for u in t if u not in key), default=None), []).append(g)
        out = 0
        for p, guards in groups.items():
            among = self._mask(guards)
            if p is None:
                out += self.value(mask, among)
            else:
                out += max((self.value(mask & self.gives[p, v], among) for v in ALPHABET if (p, v) in self.gives), default=0)
        return out


def branch_and_bound(lex: Lexicon, budget: int = 1000, fixed: dict[str, str] | None = None, forbidden: set[tuple[str, str]] = frozenset(), target: int | None = None) -> dict:
    """Best-first search for the key of the largest score: {status, lower, upper, key, nodes}.

    lower is the score of the best key seen, upper a proven bound. status: empty_input, infeasible_alphabet,
    bound_certified (they meet), search_exhausted, budget_exhausted; with a target also feasible (a key reaches it) and
    infeasible (none can). Nothing uncertified is called optimal.
    """
    start = dict(fixed or {})
    if not lex.types:
        return {"status": "empty_input", "lower": 0, "upper": 0, "key": start, "nodes": 0}
    if lex.capacity is not None and len(lex.order) > lex.capacity * len(ALPHABET):
        return {"status": "infeasible_alphabet", "lower": 0, "upper": 0, "key": start, "nodes": 0}
    if not lex.allowed(start) or any((u, v) in forbidden for u, v in start.items()):
        return {"status": "infeasible", "lower": 0, "upper": 0, "key": {}, "nodes": 0}
    best, best_key, nodes, serial = lex.score(start), start, 0, 0
    sharp = sum(map(lex.live, lex.types)) <= PIVOT_TYPES
    # the same bounds: of many types by classes, all children at once, of few by masks
    many = None if sharp or fixed or not ShapeBound.possible(lex) else ShapeBound(lex)
    bits = None if many else lex.bits

    def upper_of(mask: int, key: dict[str, str]) -> int:
        return bits.pivot(mask, key) if sharp else bits.value(mask)

    heap = [(-(lex.bound({}) if many else upper_of(bits.mask(start), start)), 0, 0, start)]
    while heap:
        upper = max(best, -heap[0][0])
        if target is not None and best >= target:
            return {"status": "feasible", "lower": best, "upper": upper, "key": best_key, "nodes": nodes}
        if target is not None and upper < target:
            return {"status": "infeasible", "lower": best, "upper": upper, "key": best_key, "nodes": nodes}
        if upper == best:
            return {"status": "bound_certified", "lower": best, "upper": best, "key": best_key, "nodes": nodes}
        if nodes >= budget:
            return {"status": "budget_exhausted", "lower": best, "upper": upper, "key": best_key, "nodes": nodes}
        _, _, _, key = heapq.heappop(heap)
        nodes += 1
        unit = next((u for u in lex.order if u not in key), None)
        if unit is None:
            continue
        mask = None if many else bits.mask(key)
        bounds, scores = many.children(key, unit) if many else (None, None)
        for v in lex.values(key):
            if (unit, v) in forbidden:
                continue
            child = {**key, unit: v}
            b = int(bounds[ord(v) - 97]) if many else upper_of(bits.child(mask, key, unit, v), child)
            if b > best or (target is not None and b >= target):
                if (s := int(scores[ord(v) - 97]) if many else lex.score(child)) > best:
                    best, best_key = s, child
                serial += 1
                heapq.heappush(heap, (-b, -len(child), serial, child))
    if target is not None:
        return {"status": "feasible" if best >= target else "infeasible", "lower": best, "upper": best, "key": best_key, "nodes": nodes}
    return {"status": "search_exhausted", "lower": best, "upper": best, "key": best_key, "nodes": nodes}


def local_search(lex: Lexicon, key: dict[str, str], moves: int = 8) -> tuple[int, dict[str, str], int]:
    """Best improvement over all reassignments and swaps, ties by the smallest key; (score, key, neighbours seen)."""
    score, seen = lex.score(key), 0
    units = sorted(lex.order)
    for _ in range(moves):
        best: tuple[int, list, dict[str, str]] | None = None
        for i, u in enumerate(units):
            near = [({**key, u: v}, (u,)) for v in ALPHABET if key.get(u) != v]
            near += [({**key, u: key[w], w: key[u]}, (u, w)) for w in units[i + 1 :] if u in key and w in key and key[u] != key[w]]
            for k, changed in near:
                if not lex.allowed(k):
                    continue
                seen += 1
                gain = lex.gain(key, k, changed)
                if gain > 0 and (best is None or (-gain, sorted(k.items())) < best[:2]):
                    best = (-gain, sorted(k.items()), k)
        if best is None:
            break
        score, key = score - best[0], best[2]
    return score, key, seen


def anneal_key(lex: Lexicon, steps: int, seed: int, start: dict[str, str] | None = None) -> tuple[int, dict[str, str]]:
    """Linear cooling over reassignments (to values that have room) and swaps; the best key seen."""
    rng, units = random.Random(seed), lex.order
    pool = [v for v in ALPHABET for _ in range(lex.capacity or len(units))]
    rng.shuffle(pool)
    key = dict(start) if start else dict(zip(units, pool))
    score = best = lex.score(key)
    kept, heat0 = dict(key), max(1, max(lex.types.values(), default=1))
    for step in range(steps if len(units) > 1 else 0):
        u, w = rng.sample(units, 2)
        if rng.random() < 0.25 and (room := lex.values(key)):
            new, changed = {**key, u: rng.choice(room)}, (u,)
        else:
            new, changed = {**key, u: key[w], w: key[u]}, (u, w)
        s = score + lex.gain(key, new, changed)
        heat = heat0 * (1 - step / steps)
        if s >= score or (heat > 0 and rng.random() < math.exp((s - score) / heat)):
            key, score = new, s
            if s > best:
                best, kept = s, dict(key)
    return best, kept


def frequency_start(lex: Lexicon) -> dict[str, str]:
    """Units by falling weight on letters by falling number in the words, each letter as often as the capacity allows."""
    seen: dict[str, int] = {}
    for w in lex.words:
        for c in w:
            seen[c] = seen.get(c, 0) + 1
    letters = sorted(ALPHABET, key=lambda c: (-seen.get(c, 0), c))
    return {u: letters[k // (lex.capacity or 1) % len(letters)] for k, u in enumerate(lex.order)}


def local_start(lex: Lexicon, seed: int) -> dict[str, str]:
    """Where local search begins: seed 0 by frequency, others at the best key of a whole search by annealing, whose first
    restart begins by frequency and the others at random."""
    first = frequency_start(lex)
    if seed == 0:
        return first
    runs = [anneal_key(lex, PROPOSALS, seed * RESTARTS + k, None if k else first) for k in range(RESTARTS)]
    return max(runs, key=lambda r: (r[0], sorted(r[1].items(), reverse=True)))[1]


def equal_optima(lex: Lexicon, target: int, domains: dict[str, str], limit: int = 100_000) -> list[dict[str, str]]:
    """All keys over the given domains that score exactly `target`; an error where one scores more or there are too many."""
    units = sorted(domains)
    if math.prod(len(domains[u]) for u in units) > limit:
        raise ValueError("more completions than the limit")
    out = []
    for values in product(*[sorted(domains[u]) for u in units]):
        key = dict(zip(units, values))
        if lex.allowed(key) and (s := lex.score(key)) >= target:
            if s > target:
                raise ValueError("a completion scores more than the target")
            out.append(key)
    return out


def preserved_completions(free_units: int, room: list[int]) -> int:
    """In how many ways units without influence can be assigned when letters have the given room left: a sum over how
    many take each letter, by binomials."""
    ways = [1] + [0] * free_units
    for r in room:
        new = [0] * (free_units + 1)
        for have, w in enumerate(ways):
            if w:
                for k in range(min(r, free_units - have) + 1):
                    new[have + k] += w * math.comb(free_units - have, k)
        ways = new
    return ways[free_units]


def preserved_injective(free_units: int, free_letters: int) -> int:
    """In how many ways units without influence can take letters of their own that are free."""
    return math.perm(free_letters, free_units) if free_units <= free_letters else 0


def ambiguity(lex: Lexicon, key: dict[str, str]) -> dict:
    """How many keys agree with `key` on every unit of the types it turns into words: all of them keep its hits."""
    hits = [t for t in lex.types if lex.decoded(t, key) in lex.words]
    held = {u for t in hits for u in t}
    free = [u for u in lex.order if u not in held]
    used: dict[str, int] = {}
    for u in held:
        used[key[u]] = used.get(key[u], 0) + 1
    if lex.capacity == 1:
        n = preserved_injective(len(free), len(ALPHABET) - len(used))
    elif lex.capacity is None:
        n = len(ALPHABET) ** len(free)
    else:
        n = preserved_completions(len(free), [lex.capacity - used.get(v, 0) for v in ALPHABET])
    return {"hits": len(hits), "determined_units": len(held), "free_units": len(free), "completions": n}


def threshold_queries(spark: SparkSession, types: dict[str, int], words: set[str], capacity: int | None, queries: list[tuple[str, dict[str, str], set[tuple[str, str]], int]], budget: int) -> DataFrame:
    """Rows (name, status, lower, upper, nodes) of queries (name, fixed units, forbidden values, target): is there a key that
    scores the target. Each query is a task of its own."""
    shared = _Shared(spark, (types, words, capacity, {name: (fixed, forbidden, target) for name, fixed, forbidden, target in queries}))
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, w, c, todo = shared.value
        for frame in frames:
            out = []
            for name in frame["name"]:
                fixed, forbidden, target = todo[name]
                r = branch_and_bound(_lexicon(shared.id, t, w, c), budget, fixed, forbidden, target)
                out.append((name, {"feasible": "feasible", "infeasible": "infeasible", "search_exhausted": "infeasible"}.get(r["status"], "unknown"), r["lower"], r["upper"], r["nodes"]))
            yield pd.DataFrame(out, columns=["name", "status", "lower", "upper", "nodes"])

    names = spark.createDataFrame([(n,) for n, *_ in queries], "name string").repartition(max(1, len(queries)))
    return names.mapInPandas(run, "name string, status string, lower long, upper long, nodes long")


class _Shared:
    """A broadcast value with a name of its own."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


_BUILT: dict[object, Lexicon] = {}


def _lexicon(number: object, types: dict[str, int], words: set[str], capacity: int | None) -> Lexicon:
    """The problem's lexicon, built once in each worker."""
    if (number, capacity) not in _BUILT:
        _BUILT.clear()
        _BUILT[number, capacity] = Lexicon(types, words, capacity)
    return _BUILT[number, capacity]


def assess_optimum(lex: Lexicon, key: dict[str, str], budget: int = 1000) -> Iterator[tuple[str, str, str]]:
    """For each unit (unit, value, verdict): forced_at_certified_optimum if no key with another value reaches the score,
    ambiguous if one does, unresolved if the budget ends first."""
    score = lex.score(key)
    for u in lex.order:
        r = branch_and_bound(lex, budget, forbidden={(u, key[u])} if u in key else set(), target=score)
        verdict = {"infeasible": "forced_at_certified_optimum", "feasible": "ambiguous"}.get(r["status"], "unresolved")
        yield u, key.get(u, ""), verdict


def local_result(lex: Lexicon, start: dict[str, str], moves: int) -> dict:
    score, key, seen = local_search(lex, start, moves)
    return {"status": "heuristic", "lower": score, "key": key, "upper": lex.bound({}), "nodes": seen}


_SOLVE = {
    "bnb": lambda lex, seed, budget: branch_and_bound(lex, budget),
    "anneal": lambda lex, seed, budget: dict(zip(("lower", "key"), anneal_key(lex, budget, seed, None if seed else frequency_start(lex)))) | {"status": "heuristic", "upper": lex.bound({}), "nodes": budget},
    "local": lambda lex, seed, budget: local_result(lex, local_start(lex, seed), budget),
}


def solve(spark: SparkSession, types: dict[str, int], words: set[str], jobs: list[tuple[str, int, int | None, int]], starts: dict[int, dict[str, str]] | None = None) -> DataFrame:
    """Rows (method, seed, capacity, status, lower, upper, nodes, key) of jobs (method, seed, capacity, budget).

    methods: bnb, anneal (seed 0 begins by frequency), local; `starts` has keys for seeds of local search, which else come from
    local_start(). The problem, a bounded vocabulary, goes to the workers once; each job is a task of its own.
    """
    shared = _Shared(spark, (types, words, starts or {}))
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, w, begin = shared.value
        for frame in frames:
            out = []
            for method, seed, capacity, budget in frame.itertuples(index=False, name=None):
                lex = _lexicon(shared.id, t, w, None if capacity == 0 else int(capacity))
                r = local_result(lex, begin[seed], int(budget)) if method == "local" and seed in begin else _SOLVE[method](lex, int(seed), int(budget))
                text = " ".join(f"{u}={v}" for u, v in sorted(r["key"].items()))
                out.append((method, seed, capacity, r["status"], r["lower"], r["upper"], r["nodes"], text))
            yield pd.DataFrame(out, columns=["method", "seed", "capacity", "status", "lower", "upper", "nodes", "key"])

    rows = [(m, s, 0 if c is None else c, b) for m, s, c, b in jobs]
    df = spark.createDataFrame(rows, "method string, seed long, capacity int, budget long").repartition(len(rows))
    return df.mapInPandas(run, "method string, seed long, capacity int, status string, lower long, upper long, nodes long, `key` string")


def score_keys(solved: DataFrame, types: DataFrame, words: DataFrame) -> DataFrame:
    """Scores of solved keys, computed by joins: types (w, weight) are spelt out under each key and met with the words (w)."""
    key = solved.select("method", "seed", "capacity", F.str_to_map("key", F.lit(" "), F.lit("=")).alias("m"))
    n = key.count()
    if n > BROADCAST_ROWS // 100:
        raise ValueError("too many keys to spell the types under each")
    spelt = types.crossJoin(F.broadcast(key))  # each type under each of a bounded number of keys
    letters = F.transform(F.split("w", ""), lambda u: F.coalesce(F.try_element_at("m", u), F.when(u == "", "").otherwise("?")))
    hits = spelt.withColumn("x", F.array_join(letters, "")).join(words.select(F.col("w").alias("x")).distinct(), "x")
    return hits.groupBy("method", "seed", "capacity").agg(F.sum("weight").cast("long").alias("score"))


def pair_bound(lex: Lexicon, top: int = 12) -> int:
    """A bound from conflicts: of `top` types by weight, two conflict if no pair of their candidates is jointly allowed;
    of a clique of conflicting types one at most comes true. Types outside the top count in full."""
    live = sorted((t for t in lex.types if lex.live(t)), key=lambda t: (-lex.types[t], t))
    head, rest = live[:top], live[top:]

    def joint(s: str, t: str) -> bool:
        if lex.capacity != 1:
            return any(all(b.get(u, v) == v for u, v in a.items()) and lex.allowed({**a, **b}) for a in lex.candidates_of(s) for b in lex.candidates_of(t))
        both = sorted(set(s) & set(t))

        def by_shared(x: str) -> dict[tuple[str, ...], set[frozenset[str]]]:
            out: dict[tuple[str, ...], set[frozenset[str]]] = {}
            at, other = [x.index(u) for u in both], [x.index(u) for u in sorted(set(x) - set(both))]
            for w in lex.by_shape[word_shape(x)]:
                out.setdefault(tuple(w[k] for k in at), set()).add(frozenset(w[k] for k in other))
            return out

        one, two = by_shared(s), by_shared(t)
        return any(not (a & b) for k in one.keys() & two.keys() for a in one[k] for b in two[k])

    conflict = {(s, t) for i, s in enumerate(head) for t in head[i + 1 :] if not joint(s, t)}
    cliques: list[list[str]] = []
    for t in head:
        home = next((c for c in cliques if all((s, t) in conflict for s in c)), None)
        if home is None:
            cliques.append([t])
        else:
            home.append(t)
    return sum(lex.types[c[0]] for c in cliques) + sum(lex.types[t] for t in rest)


def _product(factors: list[int]) -> int:
    """Numbers of like size are multiplied, two and two."""
    while len(factors) > 1:
        factors = [math.prod(factors[k : k + 2]) for k in range(0, len(factors), 2)]
    return factors[0] if factors else 1


def _primes(n: int) -> dict[int, int]:
    out: dict[int, int] = {}
    p = 2
    while p * p <= n:
        while n % p == 0:
            out[p], n = out.get(p, 0) + 1, n // p
        p += 1 + (p > 2)
    if n > 1:
        out[n] = out.get(n, 0) + 1
    return out


def ratio_parts(train: dict[tuple[str, str], int], vocabulary: int, a: dict[tuple[str, str], int], b: dict[tuple[str, str], int]) -> tuple[int, int]:
    """Numerator and denominator, in lowest terms, of likelihood_ratio(). Its factors are numbers of the size of the counts, so
    their primes cancel before anything large is multiplied."""
    totals: dict[str, int] = {}
    for (h, _), n in train.items():
        totals[h] = totals.get(h, 0) + n
    power: dict[int, int] = {}
    for event in set(a) | set(b):
        if d := a.get(event, 0) - b.get(event, 0):
            for n, sign in ((10 * train.get(event, 0) + 1, d), (10 * totals.get(event[0], 0) + vocabulary, -d)):
                power[n] = power.get(n, 0) + sign
    primes: dict[int, int] = {}
    for n, e in power.items():
        if e:
            for p, k in _primes(n).items():
                primes[p] = primes.get(p, 0) + k * e
    up, down = (sorted(p ** (sign * e) for p, e in primes.items() if sign * e > 0) for sign in (1, -1))
    return _product(up), _product(down)


def likelihood_ratio(train: dict[tuple[str, str], int], vocabulary: int, a: dict[tuple[str, str], int], b: dict[tuple[str, str], int]) -> Fraction:
    """The exact ratio of the likelihoods of two histograms of (context, symbol) events under add-0.1 estimates: only
    events that differ in number enter, each as (10 c + 1) / (10 t + V)."""
    return Fraction(*ratio_parts(train, vocabulary, a, b))


def rank_keys(train: dict[tuple[str, str], int], vocabulary: int, events: dict[str, dict[tuple[str, str], int]]) -> list[tuple[str, str, str, float]]:
    """Candidate keys by exact likelihood, the best first: (name, numerator, denominator, log2) of each against the first
    name, numerator and denominator in hexadecimal."""
    first = min(events)
    ratio = {k: ratio_parts(train, vocabulary, e, events[first]) for k, e in events.items()}
    logs = {k: math.log2(n) - math.log2(m) for k, (n, m) in ratio.items()}

    def order(x: str, y: str) -> int:
        if abs(logs[x] - logs[y]) > 0.5:  # far beyond what a logarithm may be wrong by; else whole numbers tell
            return -1 if logs[x] > logs[y] else 1
        one, two = ratio[x][0] * ratio[y][1], ratio[y][0] * ratio[x][1]
        return (one < two) - (one > two) or (x > y) - (x < y)

    return [(k, hex(ratio[k][0]), hex(ratio[k][1]), logs[k]) for k in sorted(events, key=cmp_to_key(order))]
