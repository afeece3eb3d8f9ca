"""Splits that keep related records together: connected families, then a swap search by parallel annealing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from random import Random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.runtime import spool

#: A family larger than the whole divided by this is placed before all others; there are at most so many.
GREAT = 4096
#: A tie of more than the whole divided by this is hot; there are fewer than so many.
HOT = 1024
#: Families that one task anneals.
SHARD = 20_000
#: Replicas of the search for the great families and in each shard, and moves of each per family.
GREAT_REPLICAS, REPLICAS, MOVES = 8, 2, 4


def _tie(kind: str, *parts: Column) -> Column:
    """A 64-bit key of a tie; null where a part is null: nulls tie nothing."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.xxhash64(F.lit(kind), *parts))


def locus_ties() -> list[Column]:
    """What ties loci: line_group within the volume, folio number within the volume (fRos is 85), scribe."""
    folio = F.lower(F.trim("folio"))
    digits = F.regexp_extract(folio, r"(\d+)", 1)
    number = F.when(folio == "fros", F.lit("85")).when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))
    scribe = F.lower(F.regexp_replace("scribe", r"^\s+|\s+$", ""))
    return [_tie("group", F.col("volume_id"), F.col("line_group")), _tie("folio", F.col("volume_id"), number), _tie("scribe", scribe)]


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of an undirected graph given as edges (u, v) of 64-bit nodes; self-loops name lone nodes.

    Contraction: each node goes to the least of its closed neighbourhood, m(u), and an edge (u, v) becomes
    (m(u), m(v)), until no edge is left. Neighbours map to neighbours, so components stay what they are, and on hashed
    nodes each round leaves a fraction of them. A round is one aggregation with partial minima (a hub's edges never meet
    in one task) and joins on the node, which adaptive execution splits where skewed. Each round is written to the
    shared folder; only the number of edges comes to the driver.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = None
    while True:
        step = spool(both(edges).groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), "step")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("m").alias("root"))
        else:
            labels = labels.join(step, labels.root == step.u, "left").select("node", F.coalesce("m", "root").alias("root"))
        to = lambda n: step.select(F.col("u").alias(n), F.col("m").alias(f"m{n}"))
        mapped = edges.join(to("u"), "u").join(to("v"), "v")
        edges = spool(mapped.where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), "edges")
        labels = spool(labels, "labels")
        if edges.isEmpty():
            return labels


def families(df: DataFrame, id_col: str, ties: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Families of records that share a tie, directly or through others.

    Returns members (id, tie), where `tie` is any one tie of the record or a key of its own if it has none, and
    roots (tie, root), root being the smallest id of the family. Records of a null id are none; a record given twice is
    one. The graph has ties, not records, as nodes: records first shrink to the distinct combinations of their ties,
    with the smallest id of each, so a tie that a third of all records share is one node.
    """
    names = [f"t{k}" for k in range(len(ties))]
    own = F.xxhash64(F.lit("own"), F.col(id_col))
    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[t.alias(n) for t, n in zip(ties, names)], own.alias("own"))
    keyed = keyed.withColumn("tie", F.coalesce(*names, "own"))
    combos = spool(keyed.groupBy(*names, "tie").agg(F.min("id").alias("id")), "combos")
    edges = combos.select(F.col("tie").alias("u"), F.explode(F.array_compact(F.array(*names))).alias("v")).where("v is not null")
    alone = combos.where(F.coalesce(*names).isNull()).select(F.col("tie").alias("u"), F.col("tie").alias("v"))
    labels = connected(edges.distinct())
    rooted = combos.join(labels, combos.tie == labels.node).groupBy(F.col("root").alias("label")).agg(F.min("id").alias("root"))
    roots = labels.join(rooted, labels.root == rooted.label).select(F.col("node").alias("tie"), rooted.root)
    lone = alone.join(combos, alone.u == combos.tie).select(F.col("u").alias("tie"), F.col("id").alias("root"))
    return keyed.select("id", "tie"), roots.unionByName(lone)


def partition_of(name: Column) -> Column:
    """One of train, validation and test from its spellings; null stays null."""
    name = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.when(name.isin("dev", "valid", "validation"), "validation").otherwise(name)


def torn_families(loci: DataFrame, run_lines: DataFrame) -> DataFrame:
    """Rows (root_locus): families of loci whose rows in run_lines name two or more different partitions.

    Null partition names are ignored, blank ones too; rows of loci that are not in `loci` belong to no family.
    """
    members, roots = families(loci, "locus_id", locus_ties())
    named = run_lines.select(F.col("locus_id").alias("id"), partition_of(F.col("partition_name")).alias("part")).where("part is not null and part <> ''")
    span = [F.min("part").alias("low"), F.max("part").alias("high")]
    of_tie = members.join(named, "id").groupBy("tie").agg(*span)
    of_root = of_tie.join(roots, "tie").groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return of_root.where("low <> high").select(F.col("root").alias("root_locus"))


def deviation(sums: list[list[float]], target: list[list[float]]) -> float:
    """How far the splits are from their shares: squares of the differences in size and in each label, relative."""
    return sum(((a - b) / max(1.0, sum(t))) ** 2 for s, t in zip(zip(*sums), zip(*target)) for a, b in zip(s, t))


def anneal(vectors: list[tuple[float, ...]], shares: list[float], start: list[int], seed: int, target: list[list[float]]) -> tuple[float, list[int]]:
    """Search over assignments of families to splits: move one family, or exchange two of different splits, keep
    what lowers the deviation and sometimes what doesn't. Returns the best deviation and assignment seen."""
    rng, k, dims = Random(seed), len(shares), len(target[0])
    at = list(start)
    scale = [1.0 / max(1.0, sum(target[s][d] for s in range(k))) for d in range(dims)]
    off = [[-target[s][d] for d in range(dims)] for s in range(k)]
    for v, s in zip(vectors, at):
        for d in range(dims):
            off[s][d] += v[d]
    cost = sum((off[s][d] * scale[d]) ** 2 for s in range(k) for d in range(dims))
    best, n = cost, len(vectors)
    since: list[tuple[int, int, int, int]] = []  # accepted moves since the best: (family, its split before, the other or -1, its split before)
    steps = MOVES * n if n > 1 else 0
    heat = max(cost, 1e-12) / 10
    cooling = math.exp(math.log(1e-4) / max(1, steps))
    for _ in range(steps):
        i = rng.randrange(n)
        a = at[i]
        j = rng.randrange(n) if rng.random() < 0.5 else -1
        b = at[j] if j >= 0 else rng.randrange(k)
        if a == b:
            continue
        change = 0.0
        delta = []
        for d in range(dims):
            x = vectors[i][d] - (vectors[j][d] if j >= 0 else 0.0)
            delta.append(x)
            p, q, w = off[a][d], off[b][d], scale[d] * scale[d]
            change += ((p - x) ** 2 - p * p + (q + x) ** 2 - q * q) * w
        if change <= 0 or rng.random() < math.exp(-change / heat):
            for d in range(dims):
                off[a][d] -= delta[d]
                off[b][d] += delta[d]
            at[i] = b
            if j >= 0:
                at[j] = a
            cost += change
            since.append((i, a, j, b))
            if cost < best - 1e-15:
                best = cost
                since.clear()
        heat *= cooling
    for i, a, j, b in reversed(since):
        at[i] = a
        if j >= 0:
            at[j] = b
    return best, at


def hashed_split(key: int, shares: list[float]) -> int:
    """The split that a hash of the key gives, by shares."""
    x, total = Random(key).random() * sum(shares), 0.0
    for s, share in enumerate(shares):
        total += share
        if x < total:
            return s
    return len(shares) - 1


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (id, tie) with the root of their tie."""
    ties = spool(members.groupBy("tie").agg(F.count("*").alias("n")), "ties")
    whole = ties.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = roots.join(ties.where(F.col("n") * HOT > whole).select("tie"), "tie", "left_semi")  # HOT rows at most
    met = members.join(F.broadcast(hot.select("tie", F.col("root").alias("hot_root"))), "tie", "left")
    seldom = met.where("hot_root is null").select("id", "tie").join(roots, "tie").select("id", "root")
    return met.where("hot_root is not null").select("id", F.col("hot_root").alias("root")).unionByName(seldom)


def assign_splits(
    df: DataFrame,
    id_col: str,
    ties: list[Column],
    label: Column,
    labels: list[str],
    shares: dict[str, float],
    shard: int = SHARD,
) -> DataFrame:
    """Rows (id, root, split): each record once, families whole in one split, sizes near `shares`, and each label of
    `labels` (values of `label`; others and null count as the rest) spread likewise.

    The search starts from a hash of the family. Families larger than a GREAT-th of all records, of which there are
    GREAT at most, are annealed first, each replica in a task of its own; the rest in shards of about `shard` families by
    hash, each against its part of what the great ones leave. The best replica counts, in each shard and for the great
    ones. Records of a hot tie, of which there are a bounded number, learn their root by a broadcast join, the others by
    a shuffled one, so no task takes all records of a tie. A record given twice counts once. An empty table gives no row.
    """
    names = list(shares)
    part = [shares[n] / sum(shares.values()) for n in names]
    members, roots = families(df.withColumn("__label", label), id_col, ties)
    dims = ["size", *[f"n{k}" for k in range(len(labels))]]
    once = df.select(F.col(id_col).alias("id"), label.alias("label")).where("id is not null").groupBy("id").agg(F.min("label").alias("label"))
    placed = spool(rooted(spool(members.distinct(), "members"), roots).join(once, "id").select("id", "root", "label"), "placed")
    count = lambda k: F.sum(F.when(F.col("label") == labels[k], 1).otherwise(0)).cast("double").alias(f"n{k}")
    sizes = spool(placed.groupBy("root").agg(F.count("*").cast("double").alias("size"), *[count(k) for k in range(len(labels))]), "sizes")
    whole = sizes.agg(F.count("*").alias("families"), *[F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in dims]).first()
    great = sizes.where(F.col("size") > whole["size"] / GREAT).orderBy("root").collect()  # at most GREAT rows
    target = [[p * whole[d] for d in dims] for p in part]
    vectors = [tuple(r[d] for d in dims) for r in great]
    at = [hashed_split(r["root"], part) for r in great]
    if great:
        first = at

        def replica(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                runs = [(int(seed), *anneal(vectors, part, first, int(seed), target)) for seed in f["id"]]
                yield pd.DataFrame(runs, columns=["seed", "cost", "places"])

        seeds = df.sparkSession.range(0, GREAT_REPLICAS, 1, GREAT_REPLICAS)
        at = seeds.mapInPandas(replica, "seed long, cost double, places array<int>").orderBy("cost", "seed").first()["places"]
    rest = [[target[s][d] - sum(v[d] for v, x in zip(vectors, at) if x == s) for d in range(len(dims))] for s in range(len(part))]
    left = max(1.0, whole["size"] - sum(v[0] for v in vectors))
    shards = max(1, math.ceil((whole["families"] - len(great)) / shard))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("root")
        own = [tuple(x) for x in pdf[dims].to_numpy().tolist()]
        weight = sum(v[0] for v in own) / left
        goal = [[max(0.0, x) * weight for x in line] for line in rest]
        start = [hashed_split(int(r), part) for r in pdf["root"]]
        best = min((anneal(own, part, start, int(key[0]) * REPLICAS + k, goal) for k in range(REPLICAS)), key=lambda r: r[0])
        return pd.DataFrame({"root": pdf["root"].to_numpy(), "split": [names[s] for s in best[1]]})

    small = sizes.where(F.col("size") <= whole["size"] / GREAT).withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(shards)))
    root_type = sizes.schema["root"].dataType.simpleString()
    chosen = small.groupBy("shard").applyInPandas(search, f"root {root_type}, split string")
    if great:
        first = df.sparkSession.createDataFrame([(r["root"], names[s]) for r, s in zip(great, at)], f"root {root_type}, split string")
        chosen = chosen.unionByName(first)
    return placed.join(chosen, "root").select(F.col("id").alias(id_col), F.col("root").alias("root"), "split")
