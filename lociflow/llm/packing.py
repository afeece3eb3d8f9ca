"""Filling containers of fixed capacity: a grouping genetic algorithm on islands, over blocks of items."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.bpe import RANKS, token_counts
from lociflow.runtime import spool

#: Items of one block, which are packed together.
BLOCK_ITEMS = 4096
#: Islands of a block, packings on each, and children born on an island between two migrations.
ISLANDS, POPULATION, CHILDREN = 4, 6, 24
#: Migrations without a gain after which a block is given up.
PATIENCE = 2


class Packing:
    """Bins as lists of item numbers; free is the space left in each."""

    __slots__ = ("bins", "free", "value")

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins = bins
        self.free = [capacity - sum(sizes[i] for i in b) for b in bins]
        # fewer bins first, then the sum of squared fill: full bins beside nearly empty ones are better than even ones
        self.value = (-len(bins), sum((capacity - f) ** 2 for f in self.free) / (capacity * capacity * max(1, len(bins))))

    @classmethod
    def of(cls, places: list[int], sizes: list[int], capacity: int) -> Packing:
        """From the bin number of each item."""
        bins: list[list[int]] = [[] for _ in range(max(places, default=-1) + 1)]
        for i, b in enumerate(places):
            bins[b].append(i)
        return cls(bins, sizes, capacity)

    def places(self) -> list[int]:
        at = [0] * sum(map(len, self.bins))
        for b, bin_ in enumerate(self.bins):
            for i in bin_:
                at[i] = b
        return at


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: the sum, and for each size up to half the capacity, what must stand beside larger items.

    For a threshold t, items above capacity - t share a bin with none of t or more; those above half the capacity share
    none with each other, and the space they leave is all that the others from t on have in these bins.
    """
    ordered = sorted(sizes)
    total = [0]
    for s in ordered:
        total.append(total[-1] + s)
    n, half = len(ordered), bisect_right(ordered, capacity // 2)
    best = -(-total[n] // capacity)
    for t in sorted(set(ordered[:half])):
        k, low = bisect_right(ordered, capacity - t), bisect_left(ordered, t)
        k = max(k, half)
        space = capacity * (k - half) - (total[k] - total[half])
        best = max(best, n - half + max(0, -(-(total[half] - total[low] - space) // capacity)))
    return best


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], free: list[int]) -> None:
    """Put each item into the bin with the least space that holds it, a new one if none does. Changes bins and free."""
    room = sorted((f, b) for b, f in enumerate(free))
    for i in items:
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            f, b = room.pop(k)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(0)
        free[b] = f - sizes[i]
        insort(room, (free[b], b))


def exchange(pool: list[int], sizes: list[int], bins: list[list[int]], free: list[int]) -> list[int]:
    """Fill bins up by exchange with the displaced items: one item or two of a bin for the largest displaced one that
    still fits, or one item for two displaced ones. What comes out is smaller, so easier to place. Returns the displaced."""
    out = sorted((sizes[i], i) for i in pool)

    def swap(b: int, gone: tuple[int, ...], came: list[tuple[int, int]]) -> None:
        for x in came:
            out.remove(x)
        for i in gone:
            bins[b].remove(i)
            insort(out, (sizes[i], i))
        bins[b] += [i for _, i in came]
        free[b] += sum(sizes[i] for i in gone) - sum(s for s, _ in came)

    for b in sorted(range(len(bins)), key=lambda k: free[k]):
        gap = free[b]
        if not gap or not out:
            continue
        best = None  # (space left, what goes, what comes)
        bin_ = bins[b]
        ways = [((i,), sizes[i]) for i in bin_] + [((i, j), sizes[i] + sizes[j]) for x, i in enumerate(bin_[:8]) for j in bin_[x + 1 : 8]]
        for gone, size in ways:
            k = bisect_right(out, (size + gap, 1 << 62)) - 1
            if k >= 0 and out[k][0] > size and (best is None or size + gap - out[k][0] < best[0]):
                best = (size + gap - out[k][0], gone, [out[k]])
                if not best[0]:
                    break
        if best is None or best[0]:
            for i in bin_:
                low, high, size = 0, len(out) - 1, sizes[i]
                while low < high:  # the two displaced that together come nearest from below
                    pair = out[low][0] + out[high][0]
                    if pair > size + gap:
                        high -= 1
                        continue
                    if pair > size and (best is None or size + gap - pair < best[0]):
                        best = (size + gap - pair, (i,), [out[low], out[high]])
                    low += 1
                if best is not None and not best[0]:
                    break
        if best is not None:
            swap(b, best[1], best[2])
    return [i for _, i in reversed(out)]


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: Random) -> Packing:
    """The child keeps the bins of `a` and takes well-filled ones of `b` whole; bins of `a` that hold one of their
    items go, with the worst ones. The items so displaced change places with some of the bins where that fills these
    better, then are fitted in, the largest first."""
    order = sorted(range(len(b.bins)), key=lambda k: b.free[k])
    full = order[: max(1, len(order) // 2)]
    taken = [b.bins[k] for k in rng.sample(full, min(len(full), rng.randrange(1, 1 + max(1, len(full) // 12))))]
    inside = {i for bin_ in taken for i in bin_}
    bins, displaced = [list(x) for x in taken], []
    worst = sorted(range(len(a.bins)), key=lambda k: -a.free[k])[: 2 + len(a.bins) // 40]
    worst = {*worst, *(rng.randrange(len(a.bins)) for _ in range(2))}
    for k, bin_ in enumerate(a.bins):
        if k in worst or any(i in inside for i in bin_):
            displaced += [i for i in bin_ if i not in inside]
        else:
            bins.append(list(bin_))
    free = [capacity - sum(sizes[i] for i in x) for x in bins]
    displaced = exchange(displaced, sizes, bins, free)
    best_fit(displaced, sizes, capacity, bins, free)
    return Packing(bins, sizes, capacity)


def settle(sizes: list[int], capacity: int, island: int, seed: int) -> list[Packing]:
    """The first packings of an island: best fit of the falling sizes, the others with sizes blurred more and more."""
    out = []
    for j in range(POPULATION):
        rng = Random(f"{seed}:{island}:{j}")
        noise = 0.05 * (j + 1) if j or island else 0
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))
        bins: list[list[int]] = []
        best_fit(order, sizes, capacity, bins, [])
        out.append(Packing(bins, sizes, capacity))
        if not noise and len(bins) == least_bins(sizes, capacity):
            break
    return out


def evolve(packings: list[Packing], sizes: list[int], capacity: int, seed: str, children: int = CHILDREN) -> list[Packing]:
    """So many children on one island; each takes the place of the worst if it is better. Ends early at the least number of bins."""
    rng, least = Random(seed), least_bins(sizes, capacity)
    packings = sorted(packings, key=lambda p: p.value, reverse=True)[:POPULATION]
    for _ in range(children if len(packings) > 1 else 0):
        if len(packings[0].bins) == least:
            break
        a, b = rng.sample(packings, 2)
        child = crossover(a, b, sizes, capacity, rng)
        if child.value > packings[-1].value and all(child.value != p.value for p in packings):
            packings[-1] = child
            packings.sort(key=lambda p: p.value, reverse=True)
    return packings


_STATE = "block long, island int, packings array<array<int>>, bins int, open boolean, stale int"


def _islands(blocks: DataFrame, capacity: int, islands: int, tasks: int) -> DataFrame:
    """Rows (block, places): the best packing of each block, a bin number for each of its sizes.

    Every island is a task of its own. Between two rounds the best packing of each goes to the next island of the block.
    A block ends at the least number of bins there can be, or when PATIENCE rounds brought no gain; the driver sees
    only how many blocks are open. Each round is written to the shared folder.
    """

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for block, sizes, k in zip(f["block"], f["sizes"], f["island"]):
                sizes = sizes.tolist()
                found = settle(sizes, capacity, int(k), int(block))
                best = min(len(p.bins) for p in found) if sizes else 0
                rows.append((block, k, [p.places() for p in found], best, best > least_bins(sizes, capacity), 0))
            yield pd.DataFrame(rows, columns=["block", "island", "packings", "bins", "open", "stale"])

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                sizes = r.sizes.tolist()
                here = [Packing.of(list(p), sizes, capacity) for p in [*r.packings, r.guest]]
                found = evolve(here, sizes, capacity, f"{r.block}:{r.island}:{r.round}")
                best = len(found[0].bins)
                rows.append((r.block, r.island, [p.places() for p in found], best, best > least_bins(sizes, capacity), 0 if best < r.least else r.stale + 1))
            yield pd.DataFrame(rows, columns=["block", "island", "packings", "bins", "open", "stale"])

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "block", "island")

    first = spool(blocks.select("block", "sizes", F.lit(0).alias("island")).repartition(tasks, "block").mapInPandas(start, _STATE), "state")
    done = [first.where("not open")]
    more = first.where("open").select("block").join(blocks.select("block", "sizes"), "block")
    more = more.select("*", F.explode(F.array(*map(F.lit, range(1, islands)))).alias("island"))
    state = spool(first.where("open").unionByName(spread(more).select("block", "sizes", "island").mapInPandas(start, _STATE)), "state")
    round_ = 0
    while not state.isEmpty():
        round_ += 1
        whole = state.groupBy("block").agg(F.min("bins").alias("least"), F.min("stale").alias("since"), F.min(F.col("open").cast("int")).alias("any"))
        # closed by reaching the bound on some island, or by rounds without a gain
        ended = (F.col("any") == 0) | (F.col("since") >= PATIENCE)
        done.append(state.join(whole.where(ended).select("block"), "block", "left_semi"))
        guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("packings")[0].alias("guest"))
        going = state.join(whole.where(~ended).select("block", "least"), "block").join(guests, ["block", "island"]).join(blocks.select("block", "sizes"), "block")
        state = spool(spread(going.withColumn("round", F.lit(round_))).mapInPandas(step, _STATE), "state")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    best = out.groupBy("block").agg(F.min_by(F.col("packings")[0], F.struct("bins", "island")).alias("places"))
    return spool(best, "best")


def pack_sized(items: DataFrame, id_col: str, size_col: str, capacity: int, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS) -> DataFrame:
    """Rows (id, part, start, size, container) of items (id, size).

    Items are dealt to blocks of about `block_items` by a hash of their id, and rows of one id and size by their number
    too, so that no id fills a block; containers hold items of one block, which leaves a part of one container unused in
    each block at most besides what packing leaves. `container` is unique in all: block * 2^32 + number in the block. An
    item larger than the capacity gives parts that fill containers alone and a rest that is packed as an item; others are
    never divided. An item of size 0 or null takes no space: one row with a null container.
    """
    if islands < 2:
        raise ValueError("two islands or more")
    id_type = items.schema[id_col].dataType.simpleString()
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0))
    kinds = spool(items.select(F.col(id_col).alias("id"), size.alias("size")).groupBy("id", "size").agg(F.count("*").alias("n")), "items")
    n_items = kinds.where("size > 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-n_items // block_items))
    # equal rows are numbered in two steps, so that none makes an array of all of them
    step = 4096
    each = kinds.withColumn("high", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step)))).withColumn("low", F.explode(F.sequence(F.lit(0), F.least(F.lit(step - 1), F.col("n") - 1 - F.col("high") * step))))
    each = each.select("id", "size", (F.col("high") * step + F.col("low")).alias("copy"))
    full = F.when(F.col("size") > capacity, F.floor((F.col("size") - 1) / capacity)).otherwise(0)
    rest = each.where("size > 0").select("id", "copy", full.alias("full"), (F.col("size") - full * capacity).cast("int").alias("rest"), F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)).alias("block"))
    # a block's items in falling order of size; ties by id
    member = F.struct((-F.col("rest")).alias("order"), "id", "copy", "full", "rest")
    table = rest.groupBy("block").agg(F.array_sort(F.collect_list(member)).alias("items"))
    table = spool(table.select("block", F.transform("items", lambda x: x["rest"]).alias("sizes"), "items"), "blocks")
    spark = items.sparkSession
    tasks = min(blocks * islands, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = table.join(_islands(table, capacity, islands, tasks), "block")
    one = packed.select("block", F.size("items").alias("n"), F.posexplode("items").alias("k", "x"), "places")
    rows = one.select(
        F.col("x.id").alias("id"), (F.col("x.full")).cast("int").alias("part"), (F.col("x.full") * capacity).alias("start"), F.col("x.rest").cast("long").alias("size"),
        (F.shiftleft("block", 32) + F.element_at("places", F.col("k") + 1)).alias("container"), F.col("block"), "k", F.col("x.full").alias("full"),
    )
    # full parts have containers of their own, numbered from 2^31 on by the item's place in the block and the part
    before = F.sum("full").over(Window.partitionBy("block").orderBy("k")) - F.col("full")  # a block is bounded
    whole = rows.where("full > 0").select("block", "id", "full", before.alias("before"))
    parts = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("part"))
    parts = parts.select("id", "part", (F.col("part").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"), (F.shiftleft("block", 32) + F.lit(1 << 31) + F.col("before") + F.col("part")).alias("container"))
    none = each.where("size = 0").select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"))
    out = rows.select("id", "part", "start", "size", "container").unionByName(parts).unionByName(none)
    return out.select(F.col("id").cast(id_type).alias(id_col), "part", "start", "size", "container")


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = RANKS) -> DataFrame:
    """Texts packed into containers of `capacity` tokens: rows (id, part, start, size, container), start and size in tokens.

    Null and empty texts take no space (a null container). Only ids and counts are shuffled, never texts. A row given
    twice is two items. An empty table gives no row.
    """
    return pack_sized(token_counts(df, id_col, text_col, path), id_col, "n_tokens", capacity)
