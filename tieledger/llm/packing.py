"""Packing documents into sequences with a grouping genetic algorithm on islands.

1. Documents are turned into ids, an end id is added, and only what is longer than a sequence is cut; the remainder is
   the first piece, so that all others fill a sequence alone.
2. The shorter pieces are dealt into pools of a few thousand by a hash of their row number.  Every pool is packed by
   several islands.  An island keeps a few solutions; crossover takes whole well-filled bins of one parent into the
   other and empties the bins that hold any of their documents, and a few of the poorest.  One or two displaced documents
   replace one or two of a bin where that fills it better; the others go back by best fit, longest first.  An island rests
   at the least possible number of bins, or when some crossovers in a row saved none.  Between epochs every island
   sends its best solution to the next one of its ring, through a shuffle.
3. The best solution of a pool wins.  What its poorly filled bins hold is dealt into pools of a next round, so that the
   loss at a pool's edge does not add up, until one pool is left or a round saves nothing worth its work.

Only lengths and row numbers travel through the genetic part, never texts.

Defined cases: a null or empty text is one piece, the end id alone; rows that share a doc_id are packed each for
itself; an empty table gives no sequence; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.tokens import TokenIds
from tieledger.sources.tables import cut

#: Pieces of a pool, islands that pack it, epochs between migrations, solutions of an island, crossovers of an epoch, and those in a row that may save no bin.
POOL, ISLANDS, EPOCHS, SOLUTIONS, CROSSOVERS, IDLE = 4096, 3, 2, 3, 10, 3
#: Islands of a task.
PER_TASK = 8
#: Bins a crossover brings in and empties, passes of replacement, pieces of a bin up to which pairs of them are swapped,
#: sums that are looked at for one swap: those are bounds of the search, none of them of what is packed.
INJECTED, EMPTIED, PASSES, WIDE, LOOKS = 24, 40, 4, 12, 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = TokenIds(vocabulary)
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = ids_of.of(text) + end
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                for k, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, PIECES)


class _Bins:
    """Bins of one pool: contents, room, and the bins ordered by room for best fit."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.order: list[tuple[int, int]] = []
        self.next = 0

    def add(self, items: list[int], room: int) -> None:
        self.bins[self.next], self.room[self.next] = items, room
        bisect.insort(self.order, (room, self.next))
        self.next += 1

    def best_fit(self, items: list[int]) -> None:
        """Longest first, each into the fullest bin that still has the room."""
        for i in sorted(items, key=lambda i: (-self.lengths[i], i)):
            n = int(self.lengths[i])
            k = bisect.bisect_left(self.order, (n, -1))
            if k == len(self.order):
                self.add([i], self.capacity - n)
                continue
            room, b = self.order.pop(k)
            self.bins[b].append(i)
            self.room[b] = room - n
            bisect.insort(self.order, (room - n, b))

    def labels(self) -> np.ndarray:
        out = np.empty(len(self.lengths), np.int32)
        for k, items in enumerate(self.bins.values()):
            out[items] = k
        return out


def _from_groups(lengths: np.ndarray, capacity: int, groups: list[list[int]]) -> _Bins:
    new = _Bins(lengths, capacity)
    for items in groups:
        new.bins[new.next], new.room[new.next] = items, capacity - int(lengths[items].sum())
        new.next += 1
    new.order = sorted((r, b) for b, r in new.room.items())
    return new


def fitness(lengths: np.ndarray, labels: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; then fuller full bins, so that the last ones can empty."""
    fill = np.bincount(labels, lengths)
    return int(labels.max()) + 1, -float(((fill / capacity) ** 2).mean())


def _groups(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]


def replace(lengths: np.ndarray, capacity: int, groups: list[list[int]], loose: list[int]) -> tuple[list[list[int]], list[int]]:
    """Swaps one or two displaced pieces against one or two of a bin wherever that fills the bin better.

    Every swap leaves less length displaced, so passes end; what comes out of a bin is offered to the others in the next
    pass.  Pairs are looked up by their sum, the largest that still fits first.
    """
    size = lengths.tolist()
    groups = [list(g) for g in groups]
    room = [capacity - sum(size[i] for i in g) for g in groups]
    for _ in range(PASSES):
        own = np.array(loose, np.int64)
        if not len(own):
            break
        one, two = np.triu_indices(len(own))  # a piece with itself stands for the piece alone
        sums = np.where(one == two, lengths[own[one]], lengths[own[one]] + lengths[own[two]])
        order = np.argsort(sums, kind="stable")
        one, two, sums = own[one[order]].tolist(), own[two[order]].tolist(), sums[order].tolist()
        free, freed = set(loose), []
        for g in sorted((g for g, r in enumerate(room) if r), key=lambda g: (room[g], g)):
            items, best, gain = groups[g], None, 0
            outs = [(), *((i,) for i in items), *((i, j) for k, i in enumerate(items) for j in items[k + 1 :])]
            for out in outs if len(items) <= WIDE else outs[: 1 + len(items)]:
                gone = sum(size[i] for i in out)
                k = top = bisect.bisect_right(sums, gone + room[g]) - 1
                while k >= 0 and sums[k] > gone + gain and top - k < LOOKS and not (one[k] in free and two[k] in free):
                    k -= 1
                if k >= 0 and sums[k] > gone + gain and top - k < LOOKS:
                    best, gain = (out, {one[k], two[k]}), sums[k] - gone
                    if gain == room[g]:
                        break
            if best:
                out, new = best
                groups[g] = [i for i in items if i not in out] + sorted(new)
                room[g] -= gain
                free -= new
                freed += out
        if len(free) == len(loose):
            break
        loose = sorted(free) + freed
    return groups, loose


def crossover(lengths: np.ndarray, capacity: int, mother: np.ndarray, father: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Some of the father's well-filled bins enter the mother whole.

    Her bins that hold any of their pieces are emptied, and so are a few of her poorest (the mutation).  The displaced
    pieces replace others where that fills a bin better; what is left is best-fitted.
    """
    theirs = _groups(father)
    fill = np.bincount(father, lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = [theirs[b] for b in draw.permutation(well)[: max(1, min(len(well) // 3, INJECTED))]]
    inside = np.zeros(len(lengths), bool)
    for items in taken:
        inside[items] = True
    own = _groups(mother)
    by_fill = np.argsort(np.bincount(mother, lengths) + draw.random(len(own)), kind="stable")
    poor = set(by_fill[: min(EMPTIED, max(1, len(own) // 8))].tolist())
    kept, displaced = [], []
    for b, items in enumerate(own):
        if b in poor or inside[items].any():
            displaced += [i for i in items if not inside[i]]
        else:
            kept.append(items)
    kept, displaced = replace(lengths, capacity, kept + taken, displaced)
    child = _from_groups(lengths, capacity, kept)
    child.best_fit(displaced)
    return child.labels()


def _first(lengths: np.ndarray, capacity: int, draw: np.random.Generator, plain: bool) -> np.ndarray:
    """Best fit decreasing; apart from the first, with a part of the pieces held back and put in last."""
    new = _Bins(lengths, capacity)
    late = np.zeros(len(lengths), bool) if plain else draw.random(len(lengths)) < 0.1
    new.best_fit(np.flatnonzero(~late).tolist())
    new.best_fit(np.flatnonzero(late).tolist())
    return new.labels()


def _evolve(capacity: int, seed: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for pool, island, lengths, start in zip(rows["pool"], rows["island"], rows["lengths"], rows["solutions"], strict=True):
                lengths = np.asarray(lengths, np.int64)
                draw = np.random.Generator(np.random.PCG64([seed, epoch, int(pool) & 0xFFFFFFFF, int(island)]))
                least = -(-int(lengths.sum()) // capacity)
                held = [np.asarray(s, np.int32) for s in start] if start is not None else []
                if not held:
                    held = [_first(lengths, capacity, draw, k + island == 0) for k in range(SOLUTIONS)]
                held.sort(key=lambda s: fitness(lengths, s, capacity))
                now, idle = fitness(lengths, held[0], capacity)[0], 0
                for _ in range(CROSSOVERS):
                    if len(held) < 2 or now <= least or idle == IDLE:
                        break
                    a, b = draw.choice(len(held), 2, replace=False)
                    held = [*held, crossover(lengths, capacity, held[min(a, b)], held[max(a, b)], draw)]
                    held = sorted(held, key=lambda s: fitness(lengths, s, capacity))[:SOLUTIONS]
                    before, now = now, fitness(lengths, held[0], capacity)[0]
                    idle = 0 if now < before else idle + 1
                n, full = fitness(lengths, held[0], capacity)
                out.append((pool, island, [s.tolist() for s in held], n, full))
            yield pd.DataFrame(out, columns=["pool", "island", "solutions", "n", "full"])

    return run


_SOLVED = "pool long, island int, solutions array<array<int>>, n int, full double"


def pack_pools(pools: DataFrame, capacity: int, seed: int, tasks: int = 1) -> DataFrame:
    """(pool, lengths array) -> (pool, lengths, labels): the bin of every piece, by islands with elite migration.

    Lengths are split off and joined by pool, so that an epoch's shuffle carries solutions only.  Islands are small rows of
    much work: they go to a stated number of tasks, which are not drawn together by their bytes.
    """
    islands = pools.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition(tasks, "pool", "island")
    now = islands.withColumn("solutions", F.lit(None).cast("array<array<int>>"))
    for epoch in range(EPOCHS):
        solved = now.select("pool", "island", "lengths", "solutions").mapInPandas(_evolve(capacity, seed, epoch), _SOLVED)
        solved = cut(solved)
        if epoch < EPOCHS - 1:  # the best one travels to the next island of the ring
            guests = solved.select("pool", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("solutions", 1, 1).alias("guests"))
            both = solved.join(guests, ["pool", "island"]).select("pool", "island", F.concat("guests", "solutions").alias("solutions"))
            now = islands.join(both, ["pool", "island"]).repartition(tasks, "pool", "island")
    best = solved.groupBy("pool").agg(F.min_by(F.struct(F.element_at("solutions", 1).alias("s")), F.struct("n", "full", "island")).alias("best"))
    return pools.join(best.select("pool", F.col("best.s").alias("labels")), "pool")


def _placed(capacity: int):
    """Each pool's bins: offsets in them, and whether a bin is well filled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for pool, items, lengths, labels in zip(rows["pool"], rows["items"], rows["lengths"], rows["labels"], strict=True):
                lengths, labels = np.asarray(lengths, np.int64), np.asarray(labels, np.int64)
                order = np.argsort(labels, kind="stable")
                ends = np.cumsum(lengths[order])
                starts = ends - lengths[order]
                first = np.append(True, np.diff(labels[order]) > 0)
                base = np.maximum.accumulate(np.where(first, starts, 0))
                fill = np.bincount(labels, lengths)
                yield pd.DataFrame({"item": np.asarray(items, np.int64)[order], "length": lengths[order], "pool": pool, "bin": labels[order], "offset": starts - base, "fill": fill[labels[order]].astype(np.int64)})

    return run


_PLACED = "item long, length long, pool long, bin long, offset long, fill long"


def assign(items: DataFrame, capacity: int = 2048, seed: int = 11, well_filled: float = 0.97, gain: float = 0.001) -> DataFrame:
    """(item, length) -> (item, round, pool, bin, offset) so that no bin holds more than ``capacity``.

    What is left after a round is packed again in pools of its own.  That goes on until one pool holds it, or dealing it
    anew saves less than ``gain`` of its bins; of the last two ways to pack it the one of fewer bins counts.
    """
    done, held, held_bins, rounds = None, None, 0, 0
    n = items.count()
    names = ["item", "round", "pool", "bin", "offset"]
    while n:
        n_pools = max(1, -(-n // POOL))
        dealt = items.withColumn("pool", F.pmod(F.xxhash64("item", F.lit(seed + rounds)), F.lit(n_pools)))
        pools = dealt.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("x"))
        pools = cut(pools.select("pool", F.col("x.item").alias("items"), F.col("x.length").alias("lengths")))
        packed = pack_pools(pools.select("pool", "lengths"), capacity, seed + rounds, -(-n_pools * ISLANDS // PER_TASK))
        packed = pools.join(packed.select("pool", "labels"), "pool")
        placed = cut(packed.select("pool", "items", "lengths", "labels").mapInPandas(_placed(capacity), _PLACED)).withColumn("round", F.lit(rounds))
        poor = F.col("fill") < int(well_filled * capacity)
        opens = F.when(F.col("offset") == 0, 1)
        bins, n, poor_bins = placed.agg(F.count(opens), F.count(F.when(poor, 1)), F.count(F.when(poor, opens))).first()
        last = n_pools == 1 or (held is not None and bins > held_bins * (1 - gain))
        settled = held if held is not None and bins > held_bins else placed if last else placed.where(~poor)
        done = settled.select(names) if done is None else done.unionByName(settled.select(names))
        if last:
            break
        held, held_bins = placed.where(poor), poor_bins
        items, rounds = held.select("item", "length"), rounds + 1
    return done


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: every id stands in one sequence.

    The pieces are written to the shared folder once, with row numbers; whatever is recomputed later reads those.
    """
    numbered = cut(pieces(docs, capacity, end_id, vocabulary).withColumn("item", F.monotonically_increasing_id()))
    full = numbered.where(F.col("length") == capacity)
    short = numbered.where(F.col("length") < capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = full.select(*names[:5], (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = assign(short.select("item", "length"), capacity, seed)
    if placed is None:
        return alone
    # a round's pools hold 4096 pieces on average, never 2**20, and are fewer than 2**32
    number = (F.col("round").cast("long") * F.lit(2**52)) + F.col("pool") * F.lit(2**20) + F.col("bin")
    joined = short.join(placed.withColumn("sequence_id", number), "item").select(*names)
    return alone.unionByName(joined)
