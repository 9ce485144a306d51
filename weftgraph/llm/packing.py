"""Documents packed into containers of fixed capacity by a grouping genetic algorithm on islands.

Items are spread over shards of bounded size. Each shard is packed by several islands, each with a population of packings;
crossover injects whole well-filled bins of one parent into another, removes what they duplicate and places displaced
documents by best fit. Between epochs the elite of every island migrates to the next one. Only sizes travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

CAPACITY = 8192
SHARD_ITEMS = 1024
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 4, 2, 6, 8, 2
EXCHANGES = 3


class Packing:
    """Items in bins: ``bin_of`` each item, ``fill`` of each bin (0 for a bin no longer used)."""

    __slots__ = ("bin_of", "fill")

    def __init__(self, bin_of: np.ndarray, fill: list[int]):
        self.bin_of, self.fill = bin_of, fill

    def fitness(self, capacity: int) -> float:
        """Mean square of the fill of the bins in use: few, full bins are best."""
        f = np.array(self.fill, float)
        f = f[f > 0] / capacity
        return float((f * f).mean()) if len(f) else 1.0

    def compact(self) -> Packing:
        used, new = np.unique(self.bin_of, return_inverse=True)
        return Packing(new.astype(np.int32), [self.fill[b] for b in used])


def best_fit(packing: Packing, items: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
    """Place ``items`` in their order, each in the bin with the least room that holds it, else in a new bin."""
    room = sorted((capacity - f, b) for b, f in enumerate(packing.fill) if 0 < f < capacity)
    for i in items.tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(packing.fill)
            packing.fill.append(0)
        packing.bin_of[i] = b
        packing.fill[b] += size
        if left > size:
            insort(room, (left - size, b))


def seeded(sizes: np.ndarray, capacity: int, rng: np.random.Generator, spread: float) -> Packing:
    """Best fit over falling sizes, each blurred by up to ``spread``."""
    p = Packing(np.full(len(sizes), -1, np.int32), [])
    best_fit(p, np.argsort(-sizes * rng.uniform(1 - spread, 1 + spread, len(sizes)), kind="stable"), sizes, capacity)
    return p.compact()


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """A copy of ``a`` with some of the fullest bins of ``b``."""
    fill_b = np.array(b.fill)
    well = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.6))
    injected = rng.choice(well, max(1, len(well) // 4), replace=False)
    moved = np.isin(b.bin_of, injected)
    touched = np.zeros(len(a.fill), bool)
    touched[a.bin_of[moved]] = True
    displaced = np.flatnonzero(touched[a.bin_of] & ~moved)
    child = Packing(a.bin_of.copy(), [0 if t else f for t, f in zip(touched, a.fill, strict=True)])
    names = np.full(len(b.fill), -1, np.int32)
    names[injected] = len(a.fill) + np.arange(len(injected))
    child.bin_of[moved] = names[b.bin_of[moved]]
    child.fill += fill_b[injected].tolist()
    best_fit(child, displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, capacity)
    return child.compact()


def exchanged(p: Packing, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Put loose items into bins in exchange for smaller ones, each where it leaves the least room; returns what is loose then. Bins only
    get fuller, so what has to be placed at the end is smaller."""
    fill = np.array(p.fill)
    loose = loose.tolist()
    for _ in range(EXCHANGES):
        moved = False
        for k in np.argsort(-sizes[loose], kind="stable").tolist():
            i = loose[k]
            placed = p.bin_of >= 0
            left = np.where(placed, sizes + capacity - fill[p.bin_of] - sizes[i], -1)
            left[(left < 0) | (sizes >= sizes[i])] = capacity + 1
            j = int(left.argmin())
            if left[j] > capacity:
                continue
            b = p.bin_of[j]
            p.bin_of[i], p.bin_of[j] = b, -1
            fill[b] += sizes[i] - sizes[j]
            loose[k] = j
            moved = True
        if not moved:
            break
    p.fill = fill.tolist()
    return np.array(loose)


def mutated(p: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Empty the least full bin and a few others, exchange their items for smaller ones, and place what is loose again."""
    fill = np.array(p.fill)
    chosen = np.zeros(len(fill), bool)
    chosen[np.argmin(fill)] = True
    chosen[rng.integers(0, len(fill), max(1, len(fill) // 30))] = True
    loose = np.flatnonzero(chosen[p.bin_of])
    q = Packing(p.bin_of.copy(), np.where(chosen, 0, fill).tolist())
    q.bin_of[loose] = -1
    loose = exchanged(q, loose, sizes, capacity)
    best_fit(q, loose[np.argsort(-sizes[loose], kind="stable")], sizes, capacity)
    return q.compact()


def evolve(sizes: np.ndarray, population: list[Packing], capacity: int, rng: np.random.Generator, generations: int, size: int) -> list[Packing]:
    """The population after some generations, the fittest first; the fittest is never lost."""
    while len(population) < size:
        population.append(seeded(sizes, capacity, rng, 0.0 if not population else 0.3))
    scored = sorted(((p.fitness(capacity), k, p) for k, p in enumerate(population)), reverse=True)[:size]
    for g in range(generations):
        if len(scored[0][2].fill) <= -(-int(sizes.sum()) // capacity):
            break  # as few bins as any packing needs
        children = []
        for k in range(size - ELITE):
            pick = lambda: min(rng.integers(0, len(scored), 2))
            a, b = scored[pick()][2], scored[pick()][2]
            child = crossover(a, b, sizes, capacity, rng)
            if k % 3 == 0:
                child = mutated(child, sizes, capacity, rng)
            children.append((child.fitness(capacity), (g + 1) * 1000 + k, child))
        scored = sorted([*scored[:ELITE], *children], reverse=True)
    return [p for _, _, p in scored]


def document_pieces(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, offset and size (bytes) of every document; only those above ``capacity`` have several pieces, all but the
    last of them full. Null and empty texts have one piece of size 0."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("bytes"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    return sized.select("doc_id", "bytes", F.posexplode(starts).alias("piece", "offset")).withColumn("size", F.least(F.lit(capacity), F.col("bytes") - F.col("offset")).cast("int"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Every piece of every document with its container: doc_id, piece, offset, size, container.

    A container never holds more than ``capacity`` bytes; a document is split only if it is larger. Repeated rows are packed
    each, rows with a null doc_id too. An empty table gives an empty result; other columns are ignored.
    """
    # the row's own number spreads even repeated ids over all shards
    pieces = written(document_pieces(documents, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("size") < capacity)
    shards = max(1, -(-loose.count() // shard_items))
    grouped = loose.groupBy(F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "piece", "offset"))).alias("items"))
    grouped = written(grouped, "shards")
    state = grouped.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("population"))

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    sizes = np.array(r.sizes, np.int64)
                    rng = np.random.default_rng([int(r.shard), int(r.island), number])
                    population = []
                    for bins in r.population if r.population is not None else []:
                        of = np.array(bins, np.int32)
                        population.append(Packing(of, np.bincount(of, sizes).astype(int).tolist()))
                    best = evolve(sizes, population, capacity, rng, GENERATIONS, POPULATION)
                    keep = [p.bin_of.tolist() for p in best]
                    out.append((r.shard, r.island, r.sizes, keep, best[0].fitness(capacity)))
                yield pd.DataFrame(out, columns=["shard", "island", "sizes", "population", "fitness"])

        return run

    schema = "shard long, island int, sizes array<int>, population array<array<int>>, fitness double"
    tasks = max(1, min(shards * islands, 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    state = state.repartition(tasks, "shard", "island")
    for e in range(epochs):
        state = state.mapInPandas(epoch(e), schema)
        if e < epochs - 1:
            stay = state.select("shard", "island", "sizes", "population")
            guests = F.struct(((F.col("island") + 1) % islands).alias("island"), F.slice("population", 1, ELITE).alias("population"))
            home = F.struct(F.col("island").alias("island"), F.col("population").alias("population"))
            sent = stay.select("shard", "sizes", F.explode(F.array(home, guests)).alias("s")).select("shard", "s.island", "sizes", "s.population")
            state = sent.groupBy("shard", "island").agg(F.first("sizes").alias("sizes"), F.flatten(F.collect_list("population")).alias("population"))
    best = state.groupBy("shard").agg(F.max_by(F.element_at("population", 1), F.struct("fitness", F.negative("island"))).alias("bins"))
    placed = (
        grouped.join(best, "shard")
        .select("shard", F.explode(F.arrays_zip("items", "bins")).alias("p"))
        .select("p.items.doc_id", "p.items.piece", "p.items.offset", "p.items.size", F.concat(F.lit("s"), F.col("shard"), F.lit("-"), F.col("p.bins")).alias("container"))
    )
    full = pieces.where(F.col("size") == capacity).select("doc_id", "piece", "offset", "size", F.concat(F.lit("f"), F.col("_row").cast("string")).alias("container"))
    return placed.unionByName(full)
