"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors has a codebook of its own; pairs of codewords form a grid of
cells, and each vector is stored in one cell. A search goes through the cells in the
order of the summed distances of both halves and stops after so many that the target
recall is met. All vectors are searched, and what the visited cells hold is verified by
the exact cosine. A pair counts for both vectors, whichever of the two searches met it.

Cells are dealt into blocks of bounded size, neighbouring codewords together; a cell that
is larger is split over several. A task holds one block ordered by cell, and the searches
that visit some of its cells stream past and are compared with these cells only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm.common import connected_components, discard, durable, lean

#: Vectors that the codebooks are fitted on and their bytes at most, and vectors that the number of cells is set by.
SAMPLE_ROWS, SAMPLE_BYTES, TRIAL_ROWS = 20_000, 64 << 20, 1_000
#: Vectors of a block.
BLOCK_ROWS = 8_192
#: Codewords of a half at most; there are at most so many cells, squared, whose counts the driver holds.
MOST_WORDS = 1_024
#: Numbers of a search's work table at a time.
WORK = 4_000_000
TARGET_RECALL = 0.98


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; codewords in the order of their first principal component."""
    rng = np.random.default_rng(1)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    middle = c - c.mean(0)
    return c[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


class MultiIndex:
    def __init__(self, sample: np.ndarray, rows: int, least: float):
        """sample: unit vectors; rows: how many vectors there are in all; least: the cosine that counts."""
        self.half = sample.shape[1] // 2
        self.k = int(np.clip(np.sqrt(rows / 4), 2, MOST_WORDS))
        self.books = codebook(sample[:, : self.half], self.k), codebook(sample[:, self.half :], self.k)
        self.visits = self.calibrate(sample[:TRIAL_ROWS], least)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def calibrate(self, x: np.ndarray, least: float) -> int:
        """Cells to visit so that a vector at just the least cosine, in a random direction, is met at the target recall."""
        rng = np.random.default_rng(2)
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(1)[:, None] * x
        u /= np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
        one, two = self.halves(x)
        at_one, at_two = (d.argmin(1) for d in self.halves(least * x + np.sqrt(1 - least**2) * u))
        rank = []
        for a, b, i, j in zip(one, two, at_one, at_two):
            b = np.sort(b)
            rank.append(int(np.searchsorted(b, a[i] + two[len(rank)][j] - a, side="right").sum()))
        return int(np.quantile(rank, TARGET_RECALL)) + 1

    def own(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector."""
        one, two = self.halves(x)
        return one.argmin(1) * self.k + two.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Cells that each vector's search visits, in ascending order.

        The multi-sequence order: of cells at places a and b of the two sorted lists, only
        those with (a + 1)(b + 1) at most the number of visits can be among the visited.
        """
        most = min(self.visits, self.k * self.k)
        a = np.repeat(np.arange(min(self.k, most)), np.minimum(self.k, most // (np.arange(min(self.k, most)) + 1)))
        b = np.arange(len(a)) - np.searchsorted(a, a)
        out, rows = np.empty((len(x), most), np.int32), max(1, WORK // len(a))
        for at in range(0, len(x), rows):
            one, two = self.halves(x[at : at + rows])
            by_one, by_two = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
            total = np.take_along_axis(one, by_one, 1)[:, a] + np.take_along_axis(two, by_two, 1)[:, b]
            near = np.argpartition(total, most - 1, 1)[:, :most]
            out[at : at + rows] = np.take_along_axis(by_one, a[near], 1) * self.k + np.take_along_axis(by_two, b[near], 1)
        return np.sort(out, 1)

    def blocks(self, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block of each cell and how many it is spread over (0: nothing is stored there). Cells come in tiles of neighbouring codewords."""
        side = max(1, int(np.sqrt(self.k)))
        i, j = cells // self.k // side, cells % self.k // side
        order = np.lexsort((cells, j, i))
        first, parts = np.zeros(self.k * self.k, np.int32), np.zeros(self.k * self.k, np.int32)
        block, room = -1, 0
        for c, n in zip(cells[order].tolist(), counts[order].tolist()):
            if n > room:
                block, room = block + 1, BLOCK_ROWS
            first[c], parts[c] = block, max(1, -(-n // BLOCK_ROWS))
            room -= n
            if parts[c] > 1:
                block, room = block + int(parts[c]) - 1, 0
        return first, parts


def vector_components(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and component of each row of vectors: id, n_links, component_id, kept.

    Two rows link when their cosine, in double precision, is least or more and the index
    finds the pair; no pair below is linked. n_links counts other rows, copies included;
    component_id is the smallest id reachable by links, kept whether that is the row's own.
    One row comes out for each row that goes in. Vectors that are null, empty or zero, or
    hold null or non-finite components, and rows with a null id, link with nothing; so do
    vectors of different lengths. Rows of one id are rows on their own. Other columns are
    left out.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def read(batches):
        for b in batches:
            lo, hi, size, unit = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.array([np.nan if y is None else y for y in x or ()], np.float64)
                peak = np.abs(v).max() if len(v) else 0
                if i is None or not np.isfinite(peak) or not peak:
                    key, v = None, None
                else:
                    v = v / peak
                    v = v / np.sqrt((v * v).sum())
                    key = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), "<i8")
                lo.append(None if key is None else int(key[0]))
                hi.append(None if key is None else int(key[1]))
                size.append(0 if v is None else len(v))
                unit.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(size, pa.int32()), pa.array(unit, pa.binary())], ["id", "lo", "hi", "size", "unit"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(lean(read), f"id {kind}, lo long, hi long, size int, unit binary")
    rows = durable(rows)
    nodes = rows.where("lo IS NOT NULL").groupBy("lo", "hi").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("unit").alias("unit"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    found, used = None, []
    for size, n in nodes.groupBy("size").count().orderBy("size").collect():
        own = nodes.where(F.col("size") == size)
        sample = own.orderBy(F.xxhash64("lo"), "lo", "hi").limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * size)))).select("unit").collect()
        index = MultiIndex(np.stack([np.frombuffer(r.unit) for r in sample]), n, least)
        part, placed = search(own, index, least)
        used.append(placed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = durable(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    group = nodes.join(component, "node", "left").select("node", "first", "copies", "lo", "hi", F.coalesce("component", "node").alias("component"))
    lowest = group.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = group.join(lowest, "component").join(links, "node", "left").select("lo", "hi", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = rows.select("id", "lo", "hi").join(durable(facts), ["lo", "hi"], "left")
    discard(nodes, found, component, *used)
    component_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def search(nodes: DataFrame, index: MultiIndex, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, links, other): rows linked with each node, in parts; and enough pairs of linked nodes to join all that are linked. Also the table that this reads."""

    def place(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = np.stack([np.frombuffer(u) for u in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(index.own(x).astype(np.int32)), pa.array(list(index.visited(x)), pa.list_(pa.int32()))], ["node", "copies", "unit", "cell", "cells"])

    placed = durable(nodes.select("node", "copies", "unit").mapInArrow(lean(place), "node long, copies long, unit binary, cell int, cells array<int>"))
    held = placed.groupBy("cell").count().collect()  # one number for each cell that is in use
    first, parts = index.blocks(np.array([r.cell for r in held]), np.array([r["count"] for r in held]))

    def deal(batches):
        """Each vector to the block of its cell (asks = 0), and its search to the blocks of the cells it visits, with these cells."""
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                node, cell = part.column(0).to_numpy(), part.column(3).to_numpy()
                visits = np.stack(part.column(4).to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(len(node)), visits.shape[1])
                cells = visits.ravel()
                row, cells = np.repeat(row, parts[cells]), np.repeat(cells, parts[cells])
                block = first[cells] + (np.arange(len(cells)) - np.maximum.accumulate(np.where(np.r_[True, (cells[1:] != cells[:-1]) | (row[1:] != row[:-1])], np.arange(len(cells)), 0)) if len(cells) else 0)
                order = np.lexsort((cells, row, block))
                row, cells, block = row[order], cells[order], block[order]
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)
                stored = first[cell] + (node * 0x9E3779B1 >> 7) % parts[cell]
                take = pa.array(np.r_[np.arange(len(node)), row[start]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(len(node)) * visits.shape[1], visits.size + start, visits.size + len(cells)].astype(np.int32)), pa.array(np.r_[visits.ravel(), cells].astype(np.int32)))
                asks = np.r_[np.zeros(len(node), np.int32), np.ones(len(start), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[stored, block[start]].astype(np.int32)), pa.array(asks), *[part.column(k).take(take) for k in range(4)], lists], ["block", "asks", "node", "copies", "unit", "cell", "cells"])

    def verify(batches):
        for held, asked in blocks_of(batches):
            node, copies, cell, visits, x = held
            root = list(range(len(node)))

            def find(a: int, root=root) -> int:
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                return a

            for who, times, own, cells, unit in asked:
                row = np.repeat(np.arange(len(who)), [len(c) for c in cells])
                flat = np.concatenate(cells)
                order = np.argsort(flat, kind="stable")
                row, flat = row[order], flat[order]
                q, b = [], []
                for s, e in zip(start := np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]), np.r_[start[1:], len(flat)]):
                    lo, hi = np.searchsorted(cell, flat[s]), np.searchsorted(cell, flat[s], side="right")
                    if lo < hi:
                        near = unit[row[s:e]] @ x[lo:hi].T >= least
                        near &= who[row[s:e], None] != node[lo:hi]
                        i, j = np.nonzero(near)
                        q.append(row[s:e][i])
                        b.append(lo + j)
                if not q or not len(q := np.concatenate(q)):
                    continue
                b = np.concatenate(b)
                yield found(who, np.bincount(q, copies[b], len(who)))
                alone = np.concatenate([~(visits[b[k : k + 4096]] == own[q[k : k + 4096], None]).any(1) for k in range(0, len(q), 4096)])  # the other search doesn't come by here
                if alone.any():
                    yield found(node, np.bincount(b[alone], times[q[alone]], len(node)))
                order = np.lexsort((b, q))
                q, b = q[order], b[order]
                to = b[np.flatnonzero(np.r_[True, q[1:] != q[:-1]])]
                pairs = np.unique(np.stack([np.repeat(to, np.diff(np.r_[np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), len(q)])), b], 1), axis=0)
                for i, j in pairs.tolist():
                    i, j = find(i), find(j)
                    root[max(i, j)] = min(i, j)
                yield linked(who[q[np.flatnonzero(np.r_[True, q[1:] != q[:-1]])]], node[to])
            top = np.array([find(i) for i in range(len(root))], np.int64)
            moved = np.flatnonzero(top != np.arange(len(top)))
            if len(moved):
                yield linked(node[moved], node[top[moved]])

    def found(node, links):
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], ["node", "links", "other"])

    def linked(node, other):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.zeros(len(node), np.int64)), pa.array(other)], ["node", "links", "other"])

    dealt = placed.mapInArrow(lean(deal), "block int, asks int, node long, copies long, unit binary, cell int, cells array<int>").repartition("block").sortWithinPartitions("block", "asks", "cell")
    return dealt.mapInArrow(lean(verify), "node long, links long, other long"), placed


def blocks_of(batches):
    """For each block what it holds (nodes, copies, cells, visited cells, vectors, ordered by cell) and a generator of the searches that visit it."""
    rows = parts_of(batches)
    ahead = next(rows, None)
    while ahead:
        block, held = ahead[0], []
        while ahead and ahead[0] == block and not ahead[1]:
            held.append(ahead[2])
            ahead = next(rows, None)

        def asked():
            nonlocal ahead
            while ahead and ahead[0] == block:
                part = ahead[2]
                for at in range(0, part.num_rows, 1024):
                    node, copies, cell, cells, unit = columns_of(part.slice(at, 1024))
                    yield node, copies, cell, cells, unit
                ahead = next(rows, None)

        if held:
            node, copies, cell, cells, unit = columns_of(pa.concat_batches(held))
            yield (node, copies, cell, np.stack(cells), unit), asked()
        for _ in asked():  # what is left
            pass


def columns_of(part):
    return part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(5).to_numpy(), part.column(6).to_numpy(zero_copy_only=False), np.stack([np.frombuffer(u) for u in part.column(4).to_pylist()])


def parts_of(batches):
    """(block, asks, rows) for each run of equal ones in batches sorted by both."""
    for b in batches:
        keys = np.stack([b.column(k).to_numpy() for k in range(2)])
        start = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if b.num_rows else []
        for a, z in zip(start, [*start[1:], b.num_rows]):
            yield int(keys[0, a]), int(keys[1, a]), b.slice(a, z - a)
