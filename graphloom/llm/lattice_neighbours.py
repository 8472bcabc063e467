"""Near-duplicate embeddings by lattice hashing.

Each table projects a vector to eight dimensions at random and decodes the point to the nearest point of the
E8 lattice, its home cell. A vector also probes the neighbouring cells whose centres are closest to its
projection. Two vectors are compared if one's home is among the cells that the other probes, by cosine in
double precision; how many links are found depends on tables, probes and scale, none below the threshold is.

Vectors that are equal are one node with a multiplicity. In a cell the homes are dealt over blocks of bounded
size and the probing vectors stream past each block, so a cell with a third of all vectors is many small
tasks. A pair counts in the first table in which it meets, which both vectors' cell codes tell, so links are
counted where they are found and pairs are never written; a block hands on a count per vector and just
enough links to keep what it connects connected.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a
null id, have no links and are components of their own; vectors of different length are never compared; rows
that repeat id and vector are copies; rows that repeat an id with another vector are vectors of their own,
not compared with each other. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import components


def _roots() -> np.ndarray:
    """The 240 neighbours of a lattice point."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and where the sum is odd, the worst coordinate the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half in every coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _codes(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """32-bit codes of lattice points, different in every table."""
    h = np.full(points.shape[:-1], table * 7919 + dim, np.uint64)
    twice = (2 * points).astype(np.int64).view(np.uint64)
    for k in range(8):
        h = (h ^ twice[..., k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(16)).astype(np.uint32).view(np.int32)


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Cell codes of unit vectors, (vectors, tables, 1 + probes); the first is the home cell."""
    n, dim = x.shape
    out = np.empty((n, tables, 1 + probes), np.int32)
    for t in range(tables):
        y = x @ (np.random.default_rng([seed, t, dim]).standard_normal((dim, 8)) * scale)
        home = nearest_e8(y)
        # |y - home - root|^2 is smallest where (y - home) . root - |root|^2 / 2 is largest; all roots are equally long.
        close = np.argpartition(-((y - home) @ ROOTS.T), probes, axis=1)[:, :probes]
        out[:, t] = _codes(np.concatenate([home[:, None], home[:, None] + ROOTS[close]], 1), t, dim)
    return out


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _coded(nodes: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """``nodes`` (node, copies, embedding) with ``cells``: the codes of all tables, home first."""
    width = tables * (1 + probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                vectors = [v.values.to_numpy(zero_copy_only=False) for v in _column(batch, "embedding")]
                codes = np.empty((len(vectors), width), np.int32)
                dims = np.array([len(v) for v in vectors])
                for d in np.unique(dims):
                    at_d = np.flatnonzero(dims == d)
                    codes[at_d] = cells(_unit([vectors[i] for i in at_d]), tables, probes, scale, seed).reshape(len(at_d), width)
                ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))],
                                                 names=[*batch.schema.names, "cells"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.mapInArrow(run, f"node long, copies long, embedding {kind}, cells array<int>")


class _Block:
    """The homes of one block, and a union-find over them."""

    def __init__(self, table: int, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, homes: np.ndarray):
        self.table, self.ids, self.copies, self.x, self.homes = table, ids, copies, x, homes
        self.links = np.zeros(len(ids), np.int64)
        self.up = list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def meet(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, probed: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(vector, links, link a, link b) for vectors that probe the cell; links to larger ids, where first met."""
        hit = (x @ self.x.T >= least) & (ids[:, None] < self.ids[None])
        for t in range(self.table):
            rows = np.flatnonzero(hit.any(1))
            if len(rows):
                hit[rows] &= ~(probed[rows, t, :, None] == self.homes[None, None, :, t]).any(1)
        self.links += hit.T @ copies
        for r in np.flatnonzero(hit.any(1)):
            found = np.flatnonzero(hit[r])
            first = int(found[0])
            yield int(ids[r]), int(self.copies[found].sum()), int(ids[r]), int(self.ids[first])
            for f in found[1:]:
                a, b = self.root(first), self.root(int(f))
                if a != b:
                    self.up[b] = a
                    yield int(ids[r]), 0, int(ids[r]), int(self.ids[f])


def _compare(tables: int, probes: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, homes = None, None, []
        for whole in batches:
            out: list[tuple] = []
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = np.stack([_column(batch, c).to_numpy() for c in ("table", "code", "block", "dim")], 1).astype(np.int64)
                role = _column(batch, "role").to_numpy()
                ids, copies = _column(batch, "node").to_numpy(), _column(batch, "copies").to_numpy()
                codes = _column(batch, "cells").flatten().to_numpy().reshape(len(ids), tables, 1 + probes)
                vectors = _column(batch, "embedding")
                change = (keys[1:] != keys[:-1]).any(1) | (role[1:] != role[:-1])
                cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    key = tuple(keys[a])
                    if key != place:
                        if block is not None:
                            out += [(int(i), int(n), None, None) for i, n in zip(block.ids, block.links) if n]
                        block, place, homes = None, key, []
                    x = _unit([vectors[i].values.to_numpy(zero_copy_only=False) for i in range(a, b)])
                    if role[a] == 0:
                        homes.append((ids[a:b], copies[a:b], x, codes[a:b, :, 0]))
                    elif homes or block is not None:
                        if block is None:
                            block = _Block(key[0], *(np.concatenate(c) for c in zip(*homes)))
                            homes = []
                        out += block.meet(ids[a:b], copies[a:b], x, codes[a:b], least)
            yield _counted(out)
        if block is not None:
            yield _counted([(int(i), int(n), None, None) for i, n in zip(block.ids, block.links) if n])

    return run


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 4)], names=["node", "n", "a", "b"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, tables: int = 6,
                    probes: int = 6, scale: float = 0.8, seed: int = 17, block: int = 1024) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector; ``kept`` marks the smallest id of each component."""
    rows = vectors.select(F.col(key), F.col(embedding).alias("embedding"))
    good = (F.col(key).isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
            & F.exists("embedding", lambda v: v != 0))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    nodes = rows.filter("good").groupBy("embedding").agg(F.min(key).cast("long").alias("node"), F.count("*").alias("copies"))
    coded = stored(_coded(nodes.select("node", "copies", "embedding"), tables, probes, scale, seed), "coded")
    entry = F.posexplode("cells")
    entries = coded.select("node", F.size("embedding").alias("dim"), entry.alias("pos", "code")).select(
        "node", "dim", "code", F.floor(F.col("pos") / (1 + probes)).cast("int").alias("table"), (F.col("pos") % (1 + probes)).alias("probe"))
    cell = ["table", "code", "dim"]
    sizes = entries.filter("probe = 0").groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("node").alias("only"), F.max("node").alias("most"))
    entries = entries.join(sizes, cell).filter("node < most OR probe = 0")  # nobody larger at home: nothing to find
    queries = entries.filter("node < most").select("node", *cell, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"))
    homes = entries.filter("probe = 0").select("node", *cell, F.pmod(F.hash("node"), "blocks").alias("block"), F.lit(0).alias("role"))
    visits = homes.unionByName(queries).join(coded, "node")
    visits = visits.repartition(*cell, "block").sortWithinPartitions(*cell, "block", "role", "node")
    found = stored(visits.select(*cell, "block", "role", "node", "copies", "embedding", "cells").mapInArrow(
        _compare(tables, probes, least), "node long, n long, a long, b long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("a IS NOT NULL"))
    nodes = stored(coded.select("node", "embedding", "copies").join(counts, "node", "left").join(roots, "node", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")), "nodes")
    linked = rows.filter("good").drop("good").join(nodes, "embedding").select(key, "n", "root")
    alone = rows.filter("NOT good").select(key, F.lit(0).cast("long").alias("n"), F.col(key).cast("long").alias("root"))
    return linked.unionByName(alone).select(
        key, F.col("n").alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col(key) == F.col("root"), F.lit(False)).alias("kept"))
