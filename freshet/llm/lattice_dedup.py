"""Near-duplicate vectors by lattice hashing.

Several tables each project the unit vectors at random to blocks of eight dimensions and
decode every block to the nearest point of the E8 lattice; the points of all blocks are
the vector's cell. A vector also probes neighbouring cells, where one block moves by one
of the 240 shortest lattice vectors to the next nearest point. Vectors that meet in a
cell, one of them at home there, are compared by cosine in double precision.

Counts of links are made where vectors meet: a pair counts only in the first of the
cells where it meets, which both vectors' own cells tell, so no pair leaves its task.

Equal vectors are one class throughout: its smallest id stands for it, and the number
of its copies is added wherever it links.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .bytes_table import U, mixed
from .common import components, keyed_runs, matrices, session_of, staged, starts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = 14
BLOCKS = 3
SCALE = 2.1
PROBES = 8
SEED = 20
NONE = np.iinfo(np.int64).max
#: Vectors of a cell that are compared in one go; a fuller cell is dealt to several tasks.
CELL_PART = 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) / 2 for v in itertools.product((1.0, -1.0), repeat=8) if np.prod(v) > 0]
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(axis=1) % 2)
    off = (x - y)[odd]
    worst = np.abs(off).argmax(axis=1)
    y[odd, worst] += np.where(off[np.arange(len(odd)), worst] < 0, -1.0, 1.0)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by a half (Conway and Sloane, 1982)."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Lattice:
    """Cells of unit vectors: ``cells[i, t]`` has vector i's cell in table t, then its probes."""

    def __init__(self, dims: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES):
        rng = np.random.default_rng(SEED)
        self.blocks, self.probes = blocks, probes
        width = 8 * blocks
        self.projections = []
        for _ in range(tables):
            g = rng.normal(size=(dims, max(width, 1)))
            if dims >= width:
                g = np.linalg.qr(g)[0] * np.sqrt(dims / width)
            else:
                g /= np.sqrt(width)
            self.projections.append(g * scale)
        self.roots = roots()
        self.codes = mixed(rng.integers(0, 2**63, size=(tables, width), dtype=np.int64).view(np.uint64)) | U(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.projections), 1 + self.probes), dtype=np.int64)
        for i in range(0, len(x), 512):
            out[i : i + 512] = self.some(x[i : i + 512])
        return out

    def some(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.projections), 1 + self.probes), dtype=np.uint64)
        for t, projection in enumerate(self.projections):
            y = (x @ projection).reshape(-1, 8)
            point = nearest_e8(y)
            lean = (y - point) @ self.roots.T
            p = self.probes
            best = np.argpartition(-lean, p - 1, axis=1)[:, :p] if p else np.zeros((len(y), 0), int)
            gain = np.take_along_axis(lean, best, axis=1).reshape(len(x), -1)
            codes = self.codes[t].reshape(self.blocks, 8)
            home = (np.rint(2 * point).astype(np.int64).view(np.uint64).reshape(len(x), self.blocks, 8) * codes).sum(axis=(1, 2), dtype=np.uint64)
            out[:, t, 0] = home
            if p:
                block = np.repeat(np.arange(self.blocks), p)
                top = np.argsort(-gain, axis=1, kind="stable")[:, :p]
                root = np.take_along_axis(best.reshape(len(x), -1), top, axis=1)
                steps = np.rint(2 * self.roots).astype(np.int64).view(np.uint64)
                out[:, t, 1:] = home[:, None] + (steps[root] * codes[block[top]]).sum(axis=2, dtype=np.uint64)
        return mixed(out).view(np.int64)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_rows(vectors: DataFrame, tables: int, blocks: int, scale: float, probes: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        lattices: dict[int, Lattice] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for at, x in matrices(batch.column("embedding")):
                dims = x.shape[1]
                if dims not in lattices:
                    lattices[dims] = Lattice(dims, tables, blocks, scale, probes)
                cells = lattices[dims](units(x)).reshape(len(x), -1)
                cells += dims
                home = np.zeros(cells.shape, dtype=bool)
                home[:, :: 1 + probes] = True
                owner = np.repeat(ids[at], cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(owner), pa.array(home.ravel())], ["cell", "vec_id", "home"])

    return vectors.mapInArrow(run, "cell long, vec_id long, home boolean")


def met(parts: DataFrame, cosine: float, tables: int, blocks: int, scale: float, probes: int) -> DataFrame:
    """Per cell part: (a, n, null) counts of links first met here, and (a, null, b) trees over linked vectors."""

    def run(batches):
        import pyarrow as pa

        lattices: dict[int, Lattice] = {}
        for table in keyed_runs(batches, ["cell", "i", "j"], 60_000):
            cell, i, j = (table[c].to_numpy() for c in ("cell", "i", "j"))
            part, ids = table["part"].to_numpy(), table["vec_id"].to_numpy()
            home = table["home"].combine_chunks().to_numpy(zero_copy_only=False)
            vectors, copies = table["embedding"].combine_chunks(), table["copies"].to_numpy()
            # a cell holds vectors of one dimension, for the dimension is part of its code
            place, unit = np.zeros(len(cell), dtype=np.int64), {}
            for at, y in matrices(vectors):
                place[at], unit[y.shape[1]] = np.arange(len(at)), units(y)
            dims_of = vectors.value_lengths().to_numpy(zero_copy_only=False)
            pairs = []
            edges = np.append(starts_of(cell, i, j), len(cell))
            for first, last in zip(edges[:-1], edges[1:]):
                here = home[first:last]
                if last - first < 2 or not here.any():
                    continue
                x = unit[dims_of[first]][place[first:last]]
                linked = x @ x.T >= cosine - 1e-9
                linked &= here[:, None] | here[None, :]
                if i[first] != j[first]:
                    side = part[first:last]
                    linked &= side[:, None] != side[None, :]
                one, two = np.nonzero(np.triu(linked, 1))
                if len(one):
                    exact = (x[one] * x[two]).sum(axis=1) >= cosine
                    pairs.append(np.stack([one[exact], two[exact]]) + first)
            pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
            names, used = np.unique(ids[pairs.ravel()], return_index=True)
            used = pairs.ravel()[used]
            owner = np.searchsorted(names, ids[pairs])
            count, label = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
            for dims in np.unique(dims_of[used]) if len(used) else ():
                if dims not in lattices:
                    lattices[dims] = Lattice(int(dims), tables, blocks, scale, probes)
                own = np.flatnonzero(dims_of[used] == dims)
                cells = lattices[dims](unit[dims][place[used[own]]])
                cells += dims
                mine = np.flatnonzero(dims_of[pairs[0]] == dims)
                for k in range(0, len(mine), 1 << 14):
                    some = mine[k : k + (1 << 14)]
                    u, v = (np.searchsorted(own, owner[side, some]) for side in (0, 1))
                    met_at = np.full(len(some), NONE)
                    for s, t in ((u, v), (v, u)):
                        at_home = cells[s, :, :1]
                        hit = (cells[t] == at_home).any(axis=2)
                        met_at = np.minimum(met_at, np.where(hit, at_home[:, :, 0], NONE).min(axis=1))
                    new = met_at == cell[pairs[0, some]]
                    for side in (0, 1):
                        theirs = copies[pairs[1 - side, some[new]]]
                        count += np.bincount(owner[side, some[new]], theirs, len(names)).astype(np.int64)
            while True:
                low = label.copy()
                np.minimum.at(low, owner[0], label[owner[1]])
                np.minimum.at(low, owner[1], label[owner[0]])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            seen, moved = count > 0, label != np.arange(len(names))
            a = np.concatenate([names[seen], names[moved]])
            n = np.concatenate([count[seen], np.zeros(moved.sum(), dtype=np.int64)])
            b = np.concatenate([np.full(seen.sum(), NONE), names[label[moved]]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(b, mask=b == NONE)], ["a", "n", "b"])

    dealt = parts.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(run, "a long, n long, b long")


def can_link(vector_col: str) -> Column:
    """Whether a vector has components, all of them finite, and one that is not zero."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector_col, lambda x: x != 0), F.lit(False))


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
    tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES,
) -> DataFrame:
    """Vectors linked by a cosine of ``cosine`` or more: vec_id, n_links, component_id, kept.

    Cosines are taken in double precision. Vectors that are null, empty, zero or hold a
    null or non-finite component, and vectors of another dimension, link with nothing.
    One row is returned for each id; rows that repeat an id are one vector, the least of
    them. Equal vectors always link. Rows without an id are returned as they come, with no links, a null component and
    kept false. Other columns are ignored; an empty table gives an empty result.
    """
    session_of(vectors)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    named = staged(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    usable = named.where(can_link("embedding"))
    classes = staged(usable.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    args = (tables, blocks, scale, probes)
    cells = staged(cell_rows(classes, *args), "cells")
    full = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    live = cells.join(full.select("cell", F.ceil(F.col("n") / CELL_PART).cast("int").alias("g")), "cell")
    live = live.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("g")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    live = live.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "home", "vec_id")
    found = staged(met(live.join(classes, "vec_id"), cosine, *args), "met")
    counts = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("vertex", "class")
    facts = classes.select("embedding", F.col("vec_id").alias("class"), "copies").join(counts, "class", "left").join(joined, "class", "left")
    linked = usable.join(facts, "embedding").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    alone = named.where(~can_link("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.col("component_id") == F.col("vec_id"))
    return out.union(rows.where("vec_id is null").select(
        "vec_id", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(False)))
