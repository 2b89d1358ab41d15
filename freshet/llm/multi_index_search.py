"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of vectors after rotations learned by iterative quantization (Gong and
Lazebnik, 2011) on a bounded sample. A code is split into substrings, and each block of
rows indexes every substring. Two codes within a radius of R bits differ by no more than
R // m bits in one of the m substrings, and by one less in another set of them (Norouzi,
Punjani and Fleet, 2012), so looking up the substrings in reach finds every code in the
radius. What is found is ranked by the inner product of the vectors themselves.

Each query has its own radius: the one that takes in a given share of a bounded sample.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .common import matrices, session_of, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that rotations and radii are fitted on, at most.
SAMPLE = 4096
SUBSTRINGS = 10
SUBSTRING_BITS = 12
#: Share of the rows whose codes a query's radius is to take in, and the least number of them.
SHARE = 0.2
LEAST = 1500
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
SEED = 7


def of_dimension(column, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and matrix of the vectors that take part; by default of the most frequent dimension."""
    found = [(at, x) for at, x in matrices(column) if dims is None or x.shape[1] == dims]
    return max(found, key=lambda f: len(f[0]), default=(np.zeros(0, dtype=np.int64), np.zeros((0, dims or 0))))


def learned_rotations(x: np.ndarray, bits: int, steps: int = 20) -> np.ndarray:
    """Directions whose signs are the code: rotations that bring the sample near its own signs."""
    rng = np.random.default_rng(SEED)
    out, dims = [], x.shape[1]
    while sum(r.shape[1] for r in out) < bits:
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.sign(x @ rotation).T @ x)
            rotation = (u @ v).T
        out.append(rotation)
    return np.concatenate(out, axis=1)[:, :bits]


def substrings(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """The code of each vector as whole numbers, one for each substring."""
    signs = (x @ rotations > 0).reshape(len(x), SUBSTRINGS, SUBSTRING_BITS)
    return (signs << np.arange(SUBSTRING_BITS)).sum(axis=2).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)


def flips() -> tuple[np.ndarray, np.ndarray]:
    """All substrings by the number of bits set, and where each number begins."""
    every = np.arange(1 << SUBSTRING_BITS)
    count = np.bitwise_count(every)
    order = np.argsort(count, kind="stable")
    return every[order], np.searchsorted(count[order], np.arange(SUBSTRING_BITS + 2))


class BlockIndex:
    """The substrings of a block of rows, each value with the rows that have it."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        values = np.arange((1 << SUBSTRING_BITS) + 1)
        self.starts = [np.searchsorted(codes[self.order[:, m], m], values) for m in range(SUBSTRINGS)]
        self.flips, self.by_count = flips()

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius."""
        reach, more = divmod(radius, SUBSTRINGS)
        found = np.zeros(len(self.codes), dtype=bool)
        for m in range(SUBSTRINGS):
            bits = reach if m <= more else reach - 1
            if bits < 0:
                continue
            near = self.flips[: self.by_count[min(bits, SUBSTRING_BITS) + 1]] ^ code[m]
            first, last = self.starts[m][near], self.starts[m][near + 1]
            some = last > first
            first, n = first[some], (last - first)[some]
            if not len(n):
                continue
            at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found[self.order[at, m]] = True
        rows = np.flatnonzero(found)
        return rows[distances(self.codes[rows], code) <= radius]


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20,
    share: float = SHARE,
) -> DataFrame:
    """The ``k`` nearest found rows of each query, by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id ``every`` divides; candidates are all rows but the
    query's own id. Scores are in double precision on the vectors as given; ties go to
    the smaller id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without an id or of another dimension than most
    of the sample. Rows that repeat an id are one vector, the least of them. A table
    with fewer candidates gives all of them; an empty one gives an empty result.
    """
    spark = session_of(vectors)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = staged(rows, "vectors")
    total = rows.count()
    mark = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1_000_000))
    fitted = rows.where(mark < int(1_000_000 * min(1.0, 0.9 * SAMPLE / max(total, 1))) + 1).limit(SAMPLE)
    _, sample = of_dimension(fitted.select("embedding").toArrow()["embedding"])
    if not len(sample):  # too few rows for the share, or none that takes part
        _, sample = of_dimension(rows.select("embedding").limit(SAMPLE).toArrow()["embedding"])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, bits = sample.shape[1], SUBSTRINGS * SUBSTRING_BITS
    rotations = learned_rotations(sample, bits)
    reach = max(share, min(1.0, LEAST / total))
    sent = spark.sparkContext.broadcast((rotations, substrings(sample, rotations)))
    n_blocks = max(1, -(-total // ROWS_PER_BLOCK))
    n_queries = max(1, -(-total // (every * QUERIES_PER_BLOCK)))
    asked = F.col("vec_id") % every == 0
    # every block of queries meets every block of rows
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).withColumn("asked", F.lit(False))
    asking = rows.where(asked).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(n_queries)).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("asked", F.lit(True))
    both = blocks.select("block", "part", "asked", "vec_id", "embedding").union(
        asking.select("block", "part", "asked", "vec_id", "embedding"))

    def search(table):
        import pyarrow as pa

        rotations, sampled = sent.value
        keep, x = of_dimension(table["embedding"], dims)
        is_query = table["asked"].to_numpy()[keep]
        ids = table["vec_id"].to_numpy()[keep]
        data, own, queries, names = x[~is_query], ids[~is_query], x[is_query], ids[is_query]
        out_q, out_v, out_s = [], [], []
        if len(data) and len(queries):
            order = np.argsort(own)
            data, own = data[order], own[order]
            index = BlockIndex(substrings(data, rotations))
            wanted = min(len(sampled) - 1, int(np.ceil(reach * len(sampled))))
            for q, name, code in zip(queries, names, substrings(queries, rotations)):
                if reach >= 1:
                    radius = SUBSTRINGS * SUBSTRING_BITS
                else:
                    radius = int(np.partition(distances(sampled, code), wanted)[wanted])
                found = index.within(code, radius)
                found = found[own[found] != name]
                if not len(found):
                    continue
                score = data[found] @ q
                if len(found) > k:
                    found = found[score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9]
                score = (data[found] * q).sum(axis=1)
                best = np.lexsort((own[found], -score))[:k]
                out_q.append(np.full(len(best), name))
                out_v.append(own[found[best]])
                out_s.append(score[best])
        empty = [np.zeros(0, np.int64)]
        return pa.table({
            "query_id": np.concatenate(out_q or empty), "vec_id": np.concatenate(out_v or empty),
            "score": np.concatenate(out_s or [np.zeros(0)])})

    found = both.groupBy("block", "part").applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
