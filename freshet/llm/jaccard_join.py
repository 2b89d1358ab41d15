"""Exact Jaccard join of documents on word shingles, as a join in a metric space.

Jaccard distance is a metric, and three kinds of pivots divide its space:

1. *Single shingles.* A text is at distance below 1 from the pivot {s} only if it
   holds s. Texts fall into the regions of their first shingles in one global order
   (common ones last); a similarity of t makes 1 - t of them and one more suffice as
   a window, so that linked texts always meet in a region.
2. *Parts of the shingle space.* The counts of a text's shingles in K hashed parts are
   its coordinates; by the triangle inequality the difference of two texts is no
   smaller than that of their coordinates. A region falls apart where
   coordinates are too far from each other.
3. *Texts.* What hangs together after that is a cluster. Within it texts are pivots:
   each text belongs to the Voronoi region of its nearest pivot, and to every region
   whose pivot is no more than twice the threshold farther away, so that linked texts
   share a region; regions are joined recursively. A region that does not shrink, or a
   small one, peels off some pivots: with m the distance of the nearest text beyond the
   threshold r, only texts at m - r or more can still link outwards. Texts that already
   hang together need no further test; those outside the largest component are then
   measured against all in blocks, whose intersections are matrix products.

Clusters of bounded size are joined in one task each. A larger one is cut into blocks:
two rounds measure all texts against a few pivots, then each block of those that still
lie outside the largest component meets each block of the cluster in a task.

Equal sets are one class throughout, so copies cost one row each.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .bytes_table import U, WordTable, flat_texts, mixed, rows_per_text, slices
from .common import bitmap, components, discard, in_bitmap, keyed_runs, session_of, staged, starts_of, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLD = U(0x2545F4914F6CDD1D)
#: Shingles counted before a task reports the common ones.
COUNTED = 1 << 20
#: The common shingles put last in the order, at most; a bound on what is broadcast.
COMMON = 1 << 16
#: Regions of up to so many texts are divided by coordinates in one task.
LOCAL_REGION = 2048
#: Clusters of up to so many shingles, repeats included, are joined in one task.
LOCAL_SHINGLES = 1 << 22
#: Pivots of a larger cluster in one round, and rounds before its blocks are joined.
ROUND_PIVOTS = 32
PIVOT_ROUNDS = 2
#: Shingles in a block of a larger cluster, about; a text with more is a block.
BLOCK_SHINGLES = 1 << 21
#: Regions of up to so many texts are not divided by Voronoi regions.
WHOLE_REGION = 1024
#: Texts that a region peels off before the rest is measured in blocks.
PEELED = 8
#: Numbers in a matrix of a block, at most; the sides of a block are one text at least.
CELLS = 1 << 22
#: Numbers in the matrix of a region's most common shingles, at most.
DENSE_CELLS = 1 << 24
#: A text has about one coordinate per so many shingles.
SHINGLES_PER_PART = 8
#: Numbers in a table of folded coordinates, at most.
FOLDED = 1 << 20
#: Coordinates looked at first; each text has so many at least.
COARSE = 8


def shingle_sets(words: WordTable, data, bounds, size: int):
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    _, _, text, codes = words(data, bounds)
    at = rows_per_text(text, len(bounds) - 1)
    rolled = codes[: max(0, len(codes) - size + 1)].copy()
    for k in range(1, size):
        rolled = rolled * FOLD + codes[k : len(codes) - size + 1 + k]
    rolled = mixed(rolled)
    for i in range(len(bounds) - 1):
        first, last = at[i], at[i + 1]
        if last - first >= size:
            yield np.unique(rolled[first : last - size + 1])
        elif last > first:
            places = np.arange(last - first, dtype=np.uint64)
            whole = (codes[first:last] * mixed(FOLD + places)).sum(dtype=np.uint64)
            yield mixed(np.array([whole ^ mixed(places[-1:] + U(1))[0]], dtype=np.uint64))
        else:
            yield codes[:0]


def set_code(s: np.ndarray) -> np.int64:
    """A 64-bit hash of a set."""
    total = mixed(s + U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + U(len(s))
    return mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0]


def coordinates(s: np.ndarray) -> bytes:
    """Counts of the shingles in hashed parts of the shingle space, a power of two of them."""
    parts = COARSE
    while parts < 1 << 16 and parts * SHINGLES_PER_PART < len(s):
        parts *= 2
    counts = np.bincount((s & U(parts - 1)).astype(np.int64), minlength=parts)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(parts: np.ndarray, n: int) -> np.ndarray:
    return parts.reshape(-1, n).sum(axis=0, dtype=np.int64) if len(parts) > n else parts.astype(np.int64)


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, with their rank by count.

    They only order the shingles; the join is exact with any order. Every task
    counts all its documents and reports shingles that it met in several.
    """

    def count(batches):
        import pyarrow as pa

        words, held, n = WordTable(), [], 0

        def report():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            data, bounds = flat_texts(batch.column("text"))
            for first, last in slices(bounds):
                part = data[bounds[first] : bounds[last]]
                for s in shingle_sets(words, part, bounds[first : last + 1] - bounds[first], size):
                    held.append(s)
                    n += len(s)
            if n >= COUNTED:
                yield report()
                held, n = [], 0
        if held:
            yield report()

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    values = top["shingle"].to_numpy().view(np.uint64)
    rank = np.arange(len(values), 0, -1).astype(np.int64)
    order = np.argsort(values)
    return values[order], rank[order]


def profiles(docs: DataFrame, size: int, percent: int, values: np.ndarray, rank: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, set code, window of first shingles and coordinates of each text."""
    sent = docs.sparkSession.sparkContext.broadcast((values, rank))

    def run(batches):
        import pyarrow as pa

        words = WordTable()
        values, rank = sent.value
        for batch in batches:
            data, bounds = flat_texts(batch.column("text"))
            n, code, window, parts = [], [], [], []
            for first, last in slices(bounds):
                part = data[bounds[first] : bounds[last]]
                for s in shingle_sets(words, part, bounds[first : last + 1] - bounds[first], size):
                    n.append(len(s))
                    if not len(s):
                        code.append(None)
                        window.append(None)
                        parts.append(None)
                        continue
                    code.append(set_code(s))
                    keep = len(s) - -(-percent * len(s) // 100) + 1
                    parts.append(coordinates(s))
                    if len(values):
                        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        late = np.where(values[at] == s, rank[at], 0)
                        s = s[np.argsort(late, kind="stable")]
                    window.append(s[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(code, pa.int64()),
                 pa.array(window, pa.list_(pa.int64())), pa.array(parts, pa.binary())],
                ["doc_id", "n_shingles", "code", "window", "parts"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, code long, window array<long>, parts binary")


def regions_of(classes: DataFrame) -> DataFrame:
    """(region, code) of every region of a single shingle with two classes or more.

    Regions with the same members are taken once; membership is compared by count
    and two hashes, aggregated before the shuffle.
    """
    rows = classes.select(F.explode("window").alias("region"), "code")
    found = rows.groupBy("region").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("code")).alias("x"), F.bit_xor(F.hash("code")).alias("y"))
    once = found.where("n > 1").groupBy("n", "x", "y").agg(F.min("region").alias("region")).select("region", "n")
    return rows.join(once, "region")


def far_apart(gap, a, b, percent: int):
    """Whether sets of a and b elements that differ in ``gap`` or more are below the threshold."""
    return 100 * (a + b - gap) < percent * (a + b + gap)


def candidate_edges(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a tree over every group of a region that coordinates cannot divide.

    Regions of more than ``LOCAL_REGION`` texts stay whole; their tree is a star.
    """

    def run(batches):
        import pyarrow as pa

        for table in keyed_runs(batches, ["region"], 20_000):
            region = table["region"].to_numpy()
            size, code = table["size"].to_numpy(), table["code"].to_numpy()
            parts = table["parts"].to_pylist()
            a, b = [], []
            edges = np.append(starts_of(region), len(region))
            for first, last in zip(edges[:-1], edges[1:]):
                root = groups_by_coordinates(parts[first:last], size[first:last], percent)
                own = code[first:last]
                rows = np.flatnonzero(root != np.arange(last - first))
                a.append(own[rows])
                b.append(own[root[rows]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    local = members.where(F.col("n") <= LOCAL_REGION).select("region", "code", "size", "parts")
    local = local.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")
    large = members.where(F.col("n") > LOCAL_REGION)
    centre = large.groupBy("region").agg(F.min("code").alias("b"))
    large = large.join(centre, "region").where("code <> b").select(F.col("code").alias("a"), "b")
    return local.union(large).distinct()


def groups_by_coordinates(parts: list[bytes], size: np.ndarray, percent: int) -> np.ndarray:
    """Smallest index connected to each text by pairs that coordinates cannot part.

    A text is held against the texts before it, newest first and some at a time; texts
    that already hang together with it need no test. Coarse coordinates come before fine ones.
    """
    n = len(parts)
    root = np.arange(n)
    widths = np.array([len(p) for p in parts])
    raw = [np.frombuffer(p, np.uint8) for p in parts]
    coarse = np.array([folded(p, COARSE) for p in raw])
    tables: dict[int, np.ndarray] = {}

    def at(width: int, rows: np.ndarray) -> np.ndarray:
        """Coordinates of some texts that have ``width`` of them at least; kept if few."""
        if n * width > FOLDED:
            return np.array([folded(raw[j], width) for j in rows])
        if width not in tables:
            tables[width] = np.zeros((n, width), dtype=np.int32)
            for j in np.flatnonzero(widths >= width):
                tables[width][j] = folded(raw[j], width)
        return tables[width][rows]

    def near(i: int, some: np.ndarray) -> np.ndarray:
        some = some[~far_apart(np.abs(coarse[some] - coarse[i]).sum(axis=1), size[some], size[i], percent)]
        found = []
        finest = np.minimum(widths[some], widths[i])
        for width in np.unique(finest):
            same, own = some[finest == width], folded(raw[i], width)
            for first in range(0, len(same), max(1, FOLDED // width)):
                rows = same[first : first + max(1, FOLDED // width)]
                gap = np.abs(at(width, rows) - own).sum(axis=1)
                found.append(rows[~far_apart(gap, size[rows], size[i], percent)])
        return np.concatenate(found) if found else some

    for i in range(1, n):
        others = np.flatnonzero(100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i]))[::-1]
        step = 32
        while len(others):
            some, others = others[:step], others[step:]
            for hit in np.unique(root[near(i, some)]):
                low, high = sorted((hit, root[i]))
                root[root == high] = low
            if root[i] != i:
                others = others[root[others] != root[i]]
            step *= 8
    return root


def shingles_of(docs: DataFrame, codes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(code, shingles) of the listed set codes, from the documents that ``ids`` names.

    A bitmap of fixed size drops most other documents before any work is done on them.
    """
    spark = docs.sparkSession
    may = in_bitmap(spark, bitmap(ids), "doc_id")

    def run(batches):
        import pyarrow as pa

        words = WordTable()
        for batch in batches:
            data, bounds = flat_texts(batch.column("text"))
            for first, last in slices(bounds):
                part = data[bounds[first] : bounds[last]]
                sets = [s for s in shingle_sets(words, part, bounds[first : last + 1] - bounds[first], size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_code(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["code", "shingles"])

    found = may(docs).mapInArrow(run, "code long, shingles binary")
    return found.join(codes, "code", "left_semi").dropDuplicates(["code"])


class Cluster:
    """The metric join of the texts of one cluster."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        self.radius = 1 - percent / 100
        self.size = np.array([len(s) for s in sets])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(self.ids.max() + 1, dtype=np.int32)
        self.root = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def measure(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Distances of texts to a pivot; links found on the way join their components."""
        own = self.ids[self.ends[pivot] : self.ends[pivot + 1]]
        self.mark[own] = 1
        if 4 * len(rows) > len(self.size):
            both = np.add.reduceat(self.mark[self.ids], self.ends[:-1])[rows]
        else:
            both = np.array([self.mark[self.ids[self.ends[i] : self.ends[i + 1]]].sum() for i in rows])
        self.mark[own] = 0
        union = self.size[rows] + self.size[pivot] - both
        hits = rows[100 * both >= self.percent * union]
        for i in hits[self.root[hits] != self.root[pivot]]:
            self.link(int(i), pivot)
        return 1 - both / union

    def join(self, rows: np.ndarray) -> None:
        todo = [rows]
        while todo:
            rows = todo.pop()
            if len(rows) > WHOLE_REGION and len(np.unique(self.root[rows])) > 1:
                cells = self.voronoi(rows)
                if 2 * sum(len(cell) ** 2 for cell in cells) < len(rows) ** 2:
                    todo += cells
                    continue
            peeled = 0
            while len(rows) > 1 and len(np.unique(self.root[rows])) > 1:
                if peeled < PEELED or len(rows) <= 64:
                    rows = self.peeled(rows)
                    peeled += 1
                else:
                    names, counts = np.unique(self.root[rows], return_counts=True)
                    self.cross(rows[self.root[rows] != names[counts.argmax()]], rows)
                    break

    def voronoi(self, rows: np.ndarray) -> list[np.ndarray]:
        """Regions of the nearest of some distant pivots, with the texts in reach of each."""
        pivots, table = [int(rows[0])], []
        while True:
            table.append(self.measure(pivots[-1], rows))
            nearest = np.min(table, axis=0)
            if len(pivots) == 8 or nearest.max() <= 2 * self.radius:
                break
            pivots.append(int(rows[nearest.argmax()]))
        return [rows[row <= nearest + 2 * self.radius + 1e-9] for row in table]

    def peeled(self, rows: np.ndarray) -> np.ndarray:
        """The texts that may still link after all were measured against one pivot.

        The pivot is taken outside the largest component, whose texts need it least.
        """
        names, counts = np.unique(self.root[rows], return_counts=True)
        pivot = int(rows[self.root[rows] != names[counts.argmax()]][0])
        distance = self.measure(pivot, rows)
        outer = distance > self.radius + 1e-9
        if not outer.any():
            return rows[:0]
        live = distance >= distance[outer].min() - self.radius - 1e-9
        return rows[live & (rows != pivot)]

    def occurrences(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``rows`` and the ids of all shingles of these texts."""
        place = np.repeat(np.arange(len(rows)), self.size[rows])
        return place, self.ids[ranges(self.ends[rows], self.size[rows])]

    def cross(self, some: np.ndarray, rows: np.ndarray) -> None:
        """Join the components of all linked pairs of a text in ``some`` and one in ``rows``.

        Shingles that many of the rows hold are columns of a matrix, and a product counts
        those that two texts share; of the others, each pair that shares one is counted.
        """
        n = len(rows)
        place, ids = self.occurrences(rows)
        held = np.bincount(ids, minlength=len(self.mark))
        column = np.full(len(held), -1)
        common = np.argsort(-held, kind="stable")[: max(1, DENSE_CELLS // n)]
        common = common[8 * held[common] >= n]
        column[common] = np.arange(len(common))

        def matrix(place: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
            # whole numbers below 2 ** 24 are exact
            out = np.zeros((n, len(common)), dtype=np.float32 if self.size.max() < 1 << 24 else np.float64)
            at = column[ids]
            out[place[at >= 0], at[at >= 0]] = 1
            return out

        dense = matrix(place, ids, n).T
        place, ids = place[column[ids] < 0], ids[column[ids] < 0]
        order = np.argsort(ids, kind="stable")
        holders, rare = place[order], np.where(column < 0, held, 0)
        first = np.cumsum(rare) - rare
        step = max(1, CELLS // n)
        for at in range(0, len(some), step):
            block = some[at : at + step]
            place, ids = self.occurrences(block)
            both = (matrix(place, ids, len(block)) @ dense).astype(np.int64)
            place, ids = place[rare[ids] > 0], ids[rare[ids] > 0]
            pairs = np.cumsum(rare[ids])
            done = 0
            while done < len(ids):
                last = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + CELLS, "right")))
                own, times = ids[done:last], rare[ids[done:last]]
                cell = np.repeat(place[done:last] * n, times) + holders[ranges(first[own], times)]
                both += np.bincount(cell, minlength=both.size).reshape(both.shape)
                done = last
            least = self.percent * (self.size[block][:, None] + self.size[rows][None, :])
            linked = (100 + self.percent) * both >= least
            for i in np.flatnonzero((linked & (self.root[rows] != self.root[block][:, None])).any(axis=1)):
                hits = rows[linked[i]]
                for j in hits[np.unique(self.root[hits], return_index=True)[1]]:
                    self.link(int(block[i]), int(j))

    def link(self, i: int, j: int) -> None:
        """Join the components of two linked texts."""
        if self.root[i] != self.root[j]:
            low, high = sorted((self.root[i], self.root[j]))
            self.root[self.root == high] = low
            self.links.append((i, j))


def ranges(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as ``times`` says, one range after the other."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - times), times)


def local_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the components of each cluster; a task holds some clusters."""

    def run(batches):
        import pyarrow as pa

        for table in keyed_runs(batches, ["cluster"], 2_000):
            cluster, code = table["cluster"].to_numpy(), table["code"].to_numpy()
            edges = np.append(starts_of(cluster), len(cluster))
            a, b = [], []
            for first, last in zip(edges[:-1], edges[1:]):
                sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].slice(first, last - first).to_pylist()]
                one = Cluster(sets, percent)
                one.join(np.arange(last - first))
                a += [code[first + i] for i, _ in one.links]
                b += [code[first + j] for _, j in one.links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "a long, b long")


def block_links(rows: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the listed texts (cluster, code) with all texts of their clusters, block by block.

    They span what the links of each pair of blocks join.
    """

    def run(batches):
        import pyarrow as pa

        for table in keyed_runs(batches, ["cluster", "left", "right"]):
            keys = [table[name].to_numpy() for name in ("cluster", "left", "right")]
            code, listed = table["code"].to_numpy(), table["listed"].to_numpy()
            edges = np.append(starts_of(*keys), len(code))
            a, b = [], []
            for first, last in zip(edges[:-1], edges[1:]):
                own = listed[first:last]
                if own.all() or not own.any():
                    continue
                sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].slice(first, last - first).to_pylist()]
                one = Cluster(sets, percent)
                one.cross(np.flatnonzero(own), np.flatnonzero(~own))
                a += [code[first + i] for i, _ in one.links]
                b += [code[first + j] for _, j in one.links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def blocks(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("cluster").agg(
            F.ceil(F.sum(F.length("shingles") / 8) / BLOCK_SHINGLES).cast("int").alias(name))

    def place(n: str):
        return F.pmod(F.xxhash64("code"), F.col(n)).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    chosen = rows.join(some.select("cluster", "code"), ["cluster", "code"], "left_semi")
    sizes = blocks(chosen, "n_left").join(blocks(rows, "n_right"), "cluster")
    sizes = staged(sizes, "blocks")
    left = chosen.join(sizes, "cluster").select(
        "cluster", place("n_left").alias("left"), each("n_right").alias("right"), F.lit(True).alias("listed"), "code", "shingles")
    right = rows.join(sizes, "cluster").select(
        "cluster", each("n_left").alias("left"), place("n_right").alias("right"), F.lit(False).alias("listed"), "code", "shingles")
    both = left.union(right).repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    return staged(both.mapInArrow(run, "a long, b long"), "links")


def large_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links of clusters too large for a task.

    Rounds against ``ROUND_PIVOTS`` pivots, texts outside the largest component so far,
    find most of that component. Of two texts that are linked and not both in it, one is
    outside: those that have not been pivots are then measured against all.
    """
    rows = staged(rows, "large")
    state = rows.select("cluster", "code", F.col("code").alias("component"), F.lit(False).alias("used"))
    links = None
    for rounds in range(PIVOT_ROUNDS + 1):
        counts = state.groupBy("cluster", "component").count()
        main = counts.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        chosen = state.join(main, "cluster").where("component <> main and not used").select("cluster", "code")
        if rounds < PIVOT_ROUNDS:
            first = Window.partitionBy("cluster").orderBy("code")
            chosen = chosen.withColumn("k", F.row_number().over(first)).where(F.col("k") <= ROUND_PIVOTS).drop("k")
        chosen = staged(chosen, "pivots")
        if chosen.isEmpty():
            return links
        new = block_links(rows, chosen, percent)
        links = new if links is None else links.union(new)
        if rounds == PIVOT_ROUNDS:
            return links
        known = components(links).select(F.col("vertex").alias("code"), F.col("component").alias("now"))
        before, used = state, chosen.withColumn("new", F.lit(True))
        state = staged(state.join(known, "code", "left").join(used, ["cluster", "code"], "left").select(
            "cluster", "code", F.coalesce("now", "code").alias("component"),
            (F.col("used") | F.coalesce("new", F.lit(False))).alias("used")), "state")
        if hasattr(before, "staged_path"):
            discard(before)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
) -> DataFrame:
    """Documents linked by similar shingle sets: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct
    runs of ``size`` words, or the whole sequence of a shorter text. Two documents link
    when 100 * intersection >= percent * union, equal sets included. ``component_id`` is
    the smallest document id reachable by links.

    Null and empty texts, and texts of white space, have an empty set: they link with
    nothing, and ``component_id`` is their own id. Documents without an id take part by
    their text; the smallest id known in the component is reported, null if there is
    none. One row is returned for each row given, repeated ids included. Other columns
    are ignored. An empty table gives an empty result.
    """
    session_of(docs)
    docs = texts(docs, id_col, text_col)
    values, rank = common_shingles(docs, size)
    table = staged(profiles(docs, size, percent, values, rank), "profiles")
    classes = table.where("code is not null").groupBy("code").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"),
        F.first("window").alias("window"), F.first("parts").alias("parts"))
    classes = staged(classes, "classes")
    regions = regions_of(classes.select("code", "window"))
    facts = classes.select("code", "size", "parts")
    clusters = components(candidate_edges(regions.join(facts, "code"), percent)).select(
        F.col("vertex").alias("code"), F.col("component").alias("cluster"))
    members = staged(classes.select("code", "doc_id", "size").join(clusters, "code"), "members")
    sets = shingles_of(docs, members.select("code"), members.select("doc_id"), size)
    totals = members.groupBy("cluster").agg(F.sum("size").alias("total"))
    rows = staged(members.join(totals, "cluster").join(sets, "code").select("cluster", "code", "shingles", "total"), "sets")
    small = F.col("total") <= LOCAL_SHINGLES
    links = local_links(rows.where(small).drop("total"), percent)
    if not rows.where(~small).isEmpty():
        links = links.union(large_links(rows.where(~small).drop("total"), percent))
    joined = components(links)
    named = table.select("doc_id", "n_shingles", "code").join(
        joined.select(F.col("vertex").alias("code"), "component"), "code", "left")
    named = named.withColumn("component", F.coalesce("component", "code"))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
