"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's documents form blocks, and one block is one slot of the mixture. Block i of
a source with weight w is released at floor(i / w) and due at ceil((i + 1) / w); the
earliest deadline among the released blocks takes the slot. The number of blocks a source
has had then never differs from its due share by a whole block.

Weights are taken exactly, as ratios of whole numbers of any length. The driver deals out
the blocks of all documents once, eight bytes a block, and a document finds its slot by
its source and block number.
"""

from __future__ import annotations

import heapq
import math
import sys
from array import array
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .common import session_of, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents in a block.
BLOCK = 64
#: Parts of a source, by the hash of the id, that are ranked apart.
CHUNKS = 1024


def shares(weights: Mapping[str, float], resolution: int) -> dict[str, int]:
    """Weights as whole parts of ``resolution``, one at least, by largest remainders."""
    names = sorted(weights)
    resolution = max(resolution, len(names))
    total = sum(weights.values())
    exact = {s: weights[s] / total * (resolution - len(names)) for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    spare = resolution - sum(out.values())
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[:spare]:
        out[s] += 1
    return out


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights."""
    ratios = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    whole = {s: int(r * scale) for s, r in ratios.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def schedule(parts: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, np.ndarray]:
    """The slots that each source takes, by earliest deadline among released blocks.

    They end with the last of ``blocks`` of the first source that runs out; without
    ``blocks``, after one period.
    """
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = {s: array("q") for s in parts}
    slot = 0
    while blocks is not None or slot < period:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // parts[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        if blocks is not None and i + 1 == blocks[s]:
            break
        if blocks is not None or i + 1 < parts[s]:
            heapq.heappush(waiting, ((i + 1) * period // parts[s], s, i + 1))
        slot += 1
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], resolution: int | None = None) -> list[dict]:
    """Schedules one after the other; each ends when its first source runs out.

    The weights of the sources that are left keep their ratios. A phase has its first
    slot, and for each source its first block, its part of the period and its slots.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = {s: 0 for s in left}
    start, out = 0, []
    while left:
        live = {s: weights[s] for s in left}
        parts = shares(live, resolution) if resolution else exact_parts(live)
        plan = schedule(parts, left)
        out.append({"start": start, "period": sum(parts.values()), "first": dict(done), "parts": parts, "plan": plan})
        start += sum(map(len, plan.values()))
        for s in list(left):
            done[s] += len(plan[s])
            left[s] -= len(plan[s])
            if not left[s]:
                del left[s], done[s]
    return out


def tempered(counts: Mapping[str, int], power: float) -> dict[str, float]:
    """Target weights in proportion to a power of the sources' sizes."""
    return {s: float(n) ** power for s, n in counts.items()}


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id",
    block: int = BLOCK, power: float = 0.5, resolution: int | None = None,
) -> DataFrame:
    """``docs`` with their place in the mixture: mix_block, mix_release, mix_due, mix_slot, mix_place.

    ``weights`` names the target weight of each source; by default it is the ``power`` of
    its number of documents, and a source without a weight gets the smallest one given.
    Weights are exact; only a given ``resolution`` rounds them to whole parts of it.
    Sorting by (mix_slot, mix_place) gives the mixture. All rows are kept: when a source
    runs out, the others go on with their weights in proportion. Documents of a source
    are ordered by a hash of their id (of the row's values where that is null), then by
    the row's values: only rows that differ in nothing but map columns tie. Null sources form one source of
    their own. Columns named as the new ones are replaced; an empty table gives an empty
    result.
    """
    spark = session_of(docs)
    new = ("mix_block", "mix_release", "mix_due", "mix_slot", "mix_place")
    rows = docs.drop(*new)
    plain = [f.name for f in rows.schema if f.dataType.simpleString() not in ("map", "variant") and "map<" not in f.dataType.simpleString()]
    key = F.when(F.col(id_col).isNull(), F.xxhash64(*map(F.col, plain))).otherwise(F.xxhash64(F.col(id_col)))
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = rows.withColumns({"__source": name, "__key": key})
    rows = rows.withColumn("__chunk", F.pmod("__key", F.lit(CHUNKS)))
    sizes = staged(rows.groupBy("__source", "__chunk").count(), "chunks")
    totals = {row["__source"]: row["n"] for row in sizes.groupBy("__source").agg(F.sum("count").alias("n")).collect()}
    if weights is None:
        target = tempered(totals, power)
    else:
        given = {f"={s}": float(w) for s, w in weights.items() if w > 0}
        target = {s: given.get(s, min(given.values(), default=1.0)) for s in totals}
    plan = phases({s: -(-n // block) for s, n in totals.items()}, target, resolution)
    sent = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__source", "__chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    # rows that tie on all plain columns are interchangeable, so a task that runs again deals the same rows
    own = Window.partitionBy("__source", "__chunk").orderBy("__key", *plain)
    rows = rows.withColumn("__rank", F.row_number().over(own) - 1).join(F.broadcast(sizes) if len(totals) <= 64 else sizes, ["__source", "__chunk"])
    rank = F.col("__rank") + F.col("__before")
    rows = rows.withColumns({"mix_block": F.floor(rank / block), "mix_place": (rank % block).cast("int")})

    def place(sources, blocks):
        import pandas as pd

        slot, release, due = (np.zeros(len(blocks), dtype=np.int64) for _ in range(3))
        for s, at in sources.groupby(sources).groups.items():
            b = blocks[at].to_numpy()
            live = [p for p in sent.value if s in p["first"]]
            k = np.searchsorted([p["first"][s] for p in live], b, "right") - 1
            for i in np.unique(k):
                p, here = live[i], k == i
                parts, period = p["parts"][s], p["period"]
                nth, inverse = np.unique(b[here] - p["first"][s], return_inverse=True)
                where = sources.index.get_indexer(at)[here]
                slot[where] = p["start"] + p["plan"][s][nth][inverse]
                # whole numbers of any length; a deadline beyond all slots may pass 64 bits
                release[where] = np.array([p["start"] + i * period // parts for i in nth.tolist()], dtype=np.int64)[inverse]
                due[where] = np.array([min(p["start"] - (-(i + 1) * period // parts), (1 << 63) - 1) for i in nth.tolist()], dtype=np.int64)[inverse]
        return pd.DataFrame({"mix_slot": slot, "mix_release": release, "mix_due": due})

    placed = F.pandas_udf(_placer(place), "mix_slot long, mix_release long, mix_due long")
    rows = rows.withColumn("__p", placed("__source", "mix_block"))
    return rows.select(*[c for c in docs.columns if c not in new], "mix_block", F.col("__p.mix_release").alias("mix_release"),
                       F.col("__p.mix_due").alias("mix_due"), F.col("__p.mix_slot").alias("mix_slot"), "mix_place")


def _placer(place):
    import pandas as pd

    def run(s: pd.Series, b: pd.Series) -> pd.DataFrame:
        return place(s, b)

    run.__annotations__ = {"s": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return run
