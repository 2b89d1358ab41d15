"""Spelling variants: words one edit apart, by dense tiles of code points.

Two words of which the longer has L code points are one edit apart exactly if their
common prefix and common suffix together reach L - 1. Words of a block form a matrix of
code points padded with zeros, one more for the reversed words; a pair of blocks is
compared column by column for all its pairs at once, which gives both lengths.

Blocks come from the same rule. Of a pair that shares its first a and its last b code
points, the rest of the longer word has R = L - a - b, and either its first or its last
h = (R - 1) // 2 are shared too. A word is therefore keyed by the prefix of h and the
suffix of h, for its own length and the next one. A key with more words than a block
holds is refined by the same rule: each of its words goes to two keys with a longer
prefix or a longer suffix, until at most two code points are free; then a key has no more
words than pairs of letters. So no group is compared whole that a finer key can split,
however many words share a prefix, and no pair is lost. A pair is taken at one key only:
at a prefix if it shares it, else at the suffix (``limit`` holds this).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import bitmap, discard, keyed_runs, session_of, staged, starts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Runs whose hash this divides lose a code point.
DAMAGED = 31
#: Words of a key, at most, unless its free code points are too few to split it.
KEY_WORDS = 1024
#: Words of a side of a tile.
TILE = 256
ALL = 1 << 30


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                  least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """Distinct words of all texts with their counts: (word, n).

    A run of letters loses one code point, which its hash names, where ``damaged``
    divides the hash of the row's id and the run. A null id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select(
        "id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Two finer keys for each row: (word, n, size, a, b, limit, key).

    ``size`` is the length of the longer word of a pair, ``a`` and ``b`` are the shared
    code points at both ends, and a pair counts here if its prefix is below ``limit``.
    """
    h = F.expr("(size - a - b - 1) div 2").cast("int")
    sides = F.array(F.struct((F.col("a") + F.col("h")).alias("a"), F.col("b").alias("b"), F.col("limit").alias("limit")),
                    F.struct(F.col("a").alias("a"), (F.col("b") + F.col("h")).alias("b"),
                             F.least("limit", F.col("a") + F.col("h")).alias("limit")))
    split = rows.withColumn("h", h).select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.*")
    key = F.xxhash64("size", "a", "b", "limit", F.expr("left(word, a)"), F.expr("right(word, b)"))
    return split.withColumn("key", key)


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of leading columns in which each row of one matrix equals each of the other."""
    width = min(left.shape[1], right.shape[1])
    same = np.ones((len(left), len(right)), dtype=bool)
    out = np.zeros(same.shape, dtype=np.int32)
    for j in range(width):
        same &= left[:, j, None] == right[None, :, j]
        if not same.any():
            break
        out += same
    return out


def _matrix(words: list, width: int) -> np.ndarray:
    """Code points of words in rows of ``width``, zeros after the end."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def near_pairs(words: list, size: int, a: int, b: int, limit: int, tile: int):
    """Indices of pairs of words one edit apart whose longer word has ``size`` code points.

    Only pairs that share ``a`` code points at the beginning, fewer than ``limit``, and ``b`` at the end.
    """
    lengths = np.array([len(w) for w in words])
    longer, shorter = np.flatnonzero(lengths == size), np.flatnonzero(lengths == size - 1)
    if not len(longer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forward, backward = _matrix(words, size), _matrix([w[::-1] for w in words], size)
    if forward.max() < 256:
        forward, backward = forward.astype(np.uint8), backward.astype(np.uint8)
    forward, backward = np.asfortranarray(forward), np.asfortranarray(backward)
    found = [], []
    blocks = [longer[i : i + tile] for i in range(0, len(longer), tile)]
    others = [shorter[i : i + tile] for i in range(0, len(shorter), tile)]
    for i, block in enumerate(blocks):
        for other in [*blocks[i:], *others]:
            before = _common(forward[block], forward[other])
            after = _common(backward[block], backward[other])
            hit = (before + after >= size - 1) & (before >= a) & (before < limit) & (after >= b)
            x, y = np.nonzero(hit)
            x, y = block[x], other[y]
            once = x < y if other is block else slice(None)
            found[0].append(x[once])
            found[1].append(y[once])
    return np.concatenate(found[0]), np.concatenate(found[1])


def _tiled(rows: DataFrame) -> DataFrame:
    """Near words of each word at one key: their number, and the most frequent of them."""
    tile = TILE

    def run(batches):
        import pyarrow as pa

        for table in keyed_runs(batches, ["key"], 4096):
            keys = [table[c].to_numpy() for c in ("key", "size", "a", "b", "limit")]
            bounds = np.append(starts_of(*keys), table.num_rows)
            words, counts = table["word"].to_pylist(), table["n"].to_numpy()
            out = [], [], [], []
            for first, last in zip(bounds[:-1], bounds[1:]):
                if last - first < 2:
                    continue
                x, y = near_pairs(words[first:last], *(int(k[first]) for k in keys[1:]), tile)
                if not len(x):
                    continue
                x, y = np.concatenate([x, y]) + first, np.concatenate([y, x]) + first
                best: dict = {}
                for i, j in zip(x.tolist(), y.tolist()):
                    n, top = best.get(i, (0, None))
                    rank = (-int(counts[j]), words[j])
                    best[i] = (n + 1, rank if top is None or rank < top else top)
                for i, (n, (least, near)) in best.items():
                    out[0].append(words[i])
                    out[1].append(n)
                    out[2].append(-least)
                    out[3].append(near)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])],
                    names=["word", "n_near", "best_n", "best"])

    return rows.mapInArrow(run, "word string, n_near long, best_n long, best string")


def _marked(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows with a column ``full``: whether a bit is set for their key."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (sent.value[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.drop_columns(["place"]).append_column("full", pa.array(hit.astype(bool)))

    placed = rows.withColumn("place", F.pmod(F.xxhash64("key"), F.lit(len(bits) * 32)))
    return placed.mapInArrow(run, rows.schema.add("full", "boolean"))


def near_words(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """All words of (word, n) that have words one edit apart: (word, n_near, best_n, best).

    ``words`` holds each word once. ``best`` is the most frequent near word, of equally
    frequent ones the first in code-point order.
    """
    session_of(words)
    length = F.length("word")
    roots = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size")).select(
        "word", "n", "size", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(ALL).alias("limit"))
    rows, ready, tables = _keyed(roots), [], []
    divisible = F.expr("size - a - b > 2")
    while True:
        full = rows.where(divisible).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > key_words)
        full = staged(full.select("key"), "full_keys")
        if full.isEmpty():
            ready.append(rows)
            discard(full)
            break
        rows = _marked(rows, bitmap(full))  # a key that only seems full is refined too, which changes no result
        discard(full)
        ready.append(rows.where(~(F.col("full") & divisible)).drop("full"))
        rows = staged(_keyed(rows.where(F.col("full") & divisible).drop("full", "key")), "finer_keys")
        tables.append(rows)
    spread = ready[0]
    for more in ready[1:]:
        spread = spread.union(more)
    spread = spread.repartition("key").sortWithinPartitions("key", "size", "a", "b", "limit")
    tiles = staged(_tiled(spread), "near")
    discard(*tables)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("m")
    grouped = tiles.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return grouped.select("word", "n_near", (-F.col("m.least")).alias("best_n"), F.col("m.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """The end of each chain of (word, form): (word, root). Chains have no cycle, as counts rise; each round doubles the steps."""
    current = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        discard(current)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        current = staged(moved.select("word", "root"), "roots")
        discard(moved)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
                      key_words: int = KEY_WORDS, **words) -> DataFrame:
    """Each word with its near words, its form and its root: (word, form, root, n, n_near, form_n).

    Words are those of ``damaged_words``, with its arguments. A word's form is its most
    frequent near word (of equal ones the first in code-point order) if that is ``ratio``
    times as frequent, else null; its root is the last form reached over forms, or the
    word itself. Null and empty texts hold no words, repeated rows count each, and no
    other column is read.
    """
    session_of(docs)
    known = staged(damaged_words(docs, id_col, text_col, **words), "words")
    near = known.join(near_words(known, key_words), "word", "left")
    fits = F.col("best_n") >= F.col("n") * ratio
    near = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "variants")
    discard(known)
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The query's SQL on `documents`: near words by deleted code points, CRC-32 by its polynomial.
ORACLE = r"""
with recursive
crc_table as (
  select list(list_reduce(range(8), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from range(256) r(i)),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 7),
bytes as (
  select distinct doc_id, run, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c:
    case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + unicode(c) // 64, 128 + unicode(c) % 64] end)) as b
  from runs),
hashes as (
  select doc_id, run, xor(list_reduce(b, lambda crc, x: xor(crc >> 8, t[xor(crc, x) % 256 + 1]), 4294967295), 4294967295) as h
  from bytes, crc_table),
words as (
  select word, count(*) as n
  from (select case when h % 31 = 0 then run[1 : (h % length(run))::bigint] || run[(h % length(run))::bigint + 2 :] else run end as word
        from runs join hashes using (run) where runs.doc_id is not distinct from hashes.doc_id)
  where length(word) >= 7 group by word having count(*) >= 2),
shorter as (
  select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from words, unnest(range(1, length(word) + 1)) u(i)),
pairs as (
  select a.word as x, a.n as xn, b.word as y, b.n as yn from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, a.n, w.word, w.n from shorter a join words w on a.rest = w.word
  union select w.word, w.n, a.word, a.n from shorter a join words w on a.rest = w.word),
near as (
  select x as word, count(*) as n_near, max(yn) as top, arg_min(y, (-yn, y)) as best from pairs group by x),
variants as (
  select words.word, n, coalesce(n_near, 0) as n_near, case when top >= 10 * n then best end as form,
         case when top >= 10 * n then top end as form_n
  from words left join near using (word)),
chain as (
  select word, word as root from variants
  union select chain.word, variants.form from chain join variants on chain.root = variants.word where variants.form is not null)
select v.word, v.form, c.root, v.n, v.n_near, v.form_n
from variants v join (select word, root from chain where root in (select word from variants where form is null)) c on v.word = c.word
"""
