"""Exact duplicates by deterministic naming of blocks; DataFrame functions only.

A text is cut into blocks of a fixed number of bytes. All distinct blocks are sorted, and
the place in that order is a block's name, an integer. Then adjacent names are taken as
pairs, the distinct pairs are sorted and named in the same way, and so on: after k rounds
a name stands for up to 2^k blocks, and a text of n blocks has a single name after
log2(n) rounds. Two texts have one identity (round, name) exactly if they are equal.

Blocks are ordered by a 64-bit code and then by their contents. The contents decide only
among blocks of one code, so they are read again for codes that occur more than once, and
compared there: first by their least and greatest, which partial aggregates find, and
where these differ (two contents under one code) all contents of the code are sorted. A
block that occurs once moves as eight bytes, and the contents of copies are aggregated
before they are shuffled. A later round shuffles the names of the texts that are not done
yet. Joins that bring names back have a unique side, and adaptive execution splits a
block that many texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, session_of, staged

BLOCK_BYTES = 4096


def one_space(text: Column) -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _names(keys: DataFrame) -> DataFrame:
    """Distinct rows with an integer name that rises in their order."""
    spread = keys.distinct().repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns)
    return staged(spread.withColumn("name", F.monotonically_increasing_id()), "names")


def _blocks(texts: DataFrame, size: int, code) -> DataFrame:
    """One row per block; an empty text is one empty block. Only the first carries the text's columns."""
    count = F.greatest(F.lit(1), F.ceil(F.length("bytes") / size).cast("int"))
    cut = texts.withColumn("n", count).select(
        "*", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                                      lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))).alias("pos", "block"))
    first = lambda name: F.when(F.col("pos") == 0, F.col(name)).alias(name)
    return cut.select("row", "pos", "n", code("block").alias("code"), "block", first("doc_id"), first("text_sha256"))


def _ordered(blocks: DataFrame) -> DataFrame:
    """The blocks without their contents, which (code, tie) stands for."""
    coded = staged(blocks.drop("block").withColumn("tie", F.lit(-1).cast("long")), "blocks")
    shared = staged(coded.groupBy("code").agg(F.count("*").alias("c")).where("c > 1").select("code"), "shared")
    contents = blocks.select("code", "block")
    ends = contents.join(shared, "code", "left_semi").groupBy("code").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    mixed = staged(ends.where("least <> most").select("code"), "mixed")
    if not mixed.isEmpty():
        names = _names(contents.join(mixed, "code", "left_semi"))
        apart = blocks.join(mixed.withColumn("mixed", F.lit(True)), "code", "left")
        apart = apart.withColumn("block", F.when(F.col("mixed"), F.col("block"))).drop("mixed")
        apart = apart.join(names, ["code", "block"], "left").withColumn("tie", F.coalesce("name", F.lit(-1)))
        apart = staged(apart.select(*coded.columns), "blocks")
        discard(coded, names)
        coded = apart
    discard(shared, mixed)
    return coded


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=one_space,
               block_bytes: int = BLOCK_BYTES, code=F.xxhash64) -> DataFrame:
    """Each row's identity: (row, doc_id, text_sha256, level, name), equal for equal texts alone.

    ``row`` numbers the rows of the table, so ids may repeat or be null. ``code`` orders
    the blocks before their contents do.
    """
    session_of(docs)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        F.encode(normalise(F.col(text_col)), "UTF-8").alias("bytes"))
    blocks = _ordered(_blocks(texts.withColumn("text_sha256", F.sha2("bytes", 256)), block_bytes, code))
    longest = blocks.agg(F.max("n")).first()[0] or 1
    names = _names(blocks.select("code", "tie"))
    level = staged(blocks.join(names, ["code", "tie"]).select("row", "pos", "n", "name"), "level")
    used, found = [level, names], []
    for k in range(int(longest - 1).bit_length() + 1):
        found.append(level.where("n = 1").select("row", F.lit(k).alias("level"), "name"))
        if longest <= 1 << k:
            break
        name_at = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = (level.where("n > 1").groupBy("row", F.shiftright("pos", 1).alias("pos"))
                 .agg(name_at(0).alias("left"), F.coalesce(name_at(1), F.lit(-1)).alias("right"), F.max("n").alias("n")))
        pairs = staged(pairs.withColumn("n", F.shiftright(F.col("n") + 1, 1)), "pairs")
        names = _names(pairs.select("left", "right"))
        level = staged(pairs.join(names, ["left", "right"]).select("row", "pos", "n", "name"), "level")
        used += [pairs, names, level]
    identity = found[0]
    for more in found[1:]:
        identity = identity.union(more)
    own = blocks.where("pos = 0").select("row", "doc_id", "text_sha256")
    result = staged(own.join(identity, "row"), "identities")
    discard(blocks, *used)
    return result


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=one_space,
                     block_bytes: int = BLOCK_BYTES, code=F.xxhash64) -> DataFrame:
    """All rows with the group of texts equal after normalisation: one of each group stays.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), a row per row of the table.
    The row with the smallest id stays; of rows that repeat an id, one. Rows with a null
    id stay only if no row of their group has an id, and then ``keep_id`` is null. Null
    texts are empty texts, and these are one group. Other columns are not read.
    """
    rows = name_texts(docs, id_col, text_col, normalise, block_bytes, code)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = rows.groupBy("level", "name").agg(first, F.count("*").alias("group_size"))
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = min(doc_id) over same as kept, sha256(text) as text_sha256
from t window same as (partition by text)
"""
