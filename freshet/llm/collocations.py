"""Phrases whose words stand together more often than their parts suggest, by stripes.

A *stripe* is keyed by a prefix of words and counts the words that follow it. Tasks make
stripes of a slice of texts in numpy, and stripes of one prefix are merged element by
element after one shuffle. The merged stripes are the one structure that everything is
read from:

* its entries are the extensions, so the stripe of the empty prefix counts words, and
  that of three words counts phrases of four;
* an entry without a word counts the places where the prefix is followed by nothing that
  can be frequent, so that a stripe's total is the frequency of its prefix;
* its largest entry is the most frequent longer phrase that begins with the prefix; that
  of phrases ending with it is the largest entry over the stripes grouped by the rest of
  the phrase. A longer phrase is no more frequent than the shorter ones in it, so phrases
  one word longer decide about all longer ones.

Stripes are made level by level, in one pass over the texts for each length of prefix. A
phrase can be frequent only if its parts are; the frequent phrases of a level are sent to
the next as a bitmap of fixed size, which only saves work: counts are exact.

The stripe of a prefix that a large share of all words belongs to, and that of the empty
prefix, travels in parts by the hash of the next word. Nothing collects a stripe into one
row: after the shuffle its entries are rows of aggregates that can spill.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .bytes_table import flat_texts
from .common import discard, session_of, staged, starts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if one that holds it has this share of its frequency, in hundredths.
SUBSUMED = 80
#: Bits of the sets of frequent phrases; the bound on what is broadcast.
BITS = 1 << 25
#: Bytes of text that a task takes at a time.
SLICE = 8 << 20
#: A prefix with a share of 1 / HOT of all words has its stripe in parts.
HOT, PARTS = 1024, 64
#: Stripes are dealt out in so many buckets, the bound on tasks that merge them.
BUCKETS = 1 << 13
#: In numbers of 38 digits, as counts times two million may pass 64 bits.
SCORE = "cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)"
#: Codes of phrases are below this, so that products stay within 64 bits.
CODES = 1 << 40

WORD, BLANK, BREAK = 0, 1, 2
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def _words(data: np.ndarray, bounds: np.ndarray):
    """Distinct lower-cased words, and of each word in order its number, its text, and whether the next one follows in its piece."""
    import pyarrow as pa

    kinds = KINDS[data]
    inside = kinds == WORD
    first = np.zeros(len(data), dtype=bool)
    first[1:] = ~inside[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(inside & first)
    text = np.searchsorted(bounds, start, "right") - 1
    piece = np.cumsum(kinds == BREAK)[start]
    follows = np.zeros(len(start), dtype=bool)
    follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    before = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(before[start], before[-1]).astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[inside]])])
    coded = held.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), text, follows


def _dense(keys: np.ndarray):
    """Ids from 0 of equal keys, and the place of one key of each id."""
    _, place, ids = np.unique(keys, return_index=True, return_inverse=True)
    return ids, place


def _step(codes, hashes):
    """The code of a phrase from that of all its words but the last, and the last one's hash."""
    return (codes * 31 + hashes) % CODES


def _in_set(words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    place = codes % (len(words) * 32)
    return (words[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def _stripes_of(langs: list, data, bounds, sets: list, hot: list):
    """Stripes of all prefixes in a slice of texts; a prefix has as many words as there are ``sets``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    depth = len(sets)
    words, word, text, follows = _words(data, bounds)
    names, lang = np.unique(np.array(langs, dtype=object), return_inverse=True)
    ids, place = _dense(lang[text] * len(words) + word)
    n, n_ids = len(ids), len(place)  # the id n_ids is "no word"
    lang_of, word_of = lang[text[place]], word[place]
    hashes = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), dtype=np.int64, count=len(words))[word_of]
    spelled = pa.concat_arrays([words.take(pa.array(word_of)).cast(pa.large_string()), pa.array([""], pa.large_string())])
    if depth == 0:
        prefix, after = lang_of[ids], ids
        of_prefix, prefixes = np.arange(len(names)), pa.array([""] * len(names), pa.large_string())
        split, of_bucket = np.ones(len(names), dtype=bool), np.arange(len(names))
    else:
        seeds = np.array([zlib.crc32(name.encode()) for name in names], dtype=np.int64)
        codes, where = _step(seeds[lang_of], hashes), place
        grams = np.where(_in_set(sets[0], codes)[ids], ids, -1)
        at = np.flatnonzero(grams >= 0)
        for k in range(1, depth):  # windows of k + 1 words whose two windows of k words may be frequent
            at = at[at + k < n]
            at = at[(grams[at + 1] >= 0) & follows[at + k - 1]]
            dense, one = _dense(grams[at] * n_ids + ids[at + k])
            where = at[one]
            codes = _step(codes[grams[where]], hashes[ids[where + k]])
            usable = _in_set(sets[k], codes)[dense]
            at, grams = at[usable], np.full(n, -1, dtype=np.int64)
            grams[at] = dense[usable]
        used = np.zeros(len(where), dtype=bool)
        used[grams[at]] = True
        prefix, where, of_bucket = (np.cumsum(used) - 1)[grams[at]], where[used], codes[used]
        after = np.full(len(at), n_ids, dtype=np.int64)
        inner = np.flatnonzero(at + depth < n)
        inner = inner[follows[at[inner] + depth - 1] & (grams[at[inner] + 1] >= 0)]
        after[inner] = ids[at[inner] + depth]
        parts = [spelled.take(pa.array(ids[where + k])) for k in range(depth)]
        of_prefix = lang_of[ids[where]]
        prefixes = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if depth > 1 else parts[0]
        split = pc.is_in(prefixes, pa.array(hot, pa.large_string())).to_numpy(zero_copy_only=False)
    part = np.where(split[prefix], np.append(hashes % PARTS, 0)[after], 0)
    key, counts = np.unique((prefix * PARTS + part) * (n_ids + 1) + after, return_counts=True)
    group, after = key // (n_ids + 1), key % (n_ids + 1)
    begins = starts_of(group)
    stripe = group[begins]
    bucket = (of_bucket[stripe // PARTS] + stripe % PARTS * (BUCKETS // PARTS + 1)) % BUCKETS
    owner = of_prefix[stripe // PARTS] * BUCKETS + bucket
    order = np.argsort(owner, kind="stable")
    firsts = np.append(starts_of(owner[order]), len(order))

    def joined(values, offsets, by):
        lists = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), values)
        return pc.binary_join(lists, pa.scalar(by, pa.large_string()))

    def packed(values):
        return joined(values.take(pa.array(order)), firsts, "\n").cast(pa.string())

    ends, owner = np.append(begins, len(group)), owner[order][firsts[:-1]]
    return pa.RecordBatch.from_arrays([
        pa.array(names[owner // BUCKETS], pa.string()),
        pa.array((owner % BUCKETS).astype(np.int32)),
        packed(prefixes.take(pa.array(stripe // PARTS))),
        packed(joined(spelled.take(pa.array(after)), ends, " ")),
        packed(joined(pa.array(counts).cast(pa.large_string()), ends, " "))],
        names=["lang", "bucket", "prefixes", "nexts", "counts"])


def local_stripes(docs: DataFrame, sets: list, hot: list) -> DataFrame:
    """Stripes of slices of (lang, text): (lang, bucket, prefixes, nexts, counts).

    A row holds all stripes of a slice that a hash sends to one bucket, one a line, with
    words and counts between spaces. Equal prefixes, or parts of them, share a bucket.
    """
    sent, full = docs.sparkSession.sparkContext.broadcast((sets, hot)), SLICE

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def made():
            table = pa.Table.from_batches(held)
            data, bounds = flat_texts(table["text"])
            if len(data):
                yield _stripes_of(table["lang"].to_pylist(), data, bounds, *sent.value)

        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= full:
                yield from made()
                held, size = [], 0
        if held:
            yield from made()

    return docs.mapInArrow(run, "lang string, bucket int, prefixes string, nexts string, counts string")


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes merged element by element: (lang, bucket, prefix, next, count).

    Extensions below ``least`` count as no word, so that totals stay whole.
    """
    lines = F.arrays_zip(*(F.split(name, "\n").alias(name) for name in ("prefixes", "nexts", "counts")))
    spread = stripes.repartition("lang", "bucket").select("lang", "bucket", F.explode(lines).alias("s"))
    entries = F.arrays_zip(F.split("s.nexts", " ").alias("next"), F.split("s.counts", " ").alias("count"))
    spread = spread.select("lang", "bucket", F.col("s.prefixes").alias("prefix"), F.explode(entries).alias("e"))
    key = ["lang", "bucket", "prefix"]
    summed = spread.groupBy(*key, F.col("e.next").alias("next")).agg(F.sum(F.col("e.count").cast("long")).alias("count"))
    kept = F.when((F.col("next") != "") & (F.col("count") >= least), F.col("next"))
    return summed.groupBy(*key, kept.alias("next")).agg(F.sum("count").alias("count"))


def _codes(lang: str, phrase: str):
    """The code of a phrase, as tasks compute it."""
    crc = lambda c: F.crc32(c.cast("binary"))
    return F.aggregate(F.split(phrase, " "), crc(F.col(lang)), lambda code, word: (code * 31 + crc(word)) % CODES)


def _bits(entries: DataFrame) -> np.ndarray:
    """A set of frequent phrases as ``BITS`` bits, whatever their number."""
    place = (_codes("lang", "phrase") % BITS).alias("p")
    words = (entries.select(place).groupBy(F.shiftright("p", 5).cast("int").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b")))
    out = np.zeros(BITS // 32, dtype=np.uint32)
    table = words.toArrow()
    out[table["w"].to_numpy()] = table["b"].to_numpy().astype(np.uint32)
    return out


def stripes(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list:
    """Merged stripes of (lang, text) for prefixes of 0 to ``longest - 1`` words, as tables."""
    levels, sets, hot, n_words = [], [], [], 0
    for depth in range(longest):
        level = staged(_merged(local_stripes(docs, sets, hot), least), "stripes")
        levels.append(level)
        if depth + 1 == longest:
            return levels
        if depth == 0:
            n_words = level.agg(F.sum("count")).first()[0] or 0
        entries = extensions(level)
        sets = [*sets, _bits(entries)]
        # at most HOT phrases of a length have that share of all words
        share = entries.groupBy("phrase").agg(F.sum("count").alias("count")).where(F.col("count") * HOT >= max(1, n_words))
        hot = share.toArrow()["phrase"].to_pylist()
    return levels


def extensions(level: DataFrame) -> DataFrame:
    """The frequent phrases that merged stripes hold: (lang, prefix, next, phrase, count)."""
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return level.where("next is not null").select("lang", "prefix", "next", phrase.alias("phrase"), "count")


def totals(level: DataFrame) -> DataFrame:
    """The frequency of each prefix: (lang, phrase, count)."""
    return level.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("count").alias("count"))


def phrase_scores(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 to ``longest`` words that occurs ``a >= least`` times is cut where
    2000000 * a / (l + r), rounded down, is least (the first such cut); l and r are the
    frequencies of both sides, n is the number of words of its language. Phrases inside a
    longer one with ``subsumed`` hundredths of their frequency or more are left out. Only
    ASCII letters are lower-cased. Null texts are empty; null languages are ``und``.
    Repeated rows count each. Ties of score go to the larger a, then the phrase's bytes.
    """
    session_of(docs)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    levels = stripes(docs, least, longest)
    frequency = totals(levels[1])
    for level in levels[2:]:
        frequency = frequency.union(totals(level))
    frequency = staged(frequency.where(F.col("count") >= least), "frequency")
    found = extensions(levels[1])
    held = None
    for level in levels[2:]:
        phrases = extensions(level)
        found = found.union(phrases)
        start = phrases.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("count").alias("longer"))
        rest = F.concat_ws(" ", F.expr("substring(prefix, instr(prefix, ' ') + 1)"), F.col("next"))
        end = phrases.groupBy("lang", rest.alias("phrase")).agg(F.max("count").alias("longer"))
        held = start.union(end) if held is None else held.union(start).union(end)
    found = found.select("lang", "phrase", F.col("count").alias("a"))
    if held is not None:
        held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        wide = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * subsumed
        found = found.join(held, ["lang", "phrase"], "left").where(~F.coalesce(wide, F.lit(False))).drop("longer")
    words = F.split("phrase", " ")
    cuts = found.withColumn("words", words).select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"),
                       F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("rest"))
    of = lambda side, name: frequency.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr(SCORE).alias("score")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = worst.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order).cast("long"))
    n = levels[0].groupBy("lang").agg(F.sum("count").alias("n"))
    result = staged(best.where(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(frequency, *levels)
    return result


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') as w from pieces),
grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase
  from words, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m),
f as (select lang, m, phrase, count(*) as a, string_split(phrase, ' ') as w from grams group by all having count(*) >= 30),
n as (select lang, count(*) as n from grams where m = 1 group by lang),
inner_of as (
  select f.lang, array_to_string(w[i : i + k - 1], ' ') as phrase, max(a) as longer
  from f, (select unnest([2, 3]) as k), (select unnest([1, 2, 3]) as i) where k < m and i + k - 1 <= m group by all),
kept as (
  select f.* from f left join inner_of using (lang, phrase)
  where m >= 2 and (longer is null or 100::hugeint * longer < 80::hugeint * a)),
cuts as (
  select k.lang, k.phrase, k.a, c, x.a as l, y.a as r, (2000000::hugeint * k.a) // (x.a + y.a) as score
  from kept k, (select unnest([1, 2, 3]) as c), f x, f y
  where c < k.m and x.lang = k.lang and y.lang = k.lang
    and x.phrase = array_to_string(k.w[1 : c], ' ') and y.phrase = array_to_string(k.w[c + 1 : k.m], ' ')),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000
"""
