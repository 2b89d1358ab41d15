"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language, by rank. A document is
compared with each profile by the out-of-place distance: the sum, over its own most
frequent n-grams, of how far each is from its rank in the profile (Cavnar and Trenkle,
1994).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import crc32_of, session_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: n-grams in a profile, and the distance of one that is missing.
PROFILE = 300
#: Labelled documents of a language that its profile is fitted on, about; the bound of its sample.
FITTED = 40_000
SLICE_CHARS = 1 << 18
CODE_BITS = 21


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(lowered: Sequence[str], letters: np.ndarray):
    """(text, gram, count) of all 1- to 3-grams, sorted by text; a gram is 63 bits of code points.

    Words are runs of letters with one boundary (a space) on each side; grams span no
    boundary, and one of boundaries alone doesn't count.
    """
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1
    heads = np.concatenate([[0], np.cumsum(lengths)])  # the separator before each text, and the last one
    is_letter = letters[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[heads] = True
    text = np.repeat(np.arange(len(lowered)), lengths)
    text = np.append(text, len(lowered))[keep]
    present = np.zeros(0x110000, dtype=bool)
    present[codes[is_letter]] = True
    alphabet = np.concatenate([[0x20], np.flatnonzero(present)])  # a boundary counts as a space
    dense = np.zeros(0x110000, dtype=np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    x = np.where(is_letter, dense[codes], 0)[keep]
    base = len(alphabet)
    out_text, out_gram, out_count = [], [], []
    for n in (1, 2, 3):
        if len(x) < n:
            break
        m = len(x) - n + 1
        valid = x[n - 1 :] >= 0
        if n == 1:
            valid = x > 0
        elif n == 2:
            valid = (x[:-1] > 0) | (x[1:] > 0)
        else:
            valid = x[1:-1] > 0
        # a gram belongs to the text it starts in; the next text's separator may close it
        ends = np.zeros(len(x), dtype=bool)
        ends[1:] = text[1:] != text[:-1]
        if n >= 2:
            valid &= ~(ends[1:m + 1] & (x[1 : m + 1] != 0))
            valid &= ~((x[:m] == 0) & ends[1 : m + 1])
        key = np.zeros(m, dtype=np.int64)
        for k in range(n):
            key = key * base + x[k : k + m]
        scale = base**n
        if scale * (len(lowered) + 1) < 2**62:
            key, count = np.unique((text[:m] * scale + key)[valid], return_counts=True)
            owner, key = key // scale, key % scale
        else:  # texts in a great many scripts
            pairs, count = np.unique(np.stack([text[:m][valid], key[valid]], axis=1), axis=0, return_counts=True)
            owner, key = pairs[:, 0], pairs[:, 1]
        gram = np.zeros(len(key), dtype=np.int64)
        for k in range(n):
            gram = (gram << CODE_BITS) | alphabet[key // base ** (n - 1 - k) % base]
        out_text.append(owner)
        out_gram.append(gram)
        out_count.append(count)
    if not out_text:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    owner, gram, count = map(np.concatenate, (out_text, out_gram, out_count))
    order = np.lexsort((gram, -count, owner))
    return owner[order], gram[order], count[order]


def text_slices(values: list[str]):
    first = size = 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(values):
        yield first, len(values)


def language_profiles(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fitted: int = FITTED,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the n-grams of any profile (sorted), and their rank in each profile.

    Fits on labelled documents: on all of a language that has up to ``fitted`` of them; of
    one that has more, on a share chosen by a hash of the id (of the text where that is
    null). So a rare language has the profile it has on a small table.
    """
    spark = session_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().where(F.col("count") > fitted)
    parts = 1 << 40
    lot = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text")), F.lit("fit")), F.lit(parts))
    sizes = sizes.select("lang", F.floor(float(parts) * fitted / F.col("count")).alias("share"))
    rows = rows.join(F.broadcast(sizes), "lang", "left").where(F.col("share").isNull() | (lot < F.col("share")))

    def count(batches):
        import pyarrow as pa

        letters = letter_table()
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            place = np.array([names.index(name) for name in langs])
            lang, gram, n = [], [], []
            for first, last in text_slices(texts):
                owner, grams, counts = gram_counts([t.lower() for t in texts[first:last]], letters)
                lang.append(place[first:last][owner] if len(owner) else owner)
                gram.append(grams)
                n.append(counts)
            lang, gram, n = map(np.concatenate, (lang, gram, n))
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])])[: len(lang)])
            sums = np.add.reduceat(n, new) if len(new) else n
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in lang[new]], pa.string()), pa.array(gram[new]), pa.array(sums.astype(np.int64))],
                ["lang", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE)
    table = top.select("lang", "gram", "rank").toPandas()
    names = sorted(table["lang"].unique())
    grams = np.unique(table["gram"].to_numpy()) if len(table) else np.zeros(0, np.int64)
    ranks = np.full((len(grams), len(names)), -1, dtype=np.int64)
    for k, name in enumerate(names):
        own = table[table["lang"] == name]
        ranks[np.searchsorted(grams, own["gram"].to_numpy()), k] = own["rank"].to_numpy() - 1
    return names, grams, ranks


def predicted(values: list, letters, names, grams, ranks) -> tuple[list, list, list]:
    """Language, confidence and fit of each text of a slice."""
    n = len(values)
    langs, scores, fits = ["und"] * n, [0.0] * n, [0.0] * n
    owner, gram, _ = gram_counts([(v or "").lower() for v in values], letters)
    if not len(owner) or not names:
        return langs, scores, fits
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    top = rank < PROFILE
    owner, gram, rank = owner[top], gram[top], rank[top]
    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    known = np.where((grams[at] == gram)[:, None], ranks[at], -1)
    off = np.where(known < 0, PROFILE, np.abs(known - rank[:, None]))
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    total = np.add.reduceat(off, starts, axis=0)
    count = np.diff(np.append(starts, len(owner)))
    best = total.argmin(axis=1)
    ranked = np.sort(total, axis=1)
    second = ranked[:, 1] if len(names) > 1 else count * PROFILE
    for k, i in enumerate(owner[starts]):
        langs[i] = names[best[k]]
        scores[i] = float((second[k] - ranked[k, 0]) / second[k]) if second[k] else 0.0
        fits[i] = float(1 - ranked[k, 0] / (count[k] * PROFILE))
    return langs, scores, fits


def identify_languages(docs: DataFrame, profiles: tuple, text_col: str = "text", out: Sequence[str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """``docs`` with the predicted language, a score and the fit to its profile appended.

    ``score`` is the lead of the best language over the second, relative to the distance
    of the second; ``fit`` is 1 for the profile's own ranks and 0 if no n-gram of the
    document is in it; both lie between 0 and 1. Whole texts are read. Null texts and
    texts without a letter are ``und`` with 0; so is everything when no profile could be
    fitted. Ties go to the language first in order. Every row is kept, repeated ones
    included, and all its columns; columns named as in ``out`` are replaced.
    """
    spark = session_of(docs)
    sent = spark.sparkContext.broadcast(profiles)
    keep = [c for c in docs.columns if c not in out]
    frame = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches):
        import pyarrow as pa

        names, grams, ranks = sent.value
        letters = letter_table()
        for batch in batches:
            values = batch.column(text_col).to_pylist()
            found = ([], [], [])
            for first, last in text_slices([v or "" for v in values]):
                for have, new in zip(found, predicted(values[first:last], letters, names, grams, ranks)):
                    have.extend(new)
            columns = [*batch.columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *out])

    return frame.mapInArrow(run, f"{schema}, {out[0]} string, {out[1]} double, {out[2]} double")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return crc32_of(id_col) % folds == fold


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the other folds."""
    session_of(docs)
    known = language_profiles(docs.where(~held_out()))
    rows = docs.select("doc_id", "text")
    found = identify_languages(rows, known)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
