"""License texts and notices in documents, found by diagonal voting.

All runs of ``GRAM`` words of a document are joined by hash to their places in the
templates. A match votes for its diagonal, the document's place less the template's;
neighbouring diagonals, as words inserted or left out make them, merge to one span. A span
that has the votes, and is not more stretched than allowed, is then verified: the words of
its matches are compared, each place of the template counts once, and only if it comes
after all earlier places of the template. It stands if what counts is enough of the
template. Texts are cut into words once, and only matches are kept.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binding import bind
from .common import session_of, staged, with_row

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals this near belong together.
NEAR = 3
#: Share of a template's runs of words that a span must hold, and how much longer it may be.
HELD = 0.7
STRETCH = 1.5

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wordings of published licenses and customary notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def places_of(words: Column, parts: Sequence[str]) -> Column:
    """Where the words ``parts`` stand one after the other."""

    def marked(word: Column, place: Column) -> Column:
        return F.when(word == parts[-1], place - (len(parts) - 1))

    def fits(place: Column) -> Column:
        same = place >= 0
        for k, part in enumerate(parts[:-1]):
            same = same & (F.get(words, place + k) == part)
        return F.coalesce(same, F.lit(False))

    return F.filter(F.transform(words, marked), fits)


def found_of(words: Column, phrase: str, label: str) -> Column:
    """A phrase's label and places."""
    parts = phrase.split(" ")
    at = F.when(F.array_contains(words, parts[-1]), places_of(words, parts)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.lit(label).alias("label"), at.alias("at"))


def found_any(found: Column) -> Column:
    return F.size(found["at"]) > 0


def template_words(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.translate(str.maketrans(UPPER, UPPER.lower())))


def template_runs(templates: Sequence[tuple[str, str]], gram: int) -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, place, number of runs, words) of each run of words; a few hundred rows."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = template_words(text)
        n = max(1, len(words) - gram + 1)
        out += [(k, label, p, n, words[p : p + gram]) for p in range(n)]
    return out


def run_table(spark, templates: Sequence[tuple[str, str]], gram: int) -> DataFrame:
    """The templates' runs of words; a constant of this module or a parameter, a few hundred rows."""
    return spark.createDataFrame(template_runs(templates, gram), "template int, label string, place int, n int, words array<string>")


def spans(hits: DataFrame, runs: DataFrame, held: float, stretch: float) -> DataFrame:
    """(row, template, label, first, last, share) of all spans that stand.

    ``hits`` has a row per document with the places and words of its runs that are in a template.
    """
    found = hits.select("row", F.explode("hits").alias("hit")).select("row", "hit.pos", "hit.words")
    votes = found.join(F.broadcast(runs), "words").withColumn("diagonal", F.col("pos") - F.col("place")).drop("words")
    diagonals = votes.groupBy("row", "template", "n", "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    merged = diagonals.withColumn("span", F.sum(new.cast("int")).over(order)).groupBy("row", "template", "n", "span").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    likely = merged.where((F.col("votes") >= held * F.col("n")) & (F.col("last") - F.col("first") + 1 <= F.ceil(stretch * F.col("n")) + NEAR))
    inside = F.col("diagonal").between(F.col("low"), F.col("high"))
    places = votes.join(likely.drop("n", "votes"), ["row", "template"]).where(inside).groupBy(
        "row", "template", "label", "n", "span", "first", "last", "place").agg(F.min("pos").alias("pos"))
    earlier = Window.partitionBy("row", "template", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ordered = places.withColumn("reached", F.max("pos").over(earlier)).where("reached is null or pos > reached")
    share = ordered.groupBy("row", "template", "label", "n", "span", "first", "last").agg((F.count("*") / F.col("n")).alias("share"))
    return share.where(F.col("share") >= held)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES, gram: int = GRAM, held: float = HELD, stretch: float = STRETCH,
) -> DataFrame:
    """Places of license phrases and labels of license texts, one row for each document.

    Returns doc_id, n_words, n_base (places where a phrase's words stand consecutively),
    first_word, last_word (their least and greatest start, null without any), base_labels,
    labels (those of the phrases and of all spans that stand; sorted and joined by commas),
    score (the greatest share of a template that a span holds, 0 without any) and spans
    (label, first and last word, share).

    Texts are lower-cased (A-Z) and read whole; a null or empty text has no words. Rows are
    kept as they come, with repeated and null ids; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = session_of(docs)
    runs = run_table(spark, templates, gram)
    codes = [r.code for r in runs.select(F.xxhash64("words").alias("code")).distinct().collect()]
    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def hits(words: Column) -> Column:
        run = lambda i: F.slice(words, i + 1, gram)
        places = F.filter(F.sequence(F.lit(0), F.size(words) - gram), lambda i: F.xxhash64(run(i)).isin(codes))
        return F.when(F.size(words) >= gram, F.transform(places, lambda i: F.struct(i.alias("pos"), run(i).alias("words"))))

    # bound, for lambdas over a column would cut the text into words anew at each step
    cut = rows.select("row", "doc_id", bind(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.filter(F.array(*(found_of(w, *p) for p in phrases)), found_any).alias("found"),
        hits(w).alias("hits"))).alias("base"))
    cut = staged(cut.select("row", "doc_id", "base.*"), "license_hits")
    base = cut.withColumn("places", F.flatten(F.transform("found", lambda x: x["at"]))).select(
        "row", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("base_labels"))
    standing = spans(cut, runs, held, stretch)
    own = standing.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"))
    out = base.join(own, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,share:double>>")).alias("spans"))


def oracle(table: str = "documents", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> str:
    """DuckDB SQL for the columns of the query."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    runs = ", ".join(f"({k}, {quoted(label)}, {p}, {n}, {quoted(' '.join(words))})"
                     for k, label, p, n, words in template_runs(templates, GRAM))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    base = " union all ".join(
        f"select doc_id, i - {len(p.split())} as spot, {quoted(label)} as label from gramed where "
        + (f"w0 = {quoted(p.split()[1])} and p1 = {quoted(p.split()[0])}" if len(p.split()) == 2 else
           f"w0 = {quoted(p.split()[2])} and p1 = {quoted(p.split()[1])} and p2 = {quoted(p.split()[0])}")
        for p, label in phrases)
    return f"""
with listed as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{word}') as words from {table}
), placed as (
    select doc_id, unnest(words) as w0, generate_subscripts(words, 1) as i from listed
), gramed as (
    select doc_id, i, w0, lag(w0, 1) over w as p1, lag(w0, 2) over w as p2,
           w0 || ' ' || lead(w0, 1) over w || ' ' || lead(w0, 2) over w as gram
    from placed window w as (partition by doc_id order by i)
), base as ({base}), based as (
    select doc_id, count(*) as n_base, min(spot) as first_word, max(spot) as last_word,
           string_agg(distinct label, ',' order by label) as base_labels, list(distinct label) as base_list
    from base group by doc_id
), runs(template, label, place, n, gram) as (values {runs}),
votes as (select doc_id, template, label, n, place, i - 1 as pos, i - 1 - place as diagonal from gramed join runs using (gram)),
diagonals as (select doc_id, template, label, n, diagonal, count(*) as votes, min(pos) as first, max(pos) as last
              from votes group by doc_id, template, label, n, diagonal),
marked as (select *, case when diagonal - lag(diagonal) over d <= {NEAR} then 0 else 1 end as new
           from diagonals window d as (partition by doc_id, template order by diagonal)),
numbered as (select *, sum(new) over (partition by doc_id, template order by diagonal) as span from marked),
merged as (select doc_id, template, n, span, sum(votes) as votes, min(first) as first, max(last) as last,
                  min(diagonal) as low, max(diagonal) as high
           from numbered group by doc_id, template, n, span
           having sum(votes) >= {HELD} * n and max(last) - min(first) + 1 <= ceil({STRETCH} * n) + {NEAR}),
places as (select v.doc_id, v.template, v.label, v.n, m.span, v.place, min(v.pos) as pos
           from votes v join merged m on v.doc_id = m.doc_id and v.template = m.template and v.diagonal >= m.low and v.diagonal <= m.high
           group by all),
standing as (select doc_id, label, count(*) / n as share from places p
             where not exists (select 1 from places q where q.doc_id = p.doc_id and q.template = p.template and q.span = p.span
                               and q.place < p.place and q.pos >= p.pos)
             group by doc_id, template, span, label, n having count(*) / n >= {HELD}),
labelled as (select doc_id, max(share) as score, list(distinct label) as found from standing group by doc_id)
select l.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
       cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(found, [])))), ',') as labels,
       cast(coalesce(score, 0) as double) as score
from listed l left join based using (doc_id) left join labelled using (doc_id)"""
