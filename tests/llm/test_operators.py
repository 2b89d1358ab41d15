"""The text operators against brute force on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from freshet.llm import (
    html_layout, jaccard_join, language_id, lattice_dedup, license_scan, mixing, multi_index_search, packing, recurrent_lm,
    suffix_dedup,
)
from freshet.llm.common import components
from freshet.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, row string, component int"


def some_texts() -> dict:
    rng = np.random.default_rng(3)
    words = ["la", "the", "of", "and", "zür", "éau", "Word", "ing", "tion", "x1", "quux", "ñan"]
    make = lambda n: " ".join(rng.choice(words, n))
    base, long = make(120), make(3000)
    passage = make(130)
    texts = [base, base, base.replace("the", "THE"), base + " end", make(4), make(4), "one two", "One  two", "", None, "\t \n",
             long, make(80) + " " + passage + " " + make(80), passage + make(50), make(30) + "\n" + passage, "a" * 450,
             "Released under the MIT License.", "mit license mit license Apache License, general PUBLIC license", "!!! 123", "é"]
    edited = base.split()
    for k in range(6):
        edited[10 + 15 * k] = f"edit{k}"
        texts.append(" ".join(edited))
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "a", "b", None)[i % 4], len(t or ""), 1, "r", 2) for i, t in some_texts().items()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(docs, spark):
    """The same with repeated rows and a row without an id."""
    return docs.union(docs.where("doc_id in (0, 11)")).union(
        spark.createDataFrame([(None, some_texts()[0], None, None, None, None, None, None)], DOCS))


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def jaccard(texts: dict):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


def test_jaccard_join(docs, awkward):
    expected = jaccard(some_texts())
    got = jaccard_join.jaccard_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    got = jaccard_join.jaccard_components(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.component_id for r in got if r.doc_id is None} == {0}
    assert jaccard_join.jaccard_components(docs.where("false")).collect() == []


def test_stages_of_the_pipeline(spark, docs, awkward):
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    def rows_of(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    # another text under the id 0, and two more rows without an id, one of them with a text of its own
    table = awkward.union(spark.createDataFrame(
        [(0, "a wholly different text of six words or so", "en", "a", 1, 1, "r", 2), (None, some_texts()[0], "en", "a", 1, 1, "r", 2),
         (None, "nobody wrote these words under any number", "en", "b", 1, 1, "r", 2)], DOCS))
    rows = rows_of(table)
    known = pipeline.keep_known_languages(spark, table, "")
    want = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert Counter(rows_of(known)) == Counter(want) and known.where("lang is null").count() == 0
    single = pipeline.keep_one_of_similar(spark, known, "")
    groups = {}
    for k, (_, component) in jaccard(dict(enumerate(t for _, t in want))).items():
        groups.setdefault(component, []).append(want[k])
    got = rows_of(single)
    assert Counter(i for i, _ in got) == Counter(
        min((i for i, _ in group if i is not None), default=None) for group in groups.values())
    assert set(got) <= set(want) and len(got) == len(groups)
    cut = pipeline.cut_repeats(spark, single, "")
    data, count, size = [(t or "").encode() for _, t in got], Counter(), pipeline.REPEAT_BYTES
    for b in data:
        count.update(b[k : k + size] for k in range(len(b) - size + 1))
    want = []
    for (i, _), b in zip(got, data):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - size + 1):
            gone[k : k + size] |= count[b[k : k + size]] > 1
        rest = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        if rest.strip(" ") or not gone.any():
            want.append((i, rest))
    assert Counter(rows_of(cut)) == Counter(want)
    mixed = pipeline.mix_sources(spark, cut, "")
    assert Counter(rows_of(mixed)) == Counter(want)
    own, lengths, expected = Tokenizer.from_file(tokenizer_path()), Counter(), Counter()
    for r in pipeline.pack_sequences(spark, mixed, "").collect():
        lengths[r.doc_id] += r.length
    for i, text in want:
        expected[i] += len(own.encode(text, add_special_tokens=False).ids) + 1
    assert lengths == expected


def test_shared_passages_leave_the_corpus(spark):
    """Passages of 51 to 120 words that documents share are cut; what is around them stays."""
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(3, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passages = [make(n) for n in (51, 60, 75, 90, 120)]
    own = [make(70) for _ in range(40)]
    texts = [f"{own[2 * i]} {passages[i % 5]} {own[2 * i + 1]}" for i in range(20)]
    clean = [make(200) for _ in range(10)]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts + clean)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, table, "").collect()}
    for i in range(20):
        passage = passages[i % 5]
        assert not any(passage[k : k + 12] in got[i] for k in range(len(passage) - 11))
        assert own[2 * i][:-8] in got[i] and own[2 * i + 1][8:] in got[i]
    assert [got[20 + k] for k in range(10)] == clean


def test_large_clusters_are_joined_in_rounds(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOCAL_SHINGLES", 1)
    monkeypatch.setattr(jaccard_join, "ROUND_PIVOTS", 2)
    got = jaccard_join.jaccard_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard(some_texts())


def test_metric_join_of_a_cluster():
    rng = np.random.default_rng(1)
    centres = [rng.choice(5000, 60, replace=False) for _ in range(5)]
    sets = []
    for k in range(150):
        s = set(centres[k % 5].tolist())
        s = set(list(s)[rng.integers(0, 12):]) | set(rng.choice(5000, rng.integers(0, 8)).tolist())
        sets.append(np.array(sorted(s), dtype=np.uint64))
    cluster = jaccard_join.Cluster(sets, 80)
    cluster.join(np.arange(len(sets)))
    least = np.arange(len(sets))
    alike = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    for _ in sets:
        least = np.array([least[row].min() for row in alike])
    assert (cluster.root == least).all()


def variants_of_one(n: int, words: int, rng) -> list[list[str]]:
    """Texts of one base, some words replaced: near the threshold, a part of them links with no other."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for k in rng.choice(words, rng.integers(1, words // 12), replace=False):
            text[k] = f"x{i}_{k}"
        out.append(text)
    return out


def test_a_group_near_the_threshold_is_not_measured_text_by_text(monkeypatch):
    rng = np.random.default_rng(4)
    number = {}
    sets = []
    for text in variants_of_one(1500, 130, rng):
        grams = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
        sets.append(np.array(sorted(number.setdefault(g, len(number)) for g in grams), dtype=np.uint64))
    measured, measure = [], jaccard_join.Cluster.measure
    monkeypatch.setattr(jaccard_join.Cluster, "measure", lambda self, *a: measured.append(1) or measure(self, *a))
    cluster = jaccard_join.Cluster(sets, 80)
    cluster.join(np.arange(len(sets)))
    held = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, s.astype(int)] = 1
    both, size = held @ held.T, np.array([len(s) for s in sets])
    alike = 100 * both >= 80 * (size[:, None] + size - both)
    least = np.arange(len(sets))
    while True:
        new = np.array([least[row].min() for row in alike])
        if (new == least).all():
            break
        least = new
    assert (cluster.root == least).all()
    alone = np.unique(least, return_counts=True)[1]
    assert alone.max() > 300 and (alone == 1).sum() > 300
    assert len(cluster.links) == len(sets) - len(alone)
    assert len(measured) <= 50


@pytest.mark.parametrize("cells", [1 << 22, 200])
def test_products_of_blocks_count_common_and_rare_shingles(monkeypatch, cells):
    monkeypatch.setattr(jaccard_join, "CELLS", cells)
    monkeypatch.setattr(jaccard_join, "DENSE_CELLS", cells)
    rng = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([np.arange(rng.integers(5, 30)), rng.choice(200, rng.integers(1, 12))])).astype(np.uint64)
            for _ in range(90)]
    cluster = jaccard_join.Cluster(sets, 80)
    cluster.cross(np.arange(30), np.arange(30, 90))
    root = np.arange(90)
    for i in range(30):
        for j in range(30, 90):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert (cluster.root == root).all() and len(np.unique(root)) < 90
    assert all(i < 30 <= j for i, j in cluster.links)


def test_rounds_of_a_large_cluster_do_not_grow_with_it(spark, monkeypatch):
    texts = {i: " ".join(t) for i, t in enumerate(variants_of_one(45, 130, np.random.default_rng(6)))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rounds, staged = [], jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    monkeypatch.setattr(jaccard_join, "LOCAL_SHINGLES", 1)
    monkeypatch.setattr(jaccard_join, "ROUND_PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1500, raising=False)
    got = jaccard_join.jaccard_components(docs).collect()
    expected = jaccard(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len(Counter(c for _, c in expected.values())) > 10
    assert 2 < rounds.count("pivots") <= 3


def brute_repeats(texts: dict, length: int):
    data = {i: (t or "").encode() for i, t in texts.items()}
    count = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, awkward):
    expected = brute_repeats(some_texts(), 400)
    got = suffix_dedup.remove_repeats(docs, digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert sum(r.n_removed for r in got) > 1000
    rest = suffix_dedup.remove_repeats(awkward)
    assert {"lang", "source"} <= set(rest.columns)
    rows = [r for r in rest.collect() if r.doc_id == 11]
    assert [r.n_removed for r in rows] == [len(some_texts()[11].encode())] * 2
    assert suffix_dedup.remove_repeats(docs.where("false")).collect() == []


def test_suffix_dedup_leaves_lone_fragments_early(spark, monkeypatch):
    """Fragments with anchors of their own are not kept beyond the first count."""
    rng = np.random.default_rng(7)
    own = [rng.bytes(4000).hex() for _ in range(12)]
    shared = rng.bytes(300).hex()
    kept, rows = suffix_dedup.staged, {}

    def counted(frame, name):
        rows[name] = (table := kept(frame, name)).count()
        return table

    monkeypatch.setattr(suffix_dedup, "staged", counted)
    table = spark.createDataFrame([*enumerate(own), (12, own[0][:900] + shared), (13, shared + own[1][:100])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(table, digest=True).collect()}
    assert got == {**dict.fromkeys(range(1, 12), 0), 0: 900, 12: 1500, 13: 600}
    assert rows["kinds"] < rows["fragments"] / 3


def test_suffix_dedup_of_large_collections(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_COLLECTION", 1)
    got = suffix_dedup.remove_repeats(docs, digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(some_texts(), 400)


def test_no_core_has_more_pieces_than_a_collection(spark, monkeypatch):
    rng = np.random.default_rng(12)
    letters = lambda n: bytes(rng.choice(list(b"abcdefghij "), n).astype(np.uint8)).decode()
    passage = letters(900)
    texts = {i: letters(100 + i) + passage + letters(80) for i in range(40)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    most, plain = [0], suffix_dedup.shared_spans

    def shared_spans(pieces, length):
        most.append(max((r["count"] for r in pieces.groupBy("key").count().collect()), default=0))
        return plain(pieces, length)

    monkeypatch.setattr(suffix_dedup, "LARGE_COLLECTION", 6)
    monkeypatch.setattr(suffix_dedup, "shared_spans", shared_spans)
    got = suffix_dedup.remove_repeats(table, digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(texts, 400)
    assert max(most) <= 6


def test_packing(awkward, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    own.encode_special_tokens = True
    pieces = packing.pack(awkward, tokenizer_path(), with_ids=True).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
    for i, text in some_texts().items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted({(r.piece, r.start, tuple(r.ids)) for r in by_doc[i]})
        assert [x for _, _, part in rows for x in part] == ids
        assert all(len(part) == 2048 for _, _, part in rows[1:])
    fill = {}
    for r in pieces:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.where("false"), tokenizer_path()).collect() == []


def test_special_tokens_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), "rb") as file:
        encode = packing.encoder(file.read())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 2, f"{end}\n x", f"x  {end}", f"<|{end}|>", "<|endoftext|", "", *filter(None, some_texts().values())]
    for text in texts:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids
    assert encode(f"a {end} b") == [64, 220, 50256, 275]


def test_best_fit_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for capacity in (10, 64):
        lengths = rng.integers(1, capacity + 1, 300).tolist()
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            room = min(fits) if fits else capacity
            if fits:
                rooms.remove(room)
            rooms.append(room - x)
        plan = packing.best_fit_plan(Counter(lengths), capacity)
        assert sum(n for n, _ in plan) == len(rooms)
        used = Counter()
        for n, makeup in plan:
            assert sum(x * t for x, t in makeup) <= capacity
            for x, t in makeup:
                used[x] += n * t
        assert used == Counter(lengths)


def test_mixing_keeps_within_a_block():
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.25}
    parts = mixing.shares(weights, 64)
    plan, period = mixing.schedule(parts), sum(parts.values())
    assert sorted(x for slots in plan.values() for x in slots.tolist()) == list(range(period))
    for s, slots in plan.items():
        had = np.searchsorted(slots, np.arange(1, period + 1), "left")
        assert (np.abs(had - parts[s] / period * np.arange(1, period + 1)) < 1).all()


def test_mixing_keeps_within_a_block_of_the_given_weights():
    blocks = {f"s{k:02d}": 500 + 37 * k for k in range(19)} | {"hot": 30_000, "rare": 20}
    weights = mixing.tempered(blocks, 0.5) | {"rare": 0.05}
    plan = mixing.phases(blocks, weights)
    assert sorted(x for p in plan for v in p["plan"].values() for x in (v + p["start"]).tolist()) == list(range(sum(blocks.values())))
    for p in plan:
        length, total = sum(map(len, p["plan"].values())), sum(weights[s] for s in p["plan"])
        slots = np.arange(1, length + 1)
        for s, own in p["plan"].items():
            assert (np.abs(np.searchsorted(own, slots, "left") - weights[s] / total * slots) < 1 + 1e-6).all()
    assert sum(map(len, plan[0]["plan"].values())) > 4 * 1024


def test_mix(awkward, docs):
    got = mixing.mix(awkward, {"a": 3, "b": 1}, block=2, resolution=8).collect()
    assert len(got) == awkward.count()
    slots = Counter((r.mix_slot, r.source) for r in got)
    assert len({slot for slot, _ in slots}) == len(slots) and max(slots.values()) == 2
    assert sorted({slot for slot, _ in slots}) == list(range(len(slots)))
    assert all(r.mix_release <= r.mix_slot < r.mix_due for r in got)
    assert mixing.mix(docs.where("false")).collect() == []


def earliest_deadline_first(blocks: dict, weights: dict) -> list:
    """(source, block) by slot: the plain rule with exact fractions, begun anew when a source runs out."""
    done, order = {s: 0 for s in blocks}, []
    while any(done[s] < blocks[s] for s in blocks):
        live = {s: Fraction(weights[s]) for s in blocks if done[s] < blocks[s]}
        share = {s: w / sum(live.values()) for s, w in live.items()}
        had, slot = {s: 0 for s in live}, 0
        while all(done[s] < blocks[s] for s in live):
            released = [s for s in live if math.floor(had[s] / share[s]) <= slot]
            s = min(released, key=lambda s: (math.ceil((had[s] + 1) / share[s]), s))
            order.append((s, done[s]))
            had[s], done[s], slot = had[s] + 1, done[s] + 1, slot + 1
    return order


def test_mix_is_earliest_deadline_first_on_rows(spark):
    sizes, weights = {"a": 97, "b": 40, "c": 9, "d": 300}, {"a": 0.3, "b": 0.1, "c": 1 / 7, "d": 2.5}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4).collect()
    slots = {(r.source, r.mix_block): r.mix_slot for r in got}
    want = earliest_deadline_first({s: -(-n // 4) for s, n in sizes.items()}, weights)
    assert [b for b, _ in sorted(slots.items(), key=lambda x: x[1])] == want
    assert sorted(slots.values()) == list(range(len(want)))
    assert Counter(r.source for r in got) == sizes


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k % 5 if k % 3 else None, f"text {k % 90}", "a" if k % 4 else None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = Counter(mixing.mix(docs.repartition(1), block=4).collect())
    assert first == Counter(mixing.mix(docs.repartition(7), block=4).collect())
    assert first == Counter(mixing.mix(docs.orderBy(F.desc("text")), block=4).collect())


def test_language_id(spark, awkward, docs):
    rng = np.random.default_rng(5)
    speak = {"en": ["the", "of", "and", "that", "with"], "fr": ["le", "des", "était", "que", "dans"]}
    rows = [(i, " ".join(rng.choice(speak[lang], 40)), lang) for i in range(80) for lang in [("en", "fr")[i % 2]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_of_documents(table).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in got)
    assert {r.held_out for r in got} == {True, False}
    known = language_id.language_profiles(table)
    found = {r.doc_id: r for r in language_id.identify_languages(awkward, known).collect()}
    assert [found[i].lang_pred for i in (8, 9, 10, 18)] == ["und"] * 4
    assert language_id.language_of_documents(docs.where("false").select("doc_id", "text", "lang")).collect() == []


def test_rare_languages_keep_their_profile(spark, monkeypatch):
    import corpus_pipeline

    georgian = "დედა ენა არის ქართული"
    rows = [(i, f"the words of that text {i}", "en") for i in range(400)] + [(1000 + i, georgian, "ka") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    profiles = language_id.language_profiles(table, fitted=20)
    assert profiles[0] == ["en", "ka"]
    found = language_id.identify_languages(table.where("lang = 'ka'"), profiles).collect()
    assert [r.lang_pred for r in found] == ["ka"] * 3 and all(r.fit > 0 for r in found)
    # a label without a profile is not judged by the profiles of others
    english = language_id.language_profiles(table.where("lang = 'en'"))
    monkeypatch.setattr(language_id, "language_profiles", lambda docs: english)
    assert corpus_pipeline.keep_known_languages(spark, table, "").where("lang = 'ka'").count() == 3


def test_gram_counts_equal_plain_counting():
    letters = language_id.letter_table()
    texts = ["ab ab", "", "é9é x", "straße"]
    owner, gram, count = language_id.gram_counts(texts, letters)
    got = {}
    for o, g, c in zip(owner.tolist(), gram.tolist(), count.tolist()):
        got.setdefault(o, Counter())[g] = c
    for k, text in enumerate(texts):
        want = Counter()
        padded = " " + re.sub("[^a-zßé]+", " ", text).strip(" ") + " "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                part = padded[i : i + n]
                if part.strip(" ") and " " not in part[1:-1]:
                    code = 0
                    for c in part:
                        code = (code << 21) | ord(c)
                    want[code] += 1
        assert got.get(k, Counter()) == (want if text else Counter())


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 8)) * 2
    points = lattice_dedup.nearest_e8(x)
    assert (np.rint(2 * points) == 2 * points).all() and (points.sum(axis=1) % 2 == 0).all()
    for root in lattice_dedup.roots():
        assert (((x - points) ** 2).sum(axis=1) <= ((x - points - root) ** 2).sum(axis=1) + 1e-9).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 64))
    x[200:240] = x[0] + rng.normal(size=(40, 64)) * 0.15
    x[240:250] = x[100]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    odd = [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] + [1.0] * 63, 1), (303, [None] + [1.0] * 63, 1),
           (304, [], 1), (None, rows[0][1], 1), (5, rows[5][1], 1), (306, [1.0, 2.0], 1)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int")


def test_lattice_dedup(vectors):
    x, table = vectors
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in lattice_dedup.link_vectors(table).collect()}
    assert len(got) == 307 and got[None].n_links == 0 and got[None].component_id is None
    assert all(got[i].n_links == 0 and got[i].kept for i in (*range(300, 305), 306))
    found = sum(got[i].n_links for i in range(300))
    assert 0.95 * linked.sum() <= found and all(got[i].n_links <= linked[i].sum() for i in range(300))
    assert got[230].component_id == 0 and got[245].component_id == 100 and got[240].n_links == 10
    assert lattice_dedup.link_vectors(table.where("false")).collect() == []


def test_full_cells_are_dealt_out(vectors, monkeypatch):
    _, table = vectors
    whole = {r.vec_id: (r.n_links, r.component_id) for r in lattice_dedup.link_vectors(table).collect()}
    monkeypatch.setattr(lattice_dedup, "CELL_PART", 4)
    assert {r.vec_id: (r.n_links, r.component_id) for r in lattice_dedup.link_vectors(table).collect()} == whole


def test_multi_index_search(vectors, monkeypatch):
    x, table = vectors
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(multi_index_search, "LEAST", 60)
    monkeypatch.setattr(multi_index_search, "ROWS_PER_BLOCK", 128)
    got = {}
    for r in multi_index_search.nearest(table, share=0.4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, rows in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:20]
        hits += len({i for i, _ in rows} & set(order))
        assert all(abs(s - scores[i]) < 1e-9 for i, s in rows) and len(rows) == 20
    assert hits >= 0.9 * 20 * len(got)
    assert multi_index_search.nearest(table.where("false")).collect() == []
    few = multi_index_search.nearest(table.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2


def test_codes_within_a_radius_are_all_found():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << multi_index_search.SUBSTRING_BITS, size=(400, multi_index_search.SUBSTRINGS))
    index = multi_index_search.BlockIndex(codes)
    for radius in (0, 9, 40, 55, 70):
        near = np.flatnonzero(multi_index_search.distances(codes, codes[7]) <= radius)
        assert (index.within(codes[7], radius) == near).all()


def test_html_layout(spark):
    page = """<!doctype html><title>no</title><style>p{}</style><body><h1>Top &amp; one</h1><p>First<p>Second <b>bold</b>
      line<br>next<ul><li>a<li>b<ol start=3><li>c</ol></ul><div hidden>x</div><div style="display: none">y<p>z</p></div>
      <table><tr><td>k<td>long cell<tr><td>wide one<td>v</table><script>var a = "</p>";</script><pre> 1
  2</pre>tail"""
    text = html_layout.page_text(page)
    assert text == ("Top & one\n\nFirst\n\nSecond bold line\nnext\n\n- a\n- b\n  3. c\n\nk         long cell\nwide one  v\n\n 1\n  2\n\ntail")
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"
    assert html_layout.page_text(deep) == "deep\n\nafter"
    rows = [(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<<>&bogus;<p", "t"), (1, page, "t")]
    table = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_layout.extract_text(table).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 1, 2, 3, 4] and got[0].text == text and got[2].text is None and got[3].text == ""
    assert html_layout.extract_text(table.where("false")).collect() == []


def test_license_scan(awkward, docs):
    got = {r.doc_id: r for r in license_scan.scan(awkward).collect()}
    r = got[17]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 0, 6, "apache,gpl,mit")
    assert got[16].labels == "mit" and got[16].score == 1.0 and got[16].spans[0].first == 0
    assert (got[9].n_words, got[9].n_base, got[9].first_word, got[9].labels, got[9].score) == (0, 0, None, "", 0.0)
    assert license_scan.scan(docs.where("false")).collect() == []


def test_license_span_with_changed_words(spark):
    text = license_scan.TEMPLATES[2][1].replace("a copy of", "one copy of")
    table = spark.createDataFrame([(1, "x " * 50 + text), (2, text[:60])], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(table).collect()}
    assert got[1].labels == "mit" and 0.8 < got[1].score < 1 and got[2].labels == ""


def test_license_votes_count_once_and_in_order(spark):
    """Repeated or shuffled pieces of a template are no license."""
    mit, apache = license_scan.TEMPLATES[1][1], license_scan.TEMPLATES[3][1]
    texts = [" ".join(["licensed under the"] * 3), " ".join(["licensed under the"] * 500), "the mit license under the mit licensed under the",
             f"{mit} {mit}", "licensed under the " * 40 + apache, ""]
    table = spark.createDataFrame([(i, t, 1, "l") for i, t in enumerate(texts)], "doc_id long, text string, template int, label string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(table).collect()}
    assert got[0] == ("", 0.0) and got[1] == ("", 0.0) and got[5] == ("", 0.0)
    assert got[2] == ("mit", 0.0)  # the phrase alone
    assert got[3][0] == "mit" and got[3][1] >= 1.0 and got[4][0] == "apache"


def test_recurrent_lm(awkward, docs):
    texts = some_texts()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {i: [*words_of(t), None] for i, t in texts.items()}
    count = Counter(w for i in texts if not held(i) for w in tokens[i])
    total, kinds = sum(count.values()), len(count)
    got = {r.doc_id: r for r in recurrent_lm.score_documents(docs).collect()}
    for i, own in tokens.items():
        base = sum(np.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(w in count for w in own), total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert len(recurrent_lm.score_documents(awkward).collect()) == awkward.count()
    assert recurrent_lm.score_documents(docs.where("false")).collect() == []


def test_rare_words_are_counted_by_a_join(docs, monkeypatch):
    whole = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in recurrent_lm.score_documents(docs).collect()}
    monkeypatch.setattr(recurrent_lm, "SENT_WORDS", 4)
    monkeypatch.setattr(recurrent_lm, "VOCABULARY", 4)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in recurrent_lm.score_documents(docs).collect()} == whole


def test_training_reads_every_word_of_whole_documents(docs, monkeypatch):
    rng = np.random.default_rng(8)
    length = np.concatenate([rng.integers(1, 60, 150), [1, 700]])
    ends = np.concatenate([[0], np.cumsum(length)])
    words = np.arange(ends[-1]) % 68 + 2
    seen, begun, plain = [], 0, recurrent_lm.gradients

    def gradients(p, g, shape, into, targets, fresh, h):
        nonlocal begun
        seen.extend(targets[targets >= 0].tolist())
        begun += int(fresh.sum())
        # a word follows the one before it, except at the beginning of a document
        assert ((into == np.where(targets == 2, 69, targets - 1)) | fresh | (targets < 0)).all()
        return plain(p, g, shape, into, targets, fresh, h)

    monkeypatch.setattr(recurrent_lm, "gradients", gradients)
    shape = recurrent_lm.Shape(70)
    recurrent_lm.Trainer(shape, np.zeros(shape.size, dtype=np.float32)).run(words, ends, 0)
    assert Counter(seen) == Counter(words.tolist()) and begun == len(length)
    read, train = [], recurrent_lm.trained
    monkeypatch.setattr(recurrent_lm, "gradients", plain)
    monkeypatch.setattr(recurrent_lm, "trained", lambda *a: read.append(train(*a)) or read[-1])
    assert {r.train_tokens for r in recurrent_lm.score_documents(docs).collect()} == {read[0][1]}


def test_vocabulary_follows_the_counts(spark, monkeypatch):
    shapes, text = [], " ".join(f"w{k}" for k in range(3000))
    monkeypatch.setattr(recurrent_lm, "trained", lambda docs, shape, flat, codes, words: shapes.append(shape) or (flat, 0))
    table = spark.createDataFrame([(i, text + f" once{i}") for i in range(8)], "doc_id long, text string")
    got = recurrent_lm.score_documents(table).collect()
    # every word of the text, the end and the unknown word, in classes of about the root of their number
    assert 3002 <= shapes[0].words <= 3003 and 54 <= shapes[0].inner <= 56 and shapes[0].classes <= 58
    places = set(zip(shapes[0].class_of(np.arange(3002)).tolist(), shapes[0].place_of(np.arange(3002)).tolist()))
    assert len(places) == 3002 and all(r.score < 0 for r in got)


def test_models_sent_do_not_grow_with_the_pieces_of_the_table(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"one two three word{i % 7}") for i in range(400)], "doc_id long, text string").repartition(60)
    sent, frame = [], type(table)
    plain = frame.repartition

    def repartition(self, *to):
        if "v" in self.columns:
            sent.append(self.agg(F.sum(F.length("v"))).first()[0])
        return plain(self, *to)

    shapes, train = [], recurrent_lm.trained
    monkeypatch.setattr(recurrent_lm, "trained", lambda docs, shape, *a: shapes.append(shape) or train(docs, shape, *a))
    monkeypatch.setattr(frame, "repartition", repartition)
    assert recurrent_lm.score_documents(table).count() == 400
    # in each round four bytes a parameter from each core at most
    assert len(sent) == recurrent_lm.ROUNDS
    assert max(sent) <= 4 * shapes[0].size * spark.sparkContext.defaultParallelism


def test_places_of_codes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        # some codes share their first bits, and the greatest code is one of the table's last time
        codes = np.unique(np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), np.arange(n, dtype=np.uint64)]))
        if n > 2:
            codes = np.append(codes, np.uint64(2**64 - 1))
        asked = np.concatenate([codes, codes + np.uint64(1), rng.integers(0, 2**63, 50, dtype=np.uint64), [np.uint64(2**64 - 1)]])
        at = {int(c): i for i, c in enumerate(codes)}
        assert recurrent_lm.Places(codes)(asked).tolist() == [at.get(int(c), len(codes)) for c in asked]


def test_most_frequent_words_are_chosen_by_count_first(spark):
    counts = spark.createDataFrame([(k * 7 % 101, (1, 1, 1, 2, 2, 5, 9)[k % 7]) for k in range(101)], "code long, n long")
    rows = sorted(((r.n, r.code) for r in counts.collect()), key=lambda r: (-r[0], r[1]))
    for words in (1, 14, 15, 40, 101, 500):
        chosen = recurrent_lm.most_frequent(counts, words)
        assert [(r.n, r.code) for r in chosen.collect()] == rows[:words]
    # rows of smaller counts leave before the sort
    plan = recurrent_lm.most_frequent(counts, 14)._jdf.queryExecution().optimizedPlan().toString()
    assert "(n" in plan and ">= 9" in plan


def test_shares_of_all_words_make_one():
    counts = np.random.default_rng(1).integers(1, 90, 403)
    for words in (2, 3, 70, 403):
        shape = recurrent_lm.Shape(words)
        p = shape.views(recurrent_lm.initial(shape, counts[:words]))
        own = np.exp(recurrent_lm.word_log(p, shape, np.zeros((words, recurrent_lm.HIDDEN), np.float32), np.arange(words)))
        assert np.allclose(own, (counts[:words] + 0.5) / (counts[:words] + 0.5).sum(), rtol=1e-4)
        p["out0"][:], p["out3"][:] = p["out0"] * 40, p["out3"] * 40  # out of the range of exponentials
        h = np.random.default_rng(2).normal(size=(1, recurrent_lm.HIDDEN)).astype(np.float32).repeat(words, axis=0)
        assert np.isfinite(recurrent_lm.word_log(p, shape, h, np.arange(words))).all()


def test_gradients_of_the_model():
    rng = np.random.default_rng(6)
    shape = recurrent_lm.Shape(70)
    flat = (rng.normal(size=shape.size) * 0.3).astype(np.float64)
    words = rng.integers(0, 66, size=(4, 3))
    targets, fresh = rng.integers(0, 66, size=(4, 3)), np.zeros((4, 3), dtype=bool)
    fresh[0], fresh[2, 1] = True, True

    def loss(x):
        p, total = shape.views(x), 0.0
        h = np.zeros((3, recurrent_lm.HIDDEN))
        for t in range(4):
            h = np.where(fresh[t][:, None], 0, h)
            h = recurrent_lm.step(p, p["embed"][words[t]] @ p["wx"] + p["b"], h)[-1]
            total -= recurrent_lm.word_log(p, shape, h, targets[t]).sum()
        return total / 12

    g = np.zeros_like(flat)
    recurrent_lm.gradients(shape.views(flat), shape.views(g), shape, words, targets, fresh, np.zeros((3, recurrent_lm.HIDDEN)))
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[k]) < 2e-3 * max(1, abs(g[k]))


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 400, size=(260, 2)).tolist() + [[1000 + k, 1001 + k] for k in range(30)]
    least = {v: v for p in pairs for v in p}
    for _ in range(60):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame([Row(a=a, b=b) for a, b in pairs]).select(F.col("a").cast("long"), F.col("b").cast("long")))
    got = {r.vertex: r.component for r in got.collect()}
    assert got == {v: m for v, m in least.items() if v in got}
    assert all(v in got for a, b in pairs if a != b for v in (a, b))


def test_json_of_the_tokenizer_gives_the_ranks():
    with open(tokenizer_path(), "rb") as file:
        ranks = packing.byte_ranks(file.read())
    assert sorted(ranks.values()) == list(range(len(ranks)))
