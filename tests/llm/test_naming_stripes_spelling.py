"""Exact duplicates, phrases and spelling variants against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import block_naming, collocations, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, n long, name string, level int, key string"


def some_texts() -> list:
    rng = np.random.default_rng(7)
    words = ["the", "of", "Zürich", "éaument", "station", "statlon", "statoin", "stations", "tations", "gaugings", "gauging", "x1"]
    make = lambda n: " ".join(rng.choice(words, n))
    long = make(4000)
    texts = [None, "", " ", "\t\n", long, long, long + ".", long[:-1], long.replace(" ", "\n\n", 40), "a", "a" * 16, "a" * 17, "a" * 32,
             "b" + "a" * 16, "a a", "a a", "a  a", "é" * 9, "New York, new york. NEW YORK! new\tyork;york"]
    texts += [make(300) for _ in range(12)] + ["station " * 4000, "stations " * 40000] + ["flood warning in force " * 20, "flood warning in", "\N{GRINNING FACE}" * 20]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], 1, "n", 2, "k") for i, t in enumerate(some_texts())]
    rows += [rows[4], rows[9], (None, some_texts()[4], "en", 1, "n", 2, "k"), (None, "alone", None, 1, "n", 2, "k"), (None, "alone", None, 1, "n", 2, "k")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_equal_texts_have_one_identity(docs):
    rows = [(r.doc_id, re.sub("[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text].append(i)
    least = {text: min((i for i in ids if i is not None), default=None) for text, ids in groups.items()}
    expected = Counter((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    alike = lambda block: F.length(block).cast("long") % 3
    for size, code in ((16, F.xxhash64), (4096, alike)):  # texts of many blocks; different blocks under one code
        got = block_naming.exact_duplicates(docs, block_bytes=size, code=code).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
        kept = [r for r in got if r.kept]
        assert Counter(r.text_sha256 for r in kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_names_tell_apart_what_differs_anywhere(spark):
    base = ("0123456789abcdef" * 9)[:-5]
    texts = [base] + [base[:k] + "#" + base[k + 1 :] for k in range(0, len(base), 7)] + [base[:-1], base + "x", base[16:] + base[:16]]
    rows = spark.createDataFrame([(i, t, "t") for i, t in enumerate(texts + texts)], "doc_id long, text string, name string")
    got = block_naming.exact_duplicates(rows, block_bytes=16, code=lambda block: F.xxhash64(F.substring(block, 1, 2))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % len(texts), 2) for i in range(2 * len(texts))}


def test_no_rows(docs):
    none = docs.where("false")
    assert block_naming.exact_duplicates(none).collect() == []
    assert collocations.phrase_scores(none).collect() == []
    assert spelling.spelling_variants(none).collect() == []


def phrases(rows, least, top=2000):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in (1, 2, 3, 4):
                count[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n[lang], -score)
    return out


@pytest.mark.parametrize("least, hot, piece", [(3, 1024, 8 << 20), (2, 1 << 40, 500)])
def test_phrases(docs, monkeypatch, least, hot, piece):
    monkeypatch.setattr(collocations, "HOT", hot)  # the second: every prefix goes in parts
    monkeypatch.setattr(collocations, "SLICE", piece)
    expected = phrases([(r.text, r.lang) for r in docs.collect()], least)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.phrase_scores(docs, least=least).collect()}
    assert got == expected and len({lang for lang, _ in got}) == 3
    top = collocations.phrase_scores(docs, least=least, top=3).collect()
    assert {(r.lang, r.rank) for r in top} == {key for key in expected if key[1] <= 3}


def test_large_counts_are_exact(spark):
    """Scores stay whole numbers where the product is beyond 64 bits."""
    rows = spark.sql("select 9000000000000L as a, 9000000000001L as l, 9000000000007L as r")
    score = rows.select(F.expr(collocations.SCORE)).first()[0]
    assert score == 2000000 * 9000000000000 // (9000000000001 + 9000000000007)


def near(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def variants(counts, ratio=10):
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[v], v) for v in counts if v != w and near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = len(others)
    result = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, out[w], counts[form[w]] if form[w] else None))
    return result


def words_of(rows, damaged=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


@pytest.mark.parametrize("damaged", [31, 2])
def test_spelling_variants(docs, damaged):
    expected = variants(words_of([(r.doc_id, r.text) for r in docs.collect()], damaged))
    got = spelling.spelling_variants(docs, damaged=damaged).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected and len(got) == len(expected)
    assert any(r.form for r in got)


@pytest.mark.parametrize("key_words, tile", [(1024, 256), (4, 3), (1, 1)])
def test_near_words_over_finer_keys(spark, monkeypatch, key_words, tile):
    """Full keys are refined down to two free code points; each pair is found once."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(400)} | {"a" * k for k in range(1, 40)} | {
        "x" * 300, "x" * 299 + "y", "x" * 301, "y" + "x" * 299, "x" * 150 + "\N{GRINNING FACE}" + "x" * 150}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.integers(1, 5, len(words)))}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(table, key_words).collect()}
    expected = {}
    for w in counts:
        others = sorted((-counts[v], v) for v in counts if v != w and near(w, v))
        if others:
            expected[w] = (len(others), -others[0][0], others[0][1])
    assert got == expected


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("u", "w3")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w9") for i in range(9)} | {("u", "w9")}
