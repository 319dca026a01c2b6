"""Phrase mining, licence scan and whitening against plain Python, numpy and SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_compare import connect, differences
from pyspark.sql import functions as F

from supplypanel.llm import license_scan, phrases, whitening

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# Phrases.


def best_phrases(rows, top, least):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = set()
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if 2 <= len(g) and a >= least}
        held = defaultdict(int)
        for g, a in candidates.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    held[g[i : i + size]] = max(held[g[i : i + size]], a)
        scored = []
        for g, a in candidates.items():
            cuts = [(2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            if 100 * held[g] < 80 * a:
                scored.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, totals[lang], -score))
    return out


def mined(df, **options):
    return {tuple(r) for r in phrases.phrases(df, **options).collect()}


@pytest.mark.parametrize("first_place", [1, 40, 100_000])
def test_phrases_agree_with_brute_force(spark, first_place):
    """Whatever the frontier begins with."""
    rng = random.Random(first_place)
    words = "a b c d e f G h é Éa 日本".split()
    rows = []
    for _ in range(500):
        lang = rng.choice(["x", "x", "x", "y", None])
        chosen = rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40))
        fixed = ["a b c d"] * rng.randint(0, 2) + ["é h G"] * rng.randint(0, 2)
        blanks = rng.choices([" ", "  ", "\t", ", ", "\n", ".", "\r!"], weights=[8, 1, 1, 1, 1, 1, 1], k=60)
        rows.append((lang, "".join(w + b for w, b in zip([*chosen, *fixed], blanks))))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = mined(df, top=25, least=8, first_place=first_place)
    assert got == best_phrases(rows, 25, 8) and len(got) > 25


def test_phrases_agree_with_sql(spark):
    out = phrases.op13_phrase_mining(spark, SMALL)
    assert differences(out, connect(SMALL), phrases.OP13_SQL) == []


def test_phrases_of_long_texts_cross_their_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_BYTES", 64)
    monkeypatch.setattr(phrases, "RUN_BYTES", 64)
    monkeypatch.setattr(phrases, "BUFFERED", 50)
    rng = random.Random(2)
    rows = [("x", "".join(rng.choice(["u ", "v ", "w\t", "long. ", "z\n"]) for _ in range(2000)))]
    texts = [rows[0][1], " . . ", "..a", "a..", "", ". a b", "x" * 200 + " .y", "b a", "b a", "q" * 30]
    texts = texts[1:] + texts + texts[3:]
    runs = list(phrases.numbered_runs([t.encode() for t in texts], ["l"] * len(texts), 0))
    assert len(runs) > 3
    got = [[]]
    for flat, _ in runs:
        for number in [0, *flat.tolist()]:
            if number:
                got[-1].append(number)
            else:
                got.append([])
    got = [g for g in got if g]
    pieces = [re.findall("[^\x20\x09]+", p) for t in texts for p in re.split("[.,;:!?\x0a-\x0d]", t)]
    pieces = [p for p in pieces if p]
    assert [len(g) for g in got] == [len(p) for p in pieces]
    by_name = {}
    for g, p in zip(got, pieces):
        assert all(by_name.setdefault(w, n) == n for w, n in zip(p, g))
    names = {(number, name.decode()) for _, named in runs for _, number, name in named}
    assert names == {(number, word) for word, number in by_name.items()}
    assert mined(spark.createDataFrame(rows, "lang string, text string"), least=5) == best_phrases(rows, 2000, 5)


def test_phrase_bounds_are_admissible():
    rng = random.Random(3)
    for _ in range(2000):
        a = rng.randint(1, 50)
        q = a + rng.randint(0, 20)
        s = q + rng.randint(0, 100)
        r = a + rng.randint(0, 100)
        assert 2_000_000 * a // (s + r) <= 2_000_000 * q // (s + q)


def test_phrases_edge_cases(spark):
    names = "doc_id bigint, lang string, text string, a string, score string, w1 string"
    none = spark.createDataFrame([], names)
    assert phrases.phrases(none).collect() == []
    rows = [(None, None, None, "k", "k", "k"), (1, "x", "", "k", "k", "k"), (2, "x", " ,. \t", "k", "k", "k")]
    df = spark.createDataFrame(rows, names)
    assert phrases.phrases(df).collect() == []
    repeated = spark.createDataFrame([(1, None, "one two", "k", "k", "k")] * 40, names)
    got = [tuple(r) for r in phrases.phrases(repeated).collect()]
    assert got == [("und", 1, "one two", 40, 40, 40, 80, 1_000_000)]


# Licences.


def plain_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [i for i, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    return len(words), len(at), min(at, default=None), max(at, default=None), base


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, labels string, key string, at int")
    out = license_scan.scan_licenses(df.repartition(3)).collect()
    return sorted((tuple(r) for r in out), key=repr)


def test_license_base_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = license_scan.op12_license_scan(spark, SMALL).collect()
    assert len(out) == docs.count()
    for r in out:
        expected = plain_scan(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
        if "CC BY-NC 4.0" in texts[r.doc_id]:
            assert "cc by nc" in r.labels


def altered(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = "changed"
        elif kind == 1:
            words.insert(k, "added")
        else:
            del words[k]
    return words


def test_license_templates_are_found_when_altered(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    filler = "river stone lantern harbour window copper".split()
    for number, (label, text) in enumerate(license_scan.TEMPLATES):
        words = re.findall("[0-9A-Za-z]+", text)
        for copy in range(4):
            inside = altered(rng, words, copy * (len(words) // 20))
            around = [rng.choice(filler) for _ in range(rng.randint(0, 300))]
            doc = number * 10 + copy
            rows.append((doc, " ".join([*around, *inside, *around]), None, None, None))
            expected[doc] = label
    rows += [(9000 + i, " ".join(rng.choice(filler) for _ in range(200)), "x", "x", 1) for i in range(30)]
    out = {r[0]: r for r in scanned(spark, rows)}
    for doc, label in expected.items():
        assert label in out[doc][6].split(","), (label, out[doc])
    assert all(out[9000 + i][6] == "" and out[9000 + i][7] == 0 for i in range(30))


def test_license_edge_cases(spark):
    long = "filler word " * 60_000 + "Released, under the MIT-License. " + "more " * 1000
    rows = [
        (None, "mit license", "x", "x", 1),
        (1, None, None, None, None),
        (2, "", None, None, None),
        (2, "", None, None, None),
        (3, long, "x", "x", 1),
        (4, "Apache\nLICENSE apache license", "x", "x", 1),
        (4, "Apache\nLICENSE apache license", "x", "x", 1),
        (5, "mïtlicense mit licensed", "x", "x", 1),
    ]
    out = scanned(spark, rows)
    assert len(out) == len(rows)
    by_id = {r[0]: r[1:] for r in out}
    assert by_id[None] == (2, 1, 0, 0, "mit", "mit", 1.0)
    assert by_id[1] == by_id[2] == (0, 0, None, None, "", "", 0.0)
    assert by_id[3][1:4] == (1, 120_003, 120_003) and by_id[3][5] == "mit"
    assert by_id[4] == (4, 2, 0, 2, "apache", "apache", 1.0)
    assert by_id[5][1] == 0
    assert scanned(spark, []) == []


# Whitening.


def test_whitening_agrees_with_numpy(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = vectors.toPandas()
    x = np.floor(1024 * np.stack(own.embedding).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    covariance = (off / n).T @ (off / n) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    white = off / n @ axes[:, :8] / np.sqrt(values[:8])
    out = whitening.whiten(vectors).toPandas()
    assert len(out) == 8 * n and set(out.n) == {n}
    wide = out.pivot(index="vec_id", columns="component", values="whitened").loc[own.vec_id].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(white)).max() < 1e-9
    signs = np.sign(wide * white)
    assert (signs == signs[0]).all()
    deviation = out.groupby("vec_id").deviation.first().loc[own.vec_id].to_numpy()
    assert (deviation == (off * off).sum(axis=1)).all()
    explained = out.groupby("component").explained.first().to_numpy()
    assert np.abs(explained / (values[:8] / np.trace(covariance)) - 1).max() < 1e-9
    error = np.abs(wide.T @ wide / n - np.eye(8)).max()
    assert out.identity_error.nunique() == 1 and 0 <= out.identity_error[0] < 1e-6 and error < 1e-6


def test_whitening_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id int, embedding array<double>")
    out = whitening.whiten(df.repartition(6)).toPandas()
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert wide.shape == (500, 5)
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(5)).max() < 1e-8


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, 2.0], "x", "x"),
        (1, [0.5, 1.0, 2.0], "x", "x"),
        (None, [3.0, -1.0, 2.0], None, "x"),
        (2, [9.0, 4.0, 2.0], "x", None),
        (3, None, "x", "x"),
        (4, [1.0, None, 2.0], "x", "x"),
        (5, [1.0, nan, 2.0], "x", "x"),
        (6, [1.0, inf, 2.0], "x", "x"),
        (7, [], "x", "x"),
        (8, [1.0], "x", "x"),
    ]
    names = "vec_id bigint, embedding array<float>, row string, n string"
    out = whitening.whiten(spark.createDataFrame(rows, names).repartition(3)).collect()
    assert len(out) == 8  # the third dimension does not vary
    assert {r.n for r in out} == {4} and {r.component for r in out} == {1, 2}
    assert {r.vec_id for r in out} == {None, 1, 2}
    assert whitening.whiten(spark.createDataFrame(rows[4:], names)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], names)).collect() == []
    assert whitening.whiten(spark.createDataFrame(rows[:2], names)).collect() == []
    large = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [0.0, 5.0])]
    big = whitening.whiten(spark.createDataFrame(large, "vec_id int, embedding array<double>")).collect()
    assert {r.deviation for r in big if r.vec_id != 3} == {None}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id int, embedding array<double>"))
