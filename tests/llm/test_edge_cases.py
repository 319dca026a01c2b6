"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from supplypanel.llm import (
    decontamination,
    html_extraction,
    line_dedup,
    near_vectors,
    ngram_join,
    packing,
    sharding,
    token_counts,
    toxicity,
    url_filter,
)

LONG = "river stone lantern " * 40_000
ROWS = [
    (1, "one two three four five six\nseven eight nine ten eleven", "x"),
    (1, "one two three four five six\nseven eight nine ten eleven", "x"),
    (2, None, None),
    (3, "", "y"),
    (4, "  \n\n \t", "z"),
    (5, LONG, "z"),
    (6, "word", "n"),
    (7, "word", "n"),
    (None, "one two three four five six", None),
    (8, "Ünïcode 日本語 😀 emoji\r\nend", "k"),
]
NAMES = "doc_id bigint, text string, {}"
# columns that the operators use inside or return
CLASHES = ("score", "shard", "n", "line", "words", "component", "place", "length", "node", "rule")


@pytest.fixture
def docs(spark):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(*r[:2], *[r[2]] * len(CLASHES)) for r in ROWS]
    return spark.createDataFrame(rows, NAMES.format(extra)).repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts(docs):
    path = token_counts.vocabulary_path()
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert out[2] == out[3] == 0 and out[6] == out[7] > 0 and out[5] > 100_000
    assert token_counts.token_counts(docs, path).count() == len(ROWS)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_sharding(docs):
    own = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    out = sharding.shard_documents(own, sharding.PRODUCTION).collect()
    assert len(out) == len(ROWS)
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(own.limit(0), sharding.PRODUCTION).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (6, None), (99, 0), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)  # only one class: nothing can be trained
    assert model.flat is not None
    clean = "a calm text about boats and rivers"
    many = [(i, f"{clean} {i} idiot idiot" if i % 2 else f"{clean} {i}") for i in range(60)]
    model = toxicity.fit(
        spark.createDataFrame(many, "doc_id bigint, text string"),
        spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int"),
    )
    out = toxicity.score_documents(docs, model, docs.columns, ("_s", "_p"))
    assert out.columns == [*docs.columns, "_s", "_p"]
    scores = [r["_s"] for r in out.collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert out.where("doc_id in (2, 3)").select("_s").distinct().count() == 1
    assert toxicity.score_documents(docs.limit(0), model, ["doc_id"]).count() == 0
    assert toxicity.fit(docs.limit(0), labels.limit(0)).flat == 0.0


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, None, "r"), (2, "", "r"), (3, "no scheme", "r"), (None, "http://", "r"), (4, "a://B.NET", "r"),
         (5, "x" * 100_000 + "://h.net/", "r"), (5, "x" * 100_000 + "://h.net/", "r")],
        "page_id bigint, url string, rule string",
    )
    model = url_filter.default_model()
    out = got(url_filter.judge(pages, "page_id", url_filter.RULES, model), "page_id", "host", "path", "rule", "verdict")
    assert out[:4] == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "b.net", "", None, out[3][4]),
    ]
    assert out[4] == out[5] == (5, "h.net", "/", "net/", "block")
    assert url_filter.judge(pages.limit(0), "page_id", url_filter.RULES, model).count() == 0


def test_ngram_join(docs):
    out = got(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert out == sorted(
        [(1, 8, 1), (1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 3, 5), (6, 1, 6), (7, 1, 6),
         (8, 2, 8), (None, 3, None)],
        key=repr,
    )
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(docs):
    out = got(line_dedup.dedup_lines(docs, names=("_a", "_b")), "doc_id", "text", "_a", "_b")
    by_id = {r[0]: r for r in out}
    assert len(out) == len(ROWS)
    assert by_id[2] == (2, None, 0, 0) and by_id[3] == (3, "", 0, 0)
    assert by_id[4][1:] == ("  \n\n \t", 3, 0)
    assert by_id[6] == (6, "word", 1, 0) and by_id[7] == (7, "", 1, 1)
    assert by_id[None][1] == "one two three four five six"
    assert [r[2:] for r in out if r[0] == 1] == [(2, 0), (2, 0)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_near_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]),
        (11, [1.0, 0.0, 0.0]), (12, [1e-30, 0.0]), (None, [0.0, -1.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out, _ = near_vectors.near_vectors(vectors)
    assert got(out, "vec_id", "n_links", "component_id", "kept") == sorted(
        [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (11, 4, 1, False), (12, 4, 1, False),
         (10, 1, 10, True), (10, 1, 10, True), (None, 0, None, False)]
        + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9)],
        key=repr,
    )
    assert near_vectors.near_vectors(vectors.limit(0))[0].count() == 0


def test_html_extraction(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "http://a.b/", "<p>x"), (3, "http://a.b/", "<p>x"),
            (None, "nothing", "plain &amp text <b>bold"), (4, "u://h", "<p>" + "w " * 300_000)]
    pages = spark.createDataFrame(
        [(*r, "e", "e") for r in rows], "page_id bigint, url string, html string, text string, host string"
    )
    out = got(html_extraction.extract(pages, "page_id"), "page_id", "text", "n_chars")
    assert [r for r in out if r[0] in (1, 2, 3, None)] == sorted(
        [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (None, "plain & text bold", 17)], key=repr
    )
    assert [r[2] for r in out if r[0] == 4] == [599_999]
    assert html_extraction.extract(pages.limit(0), "page_id").count() == 0


def test_packing(docs):
    out = packing.pack(docs, packing.vocabulary_paths()).collect()
    assert {r.length for r in out if r.doc_id in (2, 3)} == {1}
    assert {r.doc_id for r in out} == {r[0] for r in ROWS}
    taken = {}
    for r in out:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), packing.vocabulary_paths()).count() == 0


def test_decontamination(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    tests = spark.createDataFrame(
        [(1, item), (2, None), (3, ""), (None, item), (4, "to be"), (1, item)], "item_id bigint, text string"
    )
    out = decontamination.contaminated(docs, tests)
    assert got(out, "doc_id", "item_id") == [(1, 1)]
    assert decontamination.contaminated(docs.limit(0), tests).count() == 0
    assert decontamination.contaminated(docs, tests.limit(0)).count() == 0
