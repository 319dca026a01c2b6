"""The pipeline's stages, each against plain Python or SQL on its own input."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from supplypanel.llm import decontamination, line_dedup, packing
from supplypanel.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output as rows by document."""
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return dict(zip([name for name, _ in corpus_pipeline.STAGES], out, strict=True))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scored = contract.queries()["op3_toxicity"](spark, FOLDER).collect()
    clean = {r.doc_id for r in scored if r.predicted == 0}
    assert texts(after) == {i: t for i, t in texts(before).items() if i in clean}


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    decided = {r[0]: r for r in con.execute(line_dedup.OP6_SQL).fetchall()}
    expected = {}
    for doc_id, text in texts(before).items():
        lines = text.split("\n")
        gone = {int(x) for x in decided[doc_id][3].split(",") if x}
        if len(gone) < len(lines):
            expected[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert texts(after) == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    sets, kept = {}, {}
    for i, text in sorted(texts(before).items()):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets[i] = {tuple(words[j : j + 4]) for j in range(max(len(words) - 3, 1))} if words else set()
    component = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                old, new = sorted((component[i], component[j]))[::-1]
                component = {k: new if c == old else c for k, c in component.items()}
    kept = {i for i, c in component.items() if i == c}
    assert set(texts(after)) == kept


def test_near_duplicates_by_five_words(spark):
    words = [f"w{k}" for k in range(395)]
    near = list(words)
    for at in range(20, 380, 45):  # 8 words: a Jaccard of 0.81 by five words, 0.849 by four
        near[at] = f"x{at}"
    by = {n: [{tuple(x[j : j + n]) for j in range(396 - n)} for x in (words, near)] for n in (4, 5)}
    share = {n: len(a & b) / len(a | b) for n, (a, b) in by.items()}
    assert share[5] >= 0.8 and share[4] < 0.85
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id bigint, text string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert [r.doc_id for r in out.collect()] == [1]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    gone = set(texts(before)) - set(texts(after))
    plain = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in texts(before).items()}
    whole = {
        i for i, t in plain.items() if any(" ".join(re.findall(r"\w+", x.lower())) in t for x in items)
    }
    assert whole <= gone
    found = {r.doc_id for r in decontamination.overlaps(before, table(spark, FOLDER, "benchmark")).collect()}
    assert gone == found


def test_packing(stages):
    before, after = stages["packing"]
    encoder = packing.Encoder(*packing.vocabulary_paths())
    pieces = after.toPandas()
    assert {i: n for i, n in pieces.groupby("doc_id").length.sum().items()} == {
        i: len(encoder(t)) // 4 + 1 for i, t in texts(before).items()
    }
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_run_is_the_stages_in_a_row(spark, stages):
    out = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = [sorted(tuple(r) for r in df.select(columns).collect()) for df in (out, stages["packing"][1])]
    assert rows[0] == rows[1]
