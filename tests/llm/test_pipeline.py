"""The pipeline's stages, each against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgraph.llm.queries import ORACLES, QUERIES

from .test_operators import PASSAGE, brute_components, brute_passages, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    docs = [(i, prose(70, 1000 + i).replace(". ", ".\n")) for i in range(90)]
    docs += [(100 + i, " ".join(r.choice(["###", "BUY!!", "$$$"]) for _ in range(60))) for i in range(60)]
    base = prose(150, 77)
    docs += [(200 + i, base + f" tail{i}") for i in range(5)]
    docs += [(300 + i, prose(70, 3000 + i) + "\n" + PASSAGE + "\n" + prose(60, 4000 + i)) for i in range(4)]
    docs += [(400, None), (401, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 160), 0) for i, _ in docs[:150]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.keep_good(spark, docs, folder).cache()
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} >= set(range(90)) | set(range(200, 205)) and not {r.doc_id for r in good.collect()} & set(range(100, 160))
    kept = corpus_pipeline.keep_content(spark, good, folder).cache()
    assert {r.doc_id for r in kept.collect()} >= set(range(90)) and kept.columns == docs.columns
    unique = corpus_pipeline.drop_near_copies(spark, kept, folder).cache()
    table = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in unique.collect()} == {i for i, (_, c) in brute_components(table, 5, 80).items() if i == c}
    cut = {r.doc_id: r for r in corpus_pipeline.cut_passages(spark, unique, folder).collect()}
    for i, ((n, gone, *_),) in brute_passages([(r.doc_id, r.text) for r in unique.collect()], corpus_pipeline.PASSAGE_BYTES).items():
        assert abs(len(cut[i].text.encode()) - (n - gone)) <= 6 and cut[i].n_chars == len(cut[i].text)
    assert sum(PASSAGE in r.text for r in cut.values()) == 1


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.filter("length > 0").count() == out.count() > 0 and out.filter(F.col("offset") + F.col("length") > 1024).count() == 0


def test_registered():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == sorted(QUERIES, key=lambda q: (len(q.split("_")[0]), q.split("_")[0])) and len(QUERIES) == 10 and set(ORACLES) <= set(QUERIES)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    """Of a document's rows one stays, of a component one document; rows without a doc_id stay; other columns, whatever their names, go."""
    base = prose(120, 5)
    rows = [(1, base), (1, base), (2, base + " tail"), (2, base + " tail"), (3, prose(120, 6)), (3, prose(120, 6)), (4, "b " + prose(90, 7)), (4, "a " + prose(90, 8)), (None, base), (None, base), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "x", 2, "copy") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, n int, why string")
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert found == sorted([(1, base), (3, prose(120, 6)), (4, "a " + prose(90, 8)), (None, base), (None, base), (5, None), (6, "")], key=repr)
    for stage in (corpus_pipeline.cut_passages, corpus_pipeline.pack):
        assert stage(spark, df, "").count() >= len(rows) - 4
