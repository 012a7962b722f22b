"""Each stage of the pipeline on what the last one kept, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm._tables import materialize
from ledgerframe.llm.quality import score_quality
from ledgerframe.llm.secret_scan import base_spans

from .data import clashing, corpus, frame
from .test_dedup import brute_components
from .test_text_operators import brute_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        if name == "pack":
            break
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and all(r.n_chars == len(r.text or "") for r in after.values())
        if name == "quality_filter":
            scores = {r.doc_id: r.predicted for r in score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert {*after} == {i for i, p in scores.items() if p == 1} and len(after) < len(before)
        elif name == "near_dedup":
            assert {*after} == {i for i, _, _, kept in brute_components([tuple(r) for r in before], 5, 80) if kept}
        elif name == "decontaminate":
            hit = {i for i, *_, bad in brute_hits([tuple(r) for r in before], bench, 10) if bad}
            assert all(after[r.doc_id].text == r.text for r in before if r.doc_id not in hit)
            assert not any(bad for *_, bad in brute_hits([tuple(r) for r in after.values() if r.doc_id in hit], bench, 10))
        elif name == "redact_secrets":
            for r in before:
                values = [r.text[v:e] for _, _, e, v in base_spans(r.text or "")]
                assert not any(x in after[r.doc_id].text for x in values)
                if not values:
                    assert len(re.findall(r"\[SECRET\]", after[r.doc_id].text)) <= 2
    packed = docs.toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in before} and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


NAMES = ["score", "held_out", "predicted", "n_words", "contaminated", "_hits", "_items", "spans", "n_hex", "_text", "clean_text", "carried", "kept", "component", "rank", "row"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Awkward rows with null and clashing columns, and a folder of labels and a benchmark."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = corpus() + [(9000, "see token = \"ffc3105535f423f352535e4ac53b5fefe076ac6d\" here", None, None, None), (9001, "one two three four five six seven eight nine ten eleven", None, "s", None), (9001, "one two three four five six seven eight nine ten eleven", None, "s", None)]
    labels = [(i, 1 if t else 0, None) for i, t, *_ in rows if i is not None] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, None), (None, "x"), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = clashing(frame(spark, rows)).withColumns({n: F.when(F.col("doc_id") % 2 == 0, F.lit(n)) for n in NAMES})
    return folder, rows, materialize(docs, "awkward")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, awkward, name, stage):
    folder, rows, docs = awkward
    got = stage(spark, docs, folder)
    if name == "pack":
        whole = got.groupBy("doc_id", "start").count().filter("start = 0").agg(F.sum("count")).first()[0]
        assert whole == len(rows)
        return
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    out = [r.asDict() for r in got.collect()]
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert {tuple(r[c] for c in others) for r in out} <= {tuple(r[c] for c in others) for r in map(lambda r: r.asDict(), docs.collect())}
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out)
    every = sorted((-1 if i is None else i) for i, *_ in rows)
    if name == "redact_secrets":
        assert ids == every
        assert {r["text"] for r in out if r["doc_id"] == 9000} == {'see token = "[SECRET]" here'}
    elif name == "decontaminate":
        assert ids == every and [r["text"].strip() for r in out if r["doc_id"] == 9001] == ["eleven", "eleven"]
    elif name == "near_dedup":
        assert sum(i == 9001 for i in ids) == 2 and ids.count(-1) == 2
        gone = {i for i, _, _, kept in brute_components([(i, t) for i, t, *_ in rows], 5, 80) if not kept}
        assert {*ids} == {*every} - gone
    else:
        texts = {(r["doc_id"], r["text"]) for r in out}
        assert texts <= {(i, t) for i, t, *_ in rows} and 9000 in ids


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_no_rows(spark, awkward, name, stage):
    folder, _, docs = awkward
    assert stage(spark, docs.limit(0), folder).collect() == []
