"""The pipeline's stages, one after the other, against what each has to do."""

import corpus_pipeline
import pytest

from motifloom.llm.quality import score_quality
from motifloom.llm.shingle_join import similar_documents
from motifloom.llm.pii import KINDS, sanitise


@pytest.fixture(scope="module")
def stages(spark, data, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, data).write.parquet(str(folder / name))
        now = spark.read.parquet(str(folder / name))
        out.append(now)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage(spark, data, stages):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    ids = {r["doc_id"] for r in score_quality(stages[0], labels, ["doc_id"]).where("accepted = 1").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == ids and len(ids) < stages[0].count()
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(clean - ids) <= 0.02 * len(clean)


def test_near_duplicate_stage(stages):
    groups = {}
    for r in similar_documents(stages[1]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert rows(stages[2].select("doc_id")) == sorted([(min(g),) for g in groups.values()], key=str)


def test_personal_data_stage(stages):
    left = {r["doc_id"]: [s for s in r["pii_spans"] if s["kind"] in KINDS] for r in sanitise(stages[3], rewrite=False).collect()}
    assert not any(left.values())
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    changed = [i for i in before if before[i] != after[i]]
    found = {r["doc_id"] for r in sanitise(stages[2], rewrite=False).where("size(pii_spans) > 0").collect()}
    assert set(changed) == found
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_mix_and_pack_stages(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    times = {}
    for r in stages[4].collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert set(times) <= set(texts) and max(times.values()) <= 2
    words = sum(len(t.split()) for t in texts.values())
    assert sum(len(texts[i].split()) * n for i, n in times.items()) == pytest.approx(1.5 * words, rel=0.05)
    tokens = {}
    for r in stages[5].collect():
        tokens.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert {i: got for i, (got, _) in tokens.items()} == {i: n * tokens[i][1] for i, n in times.items()}


def test_run(spark, data, stages):
    assert rows(corpus_pipeline.run(spark, data).select("doc_id", "start", "doc_tokens").distinct()) != []


def test_odd_documents(spark, data, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, data)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, data).count() >= (docs is odd_docs)


def test_workers_give_back_memory(spark):
    """Workers of stages that came before don't hold what those needed."""
    import os
    import re
    import time
    from pathlib import Path

    import pyarrow as pa
    from pyspark.sql import functions as F

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")

    def probe(batches):
        list(batches)
        time.sleep(1)  # so that each task has a worker of its own
        held = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held])], names=["pid", "mb"])

    text = F.expr("concat_ws(' ', transform(sequence(1, 300), i -> substr(sha1(cast(id * 300 + i as string)), 1, 6)))")
    docs = spark.range(0, 20_000, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"))
    environment = spark.sparkContext.environment
    environment["WORKERS_OF"] = "test_workers_give_back_memory"  # workers that no other test has used
    try:
        similar_documents(docs).count()
        held = {r["pid"]: r["mb"] for r in spark.range(0, 4, 1, 4).mapInArrow(probe, "pid long, mb double").collect()}
    finally:
        del environment["WORKERS_OF"]
    assert max(held.values()) < 120
