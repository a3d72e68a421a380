"""The pipeline stage by stage against brute force."""

from collections import Counter

import corpus_pipeline as cp
import pytest
import test_documents as plain
import test_near_dedup
import test_pii
from pyspark.sql import functions as F
from seriesmill.llm import quality


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    out.append(docs)
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs)
    return out


def test_columns_are_those_of_documents(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_stage(spark, sf_dir, steps):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.trained_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if quality.judge(model, r.text)[-1]}
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept == want and 0 < len(kept) < docs.count()
    assert not any(plain.plain_base(r.text)[-1] for r in steps[1].collect())


def test_near_duplicate_stage(steps):
    want = test_near_dedup.plain_groups({r.doc_id: r.text for r in steps[1].collect()})
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(set(want.values()))


def test_personal_data_stage(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[2:4])
    assert set(before) == set(after)
    changed = 0
    for k, r in after.items():
        assert not test_pii.brute(r.text) and r.n_chars == len(r.text)
        if not test_pii.brute(before[k].text) and r.text != before[k].text:
            assert "[SECRET]" in r.text or "[PHONE]" in r.text or "[SSN]" in r.text or "[EMAIL]" in r.text
        changed += r.text != before[k].text
    assert changed


def test_mixing_stage(steps):
    before, after = ({r.doc_id for r in df.collect()} for df in steps[3:5])
    assert before == after
    times = Counter(r.doc_id for r in steps[4].collect())
    assert max(times.values()) <= cp.REPEATS + 1 and steps[4].count() > steps[3].count()


def test_encoding_stage(spark, sf_dir, steps):
    assert steps[5].count() == steps[4].count()
    last = cp.run(spark, sf_dir)
    key = lambda df: Counter(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert key(last) == key(steps[5])
    same = steps[5].join(steps[4].select("doc_id", F.sha2("text", 256).alias("h")).distinct(), "doc_id").where("h <> decoded_sha256").count()
    assert same == 0


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
