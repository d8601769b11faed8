import gc
import weakref
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from noticelake.llm import _shared, bpe, exact_dedup, simhash, toxicity

LINES = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()


def test_coder_goes_when_another_stage_begins():
    coder = weakref.ref(bpe.Coder.get(LINES, public_tokenizers.PATTERN))
    key = bpe.coder_key(LINES, public_tokenizers.PATTERN)
    assert list(_shared.lean(iter, key)([1, 2])) == [1, 2] and bpe.Coder.get(LINES, public_tokenizers.PATTERN) is coder()
    assert list(_shared.lean(iter)([3])) == [3]
    gc.collect()
    assert coder() is None


@pytest.mark.parametrize("stage, module, inner", [("drop_toxic", toxicity, "reject"), ("drop_exact_copies", exact_dedup, "drop_copies"), ("drop_near_copies", simhash, "keep_one"), ("encode", bpe, "encode")])
def test_rows_reach_python_in_small_batches(spark, tmp_path, monkeypatch, stage, module, inner):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int32())]))

    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    monkeypatch.setattr(module, inner, lambda docs, *rest: docs.mapInArrow(sizes, "n int"))
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: None)
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        spark.conf.set(most, 10_000)
        found = [r.n for r in getattr(corpus_pipeline, stage)(spark, spark.range(5000).coalesce(1), str(tmp_path)).collect()]
        assert sum(found) == 5000 and max(found) <= 2000
        spark.conf.set(most, 500)  # what the session has smaller stays
        getattr(corpus_pipeline, stage)(spark, spark.range(1), str(tmp_path))
        assert spark.conf.get(most) == "500"
    finally:
        spark.conf.set(most, before)
