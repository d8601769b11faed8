import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from noticelake.llm._shared import crc_mod, written
from noticelake.llm.bpe import read_ranks
from noticelake.llm.toxicity import THRESHOLD, scores, train


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept, names = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], sf_dir), "test"))
        assert kept[-1].columns == names
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in kept]
    model = train(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    assert sorted(ids[1]) == sorted(r.doc_id for r in scores(docs, model).collect() if r.score < THRESHOLD)
    first = {}
    for r in sorted(kept[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(" ".join(r.text.replace("\n", " ").split(" ")), r.doc_id)
    assert len(ids[2]) == len(set(ids[2])) and set(first.values()) >= set(ids[2]) and set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])
    texts = {r.doc_id: r.text for r in docs.collect()}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(Path(corpus_pipeline.RANKS).read_bytes()), special_tokens={})
    result = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf_dir).collect()
    assert sorted(r.doc_id for r in result) == sorted(ids[4])
    for r in result:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(coder.encode_ordinary(texts[r.doc_id]))


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and sorted(int(k[2:].split("_")[0]) for k in found if k.startswith("op") and k[2].isdigit()) == list(range(1, 14))


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties, repeated ids and rows, and columns whose names the stages use themselves."""
    rng, path = random.Random(9), tmp_path_factory.mktemp("edge")
    words = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "apple", "seven", "grün", "日本"]) + str(rng.randrange(50)) for _ in range(n))
    shared = words(200)
    rows = [(k, words(rng.randint(6, 60)), "en", "web" if k % 3 else None) for k in range(60)]
    rows += [(5, words(40), "de", "web"), (5, words(40), "de", "web"), (None, words(30), None, None), (None, None, None, None), (70, None, "en", "web"), (71, "", "en", "web")]
    rows += [(80, "twice the same row", "en", "web")] * 2 + [(81, "once  more", "en", "x"), (82, "once more", "en", "x"), (90, "long " * 60000, "en", "book")]
    rows += [(100 + k, shared + f" end {k}", "en", "web") for k in range(5)]
    rows += [(200 + k, words(20) + (" you filthy scumbag" if k % 2 else ""), "en", "web") for k in range(60)]
    schema = "doc_id bigint, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).withColumns({"n_chars": F.length("text").cast("bigint"), **{c: F.lit(7) for c in ("node", "k0", "c0", "cell", "__id", "__key", "block", "epoch", "score")}})
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("scumbag" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame([*labels, (None, None, None), (7, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_edge_cases(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], edge_dir), "edge"))
        assert kept[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in kept]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    exact = rows[2]
    assert len(exact) == len(set(exact)) and {x for x in exact if x[0] == 5} == {x for x in rows[1] if x[0] == 5} and (81, "once  more") in exact and (82, "once more") not in exact
    near = rows[3]
    assert sorted(k for k, _ in near if k and 100 <= k < 105) == [100] and {x for x in near if x[0] == 5} == {x for x in exact if x[0] == 5}
    assert {x for x in exact if not (x[0] and 100 < x[0] < 105)} == set(near) and set(rows[4]) == set(near)
    result = corpus_pipeline.STAGES[-1][1](spark, kept[-1], edge_dir).collect()
    assert len(result) == len(rows[4])


def test_empty_tables(spark, edge_dir, tmp_path):
    spark.read.parquet(f"{edge_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{edge_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
