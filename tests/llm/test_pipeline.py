"""The pipeline's stages on the smallest tables, each against its own input."""

import pytest

import corpus_pipeline
from emberline.llm import ngram_join, toxicity
from tests.llm.test_texts import components_by_hand, removed_by_hand
from tests.llm.test_tokens import assert_valid


@pytest.fixture(scope="module")
def kept(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()}


def test_stages_keep_columns(kept):
    assert all(sorted(k.dtypes) == sorted(kept[0].dtypes) for k in kept[:-1])


def test_toxicity_keeps_clean_documents_whole(spark, data, kept):
    before, after = rows(kept[0]), rows(kept[1])
    assert all(before[d] == r for d, r in after.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    toxic = [d for d, t in labels.items() if t and d in before]
    clean = [d for d, t in labels.items() if not t and d in before]
    assert sum(d in after for d in toxic) <= max(1, len(toxic) // 10)
    assert sum(d not in after for d in clean) <= max(1, len(clean) // 50)


def test_one_of_each_group_stays(kept):
    before, after = rows(kept[1]), rows(kept[2])
    by_hand = components_by_hand(list(before.values()))
    assert set(after) == {d for d, (_, c) in by_hand.items() if d == c}
    assert all(before[d] == r for d, r in after.items())


def test_repeats_are_taken_out(kept):
    before, after = rows(kept[2]), rows(kept[3])
    by_hand = removed_by_hand(list(before.values()))
    assert set(after) == set(before)
    for d, r in after.items():
        assert r[1] == (by_hand[d][2] if by_hand[d][1] else before[d][1])
        assert r[4] == (len(r[1]) if by_hand[d][1] else before[d][4])


def test_documents_with_items_go(spark, data, kept):
    before, after = rows(kept[3]), rows(kept[4])
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(before) - set(after) >= {d for d, r in before.items() if any(i in r[1] for i in items)}
    held = [d for d in set(before) - set(after) if not any(i in before[d][1] for i in items)]
    assert len(held) <= len(before) // 100


def test_packing_is_valid(kept):
    out = kept[5].collect()
    assert {r["doc_id"] for r in out} == set(rows(kept[4]))
    n = assert_valid([(r["sequence_id"], r["offset"], r["length"]) for r in out], 4096)
    assert n <= -(-sum(r["length"] for r in out) // 4096) + 2


def test_run_gives_the_last_stage(spark, data, kept):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, data).collect())) == sorted(map(key, kept[5].collect()))


def test_stages_of_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_operators_are_the_library_s():
    assert ngram_join.one_of_each and toxicity.without_toxic


def test_stages_keep_null_repeated_and_blank_documents(spark, data):
    odd = [(10**9 + k, t, None, None, None) for k, t in enumerate(["", "", " \n", " \n", None, None, "\x0b"])] + [(None, None, "en", "x", 1), (None, "some words", "en", "x", 1)]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert {(r["doc_id"], r["text"]) for r in out.where("doc_id >= 1000000000 or doc_id is null").collect()} == {o[:2] for o in odd}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()} >= {o[0] for o in odd}
