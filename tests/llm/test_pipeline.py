import corpus_pipeline
from nitscope.runtime import materialize
from tests.llm.data import documents, prose


def test_each_stage_keeps_columns_and_decides(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf), name)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        docs = after
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_masks_personal_data(spark):
    docs = documents(spark, [(1, "write to a.b@example.org now", "en", "a", 28)])
    r = corpus_pipeline.personal_data(spark, docs, None).first()
    assert (r.text, r.n_chars) == ("write to [EMAIL] now", 20)


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
    assert prose(1, 3)
