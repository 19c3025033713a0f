from pyspark.sql import functions as F

from nitscope.llm import langid
from nitscope.llm.queries import op1_langid
from tests.llm.data import clashing, documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op1_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_defined_cases(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    assert set(model) == {"en", "xx"}
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model, reject=False).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (10, "und"), (None, "xx"), (1, "en")} <= rows
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, model).collect())
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(docs.limit(0)) == {} and langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(clashing(spark), model).count() == docs.count()


def test_narrow_margin_is_rejected():
    same = b"the same words stand here in both of them " * 20
    c = langid.Classifier({"a": same, "b": same})
    assert c.predict("the same words")[2]
