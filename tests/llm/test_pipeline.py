import pytest

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_run_and_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "simhash near-dedup",
                                        "secret scan", "best-fit packing"]
    before = None
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
    packed = C.pack_documents(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
    assert C.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)],
                                  [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_stages_take_empty_tables_and_nulls(spark, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == min(len(rows), 1)
