"""The corpus pipeline, stage by stage, on small tables and on awkward rows."""

import pytest

import corpus_pipeline as P
from crewgrid.llm import textops as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    words = " ".join(f"word{k} of{k % 7}" for k in range(60))
    rows = [(1, words, "en", "s", 5), (1, words, "en", "s", 5), (2, words + " end", None, None, None), (3, None, "en", "s", 0), (None, "text without id password=abcdef99", "en", "s", 1), (4, "", "de", "s", 0), (5, "said " + " ".join(f"item{k}" for k in range(12)), "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (99, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, " ".join(f"item{k}" for k in range(11))), (8, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_awkward_rows(spark, awkward):
    docs = X.read(spark, awkward, "documents")
    kept = {}
    for name, stage in P.STAGES:
        docs = X.written(spark, stage(spark, docs, awkward), name)
        kept[name] = sorted(str(r.doc_id) for r in docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
        if name == "secrets":
            assert "abcdef99" not in docs.where("doc_id IS NULL").first().text
    assert kept["toxicity"] == ["1", "1", "2", "3", "4", "5", "None"]
    assert kept["near_dedup"] == ["1", "3", "5", "None"]
    assert kept["decontamination"] == kept["secrets"] == kept["sentencepiece"] == ["1", "3", "None"]
    assert docs.where("NOT same").count() == 0


def test_stages_on_empty_tables(spark, awkward):
    docs = X.read(spark, awkward, "documents").where("1 = 0")
    for name, stage in P.STAGES:
        docs = X.written(spark, stage(spark, docs, awkward), name)
        assert docs.count() == 0


def test_run_keeps_clean_documents(spark):
    from crewgrid.llm import catalog

    left = {r.doc_id for r in P.run(spark, SF).collect()}
    toxic = {r.doc_id for r in catalog.QUERIES["op6_toxicity"](spark, SF).where("predicted = 1").collect()}
    leaked = {r.doc_id for r in catalog.QUERIES["op7_decontamination"](spark, SF).where("contaminated").collect()}
    groups = {r.doc_id: r.group_id for r in catalog.QUERIES["op2_neardup"](spark, SF).collect()}
    assert not left & (toxic | leaked)
    single = {d for d, g in groups.items() if list(groups.values()).count(g) == 1}
    assert single - toxic - leaked <= left
