import corpus_pipeline
from sparkveil.llm import decontaminate, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages_work_on_all_that_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.cut(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        if name == "quality":
            assert ids == {r.doc_id for r in quality.quality(before, labels).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            assert ids == {r.component_id for r in simhash.near_duplicates(before).collect()}
        elif name == "decontamination":
            assert ids == {r.doc_id for r in decontaminate.contamination(before, bench).where("not contaminated").collect()}
        else:
            assert ids == {r.doc_id for r in before.collect()}
            assert secrets.scan(kept).agg({"n_access": "sum"}).first()[0] == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in rows} == ids
    assert sum(r.length for r in rows) == sum(len(r.text.split()) + 1 for r in kept.collect())
