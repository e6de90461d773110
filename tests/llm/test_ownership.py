"""Stored tables belong to those who made them."""

import os

import corpus_pipeline
from shelflight.llm import queries, shared
from shelflight.session import shared_folder

DATA = "/root/testdata/sf0.001"


def test_results_survive_a_later_pipeline(spark):
    names = ["op4_exact_dedup", "op7_cover_tree_links", "op9_jaccard_join", "op10_warc_bundles"]
    built = {name: queries.queries()[name](spark, DATA) for name in names}
    tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")}
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    full = corpus_pipeline.run(spark, DATA)
    # Of all that the stages stored, only the result is left, and no index.
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before} == {"packing"}
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")} == tables == set()
    assert full.count() > 0
    rows = {name: len(df.collect()) for name, df in built.items()}
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert rows["op4_exact_dedup"] == rows["op9_jaccard_join"] == documents
    assert rows["op7_cover_tree_links"] == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert rows["op10_warc_bundles"] == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_a_scope_deletes_its_own_tables_alone(spark):
    outer = shared.stored(spark.range(3), "outer")
    with shared.Scope() as scope:
        inner = shared.stored(spark.range(4), "inner")
        with shared.Scope() as nested:
            deep = shared.stored(spark.range(5), "deep")
    scope.clear()
    assert not os.path.exists(inner._stored_in) and os.path.exists(deep._stored_in)
    assert outer.count() == 3 and deep.count() == 5
    nested.clear()
    assert not os.path.exists(deep._stored_in)


def test_pipeline_on_odd_and_no_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:4]:
            at = shared.stored(stage(spark, at, folder), step)
            assert at.columns == docs.columns
        if name == "odd":
            kept = [(r["doc_id"], r["text"]) for r in at.collect()]
            assert set(kept) <= {(r["doc_id"], r["text"]) for r in docs.collect()}
        packed = corpus_pipeline.run(spark, folder)
        assert packed.count() == 0 if name == "none" else packed.count() >= 0
