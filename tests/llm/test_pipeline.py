"""The stages, one after the other, and the registration."""

import collections

import __spark_entry__
import corpus_pipeline
from shelflight.llm import digest_index, jaccard, quality, shared


def test_stages_keep_what_they_should(spark, tmp_path):
    good = [" ".join(f"word{(i * 7 + k * k * (i % 11 + 1)) % 997}" for k in range(60)) + "." for i in range(200)]
    bad = [" ".join(f"w{(i + k) % 5}$$$ | ##" for k in range(40)) for i in range(60)]
    texts = good + bad + good[:20] + [t.replace("word", "Word", 1) + " more" for t in good[20:30]]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        at = shared.stored(stage(spark, at, str(tmp_path)), name)
        seen.append(at)
        if name != "packing":
            assert at.columns == docs.columns
    ids = [collections.Counter(r["doc_id"] for r in df.collect()) for df in seen]
    assert set(ids[0]) == set(range(200)) | set(range(260, 290))
    assert set(ids[1]) == set(range(20, 200)) | set(range(260, 290))  # of equal texts the largest id
    assert set(ids[2]) == set(range(20, 200)) | set(range(260, 280))  # of near copies the smallest
    assert set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])
    full = corpus_pipeline.run(spark, str(tmp_path))
    assert full.drop("sequence_id", "offset").count() >= sum(ids[3].values())


def test_operators_are_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixture", "packing"]
    assert quality and jaccard and digest_index
