"""Scoring, mixing and exact deduplication."""

import collections
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelflight.llm import digest_index, mixing, quality, shared


def good(i):
    return " ".join(f"word{(i * 7 + k * k) % 301}" for k in range(40 + i % 30)) + "."


def bad(i):
    return " ".join(f"w{(i + k) % 5}$$$ | ##" for k in range(30 + i % 20))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, good(i) if i % 4 else bad(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 600, 2)] + [(3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_classifier_separates_held_out_documents(labelled):
    docs, labels = labelled
    rows = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 600
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 > 0) == int(r["score"] >= 0.5) for r in held)


def test_classifier_learns_nothing_from_held_out_rows(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.learnable(), F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = (quality.train(docs, x) for x in (labels, flipped))
    assert one.intercept == two.intercept and all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True))


def test_classifier_on_odd_and_no_rows(labelled, odd_docs, no_docs):
    docs, labels = labelled
    model = quality.train(docs, labels)
    rows = quality.classify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.classify(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0
    # Without labels the score is one half, without one of the labels the smoothed share.
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).scores(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_tables_add_up_to_the_score():
    x = quality.features(pa.array([good(i) if i % 2 else bad(i) for i in range(80)]))
    y = np.arange(80) % 2
    model = quality.fit(x, y.astype(float), rounds=20, pair_rounds=5)
    row = x[:1]
    total = model.intercept + sum(t[np.searchsorted(e, row[0, f])] for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    total += sum(t[np.searchsorted(model.coarse[a], row[0, a]), np.searchsorted(model.coarse[b], row[0, b])] for a, b, t in model.pairs)
    assert math.isclose(model.scores(row)[0], 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert len(model.pairs) == 5 and ((model.scores(x) >= 0.5) == y).all()


def test_poisson_steps_are_the_distribution():
    for mean in (0.1, 1.0, 7.9, 8.1, 300.0):
        draws, steps = mixing.poisson_steps(mean)
        rate = mean / draws
        assert rate <= mixing.STEP and abs(steps[-1] - 1) < 1e-12
        assert all(math.isclose(steps[k], sum(math.exp(-rate) * rate**j / math.factorial(j) for j in range(k + 1)), rel_tol=1e-9) for k in range(5))


def test_mixture_reaches_its_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("source"))
    mixed = mixing.mix_sources(docs, {"big": 1.0, "small": 1.0}, rest=2.0, epochs=2.0)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, share in (("big", 0.25), ("small", 0.25), (None, 0.5)):
        assert abs(counts[source] / 12_000 - share) < 0.02
    one = mixed.where("doc_id = 18").select("copies").distinct().collect()
    assert len(one) <= 1 and {r["doc_id"]: r["copies"] for r in mixed.collect()} == {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs.repartition(3), {"big": 1.0, "small": 1.0}, rest=2.0, epochs=2.0).collect()}
    assert all(n == c for (_, c), n in collections.Counter((r["doc_id"], r["copies"]) for r in mixed.collect()).items())


def test_mixture_of_odd_and_no_rows(odd_docs, no_docs):
    mixed = mixing.mix_sources(odd_docs, {"src0": 3.0, "src1": 1.0, "absent": 5.0}, rest=1.0, epochs=4.0)
    assert set(odd_docs.columns) | {"copy", "shuffle_key"} == set(mixed.columns)
    assert mixed.count() > 0 and mixing.mix_sources(no_docs, {"a": 1.0}).count() == 0
    # A source of empty texts cannot reach a weight.
    assert mixing.mix_sources(odd_docs.where("text = '' OR text IS NULL"), {"src0": 1.0}, rest=1.0).count() == 0


def plain_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def test_exact_dedup_of_odd_and_no_rows(spark, odd_docs, odd_rows, no_docs):
    for batches in (1, 2, 5):
        got = digest_index.deduplicate(odd_docs, digest_index.new_index(spark), batches)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(odd_rows)
    kept = digest_index.keep_rows(odd_docs, got)
    assert kept.columns == odd_docs.columns
    assert collections.Counter(r["text"] or "" for r in kept.collect()) == collections.Counter({t or "" for _, t in odd_rows})
    assert digest_index.deduplicate(no_docs, digest_index.new_index(spark)).count() == 0


def test_index_persists_and_drops_what_it_knows(spark, odd_docs, odd_rows):
    index = digest_index.new_index(spark)
    first = spark.createDataFrame([(900, "one TWO"), (901, "unseen")], "doc_id bigint, text string")
    digest_index.deduplicate(first, index).count()
    again = digest_index.DigestIndex(spark, index.table)
    rows = {r["doc_id"]: r for r in digest_index.deduplicate(odd_docs, again).collect()}
    assert rows[8]["keep_id"] == 900 and not rows[8]["kept"] and rows[7]["kept"]
    assert again.rows().count() == len({t or "" for _, t in odd_rows}) + 1
    plan = again.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the buckets already hold each digest together
    index.drop()
    assert index.rows() is None


def test_index_has_a_file_a_bucket_whatever_the_partitions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1500)], "doc_id bigint, text string")
    index, kind = digest_index.DigestIndex(spark, digest_index.new_index(spark).table, buckets=8), type(docs)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: plain(self, max(n, 37), *by))
    index.absorb(digest_index.text_digests(docs))
    assert index.rows().count() == 1500 and len(index.rows().inputFiles()) == 8
    index.absorb(digest_index.text_digests(docs.withColumn("text", F.concat("text", F.lit("!")))))
    assert index.rows().count() == 3000 and len(index.rows().inputFiles()) == 16
    index.drop()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(7, 7), (200, 201), (201, 202), (202, 200), (300, 5)]
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 5 for k in (*range(5, 60), 300)}, 200: 200, 201: 200, 202: 200}
    assert shared.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
