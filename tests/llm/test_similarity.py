"""Shingle join and cover tree, against plain versions."""

import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from shelflight.llm import cover_tree, jaccard, shingles

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def roots(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def plain_groups(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    links = [
        (a, b) for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2)
        if a != b and 100 * len(x & y) >= percent * len(x | y)
    ]
    root = roots({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), root.get(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_of_odd_and_no_rows(odd_docs, odd_rows, no_docs, size, percent):
    got = jaccard.near_duplicates(odd_docs, size, percent).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(odd_rows, size, percent)
    assert jaccard.near_duplicates(no_docs, size, percent).count() == 0
    kept = jaccard.keep_one(odd_docs, size, percent)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in map(tuple, got) if i is None or i == c}


def test_join_equals_all_pairs_on_mutated_copies(spark):
    draw, rows = random.Random(4), []
    words = [f"w{i}" for i in range(60)]
    for family in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.randint(1, 25)):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy) + draw.choice(["", " tail", " Tail"])))
        rows.append((len(rows), " ".join(base[: family + 1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for size, percent in ((3, 90), (2, 70), (5, 80)):
        got = jaccard.near_duplicates(docs, size, percent).collect()
        assert sorted(map(tuple, got), key=repr) == plain_groups(rows, size, percent)


def test_large_blocks_and_heads_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "PARTNERS", 5)
    draw = random.Random(9)
    base = [f"x{i}" for i in range(70)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 5):
            copy[draw.randrange(70)] = f"y{draw.randrange(500)}"
        rows.append((i, " ".join(copy)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows, 3, 85)


def test_rows_of_one_id_with_different_texts_lose_no_link(spark):
    # Text 1 of id 7 shares a rare shingle with the long one only, text 2 of id 7 is the one like it.
    long = [f"z{i}" for i in range(100)]
    like = [*long[:3], *[f"z{i}" for i in range(3, 99)], "end"]
    rows = [(7, " ".join([*long[40:43], *[f"k{i}" for i in range(8)]])), (7, " ".join(like)), (9, " ".join(long)), (5, "apart from all others here"), (5, "")]
    rows += [(i, " ".join([*long[60:63], *[f"m{i}x{k}" for k in range(8)]])) for i in range(20, 40)] + [(3, " ".join(like))] * 3
    rows += [(3, rows[0][1]), (41, "apart from all others here")]
    for size, percent in ((3, 90), (5, 80)):
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent).collect()
        assert sorted(map(tuple, got), key=repr) == plain_groups(rows, size, percent)


def test_bitmap_and_sketch_that_are_full_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 3)
    monkeypatch.setattr(jaccard, "SEEN_BITS", 6)  # eight bytes
    monkeypatch.setattr(jaccard, "CHUNK_BITS", 2)
    draw = random.Random(3)
    base = [[f"b{k}x{i}" for i in range(40)] for k in range(6)]
    rows = []
    for i in range(80):
        copy = list(base[i % 6])
        copy[draw.randrange(40)] = f"y{i % 9}"
        rows.append((i, " ".join(copy)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3, 80).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows, 3, 80)


def test_shingles_count_as_sets_of_words():
    texts = ["", "  ", "a", "A b", "a b c", "a b c a b c", "É é", "a\x0bb\x1cc d", " lead trail "]
    for size in (1, 3, 5):
        sets = shingles.shingle_sets(pa.array(texts), size)
        assert [len(s) for s in sets] == [len(shingle_set(t, size)) for t in texts]
    short, long = shingles.shingle_sets(pa.array(["x y", "x y z"]), 3)
    assert not set(short) & set(long)


def test_longer_prefix_only_where_it_saves_work():
    assert jaccard.choose_length(np.zeros(6), 2) > 1
    assert jaccard.choose_length(np.array([0, 0, 160, 160, 160]), 2) == 1


def plain_links(rows, least):
    fit = {}
    for n, (i, v) in enumerate(rows):
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fit[n] = np.array(v, dtype=float) if ok else None
    links = []
    for a, b in itertools.combinations(fit, 2):
        x, y = fit[a], fit[b]
        if x is not None and y is not None and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
            links.append((a, b))
    count = {n: sum(n in link for link in links) for n in fit}
    root = roots([i for i, _ in rows if i is not None], [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted(((i, count[n], root.get(i), i is not None and root[i] == i) for n, (i, _) in enumerate(rows)), key=repr)


def test_cover_tree_equals_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows = []
    for centre in draw.normal(size=(30, 8)):
        for _ in range(draw.integers(1, 12)):
            noise = draw.choice([0.0, 0.01, 0.1, 0.3])
            rows.append((len(rows), (centre + noise * draw.normal(size=8)).astype(np.float32).tolist()))
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], rows[0][1], [x * 2 for x in rows[0][1]], [-x for x in rows[0][1]]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), (None, None)]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int").repartition(3)
    for size in (4096, 16):
        got = cover_tree.near_duplicates(vectors, 0.95, part_points=size, most_pivots=8)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_links(rows, 0.95)
    assert cover_tree.near_duplicates(vectors.limit(0)).count() == 0
    assert cover_tree.near_duplicates(vectors.where("vec_id IN (1000, 1002)")).count() == 2


def test_trees_nest_and_halve():
    x = np.random.default_rng(1).normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radii = cover_tree.levels(0.3)
    paths = cover_tree.cover_paths(x, radii)
    assert all(a == 2 * b for a, b in itertools.pairwise(radii))
    for level, radius in enumerate(radii):
        centre = paths[:, level]
        assert (paths[centre, level] == centre).all() and (np.linalg.norm(x - x[centre], axis=1) <= radius + 1e-4).all()
        if level:
            assert (paths[paths[:, level], level - 1] == paths[:, level - 1]).all()  # a node lies in one node above
            assert (paths[paths[:, level - 1], level] == paths[:, level - 1]).all()  # centres stay centres


def test_rows_of_a_meeting_do_not_grow_with_the_prefix(spark, monkeypatch):
    """Sets that share 40 shingles go to their meetings with the nearest of them, and are found at the first."""
    rows = [(token, key, 100, 1, token, key, 1) for key in (1, 2, 3) for token in range(40)]
    postings = spark.createDataFrame(rows, "token long, key long, n long, l long, rank long, label long, blocks long")
    lengths = []
    first = jaccard.chosen_at

    def watched(table, choose):
        if "before" in table.columns:
            lengths.extend(len(r.before) for r in table.select("before").collect())
        return first(table, choose)

    monkeypatch.setattr(jaccard, "chosen_at", watched)
    met = jaccard.meetings(postings, 90).collect()
    assert sorted((r.token, r.key) for r in met) == [(0, 1), (0, 2), (0, 3)]
    assert max(lengths) <= jaccard.NEAREST
