"""Spans that are longer than what two windows share."""

import hashlib
import random
import re

import numpy as np
import pytest

from shelflight.llm import pii, queries, tagger


class Reader:
    """Tags what looks like a disguised email in the codes of a window, also where the window cuts it."""

    reads = 0

    def decode(self, codes):
        tags = np.zeros(codes.shape, dtype=np.int64)
        letters = np.array(list("?1aAé" + "".join(pii.SYMBOLS)))
        for row, line in zip(tags, codes, strict=True):
            for m in re.finditer(r"[aA1.]+ @ ?[aA1.]*", "".join(letters[line])):
                row[m.start() : m.end()] = 2
                if m.start() or line[0] != 2:
                    row[m.start()] = 1
        self.reads += codes.size
        return tags, np.ones(codes.shape)


def disguised(length):
    """A disguised email of so many characters; its @ is in the middle."""
    name = ("first.last." * 40)[: length // 2 - 3] + "z"
    domain = ("department.university." * 20)[: length - len(name) - 3 - 4] + "x.or"
    return f"{name} @ {domain}".replace("..", ".x")


@pytest.mark.parametrize("length", [48, 60, 140, 700])
def test_a_long_span_is_found_at_all_offsets(length):
    email = disguised(length)
    assert len(email) == length
    for offset in range(80):
        text = "-" * (160 + offset) + "/" + email + "/" + "-" * 300
        assert pii.Detector(Reader()).find([text]) == [[(0, 161 + offset, 161 + offset + length, False, 1.0)]]


def test_wide_windows_stay_linear():
    reader = Reader()
    text = "-" * 300 + "a" * 200_000 + " @ b.cd" + "-" * 300
    assert [s[1:3] for s in pii.Detector(reader).find([text])[0]] == [(300, 200_307)]
    assert reader.reads < 8 * len(text)
    assert pii.Detector(Reader()).find(["1" * 20_000 + "a" * 20_000]) == [[]]


def test_a_trained_tagger_finds_long_emails_at_all_offsets():
    draw, texts = random.Random(4), []
    for i in range(200):
        name = ".".join(draw.choice(["first", "last", "jo", "mary-ann", "k9"]) for _ in range(draw.randint(1, 8)))
        domain = ".".join(draw.choice(["department", "university", "mail", "example", "a1"]) for _ in range(draw.randint(1, 6)))
        texts.append(f"{'some words ' * (i % 4)}write {name}@{domain}.org {'more text ' * (i % 4)}in {1900 + i}.")
    detector = pii.learn(texts, batches=300)
    for length in (60, 140):
        email = disguised(length)
        found = 0
        for offset in range(80):
            before = ("some words here and more text " * 20)[: 160 + offset - 1] + " "
            text = before + email + " more text and some words" * 8
            found += (0, len(before), len(before) + length) in [s[:3] for s in detector.find([text])[0]]
        assert found == 80


def test_decode_agrees_with_the_trained_scores():
    draw = np.random.default_rng(2)
    model = tagger.Tagger.fresh(6, 4, pii.allowed_steps(), 3)
    codes = draw.integers(0, 6, (3, 17))
    scores, _ = model._emit(codes)
    assert np.allclose(scores, model._scores(codes))
    to, from_, total = model._chain(scores)
    tags, share = model.decode(codes)
    rows = np.arange(3)[:, None]
    assert np.allclose(share, np.exp(to + from_ - total[:, None, None])[rows, np.arange(17), tags])


def test_parts_of_an_ip_may_have_thousands_of_zeros():
    zeros = "0" * 5000
    assert pii.rule_spans(f"{zeros}.1.1.1 x") == [(1, 0, 5006)]
    assert pii.rule_spans(f"1.{zeros}255.1.{zeros}") == [(1, 0, 10_008)]
    assert pii.rule_spans(f"1.{zeros}256.1.1") == []
    assert pii.Detector(None).find([f"{zeros}.1.1.1"]) == [[(1, 0, 5006, True, 1.0)]]


def test_span_query_with_a_trained_tagger(spark, tmp_path):
    draw, rows = random.Random(8), []
    for i in range(150):
        base = draw.choice([f"jo{i}.doe@mail{i % 9}.example.com", f"10.{i}.{i % 7}.{i % 250}", f"+1 ({200 + i}) 555-{1000 + i}", "4111 1111 1111 1111" if i % 2 else "5500005555555559"])
        rows.append((i, f"{'some words ' * (i % 5)}here {base} and {'more text ' * (i % 4)}in {1900 + i}."))
    disguised_ones = ["jo7.doe @ mail3.example.com", "(321) 555-1234", "10 . 2 . 3 . 4", "4111.1111.1111.1111"]
    hidden = {1000 + i: f"some words here {d} and more text in 1950." for i, d in enumerate(disguised_ones)}
    rows += [*hidden.items(), (2000, None), (2001, ""), (2002, "no digits")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op5_pii_tagger(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    added = 0
    for i, text in rows:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(pii.rule_spans(text or ""))]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(base) <= set(spans) and got[i]["n_added"] == len(spans) - len(base)
        assert sum(got[i][f"n_{kind}"] for kind in pii.KINDS) == len(base)
        if i in hidden:
            added += any(span.endswith(f":16:{text.index(' and')}") for span in spans)
    assert added >= 1
