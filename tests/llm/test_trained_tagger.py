"""The tagger as the query trains it: masked lessons, neighbours, windows from anywhere in a text."""

import random

import pytest

from shelflight.llm import pii, queries


def card(draw):
    digits = [draw.randrange(10) for _ in range(15)]
    return next("".join(map(str, [*digits, last])) for last in range(10) if pii.luhn("".join(map(str, [*digits, last]))))


def span(draw, kind):
    n = lambda low, high: draw.randint(low, high)
    if kind == 0:
        return f"{draw.choice(['anna', 'jo.lee', 'm_k', 'sam'])}{n(1, 99)}@{draw.choice(['mail', 'post', 'corp'])}.example.{draw.choice(['org', 'com'])}"
    if kind == 1:
        return ".".join(str(n(1, 254)) for _ in range(4))
    if kind == 2:
        return card(draw)
    return f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}"


@pytest.fixture(scope="module")
def detector():
    draw = random.Random(7)
    texts = []
    for i in range(240):
        words = [draw.choice(["the", "cat", "went", "home", "and", "slept", "well", "today"]) for _ in range(14)]
        words.insert(draw.randrange(14), span(draw, i % 4))
        texts.append(" ".join(words)[: pii.WINDOW])
    return pii.learn(texts, batches=400)


def test_disguised_spans_of_other_documents_are_found(detector):
    draw, hits, false, asked = random.Random(99), 0, 0, 0
    for kind in range(4):
        for _ in range(20):
            for form in pii.rewritten(kind, span(draw, kind)):
                text = f"yesterday the dog went out {form} and came home late"
                found = [(k, text[a:b]) for k, a, b, base, _ in detector.find([text])[0] if not base]
                asked += 1
                hits += (kind, form) in found
                false += sum(x != (kind, form) for x in found)
    assert hits >= 0.9 * asked and false <= 0.05 * asked


def test_phones_before_an_address_are_found(detector):
    for text in ("call +1 (826) 555-4081 190.137.223.20 for more", "un. +1 (843) 555-7672 170.106.47.218 Et"):
        spans = [(pii.KINDS[k], text[a:b], base) for k, a, b, base, _ in detector.find([text])[0]]
        assert ("phone", text[text.index("+") : text.index(")") + 10], False) in spans
        assert [s for s in spans if s[0] == "ip" and s[2]]


def test_what_may_be_data_without_a_label_teaches_nothing():
    text = "write to anna @ mail.example.org or call +1 (826) 555-4081 190.137.223.20 soon"
    (kept, spans), *_ = pii.lessons_of([text])
    codes, tags = pii._lesson(kept, spans)
    at = text.index("anna")
    assert (codes[at : at + 10] == pii.OTHER).all() and not tags[at : at + 10].any()
    assert spans and all(text[a:b] == "190.137.223.20" for k, a, b in spans)


def test_trained_query_on_odd_rows_keeps_base_spans(spark, odd_docs, odd_rows):
    draw = random.Random(3)
    rows = [(100 + i, f"the cat went home {span(draw, i % 4)} and slept {'well ' * (i * 9)} {pii.rewritten(i % 4, span(draw, i % 4))[0]}") for i in range(120)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = pii.find_spans(docs, pii.train(docs, windows=2)).collect()
    assert len(found) == len(rows) + len(odd_rows)
    want = sorted((t or "", [(pii.KINDS[k], a, b) for k, a, b in sorted(pii.rule_spans(t or ""))]) for _, t in [*odd_rows, *rows])
    texts = {i: t for i, t in rows}
    for r in found:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        if r["doc_id"] in texts:
            assert (texts[r["doc_id"]], base) in want
        for s in r["spans"]:
            assert s["start"] < s["end"]
    assert sum(not s["base"] for r in found for s in r["spans"]) >= 60
    assert queries.op5_pii_tagger
