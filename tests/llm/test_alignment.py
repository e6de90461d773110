"""Alignment of token ids against byte owners and whole encodings."""

import collections

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelflight.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world", "  two  spaces\n\nand\ttabs  ", "naïve café — 東京 🙂🙂 ﬁn", "<|endoftext|> <s> plain", "it's 12345.678 isn't", "a", " ", "\x00 zero",
    "x" * 500 + " " * 300 + "y", "word▁piece", "Ünïcödé " * 40, "\u00a0nbsp\u3000wide", "it''s ... !!", "e\u0301 combining",
    "line\n  next\t tab \n", "\n", "x\x1c y\x85 z\u2003 w", "end \n \n", "a\n", " \u3000 b",
]


def plain_row(text):
    """Ids, groups and links from whole encodings by the public libraries, with bytes cut where both sides end."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letter = alignment.byte_alphabet()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    spelt_a = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
    target = (" " + text).encode()
    if not text or b"".join(spelt_a) != target or b"".join(spelt_b) != target:
        return [], []
    ends = [{sum(map(len, s[: i + 1])) for i in range(len(s))} for s in (spelt_a, spelt_b)]
    cuts = [0, *sorted(ends[0] & ends[1])]
    groups = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        sides = []
        for ids, spelt in ((a, spelt_a), (b, spelt_b)):
            at, side = 0, []
            for i, s in zip(ids, spelt, strict=True):
                at += len(s)
                if low < at <= high:
                    side.append(i)
            sides.append(side)
        groups.append(tuple(sides))
    return groups, [(x, y) for xs, ys in groups for x in xs for y in ys]


def expected(texts):
    plain = [plain_row(t or "") for t in texts]
    counts = collections.Counter(pair for _, pairs in plain for pair in set(pairs))
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for groups, pairs in plain:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs), told,
            sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs),
        ))
    return out


def aligned(docs):
    rows = alignment.align_documents(docs, A, B, {"groups_kept": F.col("groups")}).collect()
    return [(r["doc_id"], (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_kept"], r["n_best"], r["count_sum"])) for r in rows]


@pytest.mark.parametrize("frequent", [20, 3, 62])
def test_alignment_equals_plain_one(spark, monkeypatch, frequent):
    # Other bounds of the broadcast send pairs the other way: results stay.
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    texts = [*TEXTS, *TEXTS[:4], None, "", *[f"Hello world {i} and the like" for i in range(30)]]
    docs = spark.createDataFrame([(i, t, "p", "r") for i, t in enumerate(texts)], "doc_id bigint, text string, pairs string, row string").repartition(3)
    assert [row for _, row in sorted(aligned(docs))] == expected(texts)


def test_words_apart_align_like_whole_texts():
    aligner = alignment.Aligner(A, B, words=3)
    assert aligner.two.apart
    for text in TEXTS:
        words = alignment._WORDS.findall(" " + text)
        assert "".join(words) == " " + text
        if "▁" not in text:
            assert sum(aligner.two.encode(words), []) == aligner.two.model.encode(text)
        whole = aligner.one.plain.encode(" " + text, add_special_tokens=False).ids
        assert sum(map(aligner.one.encode, words), []) == whole == aligner.one.fast.encode_ordinary(" " + text)


def test_odd_and_no_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = collections.Counter((i, x[0], x[4]) for i, x in aligned(odd_docs))
    short = [(i, t) for i, t in rows if len(t or "") < 10_000]
    for (doc_id, _), want in zip(short, expected([t for _, t in short]), strict=True):
        assert got[doc_id, want[0], want[4]] >= 1
    assert sum(got.values()) == len(rows)
    long = next(x for i, x in aligned(odd_docs) if i == 9)
    assert long[2] == long[4].count(";") + 1 > 60_000
    assert aligned(no_docs) == []


def test_links_of_a_long_group_count_by_distinct_ids(monkeypatch):
    assert alignment.links([1, 1, 2], [7, 7]) == {1 << 32 | 7: 4, 2 << 32 | 7: 2}
    monkeypatch.setattr(alignment, "LONG", 1)
    texts = [t for t in TEXTS if "▁" not in t]
    for text, (told, pairs, times, *_) in zip(texts, alignment.Aligner(A, B).texts(texts), strict=True):
        groups, all_pairs = plain_row(text)
        assert told == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == collections.Counter(x << 32 | y for x, y in all_pairs)


def test_common_ends():
    assert alignment.common_ends([2, 3, 4], [1, 3, 4]) == ([3, 4], [2, 3], [2, 3])
