"""Token ids, packing, token counts, personal data, chats and archives."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from shelflight.llm import chat, packing, pii, queries, tagger, token_counts, token_ids, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "İstanbul ΑΣ ΣΑΣ. áb ﬁ ½ ²3 x y z w\x1cq", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "don't DON'T 'S Ǆ ẞ ß ÀÉ×÷ŸǱ 'tis we'Ve", "", "   ",
    "日本語 テスト 🎉🎉 a\tb\x0bc\x0cd\r\ne \x85 f", "ª º µ ¼ ¹", "a,b;c--d ÀÞÿß a1b22 <end> |x| @@ Ö!", "K ſ x y",
]


def test_ids_are_the_tokenizers():
    words = token_ids.WordTokenizer(WORD_FILE, words=5)
    for _ in range(2):
        ids, at = words.encode(pa.array(ODD))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert token_ids.slices(pa.array(["aaaa", "b", "c", "dddddd"]), 3) == [(0, 1), (1, 2), (3, 1)]


def plain_first_fit(sizes, capacity):
    free, bins = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(capacity)
        free[b] -= sizes[i]
        bins[i] = b
    return [bins[i] for i in range(len(sizes))]


def test_tournament_tree_is_first_fit():
    draw = random.Random(3)
    for _ in range(40):
        sizes = [draw.randint(1, 20) for _ in range(draw.randint(1, 60))]
        assert packing.first_fit_decreasing(sizes, 20)[0] == plain_first_fit(sizes, 20)


def check_packing(pieces, docs, capacity=4096):
    """`docs`: list of (doc_id, ids) with repeats."""
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        assert 1 <= p["length"] <= capacity and len(p["ids"]) == 4 * p["length"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in by_sequence.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(held)) and sum(held[-1]) <= capacity
    wanted = collections.Counter()
    for i, ids in docs:
        for k, token in enumerate(ids):
            wanted[i, k, token, len(ids)] += 1
    got = collections.Counter()
    for p in pieces:
        for k, token in enumerate(np.frombuffer(p["ids"], "<u4").tolist()):
            got[p["doc_id"], p["start"] + k, token, p["doc_tokens"]] += 1
    assert got == wanted


def test_packing_of_odd_and_no_rows(odd_docs, odd_rows, no_docs):
    plain = token_ids.WordTokenizer(WORD_FILE).tokenizer
    docs = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in odd_rows]
    for size in (8 << 20, 2000):
        pieces = packing.pack(odd_docs, WORD_FILE, group_bytes=size)
        check_packing(pieces.collect(), docs)
    rows = pieces.withColumn("crc", F.crc32("ids")).collect()
    assert all(r["crc"] == zlib.crc32(r["ids"]) for r in rows)
    assert packing.pack(no_docs, WORD_FILE).count() == 0


def test_cuts_fill_gaps():
    pieces = [(i, i * 60, i * 60 + 60) for i in range(10)]  # ten bins of 100, each with 60
    after = packing.top_up(pieces, 100, 8)
    assert len({b for b, *_ in after}) == 6 and sorted(x for _, _, a, b in after for x in range(a, b)) == list(range(600))
    assert packing.top_up(pieces, 100, 50) == [(b, 0, s, e) for b, s, e in pieces]


def best_split(word, scores, unknown):
    """Largest score, then fewest tokens, over all segmentations."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[b][0] + scores[word[b:end]], best[b][1] - 1) for b in range(end) if word[b:end] in scores]
        if word[end - 1] not in scores:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] - len(word[end - 1].encode())))
        best.append(max(ways))
    return -best[-1][1]


def test_trie_counts_the_best_split():
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.PrefixTrie(scores, nodes=500)
    words = ["the", "there", "thereafter", "", "a", "Ärger", "日本語", "🎉x", "zzzzqqq", "x" * 300, "antidisestablishment", "the"]
    assert [trie.count(w) for w in words] == [best_split(token_counts.BEGIN + w, scores, trie.unknown) if w else 0 for w in words]
    draw = random.Random(5)
    for _ in range(800):
        word = "".join(draw.choice("abcdeéß1,") for _ in range(draw.randint(1, 12)))
        assert trie.count(word) == best_split(token_counts.BEGIN + word, scores, trie.unknown)


def test_trie_agrees_with_a_public_unigram_model():
    from tokenizers import models

    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    model = models.Unigram([("<unk>", -100.0), *scores.items()], 0, False)
    trie = token_counts.PrefixTrie(scores)
    for word in ["hello", "internationalization", "wortschatz", "pneumonoultra", "running", "xyzzy"]:
        assert trie.count(word) == len(model.tokenize(token_counts.BEGIN + word))


def test_token_counts_of_odd_and_no_rows(odd_docs, odd_rows, no_docs):
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.PrefixTrie(scores)
    got = token_counts.count_tokens(odd_docs, scores).collect()
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in odd_rows]
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len(w), sum(map(trie.count, w))) for i, w in words), key=repr)
    assert token_counts.count_tokens(no_docs, scores).count() == 0


def plain_rules(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_rules_equal_their_patterns():
    draw = random.Random(3)
    parts = ["@", ".", "a", "b-", "+", "1", "23", "9", "255", "300", " ", "(", ")", "-", "0", "4111111111111111", "é", "x@y.z", "_%", "1.2.3.4"]
    for _ in range(8000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 22)))
        assert sorted(pii.rule_spans(text)) == sorted(plain_rules(text))
    assert pii.rule_spans("1" * 200_000 + "a" * 200_000) == []


def test_tagger_gradient_and_decoding():
    draw = np.random.default_rng(1)
    allowed = np.zeros((3, 3))
    allowed[0, 2] = -1e4
    model = tagger.Tagger.fresh(4, 3, allowed, 2)
    codes, tags = draw.integers(0, 4, (2, 5)), np.array([[0, 1, 2, 0, 0], [1, 2, 2, 1, 0]])
    _, grads = model.gradients(codes, tags)
    for name, weights in model.weights.items():
        at = tuple(draw.integers(0, n) for n in weights.shape)
        if name == "step" and at == (0, 2):
            continue
        losses = []
        for nudge in (1e-5, -2e-5):
            weights[at] += nudge
            losses.append(model.gradients(codes, tags)[0])
        weights[at] += 1e-5
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-6
    scores, _ = model._emit(codes)
    step = model.weights["step"] + allowed
    found, share = model.decode(codes)
    for row in range(2):
        ways = {w: sum(scores[row, t, k] for t, k in enumerate(w)) + sum(step[a, b] for a, b in itertools.pairwise(w)) for w in itertools.product(range(3), repeat=5)}
        assert tuple(found[row]) == max(ways, key=ways.get)
        total = sum(np.exp(v) for v in ways.values())
        assert np.allclose(share[row], [sum(np.exp(v) for w, v in ways.items() if w[t] == found[row, t]) / total for t in range(5)])


@pytest.fixture(scope="module")
def detector():
    draw, texts = random.Random(8), []
    for i in range(160):
        base = draw.choice([f"jo{i}.doe@mail{i % 9}.example.com", f"10.{i}.{i % 7}.{i % 250}", f"+1 ({200 + i}) 555-{1000 + i}", "4111 1111 1111 1111" if i % 2 else "5500005555555559"])
        texts.append(f"{'some words ' * (i % 5)}here {base} and {'more text ' * (i % 4)}in {1900 + i}.")
    return pii.learn(texts, batches=220)


def test_tagger_adds_disguised_data_and_leaves_the_rest(detector):
    kinds = {pii.KINDS[k] for t in ("here jo7.doe @ mail3.example.com and more", "call 1 (321) 555-1234 here and more", "here 10 . 2 . 3 . 4 and more") for k, *_ in detector.find([t])[0]}
    assert len(kinds) >= 2
    clean = ["In 2021 there were 1500 of 30000 people, 12.5 percent of 1,000,000.", "Version 3.2 of 4, pages 10-20.", "no digits at all"]
    assert detector.find(clean) == [[], [], []]
    assert pii.learn(["nothing to learn"]).tagger is None


def test_windows_are_reconciled(detector):
    text = ("x" * 70 + " a.b@c.de 10.0.0.1 ") * 20
    spans = detector.find([text])[0]
    assert [s for s in spans if s[3]] == [(*s, True, 1.0) for s in sorted(plain_rules(text))]
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(sorted(spans, key=lambda s: s[1])) if not (a[3] and b[3]))
    assert pii.reconcile([(0, 5, 9)], [(1, 8, 12, 0.99), (1, 20, 30, 0.9), (2, 25, 40, 0.95), (3, 41, 50, 0.9), (1, 20, 30, 0.92)]) == [
        (0, 5, 9, True, 1.0), (2, 25, 40, False, 0.95), (3, 41, 50, False, 0.9)]


def test_spans_of_odd_and_no_rows(odd_docs, odd_rows, no_docs):
    found = pii.find_spans(odd_docs, pii.Detector(None)).collect()
    plain = [(i, [(pii.KINDS[k], s, e) for k, s, e in plain_rules(t or "")]) for i, t in odd_rows]
    assert sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in found), key=repr) == sorted(plain, key=repr)
    assert pii.find_spans(no_docs, pii.train(no_docs)).count() == 0


def test_span_query_states_the_base_spans(spark, odd_docs, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda docs: pii.Detector(None))
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii_tagger(spark, str(tmp_path)).collect()
    want = []
    for i, text in odd_rows:
        spans = sorted(plain_rules(text or ""))
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        want.append((i, *(sum(k == n for k, *_ in spans) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined, 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def cheapest(roles):
    """Least cost by trying every legal output sequence state by state."""
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for price, to, *_ in chat.MOVES[role][state]:
                after[to] = min(after.get(to, chat.FAR), cost + price)
        best = after
    return min(c + chat.END_COST[s] for s, c in best.items())


def test_repairs_are_legal_and_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            moves, state = chat.walk(roles, chat.END_COST, chat.START)
            assert sum(m[0] for m in moves) + chat.END_COST[state] == cheapest(roles)
            spoken, at = [], chat.START
            for _, to, action, before in moves:
                spoken += list(before) + ([] if "merge" in action else [to - 1])
            for role in [*spoken, *chat.ENDING[state]]:
                assert role in chat.NEXT[at]
                at = 1 + role
            assert at == 3


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv_key string, rendered string")


def rendered(df):
    out = collections.defaultdict(str)
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["turn_index"], r["part"])):
        out[r["conv_id"]] += r["rendered"]
    return dict(out)


def test_chats_of_odd_and_no_rows(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 1, "user", "b"),
        (3, 2, "bot", "c"), (4, None, None, None), (5, 0, "USER ", "<|im_end|>"), (5, 1, "tool", "out"), (None, 0, "user", "q"), (None, 1, "assistant", ""),
        (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "user", "long " * 20_000), (8, 0, "user", "x"), (8, 1, "system", "late"), (8, 2, "assistant", "y"),
    ]
    got = rendered(chat.repair_chats(chats(spark, rows).repartition(3)))
    s, e = "<|im_start|>", "<|im_end|>\n"
    assert got[1] == f"{s}system\nbe kind{e}{s}user\nhi{e}{s}assistant\nhello{e}"
    assert got[2] == f"{s}user\n{e}{s}assistant\nfirst{e}"
    assert got[3] == f"{s}user\na\nb{e}{s}assistant\nc{e}"
    assert got[5] == f"{s}user\n< |im_end|>{e}{s}assistant\nout{e}"
    assert got[None] == f"{s}user\nq{e}{s}assistant\n{e}" and got[6] == f"{s}user\nsame\nsame{e}{s}assistant\n{e}"
    assert len(got[7]) > 100_000 and got[4].count(s) == 2 and got[8].startswith(f"{s}user\nx") and got[8].count(s) == 2
    assert chat.repair_chats(chats(spark, rows).limit(0)).count() == 0


def test_a_chat_over_many_partitions_is_repaired_as_one(spark):
    draw = random.Random(6)
    rows = [(1, t, draw.choice(["user", "user", "assistant", "system", "odd"]), f"t{t}") for t in range(700)]
    rows += [(c, t, draw.choice(["user", "assistant"]), "x") for c in (0, 2, 3) for t in range(5)]
    want = {}
    for conv in (0, 1, 2, 3):
        mine = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows if r[0] == conv]
        roles = tuple(chat.role_number(r["role"]) for r in mine)
        moves, _ = chat.walk(roles, chat.END_COST, chat.START)
        want[conv] = "".join(f["rendered"] for f in chat.fragments(mine, moves, chat.START, 0, True))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rendered(chat.repair_chats(chats(spark, rows))) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


PAGES = "page_id bigint, url string, html string, digest string, refers_to string, frame string"


def test_archives_of_odd_and_no_rows(spark):
    big, other = "é" * 700, "<p>" + "z" * 5000
    pages = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (8, "u", big), (8, "u", big), (9, "u", "")]
    df = spark.createDataFrame([(*p, "d", "r", "f") for p in pages], PAGES).repartition(2)
    index = warc.write_archives(df, warc.archive_folder(spark), frame_bytes=900, bundle_bytes=3000)
    rows = warc.read_archives(index).collect()
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        refers = 8 if html == big and page is not None and page < 8 else None
        want.append((page, "revisit" if refers else "response", refers, len(raw), hashlib.sha1(raw).hexdigest()))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["payload"] == (dict((p[0], p[2]) for p in pages)[r["page_id"]] or "").encode() for r in rows if r["record_type"] == "response")
    for place in index.collect():
        record = warc.read_record(place["bundle"], place["frame"], place["start"], place["size"])
        headers, _ = warc.parse_record(record)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and warc.page_of(headers["warc-record-id"]) == place["page_id"]
    bundle = index.first()["bundle"]
    store, name = warc.store_of(bundle)
    data = store.open_input_file(name).readall()
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as whole:
        assert whole.read().count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == bundle).count()
    assert warc.read_archives(warc.write_archives(df.limit(0), warc.archive_folder(spark))).count() == 0


def test_packing_gets_texts_in_small_batches(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 1000).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    packing.token_rows(texts, public_tokenizers.path("word_bpe_49k.json"), 2, 8 << 20, 29)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert max(r.n for r in texts.mapInArrow(sizes, "n bigint").collect()) <= packing.BATCH_BYTES + (1 << 20)
