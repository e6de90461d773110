"""The Merkle manifest against a plain one."""

import hashlib
import zlib

from pyspark.sql import functions as F

from shelflight.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and the siblings (before, after) of every leaf by level."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain_rows(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) from (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for row in rows:
        doc_id, text = row[:2]
        forge = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        forged = leaf(doc_id, text.translate(lower), *row[2:]) if forge else leaf(*row)
        trees.setdefault(row[2], []).append((doc_id is not None, doc_id or 0, leaf(*row), doc_id, forged))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: plain_tree([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in order}
    root, tops = plain_tree([built[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        subroot, paths = built[lang]
        for (_, _, own, doc_id, forged), path in zip(sorted(trees[lang], key=lambda x: x[:3]), paths, strict=True):
            at = forged
            for before, after in path + top:
                at = h(before, at, after)
            out.append((doc_id, own, subroot, root, h(*[a + b for a, b in path + top]), at, at == root))
    return out


def found_rows(docs):
    proofs = merkle.check_documents(docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return [tuple(r) for r in proofs.withColumn("proof", merkle.proof_digest(F.col("path"))).select(*names).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) if isinstance(x, int) or x is None else (True, x) for x in r))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rank string, path string, pack string"


def test_proofs_of_several_depths_nulls_and_repeated_rows(spark):
    rows = [(i, f"Text {i} Ä", "en", None if i % 5 else "s", i) for i in range(5000)]  # five levels, two packs
    rows += [(i, f"X{i}", "de", "s", None) for i in range(9)] + [(77, "Alone", "fr", "s", 1), (None, None, None, None, None), (5, "", None, "s", 0)]
    rows += [(1, "Text 1 Ä", "en", "s", 1)] * 20 + [(3, "other", "en", "s", 1), (None, "no id", "en", None, 2)]
    docs = spark.createDataFrame([(*r, "d", "r", "p", "k") for r in rows], SCHEMA)
    assert ordered(found_rows(docs)) == ordered(plain_rows(rows))


def test_one_leaf_odd_rows_and_none(spark, odd_docs, no_docs):
    one = [(3, "Only ONE", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, "d", "r", "p", "k") for r in one], SCHEMA)
    assert found_rows(docs) == plain_rows(one)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert ordered(found_rows(odd_docs)) == ordered(plain_rows(rows))
    assert found_rows(no_docs) == []


def test_some_leaves_can_be_asked_for(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 2 else "es", "s", 1, *"drpk") for i in range(300)], SCHEMA)
    manifest = merkle.build(merkle.document_leaves(docs), ["doc_id", "digest"])
    asked = manifest.leaves.where("doc_id IN (7, 8, 120)").withColumn("about", F.col("doc_id").cast("string"))
    rows = merkle.prove(manifest, asked).withColumn("folded", merkle.fold(F.col("digest"), F.col("path"))).collect()
    assert {r["about"] for r in rows} == {"7", "8", "120"} and {r["folded"] for r in rows} == {manifest.root}
    forged = merkle.prove(manifest, asked).select(merkle.fold(F.sha2(F.lit("no"), 256), F.col("path")).alias("folded")).collect()
    assert manifest.root not in {r["folded"] for r in forged}


def test_depth():
    assert [merkle.depth(n) for n in (0, 1, 2, 8, 9, 64, 65, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3, 4, 5]
