"""Each operator as a query over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm import alignment, chat, cover_tree, digest_index, jaccard, merkle, mixing, packing, pii, quality, token_counts, url_filter, warc

# Target weights of the mixture: the large source counts less than its share, the others follow their number.
MIXTURE = {"src0": 4.0, **{f"src{i}": 2.0 if i < 5 else 1.0 for i in range(1, 20)}}
MIXTURE_REST = 1.0
MIXTURE_SEED = 17
# Hosts and paths of the rules for URLs.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, folder, "labels")))


def op2_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), MIXTURE, MIXTURE_REST, seed=MIXTURE_SEED)


def op3_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair_chats(table(spark, folder, "conversations"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digest_index.deduplicate(table(spark, folder, "documents"))


def op5_pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.find_spans(docs, pii.train(docs))

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, folder, "documents"), scores)


def op7_cover_tree_links(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, folder, "embeddings"), least=0.95)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"), size=3, percent=90)


def op10_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write_archives(table(spark, folder, "pages"), warc.archive_folder(spark))
    return warc.read_archives(index, ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    proofs = merkle.check_documents(table(spark, folder, "documents"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_documents(table(spark, folder, "documents"), *paths, {"groups_sha256": digest})


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(rules))
    return url_filter.judge(table(spark, folder, "pages"), rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_classifier, op2_source_mixture, op3_chat_repair, op4_exact_dedup, op5_pii_tagger, op6_token_counts,
        op7_cover_tree_links, op8_packing, op9_jaccard_join, op10_warc_bundles, op11_merkle_manifest, op12_token_alignment, op13_url_filter,
    ]
    return {query.__name__: query for query in found}


def _mixture_sql() -> str:
    listed = ", ".join(f"('{name}', {weight!r}::DOUBLE)" for name, weight in MIXTURE.items())
    return f"""
WITH RECURSIVE weights(s, w) AS (VALUES {listed}, (NULL, {MIXTURE_REST!r}::DOUBLE)),
docs AS (SELECT d.*, k.s FROM documents d LEFT JOIN weights k ON d.source = k.s),
amounts AS (SELECT s, sum(length(coalesce(text, '')))::BIGINT AS n FROM docs GROUP BY s HAVING n > 0),
target AS (SELECT a.s, a.n, w.w FROM amounts a JOIN weights w ON a.s IS NOT DISTINCT FROM w.s),
rates AS (SELECT s, w / (SELECT sum(w) FROM target) * 1e0 * (SELECT sum(n) FROM amounts)::DOUBLE / n AS mean FROM target),
draws AS (SELECT s, greatest(1, ceil(mean / 8e0))::BIGINT AS m, mean / greatest(1, ceil(mean / 8e0)) AS rate FROM rates),
steps AS (
    SELECT s, m, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM draws
    UNION ALL
    SELECT s, m, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM steps WHERE k < rate OR term > 1e-18
),
curves AS (SELECT s, m, list(total ORDER BY k) AS curve FROM steps GROUP BY s, m),
drawn AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, curve,
        unnest([('0x' || substr(md5('{MIXTURE_SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT / 4503599627370496e0
                FOR i IN range(m)]) AS u
    FROM docs d JOIN curves c ON d.s IS NOT DISTINCT FROM c.s
),
counted AS (
    SELECT doc_id, text, lang, source, n_chars, sum(len([x FOR x IN curve IF x <= u]))::BIGINT AS copies
    FROM drawn GROUP BY ALL
),
copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT *, ('0x' || substr(md5('{MIXTURE_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy || ':place'), 1, 13))::BIGINT AS shuffle_key
FROM copied"""


# Unsigned crc32 of the decimal doc_id, byte by byte and bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]),
        lambda acc, bit: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384::UBIGINT) ELSE acc >> 1 END)))"""


def _merkle_sql(levels: int = 12) -> str:
    """`levels` bounds the depth of a tree: 8 ** levels leaves."""

    def framed(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || ({column}::VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, base: str) -> str:
        """Nodes by level, and the children of each node, over `base` (tree, rank, n, h)."""
        steps = [f"{name}0 AS MATERIALIZED (SELECT tree, rank AS r, n, h FROM {base})"]
        for i in range(levels):
            steps.append(f"{name}c{i} AS MATERIALIZED (SELECT tree, r // 8 AS r, n, list(h ORDER BY r) AS hs FROM {name}{i} GROUP BY tree, r // 8, n)")
            folded = f"CASE WHEN n > {8**i} THEN sha256(array_to_string(hs, '')) ELSE hs[1] END"
            steps.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, r, n, {folded} AS h FROM {name}c{i})")
        return ",\n".join(steps)

    def climb(name: str, source: str, base: str) -> str:
        """`so_far` (the digest up to here) and `path` (all siblings) climb the tree from `rank` of the rows in `base`."""
        steps, before = [], base
        for i in range(levels):
            d = f"(rank // {8**i}) % 8"
            left, right = f"array_to_string(hs[1:{d}], '')", f"array_to_string(hs[{d} + 2:], '')"
            steps.append(f"""{name}{i} AS (
    SELECT x.* EXCLUDE (so_far, path), CASE WHEN x.n > {8**i} THEN sha256({left} || so_far || {right}) ELSE so_far END AS so_far,
        CASE WHEN x.n > {8**i} THEN path || {left} || {right} ELSE path END AS path
    FROM {before} x JOIN {source}c{i} c ON x.tree = c.tree AND x.rank // {8 ** (i + 1)} = c.r)""")
            before = f"{name}{i}"
        return ",\n".join(steps)

    return f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS h,
        CASE WHEN {_CRC32} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged
    FROM documents
),
ranks AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves
),
{tree("t", "ranks")},
subroots AS MATERIALIZED (SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n, h FROM t{levels}),
{tree("s", "subroots")},
start AS (SELECT *, coalesce(forged, h) AS so_far, '' AS path FROM ranks),
{climb("u", "t", "start")},
middle AS (
    SELECT u.doc_id, u.h AS leaf, b.h AS subroot, u.so_far, u.path, b.tree, b.rank, b.n FROM u{levels - 1} u JOIN subroots b ON u.tree = b.lang
),
{climb("v", "s", "middle")}
SELECT doc_id, leaf, subroot, (SELECT h FROM s{levels}) AS root, sha256(path) AS proof_sha256, so_far AS folded_root, so_far = (SELECT h FROM s{levels}) AS verified
FROM v{levels - 1}"""


def _url_sql() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, row_number() OVER () AS row, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
),
fits AS (
    SELECT row, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (row)"""


_REACHED = """
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(id, seen) AS (
    SELECT a, a FROM edges
    UNION
    SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.seen
),
groups AS (SELECT id, min(seen) AS component FROM reached GROUP BY id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": _merkle_sql(),
        "op13_url_filter": _url_sql(),
        "op2_source_mixture": _mixture_sql(),
        "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op7_cover_tree_links": f"""
WITH RECURSIVE fit AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.95
),
{_REACHED},
linked AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN linked ON a = vec_id LEFT JOIN groups ON id = vec_id""",
        "op9_jaccard_join": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
    FROM words
),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS m FROM sets),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM members x JOIN members y ON x.m = y.m AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
),
{_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN groups ON id = doc_id""",
        "op10_warc_bundles": """
WITH sized AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first THEN first END AS refers_to
FROM kept""",
    }
