"""A Merkle manifest of a dataset: content-addressed nodes, and proofs by descent from the root.

Each tree (here one for each language, and one over their roots) has its leaves in order; every 8 consecutive nodes
become the digest of their digests, until one is left. Nodes are stored as records of a digest and its children. A proof
starts at the root's digest: the digits of the leaf's rank in base 8 say which child to go to, the other children are
collected, and the collected segments reversed lead from the leaf to the root.

Four levels at a time are built and descended in packs of 8^4 = 4,096 consecutive nodes, so a task holds one pack, however
large a tree is.
"""

from __future__ import annotations

import dataclasses
import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.shared import ship, stored

FAN_BITS = 3  # eight children
LEVELS = 4  # levels of one pack
PACK = 1 << FAN_BITS * LEVELS
_NODE = "tree string, pack bigint, n bigint, digest string, children array<string>"
_PATH = "array<struct<before:string,after:string>>"


def digest_of(*columns: Column) -> Column:
    """SHA-256, in lower-case hex, of the columns' values one after another."""
    return F.sha2(F.concat(*columns), 256)


def framed(column: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; null as a hyphen."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def depth(n: int) -> int:
    """Levels above `n` leaves."""
    return -(-(n - 1).bit_length() // FAN_BITS) if n > 1 else 0


def ranked(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """`leaves` with rank, from 0, within their tree in the order of the columns, and n, the tree's size.

    One range sort of the narrow rows. Ranks are places within a partition plus what earlier partitions hold, which
    is one row per partition and tree. Rows that repeat are spread over partitions by a hash of their place.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    ordered = leaves.withColumn("spread", spread).repartitionByRange("tree", *order, "spread").sortWithinPartitions("tree", *order)
    ordered = stored(ordered.drop("spread").withColumn("place", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    runs = ordered.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = stored(runs.select("tree", "part", (earlier - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("n")), f"{name}-runs")
    return ordered.join(runs, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _h(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode("ascii")).hexdigest()


def _build_pack(key: tuple, nodes: pa.Table) -> pa.Table:
    """Records of up to four levels over consecutive nodes, and the node on top, which has no children here."""
    tree, pack = (k.as_py() for k in key)
    n = nodes.column("n")[0].as_py()
    level = nodes.sort_by("rank").column("digest").to_pylist()
    found: dict[str, list[str]] = {}
    for _ in range(min(LEVELS, depth(n))):
        runs = [level[i : i + (1 << FAN_BITS)] for i in range(0, len(level), 1 << FAN_BITS)]
        level = [_h(run) for run in runs]
        found |= zip(level, runs, strict=True)
    digests, children = [*found, level[0]], [*found.values(), None]
    size, above = len(digests), -(-n // PACK)
    return pa.table([
        pa.array([tree] * size, pa.string()), pa.array([pack] * size, pa.int64()), pa.array([above] * size, pa.int64()),
        pa.array(digests, pa.string()), pa.array(children, pa.list_(pa.string())),
    ], names=["tree", "pack", "n", "digest", "children"])


def build_trees(leaves: DataFrame) -> list[DataFrame]:
    """Records of all trees, in rounds of four levels from the leaves (tree, rank, n, digest) upwards."""
    rounds, most = [], leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", "rank", "n", "digest")
    while most:
        packed = nodes.withColumn("pack", F.shiftright("rank", FAN_BITS * LEVELS))
        made = stored(packed.groupBy("tree", "pack").applyInArrow(_build_pack, _NODE), "records")
        rounds.append(made)
        nodes = made.where("children IS NULL").select("tree", F.col("pack").alias("rank"), "n", "digest")
        most = -(-most // PACK) if most > 1 else 0
        if most == 1:
            break
    return rounds


def _descend_pack(key: tuple, rows: pa.Table) -> pa.Table:
    """Answer a pack's requests from its records, from the digest and the path on top."""
    tree, pack = (k.as_py() for k in key)
    columns = {c: rows.column(c).to_pylist() for c in ("digest", "children", "path")}
    store = {d: c for d, c in zip(columns["digest"], columns["children"], strict=True) if c is not None}
    entry = next(i for i, path in enumerate(columns["path"]) if path is not None)
    asked = rows.filter(pc.is_valid(rows.column("rank")))
    digests, paths = [], []
    for rank, n in zip(asked.column("rank").to_pylist(), asked.column("n").to_pylist(), strict=True):
        digest, segments = columns["digest"][entry], []
        for level in reversed(range(min(LEVELS, depth(n)))):
            digit = (rank - pack * PACK) >> FAN_BITS * level & (1 << FAN_BITS) - 1
            children = store[digest]
            segments.append({"before": "".join(children[:digit]), "after": "".join(children[digit + 1 :])})
            digest = children[digit]
        digests.append(digest)
        paths.append(segments[::-1] + columns["path"][entry])
    top = rows.column("top")[entry].as_py()
    answer = asked.select(["rank", "about"]).combine_chunks()
    names = ["tree", "rank", "about", "digest", "path", "top"]
    segment = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table([
        pa.array([tree] * len(asked), pa.string()), answer.column("rank"), answer.column("about"), pa.array(digests, pa.string()),
        pa.array(paths, segment), pa.array([top] * len(asked), pa.string()),
    ], names=names)


def descend(rounds: list[DataFrame], requests: DataFrame, entries: DataFrame) -> DataFrame:
    """tree, rank, about, digest, path and top for every request (tree, rank, n, about) of a leaf.

    `entries` hold tree, digest (of the root to start from) and path (from that root onwards). Packs of an upper
    round answer for the packs below them first. A path lists, from the leaf upwards, the siblings before and after.
    `top` is the digest that the tree's descent started from.
    """
    at = entries.select("tree", F.lit(0).cast("bigint").alias("rank"), "digest", "path", F.col("digest").alias("top"))
    for number in reversed(range(len(rounds))):
        records = rounds[number]
        if number:
            # Every pack below is asked for: its place here is its rank.
            below = rounds[number - 1].where("children IS NULL")
            asked = below.select("tree", F.col("pack").alias("rank"), "n", F.lit(None).cast("string").alias("about"))
        else:
            asked = requests.select("tree", "rank", "n", "about")
        rows = asked.withColumn("pack", F.shiftright("rank", FAN_BITS * LEVELS))
        rows = rows.unionByName(at.select("tree", F.col("rank").alias("pack"), "digest", "path", "top"), allowMissingColumns=True)
        rows = rows.unionByName(records.where("children IS NOT NULL").select("tree", "pack", "digest", "children"), allowMissingColumns=True)
        found = rows.groupBy("tree", "pack").applyInArrow(_descend_pack, f"tree string, rank bigint, about string, digest string, path {_PATH}, top string")
        at = stored(found, "paths") if number else found
    return at


def fold(leaf: Column, path: Column) -> Column:
    """The root's digest from a leaf and its path."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


@dataclasses.dataclass
class Manifest:
    """Leaves in order, the records of the trees over them, and of the tree over the trees' roots."""

    leaves: DataFrame  # tree, rank, n, digest and the columns that describe a leaf
    rounds: list[DataFrame]
    roots: DataFrame  # tree '', rank, n, digest (a subroot) and about (its tree)
    root_rounds: list[DataFrame]
    root: str | None


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of `leaves`: tree (not null), digest and columns that `order` names; an empty table has no root."""
    ship(leaves.sparkSession)
    leaves = ranked(leaves, order, "leaves")
    rounds = build_trees(leaves)
    if not rounds:
        return Manifest(leaves, [], leaves, [], None)
    tops = rounds[-1].where("children IS NULL").select(F.lit("").alias("tree"), F.col("tree").alias("about"), "digest")
    roots = ranked(tops, ["about"], "roots")
    root_rounds = build_trees(roots)
    root = root_rounds[-1].where("children IS NULL").select("digest").first()[0]
    return Manifest(leaves, rounds, roots, root_rounds, root)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """tree, rank, about, digest (the leaf that the descent reaches), path (to the root) and top (the subroot).

    `requests` holds tree, rank, n and about (a text that comes back) of leaves of the manifest, each at most once;
    without it all leaves are asked for. `path` lists from the leaf to the root the digests before and after, as text.
    """
    if requests is None:
        requests = manifest.leaves.withColumn("about", F.lit(None).cast("string"))
    spark, no_path = requests.sparkSession, F.array().cast(_PATH)
    if manifest.root is None:
        empty = f"tree string, rank bigint, about string, digest string, path {_PATH}, top string"
        return spark.createDataFrame([], empty)
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(manifest.root).alias("digest"), no_path.alias("path"))
    subroots = stored(descend(manifest.root_rounds, manifest.roots, start), "subroots")
    entries = subroots.select(F.col("about").alias("tree"), "digest", "path")
    return descend(manifest.rounds, requests, entries)


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree (of the language), doc_id, digest and forged (the digest with A-Z of the text in lower case)."""
    rest = [framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        digest_of(*rest, framed(text)).alias("digest"), F.when(tampered, digest_of(*rest, framed(lowered))).alias("forged"),
    )


def check_documents(docs: DataFrame) -> DataFrame:
    """One row per document with its proof, and whether a copy with a third of all texts tampered with is verified.

    A document's leaf covers doc_id, source, lang, n_chars and text. Leaves of a language ascend by doc_id, null first,
    equal ones by digest; a null language is a tree of its own, before the others. Returns doc_id, leaf, subroot, root,
    path (before and after, from the leaf upwards), folded_root (from the tampered leaf, where there is one) and verified.
    Nulls have leaves like other values, very long texts are hashed whole, repeated rows are leaves each, an empty
    table gives no rows, and other columns are not looked at.
    """
    manifest = build(stored(document_leaves(docs), "digests"), ["doc_id", "digest"])
    about = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "forged")
    proofs = prove(manifest, manifest.leaves.withColumn("about", about) if manifest.root else None)
    told = F.split("about", ",")
    forged = F.coalesce(F.get(told, F.lit(1)), F.col("digest"))
    rows = proofs.select(
        F.when(F.get(told, F.lit(0)) != "", F.get(told, F.lit(0))).cast("bigint").alias("doc_id"), F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"), F.lit(manifest.root).alias("root"), "path", fold(forged, F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
