"""Pack documents into token sequences: first fit, largest first, in random groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import ship, text_or_empty, tidy
from shelflight.llm.token_ids import LOADED, slices, word_tokenizer

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
TOKENS = "doc_id bigint, row bigint, pack_group bigint, ids binary"
BATCH_BYTES = 4 << 20
GROUP_BITS = 32  # sequence_id is the group's number and, in so many low bits, the sequence's number in the group


class FitTree:
    """Free space of `size` bins; every inner node holds the larger of its two children, as in a tournament."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put `size` into the first bin with room for it; return the bin and its free space before."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        before = free[node]
        free[node] = before - size
        leaf, node = node, node >> 1
        while node:
            larger = max(free[2 * node], free[2 * node + 1])
            if free[node] == larger:
                break
            free[node] = larger
            node >>= 1
        return leaf - self.leaves, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, pieces taken from the largest; equal ones in their order."""
    tree = FitTree(max(1, len(sizes)), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], before = tree.place(sizes[i])
        offsets[i] = capacity - before
    return bins, offsets


def top_up(pieces: list[tuple[int, int, int]], capacity: int, least: int) -> list[tuple[int, int, int, int]]:
    """Empty the emptiest bins into the gaps of fuller ones, cutting pieces; `pieces` are (bin, begin, end).

    A gap is filled if it has `least` tokens or more, so that no small scrap is cut off. Returns (bin, offset,
    begin, end) of every piece after that.
    """
    held: dict[int, list[tuple[int, int]]] = {}
    for where, begin, end in pieces:
        held.setdefault(where, []).append((begin, end))
    used = {b: sum(end - begin for begin, end in of) for b, of in held.items()}
    order = sorted(used, key=lambda b: (-used[b], b))
    gaps = [b for b in order if least <= capacity - used[b]]
    while len(gaps) > 1 and used[gaps[-1]] <= sum(capacity - used[b] for b in gaps[:-1]):
        donor = gaps.pop()
        loose = held.pop(donor)
        while loose:
            begin, end = loose.pop()
            target = gaps[0]
            room = min(end - begin, capacity - used[target])
            held[target].append((begin, begin + room))
            used[target] += room
            if room < end - begin:
                loose.append((begin + room, end))
            if used[target] == capacity:
                gaps.pop(0)
    out = []
    for where in sorted(held):
        at = 0
        for begin, end in held[where]:
            out.append((where, at, begin, end))
            at += end - begin
    return out


def pack_group(table: pa.Table, capacity: int, least: int) -> pa.Table:
    """Pieces of one group of documents with their sequences."""
    rows = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
    docs, buffers, group = rows["doc_id"].to_pylist(), rows["ids"].to_pylist(), table["pack_group"][0].as_py()
    counts = [len(b) // 4 for b in buffers]
    begins = np.concatenate([[0], np.cumsum(counts)])
    whole, parts = [], []
    for i, count in enumerate(counts):
        full = count // capacity * capacity
        whole += [(int(begins[i]) + at, int(begins[i]) + at + capacity) for at in range(0, full, capacity)]
        if full < count:
            parts.append((int(begins[i]) + full, int(begins[i + 1])))
    bins, _ = first_fit_decreasing([end - begin for begin, end in parts], capacity)
    placed = top_up([(b, *part) for b, part in zip(bins, parts, strict=True)], capacity, least)
    first_whole = max(bins, default=-1) + 1
    placed += [(first_whole + k, 0, begin, end) for k, (begin, end) in enumerate(whole)]
    of = np.searchsorted(begins, [begin for _, _, begin, _ in placed], side="right") - 1
    out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
    for doc, (where, offset, begin, end) in zip(of.tolist(), placed, strict=True):
        start = begin - int(begins[doc])
        out["doc_id"].append(docs[doc])
        out["start"].append(start)
        out["length"].append(end - begin)
        out["ids"].append(buffers[doc][4 * start : 4 * (start + end - begin)])
        out["doc_tokens"].append(counts[doc])
        out["sequence_id"].append((group << GROUP_BITS) + where)
        out["offset"].append(offset)
    return pa.table({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, group_bytes: int, seed: int) -> DataFrame:
    """doc_id, a row number, a random group and all ids of each document in little-endian 32 bits."""
    ship(docs.sparkSession)
    # Batches of whole texts are held by the JVM, in the pipe and by the worker: 4 MB each instead of 10,000 rows.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    volume = docs.select(F.sum(F.octet_length(text_or_empty()) + F.lit(64).cast("bigint"))).first()[0] or 0
    groups = max(1, -(-volume // group_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        close = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first, count in slices(batch.column("text"), 1 << 20):
                part = batch.slice(first, count)
                ids, at = words.encode(part.column("text"))
                flat, at = memoryview(ids.astype("<u4", copy=False).tobytes()), (4 * at).tolist()
                each = pa.array([bytes(flat[a:b]) + close for a, b in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), part.column("pack_group"), each], names=["doc_id", "row", "pack_group", "ids"]
                )
        tidy(keep=LOADED)  # the memory of words serves the next task

    return rows.mapInArrow(encode, TOKENS)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, least_cut: int = 128,
    group_bytes: int = 8 << 20, seed: int = 29,
) -> DataFrame:
    """Cut and pack the token ids of all documents into sequences of at most `capacity` ids.

    Every row is encoded whole by the tokenizer file, followed by `end_id`. Rows go to random groups of about
    `group_bytes` of text. In a group, runs of `capacity` ids are sequences of their own; what is left of each
    document goes, largest first, into the first sequence with room, found by a tournament tree. At last the
    emptiest sequences are cut up to fill gaps of `least_cut` ids or more. Groups are independent, so at most
    their last sequence stays part empty.

    Returns one row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens,
    sequence_id, offset. Null and empty texts are the single `end_id`. Repeated rows and ids are packed each on
    its own, null ids too. `docs` should be a stored table: groups follow the places of rows in its files. An empty
    table gives no pieces. Other columns are not looked at.
    """
    rows = token_rows(docs, tokenizer, end_id, group_bytes, seed)

    def packed(table: pa.Table) -> pa.Table:
        return pack_group(table, capacity, least_cut)

    return rows.groupBy("pack_group").applyInArrow(packed, PIECES)
