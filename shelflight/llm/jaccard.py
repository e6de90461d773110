"""Join documents by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Documents with the same set of shingles are one node, known by a number of the set. All shingles have one order, by the
number of times that they occur and then by their own number. If two sets are similar enough, their prefixes in this order
share a shingle; if both prefixes are longer by l - 1 shingles, they share l of them. Every set takes the l that
promises the least work, and a pair is verified only if it shares as many prefix shingles as the smaller l of the two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import Runs, components, discard, may_hold, ship, stored, text_or_empty, tidy
from shelflight.llm.shingles import mix, shingle_numbers, shingle_sets, word_numbers
from shelflight.llm.token_ids import slices

SKETCH_BITS = 22  # occurrences of shingles are counted in so many buckets, whatever the input
CHUNK_BITS = 14  # buckets of one row of a sketch
SKETCH_STEPS = 8  # a byte of the merged sketch holds so many steps for each doubling of the count
SEEN_BITS = 27  # bits of the map of prefix shingles that two sets have or more
VERIFY_COST = 50.0  # work to verify a candidate, as a multiple of the work to look at one more posting; and n for its text
STEP = 40  # a set of n shingles takes an l of 1 + n // STEP at least: large sets meet others by chance
LONGEST = 4  # so many values of l from there on
SLICE = 4 << 20
NEAREST = 6  # shingles of a prefix, next before a meeting's own, that go to the meeting with the set
BLOCK = 256  # sets of one token that one side of a meeting holds
PARTNERS = 512  # partners of a set that one group of the verification holds


def set_number(shingles: np.ndarray) -> int:
    """A number of 64 bits for a set of shingles, whatever their order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def _packed(counts: np.ndarray, bits: int) -> list[bytes | None]:
    """Each chunk of a sketch compressed, None where it is empty."""
    chunks = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, 1 << bits)
    return [zlib.compress(chunk.tobytes(), 1) if chunk.any() else None for chunk in chunks]


def census(texts: DataFrame, size: int) -> DataFrame:
    """n (size) and key of the set of every row (chunk is null), and for each task how often shingles occur, by bucket.

    The counts of a task are one compressed row for each chunk of buckets, a few MB at most.
    """
    names = ["doc_id", "mark", "n", "key", "chunk", "counts"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for first, rows in slices(batch.column("text"), SLICE):
                part = batch.slice(first, rows)
                numbers, at = shingle_numbers(*word_numbers(part.column("text")), size)
                seen += np.bincount((numbers >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(seen)).astype(np.uint32)
                sets = [np.unique(numbers[a:b]) for a, b in zip(at, at[1:], strict=False)]
                sizes, keys = [len(x) for x in sets], [set_number(x) if len(x) else None for x in sets]
                columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *columns], names=names)
        chunks = [(i, packed) for i, packed in enumerate(_packed(seen, CHUNK_BITS)) if packed is not None]
        empty = [pa.nulls(len(chunks), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array([i for i, _ in chunks], pa.int32()), pa.array([packed for _, packed in chunks], pa.binary())], names=names
        )
        tidy()

    return texts.mapInArrow(count, "doc_id bigint, mark bigint, n bigint, key bigint, chunk int, counts binary")


def shingle_sketch(counted: DataFrame) -> np.ndarray:
    """Logarithm of the occurrences of shingles by bucket over all documents, in steps.

    Of a fixed size (4 MB), so it fits driver and executors. Its steps only order shingles and estimate work.
    """

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(packed.as_buffer()), dtype=np.uint16)
                sums[chunk] = sums.get(chunk, 0) + counts.astype(np.int64)
        steps = [np.minimum(np.round(np.log2(np.maximum(x, 1)) * SKETCH_STEPS), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], names=["chunk", "steps"])

    rows = counted.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(merge, "chunk int, steps binary")
    sketch = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, 1 << CHUNK_BITS), dtype=np.uint8)
    for row in rows.toArrow().to_pylist():
        sketch[row["chunk"]] = np.frombuffer(row["steps"], dtype=np.uint8)
    return sketch.reshape(-1)


def choose_length(steps: np.ndarray, base: int) -> int:
    """The l of least estimated work for a set, from the sketch's steps for its ordered shingles.

    At l the set looks at the postings of base + l - 1 shingles. Each candidate appears in l of them or more,
    so there are at most postings / l to verify.
    """
    least = 1 + len(steps) // STEP
    most = min(least + LONGEST - 1, len(steps) - base + 1)
    lengths = np.arange(min(least, most), most + 1)
    postings = np.cumsum(np.exp2(steps[: base - 1 + most] / SKETCH_STEPS))[base - 2 + lengths]
    return int(lengths[np.argmin(postings * (1 + (VERIFY_COST + len(steps)) / lengths))])


def prefixes(texts: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """key, n (size of the set), l and tokens (the prefix, in order) of every row that has a set and an id."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses_of = shared.value
        for batch in batches:
            for first, rows in slices(batch.column("text"), SLICE):
                part = batch.slice(first, rows)
                numbers, at = shingle_numbers(*word_numbers(part.column("text")), size)
                keys, sizes, lengths, tokens = [], [], [], []
                for named, a, b in zip(part.column("doc_id").is_valid().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if a == b or not named:
                        continue
                    own = np.unique(numbers[a:b])
                    use = uses_of[own >> np.uint64(64 - SKETCH_BITS)]
                    order = np.argsort(use, kind="stable")
                    base = len(own) - (percent * len(own) + 99) // 100 + 1
                    length = choose_length(use[order], base)
                    keys.append(set_number(own))
                    sizes.append(len(own))
                    lengths.append(length)
                    tokens.append(own[order[: base + length - 1]].view(np.int64))
                columns = [pa.array(x, pa.int64()) for x in (keys, sizes, lengths)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(tokens)], names=["key", "n", "l", "tokens"])
        tidy()

    return texts.mapInArrow(take, "key bigint, n bigint, l bigint, tokens array<bigint>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def seen_twice(sets: DataFrame) -> np.ndarray:
    """A map of bits that is set for every prefix shingle of two sets or more, and by chance for others.

    Of a fixed size (16 MB): with very many shingles it fills up and spares less of the shuffle; results stay.
    """
    chunk = 1 << CHUNK_BITS

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((1 << SEEN_BITS) // 8, dtype=np.uint8), np.zeros((1 << SEEN_BITS) // 8, dtype=np.uint8)
        for batch in batches:
            spots, times = np.unique(_spots(batch.column("tokens").flatten().to_numpy(), SEEN_BITS), return_counts=True)
            if not len(spots):
                continue
            bits = (128 >> (spots & 7)).astype(np.uint8)
            places, first = np.unique(spots >> 3, return_index=True)
            again = np.bitwise_or.reduceat(np.where(times > 1, bits, np.uint8(0)), first)
            own = np.bitwise_or.reduceat(bits, first)
            twice[places] |= again | (once[places] & own)
            once[places] |= own
        maps = [m.reshape(-1, chunk) for m in (once, twice)]
        held = np.flatnonzero(maps[0].any(axis=1))
        packed = [pa.array([zlib.compress(m[i].tobytes(), 1) for i in held], pa.binary()) for m in maps]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *packed], names=["chunk", "once", "twice"])
        tidy()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = (np.frombuffer(zlib.decompress(row[c]), dtype=np.uint8) for c in ("once", "twice"))
                had, often = found.get(row["chunk"], (0, 0))
                found[row["chunk"]] = (had | once, often | twice | (had & once))
        columns = [pa.array(list(found), pa.int32()), pa.array([often.tobytes() for _, often in found.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "twice"])

    maps = sets.select("tokens").mapInArrow(work, "chunk int, once binary, twice binary")
    out = np.zeros(((1 << SEEN_BITS) // 8 // chunk, chunk), dtype=np.uint8)
    for row in maps.repartition("chunk").mapInArrow(merge, "chunk int, twice binary").toArrow().to_pylist():
        out[row["chunk"]] = np.frombuffer(row["twice"], dtype=np.uint8)
    return out.reshape(-1)


def _spots(tokens: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(tokens.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def shared_postings(sets: DataFrame, twice: np.ndarray) -> DataFrame:
    """token, key and facts (n, rank and what l is beyond its least, in one number) of prefix shingles that the map holds."""
    spark = sets.sparkSession
    held = spark.sparkContext.broadcast(twice)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            tokens, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            spots = _spots(tokens, SEEN_BITS)
            keep = (held.value[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1).astype(bool)
            each = np.diff(ends)
            rank = np.arange(len(tokens)) - np.repeat(ends[:-1] - ends[0], each)
            key, n, length = (np.repeat(batch.column(c).to_numpy(), each) for c in ("key", "n", "l"))
            facts = (n << 32) + (rank << 3) + length - (1 + n // STEP)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tokens, key, facts)], names=["token", "key", "facts"])

    return sets.mapInArrow(take, "token bigint, key bigint, facts bigint")


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, from their whole texts.

    Texts of the partners travel to a, in groups of about PARTNERS, so a document with very many partners is
    split over tasks. A task holds the set of one a at a time.
    """
    parts = F.ceil(F.count("*") / PARTNERS).alias("parts")
    hubs = pairs.groupBy("a").agg(parts)
    salted = pairs.join(hubs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")))
    held = texts.select(F.col("key").alias("id"), "text")
    heads = (
        hubs.join(held, F.col("a") == F.col("id"))
        .select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "text")
    )
    rows = heads.unionByName(salted.join(held, F.col("b") == F.col("id")).select("a", "salt", "b", "text"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, []
        for batch in batches:
            for first, count in slices(batch.column("text"), SLICE):
                part = batch.slice(first, count)
                links = []
                columns = [part.column(c).to_pylist() for c in ("a", "salt", "b")]
                for a, salt, b, own in zip(*columns, shingle_sets(part.column("text"), size), strict=True):
                    if group != (a, salt):
                        group, known = (a, salt), []
                    if b is None:
                        if not any(np.array_equal(own, other) for other in known):
                            known.append(own)
                        continue
                    for other in known:
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if common and 100 * common >= percent * (len(own) + len(other) - common):
                            links.append((a, b))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        tidy()

    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(compare, "a bigint, b bigint").distinct()


def common_counts(lists: list[np.ndarray]) -> np.ndarray:
    """For each pair of lists of different numbers, how many both have."""
    sizes = np.array([len(x) for x in lists])
    out = np.zeros((len(lists), len(lists)), dtype=np.int64)
    if not sizes.any():
        return out
    owner, (values, member) = np.repeat(np.arange(len(lists)), sizes), np.unique(np.concatenate(lists), return_inverse=True)
    order = np.argsort(member, kind="stable")
    owner, at, starts = owner[order], np.searchsorted(member[order], np.arange(len(values) + 1)), np.cumsum(sizes) - sizes
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        if size:
            out[i] = np.bincount(np.concatenate([owner[at[v] : at[v + 1]] for v in member[start : start + size]]), minlength=len(lists))
    return out


def least_shared(n: Column, percent: int) -> Column:
    """The smallest l of any set that one of n shingles can be similar to."""
    return 1 + F.floor(F.ceil(n * percent / 100) / STEP)


def due_pairs(rows: dict[str, list], percent: int) -> np.ndarray:
    """Which pairs of sets that have a prefix shingle are to be verified there, as a matrix.

    `rows` hold n, l, rank (of the shingle), label, apart (a block, or its own place), before (all or some shared shingles
    of the set's prefix before this one, in order; with some, more pairs are due) and behind (how many there are from this one on). A pair is due at the
    first shingle that both prefixes have, and only if its labels differ, its sizes fit, enough shingles follow for the
    overlap that similar sets need, and enough of the prefixes for the smaller l.
    """
    n, length, rank, behind = (np.array(rows[c]) for c in ("n", "l", "rank", "behind"))
    due = np.not_equal.outer(np.array(rows["label"]), np.array(rows["label"])) & np.not_equal.outer(np.array(rows["apart"]), np.array(rows["apart"]))
    due &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    due &= (100 + percent) * np.minimum.outer(n - rank, n - rank) >= percent * np.add.outer(n, n)
    due &= np.minimum.outer(behind, behind) >= np.minimum.outer(length, length)
    if due.any():
        due &= common_counts([np.array(x, dtype=np.int64) for x in rows["before"]]) == 0
    return due


PLACE = ("token", "one", "two")
MET = "token bigint, one bigint, two bigint, block bigint, key bigint"


def chosen_at(rows: DataFrame, choose: Callable[[dict[str, list]], np.ndarray]) -> DataFrame:
    """The rows (token, one, two, block, key) of each meeting that `choose` marks."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in Runs(batches, PLACE):
            if run.num_rows < 2:
                continue
            columns = {name: run.column(name).to_pylist() for name in run.column_names}
            # Within one block every set meets every other, of two blocks only those of the other one.
            columns["apart"] = list(range(run.num_rows)) if columns["one"][0] == columns["two"][0] else columns["block"]
            mask = choose(columns)
            if mask.any():
                kept = run.select([*PLACE, "block", "key"]).filter(pa.array(mask))
                yield from kept.combine_chunks().to_batches()
        tidy()

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(work, MET)


def meetings(postings: DataFrame, percent: int) -> DataFrame:
    """(token, one, two, block, key): the sets to be verified with one another, and where.

    `postings` hold token, key, n, l, rank, label and blocks, of tokens with several labels. A token's sets are
    dealt to so many blocks, and blocks meet in pairs. No pair of sets becomes a row. A pair that shares l shingles
    has the first of them before the last l - 1 of either prefix, so a set only goes to those. Of the shingles before it only
    the NEAREST go with it: they exclude most pairs that have met before, and whole lists, which would grow with
    the square of the prefix, follow for the sets that are left. There `counted` decides.
    """
    lists = postings.groupBy("key", "n", "l", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "blocks"))).alias("held"))
    lists = stored(lists, "prefix-lists")
    behind = F.size("held") - F.col("at")
    rows = lists.select("*", F.posexplode("held").alias("at", "here")).where(behind >= least_shared(F.col("n"), percent))
    rows = rows.select(
        "key", "n", "l", "label", F.col("here.*"), behind.alias("behind"),
        F.transform(F.slice("held", F.greatest(F.col("at") - NEAREST, F.lit(0)) + 1, F.least("at", F.lit(NEAREST))), lambda x: x["token"]).alias("before"),
    )
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")
    met = stored(chosen_at(dealt, lambda found: due_pairs(found, percent).any(axis=1)), "first-meetings")

    def counted(found: dict[str, list]) -> np.ndarray:
        """The sets of pairs that share as many prefix shingles as the smaller l, by their whole lists."""
        tokens = [np.array([x["token"] for x in held], dtype=np.int64) for held in found["held"]]
        place = [int(np.flatnonzero(x == found["token"][0])[0]) for x in tokens]
        rank = [held[i]["rank"] for held, i in zip(found["held"], place, strict=True)]
        before = [x[:i] for x, i in zip(tokens, place, strict=True)]
        due = due_pairs(found | {"rank": rank, "before": before, "behind": [len(x) - i for x, i in zip(tokens, place, strict=True)]}, percent)
        if due.any():
            due &= common_counts(tokens) >= np.minimum.outer(np.array(found["l"]), np.array(found["l"]))
        return due.any(axis=1)

    both = stored(chosen_at(met.join(lists, "key"), counted), "meetings")
    discard(lists, met)
    return both


def joined(sets: list[np.ndarray], across: np.ndarray | None, percent: int) -> np.ndarray:
    """The first row that each row reaches through similar sets, found by counting common members."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, member = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(member, kind="stable")
    owner, at = owner[order], np.searchsorted(member[order], np.arange(len(values) + 1))
    starts = np.cumsum(sizes) - sizes
    root = np.arange(len(sets))
    for i in range(len(sets)):
        mine = member[starts[i] : starts[i] + sizes[i]]
        if not len(mine):
            continue
        partners = np.concatenate([owner[at[v] : at[v + 1]] for v in mine])
        common = np.bincount(partners, minlength=len(sets))
        near = (common > 0) & (100 * common >= percent * (sizes[i] + sizes - common))
        if across is not None:
            near &= across != across[i]
        near[i] = True
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root


def verify_meetings(met: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets of each meeting which similarity connects, from whole texts."""
    rows = met.join(texts, "key").repartition(*PLACE).sortWithinPartitions(*PLACE)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in Runs(batches, PLACE):
            texts = run["text"].combine_chunks()
            sets = [s for first, count in slices(texts, SLICE) for s in shingle_sets(texts.slice(first, count), size)]
            nodes = run["key"].to_numpy()
            across = run["block"].to_numpy() if run["one"][0].as_py() != run["two"][0].as_py() else None
            root = joined(sets, across, percent)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]]), pa.array(nodes[moved])], names=["a", "b"])
        tidy()

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def _facts(packed: str) -> dict[str, Column]:
    """n, rank and l from `facts`."""
    parts = {"n": f"shiftright({packed}, 32)", "rank": f"shiftright({packed}, 3) & 536870911", "l": f"({packed} & 7) + 1 + shiftright({packed}, 32) div {STEP}"}
    return {name: F.expr(f"cast({part} as bigint)") for name, part in parts.items()}


def able(postings: DataFrame, percent: int) -> DataFrame:
    """The keys of sets that have as many postings as a pair with the smallest set that they can be similar to needs."""
    counts = postings.groupBy("key", "n").agg(F.count("*").alias("held"))
    return counts.where(F.col("held") >= least_shared(F.col("n"), percent)).select("key")


def texts_of(keys: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """key and text of one document of each set in `keys`; other texts are not moved where a bitmap excludes their id."""
    chosen = members.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("of"), F.count("*").alias("rows")).join(keys, "key", "left_semi")
    chosen = stored(chosen.select("key", F.col("of.doc_id").alias("id"), F.col("of.mark").alias("their_mark"), (F.col("rows") > 1).alias("several")), "candidate-ids")
    wanted = may_hold(texts, F.col("doc_id"), chosen.select("id")).where("may").drop("may")
    found = wanted.join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("their_mark"))).select("key", "text", "several")
    # A row that is repeated, with its id, comes once; only sets of several rows can have one.
    single = found.where("NOT several").select("key", "text")
    return stored(single.unionByName(found.where("several").groupBy("key").agg(F.first("text").alias("text"))), "candidates")


def similar_pairs(texts: DataFrame, members: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """Links (a, b) of sets, enough of them that sets are connected exactly if similar pairs connect them.

    First every set is compared with one other, of the smallest sets of its prefix shingles that with which it shares
    most. This joins most of a group of near copies at about one comparison each. Then all pairs that share enough
    prefix shingles and are not joined yet meet at one of these shingles and are compared inside a task, so pairs
    never become rows.
    """
    all_sets = prefixes(texts, sketch, size, percent).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "l", "tokens")])
    sets = stored(all_sets, "sets")
    postings = stored(shared_postings(sets, seen_twice(sets)), "prefixes")
    hub = F.min(F.struct("key", "facts")).alias("hub")
    hubs = postings.groupBy("token").agg(hub, F.max("key").alias("last")).where("hub.key < last").select("token", "hub")
    # Facts stay packed, in rows of five numbers, until few rows are left.
    met = stored(postings.join(hubs, "token").select("token", "key", "facts", F.col("hub.key").alias("hub"), F.col("hub.facts").alias("hub_facts")), "met-postings")
    discard(sets, postings)
    facts, theirs = _facts("facts"), [column.alias(f"hub_{name}") for name, column in _facts("hub_facts").items()]
    kept = met.join(able(met.select("key", facts["n"].alias("n")), percent), "key", "left_semi")
    common = stored(kept.select("token", "key", *[c.alias(n) for n, c in facts.items()], "hub", *theirs), "postings")
    discard(met)
    near = texts_of(common.select("key").distinct(), members, texts)
    behind = [F.col(n) - F.min(rank) for n, rank in (("n", "rank"), ("hub_n", "hub_rank"))]
    star = (
        common.where("key <> hub").groupBy("hub", "key", "n", "hub_n")
        .agg(F.count("*").alias("shared"), F.least(F.min("l"), F.min("hub_l")).alias("least"), F.least(*behind).alias("behind"))
        .where(_sizes_fit("n", "hub_n", percent) & (F.col("shared") * 4 >= F.col("least")))
        .where(F.col("behind") * (100 + percent) >= (F.col("n") + F.col("hub_n")) * percent)
    )
    best = F.max(F.struct("shared", F.bitwise_not("hub").alias("first"), "hub")).alias("best")
    first = stored(star.groupBy("key").agg(best).select(F.col("best.hub").alias("a"), F.col("key").alias("b")), "star-pairs")
    links = stored(verify(first, near, size, percent), "star-links")
    # Two steps along the links are enough: a label need not reach the end of a chain, only never leave it.
    nearest = links.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("label"))
    onward = nearest.select(F.col("key").alias("label"), F.col("label").alias("next"))
    labels = stored(nearest.join(onward, "label", "left").select("key", F.coalesce("next", "label").alias("label")), "labels")
    tagged = common.select("token", "key", "n", "l", "rank").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    blocks = F.ceil(F.count("*") / BLOCK).alias("blocks")
    apart = tagged.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks).where("low < high")
    split = stored(tagged.join(apart.select("token", "blocks"), "token"), "apart-postings")
    discard(common, labels)
    mixed = stored(split.join(able(split, percent), "key", "left_semi"), "mixed-postings")
    discard(split)
    places = meetings(mixed, percent)
    found = stored(links.unionByName(verify_meetings(places, near, size, percent)), "similar-pairs")
    discard(near, first, links, mixed, places)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document with the group of documents that chains of similar pairs connect.

    A document's set holds the runs of `size` words of its whole text, A-Z in lower case; a shorter text is one
    run. Two documents are linked if 100 * intersection >= `percent` * union. Returns doc_id, n_shingles (long, size of
    the set), component_id (smallest doc_id that links reach, its own without links). Null and empty texts, and
    texts of white space, have empty sets and link with nothing. Rows that share a doc_id are one document: a link
    of one is a link of all. Rows without doc_id have no component_id and link with nothing. An empty table gives no
    rows. Other columns are not looked at. Sets, like shingles, are told apart by numbers of 64 bits. `percent` is from 5 to 100.
    """
    if not 5 <= percent <= 100:
        raise ValueError(f"a similarity of 5 to 100 percent, not {percent}")
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("mark", F.xxhash64("text"))
    counted = stored(census(texts, size), "census")
    members = counted.where("chunk IS NULL AND key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "mark", "key")
    links = similar_pairs(texts, members, shingle_sketch(counted), size, percent)
    # Sets that rows of one doc_id have are linked by it.
    several = members.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b")
    same = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("key").alias("b")).where("a <> b")
    groups = components(links.unionByName(same)).select(F.col("id").alias("key"), F.col("component").alias("label"))
    sets = members.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows"))
    named = sets.join(groups, "key", "left").withColumn("label", F.coalesce("label", "key"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component"), F.max("high").alias("most")).where("component < most")
    groups = stored(named.join(lowest, "label").select("key", "component", "rows"), "groups")
    # Sets that more than a 2,000th of the grouped rows have are less than 2,000.
    most = (groups.agg(F.sum("rows")).first()[0] or 0) // 2_000
    often = F.broadcast(groups.where(F.col("rows") > most).select("key", "component"))
    rest = groups.where(F.col("rows") <= most).select("key", "component")
    found = members.join(often, "key").unionByName(members.join(often, "key", "left_anti").join(rest, "key"))
    moved = found.where("doc_id <> component").select("doc_id", "component").distinct()
    sizes = counted.where("chunk IS NULL").select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(moved, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without the documents that are not the smallest id of their group, with all columns.

    Rows without doc_id, and documents without words, stay; so do all rows of an id that stays. An empty table gives no rows.
    """
    dropped = near_duplicates(docs, size, percent).where("component_id <> doc_id")
    dropped = stored(dropped.select(F.col("doc_id").alias("id")).distinct(), "near-copies")
    rows = may_hold(docs.select(F.struct("*").alias("row")), F.col("row.doc_id").cast("bigint"), dropped)
    unsure = rows.where("may").join(dropped, F.col("row.doc_id") == F.col("id"), "left_anti")
    return rows.where("NOT may").unionByName(unsure).select("row.*")
