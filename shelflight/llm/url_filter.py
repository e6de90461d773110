"""Judge URLs by rules and a list, with a blocked Bloom filter before an exact hash join.

Rules and listed URLs are entries of a host and a path in canonical form. A URL has one candidate for every shape
(labels of the host, length of the path) that some rule has. Candidates are looked up in the filter, whose blocks are
eight words of 64 bits with one bit of a key in each; only those that may be entries are joined with the entries
themselves, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import stored

WORDS = 8  # words of a block; a key has one bit in each
KEYS_A_BLOCK = 32  # 16 bits for each key: below one false positive in a thousand
SMALL = 64 << 20  # bytes up to which blocks or entries are broadcast, by their counted size
HOT = 2_000  # at most so many keys are held by more than a 2,000th of all possible hits

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["exact", "host", "path"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The canonical host and path of a URL.

    The host follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; the path goes on up to
    `?`, `#` or the end. Without `://`, and for null, both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = rest
    for mark in "/?#":
        host = F.substring_index(host, mark, 1)
    whole = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    path = F.substr(whole, F.length(host) + 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def entries_of(rules: DataFrame | None, listed: DataFrame | None) -> DataFrame:
    """exact, host, path, verdict: one row per rule, and per canonical URL of a list, which blocks that URL alone.

    `rules` holds host, path and verdict (allow or block; if two rules differ in nothing else, block), `listed` holds url.
    """
    rows = []
    if rules is not None:
        rows.append(rules.select(F.lit(False).alias("exact"), F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"))
    if listed is not None:
        host, path = host_and_path(F.col("url"))
        rows.append(listed.where("url IS NOT NULL").select(F.lit(True).alias("exact"), host.alias("host"), path.alias("path"), F.lit("block").alias("verdict")))
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return both.groupBy(*_KEY).agg(F.max("verdict").alias("verdict"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(*_KEY), F.lit(blocks))


def _bits() -> list[Column]:
    """The bit of a key in each word of its block, from six bits of a second hash."""
    second = F.xxhash64(F.lit(1), *_KEY)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0 to w7: the filter, one row for each block that holds a key."""
    bits = [bit.alias(f"w{i}") for i, bit in enumerate(_bits())]
    return entries.select(_block(blocks).alias("block"), *bits).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(candidates: DataFrame, entries: DataFrame, count: int) -> DataFrame:
    """The candidates that the filter of `count` entries does not exclude."""
    blocks = count // KEYS_A_BLOCK + 1
    table = bloom_blocks(entries, blocks)
    if blocks * 8 * (WORDS + 1) <= SMALL:
        table = F.broadcast(table)
    inside = None
    for i, bit in enumerate(_bits()):
        there = F.col(f"w{i}").bitwiseAND(bit) != 0
        inside = there if inside is None else inside & there
    return candidates.withColumn("block", _block(blocks)).join(table, "block").where(inside).select(*candidates.columns)


def exact_hits(possible: DataFrame, entries: DataFrame, size: int, small: int = SMALL) -> DataFrame:
    """Possible hits with the verdict of their entry.

    Entries of up to `small` bytes are broadcast. More are joined by a shuffle on the key, except for keys that
    more than a share of 1 / HOT of all possible hits have: their entries, below HOT in number, are broadcast, so
    that no key fills a task.
    """
    if size <= small:
        return possible.join(F.broadcast(entries), _KEY)
    possible = stored(possible, "possible-hits")
    uses = stored(possible.groupBy(*_KEY).agg(F.count("*").alias("uses")), "uses")
    most = (uses.agg(F.sum("uses")).first()[0] or 0) // HOT
    hot = stored(entries.join(uses.where(F.col("uses") > most), _KEY).select(*_KEY, "verdict"), "hot-entries")
    often = possible.join(F.broadcast(hot), _KEY)
    seldom = possible.join(F.broadcast(hot), _KEY, "left_anti").join(entries.hint("shuffle_hash"), _KEY)
    return often.unionByName(seldom)


def judge(pages: DataFrame, rules: DataFrame | None, listed: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row's `url`.

    A rule fits its host and all subdomains, if the path starts with the rule's. The rule with the longest text
    (host and path) wins, of equally long ones that with the longer host. A URL that no rule fits is blocked if its
    canonical URL is listed, else allowed; its `rule` is null. A null url, and one without `://`, has an empty host and path and is
    allowed. Repeated rows and rows without page_id are judged each by itself; an empty table gives no rows; other
    columns are not looked at. Without rules and list all is allowed.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    # Only these narrow rows are numbered and stored; no page moves.
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "urls")
    if rules is None and listed is None:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    entries = stored(entries_of(rules, listed), "url-entries")
    size = F.sum(F.octet_length("host") + F.octet_length("path") + 64)
    count, size, most = entries.agg(F.count("*"), F.coalesce(size, F.lit(0)), F.max("exact")).first()
    # Bounded by how long listed hosts and paths are, whatever their number.
    labels = F.size(F.split("host", r"\."))
    shapes = entries.where("NOT exact").select(labels.alias("labels"), F.length("path").alias("length")).distinct().collect()

    def candidate(exact: bool, host: Column, path: Column) -> Column:
        return F.struct(F.lit(exact).alias("exact"), host.alias("host"), path.alias("path"))

    tries = F.array([F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["length"]).alias("length")) for s in shapes])
    if shapes:
        fit = F.filter(tries, lambda s: (s["labels"] <= labels) & (s["length"] <= F.length("path")))
        tries = F.transform(fit, lambda s: candidate(False, F.call_function("substring_index", "host", F.lit("."), -s["labels"]), F.left(F.col("path"), s["length"])))
    whole = F.array(candidate(True, F.col("host"), F.col("path"))) if most else None
    tries = whole if not shapes else tries if whole is None else F.concat(tries, whole)
    decided = rows.select("row", "page_id", "host", "path", F.lit(None).cast("struct<rule:boolean,length:int,host:int,text:string,verdict:string>").alias("hit"))
    if tries is not None:
        candidates = rows.select("row", F.explode(tries).alias("c")).select("row", "c.*")
        hits = exact_hits(possible_hits(candidates, entries, count), entries, size, small)
        text = F.concat("host", "path")
        hit = F.struct(
            (~F.col("exact")).alias("rule"), F.length(text).alias("length"), F.length("host").alias("host"), text.alias("text"), "verdict"
        )
        best = hits.groupBy("row").agg(F.max(hit).alias("hit"))
        decided = decided.drop("hit").join(best, "row", "left")
    return decided.select(
        "page_id", "host", "path", F.when(F.col("hit.rule"), F.col("hit.text")).alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")
    )
