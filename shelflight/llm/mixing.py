"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8.0  # largest mean that is inverted at once; a larger one is the sum of several draws


def poisson_steps(mean: float) -> tuple[int, list[float]]:
    """Number of draws and the cumulative distribution of each: their sum has this mean."""
    draws = max(1, math.ceil(mean / STEP))
    rate = mean / draws
    term = math.exp(-rate)
    steps, total, k = [term], term, 0
    while k < rate or term > 1e-18:
        k += 1
        term = term * rate / k
        total = total + term
        steps.append(total)
    return draws, steps


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the parts, the same in every engine."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def target_rates(docs: DataFrame, weights: Mapping[str, float], rest: float, epochs: float) -> dict[str | None, float]:
    """Copies per document that give each source its weight of the characters; None stands for unlisted sources."""
    known = F.when(F.col("source").isin(*weights), F.col("source"))
    rows = docs.groupBy(known.alias("s")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("n"))
    amounts = {s: n for s, n in rows.collect() if n}  # at most one row per listed source and one for the others
    target = {s: w for s, w in [*weights.items(), (None, rest)] if s in amounts and w > 0}
    total, weight = sum(amounts.values()), math.fsum(target.values())
    return {s: w / weight * epochs * total / amounts[s] for s, w in target.items()}


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float], rest: float = 0.0, epochs: float = 1.0, seed: int = 17
) -> DataFrame:
    """Every document 0 or more times, so that each source makes up its weight of all characters, shuffled.

    `weights` names sources; `rest` is the weight of all others together, null included. Weights are relative to
    those of the sources that hold any text. The result has about `epochs` times the characters of `docs`. How
    often a document appears is a Poisson number with the mean that its source needs, read off the inverse
    distribution at a hash of seed and doc_id: repeatable, independent of partitions, no row is moved to decide.

    Returns the columns of `docs`, then copies (long, of this document), copy (long, from 1) and shuffle_key
    (long); these replace columns of the same names. Partitions are random sets of copies, in random order within.
    Rows that share a doc_id, null too, share their number of copies. Null texts count no characters. A source
    whose texts are all empty cannot reach any weight: its documents are left out, like those of weight 0. An empty
    table gives an empty result.
    """
    rates = target_rates(docs, weights, rest, epochs)
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))

    def drawn(mean: float) -> Column:
        draws, steps = poisson_steps(mean)
        held = F.array(*[F.lit(x) for x in steps])

        def draw(number: Column) -> Column:
            u = uniform(F.lit(str(seed)), key, number.cast("string"))
            return F.size(F.filter(held, lambda step: step <= u)).cast("bigint")

        if draws == 1:
            return draw(F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), F.lit(0).cast("bigint"), lambda sum_, i: sum_ + draw(i))

    copies = F.lit(0).cast("bigint")
    known = F.col("row.source").isin(*weights)
    if None in rates:
        copies = F.when(known.isNull() | ~known, drawn(rates[None])).otherwise(copies)
    for source, mean in rates.items():
        if source is not None:
            copies = F.when(F.col("row.source") == F.lit(source), drawn(mean)).otherwise(copies)
    kept = [c for c in docs.columns if c.lower() not in ("copies", "copy", "shuffle_key")]
    copied = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
        .withColumn("copies", copies).where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    )
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("copy").cast("string"), F.lit("place")))
    return (
        copied.withColumn("shuffle_key", F.conv(F.substring(place, 1, 13), 16, 10).cast("bigint"))
        .repartition("shuffle_key").sortWithinPartitions("shuffle_key")
        .select("row.*", "copies", "copy", "shuffle_key")
    )
