"""Verified links among items that share bucket keys, without writing out all pairs of a large bucket."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.llm.graph import components
from xrel.llm.shared import stored

# Rounds in which every item is compared with one member of another part; what is still apart then is compared in full.
ROUNDS = 3
# Nor are rounds worth while for this many memberships.
FEW = 2_000
# A pair at the similarity asked for differs in more components than most_apart() says with this chance at most.
CUT = 1e-9

Verify = Callable[[DataFrame], DataFrame]


def most_apart(hashes: int, similarity: float, least: int = 0) -> int:
    """Components in which signatures of two sets at this similarity differ, `least` or more, but for a chance of CUT.

    Components that agree in the bits that are kept count as equal, so fewer may be seen to differ, never more.
    """
    apart = 1 - similarity
    chance = [math.comb(hashes, k) * apart**k * similarity ** (hashes - k) for k in range(hashes + 1)]
    return next(m for m in range(least, hashes + 1) if math.fsum(chance[m + 1 :]) <= CUT)


def differing(words: int, width: int) -> Column:
    """Number of components of `width` bits, 4 or 8, in which the signatures bits_a and bits_b differ."""
    ones = ((1 << 64) - 1) // ((1 << width) - 1)
    out = F.lit(0)
    for i in range(words):
        x = F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))
        # The lowest bit of a component becomes whether any of its bits is set.
        for shift in (1, 2, 4)[: width.bit_length() - 1]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        out = out + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return out


def connected(
    members: DataFrame, bits: DataFrame, words: int, width: int, most: int, verify: Verify, candidates: Verify | None = None
) -> DataFrame:
    """(node, component) of all items that verified pairs within the buckets of members (key, id) connect.

    verify() takes candidate pairs (a, b) and returns those that hold. bits (id, bits) holds `words` 64-bit words of
    signature per item, with components of `width` bits; pairs that differ in more than `most` of them are not verified.
    Every other pair of a bucket is verified or lies within one component of verified links, so components are the same
    as if all these pairs had been compared.

    First every item is compared with the smallest that it shares a bucket with, then, a few times, with one of another
    component in a bucket: one pair per item and round, however large its buckets are. What then shares a bucket with
    another component goes to `candidates`: given rows (id, part), it returns all pairs (a, b) of different parts that
    may hold, by an exact filter of its own. Without it, the pairs of these buckets are compared one by one.
    """

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
        return both.where(differing(words, width) <= most).select("a", "b")

    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1").drop("n")
    shared = stored(members.join(sizes, "key"), "buckets")
    first = shared.where("hub < id").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = stored(verify(near(first)), "verified")
    opened = shared.select("key", "id")
    for turn in range(ROUNDS + 1):
        parts = components(links)
        labelled = opened.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("part")
        )
        # One member of the lowest part of each bucket and one of the highest, chosen anew each time.
        choice = F.struct("part", F.xxhash64("id", F.lit(turn)), "id")
        ends = labelled.groupBy("key").agg(F.min(choice).alias("low"), F.max(choice).alias("high")).where("low.part <> high.part")
        rest = stored(
            labelled.join(ends.select("key", "low.part", F.col("low.id").alias("low"), F.col("high.id").alias("high")).withColumnRenamed("part", "low_part"), "key"),
            "apart",
        )
        left_over = rest.count()
        if not left_over:
            break
        last = turn == ROUNDS or left_over <= FEW
        if not last:
            other = F.when(F.col("part") == F.col("low_part"), F.col("high")).otherwise(F.col("low"))
            asked = rest.select("id", other.alias("other"))
            chosen = asked.groupBy("id").agg(F.min_by("other", F.xxhash64("id", "other", F.lit(turn))).alias("other"))
            pairs = near(chosen.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
        elif candidates:
            pairs = candidates(stored(rest.select("id", "part").distinct(), "left-apart"))
        else:
            # A pair comes from the least key that both have, so it comes once.
            own = rest.groupBy("id").agg(F.collect_set("key").alias("keys"))
            signed = stored(rest.select("key", "id", "part").join(own, "id").join(bits, "id"), "signed")
            left, right = (signed.toDF(*(c if c == "key" else f"{c}_{x}" for c in signed.columns)) for x in "ab")
            apart = (F.col("id_a") < F.col("id_b")) & (F.col("part_a") != F.col("part_b")) & (differing(words, width) <= most)
            once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
            pairs = left.join(right, "key").where(apart & once).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        links = links.unionByName(stored(verify(pairs), "verified"))
        if last:
            return components(links)
        opened = rest.select("key", "id")
    return parts
