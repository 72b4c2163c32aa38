"""Mixing sources to target weights (operator 1): whole copies plus one hash-seeded Bernoulli copy per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.functions.ranks import distributed_rank
from xrel.llm.shared import lookup, stored

# Weights of the sources in ascending order, repeating; no source gives more than this many times its size.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
SEED = "mix-1"


def text_size(text: str = "text") -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> tuple[DataFrame, int]:
    """(source, source_size, target) per source, and the number of sources.

    All sizes are shared out by weight; what would exceed `most` times a source's size is shared again among the
    others. With a level L the targets are min(most * size, weight * L), so L is where they sum to the whole:
    stepping to the root of the present slope reaches it from below, each step one small sum over the sources.
    """
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # Code point order is byte order; a null source comes last.
    named = sums.withColumn("_key", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")))
    ranked = distributed_rank(named.withColumn("_all", F.lit(0)), ["_all"], "_key", "_rank")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighted = stored(
        ranked.select(
            "source",
            "source_size",
            F.element_at(listed, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("_cap"),
        ),
        "mix-weights",
    )
    whole, n_sources = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    level = 0.0
    while whole:
        full = F.col("_cap") < F.col("weight") * F.lit(level)
        capped, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        higher = (whole - capped) / open_weight if open_weight else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    target = F.least("_cap", F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", target.alias("target")), n_sources


def bernoulli(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from the document's id, or from its text where it has none; the same in every run."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def _with_copies(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Add source_size, target and copies to rows with source, size and _draw."""
    targets, n_sources = source_targets(sized.select("source", "size"), weights, most)
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("_source")
    joined = lookup(sized.select("*", key), targets.select(key, "source_size", "target"), "_source", n_sources)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    copies = (F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("int")).cast("int")
    return joined.withColumn("copies", copies)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken (words, repeats counted).

    Every document of a source is taken floor(rate) times, with rate = target / source_size, and once more if its
    Bernoulli number is below the fraction. A source without words has target 0 and is not taken. Null sources are
    one source, last in order. Repeated rows share one decision; rows without an id decide by their text. Only sums
    per source are shuffled; other columns are ignored. An empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", text_size().alias("size"), bernoulli(seed=seed).alias("_draw"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return _with_copies(sized, weights, most).select("doc_id", "size", "source_size", "target", "copies", taken)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, as often as mix() takes it."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    sized = docs.select(whole, "source", text_size().alias("size"), bernoulli(seed=seed).alias("_draw"))
    repeated = _with_copies(sized, weights, most).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"))
    return repeated.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
