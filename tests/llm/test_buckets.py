from __future__ import annotations

import random
from math import comb

from xrel.llm import near_duplicates as N
from xrel.llm.buckets import connected, most_apart
from xrel.llm.paragraphs import BITS_PER_HASH, bit_words, tuned_bands


def packed(parts, width, words):
    per_word = len(parts) // words if width == 4 else 8
    out = []
    for i in range(words):
        x = sum(v << (width * k) for k, v in enumerate(parts[i * per_word : (i + 1) * per_word]))
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def pairs_found(spark, sizes, hashes, width, words, most):
    """Numbers of differing components, all of their bits differing, whose pairs are verified."""
    rng = random.Random(8)
    members, bits = [], []
    for key, apart in enumerate(sizes):
        one = [rng.randrange(1 << width) for _ in range(hashes)]
        other = list(one)
        for k in rng.sample(range(hashes), apart):
            other[k] ^= (1 << width) - 1
        for i, own in enumerate((one, other)):
            members.append((key, 2 * key + i))
            bits.append((2 * key + i, packed(own, width, words)))
    found = connected(
        spark.createDataFrame(members, "key bigint, id bigint"), spark.createDataFrame(bits, "id bigint, bits array<bigint>"), words, width, most, lambda p: p
    )
    return sorted({sizes[r.node // 2] for r in found.collect()})


def test_no_pair_within_the_bound_is_dropped(spark):
    for similarity in (0.8, 0.85):
        most = most_apart(60, similarity, 19)
        assert most >= 19
        assert pairs_found(spark, list(range(0, 61, 1)), 60, N.BITS, N.BIT_WORDS, most) == list(range(most + 1))
    bands, rows = tuned_bands(0.8)
    most = most_apart(bands * rows, 0.8)
    assert pairs_found(spark, list(range(bands * rows + 1)), bands * rows, BITS_PER_HASH, bit_words(bands * rows), most) == list(range(most + 1))


def test_loss():
    for hashes, similarity in ((60, 0.8), (60, 0.85), (20, 0.8)):
        most = most_apart(hashes, similarity)
        assert sum(comb(hashes, k) * (1 - similarity) ** k * similarity ** (hashes - k) for k in range(most + 1, hashes + 1)) <= 1e-9
    assert most_apart(20, 1.0) == 0
