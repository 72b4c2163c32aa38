from __future__ import annotations

import gc
import random
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa

from xrel.llm import key_tables as K
from xrel.llm.paragraphs import tuned_bands, without_repeated_paragraphs
from xrel.llm.words import mix


def test_repeated_keys_and_their_table(spark, monkeypatch):
    """Keys in many blocks, one of them very often; keys with no high bits are dealt and marked as well."""
    monkeypatch.setattr(K, "GATHERED", 500)
    rng = np.random.default_rng(3)
    keys = mix(rng.integers(1, 3000, 6000, dtype=np.uint64)) >> np.uint64(6)
    keys = np.concatenate([keys, np.full(5000, 77, np.uint64), np.array([2**64 - 1, 2**64 - 1, 0], np.uint64)])
    rng.shuffle(keys)
    rows = spark.createDataFrame([(x.tobytes(),) for x in np.array_split(keys, 40)], "keys binary").repartition(5)

    def blocks(batches):
        return K.key_blocks(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) for b in batches)

    repeated = K.repeated_keys(rows, blocks, "repeated")
    wanted = sorted(int(np.uint64(k).view(np.int64)) for k, n in Counter(keys.tolist()).items() if n > 1)
    assert sorted(r.anchor for r in repeated.collect()) == wanted
    table = K.key_table(repeated)
    assert K.marked(table, np.array(wanted)).all()
    others = mix(np.arange(10**6, 10**6 + 100_000, dtype=np.uint64)).view(np.int64).reshape(-1, 10)
    assert K.marked(table, others).shape == others.shape and K.marked(table, others).mean() < 0.01
    assert not any(K.key_table(repeated.limit(0)))


def test_blocks_hold_a_key_twice_at_most():
    blocks = list(K.key_blocks([np.array([5] * 9 + [6], np.uint64)]))
    assert sum(len(x) for b in blocks for x in b.column(1).to_pylist()) == 8 * 3
    assert list(K.key_blocks([])) == list(K.key_blocks([np.empty(0, np.uint64)])) == []
    assert pa.types.is_binary(blocks[0].column(1).type)


def test_driver_holds_little_and_not_for_long(spark, table, monkeypatch):
    """What the driver hands to tasks is in proportion to the repeated band keys, and gone when the lines are known."""
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(400)]
    rows = [(k, line + f"\nhead {k}") for k, line in enumerate(lines + lines)]
    sizes, held, broadcast = [], [], type(spark.sparkContext).broadcast

    def spied(context, value):
        out = broadcast(context, value)
        sizes.append(len(value))
        held.append(weakref.ref(out))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", spied)
    found = without_repeated_paragraphs(table(rows))
    gc.collect()
    bands, _ = tuned_bands(0.8)
    assert sizes and sum(sizes) <= 4 * bands * len(lines)
    assert not any(ref() for ref in held)
    assert found.where("n_removed > 0").count() == len(lines)
