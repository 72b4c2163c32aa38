from __future__ import annotations

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tests.llm.test_paragraphs import got
from xrel.llm import key_tables as K
from xrel.llm import near_duplicates as N
from xrel.llm import paragraphs as P
from xrel.llm import passages as S
from xrel.llm.words import mix


def test_lines_without_a_partner_go_no_further(spark, table, monkeypatch):
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    copied, near = [line() for _ in range(15)], line()
    rows = [(k, "\n".join([line(), line(), *([copied[k % 15]] if k < 30 else [])])) for k in range(150)]
    rows += [(200, near), (201, near + " end")]
    kept, plain = [], P.stored_by_table
    monkeypatch.setattr(P, "stored_by_table", lambda *a: kept.append(plain(*a)) or kept[-1])
    assert got(P.without_repeated_paragraphs(table(rows))) == sorted(brute.repeated_paragraphs(rows), key=repr)
    found = kept[0].selectExpr("size(keys) keys", "size(bits) bits").collect()
    assert 30 + 2 <= len(found) < 60 and all(r["keys"] > 0 and r["bits"] > 0 for r in found)


def test_a_window_is_written_once_a_row():
    text = "a b c " * 60 + "x"
    batch = pa.RecordBatch.from_pydict({"id": [7], "n": pa.array([0], pa.int32()), "text": [text], "runs": [[{"first": 40, "last": 131}, {"first": 0, "last": 39}]]})
    (out,) = S._windows(50)(iter([batch]))
    own = text.split()
    want: dict[bytes, list[int]] = {}
    for k in range(132):
        want.setdefault(hashlib.blake2b(" ".join(own[k : k + 50]).encode(), digest_size=16).digest(), []).append(k)
    assert dict(zip(out.column(0).to_pylist(), out.column(3).to_pylist(), strict=True)) == want and len(out) == 4
    assert out.column(1).to_pylist() == [7] * 4 and out.column(2).to_pylist() == [0] * 4


def test_runs_close_to_another_need_no_digest():
    bits = bytearray(b"\xff" * 4096)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "n": pa.array([0, 0], pa.int32()), "text": ["a b " * 60, " ".join(f"w{k}" for k in range(90))]})
    (out,) = S._repeated_runs(50, 20, SimpleNamespace(value=bits))(iter([batch]))
    rows = out.to_pylist()
    assert {r["id"] for r in rows if r["close"]} == {1}
    assert all((r["text_a"] == r["text_b"] == 0) == r["close"] for r in rows)


def test_rarest_shingles_of_many_sets_at_once():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 17, 0, 60, 200, 3)]
    counts = rng.integers(0, 4, 1 << 8).astype(np.int32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(10, 16), pa.int64()), pa.array(range(20, 26), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "part", "items"]
    )
    (out,) = N._prefixes(SimpleNamespace(value=counts), 80)(iter([batch]))
    want = []
    for i, own in enumerate(sets):
        n = len(own)
        odd = np.bincount((mix(own) & np.uint64(N.ODD_BITS - 1)).view(np.int64), minlength=N.ODD_BITS) & 1
        odd = np.packbits(odd.astype(np.uint8)).view("<i8").tolist()
        order = sorted(own.tolist(), key=lambda x: (counts[x & 255], x))[: n - -(-80 * n // 100) + 1]
        want += [(x - (1 << 64) if x >> 63 else x, 10 + i, 20 + i, n, k, odd) for k, x in enumerate(order)]
    assert [tuple(r.values()) for r in out.to_pylist()] == want


def test_pages_of_the_bit_table(spark, monkeypatch):
    """Tables of one page and of many, against bits set one by one."""
    monkeypatch.setattr(K, "GATHERED", 3000)
    for n in (0, 500, 20_000):
        keys = mix(np.arange(1, n + 1, dtype=np.uint64)).view(np.int64)
        repeated = spark.createDataFrame([(int(k),) for k in keys], "anchor bigint").repartition(5)
        table = K.key_table(repeated)
        bits = 8 * len(table)
        want = {((k & 0xFFFFFFFF) + j * (((k >> 32) & 0xFFFFFFFF) | 1)) & (bits - 1) for k in keys.tolist() for j in range(K.PROBES)}
        assert bits == max(1 << 15, 1 << (16 * n - 1).bit_length()) and len(table) > 0
        assert set(np.flatnonzero(np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little")).tolist()) == want
