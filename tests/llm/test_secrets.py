from __future__ import annotations

import hashlib
import random
import string

import duckdb

from tests.llm import brute
from xrel.llm import secrets as S
from xrel.llm.queries import op9_secret_scan

ODD = [None, "", "password: hunter2abc", "PASSWORD = 'short'", "api_key=\"abcdEFGH1234\" token:xx secret=yyyyyyyy", "ſecret=abcdefgh",
       "AKIAABCDEFGHIJKL AKIA123 xAKIAAKIAAKIAAKIA1", "é" * 3 + "0123456789abcdef" * 2 + " ABCDEF" + "0" * 31, "apikey: a=b:c==token=12345678",
       "tokentoken=abcdefghi passwd:aaaaaaaa.", "🔑 secret=💥abcdefgh secret: =abcdefgh", "f" * 33 + "g" + "a" * 32]


def test_base_spans():
    for text in ODD:
        assert [(S.KINDS[k], s, e) for s, k, e in S.base_spans(text or "")] == brute.base_secrets(text)


def test_query_against_patterns(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in op9_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in rows:
        base = brute.base_secrets(text)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex")]
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r.spans.split(",")) | {""}


def test_random_strings(spark, table):
    rng = random.Random(4)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    keys = [key(string.ascii_letters + string.digits, 40) for _ in range(30)] + [key("0123456789ABCDEF", 48) for _ in range(30)]
    written = ["internationalisation2024/overview", "http/www.example.com/some/long/path/index2", "a" * 30 + "1", "MyLongClassNameForTesting2Things", "1" * 25]
    rows = [(i, f"a {k} b") for i, k in enumerate(keys)] + [(100 + i, f"see {w} now") for i, w in enumerate(written)] + [(None, None), (7, "")]
    found = {r.doc_id: r["random"] for r in S.secrets(table(rows)).collect()}
    hit = [i for i in range(len(keys)) if i != 7 and found[i]]
    assert len(hit) >= 50 and all((found[i][0]["start"], found[i][0]["end"]) == (2, 2 + len(keys[i])) for i in hit)
    assert not any(found[100 + i] for i in range(len(written))) and found[None] == []
    assert S.secrets(table([])).count() == 0


def test_long_candidates(spark, table):
    rng = random.Random(9)
    alphabets = (string.ascii_letters + string.digits + "+/", "0123456789ABCDEF")
    for n in (1_000, 1_050, 2_000, 100_000, 1_000_000):
        for letters in alphabets:
            assert S.written_like("".join(rng.choices(letters, k=n))) < 1e-9
        assert S.written_like(("a" * 40 + "1") * (n // 41)) > 0.99
    rows = [(n, "see " + "".join(rng.choices(alphabets[0], k=n)) + " now") for n in (1_200, 5_000, 200_000)] * 5
    found = S.secrets(table(rows + [(1, "password: hunter2abc")])).collect()
    assert any(r["random"] for r in found if r.doc_id == 200_000) and [len(r.base) for r in found if r.doc_id == 1] == [1]


def test_binomial_tail():
    from fractions import Fraction
    from math import comb

    for n, least in ((0, 0), (19, 0), (19, 5), (60, 60), (300, 12), (900, 70), (900, 400)):
        want = sum(comb(n, k) * Fraction(1, 10) ** k * Fraction(9, 10) ** (n - k) for k in range(least, n + 1))
        assert abs(S._binomial_tail(n, least, 0.1) / float(want) - 1) < 1e-9


def test_keys_in_paths():
    rng = random.Random(11)
    key = "a1" + "".join(rng.choices(string.ascii_letters + string.digits, k=48))
    while not S.random_candidates(key, []):
        key = "a1" + "".join(rng.choices(string.ascii_letters + string.digits, k=48))
    for before, after in (("/api-v1/", ""), ("see some_name/", "-x/y z"), ("/a-b+", "_c/d"), ("api/v1-", "")):
        text = before + key + after
        assert [(s, e) for s, e, _, _ in S.random_candidates(text, [])] == [(len(before), len(before) + len(key))]
    # Runs that fit an alphabet stay whole, and one without digits is no candidate.
    assert [p[:2] for p in S.parts("ab1/" + key)] == [(0, "ab1/" + key)] and not list(S.parts("some-long/path-to_a+page"))
    # A base span takes only the part that it touches.
    assert not S.random_candidates("/api-v1/" + key, [(8, 2, 40)])
